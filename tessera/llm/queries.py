"""Queries of the corpus operators and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .exact_dedup import ORACLE_OP4, op4_exact_dedup
from .fingerprints import op9_syncmer_fingerprints
from .line_dedup import ORACLE_OP8, op8_line_dedup
from .ngram_join import op1_ngram_join
from .packing import op2_kk_packing
from .quality import op5_quality_gam
from .secrets import ORACLE_OP10, op10_secret_scan
from .token_counts import op7_token_counts
from .toxicity import op3_toxicity_fm

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_kk_packing": op2_kk_packing,
    "op3_toxicity_fm": op3_toxicity_fm,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_gam": op5_quality_gam,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_syncmer_fingerprints": op9_syncmer_fingerprints,
    "op10_secret_scan": op10_secret_scan,
}
#: Where SQL can express the result; the others are tested against brute force in tests/llm.
ORACLE_SQL = {"op4_exact_dedup": ORACLE_OP4, "op8_line_dedup": ORACLE_OP8, "op10_secret_scan": ORACLE_OP10}
