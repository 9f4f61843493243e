"""Exact dedup and line dedup against plain Python, with odd rows."""

import hashlib
import random
import re

from tessera.llm import exact_dedup as E
from tessera.llm import line_dedup as L


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [
    (5, "a  b\n"), (3, "a b "), (9, "a b "), (3, "a b "), (7, None), (8, ""), (None, "a\tb "), (None, "only"), (None, "only"), (10, " a b"), (11, "x" * 300 + "1"), (12, "x" * 300 + "2"),
    (13, "a b "), (14, "word " * 30000), (15, "word\x0b" * 30000),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, keep_id string, _len int, kept boolean").repartition(3)


def brute(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    least = {k: min(v, key=lambda x: (x is None, x or 0)) for k, v in groups.items()}
    return sorted(((i, least[key(t)], len(groups[key(t)]), sha(key(t))) for i, t in rows), key=str), len(groups)


def test_exact_dedup(spark):
    want, texts = brute(ODD)
    for options in ({}, {"broadcast_keys": 0, "prefix_chars": 3}):
        rows = E.exact_dedup(frame(spark, ODD), with_sha256=True, **options).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == want
        assert sum(r.kept for r in rows) == texts and all(r.doc_id == r.keep_id for r in rows if r.kept)
        # The same with a full hash of the survivors only.
        rows = E.exact_dedup(frame(spark, ODD), **options).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=str) == sorted((w[:3] for w in want), key=str)
        assert sum(r.kept for r in rows) == texts and all(r.doc_id == r.keep_id for r in rows if r.kept)
    kept = E.keep_first(frame(spark, ODD)).collect()
    assert len(kept) == texts and all(r.keep_id == "x" for r in kept)
    assert E.exact_dedup(frame(spark, ODD).limit(0)).count() == 0


def test_one_normalising_scan(spark):
    """With the digest of every text asked for, the texts are read once; without, no more than the
    survivors are normalised a second time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = E.exact_dedup(docs, with_sha256=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "text#" not in plan.replace("text_sha256#", "")


def test_clashing_names(spark):
    names = ["_t_id", "_t_dropped", "_t_key", "_tid", "_tkey", "len", "prefix", "raw", "norm", "row", "full", "id", "size"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in ((2, "a b"), (1, "a  b"), (1, "a b"), (1, "a b"))], ["doc_id", "text", *names])
    kept = E.keep_first(docs).collect()
    assert [(r.doc_id, *[r[n] for n in names]) for r in kept] == [(1, *names)] and kept[0].asDict().keys() == set(docs.columns)



def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and len(holders[key(x)]) > 1 and i != min(holders[key(x)], key=lambda d: (d is None, d or 0)) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = ["A shared line.", "a SHARED line. ", "\tÄ shared line!", "ä shared line!", "short", "", "Ünique line nr", "one more line here", "\x85odd white space\x85"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "A shared line.\n" * 20000 + "end of the text"), (None, "A shared line.\nnobody's own line"), (None, "nobody's own line"), (2004, "end of the text"), (2004, "end of the text"), (2004, "other text of it\nA shared line.")]
    df = frame(spark, rows)
    want = brute_lines(rows)
    for options in ({}, {"hot": 1}):
        got = L.apply_bitmaps(df, L.line_keep_bitmaps(df, **options)).collect()
        assert sorted(map(tuple, got), key=str) == want
    many = frame(spark, [(i, "the very same line\nline number %d of all" % i) for i in range(3000)])  # a hot key
    got = L.apply_bitmaps(many, L.line_keep_bitmaps(many)).collect()
    assert sum(r.n_dropped for r in got) == 2999
    assert L.apply_bitmaps(df.limit(0), L.line_keep_bitmaps(df.limit(0))).count() == 0


def test_no_python_in_the_native_plans(spark, sf_dir):
    from tessera.llm.queries import QUERIES

    for name in ("op8_line_dedup", "op10_secret_scan"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name
