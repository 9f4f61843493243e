"""A corpus pipeline: toxic documents go, then copies, then near copies; secrets are blotted out;
what is left is packed into training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet in the shared folder and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, ngram_join, packing, secrets, toxicity
from tessera.llm.common import settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model is fitted on the labels of the training fold.

    Null and empty texts stay unless an empty text itself scores so high; rows with equal texts stay
    or go together; an empty table stays empty."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for runs of white space, the least doc_id stays.

    Null texts are empty ones, and copies of each other; a null id is larger than any other; of rows
    that repeat an id and a text one stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a 5-gram Jaccard similarity of 0.8 or more, the least doc_id stays.

    Texts without words, null ones too, are copies of each other; a null id is larger than any other."""
    return ngram_join.keep_one_of_each(docs)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes [SECRET]; n_chars follows; no document goes. A null text stays null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. A null or empty text is one piece of its end id;
    each row is a document of its own, its id may repeat or be null; an empty table gives no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", blot_secrets),
    ("packing", pack),
]

#: A fitted model, similarity components and a tokenizer are not SQL's; tests/llm/test_pipeline.py
#: holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
