"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, discard, free_prefix, settled, text_of


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, "[ \\t-\\r]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, broadcast_keys: int = 200_000, with_hash: bool = False, with_sha256: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept``; ``with_hash`` adds ``text_hash``
    (xxhash64 of the text as it is), ``with_sha256`` adds ``text_sha256`` of the normalised text.

    Refinement. One scan normalises each text and notes its length and a prefix hash. Lengths that
    occur once are done; among the others, so are prefixes that occur once. Only texts that may be
    in a surviving (length, prefix) group are read on: their rows are known by id and length of the
    text as it is, so the second scan normalises and hashes (SHA-256) these alone. If they are too
    many to broadcast, all are hashed where they are read, which gives the same result and moves
    no text. ``with_sha256`` has to hash every text anyhow; it does so in the first scan, and the
    later steps compare what the table holds.

    Every grouping is a partial aggregation, so a group that holds a third of the rows costs each
    map task one row; joins back to rows are sort-merge joins, which AQE splits when skewed, unless
    the other side is counted to be at most ``broadcast_keys`` rows.

    Defined results: null text is empty text, empty texts are copies of each other; of equal
    texts the smallest id stays, a null id counting as larger than any other; rows that repeat
    an id with an equal text are copies too, exactly one of them has ``kept``; an empty table
    gives an empty result; other columns of ``docs``, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").alias("raw"), *[F.xxhash64("text").alias("text_hash")] * with_hash, normalised(F.col("text")).alias("norm"))
    keys = ["len", "prefix"]
    rows = rows.withColumns({"len": F.octet_length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, prefix_chars))})
    extra = ["text_hash"] * with_hash + ["text_sha256"] * with_sha256
    row = F.monotonically_increasing_id().alias("row")

    light = rows.withColumn("text_sha256", F.sha2("norm", 256)) if with_sha256 else rows
    light = settled(light.select("doc_id", "raw", *keys, row, *extra), "dedup-light")
    lengths = settled(light.groupBy("len").count().where("count > 1").select("len"), "dedup-lengths")
    groups = light.join(broadcast_below(lengths, broadcast_keys), "len", "left_semi").groupBy(*keys).count().where("count > 1")
    survivors = settled(groups.select(*keys), "dedup-survivors")
    discard(lengths)
    few = broadcast_below(survivors, broadcast_keys)
    alone = light.join(few, keys, "left_anti")

    grouped = light.join(few, keys, "left_semi")
    if with_sha256:
        hashed = grouped.withColumn("full", F.col("text_sha256"))
    else:
        wanted = settled(grouped.select(F.col("doc_id").alias("id"), F.col("raw").alias("size")).distinct(), "dedup-wanted")
        if wanted.count() <= broadcast_keys:
            rows = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("raw") == F.col("size")), "left_semi")
        hashed = settled(rows.join(few, keys, "left_semi").select("doc_id", "len", F.sha2("norm", 256).alias("full"), row, *extra), "dedup-hashed")
        discard(wanted)

    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    heads = hashed.groupBy(F.col("len").alias("hlen"), F.col("full").alias("hfull")).agg(F.min(order).alias("head"), F.count("*").alias("size"))
    heads = settled(heads.where("size > 1"), "dedup-heads")  # a plain scan, so that AQE can split a large group's join
    met = hashed.join(broadcast_below(heads, broadcast_keys // 2), (F.col("full") == F.col("hfull")) & (F.col("len") == F.col("hlen")), "left")
    met = met.select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("kept"),
        *extra,
    )
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra).unionByName(met)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, of any names, and one row of each group of equal texts.

    The dropped ones are few and narrow (id, hash of the text as it is): they are broadcast if
    counted to be at most 200,000, so that the texts stay where they are; beyond that the join
    shuffles. Nulls, empty texts, ties, repeated rows and empty tables as in ``exact_dedup``; of
    rows that are equal in id and text any one stays."""
    p = free_prefix(docs)
    found = settled(exact_dedup(docs, with_hash=True), "dedup-result")
    by_key = found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    by_key = settled(by_key.where("not kept or n > 1"), "dedup-dropped")
    discard(found)
    dropped = by_key.where("not kept").select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}dropped"))
    own = docs.withColumn(f"{p}key", F.xxhash64(text_of()))
    out = own.join(broadcast_below(dropped, 200_000), F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}key") == F.col(f"{p}dropped")), "left_anti")
    # Rows that repeat an id with its text are there only if the key says so.
    repeated = by_key.where("kept").limit(1).take(1)
    return (out.dropDuplicates(["doc_id", f"{p}key"]) if repeated else out).drop(f"{p}key")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of all ``documents`` with the SHA-256 of every normalised text; nulls, ties,
    repeated rows and an empty table as there."""
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"), with_sha256=True)


ORACLE_OP4 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
