"""Line dedup with DataFrame functions only: range-partitioned line hashes, sorted by document
and position within; the first occurrence streams by and every later document drops the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, partitions, settled, text_of


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space at both ends, A-Z lower-cased, other letters untouched."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, upper, upper.lower()))


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, per_range: int = 64, hot: int = 16) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: ``doc_id, text_hash, keep_runs``.

    ``keep_runs`` is the run-length compressed bitmap of a document's lines: pairs (keep, drop),
    that many lines kept, then that many dropped; lines after the last pair are kept. The text
    itself never takes part. ``text_hash`` (xxhash64 of the text) tells rows apart that repeat
    an id with another text; rows that repeat both share one bitmap.

    A line's key is two independent 64-bit hashes. Keys are range-partitioned and sorted by
    document and position, and a window streams the first document of each. A key that holds about
    a quarter of a range's lines or more would make its task long: such keys take another
    way, the aggregation of their smallest document, one row a map task. They are those found ``hot``
    times in a sample of ``per_range`` lines for each range, which decides the way of a line
    and never the result: both ways drop the same lines. There are at most ``per_range / hot`` of
    them for each range, whatever the number of lines, and so many rows are broadcast.

    Defined results: null or empty text is one empty line; a null id counts as one document
    that is larger than all others; an empty table gives no bitmaps; other columns, whatever their
    names, are ignored.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    keyed = settled(keyed.select("doc_id", "text_hash", "pos", F.xxhash64("_key").alias("k1"), F.xxhash64(F.lit("line"), "_key").alias("k2")), "lines")

    ranges = partitions(spark)
    share = min(1.0, per_range * ranges / max(1, keyed.count()))
    often = keyed.select("k1").sample(share, seed=7).groupBy("k1").count().where(F.col("count") >= hot).select("k1")
    often = settled(often, "line-hot")
    some = bool(often.take(1))

    by = Window.partitionBy("k1", "k2").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    drops = (
        (keyed.join(F.broadcast(often), "k1", "left_anti") if some else keyed)
        .repartitionByRange(ranges, "k1", "k2")
        .sortWithinPartitions("k1", "k2", F.col("doc_id").asc_nulls_last(), "pos")
        .withColumn("_first", F.first("doc_id").over(by))
        .where(~F.col("doc_id").eqNullSafe(F.col("_first")))
        .select("doc_id", "text_hash", "pos")
    )
    if some:
        late = keyed.join(F.broadcast(often), "k1", "left_semi")
        heads = settled(late.groupBy("k1", "k2").agg(F.min("doc_id").alias("_first")), "line-heads")
        late = late.join(F.broadcast(heads), ["k1", "k2"])
        drops = drops.unionByName(late.where(~F.col("doc_id").eqNullSafe(F.col("_first"))).select("doc_id", "text_hash", "pos"))

    per_doc = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    runs = (
        drops.withColumn("_run", F.col("pos") - F.dense_rank().over(per_doc))
        .groupBy("doc_id", "text_hash", "_run")
        .agg(F.min("pos").alias("s"), (F.max("pos") - F.min("pos") + 1).alias("n"))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("_runs"))
    )
    pairs = F.expr("transform(_runs, (r, i) -> struct(r.s - if(i = 0, 0, _runs[i - 1].s + _runs[i - 1].n) as keep, r.n as drop))")
    return runs.select("doc_id", "text_hash", pairs.alias("keep_runs"))


def kept_lines(lines: str, runs: str) -> Column:
    """The lines of array column ``lines`` that the bitmap column ``runs`` keeps."""
    flags = f"flatten(transform({runs}, x -> concat(array_repeat(true, x.keep), array_repeat(false, x.drop))))"
    return F.expr(f"transform(filter(arrays_zip({lines}, {flags}), z -> coalesce(z['1'], true)), z -> z['{lines}'])")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped, kept_text``.

    Defined results: null text is empty, one empty line; a row without a bitmap keeps all its lines
    (so does every row if there are no bitmaps); rows that repeat an id and a text take the same
    bitmap, a null id that of null; an empty table gives no rows; other columns are ignored."""
    own = docs.select("doc_id", text_of().alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    maps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), "keep_runs")
    met = own.join(maps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left")
    met = met.withColumn("_lines", F.when(F.col("keep_runs").isNotNull(), F.split("_text", "\n", -1)))
    n_lines = (F.char_length("_text") - F.char_length(F.translate("_text", "\n", "")) + 1).cast("long")
    dropped = F.coalesce(F.expr("aggregate(keep_runs, 0L, (a, x) -> a + x.drop)"), F.lit(0).cast("long"))
    kept = F.when(F.col("keep_runs").isNull(), F.col("_text")).otherwise(F.array_join(kept_lines("_lines", "keep_runs"), "\n"))
    return met.select("doc_id", F.when(F.col("_lines").isNull(), n_lines).otherwise(F.size("_lines").cast("long")).alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept_text"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all ``documents``; nulls, empty texts, repeated rows and an empty table as in
    ``line_keep_bitmaps`` and ``apply_bitmaps``."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, line_keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_OP8 = r"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(pos)
), f AS (SELECT k, min(doc_id) AS first_id FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT l.*, coalesce(first_id <> doc_id, false) AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
