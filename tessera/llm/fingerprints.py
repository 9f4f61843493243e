"""Document fingerprints of closed syncmers: context-free anchors of a text."""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, partitions, settled, slices, text_of

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n characters from those of n."""
    return (h[:-n] ^ (h[:-n] >> np.uint64(29))) * _A + h[n:]


def anchors(text: str, k: int = 16, s: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers: the k-mers of code points whose least
    s-mer (by hash) is their first or their last. Whether a k-mer is one depends on nothing
    around it, so an edit moves no anchor that it does not touch. ``k`` and ``s`` are powers of
    two. A text of fewer than k code points has itself as its one anchor, an empty one none."""
    x = code_points(text)
    if len(x) < k:
        n = min(1, len(x))
        return np.zeros(n, np.int64), _mix(np.array([_fold(x)] * n, np.uint64))
    h, n, small = _mix(x), 1, None
    while n < k:
        if n == s:
            small = _mix(h)
        h = _joined(h, n)
        n *= 2
    window, least, n = k - s + 1, small, 1
    while 2 * n <= window:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if rest := window - n:
        least = np.minimum(least[:-rest], least[rest:])
    at = np.flatnonzero((small[: len(least)] == least) | (small[window - 1 :] == least))
    return at, _mix(h[at])


def _fold(x: np.ndarray) -> int:
    out = 0
    for v in x.tolist():
        out = (out * 0x100000001B3 + v + 1) & 0xFFFFFFFFFFFFFFFF
    return out


#: An anchor of a fingerprint, 12 bytes.
ANCHOR = np.dtype([("hash", "<u8"), ("at", "<u4")])


def sketch(text: str, k: int = 16, s: int = 8) -> np.ndarray:
    """All anchors of the text (``ANCHOR``), ascending by hash and position."""
    at, hashes = anchors(text, k, s)
    order = np.argsort(hashes, kind="stable")  # positions ascend as they come
    out = np.empty(len(at), ANCHOR)
    out["hash"], out["at"] = hashes[order], at[order]
    return out


def spelled(found: np.ndarray) -> str:
    return base64.b64encode(found.tobytes()).decode()


def unspelled(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ANCHOR)


def _distinct(found: np.ndarray) -> np.ndarray:
    h = found["hash"]
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of the sets of all distinct anchor hashes; two empty texts are alike."""
    a, b = _distinct(a), _distinct(b)
    if not len(a) + len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]), kind="stable")  # merges the two runs
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where two texts meet: a row (position in a, position in b) for each anchor that occurs once
    in each, ascending; along a shared passage the difference of the two stays the same."""
    once = []
    for found in (a, b):
        _, first, counts = np.unique(found["hash"], return_index=True, return_counts=True)
        once.append(found[first[counts == 1]])
    _, i, j = np.intersect1d(once[0]["hash"], once[1]["hash"], assume_unique=True, return_indices=True)
    out = np.stack([once[0]["at"][i], once[1]["at"][j]], axis=1).astype(np.int64)
    return out[np.argsort(out[:, 0], kind="stable")]


def _occurrences(found: np.ndarray) -> np.ndarray:
    """Hashes by which the second, third ... anchor of an equal hash differs from the first."""
    h = found["hash"]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.arange(len(h))
    return h + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * _A


def positional(a: np.ndarray, b: np.ndarray) -> float:
    """How much of two texts' anchors meet in passages that keep their order: 0 to 1.

    The n-th anchor of a hash in one text is matched with the n-th of that hash in the other. A
    match counts if the one before or after it (by position in ``a``) lies as far ahead in ``b``:
    a passage that both share, moved or not, keeps these differences, words that recur by chance do
    not. The likeness is the matches that count over all anchors, matched ones once; a text with a
    single anchor has it count by itself; two empty texts are alike (1.0)."""
    if not len(a) + len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(_occurrences(a), _occurrences(b), assume_unique=True, return_indices=True)
    x, y = a["at"][i].astype(np.int64), b["at"][j].astype(np.int64)
    order = np.argsort(x)
    ahead = (y - x)[order]
    along = ahead[1:] == ahead[:-1]
    counts = np.zeros(len(ahead), bool)
    counts[1:] |= along
    counts[:-1] |= along
    n = len(ahead) if min(len(a), len(b)) == 1 else int(counts.sum())
    return n / (len(a) + len(b) - n)


def _below(cuts: list, column):
    """How many of the ascending ``cuts`` are below a value, in two steps of about a root of their
    number each. Cuts and column are structs; a null in them is less than any value."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    every, coarse = F.array(*cuts), F.array(*cuts[step - 1 :: step])
    count = lambda x: F.size(F.filter(x, lambda c: c < column))
    near = count(coarse) * step
    return near + count(F.slice(every, near + 1, step))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows dealt out so that each document meets the next one by descending id (after the
    last: the first): ``_part, doc_id, text, _own``, sorted by part and id descending.

    Ids and hashes of the texts are cut into ranges (as many as there are shuffle partitions), so
    that ids of any type will do, and the texts of one repeated id, or of none, are cut as well.
    Each range goes to a task of its own and gets, besides its own documents, the largest document
    of the next lower one, with ``_own`` false. So the texts move once and no task holds more than
    a range; a text is sorted on disk if need be. Rows that repeat an id with its text are in one
    range. What comes to the driver is a row for each range.
    """
    n = ranges or partitions(docs.sparkSession)
    order = lambda: F.struct(F.col("doc_id").alias("a"), F.col("_hash").alias("b"))
    ids = settled(docs.select("doc_id", F.xxhash64(text_of()).alias("_hash")), "fingerprint-ids")
    cut = ids.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_hash").groupBy(F.spark_partition_id().alias("p"))
    ends = cut.agg(F.max(order()).alias("most")).orderBy("most").collect()  # a row for each range
    discard(ids)
    kind = dict(docs.dtypes)["doc_id"]
    struct = [F.struct(F.lit(r.most.a).cast(kind).alias("a"), F.lit(r.most.b).cast("long").alias("b")) for r in ends]
    # The part of a row: how many ranges end below it.
    rows = docs.select("doc_id", "text", F.xxhash64(text_of()).alias("_hash")).withColumn("_part", _below(struct[:-1], order()))
    if not ends:
        return rows.select("_part", "doc_id", "text", "_hash", F.lit(True).alias("_own"))
    # Each range's largest document also goes to the range above it, the highest one's to the lowest.
    spec = F.array(*[F.struct(F.lit((i + 1) % len(ends)).alias("_to"), s.alias("most")) for i, s in enumerate(struct)])
    heads = docs.sparkSession.range(1).select(F.inline(spec))
    extra = rows.drop("_part").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("most.a")) & (F.col("_hash") == F.col("most.b")))
    extra = extra.dropDuplicates(["_to"]).select(F.col("_to").alias("_part"), "doc_id", "text", "_hash", F.lit(False).alias("_own"))
    both = rows.withColumn("_own", F.lit(True)).select("_part", "doc_id", "text", "_hash", "_own").unionByName(extra)
    return both.repartitionById(len(ends), "_part").sortWithinPartitions(F.col("_own").desc(), F.col("doc_id").desc_nulls_last(), F.col("_hash").desc())


def fingerprints_with_edit(docs: DataFrame, k: int = 16, s: int = 8) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``; the edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document's.

    A fingerprint is the base64 of all closed syncmers of the text, each with its 64-bit hash and
    its position (``ANCHOR``), whatever the text's length; ``near_edited`` and ``near_next`` match
    the anchors of two texts by position (``positional``).

    Defined results: null text is empty, its fingerprint the empty string, alike to another empty
    one (1.0); ids of any type that can be ordered; rows with equal ids follow each other by the hash
    of their text; null ids come after all others; a single row is its own next; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    import hashlib

    def run(batches):
        import pyarrow as pa

        held = None

        def row(one, following):
            part, doc_id, text, found = one
            half = len(text) // 2
            edited = text[: len(text) - half] + following[2][:half]
            other = sketch(edited, k, s)
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(found), spelled(other), positional(found, other), positional(found, following[3])

        kind = None
        for batch in slices(batches, max_bytes=1 << 20):  # the anchors are several times the text
            kind, out = batch.column("doc_id").type, []
            for part, doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "text", "_own"))):
                text = text or ""
                one = (part, doc_id, text, sketch(text, k, s))
                if held is not None and held[0] == part:
                    out.append(row(held, one))
                held = one if own else None
            if out:
                arrays = list(zip(*out))
                types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(with_next(docs), run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    """``fingerprints_with_edit`` of all ``documents``; nulls, empty texts, ties, repeated rows and an
    empty table as there."""
    from .common import table

    return fingerprints_with_edit(table(spark, sf_dir, "documents"))
