"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, arrow_map, crc32_of_id, discard, settled, slices, text_of, texts_of

#: Lengths of the word beginnings that are terms of their own.
STEMS = (3, 4, 5, 6, 7)
TRIM = ".,;:!?*#%$&|()[]{}<>\"'«»¿¡-_/\\"


@dataclass(frozen=True)
class FactorizationMachine:
    """score(x) = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i in {0, 1}.

    ``terms`` are the hashed terms that the model knows; each pair of terms present adds the
    product of their factors, so that two terms together may mean more, or less, than their
    weights add up to."""

    terms: np.ndarray  # int64, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # terms x k

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: positions in ``terms`` of the terms present, each once."""
        sizes = np.array([len(r) for r in rows], np.int64)
        margin = np.full(len(rows), self.bias)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.concatenate([rows[i] for i in some])
            begins = np.cumsum(sizes[some]) - sizes[some]
            v = self.factors[flat]
            pairs = 0.5 * (np.add.reduceat(v, begins) ** 2 - np.add.reduceat(v * v, begins)).sum(axis=1)
            margin[some] += np.add.reduceat(self.weights[flat], begins) + pairs
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def hashed_terms(word: str, bits: int) -> tuple[int, ...]:
    """A word's terms: itself and, where it is longer, its first letters (``STEMS`` many), by which
    forms of one stem that were not seen in training are still known."""
    parts = [word] + [f"{word[:n]}*" for n in STEMS if len(word) > n]
    return tuple(zlib.crc32(p.encode()) & ((1 << bits) - 1) for p in parts)


class Terms:
    """Distinct words of texts, and their terms from a bounded cache."""

    def __init__(self, bits: int, known: np.ndarray | None = None, max_cached: int = 100_000):
        self.bits, self.recent = bits, Recent(max_cached, 2000)
        self.at = None if known is None else {int(t): i for i, t in enumerate(known)}

    def of(self, text: str) -> np.ndarray:
        """Distinct hashed terms, or with a model's terms their positions, ascending."""
        cache, words = self.recent.now, set(text.lower().split())
        for word in self.recent.missing(words):
            bare = word.strip(TRIM)
            terms = hashed_terms(bare, self.bits) if bare else ()
            cache[word] = terms if self.at is None else tuple(self.at[t] for t in terms if t in self.at)
        return np.unique(np.array([*chain.from_iterable(map(cache.__getitem__, words))], np.int64))


def fit_machine(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, k: int = 8, epochs: int = 400, l2: float = 2e-5, seed: int = 7) -> FactorizationMachine:
    """Logistic loss by full-batch Adam. Rows with the same terms and label are one weighted row."""
    groups: dict[tuple, list[int]] = {}
    for r, label in zip(rows, y):
        groups.setdefault((tuple(r.tolist()), int(label)), [0])[0] += 1
    keys = list(groups)
    x = np.zeros((len(keys), len(terms)), np.float32)
    for i, (r, _) in enumerate(keys):
        x[i, list(r)] = 1
    label = np.array([b for _, b in keys], np.float32)
    weight = np.array([groups[key][0] for key in keys], np.float32)
    weight /= max(1.0, float(weight.sum()))
    rng = np.random.default_rng(seed)
    share = float((weight * label).sum())
    theta = [np.array([np.log((share + 1e-3) / (1 - share + 1e-3))], np.float32), np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), k)).astype(np.float32)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, epochs + 1):
        bias, w, v = theta
        xv = x @ v
        margin = bias[0] + x @ w + 0.5 * (xv**2 - x @ (v * v)).sum(axis=1)
        g = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label)
        xg = x.T @ g
        grads = [np.array([g.sum()], np.float32), xg + l2 * w, x.T @ (g[:, None] * xv) - xg[:, None] * v + l2 * v]
        for t, m, s, d in zip(theta, first, second, grads):
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            t -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(terms, float(theta[0][0]), theta[1].astype(np.float64), theta[2].astype(np.float64))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, fold, max_rows: int) -> DataFrame:
    """``doc_id, y, text`` (a settled table) of at most ``max_rows`` rows with a label for which ``fold``
    holds: those of the least hashes of their ids. At most ``max_rows`` ids are broadcast to the scan.

    Defined results: labels that are neither 0 nor 1, and those of no id, are left out; of several
    labels of an id the larger counts; rows that repeat an id with its text count once, but only if
    there are more rows than ``max_rows``, and of what is still more (one id with many texts) those
    of the least hashes of their texts stay; no label, or an empty table, gives no rows; other
    columns are ignored."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).where(fold).groupBy("doc_id").agg(F.max(target).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = settled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), f"{target}-sample")
    if sample.count() <= max_rows:
        return sample
    keyed = sample.withColumn("hash", F.xxhash64(text_of()))
    few = keyed.select("doc_id", "hash").distinct().orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash").limit(max_rows)
    out = settled(keyed.join(F.broadcast(few), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"]).drop("hash"), f"{target}-sample")
    discard(sample)
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 512, bits: int = 22, least_z: float = 3.5, fold=None) -> FactorizationMachine:
    """Fit on a bounded sample of labelled rows (``max_rows``, see ``labelled_sample``, where nulls,
    ties and repeated rows are defined).

    Executors count in how many toxic and clean documents each hashed term occurs; the
    ``max_terms`` most telling terms (two-proportion z, at least three documents) come to the
    driver with the sample's rows over these terms. No label at all gives a model whose every
    score is 0.5 / its share."""
    fold = F.lit(True) if fold is None else fold
    sample = labelled_sample(docs, labels, "toxic", fold, max_rows)

    def count(batches):
        import pyarrow as pa

        reader = Terms(bits)
        for batch in slices(batches):
            both = [[], []]
            for text, y in zip(texts_of(batch), batch.column("y").to_pylist()):
                both[y].append(reader.of(text))
            counted = [np.unique(np.concatenate(b), return_counts=True) if b else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for b in both]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([counted[0][0], counted[1][0]])), pa.array(np.concatenate([counted[0][1], 0 * counted[1][1]])), pa.array(np.concatenate([0 * counted[0][1], counted[1][1]]))], names=["term", "n0", "n1"])

    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    counts = arrow_map(sample.select("text", F.col("y").cast("int").alias("y")), count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    pooled = (F.col("n0") + F.col("n1")) / F.lit(max(1, n0 + n1))
    z = (F.col("n1") / F.lit(max(1, n1)) - F.col("n0") / F.lit(max(1, n0))) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * F.lit(1 / max(1, n0) + 1 / max(1, n1)))
    best = counts.select("term", F.abs(z).alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(max_terms)
    terms = np.array(sorted(r.term for r in best.collect()), np.int64)

    def select(batches):
        import pyarrow as pa

        reader = Terms(bits, terms)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([reader.of(t).tolist() for t in texts_of(batch)], pa.list_(pa.int64())), batch.column("y")], names=["x", "y"])

    rows = arrow_map(sample.select("text", F.col("y").cast("int").alias("y")), select, "x array<long>, y int").groupBy("x", "y").count().collect()
    rows.sort(key=lambda r: (r.x, r.y))  # sums of floats in the same order, however the rows came
    discard(sample)
    x = [np.array(r.x, np.int64) for r in rows for _ in range(r["count"])]
    return fit_machine(x, np.array([r.y for r in rows for _ in range(r["count"])]), terms)


def score(docs: DataFrame, model: FactorizationMachine, bits: int = 22) -> DataFrame:
    """``doc_id, score`` (0 to 1) of each row: how likely the text is toxic. Scored where it is read,
    over whole texts.

    Defined results: null text is empty, and an empty text has the score of one without known terms,
    as has any text if there was no label; equal texts have equal scores; rows that repeat are scored
    each, ids of any type, null too, pass through; an empty table gives no rows; other columns,
    whatever their names, are ignored."""

    def run(batches):
        import pyarrow as pa

        reader = Terms(bits, model.terms)
        for batch in slices(batches):
            scores = model.scores([reader.of(t) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    docs = docs.select("doc_id", "text")
    return arrow_map(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


THRESHOLD = 0.7


def held_out():
    return F.pmod(crc32_of_id(), F.lit(3)) == 1


def op3_toxicity_fm(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a machine fitted on the labels outside the held-out fold; nulls,
    empty and repeated rows and an empty table as in ``score``."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), fold=~held_out())
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all columns, of any names, without the rows that score at least ``THRESHOLD``.

    The text is scored where it is read and goes along; nothing is shuffled. Nulls, empty texts,
    repeated rows and empty tables as in ``score``; rows with equal texts stay or go together."""
    model = train(docs, labels, fold=~held_out())

    def run(batches):
        import pyarrow as pa

        reader = Terms(22, model.terms)
        for batch in slices(batches):
            keep = model.scores([reader.of(t) for t in texts_of(batch)]) < THRESHOLD
            yield batch.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)
