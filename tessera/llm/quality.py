"""Quality by a generalised additive model with pairwise interactions: lookup tables learned by
cyclic boosting of shallow trees, scored by adding bins."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc32_of_id, discard, slices, texts_of
from .toxicity import labelled_sample

FEATURES = (
    "log_chars", "log_words", "letters", "upper", "digits", "white", "symbols", "pipes", "stops", "bangs",
    "chars_per_word", "distinct_words", "top_word", "repeated_next", "ends_symbol", "log_lines", "distinct_lines", "words_per_line", "short_words", "upper_words",
)
_UPPER, _LOWER, _DIGIT, _WHITE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True


def features(text: str) -> list[float]:
    """``FEATURES`` of a whole text; an empty one has zeros."""
    data = text.encode()
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words = len(data), text.split()
    lines = text.split("\n")
    many = Counter(words)
    m = max(1, len(words))
    other = counts[128:].sum()
    again = sum(map(str.__eq__, words, words[1:]))
    ends = sum(w[-1] in "#$%&*+/<=>@\\^_`{|}~!" for w in words)
    return [
        np.log1p(n), np.log1p(len(words)), (counts[_UPPER].sum() + counts[_LOWER].sum() + other) / n, counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_WHITE].sum() / n, counts[_SYMBOL].sum() / n, counts[124] / n, counts[46] / n, counts[33] / n,
        n / m, len(many) / m, (max(many.values()) if many else 0) / m, again / m, ends / m, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(m / len(lines)), sum(len(w) < 4 for w in words) / m, sum(map(str.isupper, words)) / m,
    ]


@dataclass(frozen=True)
class AdditiveModel:
    """margin(x) = bias + sum_f table_f[bin_f(x)] + sum_(f,g) table_fg[bin_f(x), bin_g(x)]."""

    bias: float
    edges: list[np.ndarray]  # of each feature's bins
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # from a feature's bins to those of its pairs
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        margin = np.full(len(x), self.bias)
        for table, own in zip(self.tables, b):
            margin += table[own]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            margin += table[self.coarse[f][b[f]], self.coarse[g][b[g]]]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """Newton step of each bin by a tree of at most ``leaves`` leaves over ordered bins."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + penalty)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best, at = 1e-9, None
        for i, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                j = int(gains.argmax())
                if gains[j] > best:
                    best, at = gains[j], (i, int(cuts[j]))
        if at is None:
            break
        i, cut = at
        a, b = parts[i]
        parts[i : i + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """A tree that cuts one side, then the other on each part."""
    def cut(gg, hh):
        step = _tree(gg.sum(axis=1), hh.sum(axis=1), 2, penalty)
        where = np.flatnonzero(np.diff(step)) + 1
        halves = np.split(np.arange(len(step)), where)
        out, gain = np.zeros(gg.shape), 0.0
        for rows in halves:
            value = _tree(gg[rows].sum(axis=0), hh[rows].sum(axis=0), 2, penalty)
            out[rows] = value
            gain -= float((gg[rows].sum(axis=0) * value).sum())
        return out, gain

    a, b = cut(g, h), cut(g.T, h.T)
    return a[0] if a[1] >= b[1] else b[0].T


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, max_bins: int = 64, pair_bins: int = 8, max_pairs: int = 8, rate: float = 0.1, penalty: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: each round visits every feature with one shallow tree on the gradients
    summed by bin; then the pairs whose residuals a tree explains best, likewise."""
    d, share = x.shape[1], (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(d)]
    model = AdditiveModel(bias, edges, [np.zeros(len(e) + 1) for e in edges], [], [], [])
    b = model.bins(x)
    margin = np.full(len(x), bias)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(d):
            g, h = slopes()
            size = len(edges[f]) + 1
            step = rate * _tree(np.bincount(b[f], g, size), np.bincount(b[f], h, size), 4, penalty)
            model.tables[f][:] += step
            margin += step[b[f]]
    for f in range(d):
        size = len(edges[f]) + 1
        model.coarse.append((np.arange(size) * pair_bins // size).astype(np.int64))

    def summed(f, g, values):
        return np.bincount(model.coarse[f][b[f]] * pair_bins + model.coarse[g][b[g]], values, pair_bins * pair_bins).reshape(pair_bins, pair_bins)

    g, h = slopes()
    worth = []
    for i in range(d):
        for j in range(i + 1, d):
            sg, sh = summed(i, j, g), summed(i, j, h)
            worth.append((-float((sg * _pair_tree(sg, sh, penalty)).sum()), i, j))
    model.pairs.extend((i, j) for _, i, j in sorted(worth, reverse=True)[:max_pairs])
    model.pair_tables.extend(np.zeros((pair_bins, pair_bins)) for _ in model.pairs)
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _pair_tree(summed(i, j, g), summed(i, j, h), penalty)
            table += step
            margin += step[model.coarse[i][b[i]], model.coarse[j][b[j]]]
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, fold=None) -> AdditiveModel:
    """Fit on a bounded sample of labelled rows (``max_rows``, see ``labelled_sample``, where nulls,
    ties and repeated rows are defined); only their features come to the driver. No label gives a
    model that scores every text 0.5."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if fold is None else fold, max_rows)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in texts_of(batch)], pa.list_(pa.float64())), batch.column("y"), batch.column("doc_id")], names=["x", "y", "doc_id"])

    kind = dict(sample.dtypes)["doc_id"]
    rows = arrow_map(sample.select("doc_id", "text", F.col("y").cast("int").alias("y")), run, f"x array<double>, y int, doc_id {kind}").orderBy("doc_id", "x").collect()
    discard(sample)
    x = np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit_model(x, np.array([r.y for r in rows], np.float64))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id, score`` (0 to 1) of each row: how likely the text is of good quality. Scored where it
    is read, over whole texts.

    Defined results: null text is empty, an empty text has zeros for features; equal texts have equal
    scores; rows that repeat are scored each, ids of any type, null too, pass through; an empty table
    gives no rows; other columns, whatever their names, are ignored."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            x = np.array([features(t) for t in texts_of(batch)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    docs = docs.select("doc_id", "text")
    return arrow_map(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


THRESHOLD = 0.7


def held_out():
    return F.pmod(crc32_of_id(), F.lit(4)) == 2


def op5_quality_gam(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model fitted on the labels outside the held-out fold; nulls,
    empty and repeated rows and an empty table as in ``score``."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), fold=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
