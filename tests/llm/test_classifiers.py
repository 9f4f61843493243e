"""Definitions, folds, odd rows and held-out accuracy of the two classifiers."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality as Q
from tessera.llm import toxicity as T

DIR = "/root/testdata/sf0.01"


def accuracy(rows, labels, modulus, remainder):
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([r.predicted == labels[r.doc_id] for r in held])


def test_machine_by_definition():
    rng = np.random.default_rng(0)
    m = T.FactorizationMachine(np.arange(6), -0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [np.array(r, np.int64) for r in ([], [2], [0, 5], [1, 2, 3, 4])]
    for r, got in zip(rows, m.scores(rows)):
        margin = m.bias + sum(m.weights[i] for i in r) + sum(m.factors[i] @ m.factors[j] for i in r for j in r if i < j)
        assert np.isclose(got, 1 / (1 + np.exp(-margin)))


def test_machine_learns_an_interaction():
    """Either term alone is harmless; additive weights cannot say so."""
    rows = [np.array(r, np.int64) for r in ([], [0], [1], [0, 1])] * 50
    y = np.array([0, 0, 0, 1] * 50)
    scores = T.fit_machine(rows, y, np.arange(2), epochs=1500).scores(rows[:4])
    assert scores[3] > 0.7 > 0.3 > max(scores[:3])


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = Q.fit_model(x, y)
    assert (0, 2) in m.pairs and np.mean((m.scores(x) > 0.5) == y) > 0.95
    b, i = m.bins(x), 17
    margin = m.bias + sum(t[b[f][i]] for f, t in enumerate(m.tables)) + sum(t[m.coarse[f][b[f][i]], m.coarse[g][b[g][i]]] for (f, g), t in zip(m.pairs, m.pair_tables))
    assert np.isclose(m.scores(x)[i], 1 / (1 + np.exp(-margin)))


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = T.op3_toxicity_fm(spark, DIR).collect()
    assert len(rows) == 1000 and accuracy(rows, {k: r.toxic for k, r in labels.items()}, 3, 1) > 0.92
    rows = Q.op5_quality_gam(spark, DIR).collect()
    assert len(rows) == 1000 and accuracy(rows, {k: r.quality for k, r in labels.items()}, 4, 2) > 0.97


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.train(docs, x, fold=~T.held_out()) for x in (labels, turned))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "scum " * 30000, "y")], "doc_id long, text string, y string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, other = T.train(docs, empty), Q.train(docs, empty)
    assert [r.doc_id for r in T.score(docs, model).collect()] == [None, 1, 1, 2]
    assert all(r.score == 0.5 for r in Q.score(docs, other).collect())
    assert T.reject_toxic(docs, empty).collect() == docs.collect()
    assert T.score(docs.limit(0), model).count() == Q.score(docs.limit(0), other).count() == 0
    bad = T.FactorizationMachine(np.array(sorted(T.hashed_terms("scum", 22)[:1])), -4.0, np.array([8.0]), np.zeros((1, 8)))
    assert [r.score > 0.7 for r in T.score(docs, bad).collect()] == [False, False, False, True]


def folded(name, target, keep):
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r[target] for r in pq.read_table(f"{DIR}/labels.parquet").to_pylist() if r[target] in (0, 1)}
    return docs, {i: y for i, y in labels.items() if i in docs and keep(zlib.crc32(str(i).encode()))}


def test_toxicity_query_against_plain_python(spark):
    """The terms chosen, the fit on all labelled rows, and every row's score, pair by pair."""
    docs, y = folded("documents", "toxic", lambda c: c % 3 != 1)
    words = lambda text: {w.strip(T.TRIM) for w in text.lower().split()} - {""}
    terms = {i: sorted({zlib.crc32(p.encode()) % 2**22 for w in words(t) for p in (w, *(w[:n] + "*" for n in (3, 4, 5, 6, 7) if len(w) > n))}) for i, t in docs.items()}
    counts, n = {}, [sum(v == k for v in y.values()) for k in (0, 1)]
    for i, label in y.items():
        for t in terms[i]:
            counts.setdefault(t, [0, 0])[label] += 1
    z = {}
    for t, (a, b) in counts.items():
        share = (a + b) / sum(n)
        if a + b >= 3:
            z[t] = (b / n[1] - a / n[0]) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / n[0] + 1 / n[1]))
    chosen = sorted(sorted((t for t in z if abs(z[t]) >= 3.5), key=lambda t: (-abs(z[t]), t))[:512])
    place = {t: k for k, t in enumerate(chosen)}
    known = {i: [place[t] for t in own if t in place] for i, own in terms.items()}
    rows = sorted((known[i], label) for i, label in y.items())
    m = T.fit_machine([np.array(r, np.int64) for r, _ in rows], np.array([b for _, b in rows]), np.array(chosen))
    for r in T.op3_toxicity_fm(spark, DIR).collect():
        x = known[r.doc_id]
        margin = m.bias + sum(m.weights[a] for a in x) + sum(float(m.factors[a] @ m.factors[b]) for k, a in enumerate(x) for b in x[k + 1 :])
        want = 1 / (1 + math.exp(-min(30, max(-30, margin))))
        assert math.isclose(r.score, want, abs_tol=1e-9) and r.held_out == (r.doc_id not in y and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_quality_query_against_plain_python(spark):
    """The fit on all labelled rows, and every row's score by looking up its bins one by one."""
    docs, y = folded("documents", "quality", lambda c: c % 4 != 2)
    x = {i: Q.features(t) for i, t in docs.items()}
    rows = sorted((i, x[i], label) for i, label in y.items())
    m = Q.fit_model(np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64))
    for r in Q.op5_quality_gam(spark, DIR).collect():
        own = x[r.doc_id]
        b = [sum(e <= v for e in edges.tolist()) for v, edges in zip(own, m.edges)]
        margin = m.bias + sum(float(t[k]) for t, k in zip(m.tables, b)) + sum(float(t[m.coarse[f][b[f]], m.coarse[g][b[g]]]) for (f, g), t in zip(m.pairs, m.pair_tables))
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), abs_tol=1e-9)


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i, f"a text {i}") for i in range(50)] + [(7, "a text 7")] * 300 + [(8, f"other {k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (None, 1), (4, 2)], "doc_id long, toxic int")
    every = F.lit(True)
    assert T.labelled_sample(docs, labels, "toxic", every, 10_000).count() == 650
    assert T.labelled_sample(docs, labels, "toxic", every, 400).count() == 350
    few = T.labelled_sample(docs, labels, "toxic", every, 60).collect()
    assert len(few) == 60 and few and len({(r.doc_id, r.text) for r in few}) == 60 and all(r.y == r.doc_id % 2 for r in few)
    assert T.labelled_sample(docs, labels, "toxic", every, 10).count() <= 10


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "s", "t")], "doc_id long, text string, score string, y string")
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert T.reject_toxic(docs, empty).collect() == docs.collect()
    assert T.score(docs, T.train(docs, empty)).columns == Q.score(docs, Q.train(docs, empty)).columns == ["doc_id", "score"]
