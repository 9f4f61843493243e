"""The stages against plain Python, each on its own input, and all in a row."""

import re

import pytest

import corpus_pipeline
from tessera.llm import toxicity as T

from .test_ngram_join import brute as near
from .test_packing import check
from .test_secrets import brute as secret_spans

DIR = "/root/testdata/sf0.01"


def plain(rows, scores):
    """rows: (doc_id, text); yields the documents after each stage but the last."""
    rows = [(d, t) for d, t in rows if scores[d] < 0.7]
    yield dict(rows)
    first = {}
    for d, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
    rows = [(d, t) for d, t in rows if d in set(first.values())]
    yield dict(rows)
    heads = {r[1] for r in near(rows)}
    rows = [(d, t) for d, t in rows if d in heads]
    yield dict(rows)
    out = {}
    for d, t in rows:
        parts, at = [], 0
        for s, _, e, _ in secret_spans(t)[1]:
            if s >= at:
                parts += [t[at:s], "[SECRET]"]
            at = max(at, e)
        out[d] = "".join(parts) + t[at:]
    yield out


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scores = {r.doc_id: r.score for r in T.score(docs.select("doc_id", "text"), T.train(docs, labels, fold=~T.held_out())).collect()}
    want = plain([(r.doc_id, r.text) for r in docs.collect()], scores)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settled(stage(spark, docs, DIR), name)
        expected = next(want)
        rows = out.collect()
        assert out.columns == docs.columns and {r.doc_id: r.text for r in rows} == expected and len(rows) == len(expected), name
        assert all(r.n_chars == len(r.text) for r in rows)
        docs = out
    pieces = corpus_pipeline.run(spark, DIR).collect()
    assert check(pieces, expected) > 0.9


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, key string, hash int"
    odd = [(None, None, None, None, None, 1, "a", 2), (1, "", "en", "s", 0, 1, "a", 2), (1, "", "en", "s", 0, 1, "a", 2), (2, "word " * 20000, None, "s", 100000, 1, "a", 2), (3, "word  " * 20000, None, "s", None, 1, "a", 2)]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DIR).count() == 0
        docs = corpus_pipeline.settled(stage(spark, docs, DIR), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    # Null and empty texts are copies of each other, and so are the runs of one word.
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()} == {1, 2}


#: Columns of the operators' own tables, old and new, as columns of the user.
INNER = """_text _hits _base _spans _red _gaps _cand _assign _t _tid _tkey _thash _tdropped _ttext _tspans _tends _tdata _t_id _t_key _t_hash _t_dropped
    score y term k1 k2 c rep size keys grams text_hash class_id copy_of n_links prefix tree node q own other set t1 t2 u v root head links docs low
    len raw norm row full id text_sha256 keep_id group_size kept count hash _id _hash _part _own start length sequence_id offset""".split()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_any_other_column(spark, name):
    """A stage's result is the same whatever other columns there are, and these keep their values."""
    rows = [(1, "a b c d e f secret: Zx81Qm0aLp93Vn2Rt7Ky", 42), (2, "a  b c d e f secret: Zx81Qm0aLp93Vn2Rt7Ky", 43), (3, "something else altogether", 25), (None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    wide = spark.createDataFrame([(*r, *[f"{n} {r[0]}" for n in INNER]) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in INNER))
    stage = dict(corpus_pipeline.STAGES)[name]
    want, got = stage(spark, plain, DIR), stage(spark, wide, DIR)
    key = lambda r: str((r.doc_id, r.asDict()))
    if name == corpus_pipeline.STAGES[-1][0]:
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
        return
    assert got.columns == wide.columns
    assert sorted(map(key, got.select("doc_id", "text", "n_chars").collect())) == sorted(map(key, want.collect()))
    assert all(r[n] == f"{n} {r.doc_id}" for r in got.collect() for n in INNER)
