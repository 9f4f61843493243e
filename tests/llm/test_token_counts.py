"""The prefix table against the library, prefix by prefix."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_counts as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = T.counter(MODEL)


def check_all_prefixes(text: str) -> None:
    COUNTER.words.clear()
    one_by_one = COUNTER.differences(text)
    COUNTER.add([text])
    assert COUNTER.differences(text) == one_by_one
    counts = T.prefix_counts(T.pack(COUNTER.differences(text)))
    got = COUNTER.library.encode([text[:i] for i in range(len(text) + 1)], num_threads=1)
    assert counts.tolist() == [len(x) for x in got], text


CASES = ["", " ", "a", "a  b", "   a   b ", "▁x ▁▁y", "日本 é́ <s></s><unk> ▁", "x\x00y\n\nz\tｆ𝒳ﬁ", "The thenantion.\nOf 108.51.216.133", "!!!!! ---- ======== 1000000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 77 + "end" + " " * 40]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    check_all_prefixes(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdehinorstu ABT.,!\n0123456789_-=éèñßçê日▁𝒳/*#{}()")), max_size=60))
def test_random(text):
    check_all_prefixes(text)


def test_space_runs():
    for n in range(1, 700):
        assert COUNTER.space_run(n + 1) == len(COUNTER.library.encode(" " * n))
    assert not [p for p in COUNTER.scores if T.re.search(f"[^{T.SPACE}]{T.SPACE}|{T.SPACE}{T.SPACE}[^{T.SPACE}]", p)]


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(None, None, "x"), (7, "", "x"), (7, "word " * 30000, "x"), (7, "", "y")], "doc_id long, text string, n_tokens string")
    rows = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    got = T.token_counts(rows, MODEL).collect()
    texts = rows.collect()
    want = COUNTER.library.encode([r.text or "" for r in texts], num_threads=1)
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(r.doc_id, len((r.text or "").encode()), len(w)) for r, w in zip(texts, want)]
    for r, t in zip(got[:40], texts):
        n = T.longest_within(r.prefix_store, 50)
        whole = t.text or ""
        assert len(COUNTER.library.encode(whole[:n])) <= 50 and all(len(COUNTER.library.encode(whole[:k])) > 50 for k in range(n + 1, min(n + 5, len(whole)) + 1))
    assert T.token_counts(more.limit(0), MODEL).count() == 0
