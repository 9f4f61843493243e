"""Ids against the tiktoken library, and the round trip."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as file:
    RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = B.coder(PATH, PATTERN)


def check(texts, coder=CODER):
    got = coder.encode(texts)
    for text, (ids, decoded) in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text), text
        assert decoded == text.encode()
    assert coder.decode([a for a, _ in got]) == [t.encode() for t in texts]


def test_cases():
    check(["", " ", "a", "  a  b ", "don't WE'LL 12345 \n\n x\n y", "日本語 é́ 𝒳 ﬁ x", "<|endoftext|>", "x" * 3000, "ab" * 900, "\t\t \r\n", "=" * 600 + " " * 600])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdehinorstuAB'.,!\n\t  0123_-éñß日𝒳  \x1c")), max_size=80), max_size=4))
def test_random(texts):
    check(texts)


def test_cache_may_be_emptied(sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    small = B.Coder(PATH, PATTERN, max_cached=300)
    for i in range(0, len(texts), 20):
        check(texts[i : i + 20], small)


def test_decoded_comes_from_the_ids():
    c, text = B.Coder(PATH, PATTERN), "one two three"
    c.encode([text, ""])
    for ids in (c.known[" three"], b""):  # a chunk's ids misplaced, then lost
        c.known[" two"] = ids
        (found, decoded), empty = c.encode([text, ""])
        assert decoded == LIBRARY.decode_bytes(np.frombuffer(found, "<u4").tolist()) != text.encode() and empty == (b"", b"")


def test_long_words_follow_the_same_rule():
    rng = np.random.default_rng(3)
    for n in (2, 9, 60, 300):
        word = "".join(rng.choice(list("abelnorst"), n)).encode()
        out = [None]
        CODER._recursive([word], [0], out)
        assert np.frombuffer(out[0], "<u4").tolist() == CODER._long(word)


def test_table(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, ids int")
    rows = B.encode_documents(docs, PATH, PATTERN)
    assert [(r.doc_id, r.n_tokens, bytes(r.decoded)) for r in rows.collect()] == [(None, 0, b""), (1, 0, b""), (1, 2, b"a b"), (1, 2, b"a b")]
    assert [bytes(r.decoded) for r in B.decode_documents(rows, PATH, PATTERN).collect()] == [b"", b"", b"a b", b"a b"]
    assert B.encode_documents(docs.limit(0), PATH, PATTERN).count() == 0
