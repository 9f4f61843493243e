"""Pieces cover every document once, ids as the library gives them, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def check(rows, texts, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        data, at = ids(texts[doc]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(data) // 4
            assert r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(data) // 4
    padded = tokens = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        tokens += at
        padded += at if at & (at - 1) == 0 else capacity
    return tokens / padded


def test_encoder_is_the_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "A<|endoftext|>b <|EndOfText|> <|startoftext|>", "H̱ İ KK don't WE'LL it's.", "a\x1cb\x85c\xa0d  e", "a...b!! 12.5%%% (x) '' --", "日本語 é 𝒳 ﬁ", "end.' x's. <|.", "X" * 5000, "क़लम ﬁne ǅ ß K"]
    for coder in (P.ChunkEncoder(PATH), P.ChunkEncoder(PATH, max_cached=50)):
        assert [x + b"\x01\0\0\0" for x in coder.encode(texts)] == [ids(t) for t in texts]


def test_differencing():
    rng = np.random.default_rng(5)
    for k in (1, 2, 7):
        sizes = rng.integers(1, 100, 60).tolist()
        sums, of = P.differencing(sizes, k)
        assert sorted(np.bincount(of, weights=sizes, minlength=k).tolist()) == sums.tolist()
        assert sums[-1] - sums[0] <= max(sizes)
    assert P.differencing([8, 7, 6, 5, 4], 2)[0].tolist() == [14, 16]
    assert len(set(P.windows([6, 6, 6], 10).tolist())) == 3  # two would hold the sum, not the parts


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10**9, None, 3), (10**9 + 1, "", 3), (10**9 + 2, "word " * 9000, 4)], "doc_id long, text string, length int")
    rows = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert check(P.pack_documents(rows.coalesce(1), PATH).collect(), texts) > 0.97
    assert check(P.pack_documents(rows.repartition(5), PATH, with_ids=True).collect(), texts) > 0.95
    assert P.pack_documents(more.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted(r.length for r in P.pack_documents(twice, PATH).collect()) and sum(r.length for r in P.pack_documents(twice, PATH).collect()) == 6


def test_finish_uses_powers_of_two():
    packer = P.Packer(2048)
    got = [x for i in range(3) for x in packer.add(i, 701)] + list(packer.finish())
    size = defaultdict(int)
    for _, _, n, sequence, _ in got:
        size[sequence] += n
    assert sum(size.values()) == 2103
    assert all(n & (n - 1) == 0 or n > 1980 for n in size.values())


def test_contraction_is_the_library():
    import random

    draw = random.Random(5)
    letters = "etaoinshrdluéüßñøœčżłßıſ"
    words = {"".join(draw.choices(letters, k=draw.randint(1, 24))) for _ in range(4000)}
    words |= {t.removesuffix("</w>") for t in LIBRARY.get_vocab() if t.isascii() and t.removesuffix("</w>").isalpha()}
    words |= {"a" * 56, "ab" * 28, "é" * 28, "the" * 18, "a" * 57, "é" * 29, "x"}
    words = [w.lower().encode() for w in words]
    coder = P.ChunkEncoder(PATH)
    short = [w for w in words if len(w) <= P.Contraction.LONGEST]
    want = {w: e.ids for w, e in zip(words, LIBRARY.encode_batch([w.decode() for w in words], add_special_tokens=False))}
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.contract(short)] == [want[w] for w in short]
    assert coder.contract([]) == []
    mixed = ["É Éa, ÉCOLE!! İstanbul, ŁÓDŹ. ét, ǅa. ǆ, ſt' ß) a̸, ª º,", None, "", " \n", "\x1c a"]
    assert [x + b"\x01\0\0\0" for x in coder.encode(mixed)] == [ids(t) for t in mixed]


def test_cache_is_small_and_bounded(monkeypatch):
    import random
    import tracemalloc

    draw = random.Random(7)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(6, 12))) for _ in range(60_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    coder = P.ChunkEncoder(PATH)
    coder.encode(texts[:1])
    tracemalloc.start()
    for i in range(0, len(texts), 10):
        coder.encode(texts[i : i + 10])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100 * len(set(words))  # bytes; as a dictionary of bytes: 250 a word
    assert [x + b"\x01\0\0\0" for x in coder.encode(texts[:20])] == [ids(t) for t in texts[:20]]
    coder = P.ChunkEncoder(PATH, max_bytes=50_000)  # long chunks: the bound is in bytes too
    for i in range(40):
        text = f"{i}," * 3000 + f" a word {i}"
        assert coder.encode([text])[0] + b"\x01\0\0\0" == ids(text)
    coder.cached.trim()
    assert coder.cached.text.nbytes + coder.cached.ids.nbytes <= 50_000
    monkeypatch.setattr(P, "hash", len, raising=False)  # all words of a length collide
    coder = P.ChunkEncoder(PATH)
    for part in (texts[:2], texts[1:3], texts[:3]):
        assert [x + b"\x01\0\0\0" for x in coder.encode(part)] == [ids(t) for t in part]
