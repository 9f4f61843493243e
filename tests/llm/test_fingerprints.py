"""Syncmers against their definition; the pairing against a plain one."""

import base64
import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import fingerprints as G


def test_closed_syncmers_by_definition():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdé ö𝒳."), 400)) + "aaaaaaaaaaaaaaaaaaaaaaaa"
    at, hashes = G.anchors(text)
    small = {}
    for i in range(len(text) - 7):  # an s-mer's hash by itself
        h, n = G._mix(G.code_points(text[i : i + 8])), 1
        while n < 8:
            h, n = G._joined(h, n), n * 2
        small[text[i : i + 8]] = int(G._mix(h)[0])
    want = []
    for i in range(len(text) - 15):
        own = [small[text[i + j : i + j + 8]] for j in range(9)]
        if min(own) in (own[0], own[-1]):
            want.append(i)
    assert at.tolist() == want
    by_kmer = {}
    for i, h in zip(at.tolist(), hashes.tolist()):
        assert by_kmer.setdefault(text[i : i + 16], h) == h
    assert len(set(by_kmer.values())) == len(by_kmer)


def test_context_free():
    a, b = "The quick brown fox jumps over the lazy dog. " * 3, "Another text begins here, quite unlike it. "
    inside = {h for p, h in zip(*map(np.ndarray.tolist, G.anchors(a)))}
    moved = {h for p, h in zip(*map(np.ndarray.tolist, G.anchors(b + a + b)))}
    assert inside <= moved
    assert G.likeness(G.sketch(a), G.sketch(a)) == 1.0 and G.likeness(G.sketch(""), G.sketch("")) == 1.0
    assert G.likeness(G.sketch(""), G.sketch(a)) == 0.0 and G.likeness(G.sketch("ab"), G.sketch("ba")) == 0.0


def kmers(text):
    return {text[i : i + 16] for i in G.anchors(text)[0].tolist()}


def long_pair():
    rng = np.random.default_rng(5)
    own = lambda n: "".join(rng.choice(list("abcdefgh ijkl"), n))
    passage = own(20000)
    return own(30000) + passage + own(1000), own(700) + passage + own(45000), passage


def test_long_texts_keep_all_anchors():
    a, b, passage = long_pair()
    x, y = G.sketch(a), G.sketch(b)
    assert len(x) == len(G.anchors(a)[0]) > 10000 and sorted(x["at"].tolist()) == G.anchors(a)[0].tolist()
    assert G.likeness(x, y) == len(kmers(a) & kmers(b)) / len(kmers(a) | kmers(b))
    assert (G.unspelled(G.spelled(x)) == x).all()
    met = G.matched(G.unspelled(G.spelled(x)), y)
    along = met[met[:, 1] - met[:, 0] == 700 - 30000]
    inside = {i + 30000 for i in G.anchors(passage)[0].tolist()}
    assert inside <= set(along[:, 0].tolist()) and len(along) > 4000
    assert all(a[i : i + 16] == b[j : j + 16] for i, j in met.tolist())


def plain_positional(a, b):
    """The definition with dictionaries and loops, on the k-mers themselves."""
    places = []
    for text in (a, b):
        seen, own = {}, {}
        for i in G.anchors(text)[0].tolist():
            kmer = text[i : i + 16]
            seen[kmer] = seen.get(kmer, 0) + 1
            own[kmer, seen[kmer]] = i
        places.append(own)
    if not places[0] and not places[1]:
        return 1.0
    met = sorted((i, places[1][key] - i) for key, i in places[0].items() if key in places[1])
    if 1 in (len(places[0]), len(places[1])):
        n = len(met)
    else:
        n = sum((k > 0 and met[k - 1][1] == d) or (k + 1 < len(met) and met[k + 1][1] == d) for k, (_, d) in enumerate(met))
    return n / (len(places[0]) + len(places[1]) - n)


def test_positional_likeness():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words, n))
    for _ in range(60):
        x, y, z = text(rng.integers(1, 120)), text(rng.integers(1, 120)), text(rng.integers(0, 60))
        for a, b in ((x, x), (x, y), (x + z, y + z), (z + x, x + y), (x, x[len(x) // 2 :] + x[: len(x) // 2]), (x, ""), (x * 3, x * 2), (x[:10], x[:10])):
            got = G.positional(G.sketch(a), G.sketch(b))
            assert got == plain_positional(a, b) and 0 <= got <= 1
            assert a != b or got == 1.0
    # The same anchors in another order are alike as sets, and not by position.
    parts = [text(6) for _ in range(30)]
    a, b = " ".join(parts), " ".join(parts[i] for i in rng.permutation(30))
    assert G.positional(G.sketch(a), G.sketch(b)) < G.positional(G.sketch(a), G.sketch(a)) == 1.0


def test_long_documents(spark):
    a, b, _ = long_pair()
    rows = {r.doc_id: r for r in G.fingerprints_with_edit(spark.createDataFrame([(2, a), (1, b)], "doc_id long, text string")).collect()}
    half = len(a) // 2
    edited = a[: len(a) - half] + b[:half]
    assert rows[2].near_next == plain_positional(a, b) and rows[1].near_next == plain_positional(b, a)
    assert rows[2].near_edited == plain_positional(a, edited) > 0.3
    for fingerprint, text in ((rows[2].fingerprint, a), (rows[2].edited_fingerprint, edited)):
        assert {text[i : i + 16] for i in G.unspelled(fingerprint)["at"].tolist()} == kmers(text)


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        f, e, n = (G.sketch(t) for t in (text, edited, following))
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), G.spelled(f), G.spelled(e), G.positional(f, e), G.positional(f, n))
    return out


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**9, None), (10**9 + 7, ""), (10**10, "a 𝒳"), (-5, "x" * 50000)], "doc_id long, text string")
    rows = docs.unionByName(more)
    want = brute([tuple(r) for r in rows.collect()])
    got = G.fingerprints_with_edit(rows.repartition(3)).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    shares = [r for r in got if r.n_chars > 500]
    assert np.mean([r.near_edited > r.near_next for r in shares]) > 0.9
    assert all(len(base64.b64decode(r.fingerprint)) % 4 == 0 and 0 <= r.near_edited <= 1 for r in got)


def test_small_tables(spark):
    schema = "doc_id long, text string, _part int, near_next string"
    one = spark.createDataFrame([(3, "abc def", 1, "x")], schema)
    assert [r.near_next for r in G.fingerprints_with_edit(one).collect()] == [1.0]
    assert G.fingerprints_with_edit(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c", 1, "x"), (3, "q", 1, "x"), (3, "q", 1, "x"), (None, None, 1, "x")], schema)
    assert len(G.fingerprints_with_edit(odd).collect()) == 4


def test_any_id(spark):
    """String ids, a third of the rows with one id, a third with none: whole rows, in order."""
    rows = [(f"d{i % 7}{i}", f"text of {i} " * 9) for i in range(40)] + [("same", f"t{i} " * 20) for i in range(40)] + [(None, f"n{i} " * 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    dealt = G.with_next(docs, 8).withColumn("p", F.spark_partition_id())
    sizes = {r._part: (r.n, r.k) for r in dealt.where("_own").groupBy("_part").agg(F.count("*").alias("n"), F.countDistinct("p").alias("k")).collect()}
    assert len(sizes) > 4 and max(n for n, _ in sizes.values()) < 60 and {k for _, k in sizes.values()} == {1}
    got = G.fingerprints_with_edit(docs).collect()
    assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(str((i, len(t))) for i, t in rows)
    own = {r.doc_id: r for r in got if r.doc_id and r.doc_id != "same"}
    ids = sorted(own, reverse=True)
    for a, b in zip(ids, ids[1:]):
        x, y = (dict(rows)[i] for i in (a, b))
        if a > "same" > b:
            continue
        half = len(x) // 2
        assert own[a].edited_sha256 == hashlib.sha256((x[: len(x) - half] + y[:half]).encode()).hexdigest()


def test_cuts(spark):
    import bisect

    ids = spark.createDataFrame([(i,) for i in range(-3, 60)], "doc_id long")
    for n in (0, 1, 2, 3, 7, 16, 23):
        cuts = sorted({(7 * i) % 50 for i in range(n)})
        rows = ids.select("doc_id", G._below([F.struct(F.lit(c).cast("long").alias("a")) for c in cuts], F.struct(F.col("doc_id").alias("a"))).alias("n")).collect()
        assert all(r.n == bisect.bisect_left(cuts, r.doc_id) for r in rows)
