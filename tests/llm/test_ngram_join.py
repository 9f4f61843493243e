"""The join against all pairs."""

import random
from collections import defaultdict

import numpy as np

from tessera.llm import ngram_join as J


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold=0.8):
    texts, sets = defaultdict(list), {}
    for doc, text in rows:
        key = tuple((text or "").lower().split())
        texts[key].append(doc)
        sets[key] = grams(text)
    least = lambda ids: min(ids, key=lambda x: (x is None, x))
    keys = list(texts)
    near = {k: set() for k in keys}
    holders = defaultdict(list)
    for i, k in enumerate(keys):
        for g in sets[k]:
            holders[g].append(i)
    for i, k in enumerate(keys):
        shared = defaultdict(int)
        for g in sets[k]:
            for j in holders[g]:
                shared[j] += j < i
        for j, c in shared.items():
            if j < i and c >= threshold * (len(sets[k]) + len(sets[keys[j]]) - c) - 1e-9:
                near[k].add(keys[j])
                near[keys[j]].add(k)
    group, out = {}, []
    for k in keys:
        if k not in group:
            stack, seen = [k], {k}
            while stack:
                for x in near[stack.pop()] - seen:
                    seen.add(x)
                    stack.append(x)
            head = least([d for x in seen for d in texts[x]])
            group |= dict.fromkeys(seen, head)
    for k, ids in texts.items():
        for doc in ids:
            out.append((doc, group[k], least(ids), len(ids) - 1, len(near[k]), sum(len(texts[x]) for x in near[k])))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    return sorted((tuple(r)[:6] for r in J.ngram_join(df, **options).collect()), key=str)


def varied(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(4)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(12):
        base = [f"g{g}x{rng.randrange(500)}" for _ in range(120)]
        texts += [varied(rng, base, c) for c in (0, 0, 1, 1, 2, 3, 9)]
    base = [f"h{rng.randrange(300)}" for _ in range(150)]
    texts += [varied(rng, base, rng.choice((1, 2))) for _ in range(60)] + [" ".join(base)] * 25
    texts += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 200))]) for _ in range(60)]
    texts += ["", " \n", None, "one two", "One  TWO", "one two three four", "a b c d e", "long " * 5000, " ".join(f"l{i}" for i in range(9000))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, "one two"), (None, None), (3, rows[3][1])]


def test_prefix_shortens_to_the_target():
    f = J.Forest()
    assert f.recall(f.floor) >= 0.999 > f.recall(f.floor + 1) and f.depth > f.floor
    assert J.Forest(target_recall=0.9).floor > f.floor
    # Few links: down to the floor. Many: as far as the hardest of them asks for.
    assert f.shortened({}) == f.shortened({19: 2999}) == f.floor
    wanted = [f.shortened({k: 1, 19: 5000}) for k in range(20)]
    assert wanted[0] == f.floor and wanted[-1] == f.depth and wanted == sorted(wanted) and len(set(wanted)) == 4
    assert all(f.recall(d, 0.8 + k * f.stratum) >= 0.999 for k, d in enumerate(wanted))


def test_trees_meet_pairs():
    """Measured recall of candidates is what the formula says, for several similarities and prefixes."""
    f, rng, pairs = J.Forest(), np.random.default_rng(2), 3000
    shingler = J.Shingler(f)
    assert len(shingler.a) == f.trees * f.depth == 160
    draw = lambda n: rng.integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2)
    for common, own in ((80, 10), (85, 15), (90, 10), (95, 5)):
        sets = []
        for _ in range(pairs):
            both = draw(common)
            sets += [np.concatenate([both, draw(own)]), np.concatenate([both, draw(own)])]
        labels = shingler.labels(np.concatenate(sets), np.full(2 * pairs, common + own)).view(np.uint64)
        for prefix in range(f.floor, f.depth + 1):
            short = labels >> np.uint64(64 - 8 * prefix)
            met = (short[::2] == short[1::2]).any(axis=1).mean()
            expected = f.recall(prefix, common / (common + 2 * own))
            assert met >= 0.9 * expected and abs(met - expected) < 0.035
            if prefix == f.prefix_for(common / (common + 2 * own)) and common / (common + 2 * own) >= 0.8:
                assert met >= 0.997


def test_exact_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    sets += [sets[0], sets[1][:-1]]
    columns = J.Columns(sets)
    for wide in (7, 2048):
        for a, b in ((range(42), range(42)), (range(3, 20), range(20, 42)), (range(1), range(41, 42))):
            out = columns.similarities(a, b, wide)
            for i in a:
                for j in b:
                    common = len(np.intersect1d(sets[i], sets[j]))
                    assert out[i - a.start, j - b.start] == common / (len(sets[i]) + len(sets[j]) - common)


def test_tiles_and_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, (9, 60)).astype(np.uint64)
    sets = [np.unique(np.concatenate([b[rng.permutation(60)[:55]], rng.integers(0, 2**60, 3).astype(np.uint64)])) for b in base for _ in range(7)]
    order = rng.permutation(len(sets))
    sets, m = [sets[i] for i in order], len(sets)
    f, labels, weights = J.Forest(threshold=0.75), np.zeros((m, 20), np.int64), rng.integers(1, 5, m)
    want = np.array([[i != j and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.75 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    for tile in (5, 16, 1024):
        root, links, docs, low = J.verified(weights, labels, np.zeros(m), sets, 0, 5, None, False, f, tile)
        assert (links == want.sum(axis=1)).all() and (docs == want @ weights).all() and ((low >= 0) == want.any(axis=1)).all()
        reach = np.linalg.matrix_power(want.astype(float) + np.eye(m), 60) > 0
        assert ((root[:, None] == root[None, :]) == reach).all()
        sides = np.repeat([0, 1], [30, m - 30])
        across = want & (sides[:, None] != sides[None, :])
        assert (J.verified(weights, labels, sides, sets, 0, 5, None, True, f, tile)[1] == across.sum(axis=1)).all()
        assert not J.verified(weights, labels, sides, sets, 3, 5, None, False, f, tile)[1].any()  # met in an earlier tree
        assert not J.verified(weights, labels, sides, sets, 0, 5, 8, False, f, tile)[1].any()  # and in an earlier round


def test_the_prefix_varies_with_the_data(spark):
    """Only close copies: matched at full depth. Copies at the threshold as well: shortened."""
    rng = random.Random(8)
    texts = []
    for g in range(40):
        base = [f"g{g}x{i}" for i in range(200)]
        texts += [" ".join(base), " ".join(base[:-1] + ["end"])]
    easy = list(enumerate(texts))
    hard = easy + [(1000 + g, varied(rng, [f"h{g // 2}x{i}" for i in range(200)], 0) + " " + " ".join(f"o{g}x{i}" for i in range(23))) for g in range(20)]
    for rows, shortest in ((easy, 8), (hard, 5)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = J.ngram_join(df, J.Forest(evidence=10)).collect()
        assert {r.prefix for r in out} == {shortest}
        assert sorted((tuple(r)[:6] for r in out), key=str) == brute(rows)
    assert {r.prefix for r in J.ngram_join(spark.createDataFrame(easy, "doc_id long, text string")).collect()} == {5}


def test_against_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, block=8, broadcast_rows=0, block_bytes=20_000) == want  # blocks, and joins without broadcast


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    found, want = got(spark, rows), brute(rows)
    assert found == want


def test_kept(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    kept = J.keep_one_of_each(df).collect()
    # Of each group the rows of the least id stay; an id may stand for several texts.
    heads = brute(rows)
    assert {r.doc_id for r in kept} == {r[1] for r in heads} and all(r.key == "x" for r in kept)
    assert len(kept) == sum(r[0] == r[1] for r in heads)
    assert J.ngram_join(df.limit(0)).count() == 0


def test_clashing_names(spark):
    names = ["_t_id", "_t_hash", "_tid", "_thash", "class_id", "k1", "c", "rep", "keys", "set", "prefix"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in ((2, "a b c"), (1, "A b c"), (3, "d"))], ["doc_id", "text", *names])
    kept = J.keep_one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and all([r[n] for n in names] == names for r in kept)
