"""Jaccard join over word n-grams: a MinHash LSH forest for the candidates, exact verification."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, arrow_map, broadcast_below, discard, free_prefix, partitions, settled, slices, text_of, texts_of
from .fingerprints import _mix


@dataclass(frozen=True)
class Forest:
    """``trees`` tries over signatures of ``depth`` MinHash values, a byte of each.

    A text's label in a tree is its ``depth`` bytes in a row, so that sorting labels is sorting the
    trie, and a node is the texts whose labels begin alike. Two texts of similarity s share a prefix of
    length d in a tree with probability s^d at least, in any of them with 1 - (1 - s^d)^trees.

    Prefixes are matched at full depth first; those pairs are verified, and what they show of the
    data says how far the prefixes have to be shortened: until pairs as hard as the hardest found
    (strata of ``stratum`` of similarity above the threshold) are met with the target recall. As few
    pairs say little of those that are missing, less than ``evidence`` linked texts shorten to the
    prefix at which a pair at the threshold itself is met with it, ``floor``; nothing goes beyond.
    """

    n: int = 5
    threshold: float = 0.8
    target_recall: float = 0.999
    trees: int = 20
    depth: int = 8  # at most 8
    seed: int = 11
    stratum: float = 0.01
    evidence: int = 3000

    def recall(self, prefix: int, similarity: float | None = None) -> float:
        return 1 - (1 - (similarity or self.threshold) ** prefix) ** self.trees

    def prefix_for(self, similarity: float) -> int:
        """The longest prefix that meets pairs of that similarity with the target recall."""
        prefix = self.depth
        while prefix > 1 and self.recall(prefix, similarity) < self.target_recall:
            prefix -= 1
        return prefix

    @property
    def floor(self) -> int:
        return self.prefix_for(self.threshold)

    def shortened(self, strata: dict[int, int]) -> int:
        """The prefix that the data ask for; strata: how many texts have their hardest link there."""
        if sum(strata.values()) < self.evidence:
            return self.floor
        return self.prefix_for(self.threshold + min(strata) * self.stratum)


class Shingler:
    """Word n-grams of lower-cased texts as 64-bit hashes; words are what ASCII white space
    parts. A text of fewer than n words has the whole of itself as its one n-gram, one without
    words none."""

    def __init__(self, forest: Forest, max_cached: int = 200_000):
        rng = np.random.default_rng(forest.seed)
        self.forest, self.recent = forest, Recent(max_cached)
        self.places = rng.integers(1, 2**63, forest.n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        size = forest.trees * forest.depth
        self.a = rng.integers(0, 2**31, size, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, size, np.int64).astype(np.uint32)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and how many each text has."""
        import xxhash

        split = [t.lower().encode().split() for t in texts]
        cache = self.recent.now
        for w in self.recent.missing(set().union(*split)):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        sizes = [len(w) for w in split]
        flat = map(cache.__getitem__, chain.from_iterable(split))
        return np.fromiter(flat, np.uint64, sum(sizes)), np.array(sizes, np.int64)

    def shingles(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams (repeated ones too), and how many each text has."""
        n = self.forest.n
        begins = np.cumsum(sizes) - sizes
        counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
        doc = np.repeat(np.arange(len(sizes)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[doc]
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        total = np.zeros(len(at), np.uint64)
        left = sizes[doc]
        for k in range(n):
            part = padded[at + k] * self.places[k]
            total += np.where(k < left, part, np.uint64(0)) if (left < n).any() else part
        return _mix(total + np.minimum(left, n).astype(np.uint64)), counts

    def text_keys(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each text's sequence of words."""
        at = (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            mixed = np.concatenate([[np.uint64(0)], np.cumsum(_mix(words ^ _mix(at * np.uint64(2) + np.uint64(salt))))])
            ends = np.cumsum(sizes)
            out.append(_mix(mixed[ends] - mixed[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
        return out[0], out[1]

    def labels(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """texts x trees: the trie labels, the first value's byte highest; texts without n-grams have 0."""
        forest, some = self.forest, np.flatnonzero(counts)
        out = np.zeros((len(counts), forest.trees), np.uint64)
        if not len(some):
            return out.view(np.int64)
        begins = (np.cumsum(counts) - counts)[some]
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for tree in range(forest.trees):
            for k in range(forest.depth):
                f = tree * forest.depth + k
                least = np.minimum.reduceat(short * self.a[f] + self.b[f], begins)
                byte = _mix(least.astype(np.uint64)) & np.uint64(255)
                out[some, tree] |= byte << np.uint64(56 - 8 * k)
        return out.view(np.int64)


class Columns:
    """n-gram sets as rows of a 0/1 matrix, over the n-grams that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.float64)
        row = np.repeat(np.arange(len(sets)), self.sizes.astype(np.int64))
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = (np.cumsum(counts > 1) - 1).astype(np.int32)
        shared = counts[inverse] > 1
        self.column, self.total = number[inverse[shared]], int((counts > 1).sum())
        self.begins = np.searchsorted(row[shared], np.arange(len(sets) + 1))

    def common(self, a: range, b: range, columns: int = 2048) -> np.ndarray:
        """Sizes of the intersections of rows a with rows b, a slice of columns at a time."""
        parts, held = [], []
        for rows in (a, b):
            part = self.column[self.begins[rows.start] : self.begins[rows.stop]]
            mark = np.zeros(self.total, bool)
            mark[part] = True
            parts.append((np.repeat(np.arange(len(rows)), np.diff(self.begins[rows.start : rows.stop + 1])), part))
            held.append(mark)
        both = held[0] & held[1]
        place = (np.cumsum(both) - 1).astype(np.int32)
        out = np.zeros((len(a), len(b)), np.float32)
        dense = []
        for row, part in parts:
            keep = both[part]
            row, at = row[keep], place[part[keep]]
            order = np.argsort(at, kind="stable")
            dense.append((row[order], at[order]))
        for begin in range(0, int(both.sum()), columns):
            pair = []
            for (row, at), rows in zip(dense, (a, b)):
                i, j = np.searchsorted(at, [begin, begin + columns])
                matrix = np.zeros((len(rows), columns), np.float32)
                matrix[row[i:j], at[i:j] - begin] = 1
                pair.append(matrix)
            out += pair[0] @ pair[1].T
        return out

    def similarities(self, a: range, b: range, columns: int = 2048) -> np.ndarray:
        """Exact Jaccard similarities of rows a with rows b."""
        common = self.common(a, b, columns).astype(np.float64)
        return common / (self.sizes[a.start : a.stop, None] + self.sizes[None, b.start : b.stop] - common)


def verified(weights: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], tree: int, prefix: int, done: int | None, pair: bool, forest: Forest, tile: int = 1024):
    """For one node (or two blocks of one): each member's component (an index of a member), links,
    linked documents and hardest link's stratum (-1: no link).

    A pair counts only in the first of the trees where its texts share the prefix, and not if they
    share one of ``done`` in any, for then it was counted before. ``pair``: only pairs across the two
    blocks, whose members come one side after the other. Members are compared a tile at a time."""
    m, columns = len(sets), Columns(sets)
    now = labels.view(np.uint64) >> np.uint64(64 - 8 * prefix)
    before = None if done is None else labels.view(np.uint64) >> np.uint64(64 - 8 * done)
    root = np.arange(m)
    links, docs, low = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, 2.0)
    cut = int(np.searchsorted(sides, sides[-1])) if pair else 0
    tiles = lambda i, j: [range(k, min(k + tile, j)) for k in range(i, j, tile)]
    blocks = [(a, b) for a in tiles(0, cut) for b in tiles(cut, m)] if pair else [(a, b) for a in tiles(0, m) for b in tiles(0, m) if a.start <= b.start]
    for a, b in blocks:
        x, y = slice(a.start, a.stop), slice(b.start, b.stop)
        similar = columns.similarities(a, b)
        met = similar >= forest.threshold - 1e-9
        if a == b:
            np.fill_diagonal(met, False)
        if not met.any():
            continue
        join(root, met, x, y)
        for t in range(tree):
            met &= now[x, t][:, None] != now[y, t][None, :]
        for t in range(0 if before is None else before.shape[1]):
            met &= before[x, t][:, None] != before[y, t][None, :]
        hardest = np.where(met, similar, 2.0)
        for own, other, axis in ((x, y, 1),) if a == b else ((x, y, 1), (y, x, 0)):
            links[own] += met.sum(axis=axis)
            docs[own] += (met * np.expand_dims(weights[other], 1 - axis)).sum(axis=axis)
            low[own] = np.minimum(low[own], hardest.min(axis=axis))
    strata = np.where(low < 2, np.floor((low - forest.threshold) / forest.stratum + 1e-6), -1).astype(np.int64)
    return root, links, docs, np.where(low < 2, np.maximum(strata, 0), -1)


def join(root: np.ndarray, met: np.ndarray, x: slice, y: slice) -> None:
    """Joins the components that the links of a tile connect; ``root`` holds each member's least."""
    n = len(root)
    a, b = root[x].copy(), root[y].copy()
    while True:
        a2 = np.minimum(a, np.where(met, b[None, :], n).min(axis=1))
        b2 = np.minimum(b, np.where(met, a2[:, None], n).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    up = np.arange(n)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in {*zip(root[x].tolist(), a.tolist()), *zip(root[y].tolist(), b.tolist())}:
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    while (up[up] != up).any():
        up = up[up]
    root[:] = up[root]


def components(edges: DataFrame) -> DataFrame:
    """``u, root``: the least member of the component of each member of ``edges`` (a, b), a > b,
    for all but the least members themselves; alternating large-star and small-star until
    nothing changes, each round a table in the shared folder, the one before deleted."""

    def star(now: DataFrame, large: bool) -> DataFrame:
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = sym if large else sym.where("v < u")
        least = settled(near.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m")).select("_u", F.least("m", "_u").alias("m")), "least")
        # Both sides of the join are plain scans, so that AQE can split the rows of a large hub.
        met = near.join(least, F.col("u") == F.col("_u"))
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        else:
            out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).distinct()
        out = settled(out, "large-star" if large else "small-star")
        discard(least, now)
        return out

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    now = settled(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    before = state(now)
    while before[0]:
        now = star(star(now, True), False)
        after = state(now)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))


def ngram_join(docs: DataFrame, forest: Forest | None = None, block: int = 512, block_bytes: int = 16 << 20, broadcast_rows: int = 200_000, with_hash: bool = False) -> DataFrame:
    """Links between all texts whose word 5-grams have a Jaccard similarity of 0.8 or more.

    One row per input row: ``doc_id``; ``class_id``, the least id of its group (texts linked
    directly or through others); ``copy_of``, the least id of the texts with its words in its
    order; ``n_copies``, the other documents with these; ``n_links``, the other texts linked to
    it; ``n_linked_docs``, their documents; ``prefix``, to which the matched prefixes were shortened.

    Plan. Texts with equal words collapse to one representative, so that copies cost no pairs.
    Then rounds: the nodes of the forest at a prefix, the full depth first, are verified, and the
    links found say whether prefixes have to be shortened, and how far (``Forest.shortened``). Nodes of
    one member, and those with the members of another node, of this round or one before, are dropped
    by a partial aggregation. Only members of the rest have their n-grams made, and each node is
    verified exactly within one task. Large nodes are cut into blocks and every two blocks meet in a
    task of their own, so that no task holds more than two blocks and no pair is lost: blocks of
    ``block`` members up to 64 of them, then 64 larger ones, of 32 * ``block`` members or about
    ``block_bytes`` of n-grams at most, so that a set of n-grams is sent 64 times in a group of up to
    a million similar texts. Tasks return one row per member, never pairs: its component's least
    member and its number of links. Components, over numbers of the representatives (no hashes), are
    joined up by distributed star rounds. Broadcasts happen only below ``broadcast_rows`` counted rows.

    Defined results: null text is empty; texts without words are copies of each other and link to
    nothing else; a null id counts as larger than any other; rows that repeat id and text are
    copies; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    forest = forest or Forest()
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    hashed = docs.withColumn("text_hash", F.xxhash64(text_of()))

    def sign(batches):
        import pyarrow as pa

        shingler = Shingler(forest)
        for batch in slices(batches, max_bytes=1 << 20):  # words and n-grams are many times the text
            words, sizes = shingler.words(texts_of(batch))
            k1, k2 = shingler.text_keys(words, sizes)
            grams, counts = shingler.shingles(words, sizes)
            keys = shingler.labels(grams, counts)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, forest.trees, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1), pa.array(k2), lists, pa.array(counts.astype(np.int64)), batch.column("text_hash")], names=["doc_id", "k1", "k2", "keys", "grams", "text_hash"])

    signed = settled(arrow_map(hashed, sign, f"doc_id {kind}, k1 long, k2 long, keys array<long>, grams long, text_hash long"), "join-signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    classes = signed.groupBy("k1", "k2").agg(F.min(order).alias("rep"), F.count("*").alias("size"), F.first("keys").alias("keys"), F.first("grams").alias("grams"))
    # Written with their numbers, which stay as they are from here on.
    classes = settled(classes.select(F.monotonically_increasing_id().alias("c"), "k1", "k2", "rep", "size", "keys", "grams"), "join-classes")

    found, seen, prefix, done = [], [], forest.depth, None
    while True:
        rows, nodes = _round(docs, classes, seen, prefix, done, forest, block, block_bytes, broadcast_rows)
        found.append(rows)
        seen.append(nodes)
        links = reduce(DataFrame.unionByName, found)
        strata = links.where("low >= 0").groupBy("c").agg(F.min("low").alias("low")).groupBy("low").count().collect()  # a row for each stratum
        wanted = forest.shortened({r.low: r["count"] for r in strata})
        if wanted >= prefix:
            break
        prefix, done = wanted, prefix

    counts = links.groupBy(F.col("c").alias("_c")).agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = components(links.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    info = classes.select("c", "k1", "k2", "rep", "size").join(counts, F.col("c") == F.col("_c"), "left").join(roots, F.col("c") == F.col("u"), "left")
    info = settled(info.select("k1", "k2", "rep", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("root", "c").alias("root")), "join-info")
    groups = settled(info.groupBy("root").agg(F.min("rep").alias("head"), F.count("*").alias("texts")).where("texts > 1"), "join-groups")
    result = info.join(groups, "root", "left").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("head", "rep").alias("head"), "rep", "size", "links", "docs")
    result = settled(result, "join-result")
    discard(*found, *seen, classes, info, groups)
    out = signed.select("doc_id", "k1", "k2", "text_hash").join(result, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    out = out.select("doc_id", F.col("head.id").alias("class_id"), F.col("rep.id").alias("copy_of"), (F.col("size") - 1).alias("n_copies"), F.col("links").alias("n_links"), F.col("docs").alias("n_linked_docs"), F.lit(prefix).alias("prefix"), *["text_hash"] * with_hash)
    out._reads = (signed, result)
    return out


def _round(docs: DataFrame, classes: DataFrame, seen: list[DataFrame], prefix: int, done: int | None, forest: Forest, block: int, block_bytes: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Verifies the nodes at ``prefix``: ``c, root, links, docs, low`` of members with a link (pairs
    that share a prefix of ``done`` were counted before), and the nodes, by which later rounds know
    what was verified."""
    kind = dict(docs.dtypes)["doc_id"]
    node = ["tree", "node"]
    spread = lambda *c: classes.select(*c, F.posexplode("keys").alias("tree", "label")).withColumn("node", F.shiftrightunsigned("label", 64 - 8 * prefix)).drop("label")
    nodes = spread("c", "grams").groupBy(*node).agg(F.count("*").alias("n"), F.sum("grams").alias("g"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y")).where("n > 1")
    nodes = nodes.groupBy("n", "x", "y").agg(F.min(F.struct(*node)).alias("first"), F.first("g").alias("g"))
    for other in seen:
        nodes = nodes.join(other.select("n", "x", "y"), ["n", "x", "y"], "left_anti")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / block), F.greatest(F.lit(64), F.ceil(F.col("n") / (32 * block)))), F.ceil(F.col("g") * 8 / block_bytes))
    nodes = settled(nodes.select("n", "x", "y", "first.*", blocks.cast("int").alias("q")), "join-nodes")
    members = spread("c", "k1", "k2", "rep", "size", "keys").join(broadcast_below(nodes.select(*node, "q"), broadcast_rows), node)
    members = settled(members.select(*node, "q", "c", "k1", "k2", "rep", "size", "keys"), "join-members")

    ids = settled(members.select(F.col("rep.id").alias("_id")).distinct(), "join-ids")
    texts = docs.join(broadcast_below(ids, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def grams_of(batches):
        import pyarrow as pa

        shingler = Shingler(forest)
        for batch in slices(batches, max_bytes=1 << 20):  # words and n-grams are many times the text
            words, sizes = shingler.words(texts_of(batch))
            k1, k2 = shingler.text_keys(words, sizes)
            grams, counts = shingler.shingles(words, sizes)
            ends = np.cumsum(counts)
            sets = [np.unique(grams[e - c : e]).tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(sets, pa.binary())], names=["doc_id", "t1", "t2", "set"])

    sets = arrow_map(texts, grams_of, f"doc_id {kind}, t1 long, t2 long, set binary")
    own = F.pmod(F.xxhash64(F.lit(2), "c"), F.col("q")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    dealt = dealt.select(*node, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "k1", "k2", "rep", "size", "keys")
    dealt = dealt.join(sets, F.col("rep.id").eqNullSafe(F.col("doc_id")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")))
    task = [*node, "i", "j"]
    dealt = dealt.select(*task, "own", "c", "size", "keys", "set")
    dealt = dealt.repartition(partitions(docs.sparkSession), *task).sortWithinPartitions(*task, "own", "c")

    def verify(batches):
        import pyarrow as pa

        held: list = []
        now = None

        def finish():
            first: dict[int, tuple] = {}
            for r in held:
                first.setdefault(r[1], r)  # rows that repeat an id and its words
            rows = list(first.values())
            tree, _, i, j = now
            if len(rows) < 2 or (i != j and rows[0][0] == rows[-1][0]):
                return None
            c = np.array([r[1] for r in rows], np.int64)
            root, links, weight, low = verified(np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), np.array([r[0] for r in rows]), [np.frombuffer(r[4], np.uint64) for r in rows], tree, prefix, done, i != j, forest)
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, root, c)
            root = least[root]
            some = (root != c) | (links > 0)
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (c, root, links, weight, low)], names=["c", "root", "links", "docs", "low"])

        for batch in slices(batches, "set"):
            columns = [batch.column(x).to_pylist() for x in (*task, "own", "c", "size", "keys", "set")]
            for tree, at, i, j, *row in zip(*columns):
                if now != (tree, at, i, j):
                    if held and (out := finish()):
                        yield out
                    held, now = [], (tree, at, i, j)
                held.append(tuple(row))
        if held and (out := finish()):
            yield out

    rows = settled(arrow_map(dealt, verify, "c long, root long, links long, docs long, low long"), "join-found")
    discard(members, ids)
    return rows, nodes


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all columns, of any names, and of each group of near duplicates the document
    with the least id. Nulls, empty texts, ties, repeated rows and empty tables as in ``ngram_join``;
    rows that are equal in id and text stay or go together."""
    p = free_prefix(docs)
    found = ngram_join(docs, with_hash=True, **options)
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash"))
    dropped = broadcast_below(settled(dropped.distinct(), "join-dropped"), 200_000)
    discard(*found._reads)
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text_of()) == F.col(f"{p}hash")), "left_anti")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """``ngram_join`` of all ``documents``; nulls, empty texts, repeated rows and an empty table as
    there."""
    from .common import table

    return ngram_join(table(spark, sf_dir, "documents"))
