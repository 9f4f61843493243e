"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, give_back, kept, slices


class Contraction:
    """Byte-level BPE with an end-of-word mark, for many words at once.

    A matrix holds the words that have equally many tokens, a column for each. A step contracts the
    leftmost pair of least rank in every word, so all of them go over to the matrix of one token
    less, where the words that begin with as many bytes join them; words without a pair are done.
    """

    #: Bytes of a word at most: a pair's rank and place share a number.
    LONGEST = 64

    def __init__(self, library):
        import json

        from tokenizers import pre_tokenizers

        model = json.loads(library.to_str())["model"]
        ids, mark = model["vocab"], model["end_of_word_suffix"]
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Bytes 0 to 127 and the lead and following bytes of letters up to U+024F.
        sign = {x: alphabet.pre_tokenize_str(chr(x))[0][0][-1] for x in range(128)}
        for x in range(0x80, 0x250):
            sign.update(zip(chr(x).encode(), alphabet.pre_tokenize_str(chr(x))[0][0]))
        self.first, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for x, char in sign.items():
            self.first[x], self.last[x] = ids[char], ids[char + mark]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = len(ids)
        pairs = np.array([ids[a] * self.base + ids[b] for a, b in merges], np.int64)
        order = pairs.argsort()
        # The last entry stands for a pair that is not to be merged, which has the highest rank.
        self.none = len(merges)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.rank = np.append(order, self.none).astype(np.int32) * self.LONGEST
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        # Ranks of pairs of bytes, the second of which may end the word.
        both = np.concatenate([self.first, self.last])
        self.bytes = self.ranks(np.repeat(self.first, 512), np.tile(both, 256))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.base + right
        at = self.pairs.searchsorted(wanted)
        return np.where(self.pairs[at] == wanted, self.rank[at], self.none * self.LONGEST)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit, of words of 1 to ``LONGEST`` bytes."""
        out: list = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        ends, sizes = np.cumsum(sizes[order]), sizes[order]
        begun, names = 0, order[:0]
        tokens = ranks = None
        for size in range(int(sizes[0]) if words else 0, 0, -1):
            until = int(np.searchsorted(-sizes, -size, side="right"))
            if until > begun:
                block = np.ascontiguousarray(data[ends[begun] - size : ends[until - 1]].reshape(-1, size).T)
                own = self.first[block]
                own[-1] = self.last[block[-1]]
                pairs = block[:-1].astype(np.int32) * 512 + block[1:]
                pairs[-1:] += 256
                own_ranks = self.bytes[pairs] + np.arange(size - 1, dtype=np.int32)[:, None]
                if len(names):
                    own = np.concatenate([tokens, own], axis=1)
                    own_ranks = np.concatenate([ranks, own_ranks], axis=1)
                tokens, ranks = own, own_ranks
                names, begun = np.concatenate([names, order[begun:until]]), until
            if not len(names):
                continue
            least = ranks.min(axis=0) if size > 1 else np.full(len(names), self.none * self.LONGEST)
            best = least // self.LONGEST
            done = best == self.none
            if done.any():
                found = tokens[:, done].T.astype("<u4").tobytes()
                for i, name in enumerate(names[done].tolist()):
                    out[name] = found[4 * size * i : 4 * size * (i + 1)]
                live = (~done).nonzero()[0]
                names, least, best = names[live], least[live], best[live]
                if not len(live):
                    continue
                tokens, ranks = tokens.take(live, axis=1), ranks.take(live, axis=1)
            at = least % self.LONGEST
            tokens[at, np.arange(len(at))] = self.made[best]
            before = np.arange(size - 1, dtype=at.dtype)[:, None] <= at
            tokens = np.where(before, tokens[:-1], tokens[1:])
            ranks = np.where(before[:-1], ranks[:-1], ranks[1:] - 1)
            has = (at > 0).nonzero()[0]
            x = at[has]
            ranks[x - 1, has] = self.ranks(tokens[x - 1, has], tokens[x, has]) + (x - 1)
            has = (at < size - 2).nonzero()[0]
            x = at[has]
            ranks[x, has] = self.ranks(tokens[x, has], tokens[x + 1, has]) + x
        return out


class Cached:
    """Token ids of byte strings, in a few flat arrays: tens of bytes an entry where a dictionary of
    bytes takes 300. Entries are found by their hash in a sorted array and compared in full.

    Beyond ``max_cached`` entries or ``max_bytes`` of strings and ids, ``trim`` keeps those used last,
    up to half of either. An entry's number holds until then."""

    def __init__(self, max_cached: int, max_bytes: int):
        self.max_cached, self.max_bytes, self.calls = max_cached, max_bytes, 0
        self.text, self.ids = np.empty(0, np.uint8), np.empty(0, "<u4")
        # Ends of each entry's bytes and ids, after a 0, and the call that used it last.
        self.text_at, self.ids_at, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.int32)
        self.hashes, self.entry = np.empty(0, np.int64), np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.used)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The entry of each key, -1 without one."""
        self.calls += 1
        out = np.full(len(keys), -1, np.int64)
        if not len(self) or not keys:
            return out
        wanted = np.fromiter(map(hash, keys), np.int64, len(keys))
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        at = np.minimum(self.hashes.searchsorted(wanted), len(self) - 1)
        entry = self.entry[at].astype(np.int64)
        begin = self.text_at[entry]
        hit = ((self.hashes[at] == wanted) & (self.text_at[entry + 1] - begin == sizes)).nonzero()[0]
        data = np.frombuffer(b"".join([keys[i] for i in hit.tolist()]), np.uint8)
        size = sizes[hit]
        other = self.text[np.repeat(begin[hit] - np.cumsum(size) + size, size) + np.arange(len(data))] != data
        out[hit] = entry[hit]
        if other.any():  # equal hashes of different keys
            out[hit[np.repeat(np.arange(len(hit)), size)[other]]] = -1
        self.used[out[out >= 0]] = self.calls
        return out

    def add(self, keys: list[bytes], ids: list[bytes]) -> np.ndarray:
        """Numbers of the entries made for keys that have none."""
        n, old = len(keys), len(self)
        ends, id_ends = (np.cumsum(np.fromiter(map(len, x), np.int64, n)) for x in (keys, ids))
        self.text_at = np.concatenate([self.text_at, self.text_at[-1] + ends])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + id_ends // 4])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(keys), np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.used = np.concatenate([self.used, np.full(n, self.calls, np.int32)])
        hashes = np.fromiter(map(hash, keys), np.int64, n)
        order = hashes.argsort(kind="stable")
        at = self.hashes.searchsorted(hashes[order], side="right")
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.entry = np.insert(self.entry, at, (old + order).astype(np.int32))
        return np.arange(old, old + n)

    def of(self, entry: int) -> bytes:
        return self.ids[self.ids_at[entry] : self.ids_at[entry + 1]].tobytes()

    def trim(self) -> None:
        if len(self) <= self.max_cached and self.text.nbytes + self.ids.nbytes <= self.max_bytes:
            return
        sizes, counts = np.diff(self.text_at), np.diff(self.ids_at)
        last = np.argsort(-self.used, kind="stable")
        cost = np.cumsum((sizes + 4 * counts)[last])
        stays = np.zeros(len(self), bool)
        stays[last[: self.max_cached // 2][cost[: self.max_cached // 2] <= self.max_bytes // 2]] = True
        self.text, self.ids = self.text[np.repeat(stays, sizes)], self.ids[np.repeat(stays, counts)]
        self.text_at, self.ids_at = (np.concatenate([[0], np.cumsum(x[stays])]) for x in (sizes, counts))
        self.used = self.used[stays]
        number, kept_rows = np.cumsum(stays) - 1, stays[self.entry]
        self.hashes, self.entry = self.hashes[kept_rows], number[self.entry[kept_rows]].astype(np.int32)


class ChunkEncoder:
    """Ids of a ``tokenizers`` file whose pre-tokenizer never joins what white space separates:
    a text's ids are those of its chunks, and each distinct chunk is encoded once (a cache bounded
    in entries and bytes that keeps the chunks used of late). Words of Latin letters are one match
    each and go through ``Contraction``, all new ones of a batch at once; the library encodes the others."""

    #: Ends of ASCII punctuation are matches of their own in the tokenizer's pattern.
    TAIL = re.compile(rb"^(.*[A-Za-z0-9\x80-\xff])([.,!?;:%*#$&()\[\]{}|-]+)$")
    #: Longer words go to the library.
    LONGEST = Contraction.LONGEST - 8
    #: Words contracted at once, at most: a step's matrices are many times the words.
    AT_ONCE = 16_000

    def __init__(self, path: str, max_cached: int = 600_000, max_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.contract = Contraction(self.library)
        self.cached = Cached(max_cached, max_bytes)

    def word(self, chunk: bytes) -> bytes | None:
        """The chunk as normalised, if it is a short word of letters up to U+024F, where lower case
        goes by letters and nothing composes; else None."""
        if len(chunk) > self.LONGEST:
            return None
        if chunk.isascii():
            return chunk.lower() if chunk.isalpha() else None
        text = chunk.decode()
        if text.isalpha() and max(text) < "\u0250":
            text = text.lower()
            if text.isalpha() and max(text) < "\u0250":
                return text.encode()
        return None

    def made(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct chunks that are not cached, and of what they are made of that is not."""
        match, word, longest = self.TAIL.match, self.word, self.LONGEST
        known: dict[bytes, bytes] = {}
        words, given, others, stems, more = [], [], [], [], set()

        def sort(c):
            if w := word(c):
                words.append(w)
                given.append(c)
            else:
                others.append(c)

        for c in chunks:
            if c.isalpha() and len(c) <= longest:  # ASCII letters: the most, and no tail to look for
                words.append(c.lower())
                given.append(c)
            elif (m := match(c)) and b"<|" not in c and (m[1][-1] < 128 or m[1].decode()[-1].isalpha()):
                stem, tail = m.groups()
                stems.append((c, stem, tail))
                more.add(stem)
                more.add(tail)
            else:
                sort(c)
        parts = list(more.difference(chunks))
        there = dict(zip(parts, self.cached.find(parts).tolist()))
        for c in parts:
            if there[c] < 0:
                sort(c)
        for i in range(0, len(words), self.AT_ONCE):
            known.update(zip(given[i : i + self.AT_ONCE], self.contract(words[i : i + self.AT_ONCE])))
        for i in range(0, len(others), 4000):
            part = others[i : i + 4000]
            for c, e in zip(part, self.library.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)):
                known[c] = np.array(e.ids, "<u4").tobytes()
        for c, *both in stems:
            known[c] = b"".join([known[x] if x in known else self.cached.of(there[x]) for x in both])
        return known

    def encode(self, texts) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text of a list or an Arrow array (null: empty)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # ASCII letters are lower-cased anyway; a special token's spelling must not arise by it.
        plain = pc.and_not(pc.string_is_ascii(texts), pc.match_substring(texts, "<|"))
        split = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))
        ends = split.offsets.to_numpy()
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        cached = self.cached
        cached.trim()
        entry = cached.find(distinct)
        if len(missing := (entry < 0).nonzero()[0]):
            made = self.made([distinct[i] for i in missing.tolist()])
            number = dict(zip(made, cached.add(list(made), list(made.values())).tolist()))
            entry[missing] = [number[distinct[i]] for i in missing.tolist()]
        which = entry[chunks.indices.to_numpy()]
        begins = cached.ids_at[which]
        sizes = cached.ids_at[which + 1] - begins
        at = np.concatenate([[0], np.cumsum(sizes)])
        # Each token's place among the ids of the cache.
        place = np.repeat(begins - at[:-1], sizes)
        place += np.arange(at[-1])
        data, at = cached.ids[place].tobytes(), (4 * at[ends]).tolist()
        return [data[i:j] for i, j in zip(at, at[1:])]


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for k windows: sums of the windows, and the window of each size.

    Each size starts as a partial partition of k windows, all but one empty. The two partial
    partitions with the largest imbalance merge, the fullest window of one with the emptiest of
    the other, until one is left. Only sums and permutations are kept while merging.
    """
    n = len(sizes)
    merges: list = [None] * n
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = sums.argsort(kind="stable")
        sums = sums[order]
        merges.append((x, y, order))
        heapq.heappush(heap, (int(sums[0] - sums[-1]), len(merges) - 1, sums))
    where: list = [None] * len(merges)
    where[-1] = np.arange(k)
    for z in range(len(merges) - 1, n - 1, -1):
        x, y, order = merges[z]
        own = np.empty(k, np.int64)
        own[order] = where[z]
        where[x], where[y], where[z] = own, own[::-1], None
    return heap[0][2], np.array([where[i][-1] for i in range(n)])


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each size; the number of windows rises as long as one is over capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        sums, of = differencing(sizes, k)
        if sums[-1] <= capacity:
            return of
        k += 1


class Packer:
    """Packs a stream of documents with bounded memory: a group of documents at a time.

    A group holds ``group`` windows' worth of tokens (the last document goes on in the next
    group). Its documents are cut at the capacity only, but those in the last ``fine_share`` of
    it into pieces of ``fine`` tokens: differencing takes large sizes first, and the fine ones
    at the end level the windows to about one per cent. What is left at the end of the stream
    fills windows as far as it can, and the rest is cut into sequences of powers of two.
    """

    def __init__(self, capacity: int, group: int = 128, fill: float = 0.998, fine: int = 64, fine_share: float = 0.1):
        self.capacity, self.group, self.fill, self.fine, self.fine_share = capacity, group, fill, fine, fine_share
        self.held: list[tuple[int, int, int]] = []  # document, start, length
        self.tokens = 0
        self.sequences = 0

    def add(self, doc: int, length: int):
        """Yields (document, start, length, sequence, offset) of the groups that are full."""
        target, start = int(self.group * self.capacity * self.fill), 0
        while length:
            n = min(length, target - self.tokens)
            self.held.append((doc, start, n))
            self.tokens, start, length = self.tokens + n, start + n, length - n
            if self.tokens == target:
                yield from self.packed(self.held)
                self.held, self.tokens = [], 0

    def packed(self, parts):
        total, at, pieces = sum(n for _, _, n in parts), 0, []
        for doc, start, n in parts:
            step = self.capacity if at < total * (1 - self.fine_share) else self.fine
            pieces += [(doc, start + i, min(step, n - i)) for i in range(0, n, step)]
            at += n
        of = windows([n for _, _, n in pieces], self.capacity)
        filled = [0] * (int(of.max()) + 1)
        names = {w: self.sequences + i for i, w in enumerate(dict.fromkeys(of.tolist()))}
        for (doc, start, n), w in zip(pieces, of.tolist()):
            yield doc, start, n, names[w], filled[w]
            filled[w] += n
        self.sequences += len(names)

    def finish(self):
        whole = int(self.tokens // self.capacity * self.capacity * 0.985)
        first, rest, at = [], [], 0
        for doc, start, n in self.held:
            m = min(n, max(0, whole - at))
            first += [(doc, start, m)] * (m > 0)
            rest += [(doc, start + m, n - m)] * (n > m)
            at += n
        if first:
            yield from self.packed(first)
        left = self.tokens - whole
        rest.reverse()
        while left:
            room = size = min(self.capacity, 1 << (left.bit_length() - 1))
            while room:
                doc, start, n = rest.pop()
                m = min(n, room)
                yield doc, start, m, self.sequences, size - room
                if n > m:
                    rest.append((doc, start + m, n - m))
                room -= m
            left -= size
            self.sequences += 1
        self.held, self.tokens = [], 0


def encoder(path: str) -> ChunkEncoder:
    return kept(("words", path), lambda: ChunkEncoder(path))


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, ``with_ids``, the piece's ``ids`` (binary, little-endian unsigned 32-bit).

    Documents are tokenised and packed in the task that reads them, without a shuffle: every
    partition packs its own rows, a group of about ``128 * capacity`` tokens at a time, so that
    neither a hot source nor a long document gathers anywhere. A sequence's id holds the
    partition's number in the high bits; a lost task is repeated with the same result.

    Sequences have at most ``capacity`` tokens; those with fewer are padded by the trainer,
    those of a power of two need no padding. Defined results: null text is empty, an empty
    document is one piece of its end id; ids, repeated or null, pass through and each row is a
    document of its own; an empty table gives no pieces; other columns are ignored.
    """

    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        base = (TaskContext.get().partitionId()) << 40
        end = int(end_id).to_bytes(4, "little")
        coder, packer = encoder(tokenizer), Packer(capacity)
        waiting: dict[int, tuple] = {}  # documents that have tokens in the open group
        number, kind = 0, None

        def rows(found):
            out: list[list] = [[] for _ in range(8)]
            for doc, start, n, sequence, offset in found:
                doc_id, data = waiting[doc]
                piece = data[4 * start : 4 * (start + n)]
                for column, value in zip(out, (doc_id, start, n, zlib.crc32(piece), len(data) // 4, base + sequence, offset, piece)):
                    column.append(value)
            if found:
                open_docs = {doc for doc, _, _ in packer.held}
                for doc in [d for d in waiting if d not in open_docs and d < number]:
                    del waiting[doc]
                arrays = [pa.array(out[0], kind), *(pa.array(c, pa.int64()) for c in out[1:7])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    arrays.append(pa.array(out[7], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches, max_bytes=1 << 20):  # chunks, ids and places are many times the text
            kind = batch.column("doc_id").type
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                waiting[number] = (doc_id, data + end)
                found = list(packer.add(number, len(data) // 4 + 1))
                number += 1
                yield from rows(found)
            give_back()  # two workers beside one JVM seldom need their most at once
        yield from rows(list(packer.finish()))

    docs = docs.select(F.col("doc_id"), F.col("text"))
    return arrow_map(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, {PIECES}" + ", ids binary" * with_ids, keeps=True)


def op2_kk_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed by ``pack_documents``; nulls, empty and repeated rows and an empty
    table as there."""
    import public_tokenizers

    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
