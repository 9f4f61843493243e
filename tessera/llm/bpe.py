"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, arrow_map, kept, slices, texts_of

#: Token-position rows (w: word, p: position, np: the next row's position, id, nx: the next row's id)
#: meet the merge table; of each word the pair of least rank, the leftmost of equals, becomes one
#: token, until no word has a pair to contract: the second row of the pair takes the first one's place
#: and the new id, and the row before learns that id. A word's last iteration is its encoding; the
#: bytes of a document's ids, aggregated in order, are its decoding.
ENCODE = """
WITH RECURSIVE state(i, w, p, np, id, nx) AS (
  SELECT 0, t.w, t.p, t.np, t.id, t.nx FROM token t
  UNION ALL
  (WITH a AS MATERIALIZED (SELECT i, w, p, np, id, nx FROM state),
  least AS (SELECT w, min((m::BIGINT << 32) | (p << 16) | np) AS best FROM a JOIN merge ON lr = (id::BIGINT << 32) | nx GROUP BY w),
  pair AS (SELECT w, (best >> 32)::INTEGER AS made, ((best >> 16) & 65535)::INTEGER AS first, (best & 65535)::INTEGER AS second FROM least)
  SELECT i + 1, w, CASE WHEN p = second THEN first ELSE p END, np, CASE WHEN p = second THEN made ELSE id END, CASE WHEN np = first THEN made ELSE nx END
  FROM a JOIN pair USING (w) WHERE p <> first)
), ended AS (SELECT w, max(i) AS i FROM state GROUP BY w), final AS MATERIALIZED (SELECT w, p, id FROM state JOIN ended USING (w, i))
"""
IDS = ENCODE + "SELECT w, list(id ORDER BY p) AS ids FROM final GROUP BY w"
WHOLE = "SELECT word.w, id FROM word JOIN vocabulary USING (bytes) ORDER BY word.w"
DECODE = """
SELECT d, count(*) AS many, string_agg(digits, '' ORDER BY p) AS decoded FROM ids JOIN vocabulary USING (id) GROUP BY d ORDER BY d
"""


class Coder:
    """Encodes and decodes with the ranks of a .tiktoken file. Each distinct word goes through
    the recursive query once (a bounded cache that keeps the words used of late)."""

    #: Longer words would take an iteration over all their rows for each contraction; they are
    #: contracted by the same rule with a priority queue.
    LONG = 512

    def __init__(self, path: str, pattern: str, max_cached: int = 600_000):
        import duckdb
        import pyarrow as pa
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.recent = Recent(max_cached)
        self.known: dict[str, bytes] = self.recent.now  # ids of chunks
        get = self.ranks.get
        merges = [(l << 32 | r, m) for t, m in self.ranks.items() for i in range(1, len(t)) if (l := get(t[:i])) is not None and (r := get(t[i:])) is not None]
        db = self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        db.execute("SET preserve_insertion_order = false")
        made = pa.table({"lr": pa.array([x for x, _ in merges], pa.int64()), "m": pa.array([m for _, m in merges], pa.int32())})
        names = pa.table({"id": pa.array(list(self.bytes), pa.int32()), "bytes": pa.array(list(self.bytes.values()), pa.binary()), "digits": [t.hex() for t in self.bytes.values()]})
        for name, rows in (("merge", made), ("vocabulary", names)):
            db.register("given", rows)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            db.unregister("given")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _query(self, sql: str, **tables):
        """The result as an Arrow table."""
        for name, rows in tables.items():
            self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            for name in tables:
                self.db.unregister(name)

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each word."""
        import pyarrow as pa

        out: list = [None] * len(words)
        numbers = pa.array(range(len(words)), pa.int32())
        whole = self._query(WHOLE, word=pa.table({"w": numbers, "bytes": pa.array(words, pa.binary())}))
        for w, i in zip(whole.column("w").to_pylist(), whole.column("id").to_pylist()):
            out[w] = i.to_bytes(4, "little")
        rest, rows = [], 0
        for w in (w for w, done in enumerate(out) if done is None):
            if len(words[w]) > self.LONG:
                out[w] = np.array(self._long(words[w]), "<u4").tobytes()
                continue
            rest.append(w)
            rows += len(words[w]) ** 2
            if rows > 6_000_000:  # what the recursion may hold at once
                self._recursive(words, rest, out)
                rest, rows = [], 0
        if rest:
            self._recursive(words, rest, out)
        return out

    def _recursive(self, words: list[bytes], rest: list[int], out: list) -> None:
        import pyarrow as pa

        sizes = np.array([len(words[w]) for w in rest])
        begins = np.cumsum(sizes) - sizes
        ids = self.single[np.frombuffer(b"".join([words[w] for w in rest]), np.uint8)]
        follows = np.concatenate([ids[1:], np.array([-1], np.int32)])
        follows[begins + sizes - 1] = -1
        places = (np.arange(sizes.sum()) - np.repeat(begins, sizes)).astype(np.int32)
        token = pa.table({"w": np.repeat(np.array(rest, np.int32), sizes), "p": places, "np": places + np.int32(1), "id": ids, "nx": follows})
        for part in self._query(IDS, token=token).to_batches():
            lists = part.column("ids")
            ends = (np.cumsum(lists.value_lengths().to_numpy()) * 4).tolist()
            ids = lists.flatten().to_numpy().astype("<u4").tobytes()
            for w, begin, end in zip(part.column("w").to_pylist(), [0, *ends], ends):
                out[w] = ids[begin:end]

    def _long(self, word: bytes) -> list[int]:
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(p):
            q = after[p] if p >= 0 else -1
            if q >= 0 and (m := self.ranks.get(self.bytes[ids[p]] + self.bytes[ids[q]])) is not None:
                heapq.heappush(heap, (m, p, ids[p], ids[q]))

        for p in range(len(ids)):
            offer(p)
        while heap:
            m, p, l, r = heapq.heappop(heap)
            q = after[p]
            if ids[p] != l or q < 0 or ids[q] != r:
                continue
            ids[p], ids[q], after[p] = m, -1, after[q]
            if after[q] >= 0:
                before[after[q]] = p
            after[q] = -1
            offer(before[p])
            offer(p)
        return [i for i in ids if i >= 0]

    def _chunks(self, text: str) -> list[str]:
        """Stretches that the pattern treats alone: where no two white spaces meet, a match ends
        before each space; else the matches themselves."""
        if re.search(r"\s\s", text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first] * bool(first) + [" " + c for c in rest]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian unsigned 32-bit) of each text, and the bytes that these ids decode to."""
        split = [self._chunks(t) for t in texts]
        known = self.known
        # Letters after a space or none are one match; only ASCII ones here, which all versions of Unicode agree on.
        matches = {c: [c] if c.isascii() and c.removeprefix(" ").isalpha() else self.pattern.findall(c) for c in self.recent.missing(set().union(*split))}
        words = list(set().union(*matches.values()).difference(known))
        for i in range(0, len(words), 40_000):
            part = words[i : i + 40_000]
            known.update(zip(part, self._contract([w.encode() for w in part])))
        for c, found in matches.items():
            if len(found) != 1:
                known[c] = b"".join([known[w] for w in found])
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        return list(zip(out, self.decode(out)))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Decoded bytes of each array of little-endian unsigned 32-bit ids."""
        import pyarrow as pa

        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        rows = pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), [len(a) for a in arrays]), "p": np.concatenate([np.arange(len(a), dtype=np.int32) for a in arrays] or [np.zeros(0, np.int32)]), "id": np.concatenate(arrays or [np.zeros(0, np.int32)])})
        out = [b""] * len(ids)
        found = self._query(DECODE, ids=rows)
        for d, many, decoded in zip(*(found.column(c).to_pylist() for c in ("d", "many", "decoded"))):
            if many != len(arrays[d]):
                raise ValueError("an id is not in the vocabulary")
            out[d] = bytes.fromhex(decoded)
        if any(len(a) and not x for a, x in zip(arrays, out)):
            raise ValueError("an id is not in the vocabulary")
        return out


def coder(path: str, pattern: str) -> Coder:
    return kept(("bytes", path, pattern), lambda: Coder(path, pattern))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, digests: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids, decoded`` (binary; ids little-endian unsigned 32-bit), or
    with ``digests`` the SHA-256 of both instead: ``ids_sha256, decoded_sha256``.

    Rows are encoded where they are read, without a shuffle; a task holds a few megabytes of
    texts, their distinct words and a bounded cache. Null text is empty and has no tokens; ids,
    repeated or null, pass through, each row giving one; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """

    def run(batches):
        import pyarrow as pa

        c = coder(ranks, pattern)
        for batch in slices(batches):
            both = c.encode(texts_of(batch))
            columns = [batch.column("doc_id"), pa.array([len(a) // 4 for a, _ in both], pa.int64())]
            if digests:
                columns += [pa.array([hashlib.sha256(x[k]).hexdigest() for x in both], pa.string()) for k in (0, 1)]
            else:
                columns += [pa.array([x[k] for x in both], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    docs = docs.select(F.col("doc_id"), F.col("text"))
    return arrow_map(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, " + ", ".join(f"{n} {'string' if digests else 'binary'}" for n in names), keeps=True)


def decode_documents(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, decoded`` (binary) of rows with ``doc_id, ids``. Null or empty ids decode to no
    bytes; rows that repeat are decoded each; an empty table gives no rows; an id that is not in the
    vocabulary raises; other columns are ignored."""

    def run(batches):
        import pyarrow as pa

        c = coder(ranks, pattern)
        for batch in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c.decode([x or b"" for x in batch.column("ids").to_pylist()]), pa.binary())], names=["doc_id", "decoded"])

    rows = rows.select("doc_id", "ids")
    return arrow_map(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded binary", keeps=True)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all ``documents``, as digests; nulls, empty and repeated rows and an
    empty table as in ``encode_documents``."""
    import public_tokenizers

    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
