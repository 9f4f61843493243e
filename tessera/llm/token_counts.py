"""Token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, arrow_map, kept, slices, texts_of

SPACE = "▁"
#: Tables of longer words are made one by one and not cached.
LONG_WORD = 64


class PrefixCounter:
    """Exact token counts of all prefixes for a sentencepiece BPE model.

    In BPE every stretch of an encoding is the encoding of what it covers, and a sequence of
    pieces is the encoding of its text if and only if every two neighbours are the encoding of
    theirs. So the encoding of a prefix ends in the one piece t whose left neighbour, the last
    piece of the prefix without t, is compatible with it, and

        count[i] = count[i - len(t)] + 1,  last[i] = t.

    One pass over a text gives the count of every prefix. No piece of the model reaches over a
    space into the next word, so the table is made once for each distinct word (a bounded cache)
    and a text's table is the tables of its words in a row, kept as differences: one signed byte
    for each code point.
    """

    def __init__(self, model: str, max_cached: int = 500_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp = self.library
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.longest = max(map(len, self.scores))
        self.max_cached = max_cached
        self.recent = Recent(max_cached)
        self.words: dict[str, bytes] = self.recent.now
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        # For tables of many words at once: pieces by number, and a trie of the reversed pieces,
        # its steps sorted as node << 21 | code point.
        self.pieces = list(self.scores)
        number = {p: i for i, p in enumerate(self.pieces)}
        steps: dict[int, int] = {}
        ends = [-1]
        for piece in self.pieces:
            node = 0
            for c in reversed(piece):
                key = node << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                node = steps[key]
            ends[node] = number[piece]
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_nodes = np.array([steps[k] for k in self.step_keys.tolist()], np.int32)
        self.ends = np.array(ends, np.int32)
        self.standing = np.full(len(self.pieces), -1, np.int8)
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        # Long runs of spaces are cut into the model's longest piece of spaces; the library is asked
        # whether this model does so, as it need not.
        run = self.run = max((len(p) for p in self.scores if not p.strip(SPACE)), default=1)
        self.spaces = [0, 1] + [len(sp.encode(" " * (j - 1))) for j in range(2, 2 * run + 1)]
        if any(len(sp.encode(" " * (n - 1))) != self.space_run(n) for n in [*range(2 * run, 4 * run + 2), 17 * run + 3, 64 * run - 1]):
            raise ValueError("the model's counts of runs of spaces do not grow by its longest piece of spaces")
        self._check()

    def _check(self) -> None:
        """Raises for a model whose counts are not those of this program, as of another kind of model."""
        text = "The quick  brown fox, jumped\nover 12,345 lazy dogs; naïve Straße   x\u4e2d\u6587 "
        if any(int(np.frombuffer(self.differences(text[:n]), np.int8).sum(dtype=np.int64)) != len(self.library.encode(text[:n])) for n in range(len(text) + 1)):
            raise ValueError("the model's token counts do not follow from its scores")

    def space_run(self, n: int) -> int:
        """Tokens of n spaces."""
        if n < len(self.spaces):
            return self.spaces[n]
        return n // self.run + self.spaces[n % self.run]

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best score first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.max_cached:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def stands(self, piece: str) -> bool:
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return found

    def table(self, word: str) -> tuple[list[int], list[bool]]:
        """counts[i] of word[:i], and whether the encoding of word[:i] begins with a lone first character."""
        scores, n = self.scores, len(word)
        counts, lasts, lone = [0] * (n + 1), [""] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            if word[i - 1] not in scores:  # byte fallback; nothing merges with it
                counts[i], lone[i] = counts[i - 1] + len(word[i - 1].encode()), lone[i - 1] or i == 1
                continue
            for j in range(max(0, i - self.longest), i):
                piece = word[j:i]
                if piece in scores and self.stands(piece) and (not lasts[j] or self.fits(lasts[j], piece)):
                    counts[i], lasts[i], lone[i] = counts[j] + 1, piece, lone[j] if j else i == 1
                    break
            else:
                raise ValueError(f"no piece ends prefix {word[:i]!r}")
        return counts, lone

    def _fits_all(self, keys: np.ndarray) -> np.ndarray:
        """``fits`` for pairs of piece numbers, left * pieces + right."""
        at = np.searchsorted(self.pair_keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.pair_keys)
        known[inside] = self.pair_keys[at[inside]] == keys[inside]
        if not known.all():
            n = len(self.pieces)
            fresh = np.unique(keys[~known])
            fits = np.array([self.merged(self.pieces[k // n] + self.pieces[k % n]) == [self.pieces[k // n], self.pieces[k % n]] for k in fresh.tolist()])
            if len(self.pair_keys) + len(fresh) > 8 * self.max_cached:
                self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
                return self._fits_all(keys)
            order = np.argsort(merged := np.concatenate([self.pair_keys, fresh]), kind="stable")
            self.pair_keys, self.pair_fits = merged[order], np.concatenate([self.pair_fits, fits])[order]
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_fits[at]

    def tables(self, words: list[str]) -> list[bytes]:
        """``word`` of many words after one space: the same recurrence, position by position for
        all words at once."""
        words = [SPACE + w for w in words]
        n, sizes = len(self.pieces), np.array([len(w) for w in words])
        width = int(sizes.max())
        chars = np.zeros((len(words), width), np.int64)
        chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        counts = np.zeros((len(words), width + 1), np.int32)
        lasts = np.full((len(words), width + 1), -1, np.int32)  # -1: the begin, or bytes
        for i in range(1, width + 1):
            rows = np.flatnonzero(sizes >= i)
            nodes = np.zeros(len(rows), np.int64)
            for size in range(1, min(i, self.longest) + 1):
                j = i - size
                keys = nodes << 21 | chars[rows, j]
                at = np.minimum(np.searchsorted(self.step_keys, keys), len(self.step_keys) - 1)
                found = self.step_keys[at] == keys
                if size == 1 and not found.all():  # byte fallback; nothing merges with it
                    odd = rows[~found]
                    c = chars[odd, j]
                    counts[odd, i] = counts[odd, j] + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                rows, nodes = rows[found], self.step_nodes[at[found]].astype(np.int64)
                if not len(rows):
                    break
                piece = self.ends[nodes]
                ended = np.flatnonzero(piece >= 0)
                if len(ended):
                    r, p = rows[ended], piece[ended]
                    unsure = np.unique(p[self.standing[p] < 0])
                    for x in unsure.tolist():
                        self.standing[x] = self.stands(self.pieces[x])
                    left = lasts[r, j]
                    good = self.standing[p] == 1
                    pair = np.flatnonzero(good & (left >= 0))
                    if len(pair):
                        good[pair] = self._fits_all(left[pair].astype(np.int64) * n + p[pair])
                    r, p = r[good], p[good]
                    counts[r, i], lasts[r, i] = counts[r, j] + 1, p
                    open_ = np.ones(len(rows), bool)
                    open_[ended[good]] = False  # the one piece is found
                    rows, nodes = rows[open_], nodes[open_]
                    if not len(rows):
                        break
        if (counts[np.arange(width + 1) <= sizes[:, None]] < 0).any() or (counts[:, 1:][np.arange(1, width + 1) <= sizes[:, None]] == 0).any():
            raise ValueError("a prefix has no last piece")
        steps = np.diff(counts, axis=1).astype(np.int8)
        return [row[:size].tobytes() for row, size in zip(steps, sizes.tolist())]

    def add(self, texts: list[str]) -> None:
        """Makes the tables of the words of ``texts`` that are not cached."""
        fresh = self.recent.missing(set().union(*[t.replace(SPACE, " ").split(" ") for t in texts if t]))
        fresh = sorted((w for w in fresh if len(w) <= LONG_WORD), key=len)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            self.words.update(zip(part, self.tables(part)))

    def word(self, rest: str, spaces: int = 1) -> bytes:
        """Differences of the counts over the prefixes of that many spaces and ``rest``."""
        if spaces == 1 and (found := self.words.get(rest)) is not None:
            return found
        counts, lone = self.table(SPACE + rest)
        if spaces > 1:
            whole, less = self.space_run(spaces), self.space_run(spaces - 1)
            counts = [self.space_run(j) for j in range(spaces + 1)] + [whole + c - 1 if x else less + c for c, x in zip(counts[2:], lone[2:])]
        out = np.diff(counts).astype(np.int8).tobytes()
        return out

    def differences(self, text: str) -> bytes:
        """One signed byte for each code point: how the count changes with it."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if text[0] == " " or "  " in text:
            units = re.findall("( +)([^ ]*)", " " + text)
            parts = [self.word(rest, len(run)) for run, rest in units]
        else:
            get = self.words.get
            parts = [get(w) or self.word(w) for w in text.split(" ")]
        head = parts[0]  # the model puts a space before a text: it comes with the first character
        both = (np.frombuffer(head[:2], np.int8).sum()).astype(np.int8).tobytes()
        parts[0] = both + head[2:]
        return b"".join(parts)


def pack(differences: bytes) -> bytes:
    return zlib.compress(differences, 1)


def prefix_counts(store: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 ... code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(store), np.int8), dtype=np.int64)])


def longest_within(store: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(store) <= budget)[-1])


def counter(model: str) -> PrefixCounter:
    return kept(("prefixes", model), lambda: PrefixCounter(model))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", store: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens`` and, with ``store``, ``prefix_store``: the token
    count of every prefix (read it with ``prefix_counts`` and ``longest_within``, which answer
    truncation and budget questions without encoding again).

    Rows are counted where they are read, without a shuffle; a task holds one Arrow batch and a
    bounded cache of words. Null text counts as empty, which has 0 tokens; ids, repeated or
    null, pass through; other columns are ignored. ``model`` is a path on every machine.
    """

    def run(batches):
        import pyarrow as pa

        c = counter(model)
        for batch in slices(batches):
            texts = texts_of(batch)
            c.add(texts)
            tables = [c.differences(t) for t in texts]
            columns = [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in tables], pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if store:
                columns.append(pa.array([pack(d) for d in tables], pa.binary()))
                names.append("prefix_store")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs, run, f"doc_id {kind}, n_bytes long, n_tokens long" + ", prefix_store binary" * store, keeps=True)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """``token_counts`` of all ``documents``; nulls, empty and repeated rows and an empty table as
    there."""
    import public_tokenizers

    from .common import table

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "prefix_store")
