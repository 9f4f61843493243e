"""Secret scan with DataFrame functions only: three fixed patterns, and candidate strings with a
sliding window of high Shannon entropy per character class, less an allow-list."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, text_of

#: Fixed values of the contract. The counted forms {14,} and {16,} find what the open forms
#: find after their short matches are dropped, since both end where the run of characters ends.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_MIN = 12


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``chars`` (ASCII) of at least ``window`` characters (31 at most)."""

    kind: str
    chars: str
    bits: float
    window: int = 20

    @property
    def pattern(self) -> str:
        return f"[{self.chars}]{{{self.window},}}"

    @property
    def alphabet(self) -> list[str]:
        return [chr(i) for i in range(128) if re.fullmatch(f"[{self.chars}]", chr(i))]


CLASSES = (CharClass("entropy_hex", "0-9A-Fa-f", 3.0), CharClass("entropy_base64", r"A-Za-z0-9+/_=\-", 3.7))
#: Candidates that are no secrets: words without digits, numbers, one repeated character, UUIDs,
#: paths and slugs of lower-case words, published example keys. Repeated groups are possessive, so
#: that a match takes a loop, not a stack frame for each repetition, however long the candidate is.
ALLOWED = (
    r"^[A-Za-z+/_=\-]++$",
    r"^[0-9+/_=\-]++$",
    r"^(.)\1++$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^/?+(?:[a-z]++[0-9]*+[/_\-]++)++(?:[a-z]++[0-9]*+)?+$",
    r"EXAMPLE",
)
#: Characters of a candidate that are scanned at a time.
BLOCK = 4096
#: 2^0 to 2^30: a running sum over n elements takes the first log2(n) doublings.
_PASSES = "array(" + ", ".join(str(1 << k) for k in range(31)) + ")"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once: a column that a lambda names would be put in its place
    by the optimizer, and then be evaluated for every element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(array: str, combined: str) -> str:
    """Running fold of ``array`` by ``combined`` of x and y (the element 2^k places before), by
    doublings: n log n steps, where appending to an array one by one takes n squared."""
    return f"aggregate(slice({_PASSES}, 1, cast(ceil(log2(greatest(size({array}), 1))) as int)), {array}, (a, k) -> transform(a, (x, i) -> if(i >= k, {_let('y', 'a[greatest(i - k, 0)]', combined)}, x)))"


def _matches(df: DataFrame, p: str, name: str, pattern: str, min_group2: int = 0) -> DataFrame:
    """Adds ``name``: array of (s, e, bs, be, hit) of the matches in the text: places in code points
    and in bytes, ends exclusive.

    ``split`` gives the gaps between the matches that ``regexp_extract_all`` lists, so that the
    places are running sums of lengths. Texts without a match skip both.
    """
    q, text, hits, second, gaps, ends = _sql(pattern), f"{p}text", f"{p}hits", f"{p}second", f"{p}gaps", f"{p}ends"
    df = df.withColumn(hits, F.expr(f"if({text} rlike {q}, regexp_extract_all({text}, {q}, 0), null)"))
    df = df.withColumn(gaps, F.expr(f"if({hits} is null, null, split({text}, {q}, -1))"))
    df = df.withColumn(ends, F.expr(f"if({hits} is null, null, zip_with(slice({gaps}, 1, size({hits})), {hits}, (g, h) -> struct(char_length(g) + char_length(h) as c, octet_length(g) + octet_length(h) as b)))"))
    df = df.withColumn(ends, F.expr(f"if({hits} is null, null, {_running(ends, 'struct(x.c + y.c as c, x.b + y.b as b)')})"))
    spans = _let("m", hits, f"transform({ends}, (x, i) -> struct(x.c - char_length(m[i]) as s, x.c as e, x.b - octet_length(m[i]) as bs, x.b as be, m[i] as hit))")
    if min_group2:
        df = df.withColumn(second, F.expr(f"if({hits} is null, null, transform(regexp_extract_all({text}, {q}, 2), x -> char_length(x)))"))
        spans = _let("z", second, f"filter({spans}, (x, i) -> z[i] >= {min_group2})")
    spans = f"if({hits} is null, null, {spans})"
    none = "cast(array() as array<struct<s: int, e: int, bs: int, be: int, hit: string>>)"
    return df.withColumn(name, F.expr(f"coalesce({spans}, {none})")).drop(hits, gaps, ends, second)


def _entropy_spans(df: DataFrame, p: str, name: str, kind: CharClass, allowed: tuple[str, ...]) -> DataFrame:
    """Adds ``name``: from the first to the last window of a candidate whose entropy reaches
    ``kind.bits``. One pass: the counts of the window change by the character that enters and
    the one that leaves, and with them the sum of c*log2(c); entropy is log2(w) - sum / w.

    The counts are 5 bits each, twelve to a number; the sum is of whole multiples of 2^-32, so that
    it does not depend on the way it was reached. A long candidate is read a block at a time, the
    blocks overlapping by a window less one character, so that only a block's characters are held."""
    w, cand, table, logs = kind.window, f"{p}cand", f"{p}table", f"{p}logs"
    df = _matches(df, p, cand, kind.pattern)
    for pattern in allowed:
        df = df.withColumn(cand, F.expr(f"if(size({cand}) = 0, {cand}, filter({cand}, c -> not c.hit rlike {_sql(pattern)}))"))
    # A character's place: which number, and how many bits to shift in it.
    place = {c: (i // 12) << 6 | 5 * (i % 12) for i, c in enumerate(kind.alphabet)}
    numbers = -(-len(place) // 12)
    df = df.withColumn(table, F.expr(f"if(size({cand}) = 0, null, array({', '.join(str(place.get(chr(i), 0)) for i in range(128))}))"))
    df = df.withColumn(logs, F.expr(f"if(size({cand}) = 0, null, array({', '.join(f'{round(c * math.log2(c) * 2**32) if c else 0}L' for c in range(w + 2))}))"))
    state = "struct<n: array<bigint>, sum: bigint, lo: int, hi: int>"
    many = lambda x: f"cast(shiftright(a.n[shiftright({x}, 6)], {x} & 63) & 31 as int)"
    step = f"""transform(array(struct(ch[i] as inn, if(i >= {w}, ch[i - {w}], -1) as gone)), t -> if(t.inn = t.gone, struct(a.n as n, a.sum as sum), struct(
        transform(a.n, (v, k) -> v + if(k = shiftright(t.inn, 6), shiftleft(1L, t.inn & 63), 0L) - if(t.gone >= 0 and k = shiftright(t.gone, 6), shiftleft(1L, t.gone & 63), 0L)) as n,
        a.sum + logs[{many('t.inn')} + 1] - logs[{many('t.inn')}] + if(t.gone >= 0, logs[{many('t.gone')} - 1] - logs[{many('t.gone')}], 0L) as sum)))"""
    hot = f"(i >= {w - 1} and t.sum <= {math.floor((math.log2(w) - kind.bits) * w * 2**32)}L)"
    moved = f"transform({step}, t -> cast(struct(t.n, t.sum, if({hot} and a.lo < 0, i - {w - 1}, a.lo), if({hot}, i + 1, a.hi)) as {state}))[0]"
    scan = f"aggregate(sequence(0, size(ch) - 1), cast(struct(array_repeat(0L, {numbers}), 0L, -1, -1) as {state}), (a, i) -> {moved}, a -> struct(a.lo as lo, a.hi as hi))"
    chars = f"transform(filter(split(cast(substring(h, b + 1, {BLOCK + w - 1}) as string), ''), x -> x <> ''), x -> places[ascii(x)])"
    blocks = f"transform(sequence(0, octet_length(h) - {w}, {BLOCK}), b -> {_let('r', _let('ch', chars, scan), 'struct(r.lo as raw, b + r.lo as lo, b + r.hi as hi)')})"
    found = _let("h", "cast(c.hit as binary)", f"filter({blocks}, r -> r.raw >= 0)")
    scanned = _let("places", table, _let("logs", logs, f"transform({cand}, c -> struct(c.s as s, c.bs as bs, {found} as r))"))
    df = df.withColumn(cand, F.expr(f"if(size({cand}) = 0, null, {scanned})"))
    ends = "transform(filter({0}, c -> size(c.r) > 0), c -> transform(array(struct(c.r[0].lo as lo, element_at(c.r, -1).hi as hi)), r -> struct(c.s + r.lo as s, c.s + r.hi as e, c.bs + r.lo as bs, c.bs + r.hi as be))[0])".format(cand)
    return df.withColumn(name, F.expr(f"coalesce({ends}, cast(array() as array<struct<s: int, e: int, bs: int, be: int>>))")).drop(cand, table, logs)


def _scanned(docs: DataFrame, p: str, text_col: str, classes: tuple[CharClass, ...], allowed: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``{p}text``, ``{p}base`` and ``{p}spans``: arrays of (s, rank, e, kind, bs, be)."""
    df = docs.withColumn(f"{p}text", text_of(text_col))
    kinds = [("assign", ASSIGN, ASSIGN_MIN), ("access", ACCESS, 0), ("hex", HEX, 0)]
    for i, (_, pattern, least) in enumerate(kinds):
        df = _matches(df, p, f"{p}k{i}", pattern, least)
    for i, c in enumerate(classes, len(kinds)):
        df = _entropy_spans(df, p, f"{p}k{i}", c, allowed)
    names = [k for k, _, _ in kinds] + [c.kind for c in classes]
    ranked = [f"transform({p}k{i}, x -> struct(x.s as s, {i} as rank, x.e as e, '{k}' as kind, x.bs as bs, x.be as be))" for i, k in enumerate(names)]
    df = df.withColumn(f"{p}base", F.expr(f"sort_array(concat({', '.join(ranked[: len(kinds)])}))"))
    none = " and ".join(f"size({p}k{i}) = 0" for i in range(len(kinds), len(names)))
    more = f"if({none}, {p}base, sort_array(concat({', '.join([f'{p}base', *ranked[len(kinds):]])})))" if classes else f"{p}base"
    return df.withColumn(f"{p}spans", F.expr(more)).drop(*[f"{p}k{i}" for i in range(len(names))])


def find_secrets(docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with two more columns: ``_base`` and ``_spans``, arrays of
    (s, rank, e, kind) sorted by start, then kind in its listed order.

    A row is scanned where it is read: no shuffle, no Python. ``_base`` holds the matches of the
    three fixed patterns, ``_spans`` these and the entropy spans of ``classes``.

    Defined results: null text is empty and has no span; rows that repeat are scanned each; ids of
    any type, null too, pass through; kinds may overlap each other; places are code points. Work
    and memory grow with the length of a text, however many matches it has and however long a
    candidate is. An empty table gives no rows. A column of ``docs`` that is named ``_base`` or
    ``_spans`` raises ValueError before anything runs; all other names are free.
    """
    if clash := {"_base", "_spans"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns named {sorted(clash)}")
    p = free_prefix(docs)
    df = _scanned(docs, p, text_col, classes, allowed)
    narrow = lambda c: F.expr(f"transform({p}{c}, x -> struct(x.s as s, x.rank as rank, x.e as e, x.kind as kind))").alias(f"_{c}")
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], narrow("base"), narrow("spans"))


def spelled(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and ``n_chars`` set
    anew where something was replaced. No row goes; rows without a span stay as they are, a null
    text null. Defined results otherwise as for ``find_secrets``, and a column of any name keeps
    its values.

    The text is cut at byte places, which takes one pass: where a span begins before the furthest
    end so far it goes on with the one before, else a piece of the text lies between."""
    p = free_prefix(docs)
    df = _scanned(docs, p, "text", **({"classes": CLASSES, "allowed": ALLOWED} | options))
    spans, ends, data, text = f"{p}spans", f"{p}ends", f"{p}data", f"{p}text"
    found = F.size(spans) > 0
    df = df.withColumn(ends, F.expr(f"if(size({spans}) = 0, null, transform({spans}, x -> x.be))"))
    df = df.withColumn(ends, F.expr(f"if(size({spans}) = 0, null, {_running(ends, 'greatest(x, y)')})"))
    df = df.withColumn(data, F.expr(f"if(size({spans}) = 0, null, cast({text} as binary))"))
    pieces = f"transform(filter(transform({spans}, (x, i) -> struct(if(i = 0, 0, t[greatest(i - 1, 0)]) as a, x.bs as b)), x -> x.b >= x.a), x -> concat(cast(substring(d, x.a + 1, x.b - x.a) as string), {_sql(mark)}))"
    cut = _let("d", data, _let("t", ends, f"concat(array_join({pieces}, ''), cast(substring(d, element_at(t, -1) + 1) as string))"))
    df = df.withColumn(text, F.when(found, F.expr(cut)))
    new = {"text": F.when(found, F.col(text)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of all ``documents``. Null and empty texts have no spans (the digest is that of the
    empty string); every row gives one row, repeated ones too; an empty table gives none."""
    from .common import table

    df = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.expr(f"cast(size(filter(_base, x -> x.kind = '{kind}')) as bigint)")
    return df.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(spelled("_base"), 256).alias("base_sha256"), spelled("_spans").alias("spans"))


def _oracle() -> str:
    """The same spans in DuckDB: places by running sums over unnested matches, entropy by counting
    the characters of every window of every candidate anew."""
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *[(c.kind, c.pattern) for c in CLASSES]]
    quoted = lambda x: x.replace("'", "''")
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{k}' AS kind, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, {'unnest(z)' if k == 'assign' else 'NULL'} AS second, generate_subscripts(h, 1) AS i "
        f"FROM (SELECT doc_id, regexp_extract_all(t, '{quoted(x)}') AS h, string_split_regex(t, '{quoted(x)}') AS g" + (f", regexp_extract_all(t, '{quoted(x)}', 2) AS z" if k == "assign" else "") + " FROM d) q"
        for i, (k, x) in enumerate(kinds)
    )
    simple = [p.replace("++", "+").replace("*+", "*").replace("?+", "?") for p in ALLOWED if "\\1" not in p]
    refused = " OR ".join([*[f"regexp_matches(hit, '{quoted(p)}')" for p in simple], "replace(hit, hit[1], '') = ''"])
    bits = "CASE rank " + " ".join(f"WHEN {i} THEN {c.bits!r}" for i, c in enumerate(CLASSES, 3)) + " END"
    w = CLASSES[0].window
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM found),
spans AS (SELECT doc_id, rank, kind, hit, second, e - length(hit) AS s, e FROM placed),
cand AS (SELECT * FROM spans WHERE rank >= 3 AND NOT ({refused})),
win AS (SELECT doc_id, rank, kind, s, hit, unnest(range(0, length(hit) - {w - 1})) AS b FROM cand),
ch AS (SELECT doc_id, rank, kind, s, b, hit[b + k + 1] AS c, count(*) AS n FROM win, range({w}) AS u(k) GROUP BY ALL),
hot AS (SELECT doc_id, rank, kind, s, b FROM ch GROUP BY ALL HAVING -sum(n / {w}.0 * log2(n / {w}.0)) >= {bits}),
allspans AS (
  SELECT doc_id, rank, kind, s, e FROM spans WHERE rank < 3 AND (rank > 0 OR length(second) >= {ASSIGN_MIN})
  UNION ALL SELECT doc_id, rank, kind, s + min(b), s + max(b) + {w} FROM hot GROUP BY doc_id, rank, kind, s),
told AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS x,
  string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(e AS BIGINT)), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
  string_agg(concat_ws(':', kind, CAST(s AS BIGINT), CAST(e AS BIGINT)), ',' ORDER BY s, rank) AS spans FROM allspans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""


ORACLE_OP10 = _oracle()
