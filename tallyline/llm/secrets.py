r"""Secret scan: three base patterns and sliding-window Shannon entropy.

Base spans are the leftmost non-overlapping matches of each kind. Candidate
strings of the method are runs of 20 or more base64 characters. A window of 20
characters slides over a candidate; each step adds one to the count of the
character that enters and takes one from that of the character that leaves,
and the sum of ``count * log2(count)`` changes by two table differences. The
sum is kept in whole 2**-20 units, so it never drifts. A candidate counts when
a window's entropy reaches its class's threshold and no allow-list rule knows
it. The classes are ``hex`` (16 symbols, case folded) and ``base64``.

The allow list: runs without both a digit and a letter (words of one case,
identifiers of words joined by separators), UUIDs, and strings marked as
examples. Candidates that overlap a base span add nothing.

Everything is a DataFrame expression. Places of matches are running sums of the
pieces' lengths, made in blocks, so that the work grows in proportion to a
text's matches; overlaps are found by running maxima over the sorted spans; and
a long candidate is looked at in slices that overlap by a window. Texts without
a sign of a kind are not put through its pattern.

Defined results: a null or empty text has no spans; offsets are code points;
a repeated row has its result twice; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from .names import fresh

# fixed values
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character that a window has to reach; 20 random hex digits have 3.2 on average, 20 random base64 characters 4.1.
THRESHOLD = {"hex": 2.75, "base64": 3.75}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|xxxxx",
)

UNIT = 1 << 20
#: Elements whose running sum grows in one array, and characters of a candidate that are looked at at once.
BLOCK, SLICE = 64, 4096
SPAN = "array<struct<start:bigint,kind:int,finish:bigint>>"
VALUED = "array<struct<start:bigint,kind:int,finish:bigint,value:string>>"


def _steps() -> str:
    """``count * log2(count)`` for 0 to WINDOW, in units."""
    return "array(" + ",".join(f"{round(c * math.log2(c) * UNIT) if c else 0}L" for c in range(WINDOW + 2)) + ")"


def _least_sum(text: str) -> str:
    """SQL of the least sum of count * log2(count) over the windows of an expression's characters.

    ``c`` holds the counts, one character ('0' + count) for each symbol.
    """
    symbols = f"transform(split({text}, ''), ch -> instr('{ALPHABET}', ch))"
    return f"""
element_at(transform(array(named_struct('at', {symbols}, 'f', {_steps()})), q -> aggregate(
  sequence(1, size(q.at)),
  named_struct('c', repeat('0', {len(ALPHABET)}), 's', 0L, 'least', cast(9223372036854775807 as bigint)),
  (a, i) -> element_at(transform(transform(transform(
    array(named_struct('put', element_at(q.at, i), 'n', ascii(substring(a.c, element_at(q.at, i), 1)) - 48)),
    e -> named_struct(
      'c', overlay(a.c placing chr(e.n + 49) from e.put for 1),
      's', a.s + element_at(q.f, e.n + 2) - element_at(q.f, e.n + 1),
      'gone', if(i > {WINDOW}, element_at(q.at, greatest(1, i - {WINDOW})), 0))),
    e -> named_struct('c', e.c, 's', e.s, 'gone', e.gone, 'n', if(e.gone > 0, ascii(substring(e.c, greatest(1, e.gone), 1)) - 48, 1))),
    e -> named_struct(
      'c', if(e.gone > 0, overlay(e.c placing chr(e.n + 47) from greatest(1, e.gone) for 1), e.c),
      's', if(e.gone > 0, e.s + element_at(q.f, e.n) - element_at(q.f, e.n + 1), e.s),
      'least', if(i >= {WINDOW}, least(a.least, if(e.gone > 0, e.s + element_at(q.f, e.n) - element_at(q.f, e.n + 1), e.s)), a.least))), 1)).least), 1)
"""


def _most_sum(kind: str) -> int:
    """The largest sum at which a window still has the class's entropy: entropy = log2(WINDOW) - sum / WINDOW."""
    return math.floor(WINDOW * (math.log2(WINDOW) - THRESHOLD[kind]) * UNIT)


def _reaches(candidate: str, kind: str) -> str:
    """SQL predicate: a window reaches the class's entropy; the windows of one slice after the other, up to the first that does."""
    slice_ = f"cast(substring(cast({candidate} as binary), at * {SLICE} + 1, {SLICE + WINDOW - 1}) as string)"
    within = f"{_least_sum('part')} <= {_most_sum(kind)}L"
    last = f"cast(greatest(0, (length({candidate}) - {WINDOW}) div {SLICE}) as int)"
    return f"exists(sequence(0, {last}), at -> exists(array({slice_}), part -> {within}))"


def suspicious(candidate: str) -> str:
    """SQL predicate: a window of the candidate string reaches its class's entropy, and the allow list doesn't know it."""
    allowed = " or ".join(f"{candidate} rlike r'{p}'" for p in ALLOWED)
    return f"""(
  {candidate} rlike '[0-9]' and {candidate} rlike '[A-Za-z]' and not ({allowed})
  and if({candidate} rlike '^[0-9a-fA-F]+$', {_reaches(f"lower({candidate})", "hex")}, {_reaches(candidate, "base64")}))"""


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running results of an associative ``step`` over an array of longs, in blocks of BLOCK.

    A block's array is at most BLOCK long while it grows, and that of the blocks' results is as long as there are blocks.
    """
    longs = F.array().cast("array<bigint>")

    def grown(items: Column, first: Column) -> Column:
        add = lambda a, x: F.array_append(a, F.when(F.size(a) > 0, step(F.element_at(a, -1), x)).otherwise(F.coalesce(step(first, x), x)))
        return F.aggregate(items, longs, add)

    def blocked(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(BLOCK)).cast("int")
        starts = F.transform(F.sequence(F.lit(1), count), lambda i: (i - 1) * BLOCK + 1)
        none = F.lit(None).cast("bigint")
        parts = F.transform(starts, lambda at: grown(F.slice(v, at, F.lit(BLOCK)), none))
        return let(
            parts,
            lambda p: let(
                grown(F.transform(p, lambda x: F.element_at(x, -1)), none),
                lambda before: F.flatten(F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: step(F.element_at(before, i), y))))),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > BLOCK, blocked(v)).otherwise(grown(v, F.lit(None).cast("bigint"))))


def _found(text: Column, pattern: str, kind: int, maybe: Column, group: int = 0) -> Column:
    """Spans of all matches in order; where ``group`` is given, with that group's text. Empty where ``maybe`` is false.

    The pieces between the matches give their places.
    """

    def spans(t: Column) -> Column:
        matches, pieces = t["matches"], t["pieces"]
        # the last piece follows the last match
        sizes = F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))
        value = lambda m: F.regexp_extract(m, pattern, group) if group else m
        span = lambda m, finish: F.struct((finish - F.length(m)).alias("start"), F.lit(kind).alias("kind"), finish.alias("finish"), value(m).alias("value"))
        return let(running(sizes, lambda a, x: a + x), lambda ends: F.transform(matches, lambda m, i: span(m, F.get(ends, i))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(maybe, let(both, spans)).otherwise(F.array().cast(VALUED))


def _free(base: Column, candidates: Column) -> Column:
    """The candidates, in order, that no base span overlaps: neither one that begins before and ends inside, nor one that begins inside."""

    def free(events: Column) -> Column:
        none = F.lit(-1).cast("bigint")
        is_base = lambda e: e["kind"] < KINDS.index("entropy")
        most = lambda a, x: F.greatest(a, x)
        reach = running(F.transform(events, lambda e: F.when(is_base(e), e["finish"]).otherwise(none)), most)
        far = F.lit(1 << 62)
        following = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(is_base(e), -e["start"]).otherwise(-far))), most))
        clear = lambda e, i, r, f: ~is_base(e) & (F.get(r, i) <= e["start"]) & (-F.get(f, i) >= e["finish"])
        return let(F.struct(reach.alias("reach"), following.alias("following")), lambda t: F.filter(events, lambda e, i: clear(e, i, t["reach"], t["following"])))

    valued = F.transform(base, lambda s: F.struct(s["start"], s["kind"], s["finish"], F.lit("").alias("value")))
    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(let(F.array_sort(F.concat(valued, candidates)), free))


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (start, kind, finish), kind an index of KINDS, by start and then kind."""
    t, cand = fresh(df, "text"), fresh(df, "candidates")
    body = F.col(t)
    low = F.lower(body)
    assign = F.filter(_found(body, ASSIGN, 0, _any(low, ASSIGN_WORDS), 2), lambda s: F.length(s["value"]) >= 6)
    access = F.filter(_found(body, ACCESS, 1, body.contains("AKIA")), lambda s: s["finish"] - s["start"] >= 20)
    # a run of hex digits is a match whole, so the shorter ones need not be found to be dropped
    hexes = _found(body, "[0-9a-f]{24,}", 2, body.rlike("[0-9a-f]{24}"))
    out = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    names = [fresh(df, k) for k in KINDS]
    out = out.withColumns({names[0]: assign, names[1]: access, names[2]: hexes, cand: _found(body, CANDIDATE, 3, body.rlike(CANDIDATE))})
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["finish"]))
    out = out.withColumn("base", F.array_sort(bare(F.concat(*(F.col(n) for n in names[:3])))))
    out = out.withColumn(cand, _free(F.col("base"), F.col(cand)))
    judged = F.expr(f"filter({cand}, s -> {suspicious('s.value')})")
    out = out.withColumn("spans", F.when(F.size(cand) == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", bare(judged)))))
    return out.drop(t, cand, *names)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def joined(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["finish"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The digest of ``find``: counts of the base kinds, a hash of the base spans and all spans as text."""
    found = find(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return found.select(
        "doc_id",
        *(counted(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        counted(F.col("spans"), "entropy").alias("n_entropy"),
    )
