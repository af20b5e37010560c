"""Secret scans with built-in functions only.

Two kinds of findings:

* fixed patterns: assignments of credentials, access key ids and long
  lower-case hexadecimal runs;
* the entropy scan: over each candidate string a window of fixed width slides
  one character at a time.  A count per character is kept, five bits each in some
  machine words, and two counts change at a step, which changes the sum of ``c * log2(c)`` by two terms; the window's
  Shannon entropy is ``log2(w) - sum / w``.  Each character class (hexadecimal,
  base-64 like) has its own window width and threshold.  An allow-list drops
  candidates that are well-known forms of harmless strings, and findings that
  fixed patterns cover from end to end are not reported twice.

Positions come without a UDF: splitting a text at the matches of a pattern gives
the pieces between them, so the running length of pieces and matches is the
place of each match, in code points.  Rows in which a pattern does not occur
skip that work.

Defined results: a null text is empty, and an empty text has no spans; equal
rows get equal results; texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ of 18 characters or more: a run that is too short has no longer tail
HEX = r"[0-9a-f]{16,}"  # as the maximal runs of 16 characters or more
MIN_VALUE = 12

#: A candidate is a whole run of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: name, form of the class, window width, least entropy in bits.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 20, 2.75),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 20, 3.6),
)
#: Harmless strings: numbers, UUIDs, dotted or dashed words, placeholders, paths of words.
ALLOW = (
    r"^[0-9_-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+([_/=+-]+[A-Za-z]+)*$",
    r"(?i)example|placeholder|changeme|dummy|xxxx|0000000",
    r"^(/[a-z]+)+/?$",
)
#: Elements of a block of running sums.
BLOCK = 64
#: A window's counts are packed in 64-bit words, five bits for each symbol from "+" to "z"; a window has 31 characters at most.
FIRST_SYMBOL, PACKED, WORDS = ord("+"), 12, 7
KINDS = ("assign", "access", "hex", "entropy")


def _running(steps: Column) -> Column:
    """Sums of an array of lengths before each of its elements: inside blocks, and before each block.

    An array grows by being copied, so blocks keep the work near the number of elements.
    """
    before = lambda x, of: F.aggregate(
        x,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, v: F.struct((acc["at"] + of(v)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
    starts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda k: F.slice(steps, k, BLOCK))
    inner = F.zip_with(blocks, before(blocks, total), lambda x, at: F.transform(before(x, lambda v: v), lambda v: v + at))
    return F.flatten(inner)


def _places(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, value) for all matches, in code points; empty without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(g) + F.length(m))
    spans = F.zip_with(
        F.zip_with(_running(steps), F.slice(gaps, 1, F.size(found)), lambda at, g: at + F.length(g)),
        found,
        lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("end"), m.alias("value")),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _log_term(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _count(words: Column, symbol: Column) -> Column:
    """How often a symbol is in the window: its five bits of the packed counts."""
    word = words[f"w{WORDS - 1}"]
    for k in range(WORDS - 2, -1, -1):
        word = F.when(symbol < (k + 1) * PACKED, words[f"w{k}"]).otherwise(word)
    return F.call_function("shiftright", word, (symbol % PACKED * 5).cast("int")).bitwiseAND(F.lit(31).cast("long")).cast("int")


def _moved(words: Column, into: Column, out_of: Column) -> Column:
    """The packed counts with one more of ``into`` and one less of ``out_of`` (under 0: none)."""
    one = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (F.greatest(s, F.lit(0)) % PACKED * 5).cast("int"))
    here = lambda s, k: (s >= k * PACKED) & (s < (k + 1) * PACKED)
    nothing = F.lit(0).cast("long")
    return F.struct(
        *[(words[f"w{k}"] + F.when(here(into, k), one(into)).otherwise(nothing) - F.when(here(out_of, k), one(out_of)).otherwise(nothing)).alias(f"w{k}") for k in range(WORDS)]
    )


def _windows(value: Column, width: int, least: float) -> Column:
    """Struct (first, last): the windows over ``value`` whose entropy reaches ``least`` begin and end there."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - FIRST_SYMBOL)
    steps = F.arrays_zip(
        codes.alias("into"), F.concat(F.array_repeat(F.lit(-1), width), codes).alias("out_of"), F.sequence(F.lit(0), F.length(value) + width - 1).alias("at")
    )
    steps = F.slice(steps, 1, F.length(value))
    empty = F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in range(WORDS)])
    start = F.struct(empty.alias("n"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        gain, loss = x["into"], x["out_of"]
        a, b = _count(acc["n"], gain), _count(acc["n"], F.greatest(loss, F.lit(0)))
        total = (
            F.when(gain == loss, acc["s"])
            .when(loss < 0, acc["s"] - _log_term(a) + _log_term(a + 1))
            .otherwise(acc["s"] - _log_term(a) + _log_term(a + 1) - _log_term(b) + _log_term(b - 1))
        )
        full = x["at"] >= width - 1
        high = full & (F.lit(math.log2(width)) - total / width >= least)
        return F.struct(
            _moved(acc["n"], gain, loss).alias("n"),
            total.alias("s"),
            F.when((acc["first"] < 0) & high, x["at"] - (width - 1)).otherwise(acc["first"]).alias("first"),
            F.when(high, x["at"] + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(text: Column) -> Column:
    kind = KINDS.index("entropy")
    found = _places(text, CANDIDATE, kind)
    allowed = "|".join(f"(?:{form})" for form in ALLOW)
    found = F.filter(found, lambda x: ~x["value"].rlike(allowed))

    def judged(x: Column) -> Column:
        hit = F.lit(None).cast("struct<first:int,last:int>")
        for _, form, width, least in reversed(CLASSES):
            hit = F.when(x["value"].rlike(form) & (F.length(x["value"]) >= width), _windows(x["value"], width, least)).otherwise(hit)
        return F.struct(x["start"].alias("start"), hit.alias("hit"))

    high = F.filter(F.transform(found, judged), lambda x: x["hit"]["last"] > 0)
    return F.transform(
        high,
        lambda x: F.struct(
            (x["start"] + x["hit"]["first"]).alias("start"), F.lit(kind).alias("kind"), (x["start"] + x["hit"]["last"]).alias("end")
        ),
    )


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def secret_spans(docs: DataFrame, text_col: str = "text", base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """``docs`` with two more columns, each an array of structs (start, kind, end) in that order.

    ``base_col`` holds the fixed patterns' findings and ``spans_col`` these and the entropy scan's;
    ``kind`` is the index in :data:`KINDS`.  Both names must be new ones; other columns may have any names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.when(
        text.rlike(ASSIGN),
        F.transform(
            F.filter(
                F.zip_with(
                    _places(text, ASSIGN, 0),
                    F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
                    lambda p, v: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"), F.length(v).alias("n")),
                ),
                lambda x: x["n"] >= MIN_VALUE,
            ),
            lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
        ),
    ).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    base = F.array_sort(F.concat(assign, _bare(_places(text, ACCESS, 1)), _bare(_places(text, HEX, 2))))
    high_col = fresh("high_spans", [*docs.columns, base_col, spans_col])
    out = docs.withColumn(base_col, base).withColumn(high_col, _entropy_spans(text))
    covered = lambda x: F.aggregate(  # how far base spans, by their starts, cover x without a gap
        F.col(base_col), x["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)
    )
    new = F.filter(F.col(high_col), lambda x: covered(x) < x["end"])
    return out.withColumn(spans_col, F.array_sort(F.concat(F.col(base_col), new))).drop(high_col)


def described(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans become one."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(
            x["start"] >= acc["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)
