"""Numbers and quantities in texts, as column expressions.

A text is spelled one way first (full-width characters, raised digits, powers of ten, unit spellings).  One pattern then reads it from left to
right: each hit is a number with what stands at it (currency, sign, unit, an open end), and everything else is decided
on the hits, as arrays.  Nothing leaves generated code but the array functions over the few hits of a text.

* :func:`signatures`: ``currency:number:unit`` of every number; sign, unit and value count, spelling does not.
* :func:`plain_signatures`: the same for prose: currencies and unit words count, scientific units, labels and product counts are text.
* :func:`point_quantities`: exact amounts with a registered unit; ranges, bounds and uncertainties are none.
* :func:`header_quantity`: the amount of a table cell, with its own unit or the one its header names.

Null texts have no numbers.  Numbers keep all their digits; an exponent beyond 100 stays as written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import units as U

WIDE = "".join(chr(0xFF01 + i) for i in range(94))
NARROW = "".join(chr(0x21 + i) for i in range(94))
RAISED = "⁺⁻⁰¹²³⁴⁵⁶⁷⁸⁹"
#: (pattern, replacement), in order; no look-around, so that other pattern engines read them alike.
REWRITES = (
    (rf"([{RAISED}]+)", "^$1"),
    (r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+", " "),
    ("℃", "°C"),
    (r"([A-Za-zΩ])\^\{?([+-]?[0-9])\}?", "$1$2"),
    (r"(^|[^A-Za-z])(m?)[oO]hms?($|[^A-Za-z])", "$1$2Ω$3"),
    (r"([AW]) h($|[^A-Za-z])", "$1h$2"),
    (r"(^|[^A-Za-z])u([SAm])($|[^A-Za-z])", "$1μ$2$3"),
    (r"(S|Wh|Ah|A|g)[ ·](kg|g|L|l|cm|m)-([123])", "$1/$2$3"),
    (r"/(kg|g|L|l|cm|m)1($|[^0-9])", "/$1$2"),
    (r"/l($|[^A-Za-z])", "/L$1"),
    ("Ω·", "Ω "),
    (r"wt ?\.? ?%", "wt%"),
    (r"百分之 ?([+-]?[0-9]+(?:\.[0-9]+)?)", "$1%"),
    (r"([0-9]) ?[×*] ?10 ?\^? ?\{?([+-]?[1-9][0-9]*)\}?", "$1e$2"),
    (r"(^|[^0-9A-Za-z_.])10 ?\^ ?\{?([+-]?[0-9]+)\}?", "$11e$2"),
)
# What a unit word stands for in a signature, and a currency mark.
WORD_UNITS = {
    "percent": "%", "pct": "%", "percentage point": "pp", "percentage points": "pp", "个百分点": "pp", "百分点": "pp",
    "basis point": "bp", "basis points": "bp", "bp": "bp", "bps": "bp", "基点": "bp", "个基点": "bp", "billion": "bn", "trillion": "tn", "million": "mn",
    "usd bn": "usd bn", "usd billion": "usd bn", "usd million": "usd mn", "gigawatt": "gw", "gigawatts": "gw", "megawatt": "mw", "megawatts": "mw",
    "gwh": "gwh", "mwh": "mwh", "kwh": "kwh", "gw": "gw", "mw": "mw", "年": "",
    "亿美元": "亿美元", "万美元": "万美元", "亿元": "亿元", "万元": "万元", "人民币": "人民币", "美元": "美元", "%": "%", "‰": "‰", "亿": "亿", "万": "万", "千": "千", "元": "元",
}
CURRENCIES = {"$": "usd", "us$": "usd", "usd": "usd", "¥": "cny", "￥": "cny", "rmb": "cny", "cny": "cny"}
SCIENTIFIC_DIMENSIONS = (
    "conductivity specific_energy volumetric_energy specific_capacity areal_capacity current_density resistance resistance_area "
    "temperature pressure length volume mass_fraction cycles"
).split()
ADJECTIVES = "新型|全固态|半固态|固态|锂离子|锂金属|动力|储能"
PRODUCTS = "电池|电芯|车型|产品|器件"


def _any(names) -> str:
    return "|".join(_quoted(n) for n in sorted(names, key=lambda n: (-len(n), n)))


def _quoted(name: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in name)


_UNITS = {**{n: u[0] for n, u in U._FOLDED.items()}, **{n: u[0] for n, u in U._EXACT.items()}}
_DIMENSION = {u[0]: u[1] for u in [*U._FOLDED.values(), *U._EXACT.values()]}
_SCIENTIFIC = [n for n, u in {**U._FOLDED, **U._EXACT}.items() if u[1] in SCIENTIFIC_DIMENSIONS]
_END = r"(?![A-Za-z0-9/^·])"
GROUPED = r"[0-9]{1,3}(?: [0-9]{3})+(?![0-9])"
NUMBER = rf"(?:(?:{GROUPED}|[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_CURRENCY = r"US\$|USD ?|CNY ?|RMB ?|[$¥￥]"
WORDED = _any([*WORD_UNITS, "usd  bn"])
#: A number, then its unit, or what follows its digits at once (more digits, or the stroke of a range).
HIT = rf"(?i)({_CURRENCY})?([+-]?{NUMBER})(?: ?((?:{_any(_SCIENTIFIC)}){_END}|{WORDED})|(?:\.?[0-9]+)+[+-]?|[+-])?"
#: The same without scientific units; a number grouped by blanks ends where a word does.
PLAIN_HIT = rf"(?i)({_CURRENCY})?([+-]?{NUMBER.replace('(?![0-9])', '(?![0-9A-Za-z_])')})(?: ?({WORDED})|(?:\.?[0-9]+)+[+-]?|[+-])?"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it stands in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spelled(text: Column) -> Column:
    """One spelling: ASCII digits and signs, one blank between words, raised digits as ``^``, powers as ``e``, units by their symbols."""
    out = F.translate(F.coalesce(text, F.lit("")), WIDE + "−µ⋅", NARROW + "-μ·")
    for k, (pattern, by) in enumerate(REWRITES):
        out = F.regexp_replace(out, pattern, by)
        if not k:
            out = F.translate(out, RAISED, "+-0123456789")
    return F.trim(out)


def groups(hit: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of a hit of ``pattern`` as an array, empty where a group has no part in it; one match instead of ``n``."""
    return F.split(F.regexp_replace(hit, pattern, "\u0001".join(f"${k + 1}" for k in range(n))), "\u0001", -1)


def canonical(number: Column) -> Column:
    """A number without grouping, exponent and zeros that say nothing; as it is where the exponent is beyond 100."""

    def parts(v: Column) -> Column:
        exponent = F.when(v.rlike("[eE]"), F.regexp_extract(v, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int")).otherwise(0)
        return F.struct(F.regexp_extract(v, r"^[+-]?([0-9.]*)", 1).alias("mantissa"), exponent.alias("power"), v.startswith("-").alias("minus"))

    def placed(p: Column) -> Column:
        m = p["mantissa"]
        point = F.when(m.contains("."), F.instr(m, ".") - 1).otherwise(F.length(m)) + p["power"]
        return F.struct(F.replace(m, F.lit(".")).alias("digits"), point.alias("point"), p["power"].alias("power"), p["minus"].alias("minus"))

    def shifted(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= F.length(digits), F.rpad(digits, point, "0"))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
        )
        short = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^0+([0-9])", "$1"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return bound(F.when(F.abs(p["power"]) <= 100, short), lambda n: F.when(p["minus"] & (n != "0"), F.concat(F.lit("-"), n)).otherwise(n))

    made = lambda n: F.coalesce(bound(bound(bound(F.regexp_replace(n, "[ ,]", ""), parts), placed), shifted), n)
    return bound(number, made)


def _map(values: dict[str, str]) -> Column:
    """A constant map, parsed at once (names hold no quotes)."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")")


_SCIENCE_OF = {n: _UNITS[n] for n in _SCIENTIFIC}


def _signed(g: Column, unit: Column) -> Column:
    currency = F.lower(F.trim(g[0]))
    return F.concat(F.coalesce(F.try_element_at(_map(CURRENCIES), currency), currency), F.lit(":"), canonical(g[1]), F.lit(":"), unit)


def _worded(raw: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(WORD_UNITS), F.lower(raw)), F.lower(raw))


def _signature(hit: Column) -> Column:
    def read(g: Column) -> Column:
        raw = g[2]
        science = F.lower(raw).isin([n.lower() for n in _SCIENTIFIC])
        exact = F.coalesce(F.try_element_at(_map(_SCIENCE_OF), raw), F.concat(F.lit("scientific:"), F.replace(raw, F.lit(" "))))
        return _signed(g, F.when(raw == "", "").when(science, exact).otherwise(_worded(raw)))

    return bound(groups(hit, HIT, 3), read)


_DIGITS = "零一二三四五六七八九"


def _counted(count: Column) -> Column:
    """A count of up to 99 in Chinese, or in digits; null for anything else."""
    c = F.translate(count, "两", "二")
    of = lambda x: F.instr(F.lit(_DIGITS), x) - 1
    tens, ones = F.substring_index(c, "十", 1), F.substring_index(c, "十", -1)
    ten = F.when(tens == "", 1).when(F.length(tens) == 1, of(tens))
    one = F.when(ones == "", 0).when(F.length(ones) == 1, of(ones))
    once = F.length(c) - F.length(F.replace(c, F.lit("十"))) == 1
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).when((F.length(c) == 1) & (of(c) >= 0), of(c)).when(once, ten * 10 + one)


def product_counts(text: Column) -> Column:
    """``:n:`` and ``count:n:product`` of Chinese product counts (``两款固态电池``)."""
    pattern = rf"(?<![0-9零一二两三四五六七八九十百千万])([0-9]{{1,6}}|[一二两三四五六七八九十]{{1,3}})\s*款\s*(?:{ADJECTIVES})?({PRODUCTS})"

    def both(hit: Column) -> Column:
        n = _counted(F.regexp_extract(hit, pattern, 1)).cast("string")
        of = F.regexp_extract(hit, pattern, 2)
        return F.array(F.concat(F.lit(":"), n, F.lit(":")), F.concat(F.lit("count:"), n, F.lit(":"), of))

    return F.filter(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), both)), lambda s: s.isNotNull())


def signatures(text: Column) -> Column:
    """Distinct signatures of a text's numbers, sorted; labelled cells (``label (unit): 1.2``) count with the unit of their label."""
    none = F.array().cast("array<string>")
    pair = lambda o: F.concat(F.lit(":"), o["value"], F.lit(":"), o["unit"])

    def read(plain: Column) -> Column:
        found = F.transform(F.regexp_extract_all(plain, F.lit(HIT), F.lit(0)), _signature)
        labels = F.when(plain.contains(":"), F.transform(labelled_quantities(text), pair)).otherwise(none)
        counts = F.when(plain.contains("款"), product_counts(plain)).otherwise(none)
        return F.array_sort(F.array_distinct(F.concat(found, labels, counts)))

    worth = F.coalesce(text, F.lit("")).rlike(r"[0-9０-９]|[一二两三四五六七八九十]\s*款")
    return F.when(worth, bound(spelled(text), read)).otherwise(none)


def plain_signatures(text: Column) -> Column:
    """Distinct signatures of the numbers of prose, sorted: with currencies and unit words.

    What looks like a scientific unit is a word there (``3 M`` at the end of a key, ``12 pa`` in a sentence), and neither
    labelled cells nor product counts are read.
    """
    one = lambda hit: bound(groups(hit, PLAIN_HIT, 3), lambda g: _signed(g, _worded(g[2])))
    read = lambda plain: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(PLAIN_HIT), F.lit(0)), one)))
    return F.when(F.coalesce(text, F.lit("")).rlike("[0-9０-９⁰¹²³⁴⁵⁶⁷⁸⁹]"), bound(spelled(text), read)).otherwise(F.array().cast("array<string>"))


def supported(text: Column, evidence: Column, numbers: Callable[[Column], Column] = signatures) -> Column:
    """Whether all signatures of ``text`` are among those of ``evidence``."""
    return F.size(F.array_except(numbers(text), numbers(evidence))) == 0


# --- point quantities

_NAMES = _any({*_UNITS, *(s for s in _DIMENSION)} - {""})
_OPEN = r"[<>≤≥≈≃~±]|\+/-"
_JOIN = r"[-–—~至到±]|\+/-|to\b"
#: What stands before (a bound, or a character that a number must not follow), the amount, its unit, and a join to the next amount.
_DOLLARS = rf"(?:US\$|\$|USD) ?([+-]?{NUMBER})(?: ?(billion|million|bn|mn)(?![A-Za-z]))?"
POINT = rf"(?i)({_OPEN})? ?([A-Za-z.,^{{])?(?:{_DOLLARS}|([+-]?{NUMBER}) ?({_NAMES})?){_END}(?: ?({_JOIN}))?"
_SIZES = {"billion": " bn", "bn": " bn", "million": " mn", "mn": " mn"}


def symbol_of(name: Column) -> Column:
    """The registered symbol of a unit's name; null for unknown ones and for a symbol in the wrong case."""
    exact = _map({n: s for n, s in _UNITS.items() if n in U._EXACT} | {s: s for s in _DIMENSION if s in U._EXACT})
    wrong = F.lower(name).isin([n.lower() for n in U._EXACT])
    folded = _map({n: u[0] for n, u in U._FOLDED.items()})
    return F.coalesce(F.try_element_at(exact, name), F.when(~wrong, F.try_element_at(folded, F.lower(name))))


def dimension_of(symbol: Column) -> Column:
    return F.try_element_at(_map(_DIMENSION), symbol)


def point_quantities(text: Column) -> Column:
    """Array of (``value``, ``unit``): exact amounts with a registered unit, in order.

    Both ends of a range, bounds, uncertainties and approximations are left out.
    """
    return spelled_points(spelled(text))


def spelled_points(plain: Column) -> Column:
    """:func:`point_quantities` of a text that is spelled already."""

    def read(g: Column) -> Column:
        dollars = F.concat(F.lit("USD"), F.coalesce(F.try_element_at(_map(_SIZES), F.lower(g[3])), F.lit("")))
        unit = F.when(g[2] != "", dollars).when(g[5] != "", symbol_of(g[5]))
        return F.struct(((g[0] == "") & (g[1] == "") & (g[6] == "")).alias("closed"), (g[6] != "").alias("joins"), F.concat(g[2], g[4]).alias("number"), unit.alias("unit"))

    def kept(hits: Column) -> Column:
        joined = lambda i: F.when(i == 0, False).otherwise(F.try_element_at(hits, i)["joins"])
        alone = F.filter(hits, lambda h, i: h["closed"] & h["unit"].isNotNull() & ~joined(i))
        return F.transform(alone, lambda h: F.struct(canonical(h["number"]).alias("value"), h["unit"].alias("unit")))

    hits = F.transform(F.regexp_extract_all(plain, F.lit(POINT), F.lit(0)), lambda h: bound(groups(h, POINT, 7), read))
    return bound(hits, kept)


# --- cells below headers

_CELL = rf"(?i)^([+-]?{NUMBER}) ?({_NAMES})$"
_IN_HEADER = rf"(?i)(?<![A-Za-z])(?:{_NAMES}){_END}"


def header_units(header: Column, dimensions: Column | None = None) -> Column:
    """Distinct units that a header names (null: one in the wrong case), of the ``dimensions`` (an array) where it is not empty."""

    def units(head: Column) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(_IN_HEADER), F.lit(0)), symbol_of))

    def of_dimensions(found: Column) -> Column:
        if dimensions is None:
            return found
        return bound(dimensions, lambda d: F.filter(found, lambda u: u.isNull() | (F.size(d) == 0) | F.array_contains(d, dimension_of(u))))

    return bound(bound(spelled(header), units), of_dimensions)


def spelled_quantity(units: Column, body: Column) -> Column:
    """:func:`header_quantity` of a cell that is spelled already, below a header with these units."""
    own = F.regexp_extract(body, _CELL, 2)
    only = lambda u: F.when(F.size(u) == 1, F.element_at(u, 1))
    below = F.when(body.rlike(rf"^[+-]?{NUMBER}$"), bound(units, only))
    number = F.when(own != "", F.regexp_extract(body, _CELL, 1)).otherwise(body)
    return bound(F.when(own != "", symbol_of(own)).otherwise(below), lambda u: F.when(u.isNotNull(), F.struct(canonical(number).alias("value"), u.alias("unit"))))


def header_quantity(header: Column, cell: Column, dimensions: Column | None = None) -> Column:
    """(``value``, ``unit``) of a cell that is one exact amount, or null.

    The cell's own unit counts; a bare number takes the one unit that the header names, of the ``dimensions`` (an array) where it is not empty.
    """
    return bound(spelled(cell), lambda body: spelled_quantity(header_units(header, dimensions), body))


FIELDS = r"[;；\n]|\s+\|\s+(?=[^|:：]{1,120}[:：])"


def labelled_quantities(text: Column) -> Column:
    """Array of (``value``, ``unit``) of the fields ``label: cell`` of a text whose amount has a scientific unit."""
    field = r"^\s*(.*?)\s*[:=：]\s*(.*?)[\s。.;；]*$"

    def read(part: Column) -> Column:
        return F.when(part.rlike(r"[:=：]"), header_quantity(F.regexp_extract(part, field, 1), F.regexp_extract(part, field, 2)))

    found = F.transform(F.split(text, FIELDS, -1), read)
    return F.filter(found, lambda o: o.isNotNull() & dimension_of(o["unit"]).isin(SCIENTIFIC_DIMENSIONS))
