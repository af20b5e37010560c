"""Measurement protocols in the methods of an article, and the table rows whose missing conditions they state.

A protocol is a sentence that says how one kind of conductivity was measured, with the measuring sentences after it.  It is a witness for
a row of the same article only if it is the article's one protocol of that kind and says each condition once; anything less clear (two
protocols, both kinds at once, a range, a part of the samples) is none.  So after one grouping a kind of an article has a protocol or
not, and rows meet it by an equi-join: no two rows and no two spans are ever paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import quantities as Q

from .metrics import experiment_key

KINDS = ("ionic", "electronic")
_KIND = r"(?i)(?<![a-z])(ionic|electronic) conductivit(?:y|ies)(?![a-z])"
_BOTH = r"(?i)(?<![a-z])(?:ionic|electronic) ?(?:and|/|&) ?(?:ionic|electronic) conductivit"
#: A direct statement: scope (all samples of a table), the kind, and what is said after the verb.
_SAID = r"(?i)^(?:for (?:all )?(?:the )?(?:samples|specimens|measurements) (?:listed |reported )?in (table [a-z]?[0-9]+), ?)?(?:the )?(ionic|electronic) conductivit(?:y|ies)(?: of all (?:the )?samples)? (?:was|were) (?:measured|determined)(?![a-z])(.*)$"
_GOES_ON = r"(?i)^(?:the |all )?measurements (?:was|were) (?:performed|conducted|taken|made)(?![a-z])(.*)$"
# Words that tie a statement to a part of the samples, and words that begin a clause about their making.
PARTIAL = r"(?i)(?<![a-z])(?:only|except|subset|selected samples?|respectively|depending on|whereas|alternatively|or)(?![a-z])|(?<![a-z])for (?:the |this |that |other |some |these |each |such )?(?:samples?|specimens?|pellets?|batch|series)(?![a-z])"
MAKING = r"(?i);|(?<![a-z])(?:cold-?)?(?:press(?:ed|ing)|dry(?:ing|ied)|anneal(?:ed|ing)?|sinter(?:ed|ing)?|fabricat(?:ed|ion)|prepar(?:ed|ation)|compact(?:ed|ion))(?![a-z])"
_OPEN = r"[0-9] ?(?:[~±–-]|to ) ?[0-9]+(?:\.[0-9]+)? ?(?:°C|K|[GMk]?Pa)(?![A-Za-z])"
_AT = rf"(?i)(?<![a-z])(?:at|under|and) (?:an? )?(?:(?:pressure|temperature) of )?({Q.NUMBER}) ?(°C|K|GPa|MPa|kPa|Pa)(?![A-Za-z0-9])"
_BY = r"(?i)(?<![a-z])(?:using|by) (?:an? )?(electrochemical impedance spectroscopy|eis|direct[- ]current polarization|dc polarization)(?![a-z])"
MADE_HERE = r"(?i)(?<![a-z])(?:synthesi[sz]ed|prepared|measured)(?![a-z])"
ELSEWHERE = r"(?i)(?<![a-z])literature(?![a-z])|(?<![a-z])(?:previously|elsewhere) (?:published|reported)(?![a-z])|文献"


def _sentences(text: Column) -> Column:
    """Array of (``text``, ``start``) of the sentences of a paragraph, offsets in characters."""

    def placed(parts: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p))
        return F.transform(parts, lambda p, i: F.struct(F.ltrim(p).alias("text"), (before(i) + F.length(p) - F.length(F.ltrim(p))).alias("start")))

    return Q.bound(F.split(text, r"(?<=[.!?])(?=\s)", -1), placed)


def _conditions(tail: Column) -> Column:
    """Array of (``name``, ``value``) that a statement gives directly: at or under an amount, by a method."""
    plain = Q.spelled(tail)
    amounts = F.transform(F.regexp_extract_all(plain, F.lit(_AT), F.lit(0)), lambda h: F.concat(Q.canonical(F.regexp_extract(h, _AT, 1)), F.lit(" "), F.regexp_extract(h, _AT, 2)))
    named = F.transform(amounts, lambda a: F.struct(F.when(a.rlike("(°C|K)$"), "temperature").otherwise("pressure").alias("name"), a.alias("value")))
    method = F.transform(F.regexp_extract_all(plain, F.lit(_BY), F.lit(1)), lambda m: F.struct(F.lit("test_method").alias("name"), m.alias("value")))
    return F.concat(named, method)


def protocols(spans: DataFrame, article: str = "article") -> DataFrame:
    """The one clear protocol of a kind in an article: the article, ``kind``, ``conditions`` (map), ``start``, ``stop``, ``quote``, ``table_label``.

    ``spans``: the article, ``span_no``, ``start`` (of the paragraph in the article's text) and ``text``.  Kinds without a protocol, with several, or with a
    doubtful one (two values of a condition, a range, a part of the samples, both kinds in a sentence) have no row.
    """
    s = spans.select(article, "span_no", F.col("start").alias("_from"), F.posexplode(_sentences(F.coalesce("text", F.lit("")))).alias("no", "s"))
    s = s.select(article, "span_no", "_from", "no", F.col("s.text").alias("said"), F.col("s.start").alias("_at")).where("said <> ''")
    kinds = F.array_distinct(F.transform(F.regexp_extract_all(F.col("said"), F.lit(_KIND), F.lit(1)), F.lower))
    s = s.withColumn("kinds", F.when(F.col("said").rlike(_BOTH), F.array(*map(F.lit, KINDS))).otherwise(kinds))
    s = s.withColumn("tail", F.coalesce(F.nullif(F.regexp_extract("said", _SAID, 3), F.lit("")), F.nullif(F.regexp_extract("said", _GOES_ON, 1), F.lit(""))))
    # A measuring sentence goes with the last one that names a kind; the paragraph is the window, so it is bounded.
    inside = Window.partitionBy(article, "span_no").orderBy("no")
    s = s.withColumn("of", F.last(F.when(F.size("kinds") > 0, F.col("no")), ignorenulls=True).over(inside)).where("of is not null and (size(kinds) > 0 or tail is not null)")
    clause = F.split(F.coalesce("tail", F.lit("")), MAKING, 2)[0]
    clear = (F.size("kinds") == 0) | ((F.size("kinds") == 1) & F.col("tail").isNotNull() & ~F.col("said").rlike(_BOTH))
    clear = clear & ~F.coalesce("tail", F.lit("")).rlike(PARTIAL) & ~Q.spelled(clause).rlike(_OPEN)
    s = s.withColumn("found", _conditions(clause)).withColumn("clear", clear)
    per = s.groupBy(article, "span_no", "of").agg(
        F.bool_and("clear").alias("clear"),
        F.flatten(F.collect_list("kinds")).alias("kinds"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "found"))), lambda x: x["found"]))).alias("found"),
        F.min(F.col("_from") + F.col("_at")).alias("start"),
        F.max(F.col("_from") + F.col("_at") + F.length("said")).alias("stop"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "said"))), lambda x: x["said"]), " ").alias("quote"),
        F.lower(F.max(F.regexp_extract("said", _SAID, 1))).alias("table_label"),
    )
    keyed = F.transform("found", lambda c: F.struct(c["name"].alias("name"), experiment_key(c["name"], c["value"]).alias("key")))
    names = F.array_distinct(F.transform("found", lambda c: c["name"]))
    per = per.withColumn("clear", F.col("clear") & (F.size("found") > 0) & (F.size(F.array_distinct(keyed)) == F.size(names)))
    each = per.withColumn("kind", F.explode("kinds"))
    one = each.groupBy(article, "kind").agg(F.count(F.lit(1)).alias("n"), F.bool_and("clear").alias("clear"), F.first(F.struct("found", "start", "stop", "quote", "table_label")).alias("p"))
    firsts = F.filter("p.found", lambda c, i: ~F.exists(F.slice("p.found", F.lit(1), i), lambda o: o["name"] == c["name"]))
    return one.where("n = 1 and clear").select(article, "kind", F.map_from_entries(firsts).alias("conditions"), "p.start", "p.stop", "p.quote", "p.table_label")


def linked(rows: DataFrame, spans: DataFrame, article: str = "article") -> DataFrame:
    """(``row_id``, ``condition``, ``value``, ``start``, ``stop``, ``basis``): conditions of table rows that their article's methods state.

    ``rows``: the article, ``row_id``, ``name`` (metric), ``conditions`` (map), ``start`` and ``stop`` of the row in the article's text, ``caption``.
    The protocol must lie outside the row's own text and agree with every condition that the row has.  It applies where it names the row's
    table, or, without naming one, where the table's samples were made or measured here and the temperatures are stated on both sides and agree.
    """
    kind = F.regexp_extract("name", "^(ionic|electronic)_conductivity$", 1)
    caption = F.lower(F.trim(F.regexp_replace(F.coalesce("caption", F.lit("")), r"\s+", " ")))
    mine = rows.select(article, "row_id", F.coalesce("conditions", F.create_map().cast("map<string,string>")).alias("has"), F.col("start").alias("_a"), F.col("stop").alias("_b"), caption.alias("caption"), kind.alias("kind")).where("kind <> ''")
    mine = mine.where(~F.col("caption").rlike(ELSEWHERE))
    both = mine.join(protocols(spans, article), [article, "kind"])
    outside = (F.col("stop") <= F.col("_a")) | (F.col("start") >= F.col("_b"))
    label = F.regexp_extract("caption", r"^(table [a-z]?[0-9]+)(?![a-z0-9])", 1)
    shared = F.filter(F.map_keys("conditions"), lambda k: F.array_contains(F.map_keys("has"), k))
    agree = F.forall(shared, lambda k: experiment_key(k, F.try_element_at("has", k)).eqNullSafe(experiment_key(k, F.try_element_at("conditions", k))))
    basis = F.when(F.col("table_label") != "", F.when(F.col("table_label") == label, "table")).when(F.array_contains(shared, "temperature") & F.col("caption").rlike(MADE_HERE), "article")
    good = both.withColumn("basis", basis).where(outside & agree & F.col("basis").isNotNull())
    given = F.filter(F.map_entries("conditions"), lambda e: ~F.array_contains(F.map_keys("has"), e["key"]))
    return good.select("row_id", F.explode(given).alias("e"), "start", "stop", "basis").select("row_id", F.col("e.key").alias("condition"), F.col("e.value").alias("value"), "start", "stop", "basis")
