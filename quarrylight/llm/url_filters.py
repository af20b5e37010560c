"""URL filters by a path-template tree.

Urls become (host, path segments).  Per host the paths form a tree, built level by
level over the distinct shapes:

* a segment that is variable by its form (numbers, hexadecimal ids, dates, long
  mixed slugs) becomes a wildcard at once, keeping a file extension;
* below one parent, children that are many and each rare become one wildcard;
* labelled branches of one parent whose rates do not differ significantly from
  the parent's (a two-sided normal test) are merged into its wildcard.

Labels come from the rules: a page that a rule fits is labelled by its verdict.
A template is rejected if its share of blocked pages, smoothed by the share of
the same template over all hosts and that again by the share over all pages, is
at least ``purity``.  A page that no rule fits takes its template's verdict.

The tree is built from counts of distinct shapes (aggregated before any shuffle),
never from the pages themselves; pages meet the result in one equi-join by (host,
shape) that the engine may split where a host is hot.  Levels follow until
no path has segments left; stretches without a branch are taken in one step.

Defined results: a null url or one without ``://`` has an empty host and path, and
its template is the empty one; equal urls get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.session import durable

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY = "*"
#: Levels of the tree in one plan.
ROUNDS = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's; null without one."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _form(segment: Column) -> Column:
    """A segment, or the wildcard of its form with the file extension."""
    ext = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = segment.substr(F.lit(1), F.length(segment) - F.length(ext))
    return (
        F.when(stem.rlike(r"^[0-9]+([-_.][0-9]+)*$"), F.concat(F.lit("{n}"), ext))
        .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.concat(F.lit("{h}"), ext))
        .when((F.length(stem) >= 24) | stem.rlike(r"^(?=.*[0-9]).{16,}$"), F.concat(F.lit("{s}"), ext))
        .otherwise(segment)
    )


def shape_of(path: Column) -> Column:
    """The path with segments that are variable by their form as wildcards."""
    return F.array_join(F.transform(F.split(path, "/", -1), _form), "/")


def _level(tree: DataFrame, many: int, rare: float, z: float) -> DataFrame:
    """One more segment of each template."""
    tree = tree.withColumn("child", F.get("rest", F.lit(0)))
    nodes = tree.where(F.col("child").isNotNull()).groupBy("host", "template", "child").agg(
        F.sum("n").alias("c_n"), F.sum("labelled").alias("c_l"), F.sum("blocked").alias("c_b")
    )
    parents = nodes.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("children"), F.count(F.when(F.col("c_l") > 0, 1)).alias("known"), F.sum("c_n").alias("p_n"), F.sum("c_l").alias("p_l"), F.sum("c_b").alias("p_b")
    )
    rate = F.try_divide("p_b", "p_l")
    spread = F.sqrt(F.try_divide(rate * (1 - rate), F.col("c_l")))
    variable = (F.col("children") > many) & (F.col("c_n") < rare * F.col("p_n"))
    alike = (F.col("known") > 1) & (F.col("c_l") > 0) & (F.abs(F.try_divide("c_b", "c_l") - rate) <= z * spread)
    named = nodes.join(parents, ["host", "template"]).select(
        "host", "template", "child", F.when(variable | F.coalesce(alike, F.lit(False)), F.lit(ANY)).otherwise(F.col("child")).alias("name")
    )
    return (
        tree.join(named, ["host", "template", "child"], "left")
        .withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "name")))
        .withColumn("rest", F.expr("slice(rest, 2, 1000000)"))
        .select("host", "shape", "n", "labelled", "blocked", "template", "rest")
    )


def _unbranched(tree: DataFrame) -> DataFrame:
    """The segments that all paths below a template share: an only child keeps its name, so no round is needed for them."""
    ends = tree.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    differs = F.filter(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda i: F.element_at("lo", i) != F.element_at("hi", i))
    shared = ends.select("host", "template", F.coalesce(F.get(differs, F.lit(0)) - 1, F.least(F.size("lo"), F.size("hi"))).alias("shared"))
    return tree.join(shared, ["host", "template"]).select(
        "host", "shape", "n", "labelled", "blocked",
        F.when(F.col("shared") > 0, F.concat_ws("/", "template", F.slice("rest", F.lit(1), F.col("shared")))).otherwise(F.col("template")).alias("template"),
        F.slice("rest", F.col("shared") + 1, F.lit(1_000_000)).alias("rest"),
    )


def templates(shapes: DataFrame, many: int = 20, rare: float = 0.05, z: float = 1.96) -> DataFrame:
    """(host, shape, n, labelled, blocked) to (host, shape, template)."""
    tree = (
        shapes.withColumn("segments", F.split("shape", "/", -1))
        .withColumn("template", F.get("segments", F.lit(0)))
        .withColumn("rest", F.slice("segments", 2, 1_000_000))
        .drop("segments")
    )
    longest = shapes.agg(F.coalesce(F.max(F.size(F.split("shape", "/", -1))), F.lit(1))).first()[0]
    for _ in range(min(ROUNDS, longest - 1)):
        tree = _level(tree, many, rare, z)
    ended, left = [], longest - 1 > ROUNDS
    while left:
        # Written, as the plan refers to the tree three times a level; shapes whose path has ended are set aside.
        tree = durable(tree, "url-tree")
        ended.append(tree.where(F.size("rest") == 0))
        tree = durable(_unbranched(tree.where(F.size("rest") > 0)), "url-tree")
        left = not tree.where(F.size("rest") > 0).isEmpty()
        for _ in range(ROUNDS * left):
            tree = _level(tree, many, rare, z)
    for part in ended:
        tree = tree.unionByName(part)
    return tree.drop("rest")


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", weight: float = 4.0, purity: float = 0.5, **tree) -> DataFrame:
    """Columns ``id``, ``host``, ``path``, ``rule``, ``template``, ``score``, ``verdict``."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    blocks = [rule for rule, verdict in rules if verdict == "block"]
    is_block = F.col("rule").isin(blocks)
    shapes = urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("rule").alias("labelled"), F.count(F.when(is_block, 1)).alias("blocked")
    )
    shapes = durable(shapes, "url-shapes")
    placed = durable(templates(shapes, **tree), "url-templates")
    total = shapes.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    prior = (total["b"] + 1) / (total["l"] + 2)
    smooth = lambda b, n, p: (F.col(b) + weight * p) / (F.col(n) + weight)
    sums = [F.sum("labelled").alias("l"), F.sum("blocked").alias("b")]
    own = placed.groupBy("host", "template").agg(*sums)
    common = own.groupBy("template").agg(F.sum("l").alias("t_l"), F.sum("b").alias("t_b"))
    scored = own.join(common, "template").select(
        "host", "template", smooth("b", "l", smooth("t_b", "t_l", F.lit(prior))).alias("score")
    )
    verdicts = placed.select("host", "shape", "template").join(scored, ["host", "template"])
    by_rule = F.when(F.col("rule").isNotNull(), F.when(is_block, "block").otherwise("allow"))
    by_tree = F.when(F.col("score") >= purity, "block").otherwise("allow")
    return urls.join(verdicts, ["host", "shape"], "left").select(
        "id", "host", "path", "rule", "template", "score", F.coalesce(by_rule, by_tree).alias("verdict")
    )
