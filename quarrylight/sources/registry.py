"""Source classification and grading from hosts, with the rules as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lists of hosts that decide a source's kind and grade.
HARD_DENY = (
    "twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com", "linkedin.com", "youtube.com",
    "pinterest.com", "reddit.com", "threads.net", "medium.com", "substack.com", "blogspot.com", "wordpress.com",
    "tumblr.com", "wixsite.com", "weebly.com", "ghost.io", "quora.com", "stackexchange.com", "stackoverflow.com",
    "wikipedia.org", "wikihow.com", "answers.com", "fandom.com", "slideshare.net", "scribd.com", "coursehero.com",
)
STANDARDS = ("iso.org", "ieee.org", "itu.int", "ietf.org", "w3.org", "etsi.org", "ansi.org")
WEAK = ("zhihu.com", "weibo.com", "douban.com", "toutiao.com", "csdn.net", "jianshu.com", "baijiahao.baidu.com", "baike.baidu.com")


@dataclass(frozen=True)
class SourceRules:
    """Hosts by kind; the first kind that fits holds."""

    deny: tuple = HARD_DENY
    tabloid: tuple = ()
    academic: tuple = ("api.crossref.org", "api.openalex.org", "nature.com", "science.org", "ncbi.nlm.nih.gov", "arxiv.org")
    gov_suffixes: tuple = (".gov", ".edu", ".mil", ".gov.cn", ".europa.eu", ".int")
    bank: tuple = ("goldmansachs.com", "morganstanley.com", "jpmorgan.com")
    institution: tuple = (*STANDARDS, "mckinsey.com", "iea.org", "oecd.org", "gartner.com")
    nonprofit: tuple = ("pewresearch.org", "rand.org", "brookings.edu")
    media: tuple = ("reuters.com", "bloomberg.com", "ft.com", "apnews.com")
    general_web: bool = True
    standards: tuple = STANDARDS
    weak: tuple = WEAK
    order: tuple = field(default=("bank", "institution", "nonprofit", "media"))


KIND_NAMES = {"bank": "investment_bank", "institution": "industry_institution", "nonprofit": "nonprofit", "media": "authoritative_media"}
HIGH_TRUST = ("academic", "government", "investment_bank", "industry_institution", "nonprofit", "authoritative_media", "user_provided")
LEVEL_WEIGHTS = {1: 1.0, 2: 0.8, 3: 0.5, 4: 0.2}


def domain(url: Column) -> Column:
    """Lower-case host without ``www.``; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(authority), r"^www\.", "")


def registrable(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def _among(host: Column, names: tuple) -> Column:
    return (host.isin(list(names)) | registrable(host).isin(list(names))) if names else F.lit(False)


def source_kind(url: Column, rules: SourceRules = SourceRules()) -> Column:
    """Denied hosts first, then academic, government by suffix, the lists in order, general web or rejection."""
    host = domain(url)
    gov = F.lit(False)
    for suffix in rules.gov_suffixes:
        gov = gov | F.endswith(F.concat(F.lit("."), host), F.lit(suffix))
    out = (
        F.when((host == "") | _among(host, rules.deny) | _among(host, rules.tabloid), "rejected")
        .when(_among(host, rules.academic), "academic")
        .when(gov, "government")
    )
    for kind in rules.order:
        out = out.when(_among(host, getattr(rules, kind)), KIND_NAMES[kind])
    return out.otherwise("general_web" if rules.general_web else "rejected")


def credibility(url: Column, kind: Column, rules: SourceRules = SourceRules()) -> Column:
    """Level 1 (official, academic, standards) to 4 (unknown host, rejected, weak)."""
    host = domain(url)
    return (
        F.when((host == "") | (kind == "rejected") | _among(host, rules.weak), 4)
        .when(kind.isin("government", "academic"), 1)
        .when((kind == "industry_institution") & _among(host, rules.standards), 1)
        .when(kind.isin("industry_institution", "authoritative_media", "investment_bank", "nonprofit", "user_provided"), 2)
        .otherwise(3)
    )


def level_weight(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for value, weight in LEVEL_WEIGHTS.items():
        out = F.when(level == value, F.lit(weight)).otherwise(out)
    return out


def filter_hits(hits: DataFrame, url: str = "url", ordinal: str = "ordinal", rules: SourceRules = SourceRules()) -> DataFrame:
    """The first hit of each url with its kind and whether it is kept."""
    first = Window.partitionBy(url).orderBy(ordinal)
    once = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("kind", source_kind(F.col(url), rules)).withColumn("kept", F.col("kind") != "rejected")


def freshness(published: Column, now: Column) -> Column:
    """``exp(-age in years)``; an unknown date counts 0.5 and a future one as new."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(published)) / 86400.0 / 365.25)
    return F.when(published.isNull(), F.lit(0.5)).otherwise(F.exp(-age))


def rank_sources(sources: DataFrame, density: str, level: str, fresh: str, ordinal: str, limit: int = 24) -> DataFrame:
    """The ``limit`` best by half density, 35 % grade weight and 15 % freshness; ties by the given order."""
    score = 0.5 * F.col(density) + 0.35 * level_weight(F.col(level)) + 0.15 * F.col(fresh)
    return sources.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), ordinal).limit(limit)


def normalize_doi(value: Column) -> Column:
    """A bare lower-case DOI, or null."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S+$") & (F.length(bare) <= 250), bare)


def work_id(value: Column) -> Column:
    """An OpenAlex-style work id, bare or in a url."""
    found = F.regexp_extract(value, r"(?:^|/)([Ww][0-9]+)$", 1)
    return F.when(found != "", F.upper(found))


def work_identifier(url: Column) -> Column:
    """``doi:``, ``arxiv:`` (without version) or ``openalex:`` identifier of a url, or null."""
    doi = normalize_doi(url)
    arxiv = F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1)
    nature = F.regexp_extract(url, r"nature\.com/articles/(s[0-9a-z-]+)", 1)
    return (
        F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi))
        .when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv))
        .when(nature != "", F.concat(F.lit("doi:10.1038/"), nature))
        .when(work_id(url).isNotNull(), F.concat(F.lit("openalex:"), work_id(url)))
    )


def public_copy(url: Column) -> Column:
    """Https, default port, no credentials, no asset suffix and no token: else null."""
    ok = (
        url.rlike(r"^https://[^/@?#:]+(:443)?(/|$)")
        & ~F.lower(url).rlike(r"\.(css|js|png|jpe?g|gif|svg|ico|zip)($|\?)")
        & ~F.lower(url).rlike(r"[?&](token|signature|sig|expires|key)=")
    )
    return F.when(ok, url)


def rebuild_abstract(entries: DataFrame, key: str, token: str, position: str) -> DataFrame:
    """Text of an inverted index with one row per position; an index with holes, repeats or negative positions gives none."""
    return (
        entries.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.countDistinct(position).alias("_d"),
            F.min(position).alias("_lo"),
            F.max(position).alias("_hi"),
            F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(token).alias("t")))).alias("_all"),
        )
        .select(
            key,
            F.when(
                (F.col("_lo") == 0) & (F.col("_n") == F.col("_d")) & (F.col("_hi") + 1 == F.col("_n")) & (F.col("_n") <= 10_000),
                F.array_join(F.transform("_all", lambda x: x["t"]), " "),
            ).alias("abstract"),
        )
    )


def cache_key(backend: Column, query: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", backend, query), 256), 1, 16)


def cache_hits(cache: DataFrame, now: Column, ttl_seconds: int, stored: str = "stored_at") -> DataFrame:
    """Entries that are still valid, to the microsecond; a negative time to live never ends."""
    if ttl_seconds < 0:
        return cache
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    return cache.where(at(now) - at(F.col(stored)) <= int(ttl_seconds * 1_000_000))


def merge_sources(base: DataFrame, extra: DataFrame, key: str = "url") -> DataFrame:
    """``base`` and what of ``extra`` has other urls."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti"), allowMissingColumns=True)
