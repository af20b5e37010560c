"""Text scalars as column expressions: tokens, terms, sentences, passages, stems, relevance.

All functions take and return columns and stay in generated code; the one that
Spark's functions cannot express (full Unicode compatibility folding) is an Arrow
UDF at the end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[a-z][a-z0-9_]*|[0-9]+(?:\.[0-9]+)?"
CJK = r"[\x{3400}-\x{9fff}]+"
#: The same without single letters and characters.
LONG_WORDS = WORDS.replace("*|", "+|")
LONG_CJK = CJK.replace("]+", "]{2,}")

# They decide which words count and must be these.
TOPIC_STOPWORDS = ("the", "a", "an", "of", "and", "or", "in", "on", "for", "to", "with", "vs", "via", "&")
SUFFIXES = (
    "ization isation ational iveness ements ability ingly ement tions ities ional ances ences ments ical "
    "ing ers est ies ied ition ation ness ment ance ence able ible ize ise ous ive er ed ly es s"
).split()
RELATED = {
    "car": ("automobile", "vehicle", "auto"),
    "ev": ("electric", "battery"),
    "ai": ("artificial", "intelligence", "ml", "machine"),
    "cost": ("price", "pricing", "expense"),
    "revenue": ("sales", "turnover", "income"),
    "market": ("industry", "sector"),
    "growth": ("expansion", "increase", "rise"),
    "supply": ("supplier", "sourcing", "procurement"),
    "policy": ("regulation", "regulatory", "legislation", "law"),
    "company": ("firm", "corporation", "business", "enterprise"),
}
ABBREVIATIONS = ("e.g.", "i.e.", "U.S.", "U.K.", "Mr.", "Mrs.", "Dr.", "vs.")
RESEARCH_ANGLES = (
    "{topic}",
    "{topic} industry overview market report",
    "{topic} government policy regulation subsidy tariff",
    "{topic} supply chain upstream midstream downstream suppliers",
    "{topic} market size TAM forecast revenue growth CAGR",
    "{topic} competitive landscape market share leading companies",
    "{topic} research study evidence site:nature.com OR site:science.org OR site:ncbi.nlm.nih.gov",
    "{topic} statistics official data site:.gov OR site:.edu OR site:who.int OR site:un.org",
    "{topic} peer-reviewed analysis findings",
)


def normalized(text: Column) -> Column:
    """Identity key: lower case, dashes unified, white space collapsed."""
    out = F.regexp_replace(F.lower(text), r"[\x{2212}\x{2010}\x{2011}]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "­", ""), r"[\s\x{a0}]+", " "))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """The identity key with full compatibility composition and case folding (ß is ss, full-width is ASCII)."""

    def one(value):
        if value is None:
            return None
        out = unicodedata.normalize("NFKC", value)
        for a, b in (("−", "-"), ("‐", "-"), ("‑", "-"), ("­", "")):
            out = out.replace(a, b)
        return " ".join(out.casefold().split())

    return text.map(one)


def tokens(text: Column, word: str = WORDS, run: str = CJK) -> Column:
    """Words and numbers in order, then overlapping bigrams of CJK runs (a single character stays); repetition is kept."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(word), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(run), F.lit(0))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
            ),
        )
    )
    return F.when(low.rlike(run), F.concat(words, pairs)).otherwise(words)


def content_terms(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Distinct tokens that are no stopwords and longer than one character or a digit."""
    found = F.array_distinct(tokens(text, LONG_WORDS, LONG_CJK))
    stop = list(stopwords)
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def shared_terms(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def sentences(text: Column) -> Column:
    """Sentences; decimals and common abbreviations do not end one, line and page breaks do."""
    whole = out = F.trim(F.coalesce(text, F.lit("")))
    for word in ABBREVIATIONS:
        plain = word.replace(".", r"\.")
        out = F.regexp_replace(out, rf"(?i)\b({plain[:-2]})\.", "$1\u0001") if word.count(".") == 1 else F.regexp_replace(
            out, rf"(?i)\b({word[0]})\.({word[2]})\.", "$1\u0001$2\u0001"
        )
    # One look for all of them, from full stops back: few texts hold any.
    ends = "|".join(w.replace(".", r"\.") for w in ABBREVIATIONS)
    out = F.when(whole.rlike(rf"(?i)\.(?<=[a-z]\.)(?<={ends})"), out).otherwise(whole)
    parts = F.split(out, "(?<=[.。！？!?])(?:(?<!\\.)\\s*|\\s+)|[\\r\\n\\f]+", -1)
    clean = F.transform(parts, lambda p: F.btrim(F.replace(p, F.lit("\u0001"), F.lit(".")), F.lit(" \t\n\x0b\f\r")))
    return F.filter(clean, lambda p: p != "")


def passages(text: Column) -> Column:
    """Blocks between blank lines; a text of one block gives groups of three sentences."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n", -1), F.trim), lambda p: p != "")
    return F.when(F.size(blocks) > 1, blocks).otherwise(_thirds(sentences(text)))


def _thirds(parts: Column) -> Column:
    def grouped(all_parts: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(all_parts), F.lit(1)), F.lit(3))
        return F.filter(F.transform(at, lambda i: F.array_join(F.slice(all_parts, i, 3), " ")), lambda p: p != "")

    return F.flatten(F.transform(F.array(parts), grouped))  # binds the sentences, so they are made once


def stem(word: Column) -> Column:
    """A light stemmer: the first suffix of the list that leaves four characters goes; ``ies`` becomes ``y``."""
    # Where one suffix ends another the list has the longer first, so the shortest stem is the one wanted.
    out = F.regexp_replace(word, rf"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")
    return F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y"))).otherwise(out)


def stem_word(word: str) -> str:
    """:func:`stem` of a literal."""
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)


def topic_stems(topic: str) -> list[str]:
    """Stems of a topic's words and of the related words of any cluster that they touch."""
    import re

    words = [w for w in re.findall(WORDS, topic.lower()) if len(w) >= 2 and w not in TOPIC_STOPWORDS]
    first = {stem_word(w) for w in words}
    out = set(first)
    for key, others in RELATED.items():
        cluster = {stem_word(key), *map(stem_word, others)}
        if first & cluster:
            out |= cluster
    return sorted(out)


def relevance(topic: str, text: Column) -> Column:
    """Struct (density, distinct): share of tokens that match the topic, and how many stems do.

    A stem matches if it is a topic stem, or one is a prefix of the other and the topic stem has four
    characters.  No topic words give (1, 0); no tokens give (0, 0).
    """
    stems = topic_stems(topic)
    if not stems:
        return F.struct(F.lit(1.0).alias("density"), F.lit(0).alias("distinct"))
    long = [s for s in stems if len(s) >= 4]
    near = sorted({*stems, *(s[:k] for s in long for k in range(1, len(s) + 1))})
    starts = f"^(?:{'|'.join(long)})" if long else "$^"
    found = F.transform(tokens(text), stem)
    # The one element of an outer array binds the stems, so they are made once.
    return F.transform(F.array(found), lambda all_stems: _matched(all_stems, near, starts))[0]


def _matched(all_stems: Column, near: list[str], starts: str) -> Column:
    hits = F.filter(all_stems, lambda s: s.isin(near) | s.rlike(starts))
    n = F.size(all_stems)
    return F.struct(
        F.when(n > 0, F.size(hits) / n).otherwise(F.lit(0.0)).alias("density"),
        F.size(F.array_distinct(hits)).alias("distinct"),
    )


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def cleaned(text: Column, most: int = 200_000) -> Column:
    """Line ends unified, control characters dropped, line ends trimmed, runs of blank lines made one, bounded."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0e-\x1f]", "")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return F.substring(F.regexp_replace(out, r"\n{3,}", "\n\n"), 1, most)


def looks_factual(sentence: Column) -> Column:
    """Has a digit or a reporting verb."""
    return sentence.rlike(r"[0-9]") | F.lower(sentence).rlike(r"(?=[iawhr])\b(?:is|are|was|were|has|have|reported|announced|accounts|reached)\b")


def writing_length(text: Column) -> Column:
    """CJK characters and Latin words."""
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) + F.regexp_count(text, F.lit(r"[A-Za-z]+"))


def query_type(query: Column) -> Column:
    """The first rule that fires: official sites, mostly Chinese, structured, academic, deep; else general."""
    low = F.lower(query)
    has = lambda words: F.coalesce(low.rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(False))
    seen = F.length(F.regexp_replace(query, r"\s", ""))
    cjk = F.regexp_count(query, F.lit("[一-鿿]"))
    return (
        F.when(has(("site:.gov", "site:.edu", "site:gov.cn", "site:.mil")), "fact")
        .when((seen > 0) & (cjk > 0.30 * seen), "chinese")
        .when(has(("表格", "营收", "市场规模", "数据表", "table", "revenue", "figures")), "structured")
        .when(has(("paper", "study", "arxiv", "论文")), "academic")
        .when(has(("对比", "深度", "调研", "in-depth", "analysis")), "deep_research")
        .otherwise("general")
    )


def research_queries(topic: Column) -> Column:
    """One search query per research angle, without repetition."""
    return F.array_distinct(F.array(*[F.trim(F.replace(F.lit(a), F.lit("{topic}"), topic)) for a in RESEARCH_ANGLES]))


def main_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags to spaces, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"[ \t\n\r\f]+", " "))


def shingles(words: Column, n: int) -> Column:
    return F.when(
        F.size(words) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))),
    ).otherwise(F.array().cast("array<string>"))


def strip_think(text: Column) -> Column:
    """Model output without its thinking blocks."""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))
