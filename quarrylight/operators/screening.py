"""Predicates that let sources, fetches and questions pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import quantities as Q
from quarrylight.functions import text as X

# Failures that are worth another attempt, besides status 429 and those from 500 on.
RETRYABLE = ("timeout", "ConnectError", "ReadError", "ReadTimeout", "ConnectTimeout", "WriteTimeout", "PoolTimeout", "RemoteProtocolError", "PublicDNSUnavailable", "gaierror")
CAUSAL = r"(?i)\bwhy\b|\bcaus(?:e|al|ation)\b|mechanism|为什么|为何|原因|机制|机理|如何影响"
# Words that say nothing about a question's subject.
QUESTION_STOPWORDS = "the a an and of in for to report research analysis please what how why is are 报告 分析 研究 说明 资料".split()
MIN_CHARS, SHORT_CHARS, SHORT_WORDS, SUBJECT_SENTENCES = 400, 100, 18, 2
# Characters that TeX reads as commands.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def retryable(reason: Column) -> Column:
    """Transport, rate and server failures; null is none."""
    return F.coalesce(reason.isin(*RETRYABLE) | reason.rlike(r"^http_(429|5[0-9]{2})$"), F.lit(False))


def asks_for_cause(question: Column) -> Column:
    return F.coalesce(question.rlike(CAUSAL), F.lit(False))


def same_identity(known: Column, found: Column) -> Column:
    """False only where both identifiers are there and differ."""
    return F.coalesce(known == found, F.lit(True))


def long_enough(text: Column, primary: Column, on_subject: Column, typed: Column) -> Column:
    """Has 400 characters, or is a short primary document on the subject: 100 characters, and 18 words unless its type is known."""
    n = F.length(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return (n >= MIN_CHARS) | ((n >= SHORT_CHARS) & primary & on_subject & (typed | (words >= SHORT_WORDS)))


def _names(text: Column, aliases: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__or__, [F.contains(low, F.lit(a.lower())) for a in aliases])


def on_subject(title: Column, text: Column, aliases: list[str], allow_lead: bool = False) -> Column:
    """An alias in the title, in the first 400 characters where a lead is enough, or in two sentences of the first 20,000; without aliases all pass."""
    if not aliases:
        return F.lit(True)
    hits = F.size(F.filter(X.sentences(F.substring(text, 1, 20_000)), lambda s: _names(s, aliases)))
    lead = _names(F.substring(text, 1, 400), aliases) if allow_lead else F.lit(False)
    return _names(title, aliases) | lead | (hits >= SUBJECT_SENTENCES)


def related(question: str, terms: list[str], text: Column, aliases: list[str] = ()) -> Column:
    """Shares a term with the question (stopwords and numbers aside; ``terms`` are the question's), or names the subject."""
    wanted = [t for t in terms if t not in QUESTION_STOPWORDS and not t.isdigit()]
    shared = F.arrays_overlap(X.content_terms(text), F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(False)
    return shared | _names(text, list(aliases)) if aliases else shared


def first_queries(objective: Column, questions: Column) -> Column:
    """The objective, then the second and third question, without repetition."""
    return F.array_distinct(F.concat(F.array(objective), F.slice(F.coalesce(questions, F.array().cast("array<string>")), 2, 2)))


def numbers_not_in(text: Column, evidence: Column, numbers: Callable[[Column], Column] = Q.signatures) -> Column:
    """Signatures of a text's numbers that its evidence does not have."""
    return F.array_except(numbers(text), numbers(evidence))


def tex_escaped(text: Column) -> Column:
    """Every character that TeX reads as a command replaced once, control characters but line ends by a blank."""
    table = F.create_map(*[F.lit(x) for pair in TEX.items() for x in pair])
    clean = F.regexp_replace(text, r"[\x00-\x09\x0b-\x1f]", " ")
    chars = F.filter(F.split(clean, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.coalesce(F.element_at(table, c), c)), "")
