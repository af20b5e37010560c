"""Bibliographic records as JSON to documents and search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import normalize_doi, public_copy, work_id

WORK = (
    "id string, doi string, title string, type string, is_retracted boolean, is_paratext boolean, publication_date string, "
    "locations array<struct<landing_page_url string, pdf_url string, is_oa boolean>>"
)
CROSSREF = (
    "DOI string, title array<string>, type string, abstract string, URL string, issued struct<`date-parts`: array<array<int>>>, "
    "link array<struct<URL string, `content-type`: string>>"
)


def works(rows: DataFrame, json: str) -> DataFrame:
    """Works that are usable: a work id and a title, not retracted, no front matter, no erratum."""
    w = rows.select(F.from_json(json, WORK).alias("w")).select("w.*")
    ok = work_id(F.col("id")).isNotNull() & F.col("title").isNotNull() & ~F.coalesce("is_retracted", F.lit(False)) & ~F.coalesce("is_paratext", F.lit(False))
    return w.where(ok & ~F.coalesce("type", F.lit("")).isin("erratum", "retraction")).select(
        work_id(F.col("id")).alias("work"), normalize_doi(F.col("doi")).alias("doi"), "title", F.when(F.col("type") == "preprint", "preprint").otherwise("published").alias("status"), "publication_date", "locations"
    )


def leads(found: DataFrame, per_work: int = 2) -> DataFrame:
    """Open copies of works, at most ``per_work`` each, PDF first."""
    urls = found.select("work", F.posexplode("locations").alias("at", "l")).where("l.is_oa")
    copy = F.coalesce(public_copy(F.col("l.pdf_url")), public_copy(F.col("l.landing_page_url")))
    rows = urls.select("work", "at", copy.alias("url"), F.col("l.pdf_url").isNotNull().alias("pdf")).where(F.col("url").isNotNull())
    w = Window.partitionBy("work").orderBy(F.desc("pdf"), "at")
    return rows.dropDuplicates(["work", "url"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_work)


def date_of(parts: Column) -> Column:
    """``[year, month, day]``, as far as it goes, to a date text."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.when(p < 10, F.concat(F.lit("0"), p.cast("string"))).otherwise(p.cast("string"))), "-")


def crossref(rows: DataFrame, json: str) -> DataFrame:
    """Records with a DOI and a title that names no retraction."""
    r = rows.select(F.from_json(json, CROSSREF).alias("r")).select("r.*").withColumn("name", F.get("title", F.lit(0)))
    ok = normalize_doi(F.col("DOI")).isNotNull() & F.col("name").isNotNull() & ~F.col("name").rlike(r"(?i)^(retraction|retracted|erratum|corrigendum)\b")
    return r.where(ok).select(
        normalize_doi(F.col("DOI")).alias("doi"), F.col("name").alias("title"), date_of(F.get(F.col("issued.date-parts"), F.lit(0))).alias("published"), F.regexp_replace("abstract", "<[^>]+>", "").alias("abstract"), F.col("URL").alias("url")
    )


def before_cutoff(published: Column, cutoff: str) -> Column:
    """Unknown dates pass; a partial date counts as its first day."""
    full = F.when(F.length(published) == 4, F.concat(published, F.lit("-01-01"))).when(F.length(published) == 7, F.concat(published, F.lit("-01"))).otherwise(published)
    return F.coalesce(F.try_to_date(full, "yyyy-MM-dd") <= F.to_date(F.lit(cutoff)), F.lit(True))
