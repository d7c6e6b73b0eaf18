"""Article state and the reads of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.functions.keys import url_path
from mapwright.functions.vocab import CHALLENGE_MARKERS, NON_ARTICLE_SEGMENTS


def is_article_url(url: Column, segments: tuple[str, ...] = NON_ARTICLE_SEGMENTS) -> Column:
    """Not a bare root, and none of the segments anywhere in the URL."""
    path = url_path(url)
    bad = F.lit(False)
    for s in segments:
        bad = bad | F.contains(url, F.lit(s))
    return ~path.isin("", "/") & ~bad


def is_challenge(html: Column, markers: tuple[str, ...] = CHALLENGE_MARKERS) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(html, F.lit(m))
    return F.coalesce(hit, F.lit(False))


def pending(articles: DataFrame, stage: str, company: str | None = None, limit: int | None = None) -> DataFrame:
    """Articles that a stage has still to handle: ``clean`` or ``extract``; in order of key."""
    if stage == "clean":
        rows = articles.where("raw_html is not null and cleaned_text is null")
    elif stage == "extract":
        rows = articles.where("cleaned_text is not null and extracted_at is null")
    else:
        raise ValueError(f"unknown stage: {stage}")
    rows = rows.where(F.col("company_name") == company) if company is not None else rows
    return rows.orderBy("key").limit(limit) if limit is not None else rows


def for_company(articles: DataFrame, company: str, key: str) -> DataFrame:
    """The article of that key, if it is this company's: no row or one."""
    return articles.where((F.col("key") == key) & (F.col("company_name") == company))


def extracted(articles: DataFrame) -> DataFrame:
    return articles.where("extracted_at is not null").orderBy("extracted_at", "key")


def pending_merge(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles to merge, in order; of each company the first ``limit``."""
    rows = articles.where("extracted_at is not null and graph_merged_at is null")
    if limit is not None:
        order = W.partitionBy("company_name").orderBy("extracted_at", "key")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return rows.orderBy("extracted_at", "key")


def stage() -> Column:
    """How far an article has come."""
    return (
        F.when(F.col("graph_merged_at").isNotNull(), "merged")
        .when(F.col("extracted_at").isNotNull(), "extracted")
        .when(F.col("cleaned_text").isNotNull(), "cleaned")
        .otherwise("scraped")
    )


def summaries(articles: DataFrame) -> DataFrame:
    """Key, title, stage and number of entities (null before extraction), without the large columns."""
    return articles.select("key", "source_url", "title", "company_name", "scraped_at", stage().alias("stage"), F.when(F.col("extracted_graph").isNotNull(), F.coalesce(F.size("extracted_graph.entities"), F.lit(0))).alias("entity_count"))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """A page, newest first; a number out of range means the nearest page there is."""
    total = rows.count()
    last = max(1, -(-total // size))
    return rows.orderBy(F.desc("scraped_at"), "key").offset((min(max(1, number), last) - 1) * size).limit(size)


def pages_of(rows: DataFrame, size: int) -> DataFrame:
    """Rows and pages by company."""
    return rows.groupBy("company_name").agg(F.count("*").alias("total")).withColumn("n_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))


def first_by_key(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(*order))).where("_n = 1").drop("_n")


def new_rows(batch: DataFrame, stored: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows of a batch whose key is not stored, one for each key; the first ``limit`` in the batch's order."""
    rows = first_by_key(batch.join(stored.select("key").distinct(), "key", "left_anti"), order)
    return rows.orderBy(*order).limit(limit) if limit is not None else rows


def mark_cleaned(articles: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Set ``cleaned_text`` of the keys in ``cleaned`` (key, text), and drop their HTML."""
    done = cleaned.select("key", F.col("text").alias("_text"))
    out = articles.join(done, "key", "left")
    has = F.col("_text").isNotNull()
    return out.withColumn("raw_html", F.when(~has, F.col("raw_html"))).withColumn("cleaned_text", F.coalesce("_text", "cleaned_text")).select(articles.columns)


def mark(articles: DataFrame, keys: DataFrame, column: str, run_ts: str) -> DataFrame:
    """Set a time column for the given keys."""
    hit = articles.join(keys.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    return hit.withColumn(column, F.when(F.col("_hit"), F.lit(run_ts)).otherwise(F.col(column))).select(articles.columns)


def reset_graph(articles: DataFrame, company: str) -> DataFrame:
    """Forget that a company's articles were merged."""
    return articles.withColumn("graph_merged_at", F.when(F.col("company_name") != company, F.col("graph_merged_at")))


def companies(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """All company names, in order, without empty ones."""
    return articles.select("company_name").union(entities.select("company_name")).distinct().where("company_name <> ''").orderBy("company_name")
