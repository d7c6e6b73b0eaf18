"""Command line: the stages of a run over a folder of snapshots."""

from __future__ import annotations

import argparse
import importlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright import config
from mapwright.functions.keys import url_key
from mapwright.operators import articles as art
from mapwright.operators import backfill, chunk, clean, extract, jobs, merge, resolve, views
from mapwright.sources import sitemap
from mapwright.sources.store import MergeInProgress, MergeLock, Snapshots
from mapwright.storage import discard, materialize

GRAPH = "struct<entities:array<struct<name:string,kind:string,domain:string,description:string>>,relationships:array<struct<source:string,target:string,relation:string,relation_phrase:string,as_of:string>>>"
#: What is known of an article, in parts that are only added to: a stage writes what it has found, never the pages again.
PARTS = {
    "articles": "key string, source_url string, title string, raw_html string, scraped_at string, company_name string",
    "texts": "key string, cleaned_text string, company_name string",
    "graphs": f"key string, extracted_graph {GRAPH}, extracted_at string, company_name string",
    "marks": "key string, graph_merged_at string, company_name string",
}
ENTITIES = "company_name string, key string, name string, kind string, domain string, first_seen_article_id string, description string, n_mentions long, aliases array<struct<name:string,method:string>>"
RELATIONSHIPS = "company_name string, key string, source_key string, target_key string, source string, target string, relation string, relation_phrase string, as_of string, source_article_ids array<string>, invalid_at string"
TABLES = {**PARTS, "entities": ENTITIES, "relationships": RELATIONSHIPS}
KEY = ["company_name", "key"]


def _save(store: Snapshots, table: str, rows: DataFrame, company: str | None) -> None:
    """Replace a table, or what one company has in it."""
    if company is None:
        store.write(table, rows)
    else:
        store.replace(table, rows, [company])


def _of(rows: DataFrame, company: str | None) -> DataFrame:
    return rows if company is None else rows.where(F.col("company_name") == company)


def articles(store: Snapshots, company: str | None = None) -> DataFrame:
    """All parts of the articles side by side; the HTML of cleaned ones is hidden. Parts that are not asked for are not read."""
    rows = _of(store.read("articles"), company)
    for part in ("texts", "graphs", "marks"):
        rows = rows.join(_of(store.read(part), company), KEY, "left")
    return rows.withColumn("raw_html", F.when(F.col("cleaned_text").isNull(), F.col("raw_html")))


def scrape(store: Snapshots, pages: DataFrame, company: str, run_ts: str, limit: int | None = None) -> int:
    """Store the pages (url, html) that are new; challenge pages are left out."""
    store.create(TABLES)
    good = pages.where(~art.is_challenge(F.col("html"))).withColumn("key", url_key(F.col("url")))
    new = materialize(art.new_rows(good, store.read("articles"), ["url"], limit), "scrape-new")
    rows = new.select("key", F.col("url").alias("source_url"), F.lit(None).cast("string").alias("title"), F.col("html").alias("raw_html"), F.lit(run_ts).alias("scraped_at"), F.lit(company).alias("company_name"))
    store.append_new("articles", rows, ["key"])
    return new.count()


def clean_stage(store: Snapshots, company: str | None = None, limit: int | None = None) -> None:
    waiting = art.pending(articles(store, company), "clean", None, limit).select(*KEY, "raw_html")
    done = clean.clean(waiting.withColumn("id", F.struct(*KEY)), "id", "raw_html").where("text is not null")
    store.append_new("texts", materialize(done.select("id.*", F.col("text").alias("cleaned_text")), "clean-done"), KEY)


def extract_stage(store: Snapshots, extractors: list, run_ts: str, company: str | None = None, limit: int | None = None, settings: config.Settings | None = None, reviewers: list | None = None, recorded: DataFrame | None = None) -> int:
    """Chunk, ask, check and merge the replies; an article with a chunk that nobody answered stays unprocessed.

    Chunks with a ``recorded`` (text, reply) answer are not asked for.

    Reviewers are asked for the wordings that the vocabulary does not know. Returns how many articles were extracted.
    """
    settings = settings or config.Settings()
    waiting = materialize(art.pending(articles(store, company), "extract", None, limit).select(*KEY, "cleaned_text"), "extract-waiting")
    chunks = chunk.chunk(waiting, "key", "cleaned_text", settings.chunk_size, settings.chunk_overlap)
    asked = materialize(extract.ask(chunks.select("key", "chunk", "text"), extractors, settings.attempts, recorded), "extract-replies")  # nobody is asked twice
    parsed = extract.parse(asked).withColumn("article_id", F.col("key"))
    whole = parsed.groupBy("key").agg(F.min("valid").alias("ok")).where("ok")
    e = merge.merge_chunks_entities(extract.entities_of(parsed, ["article_id", "chunk"]))
    r = merge.merge_chunks_edges(extract.relationships_of(parsed, ["article_id", "chunk"]))
    r = materialize(extract.review(r, reviewers, settings.attempts), "extract-reviewed") if reviewers else r
    order = ("chunk", "item")
    ents = e.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(*order, "name", "kind", "domain", "description"))).alias("e"))
    rels = r.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(*order, "source", "target", "relation", "relation_phrase", "as_of"))).alias("r"))
    graph = F.struct(
        F.coalesce(F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in ("name", "kind", "domain", "description")])), F.array().cast("array<struct<name:string,kind:string,domain:string,description:string>>")).alias("entities"),
        F.coalesce(F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in ("source", "target", "relation", "relation_phrase", "as_of")])), F.array().cast("array<struct<source:string,target:string,relation:string,relation_phrase:string,as_of:string>>")).alias("relationships"),
    )
    done = whole.join(ents, whole.key == ents.article_id, "left").drop("article_id").join(rels, F.col("key") == rels.article_id, "left").select("key", graph.alias("_graph"))
    done = materialize(waiting.select(*KEY).join(done, "key"), "extract-done")
    store.append_new("graphs", done.select(*KEY, F.col("_graph").alias("extracted_graph"), F.lit(run_ts).alias("extracted_at")), KEY)
    discard(waiting)
    return done.count()


def _statements(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and stated edges of articles that name an entity."""
    base = pending.where(F.size("extracted_graph.entities") > 0).select("company_name", F.col("key").alias("article_id"), F.to_timestamp("extracted_at").alias("extracted_at"), "extracted_graph")
    at = ["company_name", "article_id", "extracted_at", "item"]
    m = base.select(*at[:3], F.posexplode("extracted_graph.entities").alias("item", "x")).select(*at, F.col("x.name").alias("raw_name"), "x.kind", "x.domain", "x.description")
    e = base.select(*at[:3], F.posexplode("extracted_graph.relationships").alias("item", "x")).select(*at, "x.*")
    return m, e


def merge_companies(store: Snapshots, companies: list[str], run_ts: str, settings: config.Settings | None = None, resolvers: list | None = None, tokens: dict[str, int] | None = None) -> dict[str, dict[str, int]]:
    """Fold what is pending of these companies into their stored graph, in one job; by company the totals after it.

    With the ``tokens`` of their locks, whoever's lock has expired can commit nothing once a successor has begun.

    Stored entities are known to every article, stored edges keep their windows, so a second run changes nothing. The
    articles are marked last: a run that was cut off is done again.
    """
    settings = settings or config.Settings()
    here = F.col("company_name").isin(companies)
    for table in ("entities", "relationships", "marks") if tokens else ():
        store.fence(table, tokens)
    known = store.read("graphs").where(here).join(store.read("marks").where(here), KEY, "left")
    pending = materialize(art.pending_merge(known, settings.graph_article_limit), "merge-pending")
    stored_e, stored_r = store.read("entities").where(here), store.read("relationships").where(here)
    mentions, edges = _statements(pending)
    named = materialize(resolve.resolve(mentions, settings.fuzzy_threshold, stored_e), "merge-named")
    if resolvers:
        asked = named.where("method is null").select("company_name", "raw_name")
        known = resolve.known_names(mentions).select("company_name", F.col("known_name").alias("name")).union(stored_e.select("company_name", "name"))
        candidates = resolve.candidate_names(asked, known, settings.candidate_names)
        named = materialize(extract.settle(named, candidates, resolvers, settings.attempts), "merge-settled")
    names = named.select("company_name", "article_id", "raw_name", "name").distinct()
    for end in ("source", "target"):
        edges = edges.join(names.withColumnRenamed("raw_name", end), ["company_name", "article_id", end], "left").withColumn(end, F.coalesce("name", end)).drop("name")
    edges = materialize(edges, "merge-edges")
    new = merge.fold_entities(named).join(merge.fold_aliases(named), ["company_name", "key"], "left")
    entities = materialize(merge.merge_entities(stored_e, new), "merge-entities")
    relationships = materialize(merge.merge_relationships(stored_r, merge.fold_edges(edges), edges, run_ts), "merge-relationships")
    store.replace("entities", entities, companies, tokens)
    store.replace("relationships", relationships, companies, tokens)
    store.append_new("marks", pending.select(*KEY, F.lit(run_ts).alias("graph_merged_at")), KEY, tokens)
    counts = {}
    for name, rows in (("articles_merged", pending), ("entities", entities), ("relationships", relationships)):
        for r in rows.groupBy("company_name").count().collect():  # a row for each company merged
            counts.setdefault(r["company_name"], {})[name] = r["count"]
    discard(pending, named, edges, entities, relationships)
    return {c: {n: counts.get(c, {}).get(n, 0) for n in ("articles_merged", "entities", "relationships")} for c in companies}


def merge_stage(store: Snapshots, locks: MergeLock, run_ts: str, company: str, settings: config.Settings | None = None, resolvers: list | None = None) -> dict[str, int]:
    """Merge one company, alone; without an extracted article of it there is an error."""
    if _of(store.read("graphs"), company).isEmpty():
        raise RuntimeError(f"no extracted articles of {company}")
    token = locks.acquire(company)
    if not token:
        raise MergeInProgress(company)
    try:
        return merge_companies(store, [company], run_ts, settings, resolvers, {company: token})[company]
    finally:
        locks.release(company)


def merge_pending(store: Snapshots, locks: MergeLock, run_ts: str, settings: config.Settings | None = None, resolvers: list | None = None) -> dict[str, dict[str, int] | None]:
    """Merge every company with an article to merge, so many in one job; None for those that somebody else is merging."""
    size = (settings or config.Settings()).merge_companies
    waiting = [r["company_name"] for r in store.read("graphs").join(store.read("marks"), KEY, "left_anti").select("company_name").distinct().where("company_name is not null").orderBy("company_name").collect()]
    done: dict[str, dict[str, int]] = {}
    for at in range(0, len(waiting), size):  # locks are held no longer than their part takes
        mine = {c: token for c in waiting[at : at + size] if (token := locks.acquire(c))}
        try:
            done |= merge_companies(store, list(mine), run_ts, settings, resolvers, mine) if mine else {}
        finally:
            for c in mine:
                locks.release(c)
    return {c: done.get(c) for c in waiting}


def reset_graph(store: Snapshots, company: str) -> None:
    """Forget a company's graph, so that the next merge builds it anew: the articles' marks go first, then its
    relationships, then its entities."""
    store.delete_company("marks", company)
    store.delete_company("relationships", company)
    store.delete_company("entities", company)


def canonicalize_stage(store: Snapshots, company: str | None = None) -> DataFrame:
    edges = _of(store.read("relationships"), company)
    counts = materialize(backfill.counters(edges), "canonicalize-counts")
    _save(store, "relationships", backfill.canonicalize(edges), company)
    return counts


def lines(store: Snapshots, company: str) -> DataFrame:
    here = F.col("company_name") == company
    return views.listing(store.read("entities").where(here), store.read("relationships").where(here)).orderBy("part", F.collate("line", "UNICODE"), "line")


class Job:
    """A run's row in the table of jobs: a row is added for each state, the last one counts."""

    SCHEMA = "job_id string, command string, company_name string, status string, created_at string, error string"

    def __init__(self, store: Snapshots, command: str, company: str | None) -> None:
        self.store, self.command, self.company, self.id = store, command, company, uuid.uuid4().hex

    def say(self, status: str, error: str | None = None) -> None:
        now = datetime.now(timezone.utc).isoformat()
        row = self.store.spark.createDataFrame([(self.id, self.command, self.company, status, now, error)], self.SCHEMA)
        while not self.store.append("jobs", row, self.store._last("jobs")):
            pass

    def __enter__(self) -> Job:
        self.store.create({"jobs": self.SCHEMA})
        self.say("pending")
        return self

    def __exit__(self, kind, error, trace) -> None:  # noqa: ANN001
        self.say("error" if kind else "done", f"{kind.__name__}: {error}"[:1000] if kind else None)


def jobs_of(store: Snapshots) -> DataFrame:
    """Every job in its last state."""
    store.create({"jobs": Job.SCHEMA})
    return jobs.latest(store.read("jobs"))


def maintain(store: Snapshots, settings: config.Settings, interrupted: bool = False, age_s: float = 7 * 86400.0) -> dict[str, tuple[bool, int]]:
    """Keep the newest jobs only, join small folders, delete what no version has named for so long; by table what was done.

    ``interrupted``: jobs that have not ended are taken for dead, as after a restart.
    """
    kept = jobs_of(store)
    kept = materialize(jobs.retain(jobs.recover(kept) if interrupted else kept, settings.jobs_kept), "jobs-kept")
    store.write("jobs", kept)
    return {t: (store.compact(t), store.vacuum(t, age_s)) for t in [*TABLES, "jobs"]}


def models_of(name: str | None, settings: config.Settings, prompts: str | None = None) -> extract.Models:
    """What ``module:factory`` gives for (settings, prompts); the variant of the settings must be one of the prompts'."""
    templates = config.Prompts(prompts) if prompts else None
    if templates:
        templates.checked(settings.prompt_variant)
    if not name:
        return extract.Models()
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)(settings, templates)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mapwright", description=__doc__)
    parser.add_argument("--store", required=True)
    parser.add_argument("--settings", help="YAML file")
    parser.add_argument("--secrets", help="folder with a file for each secret")
    parser.add_argument("--models", help="module:factory of extractors, reviewers and resolvers, called with settings and prompts")
    parser.add_argument("--prompts", help="folder of prompt templates")
    parser.add_argument("--run-ts", default=datetime.now(timezone.utc).isoformat(timespec="seconds"))
    sub = parser.add_subparsers(dest="command", required=True)
    add = sub.add_parser("scrape")
    add.add_argument("--pages", required=True, help="Parquet with url and html")
    add.add_argument("--company", required=True)
    add.add_argument("--sitemap", help="address of a sitemap or a page: only pages that it lists are stored")
    add.add_argument("--limit", type=int)
    for name in ("clean", "extract", "run-all"):
        part = sub.add_parser(name)
        part.add_argument("--company")
        part.add_argument("--limit", type=int)
        if name != "clean":
            part.add_argument("--gazetteer", help="JSON file: kind by name")
            part.add_argument("--replies", help="Parquet with text and reply")
    sub.add_parser("merge-graph").add_argument("--company", required=True)
    sub.add_parser("merge-graph-pending")
    sub.add_parser("maintain", help="trim jobs, join small folders, delete those that no version has named for a week").add_argument("--interrupted", action="store_true", help="jobs that have not ended are dead")
    sub.add_parser("jobs").add_argument("--limit", type=int, default=20)
    sub.add_parser("canonicalize-relations").add_argument("--company")
    for name in ("graph", "reset-graph"):
        sub.add_parser(name).add_argument("--company", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("mapwright").getOrCreate()
    store, settings = Snapshots(spark, args.store), config.load(env_file=".env", yaml_file=args.settings, secrets=args.secrets)
    locks = MergeLock(args.store.rstrip("/") + "/locks", settings.lock_ttl_s, spark=spark)
    store.create(TABLES)
    company = getattr(args, "company", None)
    if args.command == "graph":
        for row in lines(store, company).toLocalIterator():
            print(row["line"])
    elif args.command == "jobs":
        for r in jobs.recent(jobs_of(store), args.limit).collect():
            print(r["created_at"], r["command"], r["company_name"] or "-", r["status"], r["error"] or "")
    elif args.command == "maintain":
        for table, (joined, gone) in maintain(store, settings, args.interrupted).items():
            print(table, "compacted" if joined else "as it was", gone, "folders deleted")
    elif args.command == "reset-graph":
        reset_graph(store, company)
    elif args.command == "canonicalize-relations":
        canonicalize_stage(store, company).show(truncate=False)
    else:
        models = models_of(args.models, settings, args.prompts)
        with Job(store, args.command, company) as job:
            _run(job, args, store, locks, settings, models)


def _run(job: Job, args: argparse.Namespace, store: Snapshots, locks: MergeLock, settings: config.Settings, models: extract.Models) -> None:
    spark, company = store.spark, getattr(args, "company", None)
    if args.command == "scrape":
        job.say("scraping")
        pages = spark.read.parquet(args.pages)
        if args.sitemap:
            pages = pages.join(sitemap.listed(spark, args.sitemap), "url", "left_semi")
        print(scrape(store, pages, company, args.run_ts, args.limit))
    if args.command in ("clean", "run-all"):
        job.say("cleaning")
        clean_stage(store, company, args.limit)
    if args.command in ("extract", "run-all"):
        job.say("extracting")
        extractors = [*models.extractors, *([gazetteer(spark, args.gazetteer)] if args.gazetteer else [])]
        if not extractors and not args.replies:
            raise SystemExit("name models, a gazetteer or recorded replies: without them nothing can be found")
        recorded = spark.read.parquet(args.replies).select("text", "reply") if args.replies else None
        print("extracted", extract_stage(store, extractors, args.run_ts, company, args.limit, settings, list(models.reviewers), recorded))
    if args.command == "merge-graph":
        job.say("merging")
        print(_said(company, merge_stage(store, locks, args.run_ts, company, settings, list(models.resolvers))))
    if args.command in ("merge-graph-pending", "run-all"):
        job.say("merging")
        for name, totals in merge_pending(store, locks, args.run_ts, settings, list(models.resolvers)).items():
            print(_said(name, totals))


def gazetteer(spark: SparkSession, path: str) -> extract.Gazetteer:
    return extract.Gazetteer(json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))


def _said(company: str, totals: dict[str, int] | None) -> str:
    if totals is None:
        return f"{company}: merge already in progress, skipped"
    if not totals["articles_merged"]:
        return f"{company}: no new articles"
    return f"{company}: merged {totals['articles_merged']} articles ({totals['entities']} entities, {totals['relationships']} relationships)"


if __name__ == "__main__":
    main()
