"""The test tables seen as articles, mentions, stated edges, chunk replies and jobs, with matching DuckDB SQL."""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapwright.functions.keys import url_key, url_path
from mapwright.functions.vocab import canonical_relation, strip
from mapwright.storage import materialize, read_table, tasks_for

RUN_TS = "2030-01-01T00:00:00+00:00"
#: Orders from here on belong to the second of two runs.
SECOND_RUN = "1998-04-25"

PHRASES = ("calls", "Writes To", "reads-from", "uses for distributed tracing", "replaced by", "pushes schema to", "userland thing", "composes", "hosts migrated route handlers from", "sends requests to", "frobnicates", "part of", "Publishes")

_SQL_PHRASES = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in four states by ``page_id % 4``; the language of the path is the company."""
    p, state = read_table(spark, sf_dir, "pages"), F.col("page_id") % 4
    ts = F.date_format(F.timestamp_seconds(1704067200 + F.col("page_id") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    graph = F.struct(F.transform(F.sequence(F.lit(1).cast("long"), F.col("page_id") % 7 + 1), lambda i: F.struct(i.cast("string").alias("name"))).alias("entities"))
    return p.select(
        "page_id",
        url_key(F.col("url")).alias("key"),
        F.col("url").alias("source_url"),
        F.regexp_extract(url_path(F.col("url")), "^/([a-z]{2})/", 1).alias("company_name"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.when(state == 0, F.col("html")).alias("raw_html"),
        F.when(state >= 1, F.col("html")).alias("cleaned_text"),
        F.when(state >= 2, graph).alias("extracted_graph"),
        ts.alias("scraped_at"),
        F.when(state >= 2, ts).alias("extracted_at"),
        F.when(state >= 3, ts).alias("graph_merged_at"),
    )


_URL_PATH = r"regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
SQL_ARTICLES = rf"""
articles as (
  select page_id, url source_url, html,
    coalesce(nullif(regexp_extract(rtrim({_URL_PATH}, '/'), '-([0-9a-f]{{12}})$', 1), ''), nullif(trim({_URL_PATH}, '/'), ''),
      regexp_extract(url, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)) as "key",
    regexp_extract({_URL_PATH}, '^/([a-z][a-z])/', 1) company_name, page_id % 4 state,
    strftime(to_timestamp(1704067200 + page_id * 60) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') scraped_at,
    case page_id % 4 when 3 then 'merged' when 2 then 'extracted' when 1 then 'cleaned' else 'scraped' end stage
  from pages)"""


#: Suppliers are sent to all tasks up to so many, and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def tasks(spark: SparkSession, sf_dir: str, each: int = 1) -> int:
    """Tasks for a shuffle of the order lines, with ``each`` rows to a line."""
    return tasks_for(spark, read_table(spark, sf_dir, "lineitem").count() * each)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders")
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    p, s = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "supplier")
    # orders know their country before lines meet them, and names come last: few and narrow rows are shuffled, and none sorted
    n_tasks = tasks(spark, sf_dir)
    o = o.select("o_orderkey", "o_custkey", "o_orderdate").join(c.select("c_custkey", "c_nationkey").hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    year = F.when(F.col("l_quantity") > 25, F.year("l_shipdate")).when(F.col("l_linenumber") == 3, 0)
    rows = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", year.alias("year")).repartition(n_tasks, "l_orderkey")
    rows = rows.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    p = p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size").hint("shuffle_hash")
    rows = rows.repartition(n_tasks, "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    s = s.select("s_suppkey", "s_name")
    rows = rows.join(F.broadcast(s) if s.count() <= BROADCAST_ROWS else s.hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    plain, turn = F.concat_ws(" ", "p_name", "p_brand"), (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    part = F.when(turn == 1, F.upper(plain)).when(turn == 2, F.translate(plain, " #", "--")).when(turn == 3, F.lower(F.translate(plain, " ", "/"))).when((turn == 4) & (F.col("l_partkey") % 3 == 0), F.concat(plain, F.lit("s"))).otherwise(plain)
    # several lines of an order may share a number; the part tells them apart
    item = (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    return rows.select(
        F.col("n_name").alias("company_name"),
        F.col("l_orderkey").alias("article_id"),
        F.col("o_orderdate").alias("extracted_at"),
        item.alias("line"),
        part.alias("part_name"),
        F.col("s_name").alias("supplier_name"),
        "p_type",
        "p_size",
        F.when(F.col("l_partkey") % 4 == 0, F.lit(None).cast("string")).when(F.col("l_partkey") % 4 == 1, "").otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("description"),
        F.element_at(F.array(*[F.lit(x) for x in PHRASES]), ((F.col("l_linenumber") + F.col("l_suppkey")) % len(PHRASES) + 1).cast("int")).alias("raw_relation"),
        F.when(F.col("year") == 0, "").otherwise(F.col("year").cast("string")).alias("as_of"),
    )


SQL_LINES = rf"""
lines as (
  select n_name company_name, l_orderkey article_id, o_orderdate extracted_at, (l_linenumber::bigint * 1000000 + l_partkey) * 10000 + l_suppkey line,
    case when (l_orderkey + l_linenumber) % 5 = 1 then upper(p_name || ' ' || p_brand)
      when (l_orderkey + l_linenumber) % 5 = 2 then translate(p_name || ' ' || p_brand, ' #', '--')
      when (l_orderkey + l_linenumber) % 5 = 3 then lower(translate(p_name || ' ' || p_brand, ' ', '/'))
      when (l_orderkey + l_linenumber) % 5 = 4 and l_partkey % 3 = 0 then p_name || ' ' || p_brand || 's'
      else p_name || ' ' || p_brand end part_name,
    s_name supplier_name, p_type, p_size,
    case l_partkey % 4 when 0 then null when 1 then '' else 'size ' || p_size end description,
    ({_SQL_PHRASES})[(l_linenumber + l_suppkey) % {len(PHRASES)} + 1] raw_relation,
    case when l_quantity > 25 then year(l_shipdate)::varchar when l_linenumber = 3 then '' end as_of
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""

def sitemap_files(spark: SparkSession, sf_dir: str, nested: bool = False) -> DataFrame:
    """``path, content``: pages as sitemaps of ten URLs each, one in ten compressed, cut off, empty, or a page.

    ``nested``: all are whole, and file n with n % 3 = 0 is an index of the files n + 1, n + 2 and n + 3.
    """
    n = F.expr("page_id div 10")
    pages = read_table(spark, sf_dir, "pages").select(n.alias("n"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("url"))
    tagged = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))
    files = pages.groupBy("n").agg(F.array_join(F.sort_array(F.collect_list(tagged)), "").alias("body"))
    xml = F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>"))
    path = F.concat(F.lit("https://maps.example.com/"), F.col("n").cast("string"))
    if nested:
        index = F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>https://maps.example.com/"), (F.col("n") + k).cast("string"), F.lit("</loc></sitemap>")) for k in (1, 2, 3)], F.lit("</sitemapindex>"))
        return files.select(path.alias("path"), F.when(F.col("n") % 3 == 0, index).otherwise(xml).cast("binary").alias("content"))
    text = F.when(F.col("n") % 10 == 3, F.substring_index(xml, "</urlset>", 1)).when(F.col("n") % 10 == 5, F.concat(F.lit("<html>"), "body", F.lit("</html>"))).when(F.col("n") % 10 == 7, "").otherwise(xml)

    def packed(batches):
        for b in batches:
            yield b.assign(content=[gzip.compress(c.encode(), mtime=0) if n % 10 == 8 else c.encode() for n, c in zip(b["n"], b["content"], strict=True)])[["path", "content"]]

    return files.select("n", path.alias("path"), text.alias("content")).mapInPandas(packed, "path string, content binary")


KINDS = {"ECONOMY": "service", "SMALL": "datastore", "MEDIUM": "queue", "PROMO": "library", "STANDARD": "model", "LARGE": "team"}


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers named by orders: raw_name, kind, domain, description, in order of ``item``."""
    return mentions_of(lines(spark, sf_dir))


def named_by_line() -> list[dict[str, Column]]:
    """What an order line names, its part and its supplier, as columns by name."""
    kind = F.lit(None).cast("string")
    for t, k in KINDS.items():
        kind = F.when(F.col("p_type") == t, k).otherwise(kind)
    part = {"item": F.col("line") * 2, "raw_name": F.col("part_name"), "kind": kind, "domain": F.concat(F.lit("D"), (F.col("p_size") % 5).cast("string")), "description": F.col("description")}
    supplier = {"item": F.col("line") * 2 + 1, "raw_name": F.col("supplier_name"), "kind": F.lit("external_system"), "domain": F.lit("Other"), "description": F.lit(None).cast("string")}
    return [part, supplier]


def mentions_of(rows: DataFrame) -> DataFrame:
    parts, suppliers = (rows.select("company_name", "article_id", "extracted_at", *[c.alias(n) for n, c in m.items()]) for m in named_by_line())
    return parts.union(suppliers)


SQL_MENTIONS = (
    SQL_LINES
    + r""",
mentions as (
  select company_name, article_id, extracted_at, line * 2 item, part_name raw_name,
    case p_type when 'ECONOMY' then 'service' when 'SMALL' then 'datastore' when 'MEDIUM' then 'queue' when 'PROMO' then 'library' when 'STANDARD' then 'model' when 'LARGE' then 'team' end kind,
    'D' || (p_size % 5) as "domain", description from lines
  union all
  select company_name, article_id, extracted_at, line * 2 + 1, supplier_name, 'external_system', 'Other', null from lines)"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated edges with raw names, canonical relation and the wording kept."""
    return edges_of(lines(spark, sf_dir))


def edges_of(rows: DataFrame) -> DataFrame:
    """As :func:`edges`; the vocabulary is asked line by line, as a join on few wordings would shuffle all lines."""
    own = strip(F.col("raw_relation"))
    rows = rows.withColumn("relation", canonical_relation(F.col("raw_relation"))).withColumn("relation_phrase", F.when(own != F.col("relation"), own))
    return rows.select(
        "company_name", "article_id", "extracted_at", F.col("line").alias("item"),
        F.when(F.col("line") % 3 == 0, F.col("supplier_name")).otherwise(F.col("part_name")).alias("source"),
        F.when(F.col("line") % 3 == 0, F.col("part_name")).otherwise(F.col("supplier_name")).alias("target"),
        "relation", "relation_phrase", "as_of",
    )


def sql_slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def sql_relation(x: str) -> str:
    """A predicate by prefix tests, longest synonym first."""
    from mapwright.functions.vocab import FALLBACK_RELATION, RELATION_KINDS, SYNONYMS

    n = sql_norm(x)
    tests = [f"when {n} = '{k.replace('_', ' ')}' then '{k}'" for k in RELATION_KINDS]
    for phrase, kind in sorted(((p, k) for k, ps in SYNONYMS.items() for p in ps), key=lambda t: (-len(t[0]), t[0])):
        tests.append(f"when {n} = '{phrase}' or {n} like '{phrase} %' then '{kind}'")
    return f"(case {' '.join(tests)} else '{FALLBACK_RELATION}' end)"


SQL_EDGES = (
    SQL_MENTIONS
    + rf""",
phrases as (select raw_relation, {sql_relation("raw_relation")} relation from (select distinct raw_relation from lines)),
edges as (
  select company_name, article_id, extracted_at, line item,
    case when line % 3 = 0 then supplier_name else part_name end source, case when line % 3 = 0 then part_name else supplier_name end target,
    phrases.relation, case when trim(raw_relation) <> phrases.relation then trim(raw_relation) end relation_phrase, as_of
  from lines join phrases using (raw_relation)),
keyed as (
  select *, {sql_slug("company_name")} || '--' || {sql_slug("source")} || '--' || {sql_slug("relation")} || '--' || {sql_slug("target")} as "key",
    {sql_slug("company_name")} || '--' || {sql_slug("source")} source_key, {sql_slug("company_name")} || '--' || {sql_slug("target")} target_key
  from edges)"""
)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saved states of jobs, one job for each user."""
    status = F.create_map(*[F.lit(x) for x in ("view", "pending", "signup", "scraping", "click", "extracting", "error", "error", "purchase", "done")])
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("job_id"), F.element_at(status, F.col("event_type")).alias("status"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("error"))


SQL_JOBS = r"""
jobs as (
  select event_id, user_id job_id, ts created_at,
    case event_type when 'view' then 'pending' when 'signup' then 'scraping' when 'click' then 'extracting' when 'error' then 'error' else 'done' end status
  from events)"""
