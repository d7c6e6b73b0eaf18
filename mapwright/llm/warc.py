"""Merkle fixity audit of WARC archives.

Pages become WARC records, filed in archives by id and laid out by offset. Records are hashed where they are read, and
only digests move. A record's leaf is the digest of its offset, its length and its bytes' digest; above it, every node is the digest of up to ten neighbours in order, first inside an archive, then
over the archives, up to one root. Replicas whose roots agree hold the same bytes. Where they differ, the audit goes
down level by level and looks at the children of differing nodes only, until it has the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.storage import materialize

from .words import NULL_ID, inner_id, outer_id

FANOUT = 10
ARCHIVE_IDS = 1000
#: Levels inside an archive at least.
LEVELS = 3

#: When the pages were fetched, if the caller does not say.
DATE = "1970-01-01T00:00:00Z"
#: Rows without an id are dealt to so many archives by their digest.
LOOSE = 4096

_HEADER = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: %s\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Target-URI: %s\r\nContent-Type: text/html\r\nContent-Length: "


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_ids: int = ARCHIVE_IDS, date: str = DATE) -> DataFrame:
    """``id, archive, position, start, length, digest, record``: a WARC record for each row, in the order of ids.

    An archive holds ``archive_ids`` consecutive ids; its records are laid end to end. Null urls and pages count as
    empty; rows without an id lie in archives of their own, numbered downwards from the least long, by their digest; rows
    that share an id follow each other by url and digest. Records of any length are hashed in one piece.
    """
    p = pages.select(inner_id(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    name = F.coalesce(outer_id("id").cast("string"), F.lit("none"))
    record = F.concat(F.format_string(_HEADER, F.lit(date), name, F.col("url")), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), F.col("html"), F.lit("\r\n\r\n"))
    r = p.withColumn("record", record).withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", digest_of("record"))
    loose = F.conv(F.substring("digest", 1, 3), 16, 10).cast("long") % LOOSE - LOOSE
    by_id = F.expr(f"(id - pmod(id, {archive_ids})) div {archive_ids}")
    least = -(1 << 63) // archive_ids - 1
    r = r.withColumn("archive", F.when(F.col("id") == NULL_ID, loose + least).otherwise(by_id))
    order = W.partitionBy("archive").orderBy("id", "url", "digest")
    return r.select(
        "id",
        "archive",
        (F.row_number().over(order) - 1).cast("long").alias("position"),
        F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        "length",
        "digest",
        "record",
    )


def digest_of(record: str) -> Column:
    return F.sha2(F.col(record).cast("binary"), 256)


def write_archives(recs: DataFrame, path: str) -> None:
    """Write the records as text files, one folder for each archive, each record's bytes in order of offset."""
    body = F.expr("left(record, char_length(record) - 1)").alias("value")  # the line separator is the last byte
    recs.repartition("archive").sortWithinPartitions("archive", "position").select("archive", body).write.partitionBy("archive").option("lineSep", "\n").text(path)


def _joined(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(children), lambda x: x["digest"]), "").cast("binary"), 256)


def shape_of(*replicas: DataFrame, fanout: int = FANOUT) -> tuple[int, int, int]:
    """Levels inside archives, levels above them, and the first archive's number, to fit all these replicas."""
    every = None
    for r in replicas:
        every = r.select("archive", "position") if every is None else every.union(r.select("archive", "position"))
    ends = every.agg(F.max("position").alias("top"), F.min("archive").alias("low"), F.max("archive").alias("high")).first()
    inside, above = LEVELS, 0
    if ends["top"] is not None:
        while fanout**inside <= ends["top"]:
            inside += 1
        above = 1
        while fanout**above <= ends["high"] - ends["low"]:
            above += 1
    return inside, above, ends["low"] or 0


def tree(recs: DataFrame, *, fanout: int = FANOUT, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """``level, archive, position, digest, up_archive, up_position``: all nodes with their parents.

    Level 0 are the records; the last level is the root. Inside archives nodes have their archive's number; above them,
    ``archive`` is null and ``position`` numbers groups of archives. A node joins at most ``fanout`` children. Replicas
    that are to be compared need one ``shape`` (:func:`shape_of`), else each tree is as high as its own records ask for.
    """
    leaf = F.sha2(F.concat_ws("|", F.col("start").cast("string"), F.col("length").cast("string"), F.col("digest")).cast("binary"), 256)
    last = materialize(recs.select("archive", "position", leaf.alias("digest")), "warc-leaves")
    level, out, none = 0, None, F.lit(None).cast("long")
    inside, above, low = shape or shape_of(last, fanout=fanout)
    for level in range(inside + above + 1):
        if level < inside:
            up_a, up_p = F.col("archive"), F.expr(f"position div {fanout}")
        elif level == inside:  # one node for each archive: from here on, archives are counted
            up_a, up_p = none, F.expr(f"(archive - ({low}L)) div {fanout}")
        else:
            up_a, up_p = none, F.expr(f"position div {fanout}") if level < inside + above else none
        nodes = last.select(F.lit(level).alias("level"), "archive", "position", "digest", up_a.cast("long").alias("up_archive"), up_p.cast("long").alias("up_position"))
        out = nodes if out is None else out.union(nodes)
        child = F.collect_list(F.struct(F.coalesce("archive", F.lit(0)).alias("a"), F.col("position").alias("p"), "digest"))
        if level < inside + above:
            last = nodes.groupBy(F.col("up_archive").alias("archive"), F.col("up_position").alias("position")).agg(_joined(child).alias("digest"))
            last = materialize(last, "warc-level")
    return out


def root_of(nodes: DataFrame) -> str | None:
    """The digest at the top; None for an empty tree."""
    return nodes.agg(F.max_by("digest", "level").alias("d")).first()["d"]


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of nodes that are not in both with equal digests."""
    key = ["archive", "position"]
    both = a.select(*key, "digest", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(*key, "digest", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    seen = both.groupBy(*key, "digest").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    return seen.where("a <> b").select(*key).distinct()


def audit(a: DataFrame, b: DataFrame, *, fanout: int = FANOUT) -> DataFrame:
    """``archive, position`` of the records that two trees (of :func:`tree`) do not share byte by byte.

    Positions that only one replica has are among them. Equal roots end the audit at once; else only the children of
    differing nodes are looked at. Trees that were not built to one shape have no nodes in common but the leaves. Two
    empty trees do not differ.
    """
    tops = [t.agg(F.max("level").alias("l")).first()["l"] for t in (a, b)]
    level, open_nodes = (tops[0], None) if tops[0] == tops[1] and tops[0] is not None else (0, None)
    while level >= 0:
        sides = [t.where(F.col("level") == level) for t in (a, b)]
        if open_nodes is not None:
            up = open_nodes.select(F.col("archive").alias("_a"), F.col("position").alias("_p"))
            sides = [s.join(up, s["up_archive"].eqNullSafe(up["_a"]) & (s["up_position"] == up["_p"]), "left_semi") for s in sides]
        open_nodes = materialize(_differing(*sides), "warc-differing")
        if open_nodes.isEmpty():
            break
        level -= 1
    return open_nodes


def damaged(pages: DataFrame, *, every: int = 50, rest: int = 7) -> DataFrame:
    """A replica of ``pages`` for tests: where ``page_id`` leaves ``rest``, the first character of a page is wrong."""
    hit = (F.pmod("page_id", F.lit(every)) == rest) & (F.char_length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.when(F.substring("html", 1, 1) == "~", "!").otherwise("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Every record with its place, leaf, archive's root, and whether the audit finds it damaged in :func:`damaged`."""
    recs = materialize(records(pages.select("page_id", "url", "html")).drop("record"), "warc-records")
    replica = materialize(records(damaged(pages.select("page_id", "url", "html"))).drop("record"), "warc-replica")
    shape = shape_of(recs, replica)
    good, bad = tree(recs, shape=shape), tree(replica, shape=shape)
    found = audit(good, bad).withColumn("damaged", F.lit(True))
    roots = good.where(F.col("archive").isNotNull() & F.col("up_archive").isNull()).select("archive", F.col("digest").alias("archive_root"))
    leaves = good.where("level = 0").select("archive", "position", F.col("digest").alias("leaf"))
    out = recs.drop("digest").join(leaves, ["archive", "position"]).join(roots, "archive").join(found, ["archive", "position"], "left")
    return out.select(outer_id("id").alias("page_id"), "archive", "position", "start", "length", "leaf", "archive_root", F.coalesce("damaged", F.lit(False)).alias("damaged"))


ORACLE_SQL = r"""
with p as (
  select page_id, page_id // 1000 archive, html,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) record
  from pages),
r as (
  select *, row_number() over (partition by archive order by page_id) - 1 as "position", strlen(record) length,
    coalesce(sum(strlen(record)) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as "start"
  from p),
leaf as (select page_id, archive, "position", "start"::bigint as "start", length, html, sha256("start"::bigint || '|' || length || '|' || sha256(record)) leaf from r),
l1 as (select archive, "position" // 10 q, sha256(string_agg(leaf, '' order by "position")) h from leaf group by all),
l2 as (select archive, q // 10 q2, sha256(string_agg(h, '' order by q)) h from l1 group by all),
l3 as (select archive, sha256(string_agg(h, '' order by q2)) archive_root from l2 group by all)
select page_id, archive::bigint archive, "position", "start", length, leaf, archive_root, page_id % 50 = 7 and strlen(coalesce(html, '')) > 0 damaged
from leaf join l3 using (archive)
"""
