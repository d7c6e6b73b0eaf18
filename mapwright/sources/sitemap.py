"""Sitemaps: the URLs of ``urlset`` files and the files that a ``sitemapindex`` points to.

Files that Spark has read, from any store, are parsed where they lie (:func:`entries`); what cannot be read becomes a
row with a reason, never an error of the run. :class:`SitemapSource` reads from addresses instead, as
``spark.read.format("sitemap")``: the first file is looked at in planning, and each file that it points to is a partition.
"""

from __future__ import annotations

import gzip
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mapwright.operators.articles import is_article_url
from mapwright.storage import discard, materialize

#: A row for each location of a file, or one with the reason why there are none. kind: url, sitemap, or null.
ENTRIES = "path string, kind string, loc string, lastmod string, reason string"
_PARENTS = {"urlset": "url", "sitemapindex": "sitemap"}


def parse(content: bytes | None) -> tuple[str | None, list[tuple[str, str | None]], str | None]:
    """(kind, [(loc, lastmod)], reason) of one file, gzip-compressed or not, whatever its name and its namespace.

    A file counts as a whole or not at all: a sitemap that breaks off gives a reason and no locations.
    """
    raw = bytes(content or b"")
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error) as e:
            return None, [], f"broken gzip: {e}"
    if not raw.strip():
        return None, [], "empty"
    head = raw[:1000].lower()
    if b"<html" in head or b"<!doctype html" in head:
        return None, [], "an HTML page, not a sitemap: a single article, or the wrong address"
    kind, found, depth = None, [], 0
    loc = lastmod = None
    parser = ElementTree.XMLPullParser(["start", "end"])
    try:
        for at in range(0, len(raw), 1 << 20):
            parser.feed(raw[at : at + (1 << 20)])
            for event, e in parser.read_events():
                name = e.tag.rpartition("}")[2]
                if event == "start":
                    depth += 1
                    if depth == 1:
                        kind = _PARENTS.get(name)
                        if kind is None:
                            return None, [], f"no urlset or sitemapindex but {name}"
                    continue
                depth -= 1
                if depth == 2 and name == "loc":
                    loc = loc or (e.text or "").strip()
                elif depth == 2 and name == "lastmod":
                    lastmod = (e.text or "").strip() or None
                elif depth == 1:
                    if name == kind and loc:
                        found.append((loc, lastmod))
                    loc = lastmod = None
                    e.clear()
        parser.close()
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        return None, [], f"broken XML: {e}"
    return kind, found, None


def _rows(path: str, content: bytes | None) -> list[tuple]:
    kind, found, reason = parse(content)
    return [(path, None, None, None, reason)] if reason else [(path, kind, loc, lastmod, None) for loc, lastmod in found]


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, content`` of the files at ``path``, in any store."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def entries(files: DataFrame) -> DataFrame:
    """The rows of ENTRIES for ``files`` (path, content). A sitemap without locations gives no row; a null content is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(_rows(path, content), columns=["path", "kind", "loc", "lastmod", "reason"], dtype=object)

    return files.select("path", "content").mapInPandas(run, ENTRIES)


def article_urls(found: DataFrame) -> DataFrame:
    """``url``: the distinct locations of :func:`entries` that are articles."""
    return found.where((F.col("kind") == "url") & is_article_url(F.col("loc"))).select(F.col("loc").alias("url")).distinct()


def quarantine(found: DataFrame) -> DataFrame:
    """``path, reason`` of the files that could not be read as sitemaps."""
    return found.where("reason is not null").select("path", "reason")


def _heads(only: DataFrame) -> DataFrame:
    """``path, head`` of files (path, up) that one index names: the first file above that is none of these, null on a ring.

    Pointers are doubled: each round goes on from where the last one ended, by as many steps again.
    """
    at, steps, n = only.select("path", F.col("up").alias("head")), 1, only.count()
    while True:
        above = at.select(F.col("path").alias("head"), F.col("head").alias("next"))
        after = materialize(at.join(above, "head", "left").select("path", "head", "next"), "sitemap-heads")
        if steps >= n or after.where("next is not null").isEmpty():
            return after.select("path", F.when(F.col("next").isNull(), F.col("head")).alias("head"))
        at, steps = after.select("path", F.coalesce("next", "head").alias("head")), 2 * steps


def crawl(found: DataFrame, start: DataFrame, path_of: Callable[[Column], Column] = lambda loc: loc) -> DataFrame:
    """The rows of :func:`entries` whose file can be reached from those of ``start`` (path), however deep.

    ``path_of`` turns a location of an index into the path of the file that holds it. A file that only one index names is
    reached if that index is, so it is folded into the first file above that several name, and so again until every file
    is named by several; a chain of any length is folded in as many rounds as its length has binary digits. What is left
    is followed by a join from the files that the last one reached; a file counts once, so indexes that point to each
    other end.
    """
    found, start = materialize(found, "sitemap-entries"), materialize(start.select("path").distinct(), "sitemap-start")
    links = found.where("kind = 'sitemap'").select("path", path_of(F.col("loc")).alias("to")).where("path <> to").distinct()
    links, folded = materialize(links, "sitemap-links"), []
    while True:
        only = links.groupBy(F.col("to").alias("path")).agg(F.min("path").alias("up"), F.count("*").alias("n")).where("n = 1").drop("n")
        only = materialize(only.join(start, "path", "left_anti"), "sitemap-only")
        if only.isEmpty():
            break
        heads = materialize(_heads(only), "sitemap-folded")
        folded.append(heads)
        # a file below a ring is not reached at all, so what it names is not reached through it
        kept = links.join(only.select(F.col("path").alias("to")), "to", "left_anti").join(heads.withColumn("inner", F.lit(True)), "path", "left")
        kept = kept.where("inner is null or head is not null").select(F.coalesce("head", "path").alias("path"), "to")
        links = materialize(kept.where("path <> to").distinct(), "sitemap-links")
    new = reached = start
    while not new.isEmpty():
        after = new.join(links, "path").select(F.col("to").alias("path")).distinct().join(reached, "path", "left_anti")
        new = materialize(after, "sitemap-reached")
        reached = reached.union(new)
    for heads in reversed(folded):
        reached = reached.union(heads.join(reached.withColumnRenamed("path", "head"), "head", "left_semi").select("path"))
    return found.join(reached, "path", "left_semi")


def resolve_urls(found: DataFrame, address: str, path_of: Callable[[Column], Column] = lambda loc: loc) -> DataFrame:
    """``url`` of the articles that an address stands for: those of its sitemap, or itself where it is a page."""
    start = found.sparkSession.range(1).select(path_of(F.lit(address)).alias("path"))
    page = found.where(F.col("reason").startswith("an HTML page")).join(start, "path", "left_semi").select(F.lit(address).alias("url"))
    return article_urls(crawl(found, start, path_of)).union(page.limit(1))


def fetched(address: str, timeout: float = 30.0, attempts: int = 3, agent: str = "Mozilla/5.0 (compatible; mapwright)") -> tuple[bytes | None, str | None]:
    """(content, reason) of an address, http(s) or a file that is mounted where this runs."""
    if not address.startswith(("http://", "https://")):
        try:
            with open(address.removeprefix("file://"), "rb") as f:
                return f.read(), None
        except OSError as e:
            return None, f"not readable: {e.strerror}"
    reason = None
    for _ in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": agent}), timeout=timeout) as answer:
                return answer.read(), None
        except urllib.error.HTTPError as e:
            reason = f"HTTP {e.code}"
            if e.code < 500:
                break
        except OSError as e:
            reason = f"not reachable: {e}"
    return None, reason


class _Sitemap(InputPartition):
    def __init__(self, address: str, seen: tuple[str, ...], content: bytes | None = None) -> None:
        self.address, self.seen, self.content = address, seen, content


class _Reader(DataSourceReader):
    def __init__(self, addresses: list[str], timeout: float) -> None:
        self.addresses, self.timeout = addresses, timeout

    def partitions(self) -> list[_Sitemap]:
        """The first files are fetched here; an index of them becomes a partition for each file that it names."""
        out, named = [], dict.fromkeys(self.addresses)
        for address in named:
            content, _ = fetched(address, self.timeout)
            kind, found, _ = parse(content)
            if kind == "sitemap":
                out += [_Sitemap(loc, tuple(named)) for loc in dict.fromkeys(loc for loc, _ in found) if loc not in named]
            else:
                out.append(_Sitemap(address, tuple(named), content))
        return out

    def read(self, partition: _Sitemap) -> Iterator[tuple]:
        """One file and, where it is an index itself, all below it."""
        waiting, seen = [(partition.address, partition.content)], {*partition.seen, partition.address}
        while waiting:
            address, content = waiting.pop()
            reason = None
            if content is None:
                content, reason = fetched(address, self.timeout)
            for row in [(address, None, None, None, reason)] if reason else _rows(address, content):
                if row[1] != "sitemap":
                    yield row
                elif row[2] not in seen:
                    seen.add(row[2])
                    waiting.append((row[2], None))


class SitemapSource(DataSource):
    """``spark.read.format("sitemap").load(address)``: the rows of ENTRIES below an address, indexes followed.

    Register it with ``spark.dataSource.register(SitemapSource)``. Several addresses are parted by white space; option
    ``timeout`` is in seconds. A file that is reached from two indexes of the first one may be read twice.
    """

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        addresses = self.options.get("path", "").split()
        if not addresses:
            raise ValueError("load an address")
        return _Reader(addresses, float(self.options.get("timeout", "30")))


def listed(spark: SparkSession, address: str) -> DataFrame:
    """``url`` of the articles below an address, read with :class:`SitemapSource`; a page stands for itself."""
    spark.dataSource.register(SitemapSource)
    found = materialize(spark.read.format("sitemap").load(address), "sitemap-listed")
    pages = found.where(F.col("reason").startswith("an HTML page") & F.col("path").isin(address.split())).select(F.col("path").alias("url"))
    out = materialize(article_urls(found).union(pages).distinct(), "sitemap-urls")
    discard(found)
    return out
