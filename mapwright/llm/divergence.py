"""How far the sources of a language lie apart in their words.

A byte-level tokenizer turns a block's concatenated UTF-8 into terms with one table look-up; equal slices are found by
xxhash and held against each other byte by byte. Each task counts (group, term) cells and sends every cell once, to the
partition of its language and term, where document counts decide which terms stay. The kept cells are dealt out in
blocks of terms; a block is a sparse matrix in CSR form (sources by terms), and segmented sums over its rows give its
share of the distance of every two sources. Shares add up exactly: all values are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.storage import materialize

from .words import blocks, mapped

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: A task sends its cells on when it has met so many terms, or holds so many cells.
TASK_TERMS, TASK_CELLS = 200_000, 800_000
#: A block of the kept terms has about so many cells.
BLOCK_CELLS = 100_000
#: The bytes of a term as they count, 0 for bytes between terms.
LOWERED = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], dtype=np.uint8)


def slices(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes of some texts, and start, end and text number of each term."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    low = LOWERED[np.frombuffer(b"\0".join([b"", *raw, b""]), dtype=np.uint8)]
    edges = np.flatnonzero((low[1:] != 0) != (low[:-1] != 0)) + 1
    starts, ends = edges[0::2], edges[1::2]
    begins = np.cumsum([1, *(len(r) + 1 for r in raw[:-1])])
    return low, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms, and the number of each slice's term: by hash, verified byte by byte."""
    data = low.tobytes()
    words = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    hashes = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    model, sizes = first[number], ends - starts
    same = sizes == sizes[model]
    size = sizes[same]
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    unlike = low[np.repeat(starts[same], size) + inside] != low[np.repeat(starts[model[same]], size) + inside]
    if unlike.any():
        same[np.repeat(np.flatnonzero(same), size)[unlike]] = False
    terms = [words[k] for k in first.tolist()]
    more: dict[bytes, int] = {}
    for k in np.flatnonzero(~same).tolist():  # two terms with one hash
        if (at := more.get(words[k])) is None:
            at = more[words[k]] = len(terms)
            terms.append(words[k])
        number[k] = at
    return terms, number


class Cells:
    """Occurrences and documents by (group, term) of what a task has read, sent on before they grow too many."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, langs: list, sources: list, texts: list) -> None:
        low, starts, ends, owner = slices(texts)
        group = np.array([self.groups.setdefault(k, len(self.groups)) for k in zip(langs, sources, strict=True)], dtype=np.int64)
        terms, number = grouped(low, starts, ends)
        if not terms:
            return
        own = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], dtype=np.int64)[number]
        # one entry for each term of a document, then one for each term of a group
        by_doc, times = np.unique((owner << 32) | own, return_counts=True)
        key = (group[by_doc >> 32] << 32) | (by_doc & 0xFFFFFFFF)
        self._hold(key, times, np.ones(len(key), dtype=np.int64))

    def _hold(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.held.append(self._sum(key, n, docs))
        self.size += len(self.held[-1][0])
        if self.size > TASK_CELLS:
            self._fold()

    def _fold(self) -> None:
        if len(self.held) > 1:
            self.held = [self._sum(*(np.concatenate(c) for c in zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])

    @staticmethod
    def _sum(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, n, docs = key[order], n[order], docs[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
        return key[at], np.add.reduceat(n, at) if len(at) else n, np.add.reduceat(docs, at) if len(at) else docs

    def full(self) -> bool:
        return len(self.terms) >= TASK_TERMS or self.size >= TASK_CELLS or len(self.groups) >= TASK_TERMS

    def sent(self) -> Iterator[pa.RecordBatch]:
        self._fold()
        if self.held:
            key, n, docs = self.held[0]
            groups, terms = list(self.groups), pa.array(list(self.terms), pa.binary()).cast(pa.string())
            langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for lo in range(0, len(key), 50_000):
                part = slice(lo, lo + 50_000)
                at = pa.array(key[part] >> 32)
                cols = [langs.take(at), sources.take(at), terms.take(pa.array(key[part] & 0xFFFFFFFF)), pa.array(n[part]), pa.array(docs[part])]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
        self.__init__()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = Cells()
    for rows in blocks(batches):
        cells.add(rows["lang"], rows["source"], rows["text"])
        if cells.full():
            yield from cells.sent()
    yield from cells.sent()


def pair_shares(indptr: np.ndarray, cols: np.ndarray, data: np.ndarray, zero: np.ndarray, terms: int) -> np.ndarray:
    """Sums of absolute differences of every two rows of a CSR matrix, whose absent cells of row r hold ``zero[r]``.

    Returned as a matrix of which the part over the diagonal is filled.
    """
    n = len(zero)
    rows = np.repeat(np.arange(n), np.diff(indptr))
    out = np.zeros((n, n), dtype=np.int64)
    for s in range(n - 1):
        lo, hi = indptr[s], indptr[s + 1]
        own = np.full(terms, zero[s], dtype=np.int64)
        own[cols[lo:hi]] = data[lo:hi]
        others = zero[s + 1 :]
        # as if all cells of the others were absent
        total = (terms - (hi - lo)) * np.abs(others - zero[s])
        for k in range(lo, hi, 4096):
            total += np.abs(others[:, None] - data[k : min(hi, k + 4096)][None, :]).sum(axis=1)
        # and what their present cells change
        if len(data) > hi:
            there = own[cols[hi:]]
            change = np.abs(data[hi:] - there) - np.abs(zero[rows[hi:]] - there)
            some = np.flatnonzero(np.diff(indptr[s + 1 :]) > 0)
            total[some] += np.add.reduceat(change, (indptr[s + 1 : -1] - hi)[some])
        out[s, s + 1 :] = total
    return out


def _block_shares(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of terms of a language: the share of every two of its sources in their distance."""
    names = sorted(groups["source"].to_pylist())
    at = {s: k for k, s in enumerate(names)}
    order = np.argsort([at[s] for s in groups["source"].to_pylist()])
    zero = groups["zero"].to_numpy()[order].astype(np.int64)
    rows = np.array([at[s] for s in cells["source"].to_pylist()], dtype=np.int64)
    codes = cells["term"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    cols = codes.indices.to_numpy().astype(np.int64)
    order = np.lexsort((cols, rows))
    indptr = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(names)))]).astype(np.int64)
    shares = pair_shares(indptr, cols[order], cells["p"].to_numpy()[order].astype(np.int64), zero, len(codes.dictionary))
    a, b = np.triu_indices(len(names), 1)
    pick = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": pick.take(pa.array(a)), "b": pick.take(pa.array(b)), "share": pa.array(shares[a, b], pa.int64())})


def _p(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    return F.expr(f"1L + cast({SCALE} as decimal(12, 0)) * cast({count} + {SMOOTH} as decimal(19, 0)) div cast({total} + {SMOOTH} * {terms} as decimal(19, 0))")


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of the sources of a language, and the terms that mark them.

    A term is a run of letters A-Z and a-z and of characters beyond ASCII, A-Z lowered; a language keeps the terms of at
    least ``min_docs`` of its documents. Part ``pair`` has for each source of a language each other one, and the sum of
    the absolute differences of their terms' parts in 1,000,000,000; part ``term`` the ``top`` terms whose part in the
    source is over that in the language, by that difference.

    Null texts, languages and sources are empty ones. Rows count each as a document, repeated or not. A language that
    keeps no term has pairs of value 0; a source alone in its language has no pairs. Ties rank by the item's bytes. A
    text of any length is read whole, in the memory of one block. An empty table gives no row; other columns are not
    looked at.
    """
    texts, langs, sources = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    d = docs.select(langs.alias("lang"), sources.alias("source"), texts.alias("text"))
    cells = mapped(d, _counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    # both steps below find the rows of a language's term where they are
    cells = cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    cells = cells.select("*", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    kept = materialize(cells.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", "first"), "divergence-cells")

    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"), F.count("*").alias("cells"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = d.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = materialize(groups.fillna(0, ["total", "lang_total", "terms", "cells"]), "divergence-groups")

    # joined as Spark sees fit: groups are few where a source is a collection, and many where it is a host
    rated = kept.join(groups, ["lang", "source"]).withColumns({"p": _p("n", "total", "terms"), "q": _p("lang_n", "lang_total", "terms")})
    over = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    marks = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    count = F.expr(f"cast(ceil(cells / {BLOCK_CELLS}) as int)")
    dealt = rated.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), count).cast("int").alias("block"))
    ends = groups.where("terms > 0").select("lang", "source", _p("0L", "total", "terms").alias("zero"), F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    shares = dealt.groupBy("lang", "block").cogroup(ends.groupBy("lang", "block")).applyInArrow(_block_shares, "lang string, a string, b string, share long")
    shares = shares.groupBy("lang", "a", "b").agg(F.sum("share").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = shares.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")
    # languages that keep nothing have no block
    bare = groups.where("terms = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = pairs.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(marks)


ORACLE_SQL = r"""
with d as (
  select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w
  from documents),
groups as (select distinct lang, source from d),
w as (select k, lang, source, unnest(w) term from d),
kept as (select lang, term, count(*)::hugeint c from w group by lang, term having count(distinct k) >= 30),
n as (select lang, source, term, count(*)::hugeint c from w semi join kept using (lang, term) group by all),
ls as (select lang, sum(c)::hugeint n, count(*)::hugeint v from kept group by lang),
gs as (select lang, source, coalesce(sum(c), 0)::hugeint n from groups left join n using (lang, source) group by all),
p as (
  select gs.lang, gs.source, kept.term, coalesce(n.c, 0) c, 1 + (1000000000 * (coalesce(n.c, 0) + 5)) // (gs.n + 5 * ls.v) p,
    1 + (1000000000 * (kept.c + 5)) // (ls.n + 5 * ls.v) q
  from gs join ls using (lang) join kept using (lang) left join n on n.lang = gs.lang and n.source = gs.source and n.term = kept.term),
pairs as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(s, 0) value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source item, sum(abs(x.p - y.p)) s from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) t
  on t.lang = a.lang and t.source = a.source and t.item = b.source),
every as (select * from pairs union all select lang, source, 'term', term, p - q from p where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) r from every)
select lang, source, part, item, value::bigint "value", r::integer rank from ranked where part = 'pair' or r <= 50
"""
