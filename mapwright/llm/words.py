"""Words, hashes and windows of whole texts, as numpy arrays over a block of documents.

The work of the word-based operators runs inside ``mapInArrow``: Spark deals out the rows, and each task turns
blocks of texts of a bounded size (:func:`blocks`) into flat arrays. A block holds whole texts only; a text longer
than the bound is a block of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mapwright.storage import materialize

#: Stands for a null id inside an operator; null ids sort first.
NULL_ID = -(1 << 63)
#: Texts are handled in blocks of about so many bytes and at most so many rows.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 2_000
#: An Arrow batch holds about so many bytes (see :func:`mapped`).
BATCH_BYTES = 2 << 20
#: A task keeps at most so many words' hashes at a time.
CACHE_WORDS = 60_000

_ODD = 0x9E3779B97F4A7C15
_SHARED = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def give_back() -> None:
    """Return what a task has freed to the machine: workers are used again, and would hold the most they ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _thrifty(run):
    def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return thrifty


def mapped(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in Arrow batches of a bounded size, unless the session has a bound of its own.

    A batch of the default 10,000 whole texts takes tens of MB in each of a task's processes.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_thrifty(run), schema)


def inner_id(name: str) -> Column:
    """An id as a long without nulls; :func:`outer_id` undoes it."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def outer_id(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_print(name: str) -> Column:
    """A digest of a text, empty for a null one: with the id it tells apart rows that share an id."""
    return F.coalesce(F.md5(F.col(name).cast("string")), F.lit(""))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, tag: str) -> DataFrame:
    """``key, own, print, text``: one row, with a key of its own, for each id and text; written to the shared folder."""
    rows = docs.select(inner_id(id_col).alias("own"), text_print(text_col).alias("print"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.groupBy("own", "print").agg(F.first("text").alias("text")).withColumn("key", F.monotonically_increasing_id()), tag)


def fresh(docs: DataFrame) -> str:
    """A beginning of names that no column of ``docs`` has."""
    out = "_"
    while any(c.lower().startswith(out) for c in docs.columns):
        out += "_"
    return out


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are not in ``gone`` (own, print)."""
    own, print_ = f"{fresh(docs)}own", f"{fresh(docs)}print"
    return docs.join(gone.toDF(own, print_), (inner_id(id_col) == F.col(own)) & (text_print(text_col) == F.col(print_)), "left_anti")


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of characters other than U+0020 and U+0009 to U+000D; ``lower`` turns A-Z into a-z."""
    raw = (text or "").encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def letter_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, after A-Z became a-z."""
    return (text or "").encode("utf-8", "replace").translate(_SHARED).split()


class WordHashes(dict):
    """64-bit hashes by word; emptied when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` items, by its start; runs over the block's end are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_ODD)
        out += hashes[k : n + k]
    return mixed(out)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values, by doubling."""
    n, have = len(values) - size + 1, 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    out = values
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


class Block:
    """Texts of a block: ``hashes`` of all their words, ``starts`` and ``counts`` by text."""

    def __init__(self, ids: list, texts: list, words: list[list[bytes]], cache: WordHashes) -> None:
        self.ids, self.texts, self.words = ids, texts, words
        self.counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if words else np.empty(0, dtype=np.int64)
        self.hashes = np.concatenate([cache.of(w) for w in words]) if words else np.empty(0, dtype=np.uint64)

    def owner(self) -> np.ndarray:
        """For each word, the position of its text in the block."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def whole(self, size: int) -> np.ndarray:
        """For each window start of :func:`windows`, whether the window ends inside its text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, dtype=bool)
        ends = np.repeat(self.starts + self.counts, self.counts)
        return np.arange(n) + size <= ends[:n]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about BLOCK_BYTES of text and at most BLOCK_ROWS rows."""
    for batch in batches:
        at, col = 0, batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        while at < len(sizes):
            done = ends[at - 1] if at else 0
            upto = min(at + BLOCK_ROWS, max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, side="right"))))
            yield batch.slice(at, upto - at)
            at = upto


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[dict[str, list]]:
    """The rows of Arrow batches as columns of Python lists, a block at a time (:func:`parts`)."""
    for part in parts(batches, text):
        yield {name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)}
