"""Benchmark decontamination by winnowing.

A passage counts when ``window`` consecutive words of a benchmark item occur in a document (an item of fewer words
counts as a whole). Fingerprints: of the k-grams in every window, the one with the least hash. Two equal windows pick
the same k-gram, so joining the fingerprints of documents and items finds every shared window; each hit is then
extended to the windows around it, and only windows that occur in an item, by 128 bits of hash, are kept.

The items' fingerprints are broadcast while their number is under a checked bound; beyond it, documents and items
meet in a shuffle join on the fingerprint, and only the windows around the survivors travel on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.storage import materialize

from .words import Block, WordHashes, blocks, inner_id, keyed_texts, letter_words, mapped, mixed, outer_id, parts, sliding_min, windows, without

WINDOW = 13
GRAM = 8
#: Windows of items that may be broadcast (16 bytes each); more take the shuffle join.
BROADCAST_WINDOWS = 1_000_000

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"


#: Makes a second, independent hash of a window.
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _keyed(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows of different lengths never meet."""
    return mixed(values ^ np.uint64(length * 0x1000193))


def _check(hashes: np.ndarray, size: int) -> np.ndarray:
    """The second hash of the windows of these words: with the first, windows are compared by 128 bits."""
    return windows(mixed(hashes ^ _SECOND), size)


def _picks(grams: np.ndarray, size: int) -> np.ndarray:
    """Which k-grams are the least of some ``size`` consecutive ones; all equal least ones are kept."""
    least = sliding_min(grams, size)
    pad = np.full(size - 1, np.iinfo(np.uint64).min, dtype=np.uint64)
    # a gram is picked if it equals the least of a window that holds it: the largest of those minima
    around = np.concatenate([pad, least, pad])
    best = ~sliding_min(~around, size)
    return grams == best[: len(grams)]


def _item_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            b = Block(rows["id"], rows["text"], [letter_words(t) for t in rows["text"]], cache)
            own = b.owner()
            for size in sorted({min(int(c), window) for c in b.counts if c}):
                w = windows(b.hashes, size)
                at = np.flatnonzero(b.whole(size) & ((b.counts[own[: len(w)]] == size) | (size == window)))
                keys = _keyed(w[at], size)
                prints = np.zeros(len(at), dtype=np.uint64)
                if size == window and len(at):
                    prints = sliding_min(windows(b.hashes, gram), window - gram + 1)[at]
                second = _check(b.hashes, size)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.full(len(at), size, dtype=np.int32)), pa.array(prints.view(np.int64)), pa.array([b.ids[k] for k in own[at]], pa.string())],
                    names=["key", "second", "size", "print", "item"],
                )

    return run


class _Known:
    """Broadcast windows of the items: sorted keys with their items, fingerprints, and the lengths under ``window``."""

    def __init__(self, rows: list, window: int) -> None:
        by_key: dict[tuple[int, int], set] = {}
        for r in rows:
            by_key.setdefault((r["key"], r["second"]), set()).add(r["item"])
        self.items = {k: sorted(v) for k, v in by_key.items()}
        self.prints = np.unique(np.array([r["print"] for r in rows if r["size"] == window], dtype=np.int64).view(np.uint64))
        self.short = {n: np.unique(np.array([r["key"] for r in rows if r["size"] == n], dtype=np.int64).view(np.uint64)) for n in sorted({r["size"] for r in rows} - {window})}


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _candidates(b: Block, window: int, gram: int, prints: np.ndarray) -> np.ndarray:
    """Starts of the windows whose own fingerprint is among ``prints``: the extension of each hit."""
    grams = windows(b.hashes, gram)
    picked = np.flatnonzero(_picks(grams, window - gram + 1)) if len(grams) >= window - gram + 1 else np.empty(0, dtype=np.int64)
    hit = picked[_among(grams[picked], prints)]
    if not len(hit):
        return np.empty(0, dtype=np.int64)
    starts = np.unique((hit[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts <= len(b.hashes) - window)]
    return starts[b.whole(window)[starts]]


def _row(b: Block, k: int, covered: np.ndarray, items: set) -> tuple:
    ids = sorted(items)
    n, hit = int(b.counts[k]), int(covered.sum())
    return (b.ids[k], n, hit, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])


def _marked(b: Block, found: dict[int, list[tuple[int, int, list]]]) -> pa.RecordBatch:
    """A row for each text; found: by text, its (start, size, items)."""
    out = []
    for k in range(len(b.ids)):
        covered, items = np.zeros(int(b.counts[k]), dtype=bool), set()
        for start, size, names in found.get(k, ()):
            covered[start : start + size] = True
            items.update(names)
        out.append(_row(b, k, covered, items))
    return _batch(out)


def _found(b: Block, have: _Known, window: int, gram: int) -> dict[int, list]:
    """By text, the (start, size, items) of its windows that occur in items."""
    found: dict[int, list] = {}
    own = b.owner()

    def note(starts: np.ndarray, keys: np.ndarray, size: int) -> None:
        second = _check(b.hashes, size)[starts]
        for s, *key in zip(starts.tolist(), keys.view(np.int64).tolist(), second.view(np.int64).tolist(), strict=True):
            if names := have.items.get(tuple(key)):
                k = int(own[s])
                found.setdefault(k, []).append((s - int(b.starts[k]), size, names))

    starts = _candidates(b, window, gram, have.prints)
    if len(starts):
        note(starts, _keyed(windows(b.hashes, window)[starts], window), window)
    for size, keys in have.short.items():
        all_keys = _keyed(windows(b.hashes, size), size)
        at = np.flatnonzero(_among(all_keys, keys) & b.whole(size))
        if len(at):
            note(at, all_keys[at], size)
    return found


def _by_broadcast(known, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            b = Block(rows["id"], rows["text"], [letter_words(t) for t in rows["text"]], cache)
            yield _marked(b, _found(b, known.value, window, gram))

    return run


def _clean_rows(known, window: int, gram: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in parts(batches, text):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            b = Block([None] * len(texts), texts, [letter_words(t) for t in texts], cache)
            marked = _marked(b, _found(b, known.value, window, gram))
            yield part.filter(pc.invert(marked.column(6)))

    return run


def _doc_prints(window: int, gram: int, short: list[int]):
    """(k, id) for each fingerprint, and for each window of the lengths of short items; once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            b = Block(rows["id"], rows["text"], [letter_words(t) for t in rows["text"]], cache)
            own, keys, owners = b.owner(), [], []
            grams = windows(b.hashes, gram)
            if len(grams) >= window - gram + 1:
                at = np.flatnonzero(_picks(grams, window - gram + 1))
                keys.append(grams[at])
                owners.append(own[at])
            for size in short:
                at = np.flatnonzero(b.whole(size))
                keys.append(_keyed(windows(b.hashes, size)[at], size))
                owners.append(own[at])
            if keys:
                pair = np.unique(np.stack([np.concatenate(keys), np.concatenate(owners).astype(np.uint64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array([b.ids[int(k)] for k in pair[:, 1]], pa.int64())], names=["k", "id"])

    return run


def _near_windows(window: int, gram: int):
    """(key, second, id) for the windows around the fingerprints that a text shares with some item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            for one, text, shared in zip(rows["id"], rows["text"], rows["shared"], strict=True):
                b = Block([one], [text], [letter_words(text)], cache)
                starts = _candidates(b, window, gram, np.sort(np.array(shared, dtype=np.int64).view(np.uint64)))
                keys = np.empty((0, 2), dtype=np.uint64)
                if len(starts):
                    keys = np.unique(np.stack([_keyed(windows(b.hashes, window)[starts], window), _check(b.hashes, window)[starts]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, k].copy().view(np.int64)) for k in (0, 1)), pa.array([one] * len(keys), pa.int64())], names=["key", "second", "id"])

    return run


def _by_join(window: int):
    """A row for each text, given the windows (``hits``: size, key, second, items) that its id shares with items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            b = Block(rows["id"], rows["text"], [letter_words(t) for t in rows["text"]], cache)
            found: dict[int, list] = {}
            for k, hits in enumerate(rows["hits"]):
                lo, n = int(b.starts[k]), int(b.counts[k])
                for size in {h["size"] for h in hits or ()}:
                    names = {(h["key"], h["second"]): h["items"] for h in hits if h["size"] == size}
                    own = b.hashes[lo : lo + n]
                    keys = zip(_keyed(windows(own, size), size).view(np.int64).tolist(), _check(own, size).view(np.int64).tolist(), strict=True)
                    found.setdefault(k, []).extend((s, size, names[key]) for s, key in enumerate(keys) if key in names)
            yield _marked(b, found)

    return run


def decontaminate(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: words, words hit, the items that occur in it, and whether a twentieth of it is hit.

    Returns ``doc_id, n_words, n_hit, n_items, items (sorted as strings), items_sha256, contaminated``.

    A null or empty text has no words and is never contaminated; a null or empty item has no window; null ids of
    items are ignored. Repeated rows each get their row. An empty ``bench`` marks nothing, an empty ``docs`` gives no
    row. Other columns are not looked at. A null ``doc_id`` stays null. A text of any length is read whole, in the
    memory of one block; items that hold the same window all count, so there is no tie to break.
    """
    d = docs.select(inner_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known, value = _item_windows(bench, item_id_col, item_text_col, window, gram, broadcast_windows)
    if value is not None:
        out = mapped(d, _by_broadcast(value, window, gram), RESULT.replace("doc_id", "id"))
    else:
        out = _joined(d, materialize(known, "decontam-items"), window, gram)
    return out.select(outer_id("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")


def _item_windows(bench: DataFrame, id_col: str, text_col: str, window: int, gram: int, bound: int):
    """The items' windows as a table, and broadcast where there are at most ``bound`` of them (else None)."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    items = bench.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    known = mapped(items, _item_rows(window, gram), "key long, second long, size int, print long, item string").distinct()
    head = known.limit(bound + 1).collect() if bound > 0 else []
    small = bound > 0 and len(head) <= bound
    return known, bench.sparkSession.sparkContext.broadcast(_Known(head, window)) if small else None


def _joined(d: DataFrame, known: DataFrame, window: int, gram: int) -> DataFrame:
    short = [r[0] for r in known.where(F.col("size") < window).select("size").distinct().collect()]  # at most window - 1
    prints = materialize(mapped(d, _doc_prints(window, gram, short), "k long, id long"), "decontam-prints")
    of_items = known.select(F.when(F.col("size") == window, F.col("print")).otherwise(F.col("key")).alias("k"), (F.col("size") < window).alias("whole")).distinct()
    shared = materialize(prints.join(of_items, "k"), "decontam-shared")
    near = mapped(d.join(shared.where("not whole").groupBy("id").agg(F.collect_set("k").alias("shared")), "id"), _near_windows(window, gram), "key long, second long, id long")
    per_key = known.groupBy("key", "second", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))
    long = near.distinct().join(per_key, ["key", "second"])
    short_ones = shared.where("whole").select(F.col("k").alias("key"), "id").distinct().join(per_key, "key")
    hits = long.unionByName(short_ones).distinct()
    per_doc = hits.groupBy("id").agg(F.collect_list(F.struct("key", "second", "size", "items")).alias("hits"))
    return mapped(d.join(per_doc, "id", "left"), _by_join(window), RESULT.replace("doc_id", "id"))


def keep_clean(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that :func:`decontaminate` does not mark, with all their columns as they are."""
    known, value = _item_windows(bench, item_id_col, item_text_col, window, gram, broadcast_windows)
    if value is not None:
        return mapped(docs, _clean_rows(value, window, gram, text_col), docs.schema)
    rows = keyed_texts(docs, id_col, text_col, "decontam-rows")  # each judged by its own text, whatever its id
    bad = _joined(rows.select(F.col("key").alias("id"), "text"), materialize(known, "decontam-items"), window, gram).where("contaminated").select(F.col("id").alias("key"))
    return without(docs, rows.select("key", "own", "print").join(bad, "key").select("own", "print"), id_col, text_col)
