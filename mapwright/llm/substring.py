"""Removal of repeated passages by level-wise doubling.

A window is ``window`` consecutive words; a word goes if it lies in a window that also starts earlier (in a smaller
document, or earlier in its own). Lengths double from a short one up to the window's (5, 10, 20 words; see
:func:`lengths`). A passage repeated at one length is extended to twice that length, and what occurs once there is
dropped, until no candidates survive or the window's length is reached, where all windows around a survivor are compared.

Of the shorter lengths only anchors are looked at: in each window, the passage of half its length with the least hash,
and in an anchor, of each shorter length the least hash of its passages. Equal windows have equal anchors at every
length, so no repeated window is lost.

Each task first compares the passages of the rows that it has at hand: of one that many texts share, only its first
occurrences in the task go to the shuffle, and the others are known to be repeats at once. So a hot passage adds a row
or two for each task to its key's group. No group is ever gathered; what travels to a document is its own windows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.storage import discard, materialize

from .words import Block, WordHashes, blocks, inner_id, mapped, mixed, outer_id, sliding_min, space_words, windows

WINDOW = 20
#: So many ids are broadcast to keep only matching texts before a join; with more, the texts are joined unfiltered.
BROADCAST_IDS = 1_000_000

#: A task remembers so many passages.
SEEN = 150_000
#: The shortest length is under twice this.
SHORTEST = 4

_PLACE_BITS = 26
#: Makes a second, independent hash of a window.
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_SPACE = r"[\x20\x09-\x0D]+"


def _anchors(b: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a full window its anchor's start (-1 where no full window starts), and the half hashes."""
    half = size // 2
    halves = windows(b.hashes, half)
    span = size - half + 1
    n = len(b.hashes)
    anchor = np.full(n, -1, dtype=np.int64)
    starts = np.flatnonzero(b.whole(size))
    if not len(starts):
        return anchor, halves
    order = halves >> np.uint64(_PLACE_BITS)  # the least by these bits; of equal ones the leftmost
    if len(halves) < 1 << _PLACE_BITS:
        low = np.uint64((1 << _PLACE_BITS) - 1)
        least = sliding_min((order << np.uint64(_PLACE_BITS)) | np.arange(len(halves), dtype=np.uint64), span)
        anchor[starts] = (least[starts] & low).astype(np.int64)
        return anchor, halves
    least = sliding_min(order, span)
    for k in reversed(range(span)):
        hit = starts[order[starts + k] == least[starts]]
        anchor[hit] = hit + k
    return anchor, halves


def lengths(window: int) -> list[int]:
    """The lengths under the window's, each half of the next, from the shortest of at least SHORTEST words."""
    out = [window // 2]
    while out[0] >= 2 * SHORTEST:
        out.insert(0, out[0] // 2)
    return out


class _Seen:
    """Keys (sorted) that a task has met, with a value each, a bounded number: if there are too many, those met once
    are forgotten, then all. What is forgotten costs rows in the shuffle, never results."""

    def __init__(self, *kinds: type) -> None:
        self.keys, self.again = np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
        self.values = [np.empty(0, dtype=k) for k in kinds]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and where."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)), at

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        """New keys, sorted."""
        where = np.searchsorted(self.keys, keys)
        self.keys, self.again = np.insert(self.keys, where, keys), np.insert(self.again, where, False)
        self.values = [np.insert(v, where, n) for v, n in zip(self.values, values, strict=True)]
        if len(self.keys) > SEEN:
            few = self.again if self.again.sum() <= SEEN // 2 else np.zeros(len(self.keys), dtype=bool)
            self.keys, self.again, self.values = self.keys[few], self.again[few], [v[few] for v in self.values]


def _flags(keys: np.ndarray, owner: np.ndarray, seen: _Seen) -> np.ndarray:
    """For passages with their texts, three bits: 1, it goes to its key's group, as the key's first two texts of the task
    do with all their rows; 2, it counts there, once a text; 4, its key is known to occur in some other text."""
    order = np.lexsort((owner, keys))
    k, o = keys[order], owner[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    other = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    texts = np.bincount(group, weights=other)
    met, at = seen.find(k[starts])
    before = np.where(met, seen.values[0][at] if len(seen.keys) else 0, 0).astype(np.int64)
    lead = o == o[starts][group]  # the rows of the first text here
    out = np.zeros(len(keys), dtype=np.int32)
    out[order] = (lead & (before < 2)[group]).astype(np.int32) | (((before > 0) | (texts > 1))[group].astype(np.int32) << 2)
    out[order[starts[before < 2]]] |= 2
    np.add.at(seen.values[0], at[met], 1)
    seen.again[at[met]] = True
    seen.add(k[starts][~met], np.ones(int((~met).sum()), dtype=np.int64))
    return out


def _anchor_rows(size: int):
    """(id, flags, h0, h1, ...) for the anchors of each text: of every length the least hash inside it, shortest first;
    flags: three bits a length (:func:`_flags`)."""
    steps = lengths(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), [_Seen(np.int64) for _ in steps]
        for rows in blocks(batches):
            b = Block(rows["id"], rows["text"], [space_words(t) for t in rows["text"]], cache)
            anchor, halves = _anchors(b, size)
            at = np.unique(anchor[anchor >= 0])
            if not len(at):
                continue
            owner = b.owner()[at]
            # each once a text; one with two places in its text repeats at every length
            order = np.lexsort((halves[at], owner))
            own, half = owner[order], halves[at][order]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (half[1:] != half[:-1])])
            inside = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
            at, owner = at[order[new]], own[new]
            keys = [sliding_min(windows(b.hashes, n), steps[-1] - n + 1)[at] for n in steps[:-1]] + [halves[at]]
            flags = np.zeros(len(at), dtype=np.int64)
            for j, k in enumerate(keys):
                flags |= (_flags(k, owner, seen[j]) | inside.astype(np.int64) << 2).astype(np.int64) << (3 * j)
            ids = np.array(b.ids, dtype=np.int64)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(flags), *(pa.array(k.view(np.int64)) for k in keys)], names=["id", "flags", *(f"h{j}" for j in range(len(steps)))])

    return run


def _repeated(d: DataFrame, window: int) -> DataFrame:
    """``id, repeated``: by text the anchors that are repeated at every length up to half the window's."""
    steps = lengths(window)
    last = len(steps) - 1
    rows = mapped(d, _anchor_rows(window), "id long, flags long, " + ", ".join(f"h{j} long" for j in range(len(steps))))
    below: list[DataFrame] = []
    for j, words in enumerate(steps):
        goes, counts, known = (F.expr(f"shiftright(flags, {3 * j + bit}) & 1") for bit in range(3))
        # rows beyond the first of a task are dealt out by themselves: their key's group need not see them
        keyed = rows.withColumn("counts", counts).withColumn("k", F.when(goes == 1, F.col(f"h{j}")).otherwise(F.xxhash64(f"h{j}", "id")))
        again = keyed.withColumn("n", F.sum("counts").over(W.partitionBy("k"))).where((known == 1) | (F.col("n") > 1))
        rows = again.select("id", "flags", *(f"h{i}" for i in range(min(j + 1, last), last + 1)))
        if j < last:
            rows = materialize(rows, f"repeats-{words}-words")
            discard(*below)
            below = [rows]
            if rows.isEmpty():  # no candidates survive
                break
    out = materialize(rows.groupBy("id").agg(F.collect_set(f"h{last}").alias("repeated")), "repeats-anchors")
    discard(*below)
    return out


def _tags(texts: list[str]) -> np.ndarray:
    """Tells texts apart that share an id; under 2**31."""
    return np.array([zlib.crc32(t.encode("utf-8", "replace")) >> 1 for t in texts], dtype=np.int64)


def _window_rows(size: int):
    """(k, k2, id, at, known): full windows whose anchor occurs again, first occurrence by text; at: its tag and start.
    k and k2 are independent hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), _Seen(np.uint64, np.int64)
        for rows in blocks(batches):
            b = Block(rows["id"], rows["text"], [space_words(t) for t in rows["text"]], cache)
            anchor, halves = _anchors(b, size)
            starts = np.flatnonzero(anchor >= 0)
            own, ok = b.owner(), np.zeros(len(halves), dtype=bool)
            for k, repeated in enumerate(rows["repeated"]):
                lo, hi = int(b.starts[k]), int(b.starts[k] + b.counts[k])
                ok[lo:hi] = np.isin(halves[lo:hi], np.array(repeated, dtype=np.int64).view(np.uint64))
            starts = starts[ok[anchor[starts]]]
            if not len(starts):
                continue
            keys, tags = windows(b.hashes, size)[starts], _tags(rows["text"])
            second = windows(mixed(b.hashes ^ _SECOND), size)[starts]
            docs = np.array(b.ids, dtype=np.int64)[own[starts]]
            order = np.lexsort((starts, docs, second, keys))
            k, k2, d, s = keys[order], second[order], docs[order], starts[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])
            again = np.concatenate([[False], ~new[1:] & (d[1:] == d[:-1])])  # later in the same text: found again there
            heads, group = np.flatnonzero(new), np.cumsum(new) - 1
            least = _least_seen(seen, k[heads], k2[heads], d[heads])[group]
            known, keep = d > least, ~again
            k, k2, d, s, known, owner = k[keep], k2[keep], d[keep], s[keep], known[keep], own[s[keep]]
            spread = k ^ (d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64) + np.uint64(1))
            at = (tags[owner] << 32) | (s - b.starts[owner])
            yield pa.RecordBatch.from_arrays([pa.array(np.where(known, spread, k).view(np.int64)), pa.array(k2.view(np.int64)), pa.array(d), pa.array(at), pa.array(known)], names=["k", "k2", "id", "at", "known"])

    return run


def _least_seen(seen: _Seen, k: np.ndarray, k2: np.ndarray, d: np.ndarray) -> np.ndarray:
    """By window (sorted) the least text that the task has met with it, these texts included."""
    met, at = seen.find(k)
    if len(seen.keys):
        met &= seen.values[0][at] == k2
        np.minimum.at(seen.values[1], at[met], d[met])
        seen.again[at[met]] = True
    least = np.where(met, seen.values[1][at], d) if len(seen.keys) else d.copy()
    fresh = np.concatenate([[True], k[1:] != k[:-1]]) & ~seen.find(k)[0]
    seen.add(k[fresh], k2[fresh], d[fresh])
    return least


def _kept(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in blocks(batches):
            words = [space_words(t) for t in rows["text"]]
            b = Block(rows["id"], rows["text"], words, cache)
            keys, tags = windows(b.hashes, size), _tags(rows["text"])
            out: list[tuple] = []
            for k, at in enumerate(rows["at"]):
                lo, n = int(b.starts[k]), int(b.counts[k])
                gone = np.zeros(n + 1, dtype=np.int64)
                own = keys[lo : lo + n - size + 1] if n >= size else keys[:0]
                # windows that another text has earlier, wherever they start here, and those that start here before
                at = np.array(at or [], dtype=np.int64)
                bad = np.isin(own, own[at[at >> 32 == tags[k]] & 0xFFFFFFFF])
                order = np.argsort(own, kind="stable")
                later = np.concatenate([[False], own[order][1:] == own[order][:-1]]) if n >= size else np.empty(0, dtype=bool)
                bad[order[later]] = True
                starts = np.flatnonzero(bad)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + size, -1)
                covered = np.cumsum(gone[:n]) > 0
                left = b" ".join(w for w, c in zip(words[k], covered.tolist(), strict=True) if not c)
                out.append((b.ids[k], rows["whole"][k], int(covered.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], names=["id", "whole", "n_removed", "kept_sha256", "kept"])

    return run


def _only(d: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``d`` whose id is in ``ids``, without moving the other texts while there are few ids."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return d.join(F.broadcast(ids), "id", "left_semi")
    return d


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: its words, those removed, and the digest of the words left (joined by one space).

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``with_text``, ``kept``: null where nothing was
    removed (the text is kept as it is), else the words left.

    Words are runs of characters other than U+0020 and U+0009 to U+000D. A null or empty text has no words. Rows that
    share a ``doc_id`` do not count as earlier than each other. A null ``doc_id`` counts as smaller than any other.
    Texts under ``window`` words keep all; one of any length is read whole, in the memory of one block. An empty table
    gives no row. Other columns are not looked at.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    d = docs.select(inner_id(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    repeated = _repeated(d, window)
    ids = repeated.select("id")
    full = mapped(_only(d, ids).join(repeated, "id"), _window_rows(window), "k long, k2 long, id long, at long, known boolean")
    bad = full.withColumn("least", F.min("id").over(W.partitionBy("k", "k2"))).where("known or id > least")
    # texts whose only repeats are inside themselves have no such row, but are looked at all the same
    spans = materialize(bad.groupBy("id").agg(F.collect_list("at").alias("at")), "repeats-spans")
    touched = _only(d, ids).join(ids, "id", "left_semi").join(spans, "id", "left")
    norm = F.regexp_replace("text", _SPACE, " ")
    norm = F.trim(norm)
    plain = d.select("id", F.when(norm == "", 0).otherwise(F.size(F.split(norm, " "))).cast("long").alias("n_words"), F.sha2(norm.cast("binary"), 256).alias("whole"))
    whole = touched.withColumn("whole", F.sha2(norm.cast("binary"), 256))
    changed = mapped(whole, _kept(window), "id long, whole string, n_removed long, kept_sha256 string, kept string").where("n_removed > 0")
    changed = (changed if with_text else changed.drop("kept")).dropDuplicates(["id", "whole"])
    out = plain.join(changed, ["id", "whole"], "left").select(
        outer_id("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        *(["kept"] if with_text else []),
    )
    return out
