"""Packing token sequences by non-negative least squares.

Documents become ids; one longer than a sequence is cut into full pieces and a rest. Only the histogram of lengths,
as many numbers as a sequence has tokens, goes to the driver. There, shallow combinations of lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what is left over is packed greedily, still by length. Which piece fills which slot is arithmetic
on the piece's rank among those of its length, so pieces are placed where they are, without being gathered.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mapwright.storage import materialize

from .pieces import PairTable
from .words import BLOCK_BYTES, blocks, mapped

TOKENS = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words that are split one by one, and lower-cased parts of them, whose ids a task keeps at a time: some 40 and 15 MB. Nearly every word of a text is
#: a new one, so that more of them save no time, and what they leave in a worker's memory stays for the stages after.
CACHE_WORDS, CACHE_PARTS = 200_000, 100_000
#: How the tokenizer cuts a text into parts, and its normal form.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
#: Characters beyond ASCII that are neither changed by the normal form, once lowered, nor anything but a letter end at U+024F.
STRANGE = re.compile("[\x80-\xbf×÷ɐ-\U0010ffff]")
SPACE, LETTER, DIGIT, OTHER = range(4)
#: Parts are merged in rows of so many bytes; longer ones are left to the library.
WIDTHS = (6, 9, 12, 16, 32, 64)
#: No such pair.
NONE = np.int32(2**31 - 1)
#: Lengths on which combinations of three and of four are built.
TRIPLE_GRID, QUAD_GRID, SWEEPS = 64, 16, 12


class WordIds(dict):
    """The ids of a word as little-endian unsigned 32-bit bytes.

    The tokenizer splits at white space, so a text's ids are those of its words in order. Words that are letters below
    U+0250 once lowered are split into letters and one closing full stop or comma here and go to the BPE model directly; all others go through
    the whole tokenizer. Both caches are emptied when full.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        #: U+0000-U+00FF as the byte-level alphabet writes them
        self.letters = {k: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(k))[0][0] for k in range(33, 127)}
        self.whole_letters: dict[int, str] = {}
        for k in range(128, 0x250):
            self.whole_letters[k] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(k))[0][0]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            spelled = part if part.isascii() else part.translate(self.whole_letters)
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8")
        end = text[-1]
        stem = (text[:-1] if end in ".," else text).lower()
        if stem.isalpha() and max(stem) < "ɐ":  # after lower-casing, which may lead beyond
            ids = self._part(stem) + (self._part(end) if end in ".," else b"")
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


class TextIds:
    """The ids of a block of texts at once, as little-endian unsigned 32-bit bytes.

    A block is one array of bytes. It falls into the parts that the tokenizer would cut; equal parts are found by their bytes,
    and the merges are done once for each different part: of every part the leftmost pair of least rank in one round. In texts
    with letters from U+0250 on, other signs beyond ASCII or a special token's beginning this holds for the words in ASCII; the
    others go through :class:`WordIds`, as all do if the tokenizer is of another kind.
    """

    def __init__(self, path: str) -> None:
        self.path, self._words = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        #: bytes as the byte-level alphabet writes them
        self.letters = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.known = self._is_known(spec) and all(x in vocab and f"{x}</w>" in vocab for x in self.letters.values())
        if not self.known:
            return
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(*(np.array([vocab[m[k]] for m in merges], dtype=np.int32) for k in (0, 1)))
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.pad = max(vocab.values()) + 1  # stands in no pair
        self.inner = np.array([vocab[self.letters[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[f"{self.letters[b]}</w>"] for b in range(256)], dtype=np.int32)
        self.kind = np.full(256, OTHER, dtype=np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = SPACE
        self.kind[48:58], self.kind[97:123], self.kind[128:] = DIGIT, LETTER, LETTER

    @staticmethod
    def _is_known(spec: dict) -> bool:
        model, cut = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        return (
            (model["type"], model["end_of_word_suffix"], model["ignore_merges"], model["dropout"], model["continuing_subword_prefix"] or "") == ("BPE", "</w>", False, None, "")
            and len({tuple(m) for m in model["merges"]}) == len(model["merges"])
            and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == NORMAL
            and [x.get("type") for x in cut] == ["Split", "ByteLevel"]
            and (cut[0]["pattern"], cut[0]["invert"], cut[0]["behavior"]) == ({"Regex": CUT}, True, "Removed")
            and all("<|" in x["content"] for x in spec["added_tokens"])
        )

    @property
    def words(self) -> WordIds:
        if self._words is None:
            self._words = WordIds(self.path)
        return self._words

    def of_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a long one is cut at white space, so that what is held beside it stays bounded."""
        plain: list[bytes] = []
        laid: list[list[bytes | int]] = []  # of each text its ids, or places in ``plain``
        for text in texts:
            own: list[bytes | int] = []
            for raw, is_plain in self._runs(text or ""):
                if not is_plain:
                    own.append(self.words.of(raw))
                elif len(raw) > BLOCK_BYTES:
                    own += [self._block([cut])[0] for cut in slices(raw.encode("utf-8"), BLOCK_BYTES)]
                else:
                    own.append(len(plain))
                    plain.append(raw.encode("utf-8"))
            laid.append(own)
        done = self._block(plain)
        return [b"".join(done[x] if isinstance(x, int) else x for x in own) for own in laid]

    def _runs(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text as runs of words that are met as arrays, lowered, and of words that are not."""
        low = text.lower()
        if not self.known:
            yield text, False
        elif "<|" not in text and (low.isascii() or not STRANGE.search(low)):
            yield low, True
        else:
            for is_plain, some in groupby(text.encode("utf-8", "replace").split(), lambda word: word.isascii() and b"<|" not in word):
                run = b" ".join(some).decode("utf-8")
                yield run.lower() if is_plain else run, is_plain

    def _parts(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and lengths of the parts; ``raw`` begins and ends with white space."""
        kind = self.kind[raw]
        start = np.zeros(len(raw), dtype=bool)
        start[1:] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        # 's and the like: one apostrophe, and as many of the letters after it
        at = np.flatnonzero((raw[:-2] == ord("'")) & start[:-2] & (kind[1:-1] == LETTER))
        first, second = raw[at + 1], raw[at + 2]
        one = np.isin(first, np.frombuffer(b"stmd", dtype=np.uint8))
        two = (second == ord("e")) & ((first == ord("r")) | (first == ord("v"))) | (second == ord("l")) & (first == ord("l"))
        at, after = at[one | two], (at + 2 + two)[one | two]
        start[at + 1] = False
        start[after[kind[after] == LETTER]] = True
        begins = np.flatnonzero(start)
        return begins, np.flatnonzero((kind[:-1] != SPACE) & (start | (kind == SPACE))[1:]) + 1 - begins

    def _block(self, raws: list[bytes]) -> list[bytes]:
        joined = b" " + b" ".join(raws) + b" " * (WIDTHS[-1] + 1)
        raw = np.frombuffer(joined, dtype=np.uint8)
        begins, lengths = self._parts(raw)
        bounds = np.searchsorted(begins, np.cumsum([1, *(len(r) + 1 for r in raws)]))
        if not len(begins):
            return [b""] * len(raws)
        # equal parts are found by two numbers of 8 bytes each, longer ones by their bytes
        eights = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=joined, strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        low, high = eights[begins] & masks[np.minimum(lengths, 8)], eights[np.minimum(begins + 8, len(eights) - 1)] & masks[np.clip(lengths - 8, 0, 8)]
        short = lengths <= 16
        which = np.empty(len(begins), dtype=np.int64)
        firsts, which[short] = distinct(low[short], high[short], lengths[short])
        firsts = np.flatnonzero(short)[firsts]
        if not short.all():
            seen: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(~short).tolist():
                which[k] = seen.setdefault(joined[begins[k] : begins[k] + lengths[k]], [len(firsts) + len(seen), k])[0]
            firsts = np.append(firsts, [k for _, k in seen.values()])
        sizes, counts = lengths[firsts], np.empty(len(firsts), dtype=np.int64)
        order, symbols, least = [], [], 0
        for width in WIDTHS:
            some, least = np.flatnonzero((sizes > least) & (sizes <= width)), width
            if len(some):
                made, counts[some] = self.merge(raw, begins[firsts[some]], sizes[some], width)
                order.append(some)
                symbols.append(made)
        for k in np.flatnonzero(sizes > least).tolist():  # by the library, whose time does not grow with the square of the length
            part = raw[begins[firsts[k]] :][: sizes[k]].tolist()
            made = np.array([t.id for t in self.words.model.tokenize("".join(map(self.letters.__getitem__, part)))], dtype=np.int32)
            order.append(np.array([k]))
            symbols.append(made)
            counts[k] = len(made)
        order = np.concatenate(order)
        at = np.empty(len(firsts), dtype=np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        n = counts[which]
        ends = np.cumsum(n)
        ids = np.concatenate(symbols)[np.arange(ends[-1]) + np.repeat(at[which] - (ends - n), n)].astype("<u4").tobytes()
        cuts = (4 * np.append(0, ends)[bounds]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the finished parts one after another, and how many each has; no part is longer than ``width``."""
        place = np.arange(width)
        letters = raw[begins[:, None] + place]
        symbols = np.full((len(begins), width + 2), self.pad, dtype=np.int32)
        ends = lengths[:, None] - 1
        symbols[:, 1:-1] = np.where(place < ends, self.inner[letters], np.where(place == ends, self.last[letters], self.pad))
        flat = symbols.reshape(-1)
        ranks = np.append(self._rank(flat[:-1], flat[1:]), NONE)  # every row ends with a symbol that stands in no pair
        rank = ranks.reshape(symbols.shape)
        after, before = np.arange(1, len(flat) + 1, dtype=np.int32), np.arange(-1, len(flat) - 1, dtype=np.int32)
        row = np.arange(len(begins))
        while len(row):
            at = rank[row].argmin(axis=1) + row * (width + 2)
            going = ranks[at] != NONE
            row, at = row[going], at[going]
            gone = after[at]
            right, left = after[gone], before[at]
            flat[at] = self.made[ranks[at]]
            flat[gone], ranks[gone] = self.pad, NONE
            after[at], before[right] = right, at
            ranks[at], ranks[left] = self._rank(flat[at], flat[right]), self._rank(flat[left], flat[at])
        stay = symbols != self.pad
        return symbols[stay], stay.sum(axis=1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.find(left, right)
        found[found < 0] = NONE
        return found


def distinct(low: np.ndarray, high: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different (low, high, length), and which of them stands at every place."""
    mixed = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ (high ^ (high >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) ^ lengths.astype(np.uint64)
    _, firsts, which = np.unique(mixed, return_index=True, return_inverse=True)
    there = firsts[which]
    if (low[there] == low).all() and (high[there] == high).all() and (lengths[there] == lengths).all():
        return firsts, which
    _, firsts, which = np.unique(np.stack([low, high, lengths.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
    return firsts, which.reshape(-1)


def slices(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end at white space."""
    gap, begin = re.compile(rb"[\x20\x09-\x0D]"), 0
    while begin < len(raw):
        found = gap.search(raw, begin + size)
        end = found.start() if found else len(raw)
        yield raw[begin:end]
        begin = end


def _pieces(path: str | None, name: str, tokens: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            ids_of = TextIds(public_tokenizers.path(name))
        else:
            ids_of = TextIds(path)
        ranks, task = [0] * (tokens + 1), TaskContext.get().partitionId()
        for rows in blocks(batches):
            out: list[tuple] = []
            for one, ids in zip(rows["id"], ids_of.of_all(rows["text"]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, tokens):
                    part = ids[4 * start : 4 * (start + tokens)]
                    length = len(part) // 4
                    out.append((one, start, length, zlib.crc32(part), n, task, ranks[length]))
                    ranks[length] += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"])

    return run


def combinations(lengths: np.ndarray, tokens: int) -> list[tuple[int, ...]]:
    """Combinations of two to four lengths that fill a sequence: all pairs, and more on a grid of common lengths."""
    have = set(lengths.tolist())
    out = {(tokens - a, a) for a in have if tokens - a in have and a <= tokens - a}
    for depth, grid in ((3, TRIPLE_GRID), (4, QUAD_GRID)):
        few = lengths[np.unique(np.linspace(0, len(lengths) - 1, min(grid, len(lengths))).astype(int))].tolist() if len(lengths) else []
        sums = [(a,) for a in few]
        for _ in range(depth - 2):
            sums = [(*c, a) for c in sums for a in few if a <= c[-1] and sum(c) + a < tokens]
        out |= {tuple(sorted((*c, tokens - sum(c)), reverse=True)) for c in sums if tokens - sum(c) in have}
    return sorted(out)


def nnls(columns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that nearly minimises the squared distance of the columns' sum to ``counts``, by coordinate descent."""
    left, x = counts.astype(float).copy(), np.zeros(len(columns))
    shaped = []
    for c in columns:
        lengths, times = np.unique(c, return_counts=True)
        shaped.append((lengths, times.astype(float), float((times**2).sum())))
    for _ in range(sweeps):
        moved = 0.0
        for j, (lengths, times, norm) in enumerate(shaped):
            step = max(-x[j], float(left[lengths] @ times) / norm)
            if step:
                x[j] += step
                left[lengths] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def plan(histogram: dict[int, int], tokens: int = TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in falling order, repeats) whose pieces are those of the histogram: fitted, then greedy on the rest."""
    counts = np.zeros(tokens + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = [((tokens,), int(counts[tokens]))] if counts[tokens] else []
    counts[tokens] = 0
    columns = combinations(np.flatnonzero(counts), tokens)
    fitted = nnls(columns, counts)
    for j in np.argsort(-fitted, kind="stable").tolist():
        lengths, times = np.unique(columns[j], return_counts=True)
        n = min(int(fitted[j]), int((counts[lengths] // times).min()))
        if n > 0:
            out.append((columns[j], n))
            counts[lengths] -= n * times
    while counts.any():
        free, taken = tokens, []
        avail = counts.copy()
        while (fits := np.flatnonzero(avail[: free + 1])).size:
            best = int(fits[-1])
            rest = free - best
            if rest and best != free:  # a pair that fills the gap exactly is better than the longest piece
                pairs = fits[(avail[free - fits] > (fits * 2 == free)) & (fits < free)] if len(fits) > 1 else fits[:0]
                best = int(pairs[-1]) if pairs.size else best
            taken.append(best)
            avail[best] -= 1
            free -= best
        lengths, times = np.unique(taken, return_counts=True)
        n = int((counts[lengths] // times).min())
        out.append((tuple(sorted(taken, reverse=True)), n))
        counts[lengths] -= n * times
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, times, first sequence, offset): which ranks of a length fill which sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in planned:
        offset, k = 0, 0
        while k < len(lengths):
            times = lengths.count(lengths[k])
            lo = used.get(lengths[k], 0)
            used[lengths[k]] = lo + n * times
            rows.append((lengths[k], lo, lo + n * times, times, sequence, offset))
            offset += lengths[k] * times
            k += times
        sequence += n
    return rows


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, tokenizer_path: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and offset there.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Sequences hold at most ``tokens``
    ids; a document is cut only where it is longer than that. Ids are the tokenizer's, with ``end_id`` at the end.

    A null or empty text is a document of the end id alone. Repeated rows are packed each; a null ``doc_id`` stays
    null. A text of any length is read whole, in the memory of one block. Pieces of one length are told apart by task
    and place in it, so which of them fills which place is not fixed. An empty table gives no row. Other columns are
    not looked at. ``tokenizer_path`` is a file that every
    executor can read; without it, ``tokenizer`` names a file of the installed public tokenizers.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"
    pieces = materialize(mapped(d, _pieces(tokenizer_path, tokenizer, tokens, end_id), schema), "packing-pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``tokens`` rows
    table = d.sparkSession.createDataFrame(slots(plan(histogram, tokens)), "slot_length long, lo long, hi long, times long, first long, at long")
    placed = pieces.join(bases, ["length", "task"]).withColumn("r", F.col("rank") + F.col("base"))
    hit = (F.col("length") == F.col("slot_length")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))
    # the table of slots is bounded by the sequence's length, whatever the number of pieces
    return placed.join(F.broadcast(table), hit).select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.expr("first + (r - lo) div times").alias("sequence_id"),
        F.expr("at + length * ((r - lo) % times)").alias("offset"),
    )
