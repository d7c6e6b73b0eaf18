"""Encoding and decoding with a SentencePiece BPE model, by vectorised rounds of merges.

A block of texts is one flat array of symbols. It falls into words: runs in which every two neighbouring characters
stand side by side in some piece of the vocabulary, so that no merge ever crosses from one word to the next. In each
round a segmented minimum finds the best rank among the pairs of each word, the leftmost pairs of that rank are merged
in all words at once, and the array is compacted; words without a pair left go out. Rounds end when no word is left.

The library is asked for the pieces and scores of the model file only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks, mapped

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: No such pair; ranks are positions in the order of falling scores.
NONE = np.int32(2**31 - 1)
_LOST = "�".encode()


class PairTable:
    """The numbers of pairs of symbols, by open addressing in numpy arrays: whole arrays are looked up at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.bits = max(4, int(len(keys) * 16).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rows = np.zeros(1 << self.bits, dtype=np.int32)
        self.probes, todo, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[at] == -1
            first = np.unique(np.where(free, at, -1), return_index=True)
            won = first[1][first[0] >= 0]
            self.keys[at[won]], self.rows[at[won]] = keys[todo[won]], todo[won]
            left_over = np.ones(len(todo), dtype=bool)
            left_over[won] = False
            todo, at = todo[left_over], (at[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row of each pair, -1 where there is none."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.rows[at], np.int32(-1))
        open_ = np.flatnonzero((met != keys) & (met != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            met = self.keys[at[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (met != -1)]
        return out


class PieceModel:
    """Vocabulary of a model file as arrays.

    Symbols are the ids of the vocabulary, and beyond them numbers for characters that stand in pieces without being
    one, and one number for all other characters. A merge is *settled* if no pair with its product ranks before it: all
    its occurrences in a word may then be merged in one round.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        kinds = [(sp.is_byte(k), sp.is_control(k) or sp.is_unknown(k)) for k in range(n)]
        if any(sp.is_unused(k) for k in range(n)) or sp.normalize(" a  ﬁ ") != f"{SPACE*2}a{SPACE*2}ﬁ{SPACE}":
            raise ValueError("only models without normalisation and unused pieces, with a leading space, are supported")
        plain = [k for k in range(n) if not any(kinds[k])]
        self.ids = {names[k]: k for k in plain}
        self.size, self.unknown = n, sp.unk_id()
        chars = sorted({c for p in self.ids for c in p})
        symbol = dict(self.ids)
        for c in chars:
            symbol.setdefault(c, n + len(symbol))
        self.other = n + len(symbol) + 1
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.byte_fallback = all(kinds[k][0] for k in self.byte_ids)
        #: symbol of each character
        self.of_char = np.full(0x110000, self.other, dtype=np.int32)
        self.of_char[[ord(c) for c in chars]] = [symbol[c] for c in chars]

        scores = {k: sp.get_score(k) for k in plain}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found = [(symbol[p[:k]], symbol[p[k:]], order[scores[i]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, ranks, made = (np.array(c, dtype=np.int32) for c in (zip(*found, strict=True) if found else [[]] * 4))
        self.pairs = PairTable(left, right)
        self.ranks, self.made = np.append(ranks, NONE), np.append(made, 0).astype(np.int32)
        near = sorted({(symbol[p[k]], symbol[p[k + 1]]) for p in self.ids for k in range(len(p) - 1)})
        self.near = PairTable(*(np.array(c, dtype=np.int32) for c in zip(*near, strict=True)))
        own_rank = np.full(self.other + 1, -1, dtype=np.int32)
        own_rank[made] = ranks
        self.settled = np.ones(self.other + 1, dtype=bool)
        for part in (left, right):
            self.settled[part[ranks <= own_rank[part]]] = False

        # runs of spaces, when their pieces share the last rank and no other piece has two spaces in a row
        widths = sorted(len(p) for p in self.ids if not p.strip(SPACE))
        last, alone = max(order.values()), all(not p.strip(SPACE) for p in self.ids if SPACE * 2 in p)
        self.last_rank, self.most = NONE, max(widths, default=0)
        if len(widths) > 1 and alone and all(order[scores[self.ids[SPACE * k]]] == last for k in widths[1:]):
            tails = [self._run(k, set(widths)) for k in range(4 * self.most)]
            if all(tails[k] == [self.most] + tails[k - self.most] for k in range(self.most, len(tails))):
                self.last_rank = np.int32(last)
                #: [length of the rest of a run, place in it]: the piece that begins there, or -1
                self.tails = np.full((self.most, self.most), -1, dtype=np.int32)
                for k in range(self.most):
                    for place, width in zip(np.cumsum([0, *tails[k]]).tolist(), tails[k], strict=False):
                        self.tails[k, place] = self.ids[SPACE * width]

        self.names = np.array([str(k) for k in range(n)], dtype=object)
        unknown = " ⁇ ".encode()
        self.surface = np.array([bytes([names[k][1:-1] and int(names[k][3:5], 16)]) if kinds[k][0] else unknown if k == self.unknown else b"" if kinds[k][1] else names[k].replace(SPACE, " ").encode() for k in range(n)], dtype=object)
        self.is_byte = np.array([k[0] for k in kinds])
        self.is_silent = np.array([k[1] and i != self.unknown for i, k in enumerate(kinds)])

    @staticmethod
    def _run(length: int, widths: set[int]) -> list[int]:
        """Widths of the pieces of a run of spaces, all of one rank: the leftmost pair first."""
        run = [1] * length
        while (k := next((k for k in range(len(run) - 1) if run[k] + run[k + 1] in widths), None)) is not None:
            run[k : k + 2] = [run[k] + run[k + 1]]
        return run

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks[self.pairs.find(left, right)]

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the finished words, in order, and the index into them of each word's first; ``starts`` are the words' starts."""
        word = np.arange(len(starts))
        rank = np.full(len(symbols), NONE, dtype=np.int32)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[starts[1:] - 1] = NONE
        out_symbols, out_words, out_lengths = [], [], []
        while len(symbols):
            lengths = np.diff(starts, append=len(symbols))
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                gone = np.repeat(done, lengths)
                out_symbols.append(symbols[gone])
                out_words.append(word[done])
                out_lengths.append(lengths[done])
                symbols, rank, word, lengths, best = symbols[~gone], rank[~gone], word[~done], lengths[~done], best[~done]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            owner = np.repeat(np.arange(len(starts)), lengths)
            hit_owner = owner[hits]
            made = self.made[self.pairs.find(symbols[hits], symbols[hits + 1])]
            drop = np.zeros(len(symbols), dtype=bool)
            # a word whose best pairs are spaces of the last rank: blocks of the longest run of spaces, in one go
            spaces = best[hit_owner] == self.last_rank
            if spaces.any():
                at, hits, made, hit_owner = hits[spaces], hits[~spaces], made[~spaces], hit_owner[~spaces]
                inside = np.zeros(len(symbols) + 1, dtype=bool)
                inside[at] = inside[at + 1] = True
                at = np.flatnonzero(inside[:-1])
                first = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
                run = np.cumsum(first) - 1
                begin = np.flatnonzero(first)
                size = np.diff(begin, append=len(at))[run]
                place = np.arange(len(at)) - begin[run]
                full = size - size % self.most
                piece = np.where(place % self.most == 0, self.ids[SPACE * self.most], -1)
                rest = place >= full
                piece[rest] = self.tails[size[rest] % self.most, (place - full)[rest]]
                symbols[at] = piece
                drop[at[piece < 0]] = True
                rank[at] = NONE  # what stands beside a run of spaces makes no piece with it
                before = at[first & (at > 0)] - 1
                rank[before] = np.where(owner[before] == owner[before + 1], self.rank(symbols[before], symbols[before + 1]), NONE)
            if len(hits):
                # of hits side by side every second one; of merges that are not settled only a word's first
                fresh = np.concatenate([[True], np.diff(hits) > 1])
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
                leading = np.concatenate([[True], hit_owner[1:] != hit_owner[:-1]])
                loose = np.zeros(len(starts), dtype=bool)
                loose[hit_owner[~self.settled[made]]] = True
                take = ((np.arange(len(hits)) - begin) % 2 == 0) & (leading | ~loose[hit_owner])
                hits, made = hits[take], made[take]
                symbols[hits] = made
                drop[hits + 1] = True
                rank[hits] = rank[hits + 1]  # a word's end stays one
            stay = ~drop
            moved = np.cumsum(stay) - 1
            symbols, rank, owner = symbols[stay], rank[stay], owner[stay]
            starts = moved[starts]
            if len(hits):
                at = moved[hits]
                for near in (at[at + 1 < len(symbols)], at[at > 0] - 1):
                    near = near[owner[near] == owner[near + 1]]
                    rank[near] = self.rank(symbols[near], symbols[near + 1])
        if not out_symbols:
            return np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        symbols, word, lengths = np.concatenate(out_symbols), np.concatenate(out_words), np.concatenate(out_lengths)
        order = np.argsort(word, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        ends = np.cumsum(lengths[order])
        take = np.arange(len(symbols)) + np.repeat(begins - (ends - lengths[order]), lengths[order])
        return symbols[take], np.concatenate([[0], ends])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        codes = np.frombuffer("".join(whole).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        if not len(codes):
            return [np.empty(0, dtype=np.int32) for _ in texts]
        symbols = self.of_char[codes]
        begins = np.cumsum(sizes) - sizes
        cut = np.ones(len(codes), dtype=bool)
        cut[1:] = self.near.find(symbols[:-1], symbols[1:]) < 0
        cut[begins[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        strange = symbols >= self.size  # such a character is a word of its own unless it stands in some piece
        merged, at = self.merge(symbols.copy(), starts)
        bounds = at[np.searchsorted(starts, np.append(begins, len(codes)))]
        if strange.any():
            merged, bounds = self._spelled(merged, bounds, codes[strange])
        return [merged[bounds[k] : bounds[k + 1]] for k in range(len(texts))]

    def _spelled(self, merged: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes, or the unknown id."""
        at = np.flatnonzero(merged >= self.size)
        # characters that merged into a piece are gone; those left are taken in order
        left = codes if len(codes) == len(at) else self._left(merged[at], codes)
        if not self.byte_fallback:
            merged[at] = self.unknown
            same = np.zeros(len(merged), dtype=bool)
            same[1:] = (merged[1:] == self.unknown) & (merged[:-1] == self.unknown)
            same[bounds[:-1][bounds[:-1] < len(merged)]] = False
            return merged[~same], np.concatenate([[0], np.cumsum(~same)])[bounds]
        raw = [chr(c).encode() for c in left.tolist()]
        times = np.ones(len(merged), dtype=np.int64)
        times[at] = [len(r) for r in raw]
        out = np.repeat(merged, times)
        out[np.repeat(merged >= self.size, times)] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out, np.concatenate([[0], np.cumsum(times)])[bounds]

    def _left(self, symbols: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which of the characters without a piece are still there: those of the one common symbol all are, others by symbol."""
        kept, k = [], 0
        for s in symbols.tolist():
            while self.of_char[codes[k]] != s:
                k += 1
            kept.append(codes[k])
            k += 1
        return np.array(kept, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids in UTF-8; the leading space of the first piece goes, bytes that are no character become U+FFFD."""
        ids = ids[~self.is_silent[ids]]
        if not len(ids):
            return b""
        parts = self.surface[ids].tolist()
        if ids[0] != self.unknown and not self.is_byte[ids[0]] and parts[0].startswith(b" "):
            parts[0] = parts[0][1:]
        raw = b"".join(parts)
        if self.is_byte[ids].any():
            try:
                raw.decode()
            except UnicodeDecodeError:
                return self._mended(parts, self.is_byte[ids].tolist())
        return raw

    @staticmethod
    def _mended(parts: list[bytes], is_byte: list[bool]) -> bytes:
        out, k = [], 0
        while k < len(parts):
            if not is_byte[k]:
                out.append(parts[k])
                k += 1
                continue
            size = 1
            for size in (4, 3, 2, 1):
                one = b"".join(parts[k : k + size])
                if len(one) == size and all(is_byte[k : k + size]):
                    try:
                        if len(one.decode()) == 1:
                            break
                    except UnicodeDecodeError:
                        continue
            else:
                one, size = _LOST, 1
            out.append(one)
            k += size
        return b"".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _place(path: str | None, name: str) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, model_name: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every whole text, without begin and end, and the text that they decode to.

    A null text is an empty one: no ids, an empty decoded text. Repeated rows and rows without an id stay as they are;
    an empty table gives no row; other columns are not looked at. A text of any length is encoded whole, in the memory
    of one block. ``model_path`` is a file that every executor can read; without it, ``model_name`` names a file of the
    installed public tokenizers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(_place(model_path, model_name))
        for rows in blocks(batches):
            ids = m.encode(rows["text"])
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(i).decode() for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(d, run, "doc_id long, ids array<int>, decoded string")


def decode_ids(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None, model_name: str = MODEL) -> DataFrame:
    """``doc_id, decoded``: the text of every list of ids; null ids, lists and numbers out of the vocabulary count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(_place(model_path, model_name))
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                known = np.array([i for i in ids or [] if i is not None and 0 <= i < m.size], dtype=np.int64)
                texts.append(m.decode(known).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return d.mapInArrow(run, "doc_id long, decoded string")


def piece_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, model_name: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text: :func:`encode_texts` as digests made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(_place(model_path, model_name))
        for rows in blocks(batches):
            counts, of_ids, of_texts = [], [], []
            for ids in m.encode(rows["text"]):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(m.names[ids].tolist()).encode()).hexdigest())
                of_texts.append(hashlib.sha256(m.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(d, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
