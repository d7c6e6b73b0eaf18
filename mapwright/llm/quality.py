"""Quality classifier from weak labels.

Heuristic labellers vote "poor" or abstain on each document. Expectation-maximisation over the counts of vote patterns
(a bounded number of them) estimates how often each labeller fires on poor and on good documents, without any label.
The posterior of a document's votes is its label; a bounded sample of so labelled documents trains a linear scorer on
hashed features, and the scorer, not the votes, decides on every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapwright.storage import materialize

from .words import Block, WordHashes, blocks, inner_id, mapped, outer_id, parts, space_words, windows

#: The scorer is fitted on about so many documents; poor and good ones weigh the same in all.
SAMPLE_ROWS = 20_000
#: A task keeps the features of so many words at a time.
CACHE_SHAPES = 60_000
DIMENSIONS = 1 << 12
THRESHOLD = 0.5

LABELLERS = ("symbol_words", "symbols", "capitals", "shouting", "repeats", "one_word", "bars", "stutter")

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#$%&*<>=@^_`{|}~\\/+[]")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_SHAPES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Shapes(dict):
    """A word's shape (letters, capitals, digits, signs; runs as one) as a feature's place."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_SHAPES:
            self.clear()
        self[word] = place = xxhash.xxh3_64_intdigest(b"shape " + _RUNS.sub(rb"\1", word.translate(_SHAPES))[:24]) % DIMENSIONS
        return place


def _place(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) % DIMENSIONS


class Reader:
    """Measures, votes and hashed features of a block of texts."""

    def __init__(self) -> None:
        self.cache, self.shapes = WordHashes(), _Shapes()

    def measures(self, texts: list) -> tuple[np.ndarray, Block]:
        """By text: shares of symbol words, symbols, capitals, words ending in !, repeated 5-grams, the commonest word,
        bars, words equal to the one before; and the number of words."""
        words = [space_words(t) for t in texts]
        b = Block([None] * len(texts), texts, words, self.cache)
        grams = windows(b.hashes, 5)
        out = np.zeros((len(texts), 9))
        for k, (text, ws) in enumerate(zip(texts, words, strict=True)):
            n = len(ws)
            if not n:
                continue
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
            hist = np.bincount(raw, minlength=256)
            symbols, upper, lower = hist[_SYMBOLS].sum(), hist[_UPPER].sum(), hist[_LOWER].sum() + (hist[128:].sum() + 1) // 2
            lo = int(b.starts[k])
            own = grams[lo : lo + n - 4] if n >= 5 else grams[:0]
            counts = np.unique(b.hashes[lo : lo + n], return_counts=True)[1]
            out[k] = (
                np.mean([w[-1:] in b"#$%&*" for w in ws]) if symbols > 0.01 * len(raw) else 0.0,
                symbols / len(raw),
                upper / max(1, upper + lower),
                int(hist[33]) / n,
                1 - len(np.unique(own)) / len(own) if len(own) else 0.0,
                counts.max() / n,
                int(hist[124]) / n,
                float(np.mean(b.hashes[lo + 1 : lo + n] == b.hashes[lo : lo + n - 1])) if n > 1 else 0.0,
                n,
            )
        return out, b

    @staticmethod
    def votes(m: np.ndarray) -> np.ndarray:
        """By text and labeller: whether it says poor."""
        enough = m[:, 8] >= 5
        v = np.stack([m[:, 0] > 0.3, m[:, 1] > 0.08, m[:, 2] > 0.5, m[:, 3] > 0.4, m[:, 4] > 0.5, (m[:, 5] > 0.4) & (m[:, 8] >= 20), m[:, 6] > 0.1, m[:, 7] > 0.2], axis=1)
        return v & enough[:, None]

    def features(self, m: np.ndarray, words: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By text: places and values; the shares of its word shapes, and its measures in steps."""
        out = []
        for k, ws in enumerate(words):
            places, counts = np.unique(np.fromiter(map(self.shapes.__getitem__, ws), dtype=np.int64, count=len(ws)), return_counts=True)
            steps = [_STEPS[j][min(9, int(10 * m[k, j]))] for j in range(8)]
            out.append((np.concatenate([places, steps]), np.concatenate([counts / max(1, len(ws)), np.ones(8)])))
        return out


_STEPS = [[_place(f"step {j} {s}") for s in range(10)] for j in range(8)]


def fit_labellers(patterns: list[tuple[int, int]], labellers: int, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over (votes as bits, count): the share of poor documents, and each labeller's rate on poor and on good ones."""
    bits = np.array([[p >> k & 1 for k in range(labellers)] for p, _ in patterns], dtype=float).reshape(-1, labellers)
    n = np.array([c for _, c in patterns], dtype=float)
    post = np.where(bits.any(axis=1), 0.9, 0.02)
    prior, poor, good = 0.1, np.full(labellers, 0.3), np.full(labellers, 0.01)
    for _ in range(rounds if len(n) else 0):
        a, c = n * post, n * (1 - post)
        prior = (a.sum() + 0.1) / (n.sum() + 1)
        new = (a @ bits + 0.3) / (a.sum() + 1), (c @ bits + 0.01) / (c.sum() + 1)
        moved = max(abs(new[0] - poor).max(), abs(new[1] - good).max())
        poor, good = new
        post = posterior(bits, prior, poor, good)
        if moved < 1e-9:
            break
    return prior, poor, good


def posterior(bits: np.ndarray, prior: float, poor: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The chance that a document with these votes is poor."""
    gain = np.log(prior / (1 - prior)) + bits @ np.log(poor / good) + (1 - bits) @ np.log((1 - poor) / (1 - good))
    return 1 / (1 + np.exp(-np.clip(gain, -50, 50)))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, dimensions: int, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft targets by full-batch AdaGrad; the last weight is the bias."""
    w, seen = np.zeros(dimensions + 1), np.full(dimensions + 1, 1e-6)
    if not rows:
        return w
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    places, values = np.concatenate([p for p, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows])
    weight = np.where(targets > 0.5, 0.5 / max(1e-9, (targets > 0.5).sum()), 0.5 / max(1e-9, (targets <= 0.5).sum()))
    for _ in range(rounds):
        z = np.bincount(owner, values * w[places], minlength=len(rows)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - targets) * weight
        grad = ridge * w
        grad[:-1] += np.bincount(places, values * miss[owner], minlength=dimensions)
        grad[-1] = miss.sum()
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
    return w


def _vote_rows(rate: float):
    """(pattern, n, key, places, shares): the vote patterns of a block with their counts, and documents drawn by a hash."""
    most = np.uint64(min((1 << 64) - 1, int(rate * (1 << 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for rows in blocks(batches):
            m, b = reader.measures(rows["text"])
            v = reader.votes(m)
            pattern = (v.astype(np.int64) << np.arange(v.shape[1])).sum(axis=1)
            keys = np.array([xxhash.xxh3_64_intdigest(f"{one} {text}".encode("utf-8", "replace")) for one, text in zip(rows["id"], rows["text"], strict=True)], dtype=np.uint64)
            drawn = np.flatnonzero((m[:, 8] > 0) & (keys <= most))
            f = reader.features(m[drawn], [b.words[k] for k in drawn.tolist()])
            seen, counts = np.unique(pattern[m[:, 8] > 0], return_counts=True)
            none = [None] * len(seen)
            cols = [
                pa.array(np.concatenate([seen, pattern[drawn]])),
                pa.array(np.concatenate([counts, np.zeros(len(drawn), dtype=np.int64)])),
                pa.array([*none, *keys[drawn].view(np.int64).tolist()], pa.int64()),
                pa.array([*none, *(p for p, _ in f)], pa.list_(pa.int32())),
                pa.array([*none, *(x for _, x in f)], pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["pattern", "n", "key", "places", "shares"])

    return run


class Model:
    """The fitted scorer; scores are chances of being poor."""

    def __init__(self, weights: np.ndarray, prior: float, poor: np.ndarray, good: np.ndarray) -> None:
        self.weights, self.prior, self.poor, self.good = weights, prior, poor, good

    def _chances(self, features: list, words: np.ndarray) -> np.ndarray:
        z = np.array([float(np.asarray(v) @ self.weights[p]) for p, v in features]) + self.weights[-1]
        z = np.where(words > 0, z, 50.0)  # nothing to read
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def scores(self, reader: Reader, texts: list) -> np.ndarray:
        m, b = reader.measures(texts)
        return self._chances(reader.features(m, b.words), m[:, 8])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``docs``: labellers on the vote patterns of all documents, the scorer on about ``sample_rows`` of them.

    The sample is drawn by a hash of id and text, so equal tables give equal models.
    """
    d = docs.select(inner_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rate = min(1.0, sample_rows / max(1, docs.count()))
    rows = materialize(mapped(d, _vote_rows(rate), "pattern long, n long, key long, places array<int>, shares array<float>"), "quality-votes")
    patterns = rows.groupBy("pattern").agg(F.sum("n").alias("n")).where("n > 0").collect()  # at most 2**labellers rows
    prior, poor, good = fit_labellers(sorted((r["pattern"], r["n"]) for r in patterns), len(LABELLERS))
    drawn = rows.where("places is not null").orderBy("key", "pattern").limit(2 * sample_rows).select("pattern", "places", "shares").collect()
    bits = np.array([[r["pattern"] >> k & 1 for k in range(len(LABELLERS))] for r in drawn], dtype=float).reshape(-1, len(LABELLERS))
    targets = posterior(bits, prior, poor, good) if drawn else np.empty(0)
    return Model(fit_linear([(np.array(r["places"]), np.array(r["shares"])) for r in drawn], targets, DIMENSIONS), prior, poor, good)


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for rows in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array(model.value.scores(reader, rows["text"]))], names=["id", "score"])

    return run


def _good_rows(model, text: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for part in parts(batches, text):
            scores = model.value.scores(reader, part.column(part.schema.get_field_index(text)).to_pylist())
            yield part.filter(pa.array(scores < threshold))

    return run


def score_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, poor (chance of being poor, 0 to 1), kept``.

    A null or empty text, or one of white space, is poor (1.0). Each row is judged by its own text, so repeated rows
    get equal scores; a chance equal to ``threshold`` is poor. A null ``doc_id`` stays null. A text of any length is read
    whole, in the memory of one block. An empty table gives no row. Other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, sample_rows=sample_rows))
    d = docs.select(inner_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = mapped(d, _score_rows(model), "id long, score double")
    return out.select(outer_id("id").alias("doc_id"), F.round("score", 6).alias("poor"), (F.col("score") < threshold).alias("kept"))


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`score_quality` keeps, with all their columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, sample_rows=sample_rows))
    return mapped(docs, _good_rows(model, text_col, threshold), docs.schema)
