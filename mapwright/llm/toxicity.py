"""Toxicity classifier from weak supervision.

Voters are lexicons and patterns: a seed list of insults; words, beginnings and endings of words that are mined from
labelled documents, dealt to voters by kind and strength; and patterns of how many and how dense these are. A voter says
toxic, clean, or nothing. All documents vote, labelled or not, and their vote patterns are counted. A generative model
with one tree of dependencies given the class (the strongest conditional mutual information) is fitted to the counts by
EM: it learns every voter's rates, and so its accuracy, and the correlations from how the voters agree. The gold label is
one more voter, which says nothing on most documents and whose accuracy is learned like any other. The posteriors of a
bounded sample train a linear classifier on the mined features of a document's distinct words; its scale and bias are
then set on labelled documents that the fit has not seen.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordHashes, blocks, inner_id, mapped, mixed, outer_id, space_words, windows

#: About so many labelled documents, and others, are fitted on at most.
SAMPLE_ROWS, MORE_ROWS = 6_000, 2_000
THRESHOLD = 0.3
FOLDS = 3
#: A feature is mined if its likelihood ratio statistic is over this; by chance it would be in about one of a million.
MINED = 24.0
#: Features with log-odds over this are strong.
STRONG = 3.0
#: Mined features that stand in the same documents make a topic; so many, and how alike (as a cosine) they are at least.
TOPICS, ALIKE = 6, 0.15

# Common insults in four languages.
SEED = (
    "clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless",
    "abschaum", "arschloch", "blöd", "depp", "dumm", "dummkopf", "idioten", "trottel", "versager", "wertlos",
    "abruti", "connard", "crétin", "débile", "imbécile", "minable", "ordure", "pathétique", "raclure", "stupide",
    "asqueroso", "basura", "cretino", "escoria", "estúpido", "gilipollas", "idiota", "imbécil", "patético", "payaso",
)

#: A task keeps the features of so many words.
CACHE_CHUNKS = 100_000

_FLIPS = (0x3C6EF372FE94F82B, 0x510E527FADE682D1, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
_WORDS = regex.compile(r"[\p{L}\p{M}']+").findall


def words_of(chunk: str) -> list[str]:
    return _WORDS(chunk)


def parts_of(word: str) -> list[str]:
    """A word's features: itself, its beginnings of 3 to 7 letters and its ending of 5, where it is longer."""
    out = ["w" + word]
    out += [f"{k}{word[:k]}" for k in (3, 4, 5, 6, 7) if len(word) > k]
    if len(word) > 5:
        out.append("e" + word[-5:])
    return out


def support(base: float) -> int:
    """In so many documents a feature must stand for its statistic to pass MINED, were all of them toxic.

    Half the base rate is taken, as it differs somewhat from fold to fold.
    """
    return 1 if base <= 0 else int(MINED / (2 * np.log(2 / min(base, 0.5)))) + 1


class Coded:
    """Texts as pairs (document, feature) of numbers, each pair once.

    Seeds are always numbered; other features from ``least`` documents on, as rarer ones cannot be mined.
    """

    def __init__(self, texts: list, least: int = 1) -> None:
        codes: dict[str, int] = {}
        words = [np.array(sorted({codes.setdefault(c, len(codes)) for c in (t or "").lower().split()}), dtype=np.int32) for t in texts]
        often = np.bincount(np.concatenate(words), minlength=len(codes)).tolist() if codes else []
        # most features stand in one document or two; counts by a hash, never too low, tell which can be dropped before they are numbered
        counts = np.zeros(1 << 22, dtype=np.int64)
        for c, n in zip(codes, often, strict=True):
            for p in {p for w in words_of(c) for p in parts_of(w)}:
                counts[zlib.crc32(p.encode()) & (1 << 22) - 1] += n
        numbers = {"w" + w: k for k, w in enumerate(SEED)}
        sizes, flat = np.zeros(len(codes), dtype=np.int64), array("i")
        for k, c in enumerate(codes):
            own = {numbers.setdefault(p, len(numbers)) for w in words_of(c) for p in parts_of(w) if p in numbers or counts[zlib.crc32(p.encode()) & (1 << 22) - 1] >= least}
            sizes[k] = len(own)
            flat.extend(own)
        of_words, starts = np.frombuffer(flat, dtype=np.int32), np.cumsum(sizes) - sizes
        owner, part = [], []
        for k, own in enumerate(words):
            long = sizes[own]
            at = np.repeat(starts[own] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            own = np.unique(of_words[at]) if len(at) else np.empty(0, dtype=np.int32)
            owner.append(np.full(len(own), k, dtype=np.int32))
            part.append(own)
        self.n, self.names = len(texts), list(numbers)
        self.owner = np.concatenate(owner) if owner else np.empty(0, dtype=np.int32)
        self.part = np.concatenate(part) if part else np.empty(0, dtype=np.int32)
        self.seeds = np.arange(len(SEED))

    def mine(self, y: np.ndarray, share: np.ndarray) -> np.ndarray:
        """By feature its log-odds, where it is far commoner in toxic documents than by chance; else 0. A document
        counts by its share."""
        n = np.bincount(self.part, weights=share[self.owner], minlength=len(self.names))
        k = np.bincount(self.part, weights=(share * y)[self.owner], minlength=len(self.names))
        n1, total = float((share * y).sum()), float(share.sum())
        if not 0 < n1 < total:
            return np.zeros(len(self.names))
        base, rate = n1 / total, np.clip(k / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        g = 2 * (k * np.log(rate / base) + (n - k) * np.log((1 - rate) / (1 - base)))
        odds = np.log((k + 0.5) / (n1 + 1)) - np.log((n - k + 0.5) / (total - n1 + 1))
        mined = np.where((g > MINED) & (rate > base) & (odds > 1.5), odds, 0.0)
        mined[self.seeds] = np.maximum(mined[self.seeds], 2.0)
        return mined

    def hits(self, mined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of mined features, numbered anew, and the features' old numbers."""
        few = np.flatnonzero(mined > 0)
        new = np.full(len(self.names), -1, dtype=np.int64)
        new[few] = np.arange(len(few))
        on = new[self.part] >= 0
        return self.owner[on].astype(np.int64), new[self.part[on]], few

    def topics(self, mined: np.ndarray, share: np.ndarray) -> np.ndarray:
        """By mined feature its topic: that of the likest leader. Leaders are the commonest features unlike those before."""
        owner, part, few = self.hits(mined)
        weight = np.sqrt(share)[owner]
        size = np.bincount(part, weights=weight**2, minlength=len(few))
        order = np.lexsort((np.array([self.names[k] for k in few]), -size)) if len(few) else np.empty(0, dtype=np.int64)
        leaders: list[np.ndarray] = []
        best, topic = np.zeros(len(few)), np.zeros(len(few), dtype=np.int64)
        while len(leaders) < TOPICS and (best < ALIKE).any():
            lead = next(k for k in order if best[k] < ALIKE)
            docs = np.zeros(self.n)
            docs[owner[part == lead]] = 1
            like = np.bincount(part, weights=weight**2 * docs[owner], minlength=len(few)) / np.sqrt(np.maximum(size * size[lead], 1e-12))
            like[lead] = 2.0
            topic, best = np.where(like > best, len(leaders), topic), np.maximum(best, like)
            leaders.append(docs)
        return topic

    def fit_linear(self, mined: np.ndarray, targets: np.ndarray, share: np.ndarray, rounds: int = 1000, rate: float = 0.5, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
        """Logistic regression on soft targets over the mined features (AdaGrad, ridge penalty): weights, bias."""
        owner, part, few = self.hits(mined)
        on = share[owner] > 0
        owner, at = owner[on], part[on]
        w, bias, seen, seen_b = np.zeros(len(few)), 0.0, np.full(len(few), 1e-8), 1e-8
        weight = share / max(1e-9, share.sum())
        for _ in range(rounds):
            z = np.bincount(owner, w[at], minlength=self.n) + bias
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) * weight
            grad, grad_b = np.bincount(at, miss[owner], minlength=len(few)) + ridge * w, miss.sum()
            seen, seen_b = seen + grad**2, seen_b + grad_b**2
            w -= rate * grad / np.sqrt(seen)
            bias -= rate * grad_b / np.sqrt(seen_b)
        return w, bias

    def logits(self, fitted: tuple[np.ndarray, float], mined: np.ndarray) -> np.ndarray:
        owner, part, _ = self.hits(mined)
        return np.bincount(owner, fitted[0][part], minlength=self.n) + fitted[1]


#: A seed lexicon, two lexicons (words, and their beginnings and endings) for each topic, two patterns; then the gold label.
VOTERS = 1 + 2 * TOPICS + 2
_GOLD = VOTERS


class Lexicon:
    """The mined features with their log-odds, as voters; it remembers what counts of a bounded number of words."""

    def __init__(self, odds: dict[str, float], topics: dict[str, int] | None = None) -> None:
        self.odds = odds
        self.group = {f: 1 + 2 * (topics or {}).get(f, 0) + (f[0] != "w") for f in odds}
        self.seeds, self.known = {"w" + w for w in SEED}, {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def hits(self, chunks: set[str]) -> set[str]:
        """The features of a text's distinct words that count."""
        out: set[str] = set()
        for c in chunks:
            own = self.known.get(c)
            if own is None:
                if len(self.known) >= CACHE_CHUNKS:
                    self.known.clear()
                self.known[c] = own = tuple(p for w in words_of(c) for p in parts_of(w) if p in self.odds)
            if own:
                out.update(own)
        return out

    def votes(self, text: str | None) -> list[int]:
        """2 (toxic), 0 (clean) or 1 (nothing) by voter; a lexicon never says clean, and nothing is what most say."""
        chunks = set((text or "").lower().split())
        hits = self.hits(chunks)
        out = [1] * VOTERS
        for f in hits:
            out[self.group[f]] = 2
            if f in self.seeds:
                out[0] = 2
        strong = sum(self.odds[f] > STRONG for f in hits)
        out[-2] = 2 if strong >= 3 else 0 if not hits else 1
        out[-1] = 2 if strong > 0.01 * len(chunks) else 0 if not hits else 1
        return out


def code_of(votes: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(votes))


def votes_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(VOTERS + 1)[None, :] % 3


class LabelModel:
    """P(votes | class) as a tree over the voters given the class, the gold label aside, which depends on the class alone.

    EM over the vote patterns (rows of 0, 1, 2; gold last) and their counts estimates all tables and the share of toxic
    documents. It starts from how many voters say toxic, not from the gold labels. Where there is no gold label that
    voter counts for nothing.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> None:
        self.v, self.n = votes.astype(np.int64), np.asarray(counts, dtype=float)
        said = (self.v[:, :VOTERS] == 2).sum(axis=1)
        post = np.where(said >= 3, 0.95, np.where(said == 2, 0.8, np.where(said == 1, 0.4, 0.02)))
        self.likelihoods: list[float] = []
        for k in range(rounds):
            if k in (0, 5):
                self.parent = self._tree(post)
            self._estimate(post)
            gain, total = self._scores(self.v)
            self.likelihoods.append(float((self.n * total).sum()))
            new = _chance(gain)
            moved, post = float(np.abs(new - post).max()) if len(new) else 0.0, new
            if moved < 1e-7 and k > 5:
                break
        self.post = post

    def _pair(self, post: np.ndarray, a: int, b: int) -> np.ndarray:
        code = self.v[:, a] * 3 + self.v[:, b]
        return np.stack([np.bincount(code, weights=self.n * w, minlength=9).reshape(3, 3) for w in (1 - post, post)])

    def _tree(self, post: np.ndarray) -> list[int]:
        gain = np.zeros((VOTERS, VOTERS))
        for a in range(VOTERS):
            for b in range(a):
                p = self._pair(post, a, b) + 0.1
                p /= p.sum()
                c = p.sum(axis=(1, 2), keepdims=True)
                gain[a, b] = gain[b, a] = (p * np.log(p * c / (p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True)))).sum()
        self.correlation = gain
        parent, inside = [-1] * VOTERS, [0]
        while len(inside) < VOTERS:
            a, b = max(((a, b) for a in inside for b in range(VOTERS) if b not in inside), key=lambda x: gain[x])
            parent[b] = a
            inside.append(b)
        return parent

    def _estimate(self, post: np.ndarray) -> None:
        self.prior = float(((self.n * post).sum() + 0.5) / (self.n.sum() + 1))
        self.tables = []
        for k, p in enumerate(self.parent):
            if p < 0:
                t = np.stack([np.bincount(self.v[:, k], weights=self.n * w, minlength=3) for w in (1 - post, post)]) + 0.2
                self.tables.append(np.log(t / t.sum(axis=1, keepdims=True)))
            else:
                t = self._pair(post, p, k) + 0.2
                self.tables.append(np.log(t / t.sum(axis=2, keepdims=True)))
        # the gold label's rates, where there is one; a few cases are added on which it is right
        on = self.v[:, _GOLD] != 1
        right = [((self.n * w)[on & (self.v[:, _GOLD] == c)].sum() + 9, (self.n * w)[on & (self.v[:, _GOLD] == 2 - c)].sum() + 1) for c, w in ((0, 1 - post), (2, post))]
        clean, toxic = (r / (r + w) for r, w in right)
        self.gold = np.log(np.array([[clean, 1.0, 1 - clean], [1 - toxic, 1.0, toxic]]))

    def _scores(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By pattern the log-odds of toxic, and the log of its chance."""
        both = np.log(np.array([1 - self.prior, self.prior]))[:, None] + self.gold[:, v[:, _GOLD]]
        for k, p in enumerate(self.parent):
            t = self.tables[k]
            both = both + (t[:, v[:, k]] if p < 0 else t[:, v[:, p], v[:, k]])
        top = both.max(axis=0)
        return both[1] - both[0], top + np.log(np.exp(both - top).sum(axis=0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return _chance(self._scores(votes.astype(np.int64))[0])

    def accuracies(self) -> np.ndarray:
        """By voter, gold last: how often it is right where it says something, under the posterior."""
        v = self.v - 1
        right = (self.n[:, None] * np.where(v > 0, self.post[:, None], np.where(v < 0, 1 - self.post[:, None], 0))).sum(axis=0)
        return right / np.maximum(1e-9, (self.n[:, None] * (v != 0)).sum(axis=0))


def _chance(gain: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(gain, -30, 30)))


def calibrate(z: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a z + b))) fits ``y`` (Platt's scaling, by Newton steps)."""
    a, b = 1.0, 0.0
    z = np.clip(z, -30, 30)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(share * (p - y) * z).sum() + 1e-3 * (a - 1), (share * (p - y)).sum()])
        s = share * (p * (1 - p) + 1e-9)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        size = float(np.abs(d).max())
        d *= min(1.0, 2.0 / size) if size > 0 else 1.0
        a, b = a - d[0], b - d[1]
        if size < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """The linear classifier; the score adds up over a document's distinct features."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def scorer(self):
        """A function of a text."""
        lexicon = Lexicon(self.weights)

        def score(text: str | None) -> float:
            z = self.bias + sum(self.weights[p] for p in sorted(lexicon.hits(set((text or "").lower().split()))))
            return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))

        return score


def sketch_of(text: str | None, cache: WordHashes) -> list[int]:
    """Least hashes of a text's runs of five words under a few hash functions; copies have the same ones."""
    h = cache.of(space_words(text, lower=True))
    if not len(h):
        return [0] * len(_FLIPS)
    w = windows(h, min(5, len(h)))
    return [int((mixed(w ^ np.uint64(f)) >> np.uint64(1)).min()) for f in _FLIPS]


def _shares(sketches: np.ndarray) -> np.ndarray:
    """A document's share is one over the number of its near copies: the mean over the hash functions."""
    out = np.zeros(len(sketches))
    for j in range(sketches.shape[1]):
        _, at, size = np.unique(sketches[:, j], return_inverse=True, return_counts=True)
        out += 1 / size[at]
    return out / sketches.shape[1]


class Fit:
    """What is learned from a sample of texts: labels y are 0, 1, or -1 where there is none."""

    def __init__(self, texts: list, y: np.ndarray, sketches: np.ndarray) -> None:
        self.texts, self.y, self.has = texts, y, y >= 0
        self.share = _shares(sketches)
        self.coded = Coded(texts, support(float((self.share * (y == 1)).sum() / max(1e-9, (self.share * self.has).sum()))))
        self.fold = sketches[:, 0] % FOLDS  # copies lie in one fold

    def mine(self, on: np.ndarray) -> np.ndarray:
        return self.coded.mine(np.maximum(self.y, 0), self.share * (on & self.has))

    def lexicon(self, mined: np.ndarray) -> Lexicon:
        few, topics = np.flatnonzero(mined > 0), self.coded.topics(mined, self.share)
        return Lexicon({self.coded.names[k]: float(mined[k]) for k in few}, {self.coded.names[k]: int(t) for k, t in zip(few, topics, strict=True)})

    def votes(self, lexicon: Lexicon, on: np.ndarray) -> np.ndarray:
        """Votes by text; the labels of texts that are not ``on`` are not seen."""
        gold = np.where(on & self.has, 2 * np.maximum(self.y, 0), 1).astype(np.int64)
        return np.concatenate([np.array([lexicon.votes(t) for t in self.texts], dtype=np.int64).reshape(-1, VOTERS), gold[:, None]], axis=1)

    def learn(self, mined: np.ndarray, model: LabelModel, votes: np.ndarray, on: np.ndarray) -> tuple:
        """The linear classifier, from the posteriors of the label model."""
        return self.coded.fit_linear(mined, model.posterior(votes), self.share * on)

    def calibrated(self) -> tuple[float, float]:
        """Scale and bias that suit scores of labelled texts which nothing was learned from."""
        z = np.zeros(len(self.texts))
        for k in range(FOLDS):
            on = self.fold != k
            mined = self.mine(on)
            votes = self.votes(self.lexicon(mined), on)
            fitted = self.learn(mined, LabelModel(votes[on], self.share[on]), votes, on)
            z[~on] = self.coded.logits(fitted, mined)[~on]
        return calibrate(z[self.has], self.y[self.has], self.share[self.has])


def finished(fit: Fit, mined: np.ndarray, lexicon: Lexicon, label_model: LabelModel) -> Model:
    a, b = fit.calibrated()
    every = np.ones(len(fit.texts), dtype=bool)
    w, bias = fit.learn(mined, label_model, fit.votes(lexicon, every), every)
    few = np.flatnonzero(mined > 0)
    return Model({fit.coded.names[k]: a * float(x) for k, x in zip(few, w, strict=True)}, a * bias + b)


def fit_rows(texts: list, y: np.ndarray, sketches: np.ndarray) -> Model:
    """Fit on labelled texts alone."""
    if not len(y) or y.min() == y.max():
        return _level(y)
    fit = Fit(texts, np.asarray(y, dtype=float), sketches)
    every = np.ones(len(texts), dtype=bool)
    mined = fit.mine(every)
    lexicon = fit.lexicon(mined)
    return finished(fit, mined, lexicon, LabelModel(fit.votes(lexicon, every), fit.share))


def _level(y: np.ndarray) -> Model:
    """Without both classes: one score for all."""
    return Model({}, float(np.log((y.sum() + 0.1) / (len(y) - y.sum() + 0.9))))


def _gold(labels: DataFrame, id_col: str, label_col: str, learn: str) -> DataFrame:
    gold = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(learn)
    return gold.groupBy("id").agg(F.max("y").alias("y"))


def _drawn(rows: DataFrame, bound: int, *by: str) -> DataFrame:
    """About ``bound`` rows, drawn by a hash."""
    rate = min(1.0, bound / max(1, rows.count()))
    return rows if rate == 1 else rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for rows in blocks(batches):
        sketches = [sketch_of(t, cache) for t in rows["text"]]
        sets = [" ".join(sorted(set((t or "").lower().split()))) for t in rows["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array(sets), pa.array(rows["y"], pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "words", "y", "sketch"])


def _vote_rows(lexicon):
    """(id, code): the votes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = lexicon.value
        for rows in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array([code_of(have.votes(t)) for t in rows["text"]], pa.int64())], names=["id", "code"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: str = "true", sample_rows: int = SAMPLE_ROWS, more_rows: int = MORE_ROWS) -> Model:
    """Fit on the documents for which the SQL condition ``learn`` on ``id`` holds, with their labels if they have one.

    All of them vote; features are mined from, and the classifier is fitted on, about ``sample_rows`` labelled ones and
    ``more_rows`` others, twice as many at most.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(f"coalesce({learn}, true)")
    gold = _gold(labels, id_col, label_col, learn)
    # the bounds make both samples fit for a broadcast
    labelled = d.join(F.broadcast(_drawn(gold, sample_rows, "id").limit(2 * sample_rows)), "id").select("id", "text", "y").limit(2 * sample_rows)
    others = _drawn(d, more_rows, "id", "text").limit(2 * more_rows).join(gold, "id", "left_anti").select("id", "text", F.lit(None).cast("int").alias("y"))
    rows = [r for part in (labelled, others) for r in mapped(part, _word_sets, "id long, words string, y int, sketch array<long>").collect()]
    rows.sort(key=lambda r: (r["y"] is None, r["id"] is None, r["id"] or 0, r["words"]))
    y = np.array([-1.0 if r["y"] is None else float(r["y"]) for r in rows])
    if not (y == 0).any() or not (y == 1).any():
        return _level(y[y >= 0])
    own = Fit([r["words"] for r in rows], y, np.array([r["sketch"] for r in rows], dtype=np.int64).reshape(len(rows), len(_FLIPS)))
    del rows
    mined = own.mine(np.ones(len(y), dtype=bool))
    lexicon = own.lexicon(mined)
    votes = mapped(d, _vote_rows(spark.sparkContext.broadcast(lexicon)), "id long, code long").join(gold, "id", "left")
    # a lexicon has two votes, a pattern and the gold label three: of the possible patterns few occur
    whole = F.col("code") + F.coalesce(2 * F.col("y"), F.lit(1)) * 3**VOTERS
    counts = votes.groupBy(whole.alias("code")).agg(F.count("*").alias("n")).collect()
    counts.sort(key=lambda r: r["code"])
    codes = np.array([r["code"] for r in counts], dtype=np.int64)
    return finished(own, mined, lexicon, LabelModel(votes_of(codes), np.array([r["n"] for r in counts])))


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for rows in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array([score(t) for t in rows["text"]], pa.float64())], names=["id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: str = "true", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, more_rows: int = MORE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, score (0 to 1), predicted (0 or 1)``.

    The label model counts the votes of all documents; features are mined from about ``sample_rows`` labelled ones, and
    the linear classifier is trained on these and about ``more_rows`` others.

    Scores depend on the text alone, so repeated rows get equal ones; a null or empty text gets the score of a text
    without words. Labels with a null id or value are ignored; with several for one id, toxic wins. Without labels of
    both classes every score is the same; a score equal to ``threshold`` is toxic. A null ``doc_id`` stays null. A text of
    any length is read whole, in the memory of one block. An empty table gives no row. Other columns are
    not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, learn=learn, sample_rows=sample_rows, more_rows=more_rows))
    d = docs.select(inner_id(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = mapped(d, _score_rows(model), "id long, score double")
    return out.select(outer_id("id").alias("doc_id"), F.round("score", 9).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
