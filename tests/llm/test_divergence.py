"""The distances of sources against a plain count with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mapwright.llm import divergence


def plain(rows, min_docs, top):
    """rows: (text, lang, source)."""
    docs = [(t or "", la or "", s or "") for t, la, s in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)) for t, _, _ in docs]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), w in zip(docs, words, strict=True):
        seen[lang].update(set(w))
        counts[lang, source].update(w)
        counts[lang, None].update(w)
    out = []
    for lang in {la for _, la, _ in docs}:
        kept = {t for t, n in seen[lang].items() if n >= min_docs}
        sources = {s for _, la, s in docs if la == lang}
        p = {}
        for g in [*sources, None]:
            total = sum(counts[lang, g][t] for t in kept)
            p[g] = {t: 1 + 10**9 * (counts[lang, g][t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, r) for r, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(seed, n, langs=("en", "de", None), sources=7):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + k % 26)}{'é' * (k % 3)}{'Q' * (k % 2)}{'x' * (k // 26)}" for k in range(90)]
    rows = [(" ".join(rng.choice(vocab[: rng.randrange(5, 90)]) + rng.choice([" ", "-", "1", "\x7f", "\0"]) for _ in range(rng.randrange(60))), rng.choice(langs), f"s{rng.randrange(sources)}") for _ in range(n)]
    return [*rows, (None, "en", None), ("", "xx", "a"), ("only here", "xx", "b"), ("@[`{ 123", "xx", None), *rows[:4], ("z" * 3000 + " wa", "en", "s0")]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("min_docs", "top", "cells", "task"), [(3, 5, 100_000, 800_000), (1, 50, 20, 40), (30, 50, 7, 1)])
def test_divergence_is_the_plain_result(spark, monkeypatch, min_docs, top, cells, task):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "TASK_CELLS", task)
    rows = rows_of(min_docs, 150)
    docs = spark.createDataFrame([(k, *r, 1, "c") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, n string").repartition(5)
    assert got(divergence.divergence(docs, min_docs=min_docs, top=top)) == plain(rows, min_docs, top)


def test_empty_and_wordless_tables(spark):
    schema = "text string, lang string, source string"
    assert got(divergence.divergence(spark.createDataFrame([], schema))) == []
    rows = [(None, None, None), ("1 2", None, "a"), ("3", None, "b")]
    assert got(divergence.divergence(spark.createDataFrame(rows, schema))) == plain(rows, 30, 50)


def test_terms_with_one_hash_are_told_apart():
    texts = ["ab ba", "Ab cd é", None, "abc", "ba ab ab"]
    low, starts, ends, owner = divergence.slices(texts)
    assert owner.tolist() == [0, 0, 1, 1, 1, 3, 4, 4, 4]
    for digest in (lambda w: 1, len, lambda w: w[0]):
        terms, number = divergence.grouped(low, starts, ends, digest)
        assert [terms[k] for k in number] == [b"ab", b"ba", b"ab", b"cd", "é".encode(), b"abc", b"ba", b"ab", b"ab"]
        assert len(set(terms)) == len(terms)


def test_shares_of_sparse_rows_are_those_of_dense_ones():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, terms = int(rng.integers(1, 7)), int(rng.integers(1, 30))
        there = rng.random((n, terms)) < rng.choice([0.0, 0.2, 0.9])
        zero = rng.integers(1, 50, n)
        dense = np.where(there, rng.integers(1, 100, (n, terms)), zero[:, None])
        rows, cols = np.nonzero(there)
        indptr = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
        want = np.triu(np.abs(dense[:, None, :] - dense[None, :, :]).sum(axis=2), 1)
        assert (divergence.pair_shares(indptr, cols, dense[rows, cols], zero, terms) == want).all()
