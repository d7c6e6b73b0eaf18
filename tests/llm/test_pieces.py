"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random
import shutil

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from mapwright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "  \n\t▁abcdeéfghiüñ.,-=#0123'\"<>/\\s\x00\x01한국어日本中文的😀​́\U0010ffff�퟿Жя"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.model(PATH)


def some_text(rng, names):
    kind = rng.randrange(6)
    if kind == 0:
        return "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
    if kind == 1:
        return "".join(rng.choice(names) for _ in range(rng.randrange(30)))
    if kind == 2:
        return rng.choice(ALPHABET) * rng.randrange(200) + rng.choice(names)
    if kind == 3:
        return "".join(rng.choice("ab ") for _ in range(rng.randrange(80)))
    if kind == 4:
        return (" " * rng.randrange(70) + rng.choice(names)) * rng.randrange(6)
    return "".join(rng.choice(ALPHABET) * rng.randrange(1, 40) for _ in range(rng.randrange(12)))


def test_ids_and_texts_are_those_of_the_library(library, model):
    rng = random.Random(3)
    names = [library.id_to_piece(k).replace("▁", " ") for k in range(259, library.get_piece_size())]
    for _ in range(60):
        texts = [some_text(rng, names) for _ in range(50)]
        for text, ids in zip(texts, model.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text), text
            assert model.decode(ids).decode() == library.decode(ids.tolist()), text


def test_every_piece_and_every_run_of_spaces(library, model):
    texts = [library.id_to_piece(k).replace("▁", " ") for k in range(library.get_piece_size())] + ["x" + " " * k + "y" for k in range(70)]
    assert [i.tolist() for i in model.encode(texts)] == library.encode(texts)


def test_runs_of_spaces_do_not_hang_on_the_short_way(library, monkeypatch):
    m = pieces.PieceModel(PATH)
    assert m.last_rank != pieces.NONE
    m.last_rank = pieces.NONE  # merged like all other pairs
    texts = [" " * k + "a" + " " * (k // 2) for k in range(80)]
    assert [i.tolist() for i in m.encode(texts)] == library.encode(texts)


def test_ids_that_no_text_gives_are_decoded_too(library, model):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids), ids


def test_very_long_runs(library, model):
    texts = [" " * 50_000, "a" * 50_000, "日本" * 30_000, "-" * 30_000 + "=*" * 10_000]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert model.decode(ids).decode() == text
    short = [t[:3000] for t in texts]
    assert [i.tolist() for i in model.encode(short)] == library.encode(short)


def test_report_over_a_table(spark, library, tmp_path):
    rng = random.Random(5)
    names = [library.id_to_piece(k).replace("▁", " ") for k in range(259, 32000)]
    rows = [(k, some_text(rng, names), "x") for k in range(200)] + [(None, "a b", "y"), (3, "same id", "y"), (3, "same id", "y"), (900, None, None), (901, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(4)
    other = shutil.copy(PATH, tmp_path / "own.model")
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    for path in (None, str(other)):
        got = [tuple(r) for r in pieces.piece_report(docs, model_path=path).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    encoded = pieces.encode_texts(docs)
    back = {(r["doc_id"], r["decoded"]) for r in pieces.decode_ids(encoded).collect()}
    assert back == {(i, library.decode(library.encode(t or ""))) for i, t, _ in rows}
    assert pieces.piece_report(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, [1, None, -5, 264, 10**6])], "doc_id long, ids array<int>")
    assert pieces.decode_ids(odd).collect()[0]["decoded"] == library.decode([1, 264])


def test_pair_table_finds_what_was_put_in():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, size=(4000, 2)), axis=0).astype(np.int32)
    table = pieces.PairTable(keys[:, 0], keys[:, 1])
    assert (table.find(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    every = np.stack(np.meshgrid(np.arange(300), np.arange(300)), -1).reshape(-1, 2).astype(np.int32)
    found = table.find(every[:, 0], every[:, 1]) >= 0
    assert {tuple(k) for k in every[found].tolist()} == {tuple(k) for k in keys.tolist()}
