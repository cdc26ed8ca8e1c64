"""SentencePiece encoding by merge rounds against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from sectional.llm import pieces
from sectional.llm.queries import QUERIES, piece_model

from .corpus import documents, nothing, rows


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(piece_model())


def hard_texts():
    rng = random.Random(5)
    alphabets = ["abc", "abcdefghijklmnopqrstuvwxyz ", "the ing▁ ", " \n\t▁", "日本語中文梦ゼ벨안녕하세요 ", "\x00\x01<s></s><unk>é😀🎉 a", "aeiouthsrn"]
    out = ["", " ", "  ", "▁", "▁▁a ▁", "\n", "a" * 1000, " " * 50, "<s>", "<0x0A>", "the" * 300, "\U0010ffff", "é", "x\x00y"]
    out += ["".join(rng.choice(alphabets[k % 7]) for _ in range(rng.choice([1, 2, 5, 20, 100, 600]))) for k in range(1500)]
    points = [(32, 127), (0xA0, 0x3000), (0x4E00, 0x9FFF), (0x10000, 0x1FFFF)]
    return out + ["".join(chr(rng.randrange(*rng.choice(points))) for _ in range(60)) for _ in range(200)]


def test_ids_and_text_equal_the_library(library, encoder):
    texts = hard_texts()
    flat, ends = encoder.encode(texts)
    got = np.split(flat, ends[:-1])
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts]
    assert encoder.model.decode_lists(flat, ends) == [library.decode(library.encode(t)) for t in texts]


def test_decoding_any_ids_equals_the_library(library, encoder):
    rng = random.Random(6)
    lists = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 13, 29871, 259]) for _ in range(rng.choice([0, 1, 2, 3, 8, 30, 200]))]
             for _ in range(3000)] + [[1, 1, 1], [1, 29871, 2], [2, 200], [229, 1, 190]]
    got = encoder.model.decode_lists(np.array([i for ids in lists for i in ids]), np.cumsum([len(ids) for ids in lists]))
    assert got == [library.decode(ids) for ids in lists]
    with pytest.raises(ValueError):
        encoder.model.decode_lists(np.array([32000]), np.array([1]))


def test_a_long_word_and_a_forgotten_cache(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    encoder = pieces.Encoder(piece_model())
    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    for text in (word, "one two three four five", word[:5000] + " ab", "five four"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_rows(spark, library):
    got = pieces.transcode(documents(spark).withColumnRenamed("rep_key", "ids"), piece_model())
    assert got.columns[-2:] == ["ids", "decoded"] and "kept" in got.columns
    found = got.select("doc_id", "ids", "decoded").collect()
    want = [(r[0], library.encode(r[1] or ""), library.decode(library.encode(r[1] or ""))) for r in rows()]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert pieces.transcode(nothing(spark), piece_model()).count() == 0
    assert "decoded" not in pieces.encode(nothing(spark), piece_model()).columns


def test_decode_rows(spark, library):
    lists = [[1, 450, 4996], [], None, [None, 229, 190, 147], [450, None]]
    df = spark.createDataFrame([(k, ids, "old") for k, ids in enumerate(lists)], "k int, ids array<int>, text string")
    got = {r["k"]: r["text"] for r in pieces.decode(df, piece_model()).collect()}
    assert got == {k: library.decode([i for i in ids or [] if i is not None]) for k, ids in enumerate(lists)}


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x0a\x03\x0a\x01a")
    with pytest.raises(ValueError):
        pieces.Model(str(path))


def test_query(spark, library):
    found = {tuple(r) for r in QUERIES["op11_merge_rounds"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in docs:
        ids = library.encode(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert found == want
