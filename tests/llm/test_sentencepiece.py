"""The piece encoder against the library, on random texts, ids, rows and the given documents."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from gridloom.llm import registry
from gridloom.llm.piece_bpe import PieceCodec, decode_pieces, encode_pieces, piece_round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "▁", "\n", "\t", "a", "the", "é", "é", "日本", "語", "😀", "퟿", "ing", "er", ".", "...", "<s>", "<0x0A>", "\x00", "ß", "tion", "aaaa", "00", "1234", "\r\n", "�", "한국", "ο", "и", "    "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(open(PATH, "rb").read())


def test_random_texts(library, codec):
    draw = random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.ids_of("▁" + text.replace(" ", "▁")) == ids or not text  # without cuts, from one table
        assert codec.decode(ids).decode() == library.decode(ids) == text.replace("▁", " ")


def test_random_ids(library, codec):
    draw = random.Random(6)
    for _ in range(5_000):
        ids = [draw.randrange(0, 259) if draw.random() < 0.4 else draw.randrange(32_000) for _ in range(draw.randint(0, 10))]
        assert codec.decode(ids).decode() == library.decode(ids)


def test_long_texts(library, codec):
    for text in ("abcdefgh" * 40_000, " " * 100_000, "a" * 50_000, "x\n" * 30_000, "日本語" * 20_000):
        assert codec.encode(text) == library.encode(text)


def test_caches_cleared(library, monkeypatch):
    from gridloom.llm import piece_bpe

    monkeypatch.setattr(piece_bpe, "KEPT_SPANS", 8)
    monkeypatch.setattr(piece_bpe, "KEPT_PAIRS", 4)
    codec, draw = PieceCodec(open(PATH, "rb").read()), random.Random(7)
    for _ in range(300):
        text = " ".join("".join(draw.choices("abcdeé.", k=draw.randint(1, 9))) for _ in range(6))
        assert codec.encode(text) == library.encode(text)


def _field(number, value):
    if isinstance(value, int):
        return bytes([number << 3 & 127 | 128, number >> 4, value]) if number > 15 else bytes([number << 3, value])
    return bytes([number << 3 | 2, len(value)]) + value


@pytest.mark.parametrize("trainer,normaliser", [({3: 1, 35: 1}, {4: 0}), ({3: 2, 35: 1}, {4: 1}), ({3: 2, 35: 1}, {4: 0, 2: b"x"}), ({3: 2, 24: 1, 35: 1}, {4: 0}), ({3: 2}, {4: 0})])
def test_other_models_are_refused(trainer, normaliser):
    raw = _field(2, b"".join(_field(k, v) for k, v in trainer.items())) + _field(3, b"".join(_field(k, v) for k, v in normaliser.items()))
    with pytest.raises(ValueError):
        PieceCodec(raw)


def test_tied_scores_are_refused():
    pieces = b"".join(_field(1, _field(1, p.encode())) for p in ("a", "b", "ab", "ba"))
    with pytest.raises(ValueError):
        PieceCodec(pieces + _field(2, _field(3, 2) + _field(35, 1)) + _field(3, _field(4, 0)))


def test_rows(spark, library):
    rows = [(1, "Hello world"), (None, "Hello world"), (1, None), (2, ""), (2, ""), (3, "né\n  x"), (None, None)]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_tokens int, key string")
    got = sorted(map(tuple, piece_round_trip(docs, PATH).collect()), key=str)
    want = []
    for i, text in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = encode_pieces(docs, PATH)
    assert sorted(map(tuple, decode_pieces(encoded, PATH).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert piece_round_trip(docs.limit(0), PATH).collect() == []


def test_documents(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op13_sentencepiece_round_trip"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
