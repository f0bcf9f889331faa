"""What the pipeline does once: texts that a mix repeats, statistics of texts, staged tables that go once they are read."""

import hashlib
import random
from pathlib import Path

import public_tokenizers as P
import pyarrow as pa

from gridloom.llm import bpe, quality_rules
from gridloom.session import shared_folder

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_equal_texts_are_encoded_once(monkeypatch):
    codec, encoded = bpe.Codec(bpe.vocabulary(RANKS), P.PATTERN), []
    plain = codec.encode_all
    monkeypatch.setattr(codec, "encode_all", lambda texts: encoded.extend(texts) or plain(texts))
    monkeypatch.setattr(bpe, "once", lambda key, make: codec)
    texts = ["one text", "one text", None, "", "another", "one text", "another", "öß日 x"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = pa.Table.from_batches(bpe._encode(None, (), P.PATTERN, True)(iter([batch]))).to_pylist()
    assert sorted(encoded) == sorted({t or "" for t in texts})
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        assert b"".join(codec.bytes_of[i] for i in r["ids"]) == raw and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_vocabulary_stays_kept(monkeypatch):
    codec = bpe.Codec(bpe.vocabulary(RANKS), P.PATTERN)
    known = dict(codec.kept)
    assert known and all(codec.code[piece.encode()] == ids for piece, ids in known.items())
    monkeypatch.setattr(bpe, "KEPT_PIECES", 8)
    r = random.Random(3)
    many = [" ".join("".join(r.choice("esnatrüq") for _ in range(9)) for _ in range(40)) for _ in range(20)]
    for text in many * 2:
        assert codec.decode(codec.encode(text)) == text.encode()
        codec.kept.trim()
        assert known.items() <= codec.kept.items() and not known.keys() & codec.kept.aside.keys()


def test_statistics_are_made_once(spark, sf, monkeypatch):
    calls, plain = [], quality_rules._statistics
    monkeypatch.setattr(quality_rules, "_statistics", lambda *a: calls.append(a) or plain(*a))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = quality_rules.passing(docs)
    assert left.columns == docs.columns and len(calls) == 1
    got = sorted(left.collect())
    kept = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    assert got == sorted(r for r in docs.collect() if r.doc_id in kept)


def test_pipeline_leaves_what_its_result_reads(spark, sf):
    import corpus_pipeline

    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("gridloom-*"))
    assert corpus_pipeline.run(spark, sf).count()
    names = {p.name.split("-")[1] for p in set(folder.glob("gridloom-*")) - before}
    assert "mix_sources" in names and not names & {"statistics", "quality_rules", "ngram_jaccard_join", "secret_scan"}
