"""Ranked search against a plain loop, and the given tables against DuckDB."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridloom.llm import lexical_search, registry
from gridloom.llm.lexical_search import Vocabulary, radix_order, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(lexical_search.UPPER, lexical_search.LOWERED)


def brute(docs, items, top=20):
    cut = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for place, (i, b) in enumerate(bags):
            m = 100 - 25 + (25 * sum(b.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t in cut(text) if t in b)
            if score > 0:
                scored.append((-score, (i is not None, i or 0), place))
        for rank, (score, key, _) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, key[1] if key[0] else None, -score))
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, n int, key string, score int")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    return sorted(map(tuple, search(docs, items, **how).collect()), key=str)


def made(seed, n, vocabulary):
    draw = random.Random(seed)
    return [(k, " ".join(draw.choices(vocabulary, k=draw.randint(0, 30)))) for k in range(n)]


def test_brute_force(spark):
    words = ["the", "The", "tHe2", "é", "É", "a-b", "naïve", "日本", "x_y", "o'clock", "q", "ab", "ba", "\x00", "…", "ﬁ"] + [f"w{k}" for k in range(40)]
    docs, items = made(1, 120, words), made(2, 15, words)
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_edges(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (None, None), (5, ""), (6, "..!"), (7, "alpha " * 50_000), (2, "alpha beta"), (9, "z" * 200_000 + " beta"), (10, "gamma")]
    items = [(1, "alpha alpha beta"), (1, "alpha"), (None, "beta"), (3, None), (4, ""), (5, "delta"), (6, "z" * 200_000)]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, docs, [(1, None)]) == []


def test_ties_take_the_least_keys(spark):
    docs = [(k, "same words here") for k in range(200, 0, -1)] + [(500, "other")]
    got = run(spark, docs, [(7, "same here")])
    assert sorted(r[2] for r in got) == list(range(1, 21)) and len({r[3] for r in got}) == 1


def test_blocks_chunks_and_segments(spark, monkeypatch):
    docs, items = made(3, 90, [f"w{k}" for k in range(30)]), made(4, 12, [f"w{k}" for k in range(30)])
    want = brute(docs, items)
    for name, value in (("BLOCK_TERMS", 40), ("MERGED", 1)):
        monkeypatch.setattr(lexical_search, name, value)
    assert run(spark, docs, items) == want


def test_scorer_in_small_chunks(monkeypatch):
    draw = np.random.default_rng(5)
    at = np.append(0, np.cumsum(draw.integers(0, 6, 300)))
    terms, times = draw.integers(0, 9, at[-1]), draw.integers(1, 4, at[-1])
    cut, item = np.arange(0, 28, 3), np.tile(np.arange(3), 9)
    best = []
    for chunk in (7, 1 << 22):
        monkeypatch.setattr(lexical_search, "CHUNK", chunk)
        scorer = lexical_search.Scorer(draw.integers(5, 6, 9), 3, cut, item, np.ones(27, np.int64), 300, int(at[-1]), 10)
        for a in range(0, 300, 100):
            b = a + 100
            scorer.add(list(range(a, b)), np.maximum(1, np.diff(at[a : b + 1])), at[a : b + 1] - at[a], terms[at[a] : at[b]], times[at[a] : at[b]])
        best.append([sorted(h) for h in scorer.heaps])
    assert best[0] == best[1]


def test_segments_of_text(monkeypatch):
    import pyarrow as pa

    from gridloom.llm.shingles import text_bytes

    texts = ["One two", "", None, "three", "four-five  SIX", "é" * 40, "x"] * 30
    data, at = text_bytes(pa.array(texts))
    want = [w for t in texts for w in TERM.findall((t or "").translate(LOWER))]
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(lexical_search, "SEGMENT", size)
        got = [part[s : s + k].tobytes().decode() for part, starts, sizes in lexical_search.words(data, at) for s, k in zip(starts, sizes)]
        assert got == want


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical_search, "hashed", lambda data, starts, sizes: (sizes % 2).astype(np.uint64))
    terms = ["a", "b", "abc", "dd", "abd"]
    data = np.frombuffer(b"abdabcadxyzq", np.uint8)
    starts, sizes = np.array([0, 3, 6, 7, 8, 11]), np.array([3, 3, 1, 1, 3, 1])
    assert Vocabulary(terms).find(data, starts, sizes).tolist() == [4, 2, 0, -1, -1, -1]


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000) & ~np.int64(0xFF0)
    assert (radix_order(keys, 1 << 40) == np.argsort(keys, kind="stable")).all()


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_tables(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = registry.QUERIES["op12_lexical_search"](spark, sf_dir)
    assert sorted(got.columns) == ["doc_id", "item_id", "rank", "score"]
    want = con.sql(registry.SQL["op12_lexical_search"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
