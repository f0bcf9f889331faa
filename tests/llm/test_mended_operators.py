"""Long quote marks, sources of few lengths, alignment at every error that is taken, and programs with secrets."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest

from gridloom.llm import chroma, quotation_links, registry, secret_scan
from gridloom.llm.mixing import fit


def test_a_million_quote_marks(spark):
    rows = [(1, 0, "a", "Where is it?"), (1, 1, "b", ">" * 1_000_000 + "Where is it?\n" + "> " * 500_000 + "x"), (1, 2, "c", "x" * 500_000)]
    got = {r.turn: r for r in quotation_links.reply_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].parent_turn == 0 and got[1].quote_levels == 1_000_000 and got[1].body == ""
    assert got[2].parent_turn is None and len(got[2].body) == 500_000


def test_short_quoted_lines_alone_link_and_others_do_not(spark):
    rows = [(1, 0, "a", "Yes.\nThat is the plan then."), (1, 1, "b", "Yes.\nAll right."), (1, 2, "c", "> Yes.\n> That is the plan then.\nGood."), (1, 3, "c", "> Yes.\nWhich?")]
    got = {r.turn: r.parent_turn for r in quotation_links.reply_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: 1}


@pytest.mark.parametrize("window", [1 << 16, 64, 16])
def test_fit_against_all_choices(window):
    draw, worse = random.Random(window), 0
    for _ in range(400):
        lengths = np.array(draw.sample(range(40), draw.randint(1, 5)))
        counts = np.array([draw.randint(1, 4) for _ in lengths])
        budget = draw.randint(0, int((lengths * counts).sum()) + 3)
        sums = {sum(k * n for k, n in zip(c, lengths.tolist())) for c in itertools.product(*[range(c + 1) for c in counts])}
        take = fit(lengths, counts, budget, window)
        assert (take >= 0).all() and (take <= counts).all()
        worse += abs(int((take * lengths).sum()) - budget) - min(abs(s - budget) for s in sums)
    assert worse == 0 if window == 1 << 16 else worse < 1200  # exact where the sums are within the window


@pytest.mark.parametrize("lengths,counts,over,want", [([1, 1000], [1, 10**7], 500, -499), ([1, 1000], [1, 10**7], 333, -332), ([1, 1000], [1, 10**13], 1, 0), ([3, 1000], [400, 10**9], 334, -1), ([3, 1000], [700, 10**9], 500, 0), ([6, 10, 1000], [3, 2, 10**8], 22, 0), ([1000], [10**10], 499, -499)])
def test_few_lengths_in_little_memory(lengths, counts, over, want):
    lengths, counts = np.array(lengths), np.array(counts)
    budget = int((lengths * counts).sum()) // 2 // 1000 * 1000 + over
    tracemalloc.start()
    take = fit(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int((take * lengths).sum()) - budget == want and (take <= counts).all() and peak < 100e6


@pytest.mark.parametrize("share", [0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.11])
def test_recall_at_every_error_that_is_taken(spark, share):
    """Independent flips of a share of the bits; a query is 50 integers of a recording at any offset."""
    draw = np.random.default_rng(int(1000 * share))
    rows, pairs = [], {}
    for k in range(120):
        codes = draw.integers(0, 1 << 32, 140)
        flips = (draw.random((140, 32)) < share) @ (1 << np.arange(32, dtype=np.int64))
        start = int(draw.integers(0, 90))
        part = (codes ^ flips)[start : start + 50]
        rows += [(1000 + k, codes.tolist()), (50 * (k + 100), part.tolist())]
        differ = np.bitwise_count(flips[start : start + 50].astype(np.uint64)).sum()
        if differ <= chroma.MOST_ERROR * 32 * 50:
            pairs[50 * (k + 100), 1000 + k] = start
    found = {(r.key, r.class_id): r.offset for r in chroma.align(spark.createDataFrame(rows, "key long, codes array<long>")).where("kind = 'match'").collect()}
    assert set(found) <= {(50 * (k + 100), 1000 + k) for k in range(120)} | {(1000 + k, 50 * (k + 100)) for k in range(120)}
    assert len(pairs) >= (40 if share == 0.11 else 100)
    assert np.mean([found.get(p) == offset for p, offset in pairs.items()]) >= 0.9


def test_given_recordings_match(spark, sf):
    found = registry.QUERIES["op8_chroma_fingerprints"](spark, sf).where("kind = 'match'").collect()
    assert found and all(r.bit_errors <= chroma.MOST_ERROR * 32 * r.overlap for r in found)


def _literal(draw):
    while True:
        word = "".join(draw.choice("abcdefghjkmnqrvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(draw.randint(12, 20)))
        if word[0].isalpha() and any(c.isdigit() for c in word) and any(c.isupper() for c in word) and secret_scan.Value(word).score() == 2.0:
            return word


def _program(draw):
    """A program and the literals that reach `db_pwd`, by running its assignments."""
    lines, state, names, told = [], {}, [f"v{k}_" for k in range(5)], set()
    for _ in range(draw.randint(3, 14)):
        target = draw.choice([*names, "db_pwd"])
        operator = draw.choice(["=", "=", " = ", " = ", " += "])
        terms, value = [], []
        unknown = draw.random() < 0.15
        for _ in range(1 if unknown else draw.randint(1, 3)):
            if unknown:
                terms.append(draw.choice(["readline()", "getenv('HOME_DIR')", "other[3]", "f(x)"]))
            elif draw.random() < 0.5 and state:
                name = draw.choice(sorted(state))
                terms.append(name)
                value += state[name]
            else:
                word = _literal(draw)
                mark = draw.choice(['"', "'", '"""', "'''", 'f"', "rb'", "b'"])
                terms.append(mark + word + mark.lstrip("frb"))
                value.append(word)
        if operator == " += ":
            value = [*state.get(target, []), *value]
            unknown = not value
        lines.append(target + operator + draw.choice(["+", " + "]).join(terms))
        if unknown:
            state.pop(target, None)
            continue
        state[target] = value
        if target == "db_pwd" and len(value):
            told |= set(value)
    return "\n".join(lines), told


def test_programs():
    draw = random.Random(11)
    for _ in range(1500):
        text, told = _program(draw)
        found = {text[a:b] for a, b, kind in secret_scan.named_spans(text)}
        assert found == told, (text, found ^ told)


@pytest.mark.parametrize("text,want", [
    ("<config><pwd>x9QzLm4kk12Pq</pwd><host>x9QzLm4kk12Pr</host></config>", {"x9QzLm4kk12Pq"}),
    ("<pwd note='n'>x9QzLm4kk12Pq</other>", set()),
    ("pwd = abcD+ef/12XyZ34QQ==", {"abcD+ef/12XyZ34QQ=="}),
    ("if pwd == 'x9QzLm4kk12Pq': pass", set()),
    ("k = 'x9QzLm4kk12Pq'\nif k == other(): pass\npwd = k", {"x9QzLm4kk12Pq"}),
    ("pwd = '''line\nx9QzLm4kk12Pq'''", {"line\nx9QzLm4kk12Pq"}),
    ("", set()),
])
def test_single_programs(text, want):
    assert {text[a:b] for a, b, _ in secret_scan.named_spans(text)} == want


def test_long_sums_take_linear_time():
    text = "pwd = " + "+".join(["a1"] * 300_000)
    assert secret_scan.named_spans(text) == []


def test_texts_are_shuffled_packed(spark, monkeypatch):
    """What meets the few classes that may link is the packed text; the sets are as before."""
    from gridloom.llm import ngram_join as J

    plans, keep = {}, J.staged
    monkeypatch.setattr(J, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    words = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(1, words), (2, words + " é"), (3, ""), (4, None), (None, words), (5, "other words " * 9)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_join(docs, width=3, num=9, den=10).collect() if r.doc_id}
    assert got == {1: (298, 1), 2: (299, 1), 3: (0, 3), 4: (0, 4), 5: (2, 5)}
    assert "packed" in plans["sets"]
