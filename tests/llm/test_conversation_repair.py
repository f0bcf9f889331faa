"""Repair of conversations against all edits of short ones and against a plain search of longer ones."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import conversation_repair, registry
from gridloom.llm.conversation_repair import damaged, repair, repair_report

GRAMMAR = re.compile(r"(?:s?(?:ua)+)?\Z")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text, fate = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        letters = WORD.findall(text)
        out.append((role, text, "b" if not letters else "d" if (role, text) in seen else "t" if letters[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def every_edit(rows):
    """(cost, audit, repaired) of the best of all edits, with up to two insertions in a place."""
    insertions = [()] + [(a,) for a in "ua"] + list(itertools.product("ua", repeat=2))
    found = None
    options = []
    for role, text, fault in rows:
        more = 5 * (fault == "t")
        choice = [("D", 2, None)]
        if fault not in ("b", "d"):
            choice += [("K", more, (role, text)), ("R", more + 1, ("user", text)), ("R", more + 1, ("assistant", text))]
        options.append(choice)
    for edits in itertools.product(*options):
        for places in itertools.product(insertions, repeat=len(rows) + 1):
            audit, cost, out = "", 0, []
            for k, put in enumerate(places):
                audit += "I" * len(put)
                cost += 5 * len(put)
                out += [({"u": "user", "a": "assistant"}[x], "") for x in put]
                if k < len(rows):
                    letter, price, row = edits[k]
                    audit, cost = audit + letter, cost + price
                    out += [row] if row else []
            if GRAMMAR.match("".join(r[:1] or "-" for r, _ in out)) and (found is None or (cost, audit) < found[:2]):
                found = (cost, audit, out)
    return found


def searched(rows):
    """The same by Dijkstra's search over (rows done, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, last, out = heapq.heappop(heap)
        if k == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (k, last) in done:
            continue
        done.add((k, last))
        follows = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[last]
        for x in set(follows) & {"u", "a"}:
            heapq.heappush(heap, (cost + 5, audit + "I", k, x, (*out, ({"u": "user", "a": "assistant"}[x], ""))))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, last, out))
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                if role[:1] in follows:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[:1], (*out, (role, text))))
                for x in set(follows) & {"u", "a"}:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", k + 1, x, (*out, ({"u": "user", "a": "assistant"}[x], text))))


def report(rows, best=searched):
    """By conversation."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for conv, mine in groups.items():
        told = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, fixed = best(told)
        found = [f for _, _, f in told]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, digest)
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conv(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, block int")


def chats(seed, convs, most):
    draw = random.Random(seed)
    rows = []
    for conv in convs:
        for k in range(draw.randint(1, most)):
            turn = draw.choice([k, k, k, k + 3, None])
            rows.append((conv, turn, draw.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), draw.choice(["Yes.", "No!", "open", " ", None, "End. \n", f"Own {draw.random()}.", "…"])))
    return rows


def test_all_edits_of_short_chats(spark):
    rows = chats(1, range(36), 3)
    assert by_conv(repair_report(frame(spark, rows), frame(spark, rows))) == report(harmless(rows), every_edit)


def harmless(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("block,piece", [(1024, 64), (3, 2), (1, 1)])
def test_blocks_and_pieces(spark, monkeypatch, block, piece):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair, "PIECE", piece)
    rows = chats(2, [*range(20), None], 40) + [(77, t, ("user", "assistant")[t % 2], f"Row {t}.") for t in range(400)] + [(78, 4, "user", "Again and again.")] * 300
    got = by_conv(repair_report(frame(spark, rows).repartition(7), frame(spark, rows)))
    assert got == report(harmless(rows))
    assert got[78][2] == 299 and got[78][5:7] == (600, "D" * 300)


def test_rows_of_the_repair(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "user", ""), (1, 3, "user", "Go on."), (1, 4, "assistant", "Done."), (2, 0, "system", "Be kind.")]
    done = repair(frame(spark, rows))
    told = sorted((r["conv_id"], r["block"], r["place"], r["role"], r["text"], r["edit"]) for r in done.rows.collect())
    assert [(r[0], *r[3:]) for r in told] == [(1, "user", "Hi.", "K"), (1, "assistant", "More.", "R"), (1, "user", "Go on.", "K"), (1, "assistant", "Done.", "K")]
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in done.reports.collect()} == {1: (3, "KRDKK"), 2: (2, "D")}
    put = list(conversation_repair.repaired([{"role": "user", "text": "a"}], 3, "KII"))
    assert put == [("user", "a", "K"), ("assistant", "", "I"), ("user", "", "I")]


def test_long_texts_nulls_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, None, "user", "x" * 300_000 + "."), (5, None, "assistant", " \t" * 100_000), (5, 7, "user", "Ok?" + " " * 100_000), (6, -3, "assistant", "a."), (6, 9, "user", "b.")]
    assert by_conv(repair_report(frame(spark, rows), frame(spark, rows))) == report(harmless(rows))
    assert repair_report(frame(spark, []), frame(spark, [])).collect() == []
    nothing = by_conv(repair_report(frame(spark, []), frame(spark, [(1, 1, "user", "x"), (1, 2, "user", "y"), (None, 1, "user", "x")])))
    assert nothing == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, None)}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None), (3, None, "user", None)]
    got = sorted(map(tuple, damaged(frame(spark, rows)).collect()), key=str)
    assert got == sorted(harm(rows), key=str)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = report(harm(rows))
    for conv in {r[0] for r in rows} - set(want):
        want[conv] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert by_conv(registry.QUERIES["op11_conversation_repair"](spark, sf_dir)) == want
