"""Repair of the structure of conversations by a forward Viterbi programme.

A repaired conversation's roles follow `(system? (user assistant)+)?`, told by their initials; the grammar has four
states. Rows are taken by turn, nulls first, then by role and text. Each row is kept (cost 0), given the role user or
assistant (1) or deleted (2), and rows with the role user or assistant and an empty text may be inserted anywhere (5).
Blank rows and repeated ones (same role and text as an earlier row) must be deleted; a row that ends before a mark
`.!?` costs 5 more unless it is deleted. The programme carries, for each state, the least (cost, edits' initials); after each row the
layer is closed with bounded insertions (a state reaches any other by two at most). Of equal costs the least audit string wins, which
is safe to decide at once: audits of one cost over the same rows are never prefixes of one another.

Conversations are sorted by range, so one of any length lies in many tasks. Each task cuts what it holds into blocks of
`BLOCK` rows and runs the programme over a block from every state that it may be entered in; the best of two neighbours
follows from theirs, so the blocks of a task, and then those of many tasks, are put together in a tree. What is
chosen goes back to the blocks, whose rows are repaired where they are.

Repeated rows are counted before they are sorted. Null roles and texts count as one blank; a null conversation is a
conversation, a null turn comes first and makes no gap. A role with another initial can't be kept. Extra columns
are dropped; an empty table gives empty tables. A conversation's audit has to fit a row.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import staged, unstaged

BLOCK, BLOCK_CHARS, PIECE = 1024, 1 << 22, 64  # rows and characters of a block, blocks of a piece
BLANK, REPEATED, CUT = "b", "d", "t"
START, OPENED = 0, 4  # OPENED: the start with insertions before the first row
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # state that an initial leads to
GIVEN = (2, 2, 3, 2)  # state that a row given its role, or an inserted one, leads to
SPOKEN = {2: "user", 3: "assistant"}
DONE = (0, 3)
LEGAL = {"su", "ua", "au"}


class Path(NamedTuple):
    """A way through rows; they are compared by cost, then audit. trail: block, letters and state after each block."""

    cost: int
    audit: str
    trail: str = ""


def _better(layer: list, state: int, path: Path) -> None:
    if layer[state] is None or path < layer[state]:
        layer[state] = path


def _closed(layer: list) -> list:
    for a, b in ((0, 2), (1, 2), (2, 3), (3, 2)):
        if layer[a] is not None:
            _better(layer, b, Path(layer[a].cost + 5, layer[a].audit + "I"))
    return layer


def _after(layer: list, initial: str, fault: str) -> list:
    """The layer after one more row."""
    new, more = [None] * 4, 5 * (fault == CUT)
    for state, path in enumerate(layer):
        if path is None:
            continue
        cost, audit, _ = path
        _better(new, state, Path(cost + 2, audit + "D"))
        if fault not in (BLANK, REPEATED):
            kept = KEEP[state].get(initial)
            if kept is not None:
                _better(new, kept, Path(cost + more, audit + "K"))
            _better(new, GIVEN[state], Path(cost + more + 1, audit + "R"))
    return _closed(new)


def ways(rows: list[tuple[str, str]], block: int) -> list[list]:
    """The best path over (initial, fault) rows from each state, and from OPENED, to each state."""
    out = []
    for entry in range(5):
        layer: list = [None] * 4
        layer[0 if entry == OPENED else entry] = Path(0, "")
        if entry == OPENED:
            layer = _closed(layer)
        for initial, fault in rows:
            layer = _after(layer, initial, fault)
        out.append([p and p._replace(trail=f"{block:016x}{len(p.audit):08x}{state}") for state, p in enumerate(layer)])
    return out


@dataclass
class Piece:
    """What is known of neighbouring rows of one conversation."""

    ways: list[list]
    turns: tuple[int, int, int] | None  # least, greatest, how many
    ends: tuple[str, str]
    counts: dict[str, int] = field(default_factory=dict)

    def then(self, other: Piece) -> Piece:
        joined = []
        for row in self.ways:
            best: list = [None] * 4
            for middle, a in enumerate(row):
                for state, b in enumerate(other.ways[middle]) if a is not None else ():
                    if b is not None:
                        _better(best, state, Path(a.cost + b.cost, a.audit + b.audit, a.trail + b.trail))
            joined.append(best)
        turns = self.turns or other.turns
        if self.turns and other.turns:
            turns = (self.turns[0], other.turns[1], self.turns[2] + other.turns[2] - (self.turns[1] == other.turns[0]))
        counts = {k: n + other.counts[k] for k, n in self.counts.items()}
        counts["illegal"] += self.ends[1] + other.ends[0] not in LEGAL
        return replace(self, ways=joined, turns=turns, ends=(self.ends[0], other.ends[1]), counts=counts)


def _piece(rows: list[tuple], block: int) -> Piece:
    """Of (turn, role, text, fault) rows."""
    initials, turns, faults = [r[1][:1] for r in rows], [r[0] for r in rows if r[0] is not None], [r[3] for r in rows]
    counts = {"blank": faults.count(BLANK), "duplicate": faults.count(REPEATED), "truncated": faults.count(CUT)}
    counts["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return Piece(ways(list(zip(initials, faults)), block), (turns[0], turns[-1], len(set(turns))) if turns else None, (initials[0], initials[-1]), counts)


class _Blocks:
    """Cuts the sorted rows of a task into blocks and pieces."""

    def __init__(self, task: int, block: int, piece: int):
        self.most_rows, self.most_blocks = block, piece
        self.next, self.rows, self.size, self.piece, self.blocks, self.conv, self.began = task << 32, [], 0, None, 0, None, False
        self.shared = True  # whether the conversation may have rows elsewhere, in other tasks or pieces
        self.out: list[tuple] = []  # conv, block, rows, piece, whether it may have to be joined

    def add(self, conv, turn, role: str, text: str, fault: str) -> None:
        if self.began and conv != self.conv:
            self.end()
            self.shared = False
        self.conv, self.began = conv, True
        self.rows.append((turn, role, text, fault))
        self.size += len(text)
        if len(self.rows) >= self.most_rows or self.size >= BLOCK_CHARS:
            self.cut()

    def cut(self) -> None:
        piece = _piece(self.rows, self.next)
        self.out.append((self.conv, self.next, [{"role": r, "text": t} for _, r, t, _ in self.rows], None, None))
        self.piece = self.piece.then(piece) if self.piece else piece
        self.rows, self.size, self.next, self.blocks = [], 0, self.next + 1, self.blocks + 1
        if self.blocks == self.most_blocks:
            self.shared = True
            self.part()

    def part(self) -> None:
        if self.piece:
            self.out.append((self.conv, self.next - 1, None, pickle.dumps(self.piece), self.shared))
        self.piece, self.blocks = None, 0

    def end(self, last: bool = False) -> None:
        self.shared |= last
        if self.rows:
            self.cut()
        self.part()


def _cut(conv: pa.DataType, block: int, piece: int):
    kinds = [conv, pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(TaskContext.get().partitionId(), block, piece)
        told = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in blocks.out], kind) for k, kind in enumerate(kinds)], ["conv", "block", "rows", "piece", "shared"])
        for batch in batches:
            for conv_, turn, role, text, fault, times in zip(*(c.to_pylist() for c in batch.columns)):
                for k in range(times):
                    blocks.add(conv_, turn, role, text, REPEATED if k and fault != BLANK else fault)
                    if len(blocks.out) >= 64:
                        yield told()
                        blocks.out = []
        if blocks.began:
            blocks.end(last=True)
        yield told()

    return run


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one conversation that follow one another as one."""
    group = group.drop(columns="near", errors="ignore").sort_values("block")
    whole = None
    for raw in group["piece"]:
        piece = pickle.loads(raw)
        whole = whole.then(piece) if whole else piece
    return group.iloc[:1].assign(piece=pickle.dumps(whole))


def _told(conv: pa.DataType):
    spans = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("piece").to_pylist():
                piece = pickle.loads(raw)
                best = min(p for p in (piece.ways[OPENED][s] for s in DONE) if p is not None)
                found, state, at = [], START, 0
                for k in range(0, len(best.trail), 25):
                    size = int(best.trail[k + 16 : k + 24], 16)
                    found.append({"block": int(best.trail[k : k + 16], 16), "state": state, "edits": best.audit[at : at + size]})
                    at, state = at + size, int(best.trail[k + 24])
                gaps = piece.turns[1] - piece.turns[0] + 1 - piece.turns[2] if piece.turns else 0
                out.append((gaps, *(piece.counts[n] for n in names[1:5]), best.cost, best.audit, found))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string(), spans]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], ["conv", *names, "audit", "spans"])

    return run


def repaired(rows: list[dict], state: int, edits: str) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the rows that the edits leave, entered in `state`."""
    here = iter(rows)
    for edit in edits:
        row = next(here) if edit != "I" else {"role": "", "text": ""}
        if edit == "D":
            continue
        state = KEEP[state][row["role"][:1]] if edit == "K" else GIVEN[state]
        yield row["role"] if edit == "K" else SPOKEN[state], row["text"], edit


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, origin = [], []
        for k in range(len(batch)):
            block, rows, state, edits = (batch.column(n)[k].as_py() for n in ("block", "rows", "state", "edits"))
            for place, row in enumerate(repaired(rows, state, edits)):
                out.append((block, place, *row))
                origin.append(k)
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("conv").take(pa.array(origin, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], ["conv", "block", "place", "role", "text", "edit"])


def _digests(conv: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda c, h: pa.RecordBatch.from_arrays([pa.array([c], conv), pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])
        last, digest = None, None
        for batch in batches:
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if digest is not None and c == last:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield told(last, digest)
                    last, digest = c, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield told(last, digest)

    return run


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text with the damage that crc32(`conv:turn`) % 20 gives each row (null: one blank): 0 drops it,
    1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes its role user."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known(conv), F.lit(":"), known(turn))) % 20
    rows = conversations.select(F.col(conv), F.col(turn), known(role).alias("role"), known(text).alias("text"), fate.alias("fate")).where("fate <> 0")
    said = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select(conv, turn, F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias(role), said.alias(text), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


class Repair(NamedTuple):
    """reports: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. rows: conv, block, place, role, text, edit
    (K, R or I); a conversation's rows are in order of (block, place)."""

    reports: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"), known(text).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("digest", F.sha2("text", 256))
    turns = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(turns).alias("first"))
    rows = rows.join(first, rows["conv"].eqNullSafe(F.col("c")) & (rows["role"] == F.col("r")) & (rows["digest"] == F.col("d")))
    ended = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(ended == "", BLANK).when(F.col("first") != turns, REPEATED).when(~ended.isin(".", "!", "?"), CUT).otherwise("")
    rows = rows.select("conv", "turn", "role", "text", fault.alias("fault"), "times")
    kind, plain = rows.schema["conv"].dataType.simpleString(), _arrow(rows, "conv")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", "text"]
    cut = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(_cut(plain, BLOCK, PIECE), f"conv {kind}, block long, rows array<struct<role:string,text:string>>, piece binary, shared boolean")
    cut = staged(cut, "blocks")
    whole = cut.where("piece IS NOT NULL AND NOT shared").select("conv", "piece")
    pieces, shift = cut.where("piece IS NOT NULL AND shared").select("conv", "block", "piece"), 32
    while pieces.groupBy("conv").count().where("count > 1").limit(1).count():
        # those of one task, then of 32 neighbouring tasks, of 1,024 and so on
        before = pieces
        pieces = staged(before.groupBy("conv", F.shiftrightunsigned("block", shift).alias("near")).applyInPandas(_joined, f"conv {kind}, block long, piece binary"), "pieces")
        shift += 5
        unstaged(before)
    told = staged(whole.unionByName(pieces.select("conv", "piece")).mapInArrow(_told(plain), f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, spans array<struct<block:long,state:int,edits:string>>"), "repairs")
    spans = told.select(F.explode("spans").alias("span")).select("span.*")
    spelt = cut.where("rows IS NOT NULL").select("conv", "block", "rows").join(spans, "block").select("conv", "block", "rows", "state", "edits")
    spelt = spelt.mapInArrow(_spelt, f"conv {kind}, block long, place int, role string, text string, edit string")
    return Repair(told.drop("spans").withColumnRenamed("conv", conv), spelt.withColumnRenamed("conv", conv))


def repair_report(conversations: DataFrame, original: DataFrame, conv: str = "conv_id", **columns: str) -> DataFrame:
    """The report of every conversation in `original` (zeros where `conversations` has none of its rows) with the SHA-256 of its
    repaired `role:text` rows, joined by line breaks. A digest reads its conversation's rows in order, one at a time."""
    done = repair(conversations, conv, **columns)
    kind = done.rows.schema[conv].dataType.simpleString()
    order = done.rows.repartition(conv).sortWithinPartitions(conv, "block", "place").select(conv, "role", "text")
    digests = order.mapInArrow(_digests(_arrow(order, conv)), f"conv {kind}, repaired_sha256 string")
    out = original.select(F.col(conv).alias("_conv")).distinct()
    reports = done.reports.withColumnRenamed(conv, "_of")
    out = out.join(reports, F.col("_conv").eqNullSafe(F.col("_of")), "left").join(digests, F.col("_conv").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("_conv").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
