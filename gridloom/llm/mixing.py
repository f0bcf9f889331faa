"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes in words, and the documents of each (source, size) counted.
2. Targets: each source's weight of the budget, at most `most` times its own size; what is over is
   shared again by weight among the rest until no source is above.
3. A target is whole passes over the source plus a budget below one pass. Each size first gives the
   rounded-down share of its documents but for a window's worth; what is over a window, sizes in falling order then fill
   greedily down to half a window, and a bounded knapsack over exact sums within the window, with the documents
   still there of each size, picks the sum next to it. Where no choice of these comes as near as the greatest common
   divisor of the sizes allows, a second programme goes over residues modulo the most plentiful size, whose documents
   are added or given back to make up for any others: what it keeps is bounded by that one size. If neither comes
   as near as that, the window is widened, up to `MOST_WINDOW`. A source of up to that many words, one whose sums the window
   reaches and one with a plentiful size are fitted exactly; for others the nearest sum found stands, and `taken`
   against `target` shows the distance. It runs in
   one task a source over its distinct sizes, which the longest document bounds, whatever the number of documents.
4. The plan says how many documents of each (source, size) are taken once more. They are those of
   least seeded hash: buckets of the hash are counted, whole buckets are taken or left, and only
   the documents of the bucket in which the count runs out are ranked.

Null sources are one source, last in order. Null texts have size 0 and are taken 0 words. Repeated
rows count separately; ties of the hash go by id, then by text. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import numbered, staged

BUCKETS = 4096
SOURCES = 100_000  # their names and sizes meet on the driver
WINDOW, MOST_WINDOW = 1 << 16, 1 << 22  # words: where the dynamic programme begins, and how far it goes


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of each source, by code points with null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(order))]
    total, target, open_ = share * sum(s for _, s in order), [0.0] * len(order), set(range(len(order)))
    left = total
    while open_ and left > 0:
        unit = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if weight[k] * unit > most * order[k][1]}
        if not over:
            for k in open_:
                target[k] = weight[k] * unit
            break
        for k in over:
            target[k] = most * order[k][1]
            left -= target[k]
        open_ -= over
    return [(source, size, t) for (source, size), t in zip(order, target)]


def _split(lengths: np.ndarray, free: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(index, documents, words) of lengths in binary parts, none over `most` words."""
    for k, (length, n) in enumerate(zip(lengths.tolist(), free.tolist())):
        n, part = min(n, most // length) if length else 0, 1
        while n > 0:
            part = min(part, n)
            yield k, part, part * length
            n -= part
            part *= 2


def _traced(first: np.ndarray, chosen: list[tuple[int, int, int]], at: int, step: Callable, size: int) -> np.ndarray:
    take = np.zeros(size, np.int64)
    while first[at] > 0:
        k, part, words = chosen[first[at] - 1]
        take[k] += part
        at = step(at, words)
    return take


def _window(lengths: np.ndarray, free: np.ndarray, left: int, window: int) -> tuple[int, np.ndarray]:
    """The reachable sum next to `left` (the lower of two) not above `window`, and how many of each length make it."""
    first = np.full(window + 1, -1, np.int32)  # the part that first reached a sum
    first[0], chosen = 0, []
    for item in _split(lengths, free, window):
        if first[min(left, window)] >= 0:
            break
        chosen.append(item)
        target = first[item[2] :]
        target[(first[: window + 1 - item[2]] >= 0) & (target < 0)] = len(chosen)
    sums = np.flatnonzero(first >= 0)
    best = int(sums[np.argmin(np.abs(sums - left))])
    return best, _traced(first, chosen, best, lambda at, words: at - words, len(lengths))


def _residues(lengths: np.ndarray, take: np.ndarray, free: np.ndarray, left: int) -> tuple[int, np.ndarray]:
    """As _window, where documents of the most plentiful length may be added or given back to make up for the
    others: only what the others leave over that length matters, so that many residues are kept, whatever the sums."""
    pivot = int(np.argmax((take + free) * (lengths > 0)))
    p, back, more = int(lengths[pivot]), int(take[pivot]), int(free[pivot])
    if not p:
        return 0, np.zeros(len(lengths), np.int64)
    others, given = free.copy(), np.zeros(len(lengths), np.int64)
    room = more * p // 2  # others are given back as far as the plentiful length can make up for them
    for k in np.argsort(lengths, kind="stable").tolist():
        if k != pivot and lengths[k]:
            given[k] = min(int(take[k]), p - 1, room // int(lengths[k]))
            room -= int(given[k] * lengths[k])
    wanted, others, left = left, others + given, left + int((given * lengths).sum())
    others[pivot] = 0
    most = max(0, left + back * p)  # words of others that giving back can make room for
    first, total, chosen = np.full(p, -1, np.int32), np.zeros(p, np.int64), []
    first[0] = 0
    order = np.argsort(lengths, kind="stable")  # short ones first: they need least room
    for k, part, words in _split(lengths[order], others[order], most):
        if first[left % p] >= 0:
            break
        chosen.append((int(order[k]), part, words))
        at = np.flatnonzero(first >= 0)
        to, sums = (at + words) % p, total[at] + words
        open_ = (first[to] < 0) & (sums <= most)
        first[to[open_]], total[to[open_]] = len(chosen), sums[open_]
    at = np.flatnonzero(first >= 0)
    times = np.clip((left - total[at] + p // 2) // p, -back, more)
    sums = total[at] + times * p
    best = int(np.lexsort((sums, np.abs(sums - left)))[0])
    out = _traced(first, chosen, int(at[best]), lambda at, words: (at - words) % p, len(lengths))
    out[pivot] += int(times[best])
    return int(sums[best]) - left + wanted, out - given


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length to take so that their sum is next to the budget."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order], counts[order]
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(order), np.int64)
    step = int(np.gcd.reduce(lengths[lengths > 0]))
    nearest = min(budget % step, step - budget % step)  # no sum comes nearer than that
    found, distance = None, None
    while True:
        # each length keeps back a window of its share, which the greedy choice and the programme give out anew
        take = np.array([max(0, int(c) * budget // total - (window // n + 1)) if n else 0 for n, c in zip(lengths.tolist(), counts.tolist())], np.int64)
        left, free = budget - int((take * lengths).sum()), counts - take
        for k, length in enumerate(lengths.tolist() if left > window else []):
            more = min(int(free[k]), max(0, left - window // 2) // length) if length else 0
            take[k] += more
            free[k] -= more
            left -= more * length
        for best, more in (_window(lengths, free, left, window), _residues(lengths, take, free, left)):
            if found is None or (abs(left - best), best - left) < distance:
                found, distance = take + more, (abs(left - best), best - left)
            if distance[0] <= nearest:
                return found[np.argsort(order)]
        if window >= min(total, MOST_WINDOW):
            return found[np.argsort(order)]
        window *= 4


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    budget = float(group["target"].iloc[0])
    size = int((group["size"] * group["documents"]).sum())
    passes = int(budget // size) if size else 0
    rest = min(size, round(budget - passes * size))
    out = group.assign(passes=passes, more=fit(group["size"].to_numpy(np.int64), group["documents"].to_numpy(np.int64), rest))
    return out[["known", "source", "size", "passes", "more"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, text: str = "text", source: str = "source", key: str = "doc_id", size: Callable = n_words, row: str | None = None) -> DataFrame:
    """Per row: key, size, source_size, target, taken (words the mix takes: 0, 1 or 2 times size), copies; and the column `row`, if named."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("content"), (F.col(row) if row else F.lit(None).cast("long")).alias("row"))
    rows = staged(rows.withColumn("known", F.col("source").isNotNull()).fillna("", ["source"]).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(BUCKETS)).cast("int")), "sizes")
    by_length = rows.groupBy("known", "source", "size").agg(F.count("*").alias("documents"))
    by_source = by_length.groupBy("known", "source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    # one row a source; their names are few and their targets depend on one another
    listed = [(r["source"] if r["known"] else None, r["source_size"]) for r in by_source.limit(SOURCES + 1).collect()]
    if len(listed) > SOURCES:
        raise ValueError(f"over {SOURCES} sources")
    aims = [(s is not None, s or "", n, float(t)) for s, n, t in targets(listed, weights, share, most)]
    aimed = docs.sparkSession.createDataFrame(aims, "known boolean, source string, source_size long, target double")
    plan = staged(by_length.join(aimed, ["known", "source"]).groupBy("known", "source").applyInPandas(_plan, "known boolean, source string, size long, passes int, more long"), "plan")

    place = ["known", "source", "size"]
    partly = plan.where("more > 0").select(*place, "more")
    filled = rows.groupBy(*place, "bucket").agg(F.count("*").alias("here")).join(partly, place)
    upto = F.sum("here").over(Window.partitionBy(*place).orderBy("bucket"))
    cut = filled.withColumn("before", upto - F.col("here")).where("before <= more AND before + here > more").select(*place, F.col("bucket").alias("edge"), (F.col("more") - F.col("before")).alias("last"))
    cut = staged(cut, "edges")
    # only rows of a bucket in which a count runs out are ranked, one bucket of a (source, size) a group
    ranked = Window.partitionBy(*place, "bucket").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key", "content", "row")
    on_edge = rows.join(cut.withColumnRenamed("edge", "bucket"), [*place, "bucket"]).withColumn("once", (F.row_number().over(ranked) <= F.col("last")).cast("int"))
    on_edge = on_edge.join(plan.select(*place, "passes"), place)
    planned = plan.join(cut.drop("last"), place, "left")
    off_edge = rows.join(planned, place).where("edge IS NULL OR bucket <> edge").withColumn("once", ((F.col("more") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))).cast("int"))
    columns = ["key", "row", "size", "known", "source", (F.col("passes") + F.col("once")).alias("copies")]
    both = on_edge.select(*columns).unionByName(off_edge.select(*columns)).join(F.broadcast(aimed), ["known", "source"])
    out = both.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", *([F.col("row").alias(row)] if row else []))
    return out


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them (not at all, once or twice). Rows are told apart by
    number, so null and repeated ids keep what the plan gives each row."""
    rows = numbered(docs, "_row")
    copies = mix(rows, row="_row", **how).where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    return rows.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
