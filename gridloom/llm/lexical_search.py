"""Ranked lexical search by sort-based accumulation.

1. Items are cut into terms; each block of them has at most `BLOCK_TERMS` terms (or one item), so the vocabulary
   that a pass sends to the tasks is bounded whatever the number of items. Each block is searched over all documents.
2. Tasks cut whole texts with numpy, a megabyte at a time, look the hash of each word up in the block's vocabulary and
   compare the bytes of what is found; a document becomes its number of terms and two short arrays, the terms it
   shares with the vocabulary and how often it has them. This index is staged.
3. Number and length of documents and the document frequencies come from it by aggregation.
4. The index is partitioned by ranges of the documents' keys. A task concatenates the matched (item, document, impact)
   arrays of some documents at a time, sorts them by the packed key of item and document with a radix sort of 16-bit
   digits, and adds up each run with reduceat. Scores are 64-bit integers throughout.
5. Each task keeps a heap of the `top` of every item; the heaps are ranked in two steps, first those of
   `MERGED` tasks each, so that no group follows the number of documents.

Equal scores go by ascending key. Rows with the same key are documents of their own, and rows of items with the same id
items of their own. A null key comes before all others; null texts have no terms, are not counted and are not found; items
without terms find nothing. Extra columns are dropped; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shingles import BASE, LOWER, ODD, U, mix, text_bytes
from gridloom.session import staged, unstaged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS, MERGED = 1 << 20, 256
SEGMENT, CHUNK = 1 << 20, 1 << 22  # bytes of text cut at once; (item, document, impact) triples sorted at once

_byte = np.arange(256)
IN_TERM = (_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each span of lower-cased bytes; spans follow one another without overlap."""
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.full(int(sizes.max()) if len(sizes) else 1, BASE, U)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = (data[place + np.repeat(starts, sizes)].astype(U) + U(1)) * powers[place]
    return mix(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(U) * ODD) if len(sizes) else np.zeros(0, U)


def words(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lower-cased bytes, starts, sizes) of the terms, for segments of all texts that end between terms; starts count
    from the segment's first byte, whose place is data's."""
    n, pos = len(data), 0
    first = np.zeros(n + 1, bool)
    first[at] = True
    while pos < n:
        end = min(pos + SEGMENT, n)
        while end < n:
            stop = np.flatnonzero(~IN_TERM[data[end : end + 4096]] | first[end : min(end + 4096, n)])
            if len(stop):
                end += int(stop[0])
                break
            end = min(end + 4096, n)
        part = data[pos:end]
        inside = IN_TERM[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[pos + 1 : end]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[pos + 1 : end]
        starts = np.flatnonzero(begins)
        yield LOWER[part], starts, np.flatnonzero(ends) + 1 - starts
        pos = end


class Vocabulary:
    """Terms to look up: sorted by hash, with their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        sizes = np.array(list(map(len, raw)), np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = hashed(data, np.cumsum(sizes) - sizes, sizes)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.sizes, self.starts, self.data = hashes[self.order], sizes, np.cumsum(sizes) - sizes, data

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 if it is none."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = hashed(data, starts, sizes)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        open_ = np.flatnonzero(self.hashes[at] == hashes)
        at = at[open_]
        while len(open_):  # terms of one hash follow one another
            term = self.order[at]
            same = self.sizes[term] == sizes[open_]
            same[same] = self._equal(data, starts[open_[same]], term[same])
            out[open_[same]] = term[same]
            open_, at = open_[~same], at[~same] + 1
            more = at < len(self.hashes)
            open_, at = open_[more], at[more]
            more = self.hashes[at] == hashes[open_]
            open_, at = open_[more], at[more]
        return out

    def _equal(self, data: np.ndarray, starts: np.ndarray, term: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, bool)
        sizes = self.sizes[term]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        return np.logical_and.reduceat(data[place + np.repeat(starts, sizes)] == self.data[place + np.repeat(self.starts[term], sizes)], first)


def _index(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        width = max(1, len(vocabulary.hashes))
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            total, found, pos = np.zeros(len(batch), np.int64), [], 0
            for part, starts, sizes in words(data, at):
                row = np.searchsorted(at, starts + pos, side="right") - 1
                total += np.bincount(row, minlength=len(batch))
                term = vocabulary.find(part, starts, sizes)
                hit = term >= 0
                found.append(row[hit] * width + term[hit])
                pos += len(part)
            both, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            has = np.flatnonzero(total)
            cut = np.append(np.searchsorted(both, has * width), len(both)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (both % width, times)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(has)), pa.array(total[has]), *lists], ["key", "n", "terms", "times"])

    return run


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of non-negative keys up to `most`: 16 bits at a time, least first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


class Scorer:
    """The items of a block by term, with the weights; adds up documents and keeps the best of each item."""

    def __init__(self, weights: np.ndarray, items: int, cut: np.ndarray, item: np.ndarray, often: np.ndarray, n_docs: int, length: int, top: int):
        self.weights, self.items, self.cut, self.item, self.often = weights, items, cut, item, often
        self.n_docs, self.length, self.top = n_docs, length, top
        self.heaps: list[list] = [[] for _ in range(items)]
        self.floor = np.zeros(items, np.int64)  # what a later document has to exceed
        self.seen = 0

    def add(self, keys: list, n: np.ndarray, at: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Documents in ascending order of key, all after those before."""
        many = self.cut[terms + 1] - self.cut[terms]
        upto = np.append(0, np.cumsum(many))[at]
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + CHUNK, side="right")) - 1)
            part = slice(int(at[a]), int(at[b]))
            self._chunk(keys[a:b], n[a:b], np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), terms[part], times[part], many[part])
            a = b

    def _chunk(self, keys: list, n: np.ndarray, doc: np.ndarray, terms: np.ndarray, times: np.ndarray, many: np.ndarray) -> None:
        if len(terms) and int(many.sum()):
            m = np.array([75 + 25 * x * self.n_docs // self.length for x in n.tolist()], np.int64)
            impact = self.weights[terms] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
            entry = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - self.cut[terms], many)
            packed = self.item[entry] * len(keys) + np.repeat(doc, many)
            impacts = np.repeat(impact, many) * self.often[entry]
            order = radix_order(packed, self.items * len(keys))
            packed = packed[order]
            first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
            score, packed = np.add.reduceat(impacts[order], first), packed[first]
            item = packed // len(keys)
            keep = score > self.floor[item]
            self._push(keys, score[keep], item[keep], packed[keep] % len(keys))
        self.seen += len(keys)

    def _push(self, keys: list, score: np.ndarray, item: np.ndarray, doc: np.ndarray) -> None:
        """Grouped by item, documents ascending."""
        edge = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(item)]):
            heap, mine = self.heaps[int(item[a])], np.arange(a, b)
            if len(mine) > self.top:  # no later one of equal score can come in, so the least that may stay is known
                least = np.partition(score[a:b], -self.top)[-self.top]
                mine = np.concatenate([mine[score[a:b] > least], mine[score[a:b] == least][: self.top]])
            for k in np.sort(mine).tolist():
                entry = (int(score[k]), -(self.seen + int(doc[k])), keys[int(doc[k])])
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.floor[int(item[a])] = heap[0][0]


def _search(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            terms, times = batch.column("terms"), batch.column("times")
            at = np.append(0, np.cumsum(terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            scorer.add(batch.column("key").to_pylist(), batch.column("n").to_numpy(), at, terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64))
        task = TaskContext.get().partitionId()
        best = [(task, item, score, key) for item, heap in enumerate(scorer.heaps) for score, _, key in heap]
        columns = [list(x) for x in zip(*best)] if best else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], kind)], ["task", "item", "score", "key"])

    return run


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _block(docs: DataFrame, listed: list, top: int, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(item, score, key) of the `top` of each of the listed (item, terms), by number in the list; and the index to delete."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    number: dict[str, int] = {}
    entries = pd.DataFrame([(number.setdefault(t, len(number)), i) for i, (_, terms) in enumerate(listed) for t in terms], columns=["term", "item"])
    entries = entries.value_counts(sort=False).sort_index().reset_index(name="often")
    kind = docs.schema["key"].dataType.simpleString()
    index = staged(docs.mapInArrow(_index(context.broadcast(list(number))), f"key {kind}, n long, terms array<int>, times array<int>"), "index")
    totals = index.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    df = np.zeros(len(number), np.int64)
    for term, count in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as the block has terms
        df[term] = count
    weights = np.array([math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    cut = np.searchsorted(entries["term"].to_numpy(), np.arange(len(number) + 1))
    shared = context.broadcast((weights, len(listed), cut, entries["item"].to_numpy(), entries["often"].to_numpy(), totals["docs"], totals["length"] or 1, top))
    ranges = index.repartitionByRange(partitions, "key", F.hash("n", "terms")).sortWithinPartitions("key")
    return ranges.mapInArrow(_search(shared, _arrow(index, "key")), f"task int, item int, score long, key {kind}"), index


def search(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Per item: item, rank (int, from 1), key, score (long) of its `top` documents with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWERED), F.lit(TERM), F.lit(0))
    asked = items.select(F.col(item).alias("item_key"), found.alias("terms")).where(F.size("terms") > 0).withColumn("row", F.monotonically_increasing_id())
    asked = staged(asked, "items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    best = []
    for block in range(blocks):
        listed = [(r["row"], r["terms"]) for r in asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "terms").collect()]
        scored, index = _block(rows, listed, top, partitions)
        names = spark.createDataFrame([(k, row) for k, (row, _) in enumerate(listed)], "item int, row long")
        best.append(staged(scored.join(F.broadcast(names), "item").select("task", "row", "score", "key"), "best"))
        unstaged(index)
    merged = best[0]
    for more in best[1:]:
        merged = merged.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_first("key")]
    merged = merged.withColumn("part", F.floor(F.col("task") / MERGED))
    near = merged.withColumn("place", F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))).where(F.col("place") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= top)
    return last.join(asked.select("row", "item_key"), "row").select(F.col("item_key").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
