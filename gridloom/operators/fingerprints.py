"""One digest of a table, whatever its partitions and the order of its rows: a hash tree over the digests of rows.

Rows are told by the SHA-256 of their text and counted if they repeat. The tree branches on the hexadecimal digits of these digests, deep
enough that a leaf has about `leaf` rows, or as deep as told; a node is the SHA-256 of its children's digests in order. A leaf's rows pass
through one task in order and none is kept, so no task holds more than sixteen nodes, and one altered byte changes the root and only the
nodes on one path."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import staged

LEAF = 1024


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prefix, row, n in order -> prefix, rows, digest of each prefix."""
    at, rows, told = None, 0, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([rows], pa.int64()), pa.array([told.hexdigest()])], ["prefix", "rows", "digest"])
    for batch in batches:
        for prefix, row, n in zip(*(batch.column(c).to_pylist() for c in ("prefix", "row", "n"))):
            if prefix != at:
                if told:
                    yield out()
                at, rows, told = prefix, 0, hashlib.sha256()
            told.update(f"{',' if rows else ''}{row}:{n}".encode())
            rows += n
    if told:
        yield out()


def tree_digest(df: DataFrame, text: Column, leaf: int = LEAF, depth: int | None = None) -> DataFrame:
    """level (0: the root), prefix, rows, digest of every node. Null texts count as empty; an empty table has the digest of nothing.
    depth: levels below the root (None: as many as leaves of about `leaf` rows need)."""
    rows = staged(df.select(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256).alias("row")).groupBy("row").agg(F.count("*").alias("n")), "rows")
    if depth is None:
        depth = max(0, math.ceil(math.log(max(rows.count(), 1) / leaf, 16)))
    ordered = rows.select(F.substring("row", 1, depth).alias("prefix"), "row", "n").repartition("prefix").sortWithinPartitions("prefix", "row")
    node = staged(ordered.mapInArrow(_leaves, "prefix string, rows long, digest string"), "nodes")
    levels = [node.withColumn("level", F.lit(depth))]
    for level in range(depth - 1, -1, -1):
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda r: r["digest"]), ",")
        node = staged(node.groupBy(F.substring("prefix", 1, level).alias("up")).agg(F.sum("rows").alias("rows"), F.sha2(parts, 256).alias("digest")).withColumnRenamed("up", "prefix"), "nodes")
        levels.append(node.withColumn("level", F.lit(level)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    if not rows.limit(1).count():
        out = df.sparkSession.range(1).select(F.lit("").alias("prefix"), F.lit(0).cast("long").alias("rows"), F.sha2(F.lit(""), 256).alias("digest"), F.lit(0).alias("level"))
    return out.select("level", "prefix", "rows", "digest")


def file_faults(manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """manifest(path, sha256) against hashes(path, sha256) of the files: path, fault (missing, altered or unlisted)."""
    there = hashes.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha256"))
    met = manifest.join(there, F.col("path") == F.col("_path"), "full")
    fault = F.when(F.col("_path").isNull(), "missing").when(F.col("path").isNull(), "unlisted").when(~F.col("sha256").eqNullSafe(F.col("_sha256")), "altered")
    return met.select(F.coalesce("path", "_path").alias("path"), fault.alias("fault")).where("fault IS NOT NULL")
