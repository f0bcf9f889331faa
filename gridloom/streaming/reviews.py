"""Review history as a stream: decisions and regenerations of samples as they come, with a state a sample.

Events are (sample, at, kind): `accepted` and `rejected` decide the present revision, `regenerated` begins a new one as a draft. The state
is what the events so far say in order of `at`, whatever the order and the batches that they come in: it holds the time of the last
regeneration and the decisions after it, which bounds it by one revision's decisions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.session import shared_folder

RESULT = "sample long, revision int, status string, decisions int, events long"
DECISIONS = ("accepted", "rejected")


def reviewed(events: DataFrame) -> DataFrame:
    """The state of each sample, of events that are all there: sample, revision, status, decisions (in this revision), events."""
    last = events.where("kind = 'regenerated'").groupBy("sample").agg(F.max("at").alias("since"), F.count("*").cast("int").alias("revision"))
    rows = events.join(last, "sample", "left")
    ours = F.col("kind").isin(*DECISIONS) & (F.col("since").isNull() | (F.col("at") > F.col("since")))
    return rows.groupBy("sample").agg(
        F.coalesce(F.max("revision"), F.lit(0)).alias("revision"), F.coalesce(F.max(F.when(ours, F.struct("at", "kind")))["kind"], F.lit("draft")).alias("status"), F.count_if(ours).cast("int").alias("decisions"), F.count("*").alias("events")
    )


def _state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    revision, since, total, raw = state.get if state.exists else (0, -1, 0, "[]")
    decided = json.loads(raw)
    for frame in batches:
        total += len(frame)
        for at, kind in zip(frame["at"].tolist(), frame["kind"]):
            if kind == "regenerated":
                revision, since = revision + 1, max(since, at)
            elif kind in DECISIONS:
                decided.append([at, kind])
    decided = [d for d in decided if d[0] > since]
    state.update((revision, since, total, json.dumps(decided)))
    yield pd.DataFrame([(key[0], revision, max(decided)[1] if decided else "draft", len(decided), total)], columns=["sample", "revision", "status", "decisions", "events"])


def reviewing(events: DataFrame) -> DataFrame:
    """The same of a stream, in update mode: a row for each sample that a batch has events of. `at` is a whole number from 0."""
    rows = events.select(F.col("sample").cast("long"), F.col("at").cast("long"), "kind")
    return rows.groupBy("sample").applyInPandasWithState(_state, RESULT, "revision int, since long, total long, decided string", "update", GroupStateTimeout.NoTimeout)


def kept(result: DataFrame, out: str) -> DataFrame:
    """Drain a stream of states that is updated into the folder `out`: every batch writes its own rows, and a restart goes on after the
    last; gives the latest row of each sample."""
    spark = result.sparkSession
    write = lambda batch, k: batch.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/part={k}")
    query = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{RESULT}, batch long").parquet(f"{out}/rows")
    names = [c.split()[0] for c in RESULT.split(", ")[1:]]
    return rows.groupBy("sample").agg(F.max(F.struct("batch", *names)).alias("s")).select("sample", *(f"s.{n}" for n in names))


def drained_reviews(events: DataFrame) -> DataFrame:
    return kept(reviewing(events), f"{shared_folder(events.sparkSession)}/gridloom-reviews-{uuid.uuid4().hex}")
