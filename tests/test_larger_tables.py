"""Queries against their SQL on tables that the small data does not stand for."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields, quantiles
from gridloom.plans import catalog


@pytest.fixture
def against_sql(spark, tmp_path):
    """Compare a query with its SQL over given tables, row by row."""

    def run(name: str, **tables: pd.DataFrame) -> int:
        con = duckdb.connect()
        for t, frame in tables.items():
            frame.to_parquet(tmp_path / f"{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        con.register("got", got)
        con.execute(f"CREATE TABLE want AS {catalog.SQL[name]}")
        columns = ", ".join(f'"{c}"' for c in got.columns)
        one, other = f"SELECT {columns} FROM want", f"SELECT {columns} FROM got"
        assert con.sql(f"{one} EXCEPT ALL {other}").fetchall() == [] == con.sql(f"{other} EXCEPT ALL {one}").fetchall()
        return len(got)

    return run


def embeddings(values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"vec_id": np.arange(len(values)), "embedding": list(values.astype("f4")), "label": np.zeros(len(values), "i4")})


def test_indexed_images_reckons_in_floats(against_sql):
    """Values whose product and sum round up to a whole number as floats, and stay below it as doubles."""
    v = np.random.default_rng(1).uniform(-0.3, 0.5, 400_000).astype("f4")
    odd = v[np.floor(v * np.float32(300) + np.float32(100)) != np.floor(v.astype("f8") * 300 + 100)]
    assert len(odd)
    assert against_sql("indexed_images", embeddings=embeddings(np.resize(odd, (3, 64)))) == 3


def test_mosaic_box_mean_beside_absent_tiles(against_sql):
    """The last row of tiles is not full: means near the gap are of the pixels that are there."""
    assert against_sql("mosaic_box_mean", embeddings=embeddings(np.random.default_rng(2).normal(size=(23, 64)))) == 23 * 64


def test_percent_text_rounds_ties_to_even(against_sql):
    """99.25 is a tie in binary, 99.35 is not."""
    prices = np.r_[198_500.0, 198_700.0, 198_900.0, 100.0, 300.0, 0.0, -50.0, 200_000.0, 200_001.0, np.arange(0, 200_000, 50), np.random.default_rng(3).uniform(0, 2e5, 2000).round(2)]
    assert against_sql("percent_text", orders=pd.DataFrame({"o_orderkey": np.arange(len(prices)), "o_totalprice": prices})) == len(prices)


def test_table_digest_of_many_rows(against_sql):
    """Over 16,384 rows a tree of about 1,024 rows a leaf has two levels, the SQL's still one."""
    n = 20_000
    orders = pd.DataFrame({"o_orderkey": np.arange(n) // 2 * 2, "o_custkey": np.arange(n) % 7, "o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    assert against_sql("table_digest", orders=orders) == 17


def test_scenes_are_dealt_to_tasks_by_number(spark):
    """Requests are few bytes and much work: Spark itself would give them all to one task."""
    requests = spark.range(400).select(F.col("id").alias("scene_id"), F.lit(30.0).alias("depth"), F.col("id").cast("double").alias("turn"))
    scenes = fields.simulated(requests.union(requests), 8)
    assert scenes.rdd.getNumPartitions() >= 7 and scenes.count() == 400


def test_scene_summary_is_that_of_the_pixels(spark):
    requests = spark.range(20).select(F.col("id").alias("scene_id"), F.lit(30.0).alias("depth"), F.col("id").cast("double").alias("turn"))
    got = fields.scene_summary(fields.simulated(requests, 16), 16).orderBy("scene_id").toPandas()
    p = fields.simulate(requests, 16).toPandas().sort_values(["scene_id", "y", "x"])
    for r, (_, g) in zip(got.itertuples(), p.groupby("scene_id")):
        top = g.loc[g["down_m"].idxmax()]
        assert (r.pixels, r.peak_m, r.peak_at.y, r.peak_at.x) == (256, top.down_m, top.y, top.x)
        assert np.allclose([r.label_percent, r.water_percent, r.mean_coherence, r.cycles], [100 * g["mask"].mean(), 100 * g["water_mask"].mean(), g["coherence"].astype("f8").mean(), np.ptp(g["phase_rad"]) / (2 * np.pi)])


def test_segment_convergence_reckons_each_bound_once(spark, sf):
    """One error function for the 65 bounds of a place, not two for each of 120 segments."""
    plan = catalog.QUERIES["segment_convergence"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EXP(") == 1


def test_quantiles_sort_no_group(spark, monkeypatch):
    """Rows of a group are counted by hash, and meet its splitters without a sort."""
    plans, keep = {}, quantiles.staged
    monkeypatch.setattr(quantiles, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name))
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.rand(3).alias("v"))
    assert quantiles.exact_quantiles(df, ["k"], "v", [0.5], 100).count() == 2
    assert "SortAggregate" not in plans["classes"] and "SortMergeJoin" not in plans["classes"]


def test_scene_audit_shuffles_requests_only(spark, sf):
    """What a scene breaks is counted where its row is, so no pixel is shuffled."""
    plan = catalog.QUERIES["scene_audit"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
