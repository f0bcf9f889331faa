"""Quantiles, digests, table functions, tiled inference, clustered reads and review streams against plain versions."""

import random
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.operators import fingerprints, inference
from gridloom.operators.quantiles import exact_quantiles
from gridloom.sources.clustered import interleaved, read_window, write_clustered
from gridloom.streaming import reviews


@pytest.mark.parametrize("small", [10_000, 50, 1])
def test_exact_quantiles(spark, small):
    draw = np.random.default_rng(2)
    groups = {
        "a": draw.normal(size=4000), "b": np.repeat([3.0, 3.0, 5.0], 500), "c": np.exp(draw.normal(size=3000) * 60), "d": np.array([7.0]), "e": np.r_[np.full(2500, 1.5), draw.random(300), -1e300, 1e300],
        None: draw.integers(0, 5, 900).astype(float),
    }
    rows = [(k, "x", float(v)) for k, values in groups.items() for v in values] + [("a", "x", None), ("f", "x", None)]
    shares = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, other string, v double").repartition(6), ["k"], "v", shares, small).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n == len(values)
        assert np.allclose([got[k][f"q{i}"] for i in range(len(shares))], np.quantile(values, shares), rtol=1e-12, atol=0)


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.range(1001).select(F.col("id").cast("int").alias("v"))
    assert [tuple(r) for r in exact_quantiles(df, [], "v", [0.5, 0.25], 10).collect()] == [(1001, 500.0, 250.0)]
    assert exact_quantiles(df.limit(0), [], "v", [0.5]).collect() == []


def test_no_task_sorts_a_group(spark):
    """The rows that are ranked one by one are few, however large the group."""
    df = spark.range(200_000).select(F.rand(3).alias("v"))
    assert np.isclose(exact_quantiles(df, [], "v", [0.5], 500).first().q0, np.median([r.v for r in df.collect()]))


def test_table_digest(spark):
    rows = [(k, f"row {k}") for k in range(3000)] + [(1, "row 1")] * 40
    df = spark.createDataFrame(rows, "k int, t string")
    nodes = lambda d, leaf=50: {(r.level, r.prefix): (r["rows"], r.digest) for r in fingerprints.tree_digest(d, F.col("t"), leaf).collect()}
    one = nodes(df.repartition(3))
    assert one == nodes(df.orderBy(F.desc("t")).repartition(11)) and one[0, ""][0] == 3040
    assert max(level for level, _ in one) == 2
    other = nodes(df.withColumn("t", F.when(F.col("k") == 77, "row 7x").otherwise(F.col("t"))))
    changed = {p for p in one if one[p] != other.get(p)} | {p for p in other if p not in one}
    assert (0, "") in changed and len(changed) <= 5
    fewer = nodes(spark.createDataFrame(rows[:-1], "k int, t string"))
    assert fewer[0, ""][1] != one[0, ""][1]
    assert len(nodes(df, 10_000)) == 1 and nodes(df.limit(0))[0, ""][0] == 0
    assert nodes(spark.createDataFrame([(1, None)], "k int, t string")) == nodes(spark.createDataFrame([(1, "")], "k int, t string"))


def test_file_faults(spark):
    manifest = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, sha256 string")
    hashes = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("d", "5")], "path string, sha256 string")
    assert sorted(map(tuple, fingerprints.file_faults(manifest.union(spark.createDataFrame([("e", "6")], "path string, sha256 string")), hashes).collect())) == [("b", "altered"), ("c", "altered"), ("d", "unlisted"), ("e", "missing")]


def test_table_functions(spark):
    tables.register(spark)
    from gridloom.operators.raster import tile_starts

    lengths = spark.createDataFrame([(n,) for n in (0, 1, 5, 8, 9, 20)] + [(None,)], "n int")
    lengths.createOrReplaceTempView("lengths")
    got = sorted(map(tuple, spark.sql("SELECT n, t.start FROM lengths, LATERAL tile_starts(n, 8, 5) t").collect()))
    assert got == sorted(map(tuple, lengths.where("n IS NOT NULL").select("n", F.explode(tile_starts(F.col("n"), 8, 5))).collect()))
    assert [tuple(r) for r in spark.sql("SELECT * FROM patches(5, 9, 8, 8)").collect()] == [(0, 0, 5, 8), (0, 1, 5, 9)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM array_runs(array(1, 1, 0, 2, NULL, 1))").collect()] == [(0, 2), (3, 4), (5, 6)]
    assert spark.sql("SELECT * FROM array_runs(CAST(NULL AS array<int>))").collect() == []
    for text in ("tile_starts('a', 8, 5)", "tile_starts(9, 0, 5)", "patches(9, 9, 4, CAST(NULL AS INT))", "array_runs(3)"):
        with pytest.raises(Exception, match="(?i)whole number|at least 1|not an array"):
            spark.sql(f"SELECT * FROM {text}").collect()


def plain(image, predict, size, stride, scales, phase):
    """Tiled scores of one scene by plain loops over output pixels."""
    def resize(a, height, width, box):
        def one(n, m):
            out = np.zeros((m, n))
            for i in range(m):
                f, c = max(Fraction(1), Fraction(n, m)), Fraction(2 * i + 1, 2) * n / m
                for k in range(n):
                    t = (k + Fraction(1, 2) - c) / f
                    out[i, k] = -Fraction(1, 2) < t <= Fraction(1, 2) if box else max(0.0, 1 - abs(t))
            return out / out.sum(1, keepdims=True)
        return one(a.shape[0], height) @ a @ one(a.shape[1], width).T

    total = np.zeros(image.shape[1:])
    for s in scales:
        small = image if s == 1 else np.stack([resize(c, -(-image.shape[1] // s), -(-image.shape[2] // s), True) for c in image])
        if phase and s > 1:
            small = small / np.hypot(*small)
        h, w = small.shape[1:]
        line = np.maximum(np.hanning(size), 0.05)
        sums, weight = np.zeros((h, w)), np.zeros((h, w))
        for y in sorted({*range(0, max(h - size, 0) + 1, stride), max(h - size, 0)}):
            for x in sorted({*range(0, max(w - size, 0) + 1, stride), max(w - size, 0)}):
                crop = np.array([[[c[min(y + i, h - 1), min(x + j, w - 1)] for j in range(size)] for i in range(size)] for c in small])
                score = predict(crop[None])[0]
                for i in range(min(size, h - y)):
                    for j in range(min(size, w - x)):
                        sums[y + i, x + j] += score[i, j] * line[i] * line[j]
                        weight[y + i, x + j] += line[i] * line[j]
        total += resize(sums / weight, *image.shape[1:], False) / len(scales)
    return total


def made():
    """A model whose score of a pixel depends on its neighbours and its window; made here, as tasks can't import this file."""
    return lambda: lambda crops: crops[:, 0] + 0.3 * np.roll(crops[:, 0], 1, axis=1) + (crops[:, 1] if crops.shape[1] > 1 else 0) ** 2 + crops.mean((1, 2, 3))[:, None, None]


@pytest.mark.parametrize("scales,phase", [((1,), False), ((1, 2, 3), False), ((2, 5), True)])
def test_multiscale(spark, scales, phase):
    draw, smooth = np.random.default_rng(9), made()
    images = {k: draw.normal(size=(2, *shape)) for k, shape in enumerate(((13, 17), (5, 9), (1, 1), (8, 8)))}
    rows = [(k, *a.shape[1:], [c.ravel().tolist() for c in a]) for k, a in images.items()]
    df = spark.createDataFrame(rows, "scene long, height int, width int, data array<array<double>>")
    got = {r.scene: np.array(r.data).reshape(r.height, r.width) for r in inference.multiscale(df, smooth, 8, 5, scales, phase, batch=3).collect()}
    for k, a in images.items():
        assert np.allclose(got[k], plain(a, smooth(), 8, 5, scales, phase), atol=1e-9), k
    with pytest.raises(ValueError):
        inference.multiscale(df, smooth, 8, 5, (1, 1))


def test_weights_of_known_sizes():
    assert np.allclose(inference.weights(2, 4, "bilinear"), [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]])
    assert np.allclose(inference.weights(4, 2, "box"), [[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
    assert np.allclose(inference.weights(5, 5, "bilinear"), np.eye(5)) and np.allclose(inference.weights(7, 7, "box"), np.eye(7))


def test_clustered_windows_touch_few_row_groups(spark, tmp_path):
    side, n = 4, 64
    rows = [(y * side, x * side, side, side, [float(k % 7) for k in range(400)]) for y in range(n) for x in range(n) for k in [y * n + x]]
    df = spark.createDataFrame(rows, "y0 int, x0 int, h int, w int, data array<double>").repartition(9)
    path = str(tmp_path / "t")
    write_clustered(df.withColumn("data", F.transform("data", lambda v: v + F.rand())), path, step=side, files=4, group_bytes=50_000)
    top, left, bottom, right = 101, 50, 140, 90
    got = {(r.y0, r.x0) for r in read_window(spark, path, top, left, bottom, right, most=side).collect()}
    assert got == {(y, x) for y, x, h, w, _ in rows if y < bottom and y + h > top and x < right and x + w > left}
    touched = groups = 0
    for file in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = meta.schema.names
        for k in range(meta.num_row_groups):
            low, high = ({c: getattr(meta.row_group(k).column(names.index(c)).statistics, s) for c in ("y0", "x0")} for s in ("min", "max"))
            groups += 1
            touched += high["y0"] > top - side and low["y0"] < bottom and high["x0"] > left - side and low["x0"] < right
    assert groups >= 16 and touched <= 0.35 * groups
    assert "PushedFilters: [" in read_window(spark, path, top, left, bottom, right, most=side)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(Exception, match="(?i)exists"):
        write_clustered(df, path)


def test_interleaved(spark):
    draw = random.Random(4)
    places = [(draw.randrange(1 << 24), draw.randrange(1 << 24)) for _ in range(200)] + [(0, 0), ((1 << 24) - 1, (1 << 24) - 1)]
    got = spark.createDataFrame(places, "y int, x int").select("y", "x", interleaved(F.col("y"), F.col("x")).alias("z")).collect()
    for r in got:
        assert r.z == sum(((r.y >> k & 1) << (2 * k + 1)) | ((r.x >> k & 1) << (2 * k)) for k in range(24))


def test_review_stream_after_any_batches_and_a_restart(spark, tmp_path):
    draw = random.Random(8)
    events = [(draw.randrange(12), t, draw.choice(["accepted", "rejected", "regenerated", "viewed"])) for t in range(300)]
    kind = "sample long, at long, kind string"
    want = sorted(map(tuple, reviews.reviewed(spark.createDataFrame(events, kind)).select("sample", "revision", "status", "decisions", "events").collect()))
    for name, order in (("sorted", events), ("mixed", draw.sample(events, len(events)))):
        source, out = tmp_path / name / "in", str(tmp_path / name / "out")
        for k, a in enumerate(range(0, 300, 100)):
            spark.createDataFrame(order[a : a + 100], kind).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
            got = reviews.kept(reviews.reviewing(stream), out)  # each call is a restart
        assert sorted(map(tuple, got.select("sample", "revision", "status", "decisions", "events").collect())) == want


def test_resampling_weights_are_made_once():
    """Scenes of one size share them."""
    assert inference.weights(8, 4, "box") is inference.weights(8, 4, "box")
