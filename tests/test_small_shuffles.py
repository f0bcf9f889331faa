"""Shuffles of small and of staged tables: tasks and files no more than they are worth."""

import pytest
from pyspark.sql import functions as F

from gridloom import session
from gridloom.llm import ngram_join as J
from gridloom.llm import components as C


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _shuffle_files(spark):
    return {str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_staged_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    out = session.staged(spark.range(10_000).groupBy(F.col("id") % 100).agg(F.count("*").alias("n")), "counted")
    assert out.count() == 100
    grown = _shuffle_files(spark) - before
    assert sum(1 for f in grown if f.endswith(".data")) <= 4  # those of the count just made
    assert spark.conf.get(session.CLEANUP, None) in (None, "false")
    session.unstaged(out)


def test_small_joins_are_written_by_few_tasks(spark, many_partitions, monkeypatch):
    files, real = {}, session.staged

    def counted(df, name):
        out = real(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(J, "staged", counted)
    monkeypatch.setattr(C, "staged", counted)
    texts = [(k, " ".join(f"w{k // 4}x{i}" for i in range(60 + k % 4))) for k in range(800)]
    rows = J.ngram_join(spark.createDataFrame(texts, "doc_id long, text string"), width=3, num=9, den=10).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: k // 4 * 4 for k in range(800)}
    few = {"listed-classes", "few", "kept", "shared", "labelled", "groups", "pairs", "tested", "edges", "found"}
    assert few <= set(files) and max(files[n] for n in few) <= session.LEAST


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_fresh_draws_keep_only_what_is_drawn(spark, monkeypatch, few):
    from gridloom.operators import manifests as M

    n, written = 300, []
    monkeypatch.setattr(M, "FEW", few)
    real = M.staged
    monkeypatch.setattr(M, "staged", lambda df, name: (out := real(df, name), written.append(out.count()))[0])
    got = M.fresh_draws(spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame([(s,) for s in range(20)], "seed long"), "k", 8, "seed", n * 4 // 3 + 20).collect()
    assert len({r.seed for r in got}) == len({r.k for r in got}) == len(got) == n and min(r.seed for r in got) >= 20
    assert sum(written) <= 20 + n + sum(r.tries + 1 for r in got) + n  # used, draws, once more for a fold, result; not all rows in each round
