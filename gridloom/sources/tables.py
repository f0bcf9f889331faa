"""Scans of the Parquet tables of one data folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder; filters and column pruning reach the scan."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # for the workers that this session starts
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
