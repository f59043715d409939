"""Readers for the input tables a run is given (one Parquet file or folder each)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_READS: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. The DataFrame is reused within a session: the footer and
    listing work is done once, and identical scans let Spark reuse exchanges."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    from fleetpulse.session import session_key

    key = (session_key(spark), path)
    df = _READS.get(key)
    if df is None:
        df = _READS[key] = spark.read.parquet(path)
    return df
