"""Reading the driver-provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contrail.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, listed anew at every call so that a rewritten table
    is seen. Column pruning and filters reach the parquet scan because the
    plan stays declarative from here on."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
