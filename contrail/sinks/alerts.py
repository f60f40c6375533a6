"""K7: the alert records of each tick, appended idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.sinks.pointer import matching


def append_alerts(alerts: DataFrame, root: str, tick_id: int) -> None:
    """One folder per tick, overwritten on replay; partitioned by date of
    the ETA for retention."""
    (alerts.withColumn("eta_date", F.to_date("eta")).write.mode("overwrite")
        .partitionBy("eta_date").parquet(f"{root}/tick_id={int(tick_id)}"))


def read_alerts(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Every alert fired so far, or before a tick: the ``fired`` input of the
    next one. None if nothing fired."""
    # a tick without alerts has no date folder
    ticks = {int(p.split("/tick_id=")[1].split("/")[0]) for p in matching(spark, f"{root}/tick_id=*/eta_date=*")}
    paths = [f"{root}/tick_id={t}" for t in sorted(ticks) if before is None or t < before]
    return spark.read.option("basePath", root).parquet(*paths) if paths else None
