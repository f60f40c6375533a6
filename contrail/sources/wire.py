"""Keyed state messages -> typed, enriched rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.phase import flight_phase
from contrail.functions.time import lenient_instant
from contrail.schema import STATE_SCHEMA

KAFKA_META = ("key", "partition", "offset", "timestamp")


def kafka_stream(spark: SparkSession, bootstrap: str, topic: str, max_offsets: int | None = None,
                 starting: str = "latest", min_partitions: int | None = None, fail_on_data_loss: bool = True) -> DataFrame:
    """The state topic as a stream (needs the Kafka connector jar).

    ``max_offsets`` caps a trigger (default: no cap, so a backlog cannot age
    out behind a fixed rate); offsets lost to retention fail the query unless
    ``fail_on_data_loss`` is False.

    ``min_partitions`` splits large topic partitions into more Spark tasks
    (a topic with few partitions would otherwise bound the parallelism of
    every micro-batch)."""
    r = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("failOnDataLoss", str(fail_on_data_loss).lower())
    )
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", int(max_offsets))
    if min_partitions:
        r = r.option("minPartitions", int(min_partitions))
    return r.load()


def parse_states(df: DataFrame, value_col: str = "value", keep: Sequence[str] = KAFKA_META) -> DataFrame:
    """P4 + P5: PERMISSIVE JSON parse with the fixed schema; a malformed
    message becomes an all-null row and is kept (see ``split_malformed``)."""
    keep = [c for c in keep if c in df.columns]
    data = F.from_json(F.col(value_col).cast("string"), STATE_SCHEMA)
    return df.select(data.alias("data"), *keep).select("data.*", *keep)


def enrich(parsed: DataFrame, **phase_params) -> DataFrame:
    """Phase and event time from the parsed state. Works on
    batch and streaming DataFrames alike (no shuffle)."""
    return parsed.withColumn("flight_phase", flight_phase(**phase_params)).withColumn(
        "time", lenient_instant(F.col("ingested_at"))
    ).withColumn("ingested_at", F.col("time"))


def reject_reason():
    """Why a message cannot enter history: ``no key`` (junk JSON, missing or
    blank id), ``no time`` (missing or unreadable stamp); null if it can."""
    return (F.when(F.col("icao24").isNull() | (F.col("icao24") == ""), "no key")
            .when(F.col("time").isNull(), "no time"))


def split_malformed(enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History rows, and the others with their ``reason``: every message goes
    to exactly one side."""
    marked = enriched.withColumn("reason", reject_reason())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def states_from_wire(wire: DataFrame, keep: Sequence[str] = KAFKA_META) -> DataFrame:
    return enrich(parse_states(wire, keep=keep))
