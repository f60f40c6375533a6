"""K1 / K5: state rows -> keyed JSON messages, nulls kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.numeric import finite_or_null
from contrail.schema import STATE_FIELDS

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def state_json(columns: list[str] | None = None) -> Column:
    """The state record as JSON text: every field present (null included),
    NaN/infinity written as null, instants as ISO text."""
    cols = []
    for name, dtype in STATE_FIELDS:
        if columns is not None and name not in columns:
            continue
        c = F.col(name)
        if dtype.typeName() == "double":
            c = finite_or_null(c)
        cols.append(c.alias(name))
    return F.to_json(F.struct(*cols), JSON_OPTIONS)


def to_wire(df: DataFrame) -> DataFrame:
    """K1: (key, value) rows ready for a Kafka sink or a file sink."""
    return df.select(F.col("icao24").alias("key"), state_json().alias("value"))


def write_kafka(df: DataFrame, bootstrap: str, topic: str, extra: dict | None = None) -> None:
    """K1 on a broker (needs the Kafka connector on the classpath)."""
    w = to_wire(df).write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic)
    for k, v in (extra or {}).items():
        w = w.option(k, v)
    w.save()


def write_json_files(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Broker-free K1: keyed JSON lines, hash-partitioned by key so one key's
    messages stay in one file, like one topic partition."""
    out = to_wire(df)
    if partitions:
        out = out.repartition(partitions, "key")
    out.write.mode("append").json(path)
