"""K2: idempotent history table, by date, and T6: its retention.

A micro-batch writes ``<root>/data/date=<d>/segment=b<n>/`` with dynamic
overwrite and then commits the segments it wrote: replaying the batch replaces
exactly those folders and commits nothing new. A date that has gathered more
than MOST_SEGMENTS of them has all but the newest batch rewritten as one, so
the number of files is bounded by the dates, not by the batches. Retention
commits a table without the old dates and then removes their folders whole.
Readers ask the committed list only; folders a commit replaced stay until the
next compaction, for those that still read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.schema import HISTORY_COLUMNS_WITH_CATEGORY
from contrail.sinks.pointer import commit_pointer, matching, read_pointer, remove

MOST_SEGMENTS = 16
ROWS_PER_TASK = 2_000_000


def _write(df: DataFrame, root: str, segment: str, tasks: int, max_records_per_file: int) -> None:
    (df.withColumn("segment", F.lit(segment))
        .repartitionByRange(tasks, "date", "icao24", "time")
        .sortWithinPartitions("date", "icao24", "time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("date", "segment")
        .parquet(f"{root}/data"))


def _dates(spark: SparkSession, root: str, segment: str) -> list[str]:
    """The dates that have a segment of that name."""
    return sorted(p.split("/date=")[1].split("/")[0] for p in matching(spark, f"{root}/data/date=*/segment={segment}"))


def append_batch(df: DataFrame, root: str, batch_id: int, partitions: int | None = None,
                 max_records_per_file: int = 5_000_000, most_segments: int = MOST_SEGMENTS) -> None:
    """Write one micro-batch (or one backfill chunk) of history.

    Range-partitioned on (date, icao24, time): files hold contiguous key
    ranges sorted by time (the layout the keyed and time scans prune on), and
    a hot aircraft's day is split across tasks because ``time`` is part of
    the range key. ``partitions`` defaults to the session's shuffle
    partitions; AQE does not coalesce an explicit range repartition.
    """
    spark = df.sparkSession
    now = read_pointer(spark, root) or {"segments": {}, "merged": -1, "newest": -1, "old": []}
    if batch_id <= now["merged"]:
        return  # already part of a merged segment
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.select(*HISTORY_COLUMNS_WITH_CATEGORY)
            .filter(F.col("icao24").isNotNull() & F.col("time").isNotNull())
            .withColumn("date", F.to_date("time")))
    segment = f"b{int(batch_id)}"
    _write(rows, root, segment, n, max_records_per_file)
    for d in _dates(spark, root, segment):
        now["segments"][d] = sorted({*now["segments"].get(d, []), segment})
    now["newest"] = max(now["newest"], int(batch_id))
    commit_pointer(spark, root, now)
    if any(len(s) > most_segments for s in now["segments"].values()):
        compact(spark, root, most_segments, max_records_per_file)


def compact(spark: SparkSession, root: str, most_segments: int = MOST_SEGMENTS, max_records_per_file: int = 5_000_000) -> None:
    """Rewrite the segments of every date that has more than ``most_segments``
    as one. The newest batch is left out: only that one can be replayed."""
    now = read_pointer(spark, root)
    last = f"b{now['newest']}"
    full = {d: [s for s in names if s != last] for d, names in now["segments"].items() if len(names) > most_segments}
    if not full:
        return
    merged = f"c{now['newest'] - 1}"
    rows = spark.read.option("basePath", f"{root}/data").parquet(
        *(f"{root}/data/date={d}/segment={s}" for d, names in full.items() for s in names)).drop("segment")
    size = rows.count()
    _write(rows, root, merged, max(1, -(-size // ROWS_PER_TASK)), max_records_per_file)
    for path in now["old"]:
        remove(spark, path)
    now["old"] = [f"{root}/data/date={d}/segment={s}" for d, names in full.items() for s in names if s != merged]
    for d in full:
        now["segments"][d] = [merged] + ([last] if last in now["segments"][d] else [])
    now["merged"] = now["newest"] - 1
    commit_pointer(spark, root, now)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """History table; filters on `date` prune directories, on `time`/`icao24`
    prune row groups."""
    now = read_pointer(spark, root)
    paths = [f"{root}/data/date={d}/segment={s}" for d, names in sorted((now or {"segments": {}})["segments"].items()) for s in names]
    if not paths:
        raise ValueError(f"no history under {root}")
    return spark.read.option("basePath", f"{root}/data").parquet(*paths).drop("segment")


def write_jdbc(df: DataFrame, url: str, table: str, props: dict) -> None:
    """K2 into a relational table (driver jar must be on the classpath)."""
    w = df.select(*HISTORY_COLUMNS_WITH_CATEGORY).write.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in {"batchsize": "1000", **props}.items():
        w = w.option(k, v)
    w.mode("append").save()


def expired_dates(spark: SparkSession, root: str, as_of, keep: str) -> list[str]:
    """The dates that lie entirely before ``as_of - keep``."""
    from contrail.functions.time import ntz

    cutoff = spark.range(1).select(F.to_date(ntz(as_of) - F.expr(f"INTERVAL {keep}")).alias("d")).first()["d"]
    now = read_pointer(spark, root) or {"segments": {}}
    return sorted(d for d in now["segments"] if d < str(cutoff))


def retain(spark: SparkSession, root: str, as_of, keep: str) -> list[str]:
    """Drop those dates. The table without them is committed first, then
    their folders go; whoever died in between finishes the next time."""
    gone = expired_dates(spark, root, as_of, keep)
    now = read_pointer(spark, root)
    if now is None:
        return []
    now["segments"] = {d: s for d, s in now["segments"].items() if d not in gone}
    now["dropped"] = sorted({*now.get("dropped", []), *gone})
    commit_pointer(spark, root, now)
    for d in now["dropped"]:
        remove(spark, f"{root}/data/date={d}")
    now["dropped"], now["old"] = [], [p for p in now["old"] if p.split("/date=")[1].split("/")[0] not in gone]
    commit_pointer(spark, root, now)
    return gone
