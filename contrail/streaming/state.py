"""Keyed state on streams, kept in RocksDB.

The newest record per key is a grouped maximum: it runs in the JVM and combines
rows before the shuffle. What a grouping cannot say (the last n points, the
last kept point, expiry, deletes that come late) is a stateful processor with
one packed value per bucket of keys and one timer (one value per key for the
last kept point): a call for a key costs more than the work on its rows. Rows of a key that cannot matter are
dropped before the shuffle, slice by slice, so a hot key sends few of them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE = 131_072     # rows that a task holds at a time to find the newest of each key
BUCKETS = 4096      # values that the keys of a stream are held in
POINT = "<qdd"       # order, longitude, latitude


def on_disk_state(spark: SparkSession) -> None:
    """State in RocksDB: on the executors' disks, incremental checkpoints; needed by the processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def latest_state(stream: DataFrame, key: str = "icao24", order: Sequence[str] = ("time", "offset")) -> DataFrame:
    """The newest record per key under ``order`` (event time with the
    offset as tie-break by default; ``("offset",)`` is pure arrival order,
    where a late row overwrites a newer one). Rows without a key are
    skipped (T10). Update mode: changed keys only."""
    on_disk_state(stream.sparkSession)
    src = stream.filter(stream[key].isNotNull() & (stream[key] != ""))
    rest = [c for c in src.columns if c not in order and c != key]
    return src.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("s")).select(
        *(F.col(key) if c == key else F.col("s")[c].alias(c) for c in src.columns))


def last_of_slices(stream: DataFrame, key: str, order: str, n: int, rows: int = SLICE) -> DataFrame:
    """Of every ``rows`` rows a task reads, the ``n`` newest rows per key: all
    that can be among the ``n`` newest of a micro-batch, and few of a hot key.
    What a slice leaves goes into the next one unless it fills half of it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(stream.schema)

    def newest(part: pa.Table) -> pa.Table:
        at = pa.table({"key": part[key], "order": part[order], "row": pa.array(np.arange(part.num_rows))})
        by = pc.sort_indices(at, [("key", "ascending"), ("order", "descending"), ("row", "ascending")]).to_numpy()
        keys = part[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[by]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        place = np.arange(len(by))
        rank = place - np.maximum.accumulate(np.where(first, place, 0))
        return part.take(pa.array(np.sort(by[rank < n])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.cast(schema))
            size += batch.num_rows
            if size < rows:
                continue
            left = newest(pa.Table.from_batches(held, schema))
            if left.num_rows > rows // 2:
                yield from left.to_batches(max_chunksize=10_000)
                left = left.slice(0, 0)
            held, size = left.to_batches(), left.num_rows
        if size:
            yield from newest(pa.Table.from_batches(held, schema)).to_batches(max_chunksize=10_000)

    return stream.mapInArrow(run, stream.schema)


class Trail(StatefulProcessor):
    """T4: at most ``n`` points per key, newest first; the keys of a bucket are
    one value, so a micro-batch costs one read and one write a bucket."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trails = handle.getValueState("trails", "keys array<string>, points array<binary>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        trails = dict(zip(*(self.trails.get() or ((), ()))))
        came: dict = {}
        for r in rows:
            came.setdefault(r["icao24"], {})[r["ord"]] = (r["ord"], r["lon"], r["lat"])
        for k, points in came.items():
            held = {p[0]: p for p in struct.iter_unpack(POINT, trails.get(k, b""))} | points
            came[k] = [held[ord_] for ord_ in sorted(held, reverse=True)[:self.n]]
            trails[k] = b"".join(struct.pack(POINT, *p) for p in came[k])
        if came:
            self.trails.update((list(trails), [bytes(p) for p in trails.values()]))
        for k, points in came.items():
            for i, (ord_, lon, lat) in enumerate(points, 1):
                yield Row(icao24=k, rn=i, lon=lon, lat=lat, ord=ord_)

    def close(self) -> None:
        pass


def bucket(key: str, buckets: int) -> Column:
    """Where the state of a key is held."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def rolling_trail(stream: DataFrame, n: int = 20, order: str = "offset", buckets: int = BUCKETS) -> DataFrame:
    """T4: the last ``n`` positioned observations per aircraft in arrival
    (``order``) order, repeats kept. Emits the whole (bounded) trail of every
    key that changed, one row per point (``rn`` = 1 newest). ``order`` tells
    the messages of an aircraft apart, as an offset does. Keys are held in
    ``buckets`` by their hash; a running stream must keep their number."""
    on_disk_state(stream.sparkSession)
    src = stream.filter(stream["icao24"].isNotNull() & stream["latitude"].isNotNull() & stream["longitude"].isNotNull()).select(
        "icao24", stream[order].alias("ord"), stream["longitude"].alias("lon"), stream["latitude"].alias("lat"))
    return last_of_slices(src, "icao24", "ord", n).withColumn("bucket", bucket("icao24", buckets)).groupBy("bucket").transformWithState(
        Trail(n), "icao24 string, rn bigint, lon double, lat double, ord bigint", "Update", "None")


class Deadband(StatefulProcessor):
    """One reference point per key."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "lat double, lon double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ref = start = self.kept.get()
        for r in sorted(((r["at"], r["event_id"], r["latitude"], r["longitude"]) for r in rows), key=lambda r: (r[0] is not None, *r)):
            if ref is None or abs(r[2] - ref[0]) >= self.threshold or abs(r[3] - ref[1]) >= self.threshold:
                ref = (r[2], r[3])
                yield Row(icao24=key[0], at=r[0], event_id=r[1], latitude=r[2], longitude=r[3])
        if ref is not None and ref is not start:
            self.kept.update((ref[0], ref[1]))

    def close(self) -> None:
        pass


def moved_points(stream: DataFrame, threshold: float = 0.001) -> DataFrame:
    """P17 on a stream: a point passes only if it lies at least ``threshold``
    degrees from the last one of its aircraft that passed. The points of an
    aircraft are to arrive in the order of their time from batch to batch;
    inside a batch they are put in order (``time``, ``event_id``)."""
    on_disk_state(stream.sparkSession)
    src = stream.filter(stream["icao24"].isNotNull() & stream["latitude"].isNotNull() & stream["longitude"].isNotNull()).select(
        "icao24", F.unix_micros(F.col("time").cast("timestamp")).alias("at"), "event_id", "latitude", "longitude")
    out = src.groupBy("icao24").transformWithState(
        Deadband(threshold), "icao24 string, at bigint, event_id bigint, latitude double, longitude double", "Append", "None")
    return out.select("icao24", F.timestamp_micros("at").cast("timestamp_ntz").alias("time"), "event_id", "latitude", "longitude")


class Changes(StatefulProcessor):
    """The newest word on each key of a bucket: an entry that expires, or the
    mark of a delete. A bucket is one value and has one timer, at the earliest
    expiry in it, so a micro-batch costs a few calls a bucket, not a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "timer bigint, packed binary")  # key: [at, seq, gone, expires, entry]

    def _held(self) -> tuple[int | None, dict]:
        was = self.newest.get()
        return (None, {}) if was is None else (was[0], json.loads(was[1]))

    def _keep(self, timer: int | None, held: dict) -> None:
        """``timer`` is the one that still stands; an earlier one is replaced,
        a later one needs none (it finds nothing to expire and is set anew)."""
        if not held:
            return self.newest.clear()
        first = -(-min(e[3] for e in held.values()) // 1000)  # milliseconds, never before its time
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer := first)
        self.newest.update((timer, json.dumps(held, separators=(",", ":")).encode()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, held = self._held()
        changed = {}
        for r in rows:
            best = held.get(r["key"])
            if best is None or (r["at"], r["seq"]) >= (best[0], best[1]):
                now = [r["at"], r["seq"], r["gone"], r["expires"], r["entry"]]
                changed.setdefault(r["key"], best)
                held[r["key"]] = now
        changed = {k: held[k] for k, was in changed.items() if held[k] != was}
        if changed:
            self._keep(timer, held)
        for k, e in changed.items():
            yield Row(key=k, at=e[0], seq=e[1], change="deleted" if e[2] else "live", entry=e[4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        timer, held = self._held()
        if timer != fired:
            return
        last = max(fired, timerValues.getCurrentWatermarkInMs())  # all whose own timer would go off now
        over = {k: e for k, e in held.items() if -(-e[3] // 1000) <= last}
        self._keep(None, {k: e for k, e in held.items() if k not in over})
        for k, e in over.items():
            yield Row(key=k, at=e[0], seq=e[1], change="expired", entry=e[4])

    def close(self) -> None:
        pass


def keyed_changes(stream: DataFrame, key: Column, at: str, seq: Column, ttl: str, gone: Column | None = None,
                  late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Entries that live ``ttl`` after ``at`` (event time).

    One row per change of a key (key, at, seq, change, entry): ``live`` for a
    new newest entry, ``deleted`` for a delete that is newer than it,
    ``expired`` when the watermark (``late`` behind the newest ``at``) has
    passed its time. A delete stays as a mark until its own time is over, so an
    older entry that arrives after it changes nothing. ``entry`` holds the
    columns of the row as JSON. Keys are held in ``buckets`` by their hash; a
    running stream must keep their number."""
    on_disk_state(stream.sparkSession)
    cols = stream.columns
    stamp = F.col(at).cast("timestamp")
    src = stream.filter(F.col(at).isNotNull()).select(
        key.alias("key"), stamp.alias("clock"), F.unix_micros(stamp).alias("at"), seq.cast("bigint").alias("seq"),
        (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
        F.unix_micros(stamp + F.expr(f"INTERVAL {ttl}")).alias("expires"), F.to_json(F.struct(*cols)).alias("entry"))
    return (src.filter("key IS NOT NULL").withColumn("bucket", bucket("key", buckets)).withWatermark("clock", late).groupBy("bucket")
            .transformWithState(Changes(), "key string, at bigint, seq bigint, change string, entry string", "Update", "EventTime"))


def entries(changes: DataFrame, schema: str) -> DataFrame:
    """What is live after all ``changes``: the columns of ``schema`` of every
    key whose newest change is neither a delete nor an expiry."""
    rank = (F.col("change") == "expired").cast("int")
    last = changes.groupBy("key").agg(F.max_by(F.struct("change", "entry"), F.struct("at", "seq", rank)).alias("c"))
    return last.filter("c.change = 'live'").select(F.from_json("c.entry", schema).alias("e")).select("e.*")
