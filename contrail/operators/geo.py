"""Path geometry: W6 W7 J10 F20 P17."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.geo import bearing, interpolate, planar_length
from contrail.operators.latest import with_position
from contrail.operators.ordered import with_previous, with_running_sum
from contrail.operators.trails import hourly
from contrail.session import materialize

ORDER = ("time", "event_id")


def segments(history: DataFrame, bucket: Column | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Consecutive positioned points of each aircraft as segments
    (lat1, lon1) -> (lat2, lon2), with planar length and bearing."""
    pts = with_position(history).select("icao24", *order, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    prev = with_previous(pts, ["icao24"], order, ["lat", "lon"], hourly() if bucket is None else bucket)
    return prev.filter(F.col("prev_lat").isNotNull()).select(
        "icao24", *order,
        F.col("prev_lat").alias("lat1"), F.col("prev_lon").alias("lon1"),
        F.col("lat").alias("lat2"), F.col("lon").alias("lon2"),
        planar_length(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")).alias("seg_len"),
        bearing(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")).alias("bearing"),
    )


def path_lengths(segs: DataFrame, bucket: Column | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Running path length per aircraft (exact decimal running total),
    plus where each segment starts along the path."""
    run = with_running_sum(segs, ["icao24"], order, "seg_len", "cum_end", hourly() if bucket is None else bucket)
    return run.withColumn("cum_start", (F.col("cum_end").cast("decimal(34,12)")
                                        - F.col("seg_len").cast("decimal(24,12)")).cast("decimal(38,12)"))


def interpolate_along(lengths: DataFrame, fractions: Sequence[float], bucket_width: float = 50.0) -> DataFrame:
    """J10 + F20: for each aircraft and each fraction f of its total path
    length, the point at distance ``pos = f * total`` — on the first segment
    whose end reaches ``pos`` (``pos = 0`` is the first segment's start),
    linearly interpolated, with the segment's bearing.

    Range join as an equi-join: segments are listed under every length
    bucket (width ``bucket_width``) they span, a position under its own
    bucket; the range test then runs only inside one (aircraft, bucket).
    """
    seg = lengths.select(
        "icao24", *ORDER, "lat1", "lon1", "lat2", "lon2", "seg_len", "bearing",
        F.col("cum_start").cast("double").alias("s"), F.col("cum_end").cast("double").alias("e"),
    )
    first = seg.groupBy("icao24").agg(F.min(F.struct(*ORDER)).alias("_first"), F.max("e").alias("total"))
    w = F.lit(float(bucket_width))
    seg_b = seg.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / w), F.floor(F.col("e") / w))))
    pos = first.select(
        "icao24", "_first", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"), "total",
    ).withColumn("pos", F.col("total") * F.col("fraction")).withColumn("_b", F.floor(F.col("pos") / w))
    j = pos.join(seg_b, ["icao24", "_b"], "inner").filter(
        ((F.col("s") < F.col("pos")) & (F.col("pos") <= F.col("e")))
        | ((F.col("pos") == 0) & (F.struct(*ORDER) == F.col("_first")))
    )
    t = F.when(F.col("seg_len") > 0, (F.col("pos") - F.col("s")) / F.col("seg_len")).otherwise(F.lit(0.0))
    return j.select(
        "icao24", "fraction", F.col("event_id").alias("segment_end_event"),
        interpolate(F.col("lat1"), F.col("lat2"), t).alias("lat"),
        interpolate(F.col("lon1"), F.col("lon2"), t).alias("lon"),
        F.col("bearing").alias("heading"),
    )


_REF = "struct<lat:double,lon:double>"
POINTS = 256  # points of a chunk: what an append to its list of kept points may copy
LISTED = 512  # chunks of one list of the fold along an aircraft
ROUNDS = 4    # of resolving references, before an aircraft is folded in one pass


def _far(p: Column, ref: Column, thr: float) -> Column:
    """The point lies at least ``thr`` degrees from the reference (or there is none)."""
    return ref.isNull() | (F.abs(p["lat"] - ref["lat"]) >= thr) | (F.abs(p["lon"] - ref["lon"]) >= thr)


def _place(p: Column) -> Column:
    return F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")).cast(_REF)


def _end(points: Column, ref: Column, thr: float) -> Column:
    """The reference after the ordered points of a chunk."""
    return F.aggregate(points, ref, lambda r, p: F.when(_far(p, r, thr), _place(p)).otherwise(r))


def _kept(points: Column, ref: Column, thr: float) -> Column:
    """The points of a chunk that are kept, from a reference on."""
    none = F.filter(points, lambda _: F.lit(False))
    return F.aggregate(
        points, F.struct(ref.alias("ref"), none.alias("kept")),
        lambda s, p: F.when(_far(p, s["ref"], thr), F.struct(
            _place(p).alias("ref"), F.concat(s["kept"], F.array(p)).alias("kept"))).otherwise(s), lambda s: s["kept"])


def _references(chunks: DataFrame, thr: float) -> DataFrame:
    """The reference point that each chunk starts from, as far as it is known:
    a fold along the chunks of an aircraft (one narrow row each, in lists of
    LISTED so that no list is copied often). After a chunk the reference is
    unchanged if the whole chunk lies inside the reference's box (a parked
    aircraft); the known end if the chunk was folded from this very
    reference; else the end of the fold from its own first point, a guess
    that the next round verifies."""
    row = F.struct("_c", "alone", "box", "used", "end")

    def after(ref: Column, c: Column) -> Column:
        inside = ((c["box"]["hi_lat"] - ref["lat"] < thr) & (ref["lat"] - c["box"]["lo_lat"] < thr)
                  & (c["box"]["hi_lon"] - ref["lon"] < thr) & (ref["lon"] - c["box"]["lo_lon"] < thr))
        return (F.when(ref.isNull(), c["alone"]).when(inside, ref)
                .when(c["used"].eqNullSafe(ref), c["end"]).otherwise(c["alone"]))

    def along(start: Column, rows: Column) -> Column:
        """struct(ref, refs): through one list of chunks."""
        empty = F.struct(start.alias("ref"), F.array().cast(f"array<{_REF}>").alias("refs"))
        return F.aggregate(rows, empty, lambda s, c: F.struct(
            after(s["ref"], c).alias("ref"), F.concat(s["refs"], F.array(s["ref"])).alias("refs")))

    lists = chunks.groupBy("icao24", F.floor(F.col("_c") / LISTED).alias("_l")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    whole = lists.groupBy("icao24").agg(F.array_sort(F.collect_list(F.struct("_l", "rows"))).alias("lists"))
    start = F.struct(F.lit(None).cast(_REF).alias("ref"), F.array().cast(f"array<array<{_REF}>>").alias("refs"))

    def through(s: Column, one: Column) -> Column:
        done = along(s["ref"], one["rows"])
        return F.struct(done["ref"].alias("ref"), F.concat(s["refs"], F.array(done["refs"])).alias("refs"))

    refs = F.flatten(F.aggregate("lists", start, through, lambda s: s["refs"]))
    names = F.flatten(F.transform("lists", lambda one: F.transform(one["rows"], lambda c: c["_c"])))
    each = whole.select("icao24", F.explode(F.arrays_zip(names.alias("c"), refs.alias("ref"))).alias("x"))
    # dealt by both keys: left as it is, partitioned by aircraft, it would draw
    # the joined points of a hot aircraft into one task
    return each.select("icao24", F.col("x.c").alias("_c"), F.col("x.ref").alias("ref")).repartition("icao24", "_c")


def deadband(history: DataFrame, threshold: float = 0.001, order: Sequence[str] = ORDER, points: int = POINTS) -> DataFrame:
    """Keep a point only when it moved at least ``threshold`` degrees in
    latitude or longitude from the last *kept* point of the same aircraft.

    The fold is sequential, but it restarts at every kept point, so it is cut
    into chunks of at most ``points`` points, whatever time they span: the
    points are sorted by range over many tasks, and a chunk is a stretch of
    one aircraft's places in that order. Every chunk is folded from its own
    first point; then references are resolved (``_references``) and only
    chunks whose reference changed are folded again. The rounds carry one
    narrow row a chunk; the kept points are written out once, at the end.

    Where points from different starts never meet (an even, slow motion), a
    round may settle one chunk only. An aircraft that is still open after
    ROUNDS rounds is folded in one pass over its chunks in order, in a task
    that holds one chunk and one reference at a time. Either way the work is
    linear in the points.
    """
    thr = float(threshold)
    lat, lon = F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    key = ["icao24", *order]
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (with_position(history).select(*key, lat, lon).repartitionByRange(n, *key).sortWithinPartitions(*key)
              .withColumn("_p", F.monotonically_increasing_id()))
    chunks = materialize(placed.groupBy("icao24", F.floor(F.col("_p") / points).alias("_c"))
                         .agg(F.array_sort(F.collect_list(F.struct("_p", *order, "lat", "lon"))).alias("points")))
    none = F.lit(None).cast(_REF)
    lats, lons = (F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lon"]))
    box = F.struct(F.array_min(lats).alias("lo_lat"), F.array_max(lats).alias("hi_lat"),
                   F.array_min(lons).alias("lo_lon"), F.array_max(lons).alias("hi_lon"))
    end = lambda ref: _end(F.col("points"), ref, thr)
    done = materialize(chunks.select("icao24", "_c", box.alias("box"), none.alias("used"), end(none).alias("end")).withColumn("alone", F.col("end")))
    for _ in range(ROUNDS):
        changed = materialize(done.join(_references(done, thr), ["icao24", "_c"]).filter(~F.col("used").eqNullSafe(F.col("ref"))).drop("used", "end"))
        if changed.isEmpty():
            settled = chunks.join(done.select("icao24", "_c", "used"), ["icao24", "_c"])
            return _told(settled.select("icao24", F.explode(_kept(F.col("points"), F.col("used"), thr)).alias("p")), order)
        again = chunks.join(changed, ["icao24", "_c"]).select("icao24", "_c", "box", F.col("ref").alias("used"), end(F.col("ref")).alias("end"), "alone")
        done = materialize(done.join(changed.select("icao24", "_c"), ["icao24", "_c"], "left_anti").select(*again.columns).unionByName(again))
    open_ = materialize(done.join(_references(done, thr), ["icao24", "_c"]).filter(~F.col("used").eqNullSafe(F.col("ref"))).select("icao24").distinct())
    settled = chunks.join(done.join(open_, "icao24", "left_anti").select("icao24", "_c", "used"), ["icao24", "_c"])
    marked = (chunks.join(open_, "icao24", "left_semi").select("icao24", "_c", lats.alias("lats"), lons.alias("lons"))
              .repartition("icao24").sortWithinPartitions("icao24", "_c").mapInArrow(_in_order(thr), "icao24 string, _c bigint, keep array<int>"))
    passed = chunks.join(marked, ["icao24", "_c"]).select("icao24", F.explode(F.transform("keep", lambda i: F.get("points", i))).alias("p"))
    return _told(settled.select("icao24", F.explode(_kept(F.col("points"), F.col("used"), thr)).alias("p")).unionByName(passed), order)


def _told(kept: DataFrame, order: Sequence[str]) -> DataFrame:
    return kept.select("icao24", *[F.col(f"p.{o}").alias(o) for o in order],
                       F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"))


def _in_order(thr: float):
    """Chunks of each aircraft one after the other: the places of the points kept in each."""
    import pyarrow as pa

    def run(batches):
        key, ref = None, None
        for batch in batches:
            out = []
            for k, lats, lons in zip(*(batch.column(c).to_pylist() for c in ("icao24", "lats", "lons"))):
                if k != key:
                    key, ref = k, None
                keep = []
                for i, (la, lo) in enumerate(zip(lats, lons)):
                    if ref is None or abs(la - ref[0]) >= thr or abs(lo - ref[1]) >= thr:
                        ref = (la, lo)
                        keep.append(i)
                out.append(keep)
            yield pa.RecordBatch.from_arrays([batch.column("icao24"), batch.column("_c"), pa.array(out, pa.list_(pa.int32()))], names=["icao24", "_c", "keep"])

    return run
