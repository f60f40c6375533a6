"""What happens at every tick of a clock.

The clock of a stream is its event time, held back by the broker's: a record
stamped in the future counts as of its arrival plus a tolerance, so it cannot
move the clock ahead and age out everybody else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators import alerts as A
from contrail.sinks.alerts import append_alerts, read_alerts
from contrail.streaming.state import on_disk_state


def clock(event_time: str = "time", arrival: str = "timestamp", tolerance: str = "1 minute") -> Column:
    """Event time, but never more than ``tolerance`` after arrival."""
    held = F.col(arrival).cast("timestamp") + F.expr(f"INTERVAL {tolerance}")
    return F.least(F.col(event_time).cast("timestamp"), held)


def snapshots(stream: DataFrame, columns: Sequence[str], tick: str, max_age: str, late: str = "1 minute",
              tolerance: str = "1 minute", key: str = "icao24", order: Sequence[str] = ("offset",)) -> DataFrame:
    """T9 + P6 + A1: the fleet at every tick, ``tick_time`` and ``columns`` of
    the newest record of each key, if it is at most ``max_age`` old and came before the tick.

    The newest record of each key and tick is a grouped maximum (combined
    before the shuffle), and those are gathered over the windows that end at
    each tick; a window goes out once the watermark, ``late`` behind the
    clock, has passed it. ``max_age`` must be a multiple of ``tick``. Records
    without a time, or later than ``late``, take no part."""
    on_disk_state(stream.sparkSession)
    spans = stream.sparkSession.range(1).select(*(F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {x})") for x in (tick, max_age))).first()
    if spans[0] <= 0 or spans[1] < spans[0] or spans[1] % spans[0]:
        raise ValueError(f"max_age {max_age} must be a multiple of tick {tick}")
    record = F.struct(F.col("_clock"), *order, *[c for c in columns if c not in (key, *order)])
    timed = stream.filter(F.col(key).isNotNull() & (F.col(key) != "") & F.col("time").isNotNull()).withColumn("_clock", clock(tolerance=tolerance))
    per_tick = (timed.withWatermark("_clock", late).groupBy(F.window("_clock", tick).alias("w"), key)
                .agg(F.max(record).alias("s")))
    held = per_tick.groupBy(F.window("w", max_age, tick).alias("w"), key).agg(F.max("s").alias("s"))
    return held.select(F.col("w.end").cast("timestamp_ntz").alias("tick_time"), *(
        F.col(key) if c == key else F.col("s")[c].alias(c) for c in columns))


def alert_tick(subscriptions: Callable[[], DataFrame], live: Callable[[], DataFrame], routes: Callable[[], DataFrame],
               root: str, window_min: int = 65) -> Callable[[DataFrame, int], None]:
    """T7 on a stream of ticks (column ``as_of``; a rate source in service):
    the ``foreachBatch`` function that evaluates every subscription at the
    batch's newest tick and appends the alerts (K7) under the batch's id.

    What fired in an earlier batch does not fire again; the batch's own folder
    is left out of that log and overwritten, so a batch that is replayed
    after a crash writes the same alerts once more in the same place. The
    three inputs are read anew at every tick."""

    def process(batch: DataFrame, batch_id: int) -> None:
        as_of = batch.agg(F.max("as_of")).first()[0]
        if as_of is None:
            return
        fired = read_alerts(batch.sparkSession, root, before=batch_id)
        due = A.due_alerts(subscriptions(), live(), routes(), str(as_of), window_min, fired=fired)
        append_alerts(due, root, batch_id)

    return process
