"""Ordered operations within a key that stay balanced when one key is hot.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; a
key holding a third of the data would then be a third of the job in one
task. Here the window runs per (key, bucket), where the bucket is a coarse,
order-monotone expression (e.g. the hour of the timestamp). Only the last
row of each bucket — a table of keys x buckets — crosses bucket borders,
taken from the same window pass (the row with no successor) and joined back
on (key, bucket), the partitioning the window already produced (the shuffle
is shared). Results equal the single-window form for any bucket width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_bucket"


def _order_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    bucket: Column | None = None,
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row of the same key.

    ``order`` must be a total order within a key (add a tie-break column).
    With ``bucket`` (monotone in ``order``) the work is split per bucket.
    """
    keys, order, cols = list(keys), list(order), list(cols)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
        return df.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols])

    b = df.withColumn(_B, bucket)
    w = Window.partitionBy(*keys, _B).orderBy(*_order_cols(order))
    # One window pass gives the in-bucket previous row and marks the last row
    # of each bucket (no following row): those rows are the bucket tails, so
    # no second scan or aggregate of the data is needed.
    inner = b.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.lead(F.lit(1)).over(w).isNull().alias("_is_last"),
        *[F.lag(c).over(w).alias("_in_" + c) for c in cols],
    )
    tails = inner.filter("_is_last").select(*keys, _B, F.struct(*[F.col(c).alias(c) for c in cols]).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(_B)
    carry = tails.select(*keys, _B, F.lag("_last").over(wb).alias("_carry"))
    joined = inner.join(carry, on=[*keys, _B], how="left")
    out = [F.col(c) for c in df.columns]
    out += [
        F.when(F.col("_rn") == 1, F.col("_carry." + c)).otherwise(F.col("_in_" + c)).alias(prefix + c)
        for c in cols
    ]
    return joined.select(*out)


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    bucket: Column | None = None,
    scale: int = 12,
) -> DataFrame:
    """Add ``out`` = running total of ``value`` within the key, in ``order``.

    The sum is carried as DECIMAL(38, scale) so the total does not depend on
    the order in which partial sums are combined (float addition does).
    """
    keys, order = list(keys), list(order)
    # value: 12 integer digits; partial sums are kept at precision 34 so
    # that adding the carry stays within 38 digits at full scale.
    v = F.col(value).cast(f"decimal(24,{scale})")
    part = f"decimal(34,{scale})"
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*_order_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(v).over(w).cast(f"decimal(38,{scale})"))

    b = df.withColumn(_B, bucket)
    wo = Window.partitionBy(*keys, _B).orderBy(*_order_cols(order))
    w = wo.rowsBetween(Window.unboundedPreceding, 0)
    inner = b.select("*", F.sum(v).over(w).cast(part).alias("_in_sum"),
                     F.lead(F.lit(1)).over(wo).isNull().alias("_is_last"))
    # the running sum at a bucket's last row is the bucket total
    totals = inner.filter("_is_last").select(*keys, _B, F.col("_in_sum").alias("_tot"))
    wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, _B, F.coalesce(F.sum("_tot").over(wb), F.lit(0)).cast(part).alias("_carry"))
    joined = inner.join(carry, on=[*keys, _B], how="left")
    total = (F.col("_in_sum") + F.col("_carry")).cast(f"decimal(38,{scale})")
    return joined.select(*[F.col(c) for c in df.columns], total.alias(out))


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str = "rn"
) -> DataFrame:
    """Newest-N style limit per key: ``row_number() <= n``.

    Catalyst plans this with a partial WindowGroupLimit before the shuffle,
    so each map task forwards at most ``n`` rows per key — a hot key cannot
    flood one reducer.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
