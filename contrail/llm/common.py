"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.session import shared_dir

# What counts as white space between words (fixed by the result contracts).
WORD_SPACE = " \t\n\x0b\x0c\r"
# A worker's memory holds this many rows of text at a time.
ROWS_AT_ONCE = 256
# A task that lands a table holds at most about this much of it.
LANDED_BLOCK = 16 << 20
#: An Arrow batch for a Python worker holds about this many bytes (one row at
#: least). The JVM holds a batch several times outside its heap and hardly gives
#: that memory back, so Spark's 64 MB would be a load for each task at a time.
ARROW_BATCH = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def landed(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage of
    a table that several later steps read, in a form that outlives executors."""
    path = shared_dir(df.sparkSession, purpose) + "/rows"
    # by default no page ends before its 100th row, however large rows are
    df.write.options(**{"parquet.block.size": LANDED_BLOCK, "parquet.page.size.row.check.min": 1}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of about ARROW_BATCH bytes; the setting
    stays with the session, as the batches are made when the result is read."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH))
    return df.mapInArrow(fn, schema)


def by_rows(df: DataFrame, fn: Callable[[list[dict]], dict], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Run ``fn`` on slices of at most ``rows`` rows inside the tasks. ``fn``
    gets a dict of column lists and returns a dict of equally long lists (or
    arrays); nothing crosses a partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = fn(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return in_arrow(df, run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal keys (a block, so of bounded size)."""
    at, rows = None, []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in keys]
        other = {f.name: batch.column(f.name) for f in batch.schema if f.name not in keys}
        for i, k in enumerate(zip(*cols)):
            if k != at:
                if rows:
                    yield at, rows
                at, rows = k, []
            rows.append({name: c[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[i].as_py()
                         for name, c in other.items()})
    if rows:
        yield at, rows
