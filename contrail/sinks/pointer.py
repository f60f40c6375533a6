"""One small file that says which folders of a table are current.

The file is written beside its place and renamed over the old one, so a reader
sees the table before or after a commit, never in between. Reading and
committing cost the same however many versions the table has had. One writer
at a time (the driver of the stream that owns the table).
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

NAME = "CURRENT"


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """What the last commit wrote; None if there was none."""
    p, fs = _place(spark, f"{root}/{NAME}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_pointer(spark: SparkSession, root: str, content: dict) -> None:
    jvm = spark.sparkContext._jvm
    p, fs = _place(spark, f"{root}/{NAME}")
    beside, _ = _place(spark, f"{root}/_{NAME}.new")
    out = fs.create(beside, True)
    try:
        out.write(json.dumps(content, sort_keys=True).encode())
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, p, how)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.delete(p, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob."""
    p, fs = _place(spark, pattern)
    return [str(s.getPath().toString()) for s in fs.globStatus(p) or []]
