"""What a task holds at a time: Arrow batches, pages and row groups, blocks."""

import uuid

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from contrail.llm import common, ngram_join


def test_arrow_batches_are_bounded_by_bytes(spark):
    df = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("x"), 200_000).alias("text"))
    got = common.by_rows(df, lambda cols: {"n": [sum(map(len, cols["text"]))]}, "n long").collect()
    assert sum(r.n for r in got) == 200 * 200_000
    assert max(r.n for r in got) <= common.ARROW_BATCH + 200_000


def test_row_groups_of_large_rows_are_bounded(spark):
    df = spark.range(0, 60, 1, 1).select("id", F.expr("transform(sequence(1, 100000), x -> xxhash64(x, id))").alias("a"))
    out = common.landed(df, "t")
    path, = out.inputFiles()
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert sum(sizes) > 40_000_000 and max(sizes) < 1.5 * common.LANDED_BLOCK
    assert out.select(F.sum(F.size("a"))).first()[0] == 60 * 100_000


def test_a_task_counts_one_block_of_columns(spark, tmp_path, monkeypatch):
    real = ngram_join._occurring

    def noted(blocks):
        run = real(blocks)

        def each(batches):
            batches = list(batches)
            (tmp_path / uuid.uuid4().hex).write_text(str(len({k for b in batches for k in b.column("block").to_pylist()})))
            yield from run(iter(batches))

        return each

    monkeypatch.setattr(ngram_join, "_occurring", noted)
    docs = spark.range(0, 50).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 60), x -> concat('w', x * (id div 2 + 1))), ' ')").alias("text"))
    got = ngram_join.occurrences(docs, 5, lambda s: s).collect()
    assert len(got) == 50 and all(r.shared >= 56 for r in got if r.n)
    assert {p.read_text() for p in tmp_path.iterdir()} <= {"0", "1"}
