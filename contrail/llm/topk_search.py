"""Operator 13: exact top-k inner products by the threshold algorithm.

Candidates are dealt by hash to cells of about CELL vectors, queries are packed
into blocks. A cell keeps one list per dimension, sorted by value. A query
reads every list from the end that adds most to its score, a step of positions
at a time, scores what it has not met yet, and stops as soon as the bound (the
sum of what the last positions read could add) is below its k-th score. The
bound of no position at all tells whether a cell has to be opened.

Every query first searches one cell; the k-th score found there goes with it
to all other cells. A cell's answer is at most k rows a query, and only rows
that reach that score. So the queries meet all rows in blocks, each block pair
once, and no list, cell or answer grows with the table.

Odd rows: a vector that is null, or holds null or non-finite components, and a
row without vec_id take no part. Only vectors of one length are compared. A
row is its own candidate never; another row of the same vec_id is one, and a
repeated query answers twice. Ties go to the smaller vec_id. An empty vector
scores 0 against empty ones. Scores are exact integers; one outside the range
of a long counts as that range's end. An empty table gives no rows; other
columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import landed

K = 5
SCALE = 256.0
CELL = 2048           # candidates of a cell, on average
BLOCK = 128           # queries that travel in one row, on average
STEPS = (8, 32, 128, 512)  # positions of each list read before the bound is looked at; then the rest
EXACT = 2.0**53       # sums of doubles that hold integers are exact below
LONG = 2**63

FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def held(score: int) -> int:
    return min(max(score, -LONG), LONG - 1)


class Cell:
    """The sorted lists of one cell."""

    def __init__(self, rows: list[int], ids: list[int], vectors: np.ndarray):
        self.rows, self.ids, self.x = np.array(rows, dtype=np.int64), np.array(ids, dtype=np.int64), vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.most = float(np.abs(vectors).max(initial=0))
        self.steps = [s for s in STEPS if s < len(rows)]

    def search(self, qrow: int, w: np.ndarray, k: int, least: int | None) -> list[tuple[int, int, int]]:
        """The k best (score, vec_id, row) of the cell that reach ``least``."""
        n, dim = self.x.shape
        x, lists = self.x, self.sorted
        if self.most * float(np.abs(w).max(initial=0)) * max(dim, 1) >= EXACT:  # integers of any size
            x, lists, w = (np.frompyfunc(int, 1, 1)(a) for a in (x, lists, w))
        up, down = np.flatnonzero(w > 0), np.flatnonzero(w < 0)

        def bound(read: int) -> int:
            """No vector that is in none of the first ``read`` positions scores more."""
            return held(int(lists[n - max(read, 1), up] @ w[up] + lists[max(read, 1) - 1, down] @ w[down])) if dim else 0

        if least is not None and bound(0) < least:
            return []
        seen = np.zeros(n, dtype=bool)
        at, scores, best = [], [], least
        for read in [*self.steps, n]:
            if read == n:
                new = ~seen
            else:
                new = np.zeros(n, dtype=bool)
                new[self.order[n - read:, up]] = True
                new[self.order[:read, down]] = True
                new &= ~seen
            seen |= new
            i = np.flatnonzero(new & (self.rows != qrow))
            at.append(i)
            new = x[i] @ w if dim else np.zeros(len(i))
            scores.append(new if new.dtype != object else np.frompyfunc(held, 1, 1)(new))
            every = np.concatenate(scores)
            if len(every) >= k:
                kth = int(np.sort(every)[-k])
                best = kth if best is None else max(best, kth)
            if read < n and best is not None and bound(read) < best:
                break
        i, s = np.concatenate(at), np.concatenate(scores)
        if best is not None:
            keep = s >= best
            i, s = i[keep], s[keep]
        found = sorted(zip((-int(v) for v in s), self.ids[i].tolist(), self.rows[i].tolist()))[:k]
        return [(-v, vec_id, row) for v, vec_id, row in found]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, ids, vectors, cell = None, [], [], [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["dim"], r["cell"]) != key:
                    key, rows, ids, vectors, cell = (r["dim"], r["cell"]), [], [], [], None
                if r["block"] is None:  # candidates come first
                    rows.append(r["row"])
                    ids.append(r["vec_id"])
                    vectors.append(np.floor(SCALE * np.asarray(r["v"], dtype=np.float64)))
                    continue
                if not rows:
                    continue
                cell = cell or Cell(rows, ids, np.array(vectors).reshape(len(rows), r["dim"]))
                for q in r["block"]:
                    w = np.floor(SCALE * np.asarray(q["v"], dtype=np.float64))
                    out += [{"query": q["row"], "query_id": q["vec_id"], "row": row, "vec_id": vec_id, "score": s}
                            for s, vec_id, row in cell.search(q["row"], w, k, q["least"])]
            yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return run


def _met(cells: DataFrame, blocks: DataFrame, k: int, tasks: int) -> DataFrame:
    """Answers of the cells to the query blocks (dim, cell, block) sent to them."""
    kind = blocks.schema["block"].dataType.simpleString()
    every = (cells.select("dim", "cell", "row", "vec_id", "v", F.lit(None).cast(kind).alias("block"))
             .unionByName(blocks.select("dim", "cell", "block"), allowMissingColumns=True)
             .withColumn("last", F.col("block").isNotNull()))
    dealt = every.repartition(tasks, "dim", "cell").sortWithinPartitions("dim", "cell", "last").drop("last")
    return dealt.mapInArrow(_search(k), "query long, query_id long, row long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame | str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` with the
    highest inner product, for each row that the condition ``queries`` picks."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = landed(vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
                                              v.alias("v"), F.size(v).alias("dim"), F.coalesce(F.expr(queries) if isinstance(queries, str) else queries, F.lit(False)).alias("asks")), "topk-rows")
    count = lambda what, size: F.greatest(F.ceil(F.count(what) / size), F.lit(1)).cast("long")
    sizes = landed(rows.groupBy("dim").agg(count(F.lit(1), CELL).alias("cells"), count(F.when(F.col("asks"), 1), BLOCK).alias("packs")), "topk-sizes")
    tasks = int(sizes.agg(F.sum("cells")).first()[0] or 1)
    with_sizes = rows.join(sizes, "dim")
    cells = with_sizes.withColumn("cell", F.pmod(F.xxhash64("row"), "cells"))
    asked = with_sizes.filter("asks").withColumn("pack", F.pmod(F.xxhash64("row"), "packs"))

    def packed(asked: DataFrame) -> DataFrame:
        one = F.struct("row", "vec_id", "v", "least")
        return asked.groupBy("dim", "cells", "pack").agg(F.collect_list(one).alias("block"))  # about BLOCK queries

    home = F.pmod(F.col("pack"), F.col("cells"))
    first = landed(_met(cells, packed(asked.withColumn("least", F.lit(None).cast("long"))).withColumn("cell", home), k, tasks), "topk-first")
    least = first.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    others = packed(asked.join(least, "row", "left")).withColumn(
        "cell", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda c: c != F.pmod("pack", "cells"))))
    found = first.unionByName(_met(cells, others, k, tasks))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
