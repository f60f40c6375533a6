"""Operator 5: near-duplicate embeddings by a robust-pruned flat graph.

Vectors of one label are dealt to the cells of their nearest centres, each to
OVERLAP of them. In every cell a graph is built: a vector's nearest and a few
far members of the cell are pruned robustly (a candidate goes if a kept
neighbour is closer to it by ALPHA). The adjacency lists of all cells are
united. Each vector is then searched for, in the cell of its nearest centre
with all neighbours of that cell's members: greedily from the medoid and its
own place, then from every vector within range to all its neighbours, until
no vector within range is left. Where that leads out of what the cell has been
given, the neighbours of the vectors reached are added to it and the cell is
searched again, so that a cloud of any size is walked through across cells.
Only links verified in double precision count.

Centres are fitted on a bounded sample (SAMPLE vectors, CENTRES centres); a
cell of more than CELL_MOST vectors is dealt again to centres of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import groups, landed
from contrail.llm.components import components

COSINE = 0.98
SLACK = 0.02          # the search walks on through vectors this much below the threshold
SAMPLE = 8192
CENTRES = 512
CELL = 400            # vectors that a cell has on average
CELL_MOST = 4000
FAN = 32              # centres of a cell that is dealt again
LEVELS = 4
OVERLAP = 2
NEAR, FAR, DEGREE, ALPHA = 64, 8, 24, 1.2
BEAM = 32


def unit(v: list | None) -> list[float] | None:
    """The vector at length 1 in double precision; None if it cannot link."""
    if v is None or any(x is None for x in v):
        return None
    a = np.asarray(v, dtype=np.float64)
    if not len(a) or not np.isfinite(a).all() or not a.any():
        return None
    a = a / np.abs(a).max()
    return (a / np.sqrt(a @ a)).tolist()


def centres_of(sample: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Spherical k-means from the first ``k`` vectors of the sample."""
    c = sample[:k].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        for j in np.unique(near):
            m = sample[near == j].sum(axis=0)
            if (size := np.sqrt(m @ m)) > 0:
                c[j] = m / size
    return c


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]


def _deal(centres: dict[int, np.ndarray]):
    """Rows (label, node, dim, v) to their OVERLAP nearest centres of that dimension."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.string()), ("node", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for dim in {r["dim"] for r in rows}:
                own = [r for r in rows if r["dim"] == dim]
                for r, cells in zip(own, nearest(np.array([r["v"] for r in own]), centres[dim], OVERLAP).tolist()):
                    out += [{"label": r["label"], "dim": dim, "cell": str(c), "node": r["node"], "home": i == 0}
                            for i, c in enumerate(cells)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.string()), ("node", pa.int64()), ("home", pa.bool_())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            near = nearest(np.array([r["v"]]), np.array(r["centres"]), OVERLAP)[0].tolist()
            out += [{"label": r["label"], "dim": r["dim"], "cell": f"{r['cell']}.{c}", "node": r["node"],
                     "home": r["home"] and i == 0} for i, c in enumerate(near)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


PLACED = "label string, dim int, cell string, node long, home boolean"
PLACED_COLUMNS = ["label", "dim", "cell", "node", "home"]
KEYS = ["label", "dim", "cell"]


def placed(vectors: DataFrame) -> DataFrame:
    """label, dim, cell, node, home: the cells of each vector."""
    sizes = vectors.groupBy("dim").count().collect()  # one row per vector length
    centres = {}
    for dim, n in sizes:
        few = vectors.filter(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").select("v").limit(SAMPLE)
        centres[dim] = centres_of(np.array([r["v"] for r in few.collect()]), int(max(1, min(CENTRES, n // CELL))))
    out = landed(vectors.select("label", "dim", "node", "v").mapInArrow(_deal(centres), PLACED), "embedding-cells")
    for _ in range(LEVELS):
        large = out.groupBy(*KEYS).count().filter(F.col("count") > CELL_MOST).drop("count")
        if large.isEmpty():
            break
        again = out.join(large, KEYS, "left_semi").join(vectors.select("node", "v"), "node")
        order = Window.partitionBy(*KEYS).orderBy(F.xxhash64("node"), "node")
        own = (again.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FAN)
               .groupBy(*KEYS).agg(F.collect_list("v").alias("centres")))  # FAN vectors
        dealt = again.join(own, KEYS).select(*KEYS, "node", "home", "v", "centres").mapInArrow(_deal_again, PLACED)
        out = landed(out.join(large, KEYS, "left_anti").select(*PLACED_COLUMNS).union(dealt.select(*PLACED_COLUMNS)).distinct(), "embedding-cells")
    return out


def pruned_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the robust-pruned graph of one cell."""
    n = len(x)
    if n < 2:
        return np.empty(0, int), np.empty(0, int)
    rng = np.random.default_rng(seed)
    near = min(NEAR, n - 1)
    sim = (x @ x.T).astype(np.float32)
    np.fill_diagonal(sim, -2)
    cand = np.argpartition(-sim, near - 1, axis=1)[:, :near]
    if n > near + 1:
        cand = np.concatenate([cand, rng.integers(n, size=(n, FAR))], axis=1)
    own = np.arange(n)[:, None]
    mine = sim[own, cand]
    order = np.argsort(-mine, axis=1, kind="stable")
    cand, mine = cand[own, order], mine[own, order]
    alive = mine > -2
    from_, to = [], []
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        some = np.flatnonzero(alive[np.arange(n), first])
        if not len(some):
            break
        pick = cand[some, first[some]]
        from_.append(some)
        to.append(pick)
        alive[some, first[some]] = False
        # squared distances are 2 - 2 cos; a candidate goes if the pick is closer to it by ALPHA
        between = sim[pick[:, None], cand[some]]
        alive[some] &= ALPHA**2 * (1 - between) > 1 - mine[some]
        alive[some] &= cand[some] != pick[:, None]
    a, b = np.concatenate(from_), np.concatenate(to)
    return np.concatenate([a, b]), np.concatenate([b, a])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for _, rows in groups(batches, KEYS):
        ids = np.array([r["node"] for r in rows])
        a, b = pruned_graph(np.array([r["x"] for r in rows]))
        edges = np.unique(np.stack([ids[a], ids[b]], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0], pa.int64()), pa.array(edges[:, 1], pa.int64())], schema=schema)


def search(x: np.ndarray, flat: np.ndarray, bounds: np.ndarray, queries: np.ndarray, start: int,
           cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, other) within range: greedy search from ``start`` and the
    query's own place with a beam, then expansion of all within range. Third,
    the vectors that the expansion has gone through.

    ``flat[bounds[i]:bounds[i + 1]]`` are the neighbours of vector i."""
    q, m = len(queries), len(x)
    seen = np.zeros((q, m), bool)
    degree = np.diff(bounds)

    def neighbours(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unseen (row, neighbour) pairs, each once; marks them seen."""
        n = degree[nodes]
        r = np.repeat(rows, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[nodes], n)
        code = r * m + flat[at]
        code = np.unique(code[~seen.ravel()[code]])
        seen.ravel()[code] = True
        return code // m, code % m

    def cosines(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.einsum("nd,nd->n", x[queries[rows]], x[nodes])

    beam = np.full((q, BEAM), -1)
    value = np.full((q, BEAM), -np.inf)
    done = np.ones((q, BEAM), bool)
    beam[:, 0], value[:, 0], done[:, 0] = start, x[queries] @ x[start], False
    beam[:, 1], value[:, 1], done[:, 1] = queries, 1.0, False
    seen[np.arange(q), start] = True
    seen[np.arange(q), queries] = True
    in_rows, in_nodes = [np.arange(q)[value[:, 0] >= cosine - SLACK], np.arange(q)], [np.full(int((value[:, 0] >= cosine - SLACK).sum()), start), queries]
    while not done.all():
        best = np.where(done, -np.inf, value)
        at = best.argmax(axis=1)
        rows = np.flatnonzero(best[np.arange(q), at] > -np.inf)
        done[rows, at[rows]] = True
        r, v = neighbours(rows, beam[rows, at[rows]])
        if not len(r):
            continue
        c = cosines(r, v)
        near = c >= cosine - SLACK
        in_rows.append(r[near])
        in_nodes.append(v[near])
        first = np.searchsorted(r, np.arange(q))
        place = np.arange(len(r)) - first[r]
        wide = int(place.max()) + 1
        new_v, new_c = np.full((q, wide), -1), np.full((q, wide), -np.inf)
        new_v[r, place], new_c[r, place] = v, c
        all_v, all_c = np.concatenate([beam, new_v], axis=1), np.concatenate([value, new_c], axis=1)
        all_d = np.concatenate([done, new_c == -np.inf], axis=1)
        keep = np.argsort(-all_c, axis=1, kind="stable")[:, :BEAM]
        own = np.arange(q)[:, None]
        beam, value, done = all_v[own, keep], all_c[own, keep], all_d[own, keep]
    rows, nodes = np.concatenate(in_rows), np.concatenate(in_nodes)
    found = np.unique(rows * m + nodes)
    front = found
    while len(front):  # range expansion
        r, v = neighbours(front // m, front % m)
        near = cosines(r, v) >= cosine - SLACK if len(r) else np.empty(0, bool)
        front = r[near] * m + v[near]
        found = np.concatenate([found, front])
    found = np.unique(found)
    r, v = found // m, found % m
    keep = (cosines(r, v) >= cosine) & (queries[r] != v)
    return queries[r[keep]], v[keep], np.unique(v)


def _rows_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


class Forest:
    """Links between the rows of a cell that join two of its components."""

    def __init__(self, rows: int):
        self.part = np.arange(rows)

    def joining(self, query: int, near: np.ndarray) -> np.ndarray:
        """Those of ``near`` to link with ``query`` so that all are one component: one of each other component."""
        parts, at = np.unique(self.part[near], return_index=True)
        other = parts != self.part[query]
        if other.any():
            self.part[np.isin(self.part, parts[other])] = self.part[query]
        return near[at[other]]


def _search(cosine: float):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("node", pa.int64()), ("degree", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("cell", pa.string()), ("via", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in groups(batches, KEYS):
            ids = np.array([r["node"] for r in rows])
            x = np.array([r["x"] for r in rows])
            copies, forest = np.array([r["copies"] for r in rows], np.int64), Forest(len(rows))
            order = np.argsort(ids)
            members = np.flatnonzero([r["member"] for r in rows])
            queries = np.flatnonzero([r["home"] for r in rows])
            if not len(queries):
                continue
            flat, bounds = [], [0]
            for r in rows:
                at = np.minimum(np.searchsorted(ids, r["near"], sorter=order), len(ids) - 1)
                hit = order[at][ids[order[at]] == r["near"]]
                flat.append(hit)
                bounds.append(bounds[-1] + len(hit))
            mean = x[members].mean(axis=0)
            medoid = int(members[(x[members] @ mean).argmax()])
            far, flat, bounds = np.zeros(len(ids), bool), np.concatenate(flat), np.array(bounds)
            for part in np.array_split(queries, -(-len(queries) // 512)):
                a, b, through = search(x, flat, bounds, part, medoid, cosine)
                far[through] = True
                if not len(a):
                    continue
                at, first = np.unique(a, return_index=True)  # ``a`` is sorted
                ends = [forest.joining(q, near) for q, near in zip(at, np.split(b, first[1:]))]
                u, v = ids[np.repeat(at, [len(e) for e in ends])], ids[np.concatenate(ends)]
                yield _rows_of(schema, x=np.minimum(u, v), y=np.maximum(u, v))
                yield _rows_of(schema, node=ids[at], degree=np.add.reduceat(copies[b], first))
            far[members] = False
            via = ids[far]  # their neighbours may be in range, too, and need not be among the rows
            yield _rows_of(schema, via=via, **{k: [v] * len(via) for k, v in zip(KEYS, place)})

    return run


def classes(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """node, label, dim, v, copies: equal vectors of one label are one class."""
    same = (vectors.filter(vectors[label].isNotNull() & vectors[embedding].isNotNull() & vectors[key].isNotNull())
            .groupBy(vectors[label].cast("string").alias("label"), vectors[embedding].cast("array<double>").alias("raw"))
            .agg(F.min(vectors[key].cast("long")).alias("node"), F.count(F.lit(1)).alias("copies")))

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("node", pa.int64()), ("v", pa.list_(pa.float64())), ("copies", pa.int64())])
        for batch in batches:
            out = [{"label": r["label"], "dim": len(v), "node": r["node"], "v": v, "copies": r["copies"]}
                   for r in batch.to_pylist() if (v := unit(r["raw"])) is not None]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return same.mapInArrow(norm, "label string, dim int, node long, v array<double>, copies long")


def near_links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """Links x < y that connect what is linked, and node, degree (vectors that a
    class is linked with outside itself), of ``vectors`` (the rows of ``classes``).

    A class is searched for in its home cell, so that cell knows its degree; of
    the links it emits those that join two components there, fewer than it has
    rows. A cloud of n near vectors over c cells gives at most c * n links."""
    cells = placed(vectors)
    own = vectors.select("node", F.col("v").alias("x"), "copies")
    dealt = cells.select(*KEYS, "node").join(own.drop("copies"), "node").repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
    edges = landed(dealt.mapInArrow(_build, "u long, v long").distinct(), "embedding-graph")
    lists = edges.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("near"))  # members of few cells
    full = landed(own.join(lists, "node", "left").select("node", "x", "copies", F.coalesce("near", F.array().cast("array<long>")).alias("near")), "embedding-lists")
    member = cells.withColumn("member", F.lit(True))
    beyond = (cells.select(*KEYS, "node").join(edges, F.col("node") == F.col("u")).select(*KEYS, F.col("v").alias("node"))
              .distinct().join(cells.select(*KEYS, "node"), [*KEYS, "node"], "left_anti")
              .withColumn("home", F.lit(False)).withColumn("member", F.lit(False)))
    there = landed(member.select(*KEYS, "node", "home", "member").union(beyond.select(*KEYS, "node", "home", "member")), "embedding-there")
    links, degrees, cells_now = None, None, there
    while True:
        dealt = cells_now.join(full, "node").repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
        found = landed(dealt.mapInArrow(_search(cosine), "x long, y long, node long, degree long, label string, dim int, cell string, via long"), "embedding-found")
        pairs = found.filter("x is not null").select("x", "y")
        counted = found.filter("node is not null").select("node", "degree")
        links, degrees = (pairs, counted) if links is None else (links.union(pairs), degrees.union(counted))
        # what a cell has in range outside of it leads on: its neighbours join the rows, until there are none
        more = landed(found.filter("via is not null").select(*KEYS, F.col("via").alias("u")).join(edges, "u").select(*KEYS, F.col("v").alias("node"))
                      .distinct().join(there.select(*KEYS, "node"), [*KEYS, "node"], "left_anti")
                      .select(*KEYS, "node", F.lit(False).alias("home"), F.lit(False).alias("member")), "embedding-more")
        if more.isEmpty():
            # a cell that was searched again has found no less than before
            return landed(links.distinct(), "embedding-links"), landed(degrees.groupBy("node").agg(F.max("degree").alias("degree")), "embedding-degrees")
        there = there.union(more)
        cells_now = there.join(more.select(*KEYS).distinct(), KEYS, "left_semi")


def deduplicate(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                cosine: float = COSINE) -> DataFrame:
    """``key``, n_links, component_id, kept for each row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without a label or key, link with nothing: 0 links, their own
    component, kept (with a null key: null component, not kept). Equal vectors
    of one label, repeated rows included, link with each other without being
    paired. Vectors of different length do not link. Other columns are not
    read; an empty table gives an empty one. The search is approximate: what it
    found of a sample's links is written beside the other tables of the run, in
    the folder embedding-audit.
    """
    cls = landed(classes(vectors, key, embedding, label), "embedding-classes")
    pairs, degrees = near_links(cls, cosine)
    landed(audit(cls, degrees, cosine), "embedding-audit")
    degree = degrees.withColumnRenamed("degree", "others")
    parts = components(pairs).withColumnRenamed("component", "part")
    known = (cls.select("label", "node", "copies").join(degree, "node", "left").join(parts, "node", "left")
             .select(F.col("node"), F.col("label").alias("c_label"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("part", "node").alias("part")))
    first = (vectors.filter(vectors[key].isNotNull()).groupBy(vectors[label].cast("string").alias("g_label"), vectors[embedding].cast("array<double>").alias("g_raw"))
             .agg(F.min(vectors[key].cast("long")).alias("g_node")))
    rows = vectors.select(vectors[key].cast("long").alias("key"), vectors[label].cast("string").alias("label"),
                          vectors[embedding].cast("array<double>").alias("raw"))
    joined = (rows.join(first, (F.col("label") == F.col("g_label")) & (F.col("raw") == F.col("g_raw")), "left")
              .join(known, F.when(F.col("key").isNotNull(), F.col("g_node")) == F.col("node"), "left"))
    component = F.coalesce("part", "key")
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def audit(vectors: DataFrame, degrees: DataFrame, cosine: float = COSINE, sample: int = 256) -> DataFrame:
    """One row: classes sampled, links_found, links_there and recall (null where there are none).

    ``sample`` classes chosen by hash are each compared with all vectors by
    brute force (the sample, of that fixed size, goes to every task)."""
    probe: dict[tuple, list] = {}
    for r in vectors.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).collect():
        probe.setdefault((r["label"], r["dim"]), []).append((r["node"], r["v"]))
    probe = {k: (np.array([n for n, _ in x]), np.array([v for _, v in x])) for k, x in probe.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = {k: np.zeros(len(n), np.int64) for k, (n, _) in probe.items()}
        for batch in batches:
            for r in batch.to_pylist():
                if (k := (r["label"], r["dim"])) in probe:
                    nodes, v = probe[k]
                    there[k] += r["copies"] * ((v @ np.array(r["v"]) >= cosine) & (nodes != r["node"]))
        for k, (nodes, _) in probe.items():
            yield pa.RecordBatch.from_pydict({"node": nodes, "there": there[k]})

    truth = vectors.select("node", "label", "dim", "v", "copies").mapInArrow(brute, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    both = truth.join(degrees, "node", "left").agg(
        F.count(F.lit(1)).alias("sampled"), F.coalesce(F.sum("degree"), F.lit(0)).alias("links_found"), F.coalesce(F.sum("there"), F.lit(0)).alias("links_there"))
    return both.withColumn("recall", F.col("links_found") / F.nullif("links_there", F.lit(0)))
