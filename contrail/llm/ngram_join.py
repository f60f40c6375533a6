"""Operator 8: n-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each class of equal n-gram sets and a column for each
n-gram. Two rows link when overlap / union >= threshold, so the overlap is at
least threshold times the larger set. That size-derived bound cuts the product
down, without losing a link, before any pair is looked at:

1. In any fixed order of columns, linked rows x and y share at least l columns
   among their first |x| - ceil(t|x|) + l ones. With the order of the column
   hashes this needs no counts: rows of which too few of those columns occur
   twice have no link and go. A second pass over what is left, now with all
   columns, keeps rows of which a share of t occurs twice.
2. Among the rest, columns are ordered from rare to frequent. Linked rows share
   one of their first |x| - ceil(t|x|) + 1 columns, which are rare ones.
3. The rows that share such a column form a family, named by its hub, the row
   with the largest share of columns that others have too. First each member is
   multiplied with the hub. Members that do not link to it are then multiplied
   with the whole family in blocks of BLOCK_ROWS rows, overlaps accumulating
   over blocks of columns. A block returns a spanning forest of its links.

Members linked to the hub need no product among each other: they are one
component already. Components come from alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import by_rows, groups, in_arrow, landed
from contrail.llm.components import components

WORDS = 5
PERCENT = 75
SPARE = 8            # the first pass looks at one column in SPARE more than a bound of 1 needs
MAP_COLUMNS = 1 << 18  # columns that a map task gathers before it deals them to blocks
BLOCK_ROWS = 128
BLOCK_COLUMNS = 4096
CACHE_WORDS = 200_000
#: Ids of surviving rows are broadcast up to this many (8 bytes each), which
#: spares shuffling all texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class WordHash(dict):
    """64-bit hashes of words seen so far; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


def word_hashes(text: str | None, cache: WordHash, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text; only A-Z are lower-cased, only the six
    ASCII white-space characters part words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, cache: WordHash, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes: the whole word
    sequence if it is shorter, nothing if there is none."""
    w = word_hashes(text, cache)
    if not len(w):
        return np.empty(0, np.int64)
    n = min(words, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            x = (h ^ w[j:len(w) - n + 1 + j]) * np.uint64(_FACTORS[j % len(_FACTORS)])
            h = x ^ (x >> np.uint64(29))
    return np.unique(h.view(np.int64))


def least_overlap(n, percent: int):
    return -(-n * percent // 100)


def _head(s: np.ndarray, percent: int) -> np.ndarray:
    """The columns that the first pass looks at."""
    n = len(s)
    return s[:n - least_overlap(n, percent) + 1 + n // SPARE]




def _incidence(words: int, blocks: int, chosen):
    """Map side: row profiles, and the incidence of the chosen columns dealt to
    blocks. A column that several rows of a task have counts for them at once
    and travels once, so a very common column is no load for its block."""
    cache = WordHash()
    schema = pa.schema([("block", pa.int32()), ("rows", pa.list_(pa.int64())), ("sizes", pa.binary()), ("columns", pa.binary()),
                        ("n", pa.list_(pa.int64())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])

    def flush(docs: list) -> pa.RecordBatch:
        ids = [d[0] for d in docs]
        keyed = [i for i, d in enumerate(docs) if d[0] is not None]
        heads = [chosen(docs[i][1]).view(np.uint64) >> np.uint64(16) for i in keyed]
        owner = np.repeat(np.arange(len(keyed)), [len(h) for h in heads])
        flat = np.concatenate([np.empty(0, np.uint64), *heads])
        _, first, back, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        shared = np.zeros(len(docs), np.int64)
        shared[keyed] = np.bincount(owner, weights=times[back] > 1, minlength=len(keyed))[:len(keyed)]
        # what is sent: every column once; -1 in place of a row says that it is counted already
        sent_owner = np.where(times > 1, -1, owner[first])
        sent = flat[first]
        block = (sent % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((sent_owner, block))
        sent, sent_owner, block = sent[order], sent_owner[order], block[order]
        bounds = np.searchsorted(block, np.arange(blocks + 1))
        out = [{"block": int(abs(hash(ids[0])) % blocks) if ids[0] is not None else 0, "rows": ids, "n": [len(d[1]) for d in docs],
                "a": [d[2][0] for d in docs], "b": [d[2][1] for d in docs], "shared": shared.tolist()}]
        for k in range(blocks):
            o = sent_owner[bounds[k]:bounds[k + 1]]
            if not len(o):
                continue
            who, size = np.unique(o, return_counts=True)
            out.append({"block": k, "rows": [None if w < 0 else ids[keyed[w]] for w in who], "sizes": size.astype("<u4").tobytes(),
                        "columns": sent[bounds[k]:bounds[k + 1]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, columns = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for i, t in zip(part["doc_id"], part["text"]):
                    s = shingles(t, cache, words)
                    own = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"\0" * 16
                    docs.append((i, s, np.frombuffer(own, "<i8").tolist()))
                    columns += len(s)
                if columns >= MAP_COLUMNS:
                    yield flush(docs)
                    docs, columns = [], 0
        if docs:
            yield flush(docs)

    return run


_BY_ROW = pa.schema([("block", pa.int32())] + [(c, pa.list_(pa.int64())) for c in ("rows", "n", "a", "b", "shared")])
BY_ROW = "block int, rows array<long>, n array<long>, a array<long>, b array<long>, shared array<long>"
PROFILE = "doc_id long, n long, a long, b long, shared long"


def _by_row(blocks: int, rows: np.ndarray, **columns: np.ndarray) -> list[dict]:
    """The entries of each block of rows as arrays in one record."""
    block = rows % blocks
    order = np.argsort(block, kind="stable")
    bounds = np.searchsorted(block[order], np.arange(blocks + 1))
    out = []
    for k in range(blocks):
        own = order[bounds[k]:bounds[k + 1]]
        if len(own):
            out.append({"block": k, "rows": rows[own], **{c: v[own] for c, v in columns.items()}})
    return out


def _occurring(blocks: int):
    """One block of columns: how many of them each row shares, dealt on to
    blocks of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, owners, known = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["columns"] is None:
                    has = np.array([x is not None for x in r["rows"]])
                    col = lambda c: np.array(r[c], np.int64)
                    rows = np.array([0 if x is None else x for x in r["rows"]], np.int64)
                    own = {c: col(c) for c in ("n", "a", "b", "shared")}
                    out = _by_row(blocks, rows[has], **{c: v[has] for c, v in own.items()})
                    if not has.all():  # rows without a key
                        out.append({"block": 0, "rows": [None] * int((~has).sum()), **{c: v[~has] for c, v in own.items()}})
                    yield pa.RecordBatch.from_pylist(out, schema=_BY_ROW)
                    continue
                size = np.frombuffer(r["sizes"], "<u4")
                raw = np.zeros((int(size.sum()), 8), np.uint8)
                raw[:, :6] = np.frombuffer(r["columns"], np.uint8).reshape(-1, 6)
                columns.append(raw.view("<u8").ravel())
                owners.append(np.repeat(np.array([0 if x is None else x for x in r["rows"]], np.int64), size))
                known.append(np.repeat(np.array([x is None for x in r["rows"]]), size))
        if not columns:
            return
        column, owner, is_known = np.concatenate(columns), np.concatenate(owners), np.concatenate(known)
        del columns, owners, known
        _, back, times = np.unique(column, return_inverse=True, return_counts=True)
        often = times > 1
        often[back[is_known]] = True
        rows, shared = np.unique(owner[often[back] & ~is_known], return_counts=True)
        yield pa.RecordBatch.from_pylist(_by_row(blocks, rows, shared=shared.astype(np.int64)), schema=_BY_ROW)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of rows: the profile of each with the sum of its shared columns."""
    profiles: list[dict] = []
    rows, shared = [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["n"] is not None:
                profiles.append(r)
            if r["rows"] and r["rows"][0] is not None:
                rows.append(np.array(r["rows"], np.int64))
                shared.append(np.array(r["shared"], np.int64))
    if rows:
        ids, back = np.unique(np.concatenate(rows), return_inverse=True)
        total = dict(zip(ids.tolist(), np.bincount(back, weights=np.concatenate(shared)).astype(np.int64).tolist()))
    for r in profiles:
        yield pa.RecordBatch.from_pydict({"doc_id": r["rows"], "n": r["n"], "a": r["a"], "b": r["b"], "shared": [
            0 if x is None else total[x] for x in r["rows"]]}, schema=pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "a", "b", "shared")]))


def occurrences(rows: DataFrame, words: int, chosen) -> DataFrame:
    """doc_id, n, a, b (size and print of the set) and shared (how many chosen
    columns other rows have too) per row. Columns are dealt to blocks, counted
    there, and the counts dealt on to blocks of rows and summed. A task has one
    block (by a hash of its number some would have several, others none)."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ("block int, rows array<long>, sizes binary, columns binary, n array<long>, a array<long>, "
            "b array<long>, shared array<long>")
    dealt = in_arrow(rows.select("doc_id", "text"), _incidence(words, blocks, chosen), kind).repartitionById(blocks, "block")
    counted = in_arrow(dealt, _occurring(blocks), BY_ROW).repartitionById(blocks, "block")
    return in_arrow(counted, _totals, PROFILE)


def _sets(words: int):
    cache = WordHash()

    def run(cols: dict) -> dict:
        sets = [shingles(t, cache, words) for t in cols["text"]]
        own = [int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) for s in sets]
        return {"node": cols["node"], "own": own, "n": [len(s) for s in sets], "cols": sets}

    return run


def surviving(profile: DataFrame, least) -> DataFrame:
    """a, b, doc_id (one of the class) of classes with enough shared columns."""
    live = profile.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0) & (F.col("shared") >= least))
    return live.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))


def _only(rows: DataFrame, live: DataFrame) -> DataFrame:
    """doc_id, node, text of the rows of surviving classes."""
    wanted = live.select("doc_id", F.col("a").alias("node"))
    return rows.join(F.broadcast(wanted) if live.count() <= BROADCAST_IDS else wanted, "doc_id")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Step 2: h, node, share for the rare first columns of each row."""
    posting = sets.select("node", "n", F.explode("cols").alias("h"))
    df = posting.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = landed(posting.join(df, "h"), "ngram-common")
    # a row keeps its chance only if enough of its columns occur elsewhere
    rows = common.groupBy("node", "n").agg(F.count(F.lit(1)).alias("common")).filter(
        F.col("common") >= F.ceil(F.col("n") * percent / 100))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("common"))
    rows = rows.select("node", "common", first.alias("first"), (F.col("common") / F.col("n")).alias("share"))
    ranked = common.join(rows, "node").withColumn(
        "at", F.row_number().over(Window.partitionBy("node").orderBy("df", "h")))
    return ranked.filter("at <= first").select("h", "node", "share")


def families(prefix: DataFrame) -> DataFrame:
    """hub, node: the members of each family but its hub."""
    top = prefix.groupBy("h").agg(F.max(F.struct("share", "node")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (prefix.join(top.select("h", F.col("top.node").alias("hub")), "h")
            .filter("hub != node").select("hub", "node").distinct())


def _linked(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def _with_hub(percent: int):
    schema = pa.schema([("hub", pa.int64()), ("node", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _), rows in groups(batches, ["hub", "part"]):
            head = next(r for r in rows if r["node"] == hub)
            out = [{"hub": hub, "node": r["node"], "linked": bool(_linked(
                len(np.intersect1d(head["cols"], r["cols"], assume_unique=True)), head["n"], r["n"], percent))}
                for r in rows if r["node"] != hub]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all left rows with all right rows: a product of 0/1
    matrices, accumulated over blocks of columns that the left rows have."""
    columns = np.unique(np.concatenate(left))

    def coordinates(rows):
        ids = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows)
        at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        hit = columns[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], ids[hit][order]

    (lc, li), (rc, ri) = coordinates(left), coordinates(right)
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(columns), BLOCK_COLUMNS):
        parts = []
        for c, i, n in ((lc, li, len(left)), (rc, ri, len(right))):
            a, b = np.searchsorted(c, [start, start + BLOCK_COLUMNS])
            m = np.zeros((n, BLOCK_COLUMNS), np.float32)
            m[i[a:b], c[a:b] - start] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def _in_blocks(percent: int):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["hub", "i", "j"]):
            left, right = [r for r in rows if r["left"]], [r for r in rows if not r["left"]]
            if not left or not right:
                continue
            n, m = np.array([r["n"] for r in left]), np.array([r["n"] for r in right])
            hit = _linked(overlaps([r["cols"] for r in left], [r["cols"] for r in right]), n[:, None], m[None, :], percent)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    x = root[x] = root[root[x]]
                return x

            out = []
            for i, j in zip(*np.nonzero(hit)):
                x, y = left[i]["node"], right[j]["node"]
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append({"x": x, "y": y})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def links(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Step 3: links x, y between rows that span the same components as all links."""
    n_blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    parts = members.groupBy("hub").agg(n_blocks(F.count(F.lit(1))).alias("parts"))
    rows = (members.join(parts, "hub").select("hub", "node", part(F.col("parts")).alias("part"))
            .union(parts.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))))
    dealt = rows.join(sets, "node").repartition("hub", "part").sortWithinPartitions("hub", "part")
    judged = landed(in_arrow(dealt, _with_hub(percent), "hub long, node long, linked boolean"), "ngram-hub")

    open_families = (judged.groupBy("hub").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(~F.col("linked")).alias("rest"))
        .filter("rest > 0 and all > 1").select("hub", n_blocks(F.col("all")).alias("parts")))
    own = judged.join(open_families, "hub").withColumn("own", part(F.col("parts")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = own.filter("not linked").select("hub", "node", F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("left"))
    right = own.select("hub", "node", "linked", "own", every.alias("i")).filter("linked or own >= i").select(
        "hub", "node", "i", F.col("own").alias("j"), F.lit(False).alias("left"))
    blocks = left.union(right).join(sets, "node").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    more = in_arrow(blocks, _in_blocks(percent), "x long, y long")
    return judged.filter("linked").select(F.col("hub").alias("x"), F.col("node").alias("y")).union(more)


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """``key``, n_shingles, component_id per row of ``docs``.

    n_shingles is the size of the row's set of distinct ``words``-word n-grams;
    component_id the least key reachable by links of Jaccard similarity of at
    least ``percent`` / 100, the row itself included. Null and empty texts have
    an empty set and link with nothing. Rows with equal sets are one class, so
    repeated rows and copies are never paired. Rows with a null key get the
    component of their class, null if it has no key. Other columns are not
    read; an empty table gives an empty one. Columns are told apart by 64-bit
    hashes, classes by 128-bit ones.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    profile = landed(occurrences(rows, words, lambda s: _head(s, percent)), "ngram-profile")
    bound = F.ceil(F.col("n") * percent / 100)
    live = landed(surviving(profile, 1 + F.floor(bound / SPARE)), "ngram-live")
    again = landed(occurrences(_only(rows, live), words, lambda s: s), "ngram-again")
    live = landed(surviving(again, bound).join(live.select("a", "b"), ["a", "b"], "left_semi"), "ngram-live")
    sets = landed(by_rows(_only(rows, live).select("node", "text"), _sets(words), "node long, own long, n long, cols array<long>")
                  .filter("own = node").drop("own"), "ngram-sets")
    if sets.count() != live.count():  # repeated rows
        sets = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("cols").alias("cols"))
    members = landed(families(prefixes(sets, percent)), "ngram-families")
    found = links(sets, members, percent)

    classes = profile.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("first_id"))
    ids = live.select(F.col("a").alias("node"), F.col("doc_id").alias("id"))
    ends = (found.join(ids.withColumnsRenamed({"node": "x", "id": "x_id"}), "x")
            .join(ids.withColumnsRenamed({"node": "y", "id": "y_id"}), "y").select("x_id", "y_id"))
    component = components(ends)
    joined = (profile.select("doc_id", "n", "a", "b")
              .join(classes, ["a", "b"], "left").join(component, F.col("first_id") == F.col("node"), "left"))
    return joined.select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "first_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                        percent: int = PERCENT) -> DataFrame:
    """``docs`` (all columns) with one row of each component: that of the least
    key (a null key last), of equal rows (key and text) one. Rows are told
    apart by a 64-bit hash of key and text, so different texts under one key
    all stay, and near copies go whether or not they have a key; rows that
    share the hash but not key and text are found and all stay. Texts without
    words are nobody's copies and stay."""
    row = "_row" + "_" * max([0, *(len(c) for c in docs.columns)])  # no column of that name
    rows = docs.withColumn(row, F.xxhash64(key, text))
    classes = landed(jaccard_classes(rows, row, text, words, percent).filter("n_shingles > 0").select(row, "component_id"), "ngram-classes")
    repeated = classes.groupBy(row).count().filter("count > 1").select(row)
    whole = F.struct(F.col(key).isNull(), key, F.sha2(text, 256))
    again = landed(rows.join(repeated, row, "left_semi").groupBy(row).agg(F.min(whole) == F.max(whole)).toDF(row, "equal"), "ngram-repeated")
    alike = again.filter("equal").select(row)
    many = classes.groupBy("component_id").count().filter("count > 1").select("component_id")
    known = classes.join(many, "component_id").join(again.filter("NOT equal").select(row), row, "left_anti").distinct()
    known = known.join(rows.select(row, F.col(key).alias("_key")).distinct(), row)
    keep = known.groupBy("component_id").agg(F.min(F.struct(F.col("_key").isNull(), "_key", row))[row].alias("_keep"))
    gone = landed(known.join(keep, "component_id").filter(F.col(row) != F.col("_keep")).select(row), "ngram-gone")
    small = gone.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if small else gone, row, "left_anti")
    if not alike.isEmpty():
        place = "_at" + row
        order = Window.partitionBy(row).orderBy(*[c for c, t in docs.dtypes if c not in (key, text) and not t.startswith("map")], F.lit(0))
        one = kept.join(alike, row, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
        kept = kept.join(alike, row, "left_anti").unionByName(one)
    return kept.drop(row)
