"""Operator 1: repeated passages by a sparse suffix array.

Of all suffixes (word positions) only those are kept at which a k-gram is the
minimum of a window of k-grams under a hash; the choice depends on the content
alone, so two copies of a passage of min_words words keep a suffix at the same
place. Suffixes whose k-gram occurs in one document only go. What the others
need to know of a text is ``side`` words to the right of the k-gram and
``side`` words to the left of it, min_words - k of each: suffixes that agree in
all of that are one entry with its least and greatest document. An entry of two
documents is settled; a k-gram of which some entry has one document is open.

The entries of open k-grams are sorted twice, by the words to the right and by
the words to the left read backwards. In a sorted order the lengths of the
prefixes an entry shares with *any* other one are the running minima of the
common prefixes of neighbours, at most ``side`` + 1 different numbers, kept as
the bits of one integer. With R words to the right and L to the left shared
with another entry (R + L >= side) the passage is extended to both ends by the
stretch of min_words words that ends R words after the k-gram and by the one
that begins L words before it. Stretches at these lengths, told apart by k-gram
and a hash of all their words (128 bits), are grouped; those of two documents
are marked with all the settled entries, and overlapping marks united.

That is exact: if p and q share R and L, both sorts give these very lengths to
both, and the two stretches reach as far as the match does inside the contexts;
what lies beyond belongs to the next kept suffix. The context words have 32 bits;
a chance agreement there only adds a stretch to be looked at.

The sorted order is cut at entries chosen by a hash (one of RANGE entries), so a
cut is the same in every execution, and a k-gram of any number of entries is
cut like others. Running minima are carried over the cuts from one row per range.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import by_rows, landed
from contrail.llm.ngram_join import WordHash, word_hashes

MIN_WORDS = 50
#: Hashes of shared suffixes, by document, are broadcast up to this many (under
#: 16 bytes each), which spares shuffling all texts; else joined.
BROADCAST_SUFFIXES = 4_000_000
#: Entries between two cuts of the sorted order (mean), and the most cuts: both
#: orders together have at most about twice that many, of under 150 bytes each.
RANGE = 65_536
MOST_CUTS = 65_536

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def shape(min_words: int) -> tuple[int, int]:
    """k and window: k + window - 1 words are the shortest passage; lengths up to min_words - k are bits of a long."""
    k = max(1, min_words // 2, min_words - 61)
    return k, min_words - k + 1


class Powers:
    """Powers of the base of the rolling hash and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _of(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(out, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._of(x, 2 * n) for x in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def stretches(words: np.ndarray, begin, end, powers: Powers) -> np.ndarray:
    """A 64-bit hash of the words from each ``begin`` up to its ``end`` (indices or slices)."""
    n = len(words)
    up, down = powers.get(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])
        h = (total[end] - total[begin]) * down[begin]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def kgrams(words: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """A 64-bit hash of the k words from each position."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    return stretches(words, slice(0, n - k + 1), slice(k, n + 1), powers)


def least_of(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the (leftmost) minimum of each window of hashes."""
    at = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1)
    return at + np.arange(len(at))


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the (leftmost) minimum of some window of hashes."""
    return np.unique(least_of(h, window)) if len(h) >= window else np.empty(0, np.int64)


def _suffixes(min_words: int):
    cache, powers = WordHash(), Powers()
    k, window = shape(min_words)

    def run(cols: dict) -> dict:
        out: dict[str, list] = {"doc_id": [], "h": []}
        for i, t in zip(cols["doc_id"], cols["text"]):
            h = kgrams(word_hashes(t, cache, lower=False), k, powers)
            kept = np.unique(h[minimisers(h, window)]).view(np.int64)
            out["doc_id"].append(i)
            out["h"].append(kept)
        return out

    return run


class Places:
    """The kept suffixes of texts whose k-gram is wanted, with the words around them."""

    def __init__(self, min_words: int):
        self.cache, self.powers, self.min_words = WordHash(), Powers(), min_words
        self.k, self.window = shape(min_words)
        self.side = min_words - self.k

    def of(self, text: str | None, wanted) -> tuple:
        """Words, positions, k-grams, entries, and the numbers of words looked at on the left and on the right."""
        words = word_hashes(text, self.cache, lower=False)
        h = kgrams(words, self.k, self.powers)
        at = minimisers(h, self.window)
        at = at[np.isin(h[at].view(np.int64), np.array(wanted, np.int64))]
        left = np.minimum(at, self.side)
        right = np.minimum(len(words) - at - self.k, self.side)
        if len(at):
            with np.errstate(over="ignore"):
                g = stretches(words, at - left, at + self.k + right, self.powers) ^ (left.astype(np.uint64) * np.uint64(_BASE))
        else:
            g = np.empty(0, np.uint64)
        return words, at, h[at].view(np.int64), g.view(np.int64), left, right

    def once(self, text: str | None, hs: list, gs: list) -> tuple[np.ndarray, Iterator[tuple]]:
        """Words of a text and, for each listed entry (k-gram, g) found in it, its
        number in the list, first position, and words on the left and on the right."""
        words, at, h, g, left, right = self.of(text, hs)
        place = dict(zip(zip(h[::-1].tolist(), g[::-1].tolist()), zip(at[::-1].tolist(), left[::-1].tolist(), right[::-1].tolist())))
        return words, ((j, *place[x]) for j, x in enumerate(zip(hs, gs)) if x in place)


def _places(min_words: int):
    places = Places(min_words)

    def run(cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("h", "g", "doc_id", "first", "n")}
        for i, t, wanted in zip(cols["doc_id"], cols["text"], cols["wanted"]):
            _, at, h, g, left, right = places.of(t, wanted)
            out["h"] += h.tolist()
            out["g"] += g.tolist()
            out["doc_id"] += [i] * len(at)
            out["first"] += (at - left).tolist()
            out["n"] += (left + places.k + right).tolist()
        return out

    return run


def _contexts(min_words: int, cuts: list[tuple]):
    """For each entry two rows, ``side`` 0 with the words to the right and 1 with
    the words to the left backwards, and the range of the sorted order they lie in."""
    places = Places(min_words)

    def run(cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("cut", "side", "h", "ctx", "g", "a", "b")}
        for i, t, hs, gs, bs in zip(cols["doc_id"], cols["text"], cols["h"], cols["g"], cols["b"]):
            words, found = places.once(t, hs, gs)
            short = (words >> np.uint64(32)).astype(np.uint32)
            for j, at, left, right in found:
                after, before = at + places.k, short[at - left:at]
                for side, ctx in enumerate((short[after:after + right].tobytes(), before[::-1].tobytes())):
                    row = (side, hs[j], ctx, gs[j])
                    for c, x in zip(("cut", "side", "h", "ctx", "g", "a", "b"), (bisect.bisect_right(cuts, row), *row, i, bs[j])):
                        out[c].append(x)
        return out

    return run


def _stretch_rows(min_words: int):
    """The stretches of entries at their levels (words before the k-gram, as bits)."""
    places = Places(min_words)

    def run(cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("h", "part", "g", "a", "b", "at")}
        for i, t, hs, gs, bs, levels in zip(cols["doc_id"], cols["text"], cols["h"], cols["g"], cols["b"], cols["levels"]):
            words, found = places.once(t, hs, gs)
            parts = kgrams(words, min_words, places.powers).view(np.int64)
            for j, at, left, right in found:
                some = [x for x in range(max(0, places.side - right), left + 1) if levels[j] >> x & 1]
                out["h"] += [hs[j]] * len(some)
                out["part"] += [int(parts[at - x]) for x in some]
                out["g"] += [gs[j]] * len(some)
                out["a"] += [i] * len(some)
                out["b"] += [bs[j]] * len(some)
                out["at"] += [left - x for x in some]
        return out

    return run


def clipped(lengths: int, most: int) -> int:
    """A set of lengths (bits) of which none is above ``most``: larger ones become ``most``."""
    low = lengths & ((1 << most) - 1)
    return low | (1 << most) if lengths >> most else low


def common_prefixes(ctx: list[bytes]) -> np.ndarray:
    """Common prefix, in words, of each context and the one before it (the first: 0)."""
    size = np.fromiter(map(len, ctx), np.int64, len(ctx)) // 4
    width = max(1, int(size.max(initial=0)))
    words = np.frombuffer(b"".join(c.ljust(4 * width, b"\0") for c in ctx), np.uint32).reshape(len(ctx), width)
    out = np.zeros(len(ctx), np.int64)
    same = np.logical_and.accumulate(words[1:] == words[:-1], axis=1).sum(axis=1)
    out[1:] = np.minimum(same, np.minimum(size[1:], size[:-1]))
    return out


def _scan(groups: list, prefix: list[int]) -> tuple[list[int], list[int]]:
    """For rows in order: the lengths shared with earlier rows of the group, and
    the length shared with the very first row (-1: another group)."""
    lengths, to_first, seen, first = [0], [_LONG], 0, _LONG
    for i in range(1, len(groups)):
        if groups[i] != groups[i - 1]:
            seen, first = 0, -1
        else:
            seen, first = clipped(seen, prefix[i]) | (1 << prefix[i]), min(first, prefix[i])
        lengths.append(seen)
        to_first.append(first)
    return lengths, to_first


_LONG = 1 << 20


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared lengths inside each range (mean size RANGE), and what its borders need."""
    held: list[pa.RecordBatch] = []

    def settled() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ctx, h, side = rows["ctx"].to_pylist(), rows["h"].to_pylist(), rows["side"].to_pylist()
        groups, prefix = list(zip(side, h)), common_prefixes(ctx).tolist()
        ahead, to_first = _scan(groups, prefix)
        back, to_last = (x[::-1] for x in _scan(groups[::-1], [0, *prefix[:0:-1]]))
        n = len(ctx)
        edge = [c if i in (0, n - 1) else None for i, c in enumerate(ctx)]
        return pa.RecordBatch.from_pydict({
            **{c: rows[c].combine_chunks() for c in ("cut", "side", "h", "g", "a", "b")}, "ahead": ahead, "back": back,
            "to_first": pa.array(to_first, pa.int32()), "to_last": pa.array(to_last, pa.int32()),
            "place": pa.array(range(n), pa.int64()), "edge": pa.array(edge, pa.binary())}, schema=_SORTED)

    for batch in batches:
        cuts = batch.column("cut").to_numpy()
        ends = [*(np.flatnonzero(cuts[1:] != cuts[:-1]) + 1).tolist(), len(cuts)]
        at = 0
        for end in ends:
            if end > at:
                if held and held[0].column("cut")[0].as_py() != cuts[at]:
                    yield settled()
                    held = []
                held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield settled()


_SORTED = pa.schema([("cut", pa.int32()), ("side", pa.int32()), ("h", pa.int64()), ("g", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                     ("ahead", pa.int64()), ("back", pa.int64()), ("to_first", pa.int32()), ("to_last", pa.int32()),
                     ("place", pa.int64()), ("edge", pa.binary())])
_SORTED_SQL = ("cut int, side int, h long, g long, a long, b long, ahead long, back long, to_first int, to_last int, "
               "place long, edge binary")


def _carried(edges: list) -> list[tuple[int, int, int]]:
    """(range, lengths its first row shares with all before, lengths its last row
    shares with all after) from the first and last row of each range in order."""
    ranges = [list(rows) for _, rows in itertools.groupby(edges, lambda r: r["cut"])]

    def one_way(order: list, near: int, far: int, lengths: str, to_near: str) -> list[int]:
        out, before, row = [], 0, None
        for rows in order:
            first, last = rows[near], rows[far]
            into = 0
            if row is not None and (row["side"], row["h"]) == (first["side"], first["h"]):
                shared = int(common_prefixes([bytes(row["edge"]), bytes(first["edge"])])[1])
                into = clipped(before, shared) | (1 << shared)
            out.append(into)
            before = last[lengths] | (clipped(into, min(last[to_near], 62)) if last[to_near] >= 0 else 0)
            row = last
        return out

    ahead = one_way(ranges, 0, -1, "ahead", "to_first")
    back = one_way(ranges[::-1], -1, 0, "back", "to_last")[::-1]
    return [(rows[0]["cut"], x, y) for rows, x, y in zip(ranges, ahead, back)]


def _levels(entries: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """Entries (h, g, a, b) with the numbers of words before the k-gram, as bits,
    at which a stretch of theirs may be shared by another entry."""
    spark, side = docs.sparkSession, min_words - shape(min_words)[0]
    n = entries.count()
    every = max(RANGE, n // MOST_CUTS + 1)
    chosen = entries.filter(F.pmod(F.xxhash64("h", "g"), F.lit(every)) == 0)
    schema = "cut int, side int, h long, ctx binary, g long, a long, b long"
    picked = by_rows(_with_text(chosen, docs), _contexts(min_words, []), schema, rows=64).select("side", "h", "ctx", "g").collect()
    cuts = sorted((r["side"], r["h"], bytes(r["ctx"]), r["g"]) for r in picked)
    rows = by_rows(_with_text(entries, docs), _contexts(min_words, cuts), schema, rows=64)
    ranged = rows.repartition(len(cuts) + 1, "cut").sortWithinPartitions("cut", "side", "h", "ctx", "g")
    order = landed(ranged.mapInArrow(_neighbours, _SORTED_SQL), "suffix-order")
    edges = order.filter("edge is not null").orderBy("cut", "place").collect()
    carried = spark.createDataFrame(_carried(edges), "cut int, into long, onto long")

    def clip(lengths: str, most: str):
        top, low = f"shiftleft(1L, {most})", f"({lengths} & (shiftleft(1L, {most}) - 1L))"
        return F.expr(f"CASE WHEN {most} < 0 THEN 0L WHEN shiftright({lengths}, {most}) != 0 THEN {low} | {top} ELSE {low} END")

    most = [F.least(c, F.lit(62)).alias(c) for c in ("to_first", "to_last")]
    near = order.join(F.broadcast(carried), "cut").select("side", "h", "g", "a", "b", "ahead", "back", "into", "onto", *most)
    shared = near.withColumn("lengths", F.col("ahead").bitwiseOR(F.col("back")).bitwiseOR(clip("into", "to_first")).bitwiseOR(clip("onto", "to_last")))
    # R words shared on the right leave side - R for the left
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(side)), F.lit(0).cast("long"), lambda acc, r: acc.bitwiseOR(
        F.when(F.call_function("getbit", F.col("lengths"), r) == 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(side) - r))
        .otherwise(F.lit(0).cast("long"))))
    level = F.when(F.col("side") == 0, bits).otherwise(F.col("lengths"))
    return shared.groupBy("h", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.bit_or(level).alias("levels"))


def _with_text(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each entry's least document, with the entries to be looked up in it."""
    more = [c for c in entries.columns if c != "a"]
    lists = entries.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list(F.struct(*more)).alias("of"))
    lists = landed(lists.select("doc_id", *[F.col(f"of.{c}").alias(c) for c in more]), "suffix-lists")
    total = lists.agg(F.coalesce(F.sum(F.size("h") * len(more) + 1), F.lit(0))).first()[0]
    return docs.join(F.broadcast(lists) if total <= BROADCAST_SUFFIXES else lists, "doc_id")


def _small(rows: DataFrame, weight: int = 1) -> DataFrame:
    """To be broadcast if it takes no more than BROADCAST_SUFFIXES hashes (a row as many as ``weight``)."""
    return F.broadcast(rows) if rows.count() * weight <= BROADCAST_SUFFIXES else rows


def united(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one: doc_id, start_word, end_word, n_words, other_doc_id."""
    order = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.groupBy("doc_id", "first", "last").agg(F.min("other").alias("other")).withColumn(
        "new", F.when(F.col("first") <= before, 0).otherwise(1))
    part = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (part.groupBy("doc_id", "part").agg(F.min("first").cast("long").alias("start_word"),
                                               F.max("last").cast("long").alias("end_word"), F.min("other").alias("other_doc_id"))
            .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least ``min_words`` (2 or more) words that also occur in another document.

    One row per passage: doc_id, start_word and end_word (words counted from 0,
    end exclusive; words are what ASCII white space parts), n_words, and
    other_doc_id, a document that has (part of) it. All copies are reported,
    so a caller may keep any one. Null, empty and short texts have none; rows
    with a null key are not compared; rows of one key are one document, so
    repeated rows do not count as a repeat. Passages that overlap in a document
    are united. Other columns are not read; an empty table gives an empty one.
    """
    k, window = shape(min_words)
    rows = docs.filter(docs[key].isNotNull()).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    kept = landed(by_rows(rows, _suffixes(min_words), "doc_id long, h array<long>").filter(F.size("h") > 0), "suffix-kept")
    each = kept.select("doc_id", F.explode("h").alias("h"))
    shared = each.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h")
    wanted = landed(each.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("wanted")), "suffix-shared")
    total = wanted.agg(F.coalesce(F.sum(F.size("wanted") + 1), F.lit(0))).first()[0]
    found = rows.join(F.broadcast(wanted) if total <= BROADCAST_SUFFIXES else wanted, "doc_id")
    places = landed(by_rows(found, _places(min_words), "h long, g long, doc_id long, first int, n int", rows=64), "suffix-places")
    entries = landed(places.groupBy("h", "g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("n").alias("n")), "suffix-entries")
    lone = entries.filter("a = b")
    open_ = landed(lone.select("h").distinct(), "suffix-open")
    of_open = entries.join(_small(open_), "h", "left_semi").select("h", "g", "a", "b")
    levels = landed(_levels(of_open, rows, min_words), "suffix-levels")
    looked = _with_text(levels, rows)
    parts = landed(by_rows(looked, _stretch_rows(min_words), "h long, part long, g long, a long, b long, at int", rows=64), "suffix-stretches")
    common = landed(parts.groupBy("h", "part").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a < b"), "suffix-common")
    some = (parts.filter("a = b").select("h", "part", "g", "at").join(_small(common, 8), ["h", "part"])
            .select("h", "g", "a", "b", "at", F.lit(min_words).alias("n")))
    whole = entries.filter("a < b").select("h", "g", "a", "b", F.lit(0).alias("at"), "n")
    marks = landed(whole.union(some), "suffix-marks")
    start = F.col("first") + F.col("at")
    spans = places.select("h", "g", "doc_id", "first").join(_small(marks, 8), ["h", "g"]).select(
        "doc_id", start.alias("first"), (start + F.col("n")).alias("last"),
        F.when(F.col("a") == F.col("doc_id"), F.col("b")).otherwise(F.col("a")).alias("other"))
    return united(spans)
