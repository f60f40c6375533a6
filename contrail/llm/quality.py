"""Operator 7: quality rules with adaptive thresholds.

Every document gets counts and ratios. Fences of each ratio come from
mergeable quantile sketches per language and source, which merge on into
sketches per language and of the whole corpus. A sketch counts the values in
buckets whose borders grow by GROWTH, so a quantile is right to half of that
share of itself; merging adds counts, so neither order nor partitioning
matters and the same rows always give the same fences. A group too small for a fence
of its own takes that of the next larger one. A share is held to the strictest
fence of its group, its language and the corpus. The fences are then joined to
the documents and replace fixed cutoffs. Two fixed base rules stay.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import by_rows, landed

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratio, side on which it may be too far out, and the least distance of the
#: fence from the quartile (fixed values): a narrow group must not fence off
#: documents that differ by little.
RATIOS = (("mean_word_chars", "low", 1.5), ("mean_word_chars", "high", 2.0), ("symbols_per_word", "high", 0.10),
          ("dup_line_share", "high", 2 / 3), ("repeat_word_share", "high", 2 / 3))
#: Ratios that end at 1. Their distance d from the quartile is folded into what
#: is left above it, as d / (1 + d) of that: the fence stays below 1, and at 0.4
#: where the quartile is 0 (d = 2/3), so below the base rule's 0.5.
SHARES = ("dup_line_share", "repeat_word_share")
#: A fence lies this many quartile ranges beyond the quartile.
REACH = 6.0
#: Ratio of the borders of a sketch's buckets, and the least value told apart
#: from 0: a sketch of values up to 1e9 has no more than 4,200 buckets.
GROWTH = 1.01
LEAST = 1e-9
#: Documents that a group needs for a fence of its own.
GROUP_DOCS = 200


def repeat_words(words: list[str]) -> int:
    """Words that lie in 3-word windows found twice or more (first included)."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    k = len(ids)
    pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
    window = pair[:-1] * k + w[2:]
    _, back, times = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[back] > 1)
    mark = np.zeros(n, bool)
    for d in range(3):
        mark[hit + d] = True
    return int(mark.sum())


def dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if WORD.search(line):
            n += line in seen
            seen.add(line)
    return n


def measure(cols: dict) -> dict:
    out: dict[str, list] = {"key": cols["key"], **{c: [] for c in COUNTS}}
    for t in cols["text"]:
        t = t or ""
        words = WORD.findall(t)
        for c, v in zip(COUNTS, (len(words), sum(map(len, words)), len(SYMBOL.findall(t)), dup_lines(t), repeat_words(words))):
            out[c].append(v)
    out["n_lines"] = [sum(1 for x in (t or "").split("\n") if WORD.search(x)) for t in cols["text"]]
    out["lang"], out["source"] = cols["lang"], cols["source"]
    return out


def signals(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
            source: str = "source") -> DataFrame:
    """Counts and ratios of each document; a document without words has null
    ratios, which no fence judges."""
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"),
                       docs[lang].cast("string").alias("lang"), docs[source].cast("string").alias("source"))
    got = by_rows(rows, measure, "key long, lang string, source string, n_lines long, "
                                 + ", ".join(f"{c} long" for c in COUNTS))
    words = F.nullif(F.col("n_words"), F.lit(0))
    return got.select("*", (F.col("word_chars") / words).alias("mean_word_chars"),
                      (F.col("n_symbols") / words).alias("symbols_per_word"),
                      (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_line_share"),
                      (F.col("n_repeat_words") / words).alias("repeat_word_share"))


def _fence(ratio: str, side: str, least: float) -> Column:
    """The fence of a ratio from its quartiles."""
    low, high = F.col(f"{ratio}_low_quartile"), F.col(f"{ratio}_high_quartile")
    reach = F.greatest(F.lit(REACH) * (high - low), F.lit(least))
    if ratio in SHARES:
        return high + (1 - high) * reach / (1 + reach)
    return high + reach if side == "high" else low - reach


def bucket(value: Column) -> Column:
    """The bucket of a value that is not negative; null for one below LEAST."""
    return F.when(value >= LEAST, F.ceil(F.log(value) / math.log(GROWTH)).cast("int"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: documents with words by bucket, counted in the map tasks first."""
    names = dict.fromkeys(r for r, _, _ in RATIOS)
    each = F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(F.coalesce(F.col(r), F.lit(0.0))).alias("bucket")) for r in names])
    return (measured.filter(F.col("n_words") > 0).select("lang", "source", F.explode(each).alias("x"))
            .groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """One row per group of merged sketches: n, and the quartiles of each ratio
    (of n sorted values those at n / 4 and 3 n / 4, rounded up, as the middle of their bucket)."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "ratio")
    upto = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket")) * (2 / (GROWTH + 1)))
    at = lambda r, q: F.min(F.when((F.col("ratio") == r) & (4 * F.col("upto") >= q * F.col("total")), value))
    return upto.groupBy(*by).agg(F.max("total").alias("n"), *[
        at(r, q).alias(f"{r}_{side}_quartile") for r in dict.fromkeys(r for r, _, _ in RATIOS) for side, q in (("low", 1), ("high", 3))])


def fences(measured: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per (lang, source) with the fence of each ratio. Sketches are
    counted once, per language and source, and merged upwards; what is joined
    later has one row per group."""
    sketch = landed(sketches(measured), "quality-sketches")
    group = quartiles(sketch, "lang", "source")

    def cut(g: DataFrame, level: str, *by: str) -> DataFrame:
        own = [_fence(r, side, least).alias(f"{level}_{r}_{side}") for r, side, least in RATIOS]
        return g.select(*by, F.col("n").alias(f"{level}_n"), *own)

    out = (cut(group, "own", "lang", "source").alias("g")
           .join(cut(quartiles(sketch, "lang").withColumnRenamed("lang", "l"), "lang", "l"), F.col("g.lang").eqNullSafe(F.col("l")))
           .drop("l"))
    whole = cut(quartiles(sketch), "all")  # one row
    corpus = whole.select(F.struct(*whole.columns).alias("w")).scalar()
    out = out.withColumn("corpus", corpus).select("*", "corpus.*")

    def strictest(r: str, side: str) -> Column:
        """A group full of repeats does not set its own standard."""
        return F.least(F.when(F.col("own_n") >= group_docs, F.col(f"own_{r}_{side}")),
                       F.when(F.col("lang_n") >= group_docs, F.col(f"lang_{r}_{side}")), F.col(f"all_{r}_{side}"))

    return out.select("lang", "source", *[
        strictest(r, side).alias(f"{r}_{side}") if r in SHARES else
        F.when(F.col("own_n") >= group_docs, F.col(f"own_{r}_{side}"))
        .when(F.col("lang_n") >= group_docs, F.col(f"lang_{r}_{side}"))
        .otherwise(F.col(f"all_{r}_{side}")).alias(f"{r}_{side}") for r, side, _ in RATIOS])


def judge(docs: DataFrame, group_docs: int = GROUP_DOCS, **columns: str) -> DataFrame:
    """Counts, ratios, base verdict, broken fences and final verdict per document.

    Base rules: fewer than 50 words, or more than half of the words in
    repeated windows. A null text has no words and so fails. A null language
    or source is a group like any other. Documents equal to a fence are kept.
    Repeated rows and null keys are kept one to one; further columns are not
    read; an empty table gives an empty one.
    """
    measured = landed(signals(docs, **columns), "quality")
    f = fences(measured, group_docs).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    both = measured.join(f, measured["lang"].eqNullSafe(F.col("f_lang"))
                         & measured["source"].eqNullSafe(F.col("f_source")), "left")
    broken = F.filter(F.array(*[
        F.when(F.col(r) > F.col(f"{r}_{side}") if side == "high" else F.col(r) < F.col(f"{r}_{side}"),
               F.lit(f"{r}_{side}")) for r, side, _ in RATIOS]), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return both.select(
        "key", *COUNTS, failed.alias("base_failed"),
        (~failed & (F.size(broken) == 0)).alias("kept"), broken.alias("broken_fences"), *dict.fromkeys(r for r, _, _ in RATIOS))
