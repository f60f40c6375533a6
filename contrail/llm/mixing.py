"""Operator 10: mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the corpus over
its actual share. Every document draws its number of copies by inverting a
Poisson distribution of that mean at a uniform number hashed from seed, key
and text digest, is exploded by that count, and all copies are shuffled
globally by another hash. The expected size per source is the target; nothing
but the per-source sums is ever aggregated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import landed

#: Without given weights a source's target share grows as its size to this power.
TEMPERATURE = 0.5
#: The mean of one draw; a larger mean is a sum of several independent draws.
DRAW_MEAN = 16.0
#: The table of sources is broadcast up to this many rows of under 1 KB each,
#: which spares shuffling all texts by source; a longer one is joined by shuffle.
BROADCAST_SOURCES = 16_384
TERMS = 96  # beyond this count a draw of mean 16 has no mass in double precision


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def source_rates(docs: DataFrame, source: str, size: Column, weights: Mapping[str, float] | None = None,
                 temperature: float = TEMPERATURE) -> DataFrame:
    """mix_source, n_docs, mix_size, mix_rate: one row per source, the null
    source being one of them. ``weights`` gives target shares (any positive
    scale; sources it does not name get none); by default sizes to the power
    ``temperature``. A source without size has rate 1."""
    sizes = docs.groupBy(docs[source].alias("mix_source")).agg(
        F.sum(size).cast("double").alias("mix_size"), F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        target = F.pow("mix_size", F.lit(temperature))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        target = F.coalesce(F.try_element_at(named, F.col("mix_source").cast("string")).cast("double"), F.lit(0.0))
    sized = sizes.withColumn("mix_target", target)
    factor = sized.agg((F.sum("mix_size") / F.sum("mix_target")).alias("f")).scalar()
    rate = F.col("mix_target") / F.col("mix_size") * factor
    return sized.select(
        "mix_source", "n_docs", "mix_size",
        F.when(F.col("mix_size") > 0, rate).otherwise(1.0).alias("mix_rate"))


def distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities P(0), P(0..1), ... up to TERMS."""
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))

    def more(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, more, lambda s: s["all"])


def replicated(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0, key: str = "doc_id",
               text: str = "text", source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` (all its columns) with mix_copy (1, 2, ... per document) and
    mix_order (hex digits to sort by), each row as often as drawn.

    Size is counted in characters; a null text has none. Rows with equal key
    and text draw alike, so repeated rows repeat together. Null keys and
    sources are ordinary values. An empty table gives an empty one. Columns of
    ``docs`` named as those added here are replaced.
    """
    own = ("mix_source", "mix_rate", "mix_copy", "mix_order", "mix_cdf", "mix_draws", "mix_seed")
    docs = docs.drop(*[c for c in own if c not in (key, text, source)])
    rates = source_rates(docs, source, F.coalesce(F.length(docs[text]), F.lit(0)), weights, temperature)
    draws = F.greatest(F.ceil(F.col("mix_rate") / DRAW_MEAN), F.lit(1)).cast("int")
    rates = rates.select("mix_source", draws.alias("mix_draws"), distribution(F.col("mix_rate") / draws).alias("mix_cdf"))
    mark = F.concat_ws("|", F.lit(str(seed)), F.coalesce(docs[key].cast("string"), F.lit("null")),
                       F.md5(F.coalesce(docs[text], F.lit(""))))
    rates = landed(rates, "mix-rates")  # one narrow row per source
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.withColumn("mix_seed", mark).join(
        rates, docs[source].eqNullSafe(F.col("mix_source")), "left")
    one = lambda j: F.size(F.filter("mix_cdf", lambda c: c <= uniform(F.col("mix_seed"), j.cast("string"))))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("mix_draws")), F.lit(0), lambda n, j: n + one(j))
    counted = joined.withColumn("mix_copy", F.when(copies > 0, F.sequence(F.lit(1), copies)))
    out = counted.filter(F.col("mix_copy").isNotNull()).select(
        *[F.col(f"`{c}`") for c in docs.columns], "mix_seed", F.explode("mix_copy").alias("mix_copy"))
    order = F.md5(F.concat_ws("|", F.lit("order"), F.col("mix_seed"), F.col("mix_copy").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_copy", order.alias("mix_order"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``replicated`` rows shuffled globally: each copy goes to a partition by
    the hash of mix_order, itself a hash, and is sorted by mix_order there. So
    every source and document is spread evenly and no range has to be sampled."""
    return replicated(docs, **options).repartition("mix_order").sortWithinPartitions("mix_order")
