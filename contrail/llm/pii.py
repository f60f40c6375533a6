"""Operator 3: personal data, by fixed forms and by bootstrapped contexts.

Base spans follow fixed forms (e-mail, IP address, card, phone). They are the
seeds: the words before a seed form a lexical pattern, and every identifier-
shaped stretch of text that follows the same words is a candidate. Patterns
and candidates form a bipartite graph; a few rounds pass confidence back and
forth (a pattern is as good as the share of confirmed instances it meets, with
a prior against it; an instance combines its patterns), and spans whose
confidence is high are added.

Only DataFrame functions are used. Positions come from the text between the
matches: a match starts where the stretches and matches before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import landed

KINDS = ("email", "ip", "card", "phone")
#: The fixed forms. Possessive repeats match the same texts as plain ones here
#: (what follows a repeat is never in it) and need no stack on long runs. A match
#: that fails at the begin of a run fails all along it, so e-mail and IP address
#: are tried there and where the last match ended only: linear in the text. Runs
#: of fewer than 13 digits cannot be cards and are not matched at all.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the form either.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": r"\+[0-9]"}
#: Identifier-shaped: a stretch with a digit or an at-sign, and groups of digits
#: after it. It begins where its run of characters does, not after a slash or a
#: bracket inside.
CANDIDATE = (r"(?<![0-9A-Za-z@._%:+-][/()]{0,8})(?=[+(]?[0-9A-Za-z])(?=[A-Za-z._%:()/+-]*+[0-9@])[+(]?[0-9A-Za-z][0-9A-Za-z@._%:()/+-]*+"
             r"(?:\x20[(]?[0-9][0-9().-]*+)*+")
#: The words before a candidate are looked for in this many characters.
CONTEXT_CHARS = 64
ROUNDS = 3
#: A pattern needs so many distinct confirmed instances; an added span needs this confidence.
SEEDS = 3
CONFIDENT = 0.8
PRIOR = 1.0  # unconfirmed instances that every pattern is charged with

SPAN = "struct<kind:string,s:int,e:int,t:string>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, form: str, hint: str) -> Column:
    """Array of struct(t, s, e, before): the leftmost non-overlapping matches,
    their code point positions (end exclusive) and the text between a match
    and the one before it."""
    def located(m: Column) -> Column:
        starts = F.aggregate(
            m["found"], F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("at")),
            lambda a, t: _let(a["at"] + F.length(F.get(m["gaps"], F.size(a["s"]))), lambda s: F.struct(
                F.concat(a["s"], F.array(s)).alias("s"), (s + F.length(t)).alias("at"))),
            lambda a: a["s"])
        return _let(starts, lambda at: F.transform(m["found"], lambda t, i: F.struct(
            t.alias("t"), F.get(at, i).alias("s"), (F.get(at, i) + F.length(t)).alias("e"),
            F.get(m["gaps"], i).alias("before"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("found"), F.split(text, form, -1).alias("gaps"))
    return F.when(F.regexp_like(text, F.lit(hint)), _let(both, located)).otherwise(
        F.array().cast("array<struct<t:string,s:int,e:int,before:string>>"))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Sum over the digits, every second one from the right doubled, is a multiple of 10."""
    digit = F.transform(F.split(F.reverse(d), ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(digit, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)),
                       F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(part, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(_digits(t)).between(13, 19), _luhn(_digits(t))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of struct(kind, s, e, t), by kind as in KINDS, then start."""
    def of(kind: str) -> Column:
        good = F.filter(matches(text, FORMS[kind], HINTS[kind]), lambda m: _valid(kind, m["t"]))
        return F.transform(good, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), m["t"].alias("t")))

    return F.concat(*map(of, KINDS))


def candidates(text: Column, base: Column) -> Column:
    """Array of struct(s, e, t, kind, patterns): identifier-shaped stretches,
    the kind of the first base span they touch (null: none) and the one and
    two words before them, in lower case."""
    def one(m: Column) -> Column:
        t = F.regexp_replace(m["t"], r"[^0-9A-Za-z)]+$", "")
        near = F.lower(F.substring(m["before"], -CONTEXT_CHARS, CONTEXT_CHARS))
        words = F.filter(F.split(near, r"\s+"), lambda w: w != "")
        two = _let(words, lambda w: F.filter(F.array(
            F.try_element_at(w, F.lit(-1)),
            F.concat_ws(" ", F.try_element_at(w, F.lit(-2)), F.try_element_at(w, F.lit(-1)))), lambda p: F.coalesce(p, F.lit("")) != ""))
        touched = F.filter(base, lambda b: (b["s"] < m["e"]) & (b["e"] > m["s"]))
        return F.struct(m["s"].alias("s"), (m["s"] + F.length(t)).alias("e"), t.alias("t"),
                        F.try_element_at(touched, F.lit(1))["kind"].alias("kind"), F.array_distinct(two).alias("patterns"))

    return F.transform(matches(text, CANDIDATE, "[0-9@]"), one)


def learned(edges: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """kind, t, confidence, pattern: instances that no form confirms but good
    patterns do, a row for each of those patterns.

    ``edges`` has distinct rows (pattern, t, kind), kind null if unconfirmed.
    Each round scores patterns by the instances confirmed so far and then the
    instances by their patterns; both steps are grouped sums."""
    seeds_at = edges.filter(F.col("kind").isNotNull()).select("kind", "t").distinct().withColumn("w", F.lit(1.0))
    meets = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    open_ = edges.filter(F.col("kind").isNull()).select("pattern", "t")
    known, new, good = seeds_at, None, None
    for _ in range(rounds):
        good = landed(edges.select("pattern", "t").join(known, "t").groupBy("pattern", "kind")
                .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= seeds)
                .join(meets, "pattern").select("pattern", "kind", (F.col("w") / (F.col("n") + PRIOR)).alias("c"))
                .filter("c > 0.1"), "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("c"), F.lit(0.999999)))))
        new = landed(open_.join(good, "pattern").groupBy("kind", "t").agg((F.lit(1.0) - doubt).alias("confidence"))
                     .filter(F.col("confidence") >= confident), "pii-learned")
        known = seeds_at.union(new.select("kind", "t", F.col("confidence").alias("w")))
    return open_.join(good, "pattern").select("kind", "t", "pattern").join(new, ["kind", "t"])


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text), base and spans (arrays of
    struct(kind, s, e, t) by kind, then start; spans holds base and more), one
    row per row of ``docs``.

    A null text is empty. Rows are told apart by key and text, so repeated
    rows all get the same spans and null keys are no obstacle. Spans added for
    a kind never overlap a base span and stand after one of the patterns that
    vouch for them: the same text elsewhere is not touched. Where two kinds claim
    the same text the more confident one (then the first kind) gets it. Other
    columns are not read; an empty table gives an empty one.
    """
    body = F.coalesce(docs[text], F.lit(""))
    found = docs.select(docs[key].alias("doc_id"), body.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = landed(found.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "base",
                                candidates(F.col("text"), F.col("base")).alias("cands")), "pii-found")
    cand = found.filter(F.size("cands") > 0).select("doc_id", "digest", F.explode("cands").alias("c"))
    edges = landed(cand.select(F.explode("c.patterns").alias("pattern"), F.col("c.t").alias("t"), F.col("c.kind").alias("kind"))
                   .distinct(), "pii-edges")
    hits = landed(learned(edges), "pii-hits")
    best = hits.groupBy("t").agg(F.max(F.struct(
        "confidence", F.negative(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).alias("order"), "kind")).alias("b"))
    vouched = hits.join(best.select("t", "b.kind"), ["t", "kind"]).select("t", "pattern", "kind")
    added = (cand.filter(F.col("c.kind").isNull()).select("doc_id", "digest", "c.s", "c.e", "c.t", F.explode("c.patterns").alias("pattern"))
             .join(vouched, ["t", "pattern"]).drop("pattern").distinct().groupBy("doc_id", "digest")
             .agg(F.collect_list(F.struct("kind", "s", "e", "t")).alias("added"))
             .withColumnsRenamed({"doc_id": "a_id", "digest": "a_digest"}))
    order = F.array(*map(F.lit, KINDS))
    rank = lambda x: F.struct(F.array_position(order, x["kind"]), x["s"], x["e"])
    by_kind = lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("digest") == F.col("a_digest")), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"), by_kind))
    return joined.select("doc_id", "digest", "base", spans.alias("spans"))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.

    Overlapping spans are replaced together, by the kind of the first. Texts
    without spans, null ones included, stay as they are; all other columns do."""
    spans = (find_spans(docs, key, text).filter(F.size("spans") > 0)
             .select(F.col("doc_id").alias("_pii_key"), F.col("digest").alias("_pii_digest"), F.col("spans").alias("_pii_spans"))
             .distinct())
    joined = docs.join(spans, docs[key].eqNullSafe(F.col("_pii_key")) & (
        F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256) == F.col("_pii_digest")), "left")
    by_start = F.array_sort("_pii_spans", lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1)
                            .otherwise(F.when(a["e"] > b["e"], -1).when(a["e"] < b["e"], 1).otherwise(0)))

    def cut(a: Column, x: Column) -> Column:
        inside = x["s"] < a["at"]
        piece = F.when(inside, F.lit("")).otherwise(F.concat(
            F.substring(docs[text], a["at"] + 1, x["s"] - a["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.concat(a["out"], F.array(piece)).alias("out"), F.greatest(a["at"], x["e"]).alias("at"))

    clean = F.aggregate(by_start, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), cut,
                        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(docs[text], a["at"] + 1, F.length(docs[text]))))
    new = F.when(F.col("_pii_spans").isNull(), docs[text]).otherwise(clean)
    return joined.select(*[new.alias(c) if c == text else docs[c] for c in docs.columns])
