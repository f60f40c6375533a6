"""Operator 11: repair of conversation structure by scalar big-integer weights.

A conversation is to read ``(s?(ua)+)?`` in the initials of its roles. The
edits of its rows span a graph whose nodes are (row, state of that pattern).
The way from a node to the end weighs one integer: its cost in the high
digits, below them one digit for each letter of the audit (Delete, Insert,
Keep, Rerole in ASCII order), first letter highest, zeros at the end. A letter
put in front moves the others one place down. So the ordinary minimum of
integers picks the cheapest way and, among equals, the ASCII-least audit.
The audit fixes the repaired turns: in a given state only one role can be
inserted or assigned.

Conversations of up to LONG rows and LONG_CHARS characters are repaired one by
one inside the tasks. A longer one is sorted by range over many tasks and cut
into blocks of BLOCK rows. A block's ways between any two states are weighed
alone; equally long stretches never hold an audit that begins another one, so
the cheapest way through all blocks follows from their costs and the order of
their audits, four numbers at a time. Then each block writes out its part.

Odd rows: a null role or text reads as one space, so the row is blank or its
role fits nowhere; rows of equal turn are ordered by role, then by the SHA-256
of the text; null turns come first; rows without conv_id are a conversation of
their own; repeated rows are duplicates; an empty table gives no rows. Other
columns are not read. conv_id and turn must be integers; a gap count beyond a
long is reported as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import WORD_SPACE, landed

LONG, LONG_CHARS = 4096, 16_000_000  # a conversation of more rows or characters is cut
BLOCK = 512                          # rows of a block of such a conversation, at most

# Fixed by the contract: costs, letters (by digit), states of the pattern (0 nothing yet, 1 after s, 2 after u, 3 after a).
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
DIGIT = 3                            # bits of a digit
GOES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUTS = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))  # the one role that can be put in, and the state after it
TO_THE_END = ("", "II", "I", "")     # inserts that finish the pattern

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, sha, gone of each row after the damage that
    the checksum of ``conv_id:turn`` prescribes; a dropped row stays as a mark."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = (F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    gone = F.col("fault") == 0
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"),
                       gone.alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy").withColumn("sha", F.sha2("text", 256))


# -- one stretch of rows --------------------------------------------------------

def ways(rows: list[tuple[str, bool, bool]], ends: dict[int, str], width: int) -> list[int | None]:
    """The weight of the best way through ``rows`` (initial, must go, truncated)
    from each state. ``ends``: the states it may end in, with the letters that
    follow there. An audit has room for ``width`` letters."""
    bits = DIGIT * width
    low = (1 << bits) - 1

    def put(letter: str, cost: int, rest: int | None) -> int | None:
        if rest is None:
            return None
        return (((rest >> bits) + cost) << bits) | (LETTERS[letter] << (bits - DIGIT)) | ((rest & low) >> DIGIT)

    def least(*found: int | None) -> int | None:
        return min((w for w in found if w is not None), default=None)

    now: list[int | None] = []
    for state in range(4):
        rest = 0 if state in ends else None
        for _ in ends.get(state, ""):
            rest = put("I", INSERT, rest)
        now.append(rest)
    for initial, must, short in reversed(rows):
        then, now = now, []
        for state in range(4):
            best = put("D", DELETE, then[state])
            if not must:
                if initial in GOES[state]:
                    best = least(best, put("K", KEEP + short * TRUNCATED, then[GOES[state][initial]]))
                best = least(best, put("R", REROLE + short * TRUNCATED, then[PUTS[state][1]]))
            now.append(best)
        for _ in range(2):  # a third insert in a row would only come back to a state passed before
            now = [least(now[s], put("I", INSERT, now[PUTS[s][1]])) for s in range(4)]
    return now


def letters(weight: int, width: int) -> str:
    """The audit in the low digits of a weight."""
    names = {n: c for c, n in LETTERS.items()}
    digits = ((weight >> (DIGIT * (width - 1 - i))) & (2**DIGIT - 1) for i in range(width))
    return "".join(names[d] for d in digits if d)


def rewritten(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns (role, text) that an audit leaves."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else turns[at]
        at += edit != "I"
        if edit == "K":
            state = GOES[state][role[:1]]
        elif edit in "RI":
            role, state = PUTS[state]
        if edit != "D":
            out.append((edit, role, text))
    return out


def fault_of(role: str, text: str, again: bool) -> str:
    """The first fault of a row, '' for none."""
    bare = text.strip(WORD_SPACE)
    return "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ".!?" else ""


def repair_one(rows: list[tuple[int | None, str, str, str]]) -> tuple[dict, list[tuple[str, str, str]]]:
    """Report and repaired turns of one conversation: rows (turn, role, text, sha) in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text, sha in rows:
        faults.append(fault_of(role, text, (role, sha) in seen))
        seen.add((role, sha))
    width = 3 * len(rows) + 2
    weight = ways([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)], dict(enumerate(TO_THE_END)), width)[0]
    audit = letters(weight, width)
    turns = rewritten([(r[1], r[2]) for r in rows], audit)
    numbers = [r[0] for r in rows if r[0] is not None]
    report = {
        "gaps": min(max(numbers) - min(numbers) + 1 - len(set(numbers)), 2**63 - 1) if numbers else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": weight >> (DIGIT * width), "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest(),
    }
    return report, turns


# -- whole tables --------------------------------------------------------------

TURNS = "conv_id long, position long, edit string, role string, text string"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    at, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[k] for k in keys)
            if rows and key != at:
                yield at, rows
                rows = []
            at = key
            rows.append(r)
    if rows:
        yield at, rows


def _each(schema: pa.Schema, want_turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv,), rows in _grouped(batches, ["conv_id"]):  # at most LONG rows
            report, turns = repair_one([(r["turn"], r["role"], r["text"], r["sha"]) for r in rows if not r["gone"]])
            if want_turns:
                out += [{"conv_id": conv, "position": i, "edit": e, "role": role, "text": text} for i, (e, role, text) in enumerate(turns)]
            else:
                out.append({"conv_id": conv} | report)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _split(rows: DataFrame, long: int, chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that one task takes whole, and those of longer ones (None if there are none)."""
    large = landed(rows.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size"))
                   .filter((F.col("n") > long) | (F.col("size") > chars)).select("c"), "repair-long")
    if large.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def repair(rows: DataFrame, turns: bool = False, long: int = LONG, chars: int = LONG_CHARS, block: int = BLOCK) -> DataFrame:
    """A report per conversation of ``rows`` (conv_id, turn, role, text, sha,
    gone) or, with ``turns``, its repaired turns in order (conv_id, position, edit, role, text)."""
    schema = TURNS if turns else f"conv_id long, {REPORT}"
    whole, rest = _split(rows, long, chars)
    order = ["conv_id", "turn", "role", "sha"]
    out = (whole.select(*order, "text", "gone").repartition("conv_id").sortWithinPartitions(*order)
           .mapInArrow(_each(_schema(schema), turns), schema))
    return out if rest is None else out.unionByName(_repair_long(rest, turns, block))


# -- conversations longer than a task should hold ---------------------------------

def _inner(rows: list[dict]) -> list[tuple[str, bool, bool]]:
    return [(r["role"][:1], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in rows]


def _weigh(schema: pa.Schema):
    """Of each block: the cost of the best way between any two states, its rank
    among those that begin alike (by audit), the initials at its ends, its illegal pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _grouped(batches, ["conv_id", "block"]):
            inner, width = _inner(rows), 3 * len(rows) + 2
            bits = DIGIT * width
            by_end = [ways(inner, {end: ""}, width) for end in range(4)]
            costs, ranks = [], []
            for state in range(4):
                audits = sorted({by_end[e][state] & ((1 << bits) - 1) for e in range(4) if by_end[e][state] is not None})
                for e in range(4):
                    w = by_end[e][state]
                    costs.append(None if w is None else w >> bits)
                    ranks.append(None if w is None else audits.index(w & ((1 << bits) - 1)))
            initials = [i for i, _, _ in inner]
            yield pa.RecordBatch.from_pylist([{
                "conv_id": conv, "block": block, "costs": costs, "ranks": ranks, "first": initials[0], "last": initials[-1],
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))}], schema=schema)

    return run


def _choose(schema: pa.Schema):
    """Per conversation, blocks from the last to the first: which state each
    block begins and ends in. Held are four numbers a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        def told(conv, steps, cost, illegal):
            state, out = 0, []
            for block, goes in reversed(steps):
                out.append({"conv_id": conv, "block": block, "enter": state, "leave": goes[state], "cost": None, "illegal": None})
                state = goes[state]
            out.append({"conv_id": conv, "block": None, "enter": None, "leave": state, "cost": cost[0], "illegal": illegal})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        conv, steps, cost, illegal, first = None, [], [], 0, ""
        for r in rows():
            if steps and r["conv_id"] != conv:
                yield told(conv, steps, cost, illegal)
                steps = []
            if not steps:
                conv, illegal, cost = r["conv_id"], 0, [INSERT * len(t) for t in TO_THE_END]
            else:
                illegal += r["last"] + first not in ("su", "ua", "au")
            illegal += r["illegal"]
            first = r["first"]
            best = [min((r["costs"][4 * s + e] + cost[e], r["ranks"][4 * s + e], e) for e in range(4) if r["costs"][4 * s + e] is not None)
                    for s in range(4)]
            cost = [b[0] for b in best]
            steps.append((r["block"], bytes(b[2] for b in best)))
        if steps:
            yield told(conv, steps, cost, illegal)

    return run


def _write(schema: pa.Schema):
    """Rows of each block after the edits of its best way; deleted ones keep their letter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _grouped(batches, ["conv_id", "block"]):
            width = 3 * len(rows) + 2
            enter, leave = rows[0]["enter"], rows[0]["leave"]
            audit = letters(ways(_inner(rows), {leave: ""}, width)[enter], width)
            kept = iter(rewritten([(r["role"], r["text"]) for r in rows], audit, enter))
            out = [{"conv_id": conv, "block": block, "no": i, "edit": e, **dict(zip(("role", "text"), next(kept)[1:] if e != "D" else (None, None)))}
                   for i, e in enumerate(audit)]
            for i in range(0, len(out), 128):
                yield pa.RecordBatch.from_pylist(out[i:i + 128], schema=schema)

    return run


def _digested(schema: pa.Schema):
    """Audit and digest of each conversation from its edits in order; texts only pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, audit, sha, lines = False, None, [], hashlib.sha256(), 0

        def told():
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if not open_ or r["conv_id"] != conv:
                    if open_:
                        yield told()
                    open_, conv, audit, sha, lines = True, r["conv_id"], [], hashlib.sha256(), 0
                audit.append(r["edit"])
                if r["edit"] != "D":
                    sha.update((("\n" if lines else "") + f"{r['role']}:{r['text']}").encode())
                    lines += 1
        if open_:
            yield told()

    return run


def _repair_long(rows: DataFrame, want_turns: bool, block: int) -> DataFrame:
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "sha", "copy"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = landed(rows.filter("NOT gone").withColumn("copy", F.monotonically_increasing_id())
                    .repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .select("conv_id", "turn", "role", "text", "sha", F.monotonically_increasing_id().alias("pos")), "repair-placed")
    first = placed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min("pos").alias("first"))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("pos") > F.col("first"), "duplicate")
             .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise(""))
    flagged = landed(placed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")))
                     .select("conv_id", "turn", "role", "text", "pos", F.floor(F.col("pos") / block).cast("long").alias("block"), fault.alias("fault")),
                     "repair-flagged")
    ddl = "conv_id long, block long, costs array<long>, ranks array<int>, first string, last string, illegal long"
    weighed = (flagged.select("conv_id", "block", "pos", "role", "fault").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
               .mapInArrow(_weigh(_schema(ddl)), ddl))
    ddl = "conv_id long, block long, enter int, leave int, cost long, illegal long"
    chosen = landed(weighed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_choose(_schema(ddl)), ddl), "repair-chosen")
    ddl = "conv_id long, block long, no long, edit string, role string, text string"
    steps = chosen.filter("block IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "enter", "leave")
    edits = (flagged.join(steps, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
             .select("conv_id", "block", "pos", "role", "text", "fault", "enter", "leave")
             .repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(_write(_schema(ddl)), ddl))
    ends = (chosen.filter("block IS NULL").select("conv_id", F.lit(2**62).alias("block"), F.array(*map(F.lit, TO_THE_END)).getItem(F.col("leave")).alias("puts"))
            .select("conv_id", "block", F.posexplode(F.split("puts", "")).alias("no", "edit")).filter("edit = 'I'"))
    # after s comes user, assistant; after u only assistant
    role = F.when((F.count(F.lit(1)).over(_window("conv_id")) == 2) & (F.col("no") == F.min("no").over(_window("conv_id"))), "user").otherwise("assistant")
    edits = landed(edits.unionByName(ends.select("conv_id", "block", F.col("no").cast("long").alias("no"), "edit", role.alias("role"), F.lit("").alias("text"))),
                   "repair-edits")
    if want_turns:
        # the place of a turn: those of earlier blocks, then its own
        kept = edits.filter("edit <> 'D'")
        before = kept.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
        before = before.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                               (F.sum("n").over(_window("conv_id").orderBy("block")) - F.col("n")).alias("before"))
        kept = kept.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
        return kept.select("conv_id", (F.col("before") + F.row_number().over(_window("conv_id", "block").orderBy("no")) - 1).cast("long").alias("position"),
                           "edit", "role", "text")
    ddl = "conv_id long, audit string, repaired_sha256 string"
    digests = edits.repartition("conv_id").sortWithinPartitions("conv_id", "block", "no").mapInArrow(_digested(_schema(ddl)), ddl)
    told = F.col("turn").cast("decimal(38,0)")
    counts = flagged.groupBy("conv_id").agg(
        F.coalesce(F.max(told) - F.min(told) + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    totals = chosen.filter("block IS NULL").select(F.col("conv_id").alias("c"), "cost", "illegal")
    digests = digests.withColumnRenamed("conv_id", "g")
    known = counts.join(totals, F.col("conv_id").eqNullSafe(F.col("c"))).join(digests, F.col("conv_id").eqNullSafe(F.col("g")), "left").select(
        "conv_id", F.least("gaps", F.lit(2**63 - 1)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    # a long conversation of which every row was dropped
    all_gone = rows.groupBy("conv_id").agg(F.bool_and("gone").alias("gone")).filter("gone")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.unionByName(all_gone.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256")))


def _window(*keys: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(*keys)
