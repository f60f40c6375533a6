"""Conversation repair, conversation trie and top-k search against brute force and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from contrail.llm import conversation_repair as repair
from contrail.llm import conversation_trie as trie
from contrail.llm import topk_search as topk
from contrail.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


def tally(rows):
    return collections.Counter(tuple(r) for r in rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", sha(text or ""), text or ""))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}


def plain_trie(rows, rebuild=True):
    convs = ordered(rows)
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - c % 20, [])[:h[c]] + convs[c][h[c]:] for c in convs}
    members = collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        worth = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += worth
    return collections.Counter(
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
         sha(",".join(str(c) for c in m if len(convs[c]) == len(k)))) for k, m in members.items())


def branching(seed=3, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        text = [rng.choice(["a b", "a", "", None, "c d e"]) for _ in range(rng.randrange(1, 12))]
        rows += [(c * rng.choice([1, 1, 20]), t, rng.choice(["user", "assistant"]) if t > 2 else "user", x) for t, x in enumerate(text)]
    common = [(t, "user", f"turn {t} of many") for t in range(9)]
    rows += [(c, *x) for c in range(1000, 1060) for x in common]
    rows += [(c, *x) for c in range(1060, 1090) for x in common[:rng.randrange(1, 9)]]
    return rows


def test_trie_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += branching()
    df = spark.createDataFrame(rows, CONV)
    assert tally(trie.prefix_trie(df, rebuild=True).collect()) == plain_trie(rows)


@pytest.mark.parametrize("block,per_task,fan", [(128, 7, 2), (3, 5, 2), (1, 1000, 64), (2, 3, 3)])
def test_trie_over_borders_and_blocks(spark, block, per_task, fan):
    """Partitions of a few rows, forests merged in several rounds, conversations of many blocks."""
    rows = branching(block)
    df = spark.createDataFrame(rows, CONV)
    got = trie.prefix_trie(df, rebuild=block != 2, block=block, per_task=per_task, fan=fan)
    assert tally(got.collect()) == plain_trie(rows, rebuild=block != 2)


def test_trie_of_odd_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONV), rebuild=True).count() == 0
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"),
            (21, 0, "user", "only one turn"), (40, 0, "user", "x " * 20000), (41, 0, "user", "x " * 20000)]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS k", "2 AS chain", "'z' AS digs", "3 AS part")
    assert tally(trie.prefix_trie(df, rebuild=True).collect()) == plain_trie(rows)


def test_heads_of_conversations_below_zero(spark):
    """-1 takes its head from -20, not from 0; the least id has no base."""
    rng = random.Random(8)
    rows = [(c, t, "user", f"{'first' if c == 0 else rng.choice('ab')} turn") for c in range(-60, 45) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", f"far {t}") for c in (-2**63, -2**63 + 7, -2**63 + 8, 2**63 - 1) for t in range(5)]
    assert tally(trie.prefix_trie(spark.createDataFrame(rows, CONV), rebuild=True).collect()) == plain_trie(rows)


def plain_damage(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        convs[c] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2]))) for c, v in convs.items()}


def plain_report(rows):
    """Best (cost, audit) over all edit sequences, as tuples and text."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = {("", 0): (0, "", [])}
    fits = re.compile(r"(s?(ua)*u?)?")

    def inserted(ways):
        for _ in range(3):
            for (state, at), (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    if fits.fullmatch(state + role[0]):
                        add(ways, state + role[0], at, cost + 2, audit + "I", [*lines, role + ":"])

    def add(ways, state, at, cost, audit, lines):
        state = re.sub("(ua)+", "ua", state)  # what may follow depends on no more
        if (state, at) not in ways or (cost, audit) < ways[state, at][:2]:
            ways[state, at] = (cost, audit, lines)

    for i, ((_, role, text), fault) in enumerate(zip(rows, faults)):
        inserted(ways)
        then = {}
        for (state, _), (cost, audit, lines) in ways.items():
            add(then, state, i + 1, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            for edit, name, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if name[:1] and fits.fullmatch(state + name[:1]):
                    add(then, state + name[:1], i + 1, cost + price + (fault == "truncated"), audit + edit, [*lines, f"{name}:{text}"])
        ways = then
    inserted(ways)
    cost, audit, lines = min(w for (state, _), w in ways.items() if re.fullmatch(r"(s?(ua)+)?", state))
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, sha("\n".join(lines)))


def messy(seed=1, convs=150):
    rng = random.Random(seed)
    rows = [(rng.randrange(convs), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "sage", "Ursula", "apt"]),
             rng.choice(["Done.", "so what?\t\n", "cut off", " ", "", None, "\x1f.", "a.\x85", "é!"])) for _ in range(convs * 6)]
    return rows + [(900, i, "user" if i % 2 else "assistant", f"t{i % 40}." if i % 3 else "t") for i in range(90)] + [(None, 3, "user", "x.")]


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("long,chars,block", [(4096, 10**7, 512), (5, 10**7, 4), (4096, 12, 2), (0, 0, 1)])
def test_repair_equals_brute_force(spark, long, chars, block):
    rows = messy()
    df = repair.damaged(spark.createDataFrame(rows, CONV))
    got = repair.repair(df, long=long, chars=chars, block=block)
    want = [(c, *plain_report(v)) for c, v in plain_damage(rows).items()]
    assert tally(got.select(*REPORT).collect()) == tally(want)


@pytest.mark.parametrize("long", [4096, 5])
def test_repaired_turns(spark, long):
    rows = messy(2, 60)
    df = repair.damaged(spark.createDataFrame(rows, CONV))
    report = {r.conv_id: r for r in repair.repair(df, long=long, block=3).collect()}
    lines = collections.defaultdict(dict)
    for r in repair.repair(df, turns=True, long=long, block=3).collect():
        assert r.position not in lines[r.conv_id]
        lines[r.conv_id][r.position] = r
    for c, r in report.items():
        mine = [lines[c][i] for i in range(len(lines[c]))]
        assert sha("\n".join(f"{t.role}:{t.text}" for t in mine)) == r.repaired_sha256
        assert "".join(t.edit for t in mine) == r.audit.replace("D", "")
        assert re.fullmatch(r"(s?(ua)+)?", "".join(t.role[:1] for t in mine))


def test_repair_of_odd_tables(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], CONV))).count() == 0
    rows = [(1, None, None, None), (1, 2**62, "user", "a." * 50000), (1, -2**62, "user", "a." * 50000), (None, None, "user", "x."), (None, 1, "user", "x.")]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS sha", "2 AS gone", "'z' AS fault", "3 AS copy", "4 AS block", "5 AS pos")
    for long in (4096, 0):
        got = repair.repair(repair.damaged(df), long=long).select(*REPORT).collect()
        assert tally(got) == tally((c, *plain_report(v)) for c, v in plain_damage(rows).items())


VEC = "vec_id long, embedding array<float>"


def plain_top(rows, k=5, every=50):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, w) in enumerate(fine):
        if q % every == 0:
            best = sorted((-min(max(sum(x * y for x, y in zip(w, v)), -2**63), 2**63 - 1), i) for b, (i, v) in enumerate(fine) if a != b and len(v) == len(w))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return tally(out)


@pytest.mark.parametrize("cell,block", [(2048, 128), (20, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "STEPS", (1, 3, 8))
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 3 * 50][1]) for i in range(30)]                  # copies: ties by id
    rows += [(1000 + i, (np.array(rows[0][1]) * 40).tolist()) for i in range(3)]  # long vectors
    rows += [(50, rows[7][1]), (100, [0.0] * 12), (2000, [1.0, 2.0]), (2050, [2.0, -1.0]), (2100, []), (2101, []), (2150, [3.0])]
    rows += [(150, None), (200, [None] * 12), (250, [float("nan")] * 12), (300, [float("inf")] * 12), (None, rows[1][1]), (-50, rows[2][1])]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 AS row", "2 AS dim", "3 AS cell", "4 AS v", "5 AS asks")
    got = topk.top_k(df, "vec_id % 50 = 0")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert tally(got.collect()) == plain_top(rows)


def test_top_k_of_huge_components_and_empty_tables(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([3e15, -3e15, 3e15, 2.0, 3e4])]
    got = topk.top_k(spark.createDataFrame(rows, VEC), "vec_id < 2").collect()
    want = plain_top([(50 * i, v) for i, v in rows], every=1)
    assert tally(got) == tally((q // 50, n, i // 50, s) for q, n, i, s in want if q < 100)
    assert topk.top_k(spark.createDataFrame([], VEC), "vec_id % 50 = 0").count() == 0


def test_bound_stops_before_all_is_read():
    """A few vectors that tower over the rest: their lists are left after the first steps."""
    x = np.floor(256 * np.random.default_rng(0).normal(size=(2000, 8)) / 50)
    x[:9] += 500
    cell, read = topk.Cell(list(range(2000)), list(range(2000)), x), []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype.kind == "i":
                read.append(len(at))
            return super().__getitem__(at)

    cell.x = x.view(Counted)
    got = cell.search(-1, np.full(8, 100.0), 5, None)
    assert [s for s, _, _ in got] == sorted((x @ np.full(8, 100.0)).astype(int).tolist(), reverse=True)[:5]
    assert sum(read) < 300
    assert cell.search(-1, np.full(8, 100.0), 5, 10**9) == []


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_conversation_trie", "op13_topk_search"])
def test_registered_queries(spark, name):
    got = QUERIES[name](spark, SF)
    table = "embeddings" if "op13" in name else "conversations"
    rows = [tuple(r)[:4] if table == "conversations" else (r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()]
    want = (tally((c, *plain_report(v)) for c, v in plain_damage(rows).items()) if "op11" in name else plain_trie(rows) if "op12" in name else plain_top(rows))
    if "op11" in name:
        got = got.select(*REPORT)
    assert tally(got.collect()) == want
