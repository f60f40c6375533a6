"""Copies, passages, vectors and archives: against brute force and odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from contrail.llm import embedding_dedup, ngram_join, suffix_dedup, warc
from contrail.llm.components import components
from contrail.session import shared_dir

DOCS = "doc_id long, text string"


def tally(rows):
    return collections.Counter(tuple(r) for r in rows)


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def planted(seed=5):
    """Documents with copies, chains of near copies, a common line and a hub of variants."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(word() for _ in range(9))
    rows = [(i, line + "\n" + " ".join(word() for _ in range(rng.randrange(8, 120)))) for i in range(150)]
    base = [word() for _ in range(120)]
    for i in range(90):  # one large group of near copies, some too far from the base
        v = list(base)
        for _ in range(rng.randrange(0, 9)):
            v[rng.randrange(len(v))] = word()
        rows.append((1000 + i, " ".join(v)))
    chain = [word() for _ in range(60)]
    for i in range(12):
        rows.append((2000 - i, " ".join(chain[i * 2:i * 2 + 40])))
    rows += [(3000 + i, rows[3][1]) for i in range(20)]
    rows += [(-1, None), (-2, ""), (-3, "a b"), (-4, "A  B"), (-5, "a b c"), (rows[0][0], rows[0][1]), (None, rows[7][1]), (9, rows[8][1])]
    return rows


def shingle_set(t, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    kinds = list({s for s in sets if s})
    at = {s: k for k, s in enumerate(kinds)}
    pairs = [(i, j) for i, a in enumerate(kinds) for j, b in enumerate(kinds[:i]) if 100 * len(a & b) >= 75 * len(a | b)]
    root, low = union_find(len(kinds), pairs), {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            r = root[at[s]]
            low[r] = min(low.get(r, i), i)
    return tally((i, len(s), low.get(root[at[s]]) if s else i) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("block_rows", [128, 8])
def test_jaccard_classes_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    rows = planted()
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", node int")
    assert tally(ngram_join.jaccard_classes(docs).collect()) == brute_classes(rows)


def test_jaccard_classes_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", -1)
    rows = planted(6)
    assert tally(ngram_join.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect()) == brute_classes(rows)


def test_one_document_of_each_group_stays(spark):
    rows = planted()[:-1]  # without a key that has two texts
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", source string")
    kept = ngram_join.without_near_copies(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    want = {i for (i, _, c) in brute_classes(rows) if i is not None and i == c}
    assert sorted(ids) == sorted(want) and not any(r.doc_id is None for r in kept)


def test_overlaps_are_the_matrix_product():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 9000, n)) for n in (5, 4000, 6000, 1, 300)]
    got = ngram_join.overlaps(rows[:3], rows)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in rows] for a in rows[:3]]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 199), (None, 3), (199, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 199: 199, 200: 199}


def brute_passages(rows, k=50):
    where, words = collections.defaultdict(set), []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        words.append((i, w))
        for p in range(len(w) - k + 1):
            where[tuple(w[p:p + k])].add(i)
    out = collections.defaultdict(set)
    for i, w in words:
        for p in range(len(w) - k + 1):
            if len(where[tuple(w[p:p + k])] - {None}) > 1 and i is not None:
                out[i].update(range(p, p + k))
    return out


@pytest.mark.parametrize("broadcast", [1_000_000, -1])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_SUFFIXES", broadcast)
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    parts = [fresh(n) for n in (49, 50, 51, 60, 75, 120, 300)]
    rows = [(10 * j + q, f"{fresh(rng.randrange(80))} {p}\n {fresh(rng.randrange(80))}") for j, p in enumerate(parts) for q in range(4)]
    rows += [(500 + i, fresh(rng.randrange(200))) for i in range(40)] + [(600 + i, parts[6]) for i in range(60)]
    rows += [(-1, None), (-2, ""), (-3, "a b"), rows[0], (None, rows[5][1]), (-7, parts[4] + " z " + parts[4]), (-8, "a " * 500)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", h int")
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs).collect():
        assert r.end_word - r.start_word == r.n_words >= 50 and r.other_doc_id != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == {i: s for i, s in brute_passages(rows).items() if s}


def test_passages_that_reach_left_of_a_common_line(spark):
    """A line of 40 to 49 words in hundreds of documents, too short itself; a few also share the words before it."""
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"y{rng.randrange(10**9)}" for _ in range(n))
    rows = []
    for g, n in enumerate((40, 45, 49)):
        line, before = fresh(n), [fresh(50 - n) for _ in range(8)]
        rows += [(1000 * g + i, f"{fresh(30)} {line} {fresh(30)}") for i in range(300)]
        rows += [(1000 * g + 500 + i, f"{fresh(30)} {before[i % 8]} {line} {fresh(30)}") for i in range(16)]
    rng.shuffle(rows)
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    want = {i: s for i, s in brute_passages(rows).items() if s}
    assert len(want) == 48 and got == want


def test_passages_need_no_borders_of_sorted_partitions(spark, monkeypatch):
    """Nothing is dealt by sampled ranges, which differ from one execution to the next."""
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda *a: pytest.fail("dealt by sampled ranges"))
    rng = random.Random(9)
    text = " ".join(f"z{rng.randrange(10**9)}" for _ in range(55))
    docs = spark.createDataFrame([(i, f"a{i} {text} b{i}") for i in range(40)], DOCS)
    for n in (1, 7):
        got = suffix_dedup.repeated_passages(docs.repartition(n)).collect()
        assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [(i, 1, 56) for i in range(40)]


@pytest.mark.parametrize("every", [2, 9, 65_536])
def test_passages_equal_brute_force_wherever_the_sorted_order_is_cut(spark, monkeypatch, every):
    """Texts glued from a few pieces share prefixes of every length on both sides; cuts fall inside their k-grams."""
    monkeypatch.setattr(suffix_dedup, "RANGE", every)
    rng = random.Random(every)
    pieces = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(25)))) for i in range(250)]
    rows += [(900 + i, f"{pieces[i % 7]} {pieces[0]} {pieces[1]} {pieces[2]} {pieces[i % 11]} {i}") for i in range(80)]
    for least in (2, 7, 12):
        got = collections.defaultdict(set)
        for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS), min_words=least).collect():
            got[r.doc_id].update(range(r.start_word, r.end_word))
        assert got == {i: s for i, s in brute_passages(rows, least).items() if s}


def test_lengths_carried_over_cuts_equal_those_of_one_range():
    rng = np.random.default_rng(4)
    ctx = sorted((int(rng.integers(2)), rng.integers(0, 2, rng.integers(0, 9)).astype(np.uint32).tobytes()) for _ in range(120))
    h, texts = [x for x, _ in ctx], [c for _, c in ctx]

    def shared(i, j):
        n = 0
        for x, y in zip(np.frombuffer(texts[i], np.uint32), np.frombuffer(texts[j], np.uint32)):
            if x != y:
                break
            n += 1
        return n

    borders = [0, 1, 2, 30, 31, 77, 120]
    cols = {c: [0] * 120 for c in ("side", "g", "a", "b")}
    batch = pa.RecordBatch.from_pydict({**cols, "h": h, "ctx": texts, "cut": np.repeat(np.arange(6), np.diff(borders))})
    rows = [r for out in suffix_dedup._neighbours(iter([batch.slice(0, 50), batch.slice(50)])) for r in out.to_pylist()]
    carried = {c: x for c, *x in suffix_dedup._carried([r for r in rows if r["edge"] is not None])}
    for i, r in enumerate(rows):
        got = r["ahead"] | r["back"]
        for lengths, to in zip(carried[r["cut"]], (r["to_first"], r["to_last"])):
            got |= suffix_dedup.clipped(lengths, min(to, 62)) if to >= 0 else 0
        assert got == sum(1 << n for n in {shared(i, j) for j in range(120) if j != i and h[j] == h[i]})


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for label, n in ((1, 300), (2, 40), (3, 1)):
        for _ in range(n):
            rows.append((at, rng.normal(size=16).tolist(), label))
            at += 1
    hub = rng.normal(size=16)
    rows += [(5000 + i, (hub + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(200)]  # about the threshold
    e = rows[0]
    rows += [(-1, None, 1), (-2, [0.0] * 16, 1), (-3, [float("nan")] * 16, 1), (-4, [None] + [1.0] * 15, 1), (-5, e[1], e[2]),
             (-6, e[1], None), (None, e[1], e[2]), (-8, [1.0, 2.0], 1), (-9, [2.0, 4.0], 1), (-10, [], 1), rows[1], (-11, [1e300, -1e300], 1)]
    vectors = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    got = embedding_dedup.deduplicate(vectors).collect()
    own = [r for r in rows if r[0] is not None]
    units = [embedding_dedup.unit(r[1]) if r[2] is not None else None for r in own]
    pairs = [(i, j) for i, a in enumerate(units) for j, b in enumerate(units[:i])
             if a and b and len(a) == len(b) and own[i][2] == own[j][2] and np.dot(a, b) >= 0.98]
    root, degree, low = union_find(len(own), pairs), collections.Counter(x for p in pairs for x in p), {}
    for i, r in enumerate(own):
        low[root[i]] = min(low.get(root[i], r[0]), r[0])
    truth = sum(degree.values())
    found = {r.vec_id: r for r in got if r.vec_id is not None}
    assert sum(r.n_links for r in got) >= 0.9 * truth and len(got) == len(rows)
    for i, r in enumerate(own):
        assert found[r[0]].n_links <= degree[i] and found[r[0]].component_id >= low[root[i]]
    classes = embedding_dedup.classes(vectors, "vec_id", "embedding", "label")
    report = embedding_dedup.audit(classes, embedding_dedup.near_links(classes)[1], sample=10**4).first()
    linked = sum(degree[i] for i, r in enumerate(own) if units[i] and r[0] == min(own[j][0] for j, u in enumerate(units) if u == units[i] and own[j][2] == r[2]))
    assert report.sampled == classes.count() and 0.9 * report.links_there <= report.links_found <= report.links_there <= linked
    assert report.links_there > 0 and report.recall == report.links_found / report.links_there


def test_cells_that_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_MOST", 60)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        c = rng.normal(size=8)
        rows += [(g * 20 + i, (c + rng.normal(size=8) * 0.01).tolist(), 1) for i in range(10)]
    got = embedding_dedup.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 40 * 90
    assert sum(r.kept for r in got) <= 44


def test_a_cloud_larger_than_its_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_MOST", 150)
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    rng = np.random.default_rng(7)
    hub = rng.normal(size=16)
    v = np.concatenate([hub + rng.normal(size=(900, 16)) * 0.07 * np.linalg.norm(hub) / 4, rng.normal(size=(300, 16))])
    docs = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    truth = int(((u @ u.T) >= 0.98).sum()) - len(u)
    assert truth > 400_000
    got = embedding_dedup.deduplicate(docs).collect()
    degree = ((u @ u.T) >= 0.98).sum(axis=1) - 1
    assert sum(r.n_links for r in got) >= 0.99 * truth and all(r.n_links <= degree[r.vec_id] for r in got)


def test_links_of_a_cloud_are_not_its_pairs(spark):
    rng = np.random.default_rng(11)
    v = np.ones(16) + rng.normal(size=(2000, 16)) * 0.01
    docs = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    links, degrees = embedding_dedup.near_links(embedding_dedup.landed(embedding_dedup.classes(docs, "vec_id", "embedding", "label"), "t"))
    assert links.count() < 10 * len(v)
    assert [tuple(r) for r in degrees.groupBy("degree").count().collect()] == [(1999, 2000)]
    assert components(links).filter("component = 0").count() == 2000


PAGES = [(1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, None, "x" * 99), (4, "http://a/4", "x" * 99), (5, "u\r\nv", None),
         (None, "http://a/6", "x" * 100), (7, "http://a/7", "é" * 60 + "\r\n\r\n"), (8, "http://a/8", "é" * 60 + "\r\n\r\n"),
         (9, "http://a/9", ""), (2, "http://a/2", "x" * 100), (10, "http://a/10", "y" * 300_000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h in PAGES:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in PAGES:
        raw, f = (h or "").encode(), first.get(h)
        revisit = f is not None and f != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    assert tally(warc.round_trip(pages, shared_dir(spark, "warc-test")).collect()) == tally(want)


def test_selected_records_by_byte_ranges(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    root = shared_dir(spark, "warc-test")
    index = warc.write_archives(pages, root)
    some = index.filter("page_id in (1, 5, 10)")
    got = {r.page_id: bytes(r.payload) for r in warc.read_records(some, root).collect()}
    assert got == {1: b"x" * 100, 5: b"", 10: b"y" * 300_000}
    row = index.filter("page_id = 10").first()
    assert row.payload_bytes == 300_000 and row.url == "http://a/10" and row.digest == hashlib.sha256(b"y" * 300_000).hexdigest()


def test_reads_are_coalesced():
    row = lambda a, o, n: {"archive": a, "offset": o, "length": n}
    far = 10 * warc.READ_GAP
    rows = [row("a", 0, 10), row("a", 10, 10), row("a", 20 + far, 5), row("b", 25 + far, 5)]
    assert [len(r) for r in warc.coalesced(rows)] == [2, 1, 1]


@pytest.mark.parametrize("apply", [ngram_join.jaccard_classes, ngram_join.without_near_copies, suffix_dedup.repeated_passages])
def test_empty_documents(spark, apply):
    assert apply(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_vectors_and_pages(spark):
    assert embedding_dedup.deduplicate(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages, shared_dir(spark, "warc-test")).count() == 0


def test_near_copies_by_row_not_by_key(spark):
    """Different texts under one key stay, near copies without a key go."""
    long = [f"word{i}" for i in range(60)]
    near = " ".join([*long[:59], "other"])
    rows = [(1, " ".join(long)), (1, "another text of its own under the same key"), (1, " ".join(long)), (None, near), (None, None), (None, ""), (2, None),
            (None, "nobody has this text but me and it has no key"), (3, "nobody has this text but me and it has no key")]
    got = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _row", "2 AS _key", "3 AS component_id"))
    assert got.columns == ["doc_id", "text", "_row", "_key", "component_id"]
    assert tally((r[0], r[1]) for r in got.collect()) == tally(
        [(1, " ".join(long)), (1, rows[1][1]), (None, None), (None, ""), (2, None), (3, rows[8][1])])
