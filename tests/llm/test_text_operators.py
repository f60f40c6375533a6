"""Tokens, personal data, quality, language, mixing: against the libraries,
brute force, planted cases and odd rows."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contrail.llm import byte_bpe, language, mixing, pii, quality, token_counts

ODD = [(-1, None), (-2, ""), (-3, "a<|endoftext|>b  <|endoftext|>"), (-4, "x" * 700 + "  　 \x1c\x85 don't  I'LL \U0001f600 é\n\n\n  "),
       (-5, "é" * 300 + "1234567890" * 30 + "-" * 200), (-6, "�​\u0000ab"), (-6, "�​\u0000ab"),
       (None, "no key"), (-7, "odd marks ")]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in some[:60]] + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], DOCS + ", n_tokens string, text_ int")


def tally(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_token_counts_equal_the_library(docs, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    got = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert tally(got) == tally(want)


def test_bpe_equals_the_library_and_decodes(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    want = [(i, tuple(lib.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts]
    assert tally((r[0], tuple(r[1]), bytes(r[2])) for r in got) == tally(want)


@pytest.mark.parametrize("frequent,slice_bytes,long_bytes", [(0, 16 << 20, 512), (50, 300, 40), (10**6, 1, 1)])
def test_bpe_does_not_depend_on_frequent_words_and_slices(docs, monkeypatch, frequent, slice_bytes, long_bytes):
    """No word known beforehand, slices of a few rows, long words merged from a heap."""
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(byte_bpe, "LONG_BYTES", long_bytes)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    coded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN, frequent=frequent)
    got = coded.collect()
    again = byte_bpe.decode(coded.drop("decoded"), byte_bpe.read_ranks(path)).collect()
    assert tally((r[0], tuple(r[1]), bytes(r[2])) for r in again) == tally((r[0], tuple(r[1]), bytes(r[2])) for r in got)
    assert tally((r[0], tuple(r[1]), bytes(r[2])) for r in got) == tally((r[0], tuple(r[1]), bytes(r[2])) for r in plain)


def test_bpe_of_a_very_long_word_and_text_keys(spark):
    """One word of 200,000 letters; keys that are no numbers."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = __import__("random").Random(1)
    rows = [("a", "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))), ("b", "x" * 3000 + " y"), (None, None)]
    got = byte_bpe.encode_documents(spark.createDataFrame(rows, "doc_id string, text string"), path, public_tokenizers.PATTERN).collect()
    assert {r[0]: (list(r[1]), bytes(r[2])) for r in got} == {i: (lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}


def test_bpe_ranks_are_not_written_out_in_plans(docs, capsys):
    """The driver keeps descriptions of plans; nor is the rank map a column of the rows, copied for each."""
    coded = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    capsys.readouterr()
    coded.explain()
    plan = capsys.readouterr().out
    assert "Subquery" in plan and len(plan) < 100_000 and "bpe_known" not in plan


def test_bpe_words_reach_the_fold_as_byte_pieces(docs, capsys):
    """One array per slice, written by numpy; no expression per byte takes words apart."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe.ByteBpe(docs.sparkSession, ranks, public_tokenizers.PATTERN)
    for words in (["the", "", "é\u0000z", "x"], ["", "ab"], ["ab", ""], ["", ""], []):
        want = []
        for w in map(str.encode, words):
            after = [ranks.get(w[i:i + 2], byte_bpe.NO_RANK) if i + 1 < len(w) else byte_bpe.NO_RANK for i in range(len(w))]
            want.append([(r << 2 * byte_bpe.ID_BITS) + (i << byte_bpe.ID_BITS) + ranks[w[i:i + 1]] for i, r in enumerate(after)])
        given = byte_bpe.pa.array(words, byte_bpe.pa.string())
        assert byte_bpe.byte_pieces(given, bpe.letters).to_pylist() == want
        assert byte_bpe.byte_pieces(given[1:], bpe.letters).to_pylist() == want[1:]
    capsys.readouterr()
    byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).explain()
    assert "ascii(" not in capsys.readouterr().out


def test_two_place_table_finds_every_entry():
    entries = {(i * 7919) << byte_bpe.ID_BITS | i: i for i in range(5000)}
    table, p, q = byte_bpe.two_place_table(entries)
    for k, v in entries.items():
        assert k << byte_bpe.ID_BITS | v in (table[k % p], table[p + k % q])


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 13 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = [
    (-11, "+" * 50 + "1 (222) 333-4444 a@b.c.d_x@y.com é\U0001f600 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 0000001.2.3.4"),
    (-12, "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 5000 + " +12--34..5(6)7 8 9 0a 4111111111111111"),
    (-13, "a." * 3000 + "@x" + ".b" * 5000), (None, "mail me a@b.de"), (-14, "call 555"), (-14, "call 555"),
]
CONTEXT = [(-100 - i, f"Please call my mobile on +1 (212) 555-01{i:02d} thanks.") for i in range(8)] + [
    (-200 - i, f"He said call my mobile on 0171 555 01{i:02d} thanks, and the year {1990 + i} was fine.") for i in range(3)]


def test_personal_data_base_and_learned(spark, texts):
    rows = texts + PII_TEXTS + CONTEXT
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", base string")
    got = pii.find_spans(docs).collect()
    want = tally((i, hashlib.sha256((t or "").encode()).hexdigest(), tuple(base_spans(t))) for i, t in rows)
    assert tally((r.doc_id, r.digest, tuple((x.kind, x.s, x.e) for x in r.base)) for r in got) == want
    more = {r.doc_id: [(x.kind, x.t) for x in r.spans if x not in r.base] for r in got if r.spans != r.base}
    assert more == {-200 - i: [("phone", f"0171 555 01{i:02d}")] for i in range(3)}


def test_personal_data_only_after_the_learned_words(spark):
    """A number learned after "mobile on" is no personal data after other words."""
    rows = CONTEXT + [(-300, "call my mobile on 0171 555 0100 or quote part 0171 555 0100 to us")]
    got = {r.doc_id: [(x.kind, x.s) for x in r.spans] for r in pii.find_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[-300] == [("phone", 18)] and got[-200] == [("phone", 26)]


def test_personal_data_in_very_long_runs(spark):
    """Runs of one kind of character take time in proportion to their length."""
    n = 300_000
    rows = [(1, "a" * n), (2, "1" * n), (3, "/" * n), (4, "(" * n), (5, "/a" * n), (6, "%" * n + "@x." + "y" * n), (7, "a@" * n), (8, "1." * n)]
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.base] for r in pii.find_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[6] == [("email", 0, 2 * n + 3)] and not any(got[i] for i in (1, 2, 3, 4, 5, 7))
    assert got[8][:2] == [("ip", 0, 7), ("ip", 8, 15)] and len(got[8]) == n // 4


def brute_learned(edges):
    """The rounds of scoring over plain sets and sums."""
    meets = collections.Counter(p for p, _, _ in edges)
    seeds = {(k, t): 1.0 for _, t, k in edges if k}
    known, new, good = dict(seeds), {}, {}
    for _ in range(pii.ROUNDS):
        sums = collections.defaultdict(list)
        for p, t, _ in edges:
            for (k, u), w in known.items():
                if u == t:
                    sums[p, k].append(w)
        good = {x: sum(w) / (meets[x[0]] + pii.PRIOR) for x, w in sums.items() if len(w) >= pii.SEEDS}
        good = {x: c for x, c in good.items() if c > 0.1}
        doubt = collections.defaultdict(lambda: 1.0)
        for p, t, kind in edges:
            for (q, k), c in good.items():
                if p == q and kind is None:
                    doubt[k, t] *= 1 - min(c, 0.999999)
        new = {x: 1 - d for x, d in doubt.items() if 1 - d >= pii.CONFIDENT}
        known = list(seeds.items()) + list(new.items())
        known = dict(known)
    return {(k, t, p): new[k, t] for p, t, kind in edges if kind is None for k in pii.KINDS if (k, t) in new and (p, k) in good}


def test_learned_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    edges = {(f"p{rng.integers(6)}", f"{k or 'x'}{rng.integers(25)}", k) for k in (None, "email", "phone") for _ in range(60)}
    edges |= {("near phone", f"phone{i}", "phone") for i in range(25)} | {("near phone", f"x{i}", None) for i in range(3)}
    edges = sorted(edges, key=str)
    got = {(r.kind, r.t, r.pattern): r.confidence for r in pii.learned(spark.createDataFrame(edges, "pattern string, t string, kind string")).collect()}
    want = brute_learned(edges)
    assert want and got.keys() == want.keys() and all(abs(got[x] - c) < 1e-9 for x, c in want.items())


def test_redaction_keeps_everything_else(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de, +49 170 1234567!", "k"), (2, None, None), (2, "plain", "p")], DOCS + ", t string")
    assert tally(pii.redacted(docs).collect()) == tally([(1, "mail <EMAIL>, <PHONE>!", "k"), (2, None, None), (2, "plain", "p")])


def brute_quality(t):
    words = re.findall("[^\x20\x09-\x0d]+", t or "")
    n = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if n[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit))


def test_quality_counts_and_fences(spark, texts):
    rows = texts + [(-21, "a b c a b c a b"), (-22, "x\n\n x\nx\n y\n y"), (-23, "a b c")]
    good = [(i, " ".join(f"word{i}{j}" for j in range(80)), "en", f"s{i % 2}") for i in range(1000, 1500)]
    bad = [(2000, " ".join(f"#$%&|<>*{j}" for j in range(80)), "en", "s0"), (2001, "again and " * 60, "en", "s0")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows] + good + bad, DOCS + ", lang string, source string")
    got = {r.key: r for r in quality.judge(docs).collect() if r.key is not None}
    for i, t in rows:
        if i is not None:
            assert tuple(got[i][c] for c in quality.COUNTS) == brute_quality(t), i
            n, _, _, _, rep = brute_quality(t)
            assert got[i].base_failed == (n < 50 or 100 * rep > 50 * n)
    assert all(got[i].kept for i, *_ in good)
    assert not got[2000].kept and not got[2000].base_failed and "symbols_per_word_high" in got[2000].broken_fences
    assert got[2001].base_failed and not got[2001].kept


def test_quality_fences_of_shares_can_be_broken(spark):
    """19 of 40 lines are repeated ones: too many in a clean source, and in one full of repeats."""
    line = lambda i, j: " ".join(f"w{5000 + i}x{j + 10}y{k}" for k in range(4))
    lines = lambda i, n: "\n".join(line(i, j) + ("\nw12345x00y0" if j < n else "") for j in range(20))
    good = [(i, lines(i, 0), "en", "clean") for i in range(600)]
    dirty = [(1000 + i, lines(1000 + i, i % 20), "en", "dirty") for i in range(240)]
    bad = [(2000, lines(2000, 20), "en", "clean"), (2001, lines(2001, 20), "en", "dirty")]
    got = {r.key: r for r in quality.judge(spark.createDataFrame(good + dirty + bad, DOCS + ", lang string, source string")).collect()}
    assert all(got[i].kept for i in range(600))
    for i in (2000, 2001):
        assert not got[i].base_failed and list(got[i].broken_fences) == ["dup_line_share_high"]


def brute_kept(rows, least_docs):
    """Verdicts from sorted lists of bucketed ratios."""
    ratios = {}
    for i, t, *group in rows:
        n, chars, symbols, dup, rep = brute_quality(t)
        if n:
            lines = sum(1 for x in t.split("\n") if x.split())
            ratios[i] = dict(mean_word_chars=chars / n, symbols_per_word=symbols / n, dup_line_share=dup / lines, repeat_word_share=rep / n)
    levels = [lambda g: tuple(g), lambda g: g[0], lambda g: None]
    members = [collections.defaultdict(list) for _ in levels]
    for i, _, *g in rows:
        if i in ratios:
            for level, m in zip(levels, members):
                m[level(g)].append(ratios[i])

    def fence(docs, r, side, least):
        b = sorted(-1e9 if x[r] < quality.LEAST else math.ceil(math.log(x[r]) / math.log(quality.GROWTH)) for x in docs)
        low, high = (0.0 if x == -1e9 else quality.GROWTH ** x * 2 / (quality.GROWTH + 1) for x in (b[-(-len(b) // 4) - 1], b[-(-3 * len(b) // 4) - 1]))
        reach = max(quality.REACH * (high - low), least)
        return high + (1 - high) * reach / (1 + reach) if r in quality.SHARES else high + reach if side == "high" else low - reach

    out = {}
    for i, t, *g in rows:
        n, _, _, _, rep = brute_quality(t)
        out[i] = n >= 50 and 100 * rep <= 50 * n
        for r, side, least in quality.RATIOS:
            if i in ratios:
                large = [m[f(g)] for f, m in zip(levels, members) if f(g) is None or len(m[f(g)]) >= least_docs]
                own = [fence(x, r, side, least) for x in large]
                at = min(own) if r in quality.SHARES else own[0]
                out[i] &= ratios[i][r] <= at if side == "high" else ratios[i][r] >= at
    return out


def test_quality_verdicts_equal_brute_force(spark):
    """Groups large and small, null ones too; the same whatever the partitions are."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(900):
        lang, source = [("en", "a"), ("en", "b"), ("de", "a"), (None, "a"), ("fr", None)][min(int(rng.exponential(1.2)), 4)]
        words = [("x" * rng.integers(1, 4 + 30 * (i % 40 == 0))) + str(rng.integers(10**6)) + "#" * int(i % 15 == 0 and rng.integers(2)) for _ in range(rng.integers(40, 120))]
        text = "\n".join(" ".join(words[j:j + 6]) for j in range(0, len(words), 6))
        rows.append((i, text + ("\n" + text[:rng.integers(len(text))]) * int(i % 7 == 0), lang, source))
    rows += [(901, None, None, None), (902, "", "en", "a"), (903, " ", "it", "z")]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, source string")
    want = brute_kept(rows, 100)
    assert 20 < sum(not k for i, k in want.items() if brute_quality(rows[i][1] if i < 900 else "")[0] >= 50) < 300
    for n in (1, 5):
        assert {r.key: r.kept for r in quality.judge(docs.repartition(n), group_docs=100).collect()} == want


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(1)
    lengths, k = np.array([1, 0, 5, 200, 64, 65, 128]), 3
    scores, tr = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k))

    def lse(x, a):
        m = x.max(axis=a, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=a, keepdims=True))).squeeze(a)

    want, at = [], 0
    for n in lengths:
        s = scores[at:at + n]
        at += n
        if n:
            a, b = [s[0]], [np.zeros(k)]
            for t in range(1, n):
                a.append(s[t] + lse(a[-1][:, None] + tr, 0))
            for t in range(n - 1, 0, -1):
                b.append(lse(tr + (s[t] + b[-1])[None], 1))
            g = np.array(a) + np.array(b[::-1])
            want.append(np.exp(g - lse(g, 1)[:, None]))
    assert np.allclose(np.concatenate(want), language.marginals(scores, tr, lengths))


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 !?", None), (None, "the and of with", "en")], DOCS + ", lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit("clash"))
    field = language.Field.fit(language.training_sample(both, "doc_id", "text", "lang"))
    got = {r.doc_id: r for r in language.identify(both, field=field).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert got[None].held_out
    kept = language.identified(both, field=field)
    assert kept.columns == both.columns and kept.count() == both.count() - 3
    mixed = docs.filter("lang = 'de'").first().text[:200] + " " + docs.filter("lang = 'fr'").first().text[:200]
    labels = [x[1] for x in language.segments(mixed, language.Labeller(field))]
    assert labels[:10].count("de") >= 9 and labels[-10:].count("fr") >= 9  # code-switched text


def test_language_without_anything_to_learn(spark):
    """No label is learned: nobody is named, and no text with a letter is lost."""
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None), (3, "12 !", None)], DOCS + ", lang string")
    assert sorted(tuple(r)[2:] for r in language.identify(docs).collect()) == [("und", 0.0)] * 3
    assert [r.doc_id for r in language.identified(docs).collect()] == [1]


def test_every_language_is_learned(spark):
    words = {f"l{n:02}": [f"{a}{b}x{n}".translate(str.maketrans("0123456789", "qwertzuiop")) for a in "abcde" for b in "klmno"] for n in range(70)}
    rows = [(n * 100 + i, " ".join(w[(i + j) % 25] for j in range(30)), lang) for n, (lang, w) in enumerate(words.items()) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    sample = language.training_sample(docs, "doc_id", "text", "lang")
    learnable = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert len(learnable) == 70 and set(sample) == learnable


def test_gradient_of_the_field():
    """Against differences of the log likelihood, with scores beyond the floor."""
    rng = np.random.default_rng(2)
    n, length, k = 3, 7, 4
    scores, transition, gold = rng.normal(size=(n, length, k)) * 4, rng.normal(size=(k, k)), rng.integers(k, size=(n, length))
    scores[0, 2, 1] -= 40
    by_score, by_pair = language.gradient(scores, transition, gold)
    for grad, at in ((by_score, scores), (by_pair, transition)):
        for i in np.ndindex(at.shape):
            old, e = at[i], 1e-5
            at[i] = old + e
            up = language.likelihood(scores, transition, gold)
            at[i] = old - e
            down = language.likelihood(scores, transition, gold)
            at[i] = old
            assert abs((up - down) / (2 * e) - grad[i]) < 1e-5, (i, (up - down) / (2 * e), grad[i])


def test_mixing_meets_the_targets_and_keeps_rows(spark):
    rows = [(i, "x" * 100, "a" if i % 3 else "b", i) for i in range(6000)] + [(None, None, None, 0), (7, "x" * 100, "a", 7)]
    docs = spark.createDataFrame(rows, DOCS + ", source string, mix_copy int")
    got = mixing.replicated(docs, weights={"a": 1.0, "b": 3.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["a"] / 1500 - 1) < 0.1 and abs(n["b"] / 4500 - 1) < 0.1
    assert mixing.mixed(docs, weights={"a": 1.0, "b": 3.0}).count() == sum(n.values())
    many = mixing.replicated(docs.filter("source = 'b'"), weights={"b": 1.0}).count()
    assert abs(many / 2000 - 1) < 0.1


def test_mixing_large_means(spark):
    docs = spark.createDataFrame([(i, "x" if i < 50 else "y" * 4000, "a" if i < 50 else "b") for i in range(100)], DOCS + ", source string")
    got = mixing.replicated(docs, weights={"a": 1.0, "b": 99.0}).groupBy("source", "doc_id").count().groupBy("source").agg(F.avg("count")).collect()
    mean = {r[0]: r[1] for r in got}
    assert abs(mean["a"] / 40.01 - 1) < 0.1  # a sum of three draws


@pytest.mark.parametrize("apply", [
    lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    lambda d: byte_bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    pii.find_spans, pii.redacted, quality.judge, language.identify, language.identified, mixing.mixed])
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], DOCS + ", lang string, source string")).count() == 0
