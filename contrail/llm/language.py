"""Operator 9: language identification by a linear-chain conditional random field.

Every word of a text gets a label; neighbouring labels are tied by learned
transitions, so short stretches of another language inside a text are told
apart. A word's scores are sums over its affixes, character n-grams and itself
(the lexicon), hashed into a table of fixed size; part of the model is that a
word speaks against a label by FLOOR at most. Forward-backward over the whole
text gives the label probabilities of each word; a text's language is the
label with the largest mean probability.

The field is fitted on the driver with a bounded sample: SAMPLE_DOCS labelled
documents, spread over all languages there are (at most DOCS_PER_LANG of each,
one at least), and WORDS_PER_DOC words of each. Segments of several languages
are strung together so that switches are seen. Predictions run in the tasks
over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import ROWS_AT_ONCE, by_rows, in_arrow

SAMPLE_DOCS = 12_800
DOCS_PER_LANG = 200
WORDS_PER_DOC = 120
TABLE_BITS = 16
STEPS, SEQUENCES, LENGTH = 160, 48, 48
RATE, DECAY = 0.3, 1e-4
FLOOR = -12.0        # a single word counts for no more than this against a language
CHUNK = 64           # words per step of the scan over a text
CACHE_WORDS = 100_000
WORDS_AT_ONCE = 4096
TEXT_AT_ONCE = 1 << 20  # bytes of text that are labelled together (one text at least)
UNKNOWN = "und"
LEAST = 0.4          # mean probability of the language of a document that is kept

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places in the table of many words at once, by kind of feature: (places,
    where each word's begin). Kinds are the word, its first and last 4 and 5
    letters and its 2- and 3-grams, all with marks at both ends."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    c = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(c)) - np.repeat(starts, lengths)
    each = np.arange(len(words))

    def places(kind: int, value: np.ndarray) -> np.ndarray:
        mixed = (value + np.uint64(kind)) * odd
        return (((mixed >> np.uint64(29)) ^ mixed) * odd >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    base = np.uint64(0x100000001B3)
    powers = np.cumprod(np.full(int(lengths.max()), base))
    out = [(places(1, np.add.reduceat(c * powers[at], starts)), each)]
    for kind, n in ((2, 4), (3, 5)):
        head = tail = np.zeros(len(words), np.uint64)
        for i in range(n):
            there = i < lengths
            head = head + np.where(there, c[starts + np.minimum(i, lengths - 1)] * powers[min(i, len(powers) - 1)], np.uint64(0))
            tail = tail + np.where(there, c[starts + np.maximum(lengths - 1 - i, 0)] * powers[min(i, len(powers) - 1)], np.uint64(0))
        out += [(places(kind, head), each), (places(kind + 2, tail), each)]
    for kind, n in ((6, 2), (7, 3)):
        gram = sum(c[i:len(c) - n + 1 + i] * powers[i] for i in range(n))
        inside = (at + n <= np.repeat(lengths, lengths))[:len(gram)]
        out.append((places(kind, gram[inside]), np.cumsum(lengths - n + 1) - (lengths - n + 1)))
    return out


def _normalised(x: np.ndarray, axis) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def marginals(scores: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of several texts, by forward-backward.

    ``scores`` (words, labels) holds the texts one after the other. Texts are
    cut into chunks of CHUNK words; the products of step matrices within
    chunks are taken for all chunks at once, then carried along each text, then
    spread inside the chunks again. That is exact, for texts of any length.
    """
    k = scores.shape[1]
    emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), FLOOR))
    step = np.exp(transition - transition.max())
    n_chunks = -(-lengths // CHUNK)
    first = np.concatenate([[0], np.cumsum(n_chunks)[:-1]])
    total = int(n_chunks.sum())
    place = np.repeat(first * CHUNK - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(scores))
    padded = np.ones((total * CHUNK, k))
    real = np.zeros(total * CHUNK, bool)
    padded[place], real[place] = emit, True
    padded, real = padded.reshape(total, CHUNK, k), real.reshape(total, CHUNK)
    text = np.repeat(np.arange(len(lengths)), n_chunks)
    starts = np.zeros(total, bool)
    starts[first[n_chunks > 0]] = True

    # product over each chunk: from the label before it to its last label
    prod = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(CHUNK):
        nxt = (prod.reshape(-1, k) @ step).reshape(total, k, k) * padded[:, t, None, :]
        if t % 8 == 7:  # no word scales by less than exp(FLOOR)
            nxt /= nxt.max(axis=(1, 2), keepdims=True)
        prod = np.where(real[:, t, None, None], nxt, prod)

    # carried along the texts, all texts side by side
    into = np.ones((total, k))   # forward vector before a chunk
    after = np.ones((total, k))  # backward vector behind it
    order = np.arange(total) - first[text]
    by_order = [np.flatnonzero(order == o) for o in range(int(n_chunks.max(initial=0)))]
    for now, nxt in zip(by_order, by_order[1:]):
        before = nxt - 1
        into[nxt] = _normalised(np.einsum("nk,nkl->nl", into[before], prod[before]), 1)
    for nxt in reversed(by_order[1:]):
        after[nxt - 1] = _normalised(np.einsum("nkl,nl->nk", prod[nxt], after[nxt]), 1)

    fwd = np.empty((total, CHUNK, k))
    a = into
    for t in range(CHUNK):
        new = a @ step * padded[:, t]
        if t == 0:
            new = np.where(starts[:, None], padded[:, 0], new)
        a = np.where(real[:, t, None], _normalised(new, 1), a)
        fwd[:, t] = a
    b = after
    for t in reversed(range(CHUNK)):
        fwd[:, t] *= b
        b = np.where(real[:, t, None], _normalised((padded[:, t] * b) @ step.T, 1), b)
    return _normalised(fwd.reshape(-1, k)[place], 1)


def likelihood(scores: np.ndarray, transition: np.ndarray, gold: np.ndarray) -> float:
    """Log likelihood of the labels ``gold`` of sequences of equal length."""
    emit = np.maximum(scores - scores.max(axis=2, keepdims=True), FLOOR)
    rows = np.arange(len(gold))
    a = np.log(np.full(emit[:, 0].shape, 1.0)) + emit[:, 0]
    right = emit[rows, 0, gold[:, 0]].sum()
    for t in range(1, scores.shape[1]):
        a = np.logaddexp.reduce(a[:, :, None] + transition[None], axis=1) + emit[:, t]
        right += (emit[rows, t, gold[:, t]] + transition[gold[:, t - 1], gold[:, t]]).sum()
    return float(right - np.logaddexp.reduce(a, axis=1).sum())


def gradient(scores: np.ndarray, transition: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``likelihood``, by the scores and by the transitions: what is observed
    less what the field expects, words and pairs by forward-backward."""
    n, length, k = scores.shape
    raw = scores - scores.max(axis=2, keepdims=True)
    emit, step = np.exp(np.maximum(raw, FLOOR)), np.exp(transition - transition.max())
    fwd, bwd = np.empty_like(emit), np.ones_like(emit)
    fwd[:, 0] = _normalised(emit[:, 0], 1)
    for t in range(1, length):
        fwd[:, t] = _normalised(fwd[:, t - 1] @ step * emit[:, t], 1)
    for t in range(length - 2, -1, -1):
        bwd[:, t] = _normalised((emit[:, t + 1] * bwd[:, t + 1]) @ step.T, 1)
    want = np.eye(k)[gold]
    by_score = want - _normalised(fwd * bwd, 2)
    by_score[raw < FLOOR] = 0.0  # held at the floor, whatever the score
    top = scores.argmax(axis=2)[:, :, None]
    np.put_along_axis(by_score, top, 0.0, axis=2)
    np.put_along_axis(by_score, top, -by_score.sum(axis=2, keepdims=True), axis=2)  # scores count against the best one
    pair = fwd[:, :-1, :, None] * step * (emit * bwd)[:, 1:, None, :]
    expected = _normalised(pair, (2, 3)).sum(axis=(0, 1))
    return by_score, np.einsum("stk,stl->kl", want[:, :-1], want[:, 1:]) - expected


class Field:
    """Labels, feature table and transitions of a fitted field."""

    def __init__(self, labels: list[str], table: np.ndarray, transition: np.ndarray):
        self.labels, self.table, self.transition = labels, table, transition

    @classmethod
    def fit(cls, samples: dict[str, list[list[str]]], seed: int = 0) -> Field:
        """Stochastic gradient on the log likelihood of strung-together segments."""
        labels = sorted(x for x in samples if samples[x])
        k, rng = len(labels), np.random.default_rng(seed)
        vocabulary: dict[str, int] = {}
        texts = [[np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t]) for t in samples[x]] for x in labels]
        whole, transition = np.zeros((1 << TABLE_BITS, k), np.float32), np.eye(k)
        if k < 2:
            return cls(labels, whole, transition)
        names, parts = list(vocabulary), []
        for at in range(0, len(names), WORDS_AT_ONCE):
            for p, begin in features(names[at:at + WORDS_AT_ONCE]):
                parts.append((p.astype(np.int32), np.repeat(np.arange(at, at + len(begin), dtype=np.int32), np.diff(np.append(begin, len(p))))))
        places, owner = (np.concatenate(x) for x in zip(*parts))
        by_word = np.argsort(owner, kind="stable")
        places, owner = places[by_word], owner[by_word]
        used, flat = np.unique(places, return_inverse=True)  # rows of the table that the sample has
        bounds = np.searchsorted(owner, np.arange(len(vocabulary)))
        by_place = np.argsort(flat, kind="stable")
        word_at, place_at = owner[by_place], np.searchsorted(flat[by_place], np.arange(len(used)))
        table = np.zeros((len(used), k))
        squares, t_squares = np.full_like(table, 1e-6), np.full_like(transition, 1e-6)
        for _ in range(STEPS):
            ids, gold = np.empty((SEQUENCES, LENGTH), int), np.empty((SEQUENCES, LENGTH), int)
            for s in range(SEQUENCES):
                at = 0
                while at < LENGTH:
                    y = rng.integers(k)
                    t = texts[y][rng.integers(len(texts[y]))]
                    n = min(int(rng.integers(2, 24)), len(t), LENGTH - at)
                    begin = rng.integers(len(t) - n + 1)
                    ids[s, at:at + n], gold[s, at:at + n] = t[begin:begin + n], y
                    at += n
            scores = np.add.reduceat(table[flat], bounds)
            by_score, t_grad = gradient(scores[ids], transition, gold)
            by_word = np.zeros((len(vocabulary), k))
            np.add.at(by_word, ids.ravel(), by_score.reshape(-1, k))
            grad = np.add.reduceat(by_word[word_at], place_at) / SEQUENCES - DECAY * table
            squares += grad**2
            table += RATE * grad / np.sqrt(squares)
            t_grad = t_grad / SEQUENCES
            t_squares += t_grad**2
            transition += RATE * t_grad / np.sqrt(t_squares)
        whole[used] = table
        return cls(labels, whole, transition)


class Labeller:
    """Applies a field; keeps the scores of words seen so far."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.scores = np.empty((1024, len(field.labels)), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of ``scores`` of each word."""
        if new := [w for w in set(words) if w not in self.known]:
            n, table = len(self.known), self.field.table
            while n + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            for at in range(0, len(new), WORDS_AT_ONCE):
                part = new[at:at + WORDS_AT_ONCE]
                self.scores[n + at:n + at + len(part)] = sum(np.add.reduceat(table[p], begin) for p, begin in features(part))
            self.known.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        lengths = np.array([len(x) for x in words])
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.field.labels or not lengths.sum():
            return names, scores
        ids = self.ids([w for x in words for w in x])
        p = marginals(self.scores[ids].astype(float), self.field.transition, lengths)
        filled = np.flatnonzero(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths[filled])[:-1]])
        mean = np.add.reduceat(p, starts) / lengths[filled, None]
        for i, m in zip(filled, mean):
            names[i], scores[i] = self.field.labels[int(m.argmax())], float(min(1.0, m.max()))
        return names, scores


def held_out(key: Column) -> Column:
    """Rows never learned from: CRC-32 of the key as text divisible by 5, or no key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, key: str, text: str, lang: str) -> dict[str, list[list[str]]]:
    """Words of the sample, by language. Documents are chosen by a hash of
    their key from all labelled ones that are not held out."""
    own = docs.filter(docs[lang].isNotNull() & ~held_out(docs[key]))
    each = max(1, min(DOCS_PER_LANG, SAMPLE_DOCS // max(1, own.select(docs[lang]).distinct().count())))
    order = Window.partitionBy("l").orderBy("h", "k")
    chosen = (own.select(docs[lang].alias("l"), docs[key].alias("k"), F.xxhash64(docs[key].cast("string")).alias("h"))
              .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("k").distinct())
    rows = own.join(F.broadcast(chosen), docs[key] == chosen["k"], "left_semi").select(  # at most SAMPLE_DOCS keys, or one a language
        docs[lang].alias("l"), docs[key].alias("k"), F.substring(docs[text], 1, 40 * WORDS_PER_DOC).alias("t"))
    out: dict[str, list[list[str]]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["l"], r["k"])):
        words = words_of(r["t"] or "")[:WORDS_PER_DOC]
        if words and len(out.setdefault(r["l"], [])) < each:
            out[r["l"]].append(words)
    return out


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             field: Field | None = None) -> DataFrame:
    """``key``, held_out, lang_pred, score for each row of ``docs``.

    lang_pred is a learned language, ``und`` (score 0) for a null text, a text
    without a letter, or when there is nothing to learn from; equal
    probabilities go to the first language in alphabetical order. Rows without
    a key are held out. Repeated rows are kept; other columns are not read; an
    empty table gives an empty one. ``field`` skips the fitting.
    """
    field = field or Field.fit(training_sample(docs, key, text, lang))
    shared = docs.sparkSession.sparkContext.broadcast((field.labels, field.table, field.transition))  # a column for each language
    state: list[Labeller] = []

    def run(cols: dict) -> dict:
        if not state:
            state.append(Labeller(Field(*shared.value)))
        names, scores = state[0].label(cols["text"])
        return {"key": cols["key"], "held_out": cols["held_out"], "lang_pred": names, "score": scores}

    rows = docs.select(docs[key].cast("long").alias("key"), held_out(docs[key]).alias("held_out"), docs[text].alias("text"))
    return by_rows(rows, run, "key long, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
               field: Field | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) that get a language:
    rows with a null text or no letter go, and rows whose language has a mean
    probability below ``least`` (no language holds the text). Where nothing
    could be learned, every row with a letter stays. Nothing is shuffled."""
    field = field or Field.fit(training_sample(docs, key, text, lang))
    shared = docs.sparkSession.sparkContext.broadcast((field.labels, field.table, field.transition))
    learned = bool(field.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        labeller = Labeller(Field(*shared.value))
        for batch in batches:
            at, mean = 0, max(1, batch.column(text).nbytes // max(1, batch.num_rows))
            while at < batch.num_rows:
                part = batch.slice(at, max(1, min(ROWS_AT_ONCE, TEXT_AT_ONCE // mean)))
                at += part.num_rows
                texts = part.column(text).to_pylist()
                if learned:
                    keep = [n != UNKNOWN and s >= least for n, s in zip(*labeller.label(texts))]
                else:
                    keep = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def segments(text: str, labeller: Labeller) -> Iterator[tuple[str, str, float]]:
    """Word, label and probability along one text: the code-switched view."""
    words = words_of(text)
    if words and labeller.field.labels:
        p = marginals(labeller.scores[labeller.ids(words)].astype(float), labeller.field.transition, np.array([len(words)]))
        for w, row in zip(words, p):
            yield w, labeller.field.labels[int(row.argmax())], float(row.max())
