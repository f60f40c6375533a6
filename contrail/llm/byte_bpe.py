"""Operator 2: byte-level BPE encoding and decoding.

Words (matches of the tokenizer's split pattern) are arrays of byte pieces,
each held as its identifier, which is its rank (written by numpy for the words
of a slice at a time). A Spark fold over such an array
merges the adjacent pair of lowest rank, leftmost first, as often as the word
has bytes. The rank map is an array in which a pair of identifiers is at one of
two places (Spark would search a map value from its start). It is a scalar
subquery on a table of one row: as a literal it would be written out, megabytes
of text, in each description of a plan, and the driver keeps those.

Only distinct words are folded. The most frequent ones of all texts (at most
FREQUENT_WORDS, counted in one aggregated pass) are folded once and sent to
every task; of the others, a task folds each distinct one once for a slice of
about SLICE_BYTES of text, and puts the identifiers back in the order of the
words. No text is shuffled, and results do not depend on which words are
frequent. A word of more than LONG_BYTES (a blob, a script without spaces)
would take as many passes as it has bytes; it is merged with a heap of pairs
instead. Decoding joins the binary pieces of the identifiers.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.common import in_arrow, landed

ID_BITS = 20            # identifiers, and the places of bytes in a word that is folded, are below 2 ** ID_BITS
_ID = (1 << ID_BITS) - 1
NO_RANK = 1 << ID_BITS  # above every rank
#: Distinct words sent to every task: at most this many, each of at most so many characters.
FREQUENT_WORDS = 524_288
FREQUENT_CHARS = 32
#: A slice looks its words up in a table of the frequent ones that is made anew for it.
SLICE_BYTES = 1 << 21
LONG_BYTES = 512
STEPS_PER_DOUBLING = 8  # classes of word counts, for the choice of the frequent ones


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file on the driver: base64 piece and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of every pair of pieces whose bytes together are a piece, by the
    two identifiers in one number."""
    out = {}
    for whole, rank in ranks.items():
        for cut in range(1, len(whole)):
            a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
            if a is not None and b is not None:
                out[a << ID_BITS | b] = rank
    return out


def _primes_from(n: int) -> tuple[int, int]:
    found = []
    while len(found) < 2:
        n += 1
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            found.append(n)
    return found[0], found[1]


def two_place_table(entries: dict[int, int]) -> tuple[list[int], int, int]:
    """Array in which key k, with its value in the low ID_BITS, is at k % p or
    at p + k % q (cuckoo hashing)."""
    size = max(16, 2 * len(entries))
    while True:
        p, q = _primes_from(size)
        table, ok = [-1] * (p + q), True
        for k, v in entries.items():
            item, at = k << ID_BITS | v, k % p
            for _ in range(500):
                item, table[at] = table[at], item
                if item < 0:
                    break
                k2 = item >> ID_BITS
                at = p + k2 % q if at == k2 % p else k2 % p
            else:
                ok = False
                break
        if ok:
            return table, p, q
        size = size * 3 // 2


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _joined(*parts: Column) -> Column:
    """Arrays one after the other (cheaper than concat inside a lambda)."""
    return F.flatten(F.array(*parts))


class ByteBpe:
    """Encoder and decoder as column expressions for one rank file."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.pattern = "(?U)" + pattern  # (?U): white space as in Unicode
        table, self.p, self.q = two_place_table(pair_ranks(ranks))
        self.pairs = spark.createDataFrame(pa.table({"pairs": pa.array([table], pa.list_(pa.int64()))}))
        self.letters = (np.array([ranks[bytes([b])] for b in range(256)], np.int64),
                        np.array([ranks.get(bytes([a, b]), NO_RANK) for a in range(256) for b in range(256)], np.int64))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _rank(self, pairs: Column, a: Column, b: Column) -> Column:
        """Rank of two identifiers side by side (long), NO_RANK if they are no piece."""
        def at(place: Column, k: Column, other: Column) -> Column:
            v = F.get(pairs, place.cast("int"))
            return F.when(F.shiftright(v, ID_BITS) == k, v.bitwiseAND(_ID)).otherwise(other)

        return _let(F.shiftleft(a, ID_BITS).bitwiseOR(b),
                    lambda k: at(k % self.p, k, at(k % self.q + self.p, k, F.lit(NO_RANK).cast("long"))))

    def _fold(self, pairs: Column, word: Column) -> Column:
        """Identifiers (array of int) of one word, given as its ``byte_pieces``."""
        place_and_id = (1 << 2 * ID_BITS) - 1

        def packed(rank: Column, place_id: Column) -> Column:
            return F.shiftleft(rank, 2 * ID_BITS).bitwiseOR(place_id)

        def merged(x: Column, low: Column, at: Column) -> Column:  # at: 1-based place of the left piece
            new = F.shiftright(low, 2 * ID_BITS)  # the identifier of a piece is its rank
            after = F.when(at + 1 < F.size(x), self._rank(pairs, new, F.get(x, at + 1).bitwiseAND(_ID))).otherwise(F.lit(NO_RANK).cast("long"))
            here = packed(after, low.bitwiseAND(place_and_id - _ID).bitwiseOR(new))
            left = F.get(x, at - 2)
            before = packed(self._rank(pairs, left.bitwiseAND(_ID), new), left.bitwiseAND(place_and_id))
            rest = F.slice(x, at + 2, F.size(x))
            return F.when(at == 1, _joined(F.array(here), rest)).otherwise(_joined(F.slice(x, F.lit(1), at - 2), F.array(before, here), rest))

        def step(x: Column, _: Column) -> Column:
            return _let(F.array_min(x), lambda low: F.when(low >= NO_RANK << 2 * ID_BITS, x).otherwise(
                _let(F.array_position(x, low).cast("int"), lambda at: merged(x, low, at))))

        return F.aggregate(F.slice(word, F.lit(2), F.size(word)), word, step,
                           lambda end: F.transform(end, lambda e: e.bitwiseAND(_ID).cast("int")))

    def with_encoded(self, rows: DataFrame, name: str, words: Column) -> DataFrame:
        """``rows`` with the identifiers of each word of an array of words, as ``byte_pieces``, as column ``name``.

        A subquery may not be written inside a function over arrays, so it gets
        a column of its own; used once, it is put in its place by the optimiser."""
        return (rows.withColumn("bpe_known", self.pairs.scalar())
                .withColumn(name, _let(F.col("bpe_known"), lambda pairs: F.transform(words, lambda w: self._fold(pairs, w)))).drop("bpe_known"))

    def frequent(self, texts: DataFrame, column: str, most: int) -> pa.Table:
        """word, ids of the most frequent words of all texts: whole classes of
        equal counts, as many as come to at most ``most`` words."""
        word = texts.select(F.explode(self.words(texts[column])).alias("word")).filter(F.length("word") <= FREQUENT_CHARS)
        degree = F.floor(F.log2("n") * STEPS_PER_DOUBLING)
        counts = landed(word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", degree.alias("degree")), "bpe-words")
        least, room = None, most
        for r in counts.groupBy("degree").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("degree")).collect():  # some hundred classes
            room -= r["words"]
            if room < 0:
                break
            least = r["degree"]
        top = counts.filter(F.lit(False) if least is None else F.col("degree") >= least).select("word")
        parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        letters = self.letters

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), byte_pieces(batch.column(0), letters)], ["word", "pieces"])

        top = in_arrow(top.repartition(parts, "word"), pieces, "word string, pieces array<long>")
        return self.with_encoded(top, "ids", F.array("pieces")).select("word", F.col("ids")[0].alias("ids")).toArrow()


def byte_pieces(words: pa.Array, letters: tuple[np.ndarray, np.ndarray]) -> pa.ListArray:
    """The bytes of each word as pieces, one number each: rank with the piece
    behind it, place of its first byte, identifier. So the least number is the
    leftmost pair of lowest rank, and places need no change when pieces merge.
    ``letters`` has the identifier of each byte and the rank of each two bytes."""
    ids, first = letters
    words = words.cast(pa.binary())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets or b"", np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    value = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]].astype(np.int64)
    ends = ends - ends[0]
    rank = np.full(len(value), NO_RANK, np.int64)
    rank[:-1] = first[value[:-1] << 8 | value[1:]]
    rank[ends[1:][np.diff(ends) > 0] - 1] = NO_RANK  # the last of a word has none behind it
    place = np.arange(len(value)) - np.repeat(ends[:-1], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rank << 2 * ID_BITS | place << ID_BITS | ids[value]))


def merged_piece(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Identifiers of one long word: the pair of lowest rank, leftmost first, from a heap."""
    n = len(word)
    end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # piece i is word[i:end[i]], the one in front begins at before[i]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if not gone[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two was merged meanwhile
        end[i], gone[j] = stop, 1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i:end[i]]] for i in range(n) if not gone[i]]


def _sliced(shared, schema: pa.Schema):
    """Rows (key, words) to one row a slice: its keys, the number of words of
    each, a code for each word, and the distinct words that are not known yet
    (the rare ones as ``byte_pieces``). Code c >= 0 is frequent word c, -1 - i
    the i-th of rare and then long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back when a slice is done
        known, letters = shared.value

        def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            keys = pa.concat_arrays([p.column(0) for p in parts])
            sizes = pa.concat_arrays([pc.list_value_length(p.column(1)) for p in parts])
            each = pa.concat_arrays([p.column(1).flatten() for p in parts]).dictionary_encode()
            words = each.dictionary
            code = pc.index_in(words, value_set=known)
            new = np.flatnonzero(code.is_null().to_numpy(zero_copy_only=False))
            large = pc.greater(pc.binary_length(words.take(pa.array(new))), LONG_BYTES).to_numpy(zero_copy_only=False)
            new = np.concatenate([new[~large], new[large]])
            code = code.fill_null(0).to_numpy(zero_copy_only=False).copy()
            code[new] = -1 - np.arange(len(new))
            codes = code[each.indices.to_numpy(zero_copy_only=False)] if len(each) else code[:0]
            rare, long = (words.take(pa.array(x)) for x in np.split(new, [int((~large).sum())]))
            values = (keys, sizes, pa.array(codes, pa.int32()), byte_pieces(rare, letters), long)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(v)], v).cast(f.type) for f, v in zip(schema, values)], schema=schema)

        parts, size = [], 0
        for batch in batches:
            per_row = max(1, batch.column(1).nbytes // max(1, batch.num_rows))
            for at in range(0, batch.num_rows, rows := max(1, SLICE_BYTES // per_row)):
                parts.append(batch.slice(at, rows))
                size += per_row * parts[-1].num_rows
                if size >= SLICE_BYTES:
                    yield told(parts)
                    parts, size = [], 0
        if parts:
            yield told(parts)

    return run


def _assembled(shared, schema: pa.Schema):
    """Slices with the identifiers of their rare words back to rows (key, token_ids, decoded)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        starts, sizes, ids, ranks = shared.value
        pieces = binary_pieces(ranks)
        for batch in batches:
            for at in range(batch.num_rows):
                keys, per_doc, codes, folded = (batch.column(c)[at].values for c in ("keys", "sizes", "codes", "folded"))
                long = [merged_piece(w.encode(), ranks) for w in batch.column("long")[at].as_py()]
                own_sizes = np.concatenate([pc.list_value_length(folded).to_numpy(zero_copy_only=False), [len(x) for x in long]]).astype(np.int64)
                own_ids = np.concatenate([folded.flatten().to_numpy(zero_copy_only=False), *(np.array(x, np.int32) for x in long)])
                every = np.concatenate([ids, own_ids])
                own_starts = len(ids) + np.cumsum(own_sizes) - own_sizes
                code = codes.to_numpy(zero_copy_only=False)
                own = code < 0
                begin = (starts[np.where(own, 0, code)] if len(starts) else np.zeros(len(code))).astype(np.int64)
                size = np.empty(len(code), np.int64)
                begin[own], size[own] = own_starts[-1 - code[own]], own_sizes[-1 - code[own]]
                size[~own] = sizes[code[~own]]
                ends = np.cumsum(size)
                place = np.repeat(begin - ends + size, size)
                place += np.arange(len(place))
                doc_ends = np.concatenate([[0], np.cumsum(per_doc.to_numpy(zero_copy_only=False))])
                offsets = np.concatenate([[0], ends])[doc_ends]
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(every[place], pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.cast(schema.field(0).type), tokens.cast(schema.field(1).type), joined_pieces(pieces, tokens)], schema=schema)

    return run


def _arrow(ddl_or_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_or_schema)


def binary_pieces(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each identifier."""
    pieces = [b""] * (max(ranks.values(), default=0) + 1)
    for piece, n in ranks.items():
        pieces[n] = piece
    return pa.array(pieces, pa.binary())


def joined_pieces(pieces: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The binary pieces of each list of identifiers, one after the other."""
    parts = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), pieces.take(ids.flatten()))
    return pc.binary_join(parts, pa.scalar(b"", pa.binary()))


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes that ``ids`` stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary
    out = encoded.withColumn("decoded", F.lit(None).cast("binary")).schema
    schema = _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = binary_pieces(shared.value)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, joined_pieces(pieces, col)], schema=schema)

    return in_arrow(encoded, run, out)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text",
                     frequent: int = FREQUENT_WORDS) -> DataFrame:
    """``key``, token_ids (array of int) and decoded (binary) for each row.

    A null text is empty: no identifiers, no bytes. Repeated rows and null
    keys are kept one to one; other columns are not read; an empty table gives
    an empty one. Texts and words are encoded whole, whatever their length.
    ``frequent`` bounds the words sent to every task.
    """
    ranks = read_ranks(rank_file)
    bpe = ByteBpe(docs.sparkSession, ranks, pattern)
    known = bpe.frequent(docs.select(docs[text].alias("t")), "t", frequent).combine_chunks()
    ids = known.column("ids").combine_chunks() if len(known) else pa.array([], pa.list_(pa.int32()))
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int32)
    words = known.column("word").combine_chunks().cast(pa.string()) if len(known) else pa.array([], pa.string())
    # at most ``frequent`` words of FREQUENT_CHARS characters, and the vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((words, bpe.letters))
    known_ids = docs.sparkSession.sparkContext.broadcast(
        ((np.cumsum(sizes) - sizes).astype(np.int32), sizes, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), ranks))
    del known, ids, words
    pa.default_memory_pool().release_unused()
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), bpe.words(docs[text]).alias("words"))
    ddl = f"keys array<{kind}>, sizes array<int>, codes array<int>, rare array<array<long>>, long array<string>"
    # landed, so that a task has one Python worker at a time
    slices = landed(in_arrow(rows, _sliced(shared, _arrow(_struct(ddl))), ddl), "bpe-slices")
    folded = bpe.with_encoded(slices, "folded", F.col("rare")).drop("rare")
    ddl = f"key {kind}, token_ids array<int>, decoded binary"
    return in_arrow(folded, _assembled(known_ids, _arrow(_struct(ddl))), ddl).withColumnRenamed("key", key)


def _struct(ddl: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def digests(encoded: DataFrame, key: str = "doc_id", more: Sequence[str] = ()) -> DataFrame:
    """n_tokens and SHA-256 digests of identifiers and decoded bytes."""
    return encoded.select(
        key, F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), *more)
