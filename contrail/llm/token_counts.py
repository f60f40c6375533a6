"""Operator 6: token counts by heap-and-linked-list byte-pair merging.

The count of a piece of text is its number of initial symbols (bytes) minus
the number of merges; no token identifiers are ever produced. A heap holds
the adjacent pairs by (rank, position); popping the lowest one unlinks its
right symbol from a doubly linked list and pushes the two new neighbours.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import by_rows

# The split pattern of byte-level tokenizers (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 200_000
CACHE_WORD_CHARS = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if
    it is a visible Latin-1 character, else the next unused letter from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    return [other.get(b, chr(b)) for b in range(256)]


def read_merges(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Merge ranks and added special strings of a tokenizer file (driver side;
    bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
    return {p: n for n, p in enumerate(pairs)}, [t["content"] for t in spec["added_tokens"]]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when no ranked adjacent pair remains."""
    n = len(symbols)
    left = list(range(-1, n - 1))
    right = [*range(1, n), -1]
    symbols = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two was merged meanwhile
        merges += 1
        symbols[i], symbols[j] = a + b, ""
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


class Counter(dict):
    """Token counts of words seen so far; starts anew when full."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.letters = ranks, byte_letters()

    def __missing__(self, word: str) -> int:
        n = merged_length([self.letters[b] for b in word.encode("utf-8", "surrogatepass")], self.ranks)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, tokenizer: str, text: str | Column = "text", key: str = "doc_id",
                 limit: int = 512) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit for each row of ``docs``.

    A null text counts as empty (0 tokens); special strings of the tokenizer
    inside a text are one token each and split the text, as the library does
    by default. Repeated rows and null keys are kept one to one, other columns
    of ``docs`` are not read, an empty table gives an empty one. Texts are
    handled whole, whatever their length; no row leaves its task.
    """
    ranks, special = read_merges(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, special))  # bounded by the vocabulary file
    state: dict = {}

    def count(cols: dict) -> dict:
        if not state:
            import re

            known, names = shared.value
            state["words"], state["count"] = regex.compile(SPLIT), Counter(known)
            state["special"] = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None
            state["names"] = names
        find, per_word = state["words"].findall, state["count"]
        n_bytes, n_tokens = [], []
        for t in cols["text"]:
            t = t or ""
            n_bytes.append(len(t.encode("utf-8")))
            n = 0
            parts = [t]
            if any(s in t for s in state["names"]):
                parts = state["special"].split(t)
                n = len(parts) - 1
            n_tokens.append(n + sum(sum(map(per_word.__getitem__, find(p))) for p in parts))
        return {"key": cols["key"], "n_bytes": n_bytes, "n_tokens": n_tokens}

    rows = docs.select(docs[key].cast("long").alias("key"),
                       (docs[text] if isinstance(text, str) else text).alias("text"))
    out = by_rows(rows, count, "key long, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
