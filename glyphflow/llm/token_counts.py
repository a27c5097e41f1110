"""Operator 7 - token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens by the vocabulary's pattern; in each, the adjacent
pair of lowest rank is popped from a heap and merged in a linked list until no
ranked pair is left. The count is the number of initial byte symbols minus the
merges; no identifiers are made. Counts of short pieces are remembered per
worker in a dictionary of bounded size, which changes speed only.

Defined cases: null text is the empty text (0 bytes, 0 tokens); a special
string inside a text is one token, as the library has it by default; repeated
rows repeat; an empty table gives an empty result; other columns are ignored, whatever their names. A long run without
white space costs n log n.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TwoGenerations, only

#: White space by the Unicode property, for use inside a character class.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A piece never shares a token with its neighbours: white space and the run after it.
PIECES = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The public pre-token pattern of byte-level vocabularies (a fixed value).
PRE_TOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
KEEP_ENTRIES, KEEP_CHARS = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merges_needed(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes on these symbols."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        rank, i, j = heapq.heappop(heap)
        if not alive[i] or after[i] != j or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        alive[j] = False
        done += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, k))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, i))
    return done


class PieceCounts(TwoGenerations):
    """Tokens of a piece."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__(KEEP_ENTRIES, KEEP_CHARS)
        self.ranks, self.symbols = ranks, byte_symbols()

    def make(self, piece: str) -> int:
        count = 0
        for word in PRE_TOKENS.findall(piece):
            symbols = [self.symbols[b] for b in word.encode()]
            count += len(symbols) - merges_needed(symbols, self.ranks)
        return count


@cache
def vocabulary(path: str) -> tuple[PieceCounts, list[str]]:
    """The counter of a tokenizer file and its special strings; once per worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
    return PieceCounts({p: k for k, p in enumerate(pairs)}), [t["content"] for t in spec["added_tokens"]]


def count_tokens(text: str, counts: PieceCounts, special: list[str]) -> int:
    """The tokens of a whole text."""
    total, parts = 0, [text]
    for mark in special:
        total += sum(p.count(mark) for p in parts)
        parts = [q for p in parts for q in p.split(mark)]
    return total + sum(sum(map(counts.__getitem__, PIECES.findall(p))) for p in parts)


def token_counts(df: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: ``key``, n_bytes, n_tokens and over_limit (more tokens than ``limit``).

    ``vocabulary_path`` is a tokenizer file that every executor has at that place.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, special = vocabulary(vocabulary_path)
        only(counts)
        for frame in frames:
            yield pd.DataFrame({"k": frame["k"], "n_tokens": [count_tokens(t or "", counts, special) for t in frame["t"]], "n_bytes": frame["n_bytes"]})

    kind = df.select(key).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInPandas(count, f"k {kind}, n_tokens long, n_bytes long")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
