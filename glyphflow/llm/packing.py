"""Operator 1 - best-fit packing of tokenised documents into sequences.

Hierarchical residual packing. Every task packs its own pieces best-fit and
keeps the nearly full bins as they are. The underfull bins of all tasks become
items of a next round: they are dealt into groups of bounded size, each group
packs its items best-fit again, and so on up the tree until one group holds what
is left or a round joins hardly anything. No task ever holds more than its own
partition's lengths or one group of at most ``GROUP_ROWS`` items.

Defined cases: a null text is the empty text, which is one piece with the end id
alone; texts of up to ``capacity`` ids are never cut; ties take the fuller, then
the older bin; repeated rows are packed like any others; an empty table gives an
empty result; a null id is carried like any other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TwoGenerations, only, written

#: Items of one group of a later round, and pieces that one local packing takes.
GROUP_ROWS, LOCAL_ROWS = 12_000, 100_000
#: A bin with at most this share of its room left is finished.
NEARLY_FULL = 1 / 256
#: A round that joins less than this share of its items is the last.
WORTH = 0.02
KEEP_ENTRIES, KEEP_CHARS = 250_000, 48
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(r"[^\t-\r \x85\xa0  -     　]+")


class WordIds(TwoGenerations):
    """The ids of a white-space-free piece as little-endian 32-bit bytes; only lower-case words and odd pieces are stored."""

    MARKS = 1 << 21

    def __init__(self, tokenizer):
        super().__init__(KEEP_ENTRIES, KEEP_CHARS)
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and (low := word.lower()) != word:
            return self[low]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        return super().__missing__(word)

    def make(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            # Lower-case letters alone pass the normaliser and the byte map unchanged.
            return np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        """The ids of a whole text. The vocabulary drops white space, so no token spans it."""
        words = _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


@cache
def word_ids(path: str) -> WordIds:
    """Once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit in the given order: bin and offset of each item, and what each bin holds.

    ``room[r]`` lists the open bins with r left; a bit set of the lists in use finds the tightest.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins, offsets, used = 0, [], [], []
    for n in lengths:
        if fits := free >> n:
            left = n + (fits & -fits).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            left, k = capacity, len(used)
            used.append(0)
        bins.append(k)
        offsets.append(used[k])
        used[k] += n
        left -= n
        if left:
            room[left].append(k)
            free |= 1 << left
    return bins, offsets, used


def _packed(frame: pd.DataFrame, length: str, tie: list[str], capacity: int) -> pd.DataFrame:
    """Sorted by falling length, then by ``tie``; with bin, bin_offset and bin_used."""
    frame = frame.sort_values([length, *tie], ascending=[False, *[True] * len(tie)], kind="stable")
    bins, offsets, used = best_fit(frame[length].tolist(), capacity)
    return frame.assign(bin=np.array(bins, np.int64), bin_offset=np.array(offsets, np.int64), bin_used=np.array(used, np.int64)[bins] if bins else np.zeros(0, np.int64))


def tokenised_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: ``key``, piece, start, length and ids_crc32. Only longer texts are cut."""
    tail = int(end_id).to_bytes(4, "little")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_path)
        only(words)
        for frame in frames:
            rows = []
            for k, text in zip(frame["k"], frame["t"], strict=True):
                ids = words.of(text or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"])

    kind = df.select(key).schema[0].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(cut, f"k {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("k", key)


def best_fit_pack(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: no sequence holds more than ``capacity``, offsets are gapless from 0.

    Lengths are from 1 to ``capacity``.
    """
    slack = int(capacity * NEARLY_FULL)
    names = [c for c in pieces.columns if c != length]

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, kept, rows = TaskContext.get().partitionId() << 33, [], 0

        def flush() -> pd.DataFrame:
            nonlocal base, kept, rows
            out = _packed(pd.concat(kept, ignore_index=True), length, [], capacity)
            out["bin"] += base
            base, kept, rows = int(out["bin"].max()) + 1, [], 0
            return out

        for frame in frames:
            if len(frame):
                kept.append(frame)
                rows += len(frame)
            if rows >= LOCAL_ROWS:
                yield flush()
        if rows:
            yield flush()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = _packed(frame, "used", ["bin_id"], capacity)
        first = out[out["bin_offset"] == 0].set_index("bin")["bin_id"]
        return pd.DataFrame({"bin_id": out["bin_id"], "parent": out["bin"].map(first), "shift": out["bin_offset"], "used": out["bin_used"]})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names, length).schema]
    # Written first: a task then holds one Python worker, not the tokenizer's and the packer's.
    pieces = written(pieces.select(*names, length), "pieces")
    placed = written(pieces.mapInPandas(local, ", ".join([*kinds, "bin long", "bin_offset long", "bin_used long"])), "packing")
    items = placed.where((F.col("bin_offset") == 0) & (F.col("bin_used") < capacity - slack)).select(F.col("bin").alias("bin_id"), F.col("bin_used").alias("used"))
    count, level, moves = items.count(), 0, None
    while count > 1:
        groups = -(-count // GROUP_ROWS)
        dealt = items.withColumn("grp", F.pmod(F.xxhash64("bin_id", F.lit(level)), F.lit(groups)))
        joined = written(dealt.groupBy("grp").applyInPandas(lambda f: merge(f[["bin_id", "used"]]), "bin_id long, parent long, shift long, used long"), "packing")
        if moves is None:
            moves = joined.select("bin_id", "parent", "shift")
        else:
            up = joined.select(F.col("bin_id").alias("parent"), F.col("parent").alias("up"), F.col("shift").alias("more"))
            moves = moves.join(up, "parent", "left").select("bin_id", F.coalesce("up", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        items = joined.where((F.col("shift") == 0) & (F.col("used") < capacity - slack)).select(F.col("parent").alias("bin_id"), "used")
        left = items.count()
        if groups == 1 or left > (1 - WORTH) * count:
            break
        count, level = left, level + 1
    if moves is None:
        return placed.select(*names, length, F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    own = placed.join(moves, placed["bin"] == moves["bin_id"], "left")
    return own.select(*names, length, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
