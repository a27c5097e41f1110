"""Operator 11 - alignment of two tokenizers' outputs by diagonal run skipping.

Both tokenizers cut the same bytes. Where a token of A and a token of B end at
the same byte, a group ends. The end arrays are compared at the current shift of
indices: probes of doubling width jump a stretch in which token meets token, and
halving widths find its end. What follows is irregular; it is stepped through
until both ends meet again, which gives the new shift. A group of m and n tokens
has m + n - 1 overlapping pairs, its links.

How often an id pair is linked in the corpus is counted per task first and then
by pair. The ``HEAD`` most frequent pairs go to all tasks (a fixed number, 16
bytes each); the pair of rank HEAD + 1 holds at most 1/HEAD of all links, so the
join of the others has no hot key. Texts are tokenised once: each row's distinct
pairs are written with how often it has them.

Neither tokenizer joins across a single blank between other characters (B's
pieces are looked through for that), so texts are cut there, and the different
words of a block are tokenised and aligned once, laid end to end.

Defined cases: texts that are null or empty, and those whose tokens don't spell
them (tokenizers that replace characters), have no tokens; a tie for the best
partner of a B id counts for all that share it; repeated rows repeat, null ids
keep their row, and both count in the corpus like any row; an empty table gives
an empty result; other columns are ignored, whatever their names; a very long
text is read whole, its parts cut where neither tokenizer joins across.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, written

#: Pairs that every task holds.
HEAD = 1 << 16
#: Characters of text that are aligned at once, and of the parts of a long text.
BLOCK_CHARS, PART_CHARS = 1 << 22, 1 << 16
#: Words that a tokenizer is given in one text, and rows that are held as Python objects.
JOINED, SLICE_ROWS = 256, 2048
#: Pairs that a task counts before it emits them.
COUNT_AT_ONCE = 1 << 21
#: A blank between characters that are no white space, and not what B writes for a blank.
_BLANK = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def _ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; its rank file, where given, holds the same vocabulary and is quicker."""

    def __init__(self, path: str, ranks: str | None = None):
        import tiktoken
        import tokenizers

        from .token_counts import byte_symbols

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        names = [self.library.id_to_token(k) or "" for k in range(self.library.get_vocab_size())]
        self.pieces = [bytes(byte_of[c] for c in n) if all(c in byte_of for c in n) else n.encode() for n in names]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.quick = ranks and tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(ranks), special_tokens={})

    def encode(self, texts: list[str]) -> list[int]:
        """The ids of these texts, each with a blank before it, end to end."""
        one = self.quick.encode_ordinary if self.quick else lambda t: self.library.encode(t, add_special_tokens=False).ids
        return [k for t in texts for k in one(f" {t}")]


class Pieces:
    """A SentencePiece model, which puts a blank before a word itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        byte = [_BYTE_PIECE.fullmatch(n) if self.library.is_byte(k) else None for k, n in enumerate(names)]
        self.pieces = [bytes([int(m[1], 16)]) if m else n.replace("▁", " ").encode() for n, m in zip(names, byte, strict=True)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        #: No piece holds a blank after anything else, so none joins across a single blank.
        self.cuttable = not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[int]:
        return [k for own in self.library.encode(texts, num_threads=1) for k in own] if texts else []


@cache
def byte_level(path: str, ranks: str | None) -> ByteLevel:
    return ByteLevel(path, ranks)


@cache
def sentence_pieces(path: str) -> Pieces:
    return Pieces(path)


def group_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: for each the number of tokens of A, and of B, up to its end. Both end arrays rise and share their last end."""
    i, shift, n = 0, 0, len(a)
    at_a, at_b, runs = [], [], []
    while i < n:
        run, width = 0, 1
        while i + run < n and a[i + run : i + run + width] == b[i + run + shift : i + run + shift + width]:
            run, width = run + width, width * 2
        run = min(run, n - i)
        while width > 1 and i + run < n:
            width //= 2
            if a[i + run : i + run + width] == b[i + run + shift : i + run + shift + width]:
                run = min(run + width, n - i)
        if run:
            at_a.append(i + 1)
            at_b.append(i + 1 + shift)
            runs.append(run)
            i += run
        if i < n:
            j = i + shift
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            at_a.append(i)
            at_b.append(j)
            runs.append(1)
            shift = j - i
    counts = np.array(runs, np.int64)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.array(at_a, np.int64), counts) + inside, np.repeat(np.array(at_b, np.int64), counts) + inside


@cache
def _labels(size_a: int, size_b: int) -> list[bytes]:
    """A's ids followed by a comma and by a bar, then B's by a comma and by a semicolon."""
    return [b"%d%s" % (k, c) for k in range(size_a) for c in (b",", b"|")] + [b"%d%s" % (k, c) for k in range(size_b) for c in (b",", b";")]


class Words:
    """Different words, each with its numbers of tokens and groups, its groups as text, and its links.

    The first ``joinable`` of them neither begin nor end with white space and hold no U+2581: they are given to the tokenizers in one text.
    """

    def __init__(self, words: list[str], joinable: int, a: ByteLevel, b: Pieces):
        spelt = [f" {w}".encode() for w in words]
        sides = [self._tokens(x, words, spelt, joinable) for x in (a, b)]
        self.sound = sides[0][0] & sides[1][0]
        (self.n_a, all_a, ends_a), (self.n_b, all_b, ends_b) = (self._laid(x, ids, sizes, self.sound) for x, (_, ids, sizes) in zip((a, b), sides, strict=True))
        cut_a, cut_b = group_ends(ends_a.tolist(), ends_b.tolist())
        size_a, size_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        to_a, to_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.n_groups = np.diff(np.searchsorted(cut_a, to_a, side="right"), prepend=0)

        # The tokens of each group as text, A's before B's.
        label = np.empty(len(all_a) + len(all_b), np.int64)
        for ids, cut, place, base in ((all_a, cut_a, np.repeat(cut_b - size_b, size_a), 0), (all_b, cut_b, np.repeat(cut_a, size_b), len(a.pieces))):
            last = np.zeros(len(ids), np.int64)
            last[cut - 1] = 1
            label[np.arange(len(ids)) + place] = 2 * (base + ids) + last
        names, label, bounds = _labels(len(a.pieces), len(b.pieces)), label.tolist(), np.concatenate([[0], to_a + to_b]).tolist()
        self.groups = [b"".join(map(names.__getitem__, label[x:y]))[:-1] for x, y in zip(bounds, bounds[1:], strict=False)]

        # Links: one to one, and in irregular groups one for each stretch between neighbouring ends of either side.
        single = (size_a == 1) & (size_b == 1)
        one = cut_a[single] - 1
        odd_a, odd_b = np.repeat(~single, size_a), np.repeat(~single, size_b)
        ends = np.unique(np.concatenate([ends_a[odd_a], ends_b[odd_b]]))
        first = np.concatenate([all_a[one], all_a[odd_a][np.searchsorted(ends_a[odd_a], ends)]])
        second = np.concatenate([all_b[cut_b[single] - 1], all_b[odd_b][np.searchsorted(ends_b[odd_b], ends)]])
        at = np.concatenate([ends_a[one], ends])
        order = np.argsort(at, kind="stable")
        self.links = (first * len(b.pieces) + second)[order]
        self.link_ends = np.searchsorted(at[order], np.concatenate([[0], ends_a])[to_a], side="right")

    @staticmethod
    def _tokens(x: ByteLevel | Pieces, words: list[str], spelt: list[bytes], joinable: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the tokens of each word spell it, all tokens, and how many each word has."""
        ids = np.array(x.encode([" ".join(words[k : min(k + JOINED, joinable)]) for k in range(0, joinable, JOINED)]), np.int64)
        to = np.cumsum([len(w) for w in spelt[:joinable]], dtype=np.int64)
        ends = np.cumsum(x.lengths[ids])
        if b"".join(map(x.pieces.__getitem__, ids.tolist())) == b"".join(spelt[:joinable]) and np.isin(to, ends, assume_unique=True).all():
            sizes, sound = np.diff(np.searchsorted(ends, to, side="right"), prepend=0), np.ones(joinable, bool)
        else:
            ids, joinable = ids[:0], 0
            sizes, sound = np.zeros(0, np.int64), np.zeros(0, bool)
        single = [x.encode([w]) for w in words[joinable:]]
        right = [b"".join(map(x.pieces.__getitem__, own)) == w for own, w in zip(single, spelt[joinable:], strict=True)]
        return np.concatenate([sound, np.array(right, bool)]), np.concatenate([ids, *(np.array(own, np.int64) for own in single)]), np.concatenate([sizes, np.array([len(own) for own in single], np.int64)])

    @staticmethod
    def _laid(x: ByteLevel | Pieces, ids: np.ndarray, sizes: np.ndarray, sound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens per sound word, all of them end to end, and where they end."""
        ids = ids[np.repeat(sound, sizes)]
        return np.where(sound, sizes, 0), ids, np.cumsum(x.lengths[ids])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


def _parts(text: str, cuttable: bool) -> Iterator[str]:
    """A text in parts that a blank divides, of about PART_CHARS."""
    at = 0
    while cuttable and len(text) - at > PART_CHARS and (blank := _BLANK.search(text, at + PART_CHARS)):
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def _blocks(texts: list[str], cuttable: bool) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of about BLOCK_CHARS together, with the numbers of their texts."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in _parts(text, cuttable) if text else ():
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= BLOCK_CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def aligned(texts: list[str], a: ByteLevel, b: Pieces) -> dict[str, np.ndarray | list]:
    """Per text n_a, n_b, n_groups and groups_sha256; and the rows (owner, pair, times) of all texts."""
    totals = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups")}
    sound, hashes = np.array([bool(t) for t in texts], bool), {}
    span = len(a.pieces) * len(b.pieces)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for rows, parts in _blocks(texts, b.cuttable):
        number: dict[str, int] = {}
        own = [[number.setdefault(w, len(number)) for w in (_BLANK.split(part) if b.cuttable else [part])] for part in parts]
        # Only the first and the last word of a part can begin or end with white space.
        seen = list(number)
        apart = {k for numbers in own for k in (numbers[0], numbers[-1]) if seen[k][0].isspace() or seen[k][-1].isspace()} if b.cuttable else set(range(len(seen)))
        if any("▁" in part for part in parts):
            apart |= {k for k, w in enumerate(seen) if "▁" in w}
        order = [k for k in range(len(seen)) if k not in apart] + sorted(apart)
        words = Words([seen[k] for k in order], len(seen) - len(apart), a, b)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        spelt = [words.groups[k] for k in place.tolist()] if apart else words.groups
        for row, numbers in zip(rows, own, strict=True):
            groups = b";".join(map(spelt.__getitem__, numbers))
            if row in hashes:
                hashes[row].update(b";" + groups)
            else:
                hashes[row] = hashlib.sha256(groups)
        flat = place[np.fromiter(chain.from_iterable(own), np.int64)]
        keys, times = _summed(np.repeat(np.array(rows), [len(x) for x in own]) * len(order) + flat, np.ones(len(flat), np.int64))
        row, word = keys // len(order), keys % len(order)
        sound[row[~words.sound[word]]] = False
        for name, total in totals.items():
            np.add.at(total, row, getattr(words, name)[word] * times)
        starts = np.concatenate([[0], words.link_ends[:-1]])
        sizes = (words.link_ends - starts)[word]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found.append(_summed(np.repeat(row, sizes) * span + words.links[np.repeat(starts[word], sizes) + inside], np.repeat(times, sizes)))
    keys, times = (np.concatenate(c) for c in zip(*found, strict=True))
    if len(found) > 2:
        keys, times = _summed(keys, times)
    owner, pair = keys // span, keys % span
    keep = sound[owner]
    digests = [hashes[k].hexdigest() if ok else "" for k, ok in enumerate(sound.tolist())]
    return {c: np.where(sound, v, 0) for c, v in totals.items()} | {"groups_sha256": digests, "owner": owner[keep], "pair": pair[keep], "times": times[keep]}


def _lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def tokenised(df: DataFrame, a: tuple[str, str | None], b: str, key: str, text: str) -> DataFrame:
    """Per row: its counts and digest, and its distinct pairs with how often it has them."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        left, right = byte_level(*a), sentence_pieces(b)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                got = aligned([t or "" for t in rows.column("text").to_pylist()], left, right)
                columns = [rows.column("id"), *(pa.array(got[c]) for c in ("n_a", "n_b", "n_groups")), pa.array(got["groups_sha256"], pa.string())]
                lists = [_lists(got["owner"], pa.array(v), rows.num_rows) for v in (got["pair"], got["times"].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *lists], ["id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(align, f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in the batch, pair, times)."""
    pairs, times = batch.column("pairs"), batch.column("times")
    sizes = np.diff(pairs.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), pairs.flatten().to_numpy(), times.flatten().to_numpy()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, np.int64)] * 2
    for batch in batches:
        _, pairs, times = _flat(batch)
        held = list(_summed(np.concatenate([held[0], pairs]), np.concatenate([held[1], times.astype(np.int64)])))
        if len(held[0]) >= COUNT_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["pair", "c"])
            held = [np.zeros(0, np.int64)] * 2
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["pair", "c"])


def _most_frequent(counts: DataFrame) -> pd.DataFrame:
    """At most HEAD pairs with their counts: all pairs above a level of the count."""
    level = F.floor(F.log2("c") * 16).cast("int")
    room, least = HEAD, None
    for row in sorted(counts.groupBy(level.alias("e")).count().collect(), reverse=True):
        if row["count"] > room:
            break
        least, room = row["e"], room - row["count"]
    return counts.where(F.lit(False) if least is None else level >= least).toPandas().sort_values("pair", ignore_index=True)


def _over_head(head: pd.DataFrame):
    """Per row the sums over the head's pairs, and the pairs that are not among them."""
    pairs, counts, best = (head[c].to_numpy() for c in ("pair", "c", "best"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, times = _flat(batch)
            if len(pairs):
                place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                known = pairs[place] == pair
            else:
                place, known = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
            n, count_sum, n_best = batch.num_rows, *(np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(count_sum, row[known], counts[place[known]] * times[known])
            np.add.at(n_best, row[known], best[place[known]] * times[known])
            others = row[~known]
            rest = [_lists(others, pa.array(v[~known]), n) for v in (pair, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(count_sum), pa.array(n_best), *rest], ["row", "count_sum", "n_best", "pairs", "times"])

    return add


def cross_alignment(df: DataFrame, a: tuple[str, str | None], b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``a``: a byte-level tokenizer file and, or None, the rank file of the same vocabulary;
    ``b``: a SentencePiece model. Every executor has them at these places.
    """
    rows = written(tokenised(df, a, b, key, text).withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    counted = rows.select("pairs", "times").mapInArrow(_counted, "pair long, c long")
    counts = counted.groupBy("pair").agg(F.sum("c").alias("c")).withColumn("b", F.col("pair") % len(sentence_pieces(b).pieces))
    counts = written(counts, "aligned-pairs")
    highest = counts.groupBy("b").agg(F.max("c").alias("highest"))
    # As many rows as B has ids: small enough for every task.
    scored = counts.join(F.broadcast(highest), "b").select("pair", "c", (F.col("c") == F.col("highest")).cast("long").alias("best"))
    head = _most_frequent(scored)

    fields = "row long, count_sum long, n_best long, pairs array<long>, times array<int>"
    summed = written(rows.select("row", "pairs", "times").mapInArrow(_over_head(head), fields), "aligned-sums")
    others = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    least = head["c"].min() if len(head) else None
    rare = scored if least is None else scored.where(F.col("c") < F.lit(int(least)))
    of_row = others.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("c")).alias("more"), F.sum(F.col("times") * F.col("best")).alias("more_best"))
    joined = rows.select("row", "id", "n_a", "n_b", "n_groups", "groups_sha256").join(summed.select("row", "count_sum", "n_best"), "row").join(of_row, "row", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    return joined.select(
        F.col("id").alias(key), "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
        plus("n_best", "more_best").alias("n_best"), plus("count_sum", "more").alias("count_sum"), "groups_sha256",
    )
