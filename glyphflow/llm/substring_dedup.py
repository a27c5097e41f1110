"""Operator 13 - repeated passages by compaction of a de Bruijn graph.

The graph's edges are the windows of k words, its nodes their first and last
k - 1 words; an edge is named by its two nodes, 64 bits each. Only edges that
occur in two documents matter, and each of them has a source: the place (document
and position) where it occurs first, by document id.

* Texts are dealt into blocks of bounded size, a table bucketed by block, so that
  later passes join what they need to the texts without moving them. A block tells
  an edge once, however many of its documents hold it, so no key has more rows
  than there are blocks.
* Sieve: each window has a least 5-word shingle (by hash). Equal windows have equal
  ones, so a window whose least shingle occurs in one document only is not looked
  at again.
* Edges that are left meet by their nodes; those of one document go, the others
  get their source.
* Compaction: a document's neighbouring windows whose sources are neighbours are
  one run. A node with one edge in and one out is passed through; runs are joined
  with the other nodes of their source and cut there, so that each is part of one
  nonbranching path: (place, windows, place of the source).
* These spans go back to the blocks, where the windows at their coordinates are
  made from the words again, and with both nodes (128 bits) looked up in all
  documents of the block.

Defined cases: null and empty texts, and texts of fewer than k words, lose
nothing; a null id counts as larger than every id, and rows that share an id, or
have none, don't remove each other's words; repeated rows repeat; very long texts
are never cut; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import removed, shared_dir, written
from .shingles import mix, powers, word_hashes

WORDS, SEED_WORDS = 13, 5
#: Bytes of text that a block has on average.
BLOCK_BYTES = 8_000_000
#: Bytes that are hashed at once.
AT_ONCE = 1 << 19
#: The place of a null id in the order of documents.
LAST = (1 << 63) - 1
_BLANK = re.compile(rb"[\x20\t-\r]")
_SALTS = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D)


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(len(words) - k + 1, 0)
    if not n:
        return words[:0]
    up, down = powers(1 << len(words).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes, made from some bytes at a time that end in white space."""
    found, start = [], 0
    while start < len(data):
        blank = _BLANK.search(data, start + AT_ONCE)
        end = blank.end() if blank else len(data)
        first, words = word_hashes(np.frombuffer(data, np.uint8, end - start, start), fold=False)
        found.append((first + start, words))
        start = end
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Block:
    """The windows of some texts: the document of each, its position there, its nodes and its least shingle."""

    def __init__(self, rows: pa.Table, k: int):
        # The order of texts, and so a document's number, is the same each time a block is read.
        rows = rows.sort_by([("o", "ascending"), ("text", "ascending")])
        self.rows, self.ids = rows, rows["o"].to_numpy()
        self.texts, self.k = [(t or "").encode() for t in rows["text"].to_pylist()], k
        first, words = _words(b"\n".join(self.texts) + b"\n")
        self.bounds = np.searchsorted(first, np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts])]))
        doc = np.repeat(np.arange(len(self.texts)), np.diff(self.bounds))
        n = max(len(words) - k + 1, 0)
        self.words, self.at = words, np.flatnonzero(doc[:n] == doc[k - 1 :])
        self.doc = doc[self.at]

    def least(self, size: int) -> np.ndarray:
        """The hash of the least shingle of each window."""
        grams, more = _grams(self.words, size), self.k - size
        low = grams[: max(len(grams) - more, 0)]
        for j in range(1, more + 1):
            low = np.minimum(low, grams[j : j + len(low)])
        return low[self.at]

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """Left and right node of each window."""
        nodes = _grams(self.words, self.k - 1)
        return nodes[self.at], nodes[self.at + 1]


def _edge_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left ^ _SALTS[0]) + mix(right ^ _SALTS[1])


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Neighbouring rows of one block; twice BLOCK_BYTES of them are enough for one piece."""
    held, size, number = [], 0, None
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for a, b in zip(cuts := [*_firsts(blocks).tolist(), len(blocks)], cuts[1:], strict=False):
            if held and (blocks[a] != number or size > 2 * BLOCK_BYTES):
                yield number, pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size, number = size + held[-1].nbytes, int(blocks[a])
    if held:
        yield number, pa.Table.from_batches(held)


def _sieve(k: int, size: int):
    """Per block its different least shingles, with the least and largest document that has them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _by_block(batches):
            block = Block(rows, k)
            m, ids = block.least(size), block.ids[block.doc]
            # A shingle is told once for each stretch of windows that has it.
            turn = np.flatnonzero(np.concatenate([np.ones(min(1, len(m)), bool), (m[1:] != m[:-1]) | (ids[1:] != ids[:-1])]))
            order = turn[np.argsort(m[turn], kind="stable")]
            if len(first := _firsts(m[order])):
                # Rows go out as the texts come: neighbours are alike, and shuffle in few bytes.
                out = np.argsort(order[first])
                columns = [_signed(m[order][first][out]), *(pa.array(f.reduceat(ids[order], first)[out]) for f in (np.minimum, np.maximum)), pa.array(np.full(len(first), number, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["m", "lo", "hi", "block"])

    return scan


def _edges(k: int, size: int):
    """Of one block the different edges that the sieve leaves: the least document, and the place there."""

    def emit(texts: pa.Table, sieved: pa.Table) -> pa.Table:
        block = Block(texts, k)
        known, m = np.sort(sieved["m"].to_numpy().view(np.uint64)), block.least(size)
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, m), len(known) - 1)] == m) if len(known) else np.zeros(0, np.int64)
        left, right = (x[at] for x in block.nodes())
        keys, ids = _edge_keys(left, right), block.ids[block.doc[at]]
        # Windows come by document, documents by id: the first of equal edges is in the least document.
        order = np.argsort(keys, kind="stable")
        first = _firsts(keys[order])
        last = np.append(first[1:], len(order))[: len(first)] - 1
        low, several = order[first], ids[order[last]] > ids[order[first]]
        out = np.argsort(low)
        low, number = low[out], texts["block"][0].as_py() if len(texts) else 0
        place = (number << 33) + (block.at[at[low]] << 1) + several[out]
        return pa.table([_signed(left[low]), _signed(right[low]), pa.array(ids[low]), pa.array(place)], ["left", "right", "o", "place"])

    return emit


def _cut(k: int):
    """Of one block every text: its words, how many of them spans cover, and the digest of the others."""

    def cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
        block = Block(texts, k)
        left, right = block.nodes()
        keys = _edge_keys(left, right)
        gone = np.zeros(len(block.words) + 1, np.int64)
        if len(spans):
            word, n, source = (spans[c].to_numpy() for c in ("word", "n", "so"))
            first = np.searchsorted(block.at, word)
            told = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            source = np.repeat(source, n)
            order = np.argsort(keys[told])
            told, source = told[order], source[order]
            place = np.minimum(np.searchsorted(keys[told], keys), len(told) - 1)
            same = (left[told[place]] == left) & (right[told[place]] == right)
            hit = block.at[same & (source[place] < block.ids[block.doc])]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + k, -1)
        kept = np.cumsum(gone[:-1]) == 0
        digests, removed_words = [], []
        for text, a, b in zip(block.texts, block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
            words, keep = text.split(), kept[a:b]
            removed_words.append(b - a - int(keep.sum()))
            digests.append(hashlib.sha256(b" ".join(compress(words, keep.tolist()) if removed_words[-1] else words)).hexdigest())
        columns = [block.rows["id"], pa.array(np.diff(block.bounds)), pa.array(removed_words, pa.int64()), pa.array(digests, pa.string())]
        return pa.table(columns, ["id", "n_words", "n_removed", "kept_sha256"])

    return cut


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(block, o, id, text) as a table bucketed by block, in the shared folder."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("o"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    name = f"substring_blocks_{uuid.uuid4().hex}"
    dealt.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(blocks, "block").saveAsTable(name)
    removed(spark)
    return spark.table(name)


def _joined(left: DataFrame, right: DataFrame, cogrouped, schema: str) -> DataFrame:
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(cogrouped, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring windows whose sources are neighbours too, as one row with their number n; rows come by block and word."""
    for batch in batches:
        if batch.num_rows:
            block, word, sb, sw = (batch.column(c).to_numpy().astype(np.int64) for c in ("block", "word", "sb", "sw"))
            step = lambda x, by: x[1:] == x[:-1] + by
            # The last windows of a document are no neighbours of the next one's: it ends k - 1 words later.
            first = np.flatnonzero(np.concatenate([[True], ~(step(block, 0) & step(word, 1) & step(sb, 0) & step(sw, 1))]))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(first)).columns, pa.array(np.diff(np.append(first, len(word))))], [*batch.schema.names, "n"])


def path_ends(own: DataFrame) -> DataFrame:
    """(sb, so, at): words of sources at which a path ends because the node there branches.

    ``own``: the different edges (left, right) with their source (sb, so, sw). The left node of an edge
    is at its word, its right node at the next.
    """
    sides = [(side, F.col("sw") + F.lit(more)) for side, more in (("left", 0), ("right", 1))]
    parts = [own.select(F.col(side).alias("node"), "sb", "so", at.alias("at"), F.count("*").over(Window.partitionBy(side)).alias("degree")).where("degree > 1") for side, at in sides]
    return parts[0].unionByName(parts[1]).select("sb", "so", "at").distinct()


def compacted(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """``runs`` cut where the path of their source ends."""
    places = ends.groupBy("sb", "so").agg(F.array_sort(F.collect_list("at")).alias("ends"))
    inside = F.filter("ends", lambda at: (at > F.col("sw")) & (at < F.col("sw") + F.col("n")))
    bounds = F.concat(F.array("sw"), F.coalesce(inside, F.array().cast("array<int>")), F.array((F.col("sw") + F.col("n")).cast("int")))
    pieces = F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), lambda at, k: F.struct(at.alias("at"), F.element_at("bounds", k + 2).alias("to")))
    cut = runs.join(places, ["sb", "so"], "left").withColumn("bounds", bounds).withColumn("piece", F.explode(pieces))
    return cut.select("block", (F.col("word") + F.col("piece.at") - F.col("sw")).alias("word"), (F.col("piece.to") - F.col("piece.at")).cast("long").alias("n"), "so", "sb", F.col("piece.at").alias("sw"))


def repeated_spans(texts: DataFrame, k: int = WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """Spans of windows that a document of smaller id holds too: (block, word, n, so, sb, sw).

    One row for each stretch of a block's first document with it: n windows from ``word`` of ``block`` (its
    texts end to end) equal those from word ``sw`` of block ``sb``, in document ``so``, and lie on one path. ``texts``: a table of (block, o, text), as ``_texts`` makes it.
    """
    found = texts.mapInArrow(_sieve(k, seed), "m long, lo long, hi long, block int")
    every = Window.partitionBy("m")
    sieved = written(found.withColumns({"a": F.min("lo").over(every), "b": F.max("hi").over(every)}).where("a <> b").select("m", "block"), "substring-sieve", "zstd")
    removed(texts.sparkSession)

    # The place of a window: its block, its word there, and in the lowest bit whether several documents of the block have it.
    met = _joined(texts, sieved, _edges(k, seed), "left long, right long, o long, place long")
    every = Window.partitionBy("left", "right")
    found = [F.min(F.struct("o", "place")).over(every).alias("source"), F.max("o").over(every).alias("last"), F.max(F.col("place").bitwiseAND(1)).over(every).alias("several")]
    sourced = met.select("*", *found).where("several = 1 or source.o <> last")
    sourced = sourced.withColumns({"own": F.expr("place = source.place"), "loses": F.expr("place & 1 = 1 or o <> source.o")})
    # A block whose only document with an edge is its source loses nothing by it.
    node = [F.when(F.col("own"), F.col(c)).alias(c) for c in ("left", "right")]
    sourced = sourced.where("own or loses").select("place", "loses", F.col("source.o").alias("so"), F.col("source.place").alias("sp"), *node)
    edges = written(sourced, "substring-edges", "zstd")
    removed(sieved)

    of_place = [(F.shiftright(F.col(p), 33).cast("int").alias(b), F.shiftright(F.col(p), 1).bitwiseAND(0xFFFFFFFF).cast("int").alias(w)) for p, b, w in (("place", "block", "word"), ("sp", "sb", "sw"))]
    losing = edges.where("loses").select(*of_place[0], "so", *of_place[1])
    sorted_rows = losing.repartition("block").sortWithinPartitions("block", "word")
    runs = written(sorted_rows.mapInArrow(_runs, "block int, word int, so long, sb int, sw int, n long"), "substring-runs", "zstd")
    removed(texts.sparkSession)
    ends = written(path_ends(edges.where("left is not null").select("left", "right", *of_place[1], "so")), "substring-ends")
    removed(edges)
    spans = written(compacted(runs, ends), "substring-spans")
    removed(runs, ends)
    return spans


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """Per row: ``key`` (a whole number), n_words, n_removed and kept_sha256."""
    kind = df.select(key).schema[0].dataType.simpleString()
    texts = _texts(df, key, text)
    spans = repeated_spans(texts.select("block", "o", "text"), k)
    cut = _joined(texts, spans, _cut(k), f"id {kind}, n_words long, n_removed long, kept_sha256 string")
    return cut.withColumnRenamed("id", key)
