"""Operator 2 - near-duplicate embeddings by p-stable hashing.

Vectors are normalised in double precision and bucketed in several tables by
quantised random projections, floor((a.x + b) / w): for the Euclidean distance
of normalised vectors the chance of sharing a bucket depends on the cosine
alone. The number of projections per table grows with the logarithm of the
number of vectors, so that unlike vectors rarely meet; the number of tables is
then what the recall at the threshold asks for.

Buckets are first read with sketches alone: every component in one byte, with
the length of what the rounding took away, which bounds the error of a cosine.
A vector goes on to the exact check of a bucket only if the bound leaves it a
partner there, so whole vectors don't move once per table. The exact cosine
decides every link, in the first table where the pair meets.

Equal vectors are one class from the start. Classes that share a large bucket
are dealt into tiles, so no task holds more than two blocks of ``BLOCK`` vectors
at once and no bucket is cut short. A tile gives the number of links per class
and a spanning forest, never its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component, and so does a vector
without an id; vectors of different lengths do not link; a repeated row is one
more copy; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

WIDTH, RECALL, BLOCK, SEED = 2.0, 0.9995, 512, 20240229
#: Unlike vectors (cosine 0) that a vector may meet per table, on average.
MEETINGS = 64
#: Projections that a task computes at once.
CELLS = 4_000_000
TILE = ("tbl", "code", "dim", "i", "j")


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one projection puts two vectors at this distance into one bucket."""
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections per table and number of tables for ``n`` vectors."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * threshold))
    k = max(4, math.ceil(math.log(max(n, 2) / MEETINGS) / -math.log(far)))
    return k, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square overflows or vanishes.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def bucket_codes(vectors: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(vectors x tables) 64-bit codes of normalised vectors."""
    rng = np.random.default_rng(SEED)
    a, b = rng.standard_normal((vectors.shape[1], k * tables)), rng.uniform(0, WIDTH, k * tables)
    factors = rng.integers(1, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    rows = max(1, CELLS // (k * tables))
    out = [np.empty((0, tables), np.uint64)]
    for start in range(0, len(vectors), rows):
        cells = np.floor((vectors[start : start + rows] @ a + b) / WIDTH).astype(np.int64).reshape(-1, tables, k).astype(np.uint64)
        mixed = (cells * factors).sum(axis=2, dtype=np.uint64)
        out.append(mixed ^ mixed >> np.uint64(29))
    return np.concatenate(out).view(np.int64)


def sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, step and error of normalised vectors: x is bytes * step but for a rest of at most that length."""
    step = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    small = np.rint(x / step[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
    rest = x - small * step[:, None].astype(np.float64)
    return small, step, (np.sqrt((rest * rest).sum(axis=1)) * 1.0001).astype(np.float32)


def possible_partners(small: np.ndarray, step: np.ndarray, error: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold. With x = x' + dx, |x.y - x'.y'| is at most |dx| + |dy| + |dx||dy|; single precision takes its share."""
    x = small.astype(np.float32) * step[:, None]
    slack = error[:, None] + error[None, :] + error[:, None] * error[None, :] + np.float32(1e-4)
    return x @ x.T + slack >= np.float32(threshold)


def forest(pairs: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of these links, as pairs of ids."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in zip(*(p.tolist() for p in pairs), strict=True):
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            out.append((int(ids[a]), int(ids[b])))
    return out


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each of its lists begins (one more for the end)."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list column from a matrix, one list per row."""
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m, pa.int32()), pa.array(values.reshape(-1)))


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted rows with the bounds of their tiles; a tile that goes on in the next batch waits for it."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = np.stack([rows[c].to_numpy() for c in TILE], axis=1)
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        if cuts:
            yield rows.slice(0, cuts[-1]), [0, *cuts]
        held = rows.slice(cuts[-1]) if cuts else rows
    if held is not None and len(held):
        yield held, [0, len(held)]


def _other_block(block: np.ndarray) -> np.ndarray | bool:
    """Pairs that a tile answers for: those across its two blocks, or all of its only block."""
    return block[:, None] != block[None, :] if (block != block[0]).any() else True


def _tile_links(x: np.ndarray, ids: np.ndarray, copies: np.ndarray, block: np.ndarray, earlier: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(a, b, 0) for links of a forest and (a, -1, links) for the counts of one tile; ``earlier`` holds the codes of the tables before."""
    close = np.triu(x @ x.T >= threshold, 1) & _other_block(block)
    a, b = np.nonzero(close)
    for codes in earlier.T:
        fresh = codes[a] != codes[b]
        a, b = a[fresh], b[fresh]
    if not len(a):
        return []
    count = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    return [(*e, 0) for e in forest((a, b), ids)] + [(int(ids[k]), -1, int(count[k])) for k in np.flatnonzero(count)]


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Per vector: ``key``, n_links, component_id (least id reachable) and kept (id is component_id)."""
    all_rows = df.select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(sound & F.col("id").isNotNull(), F.lit(False))
    # Equal vectors are told by 128 bits of hash, so that the rows' vectors need not be sorted to find their class.
    marks = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2")]
    classes = all_rows.where(sound).groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.select("*", *marks), "vector-classes")
    n = classes.count()
    plan = table_plan(n, threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = _rows(pa.chunked_array([batch.column("embedding")]))
            ids, sizes = batch.column("rep").to_numpy(), np.diff(bounds)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = unit(values[bounds[own][:, None] + np.arange(size)].astype(np.float64))
                small, step, error = sketches(x)
                columns = [pa.array(ids[own]), pa.array(np.full(len(own), size, np.int32)), _lists(small), pa.array(step), pa.array(error), _lists(bucket_codes(x, *plan) ^ int(size))]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "dim", "small", "step", "error", "codes"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_tiles(batches):
            (values, at), block, step, error = _rows(rows["small"]), *(rows[c].to_numpy() for c in ("block", "step", "error"))
            keep = np.zeros(len(rows), bool)
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1:
                    close = possible_partners(values[at[a] : at[b]].reshape(b - a, -1), step[a:b], error[a:b], threshold) & _other_block(block[a:b])
                    close &= ~np.eye(b - a, dtype=bool)
                    keep[a:b] = close.any(axis=1)
            yield from rows.select(["rep", *TILE, "block"]).filter(pa.array(keep)).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _whole_tiles(batches):
            (values, at), (codes, code_at), ids, copies, block = _rows(rows["embedding"]), _rows(rows["earlier"]), *(rows[c].to_numpy() for c in ("rep", "copies", "block"))
            out: list[tuple[int, int, int]] = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1:
                    x, earlier = values[at[a] : at[b]].reshape(b - a, -1), codes[code_at[a] : code_at[b]].reshape(b - a, -1)
                    out += _tile_links(unit(x.astype(np.float64)), ids[a:b], copies[a:b], block[a:b], earlier, threshold)
            found = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T.copy()], ["a", "b", "n"])

    def tiled(rows: DataFrame) -> DataFrame:
        return rows.repartition(*TILE).sortWithinPartitions(*TILE)

    placed = written(classes.select("rep", "embedding").mapInArrow(place, "rep long, dim int, small array<tinyint>, step float, error float, codes array<long>"), "vector-buckets")
    own = placed.select("rep", "dim", F.posexplode("codes").alias("tbl", "code"))
    shared = own.groupBy("tbl", "code").agg(F.count("*").alias("m")).where("m > 1").withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = own.join(shared, ["tbl", "code"]).withColumn("block", F.pmod(F.xxhash64("rep", "tbl"), "g").cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = other.select("rep", "tbl", "code", "dim", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sketched = tiled(dealt.join(placed.select("rep", "small", "step", "error"), "rep"))
    near = written(sketched.mapInArrow(candidates, "rep long, tbl int, code long, dim int, i int, j int, block int"), "vector-candidates")
    before = placed.select("rep", "codes")
    exact = near.join(classes.select("rep", "embedding", "copies"), "rep").join(before, "rep").withColumn("earlier", F.slice("codes", F.lit(1), F.col("tbl"))).drop("codes")
    found = written(tiled(exact).mapInArrow(links, "a long, b long, n long"), "vector-links")

    counts = found.where("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b <> -1").select("a", "b")).select(F.col("id").alias("rep"), "component")
    by_class = classes.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = all_rows.where(sound).select("id", *marks).join(by_class, ["h1", "h2"])
    out = [F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept")]
    alone = all_rows.where(~sound).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.select(*out).unionByName(alone)
