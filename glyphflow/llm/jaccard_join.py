"""Operator 8 - n-gram Jaccard join, size-aware, with a heavy-light split.

Two texts link when their shingle sets have 100 * intersection >= percent *
union. Equal sets are one class from the start. The classes are split by size:

* light sets (at most x shingles) enumerate their subsets of each size that an
  overlap at the threshold can have; two light sets that link share one;
* heavy sets scan inverted lists. Shingles are ordered from rare to frequent
  (the shingles that are frequent within blocks of texts come last, the rest by
  hash), and a set looks up only its first n - ceil(t n) + 1 of them: two sets
  that link share one of these. Light sets near the boundary are listed too.

x is chosen by cost: subsets to enumerate against list entries to scan, from the
measured sizes and frequencies.

A list is cut where the sorted sizes of its members leave a gap that no link can
span, and of lists with the same members one is kept. Then in two steps:

* lists of at most ``SMALL`` members give all their pairs, longer ones a pair of
  each member with one lead, the first of most of its lists: linear in the
  entries. Groups of near copies become components here.
* longer lists that still hold several components are compared in tiles of
  bounded size, every pair of members from different components. Sizes and parity
  sketches (an exact lower bound of the symmetric difference, of two to four
  cells a shingle) leave hardly more than the pairs that link. A first round
  emits per tile a forest over the components, closest pairs first; the last
  round emits every pair that is left.

Every pair that is emitted is checked on its whole sets. Pairs within one
component need no check: the result is the components and the verified links
that span them. No list is cut short.

Defined cases: null texts and texts without a word have an empty set and link
with nothing, as do rows without an id; repeated rows of one id are copies of
each other; ties take the least id; very long texts are read whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import only, written
from .shingles import mix, shingle_sets

#: Shingles that count as frequent: at most so many, seen so often in a block of texts.
FREQUENT, IN_BLOCK, BLOCK_SHINGLES = 1 << 18, 4, 1 << 21
#: The largest boundary that is weighed, and the members of a block of a tile.
MOST_LIGHT, BLOCK = 20, 512
#: Lists of at most so many members give all their pairs.
SMALL = 8
#: Lists with more members than ``DEAL`` are dealt over tasks; a task holds back at most ``HELD`` members of a list.
DEAL, HELD = 16_384, 65_536
#: Pairs that a task compares at once.
AT_ONCE = 1 << 18
#: Ids up to this number are sent to all executors (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Texts that a task holds as Python objects at once.
SLICE_ROWS = 2048
WORDS = 4
#: Rounds that emit a forest per tile before the one that emits all pairs left.
FORESTS = 1
_MARK = np.uint64(0xD6E8FEB86659FD93)


def least_overlap(n: int, percent: int) -> int:
    """The shingles of a set of n that any set linked with it must have."""
    return -(-percent * n // 100)


def subset_sizes(n: int, percent: int) -> range:
    return range(least_overlap(n, percent), n + 1)


def pair_overlap(a: int, b: int, percent: int) -> int:
    """The overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def light_boundary(sizes: dict[int, int], entries_per_list: float, percent: int) -> int:
    """The x of least cost: subsets of sets up to x, list entries of sets above."""
    subsets = {n: c * sum(math.comb(n, s) for s in subset_sizes(n, percent)) for n, c in sizes.items()}
    scans = {n: c * (n - least_overlap(n, percent) + 1) * (1 + entries_per_list) for n, c in sizes.items()}
    return min(range(MOST_LIGHT + 1), key=lambda x: (sum(v for n, v in subsets.items() if n <= x) + sum(v for n, v in scans.items() if n > x), x))


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of two to four cells a shingle, 64 * WORDS cells at least.

    Two sketches differ in at most |A xor B| cells, at any common size.
    """
    cells = max(64 * WORDS, 1 << (2 * len(shingles) - 1).bit_length())
    places = (shingles >> np.uint64(5)).astype(np.int64) & (cells - 1)
    return np.packbits((np.bincount(places, minlength=cells) & 1).astype(np.uint8), bitorder="little")


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch with ``size`` bytes."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def _close(p: np.ndarray, q: np.ndarray, total: int, percent: int) -> bool:
    """Whether sets with these sketches and this sum of sizes may link."""
    size = min(len(p), len(q))
    differ = int(np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum())
    return total - differ >= 2 * pair_overlap(total, 0, percent)


def _fingerprint(s: np.ndarray) -> int:
    """The class of a set."""
    return int(mix(mix(s ^ _MARK).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _summary(df: DataFrame, k: int) -> DataFrame:
    """Per text: id, n, set fingerprint, bitmap; and the shingles frequent in a block of texts with their counts."""
    bits = [f"b{i}" for i in range(WORDS)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            nonlocal held, size
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often, held, size = counts >= IN_BLOCK, [], 0
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, *[none] * WORDS, pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64)), pa.nulls(len(none), pa.binary())], names=["id", "n", "cls", *bits, "shingle", "c", "sketch"])

        for batch in _slices(batches):
            n, cls, sketches = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                cls.append(_fingerprint(s))
                sketches.append(_sketch(s))
                held.append(s)
                size += len(s)
                if size >= BLOCK_SHINGLES:
                    yield frequent()
            if n:
                none, maps = pa.nulls(len(n), pa.int64()), np.stack([_folded(x, 8 * WORDS).view(np.int64) for x in sketches])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), *(pa.array(maps[:, i]) for i in range(WORDS)), none, none, pa.array([x.tobytes() for x in sketches], pa.binary())], names=["id", "n", "cls", *bits, "shingle", "c", "sketch"])
        yield frequent()

    return df.mapInArrow(scan, "id long, n long, cls long, " + ", ".join(f"{b} long" for b in bits) + ", shingle long, c long, sketch binary")


def _listed(df: DataFrame, k: int, percent: int, x: int, frequent: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(key, part, cls, n): the subsets and list entries of each class, once per task.

    ``frequent`` is sorted from frequent to rare; the list of ``frequent[i]`` is dealt into ``parts[i]``, 1 meaning not at all.
    """
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a set and into how many parts their lists are dealt."""
        n, out = len(s), []
        if n <= x:
            marks = mix(s ^ _MARK)
            for size in subset_sizes(n, percent):
                picks = np.array(list(combinations(range(n), size)))
                out.append(mix(marks[picks].sum(axis=1, dtype=np.uint64) + np.uint64(size)))
            if n < least_overlap(x + 1, percent):
                own = np.concatenate(out)
                return own, np.ones(len(own), np.int64)
        head = n - least_overlap(n, percent) + 1
        dealt = np.ones(n, np.int64)
        if len(values):
            place = np.minimum(np.searchsorted(values, s), len(values) - 1)
            known = values[place] == s
            last = by_value[place[known]]
            order = np.argsort(-last, kind="stable")
            s = np.concatenate([s[~known], s[known][order]])
            dealt = np.concatenate([dealt[: n - len(last)], parts[last[order]]])
        subsets = sum(map(len, out))
        return np.concatenate([*out, s[:head]]), np.concatenate([np.ones(subsets, np.int64), dealt[:head]])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        seen: set[int] = set()
        for batch in _slices(batches):
            own, part, classes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                if len(s):
                    cls = _fingerprint(s)
                    if cls not in seen:
                        seen.add(cls)
                        found, dealt = keys(s)
                        own.append(found)
                        part.append(np.where(dealt > 1, cls % dealt, -1))
                        classes.append(np.full(len(found), cls, np.int64))
                        sizes.append(np.full(len(found), len(s), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (part, classes, sizes))], names=["key", "part", "cls", "n"])

    return df.mapInArrow(emit, "key long, part long, cls long, n long")


_LISTS = pa.schema([("list", pa.int64()), ("same", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("lead", pa.int64()), ("lead_n", pa.int64()), ("few", pa.list_(pa.int64()))])


def _members(names: np.ndarray, same: np.ndarray, cls: np.ndarray, n: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    """A row for each member of long lists; ``lead``: the place of its list's lead."""
    columns = [*(pa.array(c.view(np.int64)) for c in (names, same, cls, n, cls[lead], n[lead])), pa.nulls(len(cls), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, schema=_LISTS)


def _cut(key: np.ndarray, cls: np.ndarray, n: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Whole lists, cut where sizes leave a gap: one row for a list of at most SMALL members, else one for each member."""
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
    key, cls, n = key[fresh], cls[fresh], n[fresh]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (n[:-1] * 100 < percent * n[1:])]))
    sizes = np.diff(np.append(first, len(cls)))
    names = mix(key[first].view(np.uint64) ^ mix(cls[first].view(np.uint64)))
    same = mix(np.add.reduceat(mix(cls.view(np.uint64) ^ _MARK), first) + sizes.astype(np.uint64))
    run = np.repeat(np.arange(len(first)), sizes)
    little = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    if len(little):
        inside = (sizes[run] > 1) & (sizes[run] <= SMALL)
        few = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[little])]), pa.int32()), pa.array(cls[inside]))
        none = pa.nulls(len(little), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(names[little].view(np.int64)), pa.array(same[little].view(np.int64)), none, none, none, none, few], schema=_LISTS)
    at = np.flatnonzero(sizes[run] > SMALL)
    if len(at):
        place = np.full(len(first), -1)
        heads = np.flatnonzero(sizes > SMALL)
        place[heads] = np.concatenate([[0], np.cumsum(sizes[heads])[:-1]])
        yield _members(names[run[at]], same[run[at]], cls[at], n[at], place[run[at]])


def _lists(percent: int):
    """Over (key, part, n, cls), sorted: the lists.

    Equal ``same`` means equal members. A list that is dealt over tasks, or too long to hold, is named by its
    key and given as it comes, each batch with a lead of its own.
    """

    def loose(key: np.ndarray, part: np.ndarray, n: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        return _members(key, key, cls, n, np.repeat(first, np.diff(np.append(first, len(key)))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        long = None
        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "part", "n", "cls"), strict=True)]
            dealt = rows[1] >= 0
            if dealt.any():
                yield loose(*(r[dealt] for r in rows))
                rows = [r[~dealt] for r in rows]
            key = rows[0]
            if long is not None and (own := key == long).any():
                yield loose(*(r[own] for r in rows))
                rows = [r[~own] for r in rows]
                key = rows[0]
            last = int(np.searchsorted(key == key[-1], True)) if len(key) else 0  # where the last list begins
            if last:
                yield from _cut(key[:last], rows[3][:last], rows[2][:last], percent)
            held = [r[last:] for r in rows]
            if len(held[0]) > HELD:
                long = int(held[0][0])
                yield loose(*held)
                held = [h[:0] for h in held]
        if len(held[0]):
            yield from _cut(held[0], held[3], held[2], percent)

    return scan


def _can_link(percent: int):
    """Over (a, b, pn, qn, ps, qs): the pairs that sizes and sketches allow."""

    def keep(row) -> bool:
        fits = min(row.pn, row.qn) * 100 >= percent * max(row.pn, row.qn)
        return fits and _close(np.frombuffer(row.ps, np.uint8), np.frombuffer(row.qs, np.uint8), row.pn + row.qn, percent)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[[keep(r) for r in frame.itertuples(index=False)], ["a", "b"]] if len(frame) else frame[["a", "b"]]

    return scan


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs of classes (a, b) that sizes and sketches allow."""
    own = classes.select("cls", "n", "sketch")
    sides = pairs.join(own.toDF("a", "pn", "ps"), "a").join(own.toDF("b", "qn", "qs"), "b").select("a", "b", "pn", "qn", "ps", "qs")
    return sides.mapInPandas(_can_link(percent), "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs of classes (a, b) whose whole sets link; ``pairs`` is a written table."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    needed = written(classes.join(needed, "cls").select(F.col("rep").alias("id"), "cls"), "jaccard-needed")
    few = needed.count() <= BROADCAST_IDS

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in _slices(batches):
            rows = list(shingle_sets(batch.column(1).to_pylist(), k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))], names=["cls", "shingles"])

    own = texts.join(F.broadcast(needed) if few else needed, "id").select("cls", "text").mapInArrow(sets, "cls long, shingles array<long>")
    own = written(own, "jaccard-sets")
    left, right = own.toDF("a", "left"), own.toDF("b", "right")
    overlap, total = F.size(F.array_intersect("left", "right")), F.size("left") + F.size("right")
    return pairs.join(left, "a").join(right, "b").where(overlap >= F.ceil(total * percent / (100 + percent))).select("a", "b")


def _close_pairs(n: np.ndarray, sketches: list[np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of places (p, q) the sketches allow, and the share of cells (of both sizes) in which they differ."""
    words = np.array([len(s) // 8 for s in sketches])
    size, total = np.minimum(words[p], words[q]), n[p] + n[q]
    differ = np.zeros(len(p), np.int64)
    for w in np.unique(size).tolist():
        pairs = np.flatnonzero(size == w)
        used, places = np.unique(np.concatenate([p[pairs], q[pairs]]), return_inverse=True)
        table = np.stack([_folded(sketches[i], 8 * w) for i in used.tolist()]).view(np.uint64)
        left, right, step = places[: len(pairs)], places[len(pairs) :], max(1, (AT_ONCE << 2) // w)
        for a in range(0, len(pairs), step):
            differ[pairs[a : a + step]] = np.bitwise_count(table[left[a : a + step]] ^ table[right[a : a + step]]).sum(axis=1, dtype=np.int64)
    return total - differ >= 2 * -(-total * percent // (100 + percent)), differ / total


def _forest(tile: np.ndarray, ca: np.ndarray, cb: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the pairs that make a spanning forest over the components of each tile, closest first."""
    picked, root, now = [], {}, -1

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    order = np.lexsort((far, tile))
    for at, t, a, b in zip(order.tolist(), tile[order].tolist(), ca[order].tolist(), cb[order].tolist(), strict=True):
        if t != now:
            root, now = {}, t
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            picked.append(at)
    return np.array(picked, np.int64)


def _cross_pairs(percent: int, forest: bool):
    """Over sorted tiles of list members: pairs from different components that may link, all of them or a forest per tile."""
    names = ["list", "i", "j"]
    bits = [f"b{i}" for i in range(WORDS)]

    def pairs(rows: pd.DataFrame, tile: np.ndarray) -> pd.DataFrame:
        cls, comp, n, block, cross = (rows[c].to_numpy() for c in ("cls", "comp", "n", "block", "cross"))
        maps = rows[bits].to_numpy(np.int64).view(np.uint64)
        p, q, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        while step < len(rows) and (near := tile[step:] == tile[:-step]).any():
            at = np.flatnonzero(near & (comp[step:] != comp[:-step]) & (~cross[step:] | (block[step:] != block[:-step])))
            at = at[np.minimum(n[at], n[at + step]) * 100 >= percent * np.maximum(n[at], n[at + step])]
            total = n[at] + n[at + step]
            differ = np.bitwise_count(maps[at] ^ maps[at + step]).sum(axis=1, dtype=np.int64)
            at = at[total - differ >= 2 * -(-total * percent // (100 + percent))]
            p.append(at)
            q.append(at + step)
            step += 1
        p, q = np.concatenate(p), np.concatenate(q)
        near, far = _close_pairs(n, [np.frombuffer(x, np.uint8) for x in rows["sketch"]], p, q, percent)
        p, q, far = p[near], q[near], far[near]
        if forest:
            at = _forest(tile[p], comp[p], comp[q], far)
            p, q, far = p[at], q[at], far[at]
        out = {"a": np.minimum(cls[p], cls[q]), "b": np.maximum(cls[p], cls[q]), "ca": np.minimum(comp[p], comp[q]), "cb": np.maximum(comp[p], comp[q]), "far": far}
        return pd.DataFrame(out).drop_duplicates(["a", "b"])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(rows: pd.DataFrame, tile: np.ndarray) -> Iterator[pd.DataFrame]:
            """Whole tiles, some at a time, so that few pairs are held."""
            first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            sizes = np.diff(np.append(first, len(tile)))
            group = np.cumsum(sizes * (sizes - 1) // 2) // AT_ONCE
            cuts = first[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))].tolist()
            for a, b in zip(cuts, [*cuts[1:], len(tile)], strict=True):
                yield pairs(rows.iloc[a:b], tile[a:b])

        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(rows):
                continue
            keys = rows[names].to_numpy()
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
            cut = int(np.flatnonzero(new)[-1])
            if cut:
                yield from done(rows.iloc[:cut], np.cumsum(new)[:cut])
            held = rows.iloc[cut:]
        if held is not None and len(held):
            yield from done(held, np.zeros(len(held), np.int64))

    return scan


def _left(members: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b): pairs of classes of different components that share a long list and may link; with ``forest`` the closest for two components."""
    named = members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = named.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    mixed = mixed.select("list", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    dealt = named.join(mixed, "list").withColumn("block", F.pmod(F.xxhash64("cls"), "g").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("list", "cls", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiles = dealt.join(classes.drop("rep"), "cls").withColumn("cross", F.col("i") != F.col("j")).repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    found = tiles.mapInPandas(_cross_pairs(percent, forest), "a long, b long, ca long, cb long, far double")
    if not forest:
        return found.select("a", "b").distinct()
    return found.groupBy("ca", "cb").agg(F.min(F.struct("far", "a", "b")).alias("top")).select("top.a", "top.b")


def _frequent(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles by falling count, at most FREQUENT, and their counts."""
    often = written(summary.where("shingle is not null").groupBy("shingle").agg(F.sum("c").alias("c")), "jaccard-frequent")
    level = F.floor(F.log2("c") * 4).cast("int")
    least, room = 4 * 3, FREQUENT
    for row in sorted(often.groupBy(level.alias("e")).count().where(F.col("e") >= least).collect(), reverse=True):
        if row["count"] > room:
            least = row["e"] + 1
            break
        room -= row["count"]
    known = often.where(level >= least).toPandas().sort_values(["c", "shingle"], ascending=[False, True])
    return known["shingle"].to_numpy(np.int64).view(np.uint64), known["c"].to_numpy(np.int64)


def jaccard_links(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """The links found, and the members of each class of equal sets.

    Links: (a, b), least ids of two classes, verified on their whole sets. They span every component;
    of the links inside a component not all are listed. Members: ``key``, n_shingles, class_id (least id of
    the class; of empty sets and null ids the id itself) and component_id.
    """
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    bodies = texts.select("id", F.col("text").cast("binary").alias("text"))
    summary = written(_summary(bodies, k), "jaccard-summary")
    docs = summary.where("shingle is null").drop("shingle", "c")
    with_words = docs.where("n > 0 and id is not null")
    bits = [f"b{i}" for i in range(WORDS)]
    classes = written(with_words.groupBy("cls").agg(F.min("id").alias("rep"), *(F.min(c).alias(c) for c in ("n", *bits, "sketch"))), "jaccard-classes")

    frequent, counts = _frequent(summary)
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= MOST_LIGHT).groupBy("n").count().collect()}
    x = light_boundary(sizes, float(counts.mean()) if len(counts) else 1.0, percent)
    entries = _listed(bodies.where("id is not null"), k, percent, x, frequent, -(-counts // DEAL))
    lists = entries.repartition("key", "part").sortWithinPartitions("key", "part", "n", "cls").mapInArrow(_lists(percent), "list long, same long, cls long, n long, lead long, lead_n long, few array<long>")
    lists = written(lists, "jaccard-lists")

    # All pairs of short lists; of long ones each class with the lead that it shares most lists with.
    short = lists.where("few is not null").groupBy("same").agg(F.first("few").alias("few"))
    short = short.select("few", F.posexplode("few").alias("at", "x")).select("x", F.explode(F.slice("few", F.col("at") + 2, SMALL)).alias("y"))
    long = lists.where("few is null and cls <> lead")
    fits = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent
    shared = long.where(fits).groupBy("cls", "lead").agg(F.count("*").alias("lists"))
    best = shared.groupBy("cls").agg(F.max(F.struct("lists", "lead")).alias("top")).select(F.col("cls").alias("x"), F.col("top.lead").alias("y"))
    pairs = short.union(best).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tested = written(_possible(pairs, classes, percent), "jaccard-pairs")
    links = written(_verified(tested, classes, bodies, k, percent), "jaccard-links")

    one = lists.where("few is null").groupBy("same").agg(F.min("list").alias("list"))
    members = written(lists.where("few is null").join(one.select("list"), "list", "left_semi").select("list", "cls").distinct(), "jaccard-members")
    for level in range(FORESTS + 1):
        labels = components(links).select(F.col("id").alias("cls"), F.col("component").alias("comp"))
        found = written(_left(members, labels, classes, percent, level < FORESTS), "jaccard-left")
        if found.isEmpty():
            break
        rest = written(found.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        links = written(links.unionByName(_verified(rest, classes, bodies, k, percent)), "jaccard-links")
        tested = tested.unionByName(rest)
    else:
        labels = components(links).select(F.col("id").alias("cls"), F.col("component").alias("comp"))

    of_class = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least_id = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = of_class.join(least_id, "comp").select("cls", F.col("rep").alias("class_id"), "component_id")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("cls"))
    out = docs.select("id", "n", own.alias("cls")).join(named, "cls", "left")
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
    reps = classes.select("cls", "rep")
    ends = links.join(reps.toDF("a", "one"), "a").join(reps.toDF("b", "two"), "b").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    return ends, out


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Per row: ``key``, n_shingles and component_id (least key reachable by links)."""
    return jaccard_links(df, key, text, k, percent)[1].drop("class_id")
