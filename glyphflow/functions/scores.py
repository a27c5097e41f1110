"""Column expressions on score arrays: one row per line, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTS = "array<int>"


def indices(values: Column) -> Column:
    """0, 1, ... of an array; none for an empty one."""
    return F.when(F.size(values) > 0, F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)))).otherwise(F.array().cast(INTS))


def sigmoid(values: Column) -> Column:
    return F.transform(values, lambda x: 1 / (1 + F.exp(-x)))


def softmax(values: Column) -> Column:
    """With the largest value subtracted first."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def argmax(values: Column) -> Column:
    """The lowest place of the largest value, from 0."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def collapse(ids: Column) -> Column:
    """Each run of equal neighbours once."""
    return F.filter(ids, lambda v, i: (i == 0) | (v != F.get(ids, i - 1)))


def ids_to_text(ids: Column, alphabet: Column) -> Column:
    """Runs collapse first; then unknown ids go. There is no blank class."""
    return F.array_join(F.filter(F.transform(collapse(ids), lambda v: F.get(alphabet, v)), lambda c: c.isNotNull()), "")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def runs(values: Column) -> Column:
    """array<struct<start, end, value>> of equal neighbours, ends inclusive."""

    def of(v: Column) -> Column:
        starts = F.filter(indices(v), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
        one = lambda s, nxt: F.struct(s.alias("start"), (F.coalesce(nxt, F.size(v)) - 1).cast("int").alias("end"), F.get(v, s).alias("value"))
        return bound(starts, lambda st: F.transform(st, lambda s, k: one(s, F.get(st, k + 1))))

    return bound(values, of)


def boolean_runs(flags: Column) -> Column:
    """array<struct<start, end>> of runs of true, half-open."""
    own = F.filter(runs(flags), lambda r: r["value"])
    return F.transform(own, lambda r: F.struct(r["start"], (r["end"] + 1).alias("end")))


def close_holes(flags: Column, largest: int) -> Column:
    """Gaps of up to ``largest`` between runs of true become true."""

    def filled(own: Column) -> Column:
        holes = F.filter(F.transform(own, lambda r, k: F.struct(r["end"].alias("a"), F.get(own, k + 1)["start"].alias("b"))), lambda h: h["b"].isNotNull() & (h["b"] - h["a"] <= largest))
        return bound(holes, lambda hs: F.transform(flags, lambda f, i: f | F.exists(hs, lambda h: (i >= h["a"]) & (i < h["b"]))))

    return bound(boolean_runs(flags), filled)


def top_k(values: Column, k: int) -> Column:
    """array<struct<value, id>>: the k largest, equal values by rising id; k is clipped to 1..n."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("key"), i.alias("id"), v.alias("value")))
    best = F.slice(F.array_sort(pairs), 1, max(1, k))
    return F.transform(best, lambda x: F.struct(x["value"], x["id"]))


def smooth(values: Column, radius: int) -> Column:
    """Triangular weights radius + 1 - |offset|, renormalised at the ends; short arrays stay."""
    if radius <= 0:
        return values

    def at(i: Column) -> Column:
        near = F.filter(F.sequence(i - radius, i + radius), lambda j: (j >= 0) & (j < F.size(values)))
        weight = lambda j: radius + 1 - F.abs(j - i)
        total = F.aggregate(near, F.lit(0.0), lambda a, j: a + F.get(values, j) * weight(j))
        return total / F.aggregate(near, F.lit(0), lambda a, j: a + weight(j))

    return F.when(F.size(values) <= 2, values).otherwise(F.transform(indices(values), at))


def peaks(values: Column, threshold: Column | float) -> Column:
    """Places with a score of at least the threshold and of both neighbours; all of a plateau qualify."""
    low = F.lit(float("-inf"))
    ok = lambda i: (
        (F.get(values, i) >= threshold)
        & (F.get(values, i) >= F.coalesce(F.get(values, i - 1), low))
        & (F.get(values, i) >= F.coalesce(F.get(values, i + 1), low))
    )
    return F.filter(indices(values), ok)


def suppress(candidates: Column, values: Column, distance: Column | int) -> Column:
    """Greedy non-maximum suppression: by falling score, later places first on ties; the kept in order."""
    ranked = F.array_sort(F.transform(candidates, lambda i: F.struct((-F.get(values, i)).alias("key"), (-i).alias("minus"))))
    gap = F.lit(distance) if isinstance(distance, int) else distance

    def step(kept: Column, x: Column) -> Column:
        near = F.forall(kept, lambda a: F.abs(a + x["minus"]) >= gap)
        return F.when(near, F.concat(kept, F.array(-x["minus"]))).otherwise(kept)

    return F.array_sort(F.aggregate(ranked, F.array().cast(INTS), step))


def select_cut_peaks(values: Column, threshold: Column | float, distance: Column | int) -> Column:
    return suppress(peaks(values, threshold), values, distance)


def enforce_min_gap(cuts: Column, values: Column, least: int) -> Column:
    """Of two cuts closer than ``least`` the weaker goes, the left one on ties; one pass from the left is exact."""
    if least <= 1:
        return F.array_sort(F.array_distinct(cuts))

    def step(kept: Column, c: Column) -> Column:
        last = F.element_at(kept, -1)
        swap = F.get(values, last) <= F.get(values, c)
        replaced = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(c))
        return F.when(F.size(kept) == 0, F.array(c)).otherwise(F.when(c - F.try_element_at(kept, F.lit(-1)) >= least, F.concat(kept, F.array(c))).otherwise(F.when(swap, replaced).otherwise(kept)))

    return F.aggregate(F.array_sort(F.array_distinct(cuts)), F.array().cast(INTS), step)
