"""Column expressions on glyph spans, dense labels and targets.

Layout, crops, cleaning and the targets of columns are kernels over whole Arrow
batches: all lines of a batch at once, so that a line costs no call of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

IGNORED = -100
SPANS = ArrayType(StructType([StructField("ch", StringType()), StructField("x0", DoubleType()), StructField("x1", DoubleType())]))
CROPS = ArrayType(StructType([StructField("left", IntegerType()), StructField("text", StringType()), StructField("spans", SPANS)]))
CROP_TEXTS = ArrayType(StructType([StructField("left", IntegerType()), StructField("text", StringType())]))
#: Pairs of a crop and a span that are judged at once.
PAIRS = 1 << 21


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, and where each begins and ends (n + 1 places); a null list is empty."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def _lists(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, place in it) of every value."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return own, np.arange(at[-1]) - at[own]


def _made(ch: pa.Array, x0: np.ndarray, x1: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([ch, pa.array(x0), pa.array(x1)], names=["ch", "x0", "x1"])


@F.arrow_udf(SPANS)
def _laid(characters: pa.Array, advance: pa.Array, spacing: pa.Array, word_factor: pa.Array, start: pa.Array, space: pa.Array) -> pa.Array:
    ch, at = _flat(characters)
    plain, own_at = _flat(advance)
    own, i = _places(at)
    base = np.ones(len(own))  # where an advance is missing
    have = i < np.diff(own_at)[own]
    base[have] = np.maximum(1.0, pc.fill_null(plain, 1.0).to_numpy(zero_copy_only=False)[(own_at[own] + i)[have]])
    gaps = pc.equal(ch, space[0]) if len(space) else pc.equal(ch, " ")
    blank = pc.fill_null(gaps, False).to_numpy(zero_copy_only=False)
    inked = pc.fill_null(pc.invert(gaps), False).to_numpy(zero_copy_only=False)
    wide = np.where(blank, np.maximum(1.0, base * _numbers(word_factor)[own]), base)
    apart = inked.copy()
    apart[:-1] &= inked[1:]
    apart &= i + 1 < np.diff(at)[own]
    after = np.where(apart, _numbers(spacing)[own], 0.0)
    # Places add up from left to right, the longest lines first: in step k those with more than k characters are the first ones.
    x0, n = np.empty(len(own)), np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, left = at[:-1][order], n[order]
    x = _numbers(start)[order]
    for k, many in enumerate(np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")):
        here = first[:many] + k
        x0[here] = x = x[:many]
        x = (x + wide[here]) + after[here]
    return _lists(at, _made(ch, x0, np.maximum(x0 + 1, x0 + wide)))


def glyph_layout(characters: Column, advance: Column, spacing: Column, word_factor: Column, start: Column, space: str = " ") -> Column:
    """Spans of the characters of a line: advances add up; spacing goes between characters, not before a space or after the last; spaces are stretched.

    ``advance`` is the array of plain advances beside ``characters``.
    """
    double = lambda c: c.cast("double")
    return _laid(characters, advance.cast("array<double>"), double(spacing), double(word_factor), double(start), F.lit(space))


def _kept_spaces(blank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which spans stay when leading, doubled and trailing spaces go."""
    own, i = _places(at)
    before = np.concatenate([[False], ~blank[:-1]]) & (i > 0)
    inked = np.flatnonzero(~blank)
    last = np.full(len(at) - 1, -1)
    last[own[inked]] = i[inked]  # of several, the last one holds
    return (~blank | before) & (i <= last[own])


def _cut(at: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Where the lists begin and end when only some values stay."""
    return np.concatenate([[0], np.cumsum(keep)])[at]


@F.arrow_udf(SPANS)
def _cleaned(spans: pa.Array, space: pa.Array) -> pa.Array:
    values, at = _flat(spans)
    keep = _kept_spaces(pc.equal(values.field("ch"), space[0]).to_numpy(zero_copy_only=False).astype(bool) if len(space) else np.zeros(0, bool), at)
    return _lists(_cut(at, keep), values.filter(pa.array(keep)))


def clean_spans(spans: Column, space: str = " ") -> Column:
    """No leading, doubled or trailing space."""
    return _cleaned(spans, F.lit(space))


def _cropped(values: tuple[pa.Array, pa.Array, pa.Array], at: np.ndarray, lefts: pa.Array, width: pa.Array, whole: pa.Array, fragment: pa.Array, space: pa.Array, with_spans: bool) -> pa.Array:
    """The crops of lines whose spans (ch, x0, x1) lie one behind another; their spans only if asked for."""
    offers, offer_at = _flat(lefts)
    line, _ = _places(offer_at)
    left, wide, n = offers.to_numpy(zero_copy_only=False).astype(np.int64), _numbers(width)[line], np.diff(at)[line]
    ch, x0, x1 = values[0], _numbers(values[1]), _numbers(values[2])
    blank = pc.equal(ch, space[0]).to_numpy(zero_copy_only=False).astype(bool) if len(space) else np.zeros(0, bool)
    total, parts, good = np.concatenate([[0], np.cumsum(n)]), [], np.zeros(len(line), bool)
    a = 0
    while a < len(line):  # as many crops at once as have PAIRS spans, at least one
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
        pair_at = total[a : b + 1] - total[a]
        own, i = _places(pair_at)
        span = at[line[a:b]][own] + i
        l, r = left[a:b][own].astype(float), (left[a:b] + wide[a:b])[own]
        s0, s1 = x0[span], x1[span]
        seen = np.minimum(s1, r) - np.maximum(s0, l)
        share = seen / np.maximum(1e-6, s1 - s0)
        cut = ((s0 < l) | (s1 > r)) & (share < whole[0].as_py())
        spoilt = (seen > 0) & cut & (share > fragment[0].as_py())
        fine = np.ones(b - a, bool)
        fine[own[spoilt]] = False
        good[a:b] = fine
        keep = (seen > 0) & ~cut & fine[own]
        kept_at = _cut(pair_at, keep)
        keep[keep] = _kept_spaces(blank[span[keep]], kept_at)
        parts.append((span[keep], l[keep], np.diff(_cut(pair_at, keep))))
        a = b
    span, l = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, int) for k in (0, 1))
    counts = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, int)
    kept = ch.take(pa.array(span))
    text_at = np.concatenate([[0], np.cumsum(counts[good])])
    # The kept characters lie one behind another: a crop's text is a stretch of their bytes.
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(kept), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])[text_at]
    texts = pa.Array.from_buffers(pa.string(), len(text_at) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), kept.buffers()[2] or pa.py_buffer(b"")])
    rows = [pa.array(left[good], pa.int32()), texts]
    if with_spans:
        rows.append(_lists(text_at, _made(kept, x0[span] - l, x1[span] - l)))
    return _lists(_cut(offer_at, good), pa.StructArray.from_arrays(rows, names=["left", "text", "spans"][: len(rows)]))


@F.arrow_udf(CROPS)
def _crops(spans: pa.Array, lefts: pa.Array, width: pa.Array, whole: pa.Array, fragment: pa.Array, space: pa.Array) -> pa.Array:
    values, at = _flat(spans)
    return _cropped(tuple(values.field(c) for c in ("ch", "x0", "x1")), at, lefts, width, whole, fragment, space, True)


@F.arrow_udf(CROP_TEXTS)
def _crop_texts(ch: pa.Array, x0: pa.Array, x1: pa.Array, lefts: pa.Array, width: pa.Array, whole: pa.Array, fragment: pa.Array, space: pa.Array) -> pa.Array:
    (characters, at), (starts, _), (ends, _) = _flat(ch), _flat(x0), _flat(x1)
    return _cropped((characters, starts, ends), at, lefts, width, whole, fragment, space, False)


def crops(spans: Column, lefts: Column, width: Column, whole: float = 0.75, fragment: float = 0.25, space: str = " ") -> Column:
    """array<struct<left, text, spans>> of the crops that begin at ``lefts``, as ``crop_spans`` gives each; those that it refuses are left out."""
    return _crops(spans, lefts.cast("array<int>"), width.cast("double"), F.lit(whole), F.lit(fragment), F.lit(space))


def crop_texts(spans: Column, lefts: Column, width: Column, whole: float = 0.75, fragment: float = 0.25, space: str = " ") -> Column:
    """array<struct<left, text>>: ``crops`` without the spans."""
    return _crop_texts(spans["ch"], spans["x0"], spans["x1"], lefts.cast("array<int>"), width.cast("double"), F.lit(whole), F.lit(fragment), F.lit(space))


def crop_spans(spans: Column, left: Column, right: Column, whole: float = 0.75, fragment: float = 0.25, space: str = " ") -> Column:
    """The spans of a crop, shifted but not clipped; null if a cut character is too visible to drop and too hidden to keep."""
    return F.get(crops(spans, F.array(left), right - left, whole, fragment, space), F.lit(0))["spans"]


def spans_text(spans: Column) -> Column:
    return F.array_join(spans["ch"], "")


def _nearest(centre: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The span of each column of a line whose spans may lie in any order."""
    over = (x0 <= centre[:, None]) & (centre[:, None] < x1)
    near = np.abs((x0 + x1) / 2 - centre[:, None]).argmin(axis=1)
    return np.where(over.any(axis=1), over.argmax(axis=1), near)


@F.arrow_udf(ArrayType(IntegerType()))
def _dense(x0: pa.Array, x1: pa.Array, classes: pa.Array, width: pa.Array, space: pa.Array) -> pa.Array:
    start, at = _flat(x0)
    s0, s1, w = _numbers(start), _numbers(_flat(x1)[0]), np.maximum(0, width.to_numpy(zero_copy_only=False).astype(np.int64))
    own, i = _places(at)
    out_at = np.concatenate([[0], np.cumsum(w)])
    line, x = _places(out_at)
    n, inner = np.diff(at), np.flatnonzero(i > 0)
    middle = (s0 + s1) / 2
    mixed = np.zeros(len(n), bool)  # lines whose spans don't go from left to right
    mixed[own[inner[(s0[inner] < s0[inner - 1]) | (s1[inner] < s1[inner - 1]) | (middle[inner] <= middle[inner - 1])]]] = True
    low, high = np.full(len(n), np.inf), np.full(len(n), -np.inf)
    np.minimum.at(low, own, s0)
    np.maximum.at(high, own, s1)
    # From left to right, the first span that ends behind a column covers it, or lies behind the gap that holds it.
    end = np.clip(np.ceil(s1 - 0.5), 0, w[own]).astype(np.int64)
    fill = np.diff(end, prepend=0)
    fill[i == 0] = end[i == 0]
    fill[mixed[own]] = 0
    nothing = len(s0)
    tail = w.copy()
    np.subtract.at(tail, own, fill)
    # Values and their repeats, a line's spans first and then the rest of its columns.
    place = np.concatenate([np.arange(len(s0)) + own, at[1:] + np.arange(len(n))])
    value, times = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    value[place], times[place] = np.concatenate([np.arange(len(s0)), np.full(len(n), nothing)]), np.concatenate([fill, tail])
    span = np.repeat(value, times)
    centre = x + 0.5
    gap = np.flatnonzero(span < nothing)
    gap = gap[s0[span[gap]] > centre[gap]]
    gap = gap[i[span[gap]] > 0]
    nearer = np.abs(middle[span[gap] - 1] - centre[gap]) <= np.abs(middle[span[gap]] - centre[gap])
    span[gap[nearer]] -= 1
    for k in np.flatnonzero(mixed).tolist():
        a, b = out_at[k], out_at[k + 1]
        span[a:b] = at[k] + _nearest(centre[a:b], s0[at[k] : at[k + 1]], s1[at[k] : at[k + 1]])
    span[(centre < low[line]) | (centre >= high[line])] = nothing
    known = pa.concat_arrays([_flat(classes)[0].cast(pa.int32()), pa.array([space[0].as_py() if len(space) else 0], pa.int32())])
    return _lists(out_at, known.take(pa.array(span)))


def dense_labels(spans: Column, alphabet: Column | str, width: Column, space: int = 0) -> Column:
    """The class of each pixel column: the span over its centre, else the nearest span centre (first on ties); space outside the text.

    Of an alphabet that is given as text a class is one search, not one comparison per class.
    """
    place = (lambda c: F.instr(F.lit(alphabet), c)) if isinstance(alphabet, str) else (lambda c: F.array_position(alphabet, c).cast("int"))
    return _dense(spans["x0"], spans["x1"], F.transform(spans["ch"], lambda c: place(c) - 1), width, F.lit(space))


@F.arrow_udf(ArrayType(DoubleType()))
def _projected(x0: pa.Array, x1: pa.Array, width: pa.Array, radius: pa.Array, margins: pa.Array) -> pa.Array:
    start, at = _flat(x0)
    s0, s1, w = _numbers(start), _numbers(_flat(x1)[0]), np.maximum(0, width.to_numpy(zero_copy_only=False).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(w)])
    own, i = _places(at)
    inner = np.flatnonzero(i > 0)
    lines, centres = [own[inner]], [(s1[inner - 1] + s0[inner]) / 2]
    if len(margins) and margins[0].as_py():
        some = np.flatnonzero(np.diff(at) > 0)
        lines, centres = [*lines, some, some], [*centres, s0[at[some]], s1[at[some + 1] - 1]]
    line, cut = np.concatenate(lines), np.rint(np.concatenate(centres) - 0.5).astype(np.int64)
    ok = (cut >= 0) & (cut < w[line])
    line, cut = line[ok], cut[ok]
    out, reach = np.zeros(out_at[-1]), radius[0].as_py() if len(radius) else 0
    for off in range(-reach, reach + 1):
        x = cut + off
        ok = (x >= 0) & (x < w[line])
        np.maximum.at(out, out_at[line[ok]] + x[ok], 1 - abs(off) / (reach + 1.0))
    return _lists(out_at, pa.array(out))


def cut_projection(spans: Column, width: Column, radius: int = 1, margins: bool = False) -> Column:
    """A triangle of height 1 at the middle between neighbouring spans; the largest where they overlap."""
    return _projected(spans["x0"], spans["x1"], width, F.lit(radius), F.lit(margins))


def majority_bins(labels: Column, bins: int, classes: int, least: float = 0.0) -> Column:
    """The most frequent valid label of each of ``bins`` overlapping bins (lowest on ties), or IGNORED below the share."""
    n = F.size(labels)

    def at(i: Column) -> Column:
        a, b = F.floor(i * n / bins).cast("int"), F.ceil((i + 1) * n / bins).cast("int")
        own = F.filter(F.slice(labels, a + 1, b - a), lambda v: (v >= 0) & (v < classes))
        counted = F.transform(F.array_distinct(own), lambda c: F.struct((-F.size(F.filter(own, lambda v: v == c))).alias("minus"), c.alias("c")))
        best = F.array_min(counted)
        return F.when((F.size(own) > 0) & (-best["minus"] / F.size(own) >= least), best["c"]).otherwise(IGNORED)

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at)


def resample_labels(labels: Column, bins: int) -> Column:
    """The label at the centre of each bin."""
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.get(labels, F.least(F.floor((i + 0.5) * n / bins).cast("int"), n - 1)))


def crop_array(values: Column, left: int, right: int) -> Column:
    """Without ``left`` values at the start and ``right`` at the end; an error if nothing is left."""
    n = F.size(values) - left - right
    return F.when(n > 0, F.slice(values, F.lit(left + 1), F.greatest(n, F.lit(0)))).otherwise(F.raise_error(F.lit("the crop is empty")))


def clamp01(values: Column) -> Column:
    return F.transform(values, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def resize_linear(values: Column, size: int) -> Column:
    """Half-pixel centres, clamped at the ends."""
    n = F.size(values)

    def at(i: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), (i + 0.5) * n / size - 0.5))
        a = F.floor(x).cast("int")
        return F.get(values, a) * (1 - (x - a)) + F.get(values, F.least(a + 1, n - 1)) * (x - a)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def resize_nearest(values: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(values, F.floor(i * F.size(values) / size).cast("int")))


def mean_in_interval(values: Column, start: Column, end: Column) -> Column:
    """The mean of values[start:end]."""
    return F.aggregate(F.slice(values, start + 1, end - start), F.lit(0.0), lambda a, x: a + x) / F.nullif(end - start, F.lit(0))
