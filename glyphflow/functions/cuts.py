"""Column expressions on cut positions and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to even."""
    return F.bround(x, 0).cast("int")


def pairs(values: Column) -> Column:
    """array<struct<start, end>> of neighbours of a sorted array."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def gaps(values: Column) -> Column:
    return F.transform(pairs(values), lambda p: p["end"] - p["start"])


def predicted_length(cuts: Column, columns: Column) -> Column:
    """Cuts + 1, or 0 without columns."""
    return F.when(columns > 0, F.size(cuts) + 1).otherwise(0)


def cuts_text(cuts: Column, values: Column) -> Column:
    """``position:score`` with three decimals, joined by blanks."""
    return F.array_join(F.transform(cuts, lambda c: F.format_string("%d:%.3f", c, F.get(values, c).cast("double"))), " ")


def map_boundary(position: Column, source: Column, target: Column) -> Column:
    """A boundary of an input of width ``source`` in a score array of width ``target``, within 0..target."""
    return F.when(source > 0, F.greatest(F.lit(0), F.least(target, half_even(position * target / source)))).otherwise(F.lit(0))


def map_cut(position: Column, source: Column, target: Column) -> Column:
    """A cut column (its centre) as a boundary of the score array, within 1..target-1; 0 for a width below 2."""
    place = half_even((position + 0.5) * target / F.nullif(source, F.lit(0)))
    return F.when((source > 0) & (target > 1), F.greatest(F.lit(1), F.least(target - 1, place))).otherwise(F.lit(0))


def _window(width: Column, crop: tuple[int, int]) -> tuple[Column, Column]:
    """Where the scored part of an input begins and ends if ``crop`` columns are cut off left and right."""
    left = F.least(F.lit(max(0, crop[0])), F.greatest(width - 1, F.lit(0)))
    return left, F.greatest(left + 1, width - max(0, crop[1]))


def input_to_scores(position: Column, width: Column, steps: Column, crop: tuple[int, int] = (0, 0)) -> Column:
    """A boundary of the input as a boundary of the scores of its cropped part, within 0..steps."""
    left, right = _window(width, crop)
    place = half_even((position - left) * steps / (right - left))
    return F.when((width > 0) & (steps > 0), F.greatest(F.lit(0), F.least(steps, place))).otherwise(F.lit(0))


def scores_to_input(boundary: Column, width: Column, steps: Column, crop: tuple[int, int] = (0, 0)) -> Column:
    """A boundary of the scores as a boundary of the whole input, within 0..width."""
    left, right = _window(width, crop)
    place = half_even(left + boundary * (right - left) / F.nullif(steps, F.lit(0)))
    return F.when((width > 0) & (steps > 0), F.greatest(F.lit(0), F.least(width, place))).otherwise(F.lit(0))


def central_span(start: Column, end: Column, fraction: float, least: int = 1) -> Column:
    """struct<start, end>: the central part of an interval, inside it, of at least ``least``."""
    width = end - start
    part = F.greatest(F.lit(1), F.least(width, F.greatest(F.lit(least), half_even(width * F.lit(fraction)))))
    first = F.greatest(start, F.least(end - part, half_even((start + end) * 0.5 - part * 0.5)))
    whole = (width <= 1) | F.lit(fraction >= 1.0)
    return F.when(whole, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.struct(first.alias("start"), (first + part).alias("end")))


def median(values: Column) -> Column:
    """The middle of a numeric array, the mean of the middle two; null if empty."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)


def typical_width(cuts: Column, left: Column, right: Column) -> Column:
    """The median positive gap of neighbouring cuts, else the whole width."""
    return F.coalesce(median(F.filter(gaps(cuts), lambda g: g > 0)), F.greatest(right - left, F.lit(0)).cast("double"))


def promote_edges(cuts: Column, left: Column, right: Column, mode: str = "auto", ratio: float = 0.45, least: int = 2) -> Column:
    """struct<left, right, cuts>: outer cuts become the bounds of the text (off, on, or auto: if both edge intervals are narrow)."""
    kept = F.filter(F.array_sort(F.array_distinct(cuts)), lambda c: (c > left) & (c < right))
    return F.get(F.transform(F.array(kept), lambda inner: _promoted(inner, left, right, mode, ratio, least)), F.lit(0))


def _promoted(inner: Column, left: Column, right: Column, mode: str, ratio: float, least: int) -> Column:
    as_is = F.struct(left.alias("left"), right.alias("right"), inner.alias("cuts"))
    if mode == "off":
        return as_is
    promoted = F.struct(F.get(inner, F.lit(0)).alias("left"), F.get(inner, F.size(inner) - 1).alias("right"), F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))).alias("cuts"))
    if mode == "on":
        return F.when(F.size(inner) < 2, as_is).otherwise(promoted)
    typical = typical_width(inner, left, right)
    limit = F.greatest(F.lit(float(least)), typical * ratio)
    narrow = (typical > 0) & (F.get(inner, F.lit(0)) - left <= limit) & (right - F.get(inner, F.size(inner) - 1) <= limit)
    return F.when((F.size(inner) >= 2) & narrow, promoted).otherwise(as_is)


def has_ink(interval: Column, ink: Column, height: Column, steps: Column, least_columns: float = 0.035, least_pixels: float = 0.003, crop: tuple[int, int] = (0, 0)) -> Column:
    """Whether an interval of ``steps`` score columns has ink; ``ink`` counts the foreground of each image column.

    Enough columns with at least 2.5 % of the height, or enough pixels, are ink; an interval without image columns has none.
    """
    w = F.size(ink)
    left, right = scores_to_input(interval["start"], w, steps, crop), scores_to_input(interval["end"], w, steps, crop)
    own = F.slice(ink, left + 1, F.greatest(right - left, F.lit(0)))
    least = F.greatest(F.lit(1), half_even(height * 0.025))
    columns, pixels = F.size(F.filter(own, lambda n: n >= least)), F.aggregate(own, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(right > left, (columns / (right - left) >= least_columns) | (pixels / ((right - left) * height) >= least_pixels)).otherwise(False)


def trim_empty_edges(intervals: Column, has_ink: Column) -> Column:
    """Intervals without ink go at both ends; ``has_ink`` is the array of flags beside them."""
    first, last = F.array_position(has_ink, F.lit(True)), F.array_position(F.reverse(has_ink), F.lit(True))
    kept = F.greatest(F.size(intervals) - first + 1 - last + 1, F.lit(0)).cast("int")
    return F.when(first > 0, F.slice(intervals, F.greatest(first, F.lit(1)).cast("int"), kept)).otherwise(F.slice(intervals, 1, 0))


def merge_narrow_start(intervals: Column, least: int) -> Column:
    """A first interval narrower than ``least`` joins the next, until wide enough."""
    one = lambda a, b: F.struct(F.least(a["start"], b["start"]).alias("start"), F.greatest(a["end"], b["end"]).alias("end"))

    def step(done: Column, x: Column) -> Column:
        head = F.get(done, F.lit(0))
        join = (F.size(done) == 1) & (head["end"] - head["start"] < least)
        return F.when(join, F.array(one(head, x))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(intervals, F.array().cast("array<struct<start:int,end:int>>"), step)
