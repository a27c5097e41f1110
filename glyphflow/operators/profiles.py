"""Curves over tables of points: profiles, line fits, candidate lines, bounds, smoothing and gaps.

These are the long forms of the steps of text-line detection: points are rows, so an
image or a series of any length is grouped and shuffled by Spark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphflow.functions import scores as S
from glyphflow.functions.cuts import half_even, median

from .images import robust_line


def column_profile(points: DataFrame, q: float, image: str = "img") -> DataFrame:
    """(image, x, y, w): the linear quantile of the rows of ink of each column, with weight root of their number."""
    return points.groupBy(image, "x").agg(F.percentile("y", F.lit(q)).alias("y"), F.sqrt(F.count("*")).alias("w"))


def weighted_lines(profile: DataFrame, image: str = "img") -> DataFrame:
    """(image, slope, intercept): the weights apply to residuals, so squares are weighted by w squared; a single column gives its mean."""
    w, x, y = F.col("w") * F.col("w"), F.col("x"), F.col("y")
    s = profile.groupBy(image).agg(*(F.sum(e).alias(n) for n, e in (("s", w), ("sx", w * x), ("sy", w * y), ("sxy", w * x * y), ("sxx", w * x * x))))
    slope = F.coalesce(F.try_divide(F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    return s.select(image, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("s")).alias("intercept"))


def candidate_lines(sampled: DataFrame, points: DataFrame, least: float, tolerance: float, degrees: float = 25.0, image: str = "img") -> DataFrame:
    """(image, xa, xb, slope, inliers): the lines through two points of ``sampled`` at least ``least`` columns apart and not too steep, and how many of all ``points`` they meet.

    ``sampled`` holds a bounded number of points of an image (see ``spread_points``), ``points`` all of them.
    """
    a, b = sampled.select(image, "x", "y").toDF(image, "xa", "ya"), sampled.select(image, "x", "y").toDF(image, "xb", "yb")
    lines = a.join(b, image).where(F.col("xb") - F.col("xa") >= least)
    lines = lines.withColumn("slope", (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).where(F.abs(F.degrees(F.atan("slope"))) <= degrees)
    near = lines.join(points.select(image, "x", "y"), image).withColumn("r", F.abs(F.col("y") - F.col("ya") - F.col("slope") * (F.col("x") - F.col("xa"))))
    return near.groupBy(image, "xa", "xb", "slope").agg(F.sum((F.col("r") <= tolerance).cast("int")).alias("inliers"))


def spread_points(points: DataFrame, most: int = 80, image: str = "img") -> DataFrame:
    """At most ``most`` points of each image, at even places of their order."""
    w = W.partitionBy(image)
    place, n = F.row_number().over(w.orderBy("x")) - 1, F.count("*").over(w)
    share = lambda k: F.floor(k * F.least(n, F.lit(most)) / n)
    return points.withColumn("_keep", (place == 0) | (share(place) > share(place - 1))).where("_keep").drop("_keep")


def text_bounds(points: DataFrame, width: int, height: int, image: str = "img") -> DataFrame:
    """(image, left, right): columns with ink in 2.5 % of the height, holes of 1 % of the width closed, the ends of runs of at least 1.5 %; null without such a run."""
    least, hole, run = (F.greatest(F.lit(1), half_even(F.lit(v))) for v in (height * 0.025, width * 0.01, width * 0.015))
    ink = points.groupBy(image, "x").agg(F.count("*").alias("n"))
    m = ink.groupBy(image).agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("int"), "n"))).alias("_m"))
    flags = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.try_element_at("_m", x), F.lit(0)) >= least)
    closed = S.bound(flags, lambda f: S.boolean_runs(S.close_holes(f, max(1, round(width * 0.01)))))
    m = m.withColumn("_r", F.filter(closed, lambda r: r["end"] - r["start"] >= run))
    return m.select(image, F.array_min(F.transform("_r", lambda r: r["start"])).alias("left"), F.array_max(F.transform("_r", lambda r: r["end"])).alias("right"))


def running_median(rows: DataFrame, value: str, by: list[str], order: list[str], radius: int, name: str = "smooth") -> DataFrame:
    """The median of the values around each row, fewer at the ends."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-radius, radius)
    return rows.withColumn(name, median(F.collect_list(value).over(w)))


def filled_gaps(rows: DataFrame, value: str | Column, by: list[str], order: list[str], name: str = "filled") -> DataFrame:
    """Missing values from their neighbours by row number, the nearest known one beyond the ends."""
    own = W.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("_v", F.col(value) if isinstance(value, str) else value).withColumn("_n", F.row_number().over(own))
    known = F.when(F.col("_v").isNotNull(), F.struct("_n", "_v"))
    out = out.withColumn("_a", F.last(known, True).over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("_b", F.first(known, True).over(own.rowsBetween(0, W.unboundedFollowing)))
    share = (F.col("_n") - F.col("_a._n")) / F.nullif(F.col("_b._n") - F.col("_a._n"), F.lit(0))
    between = F.col("_a._v") + (F.col("_b._v") - F.col("_a._v")) * share
    return out.withColumn(name, F.coalesce(between, F.col("_a._v"), F.col("_b._v"))).drop("_v", "_n", "_a", "_b")


def robust_lines(points: DataFrame, by: list[str], height: str = "h", text_w: str = "text_w", coverage: str = "coverage") -> DataFrame:
    """(by.., slope, intercept, inliers, mad, rmse, confidence) of the points (x, y, w) of each group.

    A group is the points of one curve. One of fewer than two points has no row. ``height``, ``text_w`` and
    ``coverage`` are columns with one value per group.
    """
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    names = ["slope", "intercept", "inliers", "mad", "rmse", "confidence"]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x", "y"], ignore_index=True)
        x, y, w = (frame[c].to_numpy(float) for c in ("x", "y", "w"))
        found = robust_line(x, y, w, *(float(frame[c].iloc[0]) for c in (height, text_w, coverage)))
        rows = [[*frame[by].iloc[0].tolist(), *(found[n] for n in names)]] if found else []
        return pd.DataFrame(rows, columns=[*by, *names])

    return points.select(*by, "x", "y", "w", height, text_w, coverage).groupBy(*by).applyInPandas(fit, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


def reweighted_lines(points: DataFrame, by: list[str], rounds: int = 3, least: float = 2.0) -> DataFrame:
    """A16 in a long form: (by.., slope, intercept, n): a weighted fit, then ``rounds`` times one without the points further than max(least, median + 2.8 median absolute deviations).

    All rounds are windows over one shuffle by group. A round that would leave fewer than 40 % of the points changes nothing.
    """
    own = W.partitionBy(*by)
    rows = points.select(*by, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w"))).withColumn("_in", F.lit(True))

    def fitted(rows: DataFrame) -> DataFrame:
        v, x, y = F.when(F.col("_in"), F.col("w") * F.col("w")), F.col("x"), F.col("y")
        rows = rows.withColumns({n: F.sum(e).over(own) for n, e in (("_s", v), ("_sx", v * x), ("_sy", v * y), ("_sxy", v * x * y), ("_sxx", v * x * x))})
        rows = rows.withColumn("slope", F.coalesce(F.try_divide(F.col("_s") * F.col("_sxy") - F.col("_sx") * F.col("_sy"), F.col("_s") * F.col("_sxx") - F.col("_sx") * F.col("_sx")), F.lit(0.0)))
        return rows.withColumn("intercept", (F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("_s"))

    for _ in range(rounds):
        inside = lambda e: F.when(F.col("_in"), e)
        far = fitted(rows).withColumn("_far", F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")))
        far = far.withColumn("_middle", F.percentile(inside(F.col("_far")), F.lit(0.5)).over(own))
        far = far.withColumn("_spread", F.percentile(inside(F.abs(F.col("_far") - F.col("_middle"))), F.lit(0.5)).over(own))
        far = far.withColumn("_near", F.col("_in") & (F.col("_far") <= F.greatest(F.lit(least), F.col("_middle") + 2.8 * F.col("_spread"))))
        enough = F.count_if("_near").over(own) >= F.greatest(F.lit(2), F.round(0.4 * F.count_if("_in").over(own)))
        rows = far.withColumn("_enough", enough).select(*by, "x", "y", "w", F.when(F.col("_enough"), F.col("_near")).otherwise(F.col("_in")).alias("_in"))
    return fitted(rows).groupBy(*by).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.count_if("_in").alias("n"))
