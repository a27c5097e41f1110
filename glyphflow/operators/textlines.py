"""Text lines over tables: components and candidate lines as rows, and the line taken among them.

``images.baseline_cropped`` does the same inside one pass over pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.operators import images


def _per_image(df: DataFrame, make: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Rows made of each image (line_id, h, w, pixels), after its line_id; an image's rows go out together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                out = make(np.frombuffer(r.pixels, np.uint8).reshape(r.h, r.w))
                out.insert(0, "line_id", r.line_id)
                yield out

    return df.where(F.length("pixels") > 0).select("line_id", "h", "w", "pixels").mapInPandas(run, f"line_id long, {schema}")


def component_rows(masks: DataFrame) -> DataFrame:
    """I8: (line_id, first, area, left, top, w, h, x, bottom, weight, used): the 8-connected components of masks; pixels that aren't 0 are ink.

    ``first`` is the component's first pixel in reading order and names it. Masks without ink or pixels have no rows.
    """
    make = lambda image: images.with_bottoms(images.component_sizes(image != 0)[1], *image.shape)
    return _per_image(masks, make, "first long, area long, left long, top long, w long, h long, x double, bottom long, weight double, used boolean")


def candidate_rows(lines: DataFrame) -> DataFrame:
    """The rows of ``images.line_candidates`` of each image, with ``least``, the ink that it needs."""

    def make(image: np.ndarray) -> pd.DataFrame:
        found = pd.DataFrame(images.line_candidates(image), columns=list(images.CANDIDATE_COLUMNS))
        return found.assign(method=found["method"].astype("Int32"), left=found["left"].astype("Int32"), right=found["right"].astype("Int32"), least=max(4, round(image.size * 0.00005)))

    return _per_image(lines, make, f"{images.CANDIDATE}, least int")


def chosen_lines(candidates: DataFrame, strict: bool = True, max_angle: float = 12.0, line: str = "line_id") -> DataFrame:
    """(line, ok, status, candidates, method, confidence, slope, intercept, top_slope, top_intercept), one row per line.

    As ``images.choose_line``: one aggregation with partial maxima, ties go to the
    first mask and then to the first method, repeated ones to the steepest fall and
    the lowest line. ``method`` is null for a box. Lines without candidates have no row.
    """
    usable = F.col("method").isNotNull() & (F.coalesce(F.col("gap") > 2, F.lit(False)) if strict else F.lit(True))
    confidence = F.least("bottom_confidence", "top_confidence") if strict else F.col("bottom_confidence")
    own = F.struct(confidence.alias("confidence"), (-F.col("mask")).alias("m"), (-F.col("method")).alias("k"), "slope", "intercept", "top_slope", "top_intercept")
    box = F.struct("ink", (-F.col("mask")).alias("m"), "q88", "q02")
    rows = candidates.groupBy(line).agg(
        F.max(F.when(usable, own)).alias("_best"), F.max(F.when(F.col("enough") & F.lit(not strict), box)).alias("_box"),
        F.count(F.when(usable, 1)).alias("candidates"), (F.max("ink") < F.max("least")).alias("_scarce"),
    )
    best, boxed = F.col("_best"), F.col("_box")
    steep = F.abs(F.degrees(F.atan("_best.slope"))) > max_angle
    fine = F.coalesce(best.isNotNull() & ~steep & (F.col("_best.confidence") >= images.SURE), F.lit(False))
    fault = F.when(best.isNull(), "fit_failed").when(steep, "angle_rejected").otherwise("low_confidence")
    status = (
        F.when(fine, "ok").when(boxed.isNotNull(), F.concat(F.lit("baseline_"), fault, F.lit("_bbox_fallback")))
        .when(best.isNotNull(), F.concat(F.lit("strict_lines_"), fault)).when(F.col("_scarce"), "not_enough_foreground").otherwise("baseline_fit_failed")
    )
    level = ~fine & boxed.isNotNull()
    pick = lambda name, value: F.when(level, value).otherwise(F.col(f"_best.{name}")).alias(name)
    method: Column = F.when(~level, -F.col("_best.k")).alias("method")
    return rows.select(
        line, (fine | boxed.isNotNull()).alias("ok"), status.alias("status"), "candidates", method, pick("confidence", F.lit(images.TOP_SURE)),
        pick("slope", F.lit(0.0)), pick("intercept", F.col("_box.q88")), pick("top_slope", F.lit(0.0)), pick("top_intercept", F.col("_box.q02")),
    )
