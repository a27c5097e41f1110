"""Components of masks, and the line taken among candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.operators import evaluate, textlines
from glyphflow.sources import labels, sinks

from . import inputs as I

INK = 0.6
ENDINGS = (".png", ".PNG", ".Png")


def component_bottoms(spark: SparkSession, sf: str) -> DataFrame:
    """I8: the components of every embedding as a mask of 8 x 8, with their bottom points."""
    ink = F.array_join(F.transform("cut_scores", lambda v: F.when(v >= INK, "01").otherwise("00")), "")
    masks = I.cut_scores(spark, sf).where(F.size("cut_scores") == 64).select("line_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(ink).alias("pixels"))
    out = textlines.component_rows(masks)
    return out.select("line_id", "first", "area", "bottom", F.round("x", 6).alias("x"), F.round("weight", 6).alias("weight"), F.col("used").cast("int").alias("used"))


def line_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as candidate lines of an order: which one is taken, strict and lenient."""
    n, q, d = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int"), F.col("l_discount").cast("double")
    top = F.when(n % 3 > 0, d * 10)
    rows = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line_id"), (n % 2).alias("mask"), F.when(n % 4 < 3, n).alias("method"), q.alias("ink"), (q >= 10).alias("enough"), F.lit(10).alias("least"),
        ((d - 0.05) * 6).alias("slope"), F.col("l_partkey").cast("double").alias("intercept"), (F.col("l_tax").cast("double") * 10).alias("bottom_confidence"),
        F.when(top.isNotNull(), d).alias("top_slope"), F.when(top.isNotNull(), F.col("l_suppkey").cast("double")).alias("top_intercept"), top.alias("top_confidence"),
        F.when(top.isNotNull(), (q - 5).cast("double")).alias("gap"), F.lit(0).alias("left"), F.lit(9).alias("right"), F.lit(1.0).alias("q02"), (q + n).cast("double").alias("q88"), F.lit(9.0).alias("q98"),
    )
    kinds = [textlines.chosen_lines(rows, strict).withColumn("strict", F.lit(int(strict))) for strict in (True, False)]
    out = kinds[0].unionByName(kinds[1])
    return out.select("line_id", "strict", F.col("ok").cast("int").alias("ok"), "status", "candidates", F.round("confidence", 6).alias("confidence"), F.round("slope", 6).alias("slope"), "intercept", "top_intercept")


def image_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as an image of 8 x 8, written under endings in several cases, listed, decoded and met with its task; some are never written."""
    name = F.concat(F.lit("patch_"), F.col("line_id").cast("string"), F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("line_id") % 3 + 1).cast("int")))
    grey = F.transform("cut_scores", lambda v: F.lpad(F.hex(F.round(v * 255).cast("int")), 2, "0"))
    rows = I.cut_scores(spark, sf).where(F.size("cut_scores") == 64).select("line_id", name.alias("name"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), F.unhex(F.array_join(grey, "")).alias("pixels"))
    root = I.scratch(spark, "images")
    sinks.write_images(rows.where("line_id % 97 <> 13"), root)
    met = evaluate.with_images(rows.select("line_id", F.col("name").alias("image")), labels.read_images(spark, root))
    return met.select("line_id", "image", "h", "w", F.hex("pixels").alias("pixels"), "error")


QUERIES = (component_bottoms, line_choice, image_folder)


def _choice(strict: bool) -> str:
    usable, confidence = ("method IS NOT NULL AND coalesce(gap > 2, false)", "least(bc, tc)") if strict else ("method IS NOT NULL", "bc")
    return f"""SELECT line_id, {int(strict)} AS strict, CASE WHEN fine OR boxed THEN 1 ELSE 0 END AS ok, CASE WHEN fine THEN 'ok' WHEN boxed THEN 'baseline_' || fault || '_bbox_fallback'
            WHEN b IS NOT NULL THEN 'strict_lines_' || fault WHEN scarce THEN 'not_enough_foreground' ELSE 'baseline_fit_failed' END AS status, candidates,
            round(CASE WHEN boxed AND NOT fine THEN 0.18 ELSE b.c END, 6) AS confidence, round(CASE WHEN boxed AND NOT fine THEN 0.0 ELSE b.s END, 6) AS slope,
            CASE WHEN boxed AND NOT fine THEN x.q88 ELSE b.i END AS intercept, CASE WHEN boxed AND NOT fine THEN 1.0 ELSE b.t END AS top_intercept
        FROM (SELECT *, b IS NOT NULL AND abs(degrees(atan(b.s))) <= 12 AND b.c >= 0.24 AS fine, {'false' if strict else 'x IS NOT NULL'} AS boxed,
            CASE WHEN b IS NULL THEN 'fit_failed' WHEN abs(degrees(atan(b.s))) > 12 THEN 'angle_rejected' ELSE 'low_confidence' END AS fault
            FROM (SELECT line_id, count(*) FILTER ({usable}) AS candidates, max(ink) < 10 AS scarce,
                first({{'c': {confidence}, 's': slope, 'i': ic, 't': ti}} ORDER BY {confidence} DESC, mask, method, slope DESC, ic DESC, ti DESC) FILTER ({usable}) AS b,
                first({{'q88': q88}} ORDER BY ink DESC, mask, q88 DESC) FILTER (ink >= 10) AS x FROM cand GROUP BY line_id))"""


ORACLES = {
    "image_folder": f"""WITH {I.CUT_SCORES}, px AS (SELECT line_id, upper(string_agg(printf('%02x', round(s * 255)::INT), '' ORDER BY i)) AS pixels FROM sc GROUP BY line_id),
        nm AS (SELECT *, 'patch_' || line_id || ['.png', '.PNG', '.Png'][line_id % 3 + 1] AS image, line_id % 97 = 13 AS lost FROM px)
        SELECT line_id, image, CASE WHEN NOT lost THEN 8 END AS h, CASE WHEN NOT lost THEN 8 END AS w, CASE WHEN NOT lost THEN pixels END AS pixels, CASE WHEN lost THEN 'image_not_found: ' || image ELSE '' END AS error FROM nm""",
    "component_bottoms": f"""WITH RECURSIVE {I.CUT_SCORES}, ink AS (SELECT line_id, i, i % 8 AS x, i // 8 AS y FROM sc WHERE s >= {INK}),
        reach AS (SELECT line_id, i AS a, i, x, y FROM ink UNION SELECT r.line_id, r.a, k.i, k.x, k.y FROM reach r JOIN ink k ON k.line_id = r.line_id AND abs(k.x - r.x) <= 1 AND abs(k.y - r.y) <= 1),
        co AS (SELECT line_id, i, any_value(x) AS x, any_value(y) AS y, min(a) AS first FROM reach GROUP BY line_id, i),
        st AS (SELECT line_id, first, count(*) AS area, max(y) AS bottom, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w, avg(x) AS x FROM co GROUP BY line_id, first)
        SELECT line_id, first, area, bottom, round(x, 6) AS x, round(least(8, sqrt(area)), 6) AS weight, (area >= 2 AND h >= 2 AND NOT (w > 3.6 AND h <= 2))::INT AS used FROM st""",
    "line_choice": f"""WITH cand AS (SELECT l_orderkey AS line_id, n % 2 AS mask, CASE WHEN n % 4 < 3 THEN n END AS method, q AS ink, (d - 0.05::DOUBLE) * 6 AS slope, l_partkey::DOUBLE AS ic, l_tax::DOUBLE * 10 AS bc,
            CASE WHEN n % 3 > 0 THEN l_suppkey::DOUBLE END AS ti, CASE WHEN n % 3 > 0 THEN d * 10 END AS tc, CASE WHEN n % 3 > 0 THEN q - 5 END AS gap, (q + n)::DOUBLE AS q88
            FROM (SELECT *, l_linenumber::INT AS n, l_quantity::INT AS q, l_discount::DOUBLE AS d FROM lineitem)) {_choice(True)} UNION ALL {_choice(False)}""",
}
