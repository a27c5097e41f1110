"""Queries on scores, cuts, labels, losses and images."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphflow.functions import cuts as C
from glyphflow.functions import labels as LB
from glyphflow.functions import scores as S
from glyphflow.functions import text as T
from glyphflow.operators import augment as A
from glyphflow.operators import decode, evaluate, generate, heatmaps, images, losses, profiles, sweep
from glyphflow.streaming.evaluate import evaluate_stream

from . import inputs as I

def _classes():
    return F.array(*map(F.lit, I.CLASSES))


def _joined(values: Column) -> Column:
    return F.array_join(values, " ")


def greedy_decode(spark: SparkSession, sf: str) -> DataFrame:
    return decode.recognize(I.logits(spark, sf), _classes(), logits=True).select("line_id", "text", _joined(F.col("ids")).alias("ids"))


def timestep_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = decode.timestep_runs(decode.recognize(I.logits(spark, sf), _classes()))
    return out.select("line_id", "start", "end", "class_id", F.round("confidence", 5).alias("confidence"))


def topk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.logits(spark, sf).select("line_id", F.posexplode("p").alias("t", "v"))
    best = rows.select("line_id", "t", F.posexplode(S.top_k(F.col("v"), 3)).alias("rank", "b"))
    return best.select("line_id", "t", "rank", F.col("b.id").alias("class_id"))


def softmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.logits(spark, sf).select("line_id", F.posexplode("p").alias("t", "v")).withColumn("e", S.softmax(F.col("v")))
    return rows.select("line_id", "t", F.posexplode("e").alias("c", "p")).select("line_id", "t", "c", F.round("p", 6).alias("p"))


def smooth_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.cut_scores(spark, sf).select("line_id", F.posexplode(S.smooth(F.col("cut_scores"), 1)).alias("i", "s"))
    return rows.select("line_id", "i", F.round("s", 6).alias("s"))


def cut_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return I.cut_scores(spark, sf).select("line_id", _joined(S.peaks(F.col("cut_scores"), 0.5)).alias("peaks"))


def cut_nms(spark: SparkSession, sf: str) -> DataFrame:
    return I.cut_scores(spark, sf).select("line_id", _joined(S.select_cut_peaks(F.col("cut_scores"), 0.5, 4)).alias("cuts"))


def cut_min_gap(spark: SparkSession, sf: str) -> DataFrame:
    return I.cut_scores(spark, sf).select("line_id", _joined(S.enforce_min_gap(S.peaks(F.col("cut_scores"), 0.5), F.col("cut_scores"), 4)).alias("cuts"))


def cut_insert(spark: SparkSession, sf: str) -> DataFrame:
    return decode.segment(I.cut_scores(spark, sf), threshold=0.6, least=3, most=10, radius=1).select("line_id", _joined(F.col("cut_positions")).alias("cuts"))


def cuts_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.cut_scores(spark, sf).withColumn("c", S.peaks(F.col("cut_scores"), 0.5))
    length = C.predicted_length(F.col("c"), F.size("cut_scores"))
    return rows.select("line_id", C.cuts_text(F.col("c"), F.col("cut_scores")).alias("cuts"), F.size("c").alias("cut_count"), length.alias("pred_len"))


def cut_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of score above one half, with gaps of up to two closed."""
    flags = F.transform("cut_scores", lambda v: v >= 0.5)
    rows = I.cut_scores(spark, sf).select("line_id", F.explode(S.boolean_runs(S.close_holes(flags, 2))).alias("r"))
    return rows.select("line_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def cut_intervals(spark: SparkSession, sf: str) -> DataFrame:
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), S.peaks(F.col("cut_scores"), 0.5), F.array(F.size("cut_scores")))))
    rows = I.cut_scores(spark, sf).select("line_id", F.explode(C.pairs(cuts)).alias("p"))
    return rows.select("line_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


def typical_width(spark: SparkSession, sf: str) -> DataFrame:
    peaks = S.peaks(F.col("cut_scores"), 0.5)
    return I.cut_scores(spark, sf).select("line_id", C.typical_width(peaks, F.lit(0), F.lit(64)).alias("width"))


def boundary_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.cut_scores(spark, sf).select("line_id", F.explode(S.peaks(F.col("cut_scores"), 0.5)).alias("cut"))
    return rows.select("line_id", "cut", C.map_cut(F.col("cut"), F.lit(64), F.lit(19)).alias("boundary"))


def boundary_promotion(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.cut_scores(spark, sf).withColumn("b", C.promote_edges(S.peaks(F.col("cut_scores"), 0.5), F.lit(0), F.lit(64), "auto", 0.9))
    return rows.select("line_id", F.col("b.left").alias("left"), F.col("b.right").alias("right"), _joined(F.col("b.cuts")).alias("cuts"))


def interval_class_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals [0,3), [3,6), [6,8) of every line, each with its best class."""
    iv = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (3, 6), (6, 8))))
    out = decode.interval_classes(I.logits(spark, sf).withColumn("intervals", iv), fraction=1.0)
    return out.select("line_id", "i", F.get("candidates", F.lit(0))["id"].alias("class_id"), F.round(F.get("candidates", F.lit(0))["value"], 5).alias("mean"))


def decode_with_cuts(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.logits(spark, sf).join(decode.segment(I.cut_scores(spark, sf), distance=6).select("line_id", "cut_positions"), "line_id")
    rows = rows.withColumn("input_width", F.lit(64)).withColumn("cut_width", F.lit(64))
    return decode.decode_with_cuts(rows, _classes()).select("line_id", "text")


def glyph_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of text laid out with spacing 0.5 and word factor 1.5."""
    rows = I.pieces(spark, sf, 12)
    chars = F.split("text", "")
    spans = LB.glyph_layout(chars, F.transform(chars, lambda c: F.when(c.isin("i", "l", ".", " "), 4.0).otherwise(6.0)), F.lit(0.5), F.lit(1.5), F.lit(2.0))
    return rows.select("line_id", F.posexplode(spans).alias("i", "s")).select("line_id", "i", F.col("s.x0").alias("x0"), F.col("s.x1").alias("x1"))


def line_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Crops of 30 columns at a stride of 15, from glyphs of six columns."""
    rows = I.pieces(spark, sf, 12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spans = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("ch"), (i * 6.0 + 2).alias("x0"), (i * 6.0 + 8).alias("x1")))
    laid = rows.select("line_id", spans.alias("spans"), (F.char_length("text") * 6 + 4).alias("width"))
    return generate.crop_labels(laid, 30, 15)


def dense_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of the columns of every line's scores: letters of the best classes, seven columns each."""
    rows = decode.recognize(I.logits(spark, sf), _classes()).where(F.char_length("text") > 0)
    spans = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("ch"), (i * 8.0 + 1).alias("x0"), (i * 8.0 + 8).alias("x1")))
    labels = LB.dense_labels(spans, _classes(), F.lit(64))
    return rows.select("line_id", _joined(labels).alias("labels"))


def cut_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = decode.recognize(I.logits(spark, sf), _classes()).where(F.char_length("text") > 0)
    spans = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("ch"), (i * 8.0 + 1).alias("x0"), (i * 8.0 + 8).alias("x1")))
    heat = LB.cut_projection(spans, F.lit(64), 1)
    return rows.select("line_id", F.posexplode(heat).alias("x", "v")).where("v > 0")


def baseline_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = decode.recognize(I.logits(spark, sf), _classes())
    spans = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("ch"), (i * 8.0 + 1.5).alias("x0"), (i * 8.0 + 8.5).alias("x1")))
    heat = generate.baseline_rows(spans, F.lit(8.0), F.lit(24.0), F.lit(64), F.lit(32))
    return rows.select("line_id", F.explode(heat).alias("h")).select("line_id", "h.channel", "h.y", "h.x0", "h.x1", F.round("h.value", 6).alias("value"))


def _labels64(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, labels): four classes and -100 by the tenths of the scores."""
    kind = lambda s: F.when(s < 0.4, -100).when(s < 0.45, 0).when(s < 0.5, 1).when(s < 0.6, 2).otherwise(3)
    return I.cut_scores(spark, sf).select("line_id", F.transform("cut_scores", kind).alias("labels"), "cut_scores")


def majority_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _labels64(spark, sf).select("line_id", _joined(LB.majority_bins(F.col("labels"), 19, 4, 0.4)).alias("labels"))


def label_resample(spark: SparkSession, sf: str) -> DataFrame:
    return _labels64(spark, sf).select("line_id", _joined(LB.resample_labels(F.col("labels"), 19)).alias("labels"))


def label_crop_resize(spark: SparkSession, sf: str) -> DataFrame:
    """60 middle columns, as 30 classes by nearest and 30 values by linear sampling."""
    rows = _labels64(spark, sf)
    return rows.select("line_id", _joined(LB.resize_nearest(LB.crop_array(F.col("labels"), 2, 2), 30)).alias("nearest"), F.round(F.element_at(LB.resize_linear(LB.crop_array(F.col("cut_scores"), 2, 2), 30), 1), 6).alias("first"))


def maxpool_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label maps of 48 rows and 16 columns made of part sizes."""
    parts = I.table(spark, sf, "part").select((F.col("p_partkey") % 16).alias("x"), (F.col("p_partkey") % 48).alias("y"), F.floor(F.col("p_partkey") / 768).alias("line_id"), F.col("p_size").alias("c"))
    return losses.max_pooled(parts, 48)


def weighted_ce(spark: SparkSession, sf: str) -> DataFrame:
    """The label of a timestep is the class of the step before it; class 0 weighs one half."""
    rows = decode.recognize(I.logits(spark, sf), _classes()).select("line_id", "ids", F.posexplode(F.transform("p", S.softmax)).alias("t", "p"))
    labelled = rows.select("line_id", "t", "p", F.when(F.col("t") == 0, -100).otherwise(F.get("ids", F.col("t") - 1)).alias("label"))
    terms = losses.cross_entropy_terms(labelled, 0, 0.5).withColumn("part", F.col("line_id") % 10)
    return losses.weighted_cross_entropy(terms, ["part"]).select("part", F.round("loss", 6).alias("loss"), "n")


def _cut_loss(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = I.table(spark, sf, "embeddings").select(F.col("label").alias("part"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
        target = F.transform("x", lambda v, i: (i % 3) / 2.0)
        out = losses.mean_over_columns(rows.withColumn("l", losses.projection_loss(F.col("x"), target, kind, 4.0)), "l", ["part"])
        return out.select("part", F.round("loss", 6).alias("loss"), "n")

    query.__name__ = f"cut_loss_{kind}"
    return query


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """(img, x, y): line items as ink: the column from the part, the row from the quantity."""
    return I.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("img"), (F.col("l_partkey") % 40).alias("x"), F.col("l_quantity").cast("double").alias("y"))


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = profiles.column_profile(_points(spark, sf), 0.88)
    return out.select("img", "x", F.round("y", 6).alias("y"), F.round("w", 6).alias("w"))


def line_fit(spark: SparkSession, sf: str) -> DataFrame:
    out = profiles.weighted_lines(profiles.column_profile(_points(spark, sf), 0.88))
    return out.select("img", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


def ransac_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J11 over the profile points: of each image (40 columns) at most 30 are paired, all are counted."""
    p = _points(spark, sf).groupBy("img", "x").agg(F.max("y").alias("y"))
    scored = profiles.candidate_lines(profiles.spread_points(p, 30), p, 5, 2.0)
    return scored.groupBy("img").agg(F.max("inliers").alias("inliers"), F.count("*").alias("pairs"))


def text_x_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand images of 200 columns and 50 rows made of line items; -1 without a run."""
    points = I.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("img"), (F.col("l_partkey") % 200).alias("x"))
    out = profiles.text_bounds(points, 200, 50)
    return out.select("img", F.coalesce("left", F.lit(-1)).alias("left"), F.coalesce("right", F.lit(-1)).alias("right"))


def running_median(spark: SparkSession, sf: str) -> DataFrame:
    """W5 on events: the median of the values around each event of a user."""
    out = profiles.running_median(I.table(spark, sf, "events"), "value", ["user_id"], ["ts", "event_id"], 2)
    return out.select("event_id", F.round("smooth", 6).alias("smooth"))


def filled_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Values of clicks only, all other events of the user interpolated by event number, clamped at the ends."""
    ev = I.table(spark, sf, "events")
    out = profiles.filled_gaps(ev, F.when(F.col("event_type") == "click", F.col("value")), ["user_id"], ["ts", "event_id"])
    return out.select("event_id", F.round("filled", 6).alias("filled"))


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Q2: every line under every threshold; the true length is eight timesteps."""
    trials = sweep.trial_grid(spark, cut_threshold=[0.45, 0.5, 0.55, 0.6, None])
    rows = sweep.with_trials(I.cut_scores(spark, sf), trials, {"cut_threshold": 0.65})
    rows = rows.select("trial", F.lit("").alias("error"), F.lit(8).alias("gt_len"), (F.size(S.peaks(F.col("cut_scores"), F.col("cut_threshold"))) + 1).alias("pred_len"))
    out = evaluate.segmentation_metrics(evaluate.length_errors(rows), ["trial"])
    best = sweep.leaderboard(out, "average_abs_length_error")
    return best.select("trial", "total_abs_length_error", F.round("average_abs_length_error", 6).alias("average_abs_length_error"), "place")


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn, cut into pieces of up to 24 ASCII characters and drawn."""
    turns = I.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "?"), F.lit(".{1,24}"), F.lit(0))).alias("pos", "text"))
    rows = turns.select(((F.col("conv_id") * 100 + F.col("turn")) * 1000 + F.col("pos")).alias("line_id"), F.trim("text").alias("text")).where("text <> ''")
    # Dealt out before the kernels: the few bytes of text move, the pixels are made where they are used.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "line_id")
    return generate.render(generate.laid_out(rows, padding=4, scale=2), height=24, scale=2)


def preprocess_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every drawn line prepared to a height of 16; the size must be what the size arithmetic says."""
    drawn = _rendered(spark, sf).withColumn("source_w", F.col("w"))
    done = images.preprocess_lines(drawn, images.Params(height=16, scale_x=0.9, x_pad=0.05, y_pad=-0.1), keep=("line_id", "source_w"))
    want = images.prepared_size(F.col("w"), F.lit(24), 16, 0.9, 0.05, -0.1)
    return done.toDF("line_id", "w", "h", "w2", "c", "pixels", "status").select("line_id", F.col("w2").alias("width"), F.col("h").alias("height"), (F.col("w2") == want["w"]).alias("as_computed"))


def augment_log(spark: SparkSession, sf: str) -> DataFrame:
    out = A.augment(_rendered(spark, sf), {"cycle_shift": 0.5, "brightness": 0.5, "noise": 0.5, "rotate": 0.3, "random_line": 0.3, "invert": 0.2})
    return out.select("line_id", "log", F.md5("pixels").alias("digest"))


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as grey images of 8 x 8."""
    grey = F.transform("cut_scores", lambda v: F.lpad(F.hex(F.round(v * 255).cast("int")), 2, "0"))
    return I.cut_scores(spark, sf).select("line_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(grey, "")).alias("pixels"), F.concat("cut_scores", F.reverse("cut_scores")).alias("baseline"))


def augment_values(spark: SparkSession, sf: str) -> DataFrame:
    """Grey values at two fifths of their brightness, inverted."""
    out = A.augment(_patches(spark, sf), {"brightness": 1.0, "invert": 1.0}, {"brightness": {"factor": 0.4}})
    return out.select("line_id", F.hex("pixels").alias("pixels"))


def augment_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Every operation that moves an image moves its two maps."""
    # Dealt out before the kernel: a few files would leave most cores idle.
    patches = _patches(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "line_id")
    out = A.augment(patches, dict.fromkeys(A.GEOMETRIC, 0.5), target="baseline")
    return out.select("line_id", "log", F.md5("pixels").alias("digest"), F.round(F.aggregate("baseline", F.lit(0.0), lambda a, x: a + x), 3).alias("heat"))


def text_line_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Every drawn line detected and cropped to its text."""
    out = images.preprocess_lines(_rendered(spark, sf), images.Params(height=24, baseline_crop=True))
    return out.select("line_id", "w", "status")


def ink_edges(image: np.ndarray) -> np.ndarray:
    """Heatmaps without a network: full heat at the first and at the last ink of each column."""
    ink = image < 128
    heat, x = np.zeros((2, *image.shape), np.float32), np.flatnonzero(ink.any(axis=0))
    heat[0, ink.argmax(axis=0)[x], x] = heat[1, len(ink) - 1 - ink[::-1].argmax(axis=0)[x], x] = 1
    return heat


def straightened_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every drawn line straightened along the edges of its ink."""
    out = heatmaps.straightened_at_once(_rendered(spark, sf), ink_edges)
    return out.select("line_id", "status", "w", "h", F.round("body", 4).alias("body"), F.md5("pixels").alias("digest"))


def straight_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The lower edge of every drawn line as a straight line."""
    out = heatmaps.straightened_at_once(_rendered(spark, sf), ink_edges, heatmaps.HeatParams(curved=False))
    return out.select("line_id", "status", F.round("slope", 4).alias("slope"), F.round("confidence", 4).alias("confidence"))


@cache
def _atlas() -> dict[bytes, int]:
    """The class of every printable glyph by its ink at twice the size; made once per worker."""
    return {generate.enlarged(chr(k), 2).tobytes(): k - 32 for k in range(33, 127)}


def template_scores(stack: np.ndarray) -> list[np.ndarray]:
    """a scoring function without a network: drawn glyphs are looked up in the atlas, one step per glyph."""
    atlas, out = _atlas(), []
    for image in stack:
        ink, after, found = image[5:19] < 128, 0, []
        # Every glyph has ink in its first corner.
        for at in np.flatnonzero(ink[0, : max(0, ink.shape[1] - 9)]).tolist():
            if at >= after and (k := atlas.get(ink[:, at : at + 10].tobytes())):
                found.append(k)
                after = at + 10
        steps = np.zeros((len(found), 95))
        steps[np.arange(len(found)), found] = 1
        out.append(steps)
    return out


def render_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn lines read back by comparing with the glyph atlas, without their blanks."""
    # The text goes along with its line: nothing is drawn twice or joined.
    scored = decode.score_lines(_rendered(spark, sf), template_scores, batch=1, keep=("line_id", "text"))
    text = F.array(*map(F.lit, map(chr, range(32, 127))))
    ids = scored.withColumn("ids", F.transform("p", S.argmax))
    rows = ids.select("line_id", F.replace(F.col("text"), F.lit(" "), F.lit("")).alias("gt"), F.array_join(F.transform("ids", lambda c: F.get(text, c)), "").alias("pred"), "error")
    return evaluate.ocr_metrics(evaluate.measured(rows)).select("total", "recognized", "exact", "total_levenshtein")


def column_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Q6: window features of all score columns, a class by tenths, classes weighted; how many columns are told right."""
    rows = _labels64(spark, sf).select("line_id", F.arrays_zip(sweep.window_features(F.col("cut_scores"), 1).alias("features"), F.col("labels").alias("label")).alias("z"))
    rows = rows.select("line_id", F.explode("z").alias("z")).select("line_id", "z.features", "z.label").where("label >= 0").withColumn("w", F.when(F.col("label") == 0, 0.5).otherwise(1.0))
    model = sweep.column_classifier(rows, "w", maxIter=20)
    told = sweep.classify_columns(model, rows)
    return told.groupBy("label").agg(F.count("*").alias("n"), (F.avg((S.argmax(F.col("p")) == F.col("label")).cast("double")) > 0.2).alias("useful"))


def stream_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The predictions of every language as an epoch, streamed from files and measured as they arrive."""
    base = I.scratch(spark, "stream")
    rows = I.pairs(spark, sf)
    epoch = F.expr("CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END")
    rows.select(F.lit("run").alias("run_id"), epoch.alias("epoch"), "task_id", "pred", "error").write.parquet(f"{base}/in")
    evaluate_stream(spark, f"{base}/in", rows.select("task_id", "gt"), f"{base}/rows", f"{base}/metrics", f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/metrics")
    return out.groupBy("run_id", "epoch").agg(*(F.sum(c).cast("long").alias(c) for c in ("total", "recognized", "exact", "total_levenshtein")))


def noisy_scores(labels: np.ndarray, noise: np.ndarray, classes: int) -> np.ndarray:
    """float[n, class]: one at the label of a timestep; where there is noise, two at the next class."""
    out = np.zeros((len(labels), classes), np.float32)
    out[np.arange(len(labels)), labels] = 1
    out[noise, (labels[noise] + 1) % classes] = 2
    return out


@F.arrow_udf(StringType())
def _noisy_texts(labels: pa.Array, noise: pa.Array) -> pa.Array:
    """Dense labels as scores of every class with noise at some places, read greedily."""
    (own, at), (places, noise_at) = LB._flat(labels), LB._flat(noise)
    own = own.to_numpy(zero_copy_only=False)
    hits = np.sort(places.to_numpy(zero_copy_only=False) + np.repeat(at[:-1], np.diff(noise_at)))

    def scores(a: int, b: int) -> np.ndarray:
        low, high = np.searchsorted(hits, (a, b))
        return noisy_scores(own[a:b], hits[low:high] - a, len(I.ALPHABET))

    return decode.greedy_texts(scores, at, I.ALPHABET)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents: layout, dense labels, scores of all classes with hash noise, greedy decoding, metrics per language."""
    alphabet = I.ALPHABET
    rows = I.pieces(spark, sf, 12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Told by the piece as it is: a filter on the cleaned text would clean it twice.
    rows = rows.where(T.holds_known("text", alphabet.replace(" ", "")))
    known = T.only_known("text", alphabet)
    rows = rows.withColumn("text", F.regexp_replace(F.trim(F.regexp_replace(known, " +", " ")), r"(.)(?=\1)", "$1 "))
    laid = generate.laid_out(rows, padding=0)
    labels = laid.withColumn("labels", LB.dense_labels(F.col("spans"), alphabet, F.col("width")))
    noise = labels.withColumn("noise", T.places_below(1, F.col("line_id"), F.size("labels"), 0.002))
    read = noise.select("lang", F.col("text").alias("gt"), F.trim(_noisy_texts("labels", "noise")).alias("pred"), F.lit("").alias("error"))
    out = evaluate.ocr_metrics(evaluate.measured(read), ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("line_accuracy", "average_char_accuracy", "global_char_accuracy", "average_levenshtein")})


QUERIES = (
    greedy_decode, timestep_runs, topk_candidates, softmax_scores, smooth_scores, cut_peaks, cut_nms, cut_min_gap, cut_insert, cuts_report, cut_runs,
    cut_intervals, typical_width, boundary_map, boundary_promotion, interval_class_mean, decode_with_cuts, glyph_layout, line_crops, dense_labels,
    cut_projection, baseline_rows, majority_bins, label_resample, label_crop_resize, maxpool_labels, weighted_ce, _cut_loss("mse"), _cut_loss("bce"),
    _cut_loss("smooth_l1"), column_profile, line_fit, ransac_pairs, text_x_bounds, running_median, filled_gaps, threshold_sweep, preprocess_sizes,
    augment_log, augment_values, augment_maps, text_line_detection, straightened_lines, straight_edges, render_roundtrip, column_classifier, stream_eval, flagship,
)

_PEAKS = f"""{I.CUT_SCORES}, nb AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM sc WINDOW w AS (PARTITION BY line_id ORDER BY i)),
    pk AS (SELECT line_id, i, s FROM nb WHERE s >= 0.5 AND s >= coalesce(l, '-inf'::DOUBLE) AND s >= coalesce(r, '-inf'::DOUBLE)), ids AS (SELECT vec_id AS line_id FROM embeddings)"""
_ARGMAX = f"{I.LOGITS}, am AS (SELECT line_id, t, c, v FROM (SELECT *, row_number() OVER (PARTITION BY line_id, t ORDER BY v DESC, c) AS k FROM lg) WHERE k = 1)"
_TEXT = f"""{_ARGMAX}, cl AS (SELECT line_id, t, c FROM (SELECT *, lag(c) OVER (PARTITION BY line_id ORDER BY t) AS p FROM am) WHERE p IS NULL OR p <> c),
    kn AS (SELECT line_id, t, c FROM cl WHERE c < 7), tx AS (SELECT line_id, c, row_number() OVER (PARTITION BY line_id ORDER BY t) - 1 AS k FROM kn)"""
_LAB = f"{I.CUT_SCORES}, lab AS (SELECT line_id, i, CASE WHEN s < 0.4 THEN -100 WHEN s < 0.45 THEN 0 WHEN s < 0.5 THEN 1 WHEN s < 0.6 THEN 2 ELSE 3 END AS v, s FROM sc)"
_P12 = I.pieces_sql(12)
_PTS = "pts AS (SELECT l_suppkey % 20 AS img, l_partkey % 40 AS x, l_quantity::DOUBLE AS y FROM lineitem)"


def _loss_sql(kind: str) -> str:
    d = "(1 / (1 + exp(-x)) - t)"
    loss = {"mse": f"{d} * {d}", "bce": "greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))", "smooth_l1": f"CASE WHEN abs({d}) < 1 THEN 0.5 * {d} * {d} ELSE abs({d}) - 0.5 END"}[kind]
    return f"""WITH e AS (SELECT label AS part, unnest(embedding)::DOUBLE AS x, ((generate_subscripts(embedding, 1) - 1) % 3) / 2.0 AS t FROM embeddings)
        SELECT part, round(avg(({loss}) * (1 + 3 * t)), 6) AS loss, count(*) AS n FROM e GROUP BY part"""


ORACLES = {
    "greedy_decode": f"""WITH {_TEXT}, a AS (SELECT line_id, string_agg(c::VARCHAR, ' ' ORDER BY t) AS ids FROM am GROUP BY ALL),
        b AS (SELECT line_id, string_agg(substr('{I.CLASSES}', (c + 1)::INT, 1), '' ORDER BY t) AS text FROM kn GROUP BY ALL) SELECT a.line_id, coalesce(text, '') AS text, ids FROM a LEFT JOIN b USING (line_id)""",
    "timestep_runs": f"""WITH {_ARGMAX}, g AS (SELECT *, sum((p IS NULL OR p <> c)::INT) OVER (PARTITION BY line_id ORDER BY t) AS run FROM (SELECT *, lag(c) OVER (PARTITION BY line_id ORDER BY t) AS p FROM am))
        SELECT line_id, min(t)::INT AS start, max(t)::INT AS "end", min(c)::INT AS class_id, round(avg(v), 5) AS confidence FROM g GROUP BY line_id, run""",
    "topk_candidates": f"WITH {I.LOGITS} SELECT line_id, t::INT AS t, (k - 1)::INT AS rank, c::INT AS class_id FROM (SELECT *, row_number() OVER (PARTITION BY line_id, t ORDER BY v DESC, c) AS k FROM lg) WHERE k <= 3",
    "softmax_scores": f"WITH {I.LOGITS}, e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY line_id, t)) AS e FROM lg) SELECT line_id, t::INT AS t, c::INT AS c, round(e / sum(e) OVER (PARTITION BY line_id, t), 6) AS p FROM e",
    "smooth_scores": f"""WITH {_PEAKS} SELECT line_id, i::INT AS i, round((coalesce(l, 0) + 2 * s + coalesce(r, 0)) / (2 + (l IS NOT NULL)::INT + (r IS NOT NULL)::INT), 6) AS s FROM nb""",
    "cut_peaks": f"WITH {_PEAKS} SELECT line_id, coalesce(string_agg(i::VARCHAR, ' ' ORDER BY i), '') AS peaks FROM ids LEFT JOIN pk USING (line_id) GROUP BY line_id",
    "cut_nms": f"""WITH RECURSIVE {_PEAKS}, rk AS (SELECT line_id, i, row_number() OVER (PARTITION BY line_id ORDER BY s DESC, i DESC) AS k FROM pk),
        f AS (SELECT line_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM ids
            UNION ALL SELECT f.line_id, rk.k, CASE WHEN len(list_filter(kept, lambda a: abs(a - i) < 4)) = 0 THEN list_append(kept, i::BIGINT) ELSE kept END FROM f JOIN rk ON rk.line_id = f.line_id AND rk.k = f.k + 1)
        SELECT line_id, array_to_string(list_sort(arg_max(kept, k)), ' ') AS cuts FROM f GROUP BY line_id""",
    "cut_min_gap": f"""WITH RECURSIVE {_PEAKS}, rk AS (SELECT line_id, i, s, row_number() OVER (PARTITION BY line_id ORDER BY i) AS k FROM pk),
        f AS (SELECT line_id, 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::DOUBLE AS ls FROM ids
            UNION ALL SELECT f.line_id, rk.k, CASE WHEN ls IS NULL OR i - kept[-1] >= 4 THEN list_append(kept, i::BIGINT) WHEN ls <= s THEN list_append(kept[1:len(kept) - 1], i::BIGINT) ELSE kept END,
                CASE WHEN ls IS NULL OR i - kept[-1] >= 4 OR ls <= s THEN s ELSE ls END FROM f JOIN rk ON rk.line_id = f.line_id AND rk.k = f.k + 1)
        SELECT line_id, array_to_string(arg_max(kept, k), ' ') AS cuts FROM f GROUP BY line_id""",
    "cuts_report": f"""WITH {_PEAKS} SELECT line_id, coalesce(string_agg(i || ':' || round(s::DECIMAL(10, 4), 3)::DECIMAL(6, 3)::VARCHAR, ' ' ORDER BY i), '') AS cuts, count(i)::INT AS cut_count, (count(i) + 1)::INT AS pred_len FROM ids LEFT JOIN pk USING (line_id) GROUP BY line_id""",
    "cut_runs": f"""WITH {I.CUT_SCORES}, f AS (SELECT line_id, i FROM sc WHERE s >= 0.5), g AS (SELECT *, sum((p IS NULL OR i - p > 3)::INT) OVER (PARTITION BY line_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY line_id ORDER BY i) AS p FROM f))
        SELECT line_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM g GROUP BY line_id, k""",
    "cut_intervals": f"""WITH {_PEAKS}, b AS (SELECT line_id, i FROM pk UNION SELECT line_id, 0 FROM ids UNION SELECT line_id, 64 FROM ids)
        SELECT line_id, i::INT AS start, n::INT AS "end" FROM (SELECT line_id, i, lead(i) OVER (PARTITION BY line_id ORDER BY i) AS n FROM b) WHERE n IS NOT NULL""",
    "typical_width": f"""WITH {_PEAKS}, g AS (SELECT line_id, i - lag(i) OVER (PARTITION BY line_id ORDER BY i) AS g FROM pk) SELECT line_id, coalesce(median(g)::DOUBLE, 64.0) AS width FROM ids LEFT JOIN g USING (line_id) GROUP BY line_id""",
    "boundary_map": f"WITH {_PEAKS} SELECT line_id, i::INT AS cut, greatest(1, least(18, round_even((i + 0.5) * 19 / 64, 0)::INT)) AS boundary FROM pk",
    "boundary_promotion": f"""WITH {_PEAKS}, inn AS (SELECT line_id, i FROM pk WHERE i > 0), g AS (SELECT line_id, i, i - lag(i) OVER (PARTITION BY line_id ORDER BY i) AS g FROM inn),
        m AS (SELECT line_id, count(i) AS n, coalesce(median(g), 64.0) AS typ, min(i) AS lo, max(i) AS hi FROM ids LEFT JOIN g USING (line_id) GROUP BY line_id),
        p AS (SELECT *, coalesce(n >= 2 AND lo <= greatest(2.0, typ * 0.9) AND 64 - hi <= greatest(2.0, typ * 0.9), false) AS promote FROM m)
        SELECT p.line_id, (CASE WHEN promote THEN lo ELSE 0 END)::INT AS "left", (CASE WHEN promote THEN hi ELSE 64 END)::INT AS "right",
        coalesce(string_agg(i::VARCHAR, ' ' ORDER BY i) FILTER (NOT promote OR (i > lo AND i < hi)), '') AS cuts FROM p LEFT JOIN inn USING (line_id) GROUP BY p.line_id, promote, lo, hi""",
    "interval_class_mean": f"""WITH {I.LOGITS}, m AS (SELECT line_id, CASE WHEN t < 3 THEN 0 WHEN t < 6 THEN 1 ELSE 2 END AS i, c, avg(v) AS m FROM lg GROUP BY ALL)
        SELECT line_id, i::INT AS i, c::INT AS class_id, round(m, 5) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY line_id, i ORDER BY m DESC, c) AS k FROM m) WHERE k = 1""",
    "glyph_layout": f"""WITH {_P12}, c AS (SELECT line_id, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS i FROM (SELECT line_id, str_split(text, '') AS l FROM lines)),
        w AS (SELECT *, CASE WHEN ch IN ('i', 'l', '.', ' ') THEN 4.0::DOUBLE ELSE 6.0 END * CASE WHEN ch = ' ' THEN 1.5::DOUBLE ELSE 1 END AS wide, lead(ch) OVER (PARTITION BY line_id ORDER BY i) AS nx FROM c),
        s AS (SELECT *, wide + CASE WHEN ch <> ' ' AND nx <> ' ' THEN 0.5::DOUBLE ELSE 0 END AS step FROM w),
        x AS (SELECT *, 2 + coalesce(sum(step) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM s) SELECT line_id, i::INT AS i, x0, x0 + wide AS x1 FROM x""",
    "line_crops": f"""WITH {_P12}, c AS (SELECT line_id, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS i, len(l) AS n FROM (SELECT line_id, str_split(text, '') AS l FROM lines)),
        k AS (SELECT line_id, ch, i, i * 6.0 + 2 AS x0, i * 6.0 + 8 AS x1, unnest(generate_series(0, n * 6 + 4 - 30, 15)) AS lft FROM c WHERE n * 6 + 4 >= 30),
        j AS (SELECT *, (least(x1, lft + 30) - greatest(x0, lft)) / 6.0 AS seen FROM k),
        v AS (SELECT *, CASE WHEN seen <= 0 THEN 0 WHEN (x0 < lft OR x1 > lft + 30) AND seen < 0.75 THEN CASE WHEN seen <= 0.25 THEN 0 ELSE 2 END ELSE 1 END AS u FROM j),
        t AS (SELECT line_id, lft, string_agg(ch, '' ORDER BY i) FILTER (u = 1) AS text FROM v GROUP BY line_id, lft HAVING max(u) < 2),
        r AS (SELECT line_id, lft, trim(regexp_replace(text, ' +', ' ', 'g'), ' ') AS text FROM t) SELECT line_id, lft::INT AS "left", text FROM r WHERE length(text) >= 1""",
    "dense_labels": f"""WITH {_TEXT}, n AS (SELECT line_id, count(*) AS n FROM tx GROUP BY ALL), xs AS (SELECT line_id, n, unnest(range(64)) AS x FROM n),
        d AS (SELECT line_id, x, CASE WHEN x + 0.5 < 1 OR x + 0.5 >= n * 8 THEN NULL ELSE least(n - 1, CASE WHEN x % 8 = 0 THEN x // 8 - 1 ELSE x // 8 END) END AS k FROM xs)
        SELECT line_id, string_agg(coalesce(c, 0)::VARCHAR, ' ' ORDER BY x) AS labels FROM d LEFT JOIN tx USING (line_id, k) GROUP BY line_id""",
    "cut_projection": f"""WITH {_TEXT}, cc AS (SELECT line_id, k * 8 + 8 AS p FROM tx WHERE (line_id, k + 1) IN (SELECT (line_id, k) FROM tx)),
        v AS (SELECT line_id, p + o AS x, 1 - abs(o) / 2.0 AS v FROM cc, (VALUES (-1), (0), (1)) t(o)) SELECT line_id, x::INT AS x, max(v)::DOUBLE AS v FROM v WHERE x BETWEEN 0 AND 63 GROUP BY ALL""",
    "baseline_rows": f"""WITH {_TEXT}, ids AS (SELECT vec_id AS line_id FROM embeddings), n AS (SELECT line_id, count(k) AS n FROM ids LEFT JOIN tx USING (line_id) GROUP BY ALL)
        SELECT line_id, ch::INT AS channel, (y + o)::INT AS y, (CASE WHEN n = 0 THEN 0 ELSE 1 END)::INT AS x0, (CASE WHEN n = 0 THEN 64 ELSE least(64, n * 8 + 1) END)::INT AS x1, round(1 - abs(o) / 3.0, 6)::DOUBLE AS value
        FROM n, (VALUES (0, 8), (1, 24)) c(ch, y), (VALUES (-2), (-1), (0), (1), (2)) t(o)""",
    "majority_bins": f"""WITH {_LAB}, b AS (SELECT line_id, bin, v FROM lab, range(19) t(bin) WHERE i >= floor(bin * 64 / 19) AND i < ceil((bin + 1) * 64 / 19)),
        n AS (SELECT line_id, bin, v, count(*) AS n FROM b WHERE v >= 0 GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY line_id, bin) AS total, row_number() OVER (PARTITION BY line_id, bin ORDER BY n DESC, v) AS k FROM n),
        f AS (SELECT DISTINCT line_id, bin FROM b) SELECT line_id, string_agg((CASE WHEN n / total >= 0.4 THEN v ELSE -100 END)::VARCHAR, ' ' ORDER BY bin) AS labels FROM f LEFT JOIN (SELECT * FROM k WHERE k = 1) USING (line_id, bin) GROUP BY line_id""",
    "label_resample": f"WITH {_LAB} SELECT line_id, string_agg(v::VARCHAR, ' ' ORDER BY bin) AS labels FROM range(19) t(bin) JOIN lab ON i = least(floor((bin + 0.5) * 64 / 19), 63) GROUP BY line_id",
    "label_crop_resize": f"""WITH {_LAB}, a AS (SELECT line_id, string_agg(v::VARCHAR, ' ' ORDER BY o) AS nearest FROM range(30) t(o) JOIN lab ON i = 2 + o * 2 GROUP BY line_id),
        b AS (SELECT line_id, round(avg(s), 6) AS first FROM lab WHERE i IN (2, 3) GROUP BY line_id) SELECT * FROM a JOIN b USING (line_id)""",
    "maxpool_labels": "SELECT p_partkey // 768 AS line_id, p_partkey % 16 AS x, max(p_size) AS label FROM part WHERE p_partkey % 48 <= 46 GROUP BY ALL",
    "weighted_ce": f"""WITH {_ARGMAX}, e AS (SELECT *, ln(sum(exp(v)) OVER (PARTITION BY line_id, t)) AS z FROM lg), y AS (SELECT line_id, t + 1 AS t, c AS label FROM am),
        r AS (SELECT y.line_id % 10 AS part, z - v AS ce, CASE WHEN label = 0 THEN 0.5 ELSE 1.0 END AS w FROM y JOIN e ON e.line_id = y.line_id AND e.t = y.t AND e.c = y.label)
        SELECT part, round(sum(w * ce) / greatest(1.0, sum(w)), 6)::DOUBLE AS loss, count(*) AS n FROM r GROUP BY part""",
    **{f"cut_loss_{k}": _loss_sql(k) for k in ("mse", "bce", "smooth_l1")},
    "column_profile": f"WITH {_PTS} SELECT img, x, round(quantile_cont(y, 0.88), 6) AS y, round(sqrt(count(*)), 6) AS w FROM pts GROUP BY ALL",
    "line_fit": f"""WITH {_PTS}, p AS (SELECT img, x::DOUBLE AS x, quantile_cont(y, 0.88) AS y, count(*)::DOUBLE AS w FROM pts GROUP BY ALL),
        s AS (SELECT img, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx FROM p GROUP BY img),
        f AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS slope FROM s) SELECT img, round(slope, 6) AS slope, round((sy - slope * sx) / s, 5) AS intercept FROM f""",
    "ransac_pairs": f"""WITH {_PTS}, p AS (SELECT img, x, max(y) AS y FROM pts GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY img) AS n FROM p),
        sp AS (SELECT img, x, y FROM o WHERE k = 0 OR floor(k * least(n, 30) / n) > floor((k - 1) * least(n, 30) / n)),
        l AS (SELECT a.img, a.x AS xa, a.y AS ya, b.x AS xb, (b.y - a.y) / (b.x - a.x) AS slope FROM sp a JOIN sp b ON a.img = b.img AND b.x - a.x >= 5),
        n AS (SELECT l.img, xa, xb, sum((abs(y - ya - slope * (x - xa)) <= 2)::INT)::BIGINT AS inliers FROM l JOIN p ON l.img = p.img WHERE abs(degrees(atan(slope))) <= 25 GROUP BY ALL) SELECT img, max(inliers) AS inliers, count(*) AS pairs FROM n GROUP BY img""",
    "text_x_bounds": """WITH n AS (SELECT DISTINCT l_orderkey % 1000 AS img, l_partkey % 200 AS x FROM lineitem), f AS (SELECT img, x, lag(x) OVER (PARTITION BY img ORDER BY x) AS p FROM n),
        g AS (SELECT *, sum((p IS NULL OR x - p > 3)::INT) OVER (PARTITION BY img ORDER BY x) AS k FROM f), r AS (SELECT img, min(x) AS a, max(x) + 1 AS b FROM g GROUP BY img, k)
        SELECT m.img, coalesce(min(a), -1)::INT AS "left", coalesce(max(b), -1)::INT AS "right" FROM (SELECT DISTINCT img FROM n) m LEFT JOIN r ON m.img = r.img AND b - a >= 3 GROUP BY m.img""",
    "running_median": "SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events",
    "filled_gaps": """WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'click' THEN value END AS v FROM events),
        k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS an, min(CASE WHEN v IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bn FROM e)
        SELECT k.event_id, round(CASE WHEN an = bn THEN a.v WHEN an IS NULL THEN b.v WHEN bn IS NULL THEN a.v ELSE a.v + (b.v - a.v) * ((k.n - an)::DOUBLE / (bn - an)) END, 6) AS filled
        FROM k LEFT JOIN e a ON a.user_id = k.user_id AND a.n = an LEFT JOIN e b ON b.user_id = k.user_id AND b.n = bn""",
    "threshold_sweep": f"""WITH {I.CUT_SCORES}, nb AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM sc WINDOW w AS (PARTITION BY line_id ORDER BY i)), t AS (SELECT * FROM (VALUES (0, 0.45), (1, 0.5), (2, 0.55), (3, 0.6), (4, 0.65)) v(trial, th)),
        c AS (SELECT trial, line_id, count(*) FILTER (s >= th AND s >= coalesce(l, '-inf'::DOUBLE) AND s >= coalesce(r, '-inf'::DOUBLE)) + 1 - 8 AS d FROM nb, t GROUP BY ALL),
        m AS (SELECT trial::BIGINT AS trial, sum(abs(d))::BIGINT AS total_abs_length_error, avg(abs(d)) AS a FROM c GROUP BY ALL)
        SELECT trial, total_abs_length_error, round(a, 6) AS average_abs_length_error, row_number() OVER (ORDER BY a, trial) AS place FROM m""",
    "augment_values": f"""WITH {I.CUT_SCORES} SELECT line_id, string_agg(printf('%02X', round(255 - 0.4::DOUBLE * round(s * 255))::INT), '' ORDER BY i) AS pixels FROM sc GROUP BY line_id""",
    "stream_eval": f"""WITH {I.PAIRS} SELECT 'run' AS run_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS epoch, count(*) AS total, sum((error = '')::INT)::BIGINT AS recognized,
        sum(exact_match)::BIGINT AS exact, sum(levenshtein)::BIGINT AS total_levenshtein FROM measured GROUP BY ALL""",
}
