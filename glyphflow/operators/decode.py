"""Recognition, segmentation and decoding through cuts, one row per line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions import cuts as C
from glyphflow.functions import scores as S

from . import batches


def recognize(df: DataFrame, alphabet: Column, probs: str = "p", k: int = 1, logits: bool = False) -> DataFrame:
    """K1: ids, confidences, text and the k best classes per timestep of array<array<double>> scores [t][class]."""
    p = F.transform(probs, S.softmax) if logits else F.col(probs)
    out = df.withColumn("_p", p).withColumn("ids", F.transform("_p", S.argmax))
    return out.withColumns({
        "confidences": F.transform("_p", F.array_max), "text": S.ids_to_text(F.col("ids"), alphabet), "candidates": F.transform("_p", lambda v: S.top_k(v, k)),
    }).drop("_p")


#: Timesteps whose scores are held at once: they stay in the cache.
STEPS = 1 << 13


def greedy_texts(scores: Callable[[int, int], np.ndarray], at: np.ndarray, alphabet: str) -> pa.Array:
    """P13, W1 for a whole batch: the texts of lines whose timesteps lie one behind another, line k from at[k] to at[k + 1].

    ``scores`` gives float[b - a, class] of the timesteps a to b; it is asked for ``STEPS`` of them at
    a time. The first of the best classes counts, runs collapse, then classes outside the alphabet go.
    """
    n = int(at[-1])
    ids = np.concatenate([np.zeros(0, np.int64), *(scores(a, min(a + STEPS, n)).argmax(axis=1) for a in range(0, n, STEPS))])
    keep = np.ones(n, bool)
    keep[1:] = ids[1:] != ids[:-1]
    keep[at[:-1][at[:-1] < n]] = True
    keep &= ids < len(alphabet)
    chars = pa.array(list(alphabet), pa.string()).take(pa.array(ids[keep]))
    # The kept characters lie one behind another: a text is a stretch of their bytes.
    ends = np.frombuffer(chars.buffers()[1], np.int32, len(chars) + 1) if len(chars) else np.zeros(1, np.int32)
    places = ends[np.concatenate([[0], np.cumsum(keep)])[at]].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(places.tobytes()), chars.buffers()[2] or pa.py_buffer(b"")])


def timestep_runs(df: DataFrame, key: str = "line_id", ids: str = "ids", confidences: str = "confidences") -> DataFrame:
    """(key, run, start, end, class_id, confidence) for runs of equal ids, ends inclusive."""
    out = df.select(key, confidences, F.posexplode(S.runs(F.col(ids))).alias("run", "r"))
    own = F.slice(F.col(confidences), F.col("r.start") + 1, F.col("r.end") - F.col("r.start") + 1)
    mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)
    return out.select(key, "run", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.value").alias("class_id"), mean.alias("confidence"))


def insert_missing(cuts: list[int], candidates: list[int], values: np.ndarray, least: int, most: int, threshold: float) -> list[int]:
    """Cuts added in the widest intervals above ``most``, until the widest has no candidate (lowest place on full ties)."""
    out, pool = sorted(set(cuts)), sorted(set(candidates))
    while True:
        edges = [0, *out, len(values) - 1]
        wide = max(range(len(edges) - 1), key=lambda i: (edges[i + 1] - edges[i], -i))
        a, b = edges[wide], edges[wide + 1]
        if b - a <= most or a + least > b - least:
            return out
        free = [c for c in pool if a + least <= c <= b - least and c not in out]
        free = free or [c for c in range(a + least, b - least + 1) if c not in out and values[c] >= threshold]
        if not free:
            return out
        best = max(free, key=lambda c: (values[c], -abs(c - (a + b) / 2), -c))
        out = min_gap(sorted({*out, best}), values, least)
        if best not in out:
            return out


def min_gap(cuts: list[int], values: np.ndarray, least: int) -> list[int]:
    kept: list[int] = []
    for c in cuts:
        if not kept or c - kept[-1] >= least:
            kept.append(c)
        elif values[kept[-1]] <= values[c]:
            kept[-1] = c
    return kept


def insert_missing_cuts(df: DataFrame, cuts: str, candidates: str, scores: str, least: int, most: int, threshold: float) -> DataFrame:
    """``df`` with cuts added; the loop depends on its own results, so it runs in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame[cuts], frame[candidates], frame[scores], strict=True)
            done = [insert_missing([*map(int, c)], [*map(int, k)], np.asarray(v), least, most, threshold) if len(v) else [] for c, k, v in rows]
            yield frame.assign(**{cuts: done})

    return df.mapInPandas(run, df.schema)


def segment(
    df: DataFrame, scores: str = "cut_scores", threshold: float = 0.5, candidate_threshold: float = 0.25, distance: int = 2,
    radius: int = 0, least: int = 0, most: int = 0,
) -> DataFrame:
    """K2: candidates, cut_positions, flags, confidences and runs. Peaks use the smoothed scores, confidences the raw ones.

    With ``least`` > 0 cuts closer than that go; with ``most`` > 0 cuts are added in wider intervals.
    """
    out = df.withColumn("_s", S.smooth(F.col(scores), radius))
    out = out.withColumn("candidates", S.select_cut_peaks(F.col("_s"), candidate_threshold, distance)).withColumn("cut_positions", S.select_cut_peaks(F.col("_s"), threshold, distance))
    if least > 0 or most > 0:
        out = out.withColumn("cut_positions", S.enforce_min_gap(F.col("cut_positions"), F.col("_s"), least))
    if most > 0:
        out = insert_missing_cuts(out, "cut_positions", "candidates", "_s", least, most, candidate_threshold)
        out = out.withColumn("cut_positions", S.enforce_min_gap(F.col("cut_positions"), F.col("_s"), least))
    out = out.withColumn("flags", F.transform(S.indices(F.col(scores)), lambda i: F.array_contains("cut_positions", i).cast("int")))
    out = out.withColumn("confidences", F.zip_with("flags", scores, lambda f, s: F.when(f == 1, s).otherwise(1 - s)))
    return out.withColumn("runs", S.runs(F.col("flags"))).drop("_s")


def cut_intervals(df: DataFrame, cuts: str = "cut_positions", left: Column | None = None, right: Column | None = None, mode: str = "auto", ratio: float = 0.45, least: int = 2, ink: tuple[str, str] | None = None, steps: Column | None = None, crop: tuple[int, int] = (0, 0)) -> DataFrame:
    """The intervals between the bounds and the cuts; edges without ink go, narrow ones are merged.

    ``ink`` names the columns with the foreground count of each image column and the image height;
    ``steps`` is the width of the scores where the right bound isn't.

    Each step is a column of its own, so that no expression holds another many times.
    """
    out = df.withColumn("_left", left if left is not None else F.lit(0)).withColumn("_right", right)
    out = out.withColumn("_b", C.promote_edges(F.col(cuts), F.col("_left"), F.col("_right"), mode, ratio, least))
    out = out.withColumn("_e", F.array_sort(F.array_distinct(F.concat(F.array("_b.left"), F.col("_b.cuts"), F.array("_b.right")))))
    out = out.withColumn("_iv", F.filter(C.pairs(F.col("_e")), lambda p: p["end"] > p["start"]))
    if ink:
        out = out.withColumn("_ink", F.transform("_iv", lambda iv: C.has_ink(iv, F.col(ink[0]), F.col(ink[1]), F.col("_right") if steps is None else steps, crop=crop)))
        out = out.withColumn("_iv", C.trim_empty_edges(F.col("_iv"), F.col("_ink"))).drop("_ink")
    for _ in range(2):  # from the left, then from the right
        out = out.withColumn("_iv", F.reverse(C.merge_narrow_start(F.col("_iv"), least)))
    return out.withColumnRenamed("_iv", "intervals").drop("_left", "_right", "_b", "_e")


def interval_classes(df: DataFrame, key: str = "line_id", probs: str = "p", intervals: str = "intervals", fraction: float = 0.6, least: int = 1, k: int = 1) -> DataFrame:
    """Per interval the k best classes by mean probability over its central part: (key, i, start, end, candidates)."""
    # Outer, as the filter inferred for a plain one would be pushed down with all steps of the intervals written out in it.
    rows = df.select(key, probs, F.posexplode_outer(intervals).alias("i", "iv"))
    rows = rows.withColumn("_c", C.central_span(F.col("iv.start"), F.col("iv.end"), fraction, least))
    own = F.slice(F.col(probs), F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start"))
    rows = rows.withColumn("_own", own).where(F.size("_own") > 0)
    sums = F.aggregate(F.slice("_own", F.lit(2), F.size("_own") - 1), F.get("_own", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    rows = rows.withColumn("_mean", F.transform(sums, lambda v: v / F.size("_own")))
    return rows.select(key, "i", F.col("iv.start").alias("start"), F.col("iv.end").alias("end"), S.top_k(F.col("_mean"), k).alias("candidates"))


def decode_with_cuts(
    df: DataFrame, alphabet: Column, key: str = "line_id", probs: str = "p", cuts: str = "cut_positions", widths: tuple[str, str] = ("input_width", "cut_width"),
    mode: str = "auto", fraction: float = 0.6, ink: tuple[str, str] | None = None, bounds: tuple[str, str] | None = None, crop: tuple[int, int] = (0, 0), k: int = 1,
) -> DataFrame:
    """K3: (key, text, symbols): cuts are mapped to score columns, edges promoted, and each interval read by its best class.

    ``bounds`` names the columns with the left and right end of the text in the
    input; where they are null or empty in score columns the whole line is read.
    ``crop`` is what the scores leave out of the input at both sides. A symbol has
    its interval in score columns, the same in cut columns (source_start,
    source_end) and its ``k`` best classes. Lines without an interval that names a
    class have the empty text.
    """
    source, columns, t = F.col(widths[0]), F.col(widths[1]), F.col("_steps")
    inputs = F.transform(F.filter(cuts, lambda c: (c >= 0) & (c < columns)), lambda c: C.half_even((c + 0.5) * source / F.nullif(columns, F.lit(0))))
    mapped = df.withColumn("_steps", F.size(probs)).withColumn("_mapped", F.transform(inputs, lambda c: C.input_to_scores(c, source, t, crop)))
    ends = [C.input_to_scores(F.col(c), source, t, crop) for c in bounds] if bounds else [F.lit(0), t]
    mapped = mapped.withColumn("_from", ends[0]).withColumn("_to", ends[1])
    bounded = F.coalesce(F.col("_to") > F.col("_from"), F.lit(False)) & (F.lit(True) if not bounds else F.col(bounds[0]).isNotNull() & F.col(bounds[1]).isNotNull())
    left, right = F.when(bounded, F.col("_from")).otherwise(F.lit(0)), F.when(bounded, F.col("_to")).otherwise(t)
    whole = cut_intervals(mapped, "_mapped", left, right, mode, ink=ink, steps=t, crop=crop)
    read = interval_classes(whole, key, probs, fraction=fraction, k=k).withColumn("top", F.get("candidates", F.lit(0)))
    symbol = F.struct("i", F.get(alphabet, F.col("top.id")).alias("ch"), F.col("top.value").alias("confidence"), "start", "end", "candidates")
    known = read.where(F.get(alphabet, F.col("top.id")).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(symbol)).alias("symbols"))
    out = df.select(key, F.size(probs).alias("_steps"), columns.alias("_columns")).join(known, key, "left")
    place = lambda c: C.map_boundary(c, t, F.col("_columns"))
    placed = F.transform("symbols", lambda s: s.withField("source_start", place(s["start"])).withField("source_end", place(s["end"])))
    text = F.array_join(F.transform("symbols", lambda s: s["ch"]), "")
    return out.select(key, F.coalesce(text, F.lit("")).alias("text"), placed.alias("symbols"))


def predict_with_cuts(lines: DataFrame, alphabet: Column, key: str = "task_id", probs: str = "p", scores: str = "cut_scores", segmentation: dict | None = None, **decoding) -> DataFrame:
    """(key, pred, error) of lines with class scores and cut scores: segmented (K2), then read through their cuts (K3).

    A line that already has an error, or lacks either score, keeps its row with the
    empty text; the latter with the error ``no_scores``. The result joins to tasks
    as any predictions do.
    """
    lacking = (F.coalesce(F.size(probs), F.lit(0)) <= 0) | (F.coalesce(F.size(scores), F.lit(0)) <= 0)
    error = F.coalesce("error", F.lit("")) if "error" in lines.columns else F.lit("")
    rows = lines.withColumn("error", F.when(error != "", error).when(lacking, "no_scores").otherwise(""))
    cut = segment(rows.where("error = ''"), scores, **(segmentation or {})).withColumn("cut_width", F.size(scores))
    read = decode_with_cuts(cut, alphabet, key, probs, **decoding).select(key, F.col("text").alias("pred"))
    return rows.select(key, "error").join(read, key, "left").select(key, F.coalesce("pred", F.lit("")).alias("pred"), "error")


def score_lines(df: DataFrame, score_fn: Callable[[np.ndarray], np.ndarray], batch: int = 32, keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """K4, F1: lines (keep.., h, w, pixels) scored by a function of a batch uint8[n, h, w] -> list of [t, class].

    Batches are padded with white to their widest line; a failing batch is tried
    line by line, and a failing line keeps its error. Lines are sorted by width
    within a task to limit the padding. Scores go out for many small batches at once.
    """

    def rows(part: pd.DataFrame) -> list[np.ndarray]:
        h, w = int(part["h"].iloc[0]), int(part["w"].max())
        images = np.full((len(part), h, w), 255, np.uint8)
        for k, (px, own) in enumerate(zip(part["pixels"], part["w"], strict=True)):
            images[k, :, :own] = np.frombuffer(px, np.uint8).reshape(h, own)
        full = score_fn(images)
        return [s[: max(1, round(len(s) * own / w))] for s, own in zip(full, part["w"], strict=True)]

    def scored(part: pd.DataFrame) -> tuple[list[np.ndarray], list[str]]:
        try:
            return rows(part), [""] * len(part)
        except Exception as e:
            if len(part) == 1:
                return [np.zeros((0, 0))], [f"{type(e).__name__}: {e}"]
        alone = [scored(part.iloc[j : j + 1]) for j in range(len(part))]
        return [s for out, _ in alone for s in out], [e for _, errors in alone for e in errors]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(["h", "w", *keep])
            for _, same in frame.groupby("h", sort=False):
                many = max(batch, batches.ROWS // batch * batch)
                for k in range(0, len(same), many):
                    part, out, errors = same.iloc[k : k + many], [], []
                    for j in range(0, len(part), batch):
                        own = scored(part.iloc[j : j + batch])
                        out += own[0]
                        errors += own[1]
                    yield pd.DataFrame({**{c: part[c].to_numpy() for c in keep}, "p": [list(np.asarray(s, float)) for s in out], "error": errors})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, "h", "w", "pixels").mapInPandas(run, f"{kinds}, p array<array<double>>, error string")
