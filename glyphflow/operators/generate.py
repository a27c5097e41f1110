"""Generating labelled text lines: sampling, layout, crops, rendering.

Glyphs come from an atlas built by a rule: the 5x7 bitmap of a character is taken
from the bits of its MD5 digest, with its outer columns inked, so every character
has a shape of its own at any size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.labels import clean_spans, crop_texts, crops, glyph_layout, spans_text
from glyphflow.functions.text import chars, hash_draw, hash_uniform

from .batches import parts

GLYPH_W, GLYPH_H = 5, 7


def line_text(row: Column, alphabet: Column, seed: int, words: tuple[int, int] = (6, 18), lengths: tuple[int, int] = (2, 8)) -> Column:
    """A line of words; their number, lengths and characters are hash draws of the row. ``alphabet`` has no space."""
    count = words[0] + hash_draw(seed, row, 0) % (words[1] - words[0] + 1)

    def word(w: Column) -> Column:
        length = lengths[0] + hash_draw(seed, row, F.concat_ws(".", F.lit("n"), w)) % (lengths[1] - lengths[0] + 1)
        one = lambda c: F.get(alphabet, (hash_draw(seed, row, F.concat_ws(".", F.lit("c"), w, c)) % F.size(alphabet)).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(1), length.cast("int")), one), "")

    return F.array_join(F.transform(F.sequence(F.lit(1), count.cast("int")), word), " ")


def short_text(row: Column, alphabet: Column, seed: int, lengths: tuple[int, int], fits, tries: int = 4) -> Column:
    """A text of uniform length and characters; the first of ``tries`` that is not empty and that ``fits`` accepts."""

    def attempt(k: int) -> Column:
        length = lengths[0] + hash_draw(seed, row, f"l{k}") % (lengths[1] - lengths[0] + 1)
        one = lambda c: F.get(alphabet, (hash_draw(seed, row, F.concat_ws(".", F.lit(f"t{k}"), c)) % F.size(alphabet)).cast("int"))
        return F.array_join(F.filter(F.split(F.array_join(F.transform(F.sequence(F.lit(1), length.cast("int")), one), ""), " "), lambda x: x != ""), " ")

    return F.coalesce(*(F.when((F.char_length(t) > 0) & fits(t), t) for t in map(attempt, range(tries))))


def style(row: Column, seed: int, spacing: tuple[float, float] = (-0.4, 1.6), words: tuple[float, float] = (0.75, 1.7)) -> Column:
    """D3: struct<spacing, word_factor>, one draw per line."""
    between = lambda u, r: u * (r[1] - r[0]) + r[0]
    return F.struct(between(hash_uniform(seed, row, "s"), spacing).alias("spacing"), between(hash_uniform(seed, row, "w"), words).alias("word_factor"))


def advances(text: Column, scale: int = 1) -> Column:
    """Plain advances of the atlas: narrow for a space and thin characters."""
    wide = lambda c: F.when(c == " ", 4).when(F.lit(".,:;!|il'").contains(c), 4).otherwise(GLYPH_W + 1)
    return F.transform(chars(text), lambda c: (wide(c) * scale).cast("double"))


def laid_out(lines: DataFrame, text: str = "text", row: str = "line_id", seed: int = 42, padding: int = 8, scale: int = 1) -> DataFrame:
    """Lines with spans and the width they need."""
    out = lines.withColumn("_style", style(F.col(row), seed))
    spans = glyph_layout(chars(F.col(text)), advances(F.col(text), scale), F.col("_style.spacing"), F.col("_style.word_factor"), F.lit(float(padding)))
    out = out.withColumn("spans", spans)
    return out.withColumn("width", F.coalesce(F.ceil(F.array_max(F.col("spans")["x1"])), F.lit(padding)).cast("int") + padding).drop("_style")


def fits(spans: Column, width: int, padding: int) -> Column:
    """Whether laid-out spans fit into a width."""
    return F.coalesce(F.array_max(spans["x1"]) - F.array_min(spans["x0"]), F.lit(0.0)) <= width - 2 * padding


def font_choice(row: Column, sizes: list[int], need: Column, room: Column, seed: int) -> Column:
    """A size drawn among those that fit (``need`` per unit of size), else the smallest."""
    ok = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda s: s * need <= room)
    return F.when(F.size(ok) > 0, F.get(ok, (hash_draw(seed, row, "font") % F.greatest(F.size(ok), F.lit(1))).cast("int"))).otherwise(F.lit(min(sizes)))


def fitting_backgrounds(requests: DataFrame, backgrounds: DataFrame, seed: int, row: str = "line_id") -> DataFrame:
    """Per request (row, w, h) one background (b, bw, bh) at least as large, by hash; ``largest`` where none fits.

    Requests meet the distinct sizes of backgrounds, then one background of a drawn
    size: no row is paired with all backgrounds.
    """
    sizes = backgrounds.groupBy("bw", "bh").agg(F.count("*").alias("n"))
    need = requests.select("w", "h").distinct()
    options = need.join(sizes, (F.col("bw") >= F.col("w")) & (F.col("bh") >= F.col("h"))).groupBy("w", "h").agg(F.array_sort(F.collect_list(F.struct("bw", "bh", "n"))).alias("options"), F.sum("n").alias("total"))
    top = backgrounds.agg(F.max(F.struct("bw", "bh", "b")).alias("largest"))
    drawn = requests.join(options, ["w", "h"], "left").withColumn("_pick", F.when(F.col("total") > 0, hash_draw(seed, F.col(row), "bg") % F.col("total")))

    def at(acc: Column, o: Column) -> Column:
        inside = acc["bw"].isNull() & (acc["left"] < o["n"])
        return F.struct((acc["left"] - F.when(acc["bw"].isNull() & ~inside, o["n"]).otherwise(0)).alias("left"), F.when(inside, o["bw"]).otherwise(acc["bw"]).alias("bw"), F.when(inside, o["bh"]).otherwise(acc["bh"]).alias("bh"))

    none = F.struct(F.col("_pick").cast("long").alias("left"), F.lit(None).cast(backgrounds.schema["bw"].dataType).alias("bw"), F.lit(None).cast(backgrounds.schema["bh"].dataType).alias("bh"))
    chosen = drawn.withColumn("_at", F.aggregate("options", none, at)).select(*requests.columns, F.col("_at.bw").alias("bw"), F.col("_at.bh").alias("bh"), F.col("_at.left").alias("place"))
    from pyspark.sql import Window as W

    numbered = backgrounds.select("b", "bw", "bh", (F.row_number().over(W.partitionBy("bw", "bh").orderBy("b")) - 1).cast("long").alias("place"))
    return chosen.join(numbered, ["bw", "bh", "place"], "left").crossJoin(F.broadcast(top)).select(*requests.columns, "b", F.when(F.col("b").isNull(), F.col("largest.b")).alias("largest"))


def line_crops(lines: DataFrame, width: int, stride: int, lengths: tuple[int, int] = (1, 1 << 30), row: str = "line_id") -> DataFrame:
    """(row, left, text, spans) for the crops of lines with spans and width; crops with a half-visible character go."""
    found = lines.select(row, F.explode(crops(F.col("spans"), _lefts(width, stride), F.lit(width))).alias("c"))
    return found.select(row, "c.left", "c.text", "c.spans").where(F.char_length("text").between(*lengths))


def _lefts(width: int, stride: int) -> Column:
    many = F.col("width") >= width
    return F.when(many, F.sequence(F.lit(0), F.greatest(F.col("width") - width, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def crop_labels(lines: DataFrame, width: int, stride: int, lengths: tuple[int, int] = (1, 1 << 30), row: str = "line_id") -> DataFrame:
    """(row, left, text) as ``line_crops`` gives them, for jobs that don't read the spans."""
    found = lines.select(row, F.explode(crop_texts(F.col("spans"), _lefts(width, stride), F.lit(width))).alias("c"))
    return found.select(row, "c.left", "c.text").where(F.char_length("text").between(*lengths))


def baseline_rows(spans: Column, top: Column, bottom: Column, width: Column, height: Column, radius: int = 2) -> Column:
    """array<struct<channel, y, x0, x1, value>>: rows of a triangle around the two lines, full width without text."""
    x0 = F.greatest(F.lit(0), F.coalesce(F.floor(F.array_min(spans["x0"])), F.lit(0))).cast("int")
    x1 = F.least(width, F.coalesce(F.ceil(F.array_max(spans["x1"])), width)).cast("int")

    def rows(channel: int, y: Column) -> Column:
        centre = F.bround(y, 0).cast("int")
        near = F.filter(F.sequence(centre - radius, centre + radius), lambda v: (v >= 0) & (v < height))
        return F.transform(near, lambda v: F.struct(F.lit(channel).alias("channel"), v.alias("y"), x0.alias("x0"), x1.alias("x1"), (1 - F.abs(v - centre) / (radius + 1.0)).alias("value")))

    return F.concat(rows(0, top), rows(1, bottom))


def neighbour_layout(row: Column, seed: int, height: Column, line_height: Column, probability: float = 0.7, visible: tuple[float, float] = (0.1, 0.4), gap: tuple[int, int] = (1, 4)) -> Column:
    """struct<above, below>: where a neighbour line begins (null: none), mostly outside the image, a gap from the main line."""
    main = F.floor((height - line_height) / 2)

    def one(side: str) -> tuple[Column, Column, Column]:
        seen = F.greatest(F.lit(1), F.floor(line_height * (visible[0] + hash_uniform(seed, row, f"v{side}") * (visible[1] - visible[0]))))
        space = gap[0] + hash_draw(seed, row, f"g{side}") % (gap[1] - gap[0] + 1)
        return hash_uniform(seed, row, f"p{side}") < probability, seen, space

    on_a, seen_a, gap_a = one("a")
    on_b, seen_b, gap_b = one("b")
    above = F.least(seen_a, main - gap_a) - line_height
    below = F.greatest(height - seen_b, main + line_height + gap_b)
    return F.struct(F.when(on_a & (main - gap_a > 0), above).alias("above"), F.when(on_b & (below < height), below).alias("below"))


def glyph(ch: str) -> np.ndarray:
    """uint8[7, 5] of 0 and 1."""
    if ch == " ":
        return np.zeros((GLYPH_H, GLYPH_W), np.uint8)
    bits = np.unpackbits(np.frombuffer(hashlib.md5(ch.encode()).digest(), np.uint8))[: GLYPH_H * GLYPH_W].reshape(GLYPH_H, GLYPH_W).copy()
    bits[0, 0] = bits[-1, -1] = bits[GLYPH_H // 2, 0] = bits[GLYPH_H // 2, -1] = 1
    return bits


@lru_cache(1 << 16)
def enlarged(ch: str, scale: int) -> np.ndarray:
    """The ink of a glyph at a scale."""
    return np.kron(glyph(ch), np.ones((scale, scale), np.uint8)).astype(bool)


def draw(canvas: np.ndarray, spans: list, top: int, scale: int, ink: int = 0) -> None:
    """Blits glyphs into uint8[h, w] at their spans; what lies outside is cut off."""
    h, w = canvas.shape
    for ch, x0, _ in spans:
        g = enlarged(ch, scale)
        x, y = math.floor(x0), top
        a, b, c, d = max(0, -y), min(g.shape[0], h - y), max(0, -x), min(g.shape[1], w - x)
        if a < b and c < d:
            canvas[y + a : y + b, x + c : x + d][g[a:b, c:d]] = ink


def drawn(widths: np.ndarray, ch: list[np.ndarray], x0: list[np.ndarray], height: int, top: int, scale: int, paper: int) -> list[np.ndarray]:
    """The images of a few lines, uint8[height, width] each: as ``draw`` blits every glyph, for all glyphs at once."""
    ends = np.cumsum(height * widths)
    pixels = np.full(int(ends[-1]) if len(ends) else 0, paper, np.uint8)
    line = np.repeat(np.arange(len(ch)), [len(c) for c in ch])
    if len(line):
        names, kind = np.unique(np.concatenate(ch).astype(str), return_inverse=True)
        ink = np.array([enlarged(str(c), scale) for c in names])
        y, x = top + np.arange(ink.shape[1])[:, None], np.floor(np.concatenate(x0)).astype(np.int64)[:, None, None] + np.arange(ink.shape[2])
        wide = widths[line][:, None, None]
        seen = ink[kind] & (y >= 0) & (y < height) & (x >= 0) & (x < wide)
        pixels[((ends - height * widths)[line][:, None, None] + y * wide + x)[seen]] = 0
    return [p.reshape(height, w) for p, w in zip(np.split(pixels, ends[:-1]), widths.tolist(), strict=True)] if len(ends) else []


def render(lines: DataFrame, height: int = 32, scale: int = 2, paper: int = 255, row: str = "line_id") -> DataFrame:
    """Lines with spans and width drawn: (row, text, h, w, c, pixels, top, bottom)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts(frames):
            top = (height - GLYPH_H * scale) // 2
            images = [p.tobytes() for p in drawn(frame["width"].to_numpy(np.int64), list(frame["ch"]), list(frame["x0"]), height, top, scale, paper)]
            yield pd.DataFrame({row: frame[row], "text": frame["text"], "h": height, "w": frame["width"], "c": 1, "pixels": images, "top": float(top), "bottom": float(top + GLYPH_H * scale - 1)})

    return lines.select(row, "text", "spans.ch", "spans.x0", "width").mapInPandas(run, f"{row} long, text string, h int, w int, c int, pixels binary, top double, bottom double")


def cleaned(lines: DataFrame) -> DataFrame:
    """Lines whose spans have no leading, doubled or trailing space, with their text."""
    return lines.withColumn("spans", clean_spans(F.col("spans"))).withColumn("text", spans_text(F.col("spans")))
