"""Readers: label exports, image and font listings, datasets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.text import unicode_strip

EXPORT = "id bigint, data struct<image:string>, annotations array<struct<result:array<struct<value:struct<text:array<string>>>>>>"
_NESTED = EXPORT.replace("id bigint", "id:bigint").replace("data struct", "data:struct").replace("annotations array", "annotations:array")
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
FONT_ENDINGS = ("ttf", "otf", "ttc")
#: Shares of red, green and blue in luma, of 65536 (fixed values).
LUMA = np.array([19595, 38470, 7471], np.uint32)


def base_name(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit(""))


def flatten_tasks(tasks: DataFrame) -> DataFrame:
    """(task_id, image, gt) of export records: the first non-empty text list of all results, its first text, stripped."""
    lists = F.flatten(F.transform(F.coalesce("annotations", F.array()), lambda a: F.transform(F.coalesce(a["result"], F.array()), lambda r: r["value"]["text"])))
    first = F.get(F.filter(lists, lambda t: t.isNotNull() & (F.size(t) > 0)), F.lit(0))
    gt = F.coalesce(unicode_strip(F.get(first, F.lit(0))), F.lit(""))
    return tasks.select(F.col("id").alias("task_id"), base_name(F.col("data.image")).alias("image"), gt.alias("gt"))


def read_label_export(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Tasks of a JSON array, in file order up to ``limit``."""
    raw = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    if limit is not None:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_NESTED}>>")).alias("at", "task"))
        raw = whole.where(F.col("at") < limit).select("task.*")
    return flatten_tasks(raw)


def list_files(spark: SparkSession, root: str, endings: tuple[str, ...]) -> DataFrame:
    """(path, image) of files below a folder by their ending in any case; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(ending.isin(*endings)).dropDuplicates(["path"]).withColumn("image", base_name(F.col("path")))


def union_paths(listed: DataFrame, explicit: DataFrame, shown: int = 12) -> DataFrame:
    """Listed and explicit paths without repeats, in order; an error names explicit paths that are not there."""
    missing = explicit.join(listed.select("path"), "path", "left_anti").orderBy("path").limit(shown + 1).collect()
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(r["path"] for r in missing[:shown]) + (" ..." if len(missing) > shown else ""))
    both = explicit.select("path", F.lit(0).alias("rank")).unionByName(listed.select("path", F.lit(1).alias("rank")))
    return both.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank", "path").select("path")


def _any_case(endings: tuple[str, ...]) -> str:
    """A path glob of endings in any letter case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings) + "}"


def read_images(spark: SparkSession, root: str, channels: int = 1, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """(path, image, h, w, c, pixels, error) of the images below a folder, by their ending in any case.

    One channel is luma, three are red, green, blue; transparency is left out. A file
    that can't be decoded keeps its row: no pixels, and the error ``cannot_decode``
    with its name. A folder without such files gives no rows.
    """
    if channels not in (1, 3):
        raise ValueError("images have 1 or 3 channels")
    found = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", _any_case(endings)).load(root).select("image.*")
    kinds = "path string, h int, w int, c int, pixels binary"

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.height <= 0:
                    out.append((r.origin, None, None, None, None))
                    continue
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                px = px[..., 2::-1] if r.nChannels >= 3 else px[..., :1]  # Spark stores blue, green, red
                if channels == 1 and px.shape[2] == 3:
                    px = (px.astype(np.uint32) @ LUMA + 32768 >> 16).astype(np.uint8)
                elif channels == 3 and px.shape[2] == 1:
                    px = np.repeat(px, 3, axis=2)
                out.append((r.origin, r.height, r.width, channels, px.tobytes()))
            yield pd.DataFrame(out, columns=["path", "h", "w", "c", "pixels"]).astype({k: "Int32" for k in "hwc"})

    rows = found.mapInPandas(convert, kinds).withColumn("image", base_name(F.col("path")))
    error = F.when(F.col("pixels").isNull(), F.concat(F.lit("cannot_decode: "), F.col("image"))).otherwise("")
    return rows.select("path", "image", "h", "w", "c", "pixels", error.alias("error"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """The texts of a stored dataset alone."""
    return spark.read.parquet(path).select("text")
