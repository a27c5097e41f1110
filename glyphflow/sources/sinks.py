"""Writers: line datasets, reports, logs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_dir(root: str, config: str) -> str:
    """<root>/<config stem>, or below line_chunks for the default root."""
    stem = PurePosixPath(config).stem
    return f"{root.rstrip('/')}/{stem}" if root else f"line_chunks/{stem}"


def write_dataset(lines: DataFrame, path: str, size: int, overwrite: bool = False, row: str = "line_id") -> None:
    """Parquet by chunk of ``size`` rows; refuses to overwrite unless told to."""
    chunked = lines.withColumn("chunk_id", F.floor(F.col(row) / size))
    chunked.repartition("chunk_id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("chunk_id").parquet(path)


def png(image: np.ndarray) -> bytes:
    """uint8[h, w] or uint8[h, w, 3] as a PNG file."""
    h, w = image.shape[:2]
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.zeros((h, 1 + image[0].size), np.uint8)  # each row after the number of its filter, 0
    lines[:, 1:] = image.reshape(h, -1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def write_images(images: DataFrame, root: str) -> int:
    """Writes images (name, h, w, c, pixels) as PNG files below a folder that all executors share; their number.

    A task writes its own rows, each file under a name of its own first, then moved:
    what is there is whole, and a repeated task writes the same files again. Rows
    without pixels are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        for frame in frames:
            for r in frame.itertuples(index=False):
                px = np.frombuffer(r.pixels, np.uint8).reshape((r.h, r.w) if r.c == 1 else (r.h, r.w, 3))
                own = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(png(px))
                store.move(own, f"{folder}/{r.name}")
            yield pd.DataFrame({"n": [len(frame)]})

    rows = images.where(F.length("pixels") > 0).select("name", "h", "w", "c", "pixels")
    return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_csv(rows: DataFrame, columns: tuple[str, ...], path: str) -> None:
    """A report with a header and fixed columns."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, formats: dict[str, str], path: str) -> None:
    """Tab-separated lines appended, with fixed decimals per column (e.g. {"loss": "%.8f"})."""
    out = rows.select(*(F.format_string(formats[c], F.col(c)).alias(c) if c in formats else F.col(c) for c in rows.columns))
    out.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def sample_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per sample."""
    return rows.withColumn("metadata", F.to_json(F.struct(*columns)))
