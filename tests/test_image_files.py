"""Image files: written, listed in any letter case, decoded, met with tasks."""

import struct

import numpy as np
import pytest

from glyphflow.operators import evaluate
from glyphflow.sources import labels, sinks


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(3)
    grey, colours = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 6, 3), np.uint8)
    rows = [("a.PNG", 5, 7, 1, grey.tobytes()), ("b.Png", 4, 6, 3, colours.tobytes()), ("none.png", 0, 0, 1, None)]
    root = str(tmp_path / "img")
    df = spark.createDataFrame(rows, "name string, h int, w int, c int, pixels binary")
    assert sinks.write_images(df, root) == 2
    assert sinks.write_images(df, root) == 2  # again, over the same files
    sub = tmp_path / "img" / "sub"
    sub.mkdir()
    (sub / "broken.jpg").write_bytes(b"no image")
    (sub / "notes.txt").write_bytes(b"no image either")
    # A bitmap of one red and one blue pixel, bottom row first, rows padded to four bytes.
    body = bytes([255, 0, 0, 0, 0, 255, 0, 0])
    (sub / "c.BMP").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    return root, grey, colours


def test_images_in_grey(spark, folder):
    root, grey, colours = folder
    got = {r.image: r for r in labels.read_images(spark, root).collect()}
    assert set(got) == {"a.PNG", "b.Png", "c.BMP", "broken.jpg"}
    assert (got["a.PNG"].h, got["a.PNG"].w, got["a.PNG"].c, bytes(got["a.PNG"].pixels), got["a.PNG"].error) == (5, 7, 1, grey.tobytes(), "")
    luma = [(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) // 65536 for r, g, b in colours.reshape(-1, 3)]
    assert list(got["b.Png"].pixels) == luma
    assert list(got["c.BMP"].pixels) == [29, 76]
    assert (got["broken.jpg"].h, got["broken.jpg"].pixels, got["broken.jpg"].error) == (None, None, "cannot_decode: broken.jpg")


def test_images_in_colours(spark, folder):
    root, grey, colours = folder
    got = {r.image: r for r in labels.read_images(spark, root, channels=3).collect()}
    assert bytes(got["b.Png"].pixels) == colours.tobytes() and bytes(got["a.PNG"].pixels) == np.repeat(grey, 3).tobytes()
    assert list(got["c.BMP"].pixels) == [0, 0, 255, 255, 0, 0]
    with pytest.raises(ValueError):
        labels.read_images(spark, root, channels=2)


def test_tasks_meet_their_images(spark, folder):
    tasks = spark.createDataFrame([(1, "a.PNG"), (2, "gone.png"), (3, "broken.jpg"), (4, None), (5, "a.PNG")], "task_id long, image string")
    got = {r.task_id: (r.h, r.error) for r in evaluate.with_images(tasks, labels.read_images(spark, folder[0])).collect()}
    assert got == {1: (5, ""), 2: (None, "image_not_found: gone.png"), 3: (None, "cannot_decode: broken.jpg"), 4: (None, "image_not_found: "), 5: (5, "")}


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    assert labels.read_images(spark, str(tmp_path)).count() == 0
