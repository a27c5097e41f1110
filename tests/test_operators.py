"""Images, augmentation, datasets, sources, streaming and the registry."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.operators import audit, augment, dataset, generate, images, sweep
from glyphflow.sources import labels, sinks


@pytest.fixture(scope="module")
def drawn(spark):
    lines = spark.createDataFrame([(1, "HELLO world"), (2, "a b"), (3, "text line 42")], "line_id long, text string")
    return generate.render(generate.laid_out(lines, padding=6, scale=2), height=40, scale=2).cache()


def test_rendering_is_deterministic(drawn):
    rows = drawn.collect()
    assert all(len(r["pixels"]) == r["h"] * r["w"] and np.frombuffer(r["pixels"], np.uint8).min() == 0 for r in rows)


def test_preparing_sizes(drawn):
    rows = drawn.withColumn("src", F.col("w"))
    done = images.preprocess_lines(rows, images.Params(height=16, scale_x=0.9, x_pad=0.05, y_pad=-0.1), keep=("line_id", "src"))
    want = images.prepared_size(F.col("src"), F.lit(40), 16, 0.9, 0.05, -0.1)
    assert done.where((F.col("w") != want["w"]) | (F.col("h") != want["h"])).count() == 0


def test_trial_columns_take_the_place_of_defaults(spark, drawn):
    trials = sweep.trial_grid(spark, scale_x=[0.5, 1.0])
    done = images.preprocess_lines(sweep.with_trials(drawn, trials), images.Params(height=20), keep=("line_id", "trial"))
    w = {(r["line_id"], r["trial"]): r["w"] for r in done.collect()}
    assert all(abs(w[k, 0] * 2 - w[k, 1]) <= 1 for k in (1, 2, 3))


def test_line_detection_on_a_tilted_line():
    image = np.full((48, 200), 255, np.uint8)
    for x in range(20, 180, 8):
        y = 20 + round(x * 0.05)
        image[y : y + 10, x : x + 5] = 0
    mask = images.clean_mask(images.text_masks(image)[0])
    found = images.surest(images.profile_lines(mask, images.LOWER))
    assert found["slope"] == pytest.approx(0.05, abs=0.01) and found["confidence"] > 0.5
    out, status = images.baseline_cropped(image, vars(images.Params()))
    assert status == "ok_deskewed" and out.shape[0] < image.shape[0]
    assert images.baseline_cropped(np.full((20, 40), 255, np.uint8), vars(images.Params()))[1] == "not_enough_foreground"


def test_weighted_fit_is_polyfit():
    rng = np.random.default_rng(1)
    x, w = np.arange(20.0), rng.uniform(0.5, 2, 20)
    y = 0.3 * x + rng.standard_normal(20)
    assert images.line_fit(x, y, w) == pytest.approx(np.polyfit(x, y, 1, w=w))


def test_column_quantiles():
    mask = np.zeros((11, 2), bool)
    mask[[1, 2, 10], 0] = True
    assert images.profile_points(mask, 0.88)[1][0] == pytest.approx(8.08)


def test_components():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1]], bool)
    assert images.components(mask)[1] == 3


def test_every_augmentation(drawn):
    rows = drawn.withColumn("dense", F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: (x % 5).cast("int")))
    out = augment.augment(rows, dict.fromkeys(augment.ORDER, 1.0), target="dense")
    one, two = (sorted((r["line_id"], r["pixels"], r["log"]) for r in d.collect()) for d in (out, augment.augment(rows.repartition(3), dict.fromkeys(augment.ORDER, 1.0), target="dense")))
    assert one == two
    assert [x["name"] for x in json.loads(one[0][2])] == list(augment.ORDER)
    assert out.where(F.size("dense") != F.col("w")).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        augment.augment(rows, {"melt": 1.0})


def test_target_moves_with_the_image():
    rng = augment.rng_for(1, 2, "cycle_shift")
    image = np.zeros((4, 10))
    image[:, 3] = 1
    out, cols, used = augment.OPS["cycle_shift"](image, rng, {"max_dy": 0})
    assert augment.warp_target(np.arange(10) == 3, cols, True, 0).argmax() == out[0].argmax() == (3 + used["dx"]) % 10


def test_split_lookup_and_faults(spark):
    rows = spark.range(1000).withColumnRenamed("id", "line_id")
    split = dataset.exact_split(rows, "line_id", 0.137, 5)
    assert split.where("split = 'val'").count() == 137 and split.count() == 1000
    manifest = dataset.chunk_manifest(dataset.with_chunks(rows, 300))
    got = {r["index"]: (r["chunk_id"], r["local"]) for r in dataset.lookup(manifest, spark.createDataFrame([(0,), (299,), (300,), (-1,), (5000,)], "index long")).collect()}
    assert got == {0: (0, 0), 299: (0, 299), 300: (1, 0), -1: (3, 99)}
    bad = spark.createDataFrame([(2, 2, 1, b"1234", [1, 2]), (2, 2, 1, b"123", [1]), (1, 1, 1, b"1", None)], "w int, h int, c int, pixels binary, dense array<int>")
    assert {r["fault"]: r["n"] for r in dataset.chunk_faults(bad).collect()} == {"pixels": 1, "dense": 1}
    assert json.loads(dataset.metadata(dataset.with_chunks(rows, 300), {"format": "lines"}).first()[0])["chunk_count"] == 4
    assert [tuple(r) for r in dataset.chunk_specs(spark, 7, 3).orderBy("chunk_id").collect()] == [(0, 0, 3), (1, 3, 6), (2, 6, 7)]


def test_label_export_and_reports(spark, tmp_path):
    export = [
        {"id": 1, "data": {"image": "/d/up/a.png"}, "annotations": [{"result": [{"value": {"text": []}}, {"value": {"text": [" X 1 "]}}]}]},
        {"id": 2, "data": {}, "annotations": []},
    ]
    (tmp_path / "e.json").write_text(json.dumps(export))
    assert [tuple(r) for r in labels.read_label_export(spark, str(tmp_path / "e.json")).orderBy("task_id").collect()] == [(1, "a.png", "X 1"), (2, "", "")]
    assert labels.read_label_export(spark, str(tmp_path / "e.json"), limit=1).count() == 1
    (tmp_path / "img" / "sub").mkdir(parents=True)
    for name in ("a.PNG", "sub/b.png", "c.txt"):
        (tmp_path / "img" / name).write_bytes(b"x")
    listed = labels.list_files(spark, str(tmp_path / "img"), labels.IMAGE_ENDINGS)
    assert {r["image"] for r in listed.collect()} == {"a.PNG", "b.png"}
    with pytest.raises(FileNotFoundError):
        labels.union_paths(listed, spark.createDataFrame([("nowhere.png",)], "path string"))
    log = spark.createDataFrame([(0, 0.5)], "epoch int, loss double")
    sinks.append_log(log, {"loss": "%.8f"}, str(tmp_path / "log"))
    sinks.append_log(log, {"loss": "%.8f"}, str(tmp_path / "log"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "log")).where("loss = '0.50000000'").count() == 2
    lines = spark.range(10).withColumnRenamed("id", "line_id")
    sinks.write_dataset(lines, str(tmp_path / "set"), 4)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_dataset(lines, str(tmp_path / "set"), 4)
    assert sinks.output_dir("root", "a/b/eng.yaml") == "root/eng"


def test_coverage(spark):
    provided = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "a")], "source string, ch string")
    sources = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "source string")
    need = spark.createDataFrame([("a",), ("b",)], "ch string")
    out = {r["source"]: (r["accepted"], r["missing"]) for r in audit.coverage_report(sources, provided, need).collect()}
    assert out == {"f1": (True, ""), "f2": (False, "b"), "f3": (False, "a, b")}


def test_stream_drops_repeated_predictions(spark, tmp_path):
    from glyphflow.streaming.evaluate import evaluate_stream

    tasks = spark.createDataFrame([(1, "ab"), (2, "cd")], "task_id long, gt string")
    seen = []
    for part in ([("r", 0, 1, "ab", None), ("r", 0, 2, "cx", None)], [("r", 0, 1, "zz", None), ("r", 1, 1, "ab", None)]):
        spark.createDataFrame(part, "run_id string, epoch int, task_id long, pred string, error string").write.mode("append").parquet(f"{tmp_path}/in")
        evaluate_stream(spark, f"{tmp_path}/in", tasks, f"{tmp_path}/rows", f"{tmp_path}/metrics", f"{tmp_path}/state", on_epoch=lambda m: seen.append(m.count())).awaitTermination()
    out = sorted((r["epoch"], r["total"], r["exact"]) for r in spark.read.parquet(f"{tmp_path}/metrics").collect())
    assert out == [(0, 2, 1), (1, 1, 1)] and seen == [1, 1]


def test_registry_has_an_oracle_only_for_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_split_with_one_heavy_hash(spark):
    from glyphflow.operators.dataset import exact_split

    rows = spark.createDataFrame([(1,)] * 300 + [(k,) for k in range(2, 200)], "line_id long")
    for fraction in (0.0, 0.1, 0.5, 1.0):
        got = exact_split(rows, "line_id", fraction, 3)
        assert got.count() == rows.count()
        assert got.where("split = 'val'").count() == max(1, int(rows.count() * fraction))


def test_lookup_of_uneven_chunks(spark):
    from glyphflow.operators import dataset

    sizes = {0: 1, 3: 500, 4: 2, 5000: 7, 9000: 90}
    lines = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "chunk_id long")
    manifest = dataset.chunk_manifest(lines)
    want, at = {}, 0
    for c, n in sizes.items():
        want |= {at + k: (c, k) for k in range(n)}
        at += n
    assert {r["chunk_id"]: r["end"] for r in manifest.collect()} == {0: 1, 3: 501, 4: 503, 5000: 510, 9000: 600}
    index = spark.range(-at, at + 5).toDF("index")
    assert {r["index"]: (r["chunk_id"], r["local"]) for r in dataset.lookup(manifest, index).collect()} == {i: want[i % at] for i in range(-at, at)}


def test_morphology_follows_its_configuration():
    import numpy as np

    from glyphflow.operators import augment

    image, rng = np.ones((9, 9)), np.random.default_rng(1)
    image[4, 4] = 0
    assert augment.morphology(image, rng, {"size": 1})[0] is image
    grown, _, log = augment.morphology(image, rng, {"size": 4, "operation": "dilate"})
    assert (grown == 0).sum() == 25 and log == {"operation": "dilate", "size": 5}
    seen = {augment.morphology(image, rng, {"size": (2, 3)})[2]["operation"] for _ in range(40)}
    assert seen == {"dilate", "erode"}


def test_ransac_counts_all_points():
    import numpy as np

    from glyphflow.operators import images

    x = np.arange(200.0)
    y = 0.1 * x + 5
    y[::3] += 9  # outliers that a sparse sample could follow
    slope, icpt = images.ransac(x, y, 200.0, 2.0)
    assert abs(slope - 0.1) < 0.03 and (np.abs(y - slope * x - icpt) <= 2).sum() >= 130
    turned = images.rotate(np.zeros((10, 40), np.uint8), 30, 255)
    assert turned.shape == (29, 40) and abs(int((turned < 128).sum()) - 400) <= 40


def test_a_replayed_batch_is_counted_once(spark, tmp_path):
    from glyphflow.streaming.evaluate import evaluate_stream

    tasks = spark.createDataFrame([(1, "ab"), (2, "cd")], "task_id long, gt string")
    spark.createDataFrame([("r", 0, 1, "ab", ""), ("r", 0, 2, "c", "")], "run_id string, epoch int, task_id long, pred string, error string").write.parquet(f"{tmp_path}/in")
    paths = [f"{tmp_path}/{p}" for p in ("in", "rows", "metrics")]
    for state in ("first", "second"):  # a fresh checkpoint runs batch 0 again over what it has stored
        evaluate_stream(spark, paths[0], tasks, *paths[1:], f"{tmp_path}/{state}").awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 2
    assert [(r["total"], r["exact"]) for r in spark.read.parquet(paths[2]).collect()] == [(2, 1)]


def test_baseline_maps_move_with_the_image(spark):
    image = np.zeros((24, 40), np.uint8)
    image[10:13, 5:30] = 255
    maps = np.stack([image / 255.0, np.roll(image, 6, 0) / 255.0])
    df = spark.createDataFrame([(k, 24, 40, image.tobytes(), maps.reshape(-1).tolist()) for k in range(6)] + [(9, 24, 40, image.tobytes(), None)], "line_id long, h int, w int, pixels binary, baseline array<double>")
    moved = augment.augment(df, dict.fromkeys(augment.GEOMETRIC, 1.0), target="baseline").collect()
    for r in moved:
        if r["line_id"] == 9:
            assert r["baseline"] is None
            continue
        out = np.array(r["baseline"]).reshape(2, 24, 40)
        assert out[0] == pytest.approx(np.frombuffer(r["pixels"], np.uint8).reshape(24, 40) / 255.0, abs=0.003)
    grey = augment.augment(df, {"noise": 1.0, "invert": 1.0}, target="baseline").where("line_id < 9").collect()
    assert all(r["baseline"] == maps.reshape(-1).tolist() for r in grey)


def test_running_median_by_windows():
    y = np.random.default_rng(5).random(31)
    for radius in (0, 1, 4, 15, 40):
        assert images.median_smooth(y, radius) == pytest.approx([np.median(y[max(0, i - radius) : i + radius + 1]) for i in range(31)])
