"""Plans and kernels whose cost must not outgrow the input."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glyphflow.functions import text as T
from glyphflow.operators import augment as A
from glyphflow.operators import batches, decode, evaluate, generate, heatmaps, images, sweep, synthesis
from glyphflow.plans import score_queries

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_of_a_batch_are_those_of_single_columns(spark):
    rows = [(k, n) for k, n in ((0, 0), (7, 1), (10**18 + 3, 130), (-5, 1200), (None, 40), (12, None), (3, 20_000))]
    df = spark.createDataFrame(rows, "id long, n int")
    for seed, share in ((1, 0.002), (-123456789012345678, 0.4), (42, 0.999)):
        slow = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda x: T.hash_below(seed, F.col("id"), x, share) & (x < F.col("n")))
        got = df.select("id", T.places_below(seed, F.col("id"), F.col("n"), share).alias("a"), F.coalesce(slow, F.array().cast("array<int>")).alias("b")).collect()
        assert len(got) == len(rows) and all(r["a"] == r["b"] for r in got)
    assert df.limit(0).select(T.places_below(1, F.col("id"), F.col("n"), 0.5)).count() == 0


def test_flagship_deals_its_lines_out_and_takes_no_digest_per_column(spark):
    plan = physical(score_queries.flagship(spark, SF))
    assert "REPARTITION_BY_NUM" in plan and "_below(" in plan
    assert "md5(cast(concat_ws(:, 1," not in plan


def test_edges_of_all_images_never_go_through_the_driver(spark):
    df = spark.createDataFrame([(k, 40, 12, bytes(480)) for k in range(4)], "line_id long, w int, h int, pixels binary")
    for curved in (True, False):
        plan = physical(heatmaps.straightened(df, lambda image: np.zeros((2, *image.shape)), heatmaps.HeatParams(curved=curved)))
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_image_and_maps_move_in_one_call_as_each_alone():
    rng = np.random.default_rng(5)
    image, maps = rng.random((7, 11)), rng.random((2, 7, 11)).astype(np.float32)
    for name in A.GEOMETRIC:
        own, beside, used = A.moved(image, maps, name, A.rng_for(3, 8, name), {})
        alone, _, again = A.OPS[name](image, A.rng_for(3, 8, name), {})
        assert used == again and np.array_equal(own, alone)
        for k in (0, 1):
            assert np.array_equal(beside[k], np.clip(A.OPS[name](maps[k].astype(float), A.rng_for(3, 8, name), {"fill": 0.0})[0], 0, 1))


def test_patches_are_dealt_out_before_they_are_augmented(spark):
    assert "REPARTITION_BY_NUM" in physical(score_queries.augment_maps(spark, SF))


def test_samples_are_painted_in_as_many_tasks_as_the_session_has(spark, tmp_path, monkeypatch):
    lines = spark.range(40).selectExpr("id as line_id", "concat('ab', id) as text")
    papers = spark.createDataFrame([(k, 20, 9, bytes(180)) for k in range(3)], "b long, bw int, bh int, pixels binary")
    made, plain = [], synthesis.composed
    monkeypatch.setattr(synthesis, "composed", lambda *a: made.append(plain(*a)) or made[0])
    assert synthesis.generate_dataset(lines, papers, str(tmp_path / "d"), synthesis.Sampler("ab0123456789 ", height=24)).count() == 40
    plan = physical(made[0])
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan


def test_window_features_compute_their_values_once(spark):
    df = spark.createDataFrame([(list(map(float, range(3000))),)], "v array<double>")
    took = []
    for radius in (1, 20):
        began = time.time()
        values = F.transform("v", lambda x: F.exp(-x) + x)
        out = df.select(sweep.window_features(values, radius).alias("f")).first()["f"]
        took.append(time.time() - began)
    assert len(out) == 3000 and len(out[0]) == 41 and out[0][:20] == [0.0] * 20 and abs(out[2500][20] - 2500) < 1e-9
    assert took[1] < 20, took


def test_missing_images_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "ROWS", 100)
    tasks = spark.range(2000).selectExpr("id as task_id", "concat('i', id % 900) as image")
    images = spark.range(600).selectExpr("concat('i', id) as image").union(spark.createDataFrame([(None,), ("i5",)], "image string"))
    out = evaluate.mark_missing_images(tasks, images)
    assert physical(out).count(", 20), REPARTITION_BY_NUM") == 2
    want = {(k, "" if k % 900 < 600 else f"image_not_found: i{k % 900}") for k in range(2000)}
    assert {(r["task_id"], r["error"]) for r in out.collect()} == want and out.columns == ["image", "task_id", "error"]


def test_flagship_decodes_scores_of_all_classes(spark, monkeypatch):
    """One-hot scores with noise are read by their best classes; a batch gives what single lines give, across the bounds of its parts."""
    assert "_noisy_texts(" in physical(score_queries.flagship(spark, SF))
    assert score_queries.noisy_scores(np.array([0, 2, 2]), np.array([1]), 3).tolist() == [[1, 0, 0], [2, 0, 1], [0, 0, 1]]
    rng, alphabet = np.random.default_rng(2), " aé漢"
    lengths = np.array([0, 5, 0, 1, 40, 7, 0])
    at = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.integers(0, 3, (at[-1], 6)).astype(np.float32)
    want = []
    for a, b in zip(at, at[1:], strict=False):
        ids = [row.tolist().index(max(row)) for row in scores[a:b]]
        want.append("".join(alphabet[v] for k, v in enumerate(ids) if (k == 0 or ids[k - 1] != v) and v < len(alphabet)))
    for steps in (1, 7, 1000):
        monkeypatch.setattr(decode, "STEPS", steps)
        assert decode.greedy_texts(lambda a, b: scores[a:b], at, alphabet).to_pylist() == want
    assert decode.greedy_texts(lambda a, b: scores[a:b], np.zeros(1, int), alphabet).to_pylist() == []
    assert decode.greedy_texts(lambda a, b: scores[a:b], np.zeros(3, int), alphabet).to_pylist() == ["", ""]


def test_pieces_are_cleaned_once_and_kept_by_what_they_hold(spark):
    df = spark.createDataFrame([("a1é b",), ("1é2",), (" ",), ("",), ("..",)], "text string")
    got = df.select(T.only_known("text", " ab.").alias("a"), T.holds_known("text", "ab.").alias("b")).collect()
    assert [tuple(r) for r in got] == [("a b", True), ("", False), (" ", False), ("", False), ("..", True)]


def test_images_are_straightened_in_one_pass_as_over_tables(spark):
    """No pixels are shuffled, sorted or joined; the rows are those of the job over tables of edges."""
    rng, rows = np.random.default_rng(3), []
    for k in range(30):
        image = np.full((24, 40 + 7 * k), 255, np.uint8)
        for x in range(2, image.shape[1] - 2):
            top = int(4 + rng.integers(0, 3) + x * (k % 5) * 0.02)
            image[top : top + 8 - 7 * (k % 7 == 6), x] = 0
        image[:, : 30 * (k % 4 == 3)] = 255
        rows.append((k, image.shape[1], 24, image.tobytes()))
    rows += [(30, 12, 5, b"\xff" * 60), (31, 0, 0, b""), (32, 3, 3, None), (33, 6, 4, bytes(24))]
    df = spark.createDataFrame(rows, "line_id long, w int, h int, pixels binary")

    def every_second(image):
        return score_queries.ink_edges(image)[:, :, ::2] * np.float32(0.9)

    for heat in (score_queries.ink_edges, every_second):
        for params in (heatmaps.HeatParams(), heatmaps.HeatParams(curved=False, line_pad=0.0, line_pad_px=1.0)):
            at_once = heatmaps.straightened_at_once(df, heat, params)
            assert not any(step in physical(at_once) for step in ("Exchange", "Sort", "Join"))
            got, want = ({r["line_id"]: tuple(r) for r in out.collect()} for out in (at_once, heatmaps.straightened(df, heat, params)))
            assert got == want and len({r[1] for r in got.values()}) > 2
    for query in (score_queries.straightened_lines, score_queries.straight_edges):
        assert "Join" not in physical(query(spark, SF))


def test_kernels_hold_the_results_of_few_images_at_once(spark, tmp_path, monkeypatch):
    frames = [pd.DataFrame({"a": range(n)}) for n in (0, 5, 7)]
    monkeypatch.setattr(batches, "ROWS", 3)
    cut = list(batches.parts(frames))
    assert [len(f) for f in cut] == [3, 2, 3, 3, 1] and [v for f in cut for v in f["a"]] == [*range(5), *range(7)]


def test_samples_and_images_are_made_a_few_at_a_time(spark, monkeypatch):
    """Whatever Spark sends in one batch, a kernel hands over its results in parts."""
    lines = spark.range(50).selectExpr("id as line_id", "concat('ab', id) as text")
    papers = spark.createDataFrame([(k, 20, 9, bytes(180)) for k in range(3)], "b long, bw int, bh int, pixels binary")
    s, kernels = synthesis.Sampler("ab0123456789 ", height=24), []
    plain = type(lines).mapInPandas
    monkeypatch.setattr(type(lines), "mapInPandas", lambda df, f, *a, **k: kernels.append((f, df)) or plain(df, f, *a, **k))
    plan = synthesis.planned(lines, s)
    tiles = synthesis.cropped_tiles(synthesis.background_tiles(plan.select("line_id", "w", "h"), papers, 1), papers)
    synthesis.composed(plan, tiles, s)
    drawn = generate.render(generate.laid_out(lines), height=24)
    A.augment(drawn, {"invert": 1.0})
    images.preprocess_lines(drawn)
    heatmaps.straightened_at_once(drawn, score_queries.ink_edges)
    monkeypatch.undo()
    monkeypatch.setattr(batches, "ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        for f, df in kernels:
            frame = df.toPandas()
            sizes = [len(part) for part in f(iter([frame]))]
            assert len(kernels) == 6 and max(sizes) <= 16 and sum(sizes) == len(frame) >= 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.pyspark.enabled")


def test_drawn_lines_are_read_back_without_a_join_and_in_large_parts(spark, monkeypatch):
    plan = physical(score_queries.render_roundtrip(spark, SF))
    assert "Join" not in plan and plan.count("MapInPandas") == 2
    drawn = pd.DataFrame({"line_id": range(9), "h": 24, "w": [30 + k % 3 for k in range(9)], "pixels": [bytes([255]) * (24 * (30 + k % 3)) for k in range(9)]})
    df, kernels = spark.createDataFrame(drawn.assign(h=24), "line_id long, h int, w int, pixels binary"), []
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda own, f, *a, **k: kernels.append(f) or plain(own, f, *a, **k))
    for batch, rows, sizes in ((1, 256, [9]), (2, 4, [4, 4, 1]), (4, 2, [4, 4, 1])):
        monkeypatch.setattr(batches, "ROWS", rows)
        decode.score_lines(df, lambda stack: [np.ones((2, 3)) / len(stack)] * len(stack), batch=batch)
        out = list(kernels[-1](iter([drawn])))
        assert [len(f) for f in out] == sizes and [v for f in out for v in f["line_id"]] == [0, 3, 6, 1, 4, 7, 2, 5, 8]

    def picky(stack):
        if len(stack) > 1 or stack.shape[2] == 31:
            raise ValueError("no")
        return [np.ones((2, 3))]

    decode.score_lines(df, picky, batch=4)
    out = pd.concat(kernels[-1](iter([drawn])))
    assert out["error"].tolist() == [""] * 3 + ["ValueError: no"] * 3 + [""] * 3 and [len(p) for p in out["p"]] == [2] * 3 + [0] * 3 + [2] * 3


def test_draws_and_samples_are_those_of_plain_ones():
    draws = A.Draws()
    for k, name in ((3, "noise"), (3, "rotate"), (10**17, "noise"), (3, "noise")):
        rng, alone = draws(42, k, name), A.rng_for(42, k, name)
        for draw in (lambda r: r.random(3), lambda r: r.integers(0, 9, 5), lambda r: r.standard_normal(4), lambda r: r.random(), lambda r: r.integers(0, 2**32, 3, np.uint32)):
            assert np.array_equal(draw(rng), draw(alone))
    rng = np.random.default_rng(1)
    for fill, image in ((0.25, rng.random((5, 8))), (np.array([[[0.1]], [[0.7]]]), rng.random((2, 5, 8)))):
        xs, ys = np.append(rng.uniform(-4, 12, 60), [-1e9, 0, 7, 8, -1, 7.5]), np.append(rng.uniform(-4, 9, 60), [2, 0, 4, 4, -1, 1e9])
        want = np.zeros((*image.shape[:-2], len(xs)))
        for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
            left, top = int(np.floor(x)), int(np.floor(y))
            for dy in (0, 1):
                for dx in (0, 1):
                    inside = 0 <= left + dx < 8 and 0 <= top + dy < 5
                    v = image[..., top + dy, left + dx] if inside else np.squeeze(fill)
                    want[..., k] += v * (x - left if dx else 1 - (x - left)) * (y - top if dy else 1 - (y - top))
        assert np.array_equal(A.sample(image, xs[None], ys[None], fill)[..., 0, :], want)


def test_a_generator_is_made_once_for_many_images(spark, monkeypatch):
    made, kernels = [], []
    df = spark.createDataFrame([(k, 4, 6, bytes(range(24))) for k in range(9)], "line_id long, h int, w int, pixels binary")
    plain, philox = type(df).mapInPandas, np.random.Philox
    monkeypatch.setattr(type(df), "mapInPandas", lambda own, f, *a, **k: kernels.append(f) or plain(own, f, *a, **k))
    A.augment(df, {"noise": 1.0, "rotate": 1.0})
    monkeypatch.setattr(A.np.random, "Philox", lambda *a, **k: made.append(1) or philox(*a, **k))
    assert len(pd.concat(kernels[0](iter([df.toPandas()])))) == 9 and len(made) == 1
