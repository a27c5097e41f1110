"""Hand-checkable cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from glyphflow.functions import cuts as C
from glyphflow.functions import labels as LB
from glyphflow.functions import scores as S
from glyphflow.functions import text as T
from glyphflow.operators import decode, evaluate

SCORES = [0.1, 0.8, 0.2, 0.1, 0.6, 0.6, 0.1, 0.05, 0.3, 0.1, 0.05, 0.9]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def array(values, kind="double"):
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def test_ocr_metrics(spark):
    rows = [(1, "HELLO 42", "HELLO 42", ""), (2, "ABC", "ABD", ""), (3, "ABCDEF", "XYZ", ""), (4, "", "", ""), (5, "", "A", ""), (6, "AB", "", "image_not_found"), (7, "éàç", "eac", "")]
    got = evaluate.measured(spark.createDataFrame(rows, "task_id long, gt string, pred string, error string"))
    out = {r["task_id"]: (r["exact_match"], round(r["char_accuracy"], 6), r["levenshtein"]) for r in got.collect()}
    assert out == {1: (1, 1, 0), 2: (0, 0.666667, 1), 3: (0, 0, 6), 4: (1, 1, 0), 5: (0, 0, 1), 6: (0, 0, 2), 7: (0, 0, 3)}
    m = evaluate.ocr_metrics(got, elapsed=2.0).first().asDict()
    assert (m["total"], m["recognized"], m["exact"], m["total_levenshtein"], m["speed"]) == (7, 6, 2, 13, 3.0)
    assert m["line_accuracy"] == pytest.approx(0.285714, abs=1e-6) and m["average_char_accuracy"] == pytest.approx(0.380952, abs=1e-6)
    assert m["global_char_accuracy"] == pytest.approx(0.409091, abs=1e-6) and m["average_levenshtein"] == pytest.approx(1.857143, abs=1e-6)


def test_metrics_of_no_rows(spark):
    empty = spark.createDataFrame([], "gt string, pred string, error string")
    assert evaluate.ocr_metrics(evaluate.measured(empty)).first()["global_char_accuracy"] == 0.0


def test_segmentation_metrics(spark):
    rows = spark.createDataFrame([(5, 5, ""), (4, 6, ""), (7, 6, ""), (3, 0, "err")], "gt_len int, pred_len int, error string")
    errors = evaluate.length_errors(rows)
    assert [r["length_error"] for r in errors.collect()] == [0, 2, -1, -3]
    m = evaluate.segmentation_metrics(errors).first()
    assert (m["evaluated"], m["average_abs_length_error"], m["normalized_length_error"]) == (3, 1.0, 0.1875)
    assert m["average_signed_length_error"] == pytest.approx(1 / 3)


def test_smoothing(spark):
    want = [1 / 3, 0.475, 0.325, 0.25, 0.475, 0.475, 0.2125, 0.125, 0.1875, 0.1375, 0.275, 0.616667]
    assert value(spark, S.smooth(array(SCORES), 1)) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("threshold", "distance", "want"), [(0.5, 1, [1, 4, 5, 11]), (0.5, 3, [1, 5, 11]), (0.25, 1, [1, 4, 5, 8, 11])])
def test_peaks(spark, threshold, distance, want):
    assert value(spark, S.select_cut_peaks(array(SCORES), threshold, distance)) == want


def test_min_gap_and_insertion(spark):
    assert value(spark, S.enforce_min_gap(array([1, 4, 5, 11], "int"), array(SCORES), 3)) == [1, 5, 11]
    assert decode.insert_missing([1, 5, 11], [1, 4, 5, 8, 11], SCORES, 2, 4, 0.12) == [1, 5, 8, 11]
    assert decode.insert_missing([1, 5, 11], [], SCORES, 2, 4, 0.4) == [1, 5, 11]


def test_min_gap_equals_repeated_removal(spark):
    import random

    rnd = random.Random(1)
    rows = []
    for _ in range(60):
        s = [rnd.randint(0, 4) / 4 for _ in range(24)]
        cuts = sorted(rnd.sample(range(24), 9))
        out = list(cuts)
        while bad := next((i for i in range(1, len(out)) if out[i] - out[i - 1] < 4), None):
            out.pop(bad - 1 if s[out[bad - 1]] <= s[out[bad]] else bad)
        rows.append((cuts, s, out))
    df = spark.createDataFrame(rows, "c array<int>, s array<double>, want array<int>")
    assert df.where(S.enforce_min_gap(F.col("c"), F.col("s"), 4) != F.col("want")).count() == 0


@pytest.mark.parametrize(("ids", "want"), [([1, 1, 0, 0, 2, 2, 2, 3, 3], "A BC"), ([1, 9, 1], "AA"), ([1, 1, 1], "A"), ([], "")])
def test_greedy_decode(spark, ids, want):
    assert value(spark, S.ids_to_text(array(ids, "int"), array(" ABC", "string"))) == want


@pytest.mark.parametrize(("a", "b", "fraction", "want"), [(0, 5, 0.6, (1, 4)), (3, 8, 0.6, (4, 7)), (0, 2, 0.6, (0, 1)), (0, 1, 0.6, (0, 1)), (4, 14, 0.25, (8, 10))])
def test_central_span(spark, a, b, fraction, want):
    assert tuple(value(spark, C.central_span(F.lit(a), F.lit(b), fraction))) == want


@pytest.mark.parametrize(("cut", "want"), [(0, 1), (10, 3), (31, 9), (63, 18)])
def test_cut_boundary(spark, cut, want):
    assert value(spark, C.map_cut(F.lit(cut), F.lit(64), F.lit(19))) == want


def test_label_alignment(spark):
    labels = array([0, 0, 1, 1, 1, 2, -100, 2, 2, 3], "int")
    assert value(spark, LB.majority_bins(labels, 4, 4, 0.6)) == [0, 1, 2, 2]
    assert value(spark, LB.majority_bins(labels, 3, 4, 0.6)) == [-100, 1, 2]
    assert value(spark, LB.resample_labels(labels, 4)) == [0, 1, -100, 2]


def spans():
    return F.array(*(F.struct(F.lit(c).alias("ch"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for c, a, b in (("A", 2.0, 6.0), ("B", 6.0, 9.0), (" ", 9.0, 12.0), ("C", 13.0, 16.0))))


def test_dense_and_cut_targets(spark):
    assert value(spark, LB.dense_labels(spans(), array(" ABC", "string"), F.lit(18))) == [0, 0, 1, 1, 1, 1, 2, 2, 2, 0, 0, 0, 0, 3, 3, 3, 0, 0]
    assert value(spark, LB.cut_projection(spans(), F.lit(18), 1)) == [0, 0, 0, 0, 0, 0.5, 1, 0.5, 1, 0.5, 0, 0.5, 1, 0.5, 0, 0, 0, 0]


@pytest.mark.parametrize(("left", "right", "want"), [(0, 18, "AB C"), (5, 17, "B C"), (4, 16, None), (3, 12, "AB"), (0, 8, None)])
def test_crops(spark, left, right, want):
    got = value(spark, LB.crop_spans(spans(), F.lit(left), F.lit(right)))
    assert (None if got is None else "".join(s["ch"] for s in got)) == want


def test_text_functions(spark):
    assert value(spark, T.normalise_spaces(F.lit("  a \t b  "))) == "a \t b"
    assert value(spark, T.encode(F.lit("BA"), array(" AB", "string"), 4)) == [2, 1, 0, 0]
    assert value(spark, T.text_problem(F.lit("AxB"), array(" AB", "string"), 9)) == "unknown: x"
    assert value(spark, T.class_label(F.lit(7), array(" AB", "string"))) == "<7>"


def test_narrow_edges_and_trimming(spark):
    iv = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 1), (1, 5), (5, 9), (9, 10))))
    got = value(spark, F.reverse(C.merge_narrow_start(F.reverse(C.merge_narrow_start(iv, 2)), 2)))
    assert [tuple(x) for x in got] == [(0, 5), (5, 10)]
    ink = array([False, True, True, False], "boolean")
    assert [tuple(x) for x in value(spark, C.trim_empty_edges(iv, ink))] == [(1, 5), (5, 9)]


def test_edge_intervals_without_ink(spark):
    """Ten image columns over five score columns; only the middle ones hold ink."""
    ink = F.array(*map(F.lit, [0, 0, 0, 0, 3, 3, 2, 0, 0, 0]))
    iv = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    got = [value(spark, C.has_ink(iv(a, b), ink, F.lit(40), F.lit(5))) for a, b in [(0, 2), (2, 4), (4, 5), (3, 3), (0, 5)]]
    assert got == [False, True, False, False, True]


def test_encode_text_is_encode(spark):
    from glyphflow.functions import text as T

    abc = "ab é]^-\\"
    alphabet = F.array(*map(F.lit, abc))
    for t in ("", "ab", "é] ^-\\", "aXbéé"):
        known = value(spark, T.only_known(F.lit(t), abc))
        assert known == "".join(c for c in t if c in abc)
        assert value(spark, T.encode_text(F.lit(known), abc, 4)) == value(spark, T.encode(F.lit(known), alphabet, 4))
