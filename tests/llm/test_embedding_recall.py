"""Recall of the p-stable tables on planted pairs, the bound of the sketches, and rows in the table more than once."""

import numpy as np
from pyspark.sql import functions as F

from glyphflow.llm import embedding_dedup


def planted(rng, n, dim):
    """n unit vectors, and for each one a partner at a cosine between 0.9005 and 0.93."""
    x = embedding_dedup.unit(rng.standard_normal((n, dim)))
    side = rng.standard_normal((n, dim))
    side = embedding_dedup.unit(side - (side * x).sum(1, keepdims=True) * x)
    cos = rng.uniform(0.9005, 0.93, (n, 1))
    return np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * side])


def test_recall_of_planted_pairs(spark):
    x = planted(np.random.default_rng(11), 1500, 48).astype(np.float32)
    rows = [(k, v.tolist(), 0, 1) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int, h1 int").withColumn("tbl", F.lit("x"))
    out = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    u = embedding_dedup.unit(x.astype(np.float64))
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    want, got = close.sum(1), out["n_links"].to_numpy()
    assert (got <= want).all() and want.sum() >= 2998
    assert got.sum() >= 0.998 * want.sum()


def test_sketches_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 700):
        x = planted(rng, 60, dim) if dim > 1 else np.array([[1.0], [-1.0], [1.0]])
        x[0] = embedding_dedup.unit(np.eye(1, dim) + 1e-3)[0]  # one large component, the others vanish in a byte
        small, step, error = embedding_dedup.sketches(x)
        possible = embedding_dedup.possible_partners(small, step, error, 0.9)
        assert (possible | (x @ x.T < 0.9)).all()
        if dim == 64:
            assert possible.sum() < 4 * len(x)


def test_repeated_rows_and_signed_zeros(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [2.0, -0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (7, None), (7, None)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out.collect())
    assert got == [(0, 0, 0, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (7, 0, 7, True), (7, 0, 7, True), (9, 0, 9, True)]
