"""Near duplicates among rows that share an id or have none, and lists that are dealt or too long to hold."""

import numpy as np
import pyarrow as pa
import pytest

from glyphflow.llm import jaccard_join

PROSE = "one two three four five six seven eight nine ten eleven twelve"


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline

    rows = [(7, PROSE), (7, PROSE), (None, PROSE), (8, PROSE), (7, "something else that is said here once"), (None, "alone"), (9, None), (9, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _row string, component_id string")
    out = corpus_pipeline.near_duplicate_filter(spark, df, "")
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == [(0, "alone"), (7, PROSE), (7, "something else that is said here once"), (9, ""), (9, "")]


@pytest.mark.parametrize("dealt", [False, True])
def test_long_lists_keep_every_member(monkeypatch, dealt):
    monkeypatch.setattr(jaccard_join, "HELD", 50)
    rows = [(1, -1, 100, c) for c in range(3)] + [(2, c % 3 if dealt else -1, 100 + c // 40, 1000 + c) for c in range(400)] + [(3, -1, 10, 5), (3, -1, 90, 6)]
    rows.sort()
    columns = [pa.array([r[k] for r in rows]) for k in range(4)]
    whole = pa.RecordBatch.from_arrays(columns, names=["key", "part", "n", "cls"])
    out = [b for b in jaccard_join._lists(85)(iter([whole.slice(a, 37) for a in range(0, len(rows), 37)]))]
    table = pa.Table.from_batches(out)
    few = [x for x in table.column("few").to_pylist() if x]
    long = {}
    for name, cls, lead in zip(*(table.column(c).to_pylist() for c in ("list", "cls", "lead")), strict=True):
        if cls is not None:
            long.setdefault(name, set()).update((cls, lead))
    assert few == [[0, 1, 2]]  # the two of list 3 differ too much in size
    assert set.union(*long.values()) == set(range(1000, 1400)) and np.array([2 in long]).all()
