"""Connected components of a link table, by randomised contraction.

Each round every vertex picks the vertex of least hashed rank among itself and
its neighbours, and the links are carried over to the picks. A constant share of
the vertices goes in each round, whatever the shape of the graph, so chains and
stars alike end after a number of rounds that grows with the logarithm of their
size. Links and picks stay distributed; each round's tables are written to the
shared folder. Once at most ``FINISH`` links are left, one task joins them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


#: Links that one task may hold at the end (16 bytes each).
FINISH = 100_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, to) for each vertex of a bounded number of links: the root of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"a": list(parent), "to": [root(x) for x in list(parent)]}, dtype="int64")


def _ranked(vertex: str, level: int) -> Column:
    return F.struct(F.xxhash64(vertex, F.lit(level)).alias("rank"), F.col(vertex).alias("v"))


def _links(edges: DataFrame) -> DataFrame:
    """Distinct links between different vertices, the smaller first."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _moved(labels: DataFrame | None, picks: DataFrame) -> DataFrame:
    """(id, root) after one more round."""
    if labels is None:
        return picks.select(F.col("a").alias("id"), F.col("to").alias("root"))
    return labels.join(picks.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b); component is the least id reachable.

    Loops and repeated links are allowed; a vertex with loops alone is left out; no edges, no rows.
    """
    links, level, labels = written(_links(edges), "links"), 0, None
    while count := links.count():
        if count <= FINISH:
            picks = written(links.coalesce(1).mapInPandas(_joined, "a long, to long"), "picks")
            labels = _moved(labels, picks)
            break
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        picks = ends.groupBy("a").agg(F.min(_ranked("b", level)).alias("near")).select("a", F.least("near", _ranked("a", level))["v"].alias("to"))
        picks = written(picks, "picks")
        labels = _moved(labels, picks)
        moved = links.join(picks.withColumnRenamed("to", "a2"), "a").select("a2", F.col("b").alias("a")).join(picks.withColumnRenamed("to", "b2"), "a")
        links, level = written(_links(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "links"), level + 1
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = written(labels, "labels")
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
