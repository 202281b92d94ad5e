"""Connected components of a distributed edge table, by alternating star contraction.

Large and small stars (each keeps the components and shortens the paths) alternate until
the edges no longer change. Every round writes the edges into the shared folder; the
driver sees only a count and a checksum. A hub's edges are never gathered: its smallest
neighbour is aggregated with map-side combine and joined back, a join that AQE may split.
Up to ``FEW`` edges between whole numbers are solved on the driver, with the same result, since
each round would move little and shuffle often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges (16 bytes each) that the driver solves.
FEW = 100_000


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = down.join(_smallest(down), "u").select(F.explode(F.array("u", "v")).alias("u"), "m")
    return star.select("u", F.col("m").alias("v")).where("u <> v").distinct()


def _solved(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges: each root hooks onto its smallest neighbour until none can."""
    t = edges.toArrow()
    nodes, ends = np.unique(np.concatenate([t.column(c).to_numpy() for c in "uv"]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while ((x := root[u]) != (y := root[v])).any():
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    found = pa.table({"node": nodes, "root": nodes[root]})
    return stored(edges.sparkSession.createDataFrame(found), "roots")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each node of an edge and the smallest node of its component.

    Loops and repeated or reversed edges change nothing; no edges give an empty table.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e, last = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        mark = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())
        if 0 < mark[0] <= FEW and {k for _, k in e.dtypes} == {"bigint"}:
            return _solved(e)
        if mark == last or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()
        e, last = stored(_small_star(_large_star(e)), "edges"), mark
