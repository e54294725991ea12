"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import written

LOCAL_EDGES = 200_000


def _union_find(batches):
    """All edges of a small table in one task: each id that is not its component's smallest, and that one."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(u), find(v)
            parent[max(p, q)] = min(p, q)
    rows = [(x, find(x)) for x in list(parent)]
    rows = [(x, r) for x, r in rows if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).collect()[0]
    return r["n"], r["s"] or 0


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (u, v): every linked id that is not the smallest of its component, and that one.

    Tables of at most LOCAL_EDGES edges (about 3 MB) are joined in one task.  Beyond that size, steps use
    minima and joins only, so that an id with very many links is never gathered in a task; they go on until
    a step changes nothing.  An id without links has no row; an empty table gives no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, _ = written(edges, "edges")
    before = _mark(edges)
    if before[0] <= LOCAL_EDGES:
        return written(edges.coalesce(1).mapInArrow(_union_find, "u long, v long"), "components")[0]
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges, _ = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges
