"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import discard, stored

#: Edges of a file of a round's table, so that small tables are not thousands of files.
EDGES_A_FILE = 200_000


def _print(edges: DataFrame) -> tuple:
    """Tells two edge sets apart without collecting them."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; root is the smallest node of its component.

    A node with very many edges costs partial sums one row a task, and its rows meet its minimum in a join that AQE can
    split. The number of rounds grows with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    before = _print(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a round has no more edges than the one before
        after = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, e = e, stored(after.coalesce(1 + before[0] // EDGES_A_FILE), "edges")
        discard(old)
        now = _print(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
