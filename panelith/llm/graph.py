"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours hang on its least neighbour (or itself). A hub's rows are pre-aggregated for the least one;
    the join with them is a plain equi-join that adaptive execution can split."""
    around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select("v", "m", "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(v, root) for every node that has an edge; root is the least node of its component.

    ``edges`` holds long ids; direction, repeats and loops don't matter. Each round is a table in the shared folder.
    """
    now = common.materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = common.materialize(_star(_star(now, True), False), "edges")
        got = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        common.discard(now)
        now = new
        if tuple(got) == mark or not got[0]:
            break
        mark = tuple(got)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v")).distinct().select("v", F.col("v").alias("root"))
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionAll(roots)
