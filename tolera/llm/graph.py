"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, where: str = "tolera-checkpoints") -> DataFrame:
    """Cuts lineage with checkpoint() in the folder that the session names (set here only where it is unset)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"/tmp/{where}")
    return df.checkpoint()


#: Rows of a key from which it may be a hub, and the most hubs that there can be.
HUB, HUBS = 1024, 4096


def hub_join(big: DataFrame, small: DataFrame, key: str, n: int, count: str = "_n", how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has a row per key and in ``count`` how many rows of ``big`` have it.

    n: rows of ``big``, at least.  Keys of more than HUB rows and more than 1/HUBS of all are hubs: at most HUBS of them, so they
    are broadcast, and their rows stay where they are; the other keys are joined by a shuffle.  how: inner or left."""
    many = F.col(count) > max(HUB, n // HUBS)
    hubs = small.where(many).drop(count)
    rest = big.join(F.broadcast(hubs.select(key)), key, "left_anti").join(small.where(~many).drop(count), key, how)
    return rest.unionByName(big.join(F.broadcast(hubs), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node of its component.

    Nodes of many edges are aggregated on the map side and joined by broadcast (``hub_join``), so no task gets all edges of
    a hub.  Empty edges give an empty result; nulls and loops are ignored."""
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = settle(edges.where("a != b").select(big, small).distinct())
    before, n = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = hub_join(both, least, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        tied = hub_join(large, least, "u", n)
        out = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = settle(out.where("u != v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, n = mark, mark[0]
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
