"""Connected components by alternating large-star and small-star rounds.

A round is two equi-joins with a map-side-combined minimum and leaves fewer, shorter paths; the number of rounds grows
with the square of the logarithm of the largest component at most. Labels are written to the shared folder after each
round, so plans stay flat and lost executors cost no more than a round. Nothing is collected but a count and a checksum.

A node with very many neighbours would meet them all in one task. Such hubs have more than a thousandth of all rows, so
they are few thousand at most whatever the size, and their minima are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshqa.sources.scratch import new_path, removed

MOST_ROUNDS = 60
#: A key is frequent if it has more than one in so many of the rows, and more than OFTEN of them; HUB of the narrow rows of
#: links.
ONE_IN, OFTEN, HUB = 1000, 2000, 200_000


def looked_up(rows: DataFrame, key: str, found: DataFrame, of: str, n: str, total: int, often_from: int | None = None) -> DataFrame:
    """rows joined with found (columns `of`, unique, and n, how many rows have it; others) on key = of, `of` and n dropped.
    Frequent keys, ONE_IN at most as n adds up to total, are looked up in a broadcast; rows of the others are dealt out."""
    bound = max(OFTEN if often_from is None else often_from, total // ONE_IN)
    if total <= bound:
        return rows.join(found.drop(n), F.col(key) == F.col(of)).drop(of)
    often, rest = found.where(F.col(n) > bound).drop(n), found.where(F.col(n) <= bound).drop(n)
    more = [c for c in often.columns if c != of]
    marked = rows.join(F.broadcast(often.withColumn("_often", F.lit(True))), F.col(key) == F.col(of), "left").drop(of)
    dealt = marked.where("_often is null").drop("_often", *more).join(rest, F.col(key) == F.col(of)).drop(of)
    return marked.where("_often").drop("_often").unionByName(dealt)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component for every node that an edge touches; component is the smallest node reachable. Loops make their
    node known; edges with a null end are ignored; directions and repeated edges do not matter."""
    spark = edges.sparkSession
    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    now = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path, seen = new_path(spark, "components"), None
    now.write.parquet(path)
    now = spark.read.parquet(path)
    total = 2 * now.count()
    for _ in range(MOST_ROUNDS):
        links = now.where("u != v")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "w")
        # large star: every larger neighbour is linked to the least of the neighbourhood
        large = looked_up(both.where("v > u"), "u", least, "w", "n", total, HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node itself
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "w")
        pulled = looked_up(large, "u", low, "w", "n", total, HUB).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = pulled.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).unionByName(now.where("u = v")).distinct()
        after = new_path(spark, "components")
        star.write.parquet(after)
        removed(spark, path)
        path, now = after, spark.read.parquet(after)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen, total = state, 2 * state[0]
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    labels = now.where("u != v").groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(labels, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
