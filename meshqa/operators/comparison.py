"""Results by cell and their comparison: densities, ranks, reach, summaries, limits, and functions applied to each cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshqa.operators import topology as T
from meshqa.sources.scratch import written


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with `name`, the place of a row in the whole order (from 1). Rows are dealt out by range and numbered within
    their part; only a count for each part meets in one task."""
    placed = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_part", "_of", "_before", "_i")


def _vertices(edges: DataFrame, line: str = "line") -> DataFrame:
    return edges.select(F.explode(line).alias("p")).select("p.x", "p.y")


def bounds_area(edges: DataFrame) -> DataFrame:
    """One row: the area of the bounds of all lines, in square kilometres."""
    return _vertices(edges).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / 1e6).alias("area"))


def network_density(edges: DataFrame, degrees: DataFrame, area: DataFrame) -> DataFrame:
    """One row: infrastructure length, nodes and dangling nodes by area (a row). Without edges or nodes 0, but the dangling
    value of no nodes is missing."""
    total = edges.agg(F.coalesce(F.sum("infrastructure_length"), F.lit(0.0)).alias("m"))
    counts = degrees.agg(F.count("*").alias("n"), F.count(F.when(F.col("degree") == 1, 1)).alias("k"))
    by = lambda c: F.try_divide(F.col(c), F.col("area"))
    return total.join(F.broadcast(counts)).join(F.broadcast(area)).select(by("m").alias("edge_density"), by("n").alias("node_density"), F.when(F.col("n") > 0, by("k")).alias("dangling_density"))


def cells_of(edges: DataFrame, cell: float) -> DataFrame:
    """cx, cy: all cells between the bounds of all lines. The bounds, one row, come to the driver."""
    r = _vertices(edges).agg(*[F.floor(f(k) / cell).alias(f"{n}{k}") for k in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if r.lox is None:
        return edges.sparkSession.createDataFrame([], "cx int, cy int")
    wide, high = r.hix - r.lox + 1, r.hiy - r.loy + 1
    return edges.sparkSession.range(wide * high).selectExpr(f"cast(id div {high} + {r.lox} as int) as cx", f"cast(id % {high} + {r.loy} as int) as cy")


def merged_results(grid: DataFrame, result: DataFrame, keys: tuple[str, ...] = ("cx", "cy"), how: str = "left") -> DataFrame:
    """grid with the columns of a result by cell; columns of the grid that the result has anew are replaced."""
    again = [c for c in result.columns if c in grid.columns and c not in keys]
    return grid.drop(*again).join(result, list(keys), how)


def reach(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """cells with cells_reached, the cells of all components (parts: cx, cy, component) that touch a cell, added up, and
    reached_pct, of all cells; null where there is none."""
    parts = written(parts, "cell-parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("cells"))
    reached = parts.join(sizes, "component").groupBy("cx", "cy").agg(F.sum("cells").alias("cells_reached"))
    total = cells.agg(F.count("*").alias("total"))
    return merged_results(cells, reached).join(F.broadcast(total)).withColumn("reached_pct", F.round(F.try_divide(100 * F.col("cells_reached"), "total"), 2)).drop("total")


def local_range(df: DataFrame, column: str) -> DataFrame:
    """One row: least, most and mean of a result by cell, cells without a value left out."""
    return df.agg(F.round(F.min(column), 2).alias("least"), F.round(F.max(column), 2).alias("most"), F.round(F.avg(column), 4).alias("mean"))


def symmetric_limits(df: DataFrame, **limits: str) -> DataFrame:
    """One row: for each name the largest absolute value of a column."""
    return df.agg(*[F.max(F.abs(F.col(c))).alias(n) for n, c in limits.items()])


TYPES = ("protected", "unprotected", "mixed")


def summary(edges: DataFrame, area: DataFrame) -> DataFrame:
    """nth, metric, value: the metrics of a network (u, v, length, infrastructure_length, protected) in their order;
    lengths in kilometres."""
    e, d = edges, T.degrees(edges)
    km = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / 1000
    of_edges = e.agg(F.count("*").alias("edges"), km("length").alias("length"), km("infrastructure_length").alias("infrastructure"), F.count(F.when(F.col("u") == F.col("v"), 1)).alias("loops"), *[km(F.when(F.col("protected") == t, F.col("infrastructure_length"))).alias(t) for t in TYPES])
    of_nodes = d.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("degree") == 1, 1)).alias("dangling"))
    more = e.groupBy("u", "v").agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("multiedges"))
    row = of_edges.join(F.broadcast(of_nodes)).join(F.broadcast(more)).join(F.broadcast(area))
    kinds = [(f"{t}_km", F.col(t)) for t in sorted(TYPES, reverse=True)]
    metrics = [("nodes", F.col("nodes")), ("edges", F.col("edges")), ("length_km", F.col("length")), ("infrastructure_km", F.col("infrastructure")), *kinds, ("dangling_nodes", F.col("dangling")), ("multiedges", F.col("multiedges")), ("loops", F.col("loops")), ("edge_node_ratio", F.try_divide("edges", "nodes")), ("edge_density", F.try_divide(1000 * F.col("infrastructure"), "area")), ("node_density", F.try_divide("nodes", "area"))]
    return row.select(F.inline(F.array(*[F.struct(F.lit(k + 1).alias("nth"), F.lit(n).alias("metric"), F.round(c.cast("double"), 4).alias("value")) for k, (n, c) in enumerate(metrics)])))


def summary_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """nth, metric, osm, ref and difference of two summaries; a metric that only one has is an error."""
    both = a.select("nth", "metric", F.col("value").alias("osm"), F.lit(True).alias("_a")).join(b.select("nth", "metric", F.col("value").alias("ref"), F.lit(True).alias("_b")), ["nth", "metric"], "full")
    checked = F.when(F.col("_a") & F.col("_b"), F.col("metric")).otherwise(F.raise_error(F.concat(F.lit("only one summary has "), F.col("metric"))).cast("string"))
    return both.select("nth", checked.alias("metric"), "osm", "ref", F.round(F.col("ref") - F.col("osm"), 4).alias("difference"))


def by_cell(df: DataFrame, function: Callable, schema: str, other: DataFrame | None = None) -> DataFrame:
    """function applied to the rows of each cell (a pandas frame; with `other` two, one of which may be empty); cells
    without rows yield nothing. For what has no expression: a cell is one group in one task."""
    cells = df.groupBy("cx", "cy")
    return cells.applyInPandas(function, schema) if other is None else cells.cogroup(other.groupBy("cx", "cy")).applyInPandas(function, schema)
