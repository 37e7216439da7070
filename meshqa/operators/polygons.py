"""Areas: hulls of nodes, clipping to a study area, regular grids over it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshqa.functions import geometry as G


def hull_points(nodes: DataFrame) -> DataFrame:
    """x, y of the convex hull's corners, in order. Partitions reduce to their own hulls first, so one task sees corners
    only; what comes together is a hull for each partition."""

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for b in batches:
            held = G.hull([*held, *zip(b["x"].tolist(), b["y"].tolist())])
        yield pd.DataFrame({"x": [p[0] for p in held], "y": [p[1] for p in held], "nth": range(len(held))})

    schema = "x double, y double, nth long"
    own = nodes.select("x", "y").mapInPandas(corners, schema)
    return own.select("x", "y").repartition(1).mapInPandas(corners, schema)


def graph_area(nodes: DataFrame, window: list[tuple[float, float]] | None = None) -> DataFrame:
    """One row: the area of the convex hull of nodes, within a convex study area (counter-clockwise) if one is given."""

    def area(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring = [p for b in batches for p in b.sort_values("nth")[["x", "y"]].itertuples(index=False, name=None)]
        ring = G.clip_convex(ring, window) if window else ring
        pairs = list(zip(ring, [*ring[1:], *ring[:1]]))
        yield pd.DataFrame({"area": [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs)) / 2]})

    # the corners are in one partition already
    return hull_points(nodes).mapInPandas(area, "area double")


def merged_lines(df: DataFrame, key: str, line: str = "line") -> DataFrame:
    """key, line: the lines of each key joined end to end where exactly two meet (a feature's parts: a bounded group)."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, [{"x": x, "y": y} for x, y in line]) for k, parts in zip(b[key], b["parts"]) for line in G.merged([[(p["x"], p["y"]) for p in part["line"]] for part in parts])]
            yield pd.DataFrame(rows, columns=[key, "line"])

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).agg(F.collect_list(F.struct(F.col(line).alias("line"))).alias("parts")).mapInPandas(join, f"{key} {kind}, line {G.LINE}")


def rectangle_cells(spark, xmin: float, ymin: float, xmax: float, ymax: float, size: float, hole: tuple[float, float, float, float] | None = None) -> DataFrame:
    """grid_id, xmin, ymin, xmax, ymax, area: square cells over a rectangle, border cells clipped, a rectangular hole cut
    out, cells without area left out."""
    nx, ny = (max(1, int(-(-(hi - lo) // size))) for lo, hi in ((xmin, xmax), (ymin, ymax)))
    cells = spark.range(nx * ny).selectExpr("id", f"id div {ny} as i", f"id % {ny} as j").selectExpr(
        "id as grid_id", f"{float(xmin)!r}D + i * {float(size)!r}D as xmin", f"{float(ymin)!r}D + j * {float(size)!r}D as ymin",
        f"least({float(xmax)!r}D, {float(xmin)!r}D + (i + 1) * {float(size)!r}D) as xmax", f"least({float(ymax)!r}D, {float(ymin)!r}D + (j + 1) * {float(size)!r}D) as ymax",
    ).withColumn("area", F.expr("(xmax - xmin) * (ymax - ymin)"))
    if hole:
        a, b, c, d = map(float, hole)
        cells = cells.withColumn("area", F.expr(f"area - greatest(0, least(xmax, {c}D) - greatest(xmin, {a}D)) * greatest(0, least(ymax, {d}D) - greatest(ymin, {b}D))"))
    return cells.where("area > 0")


def convex_cells(spark, window: list[tuple[float, float]], size: float, holes: list[list[tuple[float, float]]] | None = None) -> DataFrame:
    """cx, cy, area: cells of a grid of `size` from the origin that share area with a convex study area (counter-clockwise
    corners), less convex holes that lie apart from each other."""
    xs, ys = zip(*window)
    lox, loy = int(min(xs) // size), int(min(ys) // size)
    wide, high = int(max(xs) // size) - lox + 1, int(max(ys) // size) - loy + 1

    def clipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def area(ring):
            return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]]))) / 2

        for b in batches:
            out = []
            for i in b["id"]:
                x, y = (lox + i // high) * size, (loy + i % high) * size
                square = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
                # what of the hole lies in the window and the cell
                out.append((int(lox + i // high), int(loy + i % high), area(G.clip_convex(square, window)) - sum(area(G.clip_convex(G.clip_convex(square, window), h)) for h in holes or [])))
            yield pd.DataFrame(out, columns=["cx", "cy", "area"])

    return spark.range(wide * high).mapInPandas(clipped, "cx int, cy int, area double").where("area > 1e-9")
