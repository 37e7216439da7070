"""Joins by distance. Lines are cut to their elementary segments and these are bucketed to the cells of a grid, so that
the join has an equality that deals rows out; a pair is looked at only in the cell of the lower left corner that the two
boxes share, so no pair of segments comes twice."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshqa.functions import geometry as G


def segments_of(df: DataFrame, *keep: str, line: str = "line") -> DataFrame:
    """keep, x1, y1, x2, y2, and whether a segment is its line's first or last: a row an elementary segment."""
    step = df.select(*keep, F.size(line).alias("_n"), F.posexplode(G.steps(F.col(line))).alias("_k", "_s"))
    return step.select(*keep, (F.col("_k") == 0).alias("first"), (F.col("_k") == F.col("_n") - 2).alias("last"), *[F.col(f"_s.{p}.{c}").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in "xy"])


def _boxed(df: DataFrame, grow: float, cell: float, prefix: str) -> DataFrame:
    lo = lambda k: f"least({k}1, {k}2) - {grow!r}"
    hi = lambda k: f"greatest({k}1, {k}2) + {grow!r}"
    span = lambda k: F.expr(f"sequence(cast(floor(({lo(k)}) / {cell!r}) as int), cast(floor(({hi(k)}) / {cell!r}) as int))")
    row = [F.col(c).alias(f"{prefix}_{c}") for c in df.columns]
    sides = [F.expr(lo("x")).alias(f"{prefix}__x"), F.expr(lo("y")).alias(f"{prefix}__y"), F.expr(hi("x")).alias(f"{prefix}__w"), F.expr(hi("y")).alias(f"{prefix}__h")]
    return df.select(*row, *sides, F.explode_outer(span("x")).alias("cx"), span("y").alias("_ys")).select("*", F.explode_outer("_ys").alias("cy")).drop("_ys")


def late(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column by which rows can be filtered after a join: as a generated one it isn't computed in the join for every pair
    of its keys."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, cell: float, condition: str, first: dict[str, str] | None = None) -> DataFrame:
    """Structs l and r of rows whose boxes lie within radius of each other and for which `condition` (SQL over l and r)
    holds. `first` names values (SQL too) that the condition uses more than once. Rows have x1, y1, x2, y2; a point has both
    ends alike. Cost follows the number of rows in shared cells."""
    a, b = _boxed(left, 0.0, cell, "l"), _boxed(right, float(radius), cell, "r")
    own = f"cx = cast(floor(greatest(l__x, r__x) / {cell!r}) as int) and cy = cast(floor(greatest(l__y, r__y) / {cell!r}) as int)"
    # boxes that do not meet, but for rounding, are left out before anything is computed
    meet = "l__x <= r__w + 1e-6 and r__x <= l__w + 1e-6 and l__y <= r__h + 1e-6 and r__y <= l__h + 1e-6"
    # columns stay flat until here: fields taken out of structs anew for each use make methods that the JVM won't compile
    flat = lambda sql: F.expr(re.sub(r"\b([lr])\.(\w+)", r"\1_\2", sql))
    pairs = a.join(b, ["cx", "cy"]).where(f"{meet} and {own}").withColumns({n: flat(x) for n, x in (first or {}).items()})
    whole = [F.struct(*[F.col(f"{p}_{c}").alias(c) for c in df.columns]).alias(p) for p, df in (("l", left), ("r", right))]
    return late(pairs, "_near", flat(condition)).where("_near").select(*whole)


def points_near_lines(points: DataFrame, lines: DataFrame, limit: float, cell: float, how: str = "inner", line: str = "line") -> DataFrame:
    """n, id, distance: points (n, x, y) with the lines (id, line) within `limit`. With how=left a point without any has
    one row, with nulls."""
    at = points.select("n", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = G.point_segment("l.x1", "l.y1", "r.x1", "r.y1", "r.x2", "r.y2")
    found = near_pairs(at, segments_of(lines, "id", line=line), limit, cell, f"{d} <= {float(limit)!r}").groupBy("l.n", "r.id").agg(F.min(F.expr(d)).alias("distance"))
    return points.select("n").join(found, "n", how) if how != "inner" else found


def overlay(df: DataFrame, cell: float, key: str = "id", line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Rows (key is unique) by the cells that their lines cross, with cx, cy and part, the length inside. Where `keep` names
    the columns that are needed besides the key, these go along and the rows are not met again. Cells are half
    open, so that lines on a border belong to one of two cells and lengths add up. A segment is followed column by column,
    so its cells are those that it meets and not all of its box."""
    c = repr(float(cell))
    cut = segments_of(df, key, *(keep or []), line=line).withColumn("cx", F.explode(F.expr(f"sequence(cast(floor(least(x1, x2) / {c}) as int), cast(floor(greatest(x1, x2) / {c}) as int))")))
    # where the segment is at the column's two sides
    at = lambda x: f"if(x1 = x2, {{}}, y1 + greatest(0.0D, least(1.0D, ({x} - x1) / (x2 - x1))) * (y2 - y1))"
    low, high = at(f"cx*{c}").format("y1"), at(f"(cx+1)*{c}").format("y2")
    # a cell more on each side, as the two are rounded
    cells = cut.withColumn("cy", F.explode(F.expr(f"sequence(cast(floor(least({low}, {high}) / {c} - 1e-9) as int), cast(floor(greatest({low}, {high}) / {c} + 1e-9) as int))")))
    enter, leave = G.clipped("x1", "y1", "x2", "y2", f"cx*{c}", f"cy*{c}", f"(cx+1)*{c}", f"(cy+1)*{c}")
    long = "sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))"
    inside = cells.withColumn("part", F.expr(f"(({leave}) - ({enter})) * {long}")).where("part > 1e-9")
    if keep is not None:
        return inside.groupBy(key, *keep, "cx", "cy").agg(F.sum("part").alias("part"))
    return df.join(inside.groupBy(key, "cx", "cy").agg(F.sum("part").alias("part")), key)


def overlay_sql(source: str, cell: float, segments: str = "seg", key: str = "id") -> str:
    """The same for the oracle, in its own way: a segment is cut wherever it meets a grid line, and each piece belongs to
    the cell of its middle."""
    c = repr(float(cell))
    grid = lambda k: f"CASE WHEN {k}1 = {k}2 THEN [] ELSE list_transform(range(floor(least({k}1, {k}2) / {c})::INT, floor(greatest({k}1, {k}2) / {c})::INT + 2), lambda q: (q * {c} - {k}1) / ({k}2 - {k}1)) END"
    return f"""(SELECT s.*, q.cx, q.cy, q.part FROM {source} s JOIN (SELECT {key}, cx, cy, sum(part) AS part FROM (
      SELECT {key}, floor((x1 + (t + f) / 2 * (x2 - x1)) / {c})::INT AS cx, floor((y1 + (t + f) / 2 * (y2 - y1)) / {c})::INT AS cy, (t - f) * len AS part FROM (
        SELECT *, unnest(ts[:-2]) AS f, unnest(ts[2:]) AS t FROM (SELECT *, list_sort(list_distinct(list_filter([0.0::DOUBLE, 1.0::DOUBLE] || {grid('x')} || {grid('y')}, lambda q: q >= 0 AND q <= 1))) AS ts FROM {segments}) q) q) q
      WHERE part > 1e-9 GROUP BY ALL) q USING ({key}))"""


def clip_lines(df: DataFrame, window: list[tuple[float, float]], key: str = "id", line: str = "line") -> DataFrame:
    """Rows (key is unique) whose lines lie in a convex study area (counter-clockwise corners) for some length, with
    `inside`, that length. A segment's part is between the last border that it enters and the first that it leaves."""
    enter, leave = ["0.0D"], ["1.0D"]
    for (ax, ay), (bx, by) in zip(window, [*window[1:], window[0]]):
        side = lambda i: f"({bx - ax!r}D * (y{i} - {ay!r}D) - {by - ay!r}D * (x{i} - {ax!r}D))"  # noqa: B023, E731
        p, q = side(1), side(2)
        enter.append(f"case when {p} < 0 and {q} < 0 then 2.0D when {p} < 0 then {p} / ({p} - {q}) else 0.0D end")
        leave.append(f"case when {p} >= 0 and {q} < 0 then {p} / ({p} - {q}) else 1.0D end")
    part = f"(least({', '.join(leave)}) - greatest({', '.join(enter)})) * sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))"
    cut = segments_of(df, key, line=line).withColumn("inside", F.expr(part)).where("inside > 1e-9")
    return df.join(cut.groupBy(key).agg(F.sum("inside").alias("inside")), key)
