"""The network that queries run on, derived from orders by integer arithmetic that every SQL engine does alike: a node and
an edge for every order. Nodes are a jittered lattice. Edges go to a neighbour, straight or with a bend; some are loops
and some have no length. The second data set has every edge again, moved by a few metres, a tenth of them far enough and
between nodes of their own so that they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.functions import geometry as G

#: Columns of the lattice.
COLUMNS = 100

NODE_SQL = """SELECT o_orderkey AS n,
  cast(100.0*(o_orderkey % 100) + ((o_orderkey*7919) % 41) - 20 AS double) AS x,
  cast(100.0*floor(o_orderkey/100.0) + ((o_orderkey*104729) % 41) - 20 AS double) AS y FROM {orders}"""

#: u and the step to v, which stays inside the lattice; xm, ym and xk, yk are the first and second vertex between the ends.
EDGE_SQL = """SELECT t.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
  CASE WHEN course = 'loop' THEN a.x + 30 WHEN course = 'bent' THEN cast(floor((a.x + b.x) / 2) + (id % 7) * 3 - 9 AS double) END AS xm,
  CASE WHEN course = 'loop' THEN a.y + 5 WHEN course = 'bent' THEN cast(floor((a.y + b.y) / 2) + (id % 5) * 4 - 8 AS double) END AS ym,
  CASE WHEN course = 'loop' THEN a.x + 12 END AS xk, CASE WHEN course = 'loop' THEN a.y + 28 END AS yk
FROM (
  SELECT id, u, CASE WHEN course IN ('loop', 'point') THEN u WHEN u + step >= n THEN u - 100 ELSE u + step END AS v, course, highway, cycleway, oneway, bridge, tunnel, surface, width, cycleway_width, bicycle
  FROM (SELECT *, CASE WHEN h < 2 AND u % 100 < 99 THEN 1 WHEN h = 3 AND u % 100 < 99 THEN 101 WHEN h = 4 AND u % 100 > 0 THEN 99 ELSE 100 END AS step FROM (
    SELECT id, n, (id * 7919 + c * 31 + (id * id) % 1013) % n AS u, ((id * id * 31 + id * 17) % 1009) % 5 AS h,
      CASE WHEN id % 307 = 5 THEN 'point' WHEN id % 211 = 7 THEN 'loop' WHEN id % 3 = 0 THEN 'straight' ELSE 'bent' END AS course,
      CASE substr(p, 1, 1) WHEN '1' THEN 'cycleway' WHEN '2' THEN 'primary' WHEN '3' THEN 'residential' END AS highway,
      CASE s WHEN 'F' THEN 'track' WHEN 'O' THEN 'lane' END AS cycleway,
      CASE id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS oneway,
      CASE WHEN id % 17 = 0 THEN 'yes' WHEN id % 17 = 1 THEN 'no' END AS bridge,
      CASE WHEN id % 19 = 0 THEN 'passage' END AS tunnel,
      CASE id % 4 WHEN 1 THEN 'asphalt' WHEN 2 THEN 'gravel' END AS surface,
      CASE WHEN id % 5 = 0 THEN '2' END AS width,
      CASE WHEN id % 6 = 0 THEN '3' END AS cycleway_width,
      CASE id % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'dismount' WHEN 2 THEN 'designated' END AS bicycle
    FROM (SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, (SELECT count(*) FROM {orders}) AS n FROM {orders}) t) t) t
) t JOIN ({node}) a ON t.u = a.n JOIN ({node}) b ON t.v = b.n"""

#: How the second data set lies beside the first: dx, dy; its tenth: dx, dy, and what is added to the numbers of its nodes.
MOVED, APART, OWN_NODES = (3.0, -2.0), (40.0, 25.0), 1_000_000_000


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge, also those without length, with its vertices as `line` and its length."""
    found = spark.sql(EDGE_SQL.replace("{node}", NODE_SQL), orders=_orders(spark, sf_dir))
    inner = lambda x, y: F.when(F.col(x).isNotNull(), G.point(x, y))
    line = F.filter(F.array(G.point("x1", "y1"), inner("xm", "ym"), inner("xk", "yk"), G.point("x2", "y2")), lambda p: p.isNotNull())
    return found.withColumn("line", line).withColumn("length", G.length(F.col("line"))).drop("xm", "ym", "xk", "yk", "x1", "y1", "x2", "y2")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with a length; those without are dropped once, here."""
    return raw_edges(spark, sf_dir).where("length > 0")


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODE_SQL, orders=_orders(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that an edge touches."""
    ends = edges(spark, sf_dir).select(F.explode(F.array("u", "v")).alias("n")).distinct()
    return all_nodes(spark, sf_dir).join(ends, "n", "left_semi")


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.col("id") % 10 == 0
    by = lambda k: F.when(far, APART[k]).otherwise(MOVED[k])
    own = lambda c: F.col(c) + F.when(far, OWN_NODES).otherwise(0)
    moved = F.transform("line", lambda p: F.struct((p["x"] + by(0)).alias("x"), (p["y"] + by(1)).alias("y")))
    return edges(spark, sf_dir).withColumns({"line": moved, "u": own("u"), "v": own("v")})


_SEGMENTS = """SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS k, count(*) OVER (PARTITION BY id) AS many, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM (
  SELECT id, 0 AS k, x1, y1, coalesce(xm, x2) AS x2, coalesce(ym, y2) AS y2 FROM {0}
  UNION ALL SELECT id, 1, xm, ym, coalesce(xk, x2), coalesce(yk, y2) FROM {0} WHERE xm IS NOT NULL
  UNION ALL SELECT id, 2, xk, yk, x2, y2 FROM {0} WHERE xk IS NOT NULL)"""
_LENGTH = "(SELECT e.*, l.length FROM {0} e JOIN (SELECT id, sum(len) AS length FROM {1} GROUP BY id) l USING (id) WHERE l.length > 0)"
_REF = ", ".join(f"{c} + CASE WHEN id % 10 = 0 THEN {APART[k]} ELSE {MOVED[k]} END AS {c}" for k, a in enumerate("xy") for c in (f"{a}1", f"{a}m", f"{a}k", f"{a}2"))

#: The same for the oracle: nodes, edges, the second data set, and the elementary segments of both (seg, seg_ref).
CTE = (
    "all_node AS (" + NODE_SQL.replace("{orders}", "orders") + "), edge0 AS MATERIALIZED ("
    + EDGE_SQL.replace("{node}", "SELECT * FROM all_node").replace("{orders}", "orders")
    + "), seg0 AS (" + _SEGMENTS.format("edge0") + "), edge AS MATERIALIZED " + _LENGTH.format("edge0", "seg0")
    + ", seg AS MATERIALIZED (SELECT * FROM seg0 WHERE id IN (SELECT id FROM edge))"
    + ", node AS (SELECT * FROM all_node WHERE n IN (SELECT u FROM edge UNION SELECT v FROM edge))"
    + f", ref AS MATERIALIZED (SELECT * REPLACE ({_REF}, u + CASE WHEN id % 10 = 0 THEN {OWN_NODES} ELSE 0 END AS u, v + CASE WHEN id % 10 = 0 THEN {OWN_NODES} ELSE 0 END AS v) FROM edge)"
    + ", seg_ref AS MATERIALIZED (" + _SEGMENTS.format("ref") + ")"
)
