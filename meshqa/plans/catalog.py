"""The queries of the engine, and the same in DuckDB SQL, by name. All run on the derived network of sources.network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.functions import geometry as G
from meshqa.operators import comparison as X
from meshqa.operators import matching as M
from meshqa.operators import polygons as P
from meshqa.operators import rules as R
from meshqa.operators import topology as T
from meshqa.operators.spatial import clip_lines, overlay, overlay_sql
from meshqa.plans import oracle as O
from meshqa.sources.network import CTE, edges, nodes, raw_edges, reference_edges
from meshqa.sources.scratch import written

CELL = 300.0
KM2 = CELL * CELL / 1e6
TOL, GAP = 70.0, 40.0
PIECE, BUFFER, ANGLE, HAUSDORFF = 40.0, 15.0, 30.0, 17.0

INFRASTRUCTURE = {"A": "highway == 'cycleway'", "B": "cycleway in ['lane', 'track'] and bicycle != 'no'", "C": "bicycle == 'designated' & oneway.isnull()"}
GROUPS = {
    ("centerline", True): ["cycleway == 'lane' and oneway != 'yes'", "cycleway.isnull()"],
    ("centerline", False): ["cycleway == 'lane' and oneway == 'yes'"],
    ("true_geometries", False): ["highway == 'cycleway' and oneway == 'yes'"],
    ("true_geometries", True): ["highway == 'cycleway' and oneway != 'yes'", "cycleway == 'track' and oneway not in ['yes']"],
}
TYPES = {"protected": ["highway == 'cycleway'", "cycleway in ['track']"], "unprotected": ["cycleway == 'lane'", "surface == 'gravel' and bicycle != 'no'"]}
ATTRIBUTES = {"surface": {"all": ["surface"]}, "width": {"true_geometries": ["width", "cycleway_width"], "centerline": ["cycleway_width", "width"]}, "absent": {"all": ["no_such_column"]}}
BAD = [("bicycle", "no", "cycleway", "track"), ("bicycle", "dismount", "cycleway", "track"), ("bicycle", "no", "highway", "cycleway")]


def classified(e: DataFrame) -> DataFrame:
    return R.infrastructure_length(R.protection(R.direction_and_geometry(R.flag(e, INFRASTRUCTURE), GROUPS), TYPES))


#: The same for the oracle, written on its own.
CLASSIFIED = """(SELECT *, CASE WHEN bicycle_infrastructure = 'yes' AND bicycle_geometries IS NOT NULL THEN CASE WHEN bicycle_bidirectional THEN 2 * length ELSE length END END AS infrastructure_length FROM (
  SELECT *,
    CASE WHEN highway IS NOT DISTINCT FROM 'cycleway' OR (cycleway IS NOT NULL AND bicycle IS DISTINCT FROM 'no') OR (bicycle IS NOT DISTINCT FROM 'designated' AND oneway IS NULL) THEN 'yes' ELSE 'no' END AS bicycle_infrastructure,
    CASE WHEN highway IS NOT DISTINCT FROM 'cycleway' OR (cycleway IS NOT DISTINCT FROM 'track' AND oneway IS DISTINCT FROM 'yes') THEN 'true_geometries' WHEN cycleway IS NULL OR cycleway = 'lane' THEN 'centerline' END AS bicycle_geometries,
    CASE WHEN highway IS NOT DISTINCT FROM 'cycleway' AND oneway IS DISTINCT FROM 'yes' OR cycleway IS NOT DISTINCT FROM 'track' AND oneway IS DISTINCT FROM 'yes' THEN true
         WHEN highway IS NOT DISTINCT FROM 'cycleway' THEN false
         WHEN cycleway IS NULL THEN true WHEN cycleway = 'lane' THEN oneway IS DISTINCT FROM 'yes' END AS bicycle_bidirectional,
    CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'protected' WHEN b THEN 'unprotected' END AS protected
  FROM (SELECT *, (highway IS NOT DISTINCT FROM 'cycleway' OR cycleway IS NOT DISTINCT FROM 'track') AS a,
    (cycleway IS NOT DISTINCT FROM 'lane' OR (surface IS NOT DISTINCT FROM 'gravel' AND bicycle IS DISTINCT FROM 'no')) AS b FROM {}) q) q)"""
C_EDGE, C_REF = CLASSIFIED.format("edge"), CLASSIFIED.format("ref")
ENDS = "(SELECT u AS n FROM edge UNION ALL SELECT v FROM edge)"
DEGREE = f"(SELECT n, count(*) AS degree FROM {ENDS} GROUP BY n)"
COMPONENT = "(SELECT n, min(m) AS component FROM reach GROUP BY n)"
REACH = "sym(a, b) AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge), reach(n, m) AS (SELECT n, n FROM node UNION SELECT s.b, r.m FROM reach r JOIN sym s ON s.a = r.n WHERE r.m < s.b)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, reach: bool = False, more: str = ""):
    """Register a query under its function's name, with SQL over the tables of CTE."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {CTE}{', ' + REACH if reach else ''}{', ' + more if more else ''} {sql}"
        return f

    return put


def plain(sql: str):
    """Register a query with whole SQL of its own."""

    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def grid(df: DataFrame) -> DataFrame:
    """Cell of a node."""
    return df.withColumns({"cx": F.floor(F.col("x") / CELL).cast("int"), "cy": F.floor(F.col("y") / CELL).cast("int")})


NODE_CELL = f"(SELECT *, floor(x / {CELL})::INT AS cx, floor(y / {CELL})::INT AS cy FROM node)"
r6 = lambda c: F.round(c, 6)
#: The part of an edge's infrastructure that lies in a cell.
SHARE = "try_divide(infrastructure_length * part, length)"


# rules
@query(f"SELECT id, bicycle_infrastructure FROM {C_EDGE}")
def infra_flag(s, d):
    return R.flag(edges(s, d), INFRASTRUCTURE).select("id", "bicycle_infrastructure")


@query(f"SELECT id, bicycle_geometries, bicycle_bidirectional FROM {C_EDGE}")
def bidirectional_class(s, d):
    return R.direction_and_geometry(edges(s, d), GROUPS).select("id", "bicycle_geometries", "bicycle_bidirectional")


@query(f"SELECT id, protected FROM {C_EDGE}")
def protection_class(s, d):
    return R.protection(edges(s, d), TYPES).select("id", "protected")


@query(f"SELECT id, round(infrastructure_length, 6) AS infrastructure_length FROM {C_EDGE}")
def infrastructure_length(s, d):
    return classified(edges(s, d)).select("id", r6("infrastructure_length").alias("infrastructure_length"))


@query(f"""SELECT 'surface' AS attribute, count(surface) AS count, round(coalesce(sum(length) FILTER (surface IS NOT NULL), 0), 4) AS length FROM {C_EDGE}
  UNION ALL SELECT 'width', count(*) FILTER (bicycle_geometries IS NOT NULL AND (width IS NOT NULL OR cycleway_width IS NOT NULL)),
    round(coalesce(sum(length) FILTER (bicycle_geometries = 'true_geometries' AND width IS NOT NULL OR bicycle_geometries = 'centerline' AND cycleway_width IS NOT NULL), 0), 4) FROM {C_EDGE}
  UNION ALL SELECT 'absent', 0, 0.0""")
def existing_tags(s, d):
    return R.existing_tags(R.direction_and_geometry(edges(s, d), GROUPS), ATTRIBUTES).select("attribute", "count", F.round("length", 4).alias("length"))


_BAD_SQL = " UNION ALL ".join(f"SELECT {{k}}'{a}={x}/{b}={y}' AS combination, count(*) FILTER ({a} = '{x}' AND {b} = '{y}') AS count FROM {{t}}{{g}}" for a, x, b, y in BAD)


@query(_BAD_SQL.format(k="", t="edge", g=""))
def incompatible_tags(s, d):
    return R.incompatible_tags(edges(s, d), BAD)


@query(" UNION ALL ".join(f"SELECT id, '{a}={x}/{b}={y}' AS combination FROM edge WHERE {a} = '{x}' AND {b} = '{y}'" for a, x, b, y in BAD))
def incompatible_edges(s, d):
    return R.incompatible_edges(edges(s, d), BAD)


@query(_BAD_SQL.format(k="cx, cy, ", t=overlay_sql("edge", CELL), g=" GROUP BY cx, cy"))
def incompatible_grid(s, d):
    return R.incompatible_tags(overlay(edges(s, d), CELL), BAD, ["cx", "cy"])


@query(f"SELECT cx, cy, sum(count)::BIGINT AS count FROM ({_BAD_SQL.format(k='cx, cy, ', t=overlay_sql('edge', CELL), g=' GROUP BY cx, cy')}) GROUP BY cx, cy")
def incompatible_grid_total(s, d):
    return R.incompatible_tags(overlay(edges(s, d), CELL), BAD, ["cx", "cy"]).groupBy("cx", "cy").agg(F.sum("count").alias("count"))


_TYPE = "concat(CASE WHEN highway IS NOT DISTINCT FROM 'cycleway' THEN 'A' ELSE '' END, CASE WHEN cycleway IS NOT NULL AND bicycle IS DISTINCT FROM 'no' THEN 'B' ELSE '' END, CASE WHEN bicycle IS NOT DISTINCT FROM 'designated' AND oneway IS NULL THEN 'C' ELSE '' END)"


@query(f"SELECT id, {_TYPE} AS tagging_type FROM edge")
def tagging_types(s, d):
    return R.tagging_type(edges(s, d), INFRASTRUCTURE).select("id", "tagging_type")


@query(f"SELECT DISTINCT {_TYPE} AS tagging_type FROM edge WHERE length({_TYPE}) > 1")
def tag_combinations(s, d):
    return R.tagging_type(edges(s, d), INFRASTRUCTURE).where("length(tagging_type) > 1").select("tagging_type").distinct()


@query(f"SELECT protected AS value, count(*) AS count, round(100 * count(*) / (SELECT count(*) FROM edge), 2) AS percent FROM {C_EDGE} GROUP BY 1")
def value_counts_pct(s, d):
    return R.shares(R.protection(edges(s, d), TYPES), "protected")


@query(f"SELECT protected, round(sum(length) / 1000, 4) AS km FROM {C_EDGE} GROUP BY 1")
def length_by_class(s, d):
    return R.protection(edges(s, d), TYPES).groupBy("protected").agg(F.round(F.sum("length") / 1000, 4).alias("km"))


@query("SELECT u, v, count(*) - 1 AS parallel FROM edge GROUP BY u, v")
def multiedge(s, d):
    return R.multiedges(edges(s, d))


# grid
@query(f"SELECT cx, cy, count(*) AS count_edges FROM {overlay_sql('edge', CELL)} GROUP BY cx, cy")
def grid_count(s, d):
    return overlay(edges(s, d), CELL).groupBy("cx", "cy").agg(F.count("*").alias("count_edges"))


@query(f"SELECT cx, cy, round(sum(part), 4) AS length_edges FROM {overlay_sql('edge', CELL)} GROUP BY cx, cy")
def grid_length(s, d):
    return overlay(edges(s, d), CELL).groupBy("cx", "cy").agg(F.round(F.sum("part"), 4).alias("length_edges"))


@query(f"SELECT id, cx, cy, round(part, 6) AS part FROM {overlay_sql('edge', CELL)}")
def grid_overlay_clip(s, d):
    return overlay(edges(s, d), CELL).select("id", "cx", "cy", r6("part").alias("part"))


@query(f"SELECT cx, cy, round(sum(infrastructure_length * part / length) / {KM2}, 4) AS edge_density, coalesce(any_value(m), 0) / {KM2} AS node_density, any_value(k) / {KM2} AS dangling_density FROM (SELECT * FROM {overlay_sql(C_EDGE, CELL)}) LEFT JOIN (SELECT cx, cy, count(*) AS m, count(*) FILTER (degree = 1) AS k FROM {NODE_CELL} JOIN {DEGREE} USING (n) GROUP BY cx, cy) USING (cx, cy) GROUP BY cx, cy")
def grid_density(s, d):
    """Cells without nodes have node density 0 and no dangling density."""
    e = edges(s, d)
    lines = overlay(classified(e), CELL).groupBy("cx", "cy").agg(F.round(F.sum(F.expr(SHARE)) / KM2, 4).alias("edge_density"))
    points = grid(nodes(s, d).join(T.degrees(e), "n")).groupBy("cx", "cy").agg((F.count("*") / KM2).alias("nd"), (F.count(F.when(F.col("degree") == 1, 1)) / KM2).alias("dd"))
    return lines.join(points, ["cx", "cy"], "left").select("cx", "cy", "edge_density", F.coalesce("nd", F.lit(0.0)).alias("node_density"), F.col("dd").alias("dangling_density"))


@query(f"SELECT cx, cy, " + ", ".join(f"round(coalesce(sum(infrastructure_length * part / length) FILTER (protected = '{t}'), 0) / {KM2}, 4) AS {t}_density" for t in ("protected", "unprotected", "mixed")) + f" FROM {overlay_sql(C_EDGE, CELL)} GROUP BY cx, cy")
def grid_density_by_protection(s, d):
    return overlay(classified(edges(s, d)), CELL).groupBy("cx", "cy").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("protected") == t, F.expr(SHARE))), F.lit(0.0)) / KM2, 4).alias(f"{t}_density") for t in ("protected", "unprotected", "mixed")])


@query(f"SELECT cx, cy, round(100 * count(surface) / count(*), 2) AS surface_pct, 100 - round(100 * count(surface) / count(*), 2) AS surface_pct_missing FROM {overlay_sql('edge', CELL)} GROUP BY cx, cy")
def grid_tag_pct(s, d):
    pct = F.round(100 * F.count("surface") / F.count("*"), 2)
    return overlay(edges(s, d), CELL).groupBy("cx", "cy").agg(pct.alias("surface_pct"), (100 - pct).alias("surface_pct_missing"))


@query("SELECT i * 12 + j AS grid_id, i * 300.0::DOUBLE AS xmin, j * 300.0::DOUBLE AS ymin, least(3100, (i + 1) * 300)::DOUBLE AS xmax, least(3500, (j + 1) * 300)::DOUBLE AS ymax, ((least(3100, (i + 1) * 300) - i * 300) * (least(3500, (j + 1) * 300) - j * 300) - greatest(0, least(1000, least(3100, (i + 1) * 300)) - greatest(400, i * 300)) * greatest(0, least(900, least(3500, (j + 1) * 300)) - greatest(300, j * 300)))::DOUBLE AS area FROM range(11) a(i), range(12) b(j) WHERE NOT (i * 300 >= 400 AND (i + 1) * 300 <= 1000 AND j IN (1, 2))")
def grid_cells(s, d):
    return P.rectangle_cells(s, 0.0, 0.0, 3100.0, 3500.0, CELL, (400, 300, 1000, 900))


# graph
@query(f"SELECT n, degree FROM {DEGREE}")
def node_degree(s, d):
    return T.degrees(edges(s, d))


@query(f"SELECT degree, count(*) AS nodes FROM {DEGREE} GROUP BY degree")
def degree_distribution(s, d):
    return T.degrees(edges(s, d)).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"SELECT cx, cy, round(avg(degree), 3) AS avg_degree FROM {NODE_CELL} JOIN {DEGREE} USING (n) GROUP BY cx, cy")
def avg_degree_grid(s, d):
    return grid(nodes(s, d).join(T.degrees(edges(s, d)), "n")).groupBy("cx", "cy").agg(F.round(F.avg("degree"), 3).alias("avg_degree"))


@query(f"SELECT n FROM {DEGREE} WHERE degree = 1")
def dangling_nodes(s, d):
    return T.dangling(edges(s, d))


@query(f"SELECT cx, cy, count(*) AS nodes, count(*) FILTER (degree = 1) AS dangling, round(100 * count(*) FILTER (degree = 1) / count(*), 2) AS dangling_pct FROM {NODE_CELL} JOIN {DEGREE} USING (n) GROUP BY cx, cy")
def dangling_pct_grid(s, d):
    loose = F.count(F.when(F.col("degree") == 1, 1))
    return grid(nodes(s, d).join(T.degrees(edges(s, d)), "n")).groupBy("cx", "cy").agg(F.count("*").alias("nodes"), loose.alias("dangling"), F.round(100 * loose / F.count("*"), 2).alias("dangling_pct"))


@query("SELECT id, u, v, row_number() OVER (PARTITION BY u, v ORDER BY id) - 1 AS key FROM edge")
def parallel_keys(s, d):
    return T.parallel_keys(edges(s, d)).select("id", "u", "v", "key")


@query(f"SELECT id FROM {O.VERTS} e WHERE NOT EXISTS (SELECT 1 FROM {O.VERTS} o WHERE {O.SAME_COURSE} AND o.id < e.id)")
def undirected_dedupe(s, d):
    return T.undirected(edges(s, d)).select("id")


@query(f"SELECT e.id, min(o.id) AS of FROM {O.VERTS} e JOIN {O.VERTS} o ON {O.SAME_COURSE} AND o.id < e.id GROUP BY e.id")
def duplicate_edges(s, d):
    return T.duplicates(edges(s, d))


@query(f"SELECT a.id, least(a.u, a.v) AS u, greatest(a.u, a.v) AS v, count(DISTINCT b.first) AS key FROM {O.COURSES} a LEFT JOIN {O.COURSES} b ON least(a.u, a.v) = least(b.u, b.v) AND greatest(a.u, a.v) = greatest(b.u, b.v) AND b.first < a.first GROUP BY ALL")
def edge_keys(s, d):
    return T.edge_keys(edges(s, d)).select("id", "u", "v", "key")


@query("SELECT id, CASE WHEN key = 1 AND NOT EXISTS (SELECT 1 FROM keyed o WHERE o.u = k.u AND o.v = k.v AND o.key = 0) THEN 0 ELSE key END AS key FROM keyed k", more="keyed AS (SELECT id, u, v, key FROM (SELECT id, u, v, row_number() OVER (PARTITION BY u, v ORDER BY id) - 1 AS key FROM edge) WHERE NOT (key = 0 AND id % 4 = 1))")
def moved_keys(s, d):
    """Keys after some edges with key 0 are gone."""
    return T.moved_keys(T.parallel_keys(edges(s, d)).where("not (key = 0 and id % 4 = 1)")).select("id", "key")


@query("SELECT id, round(CASE WHEN course = 'bent' THEN sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) ELSE length END, 6) AS length FROM edge")
def graph_tables(s, d):
    """Edges whose geometry is missing, here the bent ones', are straight."""
    bare = edges(s, d).withColumn("line", F.when(F.col("course") != "bent", F.col("line")))
    return T.graph_tables(nodes(s, d), bare)[1].select("id", r6(G.length(F.col("line"))).alias("length"))


@query("SELECT e.id, round(p.x, 3) AS x, round(p.y, 3) AS y, row_number() OVER (PARTITION BY e.u, e.v ORDER BY e.id) - 1 AS key FROM edge e JOIN node p ON p.n = e.v")
def graph_from_lines(s, d):
    """Ends of lines as nodes: where each edge arrives, and its key."""
    made, lines = T.graph_from_lines(edges(s, d))
    return lines.join(made, F.col("v") == F.col("n")).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "key")


@query("SELECT count(*) AS edges, count(*) FILTER (id NOT IN (SELECT id FROM edge)) AS without_length FROM edge0")
def zero_length(s, d):
    return raw_edges(s, d).agg(F.count("*").alias("edges"), F.count(F.when(F.col("length") == 0, 1)).alias("without_length"))


_AREA = "(SELECT (max(greatest(x1, x2)) - min(least(x1, x2))) * (max(greatest(y1, y2)) - min(least(y1, y2))) / 1e6 FROM seg)"


@query(f"SELECT round(sum(infrastructure_length) / {_AREA}, 4) AS edge_density, round((SELECT count(*) FROM node) / {_AREA}, 6) AS node_density, round((SELECT count(*) FROM {DEGREE} WHERE degree = 1) / {_AREA}, 6) AS dangling_density FROM {C_EDGE}")
def network_density(s, d):
    """Over the area of the network's bounds."""
    e = edges(s, d)
    return X.network_density(classified(e), T.degrees(e), X.bounds_area(e)).select(F.round("edge_density", 4).alias("edge_density"), r6("node_density").alias("node_density"), r6("dangling_density").alias("dangling_density"))


def _counts(e: DataFrame) -> DataFrame:
    """One row: v nodes, p components; and e edges."""
    parts = T.node_components(e)
    return parts.agg(F.count("*").alias("v"), F.countDistinct("component").alias("p")).join(F.broadcast(e.agg(F.count("*").alias("e"))))


@query("SELECT " + ", ".join(f"round({x}, 9) AS {k}" for k, x in T.alpha_beta_gamma().items()) + f" FROM (SELECT count(*) AS v, count(DISTINCT component) AS p, (SELECT count(*) FROM edge) AS e FROM {COMPONENT})", reach=True)
def alpha_beta_gamma(s, d):
    return _counts(edges(s, d)).selectExpr(*[f"round({x}, 9) AS {k}" for k, x in T.alpha_beta_gamma().items()])


# components
@query(f"SELECT n, component FROM {COMPONENT}", reach=True)
def components(s, d):
    return T.node_components(edges(s, d))


@query(f"SELECT component, round(sum(length), 4) AS length, count(*) AS edges FROM edge JOIN {COMPONENT} ON u = n GROUP BY component", reach=True)
def component_lengths(s, d):
    return T.edge_components(edges(s, d)).groupBy("component").agg(F.round(F.sum("length"), 4).alias("length"), F.count("*").alias("edges"))


@query(f"SELECT component, length, row_number() OVER (ORDER BY length DESC, component) AS rank FROM (SELECT component, round(sum(length), 4) AS length FROM edge JOIN {COMPONENT} ON u = n GROUP BY component)", reach=True)
def component_rank(s, d):
    sums = T.edge_components(edges(s, d)).groupBy("component").agg(F.round(F.sum("length"), 4).alias("length"))
    return X.ranked(sums, "rank", F.desc("length"), F.col("component"))


@query(f"SELECT component, nodes, round(100 * length / (SELECT sum(length) FROM edge), 4) AS length_pct FROM (SELECT component, count(DISTINCT c.n) AS nodes FROM {COMPONENT} c GROUP BY component ORDER BY nodes DESC, component LIMIT 1) JOIN (SELECT component, sum(length) AS length FROM edge JOIN {COMPONENT} ON u = n GROUP BY component) USING (component)", reach=True)
def largest_component(s, d):
    parts = written(T.node_components(edges(s, d)), "parts")
    top = parts.groupBy("component").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "component").limit(1)
    sums = T.edge_components(edges(s, d), parts).join(F.broadcast(top), "component", "left")
    return sums.agg(F.max("component").alias("_"), F.max(F.when(F.col("nodes").isNotNull(), F.col("component"))).alias("component"), F.max("nodes").alias("nodes"), F.round(100 * F.sum(F.when(F.col("nodes").isNotNull(), F.col("length"))) / F.sum("length"), 4).alias("length_pct")).drop("_")


@query(f"SELECT id, component FROM edge JOIN {COMPONENT} ON u = n", reach=True)
def edge_components(s, d):
    return T.edge_components(edges(s, d)).select("id", "component")


_CELL_PARTS = f"(SELECT DISTINCT cx, cy, component FROM {overlay_sql('edge', CELL)} JOIN {COMPONENT} ON u = n)"


def _cell_parts(s, d):
    return overlay(T.edge_components(edges(s, d)), CELL).select("cx", "cy", "component").distinct()


#: All cells between the network's bounds.
ALL_CELLS = f"(SELECT cx, cy FROM (SELECT unnest(range(min(floor(least(x1, x2) / {CELL}))::INT, max(floor(greatest(x1, x2) / {CELL}))::INT + 1)) AS cx FROM seg), (SELECT unnest(range(min(floor(least(y1, y2) / {CELL}))::INT, max(floor(greatest(y1, y2) / {CELL}))::INT + 1)) AS cy FROM seg))"
_REACH_OF = "(SELECT c.cx, c.cy, q.cells_reached, round(100 * q.cells_reached / (SELECT count(*) FROM {cells}), 2) AS reached_pct FROM {cells} c LEFT JOIN (SELECT cx, cy, sum(cells)::BIGINT AS cells_reached FROM {parts} JOIN (SELECT component, count(*) AS cells FROM {parts} GROUP BY component) USING (component) GROUP BY cx, cy) q USING (cx, cy))"


@query(f"SELECT c.cx, c.cy, string_agg(component::VARCHAR, ',' ORDER BY component) AS components FROM {ALL_CELLS} c LEFT JOIN {_CELL_PARTS} USING (cx, cy) GROUP BY c.cx, c.cy", reach=True)
def cell_components(s, d):
    found = _cell_parts(s, d).groupBy("cx", "cy").agg(F.array_join(F.array_sort(F.collect_list("component")), ",").alias("components"))
    return X.merged_results(X.cells_of(edges(s, d), CELL), found)


@query(f"SELECT * FROM {_REACH_OF.format(cells=ALL_CELLS, parts=_CELL_PARTS)}", reach=True)
def cell_reach(s, d):
    return X.reach(X.cells_of(edges(s, d), CELL), _cell_parts(s, d))


# quality
@query(f"SELECT id FROM edge JOIN {DEGREE} a ON u = a.n JOIN {DEGREE} b ON v = b.n WHERE length <= 100 AND (a.degree = 1) <> (b.degree = 1)")
def overshoots(s, d):
    return T.overshoots(edges(s, d), 100.0).select("id")


_OWN = f"(SELECT u AS n, v AS far FROM edge JOIN {DEGREE} q ON q.n = u AND degree = 1 UNION ALL SELECT v, u FROM edge JOIN {DEGREE} q ON q.n = v AND degree = 1)"


@query(f"SELECT DISTINCT o.n, q.id FROM {_OWN} o JOIN node p ON p.n = o.n JOIN {O.seg_cells('seg', TOL)} q ON q.cx = floor(p.x / 200)::INT AND q.cy = floor(p.y / 200)::INT JOIN edge e ON e.id = q.id AND e.u NOT IN (o.n, o.far) AND e.v NOT IN (o.n, o.far) WHERE {O.point_distance('p.x', 'p.y', 'q')} <= {TOL}")
def undershoots(s, d):
    return T.undershoots(edges(s, d), nodes(s, d), TOL)


@query(f"SELECT id, count(DISTINCT other) AS n FROM {O.crossing_pairs('seg')} GROUP BY id")
def crossings(s, d):
    return T.crossings(edges(s, d))


_GROUND = "(SELECT * FROM seg WHERE id IN (SELECT id FROM edge WHERE coalesce(bridge NOT IN ('yes', 'passage'), true) AND coalesce(tunnel NOT IN ('yes', 'passage'), true)))"


@query(f"SELECT id, count(DISTINCT other) AS n FROM {O.crossing_pairs(_GROUND)} GROUP BY id")
def missing_intersections(s, d):
    return T.missing_intersections(edges(s, d))


@query(f"SELECT e.id, q.n AS intersections FROM edge e LEFT JOIN (SELECT id, count(DISTINCT other) AS n FROM {O.crossing_pairs(_GROUND)} GROUP BY id) q USING (id)")
def intersections(s, d):
    return T.intersections(edges(s, d)).select("id", "intersections")


_PARTED = f"(SELECT s.*, component FROM seg s JOIN edge e USING (id) JOIN {COMPONENT} c ON e.u = c.n)"
_GAP = f"(SELECT l.id AS a, r.id AS b, min(list_min({O.nearest('l', 'r')})) AS m FROM {O.seg_cells('parted', GAP / 2 + 0.01)} l JOIN {O.seg_cells('parted', GAP / 2 + 0.01)} r ON l.cx = r.cx AND l.cy = r.cy AND l.id < r.id AND l.component <> r.component WHERE {O.distance('l', 'r')} <= {GAP} GROUP BY ALL)"


@query(f"SELECT a, b, round(m.d, 6) AS distance, round(m.x, 3) AS x, round(m.y, 3) AS y FROM {_GAP}", reach=True, more=f"parted AS MATERIALIZED {_PARTED}")
def component_gaps(s, d):
    e = edges(s, d)
    return T.gaps(e, T.node_components(e), GAP).select("a", "b", r6("distance").alias("distance"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"SELECT a AS id FROM {_GAP} UNION SELECT b FROM {_GAP}", reach=True, more=f"parted AS MATERIALIZED {_PARTED}")
def gap_edges(s, d):
    e = edges(s, d)
    return T.gaps(e, T.node_components(e), GAP).select(F.explode(F.array("a", "b")).alias("id")).distinct()


# geometry
@query("SELECT id, k AS part, round(len, 6) AS length FROM seg")
def unzip_lines(s, d):
    return edges(s, d).select("id", F.posexplode(G.unzip(F.col("line"))).alias("part", "l")).select("id", "part", r6(G.length(F.col("l"))).alias("length"))


@query("SELECT s.id, round(sum(len), 6) AS length, round(sum(len * (s.x1 + s.x2) / 2) / sum(len), 6) AS cx, round(sum(len * (s.y1 + s.y2) / 2) / sum(len), 6) AS cy, round(abs(sum(s.x1 * s.y2 - s.x2 * s.y1) + any_value(e.x2 * e.y1 - e.x1 * e.y2)) / 2, 4) AS ring FROM seg s JOIN edge e ON e.id = s.id GROUP BY s.id")
def line_measures(s, d):
    line = F.col("line")
    c = G.centroid(line)
    return edges(s, d).select("id", r6(G.length(line)).alias("length"), r6(c["x"]).alias("cx"), r6(c["y"]).alias("cy"), F.round(G.ring_area(line), 4).alias("ring"))


@query("SELECT id, CASE WHEN a > 90 THEN round(180 - a, 6) ELSE round(a, 6) END AS angle FROM (SELECT id, abs(degrees(atan2(x2-x1, y2-y1))) AS a FROM seg WHERE k = 0)")
def angle(s, d):
    north = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")))
    return edges(s, d).select("id", r6(G.direction_angle(F.col("line"), north)).alias("angle"))


@query(f"SELECT id, round(h, 6) AS hausdorff FROM {O.hausdorff('(SELECT id AS ref, id AS match FROM edge)', O.vertices('seg', 'id'), O.vertices('seg_ref', 'id'), 'ref')} q(id, m, h)")
def hausdorff(s, d):
    both = edges(s, d).select("id", F.col("line").alias("a")).join(reference_edges(s, d).select("id", F.col("line").alias("b")), "id")
    return both.select("id", r6(G.hausdorff(F.col("a"), F.col("b"))).alias("hausdorff"))


@query("SELECT id, round(2 * 6371009 * asin(sqrt(least(1.0, pow(sin(radians(y2/1e4 - y1/1e4)/2), 2) + cos(radians(y1/1e4)) * cos(radians(y2/1e4)) * pow(sin(radians(x2/1e4 - x1/1e4)/2), 2)))), 3) AS metres FROM edge")
def haversine(s, d):
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    return edges(s, d).select("id", G.haversine(first["y"] / 1e4, first["x"] / 1e4, last["y"] / 1e4, last["x"] / 1e4).alias("metres"))


_N = "(1 / 298.257223563) / (2 - 1 / 298.257223563)"
_UTM = f"""SELECT n, round(500000 + m * (h + a1 * cos(2*g) * (exp(2*h) - exp(-2*h)) / 2 + a2 * cos(4*g) * (exp(4*h) - exp(-4*h)) / 2 + a3 * cos(6*g) * (exp(6*h) - exp(-6*h)) / 2), 2) AS x,
  round(m * (g + a1 * sin(2*g) * (exp(2*h) + exp(-2*h)) / 2 + a2 * sin(4*g) * (exp(4*h) + exp(-4*h)) / 2 + a3 * sin(6*g) * (exp(6*h) + exp(-6*h)) / 2), 2) AS y FROM (
  SELECT *, atan2(t, cos(l)) AS g, ln((1 + sin(l) / sqrt(1 + t*t)) / (1 - sin(l) / sqrt(1 + t*t))) / 2 AS h FROM (
    SELECT *, (exp(q) - exp(-q)) / 2 AS t FROM (SELECT *, ln((1 + s) / (1 - s)) / 2 - e * ln((1 + e*s) / (1 - e*s)) / 2 AS q FROM (
      SELECT n, radians(x / 1e5 - 1) AS l, sin(radians(55 + y / 1e5)) AS s, 2 * sqrt(k) / (1 + k) AS e, 0.9996 * 6378137 / (1 + k) * (1 + k*k / 4 + k*k*k*k / 64) AS m,
        k / 2 - 2*k*k / 3 + 5*k*k*k / 16 AS a1, 13*k*k / 48 - 3*k*k*k / 5 AS a2, 61*k*k*k / 240 AS a3 FROM node, (SELECT {_N} AS k) q) q) q) q) q"""


@query(_UTM)
def projected(s, d):
    """Nodes as if a hundred kilometres were a degree, west of the middle of zone 32."""
    at = G.to_utm(8 + F.col("x") / 1e5, 55 + F.col("y") / 1e5, 32)
    return nodes(s, d).withColumn("p", at).select("n", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


@query("SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM node")
def bounds(s, d):
    return nodes(s, d).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


SEG_E, SEG_R = (O.pieces(t, g, PIECE) for t, g in (("edge", "seg"), ("ref", "seg_ref")))


def _pieces(e: DataFrame) -> DataFrame:
    return M.numbered(M.segments(e, PIECE))


@query("SELECT seg, round(length, 6) AS length, vertices, round(q.x2, 6) AS x2, round(q.y2, 6) AS y2 FROM piece_e JOIN (SELECT seg, count(*) AS vertices, arg_max(x, pos) AS x2, arg_max(y, pos) AS y2 FROM vert_e GROUP BY seg) q USING (seg)", more=SEG_E.format(k="e"))
def segments(s, d):
    last = F.element_at("line", -1)
    return _pieces(edges(s, d)).select("seg", r6("length").alias("length"), F.size("line").cast("long").alias("vertices"), r6(last["x"]).alias("x2"), r6(last["y"]).alias("y2"))


# matching
_NEAR = f"SELECT DISTINCT l.seg AS ref, r.seg AS match FROM {O.seg_cells('step_r', BUFFER / 2 + 0.01, 100)} l JOIN {O.seg_cells('step_e', BUFFER / 2 + 0.01, 100)} r ON l.cx = r.cx AND l.cy = r.cy WHERE {O.distance('l', 'r')} <= {BUFFER}"
_MATCH = f"""{SEG_E.format(k='e')}, {SEG_R.format(k='r')}, near AS MATERIALIZED ({_NEAR}),
  turned AS (SELECT ref, match FROM near JOIN step_r l ON l.seg = ref AND l.k = 0 JOIN step_e r ON r.seg = match AND r.k = 0 WHERE {O.folded('l', 'r')} <= {ANGLE}),
  best AS (SELECT ref, match, h AS hausdorff FROM (SELECT ref, match, h, row_number() OVER (PARTITION BY ref ORDER BY h, match) AS rn FROM (SELECT ref, match, round(h, 6) AS h FROM {O.hausdorff('turned', '(SELECT seg AS key, x, y FROM vert_r)', '(SELECT seg AS key, x, y FROM vert_e)', 'ref, match')}) WHERE h <= {HAUSDORFF}) WHERE rn = 1)"""


def _matched(s, d):
    e, r = _pieces(edges(s, d)), _pieces(reference_edges(s, d))
    return e, r, M.match(r, e, BUFFER, ANGLE, HAUSDORFF)


@query("SELECT ref, string_agg(match, ',' ORDER BY match) AS matches, count(*) AS count FROM near GROUP BY ref", more=_MATCH)
def buffer_candidates(s, d):
    near = M.near_steps(_pieces(reference_edges(s, d)), _pieces(edges(s, d)), BUFFER)
    found = M.overlay_buffer(near.select(F.col("l.seg").alias("ref"), F.col("r.seg").alias("match")))
    return found.withColumn("matches", F.array_join("matches", ","))


@query("SELECT ref, match, hausdorff FROM best", more=_MATCH)
def best_match(s, d):
    return _matched(s, d)[2].drop("ref_length", "match_length")


@query("""SELECT side, count(*) AS segments, count(*) FILTER (m) AS matched, round(sum(length), 3) AS length, round(coalesce(sum(length) FILTER (m), 0), 3) AS matched_length,
  round(100 * count(*) FILTER (m) / count(*), 2) AS percent, round(100 * coalesce(sum(length) FILTER (m), 0) / sum(length), 2) AS length_percent
  FROM (SELECT 'reference' AS side, length, seg IN (SELECT ref FROM best) AS m FROM piece_r UNION ALL SELECT 'other', length, seg IN (SELECT match FROM best) FROM piece_e) GROUP BY side""", more=_MATCH)
def match_stats(s, d):
    e, r, found = _matched(s, d)
    return M.statistics(r, e, found).withColumns({c: F.round(c, 3) for c in ("length", "matched_length")})


@query(f"SELECT a.protected AS ref_protected, b.protected AS osm_protected, count(*) AS count FROM best JOIN piece_r p ON p.seg = ref JOIN piece_e q ON q.seg = match JOIN {C_REF} a ON a.id = p.id JOIN {C_EDGE} b ON b.id = q.id GROUP BY ALL", more=_MATCH)
def match_protection(s, d):
    e, r, found = _matched(s, d)
    of = lambda pieces, key, name: R.protection(pieces, TYPES).select(F.col("seg").alias(key), F.col("protected").alias(name))
    return found.join(of(r, "ref", "ref_protected"), "ref").join(of(e, "match", "osm_protected"), "match").groupBy("ref_protected", "osm_protected").agg(F.count("*").alias("count"))


_SIDE_GRID = "(SELECT cx, cy, count(*) AS segments, count(*) FILTER (m) AS matched, round(100 * count(*) FILTER (m) / count(*), 2) AS matched_pct FROM (SELECT *, seg IN (SELECT {of} FROM best) AS m FROM {cut}) GROUP BY cx, cy)"
_GRIDS = {k: _SIDE_GRID.format(of=of, cut=overlay_sql(f"piece_{k}", CELL, f"step_{k}", "seg")) for k, of in (("e", "match"), ("r", "ref"))}


def _match_grid(pieces: DataFrame, found: DataFrame, key: str) -> DataFrame:
    hit = F.count(F.when(F.col("matched"), 1))
    return overlay(M.split(pieces.select("seg", "line"), found, key), CELL, "seg", keep=["matched"]).groupBy("cx", "cy").agg(F.count("*").alias("segments"), hit.alias("matched"), F.round(100 * hit / F.count("*"), 2).alias("matched_pct"))


@query(f"SELECT cx, cy, e.segments, e.matched, e.segments - e.matched AS unmatched, e.matched_pct, r.segments AS ref_segments, r.matched AS ref_matched, r.matched_pct AS ref_matched_pct FROM {_GRIDS['e']} e FULL JOIN {_GRIDS['r']} r USING (cx, cy)", more=_MATCH)
def match_grid(s, d):
    e, r, found = _matched(s, d)
    found = written(found, "matches")
    ref = _match_grid(r, found, "ref").withColumnsRenamed({c: f"ref_{c}" for c in ("segments", "matched", "matched_pct")})
    return _match_grid(e, found, "match").withColumn("unmatched", F.col("segments") - F.col("matched")).join(ref, ["cx", "cy"], "full")


@query(f"SELECT round(min(matched_pct), 2) AS least, round(max(matched_pct), 2) AS most, round(avg(matched_pct), 4) AS mean FROM {_GRIDS['e']}", more=_MATCH)
def local_match_range(s, d):
    e, _, found = _matched(s, d)
    return X.local_range(_match_grid(e, found, "match"), "matched_pct")


# comparison
@query(f"SELECT round(b - a, 3) AS difference, round(abs(b - a) / a * 100, 4) AS percent FROM (SELECT (SELECT sum(infrastructure_length) FROM {C_EDGE}) AS a, (SELECT sum(infrastructure_length) FROM {C_REF}) AS b)")
def length_diff(s, d):
    total = lambda e, n: classified(e).agg(F.sum("infrastructure_length").alias(n))
    return total(edges(s, d), "a").join(F.broadcast(total(reference_edges(s, d), "b"))).select(F.round(F.col("b") - F.col("a"), 3).alias("difference"), F.round(F.try_divide(F.abs(F.col("b") - F.col("a")), "a") * 100, 4).alias("percent"))


_ALL_DENSITIES = "(SELECT cx, cy, e, coalesce(n, 0) AS n, k FROM (SELECT cx, cy, sum(infrastructure_length * part / length) / {km2} AS e FROM {cut} GROUP BY cx, cy) LEFT JOIN (SELECT cx, cy, count(*) / {km2} AS n, count(*) FILTER (degree = 1) / {km2} AS k FROM {at} GROUP BY cx, cy) USING (cx, cy))"
_ENDS_AT = "(SELECT floor(x / 300.0)::INT AS cx, floor(y / 300.0)::INT AS cy, n, count(*) AS degree FROM (SELECT u AS n, x1 AS x, y1 AS y FROM {0} UNION ALL SELECT v, x2, y2 FROM {0}) GROUP BY ALL)"


def _densities(e: DataFrame, name: str, *types: str) -> DataFrame:
    sums = [F.sum(F.expr(SHARE))] if not types else [F.sum(F.when(F.col("protected") == t, F.expr(SHARE))) for t in types]
    return overlay(classified(e), CELL).groupBy("cx", "cy").agg(*[(x / KM2).alias(n) for x, n in zip(sums, [name] if not types else [f"{name}_{t}" for t in types])])


def _all_densities(e: DataFrame, name: str) -> DataFrame:
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.element_at("line", 1).alias("p")), F.struct(F.col("v").alias("n"), F.element_at("line", -1).alias("p")))).alias("s")).groupBy("s.n", "s.p").agg(F.count("*").alias("degree"))
    cells = grid(ends.select("n", "p.x", "p.y", "degree")).groupBy("cx", "cy").agg((F.count("*") / KM2).alias(f"{name}_n"), (F.count(F.when(F.col("degree") == 1, 1)) / KM2).alias(f"{name}_k"))
    return _densities(e, f"{name}_e").join(cells, ["cx", "cy"], "left")


@query(f"SELECT cx, cy, " + ", ".join(f"round(coalesce(b.{k}, 0) - coalesce(a.{k}, 0), 3) AS {n}_difference" for k, n in (("e", "edge"), ("n", "node"), ("k", "dangling"))) + f" FROM {_ALL_DENSITIES.format(km2=KM2, cut=overlay_sql(C_EDGE, CELL), at=_ENDS_AT.format('edge'))} a FULL JOIN {_ALL_DENSITIES.format(km2=KM2, cut=overlay_sql(C_REF, CELL, 'seg_ref'), at=_ENDS_AT.format('ref'))} b USING (cx, cy)")
def density_diff(s, d):
    """Of edges, nodes and dangling nodes: the second data set's less the first's, nothing counted as 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    both = _all_densities(edges(s, d), "a").join(_all_densities(reference_edges(s, d), "b"), ["cx", "cy"], "full")
    return both.select("cx", "cy", *[F.round(z(f"b_{k}") - z(f"a_{k}"), 3).alias(f"{n}_difference") for k, n in (("e", "edge"), ("n", "node"), ("k", "dangling"))])


@plain("SELECT max(abs(edge_difference)) AS edge_limit, max(abs(node_difference)) AS node_limit FROM (" + ORACLES["density_diff"] + ")")
def symmetric_limits(s, d):
    """Limits that are alike on both sides of zero, for showing differences."""
    return X.symmetric_limits(density_diff(s, d), edge_limit="edge_difference", node_limit="node_difference")


_TYPED = "protected", "unprotected", "mixed"


@query("SELECT cx, cy, " + ", ".join(f"round(coalesce(b_{t}, 0) - coalesce(a_{t}, 0), 3) AS {t}_difference" for t in _TYPED) + " FROM " + " FULL JOIN ".join(f"(SELECT cx, cy, " + ", ".join(f"sum(infrastructure_length * part / length) FILTER (protected = '{t}') / {KM2} AS {n}_{t}" for t in _TYPED) + f" FROM {overlay_sql(src, CELL, g)} GROUP BY cx, cy) {n}" for n, src, g in (("a", C_EDGE, "seg"), ("b", C_REF, "seg_ref"))) + " USING (cx, cy)")
def typed_density_diff(s, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    both = _densities(edges(s, d), "a", *_TYPED).join(_densities(reference_edges(s, d), "b", *_TYPED), ["cx", "cy"], "full")
    return both.select("cx", "cy", *[F.round(z(f"b_{t}") - z(f"a_{t}"), 3).alias(f"{t}_difference") for t in _TYPED])


_LOOSE = "(SELECT count(*) FROM (SELECT n FROM (SELECT u AS n FROM {0} UNION ALL SELECT v FROM {0}) GROUP BY n HAVING count(*) = 1))"


@query(f"SELECT round(100 * ({_LOOSE.format('ref')} - {_LOOSE.format('edge')}) / nullif({_LOOSE.format('edge')}, 0), 2) AS dangling_diff_pct")
def dangling_diff_pct(s, d):
    n = lambda e, k: T.dangling(e).agg(F.count("*").alias(k))
    return n(edges(s, d), "a").join(F.broadcast(n(reference_edges(s, d), "b"))).select(F.round(F.try_divide(100 * (F.col("b") - F.col("a")), "a"), 2).alias("dangling_diff_pct"))


_METRICS = """SELECT 1 AS nth, 'nodes' AS metric, round(count(*)::DOUBLE, 4) AS value FROM ({ends}) UNION ALL SELECT 2, 'edges', round(count(*)::DOUBLE, 4) FROM {t}
  UNION ALL SELECT 3, 'length_km', round(sum(length) / 1000, 4) FROM {t} UNION ALL SELECT 4, 'infrastructure_km', round(sum(infrastructure_length) / 1000, 4) FROM {c}
  UNION ALL SELECT 4 + row_number() OVER (ORDER BY p DESC), p || '_km', round(coalesce((SELECT sum(infrastructure_length) FROM {c} WHERE protected = p), 0) / 1000, 4) FROM (VALUES ('protected'), ('unprotected'), ('mixed')) q(p)
  UNION ALL SELECT 8, 'dangling_nodes', round(count(*)::DOUBLE, 4) FROM ({ends} HAVING count(*) = 1) UNION ALL SELECT 9, 'multiedges', round(coalesce(sum(k), 0)::DOUBLE, 4) FROM (SELECT count(*) - 1 AS k FROM {t} GROUP BY u, v)
  UNION ALL SELECT 10, 'loops', round(count(*)::DOUBLE, 4) FROM {t} WHERE u = v UNION ALL SELECT 11, 'edge_node_ratio', round((SELECT count(*) FROM {t})::DOUBLE / count(*), 4) FROM ({ends})
  UNION ALL SELECT 12, 'edge_density', round(sum(infrastructure_length) / {area}, 4) FROM {c} UNION ALL SELECT 13, 'node_density', round(count(*) / {area}, 4) FROM ({ends})"""
_METRICS_OF = {t: "(" + _METRICS.format(t=t, c=c, area=_AREA, ends=f"SELECT n FROM (SELECT u AS n FROM {t} UNION ALL SELECT v FROM {t}) GROUP BY n") + ")" for t, c in (("edge", C_EDGE), ("ref", C_REF))}


@query(f"SELECT nth, metric, a.value AS osm, b.value AS ref, round(b.value - a.value, 4) AS difference FROM {_METRICS_OF['edge']} a JOIN {_METRICS_OF['ref']} b USING (nth, metric)")
def summary_join(s, d):
    """The metrics of both data sets in their order, lengths in kilometres, over one area."""
    area = X.bounds_area(edges(s, d))
    return X.summary_join(X.summary(classified(edges(s, d)), area), X.summary(classified(reference_edges(s, d)), area))


_REF_PARTS = f"(SELECT DISTINCT cx, cy, component FROM {overlay_sql('ref', CELL, 'seg_ref')} JOIN (SELECT n, min(m) AS component FROM reach_r GROUP BY n) ON u = n)"


@query(f"SELECT cx, cy, round(b.reached_pct - a.reached_pct, 2) AS difference FROM {_REACH_OF.format(cells=ALL_CELLS, parts=_CELL_PARTS)} a JOIN {_REACH_OF.format(cells=ALL_CELLS, parts=_REF_PARTS)} b USING (cx, cy)", reach=True, more="sym_r(a, b) AS (SELECT u, v FROM ref UNION SELECT v, u FROM ref), reach_r(n, m) AS (SELECT a, a FROM sym_r UNION SELECT s.b, r.m FROM reach_r r JOIN sym_r s ON s.a = r.n WHERE r.m < s.b)")
def reach_diff(s, d):
    """Percentages of the same cells; null where a side has none."""
    cells, ref = X.cells_of(edges(s, d), CELL), overlay(T.edge_components(reference_edges(s, d)), CELL).select("cx", "cy", "component").distinct()
    a = X.reach(cells, _cell_parts(s, d)).select("cx", "cy", F.col("reached_pct").alias("a"))
    return a.join(X.reach(cells, ref).select("cx", "cy", F.col("reached_pct").alias("b")), ["cx", "cy"]).select("cx", "cy", F.round(F.col("b") - F.col("a"), 2).alias("difference"))


@query(f"SELECT cx, cy, coalesce(e, 0) AS edges, coalesce(n, 0) AS nodes FROM (SELECT cx, cy, count(*) AS e FROM {overlay_sql('edge', CELL)} GROUP BY ALL) FULL JOIN (SELECT cx, cy, count(*) AS n FROM {NODE_CELL} GROUP BY ALL) USING (cx, cy)")
def cell_analysis(s, d):
    """A Python function over the edges and nodes of each cell."""
    import pandas as pd

    def counts(e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        some = e if len(e) else n
        return pd.DataFrame({"cx": [some["cx"].iloc[0]], "cy": [some["cy"].iloc[0]], "edges": [len(e)], "nodes": [len(n)]})

    return X.by_cell(overlay(edges(s, d), CELL).select("cx", "cy", "id"), counts, "cx int, cy int, edges long, nodes long", grid(nodes(s, d)))


# simplification
_NEIGH = "(SELECT n, count(*) AS degree, count(DISTINCT m) AS others, bool_or(n = m) AS loop FROM (SELECT u AS n, v AS m FROM edge UNION ALL SELECT v, u FROM edge) GROUP BY n)"
_ENDPOINT = f"ep AS MATERIALIZED (SELECT n, (others <> 2 OR degree <> 2 OR loop) AS endpoint FROM {_NEIGH})"
_CHAIN = _ENDPOINT + ", inn(a, b) AS (SELECT u, v FROM edge WHERE u IN (SELECT n FROM ep WHERE NOT endpoint) AND v IN (SELECT n FROM ep WHERE NOT endpoint)), symi(a, b) AS (SELECT a, b FROM inn UNION SELECT b, a FROM inn), walk(n, m) AS (SELECT n, n FROM ep WHERE NOT endpoint UNION SELECT s.b, w.m FROM walk w JOIN symi s ON s.a = w.n WHERE w.m < s.b), chain AS (SELECT n, min(m) AS chain FROM walk GROUP BY n), tied AS (SELECT e.*, pu.endpoint AS eu, pv.endpoint AS ev, coalesce(cu.chain, cv.chain) AS chain FROM edge e JOIN ep pu ON pu.n = e.u JOIN ep pv ON pv.n = e.v LEFT JOIN chain cu ON cu.n = e.u LEFT JOIN chain cv ON cv.n = e.v)"


@query("SELECT n, endpoint FROM ep", more=_ENDPOINT)
def endpoints(s, d):
    return T.endpoints(edges(s, d))


@query("""SELECT chain, NULL::BIGINT AS single, min(x)::BIGINT AS u, max(x)::BIGINT AS v, count(DISTINCT id) AS edges, round(sum(length / k), 4) AS length FROM (
  SELECT chain, id, length, CASE WHEN eu THEN u WHEN ev THEN v END AS x, 1 AS k FROM tied WHERE chain IS NOT NULL) GROUP BY chain
  UNION ALL SELECT NULL, id, least(u, v), greatest(u, v), 1, round(length, 4) FROM tied WHERE chain IS NULL""", more=_CHAIN)
def simplified_edges(s, d):
    return T.simplified(edges(s, d)).withColumn("length", F.round("length", 4))


@query("SELECT round(100.0 * ((SELECT count(*) FROM edge) - (SELECT count(DISTINCT chain) + count(*) FILTER (chain IS NULL) FROM tied)) / (SELECT count(*) FROM edge), 4) AS edges_pct, round(100.0 * count(*) FILTER (NOT endpoint) / count(*), 4) AS nodes_pct FROM ep", more=_CHAIN)
def simplify_outcome(s, d):
    e = edges(s, d)
    after = T.simplified(e).agg(F.count("*").alias("after"))
    passed = T.endpoints(e).agg(F.round(100 * F.avg((~F.col("endpoint")).cast("double")), 4).alias("nodes_pct"))
    return e.agg(F.count("*").alias("before")).join(F.broadcast(after)).join(F.broadcast(passed)).select(F.round(100 * (F.col("before") - F.col("after")) / F.col("before"), 4).alias("edges_pct"), "nodes_pct")


@query("""SELECT chain, NULL::BIGINT AS single, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces, (count(DISTINCT id) + 1 + sum(many - 1) FILTER (k = 0))::BIGINT AS vertices FROM tied JOIN (SELECT id, k, many FROM seg) USING (id) WHERE chain IS NOT NULL GROUP BY chain
  UNION ALL SELECT NULL, id, any_value(surface), count(*) + 1 FROM tied JOIN (SELECT id FROM seg) USING (id) WHERE chain IS NULL GROUP BY id""", more=_CHAIN)
def simplified_geometry(s, d):
    """Simplified edges' surfaces and the vertices of their joined lines."""
    e = edges(s, d)
    lists = T.simplified(e, lists=("surface",)).select("chain", "single", F.expr("nullif(array_join(surface, ','), '')").alias("surfaces"))
    lines = T.simplified_lines(e).select(F.col("chain").alias("c"), F.col("single").alias("i"), F.size("line").cast("long").alias("vertices"))
    return lists.join(lines, F.col("chain").eqNullSafe(F.col("c")) & F.col("single").eqNullSafe(F.col("i"))).drop("c", "i")


_NTH = "(SELECT e.*, many, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY id) AS nth FROM edge e JOIN (SELECT DISTINCT id, many FROM seg) USING (id))"
#: The new number's place in a split edge: after the first step of a loop, halfway through the steps of a parallel edge.
_SPLIT = "(SELECT s.id, s.k, s.len, q.u, q.v, q.many, CASE WHEN q.u = q.v THEN CASE WHEN s.k = 0 THEN 0 WHEN s.k < q.many - 1 THEN 1 ELSE 2 END WHEN q.nth > 1 THEN CASE WHEN q.many > 1 AND s.k >= (q.many + 1) // 2 THEN 1 ELSE 0 END ELSE 0 END AS part, (q.u = q.v) AS loop, q.nth > 1 AND q.u <> q.v AS twice FROM seg s JOIN {q} q ON q.id = s.id)".format(q=_NTH)


@query(f"""SELECT id, CASE WHEN part = 0 THEN u WHEN part = 1 OR twice THEN 10000000000 + 2 * id ELSE 10000000001 + 2 * id END AS u, CASE WHEN NOT loop AND (NOT twice OR part = 1) THEN v WHEN loop AND part = 2 THEN v WHEN part = 0 THEN 10000000000 + 2 * id ELSE 10000000001 + 2 * id END AS v, round(sum(len), 6) AS length FROM {_SPLIT} WHERE NOT (twice AND many = 1) GROUP BY ALL
  UNION ALL SELECT id, unnest([u, 10000000000 + 2 * id]), unnest([10000000000 + 2 * id, v]), unnest([round(len / 2, 6), round(len / 2, 6)]) FROM {_SPLIT} WHERE twice AND many = 1""")
def simple_graph(s, d):
    return T.simple_graph(edges(s, d), 10_000_000_000).select("id", "u", "v", r6(G.length(F.col("line"))).alias("length"))


#: A convex study area, counter-clockwise.
STUDY = [(200.0, -50.0), (7300.0, 150.0), (9000.0, 900.0), (4000.0, 1400.0), (300.0, 800.0)]


@query(f"SELECT id, round(sum(inside), 6) AS inside FROM {O.inside('seg', STUDY)} GROUP BY id")
def study_area_lines(s, d):
    return clip_lines(edges(s, d), STUDY).select("id", r6("inside").alias("inside"))


# polygons: beyond SQL without spatial functions; tests hold them against plain versions
@query()
def graph_area(s, d):
    return P.graph_area(nodes(s, d))


@query()
def clipped_area(s, d):
    return P.graph_area(nodes(s, d), [(0.0, 0.0), (1500.0, 0.0), (2000.0, 1100.0), (0.0, 1200.0)])


@query()
def study_area_cells(s, d):
    return P.convex_cells(s, STUDY, CELL, [[(2000.0, 300.0), (2600.0, 300.0), (2300.0, 700.0)]])


def flagship(s: SparkSession, d: str) -> DataFrame:
    return grid_density(s, d)
