"""Network topology: degrees, ends, keys, undirected edges, quality checks, components by cell, simplification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshqa.functions import geometry as G
from meshqa.operators.components import components
from meshqa.operators.polygons import merged_lines
from meshqa.operators.spatial import near_pairs, points_near_lines, segments_of

#: Tags of ways that are not on the ground.
OVER_OR_UNDER = ("yes", "Yes", "True", "passage", "building_passage", "movable")
#: Side of the cells in which pairs are sought; any length is right, about an edge's length is fast.
CELL = 200.0


def ends(edges: DataFrame) -> DataFrame:
    """n: every end of every edge; a loop has two."""
    return edges.select(F.explode(F.array("u", "v")).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("n").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree = 1").select("n")


def graph_from_lines(lines: DataFrame, line: str = "line", order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes (n, x, y) at the distinct ends of lines, numbered by place, and lines with u, v and key, in the order of a
    unique column."""
    placed = lines.withColumns({"_a": F.element_at(line, 1), "_b": F.element_at(line, -1)})
    at = placed.select(F.explode(F.array("_a", "_b")).alias("p")).distinct()
    # ids by place: unique and the same in every run, without a sort of all nodes in one task
    nodes = at.select(F.xxhash64("p.x", "p.y").alias("n"), "p.x", "p.y")
    return nodes, parallel_keys(placed.withColumns({"u": F.xxhash64("_a.x", "_a.y"), "v": F.xxhash64("_b.x", "_b.y")}).drop("_a", "_b"), order)


def parallel_keys(edges: DataFrame, order: str = "id") -> DataFrame:
    """key: an edge's number among those of the same direction between the same nodes."""
    return edges.withColumn("key", (F.row_number().over(Window.partitionBy("u", "v").orderBy(order)) - 1).cast("long"))


def undirected(edges: DataFrame, order: str = "id", attributes: tuple[str, ...] = (), line: str = "line") -> DataFrame:
    """One of each set of edges with the same ends, course in either direction and values of `attributes`: that with the
    least id. Parallel edges of another course stay."""
    same = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), G.canonical(F.col(line)), *attributes).orderBy(order)
    return edges.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def duplicates(edges: DataFrame, attributes: tuple[str, ...] = (), line: str = "line") -> DataFrame:
    """id, of: edges that repeat one of a smaller id: the same ends, course in either direction and attributes."""
    same = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v"), G.canonical(F.col(line)), *attributes)
    return edges.select("id", F.min("id").over(same).alias("of")).where("id <> of")


def edge_keys(edges: DataFrame, line: str = "line") -> DataFrame:
    """u and v in ascending order and key, an edge's number among the undirected edges between them, in the order of ids;
    edges of one course have one key."""
    ends = edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v"), "_course": G.canonical(F.col(line))})
    first = ends.withColumn("_first", F.min("id").over(Window.partitionBy("u", "v", "_course")))
    return first.withColumn("key", F.dense_rank().over(Window.partitionBy("u", "v").orderBy("_first")).cast("long") - 1).drop("_first", "_course")


def moved_keys(edges: DataFrame) -> DataFrame:
    """Edges with key 1 whose nodes have no edge with key 0 get key 0; others keep theirs."""
    has = F.max((F.col("key") == 0).cast("int")).over(Window.partitionBy("u", "v"))
    return edges.withColumn("key", F.when((F.col("key") == 1) & (has == 0), F.lit(0)).otherwise(F.col("key")).cast("long"))


def graph_tables(nodes: DataFrame, edges: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """A graph as tables of nodes and edges; an edge without geometry becomes a straight line between its nodes."""
    at = lambda e: nodes.select(F.col("n").alias(e), G.point("x", "y").alias(f"_{e}"))
    placed = edges.join(at("u"), "u", "left").join(at("v"), "v", "left")
    return nodes, placed.withColumn(line, F.coalesce(F.col(line), F.array("_u", "_v"))).drop("_u", "_v").select(*edges.columns)


def overshoots(edges: DataFrame, limit: float) -> DataFrame:
    """Edges up to `limit` long with exactly one dangling end."""
    loose = dangling(edges).withColumn("loose", F.lit(1))
    at = lambda e: loose.select(F.col("n").alias(e), F.col("loose").alias(f"loose_{e}"))
    marked = edges.where(F.col("length") <= limit).join(at("u"), "u", "left").join(at("v"), "v", "left")
    return marked.where("coalesce(loose_u, 0) + coalesce(loose_v, 0) = 1").drop("loose_u", "loose_v")


def undershoots(edges: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """n, id: a dangling node and an edge within `limit` that shares no node with the node's own edge."""
    loose = dangling(edges)
    own = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("far")), F.struct(F.col("v").alias("n"), F.col("u").alias("far")))).alias("s")).select("s.*").join(loose, "n", "left_semi")
    near = points_near_lines(nodes.join(loose, "n", "left_semi"), edges, limit, CELL)
    return near.join(own, "n").join(edges.select("id", "u", "v"), "id").where("u <> n and v <> n and u <> far and v <> far").select("n", "id")


def crossings(edges: DataFrame) -> DataFrame:
    """id, n: how many other edges cross an edge, where any do: lines that meet in a point that is an end of neither."""
    some = segments_of(edges, "id")
    return near_pairs(some, some, 0.0, CELL, f"l.id <> r.id and {G.meets_inside('l', 'r')}").select("l.id", F.col("r.id").alias("other")).distinct().groupBy("id").agg(F.count("*").alias("n"))


def on_the_ground(edges: DataFrame) -> DataFrame:
    off = lambda c: F.coalesce(F.col(c).isin(*OVER_OR_UNDER), F.lit(False))
    return edges.where(~off("bridge") & ~off("tunnel"))


def missing_intersections(edges: DataFrame) -> DataFrame:
    return crossings(on_the_ground(edges))


def intersections(edges: DataFrame) -> DataFrame:
    """edges with `intersections`: how many others cross each, bridges and tunnels left out on both sides; null for none."""
    return edges.join(missing_intersections(edges).withColumnRenamed("n", "intersections"), "id", "left")


def gaps(edges: DataFrame, parts: DataFrame, limit: float) -> DataFrame:
    """a, b, distance, x, y: edges of different components (n, component) within `limit` of each other, a < b, and the
    place of the gap, in the middle between their nearest points."""
    own = segments_of(edges.join(parts, F.col("u") == F.col("n")), "id", "component")
    d = G.segment_distance("l", "r")
    near = near_pairs(own, own, limit, CELL, f"l.id < r.id and l.component <> r.component and {d} <= {float(limit)!r}")
    return near.groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b")).agg(F.min(F.expr(G.nearest("l", "r"))).alias("m")).select("a", "b", F.col("m.d").alias("distance"), "m.x", "m.y")


def node_components(edges: DataFrame) -> DataFrame:
    return components(edges.select("u", "v")).withColumnRenamed("node", "n")


def edge_components(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """edges with the component of their nodes; an edge whose node has none is an error."""
    parts = node_components(edges) if parts is None else parts
    joined = edges.join(parts, F.col("u") == F.col("n"), "left").drop("n")
    lost = F.raise_error(F.concat(F.lit("no component for node "), F.col("u").cast("string"))).cast("long")
    return joined.withColumn("component", F.coalesce("component", lost))


def neighbours(edges: DataFrame) -> DataFrame:
    """n, degree, others: neighbours other than itself, and whether it has a loop."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))).alias("s")).select("s.*")
    return both.groupBy("n").agg(F.count("*").alias("degree"), F.countDistinct("m").alias("others"), F.max((F.col("m") == F.col("n")).cast("int")).alias("loop"))


def endpoints(edges: DataFrame, attributes: list[str] | None = None, directed: bool = False) -> DataFrame:
    """n, endpoint: false for nodes that an edge merely passes: two neighbours, degree two, no loop, and the same values
    of `attributes` on both sides. In a directed network edges run one way, a way in both directions is two edges: a node
    of degree four is passed too, and one without an edge in or out is an endpoint."""
    plain = neighbours(edges)
    if directed:
        sides = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("s")).groupBy("s.n").agg(F.sum("s.o").alias("outs"), F.sum("s.i").alias("ins"))
        plain = plain.join(sides, "n").withColumn("endpoint", (F.col("others") != 2) | ~F.col("degree").isin(2, 4) | (F.col("loop") == 1) | (F.col("outs") == 0) | (F.col("ins") == 0))
    else:
        plain = plain.withColumn("endpoint", (F.col("others") != 2) | (F.col("degree") != 2) | (F.col("loop") == 1))
    if attributes:
        sides = edges.select(F.explode(F.array("u", "v")).alias("n"), F.xxhash64(*attributes).alias("h")).groupBy("n").agg((F.countDistinct("h") > 1).alias("differs"))
        plain = plain.join(sides, "n").withColumn("endpoint", F.col("endpoint") | F.col("differs"))
    return plain.select("n", "endpoint")


def _tied(edges: DataFrame, attributes: list[str] | None) -> DataFrame:
    """edges with the chain of passed nodes that they belong to (null between endpoints) and their ends that are endpoints."""
    kind = endpoints(edges, attributes)
    at = lambda e: kind.select(F.col("n").alias(e), F.col("endpoint").alias(f"end_{e}"))
    marked = edges.join(at("u"), "u").join(at("v"), "v")
    inner = marked.where("not end_u and not end_v").select("u", "v")
    alone = kind.where("not endpoint").select(F.col("n").alias("u"), F.col("n").alias("v"))
    chain = components(inner.unionByName(alone))
    passed = marked.withColumn("_m", F.expr("case when not end_u then u when not end_v then v end"))
    tied = passed.join(chain.withColumnRenamed("component", "chain"), F.col("_m") == F.col("node"), "left")
    return tied.withColumn("ends", F.expr("filter(array(if(end_u, u, null), if(end_v, v, null)), x -> x is not null)")).drop("_m", "node", "end_u", "end_v")


def simplified(edges: DataFrame, attributes: list[str] | None = None, sums: tuple[str, ...] = ("length",), lists: tuple[str, ...] = ()) -> DataFrame:
    """chain, single, u, v, edges, sums and lists: paths through passed nodes become one edge. A chain of passed nodes is a
    component of the network that they induce, and is named by its least node; an edge between endpoints keeps its id as
    `single`. Columns `sums` are added up; of columns `lists` the distinct values that are there are kept, in order. A
    ring without endpoints has no u and v; a path that comes back to its start has them alike."""
    tied = _tied(edges, attributes)
    of = [F.sum(c).alias(c) for c in sums] + [F.array_sort(F.collect_set(c)).alias(c) for c in lists]
    joined = tied.where("chain is not null").groupBy("chain").agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("e"), F.count("*").alias("edges"), *of)
    through = joined.select("chain", F.lit(None).cast("long").alias("single"), F.get("e", F.lit(0)).alias("u"), F.get("e", F.lit(1)).alias("v"), "edges", *sums, *lists)
    alone = [F.expr(f"filter(array(`{c}`), x -> x is not null)").alias(c) for c in lists]
    single = tied.where("chain is null").select(F.lit(None).cast("long").alias("chain"), F.col("id").alias("single"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(1).cast("long").alias("edges"), *sums, *alone)
    return through.unionByName(single)


def simplified_lines(edges: DataFrame, attributes: list[str] | None = None, line: str = "line") -> DataFrame:
    """chain, single, line: the geometry of simplified edges, the lines of a chain joined end to end."""
    tied = _tied(edges, attributes)
    joined = merged_lines(tied.where("chain is not null").select("chain", line), "chain", line)
    return joined.select("chain", F.lit(None).cast("long").alias("single"), line).unionByName(tied.where("chain is null").select("chain", F.col("id").alias("single"), line))


def simple_graph(edges: DataFrame, first_new: int, line: str = "line") -> DataFrame:
    """id, u, v, line: no loops and no parallel edges. A loop gets two artificial nodes at its second and last but one
    vertex, or at its thirds if it has only one between; all parallel edges but the first get one at their middle vertex,
    or halfway along a straight edge. Artificial nodes are numbered from the edge's id: first_new + 2 * id."""
    nth = F.row_number().over(Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("id"))
    a, b = F.lit(first_new) + 2 * F.col("id"), F.lit(first_new) + 2 * F.col("id") + 1
    c, n = F.col(line), F.size(line)
    part = lambda u, v, p: F.struct(u.alias("u"), v.alias("v"), p.alias(line))
    third = lambda lo, hi: G.substring(c, G.length(c) * lo / 3, G.length(c) * hi / 3)
    loop = F.when(n > 3, F.array(part(F.col("u"), a, F.slice(c, 1, 2)), part(a, b, F.slice(c, F.lit(2), n - 2)), part(b, F.col("v"), F.slice(c, n - 1, F.lit(2))))).otherwise(F.array(part(F.col("u"), a, third(0, 1)), part(a, b, third(1, 2)), part(b, F.col("v"), third(2, 3))))
    middle = F.floor(n / 2).cast("int") + 1
    half = lambda lo, hi: G.substring(c, G.length(c) * lo / 2, G.length(c) * hi / 2)
    twice = F.when(n > 2, F.array(part(F.col("u"), a, F.slice(c, F.lit(1), middle)), part(a, F.col("v"), F.slice(c, middle, n)))).otherwise(F.array(part(F.col("u"), a, half(0, 1)), part(a, F.col("v"), half(1, 2))))
    return edges.withColumn("_nth", nth).select("id", F.inline(F.when(F.col("u") == F.col("v"), loop).when(F.col("_nth") > 1, twice).otherwise(F.array(part(F.col("u"), F.col("v"), c)))))


def alpha_beta_gamma(n_edges: str = "e", n_nodes: str = "v", n_components: str = "p", planar: bool = True) -> dict[str, str]:
    """SQL of the three indices over counts of edges, nodes and components."""
    e, v, p = f"cast({n_edges} as double)", f"cast({n_nodes} as double)", f"cast({n_components} as double)"
    if planar:
        return {"alpha": f"({e} - {v} + {p}) / nullif(2 * {v} - 5, 0)", "beta": f"{e} / nullif({v}, 0)", "gamma": f"{e} / nullif(3 * ({v} - 2), 0)"}
    full = f"({v} * ({v} - 1) / 2)"
    return {"alpha": f"({e} - {v}) / nullif({full} - ({v} - 1), 0)", "beta": f"{e} / nullif({v}, 0)", "gamma": f"{e} / nullif({full}, 0)"}
