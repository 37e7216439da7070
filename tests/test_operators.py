"""Operators on small hand-made networks whose results are plain to see."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from meshqa.functions import geometry as G
from meshqa.operators import comparison as X
from meshqa.operators import matching as M
from meshqa.operators import rules as R
from meshqa.operators import spatial as S
from meshqa.operators import topology as T
from meshqa.sources import files, settings


def network(spark, *lines, more: dict | None = None):
    """Edges from (id, u, v, [(x, y), ...]), with further columns by name."""
    rows = [(i, u, v, [(float(x), float(y)) for x, y in line]) for i, u, v, line in lines]
    df = spark.createDataFrame(rows, f"id long, u long, v long, line {G.LINE}").withColumn("length", G.length(F.col("line")))
    for name, values in (more or {}).items():
        df = df.withColumn(name, F.create_map(*[F.lit(x) for i, v in values.items() for x in (i, v)])[F.col("id")]) if values else df.withColumn(name, F.lit(None).cast("string"))
    return df


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_crossings_of_bent_lines(spark):
    # 2 crosses 1 in its second step; 3 ends on 1; 4 meets 1 where both bend; 5 runs along it
    e = network(spark, (1, 1, 2, [(0, 0), (10, 0), (20, 10)]), (2, 3, 4, [(14, 0), (14, 5), (13, 9)]), (3, 5, 6, [(5, 0), (5, 5)]), (4, 7, 8, [(10, -5), (10, 0), (9, 5)]), (5, 9, 10, [(2, 0), (4, 0)]))
    assert rows(T.crossings(e), "id", "n") == [(1, 2), (2, 1), (4, 1)]
    tagged = e.withColumn("bridge", F.when(F.col("id") == 2, "yes")).withColumn("tunnel", F.lit(None).cast("string"))
    assert rows(T.missing_intersections(tagged), "id", "n") == [(1, 1), (4, 1)]
    assert rows(T.intersections(tagged), "id", "intersections")[1] == (2, None)


def test_degrees_loops_and_ends(spark):
    e = network(spark, (1, 1, 2, [(0, 0), (5, 0)]), (2, 2, 2, [(5, 0), (6, 1), (6, -1), (5, 0)]), (3, 2, 3, [(5, 0), (9, 0)]))
    assert rows(T.degrees(e), "n", "degree") == [(1, 1), (2, 4), (3, 1)]
    assert rows(T.dangling(e), "n") == [(1,), (3,)]
    assert rows(T.overshoots(e, 4.0), "id") == [(3,)]
    assert rows(T.overshoots(e, 5.0), "id") == [(1,), (3,)]


def test_undershoots_and_points_near_lines(spark):
    e = network(spark, (1, 1, 2, [(0, 0), (0, 10)]), (2, 3, 4, [(-5, 13), (5, 13), (5, 20)]), (3, 2, 5, [(0, 10), (30, 10)]))
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 10.0), (3, -5.0, 13.0), (4, 5.0, 20.0), (5, 30.0, 10.0)], "n long, x double, y double")
    # node 3 is 5.83 from node 2; node 4 is 10 from edge 3
    assert rows(T.undershoots(e, nodes, 3.0), "n", "id") == []
    assert rows(T.undershoots(e, nodes, 6.0), "n", "id") == [(3, 1), (3, 3)]
    assert rows(T.undershoots(e, nodes, 10.0), "n", "id") == [(3, 1), (3, 3), (4, 3)]
    left = S.points_near_lines(nodes, e.where("id = 2"), 1.0, 10.0, "left")
    assert rows(left, "n", "id")[2:4] == [(3, 2), (4, 2)] and left.where("id is null").count() == 3


def test_components_and_gaps(spark):
    e = network(spark, (1, 1, 2, [(0, 0), (10, 0)]), (2, 2, 3, [(10, 0), (10, 30)]), (3, 8, 9, [(40, 40), (13, 20), (40, 0)]), (4, 20, 21, [(500, 500), (520, 500)]))
    parts = T.node_components(e)
    assert rows(parts, "n", "component") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (20, 20), (21, 20)]
    assert rows(T.gaps(e, parts, 5.0), "a", "b", "distance", "x", "y") == [(2, 3, 3.0, 11.5, 20.0)]
    with pytest.raises(Exception, match="no component"):
        T.edge_components(e, parts.where("n <> 8")).collect()
    assert rows(X.ranked(T.edge_components(e).groupBy("component").agg(F.round(F.sum("length"), 1).alias("m")), "rank", F.desc("m"), F.col("component")), "component", "rank") == [(1, 2), (8, 1), (20, 3)]


def test_parallel_edges_of_other_courses_stay(spark):
    straight, bent = [(0, 0), (10, 0)], [(0, 0), (5, 5), (10, 0)]
    e = network(spark, (1, 1, 2, straight), (2, 1, 2, bent), (3, 2, 1, bent[::-1]), (4, 2, 1, straight[::-1]), (5, 1, 2, [(0, 0), (5, -5), (10, 0)]), more={"name": {1: "a", 2: "a", 3: "b", 4: "a", 5: "a"}})
    assert rows(T.undirected(e), "id") == [(1,), (2,), (5,)]
    assert rows(T.undirected(e, attributes=("name",)), "id") == [(1,), (2,), (3,), (5,)]
    assert rows(T.duplicates(e), "id", "of") == [(3, 2), (4, 1)]
    assert rows(T.edge_keys(e), "id", "key") == [(1, 0), (2, 1), (3, 1), (4, 0), (5, 2)]
    assert rows(T.parallel_keys(e), "id", "key") == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 2)]
    assert rows(T.moved_keys(T.parallel_keys(e).where("id <> 3")), "id", "key") == [(1, 0), (2, 1), (4, 0), (5, 2)]


def test_graph_tables_fill_in_straight_lines(spark):
    e = network(spark, (1, 1, 2, [(0, 0), (3, 4), (6, 0)])).withColumn("line", F.lit(None).cast(G.LINE))
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 6.0, 0.0)], "n long, x double, y double")
    assert [G_ for G_ in T.graph_tables(nodes, e)[1].select(G.length(F.col("line"))).first()] == [6.0]


def test_simplified_paths(spark):
    e = network(spark, (1, 1, 2, [(0, 0), (5, 1), (10, 0)]), (2, 3, 2, [(20, 0), (10, 0)]), (3, 3, 4, [(20, 0), (30, 0)]), (4, 4, 5, [(30, 0), (30, 9)]), (5, 4, 6, [(30, 0), (40, 0)]), more={"kind": {1: "a", 2: "b", 3: "a"}})
    found = T.simplified(e, lists=("kind",)).withColumn("length", F.round("length", 3))
    assert [(r.chain, r.single, r.u, r.v, r.edges, r.kind) for r in found.orderBy(F.col("chain").desc_nulls_last(), "single").collect()] == [(2, None, 1, 4, 3, ["a", "b"]), (None, 4, 4, 5, 1, []), (None, 5, 4, 6, 1, [])]
    line = T.simplified_lines(e).where("chain = 2").first().line
    assert [(p.x, p.y) for p in line] in ([(0, 0), (5, 1), (10, 0), (20, 0), (30, 0)], [(30, 0), (20, 0), (10, 0), (5, 1), (0, 0)])
    assert T.simplified(e, ["kind"]).count() == 5
    both = network(spark, (1, 1, 2, [(0, 0), (1, 0)]), (2, 2, 1, [(1, 0), (0, 0)]), (3, 2, 3, [(1, 0), (2, 0)]), (4, 3, 2, [(2, 0), (1, 0)]))
    assert rows(T.endpoints(both, directed=True), "n", "endpoint") == [(1, True), (2, False), (3, True)]
    assert rows(T.endpoints(both), "n", "endpoint") == [(1, True), (2, True), (3, True)]


def test_simple_graph_splits_at_vertices(spark):
    loop, bent = [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)], [(0, 0), (1, 5), (2, 5), (3, 0)]
    e = network(spark, (1, 1, 1, loop), (2, 1, 2, [(0, 0), (3, 0)]), (3, 2, 1, bent[::-1]), (4, 1, 2, [(0, 0), (3, 0)]), (5, 3, 3, [(9, 9), (9, 12), (9, 9)]))
    got = T.simple_graph(e, 100)
    assert rows(got.withColumn("m", F.round(G.length(F.col("line")), 3)), "id", "u", "v", "m") == sorted([(1, 1, 102, 3.0), (1, 102, 103, 6.0), (1, 103, 1, 3.0), (2, 1, 2, 3.0), (3, 2, 106, 6.099), (3, 106, 1, 5.099), (4, 1, 108, 1.5), (4, 108, 2, 1.5), (5, 3, 110, 2.0), (5, 110, 111, 2.0), (5, 111, 3, 2.0)])
    pairs = [tuple(sorted(r)) for r in rows(got, "u", "v")]
    assert len(pairs) == len(set(pairs)) and all(u != v for u, v in pairs)


def test_overlay_keeps_lengths(spark):
    e = network(spark, (1, 1, 2, [(1, 1), (9, 1), (9, 19)]), (2, 3, 4, [(0, 0), (40, 40)]), (3, 5, 6, [(10, 0), (10, 25)]), (4, 7, 8, [(-5, 5), (25, 5)]))
    got = S.overlay(e, 10.0)
    assert rows(got.groupBy("id").agg(F.round(F.sum("part"), 6).alias("m"), F.count("*").alias("k")), "id", "m", "k") == [(1, 26.0, 2), (2, round(40 * 2**0.5, 6), 4), (3, 25.0, 3), (4, 30.0, 4)]
    # a line on a border is in one cell only
    assert rows(got.where("id = 3"), "cx", "cy") == [(1, 0), (1, 1), (1, 2)]
    long = network(spark, (1, 1, 2, [(0, 0), (9999, 9998)]))
    assert S.overlay(long, 10.0).count() < 2100


def test_densities_and_limits(spark):
    e = network(spark, (1, 1, 2, [(0, 0), (1000, 0)]), (2, 2, 3, [(1000, 0), (1000, 500)])).withColumns({"infrastructure_length": F.col("length") * 2, "protected": F.lit("mixed")})
    area = X.bounds_area(e)
    assert area.first().area == 0.5
    assert tuple(X.network_density(e, T.degrees(e), area).first()) == (6000.0, 6.0, 4.0)
    assert tuple(X.network_density(e.limit(0), T.degrees(e.limit(0)), area).first()) == (0.0, 0.0, None)
    found = {r.metric: r.value for r in X.summary(e, area).collect()}
    assert found["length_km"] == 1.5 and found["mixed_km"] == 3.0 and found["protected_km"] == 0 and found["edge_node_ratio"] == round(2 / 3, 4)
    assert X.summary_join(X.summary(e, area), X.summary(e, area)).where("difference <> 0").count() == 0
    with pytest.raises(Exception, match="only one summary"):
        X.summary_join(X.summary(e, area), X.summary(e, area).where("nth > 1")).collect()
    df = spark.createDataFrame([(1.0, None), (-7.0, 2.0), (None, 3.0)], "a double, b double")
    assert tuple(X.symmetric_limits(df, m="a", n="b").first()) == (7.0, 3.0)
    assert tuple(X.local_range(df, "b").first()) == (2.0, 3.0, 2.5)
    grid, result = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "cx int, cy int, a int"), spark.createDataFrame([(0, 1, 9)], "cx int, cy int, a int")
    assert rows(X.merged_results(grid, result), "cx", "cy", "a") == [(0, 0, None), (0, 1, 9)]
    assert X.cells_of(e, 300.0).count() == 4 * 2 and X.cells_of(e.limit(0), 300.0).count() == 0


def test_reach_counts_cells_of_all_components_there(spark):
    cells = spark.createDataFrame([(x, 0) for x in range(4)], "cx int, cy int")
    parts = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (1, 0, 2)], "cx int, cy int, component int")
    assert [(r.cx, r.cells_reached, r.reached_pct) for r in X.reach(cells, parts).orderBy("cx").collect()] == [(0, 2, 50.0), (1, 3, 75.0), (2, None, None), (3, None, None)]


def test_matching_of_bent_pieces(spark):
    ref = M.numbered(M.segments(network(spark, (1, 1, 2, [(0, 0), (30, 0), (30, 23)])), 10.0))
    assert rows(ref.withColumn("n", F.size("line")), "seg", "length", "n") == [("1_0", 10.0, 2), ("1_1", 10.0, 2), ("1_2", 10.0, 2), ("1_3", 10.0, 2), ("1_4", 13.0, 2)]
    bend = M.segments(network(spark, (1, 1, 2, [(0, 0), (5, 0), (5, 5)])), 10.0)
    assert [len(r.line) for r in bend.collect()] == [3]
    other = M.numbered(M.segments(network(spark, (7, 1, 2, [(0, 2), (30, 2)]), (8, 3, 4, [(5, -20), (5, 20)])), 10.0))
    pairs = M.candidates(ref, other, 3.0)
    assert {r.ref: r["count"] for r in M.overlay_buffer(pairs).collect()} == {"1_0": 4, "1_1": 3, "1_2": 2, "1_3": 1}
    best = M.best_matches(pairs, 30.0, 5.0)
    assert rows(best, "ref", "match", "hausdorff") == [("1_0", "7_0", 2.0), ("1_1", "7_1", 2.0), ("1_2", "7_2", 2.0)]
    split = M.statistics(ref, other, best)
    assert rows(split, "side", "segments", "matched", "percent") == [("other", 7, 3, 42.86), ("reference", 5, 3, 60.0)]


def test_rules_on_tags(spark):
    df = spark.createDataFrame([(1, "lane", "yes", 10.0, "no"), (2, "track", None, 20.0, None), (3, None, None, 30.0, "no"), (4, "lane", "no", 40.0, "yes")], "id long, way string, oneway string, length double, car string")
    groups = {("centerline", True): ["way == 'lane'"], ("centerline", False): ["way == 'lane' and oneway == 'yes'"], ("true_geometries", True): ["way == 'track'"]}
    kinds = R.direction_and_geometry(df, groups)
    assert rows(kinds, "id", "bicycle_geometries", "bicycle_bidirectional") == [(1, "centerline", False), (2, "true_geometries", True), (3, None, None), (4, "centerline", True)]
    assert rows(R.infrastructure_length(R.flag(kinds, {"a": "way in ['lane', 'track']"})).na.fill({"infrastructure_length": -1}), "id", "infrastructure_length") == [(1, 10.0), (2, 40.0), (3, -1.0), (4, 80.0)]
    assert rows(R.infrastructure_length(df, geometry="centerline_", both=True, present="yes").na.fill(0, ["infrastructure_length"]), "infrastructure_length")[0] == (0.0,)
    assert rows(R.protection(df, {"p": ["way == 'track'", "car == 'no'"], "u": ["way == 'lane'"]}).na.fill({"protected": "-"}), "id", "protected") == [(1, "mixed"), (2, "p"), (3, "p"), (4, "u")]
    assert rows(R.incompatible_tags(df, [("way", "lane", "car", "no"), ("none", "a", "car", "no")]), "combination", "count") == [("way=lane/car=no", 1)]
    assert {r.value: r.percent for r in R.shares(df, "way").collect()} == {"lane": 50.0, "track": 25.0, None: 25.0}
    with pytest.raises(Exception, match="id too long"):
        R.padded_index(df.selectExpr("123456 as n"), "n", 5).collect()


def test_settings_and_tables(spark, tmp_path):
    path = f"{tmp_path}/settings.json"
    with open(path, "w") as f:
        json.dump({"cell": 250, "infrastructure": {"A": "way == 'lane'"}, "keep": ["way", "gone"]}, f)
    made = settings.load(path)
    assert made.cell == 250 and made.buffer == 15 and made.infrastructure == {"A": "way == 'lane'"}
    with pytest.raises(ValueError):
        settings.Settings.of({"no such setting": 1})
    df = spark.createDataFrame([(1, "lane", 2)], "id long, way string, other int")
    assert settings.whitelisted(df, made.keep, ("id",)).columns == ["id", "way"]
    assert settings.place(str(tmp_path), "osm", "north", "processed") == f"{tmp_path}/data/OSM/north/processed"
    files.write_results(df, f"{tmp_path}/r", "csv")
    assert files.read_results(spark, f"{tmp_path}/r", "csv", "id long, way string, other int").collect() == df.collect()
    files.write_results(files.to_metrics(df), f"{tmp_path}/j", "json")
    assert files.metrics_of(files.read_results(spark, f"{tmp_path}/j", "json")) == {"id": 1, "way": "lane", "other": 2}
    runs = []
    for _ in range(2):
        again = files.cached(spark, str(tmp_path), "t", {"b": 1, "a": 2}, lambda: runs.append(1) or df)
    assert again.collect() == df.collect() and runs == [1]
    e = network(spark, (1, 1, 2, [(0, 0), (1, 1)]))
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "n long, x double, y double")
    files.save_graph(nodes, e, f"{tmp_path}/g")
    assert [t.count() for t in files.load_graph(spark, f"{tmp_path}/g")] == [2, 1]
    with pytest.raises(ValueError):
        files.save_graph(nodes.unionByName(nodes), e, f"{tmp_path}/h")


def test_geojson_lines_come_back(spark, tmp_path):
    e = network(spark, (1, 1, 2, [(0, 0), (3, 4)]), (2, 2, 3, [(3, 4), (3, 9), (8, 9)]))
    files.write_geojson(e.select("id", "line"), f"{tmp_path}/lines")
    got = files.read_geojson(spark, f"{tmp_path}/lines")
    assert rows(got.select(F.get_json_object("properties", "$.id").cast("long").alias("id"), G.length(F.col("line")).alias("m")), "id", "m") == [(1, 5.0), (2, 10.0)]
    with open(f"{tmp_path}/whole.geojson", "w") as f:
        json.dump({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 5}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 0]], [[5, 5], [5, 7, 3]]]}}]}, f)
    whole = files.read_geojson(spark, f"{tmp_path}/whole.geojson", whole=True)
    assert rows(whole.select(G.length(F.col("line")).alias("m")), "m") == [(1.0,), (2.0,)]


def test_streams_are_flagged_and_counted(spark, tmp_path):
    from meshqa.streaming import classify

    schema = "at timestamp, way string"
    given = spark.createDataFrame([("2024-01-01 00:01:00", "lane"), ("2024-01-01 00:02:00", "track"), ("2024-01-01 00:07:00", None), ("2024-01-01 01:00:00", "lane")], "at string, way string")
    given.selectExpr("cast(at as timestamp) at", "way").write.parquet(f"{tmp_path}/in")
    stream = classify.flagged(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), {"A": "way in ['lane', 'track']"})
    counted = classify.counts_by_window(stream, "at", "bicycle_infrastructure")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.start.hour, r.start.minute, r.bicycle_infrastructure): r.n for r in spark.table("counted").collect()}
    assert got == {(0, 0, "yes"): 2, (0, 5, "no"): 1, (1, 0, "yes"): 1}


def test_study_areas(spark):
    from meshqa.operators import polygons as P

    diamond = [(10.0, 0.0), (20.0, 10.0), (10.0, 20.0), (0.0, 10.0)]
    e = network(spark, (1, 1, 2, [(-5, 10), (25, 10)]), (2, 3, 4, [(0, 0), (4, 4)]), (3, 5, 6, [(10, 10), (10, 30), (12, 30)]), (4, 7, 8, [(0, 0), (30, 0)]))
    assert rows(S.clip_lines(e, diamond).withColumn("inside", F.round("inside", 6)), "id", "inside") == [(1, 20.0), (3, 10.0)]
    cells = P.convex_cells(spark, diamond, 10.0)
    assert rows(cells, "cx", "cy", "area") == [(0, 0, 50.0), (0, 1, 50.0), (1, 0, 50.0), (1, 1, 50.0)]
    hole = [(8.0, 8.0), (12.0, 8.0), (12.0, 12.0), (8.0, 12.0)]
    assert P.convex_cells(spark, diamond, 10.0, [hole]).agg(F.sum("area")).first()[0] == 200 - 16


def test_projection(spark):
    import math

    def meridian(lat: float) -> float:
        """The length of a meridian from the equator, by summing small steps."""
        e2, steps = G.FLATTENING * (2 - G.FLATTENING), 20_000
        return sum(G.RADIUS * (1 - e2) / (1 - e2 * math.sin(math.radians(lat) * (k + 0.5) / steps) ** 2) ** 1.5 for k in range(steps)) * math.radians(lat) / steps

    rows = spark.createDataFrame([(9.0, 0.0), (9.0, 55.0), (9.001, 55.0), (9.0, 55.001), (10.5, 55.0), (7.5, 55.0)], "lon double, lat double")
    a, b, c, d, e, f = ((r.p.x, r.p.y) for r in rows.select(G.to_utm(F.col("lon"), F.col("lat"), 32).alias("p")).collect())
    assert a == pytest.approx((500_000, 0), abs=1e-6) and b == pytest.approx((500_000, 0.9996 * meridian(55.0)), abs=1e-3)
    # angles are kept: a step east is at right angles to one north, and as long as it should be
    east, north = (c[0] - b[0], c[1] - b[1]), (d[0] - b[0], d[1] - b[1])
    assert abs(east[1]) < 1e-3 and abs(north[0]) < 1e-6
    prime = G.RADIUS / math.sqrt(1 - G.FLATTENING * (2 - G.FLATTENING) * math.sin(math.radians(55)) ** 2) * math.cos(math.radians(55))
    assert east[0] == pytest.approx(0.9996 * prime * math.radians(0.001), abs=1e-4)
    assert e[0] - 500_000 == pytest.approx(500_000 - f[0], abs=1e-6) and e[1] == pytest.approx(f[1], abs=1e-6)
    assert spark.range(1).select(G.to_utm(F.lit(9.0), F.lit(-1.0), 32, True)["y"]).first()[0] == pytest.approx(10_000_000 - 0.9996 * meridian(1.0), abs=1e-3)


def test_matching_does_its_work_after_the_join(spark):
    # conditions that cost something are generated columns, or the join computes them for every pair of a cell
    line = lambda k, y: (k, 1, 2, [(0, y), (60, y), (60, y + 30)])
    ref, other = (M.numbered(M.segments(network(spark, *rows), 40.0)) for rows in ([line(1, 0), line(2, 200)], [line(7, 4), line(8, 190)]))
    found = M.match(ref, other, 15.0, 30.0, 17.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(row for row in plan.split("\n") if "Join Inner" in row)
    assert "ATAN2" not in join and "SQRT" not in join and "transform" not in join
    pairs = M.candidates(ref, other, 15.0)
    assert pairs.count() == pairs.distinct().count() > 4
    plain = M.best_matches(pairs, 30.0, 17.0)
    rows = {tuple(r) for r in found.select("ref", "match", "hausdorff").collect()}
    assert rows == {tuple(r) for r in plain.collect()} and len(rows) == 4
    # with the lengths of matched pieces at hand the figures are those of a second meeting
    assert sorted(map(tuple, M.statistics(ref, other, found).select("side", "segments", "matched", "length", "matched_length").collect())) == sorted(map(tuple, M.statistics(ref, other, plain).select("side", "segments", "matched", "length", "matched_length").collect()))
    got = S.overlay(M.split(ref, plain, "ref"), 30.0, "seg")
    assert sorted(map(tuple, got.select("seg", "cx", "cy", "matched").collect())) == sorted(map(tuple, S.overlay(M.split(ref, plain, "ref"), 30.0, "seg", keep=["matched"]).select("seg", "cx", "cy", "matched").collect()))
