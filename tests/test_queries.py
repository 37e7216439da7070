"""Every query with SQL against DuckDB on the small tables, and the reference expectations on tiny inputs."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from meshqa.functions import geometry as G
from meshqa.functions.predicates import RuleError, matches, to_sql
from meshqa.operators import polygons, rules
from meshqa.operators import topology as T
from meshqa.operators.components import components
from meshqa.operators.matching import segments as line_segments
from meshqa.plans.catalog import ORACLES, QUERIES
from meshqa.sources import files
from tests.conftest import SMALL


def _same(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 4) if isinstance(value, (int, float)) or hasattr(value, "as_tuple") else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_same(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders",):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    df = QUERIES[name](spark, SMALL)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, want.fetchall())


def test_rules_treat_nulls_as_missing(spark):
    df = spark.createDataFrame([("no", "lane"), (None, None), ("yes", "track")], "o string, r string")
    held = lambda rule: [tuple(r) for r in df.where(matches(rule)).collect()]
    assert held("o != 'no'") == [(None, None), ("yes", "track")]
    assert held("r not in ['lane']") == [(None, None), ("yes", "track")]
    assert held("o == 'no' or o.isnull()") == [("no", "lane"), (None, None)]
    assert held("not (o == 'no') and r in ['track', 'lane']") == [("yes", "track")]
    for bad in ("o ==", "== 'a'", "o = 'a'", "o in []", "o == 'a' )"):
        with pytest.raises(RuleError):
            to_sql(bad)


def test_geometry(spark):
    line = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    get = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert get(G.length(line((0, 0), (3, 4), (3, 5)))) == 6
    assert get(G.polygon_area(F.array(line((0, 0), (10, 0), (10, 10), (0, 10)), line((1, 1), (3, 1), (3, 3), (1, 3))))) == 96
    assert get(G.hausdorff(line((0, 0), (10, 0)), line((10, 0), (20, 0)))) == 10
    assert get(G.direction_angle(line((0, 0), (1, 0)), line((0, 0), (-1, 1)))) == pytest.approx(45)
    assert get(G.canonical(line((0, 0), (1, 1)))) == get(G.canonical(line((1, 1), (0, 0))))
    cut = line_segments(spark.range(1).withColumn("line", line((0, 0), (20, 0), (20, 33))), 8).select("part", G.length(F.col("line")).alias("n")).orderBy("part").collect()
    assert [round(r.n, 6) for r in cut] == [8, 8, 8, 8, 8, 8, 5]


def test_grid_and_areas(spark):
    cells = polygons.rectangle_cells(spark, 0, 0, 10, 10, 1, (1, 1, 3, 3))
    assert cells.count() == 96 and cells.agg(F.sum("area")).first()[0] == 96
    points = spark.createDataFrame([(float(x), float(y)) for x in range(11) for y in range(11)], "x double, y double")
    assert polygons.graph_area(points).first().area == 100
    assert polygons.graph_area(points, [(5.0, 5.0), (20.0, 5.0), (20.0, 20.0), (5.0, 20.0)]).first().area == 25
    parts = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)]), (1, [(2.0, 0.0), (1.0, 0.0)])], f"id long, line {G.LINE}")
    assert [len(r.line) for r in polygons.merged_lines(parts, "id").collect()] == [3]


def test_components_settle(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000, 5000: 5000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rings_and_keys(spark):
    ring = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 1, 1.0)], "id long, u long, v long, length double")
    r = T.simplified(ring).first()
    assert (r.chain, r.u, r.v, r.edges, r.length) == (1, None, None, 3, 3.0)
    assert sorted(x.key for x in T.parallel_keys(spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 1)], "id long, u long, v long")).collect()) == [0, 0, 1]


def test_names_and_settings(spark):
    df = spark.createDataFrame([(1, "a")], "`Cycleway:Both` long, Way string")
    assert rules.clean_names(df).columns == ["cycleway_both", "way"]
    with pytest.raises(ValueError):
        rules.clean_names(spark.createDataFrame([(1, 2)], "`a:b` long, a_b long"))
    assert rules.padded_index(df.selectExpr("12 as n"), "n", 5).first().node_index == "00012"


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    db = sqlite3.connect(path := f"{tmp_path}/x.gpkg")
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_contents VALUES ('ways', 'features')")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('ways', 'geom')")
    db.execute("CREATE TABLE ways (fid INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
    wkb = struct.pack("<BII4d", 1, 2, 2, 0, 0, 3, 4)
    db.execute("INSERT INTO ways (name, geom) VALUES ('a', ?)", (b"GP\0\1" + struct.pack("<i", 0) + wkb,))
    db.commit()
    spark.dataSource.register(files.GeoPackage)
    r = spark.read.format("gpkg").option("path", path).load().select("properties", G.length(F.col("parts")[0]).alias("n")).first()
    assert r.n == 5 and '"a"' in r.properties
    assert math.isclose(r.n, 5)
