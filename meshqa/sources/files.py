"""Reading and writing networks and results: Parquet, CSV and JSON by Spark; GeoPackage lines and polygons through a
Python data source; a table written once under its settings and read from then on."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def read_results(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def to_metrics(row: DataFrame) -> DataFrame:
    """A one-row result as metric, value (JSON text)."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value")) for c in row.columns])))


def metrics_of(table: DataFrame) -> dict:
    """metric, value (JSON text) as a dictionary: a row a metric of one result."""
    return {r.metric: json.loads(r.value).get("v") for r in table.collect()}


def write_geojson(df: DataFrame, path: str, line: str = "line") -> None:
    """Lines as GeoJSON features, one a row of text; other columns are their properties."""
    coordinates = F.transform(line, lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*[c for c in df.columns if c != line]).alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """properties (JSON text) and line: a row for each line of GeoJSON features, one a row of text; whole: files that hold
    a collection each. Further ordinates are skipped; features that are no lines are left out."""
    feature = "struct<type:string,properties:string,geometry:struct<type:string,coordinates:string>>"
    text = spark.read.text(path, wholetext=whole)
    found = text.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f")) if whole else text.select(F.from_json("value", feature).alias("f"))
    of = F.col("f.geometry.coordinates")
    lines = F.when(F.col("f.geometry.type") == "LineString", F.array(F.from_json(of, "array<array<double>>"))).when(F.col("f.geometry.type") == "MultiLineString", F.from_json(of, "array<array<array<double>>>"))
    return found.select(F.col("f.properties").alias("properties"), F.explode(lines).alias("l")).select("properties", F.transform("l", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("line"))


def lines_of(features: DataFrame) -> DataFrame:
    """A row a line of features with `parts`, as the GeoPackage source gives them."""
    return features.select(*[c for c in features.columns if c != "parts"], F.explode("parts").alias("line"))


def cached(spark: SparkSession, folder: str, name: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under its name and settings; made if it is not there."""
    path = f"{folder}/{name}" + "".join(f"_{k}={v}" for k, v in sorted(settings.items()))
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as a pair of tables. Ids must be unique."""
    for df, key in ((nodes, "n"), (edges, "id")):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def parts_of_wkb(data: bytes, at: int = 0) -> tuple[list[list[tuple[float, float]]], int]:
    """The point lists of a WKB point, line, polygon or collection of them (2D; further ordinates are skipped)."""
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if kind & 0x20000000:
        at += 4
    size = 2 + bool(kind & 0x80000000 or kind % 10000 // 1000 in (1, 3)) + bool(kind & 0x40000000 or kind % 10000 // 1000 in (2, 3))
    kind = kind & 0xFFFF if kind < 0x10000000 else kind & 0x0FFFFFFF
    kind %= 1000

    def points(n: int, at: int):
        flat = struct.unpack_from(f"{order}{n * size}d", data, at)
        return [(flat[k], flat[k + 1]) for k in range(0, n * size, size)], at + 8 * n * size

    if kind == 1:
        line, at = points(1, at)
        return [line], at
    (n,), at = struct.unpack_from(order + "I", data, at), at + 4
    out: list = []
    for _ in range(1 if kind == 2 else n):
        if kind == 2:
            line, at = points(n, at)
            out.append(line)
        elif kind == 3:
            (m,), at = struct.unpack_from(order + "I", data, at), at + 4
            line, at = points(m, at)
            out.append(line)
        else:
            more, at = parts_of_wkb(data, at)
            out += more
    return out, at


def parts_of_gpkg(blob: bytes) -> list[list[tuple[float, float]]]:
    """A GeoPackage geometry: its header's flags tell how long its envelope is; WKB follows."""
    if blob[:2] != b"GP":
        raise ValueError("no GeoPackage geometry")
    return parts_of_wkb(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])[0]


class GeoPackage(DataSource):
    """spark.read.format("gpkg").option("path", file).option("layer", table).load(): the layer's columns as JSON text, and
    `parts`, its geometry's lines or rings. The file is read in ranges of row ids. It must lie where executors see it."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return "fid long, properties string, parts array<array<struct<x:double,y:double>>>"

    def reader(self, schema):
        return _GeoPackageReader(self.options)


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layer, self.n = options["path"], options.get("layer"), int(options.get("partitions", 8))

    def _open(self):
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        layer = self.layer or db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY 1").fetchone()[0]
        column = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()[0]
        return db, layer.replace('"', '""'), column

    def partitions(self):
        db, layer, _ = self._open()
        lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{layer}"').fetchone()
        if lo is None:
            return [InputPartition((0, -1))]
        step = -(-(hi - lo + 1) // self.n)
        return [InputPartition((k, min(hi, k + step - 1))) for k in range(lo, hi + 1, step)]

    def read(self, partition):
        db, layer, column = self._open()
        rows = db.execute(f'SELECT rowid, * FROM "{layer}" WHERE rowid BETWEEN ? AND ?', partition.value)
        names = [d[0] for d in rows.description][1:]
        for fid, *values in rows:
            row = dict(zip(names, values))
            blob = row.pop(column)
            yield fid, json.dumps(row, default=str), [[{"x": x, "y": y} for x, y in p] for p in parts_of_gpkg(blob)] if blob else None
