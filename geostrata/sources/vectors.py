"""Vector layers: features with a geometry in WKT and typed fields, in parquet, shapefiles, SQLite or a JDBC table."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wkt import parse_polygons

#: Field kinds of layers, and what they are in Spark.
FIELD_TYPES = {"Int": "bigint", "Double": "double", "String": "string", "Blob": "binary"}
GEOMETRY_TYPES = ("Point", "Line", "Polygon", "MultiPoint", "MultiLine", "MultiPolygon", "PointZ", "MultiPolygonZ")
#: Names of coordinate systems that are known without a projection library.
PROJECTIONS = {4326: 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'}


def projection_from_srid(srid: int) -> str:
    """WKT of WGS 84 or of its UTM zones."""
    if srid in PROJECTIONS:
        return PROJECTIONS[srid]
    if 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        zone, north = srid % 100, srid < 32700
        return f'PROJCS["WGS 84 / UTM zone {zone}{"N" if north else "S"}",{PROJECTIONS[4326]},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",{zone * 6 - 183}],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",{0 if north else 10000000}],UNIT["metre",1],AUTHORITY["EPSG","{srid}"]]'
    raise ValueError(f"no projection for {srid}")


def with_constants(features: DataFrame, **values: int | float | str) -> DataFrame:
    """Fields that have one value in every feature."""
    return features.withColumns({k: F.lit(v) for k, v in values.items()}) if values else features


def write_layer(features: DataFrame, folder: str, layer: str = "data", replace: bool = False, order: list[str] | None = None) -> None:
    """A layer as parquet. order clusters its files, which stands in for a spatial index."""
    held = features.repartitionByRange(*order).sortWithinPartitions(*order) if order else features
    held.write.mode("overwrite" if replace else "errorifexists").parquet(os.path.join(folder, layer))


def read_layer(spark: SparkSession, folder: str, layer: str = "data") -> DataFrame:
    return spark.read.parquet(os.path.join(folder, layer))


def layer_fields(features: DataFrame) -> dict[str, str]:
    names = {v: k for k, v in FIELD_TYPES.items()} | {"int": "Int", "float": "Double", "smallint": "Int"}
    return {c: names.get(t, "Unknown") for c, t in features.dtypes}


def convert(spark: SparkSession, source: str, target: str, kind: str) -> None:
    """A layer in another format: parquet, csv or json."""
    spark.read.parquet(source).write.format(kind).option("header", True).save(target)


def write_jdbc(features: DataFrame, url: str, layer: str, properties: dict[str, str] | None = None) -> None:
    """Features appended to a database table, each partition in a transaction."""
    features.write.jdbc(url, layer, mode="append", properties=properties or {})


def write_sqlite(features: DataFrame, path: str, layer: str = "data", batch: int = 10_000) -> int:
    """Features into a table of a local SQLite file, in one transaction, row by row from the partitions in turn; gives their number."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
    columns = features.dtypes
    n = 0
    with sqlite3.connect(path) as base:
        base.execute(f'CREATE TABLE IF NOT EXISTS "{layer}" (' + ", ".join(f'"{c}" {kinds.get(t, "TEXT")}' for c, t in columns) + ")")
        held = []
        for row in features.toLocalIterator(prefetchPartitions=False):
            held.append(tuple(row))
            if len(held) == batch:
                base.executemany(f'INSERT INTO "{layer}" VALUES ({",".join("?" * len(columns))})', held)
                n, held = n + len(held), []
        if held:
            base.executemany(f'INSERT INTO "{layer}" VALUES ({",".join("?" * len(columns))})', held)
    return n + len(held)


def read_sqlite(spark: SparkSession, path: str, layer: str = "data", schema: str | None = None) -> DataFrame:
    with sqlite3.connect(path) as base:
        held = base.execute(f'SELECT * FROM "{layer}"')
        names = [d[0] for d in held.description]
        rows = held.fetchall()
    return spark.createDataFrame(rows, schema or names)


def encode_shp(shapes: list[list[list[np.ndarray]]]) -> bytes:
    """Polygons (each a list of polygons of rings) as the main file of a shapefile; outer rings run clockwise, holes the other way."""
    records, boxes = [], []
    for number, polygons in enumerate(shapes, 1):
        rings = []
        for polygon in polygons:
            for i, ring in enumerate(polygon):
                turn = float((ring[:-1, 0] * ring[1:, 1] - ring[1:, 0] * ring[:-1, 1]).sum())
                rings.append(ring[::-1] if (turn > 0) == (i == 0) else ring)
        points = np.vstack(rings) if rings else np.zeros((0, 2))
        if not len(points):
            body = struct.pack("<i", 0)
        else:
            box = (*points.min(0), *points.max(0))
            boxes.append(box)
            starts = np.cumsum([0, *[len(r) for r in rings[:-1]]])
            body = struct.pack("<i4d2i", 5, *box, len(rings), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
        records.append(struct.pack(">2i", number, len(body) // 2) + body)
    held = b"".join(records)
    all_ = np.array(boxes) if boxes else np.zeros((1, 4))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(held) // 2) + struct.pack("<2i8d", 1000, 5, all_[:, 0].min(), all_[:, 1].min(), all_[:, 2].max(), all_[:, 3].max(), 0, 0, 0, 0)
    return head + held


def decode_shp(raw: bytes) -> list[tuple[int, str | None]]:
    """(record number, WKT) of each shape: points, lines and polygons; a null shape has none."""
    at, out = 100, []
    text = lambda p: ", ".join(f"{x!r} {y!r}" for x, y in p.tolist())
    while at + 12 <= len(raw):
        number, words = struct.unpack_from(">2i", raw, at)
        kind, = struct.unpack_from("<i", raw, at + 8)
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", raw, at + 12)
            out.append((number, f"POINT ({x!r} {y!r})"))
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, n = struct.unpack_from("<2i", raw, at + 44)
            starts = [*np.frombuffer(raw, "<i4", parts, at + 52).tolist(), n]
            points = np.frombuffer(raw, "<f8", 2 * n, at + 52 + 4 * parts).reshape(n, 2)
            rings = [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            if kind in (3, 13, 23):
                out.append((number, "MULTILINESTRING (" + ", ".join(f"({text(r)})" for r in rings) + ")"))
            else:
                polygons: list[list[str]] = []
                for r in rings:
                    outer = float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) <= 0
                    if outer or not polygons:
                        polygons.append([])
                    polygons[-1].append(f"({text(r)})")
                out.append((number, "MULTIPOLYGON (" + ", ".join("(" + ", ".join(p) + ")" for p in polygons) + ")"))
        else:
            out.append((number, None))
        at += 8 + 2 * words
    return out


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, wkt) of shapefiles' main files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = decode_shp(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], names=["file", "record", "wkt"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, record int, wkt string")


def write_shp(features: DataFrame, folder: str, wkt: str = "wkt") -> DataFrame:
    """A shapefile for each partition in a shared folder; gives (file, features) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        shapes = [parse_polygons(w) for batch in batches for w in batch.column(0).to_pylist()]
        if shapes:
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, f"part-{uuid.uuid4().hex}.shp")
            with open(path, "wb") as file:
                file.write(encode_shp(shapes))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(shapes)], pa.int64())], names=["file", "features"])

    return features.select(F.col(wkt).cast("string")).mapInArrow(run, "file string, features long")
