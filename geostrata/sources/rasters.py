"""Raster files: the engine's own store, GeoTIFF and ENVI, and what their headers say."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GridSpec

_NUMPY = {"Float64": "f8", "Float32": "f4", "UInt32": "u4", "UInt16": "u2", "Byte": "u1", "Int32": "i4", "Int16": "i2"}
_ENVI = {1: "Byte", 2: "Int16", 3: "Int32", 4: "Float32", 5: "Float64", 12: "UInt16", 13: "UInt32"}
#: File endings of the drivers that are known here.
RASTER_DRIVERS = {"GTiff": ("tif", "tiff"), "ENVI": ("dat", "img", "envi"), "Store": ("raster",)}
VECTOR_DRIVERS = {"ESRI Shapefile": ("shp",), "SQLite": ("sqlite", "db"), "CSV": ("csv",), "GeoJSON": ("geojson", "json"), "Parquet": ("parquet",)}


def drivers(spark: SparkSession, like: str = "") -> DataFrame:
    """(kind, driver, extension) of all drivers whose name holds a text."""
    rows = [(k, d, e) for k, held in (("raster", RASTER_DRIVERS), ("vector", VECTOR_DRIVERS)) for d, es in held.items() for e in es if like.lower() in d.lower()]
    return spark.createDataFrame(rows, "kind string, driver string, extension string")


def driver_for(path: str) -> str | None:
    ending = os.path.splitext(path)[1].lstrip(".").lower()
    return next((d for held in (RASTER_DRIVERS, VECTOR_DRIVERS) for d, es in held.items() if ending in es), None)


def write_store(raster: DataFrame, spec: GridSpec, folder: str, mode: str = "errorifexists") -> None:
    """Cells as parquet by band, with the frame beside them."""
    raster.where(F.col("value").isNotNull()).write.mode(mode).partitionBy("band").parquet(os.path.join(folder, "cells"))
    raster.sparkSession.createDataFrame([(spec.to_json(),)], "value string").coalesce(1).write.mode(mode).text(os.path.join(folder, "spec"))


def read_store(spark: SparkSession, folder: str, band: int | None = None) -> tuple[GridSpec, DataFrame]:
    spec = GridSpec.from_json(spark.read.text(os.path.join(folder, "spec")).first()[0])
    cells = spark.read.parquet(os.path.join(folder, "cells"))
    return spec, (cells if band is None else cells.where(F.col("band") == band))


def encode_tiff(spec: GridSpec, bands: np.ndarray, compress: bool = True) -> bytes:
    """A GeoTIFF of bands (n x rows x cols), a strip for each row of each band, with the frame's transform and nodata."""
    kind = np.dtype("<" + _NUMPY[spec.kind])
    n, rows, cols = bands.shape
    strips = []
    for b in range(n):
        for r in range(rows):
            raw = np.ascontiguousarray(np.where(np.isnan(bands[b, r]), spec.nodata, bands[b, r]).astype(kind)).tobytes()
            strips.append(zlib.compress(raw) if compress else raw)
    sample = {"f": 3, "i": 2, "u": 1}[kind.kind]
    nodata = f"{spec.nodata:g}\0".encode()
    scale = struct.pack("<3d", abs(spec.res_x), abs(spec.res_y), 0.0)
    tie = struct.pack("<6d", 0, 0, 0, spec.tlx, spec.tly, 0)
    keys = struct.pack("<8H", 1, 1, 0, 1, 1024, 0, 1, 1)
    body, at = b"", 8
    places = []
    for s in strips:
        places.append(at)
        body += s
        at += len(s)
    entries: list[tuple[int, int, int, bytes]] = []
    short = lambda tag, *v: entries.append((tag, 3, len(v), struct.pack(f"<{len(v)}H", *v)))
    long = lambda tag, *v: entries.append((tag, 4, len(v), struct.pack(f"<{len(v)}I", *v)))
    long(256, cols)
    long(257, rows)
    short(258, *[8 * kind.itemsize] * n)
    short(259, 8 if compress else 1)
    short(262, 1)
    long(273, *places)
    short(277, n)
    long(278, 1)
    long(279, *[len(s) for s in strips])
    short(284, 2 if n > 1 else 1)
    short(339, *[sample] * n)
    entries += [(33550, 12, 3, scale), (33922, 12, 6, tie), (34735, 3, 8, keys), (42113, 2, len(nodata), nodata)]
    extra_at = at + 2 + 12 * len(entries) + 4
    directory, extra = struct.pack("<H", len(entries)), b""
    for tag, type_, count, data in entries:
        if len(data) <= 4:
            held = data.ljust(4, b"\0")
        else:
            held = struct.pack("<I", extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        directory += struct.pack("<HHI", tag, type_, count) + held
    return struct.pack("<2sHI", b"II", 42, at) + body + directory + struct.pack("<I", 0) + extra


def _unpack_lzw(data: bytes) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, bits, held, last = [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if code == 257:
                return b"".join(out)
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        held &= (1 << bits) - 1
    return b"".join(out)


def decode_tiff(raw: bytes) -> tuple[GridSpec, np.ndarray]:
    """Frame and bands of a GeoTIFF: strips or tiles, plain, LZW or deflate, with or without a difference of columns."""
    order = "<" if raw[:2] == b"II" else ">"
    at, = struct.unpack_from(order + "I", raw, 4)
    tags: dict[int, tuple] = {}
    sizes = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
    count, = struct.unpack_from(order + "H", raw, at)
    for i in range(count):
        tag, type_, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
        if type_ not in sizes:
            continue
        code, size = sizes[type_]
        place = at + 2 + 12 * i + 8
        if n * size > 4:
            place, = struct.unpack_from(order + "I", raw, place)
        tags[tag] = (raw[place : place + n],) if type_ == 2 else struct.unpack_from(order + code * n if len(code) == 1 else order + code * n, raw, place)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    cols, rows, n = one(256), one(257), one(277, 1)
    kind = next(k for k, c in _NUMPY.items() if c == {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 8) // 8))
    dtype = np.dtype(order + _NUMPY[kind])
    planar = one(284, 1) == 2
    tiled = 324 in tags
    width, height = (one(322), one(323)) if tiled else (cols, one(278, rows))
    across = -(-cols // width)
    down = -(-rows // height)
    out = np.zeros((n, rows, cols))
    samples = 1 if planar else n
    for k, (place, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        data = raw[place : place + size]
        data = {1: lambda d: d, 5: _unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}[one(259, 1)](data)
        band, part = divmod(k, across * down) if planar else (0, k)
        r0, c0 = part // across * height, part % across * width
        lines = height if tiled else min(height, rows - r0)
        block = np.frombuffer(data, dtype, lines * width * samples).reshape(lines, width, samples)
        if one(317, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        r, c = min(lines, rows - r0), min(width, cols - c0)
        for s in range(samples):
            out[band + s, r0 : r0 + r, c0 : c0 + c] = block[:r, :c, s]
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0, 0, 0, 0.0, 0.0, 0.0))
    nodata = float(tags[42113][0].rstrip(b"\0 ")) if 42113 in tags else None
    spec = GridSpec(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], -scale[1], cols, rows, n, -9999.0 if nodata is None else nodata, kind)
    if nodata is not None:
        out[out == nodata] = np.nan
    return spec, out


def encode_envi(spec: GridSpec, bands: np.ndarray) -> tuple[str, bytes]:
    """Header text and data of an ENVI raster in the frame's interleave."""
    code = next(c for c, k in _ENVI.items() if k == spec.kind)
    axes = {"BSQ": (0, 1, 2), "BIL": (1, 0, 2), "BIP": (1, 2, 0)}[spec.interleave]
    data = np.where(np.isnan(bands), spec.nodata, bands).transpose(axes).astype("<" + _NUMPY[spec.kind])
    header = f"ENVI\nsamples = {spec.cols}\nlines = {spec.rows}\nbands = {len(bands)}\nheader offset = 0\ndata type = {code}\ninterleave = {spec.interleave.lower()}\nbyte order = 0\ndata ignore value = {spec.nodata:g}\nmap info = {{Arbitrary, 1, 1, {spec.tlx!r}, {spec.tly!r}, {abs(spec.res_x)!r}, {abs(spec.res_y)!r}}}\n"
    return header, np.ascontiguousarray(data).tobytes()


def decode_envi(header: str, raw: bytes) -> tuple[GridSpec, np.ndarray]:
    held = {k.strip().lower(): v.strip() for k, _, v in (line.partition("=") for line in header.splitlines()) if v}
    cols, rows, n = int(held["samples"]), int(held["lines"]), int(held.get("bands", 1))
    kind, interleave = _ENVI[int(held["data type"])], held.get("interleave", "bsq").upper()
    info = [p.strip() for p in held.get("map info", "{x, 1, 1, 0, 0, 1, 1}").strip("{}").split(",")]
    order = ">" if held.get("byte order", "0") == "1" else "<"
    shape, back = {"BSQ": ((n, rows, cols), (0, 1, 2)), "BIL": ((rows, n, cols), (1, 0, 2)), "BIP": ((rows, cols, n), (2, 0, 1))}[interleave]
    bands = np.frombuffer(raw, order + _NUMPY[kind], n * rows * cols, int(held.get("header offset", 0))).reshape(shape).transpose(back).astype(float)
    nodata = float(held.get("data ignore value", -9999.0))
    bands[bands == nodata] = np.nan
    return GridSpec(float(info[3]), float(info[4]), float(info[5]), -float(info[6]), cols, rows, n, nodata, kind, interleave), bands


def read_tiff(spark: SparkSession, path: str, band: int | None = None) -> DataFrame:
    """(file, band, row, col, x, y, value) of the cells with data of GeoTIFFs; a file is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spec, bands = decode_tiff(content.as_py())
                for b in range(spec.bands):
                    if band is not None and b + 1 != band:
                        continue
                    for r0 in range(0, spec.rows, max(1, 65_536 // max(spec.cols, 1))):
                        part = bands[b, r0 : r0 + max(1, 65_536 // max(spec.cols, 1))]
                        r, c = np.nonzero(~np.isnan(part))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(r)), pa.array(np.full(len(r), b + 1, np.int32)), pa.array((r + r0).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(spec.tlx + (c + 0.5) * spec.res_x), pa.array(spec.tly + (r + r0 + 0.5) * spec.res_y), pa.array(part[r, c])], names=["file", "band", "row", "col", "x", "y", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, band int, row int, col int, x double, y double, value double")


def write_tiff_tiles(raster: DataFrame, spec: GridSpec, folder: str, tile: int = 1024) -> DataFrame:
    """Writes the raster as GeoTIFF tiles into a shared folder and gives (file, cells) of what was written.

    A tile is built in the task that has its cells, so no task holds more than a tile.
    """
    from ..operators.raster import tiles

    def write(cells: pa.Table) -> pa.Table:
        tr, tc = cells.column("tile_row")[0].as_py(), cells.column("tile_col")[0].as_py()
        rows, cols = min(tile, spec.rows - tr * tile), min(tile, spec.cols - tc * tile)
        bands = np.full((spec.bands, rows, cols), np.nan)
        bands[cells.column("band").to_numpy() - 1, cells.column("row").to_numpy() - tr * tile, cells.column("col").to_numpy() - tc * tile] = cells.column("value").to_numpy()
        own = replace(spec, tlx=spec.tlx + tc * tile * spec.res_x, tly=spec.tly + tr * tile * spec.res_y, rows=rows, cols=cols)
        path = os.path.join(folder, f"tile_{tr}_{tc}.tif")
        os.makedirs(folder, exist_ok=True)
        with open(path + ".writing", "wb") as file:
            file.write(encode_tiff(own, bands))
        os.replace(path + ".writing", path)
        return pa.table({"file": [path], "cells": [len(cells)]})

    held = raster.where(F.col("value").isNotNull() & spec.has(F.col("col"), F.col("row"))).select("band", "row", "col", F.col("value").cast("double").alias("value"))
    return tiles(held, tile).groupBy("tile_row", "tile_col").applyInArrow(write, "file string, cells long")


def save_grid(raster: DataFrame, spec: GridSpec, folder: str) -> DataFrame:
    """Quick save as Float32 with nodata -9999."""
    return write_tiff_tiles(raster, replace(spec, kind="Float32", nodata=-9999.0), folder)


def band_info(path: str) -> dict[str, object]:
    """Number of bands, size and type of a raster file, from its content."""
    with open(path, "rb") as file:
        spec, _ = decode_tiff(file.read())
    return {"bands": spec.bands, "cols": spec.cols, "rows": spec.rows, "kind": spec.kind, "nodata": spec.nodata}
