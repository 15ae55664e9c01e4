"""LAS point files: a Spark data source ("las") that reads records in Arrow batches and writes a file for each partition."""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "x double, y double, z double, intensity double, scan_angle double, cls int, return_num int, num_returns int, is_edge boolean, gps_time double, file string"
CHUNK_RECORDS = 1_000_000
_SCALE = 0.001


@dataclass(frozen=True)
class Header:
    version: tuple[int, int]
    data_at: int
    point_format: int
    record_length: int
    count: int
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    least: tuple[float, ...]
    most: tuple[float, ...]


def read_header(path: str) -> Header:
    with open(path, "rb") as file:
        raw = file.read(375)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    major, minor = raw[24], raw[25]
    data_at, = struct.unpack_from("<I", raw, 96)
    form, length, count = struct.unpack_from("<BHI", raw, 104)
    if form & 0x80:
        raise ValueError(f"{path} is compressed")
    numbers = struct.unpack_from("<12d", raw, 131)
    if (major, minor) >= (1, 4):
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    return Header((major, minor), data_at, form, length, count, numbers[:3], numbers[3:6], (numbers[7], numbers[9], numbers[11]), (numbers[6], numbers[8], numbers[10]))


def decode(raw: bytes, header: Header) -> dict[str, np.ndarray]:
    """Columns of whole records."""
    n = len(raw) // header.record_length
    held = np.frombuffer(raw, np.uint8, n * header.record_length).reshape(n, header.record_length)
    take = lambda at, kind: np.ascontiguousarray(held[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    out = {c: take(4 * i, "<i4") * header.scale[i] + header.offset[i] for i, c in enumerate("xyz")}
    out["intensity"] = take(12, "<u2").astype(float)
    flags = held[:, 14]
    if header.point_format >= 6:
        out |= {"return_num": flags & 15, "num_returns": flags >> 4, "is_edge": held[:, 15] >> 7 == 1, "cls": held[:, 16], "scan_angle": take(18, "<i2") * 0.006, "gps_time": take(22, "<f8")}
    else:
        out |= {"return_num": flags & 7, "num_returns": flags >> 3 & 7, "is_edge": flags >> 7 == 1, "cls": held[:, 15] & 31, "scan_angle": take(16, "i1").astype(float)}
        out["gps_time"] = take(20, "<f8") if header.point_format in (1, 3, 4, 5) else np.full(n, np.nan)
    return out


def _files(path: str) -> list[str]:
    found = []
    for part in path.split(","):
        found += sorted(glob.glob(os.path.join(part, "*.[lL][aA][sS]"))) if os.path.isdir(part) else sorted(glob.glob(part))
    return found


class _Chunk(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class LasReader(DataSourceReader):
    """A partition for each chunk of records of a file, so that a large file is many tasks."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.chunk = int(options.get("chunkrecords", CHUNK_RECORDS))

    def partitions(self) -> list[_Chunk]:
        return [_Chunk(p, at, min(self.chunk, h.count - at)) for p in _files(self.path) for h in (read_header(p),) for at in range(0, h.count, self.chunk)]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        header = read_header(partition.path)
        with open(partition.path, "rb") as file:
            file.seek(header.data_at + partition.first * header.record_length)
            left = partition.count
            while left:
                n = min(left, 65_536)
                held = decode(file.read(n * header.record_length), header)
                left -= n
                arrays = [pa.array(held[c]) for c in ("x", "y", "z", "intensity", "scan_angle")] + [pa.array(held[c].astype(np.int32)) for c in ("cls", "return_num", "num_returns")] + [pa.array(held["is_edge"]), pa.array(held["gps_time"], from_pandas=True), pa.array([partition.path] * n)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")])


def encode(columns: dict[str, np.ndarray], template: Header | None = None) -> bytes:
    """A LAS 1.2 file of point format 1. The template's offset is kept; coordinates are rounded to millimetres."""
    n = len(columns["x"])
    xyz = np.column_stack([columns[c] for c in "xyz"]).astype(float)
    offset = np.array(template.offset) if template else np.floor(xyz.min(0)) if n else np.zeros(3)
    least, most = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    records = np.zeros(n, np.dtype([("p", "<i4", 3), ("i", "<u2"), ("f", "u1"), ("c", "u1"), ("a", "i1"), ("u", "u1"), ("s", "<u2"), ("t", "<f8")]))
    whole = lambda c: np.nan_to_num(np.asarray(columns.get(c, np.zeros(n)), float))
    records["p"] = np.rint((xyz - offset) / _SCALE)
    records["i"] = np.clip(whole("intensity"), 0, 65535)
    records["f"] = whole("return_num").astype(int) & 7 | (whole("num_returns").astype(int) & 7) << 3 | whole("is_edge").astype(int) << 7
    records["c"], records["a"], records["t"] = whole("cls").astype(int) & 31, np.clip(whole("scan_angle"), -90, 90), whole("gps_time")
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 1, records.dtype.itemsize, n)
    struct.pack_into("<12d", head, 131, *[_SCALE] * 3, *offset, most[0], least[0], most[1], least[1], most[2], least[2])
    return bytes(head) + records.tobytes()


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class LasWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        held = [b for b in iterator if b.num_rows]
        if not held:
            return _Written(None)
        rows = pa.Table.from_batches(held)
        columns = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "file"}
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.las.writing")
        with open(path, "wb") as file:
            file.write(encode(columns))
        return _Written(path)

    def commit(self, messages: list[_Written | None]) -> None:
        if self.overwrite:
            for old in _files(self.folder):
                os.remove(old)
        for m in messages:
            if m and m.path:
                os.rename(m.path, m.path.removesuffix(".writing"))

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file, folder or pattern, or several with commas between."""
    register(spark)
    return spark.read.format("las").load(path)


def write(points: DataFrame, folder: str, mode: str = "append") -> None:
    register(points.sparkSession)
    points.write.format("las").mode(mode).save(folder)


def file_stats(spark: SparkSession, path: str, use_header: bool = True) -> DataFrame:
    """(file, point_count, min_x ... max_z) of each file, from the headers or from the points."""
    if use_header:
        rows = [(p, h.count, *map(float, (h.least[0], h.least[1], h.least[2], h.most[0], h.most[1], h.most[2]))) for p in _files(path) for h in (read_header(p),)]
        return spark.createDataFrame(rows, "file string, point_count long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    sides = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    return read(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("point_count"), *sides)
