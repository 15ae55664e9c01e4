"""Files of fixed binary records: trajectories, their errors, and three-dimensional velocity grids; and text point files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Little-endian doubles of a record, in order.
SBET = ("time_s", "latitude", "longitude", "altitude", "x_velocity", "y_velocity", "z_velocity", "roll", "pitch", "heading", "wander_angle", "x_acceleration", "y_acceleration", "z_acceleration", "x_angular_rate", "y_angular_rate", "z_angular_rate")
SMRMSG = ("time_s", "north_rms", "east_rms", "down_rms", "north_velocity_rms", "east_velocity_rms", "down_velocity_rms", "roll_rms", "pitch_rms", "heading_rms")
BATCH = 65_536


def _doubles(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """One row for each record. Bytes after the last whole record are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                n = len(raw) // (8 * len(names))
                held = np.frombuffer(raw, "<f8", n * len(names)).reshape(n, len(names))
                for begin in range(0, n, BATCH):
                    part = held[begin : begin + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([path_] * len(part)), pa.array(np.arange(begin, begin + len(part)))] + [pa.array(np.ascontiguousarray(part[:, i])) for i in range(len(names))], names=["file", "record", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record long, " + ", ".join(f"{n} double" for n in names))


def read_sbet(spark: SparkSession, path: str) -> DataFrame:
    return _doubles(spark, path, SBET)


def read_smrmsg(spark: SparkSession, path: str) -> DataFrame:
    return _doubles(spark, path, SMRMSG)


def write_doubles(rows: np.ndarray, path: str) -> None:
    """Records (n x fields) as a file; for one trajectory, which is one file."""
    np.ascontiguousarray(rows, "<f8").tofile(path)


def write_sbet(trajectory: DataFrame, source: str, folder: str, tasks: int) -> DataFrame:
    """write_records of SBET records."""
    return write_records(trajectory, source, folder, tasks, SBET)


def write_records(trajectory: DataFrame, source: str, folder: str, tasks: int, names: tuple[str, ...]) -> DataFrame:
    """Writes the records of each source in the order of time into files of a shared folder; gives (file, records).

    The rows are laid out by ranges of source and time, so that a long flight becomes several files, in their order, and
    no task holds a whole one.
    """
    import os
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        sources = rows.column(0).to_numpy()
        values = np.column_stack([rows.column(1 + i).to_numpy() for i in range(len(names))])
        os.makedirs(folder, exist_ok=True)
        for one in np.unique(sources):
            part = values[sources == one]
            path = os.path.join(folder, f"{one}-{part[0, 0]:020.6f}-{uuid.uuid4().hex}.{"sbet" if names == SBET else "smrmsg"}")
            write_doubles(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(part)])], names=["file", "records"])

    held = trajectory.select(F.col(source).cast("long").alias("_source"), *[F.col(c).cast("double") for c in names])
    return held.repartitionByRange(tasks, "_source", "time_s").sortWithinPartitions("_source", "time_s").mapInArrow(run, "file string, records long")


def sbet_to_csv(trajectory: DataFrame, zone: int, folder: str) -> None:
    """The fields with easting and northing of a UTM zone in the place of longitude and latitude, as CSV with a header."""
    from ..operators.surface import to_utm

    x, y = to_utm(F.col("latitude"), F.col("longitude"), zone)
    trajectory.select("time_s", x.alias("x"), y.alias("y"), *SBET[3:]).write.option("header", True).csv(folder)


def decode_gvb(raw: bytes) -> tuple[dict[str, float], np.ndarray]:
    """Header and six bands (6 x rows x cols, north up) of a velocity grid.

    The header is 11 entries of an 8-byte name and a value, an int or a double; then rows x cols x 6 floats, from the
    south-east corner to the west and north.
    """
    kinds = (("NUM_OREC", "<i4"), ("GS_TYPE", "S8"), ("VERSION", "S8"), ("S_LAT", "<f8"), ("N_LAT", "<f8"), ("E_LONG", "<f8"), ("W_LONG", "<f8"), ("LAT_INC", "<f8"), ("LONG_INC", "<f8"), ("ROWS", "<i4"), ("COLS", "<i4"))
    at, header = 0, {}
    for name, kind in kinds:
        value = raw[at + 8 : at + 16]
        header[name] = value.decode().strip() if kind == "S8" else np.frombuffer(value, kind, 1)[0].item()
        at += 16
    rows, cols = header["ROWS"], header["COLS"]
    held = np.frombuffer(raw, "<f4", rows * cols * 6, at).reshape(rows, cols, 6)
    return header, np.ascontiguousarray(held[::-1, ::-1].transpose(2, 0, 1))


def encode_gvb(header: dict, bands: np.ndarray) -> bytes:
    out = b""
    for name, value in header.items():
        held = value.encode().ljust(8)[:8] if isinstance(value, str) else np.array(value, "<f8").tobytes() if isinstance(value, float) else np.array(value, "<i4").tobytes().ljust(8, b"\0")
        out += name.encode().ljust(8) + held
    return out + np.ascontiguousarray(bands.transpose(1, 2, 0)[::-1, ::-1], "<f4").tobytes()


def read_gvb(spark: SparkSession, path: str) -> DataFrame:
    """(file, band, row, col, x, y, value) of the grids' cells; x and y in degrees, from seconds of arc, at the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                header, bands = decode_gvb(content.as_py())
                b, r, c = (g.ravel() for g in np.indices(bands.shape))
                x, y = -header["W_LONG"] / 3600 + c * header["LONG_INC"] / 3600, header["N_LAT"] / 3600 - r * header["LAT_INC"] / 3600
                for begin in range(0, len(b), BATCH):
                    s = slice(begin, begin + BATCH)
                    yield pa.RecordBatch.from_arrays([pa.array([path_] * len(b[s])), pa.array((b[s] + 1).astype(np.int32)), pa.array(r[s].astype(np.int32)), pa.array(c[s].astype(np.int32)), pa.array(x[s]), pa.array(y[s]), pa.array(bands.ravel()[s].astype(float))], names=["file", "band", "row", "col", "x", "y", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, band int, row int, col int, x double, y double, value double")


def read_point_text(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(id, features) of a text file of points, numbers with white space between; id is the line's place in the file's order.

    Of a dump the header and the tree are left out and its ids are kept. Files are read line by line and not split, for
    the order of lines is their id.
    """
    text = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                ids, rows = [], []
                dump = content.lstrip().startswith("#")
                inside = not dump
                for line in content.splitlines():
                    parts = line.split()
                    if dump and parts[:1] == ["points"]:
                        inside = True
                        continue
                    if dump and parts[:1] == ["tree"]:
                        break
                    if inside and len(parts) >= dims + dump and not parts[0].startswith("#"):
                        ids.append(int(parts[0]) if dump else len(ids))
                        rows.append([float(p) for p in parts[dump : dims + dump]])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["id", "features"])

    return text.mapInArrow(run, "id long, features array<double>")


def dump_points(points: DataFrame, folder: str) -> None:
    """Points (id, features) as text lines of id and numbers."""
    points.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.transform("features", lambda v: v.cast("string")), " ")).alias("value")).write.text(folder)


def read_csv(spark: SparkSession, path: str, header: bool = True, typed: bool = True) -> DataFrame:
    """Columns typed by their values (whole numbers, numbers, text) or, not typed, all text; '#' begins a comment line."""
    return spark.read.options(header=header, inferSchema=typed, comment="#", mode="PERMISSIVE", escape="\\").csv(path)
