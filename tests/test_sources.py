import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.functions import scalar
from geostrata.functions.wkt import parse_polygons
from geostrata.model import GridSpec
from geostrata.sources import info, las, rasters, records, vectors


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(float(x), float(y), float(z), float(i), 3.0, 2, 1, 2, bool(i % 2), float(i)) for i, (x, y, z) in enumerate(np.round(rng.random((300, 3)) * 1000, 3))]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity double, scan_angle double, cls int, return_num int, num_returns int, is_edge boolean, gps_time double").withColumn("file", F.lit("")).repartition(2)
    folder = str(tmp_path / "las")
    las.write(df, folder)
    las.register(spark)
    got = spark.read.format("las").option("chunkrecords", 40).load(folder)
    names = df.columns[:-1]
    assert got.select(F.input_file_name()).count() == 300
    key = lambda d: sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in d.select(*names).collect())
    assert key(got) == key(df)
    a, b = ({tuple(round(v, 3) if isinstance(v, float) else v for v in r[1:]) for r in las.file_stats(spark, folder, h).select("file", "point_count", "min_x", "max_z").collect()} for h in (True, False))
    assert a == b and sum(r[0] for r in a) == 300
    las.write(df.limit(0), folder, "overwrite")
    assert las.read(spark, folder).count() == 0


def test_trajectories(spark, tmp_path):
    rows = np.arange(34, dtype=float).reshape(2, 17)
    path = str(tmp_path / "a.sbet")
    records.write_doubles(rows, path)
    with open(path, "ab") as file:
        file.write(b"rest")
    got = records.read_sbet(spark, path).orderBy("record").collect()
    assert len(got) == 2 and got[1]["roll"] == 24.0
    records.sbet_to_csv(records.read_sbet(spark, path).withColumns({"latitude": F.lit(0.85), "longitude": F.lit(-0.3)}), 28, str(tmp_path / "csv"))
    assert len(records.read_csv(spark, str(tmp_path / "csv")).columns) == 17
    records.write_doubles(np.ones((3, 10)), str(tmp_path / "b.out"))
    assert records.read_smrmsg(spark, str(tmp_path / "b.out")).count() == 3


def test_velocity_grid(spark, tmp_path):
    header = {"NUM_OREC": 11, "GS_TYPE": "SECONDS", "VERSION": "V1", "S_LAT": 0.0, "N_LAT": 7200.0, "E_LONG": 0.0, "W_LONG": 3600.0, "LAT_INC": 3600.0, "LONG_INC": 3600.0, "ROWS": 3, "COLS": 2}
    bands = np.arange(36, dtype=float).reshape(6, 3, 2)
    (tmp_path / "g.gvb").write_bytes(records.encode_gvb(header, bands))
    got = records.read_gvb(spark, str(tmp_path / "g.gvb"))
    assert got.count() == 36 and tuple(got.where("band = 6 and row = 2 and col = 0").select("x", "y", "value").first()) == (-1.0, 0.0, 34.0)


def test_point_text(spark, tmp_path):
    (tmp_path / "p.pts").write_text("1.5 2\n  3 4\n")
    assert [tuple(r) for r in records.read_point_text(spark, str(tmp_path / "p.pts"), 2).collect()] == [(0, [1.5, 2.0]), (1, [3.0, 4.0])]
    (tmp_path / "d.dmp").write_text("#ANN 1\npoints 2 2\n7 1 2\n8 3 4\ntree 2 2 1\nleaf 1 0\n")
    got = records.read_point_text(spark, str(tmp_path / "d.dmp"), 2)
    assert [tuple(r) for r in got.collect()] == [(7, [1.0, 2.0]), (8, [3.0, 4.0])]
    records.dump_points(got, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("kind", ["Float64", "Float32", "Int16", "Byte"])
@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip(kind, compress):
    spec = GridSpec(100.0, 200.0, 2.0, -2.0, 5, 4, 2, 255.0 if kind == "Byte" else -9999.0, kind)
    bands = np.arange(40, dtype=float).reshape(2, 4, 5)
    bands[1, 2, 3] = np.nan
    got, out = rasters.decode_tiff(rasters.encode_tiff(spec, bands, compress))
    assert np.array_equal(out, bands, equal_nan=True) and (got.tlx, got.tly, got.res_x, got.res_y, got.cols, got.rows, got.bands, got.kind) == (100.0, 200.0, 2.0, -2.0, 5, 4, 2, kind)


@pytest.mark.parametrize("interleave", ["BIL", "BSQ", "BIP"])
def test_envi_round_trip(interleave):
    spec = GridSpec(1.0, 2.0, 3.0, -3.0, 4, 3, 2, interleave=interleave)
    bands = np.arange(24, dtype=float).reshape(2, 3, 4)
    got, out = rasters.decode_envi(*rasters.encode_envi(spec, bands))
    assert (out == bands).all() and got.tly == 2.0 and got.interleave == interleave


def test_raster_files(spark, tmp_path):
    spec = GridSpec(0.0, 10.0, 1.0, -1.0, 10, 10)
    cells = spark.range(100).select(F.lit(1).alias("band"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("value")).where("id <> 5")
    assert rasters.write_tiff_tiles(cells, spec, str(tmp_path / "t"), 4).agg(F.sum("cells")).first()[0] == 99
    got = rasters.read_tiff(spark, str(tmp_path / "t"))
    assert {(r["x"], r["y"], r["value"]) for r in got.collect()} == {(r["col"] + 0.5, 9.5 - r["row"], r["value"]) for r in cells.collect()}
    rasters.write_store(cells, spec, str(tmp_path / "s"))
    back, held = rasters.read_store(spark, str(tmp_path / "s"), 1)
    assert back == spec and held.count() == 99
    assert rasters.driver_for("a/b.TIF") == "GTiff" and rasters.driver_for("x") is None and rasters.drivers(spark, "shape").count() == 1


def test_vectors(spark, tmp_path):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1)), ((9 9, 10 9, 10 10, 9 9)))"
    df = vectors.with_constants(spark.createDataFrame([(1, wkt), (2, None)], "id long, wkt string"), source="x", n=3)
    written = vectors.write_shp(df.coalesce(1), str(tmp_path / "shp")).collect()
    got = vectors.read_shp(spark, written[0]["file"]).orderBy("record").collect()
    assert [len(p) for p in parse_polygons(got[0]["wkt"])] == [2, 1] and got[1]["wkt"] is None
    assert vectors.write_sqlite(df, str(tmp_path / "v.sqlite")) == 2
    assert vectors.read_sqlite(spark, str(tmp_path / "v.sqlite"), schema="id long, wkt string, source string, n int").count() == 2
    vectors.write_layer(df, str(tmp_path / "l"), order=["id"])
    assert vectors.read_layer(spark, str(tmp_path / "l")).count() == 2
    assert vectors.layer_fields(df) == {"id": "Int", "wkt": "String", "source": "String", "n": "Int"}
    assert "zone 10N" in vectors.projection_from_srid(32610)
    with pytest.raises(ValueError):
        vectors.projection_from_srid(1)
    assert json.loads(info.layer_info(df).first()[0])["count"] == 2


def test_strings(spark):
    df = spark.createDataFrame([("a/b/c.d.txt", "1,2,3,4"), ("plain", "1,2,3,4,5,6"), (None, "1,2")], "p string, b string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(scalar.basename(p), scalar.extension(p), scalar.parent(p), scalar.sanitize(p)).collect()]
    assert got == [("c.d", "txt", "a/b", "a_b_c_d_txt"), ("plain", "plain", "", "plain"), (None, None, "" if got[2][2] == "" else None, None)]
    boxes = [r[0] for r in df.select(scalar.parse_bounds(F.col("b"))).collect()]
    assert tuple(boxes[0])[:4] == (1.0, 2.0, 3.0, 4.0) and tuple(boxes[1]) == (1.0, 2.0, 4.0, 5.0, 3.0, 6.0) and boxes[2] is None
    one = spark.range(1).select(scalar.clock(F.lit(3725.9)), scalar.combinations(F.lit(5.0), 2), scalar.is_int(F.lit("-3 ")), scalar.is_double(F.lit("1e5")), scalar.minkowski(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)), 2), scalar.join_path(F.lit("a/"), F.lit("/b"))).first()
    assert tuple(one) == ("01:02:05", 10.0, True, True, 5.0, "a/b")
