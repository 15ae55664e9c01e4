import datetime

import pytest
from pyspark.sql import functions as F

from geostrata.streaming import finalise


def source(spark, tmp_path, files):
    schema = "ts timestamp, cell int, value double"
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    for i, rows in enumerate(files):
        spark.createDataFrame([(start + datetime.timedelta(minutes=m), c, float(v)) for m, c, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_final_windows(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, 1, 2), (5, 1, 4), (70, 2, 1)], [(200, 1, 1)], [(2, 1, 9), (300, 1, 1)]])
    got = finalise.run_to_table(spark, finalise.cell_counts(stream, "ts", "1 hour", "10 minutes", ["cell"], "value"))
    rows = {(r["window_start"].hour, r["cell"]): (r["n"], r["total"]) for r in got.collect()}
    assert rows[(0, 1)] == (2, 6.0) and rows[(1, 2)] == (1, 1.0)  # the row that came two hours late is not in


def test_sessions_and_sliding_windows(spark, tmp_path):
    stream = source(spark, tmp_path, [[(0, 1, 1), (3, 1, 1), (30, 1, 1)], [(500, 2, 1)]])
    got = finalise.run_to_table(spark, finalise.id_sessions(stream, "ts", "5 minutes", "1 minute", ["cell"]))
    assert sorted(r["n"] for r in got.where("cell = 1").collect()) == [1, 2]
    slid = finalise.run_to_table(spark, finalise.sliding_counts(stream, "ts", "10 minutes", "5 minutes", "1 minute", ["cell"]))
    assert slid.where("cell = 1").agg(F.sum("n")).first()[0] == 6


def test_cells_are_finalised_from_state(spark, tmp_path):
    stream = source(spark, tmp_path, [[(0, 1, 2), (1, 1, 4), (2, 2, 5)], [(100, 3, 1)], [(200, 3, 1)]])
    got = finalise.run_to_table(spark, finalise.finalise_cells(stream, "ts", "1 minute", "cell", "value", 60_000))
    assert {(r["cell"], r["n"], r["mean"]) for r in got.where("cell < 3").collect()} == {("1", 2, 3.0), ("2", 1, 5.0)}


def test_a_stream_that_is_cut_short_is_an_error(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data)
    found = finalise.cell_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "10 minutes", ["event_type"], "value")
    with pytest.raises(TimeoutError):
        finalise.run_to_table(spark, found, 0.01)
    assert not spark.streams.active
    assert finalise.run_to_table(spark, found).count() > 0
