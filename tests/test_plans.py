"""What Spark will do: joins by equality, narrow scans, filters at the scan."""

import re

import pytest

from geostrata.plans import catalog

NAMES = ["grid_basic_stats", "radius_join", "grid_idw", "grid_lmoments", "point_height_normalize", "bilinear_sample", "ground_assign", "raster_overlay", "raster_shift_copy", "asof_backward", "box_search", "tile_files", "focal_gaussian", "runs", "polygon_sessions", "retile", "weighted_cells", "filter_combo", "kmeans_step", "knn_points", "p4_found"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairs_of_everything(spark, data, name):
    text = plan(catalog.queries()[name](spark, data))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_scans_are_narrow(spark, data):
    text = plan(catalog.queries()["filter_class"](spark, data))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "gps_time" not in schema and "intensity" not in schema and "cls" in schema
    assert "PushedFilters" in text and "GreaterThanOrEqual(z,-500.0)" in text


def test_statistics_take_one_exchange_after_the_points_are_once(spark, data):
    text = plan(catalog.queries()["agg_filtered"](spark, data))
    assert text.count("Exchange hashpartitioning") == 2 and "partial_count" in text


def test_thinning_is_limited_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(catalog.queries()["thin_cells"](spark, data))
