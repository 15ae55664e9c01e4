"""Queries that must reach the mosaic and all tiles, at the larger scale."""

import os

import duckdb
import pytest

from geostrata.plans import catalog
from test_queries import QUERIES, base, rows  # noqa: F401


@pytest.fixture(scope="module")
def larger():
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    return folder, con


def same(ours, theirs):
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    return all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 0.0011) for x, y in zip(a, b, strict=True) for u, v in zip(x, y, strict=True))


@pytest.mark.parametrize("name", ["region_components", "region_bbox", "void_fill_idw"])
def test_voids_of_the_mosaic_too(spark, larger, name):
    folder, con = larger
    ours = QUERIES[name](spark, folder).toPandas()
    assert (ours["band"] == 1).any()
    assert same(ours, con.execute(catalog.oracle_sql()[name]).df())


def test_path_of_the_mosaic_too(spark, data, base):  # noqa: F811
    files = {r[0] for r in base.execute("select distinct file_id from pc_memgrid where x is not null and not isnan(x)").fetchall()}
    found = {r["band"] for r in QUERIES["astar_cost"](spark, data).select("band").collect()}
    assert 1 in found and found <= files


def test_tiff_of_the_whole_mosaic(spark, larger):
    folder, con = larger
    ours = QUERIES["source_tiff"](spark, folder).toPandas()
    assert ((ours["row"] >= 256) | (ours["col"] >= 1024)).any()
    assert same(ours, con.execute(catalog.oracle_sql()["source_tiff"]).df())


def test_tiles_of_all_files(spark, larger):
    folder, con = larger
    ours = {(r["tile_id"], r["file_id"]) for r in QUERIES["tile_files"](spark, folder).collect()}
    files = con.execute("select distinct file_id, min_x, min_y, max_x, max_y from pc_file where min_x is not null and not isnan(min_x)").fetchall()
    tiles = {(c, r) for _, a, b, x, y in files for c in range(int(a // 500), int(x // 500) + 1) for r in range(int(b // 500), int(y // 500) + 1)}
    want = {(c + (r - 11998) * 2**32, f) for c, r in tiles for f, a, b, x, y in files if a < c * 500 + 520 and x > c * 500 - 20 and b < r * 500 + 520 and y > r * 500 - 20}
    assert ours == want
    assert {f for _, f in ours} == {f[0] for f in files}
    assert ours == set(con.execute(catalog.oracle_sql()["tile_files"]).fetchall())
