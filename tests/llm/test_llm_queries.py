"""Queries against their SQL or the statement of their problem, over the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from geostrata.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("pc_memgrid", "pc_probe", "pc_file_stat"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert key(ours) == key(theirs) and len(ours)


def test_percentiles_are_certified(spark, data):
    got = QUERIES["p2_percentiles"](spark, data).toPandas()
    z = got[got.field == "z"]
    assert z.rank_error.max() < 0.03 and (got["count"] > 0).all()


def test_clusters_are_described(spark, data):
    got = QUERIES["p1_clusters"](spark, data).toPandas()
    found = QUERIES["p1_found"](spark, data).toPandas()
    assert got.set_index("cluster_id")["size"].to_dict() == found.groupby("cluster_id").size().to_dict()
    members = set(map(tuple, found.to_numpy().tolist()))
    assert all((c, i) in members for c, some in zip(got.cluster_id, got.typical, strict=True) for i in some)


def test_texts_come_back(spark, data):
    assert QUERIES["p6_roundtrip"](spark, data).where("not same").count() == 0


def test_containers(spark, data):
    got = QUERIES["p7_bins"](spark, data).toPandas()
    specs = pd.read_parquet(f"{data}/pack_spec.parquet").set_index("spec_id").capacity
    docs = pd.read_parquet(f"{data}/documents.parquet")
    room = got.groupby(["spec_id", "container"]).tokens.sum().reset_index()
    assert (room.tokens <= room.spec_id.map(specs)).all()
    assert all(set(g.doc_id) == set(docs.doc_id) for _, g in got.groupby("spec_id"))
    assert (QUERIES["p7_fill"](spark, data).toPandas().used > 0.8).all()


def test_levels_agree_with_held_out_labels(spark, data):
    from geostrata.llm import reading

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/reading_label.parquet")
    held = reading.reading_levels(docs, labels.where("doc_id % 3 <> 0")).toPandas().set_index("doc_id").grade
    truth = labels.where("doc_id % 3 = 0 and grade is not null").toPandas().groupby("doc_id").grade.mean()
    if len(truth) >= 5:
        assert np.corrcoef(held[truth.index], truth)[0, 1] > 0.8
