"""Queries of the operators in this package, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, clusters, digests, multiindex, packing, reading

LINK2 = 1.12
LEAST_CLUSTER = 12
TOLERANCE = 0.03
PCTS = [5, 25, 50, 75, 95]
NEIGHBOURS = 8
TOKENIZER = "byte_bpe_50k"
DEMANDING_WORDS, DEMANDING_GRADE = 40, 16
_FIELDS = ["z", "idx"]


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster(table(spark, folder, "pc_memgrid"), "point_id", ["x", "y", "z"], LINK2, LEAST_CLUSTER)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).select("cluster_id", F.col("id").alias("point_id"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster with its size and its five most typical points."""
    return clusters.describe(_clusters(spark, folder))


def _readings(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return digests.once(table(spark, folder, "pc_memgrid"), "point_id", "file_id", *_FIELDS, *more)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Declared percentiles that are off. What the bounds of the digests don't clear for certain the counting pass decides."""
    rows = _readings(spark, folder)
    merged = digests.merge_digests(digests.partial_digests(rows, "file_id", _FIELDS), ["group_id", "field"])
    stats = table(spark, folder, "pc_file_stat").select(F.col("file_id").cast("long").alias("group_id"), "field", "pct", F.col("declared").alias("value")).where("value is not null and not isnan(value)")
    ranks = digests.ranks(merged, stats.select("group_id", "field", "value").distinct())
    share = F.col("pct") / 100
    suspected = stats.join(ranks, ["group_id", "field", "value"]).where((F.col("high") > share + TOLERANCE) | (F.col("low") < share - TOLERANCE)).select("group_id", "field", "pct", "value")
    counts = digests.count_at(rows, "file_id", _FIELDS, suspected.select("group_id", "field", "value").distinct(), "_key")
    wrong = (F.col("below") / F.col("count") > share + TOLERANCE) | (F.col("at_or_below") / F.col("count") < share - TOLERANCE)
    return suspected.join(counts, ["group_id", "field", "value"]).where(F.col("count") > 0).where(wrong).select(F.col("group_id").cast("int").alias("file_id"), "field", F.col("pct").cast("int").alias("pct"))


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each file from digests of its days, with the rank error that the counting pass certifies."""
    rows = _readings(spark, folder, F.to_date("ingest_ts").alias("day"))
    daily = digests.merge_digests(digests.partial_digests(rows, "file_id", _FIELDS, "day"), ["group_id", "part", "field"])
    found = digests.percentiles(digests.merge_digests(daily, ["group_id", "field"]), PCTS)
    counts = digests.count_at(rows, "file_id", _FIELDS, found.select("group_id", "field", "value").distinct(), "_key").withColumnRenamed("count", "counted")
    share = F.col("pct") / 100
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("counted") - share, share - F.col("at_or_below") / F.col("counted"))
    return found.join(counts, ["group_id", "field", "value"]).select(F.col("group_id").alias("file_id"), "field", "pct", "value", "count", error.alias("rank_error"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = multiindex.nearest(table(spark, folder, "pc_probe"), "probe_id", table(spark, folder, "pc_memgrid"), "point_id", ["x", "y", "z"], NEIGHBOURS)
    return found.select(F.col("query_id").alias("probe_id"), F.col("id").alias("point_id"))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other points of each point whose id is divisible by 100, among all points."""
    points = table(spark, folder, "pc_memgrid")
    return multiindex.nearest(points.where("point_id % 100 = 0"), "point_id", points, "point_id", ["x", "y", "z"], NEIGHBOURS, skip_self=True).select("query_id", "id", F.col("rank").cast("int").alias("rank"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), "doc_id", "text", TOKENIZER)


def p6_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The number of ids of every post by each kind of tokenizer: bytes, words and pieces."""
    posts = table(spark, folder, "documents").select("doc_id", "text")
    counts = [bpe.count_tokens(posts, "doc_id", "text", name).withColumn("tokenizer", F.lit(name)) for name in ("byte_bpe_50k", "word_bpe_49k", "piece_bpe_32k")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether decoding each post's ids gives its text again."""
    posts = table(spark, folder, "documents").select("doc_id", "text")
    again = bpe.decode(bpe.encode(posts, "doc_id", "text", TOKENIZER), "doc_id", "ids", TOKENIZER)
    return posts.join(again.withColumnRenamed("text", "again"), "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("again")).alias("same"))


def p7_bins(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "pack_spec"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of room used, of each spec."""
    specs = table(spark, folder, "pack_spec").select("spec_id", "capacity")
    filled = p7_bins(spark, folder).groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens")).groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return filled.join(specs, "spec_id").select("spec_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The school grade of every post's own prose."""
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_label"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_levels(spark, folder).where((F.col("words") >= DEMANDING_WORDS) & (F.col("grade") >= DEMANDING_GRADE)).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_percentiles, p5_found, p5_neighbours, p6_ids, p6_lengths, p6_roundtrip, p7_bins, p7_fill, p8_found, p8_levels)}


_PLACES = """pts as (select distinct point_id, x, y, z from pc_memgrid where x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z))"""
#: Cells as wide as the link's limit, so that linked points are in neighbouring ones.
_LINKS = f"""with recursive {_PLACES}, c as (select *, floor(x / 1.06) as a, floor(y / 1.06) as b from pts),
links as (select p.point_id as u, q.point_id as v from (select *, a + i as na, b + j as nb from c, unnest([-1, 0, 1]) i(i), unnest([-1, 0, 1]) j(j)) p join c q on q.a = p.na and q.b = p.nb where p.point_id <> q.point_id
  and power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2) <= {LINK2}),
reach(u, v) as (select u, u from links union select r.u, l.v from reach r join links l on r.v = l.u),
named as (select u as point_id, min(v) as cluster_id, count(*) as n from reach group by u)
select cluster_id, point_id from named where n >= {LEAST_CLUSTER}"""
_SHARES = """with once as (select distinct point_id, file_id, z, idx from pc_memgrid), v as (select file_id, 'z' as field, z as v from once where z is not null and not isnan(z) union all select file_id, 'idx', idx::double from once where idx is not null),
s as (select t.file_id, t.field, t.pct, count(*) filter (where v < declared) / count(*)::double as l, count(*) filter (where v <= declared) / count(*)::double as h
  from pc_file_stat t join v on t.file_id = v.file_id and t.field = v.field where declared is not null and not isnan(declared) group by 1, 2, 3, declared)"""
_NEAR = "power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _LINKS,
        "p2_found": f"{_SHARES} select file_id, field, pct from s where l > pct / 100.0 + {TOLERANCE} or h < pct / 100.0 - {TOLERANCE}",
        "p5_found": f"with {_PLACES}, d as (select probe_id, point_id, row_number() over (partition by probe_id order by {_NEAR}, point_id) as k from pc_probe p, pts q where p.x is not null and p.y is not null and p.z is not null) select probe_id, point_id from d where k <= {NEIGHBOURS}",
        "p5_neighbours": f"with {_PLACES}, d as (select p.point_id as query_id, q.point_id as id, row_number() over (partition by p.point_id order by {_NEAR}, q.point_id) as k from pts p, pts q where p.point_id % 100 = 0 and p.point_id <> q.point_id) select query_id, id, cast(k as integer) as rank from d where k <= {NEIGHBOURS}",
    }
