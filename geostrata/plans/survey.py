"""Queries over the survey tables that need no language-model operator."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.near import expand, near
from ..operators.spikes import LIMIT, SPIKE_RUN, STUCK_RUN, judge
from ..session import table

NEAR_RADIUS2 = 0.12


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "pc_memgrid").select("point_id", "x", "y")
    pairs, members = near(points, "point_id", "x", "y", NEAR_RADIUS2, table(spark, folder, "survey_zone").select("zone_id", "wkt"))
    return expand(pairs, members)


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of p4_found between representatives, and (member, representative, point) of each other point at a hot place: no copies are expanded."""
    points = table(spark, folder, "pc_memgrid").select("point_id", "x", "y")
    pairs, members = near(points, "point_id", "x", "y", NEAR_RADIUS2, table(spark, folder, "survey_zone").select("zone_id", "wkt"))
    if members is None:
        return pairs
    return pairs.unionByName(members.where("id <> _rep").select(F.lit("member").alias("kind"), F.col("_rep").alias("id_a"), F.col("id").alias("id_b")))


#: The least and the largest value that each sensor can mean.
Z_LIMITS = {"z": (-500.0, 9000.0)}
FLIGHT_LIMITS = {"altitude": (-500.0, 12000.0), "roll": (-math.pi / 2, math.pi / 2), "pitch": (-math.pi / 2, math.pi / 2)}


def p3_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Each implausible reading with the reasons."""
    points = table(spark, folder, "pc_memgrid").select("point_id", "file_id", "gps_time", "z")
    flights = table(spark, folder, "pc_trajectory").select("rec_id", "flight_id", "time_s", *FLIGHT_LIMITS)
    return judge(points, "point_id", "file_id", "gps_time", Z_LIMITS).unionByName(judge(flights, "rec_id", "flight_id", "time_s", FLIGHT_LIMITS))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_readings(spark, folder).select("field", "reading_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_readings, p4_found, p4_classes)}


_NEAR_SQL = f"""with pts as (select distinct point_id, x, y from pc_memgrid where x is not null and y is not null and not isnan(x) and not isnan(y)),
c as (select *, floor(x / 0.35) as a, floor(y / 0.35) as b from pts),
rings as (select zone_id, unnest(regexp_extract_all(wkt, '\\(\\s*([^()]+)\\)', 1)) as ring, unnest(range(len(regexp_extract_all(wkt, '\\(\\s*([^()]+)\\)', 1)))) as k from survey_zone where wkt is not null),
corners as (select zone_id, k, list_transform(string_split(ring, ','), lambda p: list_transform(string_split_regex(trim(p), '\\s+')[1:2], lambda v: cast(v as double))) as c from rings),
edges as (select zone_id, unnest(c[1:-2]) as p, unnest(c[2:]) as q from corners),
box as (select zone_id, min(least(p[1], q[1])) as x0, max(greatest(p[1], q[1])) as x1, min(least(p[2], q[2])) as y0, max(greatest(p[2], q[2])) as y1 from edges group by 1),
crossed as (select e.zone_id, t.point_id from pts t join box on x between x0 and x1 and y between y0 and y1 join edges e on e.zone_id = box.zone_id
  where (p[2] > y) <> (q[2] > y) and x < (q[1] - p[1]) * (y - p[2]) / (q[2] - p[2]) + p[1])
select 'point' as kind, p.point_id as id_a, q.point_id as id_b from (select *, a + i as na, b + j as nb from c, unnest([-1, 0, 1]) i(i), unnest([-1, 0, 1]) j(j)) p join c q on q.a = p.na and q.b = p.nb where p.point_id < q.point_id and power(p.x - q.x, 2) + power(p.y - q.y, 2) <= {NEAR_RADIUS2}
union all select 'zone' as kind, zone_id, point_id from crossed group by zone_id, point_id having count(*) % 2 = 1"""


_CASES = f"""select field, id as reading_id from s where impossible or stuck
union select h.field, h.id from h join normal on h.field = normal.field and h.src = normal.src where height > {LIMIT} * normal"""
_REASONS = f"""select s.field, s.src::bigint as source, s.id as reading_id, s.impossible, s.stuck, case when height > {LIMIT} * normal then height else 0.0 end as spike, coalesce(normal, 0.0) as normal
  from s left join h on s.field = h.field and s.src = h.src and s.id = h.id left join normal on s.field = normal.field and s.src = normal.src where s.impossible or s.stuck or height > {LIMIT} * normal"""


def _spike_sql(detail: bool = False) -> str:
    """The definition in SQL: heights of all short runs by lags and leads, and the normal change as the least one, from the median of the changes on, that bears itself."""
    heights = []
    for length in range(1, SPIKE_RUN + 1):
        for place in range(1, length + 1):
            before, after = f"lag(v, {place}) over w", f"lead(v, {length - place + 1}) over w"
            each = []
            for k in range(1, length + 1):
                held = "v" if k == place else f"lag(v, {place - k}) over w" if k < place else f"lead(v, {k - place}) over w"
                each.append(f"case when ({held} > {before}) = ({held} > {after}) then least(abs({held} - {before}), abs({held} - {after})) else 0 end")
            low = each[0] if length == 1 else f"least({', '.join(each)})"
            heights.append(f"case when {before} is not null and {after} is not null then {low} else 0 end")
    fields = [("z", "pc_memgrid", "point_id", "file_id", "gps_time", *Z_LIMITS["z"])] + [(f, "pc_trajectory", "rec_id", "flight_id", "time_s", *limits) for f, limits in FLIGHT_LIMITS.items()]
    readings = " union all ".join(f"select distinct '{f}' as field, {key} as id, {source} as src, {at} as t, {f} as v, {f} < {low!r} or {f} > {high!r} as impossible from {name} where {f} is not null and not isnan({f})" for f, name, key, source, at, low, high in fields)
    return f"""with r as ({readings}),
n as (select *, row_number() over o as k, case when lag(v) over o = v then 0 else 1 end as begins from r window o as (partition by field, src order by t, id)),
u as (select *, sum(begins) over (partition by field, src order by k) as run from n),
s as (select *, count(*) over (partition by field, src, run) >= {STUCK_RUN} as stuck from u),
h as (select *, greatest({", ".join(heights)}) as height, lag(v) over w as pv, lag(k) over w as pk, lag(stuck) over w as ps from s where not impossible window w as (partition by field, src order by k)),
c as (select field, src, abs(v - pv) as change, greatest(height, lag(height) over (partition by field, src order by k)) as over_ from h qualify pk = k - 1 and not stuck and not ps),
g as (select field, src, over_, max(change) over (partition by field, src order by over_ range between unbounded preceding and current row) as most from c),
q as (select field, src, coalesce(quantile_disc(change, 0.5) filter (change > 0), 0) as start from c group by 1, 2),
m as (select c.field, c.src, c.change from c join q on c.field = q.field and c.src = q.src and c.change >= q.start),
b as (select m.field, m.src, m.change, g.most from (select distinct *, {LIMIT} * change as reach from m) m asof join (select distinct * from g) g on m.field = g.field and m.src = g.src and m.reach >= g.over_),
normal as (select field, src, min(change) as normal from b where most <= change group by 1, 2)
{_REASONS if detail else _CASES}"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _spike_sql(), "p3_readings": _spike_sql(True), "p4_found": _NEAR_SQL, "p4_classes": _NEAR_SQL}
