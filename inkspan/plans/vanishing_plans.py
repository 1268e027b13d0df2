"""Vanishing points of order lines read as segments, sixteen or so to a photo."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators.vanishing import vanishing_points as found
from inkspan.plans.registry import query, table

_SEG = """sg as (select l_orderkey // 4 as photo_id, 800 as w, 600 as h, l_partkey % 800 as x1, l_suppkey * 13 % 600 as y1, case when l_linenumber % 2 = 0 then l_partkey % 800 + 70 + l_partkey % 90 else l_partkey % 800 + cast(floor((l_partkey % 800 - 400) / 12) as bigint) + l_suppkey % 3 end as x2,
 case when l_linenumber % 2 = 0 then l_suppkey * 13 % 600 + l_partkey % 9 - 4 else l_suppkey * 13 % 600 + 60 + l_suppkey % 40 end as y2 from lineitem)"""
_ANG = "(degrees(atan2(y2 - y1, x2 - x1)) + 180) % 180"
_MISFIT = """case when abs(vz) < 1e-9 then acos(least(1, abs(vx * sx + vy * sy) / nz(sqrt(vx * vx + vy * vy) * len))) else acos(least(1, abs((vx / vz - mx) * sx + (vy / vz - my) * sy) / nz(sqrt((vx / vz - mx) * (vx / vz - mx) + (vy / vz - my) * (vy / vz - my)) * len))) end"""


def _misfit(limit):
    import re

    return re.sub(r"nz\((sqrt\(.*?\) \* len)\)", r"(case when \1 = 0 then 1 else \1 end)", _MISFIT) + f" < radians({limit}::double)"


@query("vanishing_points", f"""with {_SEG}, fm as (select photo_id, case when abs({_ANG} - 90) < 32 then 'upright' when {_ANG} < 32 or {_ANG} > 148 then 'level' end as family, x1 - w / 2 as a, y1 - h / 2 as b, x2 - w / 2 as c, y2 - h / 2 as d from sg),
 ln as materialized (select *, row_number() over (partition by photo_id, family order by a, b, c, d) as k, (a + c) / 2 as mx, (b + d) / 2 as my, c - a as sx, d - b as sy, sqrt((c - a) * (c - a) + (d - b) * (d - b)) as len,
  (b - d) / sqrt((b - d) * (b - d) + (c - a) * (c - a)) as l0, (c - a) / sqrt((b - d) * (b - d) + (c - a) * (c - a)) as l1, (a * d - b * c) / sqrt((b - d) * (b - d) + (c - a) * (c - a)) as l2 from fm where family is not null),
 cr as (select p.photo_id, p.family, p.k as i, q.k as j, p.l1 * q.l2 - p.l2 * q.l1 as v0, p.l2 * q.l0 - p.l0 * q.l2 as v1, p.l0 * q.l1 - p.l1 * q.l0 as v2 from ln p join ln q on p.photo_id = q.photo_id and p.family = q.family and p.k < q.k),
 vv as materialized (select photo_id, family, i, j, v0 / n as vx, v1 / n as vy, v2 / n as vz from (select *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) as n from cr) z where n > 0),
 sc as (select v.photo_id, v.family, i, j, vx, vy, vz, round(sum(case when {_misfit(1.5)} then len * len else 0 end), 6) as score from vv v join ln using (photo_id, family) group by all),
 bs as (select * from sc qualify row_number() over (partition by photo_id, family order by score desc, i, j) = 1)
 select b.photo_id, b.family, any_value(score) as score, cast(count(*) filter (ok) as int) as inliers, round(sum(len) filter (ok), 4) as length, round(sum(len) filter (ok) / sum(len), 6) as share from (select bs.*, len, {_misfit(3.0)} as ok from bs join ln using (photo_id, family)) b group by 1, 2 having count(*) filter (ok) >= 2""")
def vanishing_points(spark, sf):
    e = table(spark, sf, "lineitem")
    up = F.col("l_linenumber") % 2 != 0
    x1, y1 = F.col("l_partkey") % 800, F.col("l_suppkey") * 13 % 600
    x2 = F.when(up, x1 + F.floor((x1 - 400) / 12) + F.col("l_suppkey") % 3).otherwise(x1 + 70 + F.col("l_partkey") % 90)
    y2 = F.when(up, y1 + 60 + F.col("l_suppkey") % 40).otherwise(y1 + F.col("l_partkey") % 9 - 4)
    s = e.select(F.floor(F.col("l_orderkey") / 4).alias("photo_id"), F.lit(800).alias("w"), F.lit(600).alias("h"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return found(s).select("photo_id", "family", "score", "inliers", F.round("length", 4).alias("length"), F.round("share", 6).alias("share"))
