"""Mask queries over embedding grids read as 8x8 masks (ink where the value is positive)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import masks as mk
from inkspan.operators import outlines as ol
from inkspan.plans.inputs import ctes
from inkspan.plans.outline_plans import _F4, traced
from inkspan.plans.pixel_plans import _GP, grid_pixels
from inkspan.plans.registry import query

_INK = f"{_GP}, ink as materialized (select photo_id, x, y from gp where raw > 0), bgd as materialized (select photo_id, x, y from gp where not raw > 0)"


def ink(spark, sf, least=0.0):
    return grid_pixels(spark, sf).where(F.col("raw") > least).select("photo_id", "w", "h", "x", "y")


def _comp(src, name):
    return f"""{name}_r as (select photo_id, x, y, y * 8 + x as c from {src} union select n.photo_id, n.x, n.y, r.c from {name}_r r join {src} n on n.photo_id = r.photo_id and abs(n.x - r.x) + abs(n.y - r.y) = 1 and r.c < n.y * 8 + n.x),
 {name} as materialized (select photo_id, x, y, min(c) as comp from {name}_r group by 1, 2, 3)"""


_DIST = """dst as materialized (select i.photo_id, i.x, i.y, least(min(greatest(abs(b.x - i.x), abs(b.y - i.y)) + least(abs(b.x - i.x), abs(b.y - i.y)) * (sqrt(2.0::double) - 1)), i.x + 1, 8 - i.x, i.y + 1, 8 - i.y) as d
 from ink i left join bgd b on b.photo_id = i.photo_id group by 1, 2, 3)"""


@query("components", f"with recursive {_INK}, {_comp('ink', 'cc')} select photo_id, x, y, comp from cc")
def components(spark, sf):
    return mk.components(ink(spark, sf)).select("photo_id", "x", "y", "comp")


@query("despeckle", f"with recursive {_INK}, {_comp('ink', 'cc')}, sz as (select photo_id, comp, count(*) as n from cc group by 1, 2), mx as (select photo_id, greatest(3, .2 * max(n)) as cut from sz group by 1) select photo_id, x, y from cc join sz using (photo_id, comp) join mx using (photo_id) where n >= cut")
def despeckle(spark, sf):
    return mk.despeckle(ink(spark, sf), 0.2, 3).select("photo_id", "x", "y")


_HOLE = f"{_comp('bgd', 'hc')}, hs as (select photo_id, comp, count(*) as n from hc group by 1, 2 having not bool_or(x = 0 or y = 0 or x = 7 or y = 7))"


@query("count_holes", f"with recursive {_INK}, {_HOLE} select photo_id, (select count(*) from hs where hs.photo_id = i.photo_id and n > 1) as holes from (select distinct photo_id from ink) i")
def count_holes(spark, sf):
    return mk.count_holes(ink(spark, sf), 1)


@query("fill_holes", f"with recursive {_INK}, {_HOLE}, tot as (select photo_id, count(*) as k from ink group by 1) select photo_id, x, y from ink union all select h.photo_id, h.x, h.y from hc h join hs using (photo_id, comp) join tot using (photo_id) where n <= .05 * (k + n)")
def fill_holes(spark, sf):
    return mk.fill_holes(ink(spark, sf), 0.05).select("photo_id", "x", "y")


@query("hysteresis", f"with recursive {_GP}, wk as materialized (select photo_id, x, y, raw from gp where raw > 0.02), {_comp('wk', 'cc')} select photo_id, x, y from cc c where exists (select 1 from cc o join wk using (photo_id, x, y) where wk.raw > 0.2 and o.photo_id = c.photo_id and o.comp = c.comp)")
def hysteresis(spark, sf):
    return mk.hysteresis(ink(spark, sf, 0.2), ink(spark, sf, 0.02)).select("photo_id", "x", "y")


@query("distance_within", f"with {_INK}, {_DIST} select photo_id, x, y, round(d, 6) as d from dst")
def distance_within(spark, sf):
    return mk.distance(ink(spark, sf)).select("photo_id", "x", "y", F.round("d", 6).alias("d"))


@query("component_stats", f"""with recursive {_INK}, {_comp('ink', 'cc')}, {_DIST}, s as (select photo_id, comp, count(*) as area, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, avg(d) * 4 as stroke,
 max((x = 0)::int) + max((y = 0)::int) + max((x = 7)::int) + max((y = 7)::int) as touch from cc join dst using (photo_id, x, y) group by 1, 2)
 select photo_id, comp, area, x0, y0, x1, y1, round(stroke, 5) as stroke, touch, round(area / ((x1 - x0 + 1) * (y1 - y0 + 1)), 5) as fill, round(area / stroke / stroke, 4) as elong, greatest(x1 - x0 + 1, y1 - y0 + 1) / 8 as size from s""")
def component_stats(spark, sf):
    s = mk.component_stats(ink(spark, sf))
    return s.select("photo_id", "comp", "area", "x0", "y0", "x1", "y1", F.round("stroke", 5).alias("stroke"), "touch", F.round("fill", 5).alias("fill"), F.round("elong", 4).alias("elong"), "size")


@query("component_density", f"""with recursive {_GP}, ink as materialized (select photo_id, x, y from gp where raw > -.05::double), {_comp('ink', 'cc')} select photo_id, comp, count(*) as area, round(count(*) filter (raw > .05::double) / count(*), 6) as density from cc join gp using (photo_id, x, y) group by 1, 2""")
def component_density(spark, sf):
    return mk.component_stats(ink(spark, sf, -0.05), ink(spark, sf, 0.05)).select("photo_id", "comp", "area", F.round("density", 6).alias("density"))


@query("mask_measures", f"""with {_INK}, b as (select i.photo_id, count(*) as perimeter from ink i where (select count(*) from ink n where n.photo_id = i.photo_id and abs(n.x - i.x) + abs(n.y - i.y) = 1) < 4 group by 1)
 select photo_id, count(*) as area, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, max(perimeter) as perimeter, round(2 * count(*) / max(perimeter), 6) as stroke_width from ink join b using (photo_id) group by 1""")
def mask_measures(spark, sf):
    return mk.mask_measures(ink(spark, sf)).withColumn("stroke_width", F.round("stroke_width", 6))


@query("thin_radius", f"""with {_INK}, {_DIST}, rd as (select a.photo_id, a.x, a.y, max(a.d) as d from dst a left join dst b on b.photo_id = a.photo_id and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 where a.d >= 1.5 group by 1, 2, 3 having max(a.d) >= max(b.d)),
 l as (select photo_id, list(d order by d) as l, count(*) as n from rd group by 1) select i.photo_id, round(coalesce(l[cast(floor(n * .2::double) as bigint) + 1], 0), 6) as radius from (select distinct photo_id from ink) i left join l using (photo_id)""")
def thin_radius(spark, sf):
    return mk.thin_radius(ink(spark, sf), 0.2).withColumn("radius", F.round("radius", 6))


@query("thin_radius_in_region", f"""with {_INK}, {_DIST}, rd as (select a.photo_id, a.x, a.y, max(a.d) as d from dst a left join dst b on b.photo_id = a.photo_id and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 where a.d >= 1.5 and a.x < 5 group by 1, 2, 3 having max(a.d) >= max(b.d)),
 l as (select photo_id, list(d order by d) as l, count(*) as n from rd group by 1) select i.photo_id, round(coalesce(l[cast(floor(n * .2::double) as bigint) + 1], 0), 6) as radius from (select distinct photo_id from ink) i left join l using (photo_id)""")
def thin_radius_in_region(spark, sf):
    return mk.thin_radius(ink(spark, sf), 0.2, ink(spark, sf).where("x < 5")).withColumn("radius", F.round("radius", 6))


_D1 = "(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y) <= {r})"


@query("dilate", f"with {_INK} select distinct g.photo_id, g.x, g.y from gp g join ink i on i.photo_id = g.photo_id and {_D1.format(a='g', b='i', r=4.5)}")
def dilate(spark, sf):
    return mk.dilate(ink(spark, sf), 2).select("photo_id", "x", "y")


@query("erode", f"with {_INK} select i.photo_id, i.x, i.y from ink i where not exists (select 1 from bgd b where b.photo_id = i.photo_id and {_D1.format(a='b', b='i', r=1.5)})")
def erode(spark, sf):
    return mk.erode(ink(spark, sf), 1).select("photo_id", "x", "y")


@query("close_mask", f"with {_INK}, dl as materialized (select distinct g.photo_id, g.x, g.y from gp g join ink i on i.photo_id = g.photo_id and {_D1.format(a='g', b='i', r=1.5)}), nd as (select photo_id, x, y from gp where not exists (select 1 from dl where dl.photo_id = gp.photo_id and dl.x = gp.x and dl.y = gp.y)) select d.photo_id, d.x, d.y from dl d where not exists (select 1 from nd b where b.photo_id = d.photo_id and {_D1.format(a='b', b='d', r=1.5)})")
def close_mask(spark, sf):
    return mk.close(ink(spark, sf), 1).select("photo_id", "x", "y")


@query("open_mask", f"with {_INK}, er as materialized (select i.photo_id, i.x, i.y from ink i where not exists (select 1 from bgd b where b.photo_id = i.photo_id and {_D1.format(a='b', b='i', r=1.5)})) select distinct g.photo_id, g.x, g.y from gp g join er i on i.photo_id = g.photo_id and {_D1.format(a='g', b='i', r=1.5)}")
def open_mask(spark, sf):
    return mk.opening(ink(spark, sf), 1).select("photo_id", "x", "y")


@query("bridge_through", f"""with {_INK}, xm as (select photo_id, x, y from gp where (x + y) % 3 = 0), ba as materialized (select * from ink i where not exists (select 1 from xm where xm.photo_id = i.photo_id and xm.x = i.x and xm.y = i.y)),
 dl as materialized (select distinct g.photo_id, g.x, g.y from gp g join ba i on i.photo_id = g.photo_id and abs(g.x - i.x) <= 1 and abs(g.y - i.y) <= 1), nd as (select photo_id, x, y from gp where not exists (select 1 from dl where dl.photo_id = gp.photo_id and dl.x = gp.x and dl.y = gp.y)),
 cl as (select d.photo_id, d.x, d.y from dl d where not exists (select 1 from nd b where b.photo_id = d.photo_id and abs(b.x - d.x) <= 1 and abs(b.y - d.y) <= 1))
 select photo_id, x, y from ba union select c.photo_id, c.x, c.y from cl c join xm using (photo_id, x, y)""")
def bridge_through(spark, sf):
    g = grid_pixels(spark, sf).where((F.col("x") + F.col("y")) % 3 == 0).select("photo_id", "w", "h", "x", "y")
    return mk.bridge_through(ink(spark, sf), g, 1).select("photo_id", "x", "y")


@query("reconstruct", f"""with {_INK}, g0 as materialized (select photo_id, x, y from gp where raw > 0.2), g1 as materialized (select photo_id, x, y from ink i where exists (select 1 from g0 where g0.photo_id = i.photo_id and {_D1.format(a='g0', b='i', r=1.5)})),
 g2 as (select photo_id, x, y from ink i where exists (select 1 from g1 where g1.photo_id = i.photo_id and {_D1.format(a='g1', b='i', r=1.5)})) select * from g2""")
def reconstruct(spark, sf):
    return mk.reconstruct(ink(spark, sf, 0.2), ink(spark, sf), 2).select("photo_id", "x", "y")


@query("polygon_runs", ctes("traced") + f""", {_F4}, cr as (select id, y, ax + (y + 0.5::double - ay) / (ey - ay) * (ex - ax) as x from (select *, unnest(generate_series(greatest(0, cast(ceil(least(ay, ey) - 0.5::double) as bigint)), least(119, cast(ceil(greatest(ay, ey) - 0.5::double) as bigint) - 1))) as y from e4) q),
 pr as (select id, y, x, lead(x) over w as x2, row_number() over w as k from cr window w as (partition by id, y order by x)) select id, y, cast(greatest(0, ceil(x - 0.5::double)) as bigint) as x0, cast(least(159, floor(x2 - 0.5::double)) as bigint) as x1 from pr where k % 2 = 1 and x2 is not null and greatest(0, ceil(x - 0.5::double)) <= least(159, floor(x2 - 0.5::double))""")
def polygon_runs(spark, sf):
    return mk.polygon_runs(ol.outline_edges(traced(spark, sf), 4), 160, 120)


@query("mask_iou", f"""with {_GP}, t as (select photo_id as scene, x, y, x < 6 as inside from gp where raw > 0), c as (select photo_id as scene, x, y from gp where raw > 0.05 or (x = 7 and raw < -0.1)),
 j as (select coalesce(t.scene, c.scene) as scene, t.scene is not null as ti, c.scene is not null as ci, coalesce(t.inside, false) or t.scene is null as ins from t full join c on c.scene = t.scene and c.x = t.x and c.y = t.y)
 select scene, floor(count(*) filter (ti and ci) / count(*) * 1000 + 0.5) / 1000 as iou, floor(count(*) filter (ti and ci and ins) / nullif(count(*) filter (ins), 0) * 1000 + 0.5) / 1000 as iou_inside from j group by 1""")
def mask_iou(spark, sf):
    g = grid_pixels(spark, sf).withColumnRenamed("photo_id", "scene")
    truth = g.where("raw > 0").withColumn("inside", F.col("x") < 6)
    return mk.mask_iou(g.where((F.col("raw") > 0.05) | ((F.col("x") == 7) & (F.col("raw") < -0.1))), truth)


@query("smooth_mask", f"""with {_INK}, b as (select i.photo_id, count(*) as per from ink i where (select count(*) from ink n where n.photo_id = i.photo_id and abs(n.x - i.x) + abs(n.y - i.y) = 1) < 4 group by 1),
 rd as (select photo_id, cast(greatest(1, floor(.5::double * .4::double * (2 * count(*) / max(per)) + .5::double)) as bigint) as r from ink join b using (photo_id) group by 1)
 select g.photo_id, g.x, g.y from gp g join rd using (photo_id) join ink i on i.photo_id = g.photo_id group by 1, 2, 3 having 2 * sum(greatest(0, 2 * r + 1 - abs(g.x - i.x)) * greatest(0, 2 * r + 1 - abs(g.y - i.y))) >= power(2 * any_value(r) + 1, 4)""")
def smooth_mask(spark, sf):
    return mk.smooth_mask(ink(spark, sf), 5).select("photo_id", "x", "y")


@query("solid_width", f"""with recursive {_INK}, {_HOLE}, tot as (select photo_id, count(*) as k from ink group by 1),
 full_ as materialized (select photo_id, x, y from ink union all select h.photo_id, h.x, h.y from hc h join hs using (photo_id, comp) join tot using (photo_id) where n <= .02::double * (k + n)),
 off_ as (select g.photo_id, g.x, g.y from gp g where not exists (select 1 from full_ f where f.photo_id = g.photo_id and f.x = g.x and f.y = g.y)),
 ds as (select i.photo_id, i.x, i.y, least(min(greatest(abs(b.x - i.x), abs(b.y - i.y)) + least(abs(b.x - i.x), abs(b.y - i.y)) * (sqrt(2.0::double) - 1)), i.x + 1, 8 - i.x, i.y + 1, 8 - i.y) as d
 from full_ i left join off_ b on b.photo_id = i.photo_id group by 1, 2, 3) select photo_id, round(avg(d) * 4, 6) as width from ds group by 1""")
def solid_width(spark, sf):
    return mk.solid_width(ink(spark, sf)).withColumn("width", F.round("width", 6))
