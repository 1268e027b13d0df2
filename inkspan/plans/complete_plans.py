"""Hidden holes and outlines on embedding grids; thresholds are scaled to their eight cells a side."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import complete as cm
from inkspan.plans.mask_plans import _INK, _comp, ink
from inkspan.plans.pixel_plans import _d, grid_pixels
from inkspan.plans.registry import query

_OCT = "min(greatest(abs(i.x - b.x), abs(i.y - b.y)) + least(abs(i.x - b.x), abs(i.y - b.y)) * (sqrt(2.0::double) - 1))"
_BACK = f"""{_INK}, {_comp('bgd', 'hc')}, fa as (select b.photo_id, b.x, b.y, {_OCT} as off from bgd b join ink i using (photo_id) group by 1, 2, 3),
 bk as materialized (select photo_id, x, y, comp, off, bool_or(x = 0 or y = 0 or x = 7 or y = 7) over p as outer_, count(*) over p as size from hc join fa using (photo_id, x, y) window p as (partition by photo_id, comp)),
 cl as (select photo_id, x, y, case when raw > 0 then 'paint' when raw < -.14::double then 'wall' when raw < -.1::double then 'family' else 'hidden' end as cls, (x * 7 + photo_id) % 90 as r, (y * 9 + 3 * photo_id) % 80 as g, (x * y * 11) % 70 as b from gp)"""


def _classes(spark, sf):
    g = grid_pixels(spark, sf)
    cls = F.when(F.col("raw") > 0, "paint").when(F.col("raw") < -0.14, "wall").when(F.col("raw") < -0.1, "family").otherwise("hidden")
    return g.select("photo_id", "x", "y", cls.alias("cls"), ((F.col("x") * 7 + F.col("photo_id")) % 90).alias("r"), ((F.col("y") * 9 + F.col("photo_id") * 3) % 80).alias("g"), ((F.col("x") * F.col("y") * 11) % 70).alias("b"))


_HID = """hl as materialized (select photo_id, comp, any_value(size) as size, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from bk join cl using (photo_id, x, y) where not outer_ group by 1, 2 having count(*) filter (cls = 'wall' or (cls = 'family' and off > 1)) < .25::double * any_value(size))"""


@query("fill_hidden_holes", f"with recursive {_BACK}, {_HID} select photo_id, x, y from ink union all select photo_id, x, y from bk join hl using (photo_id, comp)")
def fill_hidden_holes(spark, sf):
    return cm.fill_hidden_holes(ink(spark, sf), _classes(spark, sf), halo=1).select("photo_id", "x", "y")


@query("fill_hidden_holes_by_colour", f"""with recursive {_BACK}, {_HID},
 ow as (select photo_id, comp, sum(r) / any_value(h.size) as r, sum(g) / any_value(h.size) as g, sum(b) / any_value(h.size) as b from hl h join bk using (photo_id, comp) join cl using (photo_id, x, y) where h.size >= 1 group by 1, 2),
 rg as (select h.photo_id, h.comp, avg(r) as r, avg(g) as g, avg(b) as b, count(*) as n from hl h join bk k on k.photo_id = h.photo_id and k.outer_ and off > 1 and off < 4 and k.x between x0 - (x1 - x0 + 1) and x1 + (x1 - x0 + 1) and k.y between y0 - (y1 - y0 + 1) and y1 + (y1 - y0 + 1) join cl c on c.photo_id = k.photo_id and c.x = k.x and c.y = k.y where h.size >= 1 group by 1, 2),
 co as (select photo_id, comp from ow join rg using (photo_id, comp) where n > 0 and {_d('ow.r', 'ow.g', 'ow.b', 'rg.r', 'rg.g', 'rg.b')} < 50)
 select photo_id, x, y from ink union all select photo_id, x, y from bk join hl using (photo_id, comp) where (photo_id, comp) not in (select (photo_id, comp) from co)""")
def fill_hidden_holes_by_colour(spark, sf):
    c = _classes(spark, sf)
    return cm.fill_hidden_holes(ink(spark, sf), c, c, hole=1, ring_pixels=0, halo=1, reach=4).select("photo_id", "x", "y")


def _rim(src, name):
    return f"""{name} as materialized (select photo_id, x, y from {src} s where x > 0 and y > 0 and x < 7 and y < 7 and (select count(*) from {src} n where n.photo_id = s.photo_id and abs(n.x - s.x) + abs(n.y - s.y) = 1) < 4)"""


_BAND = f"""hd as materialized (select photo_id, x, y, off, comp as back, outer_ from bk join cl using (photo_id, x, y) where cls = 'hidden'), {_comp('hd', 'hp')},
 nh as (select photo_id, x, y from gp where (photo_id, x, y) not in (select (photo_id, x, y) from hd)), dp as (select b.photo_id, b.x, b.y, {_OCT} as depth from hd b join nh i using (photo_id) group by 1, 2, 3), {_rim('hd', 'he')}, {_rim('ink', 'le')},
 pe as (select photo_id, count(*) as per from ink s where (select count(*) from ink n where n.photo_id = s.photo_id and abs(n.x - s.x) + abs(n.y - s.y) = 1) < 4 group by 1),
 sw as (select photo_id, 2 * count(*) / any_value(per) as sw from ink join pe using (photo_id) group by 1), lr as (select photo_id, count(*) as rim from le group by 1),
 al as (select photo_id, comp, count(*) as along from (select distinct l.photo_id, hp.comp, l.x, l.y from le l join hp on hp.photo_id = l.photo_id and (hp.x - l.x) * (hp.x - l.x) + (hp.y - l.y) * (hp.y - l.y) <= 1) q group by 1, 2),
 st as (select h.photo_id, hp.comp, any_value(sw) as sw, count(he.x) as edge, count(he.x) filter (off <= 1) as touch, bool_or(outer_) as outside, coalesce(max(depth) filter (off <= .8::double * sw), 0) as thick
  from hd h join hp using (photo_id, x, y) join dp using (photo_id, x, y) join sw using (photo_id) left join he using (photo_id, x, y) where sw >= 1 group by 1, 2),
 tk as materialized (select photo_id, comp, thick from st left join al using (photo_id, comp) left join lr using (photo_id) where edge > 0 and touch / edge >= .3::double and 2 * thick <= 2 * sw and 2 * thick >= 2 and (not outside or coalesce(along, 0) / greatest(1, coalesce(rim, 0)) >= .45::double)),
 jn as materialized (select photo_id, x, y from ink union select photo_id, x, y from hd join hp using (photo_id, x, y) join tk using (photo_id, comp) where off <= 2 * thick + 2),
 js as materialized (select * from jn where photo_id in (select photo_id from tk)),
 dl as materialized (select distinct g.photo_id, g.x, g.y from gp g join js i on i.photo_id = g.photo_id and (i.x - g.x) * (i.x - g.x) + (i.y - g.y) * (i.y - g.y) <= 1.5),
 nd as materialized (select photo_id, x, y from gp where photo_id in (select photo_id from tk) and (photo_id, x, y) not in (select (photo_id, x, y) from dl)),
 cs as (select d.photo_id, d.x, d.y from dl d where not exists (select 1 from nd b where b.photo_id = d.photo_id and (b.x - d.x) * (b.x - d.x) + (b.y - d.y) * (b.y - d.y) <= 1.5))"""


@query("outline_bands", f"with recursive {_BACK}, {_BAND} select photo_id, x, y, hp.comp as comp, thick from hd join hp using (photo_id, x, y) join tk using (photo_id, comp)")
def outline_bands(spark, sf):
    return cm.outline_bands(ink(spark, sf), _classes(spark, sf), 1.0, 1.0, 2.0).select("photo_id", "x", "y", "comp", "thick")


@query("absorb_outline", f"with recursive {_BACK}, {_BAND} select photo_id, x, y from jn union select photo_id, x, y from cs join fa using (photo_id, x, y) where off <= 2")
def absorb_outline(spark, sf):
    return cm.absorb_outline(ink(spark, sf), _classes(spark, sf), 1.0, 1.0, 2.0).select("photo_id", "x", "y")
