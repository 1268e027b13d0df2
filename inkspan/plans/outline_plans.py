"""Outline geometry, font metrics and font table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions.numbers import half_up
from inkspan.operators import library as lib
from inkspan.operators import outlines as ol
from inkspan.operators import text as tx
from inkspan.plans.inputs import ctes, load, load_outlines, sql_of
from inkspan.plans.library_plans import SQL_FINAL, sql_classes, sql_glyph_map, sql_label
from inkspan.plans.registry import query
from inkspan.session import cut_lineage
from inkspan.plans.text_plans import _BASE, _PROF, kerned, sql_edges, sql_flat


def traced(spark, sf):
    return load_outlines(spark, sf, "traced", ("id", "key"))


def own(spark, sf):
    return load_outlines(spark, sf, "outlines", ("id", "key"))


_F4 = sql_flat("traced", 4, "f4") + ", " + sql_edges("f4", "e4")
_F6 = sql_flat("outlines", 6, "f6") + ", " + sql_edges("f6", "e6")
_RING = """ring as (select id, contour, count(*) as points, sum(ax * ey - ex * ay) / 2 as area, sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))) as per from e6 group by 1, 2),
 fst as (select id, contour, x as px, y as py from f6 where i = 0),
 hold as (select f.id, f.contour, e.contour as other, count(*) % 2 as odd from fst f join e6 e on e.id = f.id and e.contour <> f.contour
  and (e.ey > py) <> (e.ay > py) and px < (e.ax - e.ex) * (py - e.ey) / (e.ay - e.ey) + e.ex group by 1, 2, 3),
 dep as (select f.id, f.contour, cast(coalesce(sum(odd), 0) as bigint) as depth from fst f left join hold h using (id, contour) group by 1, 2)"""


@query("flatten_outlines", ctes("traced") + f", {_F4} select id, contour, count(*) as points, round(sum(round(x * 1000)) / 1000, 2) as sx, round(sum(round(y * 1000)) / 1000, 2) as sy, round(max(x), 6) as x1 from f4 group by 1, 2")
def flatten_outlines(spark, sf):
    p = ol.flatten_points(traced(spark, sf), 4)
    return p.groupBy("id", "contour").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum(F.round(F.col("x") * 1000)) / 1000, 2).alias("sx"),
        F.round(F.sum(F.round(F.col("y") * 1000)) / 1000, 2).alias("sy"), F.round(F.max("x"), 6).alias("x1"),
    )


@query("bounds", ctes("traced") + f", {_F4} select id, round(min(x), 6) as x0, round(min(y), 6) as y0, round(max(x), 6) as x1, round(max(y), 6) as y1 from f4 group by 1")
def bounds(spark, sf):
    b = ol.bounds(ol.outline_edges(traced(spark, sf), 4))
    return b.select("id", *[F.round(f"b{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("ring_measures", ctes("outlines", "traced") + f", {_F6}, {_RING} select id, contour, points, round(area, 2) as area, round(per, 3) as perimeter, cast(sign(round(area, 6)) as int) as orientation from ring")
def ring_measures(spark, sf):
    r = ol.ring_measures(ol.outline_edges(own(spark, sf), 6))
    return r.withColumn("area", F.round("area", 2)).withColumn("perimeter", F.round("perimeter", 3))


@query("contour_depth", ctes("outlines") + f", {_F6}, {_RING} select * from dep")
def contour_depth(spark, sf):
    g = own(spark, sf)
    return ol.contour_depth(g, ol.outline_edges(g, 6))


@query("normalize_winding", ctes("outlines") + f", {_F6}, {_RING} select id, contour, depth, (depth % 2 = 1) <> (area > 0) as reverse from ring join dep using (id, contour)")
def normalize_winding(spark, sf):
    return ol.normalize_winding(own(spark, sf)).drop("area")


_WEIGHT = """wsum as (select id, sum(case when depth % 2 = 1 then -abs(area) else abs(area) end) as a, sum(per) as p from ring join dep using (id, contour) where points >= 3 group by 1),
 wt as (select id, round(2 * greatest(0, a) / p / greatest(1, top - bottom), 9) as w from wsum join (select distinct id, key from outlines) k using (id) join cls using (key))"""


@query("weight_of", ctes("outlines") + f", cls as {sql_classes(sql_of('slots'))}, {_F6}, {_RING}, {_WEIGHT} select id, floor(w * 1000 + 0.5::double) / 1000 as weight from wt")
def weight_of(spark, sf):
    return ol.weight_of(own(spark, sf))


_OVER = f"""cls as {sql_classes(sql_of('slots'))}, {_F4}, ob as (select id, min(x) as bx0, min(y) as by0, max(x) as bx1, max(y) as by1 from f4 group by 1),
 fl as (select id, max(x) filter (y - by0 <= greatest(1.5::double, (by1 - by0) * 0.035::double)) - min(x) filter (y - by0 <= greatest(1.5::double, (by1 - by0) * 0.035::double)) as ts,
  max(x) filter (by1 - y <= greatest(1.5::double, (by1 - by0) * 0.035::double)) - min(x) filter (by1 - y <= greatest(1.5::double, (by1 - by0) * 0.035::double)) as bs from f4 join ob using (id) group by 1),
 ft as (select o.*, c.*, case when ts > 0 then ts / (bx1 - bx0) else 0 end as flat_top, case when bs > 0 then bs / (bx1 - bx0) else 0 end as flat_bot, (top - bottom) / 700 as u from ob o join fl using (id) join (select distinct id, key from traced) k using (id) join cls c using (key)),
 ov as (select *, OS_TOP as os_top, OS_BOT as os_bot from ft)"""


def _units(f):
    return f"cast(case when not os then 0 when {f} < 0.12 then floor(15.0::double * u + 0.5) when {f} < 0.45 then floor(11.0::double * u + 0.5) when {f} < 0.60 then floor(5.0::double * u + 0.5) else 0 end as bigint)"


_OVER = _OVER.replace("OS_TOP", _units("flat_top")).replace("OS_BOT", _units("flat_bot"))


@query("overshoot", ctes("traced") + f", {_OVER} select id, round(flat_top, 5) as flat_top, round(flat_bot, 5) as flat_bot, os_top, os_bot from ov")
def overshoot(spark, sf):
    return ol.overshoot(traced(spark, sf)).select("id", F.round("flat_top", 5).alias("flat_top"), F.round("flat_bot", 5).alias("flat_bot"), "os_top", "os_bot")


def _fit_cols(r):
    out = []
    for i in range(4):
        fx, fy = f"(x{i} - bx0) * s", f"ftop - (y{i} - by0) * s"
        if r:
            fx, fy = f"floor({fx} * 100 + 0.5::double) / 100", f"floor(({fy}) * 100 + 0.5::double) / 100"
        out += [f"{fx} as x{i}", f"{fy} as y{i}"]
    return ", ".join(out)


_FIT = "fp as (select *, top + os_top as ftop, ((top + os_top) - (bottom - os_bot)) / (by1 - by0) as s from ov), fit as (select t.id, t.contour, t.seg, " + _fit_cols(False) + " from traced t join fp on fp.id = t.id)"
_SPACE = sql_flat("fit", 6, "sf") + ", " + sql_edges("sf", "se") + """,
 sbx as (select id, min(x) as sx0, max(x) as sx1 from sf group by 1),
 sp0 as (select b.*, cls_name, top - bottom as box, greatest(bottom, 0) + greatest(6.0::double, (top - bottom) * 0.06::double) as ys, least(top, 700) - greatest(6.0::double, (top - bottom) * 0.06::double) as ye from sbx b join ov using (id)),
 sl as (select e.id, sx0, sx1, ax, ay, ex, ey, ys, unnest(generate_series(greatest(0, cast(ceil((least(ay, ey) - ys) / 11) as bigint)), least(cast(floor((ye - ys) / 11) as bigint), cast(ceil((greatest(ay, ey) - ys) / 11) as bigint) - 1))) as row from se e join sp0 using (id) where ye > ys),
 sx as (select id, row, sx0, sx1, min(ax + (ys + row * 11 - ay) / (ey - ay) * (ex - ax)) as lo, max(ax + (ys + row * 11 - ay) / (ey - ay) * (ex - ax)) as hi from sl group by 1, 2, 3, 4),
 sa as (select id, sum(floor(least(lo - sx0, 175) * 1e6::double + 0.5)) / count(*) / 1e6::double as al, sum(floor(least(sx1 - hi, 175) * 1e6::double + 0.5)) / count(*) / 1e6::double as ar from sx group by 1),
 sb as (select p.*, least(165, greatest(6, floor(74 - 0.44::double * coalesce(al, 0) + 0.5))) as l0, least(165, greatest(6, floor(74 - 0.44::double * coalesce(ar, 0) + 0.5))) as r0 from sp0 p left join sa using (id)),
 sc as (select id, cls_name, box, case when ye <= ys then 62 else l0 end as l1, case when ye <= ys then 62 else r0 end as r1, cast(floor(sx1 - sx0 + 0.5) as bigint) as width from sb),
 spc as (select id, width, cast(case when cls_name = 'mark' and box < 320 then greatest(l1, 58) else l1 end as bigint) as lsb, cast(case when cls_name = 'mark' and box < 320 then greatest(r1, 58) else r1 end as bigint) as rsb from sc)"""


@query("fit_glyph", ctes("traced") + f", {_OVER}, {_FIT} select id, contour, seg, {', '.join(f'round({c}{i}, 4) as {c}{i}' for i in range(4) for c in 'xy')} from fit")
def fit_glyph(spark, sf):
    f = ol.fit_glyph(traced(spark, sf))
    rows = f.select("id", F.posexplode_outer("contours").alias("contour", "cs")).select("id", "contour", F.posexplode_outer("cs").alias("seg", "c"))
    return rows.select("id", "contour", "seg", *[F.round(f"c.{c}{i}", 4).alias(f"{c}{i}") for i in range(4) for c in "xy"])


@query("spacing", ctes("traced") + f", {_OVER}, {_FIT}, {_SPACE} select id, lsb, rsb, width, lsb + width + rsb as advance from spc")
def spacing(spark, sf):
    return ol.spacing(ol.fit_glyph(traced(spark, sf)))


@query("build_records", ctes("traced") + f""", {_OVER}, {_FIT}, {_SPACE}, outlines as (select id, contour, seg, {', '.join(f'floor({c}{i} * 100 + 0.5::double) / 100 as {c}{i}' for i in range(4) for c in 'xy')}, key from fit join (select distinct id, key from traced) kk using (id)),
 {_F6}, {_RING}, {_WEIGHT} select s.id, o.cls_name, o.os_top, o.os_bot, s.lsb, s.rsb, s.lsb + s.width + s.rsb as advance, floor(w * 1000 + 0.5::double) / 1000 as weight from spc s join ov o using (id) join wt using (id)""")
def build_records(spark, sf):
    return ol.build_records(traced(spark, sf)).select("id", "cls_name", "os_top", "os_bot", "lsb", "rsb", "advance", "weight")


@query("scanline_extents", ctes("outlines") + f""", {_F6}, ln as (select id, ax, ay, ex, ey, unnest(generate_series(cast(ceil((least(ay, ey) - 0.5::double) / 10) as bigint), cast(ceil((greatest(ay, ey) - 0.5::double) / 10) as bigint) - 1)) as row from e6)
 select id, row, floor(min(ax + (row * 10 + 0.5::double - ay) / (ey - ay) * (ex - ax)) * 10000 + 0.5::double) / 10000 as lo, floor(max(ax + (row * 10 + 0.5::double - ay) / (ey - ay) * (ex - ax)) * 10000 + 0.5::double) / 10000 as hi from ln group by 1, 2""")
def scanline_extents(spark, sf):
    e = ol.scanline_extents(ol.outline_edges(own(spark, sf), 6), 0.5, 10)
    return e.select("id", "row", half_up("lo", 4).alias("lo"), half_up("hi", 4).alias("hi"))


_ROT = ", ".join(f"round(3 + (x{i} - 3) * cos(radians(12)) - (y{i} - 5) * sin(radians(12)), 5) as x{i}, round(5 + (x{i} - 3) * sin(radians(12)) + (y{i} - 5) * cos(radians(12)), 5) as y{i}" for i in range(4))


@query("rotate_contours", ctes("traced") + f", rt as (select id, contour, seg, {_ROT} from traced) select * from rt")
def rotate_contours(spark, sf):
    g = traced(spark, sf).withColumn("contours", ol.rotate_contours(F.col("contours"), 12.0, F.lit(3.0), F.lit(5.0)))
    rows = g.select("id", F.posexplode("contours").alias("contour", "cs")).select("id", "contour", F.posexplode("cs").alias("seg", "c"))
    return rows.select("id", "contour", "seg", *[F.round(f"c.{c}{i}", 5).alias(f"{c}{i}") for i in range(4) for c in "xy"])


def _num(v):
    n = f"cast(floor(({v}) * 100 + 0.5::double) as bigint)"
    return f"(case when {n} < 0 then '-' else '' end || abs({n}) // 100 || case when abs({n}) % 100 = 0 then '' when abs({n}) % 10 = 0 then '.' || (abs({n}) % 100) // 10 else '.' || lpad((abs({n}) % 100)::varchar, 2, '0') end)"


@query("glyph_svg", ctes("outlines", "variants") + f""", fin as (select id, key, flsb, fadvance from {SQL_FINAL} f),
 sg as (select o.id, o.contour, o.seg, {_num('x0 + flsb')} || ' ' || {_num('760 - y0')} as p0, {_num('x1 + flsb')} || ' ' || {_num('760 - y1')} as p1, {_num('x2 + flsb')} || ' ' || {_num('760 - y2')} as p2, {_num('x3 + flsb')} || ' ' || {_num('760 - y3')} as p3 from outlines o join fin using (id)),
 rg as (select id, contour, 'M' || max(p0) filter (seg = 0) || string_agg('C' || p1 || ' ' || p2 || ' ' || p3, '' order by seg) || 'Z' as d from sg group by 1, 2),
 pd as (select id, string_agg(d, '' order by contour) as d from rg group by 1)
 select id, {sql_label('key')} || '__' || id || '.svg' as name, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || greatest(1, fadvance) || ' 1000" data-char="' || case key when '<' then '&lt;' when '&' then '&amp;' else key end
  || '" data-advance="' || fadvance || '" data-lsb="' || {_num('flsb')} || '"><title>' || case key when '<' then '&lt;' when '&' then '&amp;' else key end || '</title><path fill="#000" fill-rule="nonzero" d="' || d || '"/></svg>' as content from fin join pd using (id)""")
def glyph_svg(spark, sf):
    f = lib.finalize_variant(load(spark, sf, "variants")).select("id", "key", "flsb", "fadvance")
    return ol.glyph_svg(f.join(load_outlines(spark, sf, "outlines", ("id",)), "id"))


_ORDER = """sg as (select *, coalesce(drawn_key, ' ') as owner from gm where codepoint is not null),
 fc as (select lib_id, owner, min(codepoint) as f from sg group by 1, 2), rk as (select *, row_number() over (partition by lib_id order by f) as gid from fc),
 bs as (select lib_id, max(gid) as base from rk group by 1),
 lg as (select lib_id, key from gm where codepoint is null),
 mem as (select lib_id, key as lig, unnest(string_split(key, '')) as key, generate_subscripts(string_split(key, ''), 1) - 1 as i from lg),
 bx as (select lib_id, key, min(lig || ' ' || i) as wh from mem m where not exists (select 1 from sg s where s.lib_id = m.lib_id and s.key = m.key) group by 1, 2),
 nw as (select lib_id, key, unicode(key) as codepoint, string_split(wh, ' ')[1] as lig, cast(string_split(wh, ' ')[2] as int) as i, 'box' as kind from bx union all select lib_id, key, null, key, 9, 'liga' from lg),
 ord as (select s.lib_id, s.key, s.codepoint, s.owner, r.gid, 'char' as kind from sg s join rk r using (lib_id, owner)
  union all select n.lib_id, n.key, n.codepoint, case when kind = 'liga' then n.key end, b.base + row_number() over (partition by n.lib_id order by n.lig, n.i), kind from nw n join bs b using (lib_id))"""
_GM = ctes("slots", "variants") + f", {sql_glyph_map()}"


def active_map(spark, sf):
    """The glyph map is written once: every font table reads it several times."""
    return cut_lineage(lib.glyph_map(lib.active_variant(load(spark, sf, "slots"), load(spark, sf, "variants"))))


def order(spark, sf):
    return ol.glyph_order(active_map(spark, sf))


@query("glyph_order", f"{_GM}, {_ORDER} select * from ord")
def glyph_order(spark, sf):
    return order(spark, sf)


@query("cmap_segments", f"""{_GM}, {_ORDER}, cp as (select lib_id, codepoint as cp, gid, codepoint - gid as d, row_number() over (partition by lib_id order by codepoint) as rn from ord where codepoint is not null),
 br as (select *, case when lag(cp) over w = cp - 1 and lag(gid) over w = gid - 1 then 0 else 1 end as b from cp window w as (partition by lib_id order by cp)),
 gr as (select *, sum(b) over (partition by lib_id order by cp) as g from br)
 select lib_id, min(cp) as start_cp, min(gid) as start_gid, max(cp) as end_cp, max(gid) as end_gid from gr group by lib_id, g union all select distinct lib_id, 65535, 0, 65535, 0 from cp""")
def cmap_segments(spark, sf):
    return ol.cmap_segments(cut_lineage(order(spark, sf)))


@query("ligature_sets", f"""{_GM}, {_ORDER}, lc as (select m.lib_id, m.lig, string_agg(o.gid::varchar, ' ' order by m.i) as comps, min(case when m.i = 0 then o.gid end) as first_gid, count(*) as len from mem m join ord o on o.lib_id = m.lib_id and o.key = m.key and o.codepoint is not null group by 1, 2)
 select l.lib_id, first_gid, len, comps, o.gid from lc l join ord o on o.lib_id = l.lib_id and o.key = l.lig and o.kind = 'liga'""")
def ligature_sets(spark, sf):
    return ol.ligature_sets(cut_lineage(order(spark, sf)))


# Advance and box of the empty glyph (number 0 and undrawn members).
NOTDEF = {"advance": 745, "xmin": 55, "ymin": 0, "xmax": 690, "ymax": 700}


def metric_rows(spark, sf):
    gm = active_map(spark, sf)
    o = cut_lineage(ol.glyph_order(gm))
    fin = lib.finalize_variant(load(spark, sf, "variants")).select(
        "id", F.floor(F.col("flsb") + 0.5).alias("xmin"), F.floor(F.col("fy0") + 0.5).alias("ymin"),
        F.floor(F.col("flsb") + F.col("fx1") - F.col("fx0") + 0.5).alias("xmax"), F.floor(F.col("fy1") + 0.5).alias("ymax"),
    )
    drawn = o.where(F.col("kind") != "box").join(gm.select("lib_id", "key", "id", "advance"), ["lib_id", "key"]).join(fin, "id", "left")
    drawn = drawn.groupBy("lib_id", "gid").agg(
        *[F.max(c).alias(c) for c in ("advance", "xmin", "ymin", "xmax", "ymax")],
        F.min("codepoint").alias("codepoint"), F.max(F.when(F.col("kind") == "liga", F.length("key"))).alias("members"),
        F.max("codepoint").alias("cp_hi"),
    )
    blank = o.where(F.col("kind") == "box").select("lib_id", "codepoint").unionByName(
        o.select("lib_id").distinct().withColumn("codepoint", F.lit(None).cast("int"))
    )
    box = blank.select("lib_id", *[F.lit(v).cast("bigint").alias(k) for k, v in NOTDEF.items()], "codepoint",
                       F.lit(None).cast("int").alias("members"), F.col("codepoint").alias("cp_hi"))
    return drawn.drop("gid").unionByName(box)


@query("font_metrics", f"""{_GM}, {_ORDER}, fn as (select id, floor(flsb + 0.5) as xmin, floor(fy0 + 0.5) as ymin, floor(flsb + fx1 - fx0 + 0.5) as xmax, floor(fy1 + 0.5) as ymax from {SQL_FINAL} f),
 dg as (select o.lib_id, o.gid, max(g.advance) as advance, max(xmin) as xmin, max(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from ord o join gm g using (lib_id, key) left join fn on fn.id = g.id where o.kind <> 'box' group by 1, 2
  union all select lib_id, gid, 745, 55, 0, 690, 700 from ord where kind = 'box' union all select distinct lib_id, 0, 745, 55, 0, 690, 700 from ord),
 cps as (select lib_id, min(codepoint) as c0, max(codepoint) as c1, max(case when kind = 'liga' then length(key) end) as mx from ord group by 1)
 select lib_id, cast(greatest(760, max(ymax) + 12) as bigint) as ascender, cast(least(-240, min(ymin) - 12) as bigint) as descender, cast(max(advance) as bigint) as advance_max,
  cast(floor(sum(advance) / count(*) filter (advance <> 0) + 0.5) as bigint) as advance_avg, cast(min(xmin) as bigint) as min_lsb, cast(min(advance - xmax) as bigint) as min_rsb, cast(max(xmax) as bigint) as max_extent,
  max(greatest(32, c0))::bigint as first_cp, max(least(65535, c1))::bigint as last_cp, max(greatest(1, coalesce(mx, 1)))::bigint as max_context from dg join cps using (lib_id) group by lib_id""")
def font_metrics(spark, sf):
    return ol.font_metrics(metric_rows(spark, sf).withColumn("codepoint", F.coalesce("codepoint", "cp_hi")))


@query("kern_table", f"""{_BASE}, {_PROF}, {sql_glyph_map().replace('sizes as', 'sizes2 as').replace('join sizes z', 'join sizes2 z')}, {_ORDER},
 ids as (select o.lib_id, g.id, min(o.gid) as gid from ord o join gm g using (lib_id, key) where g.id is not null group by 1, 2),
 kr as (select a.lib_id, a.gid as l, b.gid as r, k.kern, row_number() over (partition by a.lib_id order by a.gid, b.gid) as rn from kern k join ids a on a.id = k.lft join ids b on b.lib_id = a.lib_id and b.id = k.rgt where kern <> 0)
 select lib_id, l, r, kern, rn from kr""")
def kern_table(spark, sf):
    gm = active_map(spark, sf)
    ids = ol.glyph_order(gm).join(gm.select("lib_id", "key", "id"), ["lib_id", "key"]).where(F.col("id").isNotNull())
    ids = ids.groupBy("lib_id", "id").agg(F.min("gid").alias("gid"))
    k = kerned(spark, sf)[1].select("lft", "rgt", "kern").distinct()
    k = k.join(ids.select("lib_id", F.col("id").alias("lft")), "lft")
    return ol.kern_table(k, ids)
