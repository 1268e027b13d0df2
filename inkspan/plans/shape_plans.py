"""Candidate shapes and paints, from order lines read as boxes and page rasters read as colour labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import pixels as px
from inkspan.operators import shapes as sh
from inkspan.plans.pixel_plans import _LB, _PX, labelled
from inkspan.plans.registry import query, table

# every eight orders' lines are one photo's shapes, among them specks, wisps and pieces over the whole frame
_BOX = """bx as (select l_orderkey // 8 as photo_id, 800 as w, 600 as h, row_number() over (partition by l_orderkey // 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as comp,
  case when l_partkey % 23 = 0 or l_partkey % 29 = 0 then 0 else l_partkey % 700 end as x0, case when l_partkey % 23 = 0 or l_partkey % 29 = 0 then 0 else l_suppkey * 7 % 500 end as y0,
  case when l_partkey % 23 = 0 or l_partkey % 29 = 0 then 799 else least(799, l_partkey % 700 + 4 + l_suppkey % 160) end as x1, case when l_partkey % 23 = 0 then 599 else least(599, l_suppkey * 7 % 500 + 6 + l_partkey % 190) end as y1,
  cast(l_quantity as bigint) as q from lineitem),
 sp as (select photo_id, w, h, comp, x0, y0, x1, y1, greatest(1, (x1 - x0 + 1) * (y1 - y0 + 1) * (q % 40) // 40) as area from bx)"""


def box_shapes(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("_boxes")
    sql = _BOX.replace("from lineitem", "from _boxes").replace("l_orderkey // 8", "l_orderkey div 8").replace("(q % 40) // 40", "(q % 40) div 40")
    return spark.sql(f"with {sql} select * from sp")


def _fold(first, step):
    """Rows folded in order per photo: ``first`` (photo_id, k, c) numbered from 1, ``step`` the list after one more."""
    return f"""fo as (select photo_id, cast(0 as bigint) as k, [] :: {first[1]} as gs from (select distinct photo_id from {first[0]}) union all
  select photo_id, k, case when hit is null then list_append(gs, {step[1]}) else list_concat(gs[1:hit - 1], [{step[2]}], gs[hit + 1:]) end
  from (select f.photo_id, n.k, f.gs, n.c, list_position(list_transform(f.gs, lambda m: {step[0]}), true) as hit from fo f join {first[0]} n on n.photo_id = f.photo_id and n.k = f.k + 1) z),
 la as (select photo_id, gs from fo qualify row_number() over (partition by photo_id order by k desc) = 1)"""


_SHAPE = "struct(comps bigint[], area bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint)[]"
_SATELLITE = """c.area <= .35::double * m.area and least(c.x1, m.x1) - greatest(c.x0, m.x0) > .5::double * (least(c.x1 - c.x0, m.x1 - m.x0) + 1) and greatest(0, greatest(c.y0, m.y0) - least(c.y1, m.y1)) < .4::double * (greatest(m.y1 - m.y0, c.y1 - c.y0) + 1)"""
_ALONE = "{'comps': [c.comp], 'area': c.area, 'x0': c.x0, 'y0': c.y0, 'x1': c.x1, 'y1': c.y1}"
_HOSTED = "{'comps': list_append(gs[hit].comps, c.comp), 'area': gs[hit].area + c.area, 'x0': least(gs[hit].x0, c.x0), 'y0': least(gs[hit].y0, c.y0), 'x1': greatest(gs[hit].x1, c.x1), 'y1': greatest(gs[hit].y1, c.y1)}"


def _candidates(three):
    return f"""with recursive {_BOX}, ts as (select *, (x0 <= 1)::int + (y0 <= 1)::int + (x1 >= w - 2)::int + (y1 >= h - 2)::int as t, (x1 - x0 + 1) * (y1 - y0 + 1) as bx from sp),
 kp as materialized (select photo_id, row_number() over (partition by photo_id order by area desc, comp) as k, {{'comp': comp, 'area': area, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} as c from ts
  where area >= greatest(420, w * h * .0018::double) and area / bx >= .02::double and not ((t >= 4 or bx > w * h * .96::double) and area / bx > .5::double){three}),
 {_fold(('kp', _SHAPE), (_SATELLITE, _ALONE, _HOSTED))}
 select photo_id, cast(row_number() over (partition by photo_id order by g.area desc, i) as int) as rank, array_to_string(g.comps, ',') as comps, g.area as area, g.x0 as x0, g.y0 as y0, g.x1 as x1, g.y1 as y1 from (select photo_id, unnest(gs) as g, generate_subscripts(gs, 1) as i from la) q"""


def _shown(df):
    return df.withColumn("comps", F.array_join(F.transform("comps", lambda c: c.cast("string")), ","))


@query("candidate_shapes", _candidates(""))
def candidate_shapes(spark, sf):
    return _shown(sh.candidate_shapes(box_shapes(spark, sf)))


@query("candidate_shapes_plain", _candidates(" and t <> 3"))
def candidate_shapes_plain(spark, sf):
    return _shown(sh.candidate_shapes(box_shapes(spark, sf), recognised=False))


# the pieces of a colour are its bands of sixteen rows
_BANDS = """tt as (select photo_id, count(*) as tot from lb group by 1),
 sp as (select photo_id, label, y // 16 as shape, count(*) / any_value(tot) as share, count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) as fill, greatest(max(x) - min(x) + 1, max(y) - min(y) + 1) / any_value(least(w, h)) as size,
  max((x = 0)::int) + max((y = 0)::int) + max((x = w - 1)::int) + max((y = h - 1)::int) as touch, label % 4 / 4.0::double as score from lb join tt using (photo_id) group by 1, 2, 3)"""
_GROUPS = """q as (select *, (x < m or y < m or x >= w - m or y >= h - m) as rn from (select *, greatest(1, floor(least(w, h) * .06::double + .5::double)) as m from lb) z),
 g0 as (select photo_id, label, count(*) as n, count(*) filter (rn) as k, avg(r) as r, avg(g) as g, avg(b) as b from q group by 1, 2),
 gr as (select photo_id, label, r, g, b, n / sum(n) over (partition by photo_id) as share, k / sum(k) over (partition by photo_id) as ring from g0)"""
_JUDGED = f"""{_BANDS}, {_GROUPS},
 ss as (select s.photo_id, s.label, bool_or(touch >= 1 and s.share >= .3::double * g.share) as edge, max(score) as top, arg_max({{'fill': fill, 'size': size}}, {{'s': s.share, 'l': -shape}}) as big,
  sum(case when s.share >= .25::double * g.share or size >= .5::double or (touch >= 1 and s.share >= .05::double * g.share) then 0 else s.share end) as parts from sp s join gr g using (photo_id, label) group by 1, 2),
 s0 as (select gr.*, parts, share >= .06::double and (ring >= .3::double or (edge and (top < .4::double or (big.fill >= .55::double and big.size >= .3::double)))) as sf from gr join ss using (photo_id, label)),
 ju as materialized (select photo_id, label, r, g, b, share, ring, parts, sf or (not bool_or(sf) over p and row_number() over (partition by photo_id order by ring desc, label) = 1) as surface from s0 window p as (partition by photo_id))"""


def bands(spark, sf):
    lb = labelled(spark, sf)
    size = lb.groupBy("photo_id").agg(F.count(F.lit(1)).alias("tot"))
    across = lambda c: F.max(c) - F.min(c) + 1
    t = lambda cond: F.max(cond.cast("int"))
    s = lb.groupBy("photo_id", "label", F.floor(F.col("y") / 16).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), across("x").alias("bw"), across("y").alias("bh"), F.first(F.least("w", "h")).alias("least"),
        (t(F.col("x") == 0) + t(F.col("y") == 0) + t(F.col("x") == F.col("w") - 1) + t(F.col("y") == F.col("h") - 1)).alias("touch"),
    )
    s = s.join(size, "photo_id")
    return s.select("photo_id", "label", "shape", (F.col("n") / F.col("tot")).alias("share"), (F.col("n") / (F.col("bw") * F.col("bh"))).alias("fill"), (F.greatest("bw", "bh") / F.col("least")).alias("size"), "touch", (F.col("label") % 4 / 4.0).alias("score"))


@query("judged_colours", f"with {_PX}, {_LB}, {_JUDGED} select photo_id, label, surface, round(parts, 9) as parts from ju")
def judged_colours(spark, sf):
    out = sh.judged_colours(px.color_groups(labelled(spark, sf)), bands(spark, sf))
    return out.select("photo_id", "label", "surface", F.round("parts", 9).alias("parts"))


def _hue(r, g, b):
    mx, d = f"greatest({r}, {g}, {b})", f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))"
    h = f"(case when {mx} = {r} then fmod(({g} - {b}) / {d}, 6) when {mx} = {g} then ({b} - {r}) / {d} + 2 else ({r} - {g}) / {d} + 4 end * 60)"
    return f"case when {d} < 40 and {d} < .35::double * {mx} then null when {h} < 0 then {h} + 360 else {h} end"


_RED = "((m.r + c.r) / 2.0::double)"
_NEAR = f"sqrt((2 + {_RED} / 256) * (m.r - c.r) * (m.r - c.r) + 4.0::double * (m.g - c.g) * (m.g - c.g) + (2 + (255 - {_RED}) / 256) * (m.b - c.b) * (m.b - c.b))"
_DOT, _MM, _CC = (f"({a}.v1 * {b}.v1 + {a}.v2 * {b}.v2 + {a}.v3 * {b}.v3)" for a, b in ("mc", "mm", "cc"))
_SHADE = f"""case when m.on <> c.on then {_NEAR} < 60 else {_DOT} / (case when {_MM} = 0 then 1 else {_MM} end) >= .55::double and ({_NEAR} < 85 or ((m.hue is null) = (c.hue is null) and (m.hue is null or least(abs(m.hue - c.hue), 360 - abs(m.hue - c.hue)) <= 35)
 and {_DOT} / ((case when {_MM} = 0 then 1 else sqrt({_MM}) end) * (case when {_CC} = 0 then 1 else sqrt({_CC}) end)) > cos(radians(22.0::double)))) end"""
_TONES = ("label", "on", "r", "g", "b", "hue", "v1", "v2", "v3")
_PAINT = "struct(members double[], total double, label integer, \"on\" integer, r double, g double, b double, hue double, v1 double, v2 double, v3 double)[]"
_FIRST = "{'members': [c.member], 'total': c.share, " + ", ".join(f"'{x}': c.{x}" for x in _TONES) + "}"
_JOINED = "{'members': list_append(gs[hit].members, c.member), 'total': gs[hit].total + c.share, " + ", ".join(f"'{x}': gs[hit].{x}" for x in _TONES) + "}"


@query("merge_paints", f"""with recursive {_PX}, {_LB}, {_JUDGED},
 nb as (select a.photo_id, a.label as a, c.label as b from lb a join lb c on c.photo_id = a.photo_id and c.x = a.x + 1 and c.y = a.y where a.label <> c.label union all select a.photo_id, a.label, c.label from lb a join lb c on c.photo_id = a.photo_id and c.x = a.x and c.y = a.y + 1 where a.label <> c.label),
 bo as materialized (select photo_id, a, b, count(*) as n from (select photo_id, a, b from nb union all select photo_id, b, a from nb) u group by 1, 2, 3),
 mn as (select photo_id, arg_max(label, {{'v': ring + share, 'l': -label}}) as main from ju where surface group by 1),
 mt as (select o.photo_id, o.a as label, arg_max(o.b, {{'n': o.n, 'l': -o.b}}) as met from bo o join ju s on s.photo_id = o.photo_id and s.label = o.b and s.surface group by 1, 2),
 lo as (select j.photo_id, j.label, min(s.label) as other from ju j join ju s on s.photo_id = j.photo_id and s.surface and s.label <> j.label group by 1, 2),
 ln as (select ju.*, coalesce(met, case when main <> label then main else coalesce(other, main) end) as on_ from ju join mn using (photo_id) left join mt using (photo_id, label) left join lo using (photo_id, label)),
 cd as (select photo_id, label, 0 as part, share as sh, r, g, b, on_ from ln where not surface and share >= .0015::double union all select photo_id, label, 1, parts, r, g, b, on_ from ln where surface and parts >= .0015::double),
 cv as materialized (select cd.photo_id, row_number() over (partition by cd.photo_id order by sh desc, part, cd.label) as k, {{'member': cd.label + part * .5::double, 'share': sh, 'label': cd.label::int, 'on': on_::int, 'r': cd.r, 'g': cd.g, 'b': cd.b, 'hue': {_hue('cd.r', 'cd.g', 'cd.b')}, 'v1': 1.5::double * (cd.r - o.r), 'v2': 2.0::double * (cd.g - o.g), 'v3': 1.6::double * (cd.b - o.b)}} as c from cd join ju o on o.photo_id = cd.photo_id and o.label = on_),
 {_fold(('cv', _PAINT), (_SHADE, _FIRST, _JOINED))}
 select photo_id, cast(i as int) as rank, p.label as paint, array_to_string(list_transform(p.members, lambda z: cast(cast(z * 2 as bigint) as varchar)), ',') as members, round(p.total, 9) as share, p.on as "on", round(p.r, 5) as r, round(p.g, 5) as g, round(p.b, 5) as b from (select photo_id, unnest(gs) as p, generate_subscripts(gs, 1) as i from la) q""")
def merge_paints(spark, sf):
    lb = labelled(spark, sf)
    out = sh.merge_paints(sh.judged_colours(px.color_groups(lb), bands(spark, sf)), px.label_borders(lb))
    members = F.array_join(F.transform("members", lambda m: (m * 2).cast("bigint").cast("string")), ",")
    return out.select("photo_id", "rank", "paint", members.alias("members"), F.round("share", 9).alias("share"), "on", *[F.round(c, 5).alias(c) for c in "rgb"])
