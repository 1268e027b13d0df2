"""Crops and warps of page rasters, gathered over tiles of sixteen pixels so that every output reads several."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import resample as rs
from inkspan.plans.pixel_plans import _PX, page_pixels
from inkspan.plans.registry import query

_SIDE = 16


def _sampled(fill, keys):
    """Four joins to the photo's pixels and their blend, for ot(keys, photo_id, x, y, w, h, sx, sy)."""
    at = lambda n, x, y: f"left join px {n} on {n}.photo_id = o.photo_id and {n}.x = {x} and {n}.y = {y} and ok"
    tone = lambda c: f"cast(case when not ok then {fill} else round_even((coalesce(a.{c}, {fill}) * (1 - tx) + coalesce(b.{c}, {fill}) * tx) * (1 - ty) + (coalesce(c.{c}, {fill}) * (1 - tx) + coalesce(d.{c}, {fill}) * tx) * ty, 0) end as int) as {c}"
    return f"""ok as materialized (select *, coalesce(sx >= 0 and sy >= 0 and sx <= w - 1 and sy <= h - 1, false) as ok, floor(sx) as fx, floor(sy) as fy, sx - floor(sx) as tx, sy - floor(sy) as ty from ot)
 select {keys}, o.x as x, o.y as y, {tone('r')}, {tone('g')}, {tone('b')}, ok as in_photo from ok o {at('a', 'fx', 'fy')} {at('b', 'least(o.w - 1, fx + 1)', 'fy')} {at('c', 'fx', 'least(o.h - 1, fy + 1)')} {at('d', 'least(o.w - 1, fx + 1)', 'least(o.h - 1, fy + 1)')}"""


_SZ = "sz as (select photo_id, any_value(w) as w, any_value(h) as h from px group by 1)"
_MAP = ["1 + (p % 7 - 3) / 50.0::double", "(p % 5 - 2) / 40.0::double", "p % 11 - 5.0::double", "(p % 3 - 1) / 30.0::double", "1 + (p % 4 - 1) / 40.0::double", "p % 13 - 6.0::double", "(p % 3 - 1) / 100.0::double", "(p % 5 - 2) / 300.0::double", "1.0::double"]
_ROW = lambda k: f"(m{k} * x + m{k + 1} * y + m{k + 2})"


@query("warp_pixels", f"""with {_PX}, {_SZ}, mp as (select photo_id, w, h, {', '.join(f'{e.replace("p %", "photo_id %")} as m{k}' for k, e in enumerate(_MAP))} from sz),
 ot as (select mp.*, x, y, {_ROW(0)} / nullif({_ROW(6)}, 0) as sx, {_ROW(3)} / nullif({_ROW(6)}, 0) as sy from mp, (select unnest(range(70)) as x) q, lateral (select unnest(range(h + 9)) as y) r), {_sampled(128, 'o.photo_id')}""")
def warp_pixels(spark, sf):
    p = page_pixels(spark, sf)
    sizes = p.select("photo_id", "h").distinct()
    m = F.array(*[F.expr(e.replace("::double", "D").replace("p %", "photo_id %")).cast("double") for e in _MAP])
    return rs.warp_pixels(p, sizes.select("photo_id", m.alias("m"), F.lit(70).alias("ow"), (F.col("h") + 9).alias("oh")), tile=_SIDE)


_QUAD = [".1::double + (p % 7) / 100.0::double", ".05::double + (p % 5) / 50.0::double", ".9::double - (p % 3) / 20.0::double", ".1::double + (p % 4) / 60.0::double", ".95::double + (p % 2) / 10.0::double", ".9::double", ".15::double - (p % 6) / 25.0::double", ".85::double + (p % 9) / 40.0::double"]
_QX, _QY = ([f"q{2 * i + k}" for i in range(4)] for k in (0, 1))
_HYP = lambda a, b: f"sqrt(({_QX[b]} - {_QX[a]}) * ({_QX[b]} - {_QX[a]}) + ({_QY[b]} - {_QY[a]}) * ({_QY[b]} - {_QY[a]}))"
_DET = lambda a, b, c, d: f"({a} * {d} - {b} * {c})"


@query("crop_pixels", f"""with {_PX}, {_SZ}, qd as (select photo_id, w, h, {', '.join(f'cast({e.replace("p %", "photo_id %")} as double) * {"wh"[k % 2]} as q{k}' for k, e in enumerate(_QUAD))} from sz),
 qs as (select *, ({_HYP(0, 1)} + {_HYP(3, 2)}) / 2 as sw, ({_HYP(0, 3)} + {_HYP(1, 2)}) / 2 as sh from qd), qk as (select *, least(3, 48 / greatest(sw, sh)) as s from qs where sw >= 1 and sh >= 1),
 qo as (select *, greatest(1, floor(sw * s + .5::double)) as ow, greatest(1, floor(sh * s + .5::double)) as oh, q2 - q4 as dx1, q6 - q4 as dx2, q0 - q2 + q4 - q6 as ex, q3 - q5 as dy1, q7 - q5 as dy2, q1 - q3 + q5 - q7 as ey from qk),
 qg as (select *, {_DET('ex', 'dx2', 'ey', 'dy2')} / {_DET('dx1', 'dx2', 'dy1', 'dy2')} as g, {_DET('dx1', 'ex', 'dy1', 'ey')} / {_DET('dx1', 'dx2', 'dy1', 'dy2')} as k from qo where {_DET('dx1', 'dx2', 'dy1', 'dy2')} <> 0),
 mp as (select photo_id, w, h, ow, oh, (q2 - q0 + g * q2) / ow as m0, (q6 - q0 + k * q6) / oh as m1, q0 as m2, (q3 - q1 + g * q3) / ow as m3, (q7 - q1 + k * q7) / oh as m4, q1 as m5, g / ow as m6, k / oh as m7, 1.0::double as m8 from qg),
 ot as (select mp.*, u as x, v as y, {_ROW(0).replace('* x', '* (u + .5::double)').replace('* y', '* (v + .5::double)')} / nullif({_ROW(6).replace('* x', '* (u + .5::double)').replace('* y', '* (v + .5::double)')}, 0) - .5::double as sx, {_ROW(3).replace('* x', '* (u + .5::double)').replace('* y', '* (v + .5::double)')} / nullif({_ROW(6).replace('* x', '* (u + .5::double)').replace('* y', '* (v + .5::double)')}, 0) - .5::double as sy
  from mp, lateral (select unnest(range(cast(ow as bigint))) as u) q, lateral (select unnest(range(cast(oh as bigint))) as v) r), {_sampled(138, 'o.photo_id as id')}""")
def crop_pixels(spark, sf):
    p = page_pixels(spark, sf)
    quad = F.array(*[F.expr(e.replace("::double", "D").replace("p %", "photo_id %")) for e in _QUAD])
    quads = p.select("photo_id").distinct().select(F.col("photo_id").alias("id"), "photo_id", quad.alias("quad"))
    return rs.crop_pixels(p, quads, max_edge=48, tile=_SIDE)


