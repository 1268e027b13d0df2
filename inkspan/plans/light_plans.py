"""Light-field and local-wall queries over page rasters read as painted walls."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import light
from inkspan.operators import pixels as px
from inkspan.plans.pixel_plans import _BG, _PX, _d, _dom, page_pixels
from inkspan.plans.registry import query

# a wall lit brighter toward one corner (two photos in three), with paint on it
_LIT = _PX.replace("px as", "p0 as", 1) + """, px as (select photo_id, w, h, x, y, case when b % 13 = 0 then 30 else cast(floor((170 + r % 9) * li) as int) end as r,
 case when b % 13 = 0 then 20 else cast(floor((160 + g % 7) * li) as int) end as g, case when b % 13 = 0 then 60 else cast(floor((150 + b % 11) * li) as int) end as b
 from (select *, case when photo_id % 3 = 0 then 1.0::double else 0.7::double + 0.4::double * y / h + 0.15::double * x / w end as li from p0) q)"""


def lit_pixels(spark, sf):
    p = page_pixels(spark, sf)
    li = F.when(F.col("photo_id") % 3 == 0, 1.0).otherwise(F.lit(0.7) + F.lit(0.4) * F.col("y") / F.col("h") + F.lit(0.15) * F.col("x") / F.col("w"))
    tone = lambda c, base, n, paint: F.when(F.col("b") % 13 == 0, paint).otherwise(F.floor((F.col(c) % n + base) * li).cast("int")).alias(c)
    return p.select("photo_id", "w", "h", "x", "y", tone("r", 170, 9, 30), tone("g", 160, 7, 20), tone("b", 150, 11, 60))


def _solver():
    """Five rounds of weighted normal equations, eliminated column by column."""
    basis = ["1.0::double", "fx", "fy", "fx * fx", "fx * fy", "fy * fy"]
    at = lambda c: " + ".join(f"s{i}_{c} * {b}" for i, b in enumerate(basis))
    out = ["""cl as (select *, least(1.0::double, n0) as wt from (select photo_id, (cx + .5::double) * cs / w - .5::double as fx, (cy + .5::double) * cs / h - .5::double as fy, rs[len(rs) // 2 + 1]::double as r, gs[len(gs) // 2 + 1]::double as g, bs[len(bs) // 2 + 1]::double as b, len(rs) / n as n0, len(rs) as k, n
  from (select photo_id, w, h, cs, x // cs as cx, y // cs as cy, count(*) as n, coalesce(list(r order by r) filter (ok), []) as rs, coalesce(list(g order by g) filter (ok), []) as gs, coalesce(list(b order by b) filter (ok), []) as bs
   from (select px.*, greatest(8, cast(ceil(greatest(px.w, px.h) / 20) as bigint)) as cs, """ + _d("px.r", "px.g", "px.b", "bg.r", "bg.g", "bg.b") + """ <= 130 as ok from px join bg using (photo_id)) q group by 1, 2, 3, 4, 5, 6) c where len(rs) >= .3::double * n and len(rs) >= 12) z),
 w0 as materialized (select photo_id, fx, fy, r, g, b, wt, wt as k from cl where photo_id in (select photo_id from cl group by 1 having count(*) >= 12))"""]
    for it in range(5):
        sums = [f"sum(k * {a} * {c})" + (" + 1e-6::double" if i == j else "") + f" as s{i}_{j}" for i, a in enumerate(basis) for j, c in enumerate([*basis, "r", "g", "b"])]
        out.append(f"n{it}_0 as materialized (select photo_id, {', '.join(sums)} from w{it} group by 1)")
        for p in range(6):
            cols = [f"s{p}_{j} / s{p}_{p} as s{p}_{j}" if i == p else f"s{i}_{j} - s{i}_{p} * (s{p}_{j} / s{p}_{p}) as s{i}_{j}" for i in range(6) for j in range(9)]
            out.append(f"n{it}_{p + 1} as materialized (select photo_id, {', '.join(cols)} from n{it}_{p})")
        fit = [f"({at(6 + c)})" for c in range(3)]
        out.append(f"r{it} as materialized (select w.photo_id, fx, fy, r, g, b, wt, {_d('r', 'g', 'b', *fit)} as res from w{it} w join n{it}_6 using (photo_id))")
        out.append(f"s{it} as (select photo_id, greatest(8, 4.685::double * 1.4826::double * l[len(l) // 2 + 1]) as sc from (select photo_id, list(res order by res) as l from r{it} group by 1))")
        out.append(f"w{it + 1} as materialized (select photo_id, fx, fy, r, g, b, wt, case when res / sc < 1 then wt * (1 - (res / sc) * (res / sc)) * (1 - (res / sc) * (res / sc)) else 0 end as k from r{it} join s{it} using (photo_id))")
    fit = [f"({at(6 + c)})" for c in range(3)]
    cols = ", ".join(f"any_value(s{i}_{6 + c}) as c{c}_{i}" for c in range(3) for i in range(6))
    out.append(f"fl as materialized (select photo_id, min(fx) as x0, min(fy) as y0, max(fx) as x1, max(fy) as y1, max({_d(*fit, 'bg.r', 'bg.g', 'bg.b')}) as spread, any_value(bg.r) as wr, any_value(bg.g) as wg, any_value(bg.b) as wb, {cols} from w5 join n4_6 using (photo_id) join bg using (photo_id) where k > 0 group by 1 having spread >= 30)")
    return ",\n ".join(out)


_CO = [f"c{c}_{i}" for c in range(3) for i in range(6)]


@query("light_field", f"with {_LIT}, {_BG}, {_solver()} select photo_id, {', '.join(f'round({c}, 4) as {c}' for c in _CO)}, round(spread, 4) as spread, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1 from fl")
def light_field(spark, sf):
    p = lit_pixels(spark, sf)
    bg = px.background_color(p)
    f = light.light_field(light.light_cells(p, bg), bg)
    return f.select("photo_id", *[F.round(F.get("co", F.lit(k)), 4).alias(c) for k, c in enumerate(_CO)], F.round("spread", 4).alias("spread"), *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _gain(c):
    """The factor of channel c: straight between the grid columns at xs and at x1, straight along them."""
    k = "rgb".index(c)
    basis = ["1.0::double", "{x}", "{y}", "{x} * {x}", "{x} * {y}", "{y} * {y}"]
    node = lambda x, y: "greatest(.55::double, least(1.8::double, w" + c + " / greatest(8.0::double, " + " + ".join(f"c{k}_{i} * {b.format(x=x, y=y)}" for i, b in enumerate(basis)) + ")))"
    k0 = f"({node('xa', 'ya')} * (1 - ty) + {node('xa', 'yb')} * ty)"
    k1 = f"(({node('xb', 'ya')} * (1 - tx) + {node('xc', 'ya')} * tx) * (1 - ty) + ({node('xb', 'yb')} * (1 - tx) + {node('xc', 'yb')} * tx) * ty)"
    return f"least(255, greatest(0, round_even({c} * ({k0} + ({k1} - {k0}) * t), 0)))::int as {c}"


@query("even_light", f"""with {_LIT}, {_BG}, {_solver()},
 g0 as (select px.*, fl.*exclude(photo_id), x // 16 * 16 as xs, least(ceil(w / 16) + 1 - 1.001::double, least(w - 1, x // 16 * 16 + 16) / 16) as qx, least(ceil(h / 16) + 1 - 1.001::double, y / 16) as qy from px join fl using (photo_id)),
 g1 as (select *, (x - xs) / 16 as t, floor(qx) as i, qx - floor(qx) as tx, floor(qy) as j, qy - floor(qy) as ty from g0),
 g2 as (select *, greatest(x0, least(x1, xs / w - .5::double)) as xa, greatest(x0, least(x1, i * 16 / w - .5::double)) as xb, greatest(x0, least(x1, (i + 1) * 16 / w - .5::double)) as xc, greatest(y0, least(y1, j * 16 / h - .5::double)) as ya, greatest(y0, least(y1, (j + 1) * 16 / h - .5::double)) as yb from g1)
 select photo_id, x, y, {_gain('r')}, {_gain('g')}, {_gain('b')} from g2 union all select photo_id, x, y, r, g, b from px where photo_id not in (select photo_id from fl)""")
def even_light(spark, sf):
    p = lit_pixels(spark, sf)
    bg = px.background_color(p)
    return light.even_light(p, light.light_field(light.light_cells(p, bg), bg)).select("photo_id", "x", "y", "r", "g", "b")


# a post of another colour inside the border's wall, paint on both
_POST = _PX.replace("px as", "p0 as", 1) + """, px as (select photo_id, w, h, x, y, case when b % 17 = 0 then 20 when x between 9 and 54 and y between 5 and h - 6 then 90 + r % 9 else 200 + r % 9 end as r,
 case when b % 17 = 0 then 120 when x between 9 and 54 and y between 5 and h - 6 then 70 + g % 9 else 190 + g % 9 end as g, case when b % 17 = 0 then 20 when x between 9 and 54 and y between 5 and h - 6 then 60 + b % 9 else 180 + b % 9 end as b from p0)"""


def post_pixels(spark, sf):
    p = page_pixels(spark, sf)
    inside = F.col("x").between(9, 54) & (F.col("y") >= 5) & (F.col("y") <= F.col("h") - 6)
    tone = lambda c, post, wall, paint: F.when(F.col("b") % 17 == 0, paint).when(inside, F.col(c) % 9 + post).otherwise(F.col(c) % 9 + wall).alias(c)
    return p.select("photo_id", "w", "h", "x", "y", tone("r", 90, 200, 20), tone("g", 70, 190, 120), tone("b", 60, 180, 20))


def _local(look, share, paint):
    reach = "cast(floor(greatest(w, h) * .15::double + .5::double) as int)"
    of = lambda s: f"cast(floor({s} * {look}::double + .5::double) as int)" if look else "reach"
    here = "coalesce({}, true)"
    dist = lambda a, b: _d(*[f"{a}.{c}" for c in "rgb"], *[f"{b}{c}" for c in "rgb"])
    h = lambda c: f"avg(px.{c}) filter (abs(px.x - p.px) <= 2 and abs(px.y - p.py) <= 2)" if paint else "cast(null as double)"
    return f"""pt as (select photo_id, k as point, (photo_id * 7 + k * 19) % 64 as px, (photo_id * 11 + k * 23) % h as py, w, h, greatest(1, {reach}) as reach from (select distinct photo_id, w, h from px), (values (0), (1), (2), (3)) v(k)),
 pw as (select *, {of('w')} as lx, {of('h')} as ly from pt),
 ab as (select photo_id, point, count(*) filter (abs(px.x - p.px) <= lx and abs(px.y - p.py) <= ly) as n, count(*) filter (abs(px.x - p.px) <= lx and abs(px.y - p.py) <= ly and {dist('px', 'bg.')} < 60) as near, {', '.join(f'{h(c)} as h{c}' for c in 'rgb')} from pw p join px using (photo_id) join bg using (photo_id) group by 1, 2),
 ri as materialized (select photo_id || ':' || point as photo_id, px.r, px.g, px.b, hr, hg, hb, bg.r as wr, bg.g as wg, bg.b as wb from pw p join ab using (photo_id, point) join px using (photo_id) join bg using (photo_id)
  where n > 0 and near / n < {share}::double and abs(px.x - p.px) <= reach and abs(px.y - p.py) <= reach and (px.x < greatest(0, p.px - reach) + bn or px.x > least(p.w - 1, p.px + reach) - bn or px.y < greatest(0, p.py - reach) + bn or px.y > least(p.h - 1, p.py + reach) - bn) and {here.format(dist('px', 'h') + ' >= 100')}),
 {_dom('ri', 'dn')}, en as (select photo_id, any_value(hr) as hr, any_value(hg) as hg, any_value(hb) as hb, any_value(wr) as wr, any_value(wg) as wg, any_value(wb) as wb from ri group by 1),
 co as (select photo_id, c.r as dr, c.g as dg, c.b as db from dn c join en using (photo_id) where frac >= .25::double and {dist('c', 'w')} >= 40 and {here.format(dist('c', 'h') + ' >= 100')}),
 ow as (select photo_id, list(d order by d) as l from (select photo_id, round({dist('ri', 'd')}, 6) as d from ri join co using (photo_id)) where d < 80 group by 1)
 select cast(split_part(photo_id, ':', 1) as bigint) as photo_id, cast(split_part(photo_id, ':', 2) as int) as point, round(dr, 5) as r, round(dg, 5) as g, round(db, 5) as b, round(coalesce(greatest(25, l[cast(floor(len(l) * .9::double) as bigint) + 1] * 1.3::double), 40), 4) as tolerance from co left join ow using (photo_id)""".replace("bn or", "greatest(3, floor(reach * .15::double + .5::double)) or").replace("- bn)", "- greatest(3, floor(reach * .15::double + .5::double)))")


def _points(p):
    k = F.explode(F.array(*map(F.lit, range(4)))).alias("point")
    size = p.select("photo_id", "h").distinct().select("photo_id", "h", k)
    return size.select("photo_id", "point", ((F.col("photo_id") * 7 + F.col("point") * 19) % 64).alias("x"), ((F.col("photo_id") * 11 + F.col("point") * 23) % F.col("h")).alias("y"))


def _walls(spark, sf, **opts):
    p = post_pixels(spark, sf)
    out = light.local_wall(p, _points(p), px.background_color(p), **opts)
    return out.select("photo_id", "point", *[F.round(c, 5).alias(c) for c in "rgb"], F.round("tolerance", 4).alias("tolerance"))


@query("local_wall", f"with {_POST}, {_BG}, {_local(None, .2, True)}")
def local_wall(spark, sf):
    return _walls(spark, sf)


@query("local_wall_middle", f"with {_POST}, {_BG}, {_local(.3, .35, False)}")
def local_wall_middle(spark, sf):
    return _walls(spark, sf, look=0.3, share=0.35, paint=False)
