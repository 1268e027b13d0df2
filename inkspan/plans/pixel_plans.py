"""Pixel queries. Photos are page bytes read as 64-wide rasters, and 8x8 embedding grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import color as co
from inkspan.operators import pixels as px
from inkspan.plans.registry import query, table
from inkspan.session import spread

_PX = """px as (select photo_id, w, cast(ceil(cnt / 64) as bigint) as h, i % 64 as x, i // 64 as y, (c * 2) % 256 as r, (c + i // 640) % 256 as g, (c * 5) % 256 as b from
 (select page_id as photo_id, 64 as w, len(ks) as cnt, unnest(list_transform(ks, lambda z: unicode(z))) as c, generate_subscripts(ks, 1) - 1 as i from (select page_id, regexp_extract_all(html, '(?s).') as ks from pages) p) q)"""
_GP = """gp as (select photo_id, 8 as w, 8 as h, i % 8 as x, i // 8 as y, cast(v as double) as raw, cast(least(255, greatest(0, floor(128 + 256 * cast(v as double)))) as bigint) as v from
 (select vec_id as photo_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) e)"""


def page_pixels(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("photo_id"), "html")
    p = spread(p, "photo_id", rows=p.agg(F.sum(F.length("html"))).first()[0] or 0)  # a photo's pixels are made in one task and stay there
    # an empty pattern cuts at every code point; an empty page has no pixel
    ks = F.when(F.col("html") == "", F.array().cast("array<string>")).otherwise(F.split("html", ""))
    p = p.select("photo_id", ks.alias("ks"))
    # the height is taken before the explode, so pixel rows do not carry the page along
    p = p.select("photo_id", F.lit(64).alias("w"), F.ceil(F.size("ks") / 64).cast("int").alias("h"), F.posexplode_outer("ks").alias("i", "k")).withColumn("c", F.ascii("k"))
    whole = lambda e, name: F.expr(e).cast("int").alias(name)
    return p.select(
        "photo_id", "w", "h", whole("i % 64", "x"), whole("i div 64", "y"),
        whole("(c * 2) % 256", "r"), whole("(c + i div 640) % 256", "g"), whole("(c * 5) % 256", "b"),
    )


def grid_pixels(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("photo_id"), F.posexplode_outer("embedding").alias("i", "f"))
    raw = F.col("f").cast("double")
    return e.select(
        "photo_id", F.lit(8).alias("w"), F.lit(8).alias("h"), (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), raw.alias("raw"),
        F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.lit(128) + F.lit(256) * raw))).cast("bigint").alias("v"),
    )


def _d(r1, g1, b1, r2, g2, b2):
    rm = f"(({r1} + {r2}) / 2.0::double)"
    return f"sqrt((2 + {rm} / 256) * ({r1} - {r2}) * ({r1} - {r2}) + 4.0::double * ({g1} - {g2}) * ({g1} - {g2}) + (2 + (255 - {rm}) / 256) * ({b1} - {b2}) * ({b1} - {b2}))"


_K = "k as (select sqrt(2 + (190 + 60) / 2 / 256.0::double) as kr, 2.0::double as kg, sqrt(2 + (255 - (190 + 60) / 2) / 256.0::double) as kb)"
_AX = f"""{_K}, av as (select px.*, (190 - 60) * kr as ar, (40 - 70) * kg as ag, (80 - 200) * kb as ab, (r - 60) * kr as vr, (g - 70) * kg as vg, (b - 200) * kb as vb from px, k),
 au as (select *, (vr * ar + vg * ag + vb * ab) / (ar * ar + ag * ag + ab * ab) as u, ar * ar + ag * ag + ab * ab as len2 from av),
 ao as (select *, (vr - u * ar) * (vr - u * ar) + (vg - u * ag) * (vg - u * ag) + (vb - u * ab) * (vb - u * ab) as off2 from au)"""
PAINT, WALL = (190, 40, 80), (60, 70, 200)


@query("color_measures", f"""with {_PX}, {_AX}, m as (select *, greatest(r, g, b) as mx, greatest(r, g, b) - least(r, g, b) as sat from ao),
 hh as (select *, case when sat = 0 then null when mx = r then ((g - b) / sat) % 6 when mx = g then (b - r) / sat + 2 else (r - g) / sat + 4 end * 60 as h0 from m)
 select photo_id, x, y, (54 * r + 183 * g + 19 * b) >> 8 as luma, round(.299::double * r + .587::double * g + .114::double * b, 4) as luma_f, round({_d('r', 'g', 'b', '190', '40', '80')}, 4) as paint_d,
 round(least({_d('r', 'g', 'b', '190', '40', '80')}, {_d('r', 'g', 'b', '20', '200', '60')}), 4) as seed_d, round(sqrt(off2 + (1 - least(u, 1)) * (1 - least(u, 1)) * len2), 4) as axis_d, sat,
 round(case when not (sat < 40 and sat < 0.35::double * mx) then case when h0 < 0 then h0 + 360 else h0 end end, 4) as hue from hh""")
def color_measures(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return page_pixels(spark, sf).select(
        "photo_id", "x", "y", co.luma(r, g, b).alias("luma"), F.round(co.luma_float(r, g, b), 4).alias("luma_f"),
        F.round(co.color_dist(r, g, b, *PAINT), 4).alias("paint_d"), F.round(co.min_color_dist(r, g, b, [PAINT, (20, 200, 60)]), 4).alias("seed_d"),
        F.round(co.axis_dist(r, g, b, PAINT, WALL), 4).alias("axis_d"), co.saturation(r, g, b).alias("sat"), F.round(co.hue(r, g, b), 4).alias("hue"),
    )


@query("threshold_masks", f"""with {_PX} select photo_id, count(*) filter (((54 * r + 183 * g + 19 * b) >> 8) < 110) as dark, count(*) filter (((54 * r + 183 * g + 19 * b) >> 8) >= 110) as light,
 count(*) filter ({_d('r', 'g', 'b', '190', '40', '80')} <= 8 + 40 * 3.4::double) as paint, count(*) filter ({_d('r', 'g', 'b', '60', '70', '200')} <= 90) as wall from px group by 1""")
def threshold_masks(spark, sf):
    m = masks_of(page_pixels(spark, sf))
    return m.groupBy("photo_id").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("dark", "light", "paint", "wall")])


def masks_of(p):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    dark = co.luma(r, g, b) < 110
    return p.select("photo_id", "x", "y", dark.alias("dark"), (dark != F.lit(True)).alias("light"),
                    (co.color_dist(r, g, b, *PAINT) <= 8 + 40 * 3.4).alias("paint"), (co.color_dist(r, g, b, *WALL) <= 90).alias("wall"))


_OTSU = """hi as (select photo_id, (54 * r + 183 * g + 19 * b) >> 8 as t, count(*) as n from px group by 1, 2),
 cu as (select *, sum(n) over w as wb, sum(t * n) over w as sb, sum(n) over (partition by photo_id) as tot, sum(t * n) over (partition by photo_id) as s from hi window w as (partition by photo_id order by t)),
 vr as (select *, wb::double * (tot - wb) * (sb / wb - (s - sb) / (tot - wb)) * (sb / wb - (s - sb) / (tot - wb)) as v from cu where tot > wb),
 th as (select photo_id, t + 1 as threshold from vr qualify row_number() over (partition by photo_id order by v desc, t) = 1)"""


@query("otsu", f"with {_PX}, {_OTSU} select photo_id, threshold from th")
def otsu(spark, sf):
    return px.otsu(px.luma_histogram(page_pixels(spark, sf)))


@query("guess_invert", f"with {_PX}, {_OTSU} select photo_id, sum(case when t < threshold then n else 0 end) > sum(n) / 2 as invert from hi join th using (photo_id) group by 1")
def guess_invert(spark, sf):
    h = px.luma_histogram(page_pixels(spark, sf))
    return px.guess_invert(h, px.otsu(h))


def _dom(src, p):
    return f"""{p}b as (select photo_id, r >> 4 as br, g >> 4 as bg, b >> 4 as bb, count(*) as n, sum(r) as sr, sum(g) as sg, sum(b) as sb from {src} group by 1, 2, 3, 4),
 {p}v as (select a.photo_id, (a.br * 16 + a.bg) * 16 + a.bb as code, sum(o.n) as n, sum(o.sr) as sr, sum(o.sg) as sg, sum(o.sb) as sb from {p}b a join {p}b o on o.photo_id = a.photo_id and abs(o.br - a.br) <= 1 and abs(o.bg - a.bg) <= 1 and abs(o.bb - a.bb) <= 1 group by 1, 2),
 {p}t as (select photo_id, sum(n) as tot from {p}b group by 1),
 {p} as (select v.photo_id, sr / n as r, sg / n as g, sb / n as b, n / tot as frac from {p}v v join {p}t using (photo_id) qualify row_number() over (partition by v.photo_id order by n desc, code) = 1)"""


_RGB = "photo_id, round(r, 5) as r, round(g, 5) as g, round(b, 5) as b"


def _round_rgb(df):
    return df.select("photo_id", *[F.round(c, 5).alias(c) for c in "rgb"])


@query("dominant_color", f"with {_PX}, {_dom('px', 'dm')} select {_RGB} from dm")
def dominant_color(spark, sf):
    return _round_rgb(px.dominant_color(page_pixels(spark, sf)))


_BG = f"""rg as (select * from px where x < greatest(3, floor(least(w, h) * .08::double + .5::double)) or y < greatest(3, floor(least(w, h) * .08::double + .5::double)) or x >= w - greatest(3, floor(least(w, h) * .08::double + .5::double)) or y >= h - greatest(3, floor(least(w, h) * .08::double + .5::double))),
 {_dom('px', 'dw')}, {_dom('rg', 'dr')},
 bg as (select w.photo_id, case when q.frac >= .25 then q.r else w.r end as r, case when q.frac >= .25 then q.g else w.g end as g, case when q.frac >= .25 then q.b else w.b end as b, case when q.frac >= .25 then q.frac else w.frac end as frac from dw w left join dr q using (photo_id))"""


@query("background_color", f"with {_PX}, {_BG} select {_RGB} from bg")
def background_color(spark, sf):
    return _round_rgb(px.background_color(page_pixels(spark, sf)))


@query("wall_tolerance", f"""with {_PX}, {_BG}, ds as (select photo_id, bg.frac, round({_d('rg.r', 'rg.g', 'rg.b', 'bg.r', 'bg.g', 'bg.b')}, 6) as d from rg join bg using (photo_id)),
 ls as (select photo_id, max(frac) as frac, list(d order by d) as l, count(*) as n from ds group by 1),
 a as (select *, greatest(25, l[cast(floor(n * .9::double) as bigint) + 1] * 1.3::double) as whole, greatest(45, 3 * l[cast(floor(n * least(.5::double, .9::double * frac)) as bigint) + 1]) as cap from ls),
 c as (select *, len(list_filter(l, lambda z: z <= cap)) as k from a)
 select photo_id, round(case when k < .25 * n then whole else least(whole, greatest(25, l[cast(floor((k - 1) * .9::double) as bigint) + 1] * 1.3::double)) end, 4) as tolerance from c""")
def wall_tolerance(spark, sf):
    p = page_pixels(spark, sf)
    return px.wall_tolerance(p, px.background_color(p)).withColumn("tolerance", F.round("tolerance", 4))


@query("surface_tolerance", f"""with {_PX}, {_BG}, ds as (select photo_id, round({_d('px.r', 'px.g', 'px.b', 'bg.r', 'bg.g', 'bg.b')}, 6) as d from px join bg using (photo_id)),
 ls as (select photo_id, list(d order by d) as l, count(*) as n from ds group by 1) select photo_id, round(greatest(25, l[cast(floor(n * .9::double) as bigint) + 1] * 1.3::double), 4) as tolerance from ls""")
def surface_tolerance(spark, sf):
    p = page_pixels(spark, sf)
    return px.surface_tolerance(p, px.background_color(p)).withColumn("tolerance", F.round("tolerance", 4))


@query("dominant_along_axis", f"""with {_PX}, pu as (select *, ((r - 60) * 130 + (g - 70) * -30 + (b - 200) * -120) / 32200.0::double as u from px),
 kp as (select * from pu where u >= .3 and u <= 1.6 and sqrt(power(r - 60 - u * 130, 2) + power(g - 70 + u * 30, 2) + power(b - 200 + u * 120, 2)) <= greatest(30, sqrt(32200) * .25)),
 en as (select photo_id from kp group by 1 having count(*) >= 60), {_dom('kp', 'dm')} select {_RGB} from dm semi join en using (photo_id)""")
def dominant_along_axis(spark, sf):
    return _round_rgb(px.dominant_along_axis(page_pixels(spark, sf), PAINT, WALL))


@query("body_tone", f"""with {_PX}, {_AX}, us as (select photo_id, list(round(least(u, 1), 9) order by u) as l, count(*) as n from ao where least(u, 1) >= .45 and sqrt(off2) <= greatest(30, .25 * sqrt(len2)) group by 1),
 md as (select photo_id, n, l[n // 2 + 1] as med from us), mv as (select p.photo_id, case when n >= 200 and med <= .85 then (1 + med) / 2 else 1.0 end::double as k from (select distinct photo_id from px) p left join md using (photo_id))
 select photo_id, round(60 + 130 * k, 5) as r, round(70 - 30 * k, 5) as g, round(200 - 120 * k, 5) as b from mv""")
def body_tone(spark, sf):
    return _round_rgb(px.body_tone(page_pixels(spark, sf), PAINT, WALL))


_OWN = """tn as (select photo_id, (120 + photo_id % 90)::double as pr, (30 + photo_id % 60)::double as pg, (60 + photo_id % 50)::double as pb, (40 + photo_id % 40)::double as wr, (60 + photo_id % 30)::double as wg, (170 + photo_id % 60)::double as wb from (select distinct photo_id from px))"""


def own_tones(spark, sf):
    photos = table(spark, sf, "pages").select(F.col("page_id").alias("photo_id")).distinct()
    base = {"pr": (120, 90), "pg": (30, 60), "pb": (60, 50), "wr": (40, 40), "wg": (60, 30), "wb": (170, 60)}
    return photos.select("photo_id", *[(F.col("photo_id") % n + b).alias(c) for c, (b, n) in base.items()])


_AXIS = "(pr - wr) * (pr - wr) + (pg - wg) * (pg - wg) + (pb - wb) * (pb - wb)"


@query("dominant_along_own_axis", f"""with {_PX}, {_OWN}, pu as (select *, ((r - wr) * (pr - wr) + (g - wg) * (pg - wg) + (b - wb) * (pb - wb)) / greatest({_AXIS}, 1e-9) as u, {_AXIS} as l2 from px join tn using (photo_id)),
 kp as (select photo_id, r, g, b from pu where l2 >= 400 and u >= .3::double and u <= 1.6::double and sqrt(power(r - wr - u * (pr - wr), 2) + power(g - wg - u * (pg - wg), 2) + power(b - wb - u * (pb - wb), 2)) <= greatest(30, sqrt(l2) * .25::double)),
 en as (select photo_id from kp group by 1 having count(*) >= 60), {_dom('kp', 'dm')} select {_RGB} from dm semi join en using (photo_id)""")
def dominant_along_own_axis(spark, sf):
    return _round_rgb(px.dominant_along_axis(page_pixels(spark, sf), own_tones(spark, sf)))


@query("body_tone_of_each", f"""with {_PX}, {_OWN}, k as (select *, sqrt(2 + (pr + wr) / 2 / 256) as kr, 2.0::double as kg, sqrt(2 + (255 - (pr + wr) / 2) / 256) as kb from tn),
 av as (select photo_id, (pr - wr) * kr as ar, (pg - wg) * kg as ag, (pb - wb) * kb as ab, (r - wr) * kr as vr, (g - wg) * kg as vg, (b - wb) * kb as vb from px join k using (photo_id)),
 au as (select *, (vr * ar + vg * ag + vb * ab) / (ar * ar + ag * ag + ab * ab) as u, ar * ar + ag * ag + ab * ab as len2 from av),
 us as (select photo_id, list(round(least(u, 1), 9) order by u) as l, count(*) as n from au where least(u, 1) >= .45::double and sqrt((vr - u * ar) * (vr - u * ar) + (vg - u * ag) * (vg - u * ag) + (vb - u * ab) * (vb - u * ab)) <= greatest(30, .25::double * sqrt(len2)) group by 1),
 md as (select photo_id, n, l[n // 2 + 1] as med from us), mv as (select tn.*, case when n >= 200 and med <= .85::double and {_d('pr', 'pg', 'pb', 'wr', 'wg', 'wb')} >= 60 then (1 + med) / 2 else 1.0 end::double as k from tn left join md using (photo_id))
 select photo_id, round(wr + (pr - wr) * k, 5) as r, round(wg + (pg - wg) * k, 5) as g, round(wb + (pb - wb) * k, 5) as b from mv""")
def body_tone_of_each(spark, sf):
    return _round_rgb(px.body_tone(page_pixels(spark, sf), own_tones(spark, sf)))


_LB = f"lb as (select *, (r // 64) * 4 + g // 64 as label from px)"


def labelled(spark, sf):
    return page_pixels(spark, sf).withColumn("label", (F.floor(F.col("r") / 64) * 4 + F.floor(F.col("g") / 64)).cast("int"))


@query("color_groups", f"""with {_PX}, {_LB}, q as (select *, (x < m or y < m or x >= w - m or y >= h - m) as rn from (select *, greatest(1, floor(least(w, h) * .06::double + .5::double)) as m from lb) z),
 g as (select photo_id, label, count(*) as n, count(*) filter (rn) as k, avg(r) as r, avg(g) as g, avg(b) as b from q group by 1, 2)
 select photo_id, label, round(r, 5) as r, round(g, 5) as g, round(b, 5) as b, round(n / sum(n) over (partition by photo_id), 6) as share, round(k / sum(k) over (partition by photo_id), 6) as ring_share from g""")
def color_groups(spark, sf):
    g = px.color_groups(labelled(spark, sf))
    return g.select("photo_id", "label", *[F.round(c, 5).alias(c) for c in "rgb"], F.round("share", 6).alias("share"), F.round("ring_share", 6).alias("ring_share"))


@query("label_borders", f"""with {_PX}, {_LB}, nb as (select a.photo_id, least(a.label, c.label) as a, greatest(a.label, c.label) as b from lb a join lb c on c.photo_id = a.photo_id and ((c.x = a.x + 1 and c.y = a.y)) where a.label <> c.label
 union all select a.photo_id, least(a.label, c.label), greatest(a.label, c.label) from lb a join lb c on c.photo_id = a.photo_id and c.x = a.x and c.y = a.y + 1 where a.label <> c.label) select photo_id, a, b, count(*) as n from nb group by 1, 2, 3""")
def label_borders(spark, sf):
    return px.label_borders(labelled(spark, sf))


def _nbr(r):
    return f"""nb{r} as (select p.photo_id, p.x, p.y, dx, dy, q.v from gp p, (select unnest(generate_series(-{r}, {r})) as dx) a, (select unnest(generate_series(-{r}, {r})) as dy) b, gp q
 where q.photo_id = p.photo_id and q.x = least(7, greatest(0, p.x + dx)) and q.y = least(7, greatest(0, p.y + dy)))"""


@query("box_blur", f"with {_GP}, {_nbr(2)} select photo_id, x, y, round(avg(v), 5) as v from nb2 group by 1, 2, 3")
def box_blur(spark, sf):
    return px.box_blur(grid_pixels(spark, sf), 2).select("photo_id", "x", "y", F.round("v", 5).alias("v"))


@query("local_std", f"with {_GP}, {_nbr(1)} select photo_id, x, y, round(avg(v), 5) as mean, round(sqrt(greatest(0, avg(v * v) - avg(v) * avg(v))), 4) as std from nb1 group by 1, 2, 3")
def local_std(spark, sf):
    return px.local_std(grid_pixels(spark, sf), 1).select("photo_id", "x", "y", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"))


def _filt(src, name, fn):
    return f"{name} as (select p.photo_id, p.x, p.y, {fn}(q.v) as v from gp p join {src} q on q.photo_id = p.photo_id and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 group by 1, 2, 3)"


@query("min_max_filter", f"with {_GP}, {_filt('gp', 'mn', 'min')}, {_filt('gp', 'mx', 'max')} select photo_id, x, y, mn.v as lo, mx.v as hi from mn join mx using (photo_id, x, y)")
def min_max_filter(spark, sf):
    g = grid_pixels(spark, sf)
    lo, hi = px.min_filter(g, 1), px.max_filter(g, 1)
    return lo.select("photo_id", "x", "y", F.col("v").alias("lo")).join(hi.select("photo_id", "x", "y", F.col("v").alias("hi")), ["photo_id", "x", "y"])


@query("tophat", f"with {_GP}, {_filt('gp', 'mn', 'min')}, {_filt('gp', 'mx', 'max')}, {_filt('mn', 'op', 'max')}, {_filt('mx', 'cl', 'min')} select photo_id, x, y, gp.v - op.v as bright, cl.v - gp.v as dark from gp join op using (photo_id, x, y) join cl using (photo_id, x, y)")
def tophat(spark, sf):
    return px.tophat(grid_pixels(spark, sf), 1)


@query("gradient", f"with {_GP} select p.photo_id, p.x, p.y, round(coalesce(sqrt(power((e.v - w.v) * .5, 2) + power((s.v - n.v) * .5, 2)), 0), 5) as grad from gp p left join gp e on e.photo_id = p.photo_id and e.x = p.x + 1 and e.y = p.y left join gp w on w.photo_id = p.photo_id and w.x = p.x - 1 and w.y = p.y left join gp s on s.photo_id = p.photo_id and s.x = p.x and s.y = p.y + 1 left join gp n on n.photo_id = p.photo_id and n.x = p.x and n.y = p.y - 1")
def gradient(spark, sf):
    return px.gradient(grid_pixels(spark, sf)).withColumn("grad", F.round("grad", 5))


@query("sobel", f"""with {_GP} select p.photo_id, p.x, p.y, cast(sum(q.v * (q.x - p.x) * (2 - abs(q.y - p.y))) as bigint) as gx, cast(sum(q.v * (q.y - p.y) * (2 - abs(q.x - p.x))) as bigint) as gy from gp p join gp q on q.photo_id = p.photo_id and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1
 where p.x between 1 and 6 and p.y between 1 and 6 group by 1, 2, 3""")
def sobel(spark, sf):
    return px.sobel(grid_pixels(spark, sf))


@query("integral", f"with {_GP} select p.photo_id, p.x, p.y, cast(sum(q.v) as bigint) as s from gp p join gp q on q.photo_id = p.photo_id and q.x <= p.x and q.y <= p.y group by 1, 2, 3")
def integral(spark, sf):
    return px.integral(grid_pixels(spark, sf))


@query("box_sum", f"with {_GP} select p.photo_id, p.y * 8 + p.x as box, cast(sum(q.v) as bigint) as total from gp p join gp q on q.photo_id = p.photo_id and q.x >= p.x and q.y >= p.y and q.x < least(8, p.x + 3) and q.y < least(8, p.y + 2) group by 1, 2")
def box_sum(spark, sf):
    g = grid_pixels(spark, sf)
    boxes = g.select("photo_id", (F.col("y") * 8 + F.col("x")).alias("box"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.least(F.lit(8), F.col("x") + 3).alias("x1"), F.least(F.lit(8), F.col("y") + 2).alias("y1"))
    return px.box_sum(px.integral(g), boxes)
