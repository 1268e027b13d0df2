"""Recognition and evaluation queries over embedding grids (8x8) and their class means."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import recognition as rc
from inkspan.plans.mask_plans import _INK, ink
from inkspan.plans.registry import query, table

CHARS = ["O", "0", "o", "l", "I", "1", "%", "R", "s", "junk"]
_CH = "['O', '0', 'o', 'l', 'I', '1', '%', 'R', 's', 'junk']"
_GR = f"""gr as materialized (select vec_id as id, label, {_CH}[label + 1] as ch, unnest(embedding)::double as raw, generate_subscripts(embedding, 1) - 1 as cell from embeddings),
 pb as materialized (select id, cell, round(least(1, greatest(0, 0.5 + raw * 1.5)), 6) as v from gr), tp as materialized (select ch as tpl, cell, round(least(1, greatest(0, 0.5 + avg(raw) * 1.5)), 6) as v from gr group by 1, 2)"""


def grid(spark, sf):
    e = table(spark, sf, "embeddings")
    ch = F.element_at(F.array(*[F.lit(c) for c in CHARS]), F.col("label") + 1)
    return e.select(F.col("vec_id").alias("id"), "label", ch.alias("ch"), F.posexplode_outer("embedding").alias("cell", "f")).withColumn("raw", F.col("f").cast("double"))


def _unit(c):
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + c * 1.5)), 6)


def probes(spark, sf):
    return grid(spark, sf).select("id", "cell", _unit(F.col("raw")).alias("v"))


def templates(spark, sf):
    return grid(spark, sf).groupBy(F.col("ch").alias("tpl"), "cell").agg(_unit(F.avg("raw")).alias("v"))


_TS = f"""{_GR}, io as (select p.id, t.tpl, sum(least(p.v, t.v)) / sum(greatest(p.v, t.v)) as iou from pb p join tp t using (cell) group by 1, 2),
 sc as (select id, tpl as ch, iou * (case abs(id % 3 - ascii(tpl) % 3) when 0 then 1.06 when 1 then .9 else .72 end)::double * greatest(.55, 1 - abs(ln((1 + id % 5) / (1 + ascii(tpl) % 4)::double)) * .35::double) as score from io)"""


def scores(spark, sf):
    p, t = probes(spark, sf), templates(spark, sf)
    pi = p.select("id").distinct().select("id", (F.col("id") % 5 + 1).cast("double").alias("aspect"), (F.col("id") % 3).alias("holes"))
    ti = t.select("tpl").distinct().select("tpl", F.col("tpl").alias("ch"), (F.ascii("tpl") % 4 + 1).cast("double").alias("aspect"), (F.ascii("tpl") % 3).alias("holes"))
    return rc.template_scores(p, t, pi, ti)


@query("template_scores", f"with {_TS} select id, ch, round(score, 5) as score from sc")
def template_scores(spark, sf):
    return scores(spark, sf).withColumn("score", F.round("score", 5))


@query("expected_scores", f"with {_TS} select id, ch, round(score, 5) as score from sc where lower(ch) = 'o'")
def expected_scores(spark, sf):
    return rc.expected_scores(scores(spark, sf), "O").withColumn("score", F.round("score", 5))


@query("match_confidence", f"with {_TS}, l as (select id, list(score order by score desc, ch desc) as l, list(ch order by score desc, ch desc) as c from sc group by 1) select id, c[1] as ch, round(least(1, greatest(0, l[1] * .75 + (l[1] - l[2]) * 2.2)), 4) as confidence from l")
def match_confidence(spark, sf):
    return rc.match_confidence(scores(spark, sf)).withColumn("confidence", F.round("confidence", 4))


_OCT = "(greatest(abs(a.cell % 8 - b.cell % 8), abs(a.cell // 8 - b.cell // 8)) + least(abs(a.cell % 8 - b.cell % 8), abs(a.cell // 8 - b.cell // 8)) * (sqrt(2.0::double) - 1))"


@query("chamfer_scores", f"""with {_GR}, pi as materialized (select id, cell from pb where v > .75), pk as (select id, cell from pb where v > .2), ti as materialized (select tpl, cell from tp where v > .3), cl as (select unnest(generate_series(0, 63)) as cell),
 td as materialized (select b.tpl, a.cell, min({_OCT}) as d from cl a, ti b group by 1, 2), pd as materialized (select b.id, a.cell, min({_OCT}) as d from cl a, pk b group by 1, 2),
 pr as (select k.id, t.tpl, avg(exp(-(d * d) / 5.12)) as p from pk k join td t using (cell) group by 1, 2), re as (select p.id, t.tpl, avg(exp(-(d * d) / 5.12)) as r from pd p join ti t using (cell) group by 1, 2)
 select id, tpl, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 5) as score from pr join re using (id, tpl)""")
def chamfer_scores(spark, sf):
    return rc.chamfer_scores(probes(spark, sf), templates(spark, sf), 8).withColumn("score", F.round("score", 5))


_SM = f"""{_GR}, wt as (select tpl as ch, cell, 8 * v as wt from tp), bi as (select tpl as ch, -4 * sum(v * v) as bias from tp group by 1), zz as (select p.id, w.ch, sum(p.v * w.wt) + max(bias) as z from pb p join wt w using (cell) join bi using (ch) group by 1, 2),
 ee as (select *, exp(z - max(z) over (partition by id)) as e from zz), rd as materialized (select id as cand_id, ch, e / sum(e) over (partition by id) as p from ee)"""


def readings(spark, sf):
    t = templates(spark, sf)
    w = t.select(F.col("tpl").alias("ch"), "cell", (F.col("v") * 8).alias("wt"))
    b = t.groupBy(F.col("tpl").alias("ch")).agg((F.sum(F.col("v") * F.col("v")) * -4).alias("bias"))
    return rc.score(probes(spark, sf), w, b).withColumnRenamed("id", "cand_id")


@query("score", f"with {_SM} select cand_id, ch, round(p, 5) as p from rd")
def score(spark, sf):
    return readings(spark, sf).withColumn("p", F.round("p", 5))


_RW = f"{_SM}, rq as materialized (select cand_id, ch, p * (case when ch = '%' then .15 else 1 end)::double / sum(p * (case when ch = '%' then .15 else 1 end)::double) over (partition by cand_id) as p from rd), lt as (select cand_id, 1 - max(case when ch = 'junk' then p end) as letterness from rq group by 1)"


@query("reweight", f"with {_RW} select cand_id, ch, round(p, 5) as p from rq")
def reweight(spark, sf):
    return rc.reweight(readings(spark, sf)).withColumn("p", F.round("p", 5))


_CL = "pl as (select cand_id, sum(p) as p from rq where ch <> 'junk' group by cand_id, case ch when '0' then 'O' when '1' then 'I' when 'l' then 'I' else upper(ch) end), cy as materialized (select cand_id, letterness, letterness * sqrt(least(1, max(p))) as clarity from lt join pl using (cand_id) group by 1, 2)"


@query("clarity", f"with {_RW}, {_CL} select cand_id, round(letterness, 5) as letterness, round(clarity, 5) as clarity from cy")
def clarity(spark, sf):
    return rc.clarity(rc.reweight(readings(spark, sf))).select("cand_id", F.round("letterness", 5).alias("letterness"), F.round("clarity", 5).alias("clarity"))


@query("top_guesses", f"""with {_RW}, r as (select *, row_number() over (partition by cand_id order by p desc, ch) as rank from rq where ch <> 'junk')
 select cand_id, rank, ch, round(p, 5) as p, rank = 1 and letterness >= .5 and p >= .35 as auto from r join lt using (cand_id) where p >= .04 and letterness >= .3""")
def top_guesses(spark, sf):
    return rc.top_guesses(rc.reweight(readings(spark, sf))).withColumn("p", F.round("p", 5))


_CD = f"""{_RW}, {_CL}, cd as (select cand_id % 50 as photo_id, c.cand_id, 100 as pw, 80 as ph, c.cand_id * 7 % 80 as x0, c.cand_id * 5 % 60 as y0, c.cand_id * 7 % 80 + 5 + c.cand_id % 17 as x1, c.cand_id * 5 % 60 + 4 + c.cand_id % 19 as y1, 20 + c.cand_id * 11 % 90 as ink,
 clarity, letterness, {_CH}[c.cand_id % 9 + 1] as top from cy c)"""


def candidates(spark, sf):
    c = rc.clarity(rc.reweight(readings(spark, sf)))
    i = F.col("cand_id")
    return c.select((i % 50).alias("photo_id"), "cand_id", F.lit(100).alias("pw"), F.lit(80).alias("ph"), (i * 7 % 80).alias("x0"), (i * 5 % 60).alias("y0"),
                    (i * 7 % 80 + 5 + i % 17).alias("x1"), (i * 5 % 60 + 4 + i % 19).alias("y1"), (i * 11 % 90 + 20).alias("ink"), "clarity", "letterness",
                    F.element_at(F.array(*[F.lit(x) for x in CHARS]), (i % 9 + 1).cast("int")).alias("top"))


_RK = """mx as (select photo_id, max(ink) as mi, max(greatest(x1 - x0 + 1, y1 - y0 + 1)) as mt from cd group by 1),
 rk as materialized (select cd.*, clarity * power(ink / mi, .3) * power(greatest(x1 - x0 + 1, y1 - y0 + 1) / mt, .5) * exp(-(power((x0 + x1) / 2 - 50, 2) + power((y0 + y1) / 2 - 40, 2)) / 16400 / (2 * .22 * .22)) * (case when x0 <= 1 or y0 <= 1 or x1 >= 98 or y1 >= 78 then .75 else 1 end)::double * (case when top in ('l', 'I', '1') then .45 else 1 end)::double as score from cd join mx using (photo_id))"""


@query("rank_candidates", f"with {_CD}, {_RK} select photo_id, cand_id, round(score, 5) as score from rk")
def rank_candidates(spark, sf):
    return rc.rank_candidates(candidates(spark, sf)).select("photo_id", "cand_id", F.round("score", 5).alias("score"))


@query("choose_split", f"""with {_CD}, {_RK}, wh as (select *, cand_id // 4 as shape from rk where cand_id % 4 = 0), le as (select *, cand_id // 4 as shape, (cand_id % 10) / 10 as ins from rk where cand_id % 4 <> 0),
 jd as (select l.cand_id // 200 as photo, l.shape, l.cand_id, l.score, l.cand_id % 7 <> 0 and l.ins < .6 and (case when w.letterness is null or w.letterness < .6 then l.letterness >= .5 else l.clarity > w.clarity + .1 end) as take from le l left join wh w using (shape)),
 sp as (select shape, bool_or(take) as s from jd group by 1), o as (select photo, shape, cand_id, 'letter' as kind, score from jd join sp using (shape) where s union all select w.cand_id // 200, w.shape, w.cand_id, 'whole', w.score * case when coalesce(s, false) then .5 else 1 end from wh w left join sp using (shape)),
 t as (select photo, max(score) as t from o group by 1) select o.photo as photo_id, shape, cand_id, kind, round(score, 5) as score from o join t using (photo) where kind = 'whole' or score >= t * .12""")
def choose_split(spark, sf):
    r = rc.rank_candidates(candidates(spark, sf)).withColumn("shape", F.floor(F.col("cand_id") / 4)).withColumn("photo_id", F.floor(F.col("cand_id") / 200))
    letters = r.where("cand_id % 4 <> 0").withColumn("inside", (F.col("cand_id") % 10) / 10).withColumn("explained", F.col("cand_id") % 7 != 0)
    return rc.choose_split(r.where("cand_id % 4 = 0"), letters).select("photo_id", "shape", "cand_id", "kind", F.round("score", 5).alias("score"))


@query("stroke_score", """select l_orderkey, l_linenumber, l_partkey, round(least(1, greatest(0, (l_quantity / 5 - 2.5) / 5.5)) * least(1, greatest(0, (l_extendedprice / 60000 - .05) / .17)) * (case when l_extendedprice / 60000 > 1.05 then .5 else 1 end)::double
 * (case when l_discount * 9 > .5 then greatest(0, (.85 - l_discount * 9) / .35) else 1 end)::double * [1, .85, .5, .15, 0][cast(l_suppkey % 5 as int) + 1]::double * least(1, greatest(0, (l_tax * 12 - .5) / .3)), 5) as score from lineitem""")
def stroke_score(spark, sf):
    li = table(spark, sf, "lineitem")
    s = rc.stroke_score(F.col("l_quantity") / 5, F.col("l_extendedprice") / 60000, F.col("l_discount") * 9, (F.col("l_suppkey") % 5).cast("int"), F.col("l_tax") * 12)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(s, 5).alias("score"))


@query("rank_inks", """with s as (select l_orderkey as photo_id, l_suppkey % 4 as ink, l_discount * 8 as s from lineitem), k as (select *, row_number() over (partition by photo_id, ink order by s desc) as k from s),
 t as (select photo_id, ink, round(sum(s * [1, .35, .15][k]::double), 9) as total from k where k <= 3 group by 1, 2), r as (select *, row_number() over (partition by photo_id order by total desc, ink) as rank, max(total) over (partition by photo_id) as b from t)
 select photo_id, ink, round(total, 6) as total, rank from r where total >= greatest(.2, .3 * b)""")
def rank_inks(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("photo_id"), (F.col("l_suppkey") % 4).alias("ink"), (F.col("l_discount") * 8).alias("s"))
    return rc.rank_inks(s).withColumn("total", F.round("total", 6))


@query("lean", """with s as (select l_orderkey as cand_id, l_suppkey * 100000000 + l_partkey * 10 + l_linenumber as i, cast(l_partkey * 7 % 57 - 28 as double) as ang, l_quantity as len, 60 as tall from lineitem),
 c as (select *, sum(len) over w as cw, sum(ang * len) over w as cs from s window w as (partition by cand_id order by ang range between 5 preceding and 5 following)),
 b as (select cand_id, arg_max(cw, (round(cw, 6), -i)) as cw, arg_max(cs, (round(cw, 6), -i)) as cs, sum(len) as total from c group by 1), v as (select *, floor(cs / cw * 10 + .5::double) / 10 as l from b)
 select cand_id, case when cw >= .6 * total and cw >= 24 and abs(l) >= 2 then l else 0 end as lean from v""")
def lean(spark, sf):
    li = table(spark, sf, "lineitem")
    s = li.select(F.col("l_orderkey").alias("cand_id"), (F.col("l_suppkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("i"),
                  (F.col("l_partkey") * 7 % 57 - 28).cast("double").alias("ang"), F.col("l_quantity").alias("len"), F.lit(60).alias("tall"))
    return rc.lean(s)


@query("accuracy", f"with {_SM}, r as (select *, row_number() over (partition by cand_id order by round(p, 9) desc, ch) as rank from rd) select g.ch as label, count(*) as n, count(*) filter (rank = 1) as top1, count(*) filter (rank <= 3) as top3 from r join (select distinct id, ch from gr) g on g.id = r.cand_id and g.ch = r.ch group by 1")
def accuracy(spark, sf):
    s = readings(spark, sf).select(F.col("cand_id").alias("id"), "ch", F.round("p", 9).alias("p"))
    return rc.accuracy(s, grid(spark, sf).select("id", F.col("ch").alias("label")).distinct())


@query("class_balance", "select label, count(*) as n from embeddings group by 1")
def class_balance(spark, sf):
    return rc.class_balance(table(spark, sf, "embeddings"))


@query("quantize_int8", """with s as (select vec_id, embedding, list_max(list_transform(embedding, lambda v: abs(v::double))) / 127 as s from embeddings), q as (select vec_id, case when s = 0 then 1 else s end as scale, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from s)
 select vec_id, i, cast(greatest(-127, least(127, round_even(v / scale, 0))) as int) as q, round(scale, 9) as scale from q""")
def quantize_int8(spark, sf):
    q = rc.quantize_int8(table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector"))
    return q.select("vec_id", F.round("scale", 9).alias("scale"), F.posexplode("q").alias("i", "q"))


@query("bench_summary", """with s as (select source as lane, doc_id as idx, case when quality = 1 or toxic = 1 then (n_chars % 1000) / 1000 end as iou from documents join labels using (doc_id))
 select lane, floor(avg(iou) * 1000 + .5::double) / 1000 as mean_iou, count(iou) as scored, arg_max(idx, (coalesce(iou, -1), -idx)) as best_idx, min_by(iou, idx) filter (true) as f0, max(case when idx = m then iou end) as first_iou from s join (select lane, min(idx) as m from s group by 1) z using (lane) group by 1""".replace("min_by(iou, idx) filter (true) as f0, ", ""))
def bench_summary(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    iou = F.when((F.col("quality") == 1) | (F.col("toxic") == 1), (F.col("n_chars") % 1000) / 1000)
    return rc.bench_summary(d.select(F.col("source").alias("lane"), F.col("doc_id").alias("idx"), iou.alias("iou")))


@query("grid_features", f"""with {_INK}, bx as (select photo_id, min(x) as x0, min(y) as y0, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from ink group by 1), sc as (select *, 28.0::double / greatest(w, h) as s from bx), of as (select *, (32 - w * s) / 2 as ox, (32 - h * s) / 2 as oy from sc),
 e as (select i.photo_id, ox + (x - x0) * s as xa, ox + (x - x0 + 1) * s as xb, oy + (y - y0) * s as ya, oy + (y - y0 + 1) * s as yb from ink i join of using (photo_id)),
 c as (select *, unnest(generate_series(cast(floor(xa + 1e-9) as bigint), cast(ceil(xb - 1e-9) as bigint) - 1)) as cx from e), c2 as (select *, unnest(generate_series(cast(floor(ya + 1e-9) as bigint), cast(ceil(yb - 1e-9) as bigint) - 1)) as cy from c)
 select photo_id, cy * 32 + cx as cell, round(sum((least(xb, cx + 1) - greatest(xa, cx)) * (least(yb, cy + 1) - greatest(ya, cy))), 5) as v from c2 group by 1, 2""")
def grid_features(spark, sf):
    return rc.grid_features(ink(spark, sf), 32, 28).withColumn("v", F.round("v", 5))


@query("pick_disjoint", """with recursive g as (select l_orderkey as shape, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as gid, l_quantity as score, l_discount * 10 as letterness, [l_suppkey % 7, l_partkey % 5] as m from lineitem),
 o as materialized (select *, row_number() over (partition by shape order by score desc, gid) as k from g where letterness >= .5),
 r as (select shape, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast([] as bigint[]) as ids from (select distinct shape from o) union all
  select r.shape, o.k, case when list_has_any(used, m) then used else list_concat(used, m) end, case when list_has_any(used, m) then ids else list_append(ids, o.gid) end from r join o on o.shape = r.shape and o.k = r.k + 1),
 e as (select shape, ids from r qualify row_number() over (partition by shape order by k desc) = 1)
 select shape, unnest(generate_series(1, len(ids))) as rank, unnest(ids) as gid from e""")
def pick_disjoint(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.select(F.col("l_orderkey").alias("shape"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("gid"), F.col("l_quantity").alias("score"),
                  (F.col("l_discount") * 10).alias("letterness"), F.array(F.col("l_suppkey") % 7, F.col("l_partkey") % 5).alias("members"))
    return rc.pick_disjoint(g)


@query("stratified_sample", """with d as (select doc_id, lang, row_number() over (partition by lang order by md5('0:' || doc_id), doc_id) as k from documents where not regexp_matches(source, '^$'))
 select doc_id, lang from d where lang = 'de' or (lang = 'en' and k <= 40) or (lang = 'fr' and k <= 20)""")
def stratified_sample(spark, sf):
    d = table(spark, sf, "documents")
    return rc.stratified_sample(d, "lang", {"en": 40, "fr": 20}, "doc_id", whole=("de",), blocked=("source", "^$")).select("doc_id", "lang")


@query("train_classifier")
def train_classifier(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features"))
    held = F.xxhash64("vec_id") % 5 == 0
    model = rc.train_classifier(e.where(~held), 20)
    return model.transform(e.where(held)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("int")).alias("top1"))


@query("locate")
def locate(spark, sf):
    """Page rasters searched for one of 25 drawn characters; no SQL: box by box it would score millions of grids."""
    from inkspan.operators.locate import locate as search
    from inkspan.plans.pixel_plans import page_pixels

    k, cell = F.col("n_nationkey"), F.explode(F.sequence(F.lit(0), F.lit(575))).alias("cell")
    drawn = table(spark, sf, "nation").select("n_nationkey", cell)
    ink = (F.floor(((F.col("cell") % 24) * (k + 3) + F.floor(F.col("cell") / 24) * (k + 5)) / 7) % 3 == 0).cast("double")
    t = drawn.groupBy(F.col("n_nationkey").cast("int").alias("tpl")).agg(F.sort_array(F.collect_list(F.struct("cell", ink.alias("v")))).alias("s"))
    t = t.select("tpl", F.chr((F.col("tpl") + 65).cast("bigint")).alias("ch"), (F.lit(0.5) + F.col("tpl") / 25).alias("aspect"), F.transform("s", lambda e: e["v"]).alias("grid"))
    p = page_pixels(spark, sf)
    wanted = table(spark, sf, "pages").select(F.col("page_id").alias("photo_id")).distinct().select("photo_id", F.chr((F.col("photo_id") % 25 + 65).cast("bigint")).alias("ch"))
    out = search(p.where("r < 90").select("photo_id", "w", "h", "x", "y"), wanted, t)
    return out.withColumn("score", F.round("score", 6))
