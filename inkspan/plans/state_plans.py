"""Command-log, burst, queue and document queries, plus point transforms and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import geometry as geo
from inkspan.plans.inputs import ctes, load
from inkspan.plans.registry import query, table
from inkspan.sources.library_json import parse_documents, to_documents
from inkspan.streaming import flows, folds


def commands(spark, sf):
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    op = F.when(F.col("event_id") % 97 == 0, "clear_all").when(F.col("event_type") == "click", "set_active").when(F.col("event_type") == "error", "delete_variant").otherwise("add_variant")
    return e.select(F.col("user_id").cast("string").alias("lib_id"), F.chr((k % 7 + 97).cast("bigint")).alias("key"), "ts", F.col("event_id").alias("seq"), op.alias("op"),
                    (k % 4).alias("idx"), F.col("event_id").cast("string").alias("payload"))


@query("library_state", """with recursive c as (select user_id::varchar as lib_id, chr(97 + k % 7) as key, ts, event_id, case when event_id % 97 = 0 then 'clear' when event_type = 'click' then 'set' when event_type = 'error' then 'del' else 'add' end as op, k % 4 as idx from (select *, regexp_extract(props, '([0-9]+)', 1)::int as k from events) e),
 cl as (select lib_id, max(ts) as t from c where op = 'clear' group by 1), o as materialized (select c.*, row_number() over (partition by c.lib_id, key order by ts, event_id) as rn from c left join cl using (lib_id) where op <> 'clear' and (t is null or ts > t)),
 s as (select distinct lib_id, key, 0::bigint as rn, 0::bigint as n, 0::bigint as a from o union all
  select s.lib_id, s.key, o.rn, case op when 'add' then n + 1 when 'del' then case when idx < n then n - 1 else n end else n end,
   case when op = 'add' then n when n = 0 then 0 when op = 'set' then least(idx, n - 1) when idx < n then greatest(0, least(a, n - 2)) else least(a, n - 1) end from s join o on o.lib_id = s.lib_id and o.key = s.key and o.rn = s.rn + 1)
 select lib_id, key, n, a as active from s qualify row_number() over (partition by lib_id, key order by rn desc) = 1 and n > 0""".replace(" qualify row_number() over (partition by lib_id, key order by rn desc) = 1 and n > 0", " where (lib_id, key, rn) in (select (lib_id, key, max(rn)) from o group by lib_id, key) and n > 0"))
def library_state(spark, sf):
    return folds.library_state(commands(spark, sf)).select("lib_id", "key", "n", "active")


@query("library_settings", """select user_id::varchar as lib_id, arg_max(substr(event_type || repeat('-', (event_id % 60)::int), 1, 40), event_id) as font_name from events where event_type <> 'error' group by 1""")
def library_settings(spark, sf):
    e = table(spark, sf, "events")
    c = e.select(F.col("user_id").cast("string").alias("lib_id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "set_active").otherwise("set_font_name").alias("op"),
                 F.concat("event_type", F.repeat(F.lit("-"), (F.col("event_id") % 60).cast("int"))).alias("payload"))
    return folds.library_settings(c).select("lib_id", "font_name")


@query("processed_photos", """select user_id::varchar as lib_id, 'ph' || event_id % 23 as photo_id, min(event_id) as first_seq from events where event_type = 'view' and event_id % 5 <> 0 group by 1, 2""")
def processed_photos(spark, sf):
    e = table(spark, sf, "events")
    photo = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("ph"), (F.col("event_id") % 23).cast("string")))
    c = e.select(F.col("user_id").cast("string").alias("lib_id"), F.lit(0).alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "mark_processed").otherwise("set_active").alias("op"), photo.alias("payload"))
    return folds.processed_photos(c).select("lib_id", "photo_id", F.col("first.seq").alias("first_seq"))


@query("patched_settings", """with p as (select user_id::varchar as lib_id, case when event_type = 'click' then 'tester' else 'design' end as target, 'c' || event_id % 5 as name, case when event_id % 7 <> 0 then 'v' || event_id end as value, ts, event_id from events where event_type in ('click', 'view'))
 select lib_id, target, name, value from p qualify row_number() over (partition by lib_id, target, name order by ts desc, event_id desc) = 1 and (target <> 'design' or value is not null)""")
def patched_settings(spark, sf):
    e = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 7 == 0, "null").otherwise(F.concat(F.lit('"v'), F.col("event_id").cast("string"), F.lit('"')))
    op = F.when(F.col("event_type") == "click", "update_tester").when(F.col("event_type") == "view", "update_design").otherwise("set_active")
    c = e.select(F.col("user_id").cast("string").alias("lib_id"), "ts", F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit('{"c'), (F.col("event_id") % 5).cast("string"), F.lit('": '), value, F.lit("}")).alias("payload"))
    return folds.patched_settings(c)


@query("bursts", """with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 6 hours then 0 else 1 end as b from events window w as (partition by user_id order by ts)), r as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from g)
 select user_id, min(ts) as first, max(ts) + interval 6 hours as fires, count(*) as changes from r group by user_id, s""")
def bursts(spark, sf):
    return flows.bursts(table(spark, sf, "events"), "6 hours", "user_id")


@query("review_queue")
def review_queue(spark, sf):
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "click", "open_now").when(F.col("event_type") == "error", "skip").when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "view", "next_candidate").otherwise("enqueue")
    photo = F.concat(F.lit("ph"), (F.col("event_id") % 40).cast("string"))
    return folds.review_queue(e.select(F.col("user_id").cast("string").alias("reviewer"), "ts", F.col("event_id").alias("seq"), op.alias("op"), photo.alias("photo_id"), F.array(photo).alias("copies"), (F.col("event_id") % 4 + 1).alias("candidates")))


@query("library_documents", ctes("variants", "slots") + "select v.lib_id, v.key, v.vidx, v.id, v.advance, s.active, v.photo_id, v.nudge_dy from variants v join slots s using (lib_id, key)")
def library_documents(spark, sf):
    slots, v = load(spark, sf, "slots"), load(spark, sf, "variants")
    settings = load(spark, sf, "libraries").select("lib_id", F.lit("Wall").alias("font_name"), F.lit(True).alias("mirror_case"), F.lit(None).cast("string").alias("tester"), F.lit(None).cast("string").alias("design"))
    processed = v.where("photo_id is not null").groupBy("lib_id", "photo_id").agg(F.min("n").alias("pos"))
    s2, v2, _, _ = parse_documents(to_documents(slots, v, settings, processed))
    return v2.select("lib_id", "key", "vidx", "id", "advance", "photo_id", "nudge_dy").join(s2, ["lib_id", "key"])


_MAT = ["1 + l_quantity / 50", "(l_partkey % 7) / 10", "l_suppkey % 11", "(l_partkey % 5) / 20", "1 + (l_suppkey % 9) / 30", "l_partkey % 13", "(l_partkey % 3) / 1000", "(l_suppkey % 4) / 900", "1"]
_INV = ["e * i - f * h", "c * h - b * i", "b * f - c * e", "f * g - d * i", "a * i - c * g", "c * d - a * f", "d * h - e * g", "b * g - a * h"]


@query("inv3", "with m as (select l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"cast({e} as double) as {c}" for e, c in zip(_MAT, "abcdefghi", strict=True)) + " from lineitem), n as (select *, a * e - b * d as last, a * (e * i - f * h) + b * (f * g - d * i) + c * (d * h - e * g) as det from m) select l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"case when abs(det) > 1e-12 and abs(last) > 1e-12 then cast(floor(({e}) / last * 1000000 + .5::double) as bigint) end as v{k}" for k, e in enumerate(_INV)) + " from n")
def inv3(spark, sf):
    m = [F.expr(f"cast({e} as double)") for e in _MAT]
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geo.inv3(m).alias("v"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.floor(F.get("v", F.lit(k)) * 1000000 + 0.5).alias(f"v{k}") for k in range(8)])


@query("apply_h", "select l_orderkey, l_linenumber, l_partkey, round((2 * l_quantity + .1 * l_partkey + 5) / (.001 * l_quantity + .0001 * l_partkey + 1), 5) as u, round((.2 * l_quantity + 1.5 * l_partkey - 3) / (.001 * l_quantity + .0001 * l_partkey + 1), 5) as v from lineitem")
def apply_h(spark, sf):
    u, v = geo.apply_h((2.0, 0.1, 5.0, 0.2, 1.5, -3.0, 0.001, 0.0001), F.col("l_quantity"), F.col("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


_PQ = """p as (select l_orderkey, l_linenumber, l_partkey, 900 + l_suppkey % 100 as fw, 700 + l_partkey % 100 as fh, l_partkey % 700 as cx, l_suppkey * 5 % 500 as cy, 20 + l_quantity as cw, 30 + l_quantity as ch, (l_linenumber * 3 - 9)::double as ang from lineitem),
 q as (select *, floor(greatest(cw, ch) * .15::double + .5) as pad from p), r as (select *, greatest(0, cx - pad) as x0, greatest(0, cy - pad) as y0, least(fw, cx + cw + pad) as x1, least(fh, cy + ch + pad) as y1, cos(radians(-ang)) as co, sin(radians(-ang)) as si from q),
 d as (select *, co * co - si * si as det, (fw * abs(co) - fh * abs(si)) / (co * co - si * si) as pw, (fh * abs(co) - fw * abs(si)) / (co * co - si * si) as ph from r)"""


def _corner(x, y):
    a = f"(({x} - fw / 2) * co + ({y} - fh / 2) * si + pw / 2) / pw"
    b = f"(-({x} - fw / 2) * si + ({y} - fh / 2) * co + ph / 2) / ph"
    return a, b


_QC = [c for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")) for c in _corner(x, y)]


@query("photo_quad", f"with {_PQ} select l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"case when det > .2 and pw > 0 and ph > 0 and x1 - x0 >= 1 and y1 - y0 >= 1 then round({c}, 3) end as q{i}" for i, c in enumerate(_QC)) + " from d")
def photo_quad(spark, sf):
    li = table(spark, sf, "lineitem")
    c = li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 100 + 900).alias("fw"), (F.col("l_partkey") % 100 + 700).alias("fh"), (F.col("l_partkey") % 700).alias("cx"), (F.col("l_suppkey") * 5 % 500).alias("cy"),
                  (F.col("l_quantity") + 20).alias("cw"), (F.col("l_quantity") + 30).alias("ch"), (F.col("l_linenumber") * 3 - 9).cast("double").alias("angle"))
    q = geo.photo_quad(c, digits=None)
    return q.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col("quad")[i], 3).alias(f"q{i}") for i in range(8)])
