"""Corpus tokenising and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import library as lib
from inkspan.operators import outlines as ol
from inkspan.operators import text as tx
from inkspan.operators import typeset as ts
from inkspan.plans.inputs import ctes, load, load_outlines
from inkspan.plans.library_plans import SQL_FINAL, _SIZES
from inkspan.plans.registry import query, table
from inkspan.session import cut_lineage

_TOK = """pat as (select lib_id, '(?s)(' || string_agg(key, '|' order by length(key) desc, key) || '|.)' as p from slots where length(key) > 1 group by lib_id),
 lns as (select doc_id, lib_id, unnest(string_split(text, chr(10))) as lt, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from docs),
 tk0 as (select doc_id, l.lib_id, line, case when lt = '' then [null] else regexp_extract_all(lt, coalesce(p, '(?s)(.)'), 1) end as ks from lns l left join pat using (lib_id)),
 tok as materialized (select doc_id, lib_id, line, unnest(ks) as key, generate_subscripts(ks, 1) - 1 as pos from tk0)"""

_MAPS = f"""{_SIZES}, nm as (select lib_id, least(max(n), 4) as n_maps from sizes group by lib_id),
 pk as (select s.lib_id, s.key, m.map_no, nm.n_maps, (least(coalesce(s.active, 0), z.n - 1) + m.map_no) % z.n as vidx from slots s join sizes z using (lib_id, key)
  join nm using (lib_id) join (values (0), (1), (2), (3)) m(map_no) on m.map_no < nm.n_maps),
 mb as (select p.lib_id, p.map_no, p.n_maps, p.key, f.id, f.fadvance as advance, f.flsb as lsb from pk p join {SQL_FINAL} f using (lib_id, key, vidx)),
 mo as (select lib_id, map_no, n_maps, case when key = lower(key) then upper(key) else lower(key) end as key, id, advance, lsb from mb where regexp_full_match(key, '[A-Za-z]')),
 mm as (select * from mb union all select o.* from mo o where not exists (select 1 from mb b where b.lib_id = o.lib_id and b.map_no = o.map_no and b.key = o.key)),
 maps as materialized (select * from mm union all select distinct lib_id, map_no, n_maps, ' ', null, 340, 0.0::double from mb)"""

_PLACE = """occ as materialized (select t.*, row_number() over (partition by doc_id, key order by line, pos) - 1 as occ, coalesce(n_maps, 1) as nmp from tok t left join nm using (lib_id)),
 plc as materialized (select o.doc_id, o.lib_id, o.line, o.pos, o.key, m.id, m.advance, m.key is not null as known, lag(m.id) over (partition by o.doc_id, o.line order by o.pos) as prev_id
  from occ o left join maps m on m.lib_id = o.lib_id and m.map_no = o.occ % o.nmp and m.key = o.key)"""


def sql_flat(src, seg, name):
    """CTEs {name}: (id, contour, i, x, y) polygons of cubic rows."""
    d = lambda a, b: f"sqrt((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a}))"
    bern = lambda v: f"(m*m*m) * {v}0 + (3.0::double * m*m*t) * {v}1 + (3.0::double * m*t*t) * {v}2 + (t*t*t) * {v}3"
    return f"""{name}_n as (select *, cast(greatest(2, ceil(({d(0, 1)} + {d(1, 2)} + {d(2, 3)}) / {float(seg)}::double) + 1) as bigint) as steps from {src}),
 {name}_e as (select *, unnest(generate_series(1, steps)) as k from {name}_n),
 {name}_s as (select id, contour, seg, k, {bern('x')} as x, {bern('y')} as y from (select *, k::double / steps as t, 1.0::double - k::double / steps as m from {name}_e) q),
 {name}_a as (select id, contour, -1 as seg, 0 as k, x0 as x, y0 as y from {src} where seg = 0 union all select * from {name}_s),
 {name}_i as (select id, contour, x, y, row_number() over (partition by id, contour order by seg, k) - 1 as i, count(*) over (partition by id, contour) as cnt from {name}_a),
 {name} as (select id, contour, i, x, y, cnt - 1 as n from {name}_i where i < cnt - 1)"""


def sql_edges(pts, name):
    return f"""{name} as (select a.id, a.contour, a.i, a.x as ax, a.y as ay, b.x as ex, b.y as ey from {pts} a join {pts} b on a.id = b.id and a.contour = b.contour and b.i = (a.i + 1) % a.n)"""


_PROF = sql_flat("outlines", 6, "fl") + ", " + sql_edges("fl", "ed") + """,
 bb as (select id, min(x) as bx0, max(x) as bx1 from fl group by id),
 ln as (select id, ax, ay, ex, ey, unnest(generate_series(cast(ceil((least(ay, ey) - 0.5::double) / 10) as bigint), cast(ceil((greatest(ay, ey) - 0.5::double) / 10) as bigint) - 1)) as row from ed),
 ext as (select id, row, min(ax + (row * 10 + 0.5::double - ay) / (ey - ay) * (ex - ax)) as lo, max(ax + (row * 10 + 0.5::double - ay) / (ey - ay) * (ex - ax)) as hi from ln group by id, row),
 adv as (select id, fadvance as advance, flsb as lsb from """ + SQL_FINAL + """ f),
 mg as (select e.id, row, cast(cast(lsb + (lo - bx0) as float) as double) as ml, cast(cast(advance - (lsb + (hi - bx0)) as float) as double) as mr from ext e join bb using (id) join adv using (id)),
 band as materialized (select id, row + o.o as row, min(ml) as ml, min(mr) as mr from mg cross join (values (-5),(-4),(-3),(-2),(-1),(0),(1),(2),(3),(4),(5)) o(o) group by 1, 2),
 sd as (select id, lsb as plsb, advance - (lsb + bx1 - bx0) as prsb from bb join adv using (id)),
 prs as (select distinct prev_id as lft, id as rgt from plc where prev_id is not null and id is not null),
 gap as (select p.lft, p.rgt, min(a.mr + b.ml) as gap from prs p join band a on a.id = p.lft join band b on b.id = p.rgt and b.row = a.row group by 1, 2),
 kk as (select p.lft, p.rgt, gap, a.prsb + b.plsb as facing from prs p join sd a on a.id = p.lft join sd b on b.id = p.rgt left join gap using (lft, rgt)),
 k2 as (select lft, rgt, floor(greatest(case when gap > facing then -0.7::double * (gap - facing) when gap < greatest(20.0::double, 0.3::double * facing) then greatest(20.0::double, 0.3::double * facing) - gap else 0.0::double end, -400.0::double) + 0.5::double) as k, gap from kk),
 kern as materialized (select lft, rgt, cast(case when gap is null or abs(k) < 8 then 0 else k end as bigint) as kern from k2)"""

# every ordered pair of a library's drawings instead of the pairs that meet in the corpus; bands meet within the library, line by line
_EVERY = _PROF.replace(
    "prs as (select distinct prev_id as lft, id as rgt from plc where prev_id is not null and id is not null)",
    "prs as (select distinct a.id as lft, b.id as rgt from variants a join variants b using (lib_id)), lb as materialized (select distinct v.lib_id, b.* from band b join variants v using (id))",
).replace("from prs p join band a on a.id = p.lft join band b on b.id = p.rgt and b.row = a.row group by 1, 2", "from lb a join lb b on b.lib_id = a.lib_id and b.row = a.row group by 1, 2").replace(
    "gap as (select p.lft, p.rgt,", "gap as (select a.id as lft, b.id as rgt,"
)

_LINES = """mv as (select p.*, coalesce(k.kern, 0) as kern from plc p left join kern k on k.lft = p.prev_id and k.rgt = p.id),
 lw as (select doc_id, line, count(key) as tokens, cast(sum(case when key is not null and not known then 1 else 0 end) as bigint) as missing,
  cast(sum(case when key is null then 0 else kern + case when known then advance else 380 end end) as bigint) as units from mv group by 1, 2),
 lnw as (select *, units * 0.112::double + tokens * (0.02::double * 112) as width from lw)"""

_BASE = ctes("docs", "slots", "variants", "outlines") + f", {_TOK}, {_MAPS}, {_PLACE}"
_FULL = f"{_BASE}, {_PROF}, {_LINES}"


def tokens(spark, sf):
    return tx.tokenize(load(spark, sf, "docs"), lib.ligatures(load(spark, sf, "slots")))


def maps(spark, sf):
    return lib.glyph_maps(load(spark, sf, "slots"), load(spark, sf, "variants"))


def cycled_tokens(spark, sf, m):
    docs = tx.with_maps(load(spark, sf, "docs"), m)
    return tx.tokenize(docs, lib.ligatures(load(spark, sf, "slots")), keep=("n_maps",))


def placed(spark, sf):
    m = cut_lineage(maps(spark, sf))
    return tx.place_glyphs(cycled_tokens(spark, sf, m), m)


def kern_inputs(spark, sf):
    """Profiles of every library drawing, with its finalised advance and bearing."""
    f = lib.finalize_variant(load(spark, sf, "variants")).select("id", F.col("fadvance").alias("advance"), F.col("flsb").alias("lsb"))
    o = load_outlines(spark, sf, "outlines", ("id", "lib_id"))
    return ol.side_profiles(o.join(f, "id"))


def corpus(spark, sf):
    """Texts, ligatures and glyph maps."""
    return load(spark, sf, "docs"), lib.ligatures(load(spark, sf, "slots")), cut_lineage(maps(spark, sf))


def kerned(spark, sf):
    """The corpus and the kerns of the pairs that meet in it."""
    c = corpus(spark, sf)
    met = cut_lineage(ts.pairs_met(*c))
    return c, ol.kern_pairs(kern_inputs(spark, sf), met)


@query("tokenize", ctes("docs", "slots") + f", {_TOK} select doc_id, line, count(key) as tokens, count(*) filter (length(key) > 1) as ligatures, min(key) as k0, max(key) as k1 from tok group by 1, 2")
def tokenize(spark, sf):
    return tokens(spark, sf).groupBy("doc_id", "line").agg(
        F.count("key").alias("tokens"), F.count(F.when(F.length("key") > 1, 1)).alias("ligatures"), F.min("key").alias("k0"), F.max("key").alias("k1")
    )


@query("missing_glyphs", ctes("docs", "slots", "variants") + f""", {_TOK}, {_MAPS}, seen as (select doc_id, lib_id, key, min(line * 1000000 + pos) as f from tok where key is not null and key <> ' ' group by 1, 2, 3),
 ab as (select s.* from seen s where not exists (select 1 from maps m where m.map_no = 0 and m.lib_id = s.lib_id and m.key = s.key)),
 r as (select doc_id, key, row_number() over (partition by doc_id order by f) as ord from ab) select doc_id, ord, key from r""")
def missing_glyphs(spark, sf):
    m = maps(spark, sf).where(F.col("map_no") == 0)
    return tx.missing_glyphs(tokens(spark, sf), m)


@query("variant_slots", ctes("docs", "slots", "variants") + f", {_TOK}, {_MAPS}, {_PLACE} select doc_id, key, occ % nmp as map_no, count(*) as n, max(occ) as last_occ from occ where key is not null group by 1, 2, 3")
def variant_slots(spark, sf):
    t = tx.variant_slots(cycled_tokens(spark, sf, maps(spark, sf)).where(F.col("key").isNotNull()))
    return t.groupBy("doc_id", "key", "map_no").agg(F.count(F.lit(1)).alias("n"), F.max("occ").alias("last_occ"))


@query("kern_pairs", ctes("variants", "outlines") + f", {_EVERY} select lft, rgt, kern from kern")
def kern_pairs(spark, sf):
    return ol.all_kerns(kern_inputs(spark, sf), load(spark, sf, "variants")).select("lft", "rgt", "kern")


@query("line_widths", _FULL + " select doc_id, line, tokens, missing, units, round(width, 4) as width from lnw")
def line_widths(spark, sf):
    c, k = kerned(spark, sf)
    return ts.line_widths(*c, k).withColumn("width", F.round("width", 4))


@query("specimen_size", _FULL + """ select *, round((lines - 1) * (112 * 1.05::double) + 112 * 1.05::double, 4) as height, cast(greatest(4, ceil(round(w0 + 78, 6))) as bigint) as page_w,
 cast(greatest(4, ceil(round((lines - 1) * (112 * 1.05::double) + 112 * 1.05::double + 78, 6))) as bigint) as page_h from (select doc_id, max(line) + 1 as lines, round(max(width), 4) as width, max(width) as w0, cast(sum(tokens) as bigint) as tokens, cast(sum(missing) as bigint) as missing from lnw group by doc_id) q""".replace("select *,", "select doc_id, lines, width, tokens, missing,"))
def specimen_size(spark, sf):
    c, k = kerned(spark, sf)
    return tx.specimen_size(ts.line_widths(*c, k)).withColumn("width", F.round("width", 4)).withColumn("height", F.round("height", 4))


@query("align_shift", _FULL + """, pg as (select doc_id, cast(greatest(4, ceil(round(max(width) + 78, 6))) as bigint) as page_w from lnw group by 1)
 select doc_id, line, round((page_w - width) / 2.0, 4) as mid, round(page_w - 39 - width, 4) as far from lnw join pg using (doc_id)""")
def align_shift(spark, sf):
    c, k = kerned(spark, sf)
    lines = cut_lineage(ts.line_widths(*c, k))
    pages = tx.specimen_size(lines)
    mid = tx.align_shift(lines, pages, "center").select("doc_id", "line", "width", "page_w", F.round("shift", 4).alias("mid"))
    return mid.select("doc_id", "line", "mid", F.round(F.col("page_w") - 39.0 - F.col("width"), 4).alias("far"))


@query("layout", _FULL + """, xs as (select doc_id, line, pos, key, id, units_before * 0.112::double + (rn - 1) * (0.02::double * 112) as x from (select *, sum(case when key is null then 0 else kern + case when known then advance else 380 end end) over w
  - (case when known then advance else 380 end) as units_before, row_number() over w as rn from mv window w as (partition by doc_id, line order by pos)) q where key is not null)
 select doc_id, line, count(*) as glyphs, round(max(x), 3) as last_x, round(min(x), 3) as first_x, count(id) as drawn, round(sum(floor(x * 1000 + 0.5::double)) / 1000, 2) as sum_x from xs group by 1, 2""")
def layout(spark, sf):
    c, k = kerned(spark, sf)
    laid = ts.layout(*c, k)
    return laid.groupBy("doc_id", "line").agg(
        F.count(F.lit(1)).alias("glyphs"), F.round(F.max("x"), 3).alias("last_x"), F.round(F.min("x"), 3).alias("first_x"), F.count("id").alias("drawn"),
        F.round(F.sum(F.floor(F.col("x") * 1000 + 0.5)) / 1000, 2).alias("sum_x"),
    )


_MK = "mk as (select doc_id, chr, round(sum(m) / 1000.0, 3)::double as manual from (select user_id as doc_id, event_id % 200 as chr, floor((value - 20) + 0.5::double) as m from events) e group by 1, 2)"


@query("apply_kerns", _BASE + f""", {_MK}, ci as (select doc_id, line, pos, key, sum(coalesce(length(key), 0)) over (partition by doc_id order by line, pos rows unbounded preceding) - coalesce(length(key), 0) + line as chr from tok)
 select c.doc_id, c.line, c.pos, c.key, cast(c.chr as bigint) as chr, k.manual from ci c join mk k on k.doc_id = c.doc_id and k.chr = c.chr where k.manual <> 0""")
def apply_kerns(spark, sf):
    e = table(spark, sf, "events")
    kerns = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 200).alias("chr"), (F.floor((F.col("value") - 20) + 0.5) / 1000.0).alias("em"))
    docs = load(spark, sf, "docs").join(kerns.select("doc_id").distinct(), "doc_id", "left_semi")  # other texts have no move
    out = tx.apply_kerns(tx.tokenize(docs, lib.ligatures(load(spark, sf, "slots"))), kerns, moved=True)
    return out.select("doc_id", "line", "pos", "key", F.col("chr").cast("bigint").alias("chr"), "manual")
