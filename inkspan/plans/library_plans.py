"""Library, photo and mirror queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import chars
from inkspan.operators import library as lib
from inkspan.plans.inputs import ctes, load, sql_of
from inkspan.plans.registry import query, table

# SQL twins of the character rules, for use inside larger statements.
SQL_MARK_ROWS = ", ".join(
    "('{}', {}, {}, {})".format(k.replace("'", "''"), *[str(x).lower() for x in v]) for k, v in chars.MARK_BOXES.items()
)
SQL_NAME_ROWS = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in chars.MARK_NAMES.items())
SQL_CHARSET_ROWS = ", ".join(
    "('{}', {}, '{}')".format(s, i, c.replace("'", "''")) for s, cs in chars.SECTIONS.items() for i, c in enumerate(cs)
)


def sql_label(k):
    return f"""case when regexp_full_match({k}, '[A-Za-z0-9]{{2,4}}') then {k} || '-liga'
 when regexp_full_match({k}, '[A-Z]') then {k} || '-caps' when regexp_full_match({k}, '[a-z]') then {k} || '-lower'
 when regexp_full_match({k}, '[0-9]') then {k}
 else coalesce((select nm from (values {SQL_NAME_ROWS}) mk(ch, nm) where mk.ch = {k}), 'u' || lower(to_hex(unicode({k})))) end"""


def sql_box(c, what):
    i = {"cls_name": 0, "top": 1, "bottom": 2, "os": 3}[what]
    pick = lambda *v: repr(v[i]) if i == 0 else str(v[i]).lower()
    col = {"cls_name": "'mark'", "top": "mb.t", "bottom": "mb.b", "os": "mb.o"}[what]
    return f"""case when regexp_full_match({c}, '[A-Z0-9]') then {pick('cap', 700, 0, True)}
 when {c} in ('b','d','f','h','k','l') then {pick('asc', 730, 0, True)} when {c} = 't' then {pick('asc', 650, 0, True)}
 when {c} in ('g','p','q','y') then {pick('desc', 490, -210, True)} when {c} = 'j' then {pick('desc', 660, -210, False)}
 when {c} = 'i' then {pick('xh', 660, 0, False)} when regexp_full_match({c}, '[a-z]') then {pick('xh', 490, 0, True)}
 else coalesce((select {col} from (values {SQL_MARK_ROWS}) mb(ch, t, b, o) where mb.ch = {c}), {pick('cap', 700, 0, True)}) end"""


# (key, cls_name, top, bottom, os) for a relation of keys
def sql_classes(keys):
    return f"""(select key, case when length(key) > 1 then 'liga' else max(nm) end as cls_name, max(t) as top, min(b) as bottom, bool_or(o) as os
 from (select key, {sql_box('c', 'cls_name')} as nm, {sql_box('c', 'top')} as t, {sql_box('c', 'bottom')} as b, {sql_box('c', 'os')} as o
 from (select key, unnest(string_split(key, '')) as c from (select distinct key from {keys}) k0) k1) k2 group by key)"""


@query("strip_local", ctes("variants") + "select lib_id, key, vidx, id, advance from variants")
def strip_local(spark, sf):
    v = load(spark, sf, "variants").select("lib_id", "key", "vidx", "id", "advance")
    return lib.strip_local(v.withColumn("thumb", F.lit("t")).withColumn("source", F.lit("s")))


@query("list_photos", ctes("photos") + """select id, name, coalesce(created, '') as created from photos
 where contains(mime, 'image/') or contains(name, '.heic') or contains(name, '.HEIC') or contains(name, '.heif') order by 3 desc, pos""")
def list_photos(spark, sf):
    return lib.list_photos(load(spark, sf, "photos")).select("id", "name", F.coalesce("created", F.lit("")).alias("created"))


def _foldered(spark, sf):
    p = load(spark, sf, "photos")
    return p.withColumn("parents", F.when(F.col("in_inbox"), F.array(F.lit("root"), F.lit("inbox"))).otherwise(F.array(F.lit("root"))))


@query("scan_folder", ctes("photos") + "select id, name, size from photos where in_inbox and not trashed")
def scan_folder(spark, sf):
    return lib.scan_folder(_foldered(spark, sf), "inbox").select("id", "name", "size")


@query("inbox_only", ctes("photos") + "select id, in_inbox as served from photos")
def inbox_only(spark, sf):
    return lib.inbox_only(_foldered(spark, sf), "inbox").select("id", "served")


@query("char_key", r"""select key, count(*) as words from (select case when regexp_full_match(v, '[A-Za-z0-9]{2,4}') then v else right(v, 1) end as key
 from (select regexp_replace(w, '^\s+|\s+$', '', 'g') as v from (select unnest(string_split(text, ' ')) as w from documents) a) b) c group by key""")
def char_key(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(chars.char_key(F.col("w")).alias("key")).agg(F.count(F.lit(1)).alias("words"))


@query("char_class", f"select key, cls_name, top, bottom, os from {sql_classes(sql_of('slots'))} c")
def char_class(spark, sf):
    keys = load(spark, sf, "slots").select("key").distinct()
    return keys.select("key", F.inline(F.array(chars.char_class(F.col("key")))))


@query("char_label", f"""select c, n, {sql_label('c')} as label from (select c, count(*) as n from
 (select unnest(regexp_extract_all(text, '(?s).')) as c from documents union all select key as c from {sql_of('slots')} s) a group by c) b""")
def char_label(spark, sf):
    c = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("c"))
    n = c.unionByName(load(spark, sf, "slots").select(F.col("key").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("label", chars.char_label(F.col("c")))


@query("svg_names", ctes("mirror") + f"""select file_id, name, nullif(regexp_extract(name, '__([a-z0-9]+)\\.svg$', 1, 'i'), '') as svg_id,
 {sql_label('key')} || '__' || id || '.svg' as made from mirror""")
def svg_names(spark, sf):
    return load(spark, sf, "mirror").select(
        "file_id", "name", chars.svg_id_from_name(F.col("name")).alias("svg_id"), chars.svg_file_name(F.col("key"), F.col("id")).alias("made")
    )


@query("photo_stem", r"""select page_id, regexp_replace(lower(url), '\.[a-z0-9]{2,5}$', '') as stem from pages""")
def photo_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", chars.photo_stem(F.col("url")).alias("stem"))


@query("validate_uploads", r"""select event_id, clean_mime, clean_name, clean_thumb, case when not starts_with(clean_mime, 'image/') then 'not an image' when size < 1 then 'empty'
 when size > 4613734 then 'too large' when not regexp_full_match(photo_id, '[A-Za-z0-9_-]{10,}') then 'bad id' end as reason from
 (select event_id, string_split(mime, ';')[1] as clean_mime, size, photo_id, least(2048, greatest(64, case when event_id % 3000 = 0 then 1800 else event_id % 3000 end)) as clean_thumb,
  case when event_id % 17 = 0 then 'photo.jpg' else substr(replace(replace(nm, '/', '_'), '\', '_'), 1, 120) end as clean_name from
 (select event_id, case event_type when 'view' then 'image/png; charset=x' when 'click' then 'image/jpeg' when 'error' then 'text/plain' else 'image/heic' end as mime,
  cast(round(value * 100000) as bigint) as size, event_type || repeat('-', cast(user_id % 8 as int)) || user_id as photo_id, 'a/b\' || event_type || repeat('x', cast(user_id as int)) as nm from events) a) b""")
def validate_uploads(spark, sf):
    e = table(spark, sf, "events")
    up = e.select(
        "event_id",
        F.when(F.col("event_type") == "view", "image/png; charset=x").when(F.col("event_type") == "click", "image/jpeg")
        .when(F.col("event_type") == "error", "text/plain").otherwise("image/heic").alias("mime"),
        F.round(F.col("value") * 100000).cast("bigint").alias("size"),
        F.concat("event_type", F.repeat(F.lit("-"), (F.col("user_id") % 8).cast("int")), F.col("user_id").cast("string")).alias("photo_id"),
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("a/b\\"), "event_type", F.repeat(F.lit("x"), F.col("user_id").cast("int")))).alias("name"),
        (F.col("event_id") % 3000).alias("thumb"),
    )
    return lib.validate_uploads(up).select("event_id", "clean_mime", "clean_name", "clean_thumb", "reason")


@query("valid_svg", r"""select page_id, nm as name from (select page_id, case when page_id % 3 = 0 then url || '.svg' when page_id % 3 = 1 then url || '.svg.bak' else '' end as nm,
 repeat(html, 20) as content from pages) a where nm <> '' and regexp_matches(nm, '\.svg$') and content <> '' and length(content) <= 400000""")
def valid_svg(spark, sf):
    p = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("id"), "page_id", F.repeat("html", F.lit(20)).alias("content"),
        F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".svg"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(".svg.bak"))).otherwise("").alias("name"),
    )
    return lib.valid_svg(p).select("page_id", "name")


@query("case_variants", """select c, v, n from (select c, n, unnest(case when lower(c) in ('c','o','s','u','v','w','x','z','k','y') then list_distinct([c, lower(c), upper(c)]) else [c] end) as v from
 (select c, count(*) as n from (select unnest(regexp_extract_all(text, '(?s).')) as c from documents) a group by c) b) d""")
def case_variants(spark, sf):
    c = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("c"))
    return c.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", F.explode(chars.case_variants(F.col("c"))).alias("v"), "n")


@query("lookalike_class", """select pool, count(*) as n, count(distinct c) as members from (select c, case c when 'ß' then 'SS' when '0' then 'O' when '1' then 'I' when 'l' then 'I' when '|' then 'I' else upper(c) end as pool from
 (select unnest(regexp_extract_all(text, '(?s).')) as c from documents) a) b group by pool""")
def lookalike_class(spark, sf):
    c = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("c"))
    by = c.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    return by.groupBy(chars.lookalike_class(F.col("c")).alias("pool")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("members"))


_SIZES = "sizes as (select lib_id, key, count(*) as n from variants group by lib_id, key)"
_ACTIVE = "act as (select s.lib_id, s.key, s.active, z.n, least(coalesce(s.active, 0), z.n - 1) as idx from slots s join sizes z using (lib_id, key))"


@query("library_counts", ctes("slots", "variants") + f""", {_SIZES} select lib_id, count(*) as slots, cast(coalesce(sum(n), 0) as bigint) as variants,
 count(*) filter (length(key) > 1) as ligatures, min(key) as first_key, max(key) as last_key from slots left join sizes using (lib_id, key) group by lib_id""")
def library_counts(spark, sf):
    return lib.library_counts(load(spark, sf, "slots"), load(spark, sf, "variants"))


@query("charset_coverage", ctes("libraries", "slots", "variants") + f""", {_SIZES}, cs as (select * from (values {SQL_CHARSET_ROWS}) t(section, ord, key))
 select l.lib_id, cs.section, cs.ord, cs.key, s.key is not null as filled, coalesce(z.n, 0) as variants from libraries l cross join cs
 left join slots s on s.lib_id = l.lib_id and s.key = cs.key left join sizes z on z.lib_id = l.lib_id and z.key = cs.key
 union all select s.lib_id, 'Ligatures', null, s.key, true, coalesce(z.n, 0) from slots s left join sizes z using (lib_id, key) where length(s.key) > 1""")
def charset_coverage(spark, sf):
    return lib.charset_coverage(load(spark, sf, "libraries"), load(spark, sf, "slots"), load(spark, sf, "variants"))


@query("active_variant", ctes("slots", "variants") + f""", {_SIZES}, {_ACTIVE}
 select v.lib_id, v.key, v.vidx, v.id from variants v join act a on a.lib_id = v.lib_id and a.key = v.key and a.idx = v.vidx""")
def active_variant(spark, sf):
    return lib.active_variant(load(spark, sf, "slots"), load(spark, sf, "variants")).select("lib_id", "key", "vidx", "id")


@query("rotated_set", ctes("slots", "variants") + f""", {_SIZES}, {_ACTIVE}
 select v.lib_id, v.key, v.vidx, v.id from variants v join act a on a.lib_id = v.lib_id and a.key = v.key and (((a.idx - 5) % a.n) + a.n) % a.n = v.vidx""")
def rotated_set(spark, sf):
    return lib.rotated_set(load(spark, sf, "slots"), load(spark, sf, "variants"), -5).select("lib_id", "key", "vidx", "id")


@query("weight_set", ctes("slots", "variants") + """, tgt as (select lib_id, min(weight) + 0.45::double * (max(weight) - min(weight)) as t from variants group by lib_id),
 d as (select v.lib_id, v.key, v.vidx, v.id, abs(v.weight - t) as d, s.active from variants v join tgt using (lib_id) join slots s using (lib_id, key)),
 b as (select *, min(d) over (partition by lib_id, key) as best from d),
 r as (select *, row_number() over (partition by lib_id, key order by (case when vidx = active then 0 else 1 end), vidx) as rn from b where d <= best + 1e-9)
 select lib_id, key, vidx, id from r where rn = 1""")
def weight_set(spark, sf):
    return lib.weight_set(load(spark, sf, "slots"), load(spark, sf, "variants"), 0.45).select("lib_id", "key", "vidx", "id")


SQL_FINAL = """(select *, case when moved then cx + (x0 - cx) * sc else x0 end as fx0, case when moved then cx + (x1 - cx) * sc else x1 end as fx1,
 case when moved then y0 * sc + nudge_dy else y0 end as fy0, case when moved then y1 * sc + nudge_dy else y1 end as fy1,
 greatest(-120.0::double, lsb + nudge_dl) as flsb, greatest(-120.0::double, rsb + nudge_dr) as frsb,
 cast(greatest(20, floor(greatest(-120.0::double, lsb + nudge_dl) + (case when moved then (cx + (x1 - cx) * sc) - (cx + (x0 - cx) * sc) else x1 - x0 end) + greatest(-120.0::double, rsb + nudge_dr) + 0.5::double)) as bigint) as fadvance
 from (select *, 1 + nudge_scale / 100 as sc, (x0 + x1) / 2 as cx, (nudge_scale <> 0 or nudge_dy <> 0) as moved from variants) fa)"""


@query("finalize_variant", ctes("variants") + f"select id, round(fx0, 6) as fx0, round(fx1, 6) as fx1, round(fy0, 6) as fy0, round(fy1, 6) as fy1, flsb, frsb, fadvance from {SQL_FINAL} f")
def finalize_variant(spark, sf):
    f = lib.finalize_variant(load(spark, sf, "variants"))
    return f.select("id", *[F.round(c, 6).alias(c) for c in ("fx0", "fx1", "fy0", "fy1")], "flsb", "frsb", "fadvance")


def sql_glyph_map(pick="a.idx", maps=""):
    """CTEs ``picked`` .. ``gm`` of the active set, mirrored, with a space."""
    return f"""{_SIZES}, {_ACTIVE},
 base as (select f.lib_id, f.key, case when length(f.key) = 1 then unicode(f.key) end as codepoint, f.key as drawn_key, f.id, f.fadvance as advance, f.flsb as lsb, f.weight
  from {SQL_FINAL} f join act a on a.lib_id = f.lib_id and a.key = f.key and {pick} = f.vidx),
 oth as (select lib_id, case when key = lower(key) then upper(key) else lower(key) end as key, drawn_key, id, advance, lsb, weight from base where regexp_full_match(key, '[A-Za-z]')),
 mir as (select * from base union all select o.lib_id, o.key, unicode(o.key), o.drawn_key, o.id, o.advance, o.lsb, o.weight from oth o where not exists (select 1 from base b where b.lib_id = o.lib_id and b.key = o.key)),
 gm as (select * from mir union all select distinct b.lib_id, ' ', 32, null, null, 340, 0.0::double, null from base b where not exists (select 1 from mir m where m.lib_id = b.lib_id and m.codepoint = 32))"""


@query("glyph_map", ctes("slots", "variants") + f", {sql_glyph_map()} select lib_id, key, codepoint, drawn_key, id, advance, lsb, weight from gm")
def glyph_map(spark, sf):
    return lib.glyph_map(lib.active_variant(load(spark, sf, "slots"), load(spark, sf, "variants")))


@query("mirror_case", ctes("slots", "variants") + f", {sql_glyph_map()} select lib_id, key, codepoint, drawn_key from mir")
def mirror_case(spark, sf):
    picked = lib.active_variant(load(spark, sf, "slots"), load(spark, sf, "variants"))
    gm = lib.glyph_map(picked, mirror_case=False).where(F.col("drawn_key").isNotNull())
    return lib.mirror_case_completion(gm).select("lib_id", "key", "codepoint", "drawn_key")


@query("ensure_space", ctes("slots", "variants") + f", {sql_glyph_map()} select lib_id, key, advance from gm where codepoint = 32")
def ensure_space(spark, sf):
    picked = lib.active_variant(load(spark, sf, "slots"), load(spark, sf, "variants"))
    return lib.glyph_map(picked).where(F.col("codepoint") == 32).select("lib_id", "key", "advance")


@query("ligatures", ctes("slots") + "select lib_id, key, length(key) as len from slots where length(key) > 1 order by lib_id, len desc")
def ligatures(spark, sf):
    return lib.ligatures(load(spark, sf, "slots"))


@query("build_summary", ctes("slots", "variants") + f""", {_SIZES} select lib_id, count(*) filter (length(key) = 1) as characters, count(*) filter (length(key) > 1) as ligatures,
 least(max(n), 4) - 1 as alternate_sets, cast(null as bigint) as weight_pct from slots join sizes using (lib_id, key) group by lib_id""")
def build_summary(spark, sf):
    return lib.build_summary(load(spark, sf, "slots"), load(spark, sf, "variants"))


_DEDUPE = """lead as (select coalesce(name, '') as name, coalesce(size, '') as size, arg_min(id, pos) as id, min(pos) as pos, count(*) as n_copies from photos group by 1, 2),
 cop as (select l.id as leader, p.id, p.pos from photos p join lead l on l.name = coalesce(p.name, '') and l.size = coalesce(p.size, ''))"""
_FORMS = r"""stem as (select regexp_replace(lower(name), '\.[a-z0-9]{2,5}$', '') as stem, arg_min(id, pos) as id from lead where regexp_replace(lower(name), '\.[a-z0-9]{2,5}$', '') <> '' group by 1),
 forms as (select * from (select coalesce(c.leader, s.id) as photo, v.lib_id, v.key, v.id as variant_id from variants v left join cop c on c.id = v.photo_id
  left join stem s on v.photo_name <> '' and s.stem = regexp_replace(lower(v.photo_name), '\.[a-z0-9]{2,5}$', '')) q where photo is not null)"""


@query("dedupe_photos", ctes("photos") + f", {_DEDUPE} select id, name, size, pos, n_copies from lead")
def dedupe_photos(spark, sf):
    return lib.dedupe_photos(load(spark, sf, "photos"))


@query("photo_copies", ctes("photos") + f", {_DEDUPE} select leader, id, pos from cop")
def photo_copies(spark, sf):
    return lib.photo_copies(load(spark, sf, "photos")).select("leader", "id", "pos")


@query("fresh_photos", ctes("photos", "processed") + f", {_DEDUPE} select id, name, n_copies from lead l where not exists (select 1 from cop c join processed p on p.photo_id = c.id where c.leader = l.id)")
def fresh_photos(spark, sf):
    return lib.fresh_photos(load(spark, sf, "photos"), load(spark, sf, "processed")).select("id", "name", "n_copies")


@query("forms_by_photo", ctes("photos", "variants") + f", {_DEDUPE}, {_FORMS} select photo, lib_id, key, variant_id from forms")
def forms_by_photo(spark, sf):
    return lib.forms_by_photo(load(spark, sf, "variants"), load(spark, sf, "photos"))


@query("photo_usage", ctes("photos", "variants", "processed") + f""", {_DEDUPE}, {_FORMS} select l.id, l.name, (select count(*) from forms f where f.photo = l.id) as forms,
 (exists (select 1 from forms f where f.photo = l.id) or exists (select 1 from cop c join processed p on p.photo_id = c.id where c.leader = l.id)) as used from lead l""")
def photo_usage(spark, sf):
    photos, variants = load(spark, sf, "photos"), load(spark, sf, "variants")
    return lib.photo_usage(photos, lib.forms_by_photo(variants, photos), load(spark, sf, "processed"))


_SRC = "case when coalesce(photo_id, '') <> '' then 'i:' || photo_id when coalesce(photo_name, '') <> '' then 'n:' || photo_name end"
_PARENT = "(select lib_id, n % 3 as g, * exclude (lib_id) replace (concat('ph', (n // 5) % 7) as photo_id) from variants)"


def _photo_variants(spark, sf):
    """Variants crowded onto few photos so that duplicate designs occur."""
    v = load(spark, sf, "variants")
    return v.withColumn("photo_id", F.when(F.col("n") % 3 != 0, F.concat(F.lit("ph"), (F.col("n") % 2).cast("string")))).withColumn(
        "photo_name", F.when(F.col("n") % 3 == 0, "wall.jpg"))


_PV = f"""pv as (select v.* exclude (photo_id, photo_name), case when n % 3 <> 0 then 'ph' || (n % 2) end as photo_id, case when n % 3 = 0 then 'wall.jpg' end as photo_name from variants v),
 src as (select *, {_SRC} as src from pv), dup as (select lib_id, key, src, count(*) as designs, min(vidx) as first_vidx, max(vidx) as last_vidx from src where src is not null group by all having count(*) > 1)"""


@query("duplicate_designs", ctes("variants") + f", {_PV} select * from dup")
def duplicate_designs(spark, sf):
    return lib.duplicate_designs(_photo_variants(spark, sf))


def _resolve_sql(keep):
    return ctes("slots", "variants") + f""", {_PV}, kept as (select s.*, d.{keep} as keep from src s left join dup d using (lib_id, key, src) where d.{keep} is null or d.{keep} = s.vidx),
 num as (select *, row_number() over (partition by lib_id, key order by vidx) - 1 as nv from kept),
 zz as (select lib_id, key, count(*) as n, max(case when keep is not null then nv end) as picked from num group by all)
 select num.lib_id, num.key, num.id, num.nv as vidx, coalesce(z.picked, least(greatest(s.active, 0), z.n - 1)) as active from num join zz z using (lib_id, key) join slots s using (lib_id, key)"""


@query("resolve_duplicates_new", _resolve_sql("last_vidx"))
def resolve_duplicates_new(spark, sf):
    s, v = lib.resolve_duplicates(load(spark, sf, "slots"), _photo_variants(spark, sf), "new")
    return v.select("lib_id", "key", "id", "vidx").join(s, ["lib_id", "key"])


@query("resolve_duplicates_old", _resolve_sql("first_vidx"))
def resolve_duplicates_old(spark, sf):
    s, v = lib.resolve_duplicates(load(spark, sf, "slots"), _photo_variants(spark, sf), "old")
    return v.select("lib_id", "key", "id", "vidx").join(s, ["lib_id", "key"])


_MERGE = """fresh as (select i.*, row_number() over (partition by i.lib_id, i.key order by i.vidx) as rn from incoming i where i.has_contours
  and not exists (select 1 from variants v where v.lib_id = i.lib_id and v.key = i.key and v.id = i.id)),
 base as (select lib_id, key, count(*) as base from variants group by all),
 mv as (select lib_id, key, vidx, id from variants union all select f.lib_id, f.key, coalesce(b.base, 0) + f.rn - 1, f.id from fresh f left join base b using (lib_id, key)),
 mn as (select lib_id, key, count(*) as n from mv group by all)"""


@query("merge_libraries", ctes("slots", "variants", "incoming") + f", {_MERGE} select * from mv")
def merge_libraries(spark, sf):
    _, v, _ = lib.merge_libraries((load(spark, sf, "slots"), load(spark, sf, "variants")), (load(spark, sf, "incoming_slots"), load(spark, sf, "incoming")))
    return v.select("lib_id", "key", "vidx", "id")


@query("merge_slots", ctes("slots", "variants", "incoming", "incoming_slots") + f""", {_MERGE}
 select lib_id, key, case when i.key is null then s.active else (case when coalesce(i.active, s.active, 0) < 0 then 0 when coalesce(i.active, s.active, 0) > coalesce(n, 0) - 1 then coalesce(n, 0) - 1 else coalesce(i.active, s.active, 0) end) end as active
 from slots s full join incoming_slots i using (lib_id, key) left join mn using (lib_id, key)""")
def merge_slots(spark, sf):
    s, _, _ = lib.merge_libraries((load(spark, sf, "slots"), load(spark, sf, "variants")), (load(spark, sf, "incoming_slots"), load(spark, sf, "incoming")), prefer_incoming=True)
    return s


@query("merge_added", ctes("slots", "variants", "incoming") + f", {_MERGE} select lib_id, count(*) as added from fresh group by lib_id")
def merge_added(spark, sf):
    _, _, a = lib.merge_libraries((load(spark, sf, "slots"), load(spark, sf, "variants")), (load(spark, sf, "incoming_slots"), load(spark, sf, "incoming")))
    return a


_SETTINGS = """loc as (select c_custkey as lib_id, case when c_custkey % 3 = 0 then 'Untitled' else c_name end as font_name, c_custkey % 2 = 0 as mirror_case, c_mktsegment as tester from customer),
 inc as (select s_suppkey as lib_id, case when s_suppkey % 5 = 0 then '' else s_name end as font_name, case when s_suppkey % 4 <> 0 then s_suppkey % 3 = 0 end as mirror_case, cast(s_nationkey as varchar) as tester from supplier)"""


@query("merge_settings", f"""with {_SETTINGS} select l.lib_id, case when coalesce(i.font_name, '') <> '' and l.font_name = 'Untitled' then i.font_name else l.font_name end as font_name, l.mirror_case, l.tester from loc l left join inc i using (lib_id)""")
def merge_settings(spark, sf, prefer=False):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    local = c.select(F.col("c_custkey").alias("lib_id"), F.when(F.col("c_custkey") % 3 == 0, "Untitled").otherwise(F.col("c_name")).alias("font_name"),
                     (F.col("c_custkey") % 2 == 0).alias("mirror_case"), F.col("c_mktsegment").alias("tester"), F.lit(None).cast("string").alias("design"))
    inc = s.select(F.col("s_suppkey").alias("lib_id"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_name")).alias("font_name"),
                   F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 3 == 0).alias("mirror_case"), F.col("s_nationkey").cast("string").alias("tester"), F.lit(None).cast("string").alias("design"))
    return lib.merge_settings(local, inc, prefer_incoming=prefer).drop("design")


@query("merge_settings_preferred", f"""with {_SETTINGS} select l.lib_id, case when coalesce(i.font_name, '') <> '' then i.font_name else l.font_name end as font_name, coalesce(i.mirror_case, l.mirror_case) as mirror_case, coalesce(i.tester, l.tester) as tester from loc l left join inc i using (lib_id)""")
def merge_settings_preferred(spark, sf):
    return merge_settings(spark, sf, prefer=True)


@query("mark_processed", """select lib_id, photo_id, min(src * 100000000000 + pos) // 100000000000 as src, min(src * 100000000000 + pos) % 100000000000 as pos from
 (select o_custkey as lib_id, o_orderstatus as photo_id, 0 as src, o_orderkey as pos from orders union all
  select user_id, case when event_type = 'error' then '' when event_type = 'view' then 'F' else event_type end, 1, event_id from events) a where photo_id <> '' group by 1, 2""")
def mark_processed(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("lib_id"), F.col("o_orderstatus").alias("photo_id"), F.col("o_orderkey").alias("pos"))
    e = table(spark, sf, "events")
    ids = e.select(F.col("user_id").alias("lib_id"), F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", "F").otherwise(F.col("event_type")).alias("photo_id"), F.col("event_id").alias("pos"))
    return lib.mark_processed(o, ids)


_PLAN = f"""libr as (select lib_id, key, vidx, id, concat('h', n) as hash from variants),
 files as (select *, nullif(regexp_extract(name, '__([a-z0-9]+)\\.svg$', 1, 'i'), '') as pid from mirror2),
 form as (select l.*, {sql_label('key')} || '__' || id || '.svg' as name from libr l),
 plan as (select f.lib_id, 'form' as kind, f.id, f.name, f.key, f.vidx,
   case when not (p.hash is null or p.hash <> f.hash or not exists (select 1 from files x where x.lib_id = f.lib_id and x.pid = f.id)) then 'keep'
    when exists (select 1 from files x where x.lib_id = f.lib_id and x.name = f.name) then 'update' else 'create' end as action
  from form f left join pushed p on p.lib_id = f.lib_id and p.id = f.id
  union all select x.lib_id, 'file', x.file_id, x.name, null, null, case when pid is null then 'ignore' when exists (select 1 from libr l where l.lib_id = x.lib_id and l.id = x.pid) then 'keep' else 'trash' end from files x),
 """


def _plan(spark, sf):
    v = load(spark, sf, "variants").select("lib_id", "key", "vidx", "id", F.concat(F.lit("h"), F.col("n").cast("string")).alias("hash"))
    m = load(spark, sf, "mirror").withColumn("name", F.when(F.col("n") % 2 == 0, F.regexp_replace("name", "^x", chars.char_label(F.col("key")))).otherwise(F.col("name")))
    m = m.withColumn("name", F.when((F.col("n") % 2 == 0) & F.col("name").endswith(F.concat(F.lit("__"), F.col("id"), F.lit(".svg"))), chars.svg_file_name(F.col("key"), F.col("id"))).otherwise(F.col("name")))
    return lib.mirror_plan(v, m.select("lib_id", "file_id", "name"), load(spark, sf, "pushed"))


_M2 = f"mirror2 as (select lib_id, file_id, n, key, id, case when n % 2 = 0 and starts_with(name, 'x__') then {sql_label('key')} || '__' || id || '.svg' else name end as name from mirror), "


@query("mirror_plan", ctes("variants", "mirror", "pushed") + f", {_M2} {_PLAN} fin as (select * from plan) select lib_id, kind, id, name, key, vidx, action from fin")
def mirror_plan(spark, sf):
    return _plan(spark, sf)


@query("push_batches", ctes("variants", "mirror", "pushed") + f""", {_M2} {_PLAN} snd as (select * from plan where kind = 'form' and action <> 'keep')
 select lib_id, id, action, cast(ceil(row_number() over (partition by lib_id order by key, vidx) / 8) as bigint) as batch from snd
 union all select distinct lib_id, null, null, 1 from plan p where kind = 'form' and not exists (select 1 from snd where snd.lib_id = p.lib_id)""")
def push_batches(spark, sf):
    return lib.push_batches(_plan(spark, sf))
