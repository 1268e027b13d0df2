"""Operator inputs derived from the given tables.

Each input is one SELECT that reads the same in Spark SQL and DuckDB, so a query and its SQL
twin start from the same rows. A library holds 256 parts; every library, photo and
document set grows with its source table.
"""

from __future__ import annotations

from inkspan.plans.registry import table

INPUTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def _input(name, sql, *tables):
    INPUTS[name] = (" ".join(sql.split()), tables)


KEY = """case when s < 94 then chr(33 + s) when s = 94 then 'ar' when s = 95 then 'th' when s = 96 then 'er'
 when s = 97 then 'tion' when s = 98 then 'an' else 'en' end"""

_input("drawn", f"""
 select concat('L', cast(cast(floor(p_partkey / 256) as bigint) as varchar(20))) as lib_id, {KEY} as key, p_partkey as n,
  concat('v', cast(p_partkey as varchar(20))) as id, s, p_size as sz from
  (select p_partkey, p_size, cast((p_partkey * 7 + p_size) % 100 as int) as s from part) q""", "part")

_input("variants", """
 select lib_id, key, cast(row_number() over (partition by lib_id, key order by n) - 1 as int) as vidx, id, n, sz,
  cast(30 + (n * 13) % 61 as double) as lsb, cast(30 + (n * 17) % 53 as double) as rsb,
  cast(30 + (n * 13) % 61 + 30 + (n * 17) % 53 + 200 + 8 * sz as bigint) as advance,
  cast((n * 37) % 500 as double) / 1000 as weight,
  cast((n % 4) * 3 as double) as nudge_scale, cast((n % 3) * 5 as double) as nudge_dy,
  cast((n % 5) - 2 as double) as nudge_dl, cast((n % 7) - 3 as double) as nudge_dr,
  case when n % 3 = 0 then concat('ph', cast((n * 11) % 397 as varchar(20))) end as photo_id,
  case when n % 5 <> 0 then concat('IMG_', cast((n * 11) % 397 as varchar(20)), '.HEIC') end as photo_name,
  cast(0 as double) as x0, cast(-210 * (n % 2) as double) as y0, cast(200 + 8 * sz as double) as x1,
  cast(500 + 10 * (n % 21) as double) as y1, n % 11 <> 0 as has_contours
 from {drawn} d""")

_input("slots", """
 select lib_id, key, cast(max(n) % 4 as int) as active from {drawn} d group by lib_id, key""")

_input("libraries", "select distinct lib_id from {drawn} d")

_input("docs", """
 select doc_id, concat('L', cast(cast(floor(doc_id / 128) as bigint) as varchar(20))) as lib_id, text from documents""", "documents")

_input("photos", """
 select concat('ph', cast(page_id as varchar(20))) as id, page_id as pos,
  concat('IMG_', cast(cast(floor(length(html) / 40) as bigint) as varchar(20)), case when page_id % 2 = 0 then '.HEIC' else '.jpg' end) as name,
  cast(cast(floor(length(html) / 400) as bigint) as varchar(20)) as size,
  case when page_id % 4 = 0 then '' when page_id % 7 = 0 then 'text/html' else 'image/jpeg' end as mime,
  case when page_id % 13 = 0 then null else concat('2026-0', cast(1 + page_id % 9 as varchar(20))) end as created,
  page_id % 5 <> 0 as in_inbox, page_id % 6 = 0 as trashed from pages""", "pages")

_input("processed", """
 select distinct concat('ph', cast((o_orderkey * 3) % 1009 as varchar(20))) as photo_id from orders where o_orderstatus = 'P' and (o_orderkey * 3) % 1009 % 2 = 1""", "orders")

# a second library revision: other parts of the same slots, some ids shared
_input("incoming", """
 select lib_id, key, cast(row_number() over (partition by lib_id, key order by n desc, z) - 1 as int) as vidx, id, n, sz,
  lsb, rsb, advance, weight, nudge_scale, nudge_dy, nudge_dl, nudge_dr, photo_id, photo_name, x0, y0, x1, y1, has_contours
 from (select v.*, 0 as z from {variants} v where n % 3 = 0
  union all select v.lib_id, v.key, v.vidx, concat(v.id, 'x') as id, v.n, v.sz, v.lsb, v.rsb, v.advance, v.weight, v.nudge_scale,
   v.nudge_dy, v.nudge_dl, v.nudge_dr, v.photo_id, v.photo_name, v.x0, v.y0, v.x1, v.y1, v.has_contours, 1 as z from {variants} v where n % 4 = 1) u""")

_input("incoming_slots", "select lib_id, key, cast(max(n) % 3 as int) as active from {incoming} i group by lib_id, key")

_input("mirror", """
 select lib_id, concat('f', cast(n as varchar(20))) as file_id,
  case when n % 10 = 3 then concat('stray', cast(n as varchar(20)), '.svg')
       when n % 10 = 4 then concat('old__', 'gone', cast(n as varchar(20)), '.svg')
       when n % 10 = 5 then concat('B-caps__', id, '.SVG')
       else concat('x__', id, '.svg') end as name, n, key, id from {drawn} d where n % 10 < 7""")

_input("pushed", """
 select lib_id, id, case when n % 6 = 0 then 'stale' else concat('h', cast(n as varchar(20))) end as hash from {drawn} d where n % 5 <> 0""")


def _template():
    """Unit shapes as cubics: a wedge on its base, an ellipse, a frame with a counter, a wedge on its tip."""
    rows = []

    def ring(shape, contour, pts):
        for i, (ax, ay) in enumerate(pts):
            bx, by = pts[(i + 1) % len(pts)]
            rows.append((shape, contour, i, ax, ay, ax + (bx - ax) / 3, ay + (by - ay) / 3, ax + 2 * (bx - ax) / 3, ay + 2 * (by - ay) / 3, bx, by))

    k = 0.27614235
    ring(0, 0, [(0, 0), (1, 0), (0.5, 1)])
    ring(3, 0, [(0, 1), (0.5, 0), (1, 1)])
    ring(2, 0, [(0, 0), (1, 0), (1, 1), (0, 1)])
    ring(2, 1, [(0.2, 0.2), (0.2, 0.8), (0.8, 0.8), (0.8, 0.2)])
    for i, c in enumerate([
        (1, 0.5, 1, 0.5 + k, 0.5 + k, 1, 0.5, 1), (0.5, 1, 0.5 - k, 1, 0, 0.5 + k, 0, 0.5),
        (0, 0.5, 0, 0.5 - k, 0.5 - k, 0, 0.5, 0), (0.5, 0, 0.5 + k, 0, 1, 0.5 - k, 1, 0.5),
    ]):
        rows.append((1, 0, i, *c))
    return ", ".join("(" + ", ".join([str(v) for v in r[:3]] + [f"{float(v)!r}e0" for v in r[3:]]) + ")" for r in rows)


_AT = ", ".join(f"ox + u{i} * bw as x{i}, oy + v{i} * bh as y{i}" for i in range(4))
_TEMPLATE = f"(select * from (values {_template()}) t(shape, contour, seg, u0, v0, u1, v1, u2, v2, u3, v3))"

# traced shapes in pixels, y down
_input("traced", f"""select id, key, contour, seg, {_AT} from (select id, key, n % 4 as shape_no, cast(0 as double) as ox, cast(0 as double) as oy,
 cast(40 + 2 * sz as double) as bw, cast(50 + n % 60 as double) as bh from {{drawn}} d) b join {_TEMPLATE} t on t.shape = b.shape_no""")

# the library's own outlines in font units, y up, nudges applied
_input("finals", """select lib_id, key, vidx, id, n, x0, x1, y0, y1, lsb, rsb, moved, sc, cx, nudge_dy, greatest(cast(-120 as double), lsb + nudge_dl) as flsb,
 greatest(cast(-120 as double), rsb + nudge_dr) as frsb from (select *, 1 + nudge_scale / 100 as sc, (x0 + x1) / 2 as cx, (nudge_scale <> 0 or nudge_dy <> 0) as moved from {variants} v) f""")
_FIN = ", ".join(
    f"case when moved then cx + (x{i} - cx) * sc else x{i} end as x{i}, case when moved then y{i} * sc + nudge_dy else y{i} end as y{i}" for i in range(4)
)
_input("outlines", f"""select id, lib_id, key, vidx, contour, seg, {_FIN} from (select b.id, b.lib_id, b.key, b.vidx, b.moved, b.cx, b.sc, b.nudge_dy, t.contour, t.seg, {_AT}
 from (select *, n % 4 as shape_no, x0 as ox, y0 as oy, x1 - x0 as bw, y1 - y0 as bh from {{finals}} f) b join {_TEMPLATE} t on t.shape = b.shape_no) q""")


def sql_of(name: str) -> str:
    """The input as one parenthesised subquery over the given tables (DuckDB side)."""
    text, _ = INPUTS[name]
    for other in INPUTS:
        mark = "{%s}" % other
        if mark in text:
            text = text.replace(mark, sql_of(other))
    return "(" + text + ")"


def ctes(*names: str) -> str:
    """``with name as (...), ...`` for a SQL twin."""
    return "with " + ", ".join(f"{n} as {sql_of(n)}" for n in names) + " "


def load(spark, sf_dir, name):
    """The input as a DataFrame (Spark side)."""
    text = sql_of(name)
    used = set()
    for _, tables in INPUTS.values():
        used |= set(tables)
    for t in sorted(used):
        table(spark, sf_dir, t).createOrReplaceTempView(f"_in_{t}")
        text = _swap(text, t)
    return spark.sql("select * from " + text + " q0")


def load_outlines(spark, sf_dir, name, keep):
    """Cubic rows folded into one row a glyph: (keep..., contours)."""
    from pyspark.sql import functions as F

    pts = F.struct(*[f"{ax}{i}" for i in range(4) for ax in ("x", "y")]).alias("c")
    segs = load(spark, sf_dir, name).groupBy(*keep, "contour").agg(F.array_sort(F.collect_list(F.struct("seg", pts))).alias("cs"))
    rings = segs.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("contour", F.transform("cs", lambda e: e["c"]).alias("ring")))).alias("rs"))
    return rings.select(*keep, F.transform("rs", lambda r: r["ring"]).alias("contours"))


def _swap(text, t):
    import re

    return re.sub(rf"\bfrom {t}\b", f"from _in_{t}", text)
