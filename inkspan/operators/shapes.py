"""Shapes of a photo: which pieces make a letterform, which colours are surfaces, which are shades of one paint.

Photos have a bounded number of shapes worth a look and of palette colours, so both are folded into the
photo's row and settled there in order, largest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHOTO = "photo_id"

# Fixed values of candidate shapes: least area (pixels, share), least fill, whole-frame share and fill, satellite
# area, overlap and gap.
AREA, AREA_SHARE, WISP, WHOLE, SOLID, SATELLITE, OVERLAP, GAP = 420, 0.0018, 0.02, 0.96, 0.5, 0.35, 0.5, 0.4

# Fixed values of surfaces and paints: share of a surface, ring share, edge share, stroke score, panel fill and size,
# body share, size and edge share; least paint; near on other surfaces and on one, along the axis, hue, direction.
SURFACE, RING, EDGE, STROKEY, PANEL_FILL, PANEL_SIZE = 0.06, 0.3, 0.3, 0.4, 0.55, 0.3
BODY_SHARE, BODY_SIZE, BODY_EDGE, LEAST_PAINT = 0.25, 0.5, 0.05, 0.0015
NEAR_APART, NEAR, HALO, HUE_APART, TURN = 60, 85, 0.55, 35, 22
WEIGHTS = (1.5, 2.0, 1.6)


def candidate_shapes(shapes: DataFrame, recognised=True, least=AREA) -> DataFrame:
    """(photo_id, rank, comps, area, x0, y0, x1, y1): shapes with their satellites, the largest first.

    shapes(photo_id, w, h, comp, area, x0, y0, x1, y1). Specks, wisps and solid pieces that span the
    frame go; a piece on three edges goes unless a recogniser will judge it. By size, each piece
    joins the first larger one that it is small beside and stands above or below of. At least 0.18 %
    of a photo each, they are some 550 at most and are folded in the photo's row; all ranks stay.
    """
    bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    whole = F.col("w") * F.col("h")
    touch = sum(c.cast("int") for c in (F.col("x0") <= 1, F.col("y0") <= 1, F.col("x1") >= F.col("w") - 2, F.col("y1") >= F.col("h") - 2))
    fill = F.col("area") / (bw * bh)
    spans = ((touch >= 4) | (bw * bh > whole * WHOLE)) & (fill > SOLID)
    kept = shapes.where((F.col("area") >= F.greatest(F.lit(float(least)), whole * AREA_SHARE)) & (fill >= WISP) & ~spans & (F.lit(recognised) | (touch != 3)))
    long = lambda c: F.col(c).cast("bigint").alias(c)
    piece = F.struct((-F.col("area")).alias("by"), F.col("comp"), *[long(c) for c in ("area", "x0", "y0", "x1", "y1")])
    rows = kept.groupBy(PHOTO).agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    comp = kept.schema["comp"].dataType.simpleString()
    hosts = f"""transform(gs, g -> c.area <= {SATELLITE}D * g.area and least(c.x1, g.x1) - greatest(c.x0, g.x0) > {OVERLAP}D * (least(c.x1 - c.x0, g.x1 - g.x0) + 1)
        and greatest(0, greatest(c.y0, g.y0) - least(c.y1, g.y1)) < {GAP}D * (greatest(g.y1 - g.y0, c.y1 - c.y0) + 1))"""
    join = "named_struct('area', g.area + c.area, 'comps', concat(g.comps, array(c.comp)), 'x0', least(g.x0, c.x0), 'y0', least(g.y0, c.y0), 'x1', greatest(g.x1, c.x1), 'y1', greatest(g.y1, c.y1))"
    new = "named_struct('area', c.area, 'comps', array(c.comp), 'x0', c.x0, 'y0', c.y0, 'x1', c.x1, 'y1', c.y1)"
    fold = f"""aggregate(pieces, cast(array() as array<struct<area:bigint,comps:array<{comp}>,x0:bigint,y0:bigint,x1:bigint,y1:bigint>>), (gs, c) ->
        element_at(transform(array(array_position({hosts}, true)), at -> if(at > 0, transform(gs, (g, i) -> if(i = at - 1, {join}, g)), concat(gs, array({new})))), 1))"""
    groups = rows.select(PHOTO, F.expr(fold).alias("gs"))
    ranked = F.array_sort(F.transform("gs", lambda g, i: F.struct((-g["area"]).alias("by"), i.alias("i"), g.alias("g"))))
    out = groups.select(PHOTO, F.posexplode(ranked).alias("rank", "s"))
    return out.select(PHOTO, (F.col("rank") + 1).alias("rank"), *[F.col(f"s.g.{c}").alias(c) for c in ("comps", "area", "x0", "y0", "x1", "y1")])


def judged_colours(groups: DataFrame, shapes: DataFrame) -> DataFrame:
    """``groups`` with ``surface`` and ``parts``, the share of a surface's colour that lies in shapes of its own.

    groups(photo_id, label, r, g, b, share, ring_share); shapes(photo_id, label, shape, share, fill, size,
    touch, score) has each colour's pieces. A surface covers 6 % and holds 30 % of the border, or
    meets the edge with a large piece and either has no stroke or is a panel. Where no colour is a
    surface, the one with most of the border is (the lowest label of equals).
    """
    s = shapes.withColumnRenamed("share", "own").join(groups.select(PHOTO, "label", "share"), [PHOTO, "label"])
    body = (F.col("own") >= F.col("share") * BODY_SHARE) | (F.col("size") >= BODY_SIZE) | ((F.col("touch") >= 1) & (F.col("own") >= F.col("share") * BODY_EDGE))
    s = s.groupBy(PHOTO, "label").agg(
        F.max((F.col("touch") >= 1) & (F.col("own") >= F.col("share") * EDGE)).alias("edge"), F.max("score").alias("top"),
        F.max_by(F.struct("fill", "size"), F.struct("own", -F.col("shape"))).alias("big"), F.sum(F.when(~body, F.col("own")).otherwise(0.0)).alias("parts"),
    )
    j = groups.join(s, [PHOTO, "label"], "left")
    panel = F.coalesce((F.col("big.fill") >= PANEL_FILL) & (F.col("big.size") >= PANEL_SIZE), F.lit(False))
    shaped = F.coalesce("edge", F.lit(False)) & ((F.coalesce("top", F.lit(0.0)) < STROKEY) | panel)
    j = j.withColumn("surface", (F.col("share") >= SURFACE) & ((F.col("ring_share") >= RING) | shaped))
    none = j.groupBy(PHOTO).agg(F.max("surface").alias("some"), F.max_by("label", F.struct("ring_share", -F.col("label"))).alias("most"))
    j = j.join(none, PHOTO).withColumn("surface", F.col("surface") | (~F.col("some") & (F.col("label") == F.col("most"))))
    return j.select(PHOTO, "label", "r", "g", "b", "share", "ring_share", "surface", F.coalesce("parts", F.lit(0.0)).alias("parts"))


def merge_paints(colours: DataFrame, borders: DataFrame) -> DataFrame:
    """(photo_id, rank, paint, members, share, on, r, g, b): the paints, shades of one paint merged, by share.

    colours as from ``judged_colours``; borders(photo_id, a, b, n). Each colour lies on the surface it
    borders most, else on the main one. By share, a colour joins the first larger paint of which it
    is a shade: near it, or on the same surface out along its line and no halo of it. A surface's
    own detached shapes are candidates, too (their member is the label plus 0.5). A photo has a
    palette's number of colours; they are settled in its row.
    """
    from inkspan.functions.color import hue

    c = colours.withColumn("hue", hue(F.col("r"), F.col("g"), F.col("b")))
    fields = [F.col("label").cast("int").alias("label"), *[F.col(x).cast("double").alias(x) for x in ("r", "g", "b", "share")], F.col("ring_share").alias("ring"), "surface", "parts", F.col("hue").cast("double").alias("hue")]
    rows = c.groupBy(PHOTO).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("gs"))
    both = borders.select(PHOTO, F.inline(F.array(*[F.struct(F.col(p).cast("int").alias("a"), F.col(q).cast("int").alias("b"), F.col("n")) for p, q in ("ab", "ba")])))
    rows = rows.join(both.groupBy(PHOTO).agg(F.collect_list(F.struct("a", "b", "n")).alias("bs")), PHOTO, "left")
    rows = rows.withColumn("sur", F.expr("filter(gs, g -> g.surface)"))
    rows = rows.withColumns({"main": F.expr("-array_max(transform(sur, s -> named_struct('v', s.ring + s.share, 'l', -s.label))).l"), "ids": F.expr("transform(sur, s -> s.label)")})
    met = "-array_max(transform(filter(bs, t -> t.a = g.label and array_contains(ids, t.b)), t -> named_struct('n', t.n, 'l', -t.b))).l"
    other = "get(filter(ids, s -> s <> g.label), 0)"
    on = f"coalesce({met}, if(main <> g.label, main, coalesce({other}, main)))"
    cand = "named_struct('by', -{share}, 'part', {part}, 'label', g.label, 'share', {share}, 'r', g.r, 'g', g.g, 'b', g.b, 'hue', g.hue, 'on', {on})"
    own = cand.format(share="g.share", part="0", on=on)
    parts = cand.format(share="g.parts", part="1", on=on)
    cands = f"array_sort(concat(transform(filter(gs, g -> not g.surface and g.share >= {LEAST_PAINT}D), g -> {own}), transform(filter(gs, g -> g.surface and g.parts >= {LEAST_PAINT}D), g -> {parts})))"
    rows = rows.withColumn("cands", F.expr(cands))
    axis = [f"({w}D * (c.{x} - filter(gs, g -> g.label = c.on)[0].{x}))" for x, w in zip("rgb", WEIGHTS)]
    tone = ", ".join(f"'{x}', c.{x}" for x in ("label", "part", "share", "r", "g", "b", "hue", "on"))
    rows = rows.withColumn("cands", F.expr(f"transform(cands, c -> named_struct({tone}, 'v1', {axis[0]}, 'v2', {axis[1]}, 'v3', {axis[2]}))"))
    rm = "((m.r + c.r) / 2D)"
    near = f"sqrt((2D + {rm} / 256D) * (m.r - c.r) * (m.r - c.r) + 4D * (m.g - c.g) * (m.g - c.g) + (2D + (255D - {rm}) / 256D) * (m.b - c.b) * (m.b - c.b))"
    dot = "(m.v1 * c.v1 + m.v2 * c.v2 + m.v3 * c.v3)"
    size = lambda a: f"({a}.v1 * {a}.v1 + {a}.v2 * {a}.v2 + {a}.v3 * {a}.v3)"
    unit = lambda a: f"if({size(a)} = 0, 1D, sqrt({size(a)}))"
    hues = f"(m.hue is null) = (c.hue is null) and (m.hue is null or least(abs(m.hue - c.hue), 360D - abs(m.hue - c.hue)) <= {HUE_APART})"
    shade = f"{dot} / if({size('m')} = 0, 1D, {size('m')}) >= {HALO}D and ({near} < {NEAR} or ({hues} and {dot} / ({unit('m')} * {unit('c')}) > cos(radians({TURN}D))))"
    hosts = f"transform(ms, m -> if(m.on <> c.on, {near} < {NEAR_APART}, {shade}))"
    names = ("label", "part", "r", "g", "b", "hue", "on", "v1", "v2", "v3")
    kind = "array<struct<members:array<double>,total:double,label:int,part:int,r:double,g:double,b:double,hue:double,on:int,v1:double,v2:double,v3:double>>"
    join = "named_struct('members', concat(m.members, array(c.label + c.part * 0.5D)), 'total', m.total + c.share, " + ", ".join(f"'{x}', m.{x}" for x in names) + ")"
    new = "named_struct('members', array(c.label + c.part * 0.5D), 'total', c.share, " + ", ".join(f"'{x}', c.{x}" for x in names) + ")"
    fold = f"""aggregate(cands, cast(array() as {kind}), (ms, c) -> element_at(transform(array(array_position({hosts}, true)), at ->
        if(at > 0, transform(ms, (m, i) -> if(i = at - 1, {join}, m)), concat(ms, array({new})))), 1))"""
    out = rows.select(PHOTO, F.posexplode(F.expr(fold)).alias("rank", "m"))
    return out.select(PHOTO, (F.col("rank") + 1).alias("rank"), F.col("m.label").alias("paint"), "m.members", F.col("m.total").alias("share"), F.col("m.on").alias("on"), "m.r", "m.g", "m.b")
