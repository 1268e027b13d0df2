"""Completing a letter's mask: holes that hide wall, outlines that belong to the letter.

ink(photo_id, w, h, x, y); classes(photo_id, x, y, cls) as from ``pixel_classes``; pixels(photo_id, x, y, r, g, b).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.color import color_dist
from inkspan.operators.masks import PIX, boundary, close, complement, components, distance, mask_measures

PHOTO = "photo_id"
BUCKET = 32

# Fixed values of hidden holes: wall share that makes a counter, halo reach, least hole to compare, ring beyond the
# letter, pixels it needs, colour difference below which a hole is wall.
WALL_SHARE, HALO, HOLE, RING, RING_PIXELS, ALIKE = 0.25, 4, 64, 30, 50, 50

# Fixed values of outlines: blend between letter and band, least stroke, share of the band's edge along the letter,
# band against stroke and at least, share of the letter's edge wrapped, where thickness is read.
BLEND, LEAST_STROKE, TOUCH, BAND, BAND_LEAST, WRAP, READ = 3.5, 4.0, 0.3, 0.5, 2.0, 0.45, 0.8


def _background(ink: DataFrame) -> DataFrame:
    """Background pixels with their piece, whether it meets the frame, and their distance to the ink."""
    back = complement(ink)
    far = distance(back, border_ink=True).select(*PIX, F.col("d").alias("off"))
    px = components(back).join(far, PIX)
    at_edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    outer = px.groupBy(PHOTO, "comp").agg(F.max(at_edge).alias("outer"), F.count(F.lit(1)).alias("size"))
    return px.join(outer, [PHOTO, "comp"])


def fill_hidden_holes(ink: DataFrame, classes: DataFrame, pixels: DataFrame | None = None, hole=HOLE, ring_pixels=RING_PIXELS, halo=HALO, reach=RING) -> DataFrame:
    """The ink with the holes that show hardly any wall filled.

    A hole under a quarter wall (the paint's halo well away from the paint counts as wall) is filled;
    with ``pixels``, unless it is large and its mean colour is that of the wall just outside the
    letter round it, within a window of its own size to each side. Windows meet the outer background
    by buckets, so a hole meets only pixels near it.
    """
    back = _background(ink)
    seen = back.join(classes.select(*PIX, "cls"), PIX, "left")
    wall = (F.col("cls") == "wall") | ((F.col("cls") == "family") & (F.col("off") > halo))
    holes = seen.where("not outer").groupBy(PHOTO, "w", "h", "comp", "size").agg(
        F.sum(F.coalesce(wall, F.lit(False)).cast("int")).alias("wall"),
        *[f(c).cast("int").alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))],
    ).where(F.col("wall") < F.col("size") * WALL_SHARE)
    if pixels is not None:
        tone = pixels.select(*PIX, *"rgb")
        mean = lambda df, n, p: df.agg(*[(F.sum(c) / n).alias(f"{p}{c}") for c in "rgb"], F.count(F.lit(1)).alias(f"{p}n"))
        large = holes.where(F.col("size") >= hole)
        own = back.where("not outer").join(large.select(PHOTO, "comp"), [PHOTO, "comp"], "left_semi").join(tone, PIX)
        own = mean(own.groupBy(PHOTO, "comp"), F.max("size"), "i")
        bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
        win = large.select(PHOTO, "comp", F.greatest(F.lit(0), F.col("x0") - bw).alias("xa"), F.least(F.col("w") - 1, F.col("x1") + bw).cast("int").alias("xb"), F.greatest(F.lit(0), F.col("y0") - bh).alias("ya"), F.least(F.col("h") - 1, F.col("y1") + bh).cast("int").alias("yb"))
        bucket = lambda c: F.floor(F.col(c) / BUCKET).cast("int")
        win = win.withColumn("bx", F.explode(F.sequence(bucket("xa"), bucket("xb")))).withColumn("by", F.explode(F.sequence(bucket("ya"), bucket("yb"))))
        ring = back.where(F.col("outer") & (F.col("off") > halo) & (F.col("off") < reach)).join(tone, PIX).select(*PIX, *"rgb", bucket("x").alias("bx"), bucket("y").alias("by"))
        met = win.join(ring, [PHOTO, "bx", "by"]).where(F.col("x").between(F.col("xa"), F.col("xb")) & F.col("y").between(F.col("ya"), F.col("yb")))
        met = mean(met.groupBy(PHOTO, "comp"), F.count(F.lit(1)), "e")
        alike = color_dist(*[F.col(f"i{c}") for c in "rgb"], *[F.col(f"e{c}") for c in "rgb"]) < ALIKE
        counters = own.join(met, [PHOTO, "comp"]).where((F.col("en") > ring_pixels) & alike)
        holes = holes.join(counters.select(PHOTO, "comp"), [PHOTO, "comp"], "left_anti")
    add = back.join(holes.select(PHOTO, "comp"), [PHOTO, "comp"], "left_semi")
    return ink.select(PHOTO, "w", "h", "x", "y").unionByName(add.select(PHOTO, "w", "h", "x", "y"))


def _edges(px: DataFrame) -> DataFrame:
    """Boundary pixels that are not on the frame."""
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1)
    return boundary(px).where(inner)


def outline_bands(ink: DataFrame, classes: DataFrame, blend=BLEND, least_stroke=LEAST_STROKE, band=BAND) -> DataFrame:
    """(photo_id, x, y, comp, off, back, outer, thick): pixels of the hidden pieces that are the letter's outline.

    A piece is one where at least 30 % of its own edge runs along the letter and it is thin next to
    the strokes; it lies in a counter, or wraps 45 % of the letter's edge. ``thick`` is its greatest
    depth near the letter, ``back`` the background piece it lies in.
    """
    back = _background(ink).withColumnRenamed("comp", "back")
    hidden = back.join(classes.where("cls = 'hidden'").select(*PIX), PIX, "left_semi").select(PHOTO, "w", "h", "x", "y", "off", "back", "outer")
    only = hidden.select(PHOTO, "w", "h", "x", "y")
    piece = components(only).select(*PIX, "comp")
    depth = distance(only, border_ink=True).select(*PIX, F.col("d").alias("depth"))
    stroke = mask_measures(ink).select(PHOTO, F.col("stroke_width").alias("sw")).where(F.col("sw") >= least_stroke)
    on_edge = _edges(only).select(*PIX, F.lit(1).alias("edge"))
    px = hidden.join(piece, PIX).join(depth, PIX).join(stroke, PHOTO).join(on_edge, PIX, "left")
    s = px.groupBy(PHOTO, "comp", "sw").agg(
        F.sum("edge").alias("edge"), F.sum(F.when(F.col("off") <= blend, F.col("edge"))).alias("touch"), F.max("outer").alias("outside"),
        F.max(F.when(F.col("off") <= F.col("sw") * READ, F.col("depth"))).alias("thick"),
    )
    letter = _edges(ink)
    r = int(-(-blend // 1))
    disk = F.inline(F.array(*[F.struct((F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y")) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= blend * blend]))
    near = letter.select(PHOTO, F.col("x").alias("px"), F.col("y").alias("py")).select(PHOTO, "px", "py", disk)
    along = near.join(piece, PIX).select(PHOTO, "comp", "px", "py").distinct().groupBy(PHOTO, "comp").agg(F.count(F.lit(1)).alias("along"))
    rim = letter.groupBy(PHOTO).agg(F.count(F.lit(1)).alias("rim"))
    s = s.join(along, [PHOTO, "comp"], "left").join(rim, PHOTO, "left")
    wide = F.coalesce("thick", F.lit(0.0)) * 2
    thin = (wide <= F.col("sw") * band) & (wide >= BAND_LEAST) & (F.coalesce("touch", F.lit(0)) / F.col("edge") >= TOUCH)
    wraps = F.coalesce("along", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("rim", F.lit(0)))
    taken = s.where((F.col("edge") > 0) & thin & (~F.col("outside") | (wraps >= WRAP))).select(PHOTO, "comp", "thick")
    return px.join(taken, [PHOTO, "comp"]).select(*PIX, "comp", "off", "back", "outer", "thick")


def absorb_outline(ink: DataFrame, classes: DataFrame, blend=BLEND, least_stroke=LEAST_STROKE, band=BAND) -> DataFrame:
    """The ink with the outline that hugs it and the blend between them; photos without one stay as they are."""
    from inkspan.session import cut_lineage

    own = ink.select(PHOTO, "w", "h", "x", "y")
    bands = cut_lineage(outline_bands(ink, classes, blend, least_stroke, band))
    frame = own.select(PHOTO, "w", "h").distinct()
    joined = own.unionByName(bands.where(F.col("off") <= F.col("thick") * 2 + blend + 1).join(frame, PHOTO).select(*own.columns))
    some = joined.join(bands.select(PHOTO).distinct(), PHOTO, "left_semi")
    off = distance(complement(own), border_ink=True).where(F.col("d") <= blend + 1).select(*PIX)
    between = close(some, int(-(-blend // 1))).select(*own.columns).join(off, PIX, "left_semi").join(joined.select(*PIX), PIX, "left_anti")
    return joined.unionByName(between.select(*own.columns)).distinct()
