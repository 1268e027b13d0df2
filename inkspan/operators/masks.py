"""Mask operators on sparse ink: ink(photo_id, w, h, x, y), one row an ink pixel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.session import cut_lineage

PHOTO = "photo_id"
PIX = [PHOTO, "x", "y"]
SQRT2 = 2**0.5


def _frame(ink: DataFrame) -> DataFrame:
    return ink.select(PHOTO, "w", "h").distinct()


def _inside():
    return (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") < F.col("h"))


def gaps(ink: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Background runs (photo_id, w, h, y, x0, x1): what lies between a row's ink runs and its ends."""
    f = frames if frames is not None else _frame(ink)
    ends = F.inline(F.array(F.struct(F.lit(-1).alias("x0"), F.lit(-1).alias("x1")), F.struct(F.col("w").alias("x0"), F.col("w").alias("x1"))))
    rows = f.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).select(PHOTO, "w", "h", "y", ends)
    runs = to_runs(ink).select(PHOTO, "w", "h", "y", F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    w = Window.partitionBy(PHOTO, "y").orderBy("x0")
    return (
        rows.unionByName(runs).withColumn("_n", F.lead("x0").over(w)).where(F.col("_n") > F.col("x1") + 1)
        .select(PHOTO, "w", "h", "y", (F.col("x1") + 1).alias("x0"), (F.col("_n") - 1).alias("x1"))
    )


def complement(ink: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Background pixels of each photo."""
    return from_runs(gaps(ink, frames))


# ---- runs and components ----------------------------------------------------


def to_runs(ink: DataFrame) -> DataFrame:
    """(photo_id, w, h, y, x0, x1): horizontal runs by gaps and islands, a row a partition key."""
    w = Window.partitionBy(PHOTO, "y").orderBy("x")
    return (
        ink.withColumn("_g", F.col("x") - F.row_number().over(w))
        .groupBy(PHOTO, "w", "h", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")
    )


def from_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def connected(edges: DataFrame) -> DataFrame:
    """(photo_id, node, root): least reachable node, over edges(photo_id, u, v) with u <> v.

    Alternating large-star and small-star steps until no edge changes, compared row by row; no
    node's neighbours are gathered as a list. Each round is written to the shared checkpoint folder.
    """
    e = cut_lineage(edges.select(PHOTO, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(PHOTO, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(PHOTO, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [PHOTO, "u"]).where(F.col("v") > F.col("u")).select(PHOTO, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy(PHOTO, "u").agg(F.min("v").alias("m"))
        small = large.join(down, [PHOTO, "u"])
        new = cut_lineage(small.select(PHOTO, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select(PHOTO, "u", F.col("m").alias("v"))
        ).where("u <> v").distinct())
        if new.join(e, [PHOTO, "u", "v"], "left_anti").isEmpty() and e.join(new, [PHOTO, "u", "v"], "left_anti").isEmpty():
            return new.select(PHOTO, F.col("u").alias("node"), F.col("v").alias("root"))
        e = new


def run_components(runs: DataFrame) -> DataFrame:
    """Runs with comp: the scan index of the component's first pixel (4-connected)."""
    node = F.col("y") * F.col("w").cast("bigint") + F.col("x0")
    r = cut_lineage(runs.withColumn("node", node))
    below = r.select(PHOTO, (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("node").alias("v"))
    # neighbouring rows meet on (photo, row); only overlapping runs become edges
    edges = r.join(below, [PHOTO, "y"]).where((F.col("x0") <= F.col("bx1")) & (F.col("bx0") <= F.col("x1"))).select(PHOTO, F.col("node").alias("u"), "v")
    roots = connected(edges)
    return r.join(roots, [PHOTO, "node"], "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "node")


def components(ink: DataFrame) -> DataFrame:
    """Ink pixels with comp."""
    return from_runs(run_components(to_runs(ink)))


def component_sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy(PHOTO, "comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def despeckle(ink: DataFrame, min_frac=0.0, min_abs=0) -> DataFrame:
    """Components smaller than max(min_abs, min_frac * largest) go."""
    runs = run_components(to_runs(ink))
    sizes = component_sizes(runs)
    cut = sizes.groupBy(PHOTO).agg(F.greatest(F.lit(float(min_abs)), F.max("area") * float(min_frac)).alias("cut"))
    keep = sizes.join(cut, PHOTO).where(F.col("area") >= F.col("cut")).select(PHOTO, "comp")
    return from_runs(runs.join(keep, [PHOTO, "comp"], "left_semi")).drop("comp")


def region_at(ink: DataFrame, seeds: DataFrame) -> DataFrame:
    """Components that hold a seed pixel (photo_id, x, y)."""
    c = components(ink)
    hit = c.join(seeds.select(*PIX), PIX, "left_semi").select(PHOTO, "comp").distinct()
    return c.join(hit, [PHOTO, "comp"], "left_semi").drop("comp")


def hysteresis(strong: DataFrame, weak: DataFrame) -> DataFrame:
    """Pixels of strong or weak whose component holds a strong pixel."""
    both = strong.select(PHOTO, "w", "h", "x", "y").unionByName(weak.select(PHOTO, "w", "h", "x", "y")).distinct()
    return region_at(both, strong)


def _touches():
    return (F.col("y") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1)


def holes(ink: DataFrame, frames=None) -> DataFrame:
    """Enclosed background pieces as runs: (photo_id, w, h, y, x0, x1, comp, area)."""
    runs = run_components(gaps(ink, frames))
    s = runs.groupBy(PHOTO, "comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.max(_touches()).alias("open"))
    return runs.join(s.where(~F.col("open")).drop("open"), [PHOTO, "comp"])


def count_holes(ink: DataFrame, more_than=8) -> DataFrame:
    h = holes(ink).select(PHOTO, "comp", "area").distinct().where(F.col("area") > more_than)
    return ink.select(PHOTO).distinct().join(h.groupBy(PHOTO).agg(F.count(F.lit(1)).alias("holes")), PHOTO, "left").select(
        PHOTO, F.coalesce("holes", F.lit(0)).alias("holes"))


def fill_holes(ink: DataFrame, max_frac: float, max_area=None, max_thick=None) -> DataFrame:
    """Holes small against ink + hole fill; so do those never thicker than ``max_thick``."""
    if max_frac <= 0:
        return ink
    h = holes(ink)
    total = ink.groupBy(PHOTO).agg(F.count(F.lit(1)).alias("ink"))
    ok = F.col("area") <= F.lit(float(max_frac)) * (F.col("ink") + F.col("area"))
    if max_area is not None:
        ok = ok & (F.col("area") <= max_area)
    j = h.join(total, PHOTO)
    if max_thick:
        px = from_runs(h.select(PHOTO, "w", "h", "y", "x0", "x1", "comp"))
        d = distance(complement(ink), border_ink=True)
        thick = px.join(d, PIX).groupBy(PHOTO, "comp").agg(F.max("d").alias("thick"))
        j = j.join(thick, [PHOTO, "comp"], "left")
        ok = ok | (F.coalesce("thick", F.lit(1e9)) <= max_thick)
    add = from_runs(j.where(ok).select(PHOTO, "w", "h", "y", "x0", "x1"))
    return ink.select(PHOTO, "w", "h", "x", "y").unionByName(add.select(PHOTO, "w", "h", "x", "y"))


def component_stats(ink: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Per component: area, box, fill, frame edges touched, stroke width, length, elongation, size.

    ``raw`` is the mask before its gaps were closed; with it ``density`` says how much of a component was ink then.
    """
    c = components(ink)
    d = distance(ink)
    t = lambda cond: F.max(cond.cast("int"))
    s = c.join(d, PIX).groupBy(PHOTO, "comp", "w", "h").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        (F.avg("d") * 4).alias("stroke"),
        (t(F.col("x") == 0) + t(F.col("y") == 0) + t(F.col("x") == F.col("w") - 1) + t(F.col("y") == F.col("h") - 1)).alias("touch"),
    )
    if raw is not None:
        own = c.join(raw.select(*PIX).distinct(), PIX, "left_semi").groupBy(PHOTO, "comp").agg(F.count(F.lit(1)).alias("own"))
        s = s.join(own, [PHOTO, "comp"], "left").withColumn("density", F.coalesce("own", F.lit(0)) / F.col("area")).drop("own")
    bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return s.withColumn("fill", F.col("area") / (bw * bh)).withColumn("length", F.col("area") / F.col("stroke")).withColumn(
        "elong", F.col("length") / F.col("stroke")
    ).withColumn("size", F.greatest(bw, bh) / F.least("w", "h"))


# ---- measures ---------------------------------------------------------------


def boundary(ink: DataFrame) -> DataFrame:
    """Ink pixels with a 4-neighbour off the mask (or off the frame), by counting ink neighbours."""
    steps = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    around = ink.select(PHOTO, F.inline(steps)).groupBy(*PIX).agg(F.count(F.lit(1)).alias("k"))
    return ink.join(around, PIX, "left").where(F.coalesce("k", F.lit(0)) < 4).drop("k")


def mask_measures(ink: DataFrame) -> DataFrame:
    box = ink.groupBy(PHOTO).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    per = boundary(ink).groupBy(PHOTO).agg(F.count(F.lit(1)).alias("perimeter"))
    return box.join(per, PHOTO).withColumn("stroke_width", F.col("area") * 2 / F.col("perimeter"))


STRIP = 64  # columns of a photo that one task's array holds


def distance(ink: DataFrame, border_ink=False) -> DataFrame:
    """(photo_id, x, y, d): exact octile distance of each ink pixel to the nearest off pixel.

    Distances along the row come from the runs; strips of columns, each bounded by the photo's
    height, then take the least over the rows above and below, going outwards until no row could
    improve any pixel. The frame counts as off at distance 1 unless ``border_ink``; without any
    off pixel the distance is infinite.
    """
    runs = to_runs(ink)
    # distance along the row to the run's ends; past the frame only when it counts as off
    left = F.when((F.col("x0") == 0) & F.lit(border_ink), F.lit(None)).otherwise(F.col("x") - F.col("x0") + 1)
    right = F.when((F.col("x1") == F.col("w") - 1) & F.lit(border_ink), F.lit(None)).otherwise(F.col("x1") - F.col("x") + 1)
    rows = runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(
        PHOTO, F.col("w").cast("int"), F.col("h").cast("int"), F.col("x").cast("int"), F.col("y").cast("int"), F.least(left, right).cast("double").alias("hd"))
    kind = ink.schema[PHOTO].dataType.simpleString()

    def strip(table):
        import numpy as np
        import pyarrow as pa

        get = lambda name: table.column(name).to_numpy()
        x, y, w, h = get("x"), get("y"), int(get("w")[0]), int(get("h")[0])
        base = int(x.min())
        side = np.zeros((h, int(x.max()) - base + 1))
        side[y, x - base] = np.nan_to_num(table.column("hd").to_numpy(zero_copy_only=False), nan=np.inf)
        best = side.copy()
        for k in range(1, h):
            if best[y, x - base].max() <= k:
                break
            reach = np.maximum(side, k) + np.minimum(side, k) * (SQRT2 - 1)
            best[k:] = np.minimum(best[k:], reach[:-k])
            best[:-k] = np.minimum(best[:-k], reach[k:])
        d = best[y, x - base]
        if not border_ink:
            d = np.minimum.reduce([d, x + 1.0, w - x + 0.0, y + 1.0, h - y + 0.0])
        return pa.table({PHOTO: table.column(PHOTO), "x": pa.array(x), "y": pa.array(y), "d": pa.array(d)})

    return rows.withColumn("_s", F.floor(F.col("x") / STRIP)).groupBy(PHOTO, "_s").applyInArrow(strip, f"{PHOTO} {kind}, x int, y int, d double")


def thin_radius(ink: DataFrame, pct=0.2, region: DataFrame | None = None) -> DataFrame:
    """Low percentile of the distance along its ridge, of the pixels in ``region`` if given; 0 without a ridge."""
    d = cut_lineage(distance(ink))
    steps = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    around = d.select(PHOTO, "d", F.inline(steps)).groupBy(*PIX).agg(F.max("d").alias("m"))
    ridge = d.join(around, PIX, "left").where((F.col("d") >= 1.5) & (F.col("d") >= F.coalesce("m", F.lit(0.0))))
    if region is not None:
        ridge = ridge.join(region.select(*PIX).distinct(), PIX, "left_semi")
    w = Window.partitionBy(PHOTO).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = ridge.groupBy(PHOTO, "d").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(w))
    n = r.groupBy(PHOTO).agg(F.max("upto").alias("cnt"))
    got = r.join(n, PHOTO).groupBy(PHOTO).agg(F.min(F.when(F.col("upto") > F.floor(F.col("cnt") * pct), F.col("d"))).alias("radius"))
    return ink.select(PHOTO).distinct().join(got, PHOTO, "left").select(PHOTO, F.coalesce("radius", F.lit(0.0)).alias("radius"))


def solid_width(ink: DataFrame) -> DataFrame:
    """Four times the mean distance to the edge once pocks (2 % of ink at most) are filled."""
    return distance(fill_holes(ink, 0.02)).groupBy(PHOTO).agg((F.avg("d") * 4).alias("width"))


# ---- morphology -------------------------------------------------------------


def _disk(r):
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r + 0.5]


def dilate(ink: DataFrame, r: int) -> DataFrame:
    """Disk of radius r: true disk up to 3, octile distance beyond."""
    cols = [PHOTO, "w", "h", "x", "y"]
    if r <= 0:
        return ink.select(*cols)
    if r <= 3:
        steps = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in _disk(r)])
        return ink.select(PHOTO, "w", "h", F.inline(steps)).where(_inside()).distinct()
    off = complement(ink)
    near = distance(off, border_ink=True).where(F.col("d") <= r)
    return ink.select(*cols).unionByName(near.join(_frame(ink), PHOTO).select(*cols))


def erode(ink: DataFrame, r: int) -> DataFrame:
    """Pixels whose whole disk is ink; past the frame is neutral."""
    cols = [PHOTO, "w", "h", "x", "y"]
    if r <= 0:
        return ink.select(*cols)
    if r <= 3:
        eaten = dilate(complement(ink), r)
        return ink.select(*cols).join(eaten.select(*PIX), PIX, "left_anti").select(*cols)
    return ink.select(*cols).join(distance(ink, border_ink=True).where(F.col("d") > r), PIX).select(*cols)


def close(ink, r):
    return erode(cut_lineage(dilate(ink, r)), r)


def opening(ink, r):
    return dilate(cut_lineage(erode(ink, r)), r)


def box_dilate(ink: DataFrame, r: int) -> DataFrame:
    wide = ink.withColumn("x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - r), F.least(F.col("w") - 1, F.col("x") + r)))).select(PHOTO, "w", "h", "x", "y").distinct()
    return wide.withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - r), F.least(F.col("h") - 1, F.col("y") + r)))).select(PHOTO, "w", "h", "x", "y").distinct()


def box_close(ink: DataFrame, r: int) -> DataFrame:
    return complement(box_dilate(complement(box_dilate(ink, r), _frame(ink)), r), _frame(ink))


def bridge_through(a: DataFrame, x: DataFrame, r: int) -> DataFrame:
    """a without x, plus what a box closing of that would put inside x."""
    cols = [PHOTO, "w", "h", "x", "y"]
    base = a.join(x.select(*PIX), PIX, "left_anti").select(*cols)
    if r <= 0:
        return base
    healed = box_close(base, r).join(x.select(*PIX), PIX, "left_semi").select(*cols)
    return base.unionByName(healed).distinct()


def reconstruct(marker: DataFrame, limit: DataFrame, iters: int) -> DataFrame:
    """Grow the marker by single-pixel dilations that never leave the limit; stops when settled."""
    cur, n = cut_lineage(marker.select(PHOTO, "w", "h", "x", "y")), -1
    for _ in range(iters):
        cur = cut_lineage(dilate(cur, 1).join(limit.select(*PIX), PIX, "left_semi"))
        k = cur.count()
        if k == n:
            break
        n = k
    return cur


def _twice_boxed(a, r, axis):
    """Two box sums of radius r along an axis of an array, zero beyond it."""
    for _ in range(2):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r + 1, r)
        c = np.pad(a, pad).cumsum(axis)
        lo, hi = [slice(None)] * 2, [slice(None)] * 2
        lo[axis], hi[axis] = slice(0, -2 * r - 1), slice(2 * r + 1, None)
        a = c[tuple(hi)] - c[tuple(lo)]
    return a


def smooth_mask(ink: DataFrame, level: float) -> DataFrame:
    """Level 0..10: two box blurs of radius max(1, round(level / 10 * 0.4 * stroke width)), kept at half.

    Blurs are separable sums of whole numbers: strips of rows are summed along x, strips of columns of
    what that gives along y, each photo with its own radius. A task holds a strip of one photo.
    """
    if level <= 0:
        return ink
    r = F.greatest(F.lit(1), F.floor(F.lit(level / 10.0 * 0.4) * F.col("stroke_width") + 0.5)).cast("int")
    radii = mask_measures(ink).select(PHOTO, r.alias("r"))
    kind = ink.schema[PHOTO].dataType.simpleString()
    rows = ink.select(PHOTO, "w", "h", "x", "y").join(radii, PHOTO).select(PHOTO, *[F.col(c).cast("int").alias(c) for c in ("w", "h", "r", "x", "y")], F.lit(1).cast("bigint").alias("v"))

    def along(axis):
        def strip(table):
            table = table.combine_chunks()
            w, h, r = (table.column(c)[0].as_py() for c in ("w", "h", "r"))
            x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
            across = y if axis else x
            first, size = int(across.min()), int(np.ptp(across)) + 1
            field = np.zeros((size, w) if axis else (h, size), np.int64)
            field[(y - first, x) if axis else (y, x - first)] = v
            pad = [(0, 0), (0, 0)]
            pad[axis] = (2 * r, 2 * r)  # sums that start beyond the frame count
            field = _twice_boxed(np.pad(field, pad), r, axis)
            cut = [slice(None)] * 2
            cut[axis] = slice(2 * r, -2 * r)
            field = field[tuple(cut)]
            ny, nx = np.nonzero(field if axis else 2 * field >= (2 * r + 1) ** 4)
            n = len(nx)
            own = lambda c: pa.array(np.full(n, table.column(c)[0].as_py()), pa.int32())
            key = table.column(PHOTO).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
            at = (nx, ny + first) if axis else (nx + first, ny)
            return pa.table({PHOTO: key, "w": own("w"), "h": own("h"), "r": own("r"), "x": pa.array(at[0], pa.int32()), "y": pa.array(at[1], pa.int32()), "v": pa.array(field[ny, nx])})

        return strip

    schema = f"{PHOTO} {kind}, w int, h int, r int, x int, y int, v bigint"
    wide = rows.groupBy(PHOTO, F.floor(F.col("y") / STRIP)).applyInArrow(along(1), schema)
    return wide.groupBy(PHOTO, F.floor(F.col("x") / STRIP)).applyInArrow(along(0), schema).select(PHOTO, "w", "h", "x", "y")


def polygon_runs(edges: DataFrame, w: int, h: int) -> DataFrame:
    """Even-odd spans at row centres: edges(id, ax, ay, bx, by) -> (id, y, x0, x1)."""
    f, last = F.greatest(F.lit(0), F.ceil(F.least("ay", "by") - 0.5)), F.least(F.lit(h - 1), F.ceil(F.greatest("ay", "by") - 0.5) - 1)
    rows = edges.withColumn("_f", f.cast("int")).withColumn("_l", last.cast("int")).where("_f <= _l").withColumn("y", F.explode_outer(F.sequence("_f", "_l")))
    x = F.col("ax") + ((F.col("y") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay"))) * (F.col("bx") - F.col("ax"))
    o = Window.partitionBy("id", "y").orderBy("_x")
    spans = rows.withColumn("_x", x).withColumn("_k", F.row_number().over(o)).withColumn("_n", F.lead("_x").over(o)).where((F.col("_k") % 2 == 1) & F.col("_n").isNotNull())
    return spans.select("id", "y", F.greatest(F.lit(0), F.ceil(F.col("_x") - 0.5)).alias("x0"), F.least(F.lit(w - 1), F.floor(F.col("_n") - 0.5)).alias("x1")).where("x0 <= x1")


def mask_iou(cand: DataFrame, truth: DataFrame) -> DataFrame:
    """(scene, iou, ious_inside): cells (scene, x, y); truth cells carry ``inside`` the frame."""
    j = truth.select("scene", "x", "y", "inside", F.lit(1).alias("t")).join(cand.select("scene", "x", "y", F.lit(1).alias("c")), ["scene", "x", "y"], "full")
    hit = F.sum(F.when(F.col("t").isNotNull() & F.col("c").isNotNull(), 1).otherwise(0))
    ins = F.coalesce("inside", F.lit(False)) | (F.col("t").isNull())
    ih = F.sum(F.when(ins & F.col("t").isNotNull() & F.col("c").isNotNull(), 1).otherwise(0))
    return j.groupBy("scene").agg(
        (F.floor(hit / F.count(F.lit(1)) * 1000 + 0.5) / 1000).alias("iou"),
        (F.floor(ih / F.nullif(F.sum(ins.cast("int")), F.lit(0)) * 1000 + 0.5) / 1000).alias("iou_inside"),
    )
