"""Resampling photos through projective maps: crops by a quad, flattened photos.

Both are one gather. Photos are kept as square tiles; the output is cut into tiles, too, each of which
knows from its mapped corners which source tiles it reads (with one pixel around). Output tiles meet
source tiles by equality of (photo, tile), never pixel by pixel, and are filled in their task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.numbers import half_up

PHOTO = "photo_id"
TILE = 64
AT_ONCE = 1 << 18  # pixels read and written at once in a task, about

# Largest enlargement and longer side of a crop, colours where a crop or a warp leaves the photo.
ENLARGE, MAX_EDGE, CROP_FILL, WARP_FILL = 3, 320, 138, 128


def pixel_tiles(pixels: DataFrame, tile=TILE) -> DataFrame:
    """(photo_id, tx, ty, data): tiles of packed colours in row order, NULL where a pixel is missing."""
    at = (F.col("y") % tile) * tile + F.col("x") % tile
    packed = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    # place and colour are one number, so a tile is sorted as plain numbers
    t = pixels.groupBy(PHOTO, F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty")).agg(
        F.sort_array(F.collect_list(F.shiftleft(at.cast("bigint"), 24) + packed)).alias("s")
    )
    colour = lambda p: p.bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    whole = F.transform("s", colour)
    # a tile at the frame's edge, or with missing pixels, is laid out place by place
    laid = F.expr(f"element_at(transform(array(map_from_entries(transform(s, p -> struct(cast(shiftright(p, 24) as int), cast(p & 16777215 as int))))), m -> transform(sequence(0, {tile * tile - 1}), i -> m[i])), 1)")
    return t.select(PHOTO, "tx", "ty", F.when(F.size("s") == tile * tile, whole).otherwise(laid).alias("data"))


def quad_map(quad: Column, w: Column, h: Column, out_w: Column, out_h: Column) -> Column:
    """Nine numbers that take output places onto the quad (fractions of the photo, clockwise from top left)."""
    x, y = [F.get(quad, F.lit(2 * i)) * w for i in range(4)], [F.get(quad, F.lit(2 * i + 1)) * h for i in range(4)]
    det = lambda a, b, c, d: a * d - b * c
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    low = F.nullif(det(dx1, dx2, dy1, dy2), F.lit(0.0))
    g, k = det(sx, dx2, sy, dy2) / low, det(dx1, sx, dy1, sy) / low
    rows = [(x[1] - x[0] + g * x[1], x[3] - x[0] + k * x[3], x[0]), (y[1] - y[0] + g * y[1], y[3] - y[0] + k * y[3], y[0]), (g, k, F.lit(1.0))]
    return F.array(*[v for a, b, c in rows for v in (a / out_w, b / out_h, c)])


def _mapped(x: str, y: str) -> tuple[str, str, str]:
    """SQL of the photo place of an output place, and of the map's denominator; ``o`` shifts to pixel centres."""
    z = f"(m[6] * ({x} + o) + m[7] * ({y} + o) + m[8])"
    return tuple(f"((m[{r}] * ({x} + o) + m[{r + 1}] * ({y} + o) + m[{r + 2}]) / nullif({z}, 0D) - o)" for r in (0, 3)) + (z,)


def gather(jobs: DataFrame, tiles: DataFrame, keys, fill=(0, 0, 0), tile=TILE) -> DataFrame:
    """(keys..., x, y, r, g, b, in_photo): output pixels, bilinear from the photo; ``fill`` where it does not reach.

    jobs(keys..., photo_id, w, h photo size, ow, oh output size, m nine numbers from output to photo,
    o 0.5 where places are pixel centres, else 0). A missing photo pixel counts as ``fill``.
    """
    keys = list(keys)
    j = jobs.select(*keys, F.col(PHOTO).alias("_p"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.col("ow").cast("int").alias("ow"), F.col("oh").cast("int").alias("oh"), "m", F.col("o").cast("double").alias("o"))
    last = lambda c: F.floor((F.col(c) - 1) / tile).cast("int")
    j = j.where((F.col("ow") > 0) & (F.col("oh") > 0)).withColumn("ox", F.explode(F.sequence(F.lit(0), last("ow")))).withColumn("oy", F.explode(F.sequence(F.lit(0), last("oh"))))
    j = j.withColumns({"xa": F.col("ox") * tile, "ya": F.col("oy") * tile, "xb": F.least(F.col("ow"), (F.col("ox") + 1) * tile) - 1, "yb": F.least(F.col("oh"), (F.col("oy") + 1) * tile) - 1})
    corners = [_mapped(x, y) for x in ("xa", "xb") for y in ("ya", "yb")]
    one_side = f"(least({', '.join(c[2] for c in corners)}) > 0 or greatest({', '.join(c[2] for c in corners)}) < 0)"
    ends = {f"{axis}{name}": f"{f}({', '.join(c[k] for c in corners)})" for k, axis in enumerate("xy") for name, f in (("lo", "least"), ("hi", "greatest"))}
    size = {"x": "w", "y": "h"}
    # across the map's horizon the corners bound nothing: every tile may be read
    bounds = {n: F.expr(f"cast(least(greatest(floor(if({one_side}, {e}, {'0D' if n.endswith('lo') else size[n[0]]}) {'' if n.endswith('lo') else '+ 1D'}), -1), {size[n[0]]}) as int)") for n, e in ends.items()}
    j = j.withColumns(bounds)
    j = j.withColumn("meets", (F.col("xhi") >= 0) & (F.col("yhi") >= 0) & (F.col("xlo") <= F.col("w") - 1) & (F.col("ylo") <= F.col("h") - 1))
    first, to = (lambda a: F.floor(F.greatest(F.lit(0), F.col(f"{a}lo")) / tile).cast("int")), (lambda a: F.floor(F.least(F.col(size[a]) - 1, F.col(f"{a}hi")) / tile).cast("int"))
    j = j.withColumns({"tx0": first("x"), "tx1": F.greatest(first("x"), to("x")), "ty0": first("y"), "ty1": F.greatest(first("y"), to("y"))}).drop("xlo", "xhi", "ylo", "yhi")
    needs = F.when(F.col("meets"), F.flatten(F.transform(F.sequence("ty0", "ty1"), lambda ty: F.transform(F.sequence("tx0", "tx1"), lambda tx: F.struct(tx.alias("tx"), ty.alias("ty"))))))
    about = [c for c in j.columns if c not in keys and c not in ("_p", "ox", "oy")]
    need = j.withColumn("t", F.explode_outer(needs)).select(*keys, "_p", "ox", "oy", F.struct(*about).alias("a"), F.col("t.tx").alias("tx"), F.col("t.ty").alias("ty"))
    src = tiles.select(F.col(PHOTO).alias("_p"), "tx", "ty", "data")
    met = need.join(src, ["_p", "tx", "ty"], "left")
    met = met.groupBy(*keys, "ox", "oy").agg(F.first("a").alias("a"), F.collect_list(F.when(F.col("data").isNotNull(), F.struct("ty", "tx", "data"))).alias("ts"))
    rows = met.select(F.struct(*keys).alias("k"), "a.*", "ts")
    kinds = ", ".join(f"{c} {jobs.schema[c].dataType.simpleString()}" for c in keys)
    tone = ", ".join(f"{c} int" for c in ("x", "y", *"rgb"))
    out = rows.mapInArrow(lambda batches: _filled(batches, fill, tile), f"k struct<{kinds.replace(' ', ':').replace(',:', ',')}>, {tone}, in_photo boolean")
    return out.select("k.*", "x", "y", *"rgb", "in_photo")


def _filled(batches, fill, tile):
    """Output pixels of output tiles, many tiles at once, blended from the source tiles that each of them reads."""
    packed = fill[0] << 16 | fill[1] << 8 | fill[2]
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        whole = lambda name: pa.compute.fill_null(get(name), 0).to_numpy().astype(int)
        side = {c: whole(c) for c in ("xa", "xb", "ya", "yb", "w", "h", "tx0", "tx1", "ty0", "ty1")}
        meets = pa.compute.fill_null(get("meets"), False).to_numpy(zero_copy_only=False)
        wide, high = side["xb"] - side["xa"] + 1, side["yb"] - side["ya"] + 1
        across = side["tx1"] - side["tx0"] + 1
        slots = np.where(meets, across * (side["ty1"] - side["ty0"] + 1), 0)  # source tiles that an output tile may read
        held = np.cumsum(wide * high + slots * tile * tile)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(held, (held[begin - 1] if begin else 0) + AT_ONCE, "right")))
            at = slice(begin, end)
            part = {c: v[at] for c, v in side.items()}
            part.update(wide=wide[at], across=across[at], slots=slots[at], meets=meets[at], size=(wide * high)[at])
            m, o = get("m").slice(begin, end - begin).flatten().to_numpy().reshape(-1, 9).T, get("o").to_numpy()[at]
            row, *columns = _blended(part, m, o, get("ts").slice(begin, end - begin), fill, packed, tile)
            key = batch.column(0).take(pa.array(row + begin))
            yield pa.RecordBatch.from_arrays([key, *columns], ["k", "x", "y", "r", "g", "b", "in_photo"])
            begin = end


def _blended(part, m, o, ts, fill, packed, tile):
    """(row, x, y, r, g, b, in_photo) of some output tiles; ``m`` nine rows of numbers, ``ts`` the source tiles of each."""
    size, n = part["size"], len(part["size"])
    row = np.repeat(np.arange(n), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    of = lambda name: part[name][row]
    x, y = of("xa") + k % of("wide"), of("ya") + k // of("wide")
    w, h, o, m = of("w"), of("h"), o[row], m[:, row]
    u, v = x + o, y + o
    with np.errstate(divide="ignore", invalid="ignore"):
        z = m[6] * u + m[7] * v + m[8]
        sx, sy = (m[0] * u + m[1] * v + m[2]) / z - o, (m[3] * u + m[4] * v + m[5]) / z - o
        ok = (sx >= 0) & (sy >= 0) & (sx <= w - 1) & (sy <= h - 1) & (z != 0) & of("meets")
    tones = np.empty((3, len(x)), np.int32)
    tones[:] = np.array(fill, np.int32)[:, None]
    at = np.flatnonzero(ok)
    if len(at):
        first = np.cumsum(part["slots"]) - part["slots"]
        owner = np.repeat(np.arange(n), pa.compute.fill_null(pa.compute.list_value_length(ts), 0).to_numpy())
        ty, tx, data = ts.flatten().flatten()
        data = np.vstack([pa.compute.fill_null(data.flatten(), packed).to_numpy().reshape(-1, tile * tile), np.full((1, tile * tile), packed, np.int32)])
        source = np.full(part["slots"].sum(), len(data) - 1)  # tiles without pixels have the fill's colour
        source[first[owner] + (ty.to_numpy() - part["ty0"][owner]) * part["across"][owner] + tx.to_numpy() - part["tx0"][owner]] = np.arange(len(owner))
        sx, sy, row_ = sx[at], sy[at], row[at]
        x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
        fx, fy = sx - x0, sy - y0
        x1, y1 = np.minimum(w[at] - 1, x0 + 1), np.minimum(h[at] - 1, y0 + 1)
        base, left, top, across = first[row_], part["tx0"][row_], part["ty0"][row_], part["across"][row_]
        look = lambda q, p: data[source[base + (q // tile - top) * across + p // tile - left], q % tile * tile + p % tile]
        a, b, c, d = look(y0, x0), look(y0, x1), look(y1, x0), look(y1, x1)
        for i, shift in enumerate((16, 8, 0)):
            a_, b_, c_, d_ = ((t >> shift & 255).astype(float) for t in (a, b, c, d))
            tones[i, at] = np.rint((a_ * (1 - fx) + b_ * fx) * (1 - fy) + (c_ * (1 - fx) + d_ * fx) * fy)
    return row, pa.array(x, pa.int32()), pa.array(y, pa.int32()), *map(pa.array, tones), pa.array(ok)


def crop_jobs(quads: DataFrame, sizes: DataFrame, max_edge=MAX_EDGE) -> DataFrame:
    """(id, photo_id, w, h, ow, oh, m, o): how each quad is cut out; a side under a pixel leaves nothing.

    quads(id, photo_id, quad), sizes(photo_id, w, h).
    """
    q = quads.select("id", PHOTO, "quad").join(sizes.select(PHOTO, "w", "h"), PHOTO)
    x, y = [F.get("quad", F.lit(2 * i)) * F.col("w") for i in range(4)], [F.get("quad", F.lit(2 * i + 1)) * F.col("h") for i in range(4)]
    side = lambda a, b: F.sqrt((x[b] - x[a]) * (x[b] - x[a]) + (y[b] - y[a]) * (y[b] - y[a]))
    q = q.withColumns({"sw": (side(0, 1) + side(3, 2)) / 2, "sh": (side(0, 3) + side(1, 2)) / 2}).where((F.col("sw") >= 1) & (F.col("sh") >= 1))
    q = q.withColumn("s", F.least(F.lit(float(ENLARGE)), max_edge / F.greatest("sw", "sh")))
    out = lambda c: F.greatest(F.lit(1), half_up(F.col(c) * F.col("s"))).cast("int")
    q = q.withColumns({"ow": out("sw"), "oh": out("sh")})
    return q.withColumn("m", quad_map(F.col("quad"), F.col("w"), F.col("h"), F.col("ow"), F.col("oh"))).select("id", PHOTO, "w", "h", "ow", "oh", "m", F.lit(0.5).alias("o")).where(F.get("m", F.lit(0)).isNotNull())


def crop_pixels(pixels: DataFrame, quads: DataFrame, max_edge=MAX_EDGE, tile=TILE) -> DataFrame:
    """(id, x, y, r, g, b, in_photo): each quad cut out of its photo, upright; gray past the photo's edge."""
    jobs = crop_jobs(quads, pixels.select(PHOTO, "w", "h").distinct(), max_edge)
    return gather(jobs, pixel_tiles(pixels, tile), ["id"], (CROP_FILL,) * 3, tile)


def warp_pixels(pixels: DataFrame, maps: DataFrame, fill=(WARP_FILL,) * 3, tile=TILE) -> DataFrame:
    """(photo_id, x, y, r, g, b, in_photo): photos resampled onto their flat size.

    maps(photo_id, m, ow, oh): nine numbers from flat to photo places (``inv3`` of the flattening), and the flat size.
    """
    jobs = maps.select(PHOTO, "m", "ow", "oh").join(pixels.select(PHOTO, "w", "h").distinct(), PHOTO).withColumn("o", F.lit(0.0))
    return gather(jobs.withColumn("_k", F.col(PHOTO)), pixel_tiles(pixels, tile), ["_k"], fill, tile).withColumnRenamed("_k", PHOTO)
