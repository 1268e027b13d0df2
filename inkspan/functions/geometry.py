"""Projective maps and photo provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.numbers import half_up


def _h(h, i):
    return h[i] if isinstance(h, Column) else F.lit(float(h[i]))


def apply_h(h, x: Column, y: Column):
    """(u, v) of a projective map of eight numbers, the ninth being 1."""
    w = _h(h, 6) * x + _h(h, 7) * y + 1
    return (_h(h, 0) * x + _h(h, 1) * y + _h(h, 2)) / w, (_h(h, 3) * x + _h(h, 4) * y + _h(h, 5)) / w


def inv3(m):
    """Inverse of a 3x3 (nine columns or numbers) by cofactors, scaled so its last entry is 1; NULL if singular."""
    a, b, c, d, e, f, g, h, i = (v if isinstance(v, Column) else F.lit(float(v)) for v in m)
    co = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    det = a * co[0] + b * co[3] + c * co[6]
    last = F.when((F.abs(det) > 1e-12) & (F.abs(co[8]) > 1e-12), co[8])
    return F.array(*[v / last for v in co[:8]])


def sub_frame(f, view_w, view_h, x, y, w, h):
    """A crop of a frame, as fractions of the whole: f = struct(x, y, w, h)."""
    return F.struct((f["x"] + x / view_w * f["w"]).alias("x"), (f["y"] + y / view_h * f["h"]).alias("y"), (w / view_w * f["w"]).alias("w"), (h / view_h * f["h"]).alias("h"))


def photo_quad(c: DataFrame, digits=4) -> DataFrame:
    """Adds quad: the crop with its margin, as four corners on the photo as shot.

    c(fw, fh frame size, cx, cy, cw, ch crop in pixels, angle degrees[, demo]). NULL where the crop leaves
    nothing, the frame is degenerate, the turn is too steep, or the item is a demo wall.
    """
    pad = half_up(F.greatest("cw", "ch") * 0.15)
    x0, y0 = F.greatest(F.lit(0), F.col("cx") - pad), F.greatest(F.lit(0), F.col("cy") - pad)
    x1, y1 = F.least(F.col("fw"), F.col("cx") + F.col("cw") + pad), F.least(F.col("fh"), F.col("cy") + F.col("ch") + pad)
    t = c.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1, "_c": F.cos(F.radians(-F.col("angle"))), "_s": F.sin(F.radians(-F.col("angle")))})
    det = F.nullif(F.col("_c") * F.col("_c") - F.col("_s") * F.col("_s"), F.lit(0.0))
    ca, sa = F.abs("_c"), F.abs("_s")
    t = t.withColumns({"_det": det, "_pw": (F.col("fw") * ca - F.col("fh") * sa) / det, "_ph": (F.col("fh") * ca - F.col("fw") * sa) / det})
    out = []
    for x, y in (("_x0", "_y0"), ("_x1", "_y0"), ("_x1", "_y1"), ("_x0", "_y1")):
        dx, dy = F.col(x) - F.col("fw") / 2, F.col(y) - F.col("fh") / 2
        out += [(dx * F.col("_c") + dy * F.col("_s") + F.col("_pw") / 2) / F.col("_pw"), (-dx * F.col("_s") + dy * F.col("_c") + F.col("_ph") / 2) / F.col("_ph")]
    ok = (F.col("_det") > 0.2) & (F.col("_pw") > 0) & (F.col("_ph") > 0) & (F.col("_x1") - F.col("_x0") >= 1) & (F.col("_y1") - F.col("_y0") >= 1)
    if "demo" in c.columns:
        ok = ok & ~F.col("demo")
    q = F.when(ok, F.array(*[v if digits is None else half_up(v, digits) for v in out]))
    return t.withColumn("quad", q).drop("_x0", "_y0", "_x1", "_y1", "_c", "_s", "_det", "_pw", "_ph")
