"""Colour arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v):
    return v if isinstance(v, Column) else F.lit(float(v))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 54 + g * 183 + b * 19, 8)


def luma_float(r, g, b) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def color_dist(r1, g1, b1, r2, g2, b2) -> Column:
    """Redmean distance."""
    r1, g1, b1, r2, g2, b2 = map(_c, (r1, g1, b1, r2, g2, b2))
    rm = (r1 + r2) / 2.0
    dr, dg, db = r1 - r2, g1 - g2, b1 - b2
    return F.sqrt((F.lit(2.0) + rm / 256.0) * dr * dr + F.lit(4.0) * dg * dg + (F.lit(2.0) + (F.lit(255.0) - rm) / 256.0) * db * db)


def min_color_dist(r, g, b, seeds) -> Column:
    """Least distance to any of a short list of (r, g, b) seeds."""
    d = [color_dist(r, g, b, *s) for s in seeds]
    return d[0] if len(d) == 1 else F.least(*d)


def axis_position(r, g, b, paint, wall):
    """(u, off-axis distance squared, axis length squared) in redmean-weighted colour."""
    pr, pg, pb, wr, wg, wb = map(_c, (*paint, *wall))
    rm = (pr + wr) / 2.0
    k = (F.sqrt(F.lit(2.0) + rm / 256.0), F.lit(2.0), F.sqrt(F.lit(2.0) + (F.lit(255.0) - rm) / 256.0))
    ax = [(p - w) * f for p, w, f in zip((pr, pg, pb), (wr, wg, wb), k)]
    v = [(_c(q) - w) * f for q, w, f in zip((r, g, b), (wr, wg, wb), k)]
    len2 = ax[0] * ax[0] + ax[1] * ax[1] + ax[2] * ax[2]
    u = (v[0] * ax[0] + v[1] * ax[1] + v[2] * ax[2]) / F.nullif(len2, F.lit(0.0))
    off = [vi - u * ai for vi, ai in zip(v, ax)]
    return u, off[0] * off[0] + off[1] * off[1] + off[2] * off[2], len2


def axis_dist(r, g, b, paint, wall) -> Column:
    """Distance to the paint along wall -> paint; what lies past the paint counts as paint."""
    u, off2, len2 = axis_position(r, g, b, paint, wall)
    u = F.least(u, F.lit(1.0))
    d = F.sqrt(off2 + (F.lit(1.0) - u) * (F.lit(1.0) - u) * len2)
    return F.when(len2 < 1, color_dist(r, g, b, *paint)).otherwise(d)


def saturation(r, g, b) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def hue(r, g, b) -> Column:
    """Degrees, NULL where nearly gray."""
    mx, d = F.greatest(r, g, b), saturation(r, g, b)
    dd = F.nullif(d, F.lit(0))
    h = (
        F.when(mx == r, ((g - b) / dd) % 6)
        .when(mx == g, (b - r) / dd + 2)
        .otherwise((r - g) / dd + 4)
    ) * 60
    return F.when(~((d < 40) & (d < mx * 0.35)), F.when(h < 0, h + 360).otherwise(h))
