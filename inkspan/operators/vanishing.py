"""Vanishing points of a photo's segments: the point most of a family's length runs toward.

Segments of a photo's family are folded into one row. Every pair of them proposes a point; proposals are
scored against all segments in blocks, so a task holds one family's segments and one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHOTO = "photo_id"

# Reach of a family, how far a segment may point past a proposal, least length, spread and distance
# (of the longer side) of an accepted point, and what counts as infinitely far.
FAMILY, MISFIT, LENGTH, SPREAD, OUTSIDE, FAR = 32.0, 1.5, 0.7, 0.15, 1.1, 1e-9
BLOCK = 1 << 20  # comparisons at once

FOUND = "vx double, vy double, vz double, score double, inliers int, length double, share double, spread double, accepted boolean"


def misfits(v, mid, way):
    """Angles between segments (middles, directions) and the directions to points (rows of v): ... x points x segments."""
    far = np.abs(v[..., 2]) < FAR
    scale = np.where(far, 1.0, v[..., 2])
    to = v[..., None, :2] / scale[..., None, None] - np.where(far[..., None, None], 0.0, mid[..., None, :, :])
    way = way[..., None, :, :]
    along = np.abs(to[..., 0] * way[..., 0] + to[..., 1] * way[..., 1])
    size = np.hypot(to[..., 0], to[..., 1]) * np.hypot(way[..., 0], way[..., 1])
    return np.arccos(np.minimum(1.0, along / np.where(size == 0, 1.0, size)))


def vanishing(ends, long_side):
    """(which, columns of FOUND) for families of as many segments each; families that agree on nothing are left out.

    ends: families x segments x (x1, y1, x2, y2 from the photo's middle), two segments at least; long_side: a number a family.
    """
    g, n = ends.shape[:2]
    mid, way = (ends[..., :2] + ends[..., 2:]) / 2, ends[..., 2:] - ends[..., :2]
    length = np.hypot(way[..., 0], way[..., 1])
    one = np.ones((g, n, 1))
    lines = np.cross(np.concatenate([ends[..., :2], one], 2), np.concatenate([ends[..., 2:], one], 2))
    size = np.hypot(lines[..., 0], lines[..., 1])
    lines = lines / np.where(size == 0, 1.0, size)[..., None]
    i, j = np.triu_indices(n, 1)
    best, score = np.zeros((g, 3)), np.full(g, -1.0)
    for at in range(0, len(i), step := max(1, BLOCK // (n * g))):
        v = np.cross(lines[:, i[at : at + step]], lines[:, j[at : at + step]])
        norm = np.sqrt((v * v).sum(2))
        v = v / np.where(norm > 0, norm, 1.0)[..., None]
        s = np.round(((misfits(v, mid, way) < np.radians(MISFIT)) @ (length * length)[..., None])[..., 0], 6)
        s = np.where(norm > 0, s, -1.0)
        top = s.argmax(1)
        more = s.max(1) > score
        best[more], score[more] = v[np.arange(g), top][more], s.max(1)[more]
    near = misfits(best[:, None], mid, way)[:, 0] < np.radians(2 * MISFIT)
    which = np.flatnonzero((score >= 0) & (near.sum(1) >= 2))
    near, mid, lines, length, side = near[which], mid[which], lines[which], length[which], long_side[which]
    rows = lines * (length * near)[..., None]
    v = np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)[1][:, :, 0]  # the point closest to all of them
    v = v * np.where(v[:, 2] < 0, -1.0, 1.0)[:, None]
    far = np.abs(v[:, 2]) < FAR
    point = v[:, :2] / np.where(far, 1.0, v[:, 2])[:, None]
    to = point[:, None] - np.where(far[:, None, None], 0.0, mid)
    off = (-mid[..., 0] * to[..., 1] + mid[..., 1] * to[..., 0]) / np.maximum(np.hypot(to[..., 0], to[..., 1]), 1e-300)
    spread = (np.where(near, off, -np.inf).max(1, initial=-np.inf) - np.where(near, off, np.inf).min(1, initial=np.inf)) / side
    own = (length * near).sum(1)
    accepted = (own >= LENGTH * side) & (spread >= SPREAD) & (far | (np.hypot(*point.T) >= OUTSIDE * side))
    return which, (*v.T, score[which], near.sum(1), own, own / length.sum(1), spread, accepted)


def vanishing_points(segments: DataFrame) -> DataFrame:
    """(photo_id, family, vx, vy, vz, score, inliers, length, share, spread, accepted): per photo and family its vanishing point.

    segments(photo_id, w, h, x1, y1, x2, y2). Families lie within 32 degrees of upright or level; points are
    homogeneous, from the photo's middle. Of equal scores the earliest pair counts, segments being
    ordered by their ends. A family whose lines agree on nothing has no row.
    """
    angle = F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0))
    family = F.when(F.abs(angle - 90) < FAMILY, "upright").when((angle < FAMILY) | (angle > 180 - FAMILY), "level")
    s = segments.withColumn("family", family).where(F.col("family").isNotNull())
    at = lambda c, size: F.col(c).cast("double") - F.col(size) / 2
    ends = F.struct(at("x1", "w").alias("a"), at("y1", "h").alias("b"), at("x2", "w").alias("c"), at("y2", "h").alias("d"))
    rows = s.groupBy(PHOTO, "family").agg(F.max(F.greatest("w", "h")).cast("double").alias("side"), F.sort_array(F.collect_list(ends)).alias("ends"))
    kind = segments.schema[PHOTO].dataType.simpleString()

    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = [{"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            sides, lists = batch.column(2).to_numpy(), batch.column(3)
            sizes = lists.value_lengths().to_numpy()
            for n in np.unique(sizes[sizes > 1]):  # families of one size are scored together
                of, together = np.flatnonzero(sizes == n), max(1, BLOCK // int(n * n * (n - 1) // 2))
                for at in range(0, len(of), together):
                    part = of[at : at + together]
                    ends = np.stack([c.to_numpy(zero_copy_only=False) for c in lists.take(pa.array(part)).flatten().flatten()], 1)
                    which, cols = vanishing(ends.reshape(len(part), n, 4), sides[part])
                    of_ = pa.array(part[which])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of_), batch.column(1).take(of_), *[pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)]], [PHOTO, "family", *names])

    return rows.select(PHOTO, "family", "side", "ends").mapInArrow(run, f"{PHOTO} {kind}, family string, {FOUND}")
