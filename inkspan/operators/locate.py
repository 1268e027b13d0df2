"""Where in a mask a character stands: boxes over places, heights and widths, matched by chamfer score.

A photo's mask is one row; templates are a bounded table every task holds. Coverage of all boxes comes
from summed areas at once. The share of a box's ink near the template's is cheap for all boxes and bounds
the score from above, together with how near the box's ink comes to the template's within some cells, found by
shifting lines of bits; only boxes whose bound reaches the best score so far are scored in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHOTO = "photo_id"

# Grid side, ink levels of probe (more than one part of so many) and template, reach of a match, diagonal step, heights and widths
# tried, least side, steps a side, least fill, longer side searched.
SIDE, PROBE_OF, TEMPLATE, SIGMA2, DIAGONAL = 24, 5, 0.3, 2 * 1.6 * 1.6, 1.41421
HEIGHTS = (1.0, 0.92, 0.85, 0.78, 0.72, 0.66, 0.6, 0.55, 0.5, 0.46, 0.42)
WIDTHS = (0.75, 1.0, 1.3, 1.65)
LEAST, STEPS, FILL, LIMIT = 8, 9, 0.04, 320
TEMPLATE_BYTES = 64 << 20
ROWS_EACH = 20_000  # rows that a search counts as when tasks are sized


def _half_up(v):
    return int(np.floor(v + 0.5))


_cell = np.arange(SIDE * SIDE)
_dx, _dy = (np.abs(a[:, None] - a[None, :]) for a in (_cell % SIDE, _cell // SIDE))
NEAR = np.exp(-((np.maximum(_dx, _dy) + np.minimum(_dx, _dy) * (DIAGONAL - 1)) ** 2) / SIGMA2)  # how near two cells are

# Cells at most so far apart, (columns, rows) by growing distance; a bound of a score counts ink beyond as at BEYOND.
STEPS_NEAR = ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2))
_near = lambda dx, dy: float(np.exp(-((max(dx, dy) + min(dx, dy) * (DIAGONAL - 1)) ** 2) / SIGMA2))
NEAR_STEPS, BEYOND = [_near(*k) for k in STEPS_NEAR], _near(4, 0)


def packed(cells):
    """Grids of cells as 24 lines of 24 bits: a row a line, a column a grid."""
    b = np.packbits(np.ascontiguousarray(cells, bool).reshape(-1, SIDE), axis=1).astype(np.int32)
    return np.ascontiguousarray((b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]).reshape(-1, SIDE).T)


def reaches(ink):
    """For each of STEPS_NEAR the packed cells that have ink at most so far away."""
    wide = [ink]  # by columns apart
    for _ in range(3):
        wide.append(wide[-1] | wide[-1] >> 1 | wide[-1] << 1 & (1 << SIDE) - 1)
    out = np.zeros_like(ink)
    for dx, dy in STEPS_NEAR:
        for across, down in {(dx, dy), (dy, dx)}:
            if not down:
                out |= wide[across]
            else:
                out[down:] |= wide[across][:-down]
                out[:-down] |= wide[across][down:]
        yield out


class Template:
    def __init__(self, grid, aspect):
        self.aspect = aspect
        ink = np.asarray(grid) > TEMPLATE
        self.cells = np.flatnonzero(ink)
        self.near = NEAR[:, self.cells].max(1) if len(self.cells) else np.zeros(SIDE * SIDE)
        self.ink = packed(ink)
        levels = [v for v in np.unique(self.near) if v > 0]
        self.levels = [(v, packed(self.near == v)) for v in levels]  # cells by how near the template comes to them

    def bounds(self, probes):
        """(precision, greatest possible score) of each probe."""
        lines = packed(probes)
        count = lambda bits: np.bitwise_count(bits).sum(0, dtype=np.int32)
        ink = count(lines)
        p = sum((v * count(lines & cells) for v, cells in self.levels), np.zeros(len(ink))) / np.maximum(ink, 1)
        r, before = np.zeros(len(ink)), 0
        for v, bits in zip(NEAR_STEPS, reaches(lines), strict=True):
            n = count(bits & self.ink)
            r += v * (n - before)
            before = n
        r = (r + BEYOND * (len(self.cells) - before)) / len(self.cells) if len(self.cells) else r
        return p, np.where(p > 0, 2 * p * r / np.maximum(p + r, 1e-300), 0.0)

    def score(self, probe, precision):
        cells = np.flatnonzero(probe)
        if not len(cells) or not len(self.cells):
            return 0.0
        recall = NEAR[np.ix_(self.cells, cells)].max(1).mean()
        return 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


def boxes(bounds, aspect):
    """(x, y, w, h) of the boxes tried for a template, in order; bounds are x0, y0, x1, y1 of the ink."""
    x0, y0, x1, y1 = bounds
    bw, bh = x1 - x0 + 1, y1 - y0 + 1
    out = []
    for k in HEIGHTS:
        h = max(LEAST, _half_up(bh * k))
        for m in WIDTHS:
            w = max(LEAST, min(_half_up(h * aspect * m), bw))
            ys = range(y0, y1 + 2 - h, max(2, _half_up((bh - h) / STEPS)))
            xs = range(x0, x1 + 2 - w, max(2, _half_up((bw - w) / STEPS)))
            out += [(x, y, w, h) for y in (ys[:1] if h >= bh else ys) for x in (xs[:1] if w >= bw else xs)]
    return np.array(out, np.int64).reshape(-1, 4)


def probes(sums, found):
    """Inked grid cells of each box, aspect kept, centred."""
    out = np.zeros((len(found), SIDE * SIDE), bool)
    across = np.ascontiguousarray(sums.T, np.int32)
    right, bottom = across.shape[0] - 1, across.shape[1] - 1
    size = found[:, 2] << 32 | found[:, 3]
    order = np.argsort(size, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
        w, h = found[at[0], 2:]
        s = min(SIDE / w, SIDE / h)
        gw, gh = max(1, _half_up(w * s)), max(1, _half_up(h * s))
        ox, oy = (SIDE - gw) // 2, (SIDE - gh) // 2

        def ends(start, n, size, last):
            edge = lambda k: np.floor(start[:, None] + k / n * size).astype(int)
            low = edge(np.arange(n)[None])
            return low.ravel(), np.minimum(np.maximum(low + 1, edge(np.arange(1, n + 1)[None])), last).ravel()

        # boxes of one size stand on a grid of places, whose lines and columns are summed once
        (xs, xi), (ys, yi) = (np.unique(found[at, k], return_inverse=True) for k in (0, 1))
        (xa, xb), (ya, yb) = ends(xs, gw, w, right), ends(ys, gh, h, bottom)
        columns = (across[xb] - across[xa]).T
        area = columns[yb] - columns[ya]
        cells = np.maximum(1, np.multiply.outer((yb - ya).astype(np.int32), (xb - xa).astype(np.int32)))
        inked = (area * PROBE_OF > cells).reshape(len(ys), gh, len(xs), gw)
        grid = np.zeros((len(at), SIDE, SIDE), bool)
        placed, spot = inked.transpose(0, 2, 1, 3), yi * len(xs) + xi
        whole = len(spot) == len(ys) * len(xs) and (spot == np.arange(len(spot))).all()
        grid[:, oy : oy + gh, ox : ox + gw] = placed.reshape(-1, gh, gw) if whole else placed[yi, xi]
        out[at] = grid.reshape(len(at), -1)
    return out


def _small(mask):
    """The mask at 320 cells or less, a cell being ink where a quarter of it is, and the factor."""
    f = -(-max(mask.shape) // LIMIT)
    if f <= 1:
        return mask, 1
    h, w = (-(-n // f) for n in mask.shape)
    padded = np.zeros((h * f, w * f), np.int32)
    padded[: mask.shape[0], : mask.shape[1]] = mask
    there = np.zeros_like(padded)
    there[: mask.shape[0], : mask.shape[1]] = 1
    block = lambda a: a.reshape(h, f, w, f).sum((1, 3))
    return block(padded) * 4 >= block(there), f


def best_box(mask, templates, scored=None):
    """(template number, x, y, w, h, score) of the best box of any template; the first of equal scores. None without ink."""
    full = mask.shape
    mask, f = _small(mask)
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return None
    sums = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    sums[1:, 1:] = mask.astype(np.int64).cumsum(0).cumsum(1)
    best = None
    for number, t in enumerate(templates):
        found = boxes((xs.min(), ys.min(), xs.max(), ys.max()), t.aspect)
        x, y, w, h = found.T
        fill = (sums[y + h, x + w] - sums[y, x + w] - sums[y + h, x] + sums[y, x]) / (w * h)
        found = found[fill >= FILL]
        if not len(found):
            continue
        p = probes(sums, found)
        precision, most = t.bounds(p)
        order = np.argsort(-most, kind="stable")
        for k in order:
            if best is not None and most[k] < best[0] - 1e-12:
                break
            s = t.score(p[k], precision[k])
            if scored is not None:
                scored.append(k)
            if best is None or (round(s, 12), -number, -k) > (round(best[0], 12), -best[1], -best[2]):
                best = (s, number, k, found[k])
    if best is None:
        return None
    x, y, w, h = (int(v) for v in best[3])
    if f > 1:
        x, y = max(0, x * f), max(0, y * f)
        w, h = min(full[1] - x, w * f), min(full[0] - y, h * f)
    return best[1], x, y, w, h, float(best[0])


def locate(ink: DataFrame, wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """(photo_id, ch, tpl, x, y, w, h, score): the best box of each wanted character, by any template in either case.

    ink(photo_id, w, h, x, y); wanted(photo_id, ch); templates(tpl, ch, aspect, grid) with 24 x 24
    coverages in row order, ordered by tpl. Photos without ink, and characters without templates,
    have no row. The templates are checked to be under 64 MB.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from inkspan.operators.masks import to_runs
    from inkspan.session import spread

    spark = ink.sparkSession
    size = templates.agg(F.sum(F.size("grid") * 8)).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates hold {size} bytes, more than {TEMPLATE_BYTES}")
    by = {}
    for r in templates.orderBy("tpl").collect():
        by.setdefault(r.ch.lower(), []).append((r.tpl, Template(r.grid, r.aspect)))
    sent = spark.sparkContext.broadcast(by)
    runs = to_runs(ink.select(PHOTO, "w", "h", "x", "y"))
    runs = runs.groupBy(PHOTO, "w", "h").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")])).alias("runs"))
    rows = runs.join(wanted.select(PHOTO, "ch"), PHOTO).select(PHOTO, "ch", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "runs")
    kind, tpl = ink.schema[PHOTO].dataType.simpleString(), templates.schema["tpl"].dataType.simpleString()
    tpl_type = to_arrow_schema(templates.select("tpl").schema).field(0).type

    def run(batches):
        for batch in batches:
            kept, out = [], []
            for i in range(batch.num_rows):
                ch, w, h = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                known = sent.value.get((ch or "").lower(), [])
                mask = np.zeros((h, w + 1), np.int32)
                y, x0, x1 = (c.to_numpy() for c in batch.column(4)[i].values.flatten())
                np.add.at(mask, (y, x0), 1)
                np.add.at(mask, (y, x1 + 1), -1)
                got = best_box(mask.cumsum(1)[:, :w] > 0, [t for _, t in known]) if known else None
                if got:
                    kept.append(i)
                    out.append((known[got[0]][0], *got[1:]))
            at = pa.array(kept, pa.int64())
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate([tpl_type, *[pa.int32()] * 4, pa.float64()])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *cols], [PHOTO, "ch", "tpl", "x", "y", "w", "h", "score"])

    rows = spread(rows, PHOTO, "ch", rows=wanted.count() * ROWS_EACH)  # a mask is small and its search long
    return rows.mapInArrow(run, f"{PHOTO} {kind}, ch string, tpl {tpl}, x int, y int, w int, h int, score double")
