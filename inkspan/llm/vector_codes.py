"""Vector code compression: eight small codebooks, fitted by Lloyd rounds that look only at what moved.

Components become whole numbers (floor of 4096 times the component), vectors are cut in eight
consecutive parts, and each part position has a codebook of sixteen entries. Between rounds every
part keeps its entry and its exact squared distance. In the next round a part whose entry stayed
fixed compares only the entries that moved with the stored distance (the others are no nearer than
before); a part whose entry moved looks at all. Ties go to the lower index either way.

Vectors never move: a round is one pass over cached rows, sums per part and entry combine in the
task and then map-side, and only the codebooks (16 entries of one vector's length) pass through the
driver. A lost executor's rows are computed again from the table.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; equal
vec_ids seed entries in the order of their vectors, a null vec_id comes last; of fewer than sixteen
rows each is an entry; vectors whose length is no multiple of eight, or less than the longest, are
filled up with zeros; whole numbers beyond 2^62 count as 2^62, sums of errors beyond a long as its
greatest value. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.totals import attach
from inkspan.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 2**62
LONG_MAX = 2**63 - 1
EXACT = 2.0**53  # whole numbers below this are exact in double precision
SLICE = 1 << 20  # components handled at once inside a task


def whole(values) -> np.ndarray:
    """floor(4096 x) as whole numbers: doubles where these are exact, Python integers where not."""
    with np.errstate(over="ignore"):
        v = np.floor(np.asarray(values, float) * SCALE)
    if not len(v) or np.abs(v).max() < EXACT:
        return v
    return np.array([max(-LARGEST, min(LARGEST, int(x))) if np.isfinite(x) else (LARGEST if x > 0 else -LARGEST) for x in v], object)


def distances(x, entries) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    peak = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * peak * peak < EXACT:
        x, entries = x.astype(float), entries.astype(float)
        return (x * x).sum(1)[:, None] - 2 * x @ entries.T + (entries * entries).sum(1)[None, :]
    exact = np.vectorize(int, otypes=[object])
    x, entries = exact(x), exact(entries)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def _stored(d):
    """Distances as longs; -1 where one is too large to be stored."""
    return np.array([int(v) if v <= LONG_MAX else -1 for v in d], np.int64) if d.dtype == object else d.astype(np.int64)


def reassign(x, code, near, entries, moved):
    """Nearest entries of the rows of one part position, in place; ``moved`` marks entries that changed."""
    fixed = ~moved[code] & (near >= 0)
    some = np.flatnonzero(fixed)
    m = np.flatnonzero(moved)
    if len(some) and len(m):
        d = distances(x[some], entries[m])
        j = d.argmin(1)
        best = d[np.arange(len(some)), j]
        better = ((best < near[some]) | ((best == near[some]) & (m[j] < code[some]))).astype(bool)
        code[some[better]], near[some[better]] = m[j[better]], _stored(best[better])
    rest = np.flatnonzero(~fixed)
    if len(rest):
        d = distances(x[rest], entries)
        j = d.argmin(1)
        code[rest], near[rest] = j, _stored(d[np.arange(len(rest)), j])


@dataclass
class Codebooks:
    """Entries (part, entry, position) and which of them moved in the last round."""

    entries: np.ndarray
    moved: np.ndarray

    @property
    def width(self):
        return self.entries.shape[2]

    def text(self):
        return ",".join(str(int(v)) for v in self.entries.ravel())

    def updated(self, sums):
        """Entries replaced by floor(sum / count) where ``sums`` has (part, entry): (count, sums)."""
        new, moved = self.entries.astype(object), np.zeros(self.moved.shape, bool)
        for (part, entry), (n, total) in sums.items():
            new[part, entry] = [t // n for t in total]
            moved[part, entry] = (new[part, entry] != self.entries[part, entry]).any()
        return Codebooks(_compact(new), moved)


def _compact(entries):
    return entries.astype(float) if np.abs(entries).max(initial=0) < EXACT else entries


def _parts(lists, width):
    """Whole numbers of a list array, as (row, part, position)."""
    n = len(lists)
    lengths = np.diff(lists.offsets.to_numpy())
    values = whole(lists.flatten().to_numpy(zero_copy_only=False))
    if (lengths != PARTS * width).any():
        filled = np.zeros((n, PARTS * width), values.dtype)
        filled[np.arange(PARTS * width)[None, :] < lengths[:, None]] = values
        values = filled
    return values.reshape(n, PARTS, width)


STATE = "vec_id bigint, {label}x array<double>, code binary, near array<bigint>"


def _step(batches, books):
    """Rows with their entries and distances brought up to date."""
    width, k = books.width, books.entries.shape[1]
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows := max(1, SLICE // max(1, PARTS * width))):
            cut = batch.slice(at, rows)
            n = cut.num_rows
            if not n:
                continue
            x = _parts(cut.column(cut.schema.get_field_index("x")), width)
            code = np.zeros((n, PARTS), np.uint8)
            near = np.full((n, PARTS), -1, np.int64)
            if "code" in cut.schema.names:
                code = np.frombuffer(b"".join(cut.column("code").to_pylist()), np.uint8).reshape(n, PARTS).copy()
                near = cut.column("near").flatten().to_numpy().reshape(n, PARTS).copy()
            assert k <= 256
            for p in range(PARTS):
                c, d = code[:, p].copy(), near[:, p].copy()
                reassign(x[:, p], c, d, books.entries[p], books.moved[p])
                code[:, p], near[:, p] = c, d
            yield cut, x, code, near


def _state(cut, code, near, names):
    codes = pa.array([row.tobytes() for row in code], pa.binary())
    dist = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, PARTS), pa.int32()), pa.array(near.ravel()))
    return pa.RecordBatch.from_arrays([*[cut.column(n) for n in names], codes, dist], [*names, "code", "near"])


def _advance(rows: DataFrame, sent, label_type) -> DataFrame:
    def run(batches):
        for cut, _, code, near in _step(batches, sent.value):
            yield _state(cut, code, near, ["vec_id", "label", "x"])

    return rows.mapInArrow(run, STATE.format(label=f"label {label_type}, "))


def _sums(state: DataFrame, width: int) -> dict:
    """(part, entry): (count, sums) of the rows' parts; each task adds up its own first."""

    def run(batches):
        total = {}
        for batch in batches:
            x = _parts(batch.column(batch.schema.get_field_index("x")), width)
            code = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("code")).to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                for e in np.unique(code[:, p]).tolist():
                    mine = x[code[:, p] == e, p]
                    peak = float(np.abs(mine).max(initial=0)) * len(mine)
                    add = mine.sum(0) if peak < EXACT else np.array([sum(int(v) for v in c) for c in mine.T], object)
                    n, old = total.get((p, e), (0, [0] * width))
                    total[p, e] = (n + len(mine), [a + int(b) for a, b in zip(old, add, strict=True)])
        rows = [(p, e, j, n, Decimal(v)) for (p, e), (n, t) in total.items() for j, v in enumerate(t)]
        kinds = [("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])

    each = state.mapInArrow(run, "part int, entry int, pos int, n bigint, total decimal(38,0)")
    got = each.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = {}
    for r in got.collect():  # 16 entries of one vector's length
        out.setdefault((r.part, r.entry), (r.n, [0] * width))[1][r.pos] = int(r.total)
    return out


def kept(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows whose vector is whole and finite."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), x.alias("x"))
    return rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def seeds(rows: DataFrame, entries: int = ENTRIES):
    """The codebooks that the smallest vec_ids give; None for an empty table."""
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    first = [r.x for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()]
    width = -(-longest // PARTS)
    vectors = _parts(pa.array(first, pa.list_(pa.float64())), width)
    return Codebooks(_compact(vectors.swapaxes(0, 1)), np.ones((PARTS, len(first)), bool))


def fit(embeddings: DataFrame, rounds: int = ROUNDS):
    """(codebooks, codes): final Codebooks and a DataFrame (vec_id, label, code, error) of every kept row."""
    rows = kept(embeddings)
    spark, label_type = rows.sparkSession, rows.schema["label"].dataType.simpleString()
    books, state, older = seeds(rows), rows, None
    if books is None:
        return None, rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    for _ in range(rounds):
        if not books.moved.any():
            break
        newer = _advance(state, spark.sparkContext.broadcast(books), label_type).persist()
        books = books.updated(_sums(newer, books.width))
        if older is not None:
            older.unpersist()
        state = older = newer
    sent = spark.sparkContext.broadcast(books)

    def last(batches):
        for cut, _, code, near in _step(batches, sent.value):
            error = pa.array([LONG_MAX if min(r) < 0 else min(LONG_MAX, sum(r)) for r in near.tolist()], pa.int64())
            codes = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([cut.column("vec_id"), cut.column("label"), codes, error], ["vec_id", "label", "code", "error"])

    codes = cut_lineage(state.mapInArrow(last, f"vec_id bigint, label {label_type}, code string, error bigint"))
    if older is not None:
        older.unpersist()
    return books, codes


def digest(books) -> str:
    return hashlib.sha256((books.text() if books else "").encode()).hexdigest()


def encode(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (of all rows with an equal label,
    null being one), codebooks_sha256."""
    books, codes = fit(embeddings)
    most = F.lit(LONG_MAX)
    per_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")), most.cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return attach(codes, per_label, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``approx``, the vector that a code stands for."""
    parts = []
    for p in range(PARTS):
        table = F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in entry]) for entry in books.entries[p]])
        parts.append(F.element_at(table, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1))
    return codes.withColumn("approx", F.concat(*parts))
