"""Quality by Bradley-Terry ranking: documents are scored so that preferred ones win their pairs.

Every preference pair (a good document over a poor one) adds the logistic loss of the difference of
their features; the fitted score orders documents, and a quantile of the training scores (the share
of poor documents there) is the threshold. All labelled documents outside the held-out remainder are
learned from, whole: they stay in Spark as rows of features, and each Newton step sums over their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.sample import labelled, remainder
from inkspan.llm.words import U, column, slices, words
from inkspan.session import cut_lineage

ROUND = 1024  # labelled documents that are compared among themselves, about
PAIRS = 12  # good documents that each poor one is compared with
STILL = 1e-9  # the fit ends when no weight moves further
BINS = 4096  # of scores, narrowed down to the threshold
MOD, HELD = 5, 0
THRESHOLD = 0.3
SCORED = "doc_id bigint, held_out boolean, score double, predicted int"

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|<>{}[]\\/=_~^", b"#$%&*@+", b",;:.'\"()-", b"\n", b" \t"]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _k, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _k


def features(column_) -> np.ndarray:
    """One row of numbers per text: shares of character kinds, repetition, word and line lengths."""
    w = words(column_)
    n, size = len(w.first) - 1, np.maximum(np.diff(w.offsets), 1).astype(float)
    kind = _KIND[w.data]
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    per = lambda mask: np.diff(cum(mask)[w.offsets])
    counts = [per(kind == k) for k in range(len(_KINDS))]
    out = [np.sqrt(c / size) for c in counts]
    nw = w.count()
    some = np.maximum(nw, 1).astype(float)
    owner = w.owner()
    same = np.zeros(len(w.hash), bool)
    if len(same):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    by_word = lambda x: np.diff(cum(x)[w.first])
    out.append(np.sqrt(by_word(same) / some))
    out.append(by_word(w.end - w.start) / some)
    out.append(np.log1p(nw))
    out.append(np.log1p(nw / (counts[6] + 1.0)))
    for k in (1, 3):
        doc, h = (owner, w.hash) if k == 1 else w.shingles(k)
        key = np.sort((doc.astype(U) << U(40)) | (h >> U(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        d = (key >> U(40)).astype(np.int64)
        total, distinct = np.bincount(d, minlength=n), np.bincount(d, new, n)
        out.append(1 - distinct / np.maximum(total, 1))
        if k == 1:
            runs = np.diff(np.append(np.flatnonzero(new), len(key)))
            top = np.zeros(n)
            np.maximum.at(top, d[new], runs)
            out.append(np.sqrt(top / some))
            out.append(np.log1p(distinct))
    out.append((nw == 0).astype(float))
    return np.stack(out, 1) if n else np.zeros((0, len(out)))


def _vectors(batches):
    for batch in batches:
        for part in slices(batch):
            x = features(column(part, "text"))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def _totals(parts: DataFrame) -> np.ndarray:
    """Sums of v by place i, exact in decimals, so that they do not depend on the order of the tasks."""
    rows = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("v")).toArrow()  # a few hundred places
    out = np.zeros(rows.num_rows)
    out[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return out


def _standard(x, mean, spread):
    return np.clip((x - mean) / spread, -6, 6)


def _slopes(mean, spread, weight):
    """Sums at these weights over the pairs of each round: their number, gradient and curvature of their logistic loss."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column(0)[k].values  # a round's documents, ordered by id
                y, x = held.field("y").to_numpy(), held.field("x").flatten().to_numpy().reshape(len(held), -1)
                good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
                if not len(good) or not len(poor):
                    continue
                z = _standard(x, mean, spread)
                pick = (np.arange(len(poor) * PAIRS) * 2654435761 + 12345) % len(good)
                diff = z[good[pick]] - z[np.repeat(poor, PAIRS)]
                p = 1 / (1 + np.exp(-np.clip(diff @ weight, -30, 30)))
                sums = np.concatenate([[len(diff)], diff.T @ (p - 1), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["i", "v"])

    return run


def _at_rank(scores: DataFrame, rank: int, low: float, high: float) -> float:
    """The score of a rank (0-based, ascending): bins are counted and the one that holds it is cut again."""
    while True:
        held = scores.where(F.col("s").between(low, high))
        at = F.least(F.floor((F.col("s") - low) / max((high - low) / BINS, 5e-324)), F.lit(BINS - 1))
        bins = sorted(held.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect(), key=lambda r: r.lo)
        for b in bins:
            if rank < b.n:
                break
            rank -= b.n
        if b.lo == b.hi:
            return b.lo
        if b.n <= BINS:
            return sorted(r.s for r in scores.where(F.col("s").between(b.lo, b.hi)).collect())[rank]
        low, high = b.lo, b.hi


def fit(docs: DataFrame, labels: DataFrame, steps=30):
    """Model of all labelled documents: feature means and spreads, weights, threshold.

    Documents are dealt by a hash of their id to rounds of some ``ROUND``; in a round every poor one meets
    ``PAIRS`` good ones. Only sums, a few hundred numbers, come to the driver.
    """
    rows = cut_lineage(labelled(docs, labels, "quality", MOD, HELD).mapInArrow(_vectors, "doc_id bigint, y int, x array<double>"))
    n, n_poor = rows.agg(F.count(F.lit(1)), F.sum(1 - F.col("y"))).first()
    if not n:
        return None
    sums = _totals(rows.select(F.posexplode("x").alias("i", "v")).select(F.inline(F.array(F.struct((2 * F.col("i")).alias("i"), "v"), F.struct((2 * F.col("i") + 1).alias("i"), (F.col("v") * F.col("v")).alias("v"))))))
    mean = sums[::2] / n
    spread = np.maximum(np.sqrt(np.maximum(sums[1::2] / n - mean**2, 0)), 1e-6)
    weight, d = np.zeros(len(mean)), len(mean)
    if 0 < n_poor < n:
        rounds = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // ROUND))).alias("round"))
        rounds = cut_lineage(rounds.agg(F.sort_array(F.collect_list(F.struct("doc_id", "y", "x"))).alias("held")).select("held"))
        for _ in range(steps):  # Newton's method
            sums = _totals(rounds.mapInArrow(_slopes(mean, spread, weight), "i int, v double"))
            if not len(sums):  # no round holds both kinds
                break
            sums = sums[1:] / sums[0]
            move = np.linalg.solve(sums[d:].reshape(d, d) + 1e-3 * np.eye(d), sums[:d] + 1e-3 * weight)
            weight = weight - move
            if np.abs(move).max() < STILL:
                break

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_standard(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), mean, spread) @ weight)], ["s"])

    scores = cut_lineage(rows.select("x").mapInArrow(scored, "s double"))
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    if not 0 < n_poor < n:
        return mean, spread, weight, low - 1 if not n_poor else high + 1
    place = (n - 1) * (n_poor / n)  # between two ranks, as quantiles are read
    below = _at_rank(scores, int(place), low, high)
    above = _at_rank(scores, min(int(place) + 1, n - 1), low, high)
    return mean, spread, weight, float(below + (above - below) * (place - int(place)))


def apply(model, x):
    """Scores in 0..1 that equal THRESHOLD at the model's quantile."""
    if model is None:
        return np.full(len(x), 0.5)
    mean, spread, weight, cut = model
    s = _standard(x, mean, spread) @ weight - cut + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def score(docs: DataFrame, model) -> DataFrame:
    """One row per document. Null and empty texts get the score of a text without words; repeated ids are scored per row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = apply(sent.value, features(column(part, "text")))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), (remainder(MOD) == HELD).alias("held_out"))
    return docs.mapInArrow(run, SCORED)
