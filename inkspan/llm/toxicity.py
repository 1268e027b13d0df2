"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence has the logit ``BIAS + sum of its words' weights``, no weight below 0; a document's score is the noisy-or of
its sentences with a leak for labels that no sentence explains: 1 - (1 - leak) * prod(1 - p). The
weights are fitted to document labels alone; afterwards the sentences that carry a document's score
are the offending ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.sample import labelled_texts, remainder
from inkspan.llm.words import U, column, slices, words

TRAIN_DOCS = 8000  # documents in the training sample, about
TRAIN_CHARS = 20_000  # longer documents are not learned from
MIN_DOCS = 5  # training documents a word must stand in
BIAS = -10.0  # logit of a sentence of unknown words: ten thousand of them make a score of 0.37 at most
SURE = 5.0  # standard deviations by which a word must stand in toxic documents oftener than chance
RIDGE = 3e-3  # pull of the weights to 0
MOD, HELD = 4, 2
THRESHOLD = 0.3

SCORED = "doc_id bigint, held_out boolean, score double, predicted int, worst_start bigint, worst_end bigint, worst_score double, n_offending bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
_BREAK = np.zeros(256, bool)
_BREAK[[0x0A, 0x21, 0x2E, 0x3F]] = True


def sentences(w):
    """Number of each word's sentence, counted over all texts: a sentence ends at . ! ? or a line break."""
    breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])
    at = breaks[w.start] + w.owner()
    new = np.concatenate([[False], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    return np.cumsum(new)


def _bags(batches):
    for batch in batches:
        for part in slices(batch):
            w = words(column(part, "text"))
            s = sentences(w)
            y = column(part, "y")
            out = {"y": [], "words": [], "sentence": []}
            for d in range(part.num_rows):
                a, b = w.first[d], w.first[d + 1]
                if b > a:
                    out["y"].append(y[d].as_py())
                    out["words"].append(w.hash[a:b].view(np.int64))
                    out["sentence"].append((s[a:b] - s[a]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(out["y"], pa.int32()), pa.array(out["words"], pa.list_(pa.int64())), pa.array(out["sentence"], pa.list_(pa.int32()))], ["y", "words", "sentence"])


def fit(docs: DataFrame, labels: DataFrame, most=TRAIN_DOCS, steps=200) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted word hashes, their weights, leak) from a bounded sample of labelled documents."""
    bags = labelled_texts(docs, labels, "toxic", MOD, HELD, most, TRAIN_CHARS).mapInArrow(_bags, "y int, words array<bigint>, sentence array<int>").toArrow()
    y = bags.column("y").to_numpy().astype(float)
    if not len(y):
        return np.zeros(0, U), np.zeros(0), 0.0
    lists, sents = bags.column("words").combine_chunks(), bags.column("sentence").combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    h, s = lists.values.to_numpy().view(U), sents.values.to_numpy()
    vocabulary, col = np.unique(h, return_inverse=True)
    pairs = np.unique(np.stack([col, doc]), axis=1)
    n1, n0 = y.sum(), (1 - y).sum()
    d1 = np.bincount(pairs[0], y[pairs[1]], len(vocabulary))
    d0 = np.bincount(pairs[0], 1 - y[pairs[1]], len(vocabulary))
    share = n1 / (n1 + n0)
    beyond = (d1 - (d1 + d0) * share) / np.sqrt(np.maximum((d1 + d0) * share * (1 - share), 1e-9))
    keep = np.flatnonzero((d1 + d0 >= MIN_DOCS) & (beyond >= SURE))
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    number = np.full(len(vocabulary), -1)
    number[keep] = np.arange(len(keep))
    live = np.flatnonzero(number[col] >= 0)
    sentence = np.unique(np.stack([doc[live], s[live]]), axis=1, return_inverse=True)
    owner, inst, col = sentence[0][0], sentence[1].reshape(-1), number[col[live]]
    weight, rate, leak = np.clip(odds[keep], 0, None), 0.1, 0.05
    m, v = np.zeros(len(keep)), np.zeros(len(keep))
    for t in range(1, steps + 1):
        z = BIAS + np.bincount(inst, weight[col], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clear = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        score = 1 - (1 - leak) * clear
        leak = float(np.clip((y * leak / np.maximum(score, 1e-9)).sum() / len(y), 1e-4, 0.5))  # an expectation step
        g = np.where(y[owner] > 0, -((1 - score) / np.maximum(score, 1e-9))[owner] * p, p)
        grad = np.bincount(col, g[inst], len(keep)) + RIDGE * weight
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weight = np.maximum(weight - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8), 0)
    order = np.argsort(vocabulary[keep])
    return vocabulary[keep][order], weight[order], leak


def score(docs: DataFrame, model) -> DataFrame:
    """One row per document of whole texts, with its most offensive sentence as a code point span.

    ``offending`` has the spans of all sentences from the threshold on, in the order of the text.

    The score leaves out the leak, so a text without words, empty or null scores 0 and has a null
    span. Repeated ids are scored per row; a null id is not held out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        vocabulary, weight, _ = sent.value
        filter_ = np.zeros(1 << 16, bool)
        filter_[(vocabulary & U(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch):
                yield _score_part(part, vocabulary, weight, filter_)

    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), (remainder(MOD) == HELD).alias("held_out"))
    return docs.mapInArrow(run, SCORED)


def _score_part(part, vocabulary, weight, filter_):
    w = words(column(part, "text"))
    n = part.num_rows
    s, owner = sentences(w), w.owner()
    many = int(s[-1]) + 1 if len(s) else 0
    z = np.full(many, BIAS)
    hit = np.flatnonzero(filter_[(w.hash & U(0xFFFF)).astype(np.int64)])
    if len(vocabulary) and len(hit):
        at = np.minimum(np.searchsorted(vocabulary, w.hash[hit]), len(vocabulary) - 1)
        good = vocabulary[at] == w.hash[hit]
        z += np.bincount(s[hit[good]], weight[at[good]], many)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if many else np.zeros(0, np.int64)
    last = np.append(first[1:], len(s))[: len(first)] - 1
    of = owner[first] if many else np.zeros(0, np.int64)
    total = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), n) if many else np.zeros(n)
    doc_score = np.clip(1 - np.exp(total), 0, 1)
    bad = np.bincount(of, p >= THRESHOLD, n).astype(np.int64) if many else np.zeros(n, np.int64)
    begin, end, top = [None] * n, [None] * n, [None] * n
    spans = [[] for _ in range(n)]
    order = np.lexsort((np.arange(many), -p, of))
    if many:
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        for i in np.flatnonzero(p >= THRESHOLD):
            base = points[w.offsets[of[i]]]
            spans[of[i]].append({"start": int(points[w.start[first[i]]] - base), "end": int(points[w.end[last[i]]] - base), "score": float(p[i])})
        head = order[np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))]
        for i in head:
            d = of[i]
            base = points[w.offsets[d]]
            begin[d], end[d], top[d] = int(points[w.start[first[i]]] - base), int(points[w.end[last[i]]] - base), float(p[i])
    return pa.RecordBatch.from_arrays(
        [column(part, "doc_id"), column(part, "held_out"), pa.array(doc_score), pa.array((doc_score >= THRESHOLD).astype(np.int32)), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(top, pa.float64()), pa.array(bad), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
        ["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "worst_score", "n_offending", "offending"],
    )
