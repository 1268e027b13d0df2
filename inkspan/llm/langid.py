"""Language identification with a language-bitmask n-gram filter.

One bit-sliced Bloom filter serves all languages: every slot holds a mask with a bit per language,
an n-gram sets its language's bit in its slots, and the AND of an n-gram's slots is the mask of all
languages that may contain it. A document counts, per language, the n-grams whose mask has its bit;
the count is corrected by the language's false positive rate, and the largest corrected share wins.
An n-gram is up to five bytes inside one word, the edges of the word included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.sample import remainder, thin_each
from inkspan.llm.words import _FOLD, U, column, mix, slices, text_buffer

LANG_DOCS = 1500  # documents of each language in the training sample, about
TRAIN_CHARS = 20_000  # longer documents are not learned from
MIN_DOCS = 3  # training documents of a language that an n-gram must stand in
SHARE = 0.2  # of its highest relative frequency that an n-gram needs in a language to belong to it
SLOTS, HASHES = 1 << 20, 2
MOD, HELD = 3, 1
UNKNOWN = "und"
MIN_SCORE = 0.3  # rejected below, where documents are filtered
SCORED = "doc_id bigint, held_out boolean, lang_pred string, score double"


def grams(column_):
    """(five-byte n-grams as integers, where each text's begin)."""
    data, off = text_buffer(column_)
    n = len(off) - 1
    shift = off + np.arange(n + 1) + 1  # a zero byte before, between and after the texts
    t = np.zeros(len(data) + n + 6, np.uint8)
    t[np.arange(len(data)) + np.repeat(np.arange(n) + 1, np.diff(off))] = _FOLD[data]
    at = np.flatnonzero(t[1:-4]) # the byte before each byte of a word
    g = t[at].astype(U) | (t[at + 1].astype(U) << U(8))
    inside = np.ones(len(at), bool)
    for k in (2, 3, 4):
        b = t[at + k]
        inside &= b != 0
        g |= np.where(inside, b, 0).astype(U) << U(8 * k)
    return g, np.searchsorted(at, shift - 1)


def slots(g):
    h = mix(g)
    return [((h >> U(24 * k)) & U(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def _counted(batches):
    for batch in batches:
        for part in slices(batch):
            g, first = grams(column(part, "text"))
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            lang = column(part, "lang").dictionary_encode()
            code = lang.indices.to_numpy()[doc].astype(np.int64)
            order = np.lexsort((doc, g, code))
            c, g, doc = code[order], g[order], doc[order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            first_in_doc = new | np.concatenate([[False], doc[1:] != doc[:-1]])[: len(new)]
            docs = np.add.reduceat(first_in_doc, at) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(c[at])), pa.array(g[at].view(np.int64)), pa.array(np.diff(np.append(at, len(g)))), pa.array(docs.astype(np.int64))], ["lang", "gram", "n", "docs"]
            )


class Filter:
    def __init__(self, langs, table, fill):
        self.langs, self.table, self.fill = langs, table, fill  # table: words of 64 languages x slots


def fit(docs: DataFrame, most=LANG_DOCS) -> Filter:
    """The filter of about ``most`` learning rows of each language, all of them where there are fewer; null languages are not learned."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & (remainder(MOD) != HELD))
    rows = thin_each(rows.where(F.length("text") <= TRAIN_CHARS), most, "lang", "doc_id", "text").select("lang", "text")
    found = rows.mapInArrow(_counted, "lang string, gram bigint, n bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.where(F.col("docs") >= MIN_DOCS).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    lang = found.column("lang").combine_chunks().dictionary_encode()
    langs = lang.dictionary.to_pylist()
    code, gram, n = lang.indices.to_numpy(), found.column("gram").to_numpy().view(U), found.column("n").to_numpy().astype(float)
    share = n / np.bincount(code, n, len(langs))[code] if len(n) else n
    _, which = np.unique(gram, return_inverse=True)
    most_ = np.zeros(which.max() + 1 if len(which) else 0)
    np.maximum.at(most_, which, share)
    keep = share >= SHARE * most_[which]
    table = np.zeros((max(1, (len(langs) + 63) // 64), SLOTS), U)
    for s in slots(gram[keep]):
        for word in range(len(table)):
            here = code[keep] // 64 == word
            np.bitwise_or.at(table[word], s[here], U(1) << (code[keep][here] % 64).astype(U))
    fill = np.array([((table[k // 64] >> U(k % 64)) & U(1)).mean() for k in range(len(langs))])
    return Filter(langs, table, fill)


def predict(filter_: Filter, column_):
    """(language, score) per text."""
    g, first = grams(column_)
    n, count = len(first) - 1, np.diff(first)
    masks = []
    at = slots(g)
    for word in filter_.table:
        m = word[at[0]]
        for s in at[1:]:
            m &= word[s]
        masks.append(m)
    wrong = filter_.fill**HASHES
    share = np.zeros((n, len(filter_.langs)))
    for k in range(len(filter_.langs)):
        bits = np.concatenate([[0], np.cumsum((masks[k // 64] >> U(k % 64)) & U(1))])
        share[:, k] = np.clip((np.diff(bits[first]) / np.maximum(count, 1) - wrong[k]) / (1 - wrong[k]), 0, 1)
    best = share.argmax(1) if len(filter_.langs) else np.zeros(n, np.int64)
    total = share.sum(1)
    score = np.where(total > 0, share.max(1, initial=0) / np.maximum(total, 1e-12), 0.0)
    lang = [filter_.langs[b] if filter_.langs else UNKNOWN for b in best]
    data, off = text_buffer(column_)
    ascii_ = np.concatenate([[0], np.cumsum((_FOLD[data] >= 0x61) & (_FOLD[data] <= 0x7A))])
    for d in np.flatnonzero(np.diff(ascii_[off]) == 0):
        if not any(c.isalpha() for c in column_[d].as_py() or ""):
            lang[d], score[d] = UNKNOWN, 0.0
    return lang, score


def _pass_over(docs, filter_, schema, emit):
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filter_)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield emit(part, *predict(sent.value, column(part, "text")))

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, filter_: Filter) -> DataFrame:
    """One row per document: the language with the largest corrected share (first by name if equal), `und` without letters.

    The score is that share over the sum of all languages' shares, 0 if no n-gram is known. Null and
    empty texts are `und` with score 0; repeated ids are judged per row; a null id is not held out.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), (remainder(MOD) == HELD).alias("held_out"))
    emit = lambda part, lang, score: pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
    return _pass_over(docs, filter_, SCORED, emit)


def keep_known(docs: DataFrame, filter_: Filter, min_score=MIN_SCORE) -> DataFrame:
    """The documents, with all their columns, that have a language with at least ``min_score``."""
    emit = lambda part, lang, score: part.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score, strict=True)], pa.bool_()))
    return _pass_over(docs, filter_, docs.schema, emit)
