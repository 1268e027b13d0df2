"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: every shard holds the posting lists (word positions) of its
own documents, so postings never move. Test items become windows of ten words; a shard looks up a
window's rarest term first, turns its postings into candidate starts by subtracting the term's
offset, and intersects them with the next rarer terms. Windows travel in blocks of bounded size, at
most so many blocks in a pass; a benchmark beyond that takes several passes over the shards, which
carry what was found so far.

* ``build_index``  documents -> shards, a table that may be written and searched again
* ``search``       shards, items -> one row per document
* ``drop_contaminated``  both in one pass, keeping the columns of the documents
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.words import U, column, slices, word_hashes, words
from inkspan.session import cut_lineage

WINDOW = 10
SLOP = 2  # a proximity match lets every word of a window stand this many words off its place
GAP = 2 * WINDOW + 2 * SLOP  # empty places between documents: no window reaches over them
BLOCK_BYTES = 4 << 20  # of item texts in one block of windows
PASS_BLOCKS = 8  # blocks broadcast at once

SHARD = "doc_ids array<bigint>, n_words array<int>, terms array<bigint>, offsets array<int>, positions array<int>"
FOUND = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint, hit_spans array<struct<start:int,end:int>>"


class Windows:
    """A block of test windows: term numbers into a sorted vocabulary, padded with -1."""

    def __init__(self, items):
        rows, owner = [], []
        for (item, _), h in zip(items, word_hashes([t for _, t in items]), strict=True):
            n = min(WINDOW, len(h))
            for i in range(len(h) - n + 1 if n else 0):
                rows.append(h[i : i + n])
                owner.append(item)
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, U)
        self.length = np.array([len(r) for r in rows], np.int32)
        self.terms = np.full((len(rows), WINDOW), -1, np.int32)
        for k, r in enumerate(rows):
            self.terms[k, : len(r)] = np.searchsorted(self.vocabulary, r)
        self.owner = owner


def blocks(items: DataFrame, limit=BLOCK_BYTES):
    """Test windows in blocks of at most ``limit`` bytes of item text; one block is on the driver at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("string"), F.col("text")).where(F.col("text").isNotNull()).toLocalIterator(prefetchPartitions=False):
        held.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= limit:
            yield Windows(held)
            held, size = [], 0
    if held:
        yield Windows(held)


class Shard:
    """Posting lists of some documents: term t is at positions[offsets[t]:offsets[t + 1]]."""

    def __init__(self, doc_ids, n_words, terms, offsets, positions):
        self.doc_ids, self.n_words, self.terms, self.offsets, self.positions = doc_ids, n_words, terms, offsets, positions
        self.begin = np.concatenate([[0], np.cumsum(np.asarray(n_words, np.int64) + GAP)])

    @classmethod
    def of(cls, batch, vocabulary=None):
        """Postings of all words, or only of those in a sorted vocabulary."""
        w = words(column(batch, "text"))
        n = w.count()
        place = np.arange(len(w.start)) + np.repeat(np.arange(len(n)) * GAP, n)
        h = w.hash
        if vocabulary is not None:
            v = np.zeros(1 << 16, bool)
            v[(vocabulary & U(0xFFFF)).astype(np.int64)] = True
            keep = np.flatnonzero(v[(h & U(0xFFFF)).astype(np.int64)])
            at = np.searchsorted(vocabulary, h[keep])
            at[at == len(vocabulary)] = 0
            keep = keep[vocabulary[at] == h[keep]] if len(vocabulary) else keep[:0]
            h, place = h[keep], place[keep]
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return cls(column(batch, "doc_id"), n, h[new], np.append(new, len(h)), place[order])

    def _counts(self, windows):
        at = np.searchsorted(self.terms, windows.vocabulary)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == windows.vocabulary if len(self.terms) else np.zeros(len(at), bool)
        return np.where(there, np.diff(self.offsets)[at] if len(self.terms) else 0, 0), at

    def starts(self, windows, slop=0):
        """(window, start, anchor) of every place where a window's words stand, each within ``slop`` of its place.

        The anchor is a posting of the window's rarest term; a start may lie before its document.
        """
        count, at = self._counts(windows)
        none = np.zeros(0, np.int64)
        if not len(windows.terms):
            return none, none, none
        c = np.where(windows.terms >= 0, count[windows.terms], np.iinfo(np.int64).max)
        live = np.flatnonzero(c.min(1) > 0)
        order = np.argsort(c[live], 1, kind="stable")
        dense = np.full(self.begin[-1] + 2 * GAP, -1, np.int32)  # vocabulary number at each place
        for_term = np.full(len(self.terms), -1, np.int32)
        present = np.flatnonzero(count)
        for_term[at[present]] = present
        dense[self.positions + GAP] = np.repeat(for_term, np.diff(self.offsets))
        first = windows.terms[live, order[:, 0]]
        n = count[first]
        win = np.repeat(np.arange(len(live)), n)
        inside = np.arange(len(win)) - np.repeat(np.cumsum(n) - n, n)
        anchor = self.positions[self.offsets[at[first]][win] + inside]
        if slop:  # the anchor, too, may stand off its place
            shift = np.tile(np.arange(-slop, slop + 1), len(win))
            win, anchor = np.repeat(win, 2 * slop + 1), np.repeat(anchor, 2 * slop + 1)
        else:
            shift = 0
        start = anchor - order[win, 0] + shift
        for rank in range(1, WINDOW):
            off = order[win, rank]
            term = windows.terms[live[win], off]
            ok = term < 0
            place = start + off + GAP
            for d in range(-slop, slop + 1):
                q = place + d
                ok |= (q >= 0) & (dense[np.maximum(q, 0)] == term)
            win, start, anchor = win[ok], start[ok], anchor[ok]
        return live[win], start, anchor

    def look(self, all_windows, slop, hit, items, near):
        """Adds what windows meet to ``hit`` (per place) and to the sets of items per document."""
        change = np.zeros(self.begin[-1] + GAP + 1, np.int32)
        for windows in all_windows:
            for found, width in ((items, 0), (near, slop)):
                win, start, anchor = self.starts(windows, width)
                doc = np.searchsorted(self.begin, anchor, "right") - 1
                if not width:
                    np.add.at(change, start, 1)
                    np.add.at(change, start + windows.length[win], -1)
                if len(win):
                    for x, k in np.unique(np.stack([doc, win]), axis=1).T:
                        found[x].add(windows.owner[k])
        hit |= np.cumsum(change)[: len(hit)] > 0

    def blank(self):
        d = len(self.n_words)
        return np.zeros(self.begin[-1], bool), [set() for _ in range(d)], [set() for _ in range(d)]

    def columns(self, hit, items, near):
        """Columns of FOUND for the shard's documents."""
        total = np.concatenate([[0], np.cumsum(hit)])
        begin = self.begin[:-1]
        n_hit = total[begin + self.n_words] - total[begin]
        spans = []
        for x in range(len(self.n_words)):
            spans.append([])
            if n_hit[x]:
                m = np.diff(np.concatenate([[0], hit[begin[x] : begin[x] + self.n_words[x]].astype(np.int8), [0]]))
                spans[x] = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(m == 1), np.flatnonzero(m == -1), strict=True)]
        names = [sorted(i for i in found if i is not None) for found in items]
        return {
            "n_words": pa.array(np.asarray(self.n_words, np.int64)), "n_hit": pa.array(n_hit.astype(np.int64)),
            "n_items": pa.array([len(x) for x in names], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
            "contaminated": pa.array(n_hit > 0),
            "n_near": pa.array([len(b - a - {None}) for a, b in zip(items, near, strict=True)], pa.int64()),
            "hit_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        }

    def search(self, all_windows, slop=SLOP):
        found = self.blank()
        self.look(all_windows, slop, *found)
        return self.columns(*found)


def _passes(spark, items):
    """Lists of broadcast blocks, each as many as one pass takes; the last pass's are let go before the next is made."""
    held = []
    for b in blocks(items):
        held.append(spark.sparkContext.broadcast(b))
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
    if held:
        yield held


def _vocabulary(sent):
    return np.unique(np.concatenate([b.value.vocabulary for b in sent])) if sent else np.zeros(0, U)


def build_index(docs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Shards of posting lists over whole texts: of all words, or of the words that ``items`` hold, where one pass takes them.

    Null and empty texts have no words and stay in the index; a repeated doc_id is indexed per row.
    """
    passes = [] if items is None else list(islice(_passes(docs.sparkSession, items), 2))
    if len(passes) > 1:
        for b in passes[0] + passes[1]:
            b.destroy()
    sent = passes[0] if len(passes) == 1 else None

    def index(batches):
        known = None if sent is None else _vocabulary(sent)
        for batch in batches:
            for part in slices(batch):
                s = Shard.of(part, known)
                one = lambda v, t: pa.array([v], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.doc_ids.to_pylist()], pa.list_(pa.int64())), one(s.n_words.astype(np.int32), pa.int32()), one(s.terms.view(np.int64), pa.int64()), one(s.offsets.astype(np.int32), pa.int32()), one(s.positions.astype(np.int32), pa.int32())],
                    ["doc_ids", "n_words", "terms", "offsets", "positions"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(index, SHARD)


STATE = "hit binary, items array<array<string>>, near array<array<string>>"


def _shards(batches):
    """Shards of index rows, and what passes before have found in them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            get = lambda name: column(row, name)[0].values  # noqa: B023, E731
            num = lambda name: get(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            s = Shard(get("doc_ids"), num("n_words").astype(np.int64), num("terms").astype(np.int64).view(U), num("offsets").astype(np.int64), num("positions").astype(np.int64))
            found = s.blank()
            if "hit" in row.schema.names:
                hit = np.unpackbits(np.frombuffer(column(row, "hit")[0].as_py(), np.uint8))[: len(found[0])].astype(bool)
                found = (hit, *[[set(x) for x in column(row, c)[0].as_py()] for c in ("items", "near")])
            yield row, s, found


def search(index: DataFrame, items: DataFrame, slop=SLOP) -> DataFrame:
    """One row per indexed document: words, words inside any exact window, items met, proximity matches.

    An item without words meets nothing; items with a null id hit words but are not counted or listed.
    ``n_near`` counts items with a window whose words all stand within ``slop`` of their places, but
    with no exact window; ``hit_spans`` has the stretches of hit words. Repeated items count once. No
    items: nothing is contaminated. A benchmark of more than PASS_BLOCKS blocks takes several passes.
    """

    def kept(sent):
        def run(batches):
            for row, s, found in _shards(batches):
                s.look((b.value for b in sent), slop, *found)
                lists = [pa.array([[list(x) for x in f]], pa.list_(pa.list_(pa.string()))) for f in found[1:]]
                names = ["doc_ids", "n_words", "terms", "offsets", "positions"]
                yield pa.RecordBatch.from_arrays([*[column(row, c) for c in names], pa.array([np.packbits(found[0]).tobytes()], pa.binary()), *lists], [*names, "hit", "items", "near"])

        return run

    def finish(sent):
        def run(batches):
            for _, s, found in _shards(batches):
                s.look((b.value for b in sent), slop, *found)
                cols = s.columns(*found)
                yield pa.RecordBatch.from_arrays([s.doc_ids, *cols.values()], ["doc_id", *cols])

        return run

    last = []
    for sent in _passes(index.sparkSession, items):
        if last:
            index = cut_lineage(index.mapInArrow(kept(last), f"{SHARD}, {STATE}"))
            for b in last:
                b.destroy()
        last = sent
    return index.mapInArrow(finish(last), FOUND)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, without any exact window of a test item; nothing is shuffled.

    A benchmark of several passes drops documents pass by pass.
    """

    def run_with(sent):
        def run(batches):
            known = _vocabulary(sent)
            for batch in batches:
                for part in slices(batch):
                    s = Shard.of(part, known)
                    found = s.blank()
                    s.look((b.value for b in sent), 0, *found)
                    n_hit = np.add.reduceat(np.append(found[0], False), s.begin[:-1]) if part.num_rows else np.zeros(0)
                    yield part.filter(pa.array(n_hit == 0))

        return run

    last = []
    for sent in _passes(docs.sparkSession, items):
        if last:
            docs = cut_lineage(docs.mapInArrow(run_with(last), docs.schema))
            for b in last:
                b.destroy()
        last = sent
    return docs.mapInArrow(run_with(last), docs.schema) if last else docs
