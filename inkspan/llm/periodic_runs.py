"""Periodic runs of words, found with suffix trees.

A run is a maximal stretch with a smallest period. Its Lyndon root (of one of the two orders of the
alphabet) is the longest Lyndon word at its place, so the longest Lyndon words of all places, taken
in both orders, are all the candidates there are. Each candidate is extended to both sides by the
longest common extension of its two ends: to the right in a suffix tree of the words, to the left in
one of their reversal, each in constant time as the lowest common ancestor of two leaves, which is a
range minimum over the Euler tour. The trees are built by Ukkonen's algorithm.

Trees are built for the stretches of a text that can hold a run asked for: in a run of at least four
periods and six words every four consecutive words recur within the run, so where four words do not
recur within their stretch, no run passes. That loses no run.

Every document is a task's own work, nothing is shuffled. Memory is bounded by the longest periodic
stretch of one text (about half a kilobyte a word). Defined results: a null text has no words; every
row of a repeated doc_id has its own result; other columns are ignored or, by ``collapse``, kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.words import slices, text_buffer

LEAST_LENGTH, LEAST_PERIODS = 6, 4
GRAM = 4  # words that recur within every run of at least four periods and six words
ROUNDS = 8  # of cutting stretches where four words do not recur
BLOCK = 16
U = np.uint64


class RangeMin:
    """Constant-time minima of ranges: inside blocks by prefix and suffix, between them by powers of two."""

    def __init__(self, values):
        n = len(values)
        blocks = -(-n // BLOCK)
        self.values = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        self.values[:n] = values
        square = self.values.reshape(blocks, BLOCK)
        self.prefix = np.minimum.accumulate(square, 1).ravel()
        self.suffix = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [square.min(1)]
        step = 1
        while 2 * step <= blocks:
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def query(self, a, b):
        """Minima of values[a..b], both ends included; a <= b."""
        out = np.minimum(self.suffix[a], self.prefix[b])
        first, last = a // BLOCK + 1, b // BLOCK
        wide = np.flatnonzero(last > first)
        if len(wide):
            f, t = first[wide], last[wide]
            level = np.frexp(t - f)[1] - 1
            inner = np.empty(len(wide), np.int32)
            for k in np.unique(level):
                here = level == k
                table = self.levels[k]
                inner[here] = np.minimum(table[f[here]], table[t[here] - (1 << k)])
            out[wide] = np.minimum(out[wide], inner)
        near = np.flatnonzero(last < first)  # both ends in one block
        if len(near):
            low, high = a[near], b[near]
            m = self.values[low]
            for k in range(1, BLOCK):
                at = low + k
                inside = at <= high
                if not inside.any():
                    break
                m[inside] = np.minimum(m[inside], self.values[at[inside]])
            out[near] = m
        return out


class SuffixTree:
    """Ukkonen's tree of whole numbers from 1 on; a terminal 0, less than all, is put at the end."""

    def __init__(self, symbols):
        s = [*symbols, 0]
        self.n, self.size = len(s), max(s) + 1
        self._grow(s)
        self._order(s)

    def _grow(self, s):
        n, size = self.n, self.size
        start, end, link, child = [0], [0], [0], {}
        node, edge, length, left = 0, 0, 0, 0
        for i in range(n):
            symbol, left, made = s[i], left + 1, 0
            while left:
                if not length:
                    edge = i
                key = node * size + s[edge]
                to = child.get(key)
                if to is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    span = end[to] - start[to] if end[to] <= i else i + 1 - start[to]
                    if length >= span:
                        edge += span
                        length -= span
                        node = to
                        continue
                    if s[start[to] + length] == symbol:
                        if made and node:
                            link[made] = node
                        length += 1
                        break
                    cut = len(start)
                    start.append(start[to])
                    end.append(start[to] + length)
                    link.append(0)
                    child[key] = cut
                    child[cut * size + symbol] = cut + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    start[to] += length
                    child[cut * size + s[start[to]]] = to
                    if made:
                        link[made] = cut
                    made = cut
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.child = start, end, child

    def _order(self, s):
        """Children of every node by their first symbol, as offsets into one array."""
        count = len(self.start)
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        kids = np.fromiter(self.child.values(), np.int64, len(self.child))
        self.child = None
        by_key = np.argsort(keys)
        self.kids, parents = kids[by_key], keys[by_key] // self.size
        self.offsets = np.searchsorted(parents, np.arange(count + 1))
        self.terminal = keys[by_key] % self.size == 0
        self.lengths = np.array(self.end) - np.array(self.start)
        self.start = self.end = None

    def tour(self):
        """String depths along the Euler tour, kept for range minima; suffixes in order."""
        kids, at, lengths = self.kids.tolist(), self.offsets.tolist(), self.lengths.tolist()
        ends, n = at[1:], self.n
        depths, first, order = [0], [0] * n, []
        path, sums, node, depth = [], [], 0, 0
        while True:
            k = at[node]
            if k < ends[node]:
                at[node] = k + 1
                to = kids[k]
                deep = depth + lengths[to]
                if at[to] == ends[to]:
                    first[n - deep] = len(depths)
                    order.append(n - deep)
                    depths.append(deep)
                    depths.append(depth)
                else:
                    path.append(node)
                    sums.append(depth)
                    node, depth = to, deep
                    depths.append(depth)
            elif path:
                node, depth = path.pop(), sums.pop()
                depths.append(depth)
            else:
                break
        self.first, self.minima = np.array(first), RangeMin(np.array(depths, np.int32))
        return order

    def backward(self):
        """Suffixes in the order of the reversed alphabet; a prefix still comes before what it begins."""
        kids, offsets, lengths, terminal = self.kids.tolist(), self.offsets.tolist(), self.lengths.tolist(), self.terminal.tolist()
        stack, order, n = [(0, 0)], [], self.n
        while stack:
            node, depth = stack.pop()
            a, b = offsets[node], offsets[node + 1]
            if a == b:
                order.append(n - depth)
                continue
            ended = terminal[a]
            stack += [(kids[k], depth + lengths[kids[k]]) for k in range(a + ended, b)]
            if ended:
                stack.append((kids[a], depth + lengths[kids[a]]))
        return order

    def common(self, a, b):
        """Longest common extensions to the right of places a and b."""
        fa, fb = self.first[a], self.first[b]
        return self.minima.query(np.minimum(fa, fb), np.maximum(fa, fb)).astype(np.int64)


def lyndon_ends(order):
    """Where the longest Lyndon word of each place ends: at the next smaller suffix."""
    n = len(order) - 1  # the last suffix is the terminal alone, smaller than all
    rank = [0] * (n + 1)
    for r, i in enumerate(order):
        rank[i] = r
    ends, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return np.array(ends, np.int64)


def runs_of(symbols, least_length=LEAST_LENGTH, least_periods=LEAST_PERIODS):
    """(start, length, period) rows of all runs of at least so many words and periods (two or more)."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    back.tour()
    found = []
    for order in (ahead.tour(), ahead.backward()):
        i = np.arange(n)
        j = lyndon_ends(order)
        right, left = ahead.common(i, j), back.common(n - i, n - j)
        period = j - i
        length = period + left + right
        ok = length >= np.maximum(least_length, least_periods * period)
        found.append(np.stack([i - left, length, period], 1)[ok])
    return np.unique(np.concatenate(found), axis=0)


def stretches(keys):
    """(start, end) of the stretches of words in which every four words recur."""
    starts = np.arange(len(keys) - GRAM + 1)
    if len(starts) < LEAST_LENGTH - GRAM + 1:
        return []
    grams = np.zeros(len(starts), U)
    for j in range(GRAM):
        grams = grams * U(0x9E3779B97F4A7C15) + keys[j : j + len(starts)]
    stretch = np.zeros(len(starts), np.int64)
    for _ in range(ROUNDS):
        mixed = grams ^ (stretch.astype(U) * U(0xBF58476D1CE4E5B9))
        by = np.argsort(mixed, kind="stable")
        same = mixed[by][1:] == mixed[by][:-1]
        recurs = np.zeros(len(by), bool)
        recurs[by[1:]] |= same
        recurs[by[:-1]] |= same
        kept = starts[recurs]
        if not len(kept):
            return []
        cut = np.flatnonzero((np.diff(kept) > 1) | (np.diff(stretch[recurs]) > 0)) + 1
        edges = np.concatenate([[0], cut, [len(kept)]])
        long = np.diff(edges) >= LEAST_LENGTH - GRAM + 1
        new = np.repeat(np.arange(len(long)), np.diff(edges))
        stays = np.repeat(long, np.diff(edges))
        kept, new = kept[stays], new[stays]
        if not len(kept):
            return []
        done = len(kept) == len(starts)
        starts, grams, stretch = kept, grams[recurs][stays], new
        if done:
            break
    heads = np.flatnonzero(np.concatenate([[True], np.diff(stretch) > 0]))
    tails = np.concatenate([heads[1:], [len(stretch)]]) - 1
    return [(int(starts[a]), int(starts[b]) + GRAM) for a, b in zip(heads, tails, strict=True)]


def runs_of_words(words):
    """(start, length, period) rows of the runs of a list of words, by start, then period."""
    if len(words) < LEAST_LENGTH:
        return np.zeros((0, 3), np.int64)
    keys = np.fromiter(map(hash, words), np.int64, len(words)).view(U)
    found = [np.zeros((0, 3), np.int64)]
    for a, b in stretches(keys):
        number = {}
        rows = runs_of([number.setdefault(w, len(number) + 1) for w in words[a:b]])
        found.append(rows + [a, 0, 0])
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words, rows):
    """Words without those that repeat a run's first period."""
    if not len(rows):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def _texts(batch, prepare):
    """(row, words, runs) of each text of a batch."""
    names = batch.schema.names
    ids = batch.column(names.index("doc_id")).to_pylist() if prepare else None
    data, off = text_buffer(batch.column(names.index("text")))
    data = bytes(data)
    for i in range(batch.num_rows):
        words = data[off[i] : off[i + 1]].split()  # at the six ASCII white-space characters
        if prepare:
            words = prepare(words, ids[i])
        yield i, words, runs_of_words(words)


REPORT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame, prepare=None) -> DataFrame:
    """Per document the number of runs, the longest (then first, then shortest-period) run, and digests.

    ``prepare(words, doc_id)`` may change a document's words before.
    """

    def run(batches):
        for batch in batches:
            for cut in slices(batch):
                columns = [[] for _ in range(7)]
                for _, words, rows in _texts(cut, prepare):
                    text = "".join(f"{a},{n},{p}\n" for a, n, p in rows.tolist())
                    best = min(rows.tolist(), key=lambda r: (-r[1], r[0], r[2])) if len(rows) else None
                    start, length, period = best or (None, None, None)
                    values = (len(rows), start, length, period, 1000 * length // period if best else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, rows))).hexdigest())
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [f.split()[0] for f in REPORT.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, REPORT)


def find(docs: DataFrame, prepare=None) -> DataFrame:
    """doc_id, n_words and runs (start, length, period), by start, then period."""

    def run(batches):
        for batch in batches:
            for cut in slices(batch):
                got = [(len(words), rows.tolist()) for _, words, rows in _texts(cut, prepare)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                spans = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in rows] for _, rows in got], kind)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), spans], ["doc_id", "n_words", "runs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run cut to its first period; texts without runs, and nulls, stay as they are."""

    def run(batches):
        for batch in batches:
            for cut in slices(batch):
                texts = cut.column("text").to_pylist()
                for i, words, rows in _texts(cut, None):
                    if len(rows):
                        texts[i] = b" ".join(collapsed(words, rows)).decode()
                at = cut.schema.get_field_index("text")
                yield cut.set_column(at, cut.schema.field(at), pa.array(texts, cut.schema.field(at).type))

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    out = docs.select("text", rest).mapInArrow(run, docs.select("text", rest).schema)
    return out.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
