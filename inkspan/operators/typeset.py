"""Setting whole corpora: each text met once with its library's ligatures, glyph maps and kerns.

Texts are dealt to groups of bounded size within their library (a library with a third of all texts is
many groups), and each group meets one copy of its library's tables. Tokens, occurrence numbers,
glyphs and moves of a group are arrays; no token is shuffled, sorted or joined as a row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.operators.text import DEFAULTS
from inkspan.session import EXPANDED, share_of, small_side, spread

GROUP_BYTES = 2 << 20  # of text in a group, about; a longer text is a group of its own
TASK_GROUPS = 64  # groups of a task, on average, where a corpus has more than the session's partitions hold
SIDE = "lib_id", "kind", "map_no", "n_maps", "key", "id", "advance", "lft", "kern"


def _side(ligs: DataFrame, maps: DataFrame, kerns: DataFrame | None) -> DataFrame:
    """A library's tables as one: ligature keys (0), map entries (1), kerns (2)."""
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    lig = ligs.select("lib_id", F.lit(0).alias("kind"), null("int", "map_no"), null("int", "n_maps"), "key", null("string", "id"), null("bigint", "advance"), null("string", "lft"), null("bigint", "kern"))
    glyph = maps.select("lib_id", F.lit(1).alias("kind"), F.col("map_no").cast("int"), F.col("n_maps").cast("int"), "key", F.col("id").cast("string"), F.col("advance").cast("bigint").alias("advance"), null("string", "lft"), null("bigint", "kern"))
    out = lig.unionByName(glyph)
    if kerns is not None:
        pair = kerns.where("kern <> 0").select("lib_id", F.lit(2).alias("kind"), null("int", "map_no"), null("int", "n_maps"), null("string", "key"), F.col("rgt").cast("string").alias("id"), null("bigint", "advance"), F.col("lft").cast("string").alias("lft"), F.col("kern").cast("bigint").alias("kern"))
        out = out.unionByName(pair)
    return out


class Library:
    """Ligature pattern, glyph table (map, key) -> entry, and kerns of pairs of drawings."""

    def __init__(self, side: pa.Table, cycle: bool):
        kind = side.column("kind").to_numpy()
        get = lambda name, k: [v for v, x in zip(side.column(name).to_pylist(), kind, strict=True) if x == k]
        ligs = sorted(set(get("key", 0)), key=lambda k: (-len(k), k))
        self.tokens = re.compile("|".join([*ligs, "."]), re.DOTALL).findall
        self.maps = max([1, *get("n_maps", 1)]) if cycle else 1
        entries = sorted(zip(get("map_no", 1), get("key", 1), get("id", 1), get("advance", 1), strict=True), key=str)
        self.ids = [e[2] for e in entries]
        self.advance = np.array([0 if e[3] is None else e[3] for e in entries] + [0], np.int64)
        names = sorted({i for i in self.ids if i is not None})
        number = {n: k for k, n in enumerate(names)}
        self.names = pa.array([*names, None], pa.string())
        self.drawing = np.array([number.get(i, -1) for i in self.ids] + [-1])  # the drawing of an entry, -1 for none
        self.code = {}
        for e in entries:
            self.code.setdefault(e[1], len(self.code))
        self.table = np.full((self.maps, len(self.code) + 1), -1)
        for k, e in enumerate(entries):
            if e[0] < self.maps:
                self.table[e[0], self.code[e[1]]] = k
        pairs = [(number[a] * len(names) + number[b], v) for a, b, v in zip(get("lft", 2), get("id", 2), get("kern", 2), strict=True) if a in number and b in number]
        pairs.sort()
        self.pairs, self.kerns = np.array([p for p, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int64)

    def kern(self, left, right):
        """Kerns of pairs of drawings, 0 where either is missing or the pair has none."""
        if not len(self.pairs):
            return np.zeros(len(left), np.int64)
        at = left * (len(self.names) - 1) + right
        k = np.minimum(np.searchsorted(self.pairs, at), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[k] == at), self.kerns[k], 0)


class Setting:
    """The tokens of a group of texts, as arrays, each with its line, glyph and the drawing before it."""

    def __init__(self, texts, library: Library):
        keys, owner, line, size = [], [], [], []
        for d, text in enumerate(texts):
            for n, part in enumerate(text.split("\n") if text is not None else ()):
                found = library.tokens(part)
                keys += found
                owner.append(d)
                line.append(n)
                size.append(len(found))
        self.keys, self.line_owner, self.line_no, self.size = keys, np.array(owner, np.int64), np.array(line, np.int64), np.array(size, np.int64)
        self.line = np.repeat(np.arange(len(size)), self.size)
        self.first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.pos = np.arange(len(keys)) - self.first[self.line]
        code = dict(library.code)
        codes = np.fromiter((code.setdefault(k, len(code)) for k in keys), np.int64, len(keys))
        at = self.line_owner[self.line] * (len(code) + 1) + codes if len(keys) else codes
        order = np.argsort(at, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = at[order][1:] != at[order][:-1]
        heads = np.flatnonzero(new)
        occ = np.empty(len(order), np.int64)
        occ[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        self.entry = library.table[occ % library.maps, np.minimum(codes, len(library.code))]
        self.drawing = library.drawing[self.entry]
        self.before = np.full(len(keys), -1)
        self.before[1:] = self.drawing[:-1]
        self.before[self.first[:-1][self.size > 0]] = -1
        self.kern = library.kern(self.before, self.drawing)


def _met(docs, ligs, maps, kerns, cycle, emit, schema):
    sizes = docs.groupBy("lib_id").agg(F.ceil(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16) / GROUP_BYTES).cast("int").alias("n_parts"))
    sizes = small_side(sizes)
    rows = share_of(sizes, "n_parts") * EXPANDED // TASK_GROUPS
    of = lambda df: df.join(sizes.withColumnRenamed("lib_id", "_l"), F.col("lib_id").eqNullSafe(F.col("_l"))).drop("_l")
    dealt = of(docs.select("doc_id", "lib_id", "text")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("n_parts")).cast("int")).drop("n_parts")
    side = of(_side(ligs, maps, kerns)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")

    def run(texts, tables):
        if not texts.num_rows:
            return pa.Table.from_arrays([pa.array([], t.type) for t in schema_types], names)
        library = Library(tables, cycle)
        columns = emit(texts, library, Setting(texts.column("text").to_pylist(), library))
        return pa.Table.from_arrays([c.cast(t.type) for c, t in zip(columns, schema_types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    schema_types, names = list(arrow), arrow.names
    dealt, side = (spread(df, "lib_id", "part", rows=rows).groupBy("lib_id", "part") for df in (dealt, side))
    return dealt.cogroup(side).applyInArrow(run, schema)


def _taken(column, index):
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).take(pa.array(index))


def pairs_met(docs: DataFrame, ligs: DataFrame, maps: DataFrame, cycle=True) -> DataFrame:
    """Distinct (lib_id, lft, rgt): drawings that stand side by side in the texts; unmapped characters break a pair.

    docs(doc_id, lib_id, text), ligs(lib_id, key), maps(lib_id, map_no, n_maps, key, id, advance).
    """

    def emit(texts, library, s):
        both = (s.before >= 0) & (s.drawing >= 0)
        n = len(library.names)
        pair = np.unique(s.before[both] * n + s.drawing[both])
        lib = texts.column("lib_id").slice(0, 1)
        return [_taken(lib, np.zeros(len(pair), int)), library.names.take(pa.array(pair // n)), library.names.take(pa.array(pair % n))]

    lib = docs.schema["lib_id"].dataType.simpleString()
    return _met(docs, ligs, maps, None, cycle, emit, f"lib_id {lib}, lft string, rgt string").distinct()


def _moves(s, library, opts):
    return s.kern + np.where(s.entry >= 0, library.advance[s.entry], int(opts["gap"] * 1000))


def line_widths(docs: DataFrame, ligs: DataFrame, maps: DataFrame, kerns: DataFrame | None = None, cycle=True, opts=DEFAULTS) -> DataFrame:
    """(doc_id, line, tokens, missing, units, width) of every line; kerns(lib_id, lft, rgt, kern).

    A null text has no line. A library without maps leaves every character missing.
    """

    def emit(texts, library, s):
        n = len(s.size)
        total = lambda v: np.bincount(s.line, v, n) if len(v) else np.zeros(n)
        return [_taken(texts.column("doc_id"), s.line_owner), pa.array(s.line_no), pa.array(s.size), pa.array(total(s.entry < 0).astype(np.int64)), pa.array(total(_moves(s, library, opts)).astype(np.int64))]

    doc = docs.schema["doc_id"].dataType.simpleString()
    out = _met(docs, ligs, maps, kerns, cycle, emit, f"doc_id {doc}, line int, tokens bigint, missing bigint, units bigint")
    return out.withColumn("width", F.col("units") * (opts["size"] / 1000.0) + F.col("tokens") * (opts["tracking"] * opts["size"]))


def layout(docs: DataFrame, ligs: DataFrame, maps: DataFrame, kerns: DataFrame | None = None, cycle=True, opts=DEFAULTS) -> DataFrame:
    """(doc_id, line, pos, key, id, known, x, y): the place of every glyph, as ``text.layout`` has it."""

    def emit(texts, library, s):
        move = _moves(s, library, opts)
        run = np.cumsum(move)
        start = np.concatenate([[0], run])[s.first[:-1]] if len(s.size) else np.zeros(0, np.int64)
        units = run - move + s.kern - start[s.line] if len(run) else run
        x = units * (opts["size"] / 1000.0) + s.pos * (opts["tracking"] * opts["size"])
        y = opts["ascent"] * opts["size"] + s.line_no[s.line] * (opts["size"] * opts["leading"]) if len(run) else run
        ids = library.names.take(pa.array(np.where(s.drawing >= 0, s.drawing, len(library.names) - 1)))
        return [_taken(texts.column("doc_id"), s.line_owner[s.line]), pa.array(s.line_no[s.line]), pa.array(s.pos), pa.array(s.keys, pa.string()), ids, pa.array(s.entry >= 0), pa.array(np.asarray(x, float)), pa.array(np.asarray(y, float))]

    doc = docs.schema["doc_id"].dataType.simpleString()
    return _met(docs, ligs, maps, kerns, cycle, emit, f"doc_id {doc}, line int, pos int, key string, id string, known boolean, x double, y double")
