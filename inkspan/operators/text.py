"""Ligature-aware tokenising and line layout over text corpora.

docs(doc_id, lib_id, text). A document is one row, so windows per document are bounded by a
row's size; the raw text is shuffled once by doc_id and every window below reuses that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions.numbers import half_up
from inkspan.session import beside, share_of, small_side, spread

# Specimen defaults (em fractions of the size).
DEFAULTS = {"size": 112.0, "tracking": 0.02, "leading": 1.05, "ascent": 0.76, "gap": 0.38, "tall": 1.05, "pad": 0.35}


def token_pattern(ligs: DataFrame) -> DataFrame:
    """(lib_id, pattern): the library's ligature keys, longest first, then any character.

    Keys are 2-4 letters or digits, so nothing needs escaping.
    """
    k = F.struct((-F.length("key")).alias("o"), "key")
    return ligs.groupBy("lib_id").agg(F.array_sort(F.collect_set(k)).alias("ks")).select(
        "lib_id", F.concat(F.lit("(?s)("), F.array_join(F.transform("ks", lambda e: e["key"]), "|"), F.lit("|.)")).alias("pattern")
    )


def tokenize(docs: DataFrame, ligs: DataFrame, keep=()) -> DataFrame:
    """(doc_id, lib_id, line, pos, key): lines split at newlines, longest ligature first.

    An empty line keeps one row with NULL key. ``keep`` names further document columns to carry.
    Texts are dealt over tasks by their length, so a task's tokens do not grow with the input.
    """
    plain = F.lit("(?s)(.)")
    patterns = token_pattern(ligs)
    keyed = docs.join(patterns, "lib_id", "left").select(
        "doc_id", "lib_id", *keep, "text", F.coalesce("pattern", plain).alias("pattern")
    )
    return (
        spread(keyed, "doc_id", rows=share_of(docs, F.length("text")))
        .select("doc_id", "lib_id", *keep, "pattern", F.posexplode_outer(F.split("text", "\n")).alias("line", "line_text"))
        .select(
            "doc_id", "lib_id", *keep, "line",
            F.posexplode_outer(F.regexp_extract_all("line_text", F.col("pattern"), F.lit(1))).alias("pos", "key"),
        )
    )


def with_maps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """Documents with the number of cycle maps of their library (n_maps), 1 where it has none."""
    n = maps.groupBy("lib_id").agg(F.max("n_maps").cast("int").alias("n_maps"))
    return docs.join(n, "lib_id", "left").withColumn("n_maps", F.coalesce("n_maps", F.lit(1)))


def variant_slots(tokens: DataFrame) -> DataFrame:
    """Adds occ (0-based, per key over the whole text) and map_no = occ mod n_maps."""
    w = Window.partitionBy("doc_id", "key").orderBy("line", "pos")
    return (
        tokens.withColumn("occ", F.row_number().over(w) - 1)
        .withColumn("map_no", F.pmod(F.col("occ"), F.col("n_maps")))
    )


def missing_glyphs(tokens: DataFrame, gm: DataFrame) -> DataFrame:
    """Characters of each text with no glyph, first seen first: (doc_id, ord, key); a caller shows as many as it likes.

    Reduced to one row per distinct key map-side before the anti join.
    """
    seen = (
        tokens.where(F.col("key").isNotNull() & (F.col("key") != " "))
        .groupBy("doc_id", "lib_id", "key").agg(F.min(F.struct("line", "pos")).alias("first"))
    )
    absent = seen.join(gm.select("lib_id", "key"), ["lib_id", "key"], "left_anti")
    w = Window.partitionBy("doc_id").orderBy("first")
    return absent.withColumn("ord", F.row_number().over(w)).select("doc_id", "ord", "key")


def adjacent_pairs(placed: DataFrame) -> DataFrame:
    """Distinct (lft, rgt) drawings that meet in the corpus; unmapped characters break a pair."""
    return placed.where(F.col("prev_id").isNotNull() & F.col("id").isNotNull()).select(
        F.col("prev_id").alias("lft"), F.col("id").alias("rgt")
    ).distinct()


def place_glyphs(tokens: DataFrame, maps: DataFrame, cycle=True) -> DataFrame:
    """Tokens with their glyph and the drawing before on the line.

    Tokens carry n_maps when cycling. maps(lib_id, map_no, key, id, advance, lsb). A drawing
    that has no outline (the space) has NULL id; ``known`` says whether the key is mapped.
    """
    if cycle:
        slotted = variant_slots(tokens)
    else:
        slotted = tokens.withColumn("map_no", F.lit(0))
        maps = maps.where(F.col("map_no") == 0)
    m = small_side(maps.select("lib_id", F.col("map_no").cast("int").alias("map_no"), "key", "id", "advance", "lsb", F.lit(True).alias("known")))
    w = Window.partitionBy("doc_id", "line").orderBy("pos")
    return (
        slotted.join(m, ["lib_id", "map_no", "key"], "left")
        .select("doc_id", "lib_id", "line", "pos", "key", "id", "advance", "lsb", F.coalesce("known", F.lit(False)).alias("known"))
        .withColumn("prev_id", F.lag("id").over(w))
    )


def char_index(tokens: DataFrame) -> DataFrame:
    """Adds chr: the token's character index in the text, newlines counted."""
    w = Window.partitionBy("doc_id").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.coalesce(F.length("key"), F.lit(0))
    return tokens.withColumn("chr", F.sum(n).over(w) - n + F.col("line"))


def apply_kerns(placed: DataFrame, kerns: DataFrame, moved=False) -> DataFrame:
    """Adds manual (em): kerns(doc_id, chr, em); several moves of one spot add at 3 decimals.

    A text's moves lie in one row and each token looks its place up, so tokens stay where they are.
    ``moved`` leaves only tokens with a move.
    """
    total = kerns.groupBy("doc_id", "chr").agg(half_up(F.sum(half_up(F.col("em") * 1000.0)) / 1000.0, 3).alias("manual")).where(F.col("manual") != 0)
    held = total.where(F.col("chr").isNotNull()).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("chr").cast("bigint").alias("chr"), "manual"))).alias("_moves"))
    j = char_index(placed).join(beside(held), "doc_id", "inner" if moved else "left")
    rest = [c for c in j.columns if c not in ("doc_id", "chr", "_moves")]
    out = j.select("doc_id", "chr", *rest, F.try_element_at("_moves", F.col("chr").cast("bigint")).alias("manual"))
    return out.where(F.col("manual").isNotNull()) if moved else out


def _add_kern(placed: DataFrame, kern: DataFrame | None) -> DataFrame:
    if kern is None:
        return placed.withColumn("kern", F.lit(0).cast("bigint"))
    k = kern.where(F.col("kern") != 0).select(F.col("lft").alias("prev_id"), F.col("rgt").alias("id"), "kern")
    k = small_side(k)
    return placed.join(k, ["prev_id", "id"], "left").withColumn("kern", F.coalesce("kern", F.lit(0)))


def _moves(df: DataFrame, opts) -> Column:
    """Font-unit and em parts are summed apart as integers, so totals do not depend on order."""
    return F.when(F.col("key").isNull(), F.lit(0)).otherwise(
        F.col("kern") + F.when(F.col("known"), F.col("advance")).otherwise(F.lit(int(opts["gap"] * 1000)))
    ).cast("bigint")


def layout(placed: DataFrame, kern: DataFrame | None = None, opts=DEFAULTS) -> DataFrame:
    """x of each glyph: (doc_id, line, pos, key, id, x, y). Manual kerns count when present."""
    df = _add_kern(placed, kern)
    manual = F.coalesce(F.col("manual"), F.lit(0.0)) if "manual" in df.columns else F.lit(0.0)
    w = Window.partitionBy("doc_id", "line").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    move = _moves(df, opts)
    m3 = half_up(manual * 1000.0)
    units = F.sum(move).over(run) - move + F.col("kern") + F.sum(m3).over(run)
    before = F.row_number().over(w) - 1
    return df.where(F.col("key").isNotNull()).select(
        "doc_id", "line", "pos", "key", "id", "known",
        (units * (opts["size"] / 1000.0) + before * (opts["tracking"] * opts["size"])).alias("x"),
        (F.lit(opts["ascent"] * opts["size"]) + F.col("line") * (opts["size"] * opts["leading"])).alias("y"),
    )


def line_widths(placed: DataFrame, kern: DataFrame | None = None, opts=DEFAULTS) -> DataFrame:
    """(doc_id, line, tokens, missing, units, width) — widths need sums only, no running x."""
    df = _add_kern(placed, kern)
    manual = half_up(F.coalesce(F.col("manual"), F.lit(0.0)) * 1000.0) if "manual" in df.columns else F.lit(0)
    n = F.count("key")
    return df.groupBy("doc_id", "line").agg(
        n.alias("tokens"),
        F.sum(F.when(F.col("key").isNotNull() & ~F.col("known"), 1).otherwise(0)).cast("bigint").alias("missing"),
        F.sum(_moves(df, opts) + manual).cast("bigint").alias("units"),
    ).withColumn("width", F.col("units") * (opts["size"] / 1000.0) + F.col("tokens") * (opts["tracking"] * opts["size"]))


def specimen_size(lines: DataFrame, opts=DEFAULTS) -> DataFrame:
    """Page of each text: lines, widest line, height, W and H with the default margin."""
    pad = float(int(opts["pad"] * opts["size"] + 0.5))
    return (
        lines.groupBy("doc_id")
        .agg((F.max("line") + 1).cast("bigint").alias("lines"), F.max("width").alias("width"),
             F.sum("tokens").alias("tokens"), F.sum("missing").alias("missing"))
        .withColumn("height", (F.col("lines") - 1) * (opts["size"] * opts["leading"]) + opts["size"] * opts["tall"])
        .withColumn("page_w", F.greatest(F.lit(4), F.ceil(half_up(F.col("width") + 2 * pad, 6))).cast("bigint"))
        .withColumn("page_h", F.greatest(F.lit(4), F.ceil(half_up(F.col("height") + 2 * pad, 6))).cast("bigint"))
    )


def align_shift(lines: DataFrame, pages: DataFrame, align: str, opts=DEFAULTS) -> DataFrame:
    """Adds shift: where a line starts on its page for left, center or right."""
    pad = float(int(opts["pad"] * opts["size"] + 0.5))
    shift = {
        "left": F.lit(pad),
        "center": (F.col("page_w") - F.col("width")) / 2.0,
        "right": F.col("page_w") - pad - F.col("width"),
    }[align]
    return lines.join(pages.select("doc_id", "page_w"), "doc_id").withColumn("shift", shift)


def specimen_svg(laid: DataFrame, glyphs: DataFrame, lines: DataFrame, pages: DataFrame, fg="#000000", bg="#ffffff",
                 align="left", opts=DEFAULTS) -> DataFrame:
    """One SVG row per text line, plus the page head: (doc_id, line, svg).

    glyphs(id, contours, lsb). A page's parts stay rows (line -1 opens, a last line closes), so a
    long text is never gathered whole; a writer concatenates them in line order.
    """
    from inkspan.operators.outlines import path_text

    pad = float(int(opts["pad"] * opts["size"] + 0.5))
    s = opts["size"] / 1000.0
    shifted = align_shift(lines, pages, align, opts).select("doc_id", "line", "shift")
    g = (
        laid.join(glyphs.select("id", "contours", "lsb"), "id")
        .join(shifted, ["doc_id", "line"])
        .withColumn("ox", F.col("shift") + F.col("x") + F.col("lsb") * s).withColumn("oy", F.lit(pad) + F.col("y"))
        .withColumn("d", path_text(F.col("contours"), lambda x: F.col("ox") + x * s, lambda y: F.col("oy") - y * s))
        .where(F.col("d") != "")
        .select("doc_id", "line", "pos", F.concat(F.lit('<path d="'), "d", F.lit('"/>')).alias("svg"))
    )
    wh = F.concat(F.col("page_w").cast("string"), F.lit('" height="'), F.col("page_h").cast("string"))
    head = pages.select(
        "doc_id", F.lit(-1).alias("line"), F.lit(0).alias("pos"),
        F.concat(
            F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.col("page_w").cast("string"), F.lit(" "),
            F.col("page_h").cast("string"), F.lit('" width="'), wh, F.lit('"><rect width="'), wh,
            F.lit(f'" fill="{bg}"/><g fill="{fg}" fill-rule="nonzero">'),
        ).alias("svg"),
    )
    tail = pages.select("doc_id", F.col("lines").cast("int").alias("line"), F.lit(0).alias("pos"), F.lit("</g></svg>").alias("svg"))
    return head.unionByName(g).unionByName(tail)
