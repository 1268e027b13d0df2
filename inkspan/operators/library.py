"""Letterform library tables: coverage, picks, merging, mirroring, photo bookkeeping.

slots(lib_id, key, active)
variants(lib_id, key, vidx, id, lsb, rsb, advance, weight, nudge_*, photo_id, photo_name, x0..y1)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.chars import SECTIONS, SPACE_ADVANCE, photo_stem, svg_file_name, svg_id_from_name
from inkspan.functions.numbers import clamp, half_up
from inkspan.operators.ordering import running_number

SLOT = ["lib_id", "key"]
MAX_MAPS = 4


def slot_sizes(variants: DataFrame) -> DataFrame:
    return variants.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n"))


def strip_local(variants: DataFrame) -> DataFrame:
    """Fields that never leave the device are dropped before sharing or hashing."""
    return variants.drop("thumb", "source")


def record_hash(variants: DataFrame) -> DataFrame:
    """Adds ``hash`` over the shared shape of a record."""
    shared = [c for c in strip_local(variants).columns if c not in ("lib_id", "key", "vidx")]
    return variants.withColumn("hash", F.sha2(F.to_json(F.struct(*shared)), 256))


def library_counts(slots: DataFrame, variants: DataFrame) -> DataFrame:
    per_slot = slots.join(slot_sizes(variants), SLOT, "left")
    return per_slot.groupBy("lib_id").agg(
        F.count(F.lit(1)).alias("slots"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("variants"),
        F.sum((F.length("key") > 1).cast("int")).cast("bigint").alias("ligatures"),
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
    )


def charset_coverage(libraries: DataFrame, slots: DataFrame, variants: DataFrame) -> DataFrame:
    """Every charset character per library by section, then the captured ligatures."""
    rows = [
        F.struct(F.lit(name).alias("section"), F.lit(i).alias("ord"), F.lit(ch).alias("key"))
        for name, chars in SECTIONS.items()
        for i, ch in enumerate(chars)
    ]
    grid = libraries.select("lib_id", F.inline(F.array(*rows)))
    sizes = slot_sizes(variants)
    fixed = grid.join(slots.select(*SLOT, F.lit(True).alias("filled")), SLOT, "left")
    liga = slots.where(F.length("key") > 1).select(
        "lib_id", F.lit("Ligatures").alias("section"), F.lit(None).cast("int").alias("ord"), "key",
        F.lit(True).alias("filled"),
    )
    return (
        fixed.unionByName(liga)
        .join(sizes, SLOT, "left")
        .select(
            "lib_id", "section", "ord", "key",
            F.coalesce("filled", F.lit(False)).alias("filled"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("variants"),
        )
    )


def _clamped_active(slots: DataFrame, variants: DataFrame) -> DataFrame:
    return slots.join(slot_sizes(variants), SLOT).withColumn(
        "idx", F.least(F.coalesce("active", F.lit(0)), F.col("n") - 1)
    )


def active_variant(slots: DataFrame, variants: DataFrame) -> DataFrame:
    pick = _clamped_active(slots, variants).select(*SLOT, F.col("idx").alias("vidx"))
    return variants.join(pick, SLOT + ["vidx"])


def rotated_set(slots: DataFrame, variants: DataFrame, offset: int) -> DataFrame:
    """Each slot's pick moved on by ``offset``, wrapping round."""
    pick = _clamped_active(slots, variants).select(
        *SLOT, F.pmod(F.col("idx") + F.lit(offset), F.col("n")).alias("vidx")
    )
    return variants.join(pick, SLOT + ["vidx"])


def rotated_sets(slots: DataFrame, variants: DataFrame, max_maps: int = MAX_MAPS) -> DataFrame:
    """All cycle maps at once: (map_no, variant...) with min(most variants, 4) maps a library."""
    sized = _clamped_active(slots, variants)
    maps = sized.groupBy("lib_id").agg(F.least(F.max("n"), F.lit(max_maps)).alias("n_maps"))
    picks = (
        sized.join(maps, "lib_id")
        .select(*SLOT, "idx", "n", "n_maps", F.explode(F.sequence(F.lit(0), F.col("n_maps").cast("int") - 1)).alias("map_no"))
        .select(*SLOT, "map_no", "n_maps", F.pmod(F.col("idx") + F.col("map_no"), F.col("n")).alias("vidx"))
    )
    return variants.join(picks, SLOT + ["vidx"])


def weight_set(slots: DataFrame, variants: DataFrame, t: float) -> DataFrame:
    """In every slot the variant nearest lightest + t * (heaviest - lightest)."""
    t = min(1.0, max(0.0, t))
    span = variants.groupBy("lib_id").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    d = (
        variants.join(span, "lib_id")
        .withColumn("d", F.abs(F.col("weight") - (F.col("lo") + F.lit(t) * (F.col("hi") - F.col("lo")))))
        .select(*SLOT, "vidx", "d")
    )
    best = d.groupBy(*SLOT).agg(F.min("d").alias("best"))
    near = d.join(best, SLOT).where(F.col("d") <= F.col("best") + 1e-9)
    active = slots.select(*SLOT, "active")
    pick = (
        near.join(active, SLOT, "left")
        .groupBy(*SLOT)
        .agg(F.min_by("vidx", F.struct((~F.coalesce(F.col("vidx") == F.col("active"), F.lit(False))).alias("o"), "vidx")).alias("vidx"))
    )
    return variants.join(pick, SLOT + ["vidx"])


def finalize_variant(variants: DataFrame) -> DataFrame:
    """Manual nudges applied to the box: fx0..fy1, flsb, frsb, fadvance."""
    s = F.lit(1.0) + F.coalesce("nudge_scale", F.lit(0.0)) / 100.0
    moved = (F.coalesce("nudge_scale", F.lit(0.0)) != 0) | (F.coalesce("nudge_dy", F.lit(0.0)) != 0)
    cx = (F.col("x0") + F.col("x1")) / 2.0
    dy = F.coalesce("nudge_dy", F.lit(0.0))

    def at(fx, raw):
        return F.when(moved, fx).otherwise(F.col(raw).cast("double"))

    out = (
        variants.withColumn("fx0", at(cx + (F.col("x0") - cx) * s, "x0"))
        .withColumn("fx1", at(cx + (F.col("x1") - cx) * s, "x1"))
        .withColumn("fy0", at(F.col("y0") * s + dy, "y0"))
        .withColumn("fy1", at(F.col("y1") * s + dy, "y1"))
        .withColumn("flsb", F.greatest(F.lit(-120.0), F.col("lsb") + F.coalesce("nudge_dl", F.lit(0.0))))
        .withColumn("frsb", F.greatest(F.lit(-120.0), F.col("rsb") + F.coalesce("nudge_dr", F.lit(0.0))))
    )
    return out.withColumn(
        "fadvance",
        F.greatest(F.lit(20), half_up(F.col("flsb") + (F.col("fx1") - F.col("fx0")) + F.col("frsb"))).cast("bigint"),
    )


def finalize_points(points: DataFrame, nudges: DataFrame) -> DataFrame:
    """The same nudges on every control point; nudges(id, x0, x1, nudge_scale, nudge_dy)."""
    s = F.lit(1.0) + F.col("nudge_scale") / 100.0
    cx = (F.col("x0") + F.col("x1")) / 2.0
    return points.join(nudges, "id").select(
        *[F.col(c) for c in points.columns if c not in ("x", "y")],
        (cx + (F.col("x") - cx) * s).alias("x"),
        (F.col("y") * s + F.col("nudge_dy")).alias("y"),
    )


def glyph_map(picked: DataFrame, mirror_case: bool = True) -> DataFrame:
    """glyph_map(lib_id, key, codepoint, drawn_key, id, advance, lsb, weight) of one picked set.

    ``codepoint`` is NULL for ligatures. ``drawn_key`` says which slot the drawing is from.
    """
    fin = finalize_variant(picked)
    base = fin.select(
        "lib_id", "key", F.when(F.length("key") == 1, F.ascii("key")).alias("codepoint"),
        F.col("key").alias("drawn_key"), "id", F.col("fadvance").alias("advance"),
        F.col("flsb").alias("lsb"), "weight",
    )
    full = mirror_case_completion(base) if mirror_case else base
    return ensure_space(full, picked.select("lib_id").distinct())


def glyph_maps(slots: DataFrame, variants: DataFrame, mirror_case=True) -> DataFrame:
    """Every cycle map of every library: glyph_map columns plus map_no and n_maps."""
    picked = rotated_sets(slots, variants).withColumn("lib_id", F.struct("lib_id", "map_no", "n_maps"))
    gm = glyph_map(picked.drop("map_no", "n_maps"), mirror_case)
    return gm.select("lib_id.*", *[c for c in gm.columns if c != "lib_id"])


def mirror_case_completion(gm: DataFrame) -> DataFrame:
    """The other case of each drawn ASCII letter, where nothing is mapped there."""
    other = gm.where(F.col("key").rlike("^[A-Za-z]$")).withColumn(
        "key", F.when(F.col("key") == F.lower("key"), F.upper("key")).otherwise(F.lower("key"))
    ).withColumn("codepoint", F.ascii("key"))
    return gm.unionByName(other.join(gm.select(*SLOT), SLOT, "left_anti"))


def ensure_space(gm: DataFrame, libraries: DataFrame) -> DataFrame:
    have = gm.where(F.col("codepoint") == 32).select("lib_id")
    add = libraries.join(have, "lib_id", "left_anti").select(
        "lib_id", F.lit(" ").alias("key"), F.lit(32).alias("codepoint"),
        F.lit(None).cast("string").alias("drawn_key"), F.lit(None).cast("string").alias("id"),
        F.lit(SPACE_ADVANCE).cast("bigint").alias("advance"), F.lit(0.0).alias("lsb"),
        F.lit(None).cast("double").alias("weight"),
    )
    return gm.unionByName(add)


def ligatures(slots: DataFrame) -> DataFrame:
    return slots.where(F.length("key") > 1).select("lib_id", "key", F.length("key").alias("len"))


def build_summary(slots: DataFrame, variants: DataFrame, weight=None) -> DataFrame:
    """Characters, ligatures, alternate sets and weight percent of each library's build."""
    sized = slots.join(slot_sizes(variants), SLOT)
    sets = F.lit(0) if weight is not None else F.least(F.max("n"), F.lit(MAX_MAPS)) - 1
    pct = F.lit(None).cast("bigint") if weight is None else half_up(F.lit(weight * 100.0)).cast("bigint")
    return sized.groupBy("lib_id").agg(
        F.sum((F.length("key") == 1).cast("int")).cast("bigint").alias("characters"),
        F.sum((F.length("key") > 1).cast("int")).cast("bigint").alias("ligatures"),
        sets.cast("bigint").alias("alternate_sets"),
    ).withColumn("weight_pct", pct)


# ---- photos -----------------------------------------------------------------


def list_photos(files: DataFrame) -> DataFrame:
    """Image files, newest first by the creation text (missing sorts as '')."""
    keep = F.coalesce(F.col("mime"), F.lit("")).contains("image/") | F.coalesce(F.col("name"), F.lit("")).rlike(
        r"\.(heic|HEIC|heif)"
    )
    return files.where(keep).orderBy(F.coalesce("created", F.lit("")).desc(), "pos")


def scan_folder(files: DataFrame, folder, trashed=False) -> DataFrame:
    return files.where(F.array_contains("parents", folder) & (F.col("trashed") == F.lit(trashed)))


def inbox_only(photos: DataFrame, inbox) -> DataFrame:
    """Membership verdict: only photos whose parents include the inbox may be served."""
    return photos.withColumn("served", F.coalesce(F.array_contains("parents", inbox), F.lit(False)))


def photo_copies(photos: DataFrame) -> DataFrame:
    """Same name and size is one photo: (leader, id, pos), one row a copy.

    Copies stay rows, so a photo uploaded without end is never one array.
    """
    k = [F.coalesce("name", F.lit("")).alias("k_name"), F.coalesce("size", F.lit("")).alias("k_size")]
    keyed = photos.select("id", "pos", *k)
    lead = keyed.groupBy("k_name", "k_size").agg(
        F.min_by("id", "pos").alias("leader"), F.min("pos").alias("leader_pos")
    )
    return keyed.join(lead, ["k_name", "k_size"]).select("leader", "leader_pos", "id", "pos")


def dedupe_photos(photos: DataFrame) -> DataFrame:
    return (
        photos.groupBy(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("size", F.lit("")).alias("size"))
        .agg(F.min_by("id", "pos").alias("id"), F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n_copies"))
        .select("id", "name", "size", "pos", "n_copies")
    )


def fresh_photos(photos: DataFrame, processed: DataFrame, rescan=False) -> DataFrame:
    """Photos none of whose copies was processed; a re-scan returns all."""
    leaders = dedupe_photos(photos)
    if rescan:
        return leaders
    copies = photo_copies(photos)
    done = copies.join(processed.select(F.col("photo_id").alias("id")), "id", "left_semi")
    return leaders.join(done.select(F.col("leader").alias("id")).distinct(), "id", "left_anti")


def forms_by_photo(variants: DataFrame, photos: DataFrame) -> DataFrame:
    """(photo leader, lib_id, key, variant id): by any copy's id, else by name stem."""
    copies = photo_copies(photos)
    by_id = copies.select(F.col("id").alias("photo_id"), F.col("leader").alias("by_id"))
    stems = (
        dedupe_photos(photos)
        .select(photo_stem(F.col("name")).alias("stem"), "pos", "id")
        .where(F.col("stem") != "")
        .groupBy("stem").agg(F.min_by("id", "pos").alias("by_name"))
    )
    src = variants.select("lib_id", "key", F.col("id").alias("variant_id"), "photo_id",
                          F.when(F.coalesce("photo_name", F.lit("")) != "", photo_stem(F.col("photo_name"))).alias("stem"))
    placed = src.join(by_id, "photo_id", "left").join(stems, "stem", "left")
    return placed.select(
        F.coalesce("by_id", "by_name").alias("photo"), "lib_id", "key", "variant_id"
    ).where(F.col("photo").isNotNull())


def photo_usage(photos: DataFrame, forms: DataFrame, processed: DataFrame) -> DataFrame:
    counts = forms.groupBy("photo").agg(F.count(F.lit(1)).alias("forms"))
    done = (
        photo_copies(photos)
        .join(processed.select(F.col("photo_id").alias("id")), "id", "left_semi")
        .select(F.col("leader").alias("id")).distinct().withColumn("done", F.lit(True))
    )
    return (
        dedupe_photos(photos)
        .join(counts.withColumnRenamed("photo", "id"), "id", "left")
        .join(done, "id", "left")
        .select(
            "id", "name", F.coalesce("forms", F.lit(0)).cast("bigint").alias("forms"),
            (F.coalesce("forms", F.lit(0)) + F.coalesce("done", F.lit(False)).cast("int") > 0).alias("used"),
        )
    )


def duplicate_designs(variants: DataFrame) -> DataFrame:
    """Same character from the same photo: by photo id, or by name where there is no id."""
    src = F.when(F.coalesce("photo_id", F.lit("")) != "", F.concat(F.lit("i:"), "photo_id")).when(
        F.coalesce("photo_name", F.lit("")) != "", F.concat(F.lit("n:"), "photo_name")
    )
    return (
        variants.withColumn("src", src).where(F.col("src").isNotNull())
        .groupBy("lib_id", "key", "src")
        .agg(F.count(F.lit(1)).alias("designs"), F.min("vidx").alias("first_vidx"), F.max("vidx").alias("last_vidx"))
        .where(F.col("designs") > 1)
    )


def resolve_duplicates(slots: DataFrame, variants: DataFrame, policy="new"):
    """One design of a character per photo.

    ``new`` keeps the latest design of each photo and drops the ones before; ``old``
    keeps the first, drops the rest, and makes it the active pick. Returns
    (slots, variants), positions closed up.
    """
    dup = duplicate_designs(variants)
    keep = F.col("last_vidx") if policy == "new" else F.col("first_vidx")
    src = F.when(F.coalesce("photo_id", F.lit("")) != "", F.concat(F.lit("i:"), "photo_id")).when(
        F.coalesce("photo_name", F.lit("")) != "", F.concat(F.lit("n:"), "photo_name")
    )
    kept = dup.select("lib_id", "key", "src", keep.alias("keep"))
    rest = (
        variants.withColumn("src", src)
        .join(kept, ["lib_id", "key", "src"], "left")
        .where(F.col("keep").isNull() | (F.col("vidx") == F.col("keep")))
    )
    numbered = running_number(rest, SLOT, "vidx", "rn").withColumn("new_vidx", (F.col("rn") - 1).cast("int"))
    # the newest addition (or the design kept from before) becomes the live pick
    chosen = numbered.where(F.col("keep").isNotNull()).groupBy(*SLOT).agg(F.max("new_vidx").alias("picked"))
    sizes = numbered.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n"))
    out_slots = (
        slots.join(sizes, SLOT).join(chosen, SLOT, "left")
        .select(*SLOT, F.coalesce("picked", clamp(F.coalesce("active", F.lit(0)), 0, F.col("n") - 1)).cast("int").alias("active"))
    )
    cols = [c for c in variants.columns if c != "vidx"]
    return out_slots, numbered.select(*cols, F.col("new_vidx").alias("vidx"))


# ---- merging ----------------------------------------------------------------


def merge_libraries(local, incoming, prefer_incoming=False, replace=False):
    """Union of variants by id, the local copy winning.

    ``local`` and ``incoming`` are (slots, variants) pairs; incoming variants carry
    ``has_contours``. Returns (slots, variants, added per library). An id repeated inside
    one incoming slot is added as often as it occurs.
    """
    l_slots, l_vars = local
    i_slots, i_vars = incoming
    if replace:
        l_slots, l_vars = l_slots.limit(0), l_vars.limit(0)
    cols = [c for c in l_vars.columns]
    fresh = (
        i_vars.where(F.col("has_contours"))
        .join(l_vars.select("lib_id", "key", "id"), SLOT + ["id"], "left_anti")
    )
    fresh = running_number(fresh, SLOT, "vidx", "rn")
    base = slot_sizes(l_vars).withColumnRenamed("n", "base")
    fresh = fresh.join(base, SLOT, "left").withColumn(
        "vidx", (F.coalesce("base", F.lit(0)) + F.col("rn") - 1).cast("int")
    )
    variants = l_vars.unionByName(fresh.select(*cols))
    merged = l_slots.select(*SLOT, F.col("active").alias("a_local")).join(
        i_slots.select(*SLOT, F.col("active").alias("a_in"), F.lit(True).alias("incoming")), SLOT, "full"
    )
    pick = F.coalesce("a_in", "a_local") if prefer_incoming else F.col("a_local")
    slots = merged.join(slot_sizes(variants), SLOT, "left").select(
        *SLOT,
        F.when(
            F.col("incoming"),
            clamp(F.coalesce(pick, F.lit(0)), 0, F.coalesce("n", F.lit(0)) - 1),
        ).otherwise(F.col("a_local")).cast("int").alias("active"),
    )
    added = fresh.groupBy("lib_id").agg(F.count(F.lit(1)).alias("added"))
    return slots, variants, added


def merge_settings(local, incoming, prefer_incoming=False, replace=False, default_name="Untitled"):
    """Font name and preferences of a merge; settings(lib_id, font_name, mirror_case, tester, design)."""
    i = incoming.select("lib_id", *[F.col(c).alias(f"i_{c}") for c in ("font_name", "mirror_case", "tester", "design")])
    take = F.coalesce(F.col("i_font_name") != "", F.lit(False)) & (
        F.lit(prefer_incoming or replace) | (F.col("font_name") == default_name)
    )
    pick = lambda c: F.coalesce(f"i_{c}", c).alias(c) if prefer_incoming else F.col(c)
    return local.join(i, "lib_id", "left").select(
        "lib_id", F.when(take, F.col("i_font_name")).otherwise(F.col("font_name")).alias("font_name"),
        pick("mirror_case"), pick("tester"), pick("design"),
    )


def mark_processed(processed: DataFrame, ids: DataFrame) -> DataFrame:
    """Idempotent append: (lib_id, photo_id, src, pos), first mention kept, blanks ignored."""
    both = processed.select("lib_id", "photo_id", F.lit(0).alias("src"), "pos").unionByName(
        ids.select("lib_id", "photo_id", F.lit(1).alias("src"), "pos")
    )
    return (
        both.where(F.coalesce("photo_id", F.lit("")) != "")
        .groupBy("lib_id", "photo_id")
        .agg(F.min(F.struct("src", "pos")).alias("at"))
        .select("lib_id", "photo_id", "at.src", "at.pos")
    )


# ---- mirror -----------------------------------------------------------------


def mirror_plan(library: DataFrame, mirror: DataFrame, pushed: DataFrame) -> DataFrame:
    """What to do with each letterform and each mirrored file.

    library(lib_id, key, vidx, id, hash); mirror(lib_id, file_id, name); pushed(lib_id, id, hash).
    A letterform is sent when its hash moved or the server lacks its id: update where a file
    of that name exists, else create. A file whose id left the library is trashed; a file
    whose name does not parse is ignored.
    """
    files = mirror.withColumn("id", svg_id_from_name(F.col("name")))
    server = files.where(F.col("id").isNotNull()).select("lib_id", "id").distinct().withColumn("on_server", F.lit(True))
    # a name held by several files routes to the last listed
    names = files.groupBy("lib_id", "name").agg(F.max("file_id").alias("file_id"))
    last = pushed.select("lib_id", "id", F.col("hash").alias("last_hash"))
    forms = (
        library.withColumn("name", svg_file_name(F.col("key"), F.col("id")))
        .join(last, ["lib_id", "id"], "left")
        .join(server, ["lib_id", "id"], "left")
        .join(names, ["lib_id", "name"], "left")
        .withColumn("send", F.coalesce(F.col("last_hash") != F.col("hash"), F.lit(True)) | F.col("on_server").isNull())
        .select(
            "lib_id", F.lit("form").alias("kind"), "id", "name", "key", "vidx",
            F.when(~F.col("send"), F.lit("keep")).when(F.col("file_id").isNotNull(), F.lit("update"))
            .otherwise(F.lit("create")).alias("action"),
        )
    )
    known = library.select("lib_id", "id").distinct().withColumn("known", F.lit(True))
    kept = files.join(known, ["lib_id", "id"], "left").select(
        "lib_id", F.lit("file").alias("kind"), F.col("file_id").alias("id"), "name",
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("vidx"),
        F.when(F.col("id").isNull(), F.lit("ignore")).when(F.col("known"), F.lit("keep"))
        .otherwise(F.lit("trash")).alias("action"),
    )
    return forms.unionByName(kept)


def push_batches(plan: DataFrame, size: int = 8) -> DataFrame:
    """Letterforms to send, numbered in order and cut into batches of ``size``.

    A library with nothing to send still makes one empty batch (its document is rewritten).
    """
    send = plan.where((F.col("kind") == "form") & F.col("action").isin("create", "update"))
    numbered = running_number(send, ["lib_id"], "vidx", "rn", lead=["key"])
    some = numbered.select("lib_id", "id", "action", F.ceil(F.col("rn") / size).cast("bigint").alias("batch"))
    idle = (
        plan.where(F.col("kind") == "form").select("lib_id").distinct()
        .join(send.select("lib_id").distinct(), "lib_id", "left_anti")
        .select("lib_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("action"),
                F.lit(1).cast("bigint").alias("batch"))
    )
    return some.unionByName(idle)


# ---- request validation -----------------------------------------------------

# What the upload and photo routes accept.
MAX_BODY = int(4.4 * 1024 * 1024)
MAX_SVG = 400000


def validate_uploads(df: DataFrame, default_name="photo.jpg", default_mime="image/jpeg") -> DataFrame:
    """uploads(name, mime, size, photo_id, thumb) -> cleaned columns and a reject reason."""
    given = F.when(F.coalesce("mime", F.lit("")) == "", F.lit(default_mime)).otherwise(F.col("mime"))
    mime = F.split_part(given, F.lit(";"), F.lit(1))
    # cut first: a character is replaced by one character, and names may be long
    clean = F.regexp_replace(F.substring(F.coalesce("name", F.lit("")), 1, 120), r"[/\\]", "_")
    width = F.coalesce(F.col("thumb"), F.lit(1800))
    return (
        df.withColumn("clean_mime", mime)
        .withColumn("clean_name", F.when(clean == "", F.lit(default_name)).otherwise(clean))
        .withColumn("clean_thumb", F.least(F.lit(2048), F.greatest(F.lit(64), F.when(width == 0, 1800).otherwise(width))))
        .withColumn(
            "reason",
            F.when(~mime.startswith("image/"), "not an image")
            .when(F.coalesce("size", F.lit(0)) < 1, "empty")
            .when(F.col("size") > MAX_BODY, "too large")
            .when(~F.coalesce("photo_id", F.lit("")).rlike(r"^[A-Za-z0-9_-]{10,}$"), "bad id"),
        )
    )


def valid_svg(df: DataFrame) -> DataFrame:
    """mirror rows(id, name, content): only those a push may write."""
    there = [F.coalesce(c, F.lit("")) != "" for c in ("id", "name", "content")]
    return df.where(
        there[0] & there[1] & there[2] & F.col("name").rlike(r"\.svg\z") & (F.length("content") <= MAX_SVG)
    )
