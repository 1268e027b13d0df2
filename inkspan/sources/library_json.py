"""Library documents: one JSON object a library, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APP_TAG = "letterforms"
_POINT = "struct<x:double,y:double>"
VARIANT = (
    "struct<id:string,char:string,contours:array<struct<cubics:array<array<" + _POINT + ">>>>,lsb:double,rsb:double,advance:bigint,"
    "osTop:int,osBot:int,clsName:string,nudge:struct<scale:double,dy:double,dl:double,dr:double>,created:bigint,weight:double,"
    "photo:struct<id:string,name:string,quad:array<double>>>"
)
DOCUMENT = (
    "struct<app:string,version:int,exported:string,fontName:string,mirrorCase:boolean,glyphs:map<string,struct<variants:array<" + VARIANT
    + ">,active:int>>,processedPhotos:array<string>,tester:string,design:string>"
)


def parse_documents(docs: DataFrame, app_tag: str = APP_TAG):
    """docs(lib_id, doc) -> (slots, variants, settings, processed).

    Documents without the app tag or without glyphs are rejected.
    """
    d = docs.select("lib_id", F.from_json("doc", DOCUMENT).alias("d")).where((F.col("d.app") == app_tag) & F.col("d.glyphs").isNotNull())
    entries = d.select("lib_id", F.explode_outer("d.glyphs").alias("key", "slot")).where(F.col("key").isNotNull())
    slots = entries.select("lib_id", "key", F.coalesce("slot.active", F.lit(0)).alias("active"))
    v = entries.select("lib_id", "key", F.posexplode_outer("slot.variants").alias("vidx", "v")).where(F.col("v").isNotNull())
    variants = v.select(
        "lib_id", "key", "vidx", "v.id", "v.contours", "v.lsb", "v.rsb", "v.advance", "v.osTop", "v.osBot", "v.clsName", "v.weight",
        *[F.coalesce(f"v.nudge.{n}", F.lit(0.0)).alias(f"nudge_{n}") for n in ("scale", "dy", "dl", "dr")],
        F.col("v.created").alias("created_ms"), F.col("v.photo.id").alias("photo_id"), F.col("v.photo.name").alias("photo_name"),
        F.col("v.photo.quad").alias("quad"), F.col("v.contours").isNotNull().alias("has_contours"),
    )
    settings = d.select("lib_id", F.col("d.fontName").alias("font_name"), F.col("d.mirrorCase").alias("mirror_case"), "d.tester", "d.design")
    processed = d.select("lib_id", F.posexplode_outer("d.processedPhotos").alias("pos", "photo_id")).where(F.col("photo_id").isNotNull())
    return slots, variants, settings, processed


def read_library(spark, path: str, app_tag: str = APP_TAG):
    """Every JSON file under ``path``; the library id is the folder ``lib_id=...`` or else the file's stem."""
    at = F.col("_metadata.file_path")
    folder = F.regexp_extract(at, r"/lib_id=([^/]+)/[^/]*$", 1)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    stem = plain(F.regexp_extract(at, r"([^/]+?)(\.json)?$", 1))
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.when(folder != "", plain(plain(folder))).otherwise(stem).alias("lib_id"), F.col("value").alias("doc"))
    return parse_documents(files, app_tag)


def outlines_of(variants: DataFrame) -> DataFrame:
    """Variants with stored contours as the outline operators take them: array<array<struct(x0, y0 .. x3, y3)>>."""
    cubic = lambda c: F.struct(*[F.get(c, i)[ax].alias(f"{ax}{i}") for i in range(4) for ax in ("x", "y")])
    return variants.where("has_contours").withColumn("contours", F.transform("contours", lambda r: F.transform(r["cubics"], cubic)))


def stored_contours(contours):
    """The way back: outline structs as ``{cubics: [[p0, c1, c2, p3]]}``."""
    points = lambda c: F.array(*[F.struct(c[f"x{i}"].alias("x"), c[f"y{i}"].alias("y")) for i in range(4)])
    return F.transform(contours, lambda r: F.struct(F.transform(r, points).alias("cubics")))


def to_documents(slots: DataFrame, variants: DataFrame, settings: DataFrame, processed: DataFrame, app_tag: str = APP_TAG) -> DataFrame:
    """(lib_id, doc): slots in key order, variants in position order.

    One library is one document by format, so its size is bounded by what a row may hold.
    """
    nudge = F.struct(*[F.col(f"nudge_{n}").alias(n) for n in ("scale", "dy", "dl", "dr")])
    quad = [F.col("quad")] if "quad" in variants.columns else []
    photo = F.when(F.col("photo_id").isNotNull() | F.col("photo_name").isNotNull(), F.struct(F.col("photo_id").alias("id"), F.col("photo_name").alias("name"), *quad))
    more = [F.col(c).alias(name) for c, name in (("contours", "contours"), ("osTop", "osTop"), ("osBot", "osBot"), ("clsName", "clsName"), ("created_ms", "created")) if c in variants.columns]
    rec = F.struct("id", F.col("key").alias("char"), *more, "lsb", "rsb", "advance", nudge.alias("nudge"), "weight", photo.alias("photo"))
    per_slot = variants.groupBy("lib_id", "key").agg(F.array_sort(F.collect_list(F.struct("vidx", rec.alias("v")))).alias("vs"))
    s = slots.join(per_slot, ["lib_id", "key"], "left").select(
        "lib_id", F.struct("key", F.struct(F.transform(F.coalesce("vs", F.array()), lambda e: e["v"]).alias("variants"), "active").alias("slot")).alias("e"))
    glyphs = s.groupBy("lib_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("glyphs"))
    done = processed.groupBy("lib_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "photo_id"))), lambda e: e["photo_id"]).alias("processedPhotos"))
    j = settings.join(glyphs, "lib_id", "left").join(done, "lib_id", "left")
    doc = F.to_json(F.struct(
        F.lit(app_tag).alias("app"), F.lit(1).alias("version"), F.col("font_name").alias("fontName"), F.col("mirror_case").alias("mirrorCase"),
        F.coalesce("glyphs", F.from_json(F.lit("{}"), dict(j.dtypes)["glyphs"])).alias("glyphs"),
        F.coalesce("processedPhotos", F.array().cast("array<string>")).alias("processedPhotos"),
        *[F.try_parse_json(c).alias(c) for c in ("tester", "design")]))  # objects, not quoted text
    return j.select("lib_id", doc.alias("doc"))


def write_library(documents: DataFrame, path: str) -> None:
    """Documents partitioned by library id, overwritten as a whole."""
    documents.write.mode("overwrite").partitionBy("lib_id").text(path)
