"""Photo files: listing, decoding into pixel rows, and the mirror of letterform files."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = "photo_id string, w int, h int, x int, y int, r int, g int, b int"


def photo_files(spark, path: str, pattern="*") -> DataFrame:
    """(id, name, size, created): metadata only; file contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(F.col("path").alias("id"), name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("created"))


def read_photos(spark, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")


def pixels(images: DataFrame, max_edge: int | None = None) -> DataFrame:
    """Decoded images to pixel rows: every pixel, or a working size (nearest sample, longer side max_edge).

    One photo is expanded at a time, in slices of rows, so a batch never holds all its pixels.
    """

    def expand(batches):
        for pdf in batches:
            for rec in pdf.itertuples(index=False):
                a = np.frombuffer(rec.data, dtype=np.uint8).reshape(rec.height, rec.width, rec.nChannels)
                s = max(1.0, max(rec.height, rec.width) / max_edge) if max_edge else 1.0
                h, w = max(1, int(rec.height / s + 0.5)), max(1, int(rec.width / s + 0.5))
                ys = np.minimum((np.arange(h) * s).astype(int), rec.height - 1)
                xs = np.minimum((np.arange(w) * s).astype(int), rec.width - 1)
                for y0 in range(0, h, 256):
                    part = a[ys[y0:y0 + 256]][:, xs]
                    yy, xx = np.mgrid[y0:y0 + part.shape[0], 0:w]
                    c = part if part.shape[2] >= 3 else np.repeat(part[:, :, :1], 3, axis=2)
                    yield pd.DataFrame({
                        "photo_id": rec.origin, "w": w, "h": h, "x": xx.ravel(), "y": yy.ravel(),
                        "r": c[:, :, 2].ravel().astype(int), "g": c[:, :, 1].ravel().astype(int), "b": c[:, :, 0].ravel().astype(int),
                    })

    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # images are large rows
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(expand, PIXELS)


def write_mirror(rows: DataFrame, folder: str) -> None:
    """One file a row(name, content) in a folder all executors share; same name replaces."""

    def put(part):
        os.makedirs(folder, exist_ok=True)
        for r in part:
            tmp = os.path.join(folder, f".{r['name'].replace('/', '_')}.{os.getpid()}")
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(r["content"])
            os.replace(tmp, os.path.join(folder, r["name"].replace("/", "_")))

    rows.select("name", "content").foreachPartition(put)
