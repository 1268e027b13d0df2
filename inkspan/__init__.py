"""Lettering analytics on Spark: libraries, outlines, text layout, pixels, recognition."""
