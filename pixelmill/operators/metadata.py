"""Metadata of images as a map column and an EXIF binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.color import check


def set_entry(meta: Column, key: str, value: str) -> Column:
    """Upsert; the entry moves to the end."""
    check(bool(key), "an empty key")
    return F.map_concat(F.map_filter(meta, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))


def get_entry(meta: Column, key: str) -> Column:
    """The value, or null if there is none."""
    return F.try_element_at(meta, F.lit(key))


def has_entry(meta: Column, key: str) -> Column:
    return F.map_contains_key(meta, key)


def remove_entry(meta: Column, key: str) -> Column:
    return F.map_filter(meta, lambda k, _: k != key)


def entry_count(meta: Column) -> Column:
    return F.cardinality(meta)


def set_exif(images: DataFrame, blob: bytes | None) -> DataFrame:
    """Replace the EXIF block; an empty one strips it."""
    return images.withColumn("exif", F.lit(bytes(blob) if blob else None).cast("binary"))


def get_exif(images: DataFrame) -> Column:
    """The EXIF block, or null."""
    return F.col("exif")


def strip_exif(images: DataFrame) -> DataFrame:
    return set_exif(images, None)


def has_exif(images: DataFrame) -> Column:
    return F.col("exif").isNotNull()
