"""Sets of characters as bitmaps of code points: as large as an alphabet, whatever the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alphabets(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, bits: a bitmap of code points for each 32,768 of them that a key's texts use; null texts have none.

    Bitmaps are put together where texts are read, so what is exchanged is at most 4 KB for each key, page and task.
    """
    chars = texts.select(*keys, F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("ch")).filter(F.col("ch") != "")
    points = chars.select(*keys, F.ascii("ch").cast("long").alias("point"))
    return points.groupBy(*keys, F.bitmap_bucket_number("point").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("point")).alias("bits"))


def merged(bitmaps: DataFrame) -> DataFrame:
    """page, bits: the union of bitmaps of all keys."""
    return bitmaps.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def size(bitmaps: DataFrame, keys: list[str], name: str = "characters") -> DataFrame:
    """keys and how many characters their bitmaps hold; without keys one row, 0 for no bitmaps."""
    return bitmaps.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(name))
