"""Characters of a corpus and how far a dictionary covers them; samples of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alphabets import alphabets, merged, size

def characters(texts: DataFrame, key: str = "image") -> DataFrame:
    """key, ch: every character of every text, once per key."""
    return texts.select(key, F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), ""))).alias("ch")).filter(F.col("ch") != "").distinct()


def character_counts(texts: DataFrame, key: str = "image") -> DataFrame:
    """Distinct characters and texts per key, and for the whole corpus where ``key`` is null and ``whole`` is true."""
    bitmaps = alphabets(texts, [key])
    counts = null_safe_left(texts.groupBy(key).agg(F.count("*").alias("texts")), size(bitmaps, [key]), key)
    total = texts.agg(F.count("*").alias("texts")).crossJoin(size(merged(bitmaps), [])).select(F.lit(None).cast(texts.schema[key].dataType).alias(key), "texts", "characters", F.lit(True).alias("whole"))
    return counts.select(key, "texts", F.coalesce("characters", F.lit(0)).alias("characters"), F.lit(False).alias("whole")).unionByName(total)


def null_safe_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on ``key`` in which null is a key like any other."""
    other = right.withColumnRenamed(key, "_key")
    return left.join(other, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def coverage(texts: DataFrame, dictionary: DataFrame, key: str = "image") -> DataFrame:
    """characters, dictionary, coverage: distinct characters in percent of the dictionary's size, 0 for an empty one; may exceed 100."""
    n = size(merged(alphabets(texts, [])), [])
    entries = dictionary.agg(F.count("*").alias("dictionary"))
    percent = F.when(F.col("dictionary") == 0, 0.0).otherwise(100.0 * F.col("characters") / F.col("dictionary"))
    return n.crossJoin(entries).withColumn("coverage", percent)


def sample_texts(texts: DataFrame, n: int = 10, key: str = "image", order: str = "idx") -> DataFrame:
    """key, sample: the first ``n`` texts of a key. Each hashed part of a key gives its first ``n``, so no task holds a whole key."""
    first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(key, *by).orderBy(order, "text"))).filter(F.col("_n") <= n)
    few = first(texts.select(key, order, "text").withColumn("_part", F.pmod(F.xxhash64(order, "text"), F.lit(64))), "_part")
    listed = first(few).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("s"))
    return listed.select(key, F.transform("s", lambda s: s["text"]).alias("sample"))
