"""Logits, tensors and probability maps as rows: decoding, statistics and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .zonal import zonal_mean  # noqa: F401  of maps as well


def layout(shape: Column) -> Column:
    """(t, c) of logits from a shape of rank 2, 3 or 4 with one single inner axis; null for others."""
    at = lambda i: F.get(shape, F.lit(i))
    pair = lambda t, c: F.struct(t.alias("t"), c.alias("c"))
    four = F.size(shape) == 4
    return (
        F.when(four & (at(2) == 1) & (at(1) > 0) & (at(3) > 0), pair(at(1), at(3)))
        .when(four & (at(1) == 1) & (at(2) > 0) & (at(3) > 0), pair(at(2), at(3)))
        .when(F.size(shape) == 3, pair(at(1), at(2))).when(F.size(shape) == 2, pair(at(0), at(1))))


def argmax(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best, p: the class of the highest score, the lowest class on ties; ``scores``: keys, c, p."""
    top = F.max(F.struct("p", (-F.col("c")).alias("minus_c"))).alias("m")
    return scores.groupBy(*keys).agg(top).select(*keys, (-F.col("m.minus_c")).alias("best"), "m.p")


def dictionary_lookup(classes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``ch`` of class ids from 1 (class_idx is id - 1); ids beyond the dictionary are dropped. A dictionary is small by nature."""
    return classes.join(F.broadcast(dictionary.select((F.col("class_idx") + 1).alias("best"), "ch")), "best")


def ctc_decode(scores: DataFrame, dictionary: DataFrame, blank: int = 0) -> DataFrame:
    """item, text, score of ``scores`` (item, t, c, p): best class per step, no blanks, no repeats of the step before.

    A step of a class beyond the dictionary adds nothing but still counts as the step
    before. Items without a kept step have an empty text and the score 0.
    """
    best = argmax(scores, ["item", "t"])
    before = F.lag("best").over(Window.partitionBy("item").orderBy("t"))
    kept = best.withColumn("before", before).filter((F.col("best") != blank) & (F.col("before").isNull() | (F.col("best") != F.col("before"))))
    chars = dictionary_lookup(kept, dictionary)
    texts = chars.groupBy("item").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "ch"))), lambda s: s["ch"]), "").alias("text"), F.avg("p").alias("score"))
    return scores.select("item").distinct().join(texts, "item", "left").select("item", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))


def tensor_diff(pairs: DataFrame, keys: list[str], left: str = "a", right: str = "b") -> DataFrame:
    """Per key: mean and greatest absolute difference, and mean and greatest value of each side; ``same_shape`` is false for other lengths."""
    a, b = F.col(left), F.col(right)
    same = F.size(a) == F.size(b)
    rows = pairs.select(*keys, same.alias("same_shape"), F.explode_outer(F.when(same, F.arrays_zip(a.alias("p"), b.alias("q")))).alias("z"))
    p, q = F.col("z.p").cast("double"), F.col("z.q").cast("double")
    return rows.groupBy(*keys, "same_shape").agg(
        F.avg(F.abs(p - q)).alias("mean_diff"), F.max(F.abs(p - q)).alias("max_diff"), F.avg(p).alias("mean_a"), F.max(p).alias("max_a"), F.avg(q).alias("mean_b"), F.max(q).alias("max_b"))


def map_diff(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per map: differences, pixels above ``threshold`` on each side, and pixels on which the sides disagree."""
    j = left.select("map_id", "px", "py", F.col("p").alias("a")).join(right.select("map_id", "px", "py", F.col("p").alias("b")), ["map_id", "px", "py"])
    up_a, up_b = F.col("a") > threshold, F.col("b") > threshold
    return j.groupBy("map_id").agg(
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_diff"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"),
        F.count_if(up_a).alias("above_a"), F.count_if(up_b).alias("above_b"), F.count_if(up_a != up_b).alias("disagree"))


def pixel_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per crop of (crop, px, py, ch, v): mean and greatest difference, pixels with any channel changed; ``same_size`` false where pixels lack a partner."""
    j = left.withColumnRenamed("v", "a").join(right.withColumnRenamed("v", "b"), ["crop", "px", "py", "ch"], "full_outer")
    d = F.abs(F.col("a") - F.col("b"))
    by_pixel = j.groupBy("crop", "px", "py").agg(F.sum(d).alias("s"), F.count(d).alias("n"), F.max(d).alias("m"), F.count_if(d.isNull()).alias("lone"))
    sums = by_pixel.groupBy("crop").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m"), F.count_if(F.col("m") > 0).alias("changed"), F.sum("lone").alias("lone"))
    same = F.col("lone") == 0
    return sums.select("crop", same.alias("same_size"), F.when(same, F.col("s") / F.col("n")).alias("mean_diff"), F.when(same, F.col("m")).alias("max_diff"), F.when(same, F.col("changed")).alias("changed_pixels"))


def map_statistics(pixels: DataFrame) -> DataFrame:
    """Per map: least, greatest, mean, root mean square, positive pixels and the value at the middle."""
    middle = F.struct(F.floor((F.max("px") + 1) / 2).alias("px"), F.floor((F.max("py") + 1) / 2).alias("py"))
    stats = pixels.groupBy("map_id").agg(
        F.min("p").alias("min"), F.max("p").alias("max"), F.avg("p").alias("mean"), F.sqrt(F.avg(F.col("p") * F.col("p"))).alias("rms"), F.count_if(F.col("p") > 0).alias("positive"), middle.alias("mid"))
    center = pixels.select("map_id", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.col("p").alias("center"))
    flat = stats.select("map_id", "min", "max", "mean", "rms", "positive", "mid.px", "mid.py")
    return flat.join(center, ["map_id", "px", "py"], "left").drop("px", "py")


def as_probabilities(pixels: DataFrame) -> DataFrame:
    """A map with any value outside 0 and 1 goes through the logistic function, whole; others stay."""
    w = Window.partitionBy("map_id")
    outside = (F.min("p").over(w) < 0) | (F.max("p").over(w) > 1)
    return pixels.withColumn("p", F.when(outside, 1 / (1 + F.exp(-F.col("p")))).otherwise(F.col("p")))


def normalised(values: DataFrame, channels: DataFrame) -> DataFrame:
    """v becomes (v * scale - mean) / std of its channel; a std near 0 counts as 1. ``channels`` holds a few rows."""
    j = values.join(F.broadcast(channels), "ch")
    std = F.when(F.abs("std") < 1e-12, 1.0).otherwise(F.col("std"))
    return j.withColumn("v", (F.col("v") * F.col("scale") - F.col("mean")) / std).drop("scale", "mean", "std")


def channel_means(values: DataFrame) -> DataFrame:
    return values.groupBy("crop", "ch").agg(F.avg("v").alias("mean"))


def compare_logits(left: DataFrame, right: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per item of two runs of logits: both texts and scores, whether the texts agree, and how far the values differ."""
    a, b = ctc_decode(left, dictionary), ctc_decode(right, dictionary)
    cells = left.withColumnRenamed("p", "a").join(right.withColumnRenamed("p", "b"), ["item", "t", "c"], "full_outer")
    d = F.abs(F.col("a") - F.col("b"))
    diff = cells.groupBy("item").agg(F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), (F.count_if(d.isNull()) == 0).alias("same_shape"))
    both = a.select("item", F.col("text").alias("left_text"), F.col("score").alias("left_score")).join(
        b.select("item", F.col("text").alias("right_text"), F.col("score").alias("right_score")), "item")
    return both.join(diff, "item").withColumn("same_text", F.col("left_text") == F.col("right_text"))


def points_close(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Whether two polygons have equally many points, all within ``tolerance``; null only agrees with null."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)
    close = F.forall(F.zip_with(a, b, near), lambda v: F.coalesce(v, F.lit(False)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & close)
