"""Decoding of dumped logits inside their rows: an item's scores are one array, step after step, and stay so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letters(dictionary: DataFrame) -> DataFrame:
    """One row, ``chars``: the characters by class id, which is class_idx + 1. A dictionary is small by nature."""
    return dictionary.agg(F.map_from_entries(F.collect_list(F.struct((F.col("class_idx") + 1).cast("int").alias("id"), "ch"))).alias("chars"))


def best_steps(values: Column, steps: Column, classes: Column) -> Column:
    """Of each step (best, p): the class of the highest score, the lowest class on ties."""

    def top(t: Column) -> Column:
        row = F.slice(values, (t * classes + 1).cast("int"), classes)
        return F.transform(F.array(row), lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1).cast("int").alias("best"), F.array_max(r).cast("double").alias("p")))[0]

    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), top)).otherwise(F.array().cast("array<struct<best:int,p:double>>"))


def kept_steps(best: Column, blank: int = 0) -> Column:
    """Steps that are no blank and no repeat of the step before; blanks and unknown classes count as steps before."""
    before = lambda i: F.get(best, i - 1)["best"]
    return F.filter(best, lambda s, i: (s["best"] != blank) & ((i == 0) | (s["best"] != before(i))))


def decode_logits(items: DataFrame, dictionary: DataFrame, key: str = "original_index", blank: int = 0) -> DataFrame:
    """item, text, score of dumped logits (``key``, values, time_steps, num_classes), as ``readers.dump_items`` gives them; no row leaves its task.

    A kept step of a class beyond the dictionary adds neither text nor score. Items without a kept step have an empty text and the score 0,
    and items whose values do not fill time_steps by num_classes are left out.
    """
    whole = items.filter((F.col("num_classes") > 0) & (F.size("values") >= F.col("time_steps") * F.col("num_classes")))
    best = whole.select(F.col(key).alias("item"), best_steps(F.col("values"), F.col("time_steps"), F.col("num_classes")).alias("best"))
    kept = best.select("item", kept_steps(F.col("best"), blank).alias("kept")).crossJoin(F.broadcast(letters(dictionary)))
    told = kept.select("item", F.filter(F.transform("kept", lambda s: F.struct(F.try_element_at("chars", s["best"]).alias("ch"), s["p"].alias("p"))), lambda s: s["ch"].isNotNull()).alias("told"))
    total = F.aggregate("told", F.lit(0.0), lambda a, s: a + s["p"])
    text = F.array_join(F.transform("told", lambda s: s["ch"]), "")
    return told.select("item", text.alias("text"), F.when(F.size("told") > 0, total / F.size("told")).otherwise(0.0).alias("score"))


def compare_items(left: DataFrame, right: DataFrame, dictionary: DataFrame, key: str = "original_index") -> DataFrame:
    """Per item of two runs of dumped logits: both texts and scores, whether the texts agree, and how far the values differ.

    One exchange brings the two runs of an item together; both are decoded before it. ``same_shape`` is false where steps or classes differ;
    differences are then of the values both have. Items of one run alone are left out.
    """
    a, b = (_with_text(x, dictionary, key, n) for x, n in ((left, "left"), (right, "right")))
    both = a.join(b, "item")
    near = F.least(F.size("left_values"), F.size("right_values"))
    gaps = F.zip_with(F.slice("left_values", F.lit(1), near), F.slice("right_values", F.lit(1), near), lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    told = both.withColumn("gaps", gaps)
    mean = F.when(F.size("gaps") > 0, F.aggregate("gaps", F.lit(0.0), lambda s, g: s + g) / F.size("gaps"))
    return told.select(
        "item", "left_text", "left_score", "right_text", "right_score", mean.alias("mean_diff"), F.array_max("gaps").alias("max_diff"),
        (F.col("left_shape") == F.col("right_shape")).alias("same_shape"), (F.col("left_text") == F.col("right_text")).alias("same_text"))


def _with_text(items: DataFrame, dictionary: DataFrame, key: str, name: str) -> DataFrame:
    """item and, under ``name``, its values, shape, text and score."""
    used = F.slice("values", F.lit(1), F.greatest(F.col("time_steps") * F.col("num_classes"), F.lit(0)))
    own = F.struct(F.col(key).alias("item"), F.struct("time_steps", "num_classes").alias("shape"), used.alias("values")).alias("own")
    own = items.select(own, "values", "time_steps", "num_classes")
    d = decode_logits(own, dictionary, "own")
    return d.select("item.item", F.col("item.shape").alias(f"{name}_shape"), F.col("item.values").alias(f"{name}_values"), F.col("text").alias(f"{name}_text"), F.col("score").alias(f"{name}_score"))
