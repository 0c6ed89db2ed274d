"""Comparing two recognition runs box by box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import stored
from .matching import greedy_match, matches_of_few

#: An image with more boxes than this on either side is large. Smaller ones have at most 16,384 pairs.
FEW = 128


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    # plain columns, worked out once a box: the condition of the join is put to every two boxes that meet
    sides = lambda s: [F.col("x").alias(f"{s}x"), (F.col("x") + F.col("w")).alias(f"{s}x2"), F.col("y").alias(f"{s}y"), (F.col("y") + F.col("h")).alias(f"{s}y2"), (F.col("w") * F.col("h")).alias(f"{s}area")]
    left, right = left.dropna(subset=list("xywh")), right.dropna(subset=list("xywh"))
    return left.select("image", F.col("idx").alias("l"), *sides("a"), F.col("text").alias("l_text")), right.select("image", F.col("idx").alias("r"), *sides("b"), F.col("text").alias("r_text"))


def _overlapping(pairs: DataFrame, least: float) -> DataFrame:
    w, h = F.least("ax2", "bx2") - F.greatest("ax", "bx"), F.least("ay2", "by2") - F.greatest("ay", "by")
    union = F.col("aarea") + F.col("barea") - w * h
    return pairs.filter((w > 0) & (h > 0) & (union > 0) & (w * h / union >= least)).select("image", "l", "r", (w * h / union).alias("iou"), "l_text", "r_text")


def iou_pairs(left: DataFrame, right: DataFrame, least: float = 0.5, cell: float | None = 64.0) -> DataFrame:
    """image, l, r, iou, l_text, r_text: pairs of boxes of an image with an IoU of ``least`` (above 0) or more.

    Boxes are dealt to strips ``cell`` high, and only boxes that share a strip meet, each pair in its first
    common strip, so an image's boxes do not all meet; None lets them.
    """
    a, b = _sides(left, right)
    on = ["image"]
    if cell:
        strip = lambda c: F.floor(F.col(c) / cell)
        in_strips = lambda df, s: df.withColumn(f"{s}top", strip(f"{s}y")).withColumn("strip", F.explode(F.sequence(f"{s}top", strip(f"{s}y2"))))
        a, b, on = in_strips(a, "a"), in_strips(b, "b"), ["image", "strip"]
    pairs = a.join(b, on)
    if cell:
        pairs = pairs.filter(F.col("strip") == F.greatest("atop", "btop"))
    return _overlapping(pairs, least)


def matched_boxes(left: DataFrame, right: DataFrame, least: float = 0.5, few: int = FEW) -> DataFrame:
    """The rows of ``greedy_match(iou_pairs(left, right, least))``; both sides are tables, as they are counted first.

    Images of up to ``few`` boxes a side are brought together once, by image: all their boxes meet, and
    their pairs are put in order and matched where they are. Larger ones go by strips, however many boxes they have.
    """
    many = lambda df: df.groupBy("image").count().filter(F.col("count") > few).select("image")
    large = stored(many(left).unionByName(many(right)).distinct())
    if large.isEmpty():
        return matches_of_few(_overlapping(_joined(left, right), least))
    rest = lambda df, how: df.join(large, "image", how)
    small = matches_of_few(_overlapping(_joined(rest(left, "left_anti"), rest(right, "left_anti")), least))
    return small.unionByName(greedy_match(iou_pairs(rest(left, "left_semi"), rest(right, "left_semi"), least)))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _sides(left, right)
    return a.join(b, "image")


def unmatched(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """side (left or right), image, idx, text of boxes in no match."""
    rest = lambda df, key, side: df.join(matches.select("image", F.col(key).alias("idx")), ["image", "idx"], "left_anti").select(
        F.lit(side).alias("side"), "image", "idx", "text")
    return rest(left, "l", "left").unionByName(rest(right, "r", "right"))


def rate(part: Column, whole: Column) -> Column:
    """A share, 1 where there is nothing to share."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def parity_counters(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts and rates for every image of either run."""
    n = lambda df, name: df.groupBy("image").agg(F.count("*").alias(name))
    found = matches.groupBy("image").agg(F.count("*").alias("matched"), F.count_if(F.col("l_text") == F.col("r_text")).alias("exact"))
    all_images = n(left, "n_left").join(n(right, "n_right"), "image", "full_outer").join(found, "image", "left")
    counts = all_images.select("image", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right", "matched", "exact")])
    return counts.withColumns({"exact_of_left": rate(F.col("exact"), F.col("n_left")), "exact_of_pairs": rate(F.col("exact"), F.col("matched"))})


def mismatches(matches: DataFrame) -> DataFrame:
    """image, mismatches: texts and IoU of matches whose texts differ, in the order of matching."""
    row = F.struct("rank", "l_text", "r_text", "iou")
    listed = matches.filter(F.col("l_text") != F.col("r_text")).groupBy("image").agg(F.sort_array(F.collect_list(row)).alias("m"))
    return listed.select("image", F.transform("m", lambda x: F.struct(x["l_text"].alias("left_text"), x["r_text"].alias("right_text"), x["iou"].alias("iou"))).alias("mismatches"))


def parity_gate(counters: DataFrame) -> DataFrame:
    """images, failed, passed: an image passes with equal counts, all boxes matched and all texts exact."""
    fine = (F.col("n_left") == F.col("n_right")) & (F.col("matched") == F.col("n_left")) & (F.col("exact") == F.col("matched"))
    return counters.agg(F.count("*").alias("images"), F.count_if(~fine).alias("failed"), F.coalesce(F.bool_and(fine), F.lit(True)).alias("passed"))
