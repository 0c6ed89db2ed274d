"""Reading-order text blocks: boxes of an image are filtered, ordered, merged and freed of duplicates.

Every image is one fold over its boxes in reading order, inside the JVM; one shuffle on
``image`` serves all of it. The folds look only at what the next box can reach (``grouping``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_text, trimmed
from .grouping import MEMBER, group_numbers, kept_groups

def clean_text(detections: DataFrame) -> DataFrame:
    """Trim texts and drop rows whose text is blank or null."""
    return detections.withColumn("text", trimmed(F.col("text"))).filter(F.col("text") != "")


def reading_order(detections: DataFrame) -> DataFrame:
    """Add ``pos``, from 1, within an image: by y, then x, then arrival."""
    return detections.withColumn("pos", F.row_number().over(Window.partitionBy("image").orderBy("y", "x", "idx")))


def block_text(members: Column, source: str) -> Column:
    """Texts of members in order, with a space between for ``en``; a text equal to all before it is not repeated."""
    gap = " " if source == "en" else ""
    rest = F.slice(members, 2, F.greatest(F.size(members), F.lit(1)))
    return F.aggregate(rest, members[0]["text"], lambda t, m: F.when(t == m["text"], t).otherwise(F.concat(t, F.lit(gap), m["text"])))


def greedy_groups(detections: DataFrame, x_gap: float, y_gap: float) -> DataFrame:
    """image, n (from 0, in order of creation), x, y, w, h, members: the groups of detections (image, idx, x, y, w, h, text), members in reading order."""
    boxes = F.sort_array(F.collect_list(F.struct("y", "x", "idx", "w", "h", "text"))).cast(f"array<{MEMBER}>")
    images = clean_text(detections).groupBy("image").agg(boxes.alias("boxes"))
    put = images.select("image", "boxes", group_numbers(F.col("boxes"), x_gap, y_gap).alias("numbers"))
    put = put.select("image", F.inline(F.arrays_zip("boxes", "numbers"))).filter("numbers >= 0").select("image", F.col("numbers").alias("n"), "boxes.*")
    x, y = F.min("x"), F.min("y")
    return put.groupBy("image", "n").agg(
        x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"),
        F.sort_array(F.collect_list(F.struct("y", "x", "idx", "w", "h", "text"))).cast(f"array<{MEMBER}>").alias("members"))


def text_blocks(detections: DataFrame, source: str = "en", x_gap: float = 20, y_gap: float = 15, with_members: bool = False) -> DataFrame:
    """image, block (from 1), text, x, y, w, h and members (empty unless asked for) of detections (image, idx, x, y, w, h, text)."""
    # groups are made, told and compared by image: one exchange serves all of it
    groups = greedy_groups(detections, x_gap, y_gap)
    members = F.transform("members", lambda m: m["text"]) if with_members else F.array().cast("array<string>")
    told = groups.select("image", F.struct("n", "x", "y", "w", "h", block_text(F.col("members"), source).alias("text"), members.alias("members")).alias("g"))
    listed = told.groupBy("image").agg(F.sort_array(F.collect_list("g")).alias("groups"))
    kept = listed.select("image", F.posexplode(F.transform(kept_groups(F.col("groups")), lambda i: F.get(F.col("groups"), i))).alias("block", "g"))
    return kept.select("image", (F.col("block") + 1).alias("block"), "g.text", "g.x", "g.y", "g.w", "g.h", "g.members")


def uncrowded(detections: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Detections of images with at most ``most`` boxes, and (image, boxes) of the others.

    For reports of images beyond the detector's own cap; the folds take images of any size.
    """
    sizes = detections.groupBy("image").agg(F.count("*").alias("boxes"))
    crowded = sizes.filter(F.col("boxes") > most)
    return detections.join(crowded, "image", "left_anti"), crowded


def overlay_payload(blocks: DataFrame, sizes: DataFrame | None = None, debug: DataFrame | None = None) -> DataFrame:
    """image, payload: the blocks of an image as JSON, without empty member lists.

    ``sizes`` (image, orig_width, orig_height, debug_trace) adds the image's size, and the
    trace flag where it is true; images without blocks then have an empty list. ``debug``
    (image, idx, x, y, w, h, text, score, accepted) adds the debug detections of the images
    that have some, each as bounds, text, score and acceptance.
    """
    bounds = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    group = F.struct("block", "text", bounds.alias("bounds"), F.when(F.size("members") > 0, F.col("members")).alias("members"))
    listed = blocks.groupBy("image").agg(F.sort_array(F.collect_list(group)).alias("groups"))
    shown = F.transform("groups", lambda g: F.struct(g["text"].alias("text"), g["bounds"].alias("bounds"), g["members"].alias("members")))
    parts = [F.lit('{"groups":'), F.coalesce(F.to_json(shown, {"ignoreNullFields": "true"}), F.lit("[]"))]
    if sizes is not None:
        listed = sizes.select("image", "orig_width", "orig_height", "debug_trace").join(listed, "image", "left")
    if debug is not None:
        one = F.concat(F.lit("["), F.to_json(bounds), F.lit(","), json_text(F.col("text")), F.lit(","), F.col("score").cast("string"), F.lit(","), F.col("accepted").cast("string"), F.lit("]"))
        by_image = debug.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("idx", one.alias("d")))).alias("debug"))
        listed = listed.join(by_image, "image", "left")
        parts.append(F.coalesce(F.concat(F.lit(',"debug_detections":['), F.array_join(F.transform("debug", lambda x: x["d"]), ","), F.lit("]")), F.lit("")))
    if sizes is not None:
        parts += [F.lit(',"orig_width":'), F.col("orig_width").cast("string"), F.lit(',"orig_height":'), F.col("orig_height").cast("string")]
        parts.append(F.when(F.col("debug_trace"), ',"debug_trace":true').otherwise(""))
    return listed.select("image", F.concat(*parts, F.lit("}")).alias("payload"))
