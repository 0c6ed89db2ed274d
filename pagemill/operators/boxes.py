"""Row-wise operators on detections, and simple groups of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo


def with_bounds(polygons: DataFrame, col: str = "polygon") -> DataFrame:
    """Replace a polygon column by x, y, w, h of the box around it."""
    b = geo.polygon_bounds(F.col(col))
    return polygons.withColumn("_b", b).withColumns({c: F.col(f"_b.{c}") for c in "xywh"}).drop("_b", col)


def with_polygon(boxes: DataFrame, col: str = "polygon") -> DataFrame:
    return boxes.withColumn(col, geo.bounds_polygon(*[F.col(c) for c in "xywh"]))


def rescaled(boxes: DataFrame, scales: DataFrame) -> DataFrame:
    """Boxes times the scale of their image; ``scales``: image, sx, sy. Images without a scale keep theirs."""
    sx, sy = F.coalesce("sx", F.lit(1.0)), F.coalesce("sy", F.lit(1.0))
    joined = boxes.join(scales.select("image", "sx", "sy"), "image", "left")
    return joined.withColumns({"x": F.col("x") * sx, "y": F.col("y") * sy, "w": F.col("w") * sx, "h": F.col("h") * sy}).drop("sx", "sy")


def moved(boxes: DataFrame, origins: DataFrame) -> DataFrame:
    """Boxes shifted by the crop origin of their image; ``origins``: image, ox, oy."""
    joined = boxes.join(origins.select("image", "ox", "oy"), "image", "left")
    return joined.withColumns({"x": F.col("x") + F.coalesce("ox", F.lit(0.0)), "y": F.col("y") + F.coalesce("oy", F.lit(0.0))}).drop("ox", "oy")


def with_accepted(scored: DataFrame, threshold: float) -> DataFrame:
    """Add ``accepted``: score at least the threshold, which is held within 0 and 1. Null scores are not accepted."""
    return scored.withColumn("accepted", F.coalesce(F.col("score") >= min(1.0, max(0.0, threshold)), F.lit(False)))


def union_box(boxes: DataFrame) -> DataFrame:
    """image and the box around all its boxes."""
    x, y = F.min("x"), F.min("y")
    return boxes.groupBy("image").agg(
        x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def first_candidates(candidates: DataFrame, limit: int = 1000) -> DataFrame:
    """At most ``limit`` candidates of an image, in order of arrival: the feature is the cap."""
    return candidates.withColumn("_rn", F.row_number().over(Window.partitionBy("image").orderBy("idx"))).filter(F.col("_rn") <= limit).drop("_rn")


def merge_pairs(boxes: DataFrame, x_gap: float, y_gap: float) -> DataFrame:
    """Pairs of boxes of an image, the earlier as the group, that could merge, with their score and overlap."""
    g = boxes.select("image", F.col("idx").alias("g_idx"), F.struct(*"xywh", "text").alias("g"))
    b = boxes.select("image", F.col("idx").alias("b_idx"), F.struct(*"xywh", "text").alias("b"))
    near = (F.col("g_idx") < F.col("b_idx")) & geo.can_merge(F.col("g"), F.col("b"), x_gap, y_gap)
    contains = F.contains("g.text", "b.text") | F.contains("b.text", "g.text")
    overlap = geo.overlap_of_smaller(F.col("g"), F.col("b"))
    return g.join(b, "image").filter(near).select(
        "image", "g_idx", "b_idx", geo.merge_score(F.col("g"), F.col("b")).alias("score"), overlap.alias("overlap"), ((overlap >= 0.9) & contains).alias("nested"))


def banded_order(boxes: DataFrame) -> DataFrame:
    """image, pos, idx: sorted by y then x, after which a box moves left past neighbours less than 10 away in y with a larger x.

    y is rounded to 1e-4 for the sort, as a tolerance alone would not give one order.
    Where y jumps by more than 10, no later box passes an earlier one: the runs between are folded apart, each in a task of its own if need be.
    """
    order = ["r", "x", "idx", "y"]
    in_order = Window.partitionBy("image").orderBy(*order)
    placed = boxes.select("image", "idx", "x", "y", F.round("y", 4).alias("r")).withColumns({"jump": F.col("r") - F.lag("r").over(in_order), "place": F.row_number().over(in_order)})
    runs = placed.withColumn("run", F.count_if(F.col("jump") > 10.001).over(in_order)).groupBy("image", "run")
    runs = runs.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("rows"), F.min("place").alias("first"))

    def insert(out, v):
        stops = F.transform(out, lambda e, n: F.when(~((F.abs(v["y"] - e["y"]) < 10) & (v["x"] < e["x"])), n + 1).otherwise(0))
        at = F.coalesce(F.array_max(stops), F.lit(0))
        return F.transform(F.array(at), lambda a: F.concat(F.slice(out, F.lit(1), a), F.array(v), F.slice(out, a + 1, F.size(out))))[0]

    folded = runs.select("image", "first", F.aggregate("rows", F.slice("rows", 1, 0), insert).alias("rows"))
    return folded.select("image", "first", F.posexplode("rows").alias("pos", "r")).select("image", (F.col("pos") + F.col("first")).cast("int").alias("pos"), "r.idx")
