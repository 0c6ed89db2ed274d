"""Sizes, candidate funnels and batches: what to feed a detector and a recogniser, without images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that results depend on.
SCREENSHOT_LIMIT = 1024
DET_ALIGN = 32
BATCH = 6


def crop_rect(requests: DataFrame) -> DataFrame:
    """Add crop_x, crop_y, crop_w, crop_h and error: a selection in a viewport as whole pixels of the image.

    ``requests``: image_w, image_h, rect_x, rect_y, rect_w, rect_h, viewport_w, viewport_h. A selection may
    run left or up, is cut at the viewport, is one pixel at least and ends at the image's edge.
    """
    c = F.col
    error = F.when((c("image_w") <= 0) | (c("image_h") <= 0), "empty image").when((c("viewport_w") <= 0) | (c("viewport_h") <= 0), "bad viewport")

    def side(at: str, size: str, view: str, image: str) -> tuple[Column, Column]:
        inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), c(view))
        low, high = inside(F.least(c(at), c(at) + c(size))), inside(F.greatest(c(at), c(at) + c(size)))
        scale = c(image) / c(view)
        start = F.floor(low * scale).cast("int")
        length = F.greatest(F.ceil((high - low) * scale).cast("int"), F.lit(1))
        return start, F.least(length, F.greatest(c(image) - start, F.lit(0)))

    x, w = side("rect_x", "rect_w", "viewport_w", "image_w")
    y, h = side("rect_y", "rect_h", "viewport_h", "image_h")
    good = lambda v: F.when(F.col("error").isNull(), v)
    return requests.withColumn("error", error).withColumns({"crop_x": good(x), "crop_y": good(y), "crop_w": good(w), "crop_h": good(h)})


def resize_limits(images: DataFrame, limit: int = SCREENSHOT_LIMIT) -> DataFrame:
    """Add max_w, max_h (0: none) from ``mode`` (width or long-side) and the backend's own width limit ``backend_w`` (0: none)."""
    width = F.when(F.col("backend_w") > 0, F.least("backend_w", F.lit(limit))).otherwise(limit)
    by_width = (F.col("mode") == "width") | (F.col("image_w") >= F.col("image_h"))
    return images.withColumns({"max_w": F.when(by_width, width).otherwise(0), "max_h": F.when(by_width, 0).otherwise(limit)})


def effective_limits(images: DataFrame, limit: int = SCREENSHOT_LIMIT) -> DataFrame:
    """Add eff_h, eff_w of a comparison run: explicit limits, but in pipeline mode by the long side only where it is too long."""
    width = F.when(F.col("asked_w") > 0, F.col("asked_w")).when((F.col("runner") == "pipeline") & (F.col("mode") == "width"), limit).otherwise(0)
    height = F.when(F.col("asked_h") > 0, F.col("asked_h")).otherwise(0)
    long_side = (F.col("runner") == "pipeline") & (F.col("mode") != "width")
    wide = F.col("image_w") >= F.col("image_h")
    over = lambda size: F.when(F.col(size) > limit, limit).otherwise(0)
    return images.withColumns({
        "eff_h": F.when(~long_side, height).when(wide, 0).otherwise(over("image_h")),
        "eff_w": F.when(~long_side, width).when(wide, over("image_w")).otherwise(0)})


def _sized(images: DataFrame) -> DataFrame:
    """Add error for images without a size."""
    return images.withColumn("error", F.when(~((F.col("image_w") > 0) & (F.col("image_h") > 0)) | F.col("image_w").isNull() | F.col("image_h").isNull(), "empty image"))


def fit_resize(images: DataFrame) -> DataFrame:
    """Add target_w, target_h and the factors back, sx and sy, for limits max_w and max_h; nothing changes if the image fits. Images of no size have an error."""
    ratio = lambda limit, size: F.when((F.col(limit) > 0) & (F.col(size) > F.col(limit)), F.col(limit) / F.col(size)).otherwise(1.0)
    r = F.least(ratio("max_w", "image_w"), ratio("max_h", "image_h"))
    good = lambda v: F.when(F.col("error").isNull(), v)
    target = lambda size: good(F.when(F.col("_r") < 1, F.greatest(F.round(F.col(size) * F.col("_r")).cast("int"), F.lit(1))).otherwise(F.col(size)))
    return _sized(images).withColumn("_r", r).withColumns({"target_w": target("image_w"), "target_h": target("image_h")}).withColumns(
        {"sx": F.col("image_w") / F.col("target_w"), "sy": F.col("image_h") / F.col("target_h")}).drop("_r")


def detector_size(images: DataFrame, side: int = 64, kind: str = "min", max_side: int = 4000) -> DataFrame:
    """Add det_w, det_h: tiny images padded to 32, scaled by ``kind`` (max, min or resize_long), capped, then to multiples of 32. Images of no size have an error."""
    side = max(side, 1)
    cap = max(max_side, side)
    images = _sized(images)
    tiny = F.col("image_w") + F.col("image_h") < 64
    padded = images.withColumns({f"_{k}": F.when(F.col("error").isNull(), F.when(tiny, F.greatest(F.lit(32), F.col(f"image_{k}"))).otherwise(F.col(f"image_{k}"))) for k in "wh"})
    longest, shortest = F.greatest("_w", "_h"), F.least("_w", "_h")
    scale = {
        "max": F.when(longest > side, side / longest).otherwise(1.0),
        "resize_long": side / longest,
    }.get(kind, F.when(shortest < side, side / shortest).otherwise(1.0))
    scaled = padded.withColumn("_s", scale.cast("double")).withColumns({k: (F.col(k) * F.col("_s")).cast("int") for k in ("_w", "_h")})
    top = F.greatest("_w", "_h")
    capped = scaled.withColumn("_c", F.when(top > cap, cap / top).otherwise(1.0)).withColumns({k: (F.col(k) * F.col("_c")).cast("int") for k in ("_w", "_h")})
    aligned = lambda k: F.when(F.col("error").isNull(), F.greatest(F.lit(DET_ALIGN), (F.round(F.col(k) / DET_ALIGN) * DET_ALIGN).cast("int")))
    return capped.withColumns({"det_w": aligned("_w"), "det_h": aligned("_h")}).drop("_w", "_h", "_s", "_c")


def recogniser_width(crops: DataFrame, height: int = 48, base: int = 320, most: int = 3200) -> DataFrame:
    """Add rec_w, the input width of a crop (w, h), and resized_w, how much of it the crop fills."""
    most = max(base, most)
    ratio = F.greatest(F.lit(1.0), F.col("w")) / F.greatest(F.lit(1.0), F.col("h"))
    width = F.least(F.lit(most), F.greatest(F.lit(base), (height * F.greatest(F.lit(base / height), ratio)).cast("int")))
    filled = F.ceil(height * F.col("w") / F.greatest(F.lit(1.0), F.col("h"))).cast("int")
    return crops.withColumn("rec_w", width).withColumn(
        "resized_w", F.when(F.col("rec_w") >= most, most).otherwise(F.greatest(F.lit(1), F.least(filled, F.col("rec_w")))))


def reject_reason(candidates: DataFrame, min_side: float = 3.0, box_threshold: float = 0.6) -> DataFrame:
    """Add reason, the first rule that a candidate (mini_side, score, unclip_side) fails, or accepted."""
    reason = (
        F.when(F.col("mini_side") < min_side, "min_side").when(F.col("score") < box_threshold, "score")
        .when(F.col("unclip_side") < min_side + 2, "unclip_side").otherwise("accepted"))
    return candidates.withColumn("reason", reason)


def to_source(value: Column, scale: Column, size: Column) -> Column:
    """A map coordinate in the source image: rounded half to even, kept inside."""
    return F.least(F.greatest(F.bround(value * scale), F.lit(0.0)), size.cast("double"))


def orientation(candidates: DataFrame) -> DataFrame:
    """Add rotated (label 1) and ratio (w over h, h at least 1)."""
    return candidates.withColumns({"rotated": F.col("label") == 1, "ratio": F.col("w") / F.greatest(F.lit(1.0), F.col("h"))})


def ratio_order(candidates: DataFrame) -> DataFrame:
    """Add sorted_index, from 0: by ratio within an image, equal ones by arrival."""
    return candidates.withColumn("sorted_index", F.row_number().over(Window.partitionBy("image").orderBy("ratio", "idx")) - 1)


def fixed_batches(ordered: DataFrame, position: str = "sorted_index", size: int = BATCH) -> DataFrame:
    """Add batch: every ``size`` rows of an image in the given order."""
    return ordered.withColumn("batch", F.floor(F.col(position) / size))


def budget_batches(ordered: DataFrame, budget: int, size: int = BATCH) -> DataFrame:
    """image, batch, n, max_w: a batch grows while it has fewer than ``size`` rows and its widest times its count stays within ``budget``."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("sorted_index", "rec_w"))), lambda s: s["rec_w"])

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["n"] == 0) | ((acc["n"] < size) & (F.greatest(acc["w"], w) * (acc["n"] + 1) <= budget))
        closed = F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), acc["w"].alias("w"))))
        return F.when(fits, F.struct((acc["n"] + 1).alias("n"), F.greatest(acc["w"], w).alias("w"), acc["out"].alias("out"))).otherwise(
            F.struct(F.lit(1).alias("n"), w.alias("w"), closed.alias("out")))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"), F.array().cast("array<struct<n:int,w:int>>").alias("out"))
    folded = F.aggregate("ws", start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), acc["w"].alias("w")))))
    batches = ordered.groupBy("image").agg(rows.alias("ws")).select("image", F.posexplode(folded).alias("batch", "b"))
    return batches.select("image", "batch", "b.n", F.col("b.w").alias("max_w"))


def batch_report(batched: DataFrame) -> DataFrame:
    """image, batch, n, max_w, waste: the padding that a batch's rows need to reach its widest."""
    return batched.groupBy("image", "batch").agg(
        F.count("*").alias("n"), F.max("rec_w").alias("max_w"), (F.max("rec_w") * F.count("*") - F.sum("rec_w")).alias("waste"))


def funnel(candidates: DataFrame) -> DataFrame:
    """Per image: boxes, rotated ones, accepted ones and rejects by reason."""
    of = lambda r: F.count_if(F.col("reason") == r)
    return candidates.groupBy("image").agg(
        F.count("*").alias("boxes"), F.count_if("rotated").alias("rotated"), of("accepted").alias("accepted"),
        of("min_side").alias("min_side"), of("score").alias("low_score"), of("unclip_side").alias("unclip_side"))
