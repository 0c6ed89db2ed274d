"""Queries over sizes, candidates and batches; images and crops are derived from lineitem and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as pl
from ..sources import views
from ..sources.views import DET
from .registration import registration

QUERIES, SQL, query = registration()


def images(spark, d):
    o = F.col("o_orderkey")
    return views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image"), (F.col("o_custkey") * 7 % 3000).cast("int").alias("image_w"), (o * 11 % 2000).cast("int").alias("image_h"),
        F.when(o % 2 == 0, "width").otherwise("long-side").alias("mode"), (o % 3 * 600).cast("int").alias("backend_w"))


IMAGES = """images AS (SELECT o_orderkey AS image, CAST(o_custkey * 7 % 3000 AS INTEGER) AS image_w, CAST(o_orderkey * 11 % 2000 AS INTEGER) AS image_h,
    CASE WHEN o_orderkey % 2 = 0 THEN 'width' ELSE 'long-side' END AS mode, CAST(o_orderkey % 3 * 600 AS INTEGER) AS backend_w FROM orders)"""


@query("p6_crop_rect", f"""WITH {IMAGES}, r AS (SELECT image, image_w, image_h, CAST(image % 900 AS DOUBLE) AS rx, CAST(image % 500 AS DOUBLE) AS ry, CAST(image % 700 - 300 AS DOUBLE) AS rw, CAST(image % 400 - 100 AS DOUBLE) AS rh,
    CAST(CASE WHEN image % 50 = 0 THEN 0 ELSE 1280 END AS DOUBLE) AS vw, CAST(720 AS DOUBLE) AS vh FROM images),
    e AS (SELECT *, CASE WHEN image_w <= 0 OR image_h <= 0 THEN 'empty image' WHEN vw <= 0 THEN 'bad viewport' END AS error,
          least(greatest(least(rx, rx + rw), 0), vw) AS x1, least(greatest(greatest(rx, rx + rw), 0), vw) AS x2, least(greatest(least(ry, ry + rh), 0), vh) AS y1, least(greatest(greatest(ry, ry + rh), 0), vh) AS y2 FROM r),
    c AS (SELECT *, CASE WHEN error IS NULL THEN floor(x1 * (image_w / vw)) END AS cx, CASE WHEN error IS NULL THEN floor(y1 * (image_h / vh)) END AS cy FROM e)
    SELECT image, error, CAST(cx AS INTEGER) AS crop_x, CAST(cy AS INTEGER) AS crop_y,
           CAST(CASE WHEN error IS NULL THEN least(greatest(ceil((x2 - x1) * (image_w / vw)), 1), greatest(image_w - cx, 0)) END AS INTEGER) AS crop_w,
           CAST(CASE WHEN error IS NULL THEN least(greatest(ceil((y2 - y1) * (image_h / vh)), 1), greatest(image_h - cy, 0)) END AS INTEGER) AS crop_h FROM c""")
def p6(spark, d):
    i = F.col("image")
    r = images(spark, d).withColumns({
        "rect_x": (i % 900).cast("double"), "rect_y": (i % 500).cast("double"), "rect_w": (i % 700 - 300).cast("double"), "rect_h": (i % 400 - 100).cast("double"),
        "viewport_w": F.when(i % 50 == 0, 0.0).otherwise(1280.0), "viewport_h": F.lit(720.0)})
    return pl.crop_rect(r).select("image", "error", "crop_x", "crop_y", "crop_w", "crop_h")


LIMITS = IMAGES + """, limits AS (SELECT *, CASE WHEN mode = 'width' OR image_w >= image_h THEN CASE WHEN backend_w > 0 THEN least(backend_w, 1024) ELSE 1024 END ELSE 0 END AS max_w,
    CASE WHEN mode = 'width' OR image_w >= image_h THEN 0 ELSE 1024 END AS max_h FROM images)"""


@query("p7_resize_limits", f"""WITH {LIMITS} SELECT image, max_w, max_h, CASE WHEN image_w >= image_h THEN 0 WHEN image_h > 1024 THEN 1024 ELSE 0 END AS eff_h,
    CASE WHEN image_w < image_h THEN 0 WHEN image_w > 1024 THEN 1024 ELSE 0 END AS eff_w FROM limits WHERE mode <> 'width'
    UNION ALL SELECT image, max_w, max_h, 0, CASE WHEN backend_w > 0 THEN backend_w ELSE 1024 END FROM limits WHERE mode = 'width'""")
def p7(spark, d):
    asked = pl.resize_limits(images(spark, d)).withColumns({"runner": F.lit("pipeline"), "asked_w": F.col("backend_w"), "asked_h": F.lit(0)})
    return pl.effective_limits(asked).select("image", "max_w", "max_h", "eff_h", "eff_w")


@query("p8_fit_resize", f"""WITH {LIMITS}, r AS (SELECT *, least(CASE WHEN max_w > 0 AND image_w > max_w THEN max_w / image_w ELSE 1 END, CASE WHEN max_h > 0 AND image_h > max_h THEN max_h / image_h ELSE 1 END) AS ratio FROM limits),
    t AS (SELECT *, CAST(CASE WHEN ratio < 1 THEN greatest(round(image_w * ratio), 1) ELSE image_w END AS INTEGER) AS target_w, CAST(CASE WHEN ratio < 1 THEN greatest(round(image_h * ratio), 1) ELSE image_h END AS INTEGER) AS target_h FROM r)
    SELECT image, CASE WHEN image_w > 0 AND image_h > 0 THEN NULL ELSE 'empty image' END AS error, CASE WHEN image_w > 0 AND image_h > 0 THEN target_w END AS target_w,
           CASE WHEN image_w > 0 AND image_h > 0 THEN target_h END AS target_h, CASE WHEN image_w > 0 AND image_h > 0 THEN round(image_w / target_w, 9) END AS sx,
           CASE WHEN image_w > 0 AND image_h > 0 THEN round(image_h / target_h, 9) END AS sy FROM t""")
def p8(spark, d):
    r = pl.fit_resize(pl.resize_limits(images(spark, d)))
    return r.select("image", "error", "target_w", "target_h", F.round("sx", 9).alias("sx"), F.round("sy", 9).alias("sy"))


@query("p9_detector_size", f"""WITH {IMAGES}, p AS (SELECT image, CASE WHEN image_w + image_h < 64 THEN greatest(32, image_w) ELSE image_w END AS w, CASE WHEN image_w + image_h < 64 THEN greatest(32, image_h) ELSE image_h END AS h FROM images WHERE image_w > 0 AND image_h > 0),
    e AS (SELECT image FROM images WHERE NOT (image_w > 0 AND image_h > 0)),
    s AS (SELECT image, CAST(trunc(w * k) AS INTEGER) AS w, CAST(trunc(h * k) AS INTEGER) AS h FROM (SELECT *, CASE WHEN least(w, h) < 736 THEN 736 / least(w, h) ELSE CAST(1 AS DOUBLE) END AS k FROM p)),
    c AS (SELECT image, CAST(trunc(w * k) AS INTEGER) AS w, CAST(trunc(h * k) AS INTEGER) AS h FROM (SELECT *, CASE WHEN greatest(w, h) > 4000 THEN 4000 / greatest(w, h) ELSE CAST(1 AS DOUBLE) END AS k FROM s))
    SELECT image, NULL AS error, CAST(greatest(32, round(w / 32) * 32) AS INTEGER) AS det_w, CAST(greatest(32, round(h / 32) * 32) AS INTEGER) AS det_h FROM c
    UNION ALL SELECT image, 'empty image', NULL, NULL FROM e""")
def p9(spark, d):
    return pl.detector_size(images(spark, d), 736).select("image", "error", "det_w", "det_h")


def crops(spark, d):
    det = views.detections(spark, d).withColumn("w", F.col("w") * (1 + F.col("part") % 9))
    return pl.recogniser_width(pl.orientation(det.withColumn("label", F.col("part") % 2)))


CROPS = DET + """, crops AS (SELECT *, w / h AS ratio, part % 2 = 1 AS rotated, CAST(least(3200, greatest(320, trunc(48 * greatest(320 / 48, w / h)))) AS INTEGER) AS rec_w
    FROM (SELECT * REPLACE (w * (1 + part % 9) AS w) FROM det)),
sorted AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ratio, idx) - 1 AS sorted_index FROM crops)"""


@query("p10_p14_recogniser_width", f"""WITH {CROPS} SELECT image, idx, rotated, ratio, rec_w, CASE WHEN rec_w >= 3200 THEN 3200 ELSE CAST(greatest(1, least(ceil(48 * w / h), rec_w)) AS INTEGER) END AS resized_w FROM crops""")
def p10(spark, d):
    return crops(spark, d).select("image", "idx", "rotated", "ratio", "rec_w", "resized_w")


CANDIDATES = DET + """, cand AS (SELECT *, part % 2 = 1 AS rotated, part % 11 AS mini_side, part % 11 + idx % 3 AS unclip_side FROM det),
reasons AS (SELECT *, CASE WHEN mini_side < 3 THEN 'min_side' WHEN score < 0.4 THEN 'score' WHEN unclip_side < 5 THEN 'unclip_side' ELSE 'accepted' END AS reason FROM cand)"""


def candidates(spark, d):
    c = views.detections(spark, d).withColumns({"rotated": F.col("part") % 2 == 1, "mini_side": F.col("part") % 11, "unclip_side": F.col("part") % 11 + F.col("idx") % 3})
    return pl.reject_reason(c, 3.0, 0.4)


@query("p12_reject_reason", f"WITH {CANDIDATES} SELECT image, idx, reason FROM reasons")
def p12(spark, d):
    return candidates(spark, d).select("image", "idx", "reason")


@query("p13_to_source", f"WITH {DET} SELECT image, idx, least(greatest(round_even(x * 1.25::DOUBLE, 0), 0), 900) AS sx, least(greatest(round_even(y * 0.75::DOUBLE, 0), 0), 500) AS sy FROM det")
def p13(spark, d):
    det = views.detections(spark, d)
    return det.select("image", "idx", pl.to_source(F.col("x"), F.lit(1.25), F.lit(900)).alias("sx"), pl.to_source(F.col("y"), F.lit(0.75), F.lit(500)).alias("sy"))


@query("a10_candidate_funnel", f"""WITH {CANDIDATES} SELECT image, count(*) AS boxes, count(*) FILTER (WHERE rotated) AS rotated, count(*) FILTER (WHERE reason = 'accepted') AS accepted,
    count(*) FILTER (WHERE reason = 'min_side') AS min_side, count(*) FILTER (WHERE reason = 'score') AS low_score, count(*) FILTER (WHERE reason = 'unclip_side') AS unclip_side FROM reasons GROUP BY image""")
def a10(spark, d):
    return pl.funnel(candidates(spark, d))


@query("w3_ratio_order", f"WITH {CROPS} SELECT image, idx, CAST(sorted_index AS INTEGER) AS sorted_index FROM sorted")
def w3(spark, d):
    return pl.ratio_order(crops(spark, d)).select("image", "idx", "sorted_index")


@query("w4_w6_batch_report", f"WITH {CROPS} SELECT image, sorted_index // 6 AS batch, count(*) AS n, max(rec_w) AS max_w, CAST(max(rec_w) * count(*) - sum(rec_w) AS BIGINT) AS waste FROM sorted GROUP BY image, sorted_index // 6")
def w4(spark, d):
    return pl.batch_report(pl.fixed_batches(pl.ratio_order(crops(spark, d))))


@query("w5_budget_batches", f"""WITH RECURSIVE {CROPS}, fold AS (
    SELECT image, CAST(-1 AS BIGINT) AS i, 0 AS n, 0 AS w, CAST(-1 AS INTEGER) AS batch FROM (SELECT DISTINCT image FROM sorted)
    UNION ALL
    SELECT f.image, s.sorted_index, CASE WHEN f.n > 0 AND f.n < 6 AND greatest(f.w, s.rec_w) * (f.n + 1) <= 1500 THEN f.n + 1 ELSE 1 END,
           CASE WHEN f.n > 0 AND f.n < 6 AND greatest(f.w, s.rec_w) * (f.n + 1) <= 1500 THEN greatest(f.w, s.rec_w) ELSE s.rec_w END,
           CASE WHEN f.n > 0 AND f.n < 6 AND greatest(f.w, s.rec_w) * (f.n + 1) <= 1500 THEN f.batch ELSE f.batch + 1 END
    FROM fold f JOIN sorted s ON s.image = f.image AND s.sorted_index = f.i + 1)
    SELECT image, batch, max(n) AS n, max(w) AS max_w FROM fold WHERE i >= 0 GROUP BY image, batch""")
def w5(spark, d):
    return pl.budget_batches(pl.ratio_order(crops(spark, d)), 1500)


@query("w7_orientation_batches", f"WITH {DET} SELECT image, (idx - 1) // 6 AS batch, count(*) AS n, min(idx) AS first_idx FROM det GROUP BY image, (idx - 1) // 6")
def w7(spark, d):
    det = views.detections(spark, d).withColumn("pos", F.col("idx") - 1)
    return pl.fixed_batches(det, "pos").groupBy("image", "batch").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
