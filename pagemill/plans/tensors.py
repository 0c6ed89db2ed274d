"""Queries over logits, tensors and maps, all derived from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decoding, tensors
from ..sources import views
from ..sources.views import LOGITS
from .registration import registration

QUERIES, SQL, query = registration()


def _dictionary(spark, d):
    """Six letters, so that class 7 lies beyond the dictionary."""
    return spark.createDataFrame(list(enumerate("abcdef")), "class_idx int, ch string")


def _items(spark, d):
    """Embeddings as dumped logits of 8 classes a step."""
    steps = F.floor(F.size("embedding") / 8).cast("int")
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("original_index"), F.col("embedding").alias("values"), steps.alias("time_steps"), F.lit(8).alias("num_classes"))


BEST = LOGITS + ", best AS (SELECT item, t, c AS best, p FROM (SELECT *, row_number() OVER (PARTITION BY item, t ORDER BY p DESC, c) AS rn FROM logits) WHERE rn = 1)"
CTC = BEST + """, steps AS (SELECT *, lag(best) OVER (PARTITION BY item ORDER BY t) AS before FROM best),
kept AS (SELECT item, t, substr('abcdef', CAST(best AS INTEGER), 1) AS ch, p FROM steps WHERE best <> 0 AND best <= 6 AND (before IS NULL OR before <> best)),
texts AS (SELECT item, string_agg(ch, '' ORDER BY t) AS text, avg(p) AS score FROM kept GROUP BY item),
decoded AS (SELECT i.item, coalesce(text, '') AS text, coalesce(score, 0) AS score FROM (SELECT DISTINCT item FROM logits) i LEFT JOIN texts x ON x.item = i.item)"""
PAIR = LOGITS + ", duo AS (SELECT a.item, a.t, a.c, a.p AS a, b.p AS b FROM logits a JOIN logits b ON b.item = a.item + 1 AND a.t = b.t AND a.c = b.c)"


@query("a13_argmax", f"WITH {BEST} SELECT item, t, best, p FROM best")
def a13(spark, d):
    return tensors.argmax(views.logits(spark, d), ["item", "t"])


@query("a14_w2_j7_ctc_decode", f"WITH {CTC} SELECT item, text, round(score, 8) AS score FROM decoded")
def a14(spark, d):
    return decoding.decode_logits(_items(spark, d), _dictionary(spark, d)).withColumn("score", F.round("score", 8))


@query("a6_tensor_diff", f"""WITH {PAIR} SELECT item, round(avg(abs(a - b)), 8) AS mean_diff, max(abs(a - b)) AS max_diff, round(avg(a), 8) AS mean_a, max(a) AS max_a,
    round(avg(b), 8) AS mean_b, max(b) AS max_b FROM duo GROUP BY item""", zero=("mean_a", "mean_b"))
def a6(spark, d):
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("item") - 1).alias("item"), F.col("a").alias("b")), "item")
    r = tensors.tensor_diff(pairs, ["item"]).drop("same_shape")
    return r.withColumns({c: F.round(c, 8) for c in ("mean_diff", "mean_a", "mean_b")})


@query("a7_map_diff", f"""WITH {PAIR} SELECT item AS map_id, round(avg(abs(a - b)), 8) AS mean_diff, max(abs(a - b)) AS max_diff, count(*) FILTER (WHERE a > 0.1::DOUBLE) AS above_a,
    count(*) FILTER (WHERE b > 0.1::DOUBLE) AS above_b, count(*) FILTER (WHERE (a > 0.1::DOUBLE) <> (b > 0.1::DOUBLE)) AS disagree FROM duo GROUP BY item""")
def a7(spark, d):
    p = views.pixels(spark, d)
    return tensors.map_diff(p, p.withColumn("map_id", F.col("map_id") - 1), 0.1).withColumn("mean_diff", F.round("mean_diff", 8))


def _crops(spark, d):
    return views.pixels(spark, d).select(F.col("map_id").alias("crop"), "px", (F.col("py") % 2).alias("py"), F.expr("py div 2").alias("ch"), F.round(F.col("p") * 2).alias("v"))


@query("a8_pixel_diff", f"""WITH {PAIR}, v AS (SELECT item, c, t % 2 AS y, abs(round(a * 2) - round(b * 2)) AS d FROM duo), px AS (SELECT item, c, y, sum(d) AS s, max(d) AS m, count(*) AS n FROM v GROUP BY item, c, y)
    SELECT item AS crop, round(sum(s) / sum(n), 8) AS mean_diff, max(m) AS max_diff, count(*) FILTER (WHERE m > 0) AS changed_pixels FROM px GROUP BY item""")
def a8(spark, d):
    p = _crops(spark, d)
    r = tensors.pixel_diff(p, p.withColumn("crop", F.col("crop") - 1)).filter("same_size")
    return r.select("crop", F.round("mean_diff", 8).alias("mean_diff"), "max_diff", "changed_pixels")


@query("a9_map_statistics", f"""WITH {LOGITS} SELECT item AS map_id, min(p) AS min, max(p) AS max, round(avg(p), 8) AS mean, round(sqrt(avg(p * p)), 8) AS rms, count(*) FILTER (WHERE p > 0) AS positive,
    max(CASE WHEN t = 4 AND c = 4 THEN p END) AS center FROM logits GROUP BY item""", zero=("mean",))
def a9(spark, d):
    return tensors.map_statistics(views.pixels(spark, d)).withColumns({c: F.round(c, 8) for c in ("mean", "rms")})


@query("a15_channel_means", f"WITH {LOGITS} SELECT item AS crop, t // 2 AS ch, round(avg(round(p * 2)), 8) AS mean FROM logits GROUP BY item, t // 2", zero=("mean",))
def a15(spark, d):
    return tensors.channel_means(_crops(spark, d)).withColumn("mean", F.round("mean", 8))


@query("a19_logit_comparison", f"""WITH {CTC}, duo AS (SELECT a.item, a.p AS a, b.p AS b FROM logits a JOIN logits b ON b.item = a.item + 1 AND a.t = b.t AND a.c = b.c)
    SELECT l.item, l.text AS left_text, r.text AS right_text, round(l.score, 8) AS left_score, round(r.score, 8) AS right_score, l.text = r.text AS same_text, d.mean_diff, d.max_diff
    FROM decoded l JOIN decoded r ON r.item = l.item + 1 JOIN (SELECT item, round(avg(abs(a - b)), 8) AS mean_diff, max(abs(a - b)) AS max_diff FROM duo GROUP BY item) d ON d.item = l.item""")
def a19(spark, d):
    a = _items(spark, d)
    r = decoding.compare_items(a, a.withColumn("original_index", F.col("original_index") - 1), _dictionary(spark, d)).drop("same_shape")
    return r.withColumns({c: F.round(c, 8) for c in ("left_score", "right_score", "mean_diff")})


@query("f10_probabilities", f"WITH {LOGITS} SELECT item AS map_id, c AS px, t AS py, round(CASE WHEN min(p) OVER m < 0 OR max(p) OVER m > 1 THEN 1 / (1 + exp(-p)) ELSE p END, 9) AS p FROM logits WINDOW m AS (PARTITION BY item)")
def f10(spark, d):
    return tensors.as_probabilities(views.pixels(spark, d)).withColumn("p", F.round("p", 9))


@query("f11_normalised", f"WITH {LOGITS} SELECT item AS crop, c AS px, t % 2 AS py, t // 2 AS ch, round((round(p * 2) * 2 - t // 2) / CASE t // 2 WHEN 0 THEN 1 ELSE t // 2 END, 9) AS v FROM logits", zero=("v",))
def f11(spark, d):
    p = _crops(spark, d)
    channels = p.select("ch").distinct().select("ch", F.lit(2.0).alias("scale"), F.col("ch").cast("double").alias("mean"), F.col("ch").cast("double").alias("std"))
    return tensors.normalised(p, channels).withColumn("v", F.round("v", 9))


@query("f12_logit_layout", """SELECT vec_id, CASE vec_id % 5 WHEN 4 THEN NULL ELSE 8 END AS t, CASE vec_id % 5 WHEN 4 THEN NULL WHEN 1 THEN 4 ELSE 8 END AS c FROM embeddings""")
def f12(spark, d):
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    shape = F.when(F.col("vec_id") % 5 == 0, lit(8, 8)).when(F.col("vec_id") % 5 == 1, lit(1, 8, 4)).when(F.col("vec_id") % 5 == 2, lit(1, 8, 1, 8)).when(F.col("vec_id") % 5 == 3, lit(1, 1, 8, 8)).otherwise(lit(1, 2, 3, 4))
    t = views.table(spark, d, "embeddings").select("vec_id", tensors.layout(shape).alias("l"))
    return t.select("vec_id", "l.t", "l.c")


@query("j10_zonal_mean", f"""WITH {LOGITS}, q AS (SELECT item, box, item % 4 + box AS x0, item % 3 + box AS y0 FROM (SELECT DISTINCT item FROM logits), (SELECT unnest([0, 2, 9]) AS box))
    SELECT q.item AS map_id, q.box, count(p) AS n, round(coalesce(sum(p), 0), 8) AS total, round(coalesce(avg(p), 0), 8) AS mean
    FROM q LEFT JOIN logits l ON l.item = q.item AND l.c + 0.5 BETWEEN q.x0 AND q.x0 + 3 AND l.t + 0.5 BETWEEN q.y0 AND q.y0 + 2 GROUP BY q.item, q.box""", zero=("total", "mean"))
def j10(spark, d):
    p = views.pixels(spark, d)
    box = F.explode(F.array(F.lit(0), F.lit(2), F.lit(9))).alias("box")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("map_id") % 4 + F.col("box"), F.col("map_id") % 3 + F.col("box")
    quads = p.select("map_id").distinct().select("map_id", box).select("map_id", "box", F.array(point(x, y), point(x + 3, y), point(x + 3, y + 2), point(x, y + 2)).alias("quad"))
    return tensors.zonal_mean(p, quads).withColumns({c: F.round(c, 8) for c in ("total", "mean")})


@query("a18_points_close", "SELECT vec_id, vec_id % 3 <> 1 AS close FROM embeddings")
def a18(spark, d):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    v = F.col("vec_id")
    a = F.when(v % 3 != 2, F.array(point(v, v + 1), point(v + 2, v)))
    b = F.when(v % 3 == 0, F.array(point(v + 0.00005, v + 1), point(v + 2, v))).when(v % 3 == 1, F.array(point(v, v + 1.001), point(v + 2, v)))
    return views.table(spark, d, "embeddings").select("vec_id", tensors.points_close(a, b).alias("close"))
