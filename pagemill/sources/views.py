"""Tables shaped like recognition results, derived from the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Run A: image, idx, x, y, w, h, text, score and the part key that run B depends on; images are dealt to ``parts`` tasks if that is given."""
    w = Window.partitionBy(F.expr("l_orderkey div 4")).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    text = F.concat(F.lit(" "), F.col("l_returnflag"), F.col("l_linestatus"), (F.col("l_linenumber") % 3).cast("string"), F.lit("\t"))
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(parts, F.expr("l_orderkey div 4")) if parts else lines
    return lines.select(
        F.expr("l_orderkey div 4").alias("image"),
        F.row_number().over(w).alias("idx"),
        ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 60) % 800).cast("double").alias("x"),
        (((F.col("l_partkey") * 13 + F.col("l_suppkey") * 29) % 30) * 24).cast("double").alias("y"),
        (20 + F.col("l_quantity")).alias("w"),
        F.lit(16.0).alias("h"),
        F.when(F.col("l_suppkey") % 19 == 0, "  ").otherwise(text).alias("text"),
        (F.col("l_discount") * 10).alias("score"),
        F.col("l_partkey").alias("part"),
    )


DET = """det AS MATERIALIZED (
    SELECT l_orderkey // 4 AS image,
           CAST(row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS idx,
           CAST((l_partkey * 7 + l_linenumber * 60) % 800 AS DOUBLE) AS x,
           CAST(((l_partkey * 13 + l_suppkey * 29) % 30) * 24 AS DOUBLE) AS y,
           20 + l_quantity AS w, CAST(16 AS DOUBLE) AS h,
           CASE WHEN l_suppkey % 19 = 0 THEN '  ' ELSE ' ' || l_returnflag || l_linestatus || CAST(l_linenumber % 3 AS VARCHAR) || chr(9) END AS text,
           l_discount * 10 AS score, l_partkey AS part
    FROM lineitem)"""


def other_run(run_a: DataFrame) -> DataFrame:
    """Run B: some boxes moved by 1, some texts changed, some boxes missing."""
    return run_a.filter(F.col("part") % 13 != 0).withColumns({
        "x": F.col("x") + F.when(F.col("part") % 5 == 0, 1.0).otherwise(0.0),
        "text": F.when(F.col("part") % 11 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")),
    })


DET_B = """det_b AS (
    SELECT image, idx, x + CASE WHEN part % 5 = 0 THEN 1 ELSE 0 END AS x, y, w, h,
           CASE WHEN part % 11 = 0 THEN text || '?' ELSE text END AS text, score, part
    FROM det WHERE part % 13 <> 0)"""


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, image, detection_count, elapsed_ms: an image for every 200 events, half of them in each run; run 1 lacks images ...3 and counts images ...5 otherwise."""
    e = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 2).cast("int").alias("run"), F.concat(F.lit("shots/img"), F.expr("event_id div 200").cast("string"), F.lit(".png")).alias("image"),
        "event_id", "value")
    runs = e.groupBy("run", "image").agg(
        F.countDistinct(F.col("event_id") % 7).cast("int").alias("detection_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("elapsed_ms"))
    changed = F.when((F.col("run") == 1) & F.col("image").endswith("5.png"), F.col("detection_count") + 1).otherwise(F.col("detection_count"))
    return runs.withColumn("detection_count", changed).filter(~((F.col("run") == 1) & F.col("image").endswith("3.png")))


BENCH = """e0 AS (SELECT CAST(event_id % 2 AS INTEGER) AS run, 'shots/img' || CAST(event_id // 200 AS VARCHAR) || '.png' AS image, event_id, value FROM events),
bench AS (
    SELECT run, image, CAST(count(DISTINCT event_id % 7) + CASE WHEN run = 1 AND image LIKE '%5.png' THEN 1 ELSE 0 END AS INTEGER) AS detection_count,
           array_agg(value ORDER BY event_id) AS elapsed_ms
    FROM e0 WHERE NOT (run = 1 AND image LIKE '%3.png') GROUP BY run, image)"""


def logits(spark: SparkSession, sf_dir: str, steps: int = 8) -> DataFrame:
    """item, t, c, p: every embedding as 8 steps of 8 class scores."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.posexplode("embedding").alias("k", "v"))
    return e.select("item", F.expr(f"cast(k div {steps} as int)").alias("t"), (F.col("k") % steps).alias("c"), F.col("v").cast("double").alias("p"))


LOGITS = """cells AS (
    SELECT vec_id AS item, CAST(unnest(range(len(embedding))) AS INTEGER) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
logits AS (SELECT item, k // 8 AS t, k % 8 AS c, v AS p FROM cells)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_id, px, py, p: every embedding as a map of 8 by 8 pixels."""
    return logits(spark, sf_dir).select(F.col("item").alias("map_id"), F.col("c").alias("px"), F.col("t").alias("py"), "p")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ts, seq, kind (capture or result), gen: a view starts a generation, a click is a result for an earlier one."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click"))
    captures = F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(
        Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    gen = F.when(F.col("event_type") == "view", captures).otherwise(F.greatest(captures - F.col("event_id") % 3, F.lit(0)))
    return e.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "capture").otherwise("result").alias("kind"), gen.cast("long").alias("gen"))


SESSIONS = """s0 AS (
    SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n
    FROM events WHERE event_type IN ('view', 'click')),
sessions AS (
    SELECT user_id AS session, ts, event_id AS seq, CASE WHEN event_type = 'view' THEN 'capture' ELSE 'result' END AS kind,
           CAST(CASE WHEN event_type = 'view' THEN n ELSE greatest(n - event_id % 3, 0) END AS BIGINT) AS gen FROM s0)"""
