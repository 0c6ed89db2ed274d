"""Queries over benchmark and profile logs, which are written as lines from events and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import logs
from ..sources import views
from ..sources.views import BENCH
from .registration import registration

QUERIES, SQL, query = registration()


def bench_lines(spark, d):
    """Lines of both runs, the second run's records later, with noise between."""
    b = views.bench_runs(spark, d)
    record = F.concat(F.lit("12:00 "), F.lit(logs.FFI_PREFIX), F.to_json(F.struct("image", "detection_count", "elapsed_ms")))
    place = F.regexp_extract("image", "img([0-9]+)", 1).cast("long") * 2 + F.col("run") * 10**15
    rows = b.select(place.alias("line_no"), record.alias("value"))
    return rows.unionByName(rows.select((F.col("line_no") + 1).alias("line_no"), F.lit("warming up [OCR]").alias("value")))


def profile_lines(spark, d):
    e = views.table(spark, d, "events")
    line = F.concat(
        F.lit("  " + logs.PROFILE_PREFIX + "image="), F.expr("event_id div 200").cast("string"), F.lit(", size=1820x1024, boxes="), (F.col("event_id") % 50).cast("string"),
        F.lit(", rotated="), F.when(F.col("event_id") % 2 == 0, "true").otherwise("False"), F.lit(", det_ms="), (F.col("event_id") % 1000).cast("string"), F.lit(".5, rec_ms="),
        (F.col("event_id") % 300).cast("string"), F.lit(".25, boxes="), (F.col("event_id") % 40).cast("string"))
    return e.select(F.col("event_id").alias("line_no"), line.alias("value"))


SUMMARY = BENCH + """,
summary AS (SELECT run, split_part(image, '/', 2) AS image, max(detection_count) AS detection_count, avg(ms) AS mean_ms, median(ms) AS median_ms, min(ms) AS min_ms, max(ms) AS max_ms, count(*) AS samples
    FROM (SELECT run, image, detection_count, unnest(elapsed_ms) AS ms FROM bench) GROUP BY run, image)"""


@query("s1_bench_scan", f"WITH {BENCH} SELECT image, max_by(detection_count, run) AS detection_count, max_by(len(elapsed_ms), run) AS samples, round(list_sum(max_by(elapsed_ms, run)), 4) AS total FROM bench GROUP BY image")
def s1(spark, d):
    r = logs.checked_bench(logs.scan_bench(bench_lines(spark, d)))
    total = F.aggregate("elapsed_ms", F.lit(0.0), lambda a, v: a + v)
    return r.select("image", "detection_count", F.size("elapsed_ms").cast("long").alias("samples"), F.round(total, 4).alias("total"))


@query("s2_prefixed_scan", f"WITH {BENCH} SELECT CASE run WHEN 0 THEN 'ffi' ELSE 'app' END AS family, CASE WHEN image LIKE '%7.png' THEN replace(image, 'shots', 'original') ELSE image END AS image, detection_count FROM bench")
def s2(spark, d):
    b = views.bench_runs(spark, d)
    prefix = F.when(F.col("run") == 0, logs.FFI_PREFIX).otherwise(logs.APP_PREFIX)
    lines = b.select(F.lit(1).alias("line_no"), F.concat(F.lit(" "), prefix, F.to_json(F.struct("image", "detection_count", "elapsed_ms"))).alias("value"))
    paths = b.filter(F.col("image").endswith("7.png")).select(F.col("image").alias("prepared"), F.replace("image", F.lit("shots"), F.lit("original")).alias("original")).distinct()
    return logs.scan_prefixed(lines, paths).select("family", "image", "detection_count")


@query("s3_profile_scan", "SELECT event_id AS line_no, 'image=' || (event_id // 200) || ', size=1820x1024, boxes=' || (event_id % 50) || ', rotated=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'False' END || ', det_ms=' || (event_id % 1000) || '.5, rec_ms=' || (event_id % 300) || '.25, boxes=' || (event_id % 40) AS raw FROM events")
def s3(spark, d):
    return logs.scan_profile(profile_lines(spark, d))


@query("s4_json_lines", "SELECT event_id AS line_no, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 3 <> 0 AND props LIKE '{%'")
def s4(spark, d):
    e = views.table(spark, d, "events")
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("log: "), "props")).otherwise(F.col("props")).alias("value"))
    return logs.scan_json(lines, "k int")


@query("f7_f8_profile_values", """WITH r AS (SELECT event_id AS line_no, unnest(['image', 'size', 'boxes', 'rotated', 'det_ms', 'rec_ms']) AS key, event_id, user_id FROM events)
    SELECT line_no, key, CASE key WHEN 'size' THEN 'text' WHEN 'rotated' THEN 'bool' WHEN 'image' THEN 'int' WHEN 'boxes' THEN 'int' ELSE 'float' END AS kind,
           CASE WHEN key = 'rotated' THEN event_id % 2 = 0 END AS b, CASE key WHEN 'image' THEN event_id // 200 WHEN 'boxes' THEN event_id % 40 END AS i,
           CASE key WHEN 'det_ms' THEN event_id % 1000 + 0.5::DOUBLE WHEN 'rec_ms' THEN event_id % 300 + 0.25::DOUBLE END AS d, CASE WHEN key = 'size' THEN '1820x1024' END AS s
    FROM r""")
def f7(spark, d):
    return logs.typed_entries(logs.profile_entries(logs.scan_profile(profile_lines(spark, d))))


@query("f9_stage_line", "SELECT event_id, '[OCR_STAGE] app phase=' || event_type || ' capture_ms=' || (event_id % 90) AS line FROM events")
def f9(spark, d):
    fields = F.array(F.struct(F.lit("phase").alias("key"), F.col("event_type").alias("value")), F.struct(F.lit("capture_ms").alias("key"), (F.col("event_id") % 90).cast("string").alias("value")))
    return views.table(spark, d, "events").select("event_id", tx.stage_line("[OCR_STAGE] app", fields).alias("line"))


@query("w1_latest_profile", "SELECT event_id // 200 AS image, max(event_id) AS line_no, max_by(event_id % 1000, event_id) + 0.5::DOUBLE AS det_ms FROM events GROUP BY event_id // 200")
def w1(spark, d):
    e = logs.profile_entries(logs.scan_profile(profile_lines(spark, d))).withColumn("image", F.regexp_replace(F.col("fields")["image"], ",", "").cast("long"))
    last = logs.latest_entry(e, "image")
    return last.select("image", "line_no", F.regexp_replace(F.col("fields")["det_ms"], ",", "").cast("double").alias("det_ms"))


ROUNDED = "round(mean_ms, 6) AS mean_ms, round(median_ms, 6) AS median_ms, min_ms, max_ms, samples"


@query("a1_latency_summary", f"WITH {SUMMARY} SELECT run, image, detection_count, {ROUNDED} FROM summary")
def a1(spark, d):
    return logs.summarise(views.bench_runs(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_ms", "median_ms")})


def _two(spark, d):
    s = logs.summarise(views.bench_runs(spark, d))
    return s.filter("run = 0"), s.filter("run = 1")


@query("j4_benchmark_guard", f"""WITH {SUMMARY} SELECT coalesce(b.image, c.image) AS image, CASE WHEN c.image IS NULL THEN 'missing' WHEN b.image IS NULL THEN 'unexpected'
    WHEN b.detection_count <> c.detection_count THEN 'count changed' WHEN c.median_ms > b.median_ms * 1.01::DOUBLE THEN 'slower' ELSE 'ok' END AS verdict
    FROM (SELECT * FROM summary WHERE run = 0) b FULL JOIN (SELECT * FROM summary WHERE run = 1) c ON b.image = c.image""")
def j4(spark, d):
    return logs.guard(*_two(spark, d), ratio=1.01).select("image", "verdict")


@query("j5_run_comparison", f"""WITH {SUMMARY} SELECT a.image, round(b.mean_ms - a.mean_ms, 6) AS mean_delta, round(b.median_ms - a.median_ms, 6) AS median_delta,
    b.mean_ms <= a.mean_ms AS mean_not_slower, b.median_ms <= a.median_ms AS median_not_slower, a.detection_count = b.detection_count AS same_count
    FROM summary a JOIN summary b ON a.image = b.image AND a.run = 0 AND b.run = 1""", zero=("mean_delta", "median_delta"))
def j5(spark, d):
    return logs.compare_runs(*_two(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_delta", "median_delta")})



NAMES = ("load", "det", "crop", "cls", "rotate", "rec", "post")
STAGE = "[" + ", ".join(f"'{x}'" for x in NAMES) + "]"


@query("a11_stage_totals", f"""WITH s AS (SELECT event_id // 200 AS image, {STAGE}[CAST(event_id % 7 AS INTEGER) + 1] AS stage, value AS ms FROM events)
    SELECT image, {", ".join(f"round(sum(CASE WHEN stage = '{x}' THEN ms ELSE 0 END), 4) AS {x}_ms" for x in NAMES)}, round(sum(ms), 4) AS total_ms,
           round(CASE WHEN sum(ms) > 0 THEN sum(CASE WHEN stage = 'rec' THEN ms ELSE 0 END) / sum(ms) ELSE 0 END, 8) AS rec_share FROM s GROUP BY image""", zero=("rec_share",))
def a11(spark, d):
    stages = views.table(spark, d, "events").select(
        F.expr("event_id div 200").alias("image"), F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("event_id") % 7).cast("int")).alias("stage"), F.col("value").alias("ms"))
    return logs.stage_totals(stages).withColumns({**{f"{x}_ms": F.round(f"{x}_ms", 4) for x in (*NAMES, "total")}, "rec_share": F.round("rec_share", 8)})


@query("j11_bench_with_profile", f"""WITH {SUMMARY}, p AS (SELECT 'img' || (event_id // 200) || '.png' AS image, max_by(event_id % 1000, event_id) + 0.5::DOUBLE AS det_ms FROM events GROUP BY 1)
    SELECT s.image, s.detection_count, round(s.median_ms, 6) AS median_ms, p.det_ms FROM summary s JOIN p ON p.image = s.image WHERE s.run = 0""")
def j11(spark, d):
    base = _two(spark, d)[0].select("image", "detection_count", F.round("median_ms", 6).alias("median_ms"))
    last = w1(spark, d).select(F.concat(F.lit("img"), F.col("image").cast("string"), F.lit(".png")).alias("image"), "det_ms")
    return base.join(last, "image")
