"""Queries over log files and config documents: lines from events, written as text files of many parts and read again by byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs
from ..sources import readers, views
from . import logs as log_queries
from .registration import registration

QUERIES, SQL, query = registration()


def _as_files(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) as the files of one folder, in order of their names, and read back with numbers of their own."""
    path = readers.scratch(spark)
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return readers.read_lines(spark, path)


@query("s1_bench_log_files", log_queries.SQL["s1_bench_scan"])
def s1_files(spark, d):
    """Both runs in files, the second later: the last record of an image wins, in whichever file it is."""
    r = logs.checked_bench(logs.scan_bench(_as_files(spark, log_queries.bench_lines(spark, d))))
    total = F.aggregate("elapsed_ms", F.lit(0.0), lambda a, v: a + v)
    return r.select("image", "detection_count", F.size("elapsed_ms").cast("long").alias("samples"), F.round(total, 4).alias("total"))


@query("w1_latest_profile_of_files", "SELECT event_id // 200 AS image, max_by(event_id % 1000, event_id) + 0.5::DOUBLE AS det_ms FROM events GROUP BY event_id // 200")
def w1_files(spark, d):
    lines = _as_files(spark, log_queries.profile_lines(spark, d))
    e = logs.profile_entries(logs.scan_profile(lines)).withColumn("image", F.regexp_replace(F.col("fields")["image"], ",", "").cast("long"))
    return logs.latest_entry(e, "image").select("image", F.regexp_replace(F.col("fields")["det_ms"], ",", "").cast("double").alias("det_ms"))


@query("s7_config_dictionary", r"""WITH l AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark),
    k AS (SELECT CAST(row_number() OVER (ORDER BY unicode(ch)) - 1 AS INTEGER) AS class_idx, ch FROM l WHERE ch <> ''),
    w AS (SELECT * FROM k UNION ALL SELECT CAST(count(*) AS INTEGER), ' ' FROM k HAVING count(*) FILTER (WHERE ch = ' ') = 0)
    SELECT form, class_idx, ch FROM w, (SELECT unnest(['nested', 'top']) AS form)""")
def s7_config(spark, d):
    """The characters of the benchmark as config documents of both shapes, with empty entries between that go."""
    ch = views.table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch <> ''").distinct()
    listed = ch.agg(F.sort_array(F.collect_list(F.struct(F.ascii("ch").alias("at"), "ch"))).alias("s"))  # as long as the alphabet
    entries = F.flatten(F.transform("s", lambda s: F.array(F.lit(""), s["ch"])))
    top = listed.select(F.to_json(F.struct(entries.alias("character_dict"))).alias("value"))
    nested = listed.select(F.to_json(F.struct(F.struct(entries.alias("character_dict")).alias("PostProcess"))).alias("value"))
    told = lambda docs, form: readers.config_dictionary(docs).select(F.lit(form).alias("form"), "class_idx", "ch")
    return told(top, "top").unionByName(told(nested, "nested"))
