"""Lines of text files with their numbers, read by as many tasks as the files have byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value of text files; a line ends with a line feed, a carriage return or both.

    A first pass counts the lines of each byte range that a task reads, and the sums of these counts, a row for
    each range, say where a range begins to count. Filters on ``value`` are applied where lines are read, before
    ranges and lines meet. Both passes must split files alike: a line of a range that the first did
    not see stops the job.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta["file_path"].alias("path"), meta["file_name"].alias("file"), meta["file_block_start"].alias("start"), "value", F.monotonically_increasing_id().alias("at")
    )
    ranges = lines.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "start", "n", "low", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.col("at") - F.col("low")
    known = F.coalesce((within >= 0) & (within < F.col("n")), F.lit(False))
    number = F.when(known, within + F.col("before") + 1).otherwise(F.raise_error(F.lit("a log was split otherwise in the second pass; pin spark.sql.files.minPartitionNum")))
    return lines.join(ranges, ["path", "start"], "left").select("file", number.cast("long").alias("line_no"), "value")
