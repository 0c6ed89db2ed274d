"""Benchmark and stage-profile logs: scanning lines, summaries and gates.

Lines are rows (line_no, value); ``sources.readers.read_lines`` makes them from text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranges import counted_up, median_of

BENCH_JSON = "image string, source string, score_thresh double, warmups int, iterations int, detection_count int, elapsed_ms array<double>"
FFI_PREFIX, APP_PREFIX = "[FFI_BENCH] ", "[APP_OCR_BENCH] "
PROFILE_PREFIX = "run_pipeline profile "


def _place(rows: DataFrame) -> Column:
    """Where a line stands: by its number, and before that by the name of its file where lines come from files."""
    return F.struct("file", "line_no") if "file" in rows.columns else F.struct("line_no")


def scan_bench(lines: DataFrame, prefix: str = FFI_PREFIX) -> DataFrame:
    """image, detection_count, elapsed_ms, error: JSON after the first ``prefix`` anywhere in a line; the last record of an image wins.

    A record that does not parse or has no samples keeps its row, with ``error`` set.
    """
    hit = lines.filter(F.col("value").contains(prefix))
    parsed = hit.select(_place(lines).alias("place"), F.from_json(F.substring("value", F.instr("value", prefix) + len(prefix), F.length("value")), BENCH_JSON).alias("r"))
    last = parsed.groupBy("r.image").agg(F.max_by("r", "place").alias("r"))
    empty = F.coalesce(F.size("r.elapsed_ms") < 1, F.lit(True))
    return last.select("image", "r.detection_count", "r.elapsed_ms", F.when(F.col("image").isNull(), "not a record").when(empty, "no samples").alias("error"))


def checked_bench(bench: DataFrame) -> DataFrame:
    """``bench`` as scanned, unless it holds no record or one with an error: either stops the job."""
    found = bench.agg(F.count("*").alias("n"), F.min("error").alias("error")).first()
    if not found["n"]:
        raise ValueError("no benchmark record in the log")
    if found["error"]:
        raise ValueError(f"benchmark log: {found['error']}")
    return bench.drop("error")


def scan_prefixed(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """family, line_no, image, detection_count, elapsed_ms of lines that start with either prefix; ``paths`` (prepared, original) renames images."""
    v = tx.trimmed(F.col("value"))
    family = F.when(v.startswith(APP_PREFIX), "app").when(v.startswith(FFI_PREFIX), "ffi")
    skip = F.when(F.col("family") == "app", len(APP_PREFIX)).otherwise(len(FFI_PREFIX))
    hit = lines.withColumn("v", v).withColumn("family", family).filter(F.col("family").isNotNull())
    parsed = hit.select("family", "line_no", F.from_json(F.substring("v", skip + 1, F.length("v")), BENCH_JSON).alias("r")).select("family", "line_no", "r.*")
    named = parsed.join(paths, parsed["image"] == paths["prepared"], "left")
    return named.select("family", "line_no", F.coalesce("original", "image").alias("image"), "detection_count", "elapsed_ms")


def scan_json(lines: DataFrame, schema: str) -> DataFrame:
    """line_no and fields of lines that start with a brace; other lines are noise."""
    return lines.filter(F.col("value").startswith("{")).select("line_no", F.from_json("value", schema).alias("r")).select("line_no", "r.*")


def scan_profile(lines: DataFrame, prefix: str = PROFILE_PREFIX) -> DataFrame:
    """line_no, raw: lines that start with ``prefix`` once stripped, without it (the line is stripped before it is cut)."""
    v = tx.trimmed(F.col("value"))
    hit = lines.filter(F.col("value").contains(prefix))  # which readers apply where they read
    return hit.filter(v.startswith(prefix)).select(*[c for c in ("file", "line_no") if c in lines.columns], tx.trimmed(F.substring(v, F.lit(len(prefix) + 1), F.length("value"))).alias("raw"))


def profile_entries(profile: DataFrame) -> DataFrame:
    """line_no, raw and ``fields``: key to raw value."""
    return profile.withColumn("fields", tx.key_values(F.col("raw")))


def typed_entries(entries: DataFrame) -> DataFrame:
    """One row per line and key with its typed value."""
    rows = entries.select("line_no", F.explode("fields").alias("key", "value"))
    return rows.select("line_no", "key", tx.typed_value(F.col("value")).alias("v")).select("line_no", "key", "v.*")


def latest_entry(entries: DataFrame, by: str | None = None) -> DataFrame:
    """The entry of the last line, of each ``by`` if given."""
    grouped = entries.groupBy(by) if by else entries.groupBy()
    return grouped.agg(F.max_by(F.struct(*entries.columns), _place(entries)).alias("e")).select("e.*")


def summarise(bench: DataFrame) -> DataFrame:
    """Latency of each run and image (by base name): mean, exact median, least, most, samples.

    Samples are counted by value first, and the median is found in running sums of the
    counts, so no task holds the samples of an image. Null samples count for nothing.
    """
    base = F.regexp_extract("image", r"([^/\\]+)$", 1)
    samples = bench.select("run", base.alias("image"), "detection_count", F.explode("elapsed_ms").alias("ms"))
    counts = samples.groupBy("run", "image", "ms").agg(F.max("detection_count").alias("detection_count"), F.count("*").alias("rows"), F.count("ms").alias("n"))
    known = F.sum(F.col("ms") * F.col("n")) / F.sum("n")
    return counted_up(counts, ["run", "image"], "ms", "n").groupBy("run", "image").agg(
        F.max("detection_count").alias("detection_count"), known.alias("mean_ms"), median_of("ms").alias("median_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum("rows").alias("samples"))


def guard(base: DataFrame, current: DataFrame, ratio: float = 1.15) -> DataFrame:
    """image, verdict, base and current median: gone, new, another count (latency is then not looked at), slower than ``ratio``, or ok."""
    b = base.select("image", F.col("detection_count").alias("b_count"), F.col("median_ms").alias("base_ms"))
    c = current.select("image", F.col("detection_count").alias("c_count"), F.col("median_ms").alias("current_ms"))
    verdict = (
        F.when(F.col("c_count").isNull(), "missing").when(F.col("b_count").isNull(), "unexpected")
        .when(F.col("b_count") != F.col("c_count"), "count changed").when(F.col("current_ms") > F.col("base_ms") * ratio, "slower").otherwise("ok"))
    return b.join(c, "image", "full_outer").select("image", verdict.alias("verdict"), "base_ms", "current_ms")


def compare_runs(one: DataFrame, other: DataFrame) -> DataFrame:
    """Deltas and flags for images in both summaries."""
    b = other.select("image", F.col("mean_ms").alias("o_mean"), F.col("median_ms").alias("o_median"), F.col("detection_count").alias("o_count"))
    j = one.join(b, "image")
    return j.select(
        "image", (F.col("o_mean") - F.col("mean_ms")).alias("mean_delta"), (F.col("o_median") - F.col("median_ms")).alias("median_delta"),
        (F.col("o_mean") <= F.col("mean_ms")).alias("mean_not_slower"), (F.col("o_median") <= F.col("median_ms")).alias("median_not_slower"),
        (F.col("o_count") == F.col("detection_count")).alias("same_count"))


def stage_totals(stages: DataFrame) -> DataFrame:
    """image, ms per stage, total and the share of recognition; ``stages``: image, stage, ms. Stages without rows count as 0."""
    names = ("load", "det", "crop", "cls", "rotate", "rec", "post")
    sums = stages.groupBy("image").agg(*[F.sum(F.when(F.col("stage") == s, F.col("ms")).otherwise(0.0)).alias(f"{s}_ms") for s in names], F.sum("ms").alias("total_ms"))
    return sums.withColumn("rec_share", F.when(F.col("total_ms") > 0, F.col("rec_ms") / F.col("total_ms")).otherwise(0.0))
