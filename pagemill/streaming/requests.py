"""Request lines split into two tables by a stream, so that readers see whole batches of both or nothing of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import parsed_requests

MANIFEST = "batch long, attempt string"


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and errors of parsed request lines."""
    return parsed.filter(F.col("error").isNull()).drop("error"), parsed.filter(F.col("error").isNotNull()).select("id", "error")


def split_requests(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and errors of request lines."""
    return split_parsed(parsed_requests(lines))


def _write(rows: DataFrame, path: str, batch_id: int, attempt: str) -> None:
    rows.write.parquet(f"{path}/batch={batch_id}/attempt={attempt}")


def committed(spark: SparkSession, manifest: str) -> DataFrame:
    """batch, attempt: what readers may see. The row of a batch is written after both its tables."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(manifest)


def start_request_stream(lines: DataFrame, results_path: str, errors_path: str, checkpoint: str, manifest: str | None = None) -> StreamingQuery:
    """Write requests and errors of a stream of lines to two tables, in one pass over the lines.

    Every attempt at a batch writes to folders of its own, and the last thing it writes is its line in ``manifest``
    (by default a folder beside the results), which ``read_requests`` follows. An attempt that dies before
    that leaves files that nobody reads; a batch that is run again although its line is there does nothing.
    """
    spark, manifest = lines.sparkSession, manifest or manifest_of(results_path)
    spark.createDataFrame([], MANIFEST).write.mode("overwrite").json(f"{manifest}/begun")

    def sink(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        if not committed(own, manifest).filter(F.col("batch") == batch_id).isEmpty():
            return
        attempt = f"try-{uuid.uuid4().hex}"
        parsed = parsed_requests(batch).persist()
        try:
            good, bad = split_parsed(parsed)
            _write(good, results_path, batch_id, attempt)
            _write(bad, errors_path, batch_id, attempt)
        finally:
            parsed.unpersist()
        own.createDataFrame([(batch_id, attempt)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{manifest}/{batch_id}")

    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest_of(results_path: str) -> str:
    return f"{results_path.rstrip('/')}-batches"


def read_requests(spark: SparkSession, results_path: str, errors_path: str, manifest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables as of one moment: the attempts that the manifest names, up to the batch that is its last as this is called."""
    manifest = manifest or manifest_of(results_path)
    last = committed(spark, manifest).agg(F.max("batch")).first()[0]
    seen = committed(spark, manifest).filter(F.col("batch") <= F.lit(-1 if last is None else last))

    def table(path: str, schema: str) -> DataFrame:
        if last is None:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(f"{schema}, batch long, attempt string").option("basePath", path).parquet(path)
        return rows.join(seen, ["batch", "attempt"], "left_semi").drop("batch", "attempt")

    return table(results_path, "id int, source string, image_path string, score_thresh double"), table(errors_path, "id int, error string")
