"""What several operators of this subpackage need."""

from __future__ import annotations

import gc
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, as Java and Python patterns read it.
SPACE = "[\\x20\\x09-\\x0D]"
#: The same six characters, written out.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of those who clean up behind a job (see ``cleared``), innermost last; each thread has its own.
_cleaners: ContextVar[tuple[list[str], ...]] = ContextVar("_cleaners", default=())


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, and driver and executors are one process, below a folder of this session's own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/pagemill-{uuid.uuid4().hex}"
    if own := _cleaners.get():
        own[-1].append(folder)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, every folder that was made within: for jobs whose result has been written elsewhere by then."""
    made: list[str] = []
    before = _cleaners.set((*_cleaners.get(), made))
    try:
        yield
    finally:
        _cleaners.reset(before)
        for folder in made:
            delete(spark, folder)


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts the lineage, and any executor can read it.

    ``instead_of`` is a table of this kind that nothing needs any more once ``df`` is written.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(f"{folder}/{name}")
    discard(instead_of)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out._written_to = folder
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        if folder := getattr(t, "_written_to", None):
            delete(t.sparkSession, folder)


def collected(spark: SparkSession) -> None:
    """Let the shuffle files of jobs that are over go: Spark deletes them once the driver collects its garbage, and they stay until its memory happens to fill."""
    for pause in (0.3, 0):  # the first leaves what the latest job still holds
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs``, written, with ``_row``: a number of each row's own, for what ids cannot tell apart."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def rows_kept(rows: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """Those of ``rows`` whose ``_row`` is in ``kept``."""
    return rows.join(kept.select("_row").hint("merge"), "_row", "left_semi").select(*columns)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` inside tasks, classes included, where the library is not installed."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches. Columns that are passed on as they are keep their type, nulls included."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def salted_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: list[str], support: float = 0.001) -> DataFrame:
    """The inner join of ``left`` with ``right``, a table of ``written`` with one row a key, on ``key``.

    ``weight`` is how many rows of ``left`` have the key. Keys of more than ``support`` of all
    rows, at most 1 / ``support`` of them, are broadcast with the number of parts that they are
    dealt to by a hash of ``spread``, and their rows of ``right`` are copied for each part, so no
    task gets more than about ``support`` of the rows for one key. Keys must not be null.
    """
    most = max(1.0, support * (right.agg(F.sum(weight)).first()[0] or 0))
    in_parts = F.ceil(F.col(weight) / most).cast("int")
    hot = right.filter(F.col(weight) > most).select(F.col(key).alias("_hot"), in_parts.alias("_parts"))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts").cast("long")).cast("int"), F.lit(0))).drop("_hot", "_parts")
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0), in_parts - 1)))
    return dealt.join(copied.hint("merge"), [key, "_part"]).drop("_part")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: a gapless number from 0 within ``keys``.

    Rows of a key are first split into hashed parts, each part is numbered on its own and
    shifted by the sizes of the parts before it, so a key with a third of all rows is
    never gathered in one task. The numbers are stable for equal input.
    """
    n_parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    parts = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n_parts)).cast("int"))
    sizes = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = parts.withColumn("_rank", F.row_number().over(within) - 1)
    by = [*keys, "_part"]
    renamed = shifts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_shift")
    out = ranked.join(renamed, _all([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]))
    return out.select(*df.columns, (F.col("_rank") + F.col("_shift")).cast("long").alias(name))


#: Numbers of ``in_order`` hold the partition above this many bits.
PART_BITS = 33


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written, with ``at``: numbers that grow in the order given, gapless within a partition of it.

    Rows are dealt to tasks by ranges of the whole order, so a key with a third of all
    rows is spread as well, if what follows it in the order tells its rows apart.
    """
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal columns in which null equals null; ``right`` gives its other columns."""
    renamed = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    joined = left.join(renamed, _all([F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]), how)
    return joined.drop(*[f"_on{i}" for i in range(len(on))])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out & x
    return out
