"""Orders over whole groups without gathering a group: rows lie in ranges of (keys, value), and each range is told what lies beyond its edges.

A group may span many ranges. What crosses an edge is one row for each range and group,
so nothing grows with a group but the number of its ranges. These rows join the others as
rows before or after them in order, which keeps null keys like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def _in_ranges(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``rows``, stored, with ``_range``: rows alike in keys and ``at`` are in one range."""
    return stored(rows.repartitionByRange(*keys, at).withColumn("_range", F.spark_partition_id()))


def _earlier(value: Column, keys: list[str]) -> Column:
    return value.over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))


def _later(value: Column, keys: list[str]) -> Column:
    return value.over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(1, Window.unboundedFollowing))


def neighbours(asked: DataFrame, known: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of ``asked`` (keys, ``at``; distinct) with ``low`` and ``high``: the nearest ``at`` of ``known`` (keys, ``at``) of the same keys, at or to either side of their own.

    Null where there is none on that side. A null ``at`` is asked or known in vain.
    The rows are read from a table that ``tables.dropped`` deletes when given the result.
    """
    both = known.select(*keys, at).distinct().withColumn("_known", F.col(at)).unionByName(asked.select(*keys, at).withColumn("_known", F.lit(None).cast(asked.schema[at].dataType)))
    placed = _in_ranges(both.filter(F.col(at).isNotNull()), keys, at)
    edges = placed.groupBy("_range", *keys).agg(F.min("_known").alias("least"), F.max("_known").alias("most"))
    beyond = edges.select(*keys, "_range", _earlier(F.max("most"), keys).alias("below"), _later(F.min("least"), keys).alias("above"))
    row = lambda df, side, value: df.select(*keys, "_range", F.lit(side).alias("_side"), F.lit(None).cast(asked.schema[at].dataType).alias(at), F.col(value).alias("_known"))
    rows = placed.select(*keys, "_range", F.lit(0).alias("_side"), at, "_known")
    rows = rows.unionByName(row(beyond.filter("below is not null"), -1, "below")).unionByName(row(beyond.filter("above is not null"), 1, "above"))
    line = Window.partitionBy("_range", *keys).orderBy("_side", at)
    low = F.last("_known", ignorenulls=True).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first("_known", ignorenulls=True).over(line.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    out = rows.select(*keys, "_side", at, "_known", low.alias("low"), high.alias("high")).filter("_side = 0 and _known is null").select(*keys, at, "low", "high")
    out._stored_in = placed._stored_in
    return out


def counted_up(counts: DataFrame, keys: list[str], at: str, n: str) -> DataFrame:
    """``counts`` (one row for each keys and ``at``, null last) with ``upto``, the sum of ``n`` up to and with this row in order of ``at``, and ``total``, that of all rows of the keys."""
    placed = _in_ranges(counts, keys, at)
    sums = placed.groupBy("_range", *keys).agg(F.sum(n).alias("held"))
    total = F.sum("held").over(Window.partitionBy(*keys))
    edges = sums.select(*keys, "_range", F.coalesce(_earlier(F.sum("held"), keys), F.lit(0)).alias("before"), total.alias("of_all"))
    rows = placed.withColumns({"_side": F.lit(0), "_step": F.col(n), "_all": F.lit(None).cast("long")})
    first = edges.select(*keys, "_range", F.lit(-1).alias("_side"), F.col("before").alias("_step"), F.col("of_all").alias("_all"))
    line = Window.partitionBy("_range", *keys).orderBy("_side", F.asc_nulls_last(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(first, allowMissingColumns=True)
    summed = both.select("_side", *counts.columns, F.sum("_step").over(line).alias("upto"), F.max("_all").over(line).alias("total"))
    return summed.filter("_side = 0").drop("_side")


def median_of(at: str) -> Column:
    """The exact median, as an aggregate over rows of ``counted_up``: the mean of the two values in the middle, or the one."""
    reached = lambda place: F.min(F.when(F.col("upto") > F.floor(place), F.col(at)))
    return (reached((F.col("total") - 1) / 2) * 0.5 + reached(F.col("total") / 2) * 0.5).cast("double")
