"""Exact duplicates, with frequent texts split off.

Texts are equal when identical after all white space is deleted. A Misra-Gries
summary over the digests (``freqItems``, merged from one bounded summary per task)
names every digest that may hold more than ``support`` of the rows. Those few are
counted exactly, and their winners, at most ``1 / support`` rows, are broadcast, so
copies of a frequent text are settled where they were read. Only the other digests
are shuffled, and none of their groups exceeds ``support`` of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE_CHARS, rows_kept, with_rows, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then the smallest id (null last).
    Null text counts as empty, and empty texts form one group. Of rows repeated with the
    same id exactly one is kept. An empty table gives an empty result; other columns of
    the input are ignored, whatever their names.
    """
    return _judged(docs, F.monotonically_increasing_id(), id_col, text_col, support).drop("row")


def _judged(docs: DataFrame, row: Column, id_col: str, text_col: str, support: float) -> DataFrame:
    """The rows of ``exact_dedup`` and ``row``, a number of each row's own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(text).alias("points"),
            F.sha2(F.translate(text, SPACE_CHARS, ""), 256).alias("text_sha256"),
            row.alias("row"),
        ),
        "digests",
    )
    frequent = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    rank = F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("small"), F.bitwise_not("row").alias("first"))
    winners = written(
        digests.join(F.broadcast(frequent), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.max_by(F.struct("doc_id", "row"), rank).alias("best"))
        .select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")),
        "winners",
    )
    hot = digests.join(F.broadcast(winners), "text_sha256")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    # counted and compared before the shuffle, so what travels for a group is one row a task, and then its rows once
    best = rest.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max_by(F.struct("doc_id", "row"), rank).alias("best"))
    best = best.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    cold = rest.join(best.hint("merge"), "text_sha256")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row"
    )


def keep_first_copies(docs: DataFrame, support: float = 0.001) -> DataFrame:
    """The rows of ``docs`` whose text stays, with all their columns; ids may repeat or be null."""
    rows = with_rows(docs)
    judged = _judged(rows, F.col("_row"), "doc_id", "text", support)
    return rows_kept(rows, judged.filter("kept").select(F.col("row").alias("_row")), docs.columns)
