"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams that occur in it (presence, not counts), lower
case, over code points. Ratios are counted over all labelled texts, in tasks, then added
up per bucket. A bucket in fewer than ``least_documents`` texts, or with a log ratio of
less than ``least_ratio`` either way, has no say: its ratio counts as 0. The linear
weights are fitted to about ``fit_rows`` of the labelled texts, drawn by a hash, or to
as many of the first of them as have ``fit_features`` features in all, which bounds what
the driver holds. Whether a text is drawn does not depend on its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, parts, remainder, shipped, written

BITS = 20
LENGTHS = (3, 4, 5)
_MULTIPLIER = np.uint32(2654435761)


def gram_buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of the padded lower-case text, repeats included."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, h = [], codes
    for n in range(2, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULTIPLIER + codes[n - 1 :]
        if n in LENGTHS:
            found.append(((h + np.uint32(n)) * _MULTIPLIER) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def _presence_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, seen = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(1 << BITS, dtype=bool)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            seen[gram_buckets(text)] = True
            at = np.flatnonzero(seen)
            counts[toxic, at] += 1
            seen[at] = False
    at = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": at.astype(np.int64), "clean": counts[0, at], "toxic": counts[1, at]})


@dataclass
class ToxicityModel:
    #: Weight times ratio of each bucket; 0 where the ratio is too small to tell.
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = gram_buckets(text)
        at = np.unique(at[self.weights[at] != 0])
        z = self.bias + float(self.weights[at].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _fit(rows: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence by full-batch Adam, both classes weighing the same."""
    used = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
    column = np.searchsorted(used, np.concatenate(rows)) if rows else used
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    value = ratios[used][column]
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    w, b = np.full(len(used), 0.05), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[column], minlength=len(rows)) + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        g = np.append(np.bincount(column, value * error[row], minlength=len(used)) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    out = np.zeros(len(ratios), dtype=np.float32)
    out[used] = w * ratios[used]
    return out, float(b)


def train_toxicity(
    labelled: DataFrame, fit_rows: int = 6000, least_documents: int = 3, least_ratio: float = 1.0, rounds: int = 150, decay: float = 1e-4, fit_features: int = 16_000_000
) -> ToxicityModel:
    """Fit to ``labelled`` (doc_id, text, toxic 0 or 1; other labels and nulls are left out).

    Ratios come from every row. The weights are fitted to a sample of about ``fit_rows``
    rows, half of each class, chosen by a hash of id and text; texts are taken in that order
    until the first that would bring its class over half of ``fit_features``. The sample
    does not grow with the input. Without rows of both classes every score is the share of toxic rows (0.5 without rows).
    """
    spark = labelled.sparkSession
    known = labelled.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    known = written(known, "labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        share = toxic / (clean + toxic) if clean + toxic else 0.5
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))
    counts = (
        known.mapInPandas(_presence_counts, "bucket long, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("clean") + F.col("toxic") >= least_documents)
        .select(F.col("bucket").cast("int"), F.col("clean").cast("int"), F.col("toxic").cast("int"))
        .toPandas()  # at most 2^BITS rows, whatever the input
    )
    p, q = counts["toxic"] + 1.0, counts["clean"] + 1.0
    r = np.log((p / p.sum()) / (q / q.sum()))
    ratios = np.zeros(1 << BITS)
    ratios[counts["bucket"]] = np.where(np.abs(r) >= least_ratio, r, 0.0)
    telling = shipped(spark, ratios != 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = telling()
        for batch in parts(batches):
            at = [gram_buckets(t) for t in batch.column("text").to_pylist()]
            found = [np.unique(x[used[x]]).astype(np.int32) for x in at]
            columns = [batch.column("toxic"), batch.column("draw"), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "draw", "n", "at"])

    draw = F.xxhash64("doc_id", "text", F.lit(7))
    share = F.when(F.col("toxic") == 1, min(1.0, fit_rows / 2 / toxic)).otherwise(min(1.0, fit_rows / 2 / clean))
    drawn = known.withColumn("draw", draw).filter(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < share)
    drawn = written(drawn.mapInArrow(features, "toxic int, draw long, n long, at array<int>"), "drawn")
    order = drawn.select("toxic", "draw", "n").toPandas().sort_values(["toxic", "draw"]).drop_duplicates(["toxic", "draw"])
    fits = order.groupby("toxic")["n"].cumsum() <= fit_features // 2
    taken = [(int(r.toxic), int(r.draw)) for r in order[fits].itertuples()]
    chosen = spark.createDataFrame(taken, "toxic int, draw long")
    sample = drawn.join(F.broadcast(chosen), ["toxic", "draw"]).select("toxic", "draw", "at").dropDuplicates(["toxic", "draw"]).toPandas().sort_values(["toxic", "draw"])
    discard(known, drawn)
    weights, bias = _fit([np.asarray(x, dtype=np.int64) for x in sample["at"]], sample["toxic"].to_numpy(), ratios, rounds, decay)
    return ToxicityModel(weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of each whole text, empty texts (and null) too: their score is the bias alone."""
    fitted = shipped(docs.sparkSession, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = fitted().score
        for batch in parts(batches):
            found = pa.array([score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")


def labelled_for_training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that may be learned from; a document labelled twice is toxic if either says so.

    Labels of a null id, or without a value of 0 or 1, teach nothing.
    """
    allowed = remainder(F.col("doc_id"), 3) != 1
    marks = labels.filter(allowed & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the same join at every size: labels grow with the texts, so they are never broadcast
    return docs.filter(allowed).select("doc_id", "text").join(marks.hint("merge"), "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, least_score: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``: repeated rows alike, rows with a null id by their text.

    Null and empty texts score what the model makes of no n-grams. An empty table gives an
    empty result; further columns are ignored.
    """
    model = train_toxicity(labelled_for_training(docs, labels))
    return score_toxicity(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= least_score).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, least_score: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``least_score``, with all their columns."""
    fitted = shipped(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = fitted().score
        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return docs.filter(score(F.col("text")) < least_score)
