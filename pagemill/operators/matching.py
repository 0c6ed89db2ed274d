"""One-to-one matching of overlapping boxes, best pair first, without gathering an image."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import stored

#: The order of choice: best IoU first, and of equal ones the highest left, then right index.
ORDER = ("iou", "l", "r")


#: An image of more pairs than this is crowded.
CROWD = 20_000


def _first_come(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in the order of choice, image by image: keeps those whose boxes are both free. Only an image's taken boxes are held."""
    image, left, right = None, set(), set()
    for batch in batches:
        free = []
        for i, l, r in zip(*[batch.column(c).to_pylist() for c in ("image", "l", "r")], strict=True):
            if i != image:
                image, left, right = i, set(), set()
            free.append(l not in left and r not in right)
            if free[-1]:
                left.add(l)
                right.add(r)
        yield batch.filter(pa.array(free, pa.bool_()))


def _in_one_pass(pairs: DataFrame) -> DataFrame:
    """The matches of pairs by one scan in the order of choice."""
    ordered = pairs.repartition("image").sortWithinPartitions("image", *[F.desc(c) for c in ORDER])
    return ordered.mapInArrow(_first_come, pairs.schema)


def _round(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``mutual``, whether a pair is the best of both its boxes, and ``taken``, whether one of its boxes is in such a pair."""
    by_left, by_right = Window.partitionBy("image", "l"), Window.partitionBy("image", "r")
    own = F.struct(*ORDER)
    best = pairs.withColumn("_best", F.max(own).over(by_left) == own)
    best = best.withColumn("mutual", F.col("_best") & (F.max(own).over(by_right) == own)).drop("_best")
    # a box taken on the right is known where right boxes are together; the other side takes one more exchange
    best = best.withColumn("taken", F.max("mutual").over(by_right))
    return best.withColumn("taken", F.col("taken") | F.max("mutual").over(by_left))


def _in_rounds(pairs: DataFrame, rounds: int) -> DataFrame:
    """The matches of pairs by rounds of mutually best ones, and one scan of what is left after them."""
    rest, chosen = pairs, None

    def also(found: DataFrame) -> DataFrame:
        return found if chosen is None else chosen.unionByName(found)

    for _ in range(rounds):
        judged = stored(_round(rest))
        chosen = also(judged.filter("mutual").select(*pairs.columns))
        rest = judged.filter("not taken").select(*pairs.columns)
        if rest.isEmpty():
            return chosen
    return also(_in_one_pass(rest))


def greedy_match(pairs: DataFrame, rounds: int = 6, crowd: int = CROWD) -> DataFrame:
    """image, rank, iou, l, r, l_text, r_text: one-to-one pairs, best IoU first, and of equal ones the highest left, then right index; ``rank`` is the order of choice.

    Images of up to ``crowd`` pairs are scanned in the order of choice, all in one pass. In larger ones a
    pair that is the best of both its boxes is chosen whatever happens elsewhere, so each round takes all of these at
    once and strikes out the pairs of their boxes; what windows gather are the pairs of one box. Chains of
    pairs that each wait for the next would take a round a link: after ``rounds`` rounds what is left, of any
    number, is scanned once in the order of choice, which gives the same pairs.
    """
    pairs = stored(pairs.select("image", "iou", "l", "r", "l_text", "r_text"))
    crowded = stored(pairs.groupBy("image").count().filter(F.col("count") > crowd).select("image"))
    if crowded.isEmpty():
        chosen = _in_one_pass(pairs)
    else:
        named = crowded.withColumnRenamed("image", "_image")
        same = F.col("image").eqNullSafe(F.col("_image"))
        chosen = _in_one_pass(pairs.join(named, same, "left_anti")).unionByName(_in_rounds(pairs.join(named, same, "left_semi"), rounds))
    order = Window.partitionBy("image").orderBy(*[F.desc(c) for c in ORDER])
    rank: Column = (F.row_number().over(order) - 1).alias("rank")
    return chosen.select("image", rank, "iou", "l", "r", "l_text", "r_text")


def matches_of_few(pairs: DataFrame) -> DataFrame:
    """The rows of ``greedy_match`` for images of few pairs: those of an image are one array, and what a fold over it carries are the taken boxes and the matches."""
    schema = pairs.schema
    kind = f"struct<iou:{schema['iou'].dataType.simpleString()},l:{schema['l'].dataType.simpleString()},r:{schema['r'].dataType.simpleString()},l_text:string,r_text:string>"
    best_first = F.sort_array(F.collect_list(F.struct("iou", "l", "r", "l_text", "r_text")), asc=False)
    none = F.array().cast(f"array<{kind}>")
    taken = lambda found, p: F.exists(found, lambda m: m["l"].eqNullSafe(p["l"]) | m["r"].eqNullSafe(p["r"]))
    chosen = F.aggregate(F.col("pairs").cast(f"array<{kind}>"), none, lambda found, p: F.when(taken(found, p), found).otherwise(F.array_append(found, p)))
    listed = pairs.groupBy("image").agg(best_first.alias("pairs")).select("image", F.posexplode(chosen).alias("rank", "m"))
    return listed.select("image", "rank", "m.*")
