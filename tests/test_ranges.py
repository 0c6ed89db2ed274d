"""Orders over whole groups in ranges: medians and nearest neighbours against plain models."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagemill.operators import logs
from pagemill.operators.ranges import counted_up, median_of, neighbours


@pytest.mark.parametrize("seed", range(2))
def test_neighbours_of_a_key_that_fills_many_ranges(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 20 + ["a", "b", None]
    known = {(rng.choice(keys), rng.randrange(-500, 500)) for _ in range(300)} | {("only known", 3)}
    asked = {(rng.choice(keys), rng.randrange(-700, 700)) for _ in range(300)} | {("only asked", 3)}
    table = lambda rows: spark.createDataFrame(sorted(rows, key=repr), "k string, at int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = neighbours(table(asked), table(known | {("hot", None)}), ["k"], "at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, at in asked:
        own = [x for of, x in known if of == k]
        want[k, at] = max((x for x in own if x <= at), default=None), min((x for x in own if x >= at), default=None)
    assert {(r.k, r["at"]): (r.low, r.high) for r in found} == want
    assert len(found) == len(want)


@pytest.mark.parametrize("seed", range(2))
def test_medians_of_a_key_that_fills_many_ranges(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice([rng.random() * 100, float(rng.randrange(3)), -5.5])) for _ in range(900)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("nulls", None), ("b", None)]
    counts = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("v").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summed = counted_up(counts, ["k"], "v", "n")
        assert summed.filter("upto > total").count() == 0
        found = {r.k: r.m for r in summed.groupBy("k").agg(median_of("v").alias("m")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {k: [v for of, v in rows if of == k and v is not None] for k in {k for k, _ in rows}}
    assert found.keys() == want.keys()
    for k, values in want.items():
        assert found[k] == (pytest.approx(statistics.median(values)) if values else None)


def test_summaries_of_empty_and_null_samples(spark):
    bench = spark.createDataFrame(
        [(0, "a/x.png", 2, [3.0, 1.0, None]), (0, "b\\x.png", 4, [2.0, 2.0]), (1, "x.png", 1, []), (1, None, 7, [5.0]), (2, "y", 3, [None])],
        "run int, image string, detection_count int, elapsed_ms array<double>")
    found = sorted(tuple(r) for r in logs.summarise(bench).collect() if r.run < 2)
    assert found == [(0, "x.png", 4, 2.0, 2.0, 1.0, 3.0, 5), (1, None, 7, 5.0, 5.0, 5.0, 5.0, 1)]
    assert [tuple(r)[3:] for r in logs.summarise(bench).filter("run = 2").collect()] == [(None, None, None, None, 1)]
    assert logs.summarise(bench.limit(0)).count() == 0
