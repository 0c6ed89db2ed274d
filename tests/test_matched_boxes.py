"""Matching of two runs where images of few boxes take one exchange: the rows of the pairs in strips, matched by rounds."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import WHITE, trimmed
from pagemill.operators import parity

DETECTION = "image long, idx int, x double, y double, w double, h double, text string"


@pytest.mark.parametrize("few", [0, 12, 128])
def test_matches_are_those_of_pairs_in_strips(spark, few):
    rng = random.Random(few)

    def run(name):
        return spark.createDataFrame(
            [(i, rng.choice([k, k, None]), float(rng.randrange(20)), rng.choice([0.0, 3.0, 60.0, None]), float(rng.randrange(1, 30)), float(rng.choice([0, 8, 16, 70])), rng.choice([None, f"{name}{k}"]))
             for i in [*range(40), None] for k in range(rng.randrange(24))], DETECTION)

    a, b = run("a").cache(), run("b").cache()
    want = sorted(map(repr, parity.greedy_match(parity.iou_pairs(a, b, 0.3)).drop("l_text", "r_text").collect()))
    got = sorted(map(repr, parity.matched_boxes(a, b, 0.3, few).drop("l_text", "r_text").collect()))
    assert len(want) > 20 and got == want


def test_images_of_few_boxes_store_no_pairs(spark, monkeypatch):
    kept, stored = [], parity.stored
    monkeypatch.setattr(parity, "stored", lambda df: kept.append(df.columns) or stored(df))
    rows = [(i, k, k * 10.0, 0.0, 9.0, 9.0, "t") for i in range(3) for k in range(5)]
    df = spark.createDataFrame(rows, DETECTION)
    plan = parity.matched_boxes(df, df)._jdf.queryExecution().executedPlan().toString()
    assert kept == [["image"]] and plan.count("Exchange hashpartitioning") <= 2


def test_trimmed_takes_all_white_space(spark):
    every = [c for c in map(chr, range(0x3100)) if c not in "ab"]
    rows = [(f"{c}{d}a{c}b{d}{c}",) for c in every for d in (" ", "\n", "")] + [(WHITE,), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(~trimmed(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
