"""Images with many boxes: the same rows as plain models on random images, and an end within a time limit on crowded ones."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import blocks, boxes, matching, parity

DETECTION = "image long, idx int, x double, y double, w double, h double, text string"
PAIR = "image long, iou double, l int, r int, l_text string, r_text string"


def greedy(pairs):
    """Matches in order of choice, by the rule."""
    left, right, out = set(), set(), []
    for iou, l, r in sorted(((p[1], p[2], p[3]) for p in pairs), reverse=True):
        if l not in left and r not in right:
            left.add(l)
            right.add(r)
            out.append((len(out), iou, l, r))
    return out


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_matches_of_random_pairs(spark, rounds):
    rng = random.Random(rounds)
    rows = list({(i, l, r): (i, rng.randrange(4) / 4 + 0.1, l, r, f"a{l}", f"b{r}") for i in range(25) for l, r in ((rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(1, 40)))}.values())
    got = matching.greedy_match(spark.createDataFrame(rows, PAIR), rounds).collect()
    want = {(i, *m) for i in range(25) for m in greedy([r for r in rows if r[0] == i])}
    assert {(r.image, r["rank"], r.iou, r.l, r.r) for r in got} == want and len(got) == len(want)
    assert all((r.l_text, r.r_text) == (f"a{r.l}", f"b{r.r}") for r in got)


def test_a_chain_of_pairs_ends(spark):
    """Every pair waits for the next: rounds alone would take one for each."""
    n = 4000
    rows = [(1, 0.5, l, r, "", "") for l in range(n) for r in (l - 1, l) if r >= 0]
    got = {(r.l, r.r) for r in matching.greedy_match(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {(l, r) for _, _, l, r in greedy(rows)}


def test_matching_an_image_of_20000_boxes(spark):
    grid = spark.range(20_000).select(
        F.lit(1).cast("long").alias("image"), F.col("id").cast("int").alias("idx"), (F.col("id") % 40 * 50).cast("double").alias("x"), F.floor(F.col("id") / 40).cast("double").alias("row"),
        F.lit(45.0).alias("w"), F.lit(16.0).alias("h"), F.lit("t").alias("text"))
    a = grid.withColumn("y", F.col("row") * 20)
    b = a.withColumn("x", F.col("x") + 3)
    began = time.time()
    matched = parity.greedy_match(parity.iou_pairs(a, b, 0.5))
    assert matched.filter("l = r").count() == matched.count() == 20_000
    assert time.time() - began < 120


def test_iou_pairs_meet_in_strips(spark):
    """Strips change nothing: neither for boxes taller than one nor for boxes on an edge, nor where none is asked for."""
    rng = random.Random(7)
    rows = [(i, k, float(rng.randrange(60)), float(rng.randrange(-40, 200)), float(rng.randrange(1, 40)), float(rng.choice([0, 1, 16, 64, 150])), "t") for i in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, DETECTION)
    plain = {tuple(r) for r in parity.iou_pairs(df, df, 0.2, cell=None).collect()}
    assert plain
    for cell in (5.0, 64.0, 1000.0):
        got = parity.iou_pairs(df, df, 0.2, cell=cell).collect()
        assert {tuple(r) for r in got} == plain and len(got) == len(plain)
    assert {tuple(r) for r in parity.iou_pairs(df, df, 0.2).collect()} == plain


def banded(rows):
    out = []
    for r in sorted(rows, key=lambda r: (round(r[3], 4), r[2], r[1])):
        at = len(out)
        while at and abs(r[3] - out[at - 1][3]) < 10 and r[2] < out[at - 1][2]:
            at -= 1
        out.insert(at, r)
    return [(k + 1, r[1]) for k, r in enumerate(out)]


def test_banded_order_of_random_images(spark):
    rng = random.Random(3)
    ys = [0, 3, 9, 9.9999, 10, 10.0001, 12, 19, 20, 29.5, 31, 50, 60.00004]
    rows = [(i, k, float(rng.randrange(30)), float(rng.choice(ys) + rng.choice([0, 0, 100])), 5.0, 5.0, "t") for i in range(40) for k in range(rng.randrange(1, 25))]
    got = boxes.banded_order(spark.createDataFrame(rows, DETECTION)).collect()
    for i in range(40):
        assert sorted((r.pos, r.idx) for r in got if r.image == i) == banded([r for r in rows if r[0] == i])


def test_banded_order_of_a_tall_image(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("image"), F.col("id").cast("int").alias("idx"), ((F.col("id") * 7919) % 40 * 20).cast("double").alias("x"),
        (F.floor(F.col("id") / 40) * 24 + F.col("id") % 3).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), F.lit("t").alias("text"))
    began = time.time()
    got = boxes.banded_order(rows).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, n + 1))
    assert [r.idx // 40 for r in got] == [k // 40 for k in range(n)]
    assert time.time() - began < 90


def overlap(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return max(w, 0) * max(h, 0) / max(min(a[2] * a[3], b[2] * b[3]), 1) if w > 0 and h > 0 else 0


def plain_blocks(rows, x_gap, y_gap):
    """Blocks of an image by the rules, searching all groups."""
    groups = []
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        b, text = r[2:6], r[6]
        fits = []
        for n, g in enumerate(groups):
            (gx, gy, gw, gh), (bx, by, bw, bh) = g["box"], b
            reach = max(x_gap, min(gh, bh) * 1.2)
            near = bx <= gx + gw + reach and bx + bw >= gx - reach
            lines = by < gy + gh and by + bh > gy or gy + gh <= by <= gy + gh + y_gap
            centre, gap = abs(gy + gh / 2 - (by + bh / 2)), max(max(gx, bx) - min(gx + gw, bx + bw), 0)
            if near and lines or centre <= max(gh, bh) * 0.6 and gap <= reach:
                fits.append((centre * 10000 + gap, n))
        if any(overlap(m[2:6], b) >= 0.9 and (text in m[6] or m[6] in text) for _, n in fits for m in groups[n]["members"]):
            continue
        if fits:
            g = groups[min(fits)[1]]
            (gx, gy, gw, gh), (bx, by, bw, bh) = g["box"], b
            x, y = min(gx, bx), min(gy, by)
            g["box"] = (x, y, max(gx + gw, bx + bw) - x, max(gy + gh, by + bh) - y)
            g["members"].append(r)
        else:
            groups.append({"box": b, "members": [r]})
    told = []
    for n, g in enumerate(groups):
        text = g["members"][0][6]
        for m in g["members"][1:]:
            text = text if text == m[6] else f"{text} {m[6]}"
        told.append((-(g["box"][2] * g["box"][3]), n, g, text))
    kept = []
    for k, (_, _, g, text) in enumerate(sorted(told, key=lambda t: t[:2])):
        if not any(overlap(o["box"], g["box"]) >= 0.9 and (text in t or t in text) for _, o, t in kept):
            kept.append((k, g, text))
    return [(*g["box"], len(g["members"])) for _, g, _ in sorted(kept, key=lambda t: (t[1]["box"][1], t[1]["box"][0], t[0]))]


def test_blocks_of_random_images(spark):
    """Boxes of very different heights, on one another and far apart."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        for k in range(rng.randrange(1, 40)):
            h = rng.choice([0, 4, 16, 16, 20, 90, 400]) if i % 2 else rng.choice([14, 16])
            rows.append((i, k, float(rng.randrange(200)), float(rng.randrange(120 if i % 3 else 1500)), float(rng.choice([5, 20, 40, 150])), float(h), rng.choice(["a", "ab", "abc", "b", "c"])))
    got = blocks.text_blocks(spark.createDataFrame(rows, DETECTION), x_gap=10, y_gap=8, with_members=True).orderBy("image", "block").collect()
    for i in range(120):
        assert [(r.x, r.y, r.w, r.h, len(r.members)) for r in got if r.image == i] == plain_blocks([r for r in rows if r[0] == i], 10, 8), i


@pytest.mark.parametrize("gap", [60.0, 20.0])
def test_blocks_of_a_tall_image(spark, gap):
    """20,000 boxes: far apart, so that every row has groups of its own, or all of a column in one group."""
    rows = spark.range(20_000).select(
        F.lit(1).cast("long").alias("image"), F.col("id").cast("int").alias("idx"), (F.col("id") % 10 * 200).cast("double").alias("x"), (F.floor(F.col("id") / 10) * gap).cast("double").alias("y"),
        F.lit(100.0).alias("w"), F.lit(16.0).alias("h"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    began = time.time()
    found = blocks.text_blocks(rows, with_members=True).collect()
    assert len(found) == (20_000 if gap == 60 else 10)
    assert sum(len(r.members) for r in found) == 20_000
    assert time.time() - began < 150


@pytest.mark.parametrize("rounds, crowd", [(0, 0), (1, 0), (6, 0), (2, 12)])
def test_matches_of_crowded_images_among_others(spark, rounds, crowd):
    rng = random.Random(rounds + 10)
    rows = list({(i, l, r): (i, rng.randrange(4) / 4 + 0.1, l, r, f"a{l}", f"b{r}") for i in [*range(25), None] for l, r in ((rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(1, 40)))}.values())
    got = matching.greedy_match(spark.createDataFrame(rows, PAIR), rounds, crowd).collect()
    want = {(i, *m) for i in [*range(25), None] for m in greedy([r for r in rows if r[0] == i])}
    assert {(r.image, r["rank"], r.iou, r.l, r.r) for r in got} == want and len(got) == len(want)


def test_images_of_few_pairs_take_one_pass(spark, monkeypatch):
    """Two tables are stored, the pairs and the crowded images, where every round would store one more."""
    kept, stored = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df: kept.append(df) or stored(df))
    chain = [(i, 0.5, l, r, "", "") for i in range(5) for l in range(20) for r in (l - 1, l) if r >= 0]
    assert matching.greedy_match(spark.createDataFrame(chain, PAIR)).count() == 100
    assert len(kept) == 2


def test_boxes_without_area_or_values_pair_with_nothing(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, "a"), (1, 2, 0.0, 0.0, 0.0, 10.0, "b"), (1, 3, 2.0, 2.0, -1.0, -1.0, "c"), (1, 4, None, 0.0, 10.0, 10.0, "d"), (1, 5, 0.0, None, 10.0, 10.0, "e")]
    df = spark.createDataFrame(rows, DETECTION)
    for cell in (None, 64.0):
        assert [(r.l, r.r, r.iou) for r in parity.iou_pairs(df, df, 0.5, cell).collect()] == [(1, 1, 1.0)]
