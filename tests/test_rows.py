"""Work that stays in its rows: zonal means by running sums, alphabets as bitmaps, logits decoded where they lie."""

import random

from pyspark.sql import functions as F

from pagemill.functions import geometry as geo
from pagemill.operators import alphabets, corpus, decoding, tensors, zonal

PIXEL, QUAD = "map_id long, px int, py int, p double", "map_id long, box int, quad array<struct<x:double,y:double>>"


def by_all_pairs(pixels, quads):
    """Every pixel against every quad of its map."""
    cx, cy = F.col("px") + 0.5, F.col("py") + 0.5
    bounds = quads.withColumn("b", geo.polygon_bounds(F.col("quad")))
    near = (cx >= F.col("b.x")) & (cx <= F.col("b.x") + F.col("b.w")) & (cy >= F.col("b.y")) & (cy <= F.col("b.y") + F.col("b.h"))
    inside = pixels.join(bounds, "map_id").filter(near & geo.point_in_quad(cx, cy, F.col("quad")))
    sums = inside.groupBy("map_id", "box").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.avg("p").alias("mean"))
    return quads.select("map_id", "box").join(sums, ["map_id", "box"], "left").fillna({"n": 0, "total": 0.0, "mean": 0.0})


def test_zonal_means_of_random_quads(spark):
    """Convex, crossed, turned, flat and one-point quads, with corners on centres and edges; rows with holes, repeated pixels and null values."""
    rng = random.Random(8)
    pixels = [(m, x, y, None if rng.random() < 0.05 else rng.random()) for m in range(6) for x in range(12) for y in range(9) if m % 2 == 0 or rng.random() < 0.6]
    pixels += rng.sample(pixels, 20)
    at = lambda: (rng.choice([rng.uniform(-3, 15), rng.randrange(-2, 14) + 0.5, float(rng.randrange(-2, 14))]), rng.choice([rng.uniform(-3, 12), rng.randrange(-2, 11) + 0.5, float(rng.randrange(-2, 11))]))
    quads = []
    for box in range(400):
        q = [at() for _ in range(4)]
        if box % 4 == 1:  # upright
            (x, y), (u, v) = q[:2]
            q = [(x, y), (u, y), (u, v), (x, v)]
        if box % 4 == 2:  # convex, either way round
            x, y, r, s = rng.uniform(2, 9), rng.uniform(2, 7), rng.uniform(0.1, 6), rng.choice([1, -1])
            q = [(x, y - r), (x + s * r, y), (x, y + r * 0.7), (x - s * r * 1.2, y)]
        if box % 40 == 3:
            q = [q[0]] * 4
        if box % 40 == 7:  # a line
            q = [q[0], q[1], q[1], q[0]]
        quads.append((rng.randrange(7), box, q))
    p, z = spark.createDataFrame(pixels, PIXEL), spark.createDataFrame(quads, QUAD)
    got = {(r.map_id, r.box): (r.n, round(r.total, 9), round(r["mean"], 9)) for r in zonal.zonal_mean(p, z).collect()}
    want = {(r.map_id, r.box): (r.n, round(r.total, 9), round(r["mean"], 9)) for r in by_all_pairs(p, z).collect()}
    assert got == want and sum(n for n, *_ in want.values()) > 1000


def test_zonal_lookups_follow_rows_and_quads(spark):
    """A wide map: what is joined is a row of the map and a quad, not its pixels."""
    pixels = spark.range(400_000).select(F.lit(1).cast("long").alias("map_id"), (F.col("id") % 4000).cast("int").alias("px"), F.floor(F.col("id") / 4000).cast("int").alias("py"), F.lit(0.5).alias("p"))
    quads = spark.createDataFrame([(1, k, [(1.0, 1.0), (3900.0, 1.0), (3900.0, 90.0), (1.0, 90.0)]) for k in range(200)], QUAD)
    assert {(r.n, r["mean"]) for r in zonal.zonal_mean(pixels, quads).collect()} == {(3899 * 89, 0.5)}


def test_alphabets(spark):
    rows = [("a", "héllo✓"), ("a", "hello"), ("b", "𝒳𝒴 x"), ("b", None), ("c", ""), (None, "z\x00z")]
    df = spark.createDataFrame(rows, "image string, text string")
    got = {(r.image, r.whole): (r.texts, r.characters) for r in corpus.character_counts(df).collect()}
    texts = {k: [t or "" for i, t in rows if i == k] for k, _ in rows}
    want = {(k, False): (len(t), len(set("".join(t)))) for k, t in texts.items()}
    assert got == want | {(None, True): (6, len(set("".join(t or "" for _, t in rows))))}
    assert alphabets.size(alphabets.alphabets(df.limit(0), ["image"]), []).first().characters == 0
    assert alphabets.merged(alphabets.alphabets(df, ["image"])).count() == 3  # character 0, the first 32,768, and mathematical letters


def plain_decode(values, steps, classes, chars, blank=0):
    text, scores, before = "", [], None
    for t in range(steps):
        row = values[t * classes : (t + 1) * classes]
        best = row.index(max(row))
        if best != blank and best != before and best - 1 < len(chars):
            text, scores = text + chars[best - 1], [*scores, row[best]]
        before = best
    return text, sum(scores) / len(scores) if scores else 0.0


def test_logits_are_decoded_in_their_rows(spark):
    rng = random.Random(2)
    rows = []
    for k in range(120):
        t, c = rng.randrange(0, 7), rng.randrange(1, 6)
        rows.append((k, [float(rng.randrange(4)) for _ in range(t * c + rng.choice([0, 0, 3]))], t, c))
    rows += [(200, [1.0], 2, 2), (201, None, 1, 1), (202, [0.5], 1, 0)]
    df = spark.createDataFrame(rows, "original_index int, values array<float>, time_steps int, num_classes int")
    letters = spark.createDataFrame(list(enumerate("abc")), "class_idx int, ch string")
    found = decoding.decode_logits(df, letters)
    assert {r.item: (r.text, r.score) for r in found.collect()} == {k: plain_decode(v, t, c, "abc") for k, v, t, c in rows[:120]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    cells = df.filter("original_index < 120").select(F.col("original_index").alias("item"), "num_classes", "time_steps", F.posexplode("values").alias("k", "p")).filter("k < time_steps * num_classes")
    cells = cells.select("item", F.expr("k div num_classes").alias("t"), (F.col("k") % F.col("num_classes")).alias("c"), F.col("p").cast("double").alias("p"))
    old = {r.item: (r.text, r.score) for r in tensors.ctc_decode(cells, letters).collect()}
    new = {k: v for k, v in ((r.item, (r.text, r.score)) for r in found.collect()) if k in old}
    assert {k: (t, round(s, 9)) for k, (t, s) in old.items()} == {k: (t, round(s, 9)) for k, (t, s) in new.items()}


def test_items_of_two_runs(spark):
    make = lambda rows: spark.createDataFrame(rows, "original_index int, values array<float>, time_steps int, num_classes int")
    letters = spark.createDataFrame(list(enumerate("ab")), "class_idx int, ch string")
    left = make([(1, [0.0, 1.0, 0.0, 0.5, 0.0, 0.25], 2, 3), (2, [0.0, 1.0], 1, 2), (3, [1.0], 1, 1)])
    right = make([(1, [0.0, 1.0, 0.0, 0.0, 0.0, 0.75], 2, 3), (2, [0.0, 0.0, 2.0], 1, 3), (4, [1.0], 1, 1)])
    got = {r.item: r for r in decoding.compare_items(left, right, letters).collect()}
    assert sorted(got) == [1, 2]
    assert (got[1].left_text, got[1].right_text, got[1].left_score, got[1].right_score, got[1].same_text, got[1].same_shape) == ("a", "ab", 1.0, 0.875, False, True)
    assert (got[1].mean_diff, got[1].max_diff) == (1.0 / 6, 0.5)
    assert (got[2].left_text, got[2].right_text, got[2].same_shape) == ("a", "b", False)
