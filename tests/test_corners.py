"""Orders of corners against the rules, row by row, and where there are no four corners."""

import math
import random

from pyspark.sql import functions as F

from pagemill.functions import geometry as geo

QUAD = "k int, p array<struct<x:double,y:double>>"


def clockwise(p):
    cx, cy = sum(x for x, _ in p) / 4, sum(y for _, y in p) / 4
    s = [p[i] for _, i in sorted((math.atan2(y - cy, x - cx), i) for i, (x, y) in enumerate(p))]
    first = min(range(4), key=lambda i: sum(s[i]))
    return s[first:] + s[:first]


def cropped(p):
    a, b, c, d = sorted(p, key=lambda v: (math.floor(v[0] * 10000 + 0.5) / 10000, v[1], v[0]))
    (tl, bl), (tr, br) = ((a, b) if b[1] > a[1] else (b, a)), ((c, d) if d[1] > c[1] else (d, c))
    return [tl, tr, br, bl]


def test_corner_orders_follow_the_rules(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        a, cx, cy, w, h = rng.uniform(0, 6.3), rng.uniform(0, 99), rng.uniform(0, 99), rng.uniform(1, 9), rng.uniform(1, 9)
        u, v = math.cos(a), math.sin(a)
        p = [(cx + i * u * w - j * v * h, cy + i * v * w + j * u * h) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        rng.shuffle(p)
        rows.append((k, p))
    odd = [(300, None), (301, []), (302, [(1.0, 2.0)] * 3), (303, [(1.0, 2.0), None, (3.0, 4.0), (5.0, 6.0)]), (304, [(1.0, None)] * 4)]
    c, q = geo.order_clockwise(F.col("p")), geo.crop_order(F.col("p"))
    df = spark.createDataFrame(rows[:150] + odd + rows[150:], QUAD).repartition(3)
    found = df.select("k", c.alias("c"), q.alias("q"), geo.corners_text(q).alias("t"))
    got = {r.k: r for r in found.collect()}
    for k, p in rows:
        assert [tuple(x) for x in got[k].c] == clockwise(p)
        assert [tuple(x) for x in got[k].q] == cropped(p)
        assert got[k].t == " ".join(f"{x:.4f},{y:.4f}" for x, y in cropped(p))
    assert all((got[k].c, got[k].q, got[k].t) == (None, None, None) for k, _ in odd)
