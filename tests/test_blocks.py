"""Text blocks against known results and against a plain model."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators.blocks import overlay_payload, text_blocks, uncrowded

SCHEMA = "image int, idx int, x double, y double, w double, h double, text string"


def blocks(spark, boxes, **kw):
    rows = [(1, i, float(x), float(y), float(w), float(h), t) for i, (x, y, w, h, t) in enumerate(boxes, 1)]
    out = text_blocks(spark.createDataFrame(rows, SCHEMA), **kw).orderBy("block").collect()
    return [(r.text, (r.x, r.y, r.w, r.h)) for r in out]


@pytest.mark.parametrize(
    "boxes, source, want",
    [
        ([(0, 0, 50, 20, "Hello"), (60, 0, 50, 20, "World")], "en", [("Hello World", (0, 0, 110, 20))]),
        ([(0, 0, 50, 20, "Hello"), (60, 0, 50, 20, "World")], "ch", [("HelloWorld", (0, 0, 110, 20))]),
        ([(0, 0, 50, 20, "A"), (90, 0, 50, 20, "B")], "en", [("A", (0, 0, 50, 20)), ("B", (90, 0, 50, 20))]),
        ([(0, 0, 50, 20, "A"), (0, 30, 50, 20, "B")], "en", [("A B", (0, 0, 50, 50))]),
        ([(0, 0, 50, 20, "A"), (0, 36, 50, 20, "B")], "en", [("A", (0, 0, 50, 20)), ("B", (0, 36, 50, 20))]),
        ([(0, 0, 50, 20, " \t"), (0, 0, 50, 20, None)], "en", []),
        ([(0, 0, 100, 20, "Hello there"), (2, 1, 40, 16, "Hello")], "en", [("Hello there", (0, 0, 100, 20))]),
        ([(0, 0, 50, 20, "same"), (55, 0, 50, 20, "same")], "en", [("same", (0, 0, 105, 20))]),
    ],
)
def test_known(spark, boxes, source, want):
    assert blocks(spark, boxes, source=source) == want


@pytest.mark.parametrize(
    "boxes, source, want",
    [
        ([], "en", []),
        ([(10, 10, 80, 20, "Hello")], "en", ["Hello"]),
        ([(0, 0, 50, 20, "Left"), (100, 0, 50, 20, "Right")], "en", ["Left", "Right"]),
        ([(0, 0, 60, 22, "Alpha"), (84, 2, 70, 22, "Beta")], "en", ["Alpha Beta"]),
        ([(0, 0, 120, 22, "The quick"), (70, 0, 100, 22, "quick brown"), (150, 0, 80, 22, "fox")], "en", ["The quick quick brown fox"]),
        ([(0, 0, 80, 22, "2026-04"), (84, 0, 40, 22, "04")], "ch", ["2026-0404"]),
        ([(0, 0, 100, 20, "Line"), (0, 25, 100, 20, "two")], "en", ["Line two"]),
        ([(0, 0, 100, 20, "Para"), (0, 40, 100, 20, "Two")], "en", ["Para", "Two"]),
        ([(0, 0, 50, 20, "  "), (0, 30, 50, 20, "你好"), (0, 60, 80, 20, "Answer")], "en", ["你好 Answer"]),
        ([(0, 0, 40, 20, "你好"), (50, 0, 40, 20, "世界")], "ch", ["你好世界"]),
        ([(0, 30, 100, 20, "Two"), (0, 0, 100, 20, "One")], "en", ["One Two"]),
        ([(0, 0, 50, 20, "Alpha"), (0, 100, 50, 20, "Beta"), (0, 200, 50, 20, "Gamma")], "en", ["Alpha", "Beta", "Gamma"]),
        ([(0, 0, 80, 20, "Left"), (500, 0, 80, 20, "Right"), (0, 25, 80, 20, "line"), (500, 25, 80, 20, "two")], "en", ["Left line", "Right two"]),
        ([(500, 0, 80, 20, "Right"), (0, 25, 80, 20, "left")], "en", ["Right", "left"]),
        ([(10, 10, 220, 24, "The quick brown fox"), (40, 10, 100, 24, "quick brown")], "en", ["The quick brown fox"]),
        ([(10, 10, 220, 24, "ABCDE"), (20, 10, 60, 24, "XYZ")], "ch", ["ABCDEXYZ"]),
    ],
)
def test_known_texts(spark, boxes, source, want):
    assert [t for t, _ in blocks(spark, boxes, source=source)] == want


def test_known_bounds(spark):
    assert blocks(spark, [(10, 5, 50, 20, "Hello"), (70, 5, 50, 20, "World")]) == [("Hello World", (10, 5, 110, 20))]


def test_crowded_images_are_reported(spark):
    rows = spark.createDataFrame([(i, k, 0.0, 30.0 * k, 5.0, 5.0, "a") for i in (1, 2) for k in range(3 * i)], SCHEMA)
    fit, crowded = uncrowded(rows, most=4)
    assert fit.select("image").distinct().collect() == [(1,)] and [tuple(r) for r in crowded.collect()] == [(2, 6)]


def test_payload_with_sizes_and_debug(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 20.0, "A")], SCHEMA)
    sizes = spark.createDataFrame([(1, 100, 50, False), (2, 10, 5, True)], "image int, orig_width int, orig_height int, debug_trace boolean")
    debug = rows.withColumns({"score": F.lit(0.5), "accepted": F.lit(True)})
    got = {r.image: json.loads(r.payload) for r in overlay_payload(text_blocks(rows), sizes, debug).collect()}
    assert got[2] == {"groups": [], "orig_width": 10, "orig_height": 5, "debug_trace": True}
    assert set(got[1]) == {"groups", "orig_width", "orig_height", "debug_detections"}
    assert got[1]["debug_detections"] == [[{"x": 0, "y": 0, "width": 50, "height": 20}, "A", 0.5, True]]


def model(boxes, x_gap=20, y_gap=15):
    def inter(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        return w * h if w > 0 and h > 0 else 0.0

    over = lambda a, b: inter(a, b) / max(1, min(a[2] * a[3], b[2] * b[3]))
    gap = lambda a, b: max(0, max(a[0], b[0]) - min(a[0] + a[2], b[0] + b[2]))
    center = lambda a, b: abs(a[1] + a[3] / 2 - b[1] - b[3] / 2)
    alike = lambda s, t: s in t or t in s

    def joins(g, b):
        reach = max(x_gap, 1.2 * min(g[3], b[3]))
        near = b[0] <= g[0] + g[2] + reach and b[0] + b[2] >= g[0] - reach
        bottom = g[1] + g[3]
        lines = b[1] < bottom and b[1] + b[3] > g[1] or bottom <= b[1] <= bottom + y_gap
        return near and lines or center(g, b) <= 0.6 * max(g[3], b[3]) and gap(g, b) <= reach

    def text(members):
        out = members[0][4]
        for m in members[1:]:
            out = out if out == m[4] else f"{out} {m[4]}"
        return out

    groups = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        fits = [g for g in groups if joins(g["b"], b)]
        if any(over(m, b) >= 0.9 and alike(m[4], b[4]) for g in fits for m in g["m"]):
            continue
        if fits:
            g = min(fits, key=lambda g: center(g["b"], b) * 10000 + gap(g["b"], b))
            a = g["b"]
            x, y = min(a[0], b[0]), min(a[1], b[1])
            g["b"] = (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)
            g["m"].append(b)
        else:
            groups.append({"b": b[:4], "m": [b]})
    kept = []
    for g in sorted(groups, key=lambda g: -g["b"][2] * g["b"][3]):
        if not any(over(g["b"], k["b"]) >= 0.9 and alike(text(g["m"]), text(k["m"])) for k in kept):
            kept.append(g)
    return [(text(g["m"]), g["b"]) for g in sorted(kept, key=lambda g: (g["b"][1], g["b"][0]))]


def test_random_images_against_model(spark):
    rng = random.Random(5)
    images = {
        i: [(rng.randrange(0, 200, 5) * 1.0, rng.randrange(0, 90, 3) * 1.0, rng.choice([20, 40, 80]) * 1.0, rng.choice([10, 16, 30]) * 1.0, rng.choice(["a", "ab", "abc", "b", "x"])) for _ in range(rng.randrange(1, 12))]
        for i in range(120)
    }
    rows = [(i, k, *b) for i, boxes in images.items() for k, b in enumerate(boxes, 1)]
    got = {}
    for r in text_blocks(spark.createDataFrame(rows, SCHEMA)).orderBy("image", "block").collect():
        got.setdefault(r.image, []).append((r.text, (r.x, r.y, r.w, r.h)))
    for i, boxes in images.items():
        assert got.get(i, []) == model(boxes), boxes


def test_payload_leaves_out_empty_members(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 20.0, "A")], SCHEMA)
    assert "members" not in overlay_payload(text_blocks(rows)).first().payload
    assert '"members":["A"]' in overlay_payload(text_blocks(rows, with_members=True)).first().payload
