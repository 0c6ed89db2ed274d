"""Crop and resize plans against known values."""

import pytest

from pagemill.operators import boxes, planning, routing


@pytest.mark.parametrize(
    "sizes, rect, view, want",
    [
        ((2560, 1440), (100, 50, 300, 200), (1280, 720), (200, 100, 600, 400)),
        ((100, 100), (80, 60, -40, -30), (100, 100), (40, 30, 40, 30)),
        ((200, 200), (-50, -50, 400, 400), (100, 100), (0, 0, 200, 200)),
        ((0, 100), (0, 0, 10, 10), (10, 10), "empty image"),
        ((100, 100), (0, 0, 10, 10), (0, 10), "bad viewport"),
    ],
)
def test_crop_rect(spark, sizes, rect, view, want):
    row = (*sizes, *map(float, rect), *map(float, view))
    df = spark.createDataFrame([row], "image_w int, image_h int, rect_x double, rect_y double, rect_w double, rect_h double, viewport_w double, viewport_h double")
    r = planning.crop_rect(df).first()
    assert (r.error or (r.crop_x, r.crop_y, r.crop_w, r.crop_h)) == want


@pytest.mark.parametrize(
    "size, limits, want",
    [
        ((2048, 1024), (1024, 0), (1024, 512, 2.0, 2.0)),
        ((512, 256), (1024, 0), (512, 256, 1.0, 1.0)),
        ((2000, 1000), (0, 0), (2000, 1000, 1.0, 1.0)),
        ((1600, 3200), (1024, 0), (1024, 2048, 1.5625, 1.5625)),
        ((0, 10), (1024, 0), "empty image"),
    ],
)
def test_fit_resize(spark, size, limits, want):
    r = planning.fit_resize(spark.createDataFrame([(*size, *limits)], "image_w int, image_h int, max_w int, max_h int")).first()
    assert (r.error or (r.target_w, r.target_h, r.sx, r.sy)) == want


@pytest.mark.parametrize("size, want", [((2559, 1304), (1024, 0)), ((1304, 2559), (0, 1024))])
def test_long_side_limits(spark, size, want):
    r = planning.resize_limits(spark.createDataFrame([(*size, "long-side", 0)], "image_w int, image_h int, mode string, backend_w int")).first()
    assert (r.max_w, r.max_h) == want


def test_crop_offset(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0), (1, 1.0, 2.0)], "image int, x double, y double")
    origins = spark.createDataFrame([(1, 5.0, 7.0)], "image int, ox double, oy double")
    assert sorted((r.x, r.y) for r in boxes.moved(rows, origins).collect()) == [(6.0, 9.0), (15.0, 27.0)]


def test_assets_are_checked_in_parts_of_bounded_rows(spark):
    need = [(r, role, f"{role}_m") for r in [*range(40), None] for role in ("det", "cls", None)] + [(1, "det", "det_m"), (2, "rec", None)]
    have = [(r, f"{role}_m", f) for r in range(40) for role in ("det", "cls") for f in ("inference.json", "inference.pdiparams") if (r + len(f)) % 5]
    have += [(None, "det_m", "inference.json"), (2, None, "inference.json"), (7, "other", "inference.json"), (8, "det_m", None)]
    df = spark.createDataFrame(need, "root long, role string, model string"), spark.createDataFrame(have, "root long, model string, file string")
    found = routing.asset_check(*df, part_rows=20)
    assert found.rdd.getNumPartitions() >= (len(need) + len(have)) // 20
    want = {}
    for r, role, model in set(need):
        files = [f for root, m, f in have if r is not None and model is not None and (root, m) == (r, model)]
        want.setdefault(r, []).append(any(f is not None for f in files) and "inference.json" in files and "inference.pdiparams" in files)
    assert {r.root: (r.ok, r.failures.count("dir=") if None not in [n[1] for n in need if n[0] == r.root] else None) for r in found.collect()} == {
        r: (all(oks), oks.count(False) if None not in [n[1] for n in need if n[0] == r] else None) for r, oks in want.items()}
