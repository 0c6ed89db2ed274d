"""Column expressions over boxes (x, y, w, h) and polygons (arrays of points x, y)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
CORNERS = f"array<{POINT}>"


def area(b) -> Column:
    return b["w"] * b["h"]


def intersection_area(a, b) -> Column:
    """The common area of two boxes, 0 where they do not overlap."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_of_smaller(a, b) -> Column:
    """Common area as a share of the smaller box, whose area counts as 1 at least."""
    return intersection_area(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1.0))


def horizontal_gap(a, b) -> Column:
    """Free space between two boxes along x, 0 where they touch or overlap there."""
    return F.greatest(F.greatest(a["x"], b["x"]) - F.least(a["x"] + a["w"], b["x"] + b["w"]), F.lit(0.0))


def center_distance(a, b) -> Column:
    """Distance of the centres along y."""
    return F.abs(a["y"] + a["h"] / 2 - (b["y"] + b["h"] / 2))


def iou(a, b) -> Column:
    """Intersection over union of two boxes, 0 where the union has no area."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def can_merge(g, b, x_gap: float, y_gap: float) -> Column:
    """Whether box ``b`` continues group ``g``: near along x and on or just below its lines, or on its line by the centre."""
    reach = F.greatest(F.lit(float(x_gap)), F.least(g["h"], b["h"]) * 1.2)
    near = (b["x"] <= g["x"] + g["w"] + reach) & (b["x"] + b["w"] >= g["x"] - reach)
    bottom = g["y"] + g["h"]
    overlaps = (b["y"] < bottom) & (b["y"] + b["h"] > g["y"])
    below = (b["y"] >= bottom) & (b["y"] <= bottom + float(y_gap))
    same_line = (center_distance(g, b) <= F.greatest(g["h"], b["h"]) * 0.6) & (horizontal_gap(g, b) <= reach)
    return (near & (overlaps | below)) | same_line


def merge_score(g, b) -> Column:
    """Lower is better: centres first, then the gap."""
    return center_distance(g, b) * 10000.0 + horizontal_gap(g, b)


def polygon_bounds(points: Column) -> Column:
    """The box around a polygon, with no negative sizes."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    size = lambda v, least: F.greatest(F.array_max(v) - least, F.lit(0.0))
    return F.struct(x.alias("x"), y.alias("y"), size(xs, x).alias("w"), size(ys, y).alias("h"))


def bounds_polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners of a box: top left, top right, bottom right, bottom left."""
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))


def shoelace_area(points: Column) -> Column:
    """Area of a simple polygon."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2


def point_distance(p, q) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return F.sqrt(dx * dx + dy * dy)


def cross(o, a, b) -> Column:
    """Twice the signed area of the triangle o, a, b."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _quads(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Corners as numbers, by row, corner and coordinate, of the rows that hold four whole ones, and which rows these are."""
    size = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False)
    four = size == 4
    at = (np.cumsum(size) - size)[four][:, None] + np.arange(4)
    q = np.stack([c.to_numpy(zero_copy_only=False).astype(float)[at] for c in points.flatten().flatten()], axis=2)
    clear = ~np.isnan(q).any(axis=(1, 2))
    four[four] = clear
    return q[clear], four


def _as_points(q: np.ndarray, whole: np.ndarray) -> pa.Array:
    """The opposite: null for rows that are not ``whole``."""
    ends = np.concatenate([[0], np.cumsum(4 * whole)]).astype(np.int32)
    corners = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(q[:, :, k]).ravel()) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends), corners, mask=pa.array(~whole))


def _picked(q: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(q, order[:, :, None], axis=1)


def _clockwise(points: pa.Array) -> pa.Array:
    q, whole = _quads(points)
    x, y = (q[:, :, k] - ((q[:, 0, k] + q[:, 1, k] + q[:, 2, k] + q[:, 3, k]) / 4)[:, None] for k in (0, 1))
    q = _picked(q, np.argsort(np.arctan2(y, x), axis=1, kind="stable"))
    q = _picked(q, (np.argmin(q[:, :, 0] + q[:, :, 1], axis=1)[:, None] + np.arange(4)) % 4)
    o, a, b = q[:, 0], q[:, 1], q[:, 2]
    other = (a[:, 0] - o[:, 0]) * (b[:, 1] - o[:, 1]) - (a[:, 1] - o[:, 1]) * (b[:, 0] - o[:, 0]) < 0
    q[other] = q[other][:, [0, 3, 2, 1]]
    return _as_points(q, whole)


def order_clockwise(points: Column) -> Column:
    """Four corners by angle around their mean, from the one nearest the top left; turned over if they run the other way. Null where there are not four whole corners."""
    return F.arrow_udf(_clockwise, CORNERS)(points.cast(CORNERS))


def _cropped(points: pa.Array) -> pa.Array:
    q, whole = _quads(points)
    k = q[:, :, 0] * 10000
    down = np.trunc(k)
    k = (down + np.sign(k) * (np.abs(k - down) >= 0.5)) / 10000  # half goes away from zero
    q = _picked(q, np.lexsort((q[:, :, 0], q[:, :, 1], k), axis=1))
    left, right = (np.where(q[:, i + 1, 1] > q[:, i, 1], 0, 1) for i in (0, 2))  # which of two is the upper
    return _as_points(_picked(q, np.stack([left, 2 + right, 3 - right, 1 - left], axis=1)), whole)


def crop_order(points: Column) -> Column:
    """Corners of a crop: the upper left of the two leftmost, the upper and lower of the two rightmost, the lower left.

    Positions within 1e-4 along x count as equal, by rounding, which unlike a tolerance gives one order. Null
    where there are not four whole corners.
    """
    return F.arrow_udf(_cropped, CORNERS)(points.cast(CORNERS))


def _told(points: pa.Array) -> pa.Array:
    q, whole = _quads(points)
    form = " ".join(["%.4f,%.4f"] * 4)
    texts = iter([form % tuple(r) for r in q.reshape(-1, 8).tolist()])
    return pa.array([next(texts) if w else None for w in whole], pa.string())


def corners_text(points: Column) -> Column:
    """Four corners as text: x,y with four decimals, with a space between."""
    return F.arrow_udf(_told, "string")(points.cast(CORNERS))


def short_side(box: Column) -> Column:
    """The shorter of the two sides that meet in the first corner."""
    return F.least(point_distance(box[0], box[1]), point_distance(box[0], box[3]))


def crop_size(quad: Column) -> Column:
    """Output width and height of a crop: the longer opposite sides, cut to whole numbers, 1 at least."""
    side = lambda a, b, c, d: F.greatest(F.lit(1), F.greatest(point_distance(quad[a], quad[b]), point_distance(quad[c], quad[d])).cast("int"))
    return F.struct(side(0, 1, 3, 2).alias("w"), side(0, 3, 1, 2).alias("h"))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """Corners of a rectangle turned by ``angle`` around its centre."""
    ux, uy, dx, dy = F.cos(angle), F.sin(angle), w / 2, h / 2
    corner = lambda a, b: F.struct((cx + a * ux * dx - b * uy * dy).alias("x"), (cy + a * uy * dx + b * ux * dy).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def expanded_side(side: Column, w: Column, h: Column, ratio: float) -> Column:
    """A side after every edge moves out by area * ratio / perimeter; unchanged without area."""
    perimeter = 2 * (w + h)
    grown = side + 2 * (w * h * ratio / perimeter)
    return F.when((w > 0) & (h > 0) & (perimeter > 1e-6), grown).otherwise(side)


def point_in_quad(px: Column, py: Column, quad: Column) -> Column:
    """Whether a point is on one side of all four edges; edges it lies on do not count."""
    p = {"x": px, "y": py}
    sides = [cross(quad[i], quad[(i + 1) % 4], p) for i in range(4)]
    clear = lambda c, s: F.when(F.abs(c) >= 1e-5, F.signum(c)).otherwise(F.lit(s))
    return F.least(*[clear(c, 1.0) for c in sides]).eqNullSafe(1.0) | F.greatest(*[clear(c, -1.0) for c in sides]).eqNullSafe(-1.0)
