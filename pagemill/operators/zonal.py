"""Means of map pixels inside quads, from sums along the rows of a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo

#: A point this close to an edge's line, as a cross product, may be on either side of it (``geometry.point_in_quad``).
CLEAR = 1e-5


def _lines(pixels: DataFrame) -> DataFrame:
    """map_id, py, line: for each pixel of a row of a map, in order of px, what the row holds up to it: pixels, values, their sum."""
    upto = Window.partitionBy("map_id", "py").orderBy("px").rangeBetween(Window.unboundedPreceding, 0)
    sums = pixels.select(
        "map_id", "py", F.col("px").cast("long").alias("px"), F.count("*").over(upto).alias("n"), F.count("p").over(upto).alias("m"), F.coalesce(F.sum("p").over(upto), F.lit(0.0)).alias("s")
    ).distinct()
    return sums.groupBy("map_id", "py").agg(F.sort_array(F.collect_list(F.struct("px", "n", "m", "s"))).alias("line"))


def _upto(line: Column, px: Column) -> Column:
    """What a row holds up to ``px``: looked up by place where the row has every pixel, else searched."""
    first, last = line[0]["px"], F.element_at(line, -1)["px"]
    nothing = F.struct(F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("s"))
    by_place = F.get(line, (F.least(px, last) - first).cast("int"))
    return F.when(px < first, nothing).when(F.size(line) == last - first + 1, by_place).otherwise(F.element_at(F.filter(line, lambda e: e["px"] <= px), -1))


def _span(quad: Column, box: Column, cy: Column, side: int) -> Column:
    """(low, high): the pixels of a scanline whose centres have all edges on ``side`` (1 or -1) or nearly run through them; empty if low > high.

    Each edge bounds the line at one end. Ends are found by division and then put right by the test itself, as a
    quotient may round to the other side of a centre.
    """
    corners = [(quad[i], quad[(i + 1) % 4]) for i in range(4)]
    low, high = [box["x"]], [box["x"] + box["w"]]
    for a, b in corners:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        at = a["x"] + (dx * (cy - a["y"]) + side * CLEAR) / F.when(dy != 0, dy)
        low.append(F.when(dy * side < 0, at))
        high.append(F.when(dy * side > 0, at))

    def inside(px: Column) -> Column:
        cx = px + 0.5
        found = (cx >= box["x"]) & (cx <= box["x"] + box["w"])
        for a, b in corners:
            found = found & (geo.cross(a, b, {"x": cx, "y": cy}) * side > -CLEAR)
        return F.coalesce(found, F.lit(False))

    near = lambda x: F.filter(F.sequence(x.cast("long") - 1, x.cast("long") + 1), inside)
    first, last = F.array_min(near(F.ceil(F.greatest(*low) - 0.5))), F.array_max(near(F.floor(F.least(*high) - 0.5)))
    return F.struct(F.coalesce(first, F.lit(0)).cast("long").alias("low"), F.coalesce(last, F.lit(-1)).cast("long").alias("high"))


def zonal_mean(pixels: DataFrame, quads: DataFrame) -> DataFrame:
    """map_id, box, n, total, mean of pixels whose centre lies in a box's quad; 0 where no pixel does. ``quads``: map_id, box, quad.

    A quad meets each row of its map that it may reach once, and takes from that row's running sums what lies between
    its ends: rows of maps times quads, however wide either is. Pixels whose p is null count in n alone.
    """
    bounds = quads.select("map_id", "box", "quad", geo.polygon_bounds(F.col("quad")).alias("b"))
    top, bottom = F.ceil(F.col("b.y") - 0.5).cast("long"), F.floor(F.col("b.y") + F.col("b.h") - 0.5).cast("long")
    scans = bounds.select("map_id", "box", "quad", "b", F.explode(F.when(top <= bottom, F.sequence(top, bottom))).alias("py"))
    cy = F.col("py") + 0.5
    spans = scans.select("map_id", "box", "py", *[_span(F.col("quad"), F.col("b"), cy, side).alias(name) for side, name in ((1, "left"), (-1, "right"))])
    # both ways round only where a quad is a line or a point: what they share counts once
    shared = F.struct(F.greatest("left.low", "right.low").alias("low"), F.least("left.high", "right.high").alias("high"))
    empty = lambda c: F.col(f"{c}.low") > F.col(f"{c}.high")
    ends = spans.select("map_id", "box", "py", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), "left.low", "left.high"), F.struct(F.lit(1).alias("sign"), "right.low", "right.high"),
        F.struct(F.when(empty("left") | empty("right"), 0).otherwise(-1).alias("sign"), shared["low"].alias("low"), shared["high"].alias("high")))).alias("e"))
    ends = ends.select("map_id", "box", "py", "e.*").filter("sign <> 0 and low <= high")
    lines = _lines(pixels).withColumn("py", F.col("py").cast("long"))
    found = ends.join(lines, ["map_id", "py"]).select("map_id", "box", "sign", _upto(F.col("line"), F.col("high")).alias("z"), _upto(F.col("line"), F.col("low") - 1).alias("a"))
    between = lambda c: F.sum(F.col("sign") * (F.col(f"z.{c}") - F.col(f"a.{c}"))).alias(c)
    sums = found.groupBy("map_id", "box").agg(between("n"), between("m"), between("s"))
    out = quads.select("map_id", "box").join(sums, ["map_id", "box"], "left")
    total = F.when(F.col("m") > 0, F.col("s")).otherwise(0.0)
    return out.select("map_id", "box", F.coalesce("n", F.lit(0)).alias("n"), total.alias("total"), F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0).alias("mean"))
