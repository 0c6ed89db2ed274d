"""Folds over the boxes of an image from top to bottom that look only at what the next box can still reach.

What a fold carries is copied at every step, so it holds the open groups, without their members, and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as geo

BOX = "x:double,y:double,w:double,h:double"
MEMBER = "struct<y:double,x:double,idx:int,w:double,h:double,text:string>"
#: A group while it grows: its number in order of creation, how far down a box may begin and still join it, and those of its members that such a box may lie on.
OPEN = f"struct<{BOX},near:array<{MEMBER}>,reach:double,n:int>"
STATE = f"struct<now:struct<open:array<{OPEN}>,pick:int>,out:array<int>,n:int,tall:double>"
#: What a box was put into, where that is no group.
NOWHERE, NO_BOX = -1, -2


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def same_text(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _opened(x: Column, y: Column, w: Column, h: Column, near: Column, n: Column, y_gap: float, tallest: Column) -> Column:
    """A group with the lowest y at which ``geometry.can_merge`` may still hold for a box of the image.

    A box must begin above the group's bottom or at most ``y_gap`` below it, or have its centre within 0.6 of the taller
    height of the group's centre, so that it begins within 0.6 of the group's height or 0.1 of its own below that centre.
    """
    reach = F.greatest(y + h + float(y_gap), y + h / 2 + F.greatest(h * 0.6, tallest * 0.1))
    slack = (F.abs(y) + F.abs(h) + tallest + 1) * 1e-9  # for rounding; it only keeps a group for longer
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), near.alias("near"), (reach + slack).alias("reach"), n.cast("int").alias("n"))


def group_numbers(boxes: Column, x_gap: float, y_gap: float) -> Column:
    """For each of an array of boxes in reading order the number, from 0, of the greedy group it goes to; -1 for one that goes nowhere.

    A box goes nowhere if some group it could join holds it already, else to the best such group (the earliest of
    equally good ones), else it begins a group. As boxes come from top to bottom, a group whose reach they have passed is
    put aside, and only the others are searched. Heights are not negative.
    """
    tallest = F.coalesce(F.array_max(F.transform(boxes, lambda b: b["h"])), F.lit(0.0))
    now = F.struct(F.array().cast(f"array<{OPEN}>").alias("open"), F.lit(NO_BOX).alias("pick"))
    start = F.struct(now.alias("now"), F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), tallest.alias("tall")).cast(STATE)

    def joined(g, b, tall) -> Column:
        x, y = F.least(g["x"], b["x"]), F.least(g["y"], b["y"])
        w, h = F.greatest(g["x"] + g["w"], b["x"] + b["w"]) - x, F.greatest(g["y"] + g["h"], b["y"] + b["h"]) - y
        # only members that reach below the box's top can overlap it or what follows
        near = F.concat(F.filter(g["near"], lambda m: m["y"] + m["h"] > b["y"]), F.array(b))
        return _opened(x, y, w, h, near, g["n"], y_gap, tall)

    def add(state, b) -> Column:
        n = F.when(state["now"]["pick"] == state["n"], state["n"] + 1).otherwise(state["n"])

        def choice(fits) -> Column:
            nested = F.exists(fits, lambda g: F.exists(g["near"], lambda m: (geo.overlap_of_smaller(m, b) >= 0.9) & same_text(m["text"], b["text"])))
            best = F.array_min(F.transform(fits, lambda g: F.struct(geo.merge_score(g, b).alias("s"), g["n"].alias("n"))))
            return F.when(nested, NOWHERE).otherwise(F.coalesce(best["n"], n))

        def after(groups) -> Column:
            def put(k) -> Column:
                alone = _opened(b["x"], b["y"], b["w"], b["h"], F.array(b), n, y_gap, state["tall"])
                grown = F.transform(groups, lambda g: F.when(g["n"] == k, joined(g, b, state["tall"])).otherwise(g))
                return F.struct(F.when(k == NOWHERE, groups).when(k == n, F.concat(groups, F.array(alone))).otherwise(grown).alias("open"), k.alias("pick"))

            return let(let(F.filter(groups, lambda g: geo.can_merge(g, b, x_gap, y_gap)), choice), put)

        chosen = let(F.filter(state["now"]["open"], lambda g: g["reach"] >= b["y"]), after)
        # the number of the box before is noted now, so that what is computed for this one is used once
        return F.struct(chosen.alias("now"), F.concat(state["out"], F.array(state["now"]["pick"])).alias("out"), n.alias("n"), state["tall"].alias("tall")).cast(STATE)

    return F.aggregate(boxes, start, add, lambda s: F.filter(F.concat(s["out"], F.array(s["now"]["pick"])), lambda k: k != NO_BOX))


def kept_groups(groups: Column) -> Column:
    """Places, in reading order, of the groups (x, y, w, h, text) that stay: largest first, a group goes that a kept one covers to 0.9, with one text inside the other.

    Which groups cover which is found from top to bottom among those that overlap along y; whether a
    group goes depends on the larger ones that cover it, in order of size. ``groups`` is a column, not an expression, as it is read several times.
    """
    by_size = F.sort_array(F.transform(groups, lambda g, i: F.struct((-(g["w"] * g["h"])).alias("a"), i.alias("i"), *[g[c].alias(c) for c in ("y", "x", "w", "h", "text")])))
    kind = "struct<y:double,r:int,i:int,x:double,w:double,h:double,text:string>"
    ranked = F.transform(by_size, lambda s, r: F.struct(s["y"].alias("y"), r.alias("r"), *[s[c].alias(c) for c in ("i", "x", "w", "h", "text")]))
    start = F.struct(F.array().cast(f"array<{kind}>").alias("front"), F.array().cast("array<struct<late:int,early:int>>").alias("pairs"))

    def meet(state, v) -> Column:
        def with_front(front) -> Column:
            covers = F.filter(front, lambda f: (geo.overlap_of_smaller(f, v) >= 0.9) & same_text(f["text"], v["text"]))
            found = F.transform(covers, lambda f: F.struct(F.greatest(f["r"], v["r"]).alias("late"), F.least(f["r"], v["r"]).alias("early")))
            return F.struct(F.concat(front, F.array(v)).alias("front"), F.concat(state["pairs"], found).alias("pairs"))

        return let(F.filter(state["front"], lambda f: f["y"] + f["h"] > v["y"]), with_front)

    def kept(all_ranked) -> Column:
        pairs = F.aggregate(F.sort_array(all_ranked), start, meet, lambda s: F.sort_array(s["pairs"]))
        gone = F.aggregate(
            pairs, F.array().cast("array<int>"),
            lambda out, p: F.when(F.array_contains(out, p["early"]) | F.array_contains(out, p["late"]), out).otherwise(F.concat(out, F.array(p["late"]))))
        return let(gone, lambda g: F.filter(all_ranked, lambda s: ~F.array_contains(g, s["r"])))

    back = F.sort_array(F.transform(let(ranked.cast(f"array<{kind}>"), kept), lambda s: F.struct(s["y"].alias("y"), s["x"].alias("x"), s["r"].alias("r"), s["i"].alias("i"))))
    return F.transform(back, lambda s: s["i"])
