"""Queries over detections: projections, order, blocks and run against run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import blocks, boxes, parity
from ..sources import readers, views
from ..sources.views import DET, DET_B
from .registration import registration

QUERIES, SQL, query = registration()


def _clean(spark, d):
    return blocks.clean_text(views.detections(spark, d))


CLEAN = DET + r""", clean AS (SELECT * REPLACE (regexp_replace(text, '^\s+|\s+$', '', 'g') AS text) FROM det WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')"""


@query("p1_clean_text", f"WITH {CLEAN} SELECT image, idx, text FROM clean")
def p1(spark, d):
    return _clean(spark, d).select("image", "idx", "text")


@query("p2_polygon_bounds", f"WITH {DET} SELECT image, idx, x, y, w, h FROM det")
def p2(spark, d):
    return boxes.with_bounds(boxes.with_polygon(views.detections(spark, d)).drop(*"xywh")).select("image", "idx", *"xywh")


@query("p3_bounds_polygon", f"WITH {DET} SELECT image, idx, x AS x0, y AS y0, x + w AS x2, y + h AS y2 FROM det")
def p3(spark, d):
    p = boxes.with_polygon(views.detections(spark, d))
    return p.select("image", "idx", F.expr("polygon[0].x").alias("x0"), F.expr("polygon[1].y").alias("y0"), F.expr("polygon[1].x").alias("x2"), F.expr("polygon[3].y").alias("y2"))


@query("p4_rescale", f"WITH {DET} SELECT image, idx, x * (1 + image % 3) AS x, y * (1 + image % 2) AS y, w * (1 + image % 3) AS w, h * (1 + image % 2) AS h FROM det")
def p4(spark, d):
    det = views.detections(spark, d)
    scales = det.select("image").distinct().select("image", (1.0 + F.col("image") % 3).alias("sx"), (1.0 + F.col("image") % 2).alias("sy"))
    return boxes.rescaled(det, scales).select("image", "idx", *"xywh")


@query("p5_offset", f"WITH {DET} SELECT image, idx, x + image % 7 AS x, y + image % 5 AS y FROM det")
def p5(spark, d):
    det = views.detections(spark, d)
    origins = det.select("image").distinct().select("image", (F.col("image") % 7).cast("double").alias("ox"), (F.col("image") % 5).cast("double").alias("oy"))
    return boxes.moved(det, origins).select("image", "idx", "x", "y")


@query("p11_score_filter", f"WITH {DET} SELECT image, idx, score, score >= 0.5 AS accepted FROM det")
def p11(spark, d):
    return boxes.with_accepted(views.detections(spark, d), 0.5).select("image", "idx", "score", "accepted")


@query("t1_reading_order", f"WITH {DET} SELECT image, idx, CAST(row_number() OVER (PARTITION BY image ORDER BY y, x, idx) AS INTEGER) AS pos FROM det")
def t1(spark, d):
    return blocks.reading_order(views.detections(spark, d)).select("image", "idx", "pos")


@query("t2_banded_order", f"""WITH RECURSIVE {DET},
    o AS (SELECT image, idx, x, y, row_number() OVER (PARTITION BY image ORDER BY y, x, idx) AS rn FROM det),
    f AS (
        SELECT image, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, idx INTEGER)[]) AS out FROM (SELECT DISTINCT image FROM o)
        UNION ALL
        SELECT f.image, o.rn,
               list_concat(list_concat(f.out[1:cut.n], [struct_pack(x := o.x, y := o.y, idx := o.idx)]), f.out[cut.n + 1:])
        FROM f JOIN o ON o.image = f.image AND o.rn = f.rn + 1,
             LATERAL (SELECT coalesce(max(i), 0) AS n FROM (SELECT unnest(range(1, len(f.out) + 1)) AS i) WHERE NOT (abs(o.y - f.out[i].y) < 10 AND o.x < f.out[i].x)) cut),
    last AS (SELECT image, max_by(out, rn) AS out FROM f GROUP BY image)
    SELECT image, CAST(i AS INTEGER) AS pos, out[i].idx AS idx FROM (SELECT image, out, unnest(range(1, len(out) + 1)) AS i FROM last)""")
def t2(spark, d):
    return boxes.banded_order(views.detections(spark, d))


@query("t4_candidate_cap", f"WITH {DET} SELECT image, idx FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY idx) AS rn FROM det) WHERE rn <= 10")
def t4(spark, d):
    return boxes.first_candidates(views.detections(spark, d), 10).select("image", "idx")


@query("t5_groups_by_area", f"WITH {DET} SELECT image, idx, w * h AS area, CAST(row_number() OVER (PARTITION BY image ORDER BY w * h DESC, idx) AS INTEGER) AS pos FROM det")
def t5(spark, d):
    ranked = views.detections(spark, d).groupBy("image").agg(F.sort_array(F.collect_list(F.struct((-F.col("w") * F.col("h")).alias("a"), "idx"))).alias("r"))
    return ranked.select("image", F.posexplode("r").alias("p", "s")).select("image", "s.idx", (-F.col("s.a")).alias("area"), (F.col("p") + 1).alias("pos"))


@query("a12_union_box", f"WITH {DET} SELECT image, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM det GROUP BY image")
def a12(spark, d):
    return boxes.union_box(views.detections(spark, d))


GAP = "greatest(greatest(g.x, b.x) - least(g.x + g.w, b.x + b.w), 0)"
CENTER = "abs(g.y + g.h / 2 - (b.y + b.h / 2))"
REACH = "greatest(20, least(g.h, b.h) * 1.2::DOUBLE)"
INTER = "greatest(least(g.x + g.w, b.x + b.w) - greatest(g.x, b.x), 0) * greatest(least(g.y + g.h, b.y + b.h) - greatest(g.y, b.y), 0)"
CAN = f"""((b.x <= g.x + g.w + {REACH} AND b.x + b.w >= g.x - {REACH} AND ((b.y < g.y + g.h AND b.y + b.h > g.y) OR (b.y >= g.y + g.h AND b.y <= g.y + g.h + 15)))
    OR ({CENTER} <= greatest(g.h, b.h) * 0.6::DOUBLE AND {GAP} <= {REACH}))"""


def _over(a: str, b: str) -> str:
    inter = INTER.replace("g.", f"{a}.").replace("b.", f"{b}.") if (a, b) != ("g", "b") else INTER
    return f"({inter} / greatest(least({a}.w * {a}.h, {b}.w * {b}.h), 1) >= 0.9 AND (contains({a}.t, {b}.t) OR contains({b}.t, {a}.t)))"


MEMBERS = "STRUCT(y DOUBLE, x DOUBLE, idx INTEGER, w DOUBLE, h DOUBLE, t VARCHAR)[]"
#: Greedy groups of each image, one box a step; then groups without what a larger kept one covers, one group a step.
BLOCKS = """RECURSIVE {det}, clean AS ({clean}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y, x, idx) AS rn FROM clean),
fold AS (
    SELECT image, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, m {members})[]) AS gs FROM (SELECT DISTINCT image FROM clean)
    UNION ALL
    SELECT f.image, b.rn, CASE WHEN pick.nested THEN f.gs
        WHEN pick.best IS NULL THEN list_append(f.gs, struct_pack(x := b.x, y := b.y, w := b.w, h := b.h, m := [struct_pack(y := b.y, x := b.x, idx := b.idx, w := b.w, h := b.h, t := b.text)]))
        ELSE list_transform(f.gs, lambda g, i: CASE WHEN i <> pick.best THEN g ELSE struct_pack(x := least(g.x, b.x), y := least(g.y, b.y),
            w := greatest(g.x + g.w, b.x + b.w) - least(g.x, b.x), h := greatest(g.y + g.h, b.y + b.h) - least(g.y, b.y),
            m := list_append(g.m, struct_pack(y := b.y, x := b.x, idx := b.idx, w := b.w, h := b.h, t := b.text))) END) END
    FROM fold f JOIN ordered b ON b.image = f.image AND b.rn = f.rn + 1, LATERAL (
        SELECT min_by(i, (score, i)) AS best, coalesce(bool_or(nested), false) AS nested FROM (
            SELECT i, {center} * 10000 + {gap} AS score, len(list_filter(g.m, lambda m: {nested})) > 0 AS nested
            FROM (SELECT i, f.gs[i] AS g FROM (SELECT unnest(range(1, len(f.gs) + 1)) AS i)) WHERE {can})) pick),
grouped AS (SELECT image, max_by(gs, rn) AS gs FROM fold GROUP BY image),
named AS (SELECT image, i, g.x, g.y, g.w, g.h, list_transform(g.m, lambda m: m.t) AS texts FROM (SELECT image, i, gs[i] AS g FROM (SELECT image, gs, unnest(range(1, len(gs) + 1)) AS i FROM grouped))),
told AS (SELECT *, list_reduce(texts, lambda a, z: CASE WHEN a = z THEN a ELSE a || ' ' || z END) AS t FROM named),
areas AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, i) AS rn FROM told),
keep AS (
    SELECT image, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, t VARCHAR, rn BIGINT)[]) AS kept FROM (SELECT DISTINCT image FROM areas)
    UNION ALL
    SELECT k.image, g.rn, CASE WHEN len(list_filter(k.kept, lambda b: {covered})) > 0 THEN k.kept
        ELSE list_append(k.kept, struct_pack(x := g.x, y := g.y, w := g.w, h := g.h, t := g.t, rn := g.rn)) END
    FROM keep k JOIN areas g ON g.image = k.image AND g.rn = k.rn + 1),
left_over AS (SELECT image, unnest(max_by(kept, rn)) AS k FROM keep GROUP BY image),
blocks AS (SELECT a.image, CAST(row_number() OVER (PARTITION BY a.image ORDER BY a.y, a.x, a.rn) AS INTEGER) AS block, a.t AS text, a.x, a.y, a.w, a.h, a.texts
    FROM areas a JOIN left_over l ON l.image = a.image AND l.k.rn = a.rn)"""


def _blocks_sql(kept: str) -> str:
    m = lambda e: e.replace("g.", "m.")
    nested = f"({m(INTER)} / greatest(least(m.w * m.h, b.w * b.h), 1) >= 0.9 AND (contains(m.t, b.text) OR contains(b.text, m.t)))"
    trimmed = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
    clean = f"SELECT * REPLACE ({trimmed} AS text) FROM det WHERE {trimmed} <> '' AND {kept}"
    return BLOCKS.format(det=DET, clean=clean, members=MEMBERS, center=CENTER, gap=GAP, nested=nested, can=CAN, covered=_over("g", "b"))


@query("g7_text_blocks", f"WITH {_blocks_sql('score >= 0.1')} SELECT image, block, text, x, y, w, h, array_to_string(texts, '|') AS members FROM blocks")
def g7(spark, d):
    found = blocks.text_blocks(boxes.with_accepted(views.detections(spark, d), 0.1).filter("accepted"), with_members=True)
    return found.withColumn("members", F.array_join("members", "|"))


@query("g4_greedy_groups", f"""WITH {_blocks_sql('true')} SELECT image, i AS pos, x, y, w, h, len(texts) AS members FROM named""")
def g4(spark, d):
    g = blocks.greedy_groups(views.detections(spark, d), 20, 15)
    return g.select("image", (F.col("n") + 1).cast("long").alias("pos"), *"xywh", F.size("members").cast("long").alias("members"))


SIZES = "sizes AS (SELECT DISTINCT image, 800 + image % 3 AS orig_width, 736 AS orig_height, image % 4 = 0 AS debug_trace FROM det)"


@query("k2_overlay_payload", f"""WITH {_blocks_sql('true')}, {SIZES},
    shown AS (SELECT image, string_agg('{{"text":' || to_json(text) || ',"bounds":' || to_json(struct_pack(x := x, y := y, width := w, height := h)) ||
        CASE WHEN image % 2 = 0 THEN ',"members":' || to_json(texts) ELSE '' END || '}}', ',' ORDER BY block) AS groups FROM blocks GROUP BY image),
    debug AS (SELECT image, string_agg('[' || to_json(struct_pack(x := x, y := y, width := w, height := h)) || ',' || to_json(text) || ',' || round(score, 0) || ',' || (score >= 0.5) || ']', ',' ORDER BY idx) AS d
        FROM det WHERE image % 3 = 0 GROUP BY image)
    SELECT s.image, '{{"groups":[' || coalesce(g.groups, '') || ']' || coalesce(',"debug_detections":[' || d.d || ']', '') || ',"orig_width":' || orig_width || ',"orig_height":' || orig_height ||
        CASE WHEN debug_trace THEN ',"debug_trace":true' ELSE '' END || '}}' AS payload FROM sizes s LEFT JOIN shown g ON g.image = s.image LEFT JOIN debug d ON d.image = s.image""")
def k2(spark, d):
    """Payloads with members for even images, debug detections for every third, and the trace flag for every fourth."""
    det = views.detections(spark, d)
    sizes = det.select("image").distinct().select("image", (800 + F.col("image") % 3).alias("orig_width"), F.lit(736).alias("orig_height"), (F.col("image") % 4 == 0).alias("debug_trace"))
    found = blocks.text_blocks(det, with_members=True)
    found = found.withColumn("members", F.when(F.col("image") % 2 == 0, F.col("members")).otherwise(F.array().cast("array<string>")))
    debug = boxes.with_accepted(det.filter("image % 3 = 0"), 0.5).withColumn("score", F.round("score", 0))
    return blocks.overlay_payload(found, sizes, debug)


@query("g1_g2_g3_merge_pairs", f"""WITH {CLEAN} SELECT g.image, g.idx AS g_idx, b.idx AS b_idx, {CENTER} * 10000 + {GAP} AS score,
    {INTER} / greatest(least(g.w * g.h, b.w * b.h), 1) AS overlap,
    {INTER} / greatest(least(g.w * g.h, b.w * b.h), 1) >= 0.9 AND (contains(g.text, b.text) OR contains(b.text, g.text)) AS nested
    FROM clean g JOIN clean b ON g.image = b.image AND g.idx < b.idx WHERE {CAN}""")
def g1(spark, d):
    return boxes.merge_pairs(_clean(spark, d), 20, 15)


@query("f1_box_measures", f"""WITH {DET} SELECT g.image, g.idx, g.w * g.h AS area, {INTER} AS inter, {GAP} AS gap, {CENTER} AS center,
    {INTER} / greatest(least(g.w * g.h, b.w * b.h), 1) AS overlap FROM det g JOIN det b ON g.image = b.image AND b.idx = g.idx + 1""")
def f1(spark, d):
    det = views.detections(spark, d).select("image", "idx", F.struct(*"xywh").alias("g"))
    nxt = det.select("image", (F.col("idx") - 1).alias("idx"), F.col("g").alias("b"))
    g, b = F.col("g"), F.col("b")
    return det.join(nxt, ["image", "idx"]).select(
        "image", "idx", geo.area(g).alias("area"), geo.intersection_area(g, b).alias("inter"), geo.horizontal_gap(g, b).alias("gap"),
        geo.center_distance(g, b).alias("center"), geo.overlap_of_smaller(g, b).alias("overlap"))


@query("f3_polygon_measures", f"WITH {DET} SELECT image, idx, (w * h + w * (h + 3)) / 2 AS area, sqrt(w * w + 9) AS bottom, w * (h + 3) AS crossed FROM det")
def f3(spark, d):
    det = views.detections(spark, d)
    x, y, w, h = (F.col(c) for c in "xywh")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    quad = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h + 3))
    p = det.select("image", "idx", quad.alias("q"))
    q = F.col("q")
    return p.select("image", "idx", geo.shoelace_area(q).alias("area"), geo.point_distance(q[2], q[3]).alias("bottom"), geo.cross(q[0], q[1], q[3]).alias("crossed"))


POINTS4 = "list_transform([1, 2, 3, 4], lambda i: printf('%.4f,%.4f', {0}[i].x, {0}[i].y))"


@query("f4_corner_orders", f"""WITH {DET},
    turned AS (SELECT *, w / 2 AS dx, h / 2 AS dy, cos(radians(part % 90 + 0.5::DOUBLE)) AS ux, sin(radians(part % 90 + 0.5::DOUBLE)) AS uy FROM det),
    corners AS (SELECT image, idx, list_transform([[-1, -1], [1, -1], [1, 1], [-1, 1]], lambda c: struct_pack(x := x + c[1] * ux * dx - c[2] * uy * dy, y := y + c[1] * uy * dx + c[2] * ux * dy)) AS p FROM turned),
    shuffled AS (SELECT image, idx, [p[3], p[1], p[4], p[2]] AS p FROM corners),
    mean AS (SELECT *, (p[1].x + p[2].x + p[3].x + p[4].x) / 4 AS cx, (p[1].y + p[2].y + p[3].y + p[4].y) / 4 AS cy FROM shuffled),
    angles AS (SELECT image, idx, p, list_sort(list_transform(p, lambda q, i: struct_pack(a := atan2(q.y - cy, q.x - cx), i := i, x := q.x, y := q.y))) AS s FROM mean),
    firsts AS (SELECT *, list_position(list_transform(s, lambda q: q.x + q.y), list_min(list_transform(s, lambda q: q.x + q.y))) AS f FROM angles),
    clock AS (SELECT image, idx, p, list_concat(s[f:], s[:f - 1]) AS c FROM firsts),
    sides AS (SELECT image, idx, CASE WHEN (c[2].x - c[1].x) * (c[3].y - c[1].y) - (c[2].y - c[1].y) * (c[3].x - c[1].x) < 0 THEN [c[1], c[4], c[3], c[2]] ELSE c END AS c,
        list_sort(list_transform(p, lambda q: struct_pack(k := round(q.x * 10000) / 10000, y := q.y, x := q.x))) AS s FROM clock),
    crops AS (SELECT image, idx, c, [CASE WHEN s[2].y > s[1].y THEN s[1] ELSE s[2] END, CASE WHEN s[4].y > s[3].y THEN s[3] ELSE s[4] END,
        CASE WHEN s[4].y > s[3].y THEN s[4] ELSE s[3] END, CASE WHEN s[2].y > s[1].y THEN s[2] ELSE s[1] END] AS q FROM sides)
    SELECT image, idx, array_to_string({POINTS4.format('c')}, ' ') AS clockwise, array_to_string({POINTS4.format('q')}, ' ') AS crop,
        round(least(sqrt((q[1].x - q[2].x) ** 2 + (q[1].y - q[2].y) ** 2), sqrt((q[1].x - q[4].x) ** 2 + (q[1].y - q[4].y) ** 2)), 6) AS short_side FROM crops""")
def f4(spark, d):
    """Corners of turned rectangles, dealt out of order; half a degree keeps two corners from being equally far up and left."""
    det = views.detections(spark, d)
    turned = geo.rotated_corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.radians(F.col("part") % 90 + 0.5))
    p = det.select("image", "idx", F.array(*[turned[i] for i in (2, 0, 3, 1)]).alias("p"))
    c, q = geo.order_clockwise(F.col("p")), geo.crop_order(F.col("p"))
    return p.select("image", "idx", geo.corners_text(c).alias("clockwise"), geo.corners_text(q).alias("crop"), F.round(geo.short_side(q), 6).alias("short_side"))


@query("f5_crop_size", f"WITH {DET} SELECT image, idx, CAST(greatest(trunc(w), 1) AS INTEGER) AS out_w, CAST(greatest(trunc(h), 1) AS INTEGER) AS out_h FROM det")
def f5(spark, d):
    p = boxes.with_polygon(views.detections(spark, d)).withColumn("s", geo.crop_size(F.col("polygon")))
    return p.select("image", "idx", F.col("s.w").alias("out_w"), F.col("s.h").alias("out_h"))


@query("f6_oriented_rect", f"""WITH {DET} SELECT image, idx, round(x - cos(a) * w / 2 + sin(a) * h / 2, 6) AS x0, round(y - sin(a) * w / 2 - cos(a) * h / 2, 6) AS y0,
    round(w + w * h * 1.5 / (w + h), 6) AS wide FROM (SELECT *, radians(part % 90) AS a FROM det)""", zero=("x0", "y0"))
def f6(spark, d):
    det = views.detections(spark, d)
    c = geo.rotated_corners(*[F.col(k) for k in "xywh"], F.radians(F.col("part") % 90))
    wide = geo.expanded_side(F.col("w"), F.col("w"), F.col("h"), 1.5)
    return det.select("image", "idx", F.round(c[0]["x"], 6).alias("x0"), F.round(c[0]["y"], 6).alias("y0"), F.round(wide, 6).alias("wide"))


def _runs(spark, d):
    det = views.detections(spark, d, int(spark.conf.get("spark.sql.shuffle.partitions")))  # many small sorts, rather than few large ones
    a = readers.stored(blocks.clean_text(det).select("image", "idx", *"xywh", "text", "part"))  # both runs and what is counted of them read it
    return a, views.other_run(a)


IOU = "w * h / nullif(a_area + b_area - w * h, 0)"
PAIRS = CLEAN + ", " + DET_B.replace("FROM det ", "FROM clean ") + f""",
inter AS (
    SELECT a.image, a.idx AS l, b.idx AS r, a.text AS l_text, b.text AS r_text, a.w * a.h AS a_area, b.w * b.h AS b_area,
           greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) AS w, greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS h
    FROM clean a JOIN det_b b ON a.image = b.image),
pairs AS (SELECT image, l, r, {IOU} AS iou, l_text, r_text FROM inter WHERE {IOU} >= 0.5)"""
MATCHES = PAIRS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY iou DESC, l DESC, r DESC) AS rn FROM pairs),
fold AS (
    SELECT image, CAST(0 AS BIGINT) AS rn, CAST([] AS INTEGER[]) AS ls, CAST([] AS INTEGER[]) AS rs FROM (SELECT DISTINCT image FROM ranked)
    UNION ALL
    SELECT f.image, p.rn, CASE WHEN list_contains(f.ls, p.l) OR list_contains(f.rs, p.r) THEN f.ls ELSE list_append(f.ls, p.l) END,
           CASE WHEN list_contains(f.ls, p.l) OR list_contains(f.rs, p.r) THEN f.rs ELSE list_append(f.rs, p.r) END
    FROM fold f JOIN ranked p ON p.image = f.image AND p.rn = f.rn + 1),
chosen AS (SELECT image, max_by(ls, rn) AS ls, max_by(rs, rn) AS rs FROM fold GROUP BY image),
picked AS (SELECT image, unnest(ls) AS l, unnest(rs) AS r, unnest(range(len(ls))) AS rank FROM chosen),
matches AS (SELECT p.image, CAST(p.rank AS INTEGER) AS rank, p.l, p.r, q.iou, q.l_text, q.r_text FROM picked p JOIN pairs q ON q.image = p.image AND q.l = p.l AND q.r = p.r)"""
COUNTERS = MATCHES + """,
images AS (SELECT image FROM clean UNION SELECT image FROM det_b),
counters AS (
    SELECT i.image, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, coalesce(m.n, 0) AS matched, coalesce(m.e, 0) AS exact
    FROM images i LEFT JOIN (SELECT image, count(*) AS n FROM clean GROUP BY image) a ON a.image = i.image
    LEFT JOIN (SELECT image, count(*) AS n FROM det_b GROUP BY image) b ON b.image = i.image
    LEFT JOIN (SELECT image, count(*) AS n, count(*) FILTER (WHERE l_text = r_text) AS e FROM matches GROUP BY image) m ON m.image = i.image)"""


@query("j1_f2_iou_pairs", f"WITH {PAIRS} SELECT image, l, r, round(iou, 9) AS iou FROM pairs")
def j1(spark, d):
    return parity.iou_pairs(*_runs(spark, d)).select("image", "l", "r", F.round("iou", 9).alias("iou"))


@query("j1_iou_pairs_in_strips", f"WITH {PAIRS} SELECT image, l, r, round(iou, 9) AS iou FROM pairs")
def j1_strips(spark, d):
    a = _clean(spark, d)
    return parity.iou_pairs(a, views.other_run(a), cell=64.0).select("image", "l", "r", F.round("iou", 9).alias("iou"))


@query("j2_greedy_match", f"WITH RECURSIVE {MATCHES} SELECT image, rank, l, r, round(iou, 9) AS iou, l_text, r_text FROM matches")
def j2(spark, d):
    return parity.matched_boxes(*_runs(spark, d)).withColumn("iou", F.round("iou", 9))


@query("j3_unmatched", f"""WITH RECURSIVE {MATCHES} SELECT 'left' AS side, image, idx, text FROM clean c WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.image = c.image AND m.l = c.idx)
    UNION ALL SELECT 'right', image, idx, text FROM det_b c WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.image = c.image AND m.r = c.idx)""")
def j3(spark, d):
    a, b = _runs(spark, d)
    return parity.unmatched(a, b, readers.stored(parity.matched_boxes(a, b).select("image", "l", "r")))  # both sides ask for it


@query("a2_parity_counters", f"""WITH RECURSIVE {COUNTERS} SELECT *, CASE WHEN n_left = 0 THEN 1 ELSE exact / n_left END AS exact_of_left,
    CASE WHEN matched = 0 THEN 1 ELSE exact / matched END AS exact_of_pairs FROM counters""")
def a2(spark, d):
    a, b = _runs(spark, d)
    return parity.parity_counters(a, b, parity.matched_boxes(a, b))


@query("a3_mismatches", f"""WITH RECURSIVE {MATCHES} SELECT image, string_agg(l_text || '>' || r_text, ' ' ORDER BY rank) AS texts, count(*) AS n
    FROM matches WHERE l_text <> r_text GROUP BY image""")
def a3(spark, d):
    m = parity.mismatches(parity.matched_boxes(*_runs(spark, d)))
    return m.select("image", F.array_join(F.transform("mismatches", lambda x: F.concat(x["left_text"], F.lit(">"), x["right_text"])), " ").alias("texts"), F.size("mismatches").cast("long").alias("n"))


@query("a17_parity_gate", f"""WITH RECURSIVE {COUNTERS} SELECT count(*) AS images, count(*) FILTER (WHERE NOT (n_left = n_right AND matched = n_left AND exact = matched)) AS failed,
    bool_and(n_left = n_right AND matched = n_left AND exact = matched) AS passed FROM counters""")
def a17(spark, d):
    a, b = _runs(spark, d)
    return parity.parity_gate(parity.parity_counters(a, b, parity.matched_boxes(a, b)))


@query("p15_a16_smoke_gate", f"WITH {CLEAN} SELECT (SELECT count(*) FROM det) AS detections, count(*) AS recognised, count(*) > 0 AS passed FROM clean")
def a16(spark, d):
    det = views.detections(spark, d).agg(F.count("*").alias("detections"))
    return det.crossJoin(_clean(spark, d).agg(F.count("*").alias("recognised"))).withColumn("passed", F.col("recognised") > 0)
