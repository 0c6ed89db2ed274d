"""Queries over sessions and requests (as batches), readers of dumps and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.boxes import union_box, with_accepted, with_bounds
from ..operators.planning import ratio_order
from ..sources import readers, views
from ..sources.views import DET, LOGITS, SESSIONS
from ..streaming import sessions
from .registration import registration

QUERIES, SQL, query = registration()


CURRENT = SESSIONS + """, m AS (SELECT *, max(CASE WHEN kind = 'capture' THEN gen END) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS newest FROM sessions)"""


@query("r1_stale_results", f"WITH {CURRENT} SELECT session, seq, gen FROM m WHERE kind = 'result' AND gen = newest")
def r1(spark, d):
    return sessions.current_results(views.sessions(spark, d)).select("session", "seq", "gen")


@query("r2_active_request", f"WITH {CURRENT} SELECT session, count(*) AS replies FROM m WHERE kind = 'result' AND gen = newest GROUP BY session")
def r2(spark, d):
    kind = F.when(F.col("kind") == "capture", "request").otherwise("reply")
    return sessions.active_replies(views.sessions(spark, d).withColumn("kind", kind)).groupBy("session").agg(F.count("*").alias("replies"))


@query("r3_elapsed", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(event_id % 90 + 0.5::DOUBLE) AS BIGINT) END AS elapsed FROM events")
def r3(spark, d):
    i = F.col("event_id")
    start = F.when(i % 4 != 0, (i * 10).cast("double"))
    now = F.when(i % 5 == 0, i * 10 - 3.0).otherwise(i * 10 + i % 90 + 0.25)
    return views.table(spark, d, "events").select(i.alias("id"), sessions.elapsed_ms(start, now).alias("elapsed"))


REQUESTS = "CASE event_id % 5 WHEN 0 THEN 'oops' WHEN 1 THEN '{\"id\":' || event_id || ',\"source\":\"ch\"}' WHEN 2 THEN '{\"id\":' || event_id || ',\"source\":\"en\",\"image_path\":\"a\",\"score_thresh\":0.25}' ELSE '{\"id\":' || event_id || ',\"source\":\"en\",\"image_path\":\"b\"}' END"


def _requests(spark, d):
    return views.table(spark, d, "events").select(F.expr(REQUESTS).alias("value"))


@query("s9_request_lines", """SELECT CASE WHEN event_id % 5 < 2 THEN -1 ELSE event_id END AS id, CASE WHEN event_id % 5 >= 2 THEN 'en' END AS source, CASE WHEN event_id % 5 = 2 THEN 'a' WHEN event_id % 5 > 2 THEN 'b' END AS image_path,
    CAST(CASE WHEN event_id % 5 = 2 THEN 0.25 WHEN event_id % 5 > 2 THEN 0.5 END AS DOUBLE) AS score_thresh, CASE event_id % 5 WHEN 0 THEN 'not a request' WHEN 1 THEN 'missing image_path' END AS error FROM events""")
def s9(spark, d):
    return readers.parsed_requests(_requests(spark, d))


@query("r4_request_split", "SELECT 'requests' AS part, count(*) FILTER (WHERE event_id % 5 >= 2) AS n FROM events UNION ALL SELECT 'errors', count(*) FILTER (WHERE event_id % 5 < 2) FROM events")
def r4(spark, d):
    good, bad = sessions.split_requests(_requests(spark, d))
    n = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return n(good, "requests").unionByName(n(bad, "errors"))


@query("s5_detection_shapes", f"WITH {DET} SELECT image, idx, x, y, w, h FROM det")
def s5(spark, d):
    det = views.detections(spark, d)
    box = F.to_json(F.struct(F.col("image").cast("string").alias("image"), "idx", F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height")).alias("bounds")))
    x, y, w, h = (F.col(c) for c in "xywh")
    points = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    polygon = F.to_json(F.struct(F.col("image").cast("string").alias("image"), "idx", points.alias("polygon")))
    lines = det.select(F.when(F.col("idx") % 2 == 0, box).otherwise(polygon).alias("value"))
    parsed = readers.normalised_detections(lines.select(F.from_json("value", readers.DETECTION).alias("r")).select("r.*"))
    return with_bounds(parsed).select(F.col("image").cast("long").alias("image"), "idx", *"xywh")


@query("s6_logit_dump", f"WITH {LOGITS} SELECT item, t, c, round(p, 5) AS p FROM logits WHERE t < 8", zero=("p",))
def s6(spark, d):
    e = views.table(spark, d, "embeddings")
    item = F.struct(F.lit(0).alias("index"), F.col("vec_id").cast("int").alias("original_index"), F.col("embedding").alias("values"))
    dump = e.select(F.to_json(F.struct(F.lit(8).alias("time_steps"), F.lit(8).alias("num_classes"), F.array(item).alias("items"))).alias("value"))
    parsed = dump.select(F.from_json("value", readers.REC_LOGITS).alias("r")).select("r.*")
    return readers.logit_cells(readers.dump_items(parsed)).select(F.col("item").cast("long").alias("item"), "t", "c", F.round("p", 5).alias("p"))


@query("s6_candidate_dumps", f"""WITH {DET} SELECT image, CAST(idx - 1 AS INTEGER) AS index, w AS mini_side, CAST(x + w AS INTEGER) AS right, 4 AS points, CAST(y AS INTEGER) AS top, CAST(w AS INTEGER) AS score_mask_pixels,
    score * 2 AS score_sum, score, x + 1 AS unclipped_x, y + h AS scaled_y, score >= 0.5 AS accepted, CASE WHEN score >= 0.5 THEN '' ELSE 'score' END AS reject_reason FROM det""")
def s6_candidates(spark, d):
    """Dumps of detector candidates, one of each image, with all their fields."""
    x, y, w, h = (F.col(c) for c in "xywh")
    whole = lambda c: c.cast("int")
    quad = lambda a, b: F.array(F.array(a, b), F.array(a + w, b), F.array(a + w, b + h), F.array(a, b + h))
    box = F.array(whole(x), whole(y), whole(x + w), whole(y + h))
    item = F.struct(
        (F.col("idx") - 1).alias("index"), box.alias("component_bbox"), quad(x, y).alias("contour"), quad(x, y).alias("mini_box"), w.alias("mini_side"), box.alias("score_bbox"),
        whole(w).alias("score_mask_pixels"), (F.col("score") * 2).alias("score_sum"), "score", quad(x + 1, y).alias("unclipped_box"), quad(x, y).alias("scaled_box"),
        (F.col("score") >= 0.5).alias("accepted"), F.when(F.col("score") >= 0.5, "").otherwise("score").alias("reject_reason"))
    dumps = views.detections(spark, d).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("idx", item.alias("item")))).alias("items"))
    text = F.to_json(F.struct(F.lit(800).alias("src_width"), F.lit(736).alias("src_height"), F.transform("items", lambda i: i["item"]).alias("items")))
    parsed = dumps.select("image", F.from_json(text, readers.DET_CANDIDATES).alias("r")).select("image", "r.*")
    i = readers.dump_items(parsed)
    return i.select(
        "image", "index", "mini_side", i["component_bbox"][2].alias("right"), F.size("contour").alias("points"), i["score_bbox"][1].alias("top"), "score_mask_pixels", "score_sum", "score",
        i["unclipped_box"][0][0].alias("unclipped_x"), i["scaled_box"][2][1].alias("scaled_y"), "accepted", "reject_reason")


@query("s6_rec_candidate_dumps", f"""WITH {DET} SELECT image, CAST(idx - 1 AS INTEGER) AS original_index, CAST(row_number() OVER (PARTITION BY image ORDER BY w / h, idx) - 1 AS INTEGER) AS sorted_index, w / h AS ratio,
    CAST(w AS INTEGER) AS crop_width, part % 2 AS cls_label, score AS cls_score, part % 2 = 1 AS rotated_180, x AS quad_x, y + h AS polygon_y FROM det""")
def s6_rec_candidates(spark, d):
    """Dumps of recogniser candidates, in original order with their place in order of ratio."""
    x, y, w, h = (F.col(c) for c in "xywh")
    quad = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    ranked = ratio_order(views.detections(spark, d).withColumn("ratio", w / h))
    item = F.struct(
        (F.col("idx") - 1).alias("original_index"), "sorted_index", "ratio", w.cast("int").alias("crop_width"), h.cast("int").alias("crop_height"), (F.col("part") % 2).cast("int").alias("cls_label"),
        F.col("score").alias("cls_score"), (F.col("part") % 2 == 1).alias("rotated_180"), quad.alias("crop_quad"), quad.alias("polygon"))
    dumps = ranked.groupBy("image").agg(F.sort_array(F.collect_list(item)).alias("items"))
    text = F.to_json(F.struct(F.lit(800).alias("image_width"), F.lit(736).alias("image_height"), "items"))
    i = readers.dump_items(dumps.select("image", F.from_json(text, readers.REC_CANDIDATES).alias("r")).select("image", "r.*"))
    return i.select(
        "image", "original_index", "sorted_index", "ratio", "crop_width", F.col("cls_label").cast("long").alias("cls_label"), "cls_score", "rotated_180",
        i["crop_quad"][0][0].alias("quad_x"), i["polygon"][3][1].alias("polygon_y"))


@query("s6_map_dumps", f"WITH {LOGITS} SELECT item AS map_id, CAST(c AS INTEGER) AS px, CAST(t AS INTEGER) AS py, round(p, 5) AS p FROM logits WHERE t < 8", zero=("p",))
def s6_maps(spark, d):
    """Dumps of detector maps, shaped (1, 1, height, width), as pixels."""
    e = views.table(spark, d, "embeddings")
    side = F.lit(8)
    shape = F.array(F.lit(1), F.lit(1), side, side)
    text = F.to_json(F.struct(side.alias("image_width"), side.alias("image_height"), shape.alias("input_shape"), shape.alias("pred_shape"), F.col("embedding").alias("values")))
    parsed = e.select("vec_id", F.from_json(text, readers.DET_MAP).alias("r")).select("vec_id", "r.*")
    return readers.map_pixels(parsed, "vec_id").withColumn("p", F.round("p", 5))


@query("s7_dictionary", r"""WITH l AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark), w AS (SELECT unicode(ch) AS pos, regexp_replace(ch, '\s', '') AS ch FROM l WHERE ch <> ''),
    k AS (SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS class_idx, ch FROM w WHERE ch <> '')
    SELECT * FROM k UNION ALL SELECT CAST(count(*) AS INTEGER), ' ' FROM k HAVING count(*) FILTER (WHERE ch = ' ') = 0""")
def s7(spark, d):
    """The characters of the benchmark as lines of a dictionary: as many as there are characters, however much text."""
    b = views.table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).filter("ch <> ''").distinct()
    return readers.text_dictionary(b.select(F.ascii("ch").alias("line_no"), F.concat(F.lit(" "), "ch", F.lit("\t")).alias("value")))


NAMES = "'det_crop_' || (l_partkey % 90) || '_' || (l_suppkey % 50) || '_' || CAST(l_quantity AS INTEGER) || 'x16'"
OTHER_NAMES = "'sidecar_det_crop_' || (p_partkey % 97) || '_' || (p_size % 40) || '_' || (p_size % 30) || 'x16'"


@query("j6_f13_nearest_dump", f"""WITH n AS (SELECT DISTINCT {NAMES} AS name, CAST(l_partkey % 90 AS INTEGER) AS x, CAST(l_suppkey % 50 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) AS w FROM lineitem),
    o AS (SELECT DISTINCT {OTHER_NAMES} AS name, CAST(p_partkey % 97 AS INTEGER) AS x, CAST(p_size % 40 AS INTEGER) AS y, CAST(p_size % 30 AS INTEGER) AS w FROM part),
    d AS (SELECT n.x, min(abs(o.x - n.x)) AS d FROM (SELECT DISTINCT x FROM n) n, (SELECT DISTINCT x FROM o) o GROUP BY n.x),
    s AS (SELECT x, x - d AS at FROM d UNION SELECT x, x + d FROM d)
    SELECT n.name, min_by(o.name, (abs(o.y - n.y), abs(o.w - n.w), o.name)) AS nearest FROM n JOIN s ON s.x = n.x JOIN o ON o.x = s.at GROUP BY n.name""")
def j6(spark, d):
    named = lambda df, e: df.select(F.expr(e).alias("name")).distinct().withColumn("d", tx.dump_name(F.col("name")))
    return readers.nearest_dumps(named(views.table(spark, d, "lineitem"), NAMES), named(views.table(spark, d, "part"), OTHER_NAMES))


POINT = "'[' || printf('%.6f', {0}) || ',' || printf('%.6f', {1}) || ']'"
CORNERS = " || ',' || ".join(POINT.format(a, b) for a, b in (("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h")))
HEAD = f"""'{{"polygon":[' || {CORNERS} || '],"text":' || to_json(text)"""


@query("k1_detections_json", f"""WITH {DET}, d AS (SELECT image, idx, score >= 0.5 AS accepted, score, {HEAD} AS head FROM det)
    SELECT image, '{{"detections":[' || coalesce(string_agg(head || '}}', ',' ORDER BY idx) FILTER (WHERE accepted), '') || '],"debug_detections":[' ||
        string_agg(head || ',"score":' || printf('%.6f', score) || ',"accepted":' || accepted || '}}', ',' ORDER BY idx) || ']}}' AS json FROM d GROUP BY image""")
def k1(spark, d):
    return readers.detections_json(with_accepted(views.detections(spark, d), 0.5), with_debug=True)


@query("k3_report", f"WITH {DET} SELECT image, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(image % 2 AS INTEGER) AS run FROM det GROUP BY image")
def k3(spark, d):
    """A report of one JSON row per image, in a folder per run, written and read again."""
    path = f"{readers.scratch(spark)}/report"
    readers.write_report(union_box(views.detections(spark, d)).withColumn("run", (F.col("image") % 2).cast("int")), path)
    return readers.read_report(spark, path)
