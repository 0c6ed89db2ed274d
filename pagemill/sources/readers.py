"""Readers of logs, dumps, dictionaries and requests, with explicit schemas, and sinks for results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import json_text
from ..operators.ranges import neighbours
from .lines import read_lines  # noqa: F401  one of the readers
from .tables import dropped, scratch, stored  # noqa: F401  used with the readers

POINTS = "array<array<double>>"
DETECTION = f"run string, image string, idx int, polygon {POINTS}, bounds struct<x:double,y:double,width:double,height:double>, text string, score double"
REQUEST = "id int, source string, image_path string, score_thresh double"
DET_MAP = "image_width int, image_height int, input_shape array<int>, pred_shape array<int>, input_values array<float>, values array<float>"
DET_CANDIDATES = (
    f"src_width int, src_height int, pred_width int, pred_height int, items array<struct<index:int,component_bbox:array<int>,contour:{POINTS},mini_box:{POINTS},"
    f"mini_side:double,score_bbox:array<int>,score_mask_pixels:int,score_sum:double,score:double,unclipped_box:{POINTS},scaled_box:{POINTS},accepted:boolean,reject_reason:string>>")
REC_CANDIDATES = (
    "image_width int, image_height int, items array<struct<original_index:int,sorted_index:int,ratio:double,crop_width:int,crop_height:int,"
    f"cls_label:int,cls_score:double,rotated_180:boolean,crop_quad:{POINTS},polygon:{POINTS}>>")
REC_LOGITS = (
    "batch_n int, batch_w int, time_steps int, num_classes int, layout int, input_shape array<int>, output_shape array<int>, items array<struct<index:int,"
    f"original_index:int,ratio:double,polygon:{POINTS},crop_box:{POINTS},crop_width:int,crop_height:int,decoded_text:string,decoded_score:double,image_width:int,"
    "image_height:int,raw_channel_means:array<double>,raw_pixels:array<int>,rec_width:int,input_values:array<float>,values:array<float>>>")


LANGUAGE = "code string, label string"
REPORT = "image long, x double, y double, w double, h double"


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """code, label of a language file: one JSON list of entries."""
    return spark.read.schema(LANGUAGE).json(path, multiLine=True)


def as_points(polygon: Column) -> Column:
    """Points of a list of pairs."""
    return F.transform(polygon, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def normalised_detections(parsed: DataFrame) -> DataFrame:
    """One polygon per detection, whichever shape it came in: a list of points, or a box."""
    b = F.col("bounds")
    boxed = F.when(b.isNotNull(), geo.bounds_polygon(b["x"], b["y"], b["width"], b["height"]))
    return parsed.withColumn("polygon", F.coalesce(as_points(F.col("polygon")), boxed)).drop("bounds")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return normalised_detections(spark.read.schema(DETECTION).json(path))


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dump per file, by one of the schemas above; ``items`` stay nested."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("dump", F.col("_metadata.file_name"))


def dump_items(dumps: DataFrame) -> DataFrame:
    """One row per item of each dump, with its place in the list."""
    rest = [c for c in dumps.columns if c != "items"]
    return dumps.select(*rest, F.posexplode("items").alias("place", "item")).select(*rest, "place", "item.*")


def logit_cells(items: DataFrame, key: str = "original_index") -> DataFrame:
    """item, t, c, p of dumped logits; items whose values do not fill time_steps by num_classes are left out."""
    whole = items.filter((F.col("num_classes") > 0) & (F.size("values") >= F.col("time_steps") * F.col("num_classes")))
    cells = whole.select(F.col(key).alias("item"), "num_classes", "time_steps", F.posexplode("values").alias("k", "v"))
    cells = cells.filter(F.col("k") < F.col("time_steps") * F.col("num_classes"))
    return cells.select("item", F.floor(F.col("k") / F.col("num_classes")).cast("int").alias("t"), (F.col("k") % F.col("num_classes")).alias("c"), F.col("v").cast("double").alias("p"))


def map_pixels(maps: DataFrame, key: str = "dump") -> DataFrame:
    """map_id, px, py, p of dumped maps; the last two numbers of ``pred_shape`` are height and width, and values beyond them are left out."""
    h, w = F.element_at("pred_shape", -2), F.element_at("pred_shape", -1)
    cells = maps.filter((F.size("pred_shape") >= 2) & (h > 0) & (w > 0)).select(F.col(key).alias("map_id"), h.alias("h"), w.alias("w"), F.posexplode("values").alias("k", "v"))
    cells = cells.filter(F.col("k") < F.col("h") * F.col("w"))
    return cells.select("map_id", (F.col("k") % F.col("w")).alias("px"), F.floor(F.col("k") / F.col("w")).cast("int").alias("py"), F.col("v").cast("double").alias("p"))


def dictionary(entries: DataFrame) -> DataFrame:
    """class_idx, ch from rows (pos, ch): empty entries go, the rest is numbered anew from 0, and a space is added at the end if there is none.

    A dictionary of a few thousand rows; one without any other entry than spaces is an error.
    """
    kept = entries.filter(F.col("ch").isNotNull() & (F.col("ch") != ""))
    numbered = kept.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("class_idx"), "ch")
    space = numbered.agg(F.count("*").alias("n"), F.count_if(F.col("ch") == " ").alias("spaces"), F.count_if(F.trim("ch") != "").alias("real"))
    checked = space.select(F.col("n").cast("int").alias("class_idx"), F.lit(" ").alias("ch"), "spaces", F.assert_true(F.col("real") > 0, F.lit("the dictionary has no entry")).alias("ok"))
    return numbered.unionByName(checked.filter((F.col("spaces") == 0) & F.col("ok").isNull()).select("class_idx", "ch"))


def text_dictionary(lines: DataFrame) -> DataFrame:
    """A dictionary of text lines (line_no, value), each trimmed."""
    return dictionary(lines.select(F.col("line_no").alias("pos"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("ch")))


def config_dictionary(documents: DataFrame) -> DataFrame:
    """A dictionary of JSON documents (value): ``character_dict`` at the top or under ``PostProcess``."""
    parsed = F.from_json("value", "character_dict array<string>, PostProcess struct<character_dict:array<string>>")
    listed = F.coalesce(parsed["character_dict"], parsed["PostProcess"]["character_dict"])
    return dictionary(documents.select(F.posexplode(listed).alias("pos", "ch")))


def parsed_requests(lines: DataFrame) -> DataFrame:
    """id, source, image_path, score_thresh (0.5 unless given), error of request lines; a bad line or a missing field has id -1. Batch or stream."""
    r = F.from_json("value", REQUEST)
    missing = F.when(r["id"].isNull(), "id").when(r["source"].isNull(), "source").when(r["image_path"].isNull(), "image_path")
    bad = ~F.trim("value").startswith("{") | F.expr("try_parse_json(value)").isNull()
    error = F.when(bad, "not a request").when(missing.isNotNull(), F.concat(F.lit("missing "), missing))
    rows = lines.select(r.alias("r"), error.alias("error"))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select(
        F.coalesce(good(F.col("r.id")), F.lit(-1)).alias("id"), good(F.col("r.source")).alias("source"), good(F.col("r.image_path")).alias("image_path"),
        good(F.coalesce("r.score_thresh", F.lit(0.5))).alias("score_thresh"), "error")


def _step(reached: DataFrame, asked: DataFrame, whole: DataFrame, keys: list[str], field: str) -> DataFrame:
    """One coordinate further: for each of ``asked`` (stage and own coordinates up to ``field``) the values of ``keys`` and ``field`` that are nearest so far.

    ``reached`` is the same up to the coordinate before: own coordinates and ``found``, the
    few ways there that are equally near (each coordinate may tie to either side).
    """
    own = [f"own_{k}" for k in keys[1:]]
    ways = asked.join(reached, ["stage", *own]) if own else asked.withColumn("found", F.array(F.struct(F.col("stage").alias("stage"))))
    ways = ways.select(*asked.columns, F.explode("found").alias("way")).select(*asked.columns, *[F.col(f"way.{k}").alias(f"at_{k}") for k in keys])
    values = ways.select(*[F.col(f"at_{k}").alias(k) for k in keys], F.col(f"own_{field}").alias(field)).distinct()
    beside = neighbours(values, whole.select(*keys, field), keys, field)
    d = F.least(F.col(field) - F.col("low"), F.col("high") - F.col(field))
    near = F.array_distinct(F.array_compact(F.array(F.when(F.col(field) - F.col("low") == d, F.col("low")), F.when(F.col("high") - F.col(field) == d, F.col("high")))))
    sides = beside.select(*[F.col(k).alias(f"at_{k}") for k in keys], F.col(field).alias(f"own_{field}"), d.alias("d"), near.alias("near"))
    joined = ways.join(sides, [*[f"at_{k}" for k in keys], f"own_{field}"])
    found = F.transform("near", lambda v: F.struct(*[F.col(f"at_{k}").alias(k) for k in keys], v.alias(field)))
    grouped = joined.groupBy(*asked.columns).agg(F.collect_list(F.struct("d", found.alias("to"))).alias("all"))  # at most 8 of them
    least = F.array_min(F.transform("all", lambda x: x["d"]))
    best = grouped.withColumn("least", least).select(*asked.columns, F.array_distinct(F.flatten(F.transform(F.filter("all", lambda x: x["d"] == F.col("least")), lambda x: x["to"]))).alias("found"))
    out = stored(best)
    dropped(beside)
    return out


def nearest_dumps(dumps: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, nearest: the candidate of the same stage with the least |dx|, then |dy|, |dw|, |dh|, then name.

    Both sides: name, d (stage, x, y, w, h). Candidates whose numbers do not parse come
    last, by name; a dump whose own numbers do not parse gets the first name of its stage.
    Dumps of a stage without candidates are left out, repeated names are one dump. Nothing
    lists the pairs of a stage: one coordinate after another is searched to either side,
    among distinct values that lie in ranges (see ``operators.ranges``).
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in "xywh"])
    flat = lambda df, name: df.select(F.col("name").alias(name), "d.stage", *[f"d.{k}" for k in "xywh"]).distinct().withColumn("whole", whole)
    there, asked = stored(flat(candidates, "other")), stored(flat(dumps, "name"))
    own = asked.filter("whole").select("name", "stage", *[F.col(k).alias(f"own_{k}") for k in "xywh"])
    keys, reached, past = ["stage"], None, []
    for field in "xywh":
        prefix = own.select("stage", *[f"own_{k}" for k in keys[1:]], f"own_{field}").distinct()
        reached = _step(reached, prefix, there.filter("whole"), keys, field)
        past.append(reached)
        keys = [*keys, field]
    dropped(*past[:-1])
    names = there.filter("whole").groupBy(*keys).agg(F.min("other").alias("other"))
    near = reached.select(F.col("stage").alias("of"), *[f"own_{k}" for k in "xywh"], F.explode("found").alias("f")).select("of", *[f"own_{k}" for k in "xywh"], "f.*").join(names, keys)
    near = near.groupBy(F.col("of").alias("stage"), *[f"own_{k}" for k in "xywh"]).agg(F.min("other").alias("near"))
    near = own.join(near, ["stage", *[f"own_{k}" for k in "xywh"]]).select("name", "near")
    first = there.groupBy("stage").agg(F.min(F.when(F.col("whole"), F.col("other"))).alias("of_whole"), F.min("other").alias("of_all"))
    rest = asked.select("name", "stage", F.col("whole").alias("parsed")).join(first, "stage")
    rest = rest.select("name", F.when(F.col("parsed"), F.coalesce("of_whole", "of_all")).otherwise(F.col("of_all")).alias("rest"))
    return rest.join(near, "name", "left").select("name", F.coalesce("near", "rest").alias("nearest"))


def detections_json(detections: DataFrame, with_debug: bool = False) -> DataFrame:
    """image, json: polygon and text of an image's detections in order, coordinates with six decimals.

    ``accepted``, where there is such a column, says which are detections proper.
    ``with_debug`` adds all of them as ``debug_detections`` with score and acceptance.
    """
    fixed = lambda c: F.format_string("%.6f", c.cast("double"))
    corners = F.transform(geo.bounds_polygon(*[F.col(c) for c in "xywh"]), lambda q: F.concat(F.lit("["), fixed(q["x"]), F.lit(","), fixed(q["y"]), F.lit("]")))
    head = F.concat(F.lit('{"polygon":['), F.array_join(corners, ","), F.lit('],"text":'), json_text(F.col("text")))
    accepted = F.col("accepted") if "accepted" in detections.columns else F.lit(True)
    score = F.coalesce("score", F.lit(0.0)) if "score" in detections.columns else F.lit(0.0)
    tail = F.concat(F.lit(',"score":'), fixed(score), F.lit(',"accepted":'), accepted.cast("string"), F.lit("}"))
    rows = detections.select("image", F.struct("idx", accepted.alias("accepted"), F.concat(head, F.lit("}")).alias("plain"), F.concat(head, tail).alias("debug")).alias("d"))
    listed = rows.groupBy("image").agg(F.sort_array(F.collect_list("d")).alias("d"))
    plain = F.array_join(F.transform(F.filter("d", lambda x: x["accepted"]), lambda x: x["plain"]), ",")
    parts = [F.lit('{"detections":['), plain, F.lit("]")]
    if with_debug:
        parts += [F.lit(',"debug_detections":['), F.array_join(F.transform("d", lambda x: x["debug"]), ","), F.lit("]")]
    return listed.select("image", F.concat(*parts, F.lit("}")).alias("json"))


def write_report(rows: DataFrame, path: str, by: str = "run") -> None:
    """One JSON row per image, in a folder per run."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def read_report(spark: SparkSession, path: str, schema: str = REPORT, by: str = "run int") -> DataFrame:
    """The rows of ``write_report``, their run taken from the folders."""
    return spark.read.schema(f"{schema}, {by}").json(path)
