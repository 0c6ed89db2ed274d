"""Readers on real files, streaming rules against their batch form, and expressions without SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry as geo
from pagemill.functions import text
from pagemill.operators import logs, routing
from pagemill.sources import readers
from pagemill.streaming import sessions


def test_log_file_round(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        'noise\n12:00 [FFI_BENCH] {"image":"a.png","detection_count":7,"elapsed_ms":[1]}\n'
        '[FFI_BENCH] {"image":"a.png","detection_count":7,"elapsed_ms":[10,12,11]}\n[FFI_BENCH] {"image":"b.png","detection_count":1,"elapsed_ms":[]}\n')
    lines = readers.read_lines(spark, str(tmp_path))
    got = {r.image: r for r in logs.scan_bench(lines).collect()}
    assert got["a.png"].elapsed_ms == [10, 12, 11] and got["a.png"].error is None
    assert got["b.png"].error == "no samples"


@pytest.mark.parametrize("current, want", [((7, [110, 120, 125]), "ok"), ((6, [1, 1, 1]), "count changed"), ((7, [130, 140, 150]), "slower")])
def test_guard(spark, current, want):
    bench = lambda n, ms: logs.summarise(spark.createDataFrame([(0, "x/test.png", n, [float(v) for v in ms])], "run int, image string, detection_count int, elapsed_ms array<double>"))
    assert logs.guard(bench(7, [100, 110, 120]), bench(*current)).first().verdict == want


def test_indented_profile_line_is_stripped_first(spark):
    lines = spark.createDataFrame([(1, "   run_pipeline profile a=1, b=x=y, a=2,")], "line_no int, value string")
    entry = logs.profile_entries(logs.scan_profile(lines)).first()
    assert entry.raw == "a=1, b=x=y, a=2," and entry.fields == {"a": "2,", "b": "x=y,"}


def test_tab_indented_lines_are_kept(spark):
    lines = spark.createDataFrame([(1, "\t run_pipeline profile a=1\t"), (2, '\t[FFI_BENCH] {"image":"a.png","detection_count":1,"elapsed_ms":[2]}')], "line_no int, value string")
    assert [r.raw for r in logs.scan_profile(lines).collect()] == ["a=1"]
    none = spark.createDataFrame([], "prepared string, original string")
    assert [(r.family, r.image) for r in logs.scan_prefixed(lines, none).collect()] == [("ffi", "a.png")]


@pytest.mark.parametrize("value, why", [("noise", "no benchmark record"), ("[FFI_BENCH] oops", "not a record"), ('[FFI_BENCH] {"image":"a","elapsed_ms":[]}', "no samples")])
def test_a_log_without_good_records_is_an_error(spark, value, why):
    with pytest.raises(ValueError, match=why):
        logs.checked_bench(logs.scan_bench(spark.createDataFrame([(1, value)], "line_no int, value string")))


def test_language_file(spark, tmp_path):
    (tmp_path / "langs.json").write_text('[\n  { "code": "ch", "label": "Chinese" },\n  { "code": "en", "label": "English" }\n]\n')
    assert [tuple(r) for r in readers.read_languages(spark, str(tmp_path)).collect()] == [("ch", "Chinese"), ("en", "English")]


def test_detections_json_is_written_with_six_decimals(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.5, 4.0, 'a"b', 0.25, False), (1, 2, 0.0, 0.0, 1.0, 1.0, "c", 0.9, True), (2, 1, 0.0, 0.0, 1.0, 1.0, None, 0.1, False)],
        "image int, idx int, x double, y double, w double, h double, text string, score double, accepted boolean")
    plain = {r.image: r.json for r in readers.detections_json(rows).collect()}
    assert plain[1] == '{"detections":[{"polygon":[[0.000000,0.000000],[1.000000,0.000000],[1.000000,1.000000],[0.000000,1.000000]],"text":"c"}]}'
    assert plain[2] == '{"detections":[]}'
    debug = json.loads({r.image: r.json for r in readers.detections_json(rows, with_debug=True).collect()}[1])
    assert [(d["text"], d["score"], d["accepted"]) for d in debug["debug_detections"]] == [('a"b', 0.25, False), ("c", 0.9, True)]
    assert debug["debug_detections"][0]["polygon"][2] == [4.5, 6.0]


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0, 0), (2, 0.5, 1.0, 2.0, 3.0, 1)], "image long, x double, y double, w double, h double, run int")
    readers.write_report(rows, str(tmp_path / "r"))
    assert sorted(tuple(r) for r in readers.read_report(spark, str(tmp_path / "r")).collect()) == sorted(tuple(r) for r in rows.collect())


def test_nearest_dumps_against_brute_force(spark):
    rng = random.Random(4)
    name = lambda stage, p: f"{stage}_{p[0]}_{p[1]}_{p[2]}x{p[3]}"
    some = lambda n, stage: {name(stage, [rng.randrange(12) for _ in range(4)]) for _ in range(n)}
    asked = some(80, "det_crop") | some(20, "rec_crop") | {"det_crop_a_1_2x3", "cls_crop_1_1_1x1", "odd_crop_1_2_3x4"}
    there = {f"sidecar_{x}" for x in some(40, "det_crop") | some(3, "rec_crop")} | {"sidecar_det_crop_x_y_1x1", "sidecar_odd_crop_1", "sidecar_odd_crop_0_b_1x2"}

    def parsed(x):
        parts = x.removeprefix("sidecar_").split("_")
        try:
            w, h = map(int, parts[4].split("x", 1))
            return "_".join(parts[:2]), (int(parts[2]), int(parts[3]), w, h)
        except (ValueError, IndexError):
            return "_".join(parts[:2]), None

    want = {}
    for a in asked:
        stage, p = parsed(a)
        own = [(parsed(b)[1], b) for b in there if parsed(b)[0] == stage]
        far = (10**9,) * 4
        if own:
            want[a] = min((tuple(abs(u - v) for u, v in zip(q, p, strict=True)) if q and p else far, b) for q, b in own)[1]
    table = lambda names: spark.createDataFrame([(x,) for x in sorted(names)], "name string").withColumn("d", text.dump_name(F.col("name")))
    assert {r.name: r.nearest for r in readers.nearest_dumps(table(asked), table(there)).collect()} == want


def test_detections_of_either_shape(spark, tmp_path):
    rows = [{"image": "i", "idx": 1, "polygon": [[0, 0], [5, 0], [5, 2], [0, 2]], "text": "a"}, {"image": "i", "idx": 2, "bounds": {"x": 0, "y": 0, "width": 5, "height": 2}, "text": "b"}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    a, b = readers.read_detections(spark, str(tmp_path)).orderBy("idx").collect()
    assert a.polygon == b.polygon


def test_dump_items_and_dictionary(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"time_steps": 2, "num_classes": 2, "items": [{"original_index": 4, "values": [0.5, 1, 2, 3]}, {"original_index": 5, "values": [1]}]}, indent=1))
    cells = readers.logit_cells(readers.dump_items(readers.read_dump(spark, str(tmp_path), readers.REC_LOGITS))).orderBy("t", "c").collect()
    assert [tuple(r) for r in cells] == [(4, 0, 0, 0.5), (4, 0, 1, 1.0), (4, 1, 0, 2.0), (4, 1, 1, 3.0)]
    doc = spark.createDataFrame([('{"PostProcess":{"character_dict":["a","","b"]}}',)], "value string")
    assert [tuple(r) for r in readers.config_dictionary(doc).orderBy("class_idx").collect()] == [(0, "a"), (1, "b"), (2, " ")]


def test_dictionary_without_entries_is_an_error(spark):
    with pytest.raises(Exception, match="no entry"):
        readers.dictionary(spark.createDataFrame([(1, "")], "pos int, ch string")).collect()


def test_corner_orders(spark):
    q = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    r = spark.range(1).select(
        geo.order_clockwise(q((10, 5), (0, 0), (10, 0), (0, 5))).alias("a"), geo.crop_order(q((10, 5), (0, 0), (10, 0), (0, 5))).alias("b"),
        geo.point_in_quad(F.lit(5.0), F.lit(2.0), q((0, 0), (10, 0), (10, 5), (0, 5))).alias("inside"), geo.point_in_quad(F.lit(11.0), F.lit(2.0), q((0, 0), (10, 0), (10, 5), (0, 5))).alias("outside")).first()
    want = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)]
    assert [tuple(p) for p in r.a] == want and [tuple(p) for p in r.b] == want and r.inside and not r.outside


@pytest.mark.parametrize("code, want", [("ch_tra", "PP-OCRv5_server_rec"), ("sa", "devanagari_PP-OCRv5_mobile_rec"), ("ru", "eslav_PP-OCRv5_mobile_rec"), ("ku", "latin_PP-OCRv5_mobile_rec"), (" ", "en_PP-OCRv5_mobile_rec")])
def test_routes(spark, code, want):
    assert routing.routed(spark.createDataFrame([(code,)], "lang string")).first().rec == want


def _events(spark):
    rows = [(1, 1, "capture", 1), (1, 2, "result", 1), (1, 3, "capture", 2), (1, 4, "result", 1), (1, 5, "result", 2), (2, 6, "result", 1)]
    df = spark.createDataFrame(rows, "session long, seq long, kind string, gen long")
    return df.select("session", F.timestamp_seconds("seq").alias("ts"), "seq", "kind", "gen")


def test_stale_results_stream_equals_batch(spark, tmp_path):
    events = _events(spark)
    want = {r.seq for r in sessions.current_results(events).collect()}
    assert want == {2, 5}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.stream_current_results(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.seq for r in spark.sql("select seq from fresh").collect()} == want


def test_stale_results_stream_over_several_batches(spark, tmp_path):
    """One file a batch: the state outlives batches, and a run over what is there ends."""
    events = _events(spark)
    for k in range(1, 7):
        events.filter(F.col("seq") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = sessions.stream_current_results(source).writeStream.format("memory").queryName("fresh_parts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert {r.seq for r in spark.sql("select seq from fresh_parts").collect()} == {2, 5}


def test_active_replies_stream_equals_batch(spark, tmp_path):
    events = _events(spark).withColumn("kind", F.when(F.col("kind") == "capture", "request").otherwise("reply"))
    want = {r.seq for r in sessions.active_replies(events).collect()}
    assert want == {2, 5}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.stream_active_replies(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("replies").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.seq for r in spark.sql("select seq from replies").collect()} == want


def test_elapsed_stream_equals_batch(spark, tmp_path):
    ids = spark.createDataFrame([(1, 1_000, 1_250), (2, 2_000, 1_500), (3, 3_000, 3_000), (4, 5_000, 5_000 + 3_600_000)], "id long, a long, b long")
    starts, ends = ids.select("id", F.timestamp_millis("a").alias("started_at")), ids.select("id", F.timestamp_millis("b").alias("ended_at"))
    assert {(r.id, r.elapsed) for r in sessions.with_elapsed(starts, ends).collect()} == {(1, 250), (2, None), (3, 0), (4, 3_600_000)}
    starts.coalesce(1).write.parquet(str(tmp_path / "a"))
    ends.coalesce(1).write.parquet(str(tmp_path / "b"))
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    stream = sessions.with_elapsed(read(starts, "a"), read(ends, "b"), stream=True)
    q = stream.writeStream.format("memory").queryName("elapsed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.id, r.elapsed) for r in spark.sql("select * from elapsed").collect()} == {(1, 250), (3, 0)}  # in time, and after its start


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.txt").write_text('{"id":1,"source":"en","image_path":"a"}\noops\n{"id":2,"source":"en"}\n')
    lines = spark.readStream.text(str(tmp_path / "in"))
    q = sessions.start_request_stream(lines, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    good = spark.read.parquet(str(tmp_path / "good")).collect()
    assert [(r.id, r.score_thresh) for r in good] == [(1, 0.5)]
    assert sorted(r.error for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["missing image_path", "not a request"]


def test_elapsed(spark):
    rows = spark.createDataFrame([(1.0, 11.4), (None, 3.0), (5.0, 4.0), (0.0, float("inf")), (0.0, 2.5)], "a double, b double")
    assert [r.e for r in rows.select(sessions.elapsed_ms(F.col("a"), F.col("b")).alias("e")).collect()] == [10, None, None, None, 3]


def test_entry_works_without_the_training_text_queries(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
