"""Logs read by many tasks have the line numbers of a plain reader; request batches are seen whole; ends find their starts."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import logs
from pagemill.sources import readers
from pagemill.streaming import elapsed, requests, sessions


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_of_lines_in_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    files = {f"{k}.log": [f"{k} {n} " + "x" * rng.choice([0, 3, 40, 900]) if rng.random() < 0.9 else "" for n in range(rng.choice([1, 700, 3000]))] for k in range(4)}
    files["crlf.log"] = [f"line {n}" for n in range(4000)]
    for name, lines in files.items():
        end = "\r\n" if name == "crlf.log" else "\n"
        (tmp_path / name).write_bytes((end.join(lines) + (end if name != "1.log" else "")).encode())
    (tmp_path / "empty.log").write_text("")
    got = readers.read_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert {(r.file, r.line_no, r.value) for r in got.collect()} == {(f, n, v) for f, lines in files.items() for n, v in enumerate(lines, 1)}
    assert got.count() == sum(map(len, files.values()))


def test_a_large_log_is_read_by_many_tasks(spark, tmp_path):
    """200 MB in one file: the record that wins is the last one, wherever it is."""
    path = str(tmp_path / "log")
    line = F.when(F.col("id") % 40_000 == 7, F.concat(F.lit(logs.FFI_PREFIX), F.lit('{"image":"a.png","detection_count":'), F.col("id").cast("string"), F.lit(',"elapsed_ms":[1.5]}'))).otherwise(F.repeat(F.lit("n"), 200))
    spark.range(0, 1_000_000, 1, 1).select(line.alias("value")).write.text(path)
    found = readers.read_lines(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() >= 4
    hits = found.filter(F.col("value").contains(logs.FFI_PREFIX))
    assert [r.line_no for r in hits.orderBy("line_no").collect()] == list(range(8, 1_000_001, 40_000))
    assert logs.scan_bench(found).first().detection_count == 960_007


def test_lines_are_filtered_before_they_meet_their_ranges(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\nhit 1\n")
    plan = readers.read_lines(spark, str(tmp_path)).filter(F.col("value").contains("hit"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Filter") < plan.index("Relation")


def test_the_last_file_wins(spark, tmp_path):
    record = lambda n: logs.FFI_PREFIX + f'{{"image":"a.png","detection_count":{n},"elapsed_ms":[1.0]}}\n'
    (tmp_path / "part-1.log").write_text("\n" * 5 + record(1))
    (tmp_path / "part-2.log").write_text(record(2))
    assert logs.scan_bench(readers.read_lines(spark, str(tmp_path))).first().detection_count == 2


LINES = '{"id":1,"source":"en","image_path":"a"}\noops\n{"id":2,"source":"en"}\n'


def test_readers_see_both_tables_of_a_batch_or_neither(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.txt").write_text(LINES)
    good, bad, state = (str(tmp_path / x) for x in ("good", "bad", "cp"))
    write = requests._write

    def dies(rows, path, *rest):
        if path == bad:
            raise RuntimeError("killed between the writes")
        write(rows, path, *rest)

    monkeypatch.setattr(requests, "_write", dies)
    with pytest.raises(Exception, match="killed between the writes"):
        requests.start_request_stream(spark.readStream.text(str(tmp_path / "in")), good, bad, state).awaitTermination(120)
    assert spark.read.parquet(good).count() == 1  # half a batch is there
    assert [t.count() for t in requests.read_requests(spark, good, bad)] == [0, 0]  # and is not seen
    monkeypatch.setattr(requests, "_write", write)
    assert requests.start_request_stream(spark.readStream.text(str(tmp_path / "in")), good, bad, state).awaitTermination(120)
    seen = requests.read_requests(spark, good, bad)
    assert [[tuple(r) for r in t.collect()] for t in seen][0] == [(1, "en", "a", 0.5)]
    assert sorted(r.error for r in seen[1].collect()) == ["missing image_path", "not a request"]
    assert spark.read.parquet(good).count() == 2  # the dead attempt's row is still in its own folder


def test_a_batch_that_is_listed_is_not_written_again(spark, tmp_path):
    """A stream that dies after the manifest's line and before its own commit runs the batch again."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.txt").write_text(LINES)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for state in ("one", "two"):  # a checkpoint that is gone: the same batch once more
        assert requests.start_request_stream(spark.readStream.text(str(tmp_path / "in")), good, bad, str(tmp_path / state)).awaitTermination(120)
    assert [t.count() for t in requests.read_requests(spark, good, bad)] == [1, 2]
    assert spark.read.parquet(good).count() == 1


def test_ends_with_and_without_starts(spark):
    ms = lambda rows, name: spark.createDataFrame(rows, "id long, t long").select("id", F.timestamp_millis("t").alias(name))
    starts = ms([(1, 1000), (1, 1000), (1, 1500), (2, 5000), (3, 0), (5, None)], "started_at")
    ends = ms([(1, 1800), (1, 900), (2, 4000), (3, 700_000), (4, 1), (None, 7), (5, 9)], "ended_at")
    key = lambda r: (r[0] or 0, r[1] if r[1] is not None else -1)
    got = sorted((tuple(r) for r in elapsed.with_elapsed(starts, ends).collect()), key=key)
    assert got == [(None, None), (1, None), (1, 800), (2, None), (3, 700_000), (4, None), (5, None)]
    assert dict(elapsed.with_elapsed(starts, ends, within="10 minutes").filter("id = 3").collect()) == {3: None}
    assert sessions.with_elapsed is elapsed.with_elapsed


def test_the_outer_join_gives_nulls_when_watermarks_pass(spark, tmp_path):
    """Three runs: a match at once, an end whose start comes later, and nulls only when no start can come any more."""
    runs = [([(1, 0), (1, 0)], [(1, 250), (2, 1000)]), ([(2, 900)], [(3, 2000)]), ([(9, 3_000_000)], [(9, 3_000_001)]), ([(10, 6_000_000)], [(10, 6_000_001)])]
    ms = lambda rows, name: spark.createDataFrame(rows, "id long, t long").select("id", F.timestamp_millis(F.col("t") + 10**9).alias(name))
    seen = []
    for starts, ends in runs:
        a, b = ms(starts, "started_at"), ms(ends, "ended_at")
        a.write.mode("append").parquet(str(tmp_path / "a"))
        b.write.mode("append").parquet(str(tmp_path / "b"))
        found = elapsed.with_elapsed(spark.readStream.schema(a.schema).parquet(str(tmp_path / "a")), spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")), stream=True)
        q = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        seen.append({tuple(r) for r in spark.read.schema("id long, elapsed long").parquet(str(tmp_path / "out")).collect()})
    assert seen[0] == {(1, 250)}
    assert seen[1] == {(1, 250), (2, 100)}
    assert seen[3] >= {(1, 250), (2, 100), (3, None), (9, 1)}
    assert len(spark.read.parquet(str(tmp_path / "out")).filter("id = 1").collect()) == 1
