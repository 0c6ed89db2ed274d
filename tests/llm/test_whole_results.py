"""Nothing is lost or parted that the operators promise to keep."""

import pytest

from pagemill.llm import exact_dedup, language_id, sharding, warc
from pagemill.llm._shared import table

PAGE = "page_id long, url string, html string"


def test_pages_larger_than_the_reader_takes_by_itself_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 2000)
    pages = spark.createDataFrame([(1, "u", "a" * 500), (2, "u", "b" * 90_000), (3, "u", "c" * 3000), (4, None, None)], PAGE)
    got = {r.page_id: r.payload_bytes for r in warc.pages_through_warc(pages).collect()}
    assert got == {1: 500, 2: 90_000, 3: 3000, 4: 0}


def test_a_gap_does_not_excuse_lost_pages(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "a" * 500), (2, "u", "b" * 90_000), (3, "u", "c" * 3000)], PAGE)
    n = warc.archived(pages, f"file://{tmp_path}/archives")
    read = warc.read_warc(spark, f"file://{tmp_path}/archives", with_payload=False, most=2000)
    with pytest.raises(ValueError, match="1 records read of 3 written"):
        warc.quarantined(read, n, f"file://{tmp_path}/gaps", whole=True)


@pytest.mark.parametrize("sf, shards", [("sf0.001", 16), ("sf0.01", 16), ("sf0.01", 5), ("sf0.1", 16)])
def test_groups_of_equal_texts_are_whole(spark, sf, shards):
    got = sharding.kd_shards(table(spark, f"/root/testdata/{sf}", "documents"), shards).toPandas()
    groups = got.groupby(["text_crc32", "size"]).agg(n=("shard", "size"), shards=("shard", "nunique"))
    leaf = got["size"].sum() / shards
    fit = groups.index.get_level_values("size") * groups.n <= leaf
    assert (groups.shards[fit] == 1).all() and (groups.n > 1).any()


def test_the_least_long_is_an_id(spark):
    rows = spark.createDataFrame([(-(2**63), "a b"), (2**63 - 1, "ab"), (5, "a  b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(rows).collect()} == {(5, 5, True), (-(2**63), 5, False), (2**63 - 1, 5, False)}
    tie = spark.createDataFrame([(3, "x"), (-(2**63), "x")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_dedup(tie).collect()} == {-(2**63)}


def test_languages_are_learned_from_whole_texts(spark, monkeypatch):
    taught = {}
    monkeypatch.setattr(language_id, "build_model", taught.update)
    some = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, some(i % 30, 40 + i % 30), "en") for i in range(300)] + [(900, some(900, 30_000), "en"), (901, some(901, 9_000), "fi"), (902, None, "fi"), (903, "left", None)]
    language_id.train_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_chars=2000)
    texts = {t for _, t, _ in rows if t}
    assert set(taught) == {"en", "fi"}
    assert all(t in texts for found in taught.values() for t in found)  # none is cut
    assert taught["fi"] == [rows[301][1]]  # more than the sample, and the only one
    sizes = [len(t) for t in taught["en"]]
    assert len(set(taught["en"])) == len(sizes) and 2000 <= sum(sizes) < 2000 + max(sizes) and max(sizes) < 1000
