"""The reader over archives with damaged records, against the query's SQL."""

import duckdb

from pagemill.llm import queries

PAGE = "page_id long, url string, html string"


def rows_of(spark, folder, pages):
    """What the query and its SQL give for ``pages``."""
    spark.createDataFrame(pages, PAGE).write.parquet(f"file://{folder}/pages.parquet")
    got = queries.warc_damaged_archives(spark, str(folder)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    key = lambda r: str(tuple(r))
    return sorted(map(tuple, got), key=key), sorted(con.execute(queries.SQL["warc_damaged_archives"]).fetchall(), key=key)


def test_damaged_records_are_missed_and_no_others(spark, tmp_path):
    got, want = rows_of(spark, tmp_path, [(i, f"http://h/{i}", f"<p>{i}</p>" * 30) for i in range(200)])
    assert got == want
    assert [i for i, found in got if not found] == [0, 194, 97]


def test_ids_that_repeat_or_are_null_keep_their_rows(spark, tmp_path):
    got, want = rows_of(spark, tmp_path, [(i, "u", f"page {k} " * 40) for k, i in enumerate([97, 97, 5, 5, 5, None, None, -97, 6])])
    assert len(got) == 9
    assert got == want
