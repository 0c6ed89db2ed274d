"""The first texts of a key, whole, without gathering the key."""

from pagemill.operators import corpus


def test_first_whole_texts(spark):
    rows = [("hot", i, f"{i} " + "long text " * 20) for i in range(500)] + [("few", 2, "b"), ("few", 1, None), (None, 7, "c")]
    got = corpus.sample_texts(spark.createDataFrame(rows[::-1], "image string, idx long, text string"))
    assert {r.image: r["sample"] for r in got.collect()} == {"hot": [r[2] for r in rows[:10]], "few": [None, "b"], None: ["c"]}
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()  # only the first rows of a part are sorted into a list
