"""Ids beyond what a double holds, beside a null id; and where intermediate tables lie."""

from collections import Counter

import pytest

from pagemill.llm import _shared, exact_dedup, gru_lm, language_id, minhash, packing, quality, queries, sentencepiece_codec, sharding, toxicity

BIG = 2**60 + 1
ROWS = [(BIG, "one text of a few plain words", "en"), (BIG + 2, "quite another text than the one before", "en"), (None, "a row without an id", "en"), (7, None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, lang, "s") for i, t, lang in ROWS], "doc_id long, text string, lang string, source string").coalesce(1)


def _operators(spark):
    labels = spark.createDataFrame([(BIG, 1), (BIG + 2, 0)], "doc_id long, toxic int")
    vocabulary = sentencepiece_codec.load_vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    return {
        1: minhash.near_duplicates, 2: quality.quality_rules, 4: language_id.language_id, 5: lambda d: sentencepiece_codec.digests(d, vocabulary),
        6: gru_lm.language_model, 7: queries.packed_documents, 8: sharding.shards_by_bytes, 9: exact_dedup.exact_dedup, 10: lambda d: toxicity.toxicity(d, labels),
    }


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 8, 9, 10])
def test_ids_stay_exact_beside_a_null_id(spark, rows, n):
    got = _operators(spark)[n](rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in ROWS)


def test_results_stay_with_their_ids(spark, rows):
    vocabulary = sentencepiece_codec.load_vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(rows, vocabulary), vocabulary).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t, _ in ROWS}
    with open(queries.tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        own = packing.ByteTokenizer(f.read())
    assert {(r.doc_id, r.length) for r in queries.packed_documents(rows).collect()} == {(i, len(own.encode(t or "")) // 4 + 1) for i, t, _ in ROWS}
    assert {(r.doc_id, r.n_tokens) for r in gru_lm.language_model(rows).collect()} == {(i, len(gru_lm.tokens(t))) for i, t, _ in ROWS}


def test_components_beside_a_null_id(spark):
    near = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22 w23"
    rows = [(BIG + 2, near), (BIG, near + " w24"), (BIG + 4, near), (None, "x y z"), (None, near), (BIG + 6, "other words altogether than those")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(BIG, BIG), (BIG + 2, BIG), (BIG + 4, BIG), (BIG + 6, BIG + 6)}
    assert [r.kept for r in got if r.doc_id is None] == [True, True]


def test_shared_folder(spark):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_folder(Far)


def test_tables_are_cleared(spark, tmp_path):
    with _shared.cleared(spark):
        t = _shared.written(spark.range(3), "t")
        u = _shared.written(t, "u", instead_of=t)
        assert u.count() == 3
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(t._written_to).count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(u._written_to).count()
