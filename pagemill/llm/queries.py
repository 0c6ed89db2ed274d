"""The registered queries of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, gru_lm, language_id, minhash, packing, prefix_trie, quality, sentencepiece_codec, sharding, toxicity, vector_dedup, warc
from ._shared import shared_folder, table, written


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the operators take paths or contents as parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Packing under the ids of byte_bpe_50k.json; its rank table gives the same ids for all but the added tokens."""
    ranks, definition = (Path(tokenizer_file(f"byte_bpe_50k.{x}")).read_bytes() for x in ("tiktoken", "json"))
    return packing.pack_documents(docs, ranks, added=packing.added_tokens(definition))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(table(spark, sf_dir, "pages"))


def _spoiled(spark: SparkSession, source: str, target: str, every: int, most: int = warc.MOST_BYTES) -> int:
    """Copies of archives with a byte in the middle of each ``every``-th page's record turned over; returns how many."""
    salvage = warc.salvage  # a module that is shipped by value would take along what cannot be pickled

    def spoil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    data = bytearray(file.read())
                for r in salvage(bytes(data), most):
                    page = r["record_id"].rpartition(":")[2]
                    if page and int(page) % every == 0:
                        data[r["offset"] + r["length"] // 2] ^= 255
                        hits.append(r["record_id"])
                store, top = fs.FileSystem.from_uri(target)
                store.create_dir(top, recursive=True)
                with store.open_output_stream(f"{top}/{path.rpartition('/')[2]}", compression=None) as out:
                    out.write(bytes(data))
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], ["record_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source).select("path")
    return written(files.mapInArrow(spoil, "record_id string"), "spoiled").count()


def warc_damaged_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, recovered: which pages the salvage reader brings back from archives in which every 97th page's record is damaged."""
    pages, top = table(spark, sf_dir, "pages"), shared_folder(spark)
    n, most = warc.archived(pages, f"{top}/archives"), warc.most_bytes(pages)
    bad = _spoiled(spark, f"{top}/archives", f"{top}/damaged", 97, most)
    read = written(warc.read_warc(spark, f"{top}/damaged", with_payload=False, most=most).drop("payload"), "read")
    back = warc.quarantined(read, n - bad, f"{top}/gaps", whole=True)
    found = warc.pages_of_records(back).select("page_id", F.lit(True).alias("found")).distinct()
    # a page without an id is no page whose return its id could show
    recovered = F.when(F.col("page_id").isNotNull(), F.coalesce("found", F.lit(False)))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", recovered.alias("recovered"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepiece_codec.load_vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), vocabulary)


def op6_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.language_model(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op8_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_by_bytes(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_prefix_trie(table(spark, sf_dir, "conversations"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_quality_rules,
        op3_warc_salvage,
        warc_damaged_archives,
        op4_language_id,
        op5_sentencepiece,
        op6_gru_language_model,
        op7_best_fit_packing,
        op8_kd_tree_shards,
        op9_exact_dedup,
        op10_toxicity,
        op11_conversation_repair,
        op12_conversation_prefix_trie,
        op13_embedding_near_dedup,
    )
}

#: DuckDB has no crc32: byte for byte, with the reversed polynomial 0xEDB88320.
_CRC32 = """xor(list_reduce(list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"""
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL: dict[str, str] = {
    "op11_conversation_repair": rf"""
        WITH RECURSIVE keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        spoilt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("k")} % 20 AS spoil FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN spoil = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN spoil = 1 THEN '' WHEN spoil = 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE spoil WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM spoilt)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS r FROM damaged),
        judged AS (
            SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY pos) || r AS pair,
                   CASE WHEN trim(text, {_SPACE}) = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                        WHEN right(rtrim(text, {_SPACE}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM judged GROUP BY conv_id),
        added(a, z, fee, marks, lines) AS (
            VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
                   ('', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'u', 3, 'I', chr(10) || 'user:'), ('a', 'u', 3, 'I', chr(10) || 'user:'),
                   ('u', 'a', 3, 'I', chr(10) || 'assistant:'), ('', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
                   ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        moves(z, t, fee, mark, need, role) AS (
            VALUES ('', '', 4, 'D', '', ''), ('s', 's', 4, 'D', '', ''), ('u', 'u', 4, 'D', '', ''), ('a', 'a', 4, 'D', '', ''),
                   ('', 's', 0, 'K', 's', ''), ('', 'u', 0, 'K', 'u', ''), ('s', 'u', 0, 'K', 'u', ''), ('a', 'u', 0, 'K', 'u', ''), ('u', 'a', 0, 'K', 'a', ''),
                   ('', 'u', 3, 'R', '', 'user'), ('s', 'u', 3, 'R', '', 'user'), ('a', 'u', 3, 'R', '', 'user'), ('u', 'a', 3, 'R', '', 'assistant')),
        path(conv_id, pos, state, best) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, '', struct_pack(cost := 0::BIGINT, audit := '', said := '') FROM conversations
            UNION ALL
            SELECT p.conv_id, p.pos + 1, m.t,
                   min(struct_pack(cost := p.best.cost + i.fee + m.fee + CASE WHEN m.mark <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END, audit := p.best.audit || i.marks || m.mark,
                                   said := p.best.said || i.lines || CASE m.mark WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || j.role || ':' || j.text ELSE chr(10) || m.role || ':' || j.text END))
            FROM path p JOIN added i ON i.a = p.state JOIN moves m ON m.z = i.z
            JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.pos = p.pos + 1
            WHERE (m.mark = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (m.mark <> 'K' OR j.r = m.need)
            GROUP BY p.conv_id, p.pos, m.t),
        ended AS (
            SELECT p.conv_id, min(struct_pack(cost := p.best.cost + i.fee, audit := p.best.audit || i.marks, said := p.best.said || i.lines)) AS best
            FROM path p JOIN added i ON i.a = p.state AND i.z IN ('', 'a') LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
            WHERE p.pos = coalesce(c.n, 0) GROUP BY p.conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(substr(e.best.said, 2)) AS repaired_sha256
        FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
    "op12_conversation_prefix_trie": rf"""
        WITH RECURSIVE own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
        lines AS (
            SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
            UNION ALL
            SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
        placed AS (
            SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS n, sha256(length(role) || ':' || role || text) AS line,
                   len(list_filter(string_split(translate(text, {_SPACE}, '      '), ' '), lambda x: x <> '')) AS n_words
            FROM lines WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
        spelt AS (SELECT *, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM placed),
        members AS (
            SELECT conv_id, depth, n, sha256(key) AS key, sha256(left(key, 64 * (depth - 1))) AS above, n_words FROM spelt
            UNION ALL
            SELECT c.conv_id, 0, coalesce(p.n, 0), sha256(''), NULL, 0 FROM convs c LEFT JOIN (SELECT DISTINCT conv_id, n FROM placed) p ON p.conv_id = c.conv_id),
        nodes AS (
            SELECT key, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_words) AS n_words,
                   string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends
            FROM members GROUP BY key),
        families AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
        told AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN families f ON f.key = n.key),
        below AS (
            SELECT m.key, count(*) FILTER (t.n_children = 0) AS n_leaves, sum((t.n_convs - 1) * t.n_words) AS saved_tokens
            FROM told t JOIN members m ON m.conv_id = t.conv_id AND m.depth <= t.depth GROUP BY m.key)
        SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
        FROM told t JOIN below b ON b.key = t.key LEFT JOIN told p ON p.key = t.above
    """,
    "op3_warc_salvage": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "warc_damaged_archives": "SELECT page_id, page_id % 97 <> 0 AS recovered FROM pages",
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER best AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER best AS kept,
               text_sha256
        FROM d WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
    "op13_embedding_near_dedup": """
        WITH RECURSIVE fit AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.93 ELSE FALSE END),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        direct AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, coalesce(least(e.vec_id, l.b), e.vec_id) AS component_id, e.vec_id = coalesce(least(e.vec_id, l.b), e.vec_id) AS kept
        FROM embeddings e LEFT JOIN direct d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
    """,
}
