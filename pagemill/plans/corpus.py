"""Queries over corpora, languages, models and chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, routing
from ..sources import readers, views
from .registration import registration

QUERIES, SQL, query = registration()


def texts(spark, d):
    return views.table(spark, d, "documents").select(F.col("source").alias("image"), F.col("doc_id").alias("idx"), "text")


CHARS = "chars AS (SELECT DISTINCT source AS image, unnest(string_split(text, '')) AS ch FROM documents)"


@query("a4_character_counts", f"""WITH {CHARS} SELECT image, n AS texts, characters, false AS whole FROM (SELECT image, count(*) AS characters FROM chars GROUP BY image) JOIN (SELECT source AS image, count(*) AS n FROM documents GROUP BY source) USING (image)
    UNION ALL SELECT NULL, (SELECT count(*) FROM documents), count(DISTINCT ch), true FROM chars""")
def a4(spark, d):
    return corpus.character_counts(texts(spark, d))


def dictionary(spark, d):
    return corpus.characters(views.table(spark, d, "benchmark").select(F.lit(0).alias("image"), "text")).select("ch").distinct()


@query("a5_dictionary_coverage", f"""WITH {CHARS}, n AS (SELECT count(DISTINCT ch) AS characters FROM chars), s AS (SELECT count(DISTINCT ch) AS dictionary FROM (SELECT unnest(string_split(text, '')) AS ch FROM benchmark))
    SELECT characters, dictionary, round(100 * characters / dictionary, 6) AS coverage FROM n, s""")
def a5(spark, d):
    return corpus.coverage(texts(spark, d), dictionary(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query("t3_sample_texts", "SELECT source AS image, string_agg(text, '|' ORDER BY doc_id) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10 GROUP BY source")
def t3(spark, d):
    return corpus.sample_texts(texts(spark, d)).select("image", F.array_join("sample", "|").alias("sample"))


CODES = ["chi", " ZH-Hant", "ru", "ku", "sa", "english", "japan", "zh-sg", "xx", "ch_tra", "", "bg", "ar", "th", "rs_latin", "ms", "mi", " BHO", "gom", "abq", "ava", "sck", "new"]
MIXED = f"CASE doc_id % {len(CODES) + 1} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " ELSE lang END"


def _mixed(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", F.expr(MIXED).alias("lang"))


# The codes that users can choose, for the SQL alone.
LISTED_SQL = """('ch', 'en', 'ch_tra', 'japan', 'korean', 'fr', 'german', 'it', 'es', 'pt', 'ru', 'uk', 'be', 'te', 'sa', 'ta', 'af', 'az', 'bs', 'cs', 'cy', 'da', 'mt', 'nl', 'no', 'pl', 'ro', 'sk', 'sl', 'sq', 'sv',
    'sw', 'tl', 'tr', 'uz', 'vi', 'mn', 'ar', 'hi', 'ug', 'fa', 'ur', 'rs_latin', 'rs_cyrillic', 'oc', 'mr', 'ne', 'bg', 'et', 'ga', 'hr', 'hu', 'id', 'is', 'ku', 'lt', 'lv', 'mi', 'ms', 'abq', 'ady', 'kbd', 'ava',
    'dar', 'inh', 'lbe', 'lez', 'tab', 'bh', 'mai', 'ang', 'bho', 'mah', 'sck', 'new', 'gom')"""


def _in(codes) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


def _normalised_sql(v: str, variant: str) -> str:
    zh = f"({v} LIKE 'zh-%' OR {v} LIKE 'zh\\_%' ESCAPE '\\')"
    known = f"{v} IN {LISTED_SQL}"
    if variant == "settings":
        return f"CASE WHEN {known} THEN {v} ELSE 'en' END"
    if variant == "native":
        return f"CASE WHEN {known} THEN {v} WHEN {v} IN {_in(routing.ENGLISH)} THEN 'en' WHEN {v} IN {_in(routing.CHINESE)} OR {v} LIKE 'ch\\_%' ESCAPE '\\' OR {zh} THEN 'ch' ELSE 'en' END"
    return (
        f"CASE WHEN {v} IN {_in(routing.CHINESE)} THEN 'ch' WHEN {v} IN {_in(routing.TRADITIONAL)} THEN 'chinese_cht' WHEN {zh} THEN 'ch' "
        f"WHEN {v} IN {_in(routing.ENGLISH)} THEN 'en' WHEN {known} THEN {v} ELSE 'en' END")


@query("f14_language_aliases", f"WITH m AS (SELECT doc_id, lower(trim({MIXED})) AS v FROM documents) SELECT doc_id, {_normalised_sql('v', 'upstream')} AS upstream, {_normalised_sql('v', 'native')} AS native, {_normalised_sql('v', 'settings')} AS settings FROM m")
def f14(spark, d):
    n = lambda v: routing.normalised_language(F.col("lang"), v).alias(v)
    return _mixed(spark, d).select("doc_id", n("upstream"), n("native"), n("settings"))


@query("j8_language_routing", f"""WITH m AS (SELECT doc_id, lower(trim({MIXED})) AS v FROM documents), s AS (SELECT doc_id, {_normalised_sql('v', 'upstream')} AS source FROM m)
    SELECT doc_id, source, CASE """ + " ".join(f"WHEN source = '{k}' THEN '{v}'" for k, v in routing.EXACT.items()) + " " + " ".join(
        f"WHEN source IN {_in(c)} THEN '{f}_PP-OCRv5_mobile_rec'" for f, c in routing.FAMILIES.items()) + f" ELSE '{routing.DEFAULT}' END AS rec FROM s")
def j8(spark, d):
    return routing.routed(_mixed(spark, d)).select("doc_id", "source", "rec")


@query("s8_language_list", "SELECT count(DISTINCT lang) AS in_use, count(DISTINCT lang) FILTER (WHERE lang IN " + LISTED_SQL + ") AS listed FROM documents")
def s8(spark, d):
    codes = spark.createDataFrame([(c,) for c in routing.LISTED], "code string")
    used = views.table(spark, d, "documents").select("lang").filter(F.col("lang").isNotNull()).distinct()
    return used.join(F.broadcast(codes), F.col("lang") == F.col("code"), "left").agg(F.count("*").alias("in_use"), F.count("code").alias("listed"))


@query("s8_language_file", "SELECT lang AS code, 'language ' || lang AS label FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def s8_file(spark, d):
    """The languages in use, written as a language file (a list in one document) and read again."""
    used = views.table(spark, d, "documents").filter(F.col("lang").isNotNull()).select("lang").distinct()
    entry = F.struct(F.col("lang").alias("code"), F.concat(F.lit("language "), F.col("lang")).alias("label"))
    path = f"{readers.scratch(spark)}/langs"
    used.agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("value")).write.text(path)  # one entry a language
    return readers.read_languages(spark, path)


@query("j9_asset_check", """WITH need AS (SELECT p_partkey AS root, unnest(['det', 'cls', 'rec']) AS role FROM part),
    have AS (SELECT root, role, (root + length(role)) % 7 <> 0 AS dir, CASE role WHEN 'det' THEN root % 5 <> 0 ELSE true END AS m, CASE role WHEN 'rec' THEN root % 3 <> 0 ELSE true END AS p FROM need),
    f AS (SELECT root, role, dir AND (m OR p) AS dir, dir AND m AS m, dir AND p AS p FROM have)
    SELECT root, bool_and(dir AND m AND p) AS ok, coalesce(string_agg(CASE WHEN NOT (dir AND m AND p) THEN role || '(' || role || '_model): dir=' || dir || ', model_file=' || m || ', params=' || p END, '; ' ORDER BY CASE role WHEN 'det' THEN 1 WHEN 'cls' THEN 2 ELSE 3 END), '') AS failures FROM f GROUP BY root""")
def j9(spark, d):
    need = views.table(spark, d, "part").select(F.col("p_partkey").alias("root"), F.explode(F.array(F.lit("det"), F.lit("cls"), F.lit("rec"))).alias("role")).withColumn("model", F.concat("role", F.lit("_model")))
    root, role = F.col("root"), F.col("role")
    there = (root + F.length("role")) % 7 != 0
    model = F.when((role != "det") | (root % 5 != 0), F.when(root % 2 == 0, "inference.json").otherwise("inference.pdmodel"))
    params = F.when((role != "rec") | (root % 3 != 0), F.lit("inference.pdiparams"))
    files = need.filter(there).select("root", "model", F.explode(F.array_compact(F.array(model, params))).alias("file"))
    return routing.asset_check(need, files)


@query("f15_chat_request", """SELECT conv_id, turn, json_extract_string(r, '$.messages[1].content') = text AS kept, json_extract_string(r, '$.messages[0].role') AS first_role, CAST(json_extract(r, '$.temperature') AS DOUBLE) AS temperature
    FROM (SELECT *, json_object('messages', [json_object('role', 'system', 'content', 's'), json_object('role', 'user', 'content', text)], 'temperature', 0.7) AS r FROM conversations)""")
def f15(spark, d):
    r = routing.chat_request(views.table(spark, d, "conversations"), "m", "s")
    p = F.from_json("request", "messages array<struct<role:string,content:string>>, temperature double")
    return r.select("conv_id", "turn", (p["messages"][1]["content"] == F.col("text")).alias("kept"), p["messages"][0]["role"].alias("first_role"), p["temperature"].alias("temperature"))


@query("f15_chat_reply", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text END AS content, CASE turn % 3 WHEN 1 THEN 'bad response' WHEN 2 THEN 'empty response' END AS error FROM conversations")
def f15_reply(spark, d):
    choice = F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message")))
    body = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(choice.alias("choices")))).when(F.col("turn") % 3 == 1, "<html>").otherwise('{"choices":[]}')
    return routing.chat_reply(views.table(spark, d, "conversations").withColumn("response", body)).select("conv_id", "turn", "content", "error")
