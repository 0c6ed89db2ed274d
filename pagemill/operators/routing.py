"""Language codes to recognisers, and whether a model's files are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Codes, families and model names that results depend on.
LISTED = (
    "ch en ch_tra japan korean fr german it es pt ru uk be te sa ta af az bs cs cy da mt nl no pl ro sk sl sq sv sw tl tr uz vi mn ar hi ug fa ur "
    "rs_latin rs_cyrillic oc mr ne bg et ga hr hu id is ku lt lv mi ms abq ady kbd ava dar inh lbe lez tab bh mai ang bho mah sck new gom"
).split()
CHINESE = "cn zh chi chinese".split()
TRADITIONAL = "ch_tra chinese_cht zh-tw zh_tw zh-hant zh_hant".split()
ENGLISH = "en eng english".split()
EXACT = {
    "ch": "PP-OCRv5_server_rec", "chinese_cht": "PP-OCRv5_server_rec", "japan": "PP-OCRv5_server_rec", "en": "en_PP-OCRv5_mobile_rec",
    "korean": "korean_PP-OCRv5_mobile_rec", "th": "th_PP-OCRv5_mobile_rec", "el": "el_PP-OCRv5_mobile_rec", "te": "te_PP-OCRv5_mobile_rec", "ta": "ta_PP-OCRv5_mobile_rec",
}
FAMILIES = {
    "latin": (
        "af az bs cs cy da de es et fr ga hr hu id is it ku la lt lv mi ms mt nl no oc pi pl pt ro rs_latin sk sl sq sv sw tl tr uz vi french german fi eu gl "
        "lb rm ca qu").split(),
    "eslav": "ru be uk".split(),
    "arabic": "ar fa ug ur ps ku sd bal".split(),
    "cyrillic": (
        "ru rs_cyrillic be bg uk mn abq ady kbd ava dar inh che lbe lez tab kk ky tg mk tt cv ba mhr mo udm kv os bua xal tyv sah kaa").split(),
    "devanagari": "hi mr ne bh mai ang bho mah sck new gom sa bgc".split(),
}
DETECTOR, CLASSIFIER, DEFAULT = "PP-OCRv5_server_det", "PP-LCNet_x1_0_textline_ori", "en_PP-OCRv5_mobile_rec"


def normalised_language(code: Column, variant: str = "upstream", listed: list[str] = LISTED) -> Column:
    """A language code by one of three habits: ``upstream`` (traditional Chinese apart), ``native`` (listed codes first) or ``settings`` (listed codes only)."""
    v = F.lower(trimmed(F.coalesce(code, F.lit(""))))
    known = v.isin(listed)
    zh = v.startswith("zh-") | v.startswith("zh_")
    if variant == "settings":
        return F.when(known, v).otherwise("en")
    if variant == "native":
        return F.when(known, v).when(v.isin(ENGLISH), "en").when(v.isin(CHINESE) | v.startswith("ch_") | zh, "ch").otherwise("en")
    return F.when(v.isin(CHINESE), "ch").when(v.isin(TRADITIONAL), "chinese_cht").when(zh, "ch").when(v.isin(ENGLISH), "en").when(known, v).otherwise("en")


def recogniser_table(spark: SparkSession) -> DataFrame:
    """code, rank, rec: every route, the lowest rank winning; about a hundred rows."""
    rows = [(code, 0, rec) for code, rec in EXACT.items()]
    rows += [(code, k, f"{family}_PP-OCRv5_mobile_rec") for k, (family, codes) in enumerate(FAMILIES.items(), 1) for code in codes]
    return spark.createDataFrame(rows, "code string, rank int, rec string")


def routed(rows: DataFrame, code: str = "lang") -> DataFrame:
    """Add source, det, cls and rec of each row's language."""
    best = recogniser_table(rows.sparkSession).groupBy("code").agg(F.min_by("rec", "rank").alias("rec"))
    named = rows.withColumn("source", normalised_language(F.col(code)))
    return named.join(F.broadcast(best.withColumnRenamed("code", "source")), "source", "left").withColumns(
        {"rec": F.coalesce("rec", F.lit(DEFAULT)), "det": F.lit(DETECTOR), "cls": F.lit(CLASSIFIER)})


def asset_check(required: DataFrame, files: DataFrame, part_rows: int = 500_000) -> DataFrame:
    """root, ok, failures: each required (root, role, model) needs a directory, a model file and its parameters; ``files``: root, model, file.

    Roots are dealt to parts of about ``part_rows`` rows of both tables, since rows this much alike are
    so small in an exchange that Spark by itself would put too many in one task.
    """
    there = files.filter(F.col("root").isNotNull() & F.col("model").isNotNull())
    both = required.select("root", "model", F.struct("role").alias("need"), F.lit(None).cast("string").alias("file")).unionByName(
        there.select("root", "model", F.lit(None).cast(required.select(F.struct("role").alias("r")).schema["r"].dataType).alias("need"), "file"))
    n = max(int(required.sparkSession.conf.get("spark.sql.shuffle.partitions")), (required.count() + there.count()) // part_rows + 1)
    # both levels of grouping are by root, so this one exchange serves both
    of_model = both.repartition(n, "root").groupBy("root", "model").agg(
        F.collect_set("need").alias("needs"),
        F.coalesce(F.bool_or(F.col("file").isNotNull()), F.lit(False)).alias("dir"),
        F.coalesce(F.bool_or(F.col("file").isin("inference.json", "inference.pdmodel")), F.lit(False)).alias("model_file"),
        F.coalesce(F.bool_or(F.col("file") == "inference.pdiparams"), F.lit(False)).alias("params"))
    j = of_model.withColumn("need", F.explode("needs")).select("root", "need.role", "model", "dir", "model_file", "params")
    ok = F.col("dir") & F.col("model_file") & F.col("params")
    place = F.array_position(F.array(F.lit("det"), F.lit("cls"), F.lit("rec")), F.col("role"))
    text = F.format_string("%s(%s): dir=%s, model_file=%s, params=%s", "role", "model", F.col("dir").cast("string"), F.col("model_file").cast("string"), F.col("params").cast("string"))
    failed = F.sort_array(F.collect_list(F.when(~ok, F.struct(place.alias("p"), text.alias("t")))))
    return j.groupBy("root").agg(F.bool_and(ok).alias("ok"), F.array_join(F.transform(failed, lambda s: s["t"]), "; ").alias("failures"))


def chat_request(texts: DataFrame, model: str, system: str, temperature: float = 0.7) -> DataFrame:
    """Add request: the JSON body that asks for one text."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.col("text"))).alias("messages"), F.lit(temperature).alias("temperature"))
    return texts.withColumn("request", F.to_json(body))


def chat_reply(replies: DataFrame, col: str = "response") -> DataFrame:
    """Add content and error: the first choice of a response, or why there is none."""
    parsed = F.from_json(F.col(col), "choices array<struct<message:struct<content:string>>>")
    content = F.get(parsed["choices"], F.lit(0))["message"]["content"]
    return replies.withColumn("content", content).withColumn("error", F.when(parsed["choices"].isNull(), "bad response").when(content.isNull(), "empty response"))
