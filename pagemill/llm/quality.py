"""Quality rules: simple base rules, then robust multivariate outliers.

Each text gives five statistics. For every language and source a minimum covariance
determinant (MCD) estimate is made from the texts that pass the base rules, by
concentration steps: measure distances, keep the nearest ``share`` of the rows, estimate
again, until no determinant falls any more. Three starts are tried, all of them made from
medians and quartiles: the spreads alone, the correlations of squashed values, and those
of directions. After two steps the one with the least determinant goes on.

A group's estimate is drawn towards that of all rows together by the weight of ``prior``
rows, so that small groups and large ones are judged by one rule. Every step is one
grouped sum over all rows, per bin of distance: a source with a third of the rows is added
up in all tasks, and the order statistics come from those bins, which do not depend on how
rows are dealt. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE_CHARS, discard, let, rows_kept, with_rows, words, written

SPAN = 8
SYMBOLS = "#*$%&|<>"
#: Least spread of each statistic: log words, log word length, and three angles of shares. About what single words, lines and signs make of them.
FLOORS = (0.3, 0.05, 0.05, 0.2, 0.15)
_N = range(len(FLOORS))
_PAIRS = [(i, j) for i in _N for j in range(i + 1)]
#: The group of all rows together, and the rows of a table of estimates up to which it is broadcast: a few MB.
ALL, _FEW = -1, 10_000


def repeated_window_words(w: Column, span: int = SPAN) -> Column:
    """How many words lie in windows of ``span`` words that the text holds twice or more."""
    last = F.size(w) - span + 1
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, span)))

    def positions(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, q, i: F.coalesce(F.get(p, i)["h"] == q["h"], F.lit(False))
        return let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda q, i: same(p, q, i - 1) | same(p, q, i + 1)), lambda q: q["i"])))

    def covered(at: Column) -> Column:
        lengths = F.transform(at, lambda x, i: F.least(F.lit(span), F.coalesce(F.get(at, i + 1) - x, F.lit(span))))
        return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(positions(h), covered)))
    return F.when(last < 1, 0).otherwise(repeats).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_words = let(words(F.col(text_col)), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    n, r = F.col("w.n"), F.col("w.r")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col("lang"),
        F.col("source"),
        by_words.alias("w"),
        by_lines.alias("x"),
        F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(
        "doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols",
        F.col("x.n").alias("n_lines"), F.col("x.d").alias("n_dup_lines"), r.alias("n_repeat_words"),
        ((n < 20) | (100 * r > 30 * n)).alias("base_failed"),
    )


def _vector() -> list[Column]:
    angle = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))
    return [
        F.log1p("n_words"),
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        angle("n_symbols", "word_chars"),
        angle("n_dup_lines", "n_lines"),
        angle("n_repeat_words", "n_words"),
    ]


def _consistency(share: float) -> float:
    """What makes the covariance of the nearest ``share`` of a normal cloud in 5 dimensions that of the whole cloud."""
    tail = lambda x: math.sqrt(2 / math.pi) * math.exp(-x / 2)
    five = lambda x: math.erf(math.sqrt(x / 2)) - tail(x) * (math.sqrt(x) + x**1.5 / 3)
    low, high = 0.0, 200.0
    for _ in range(80):
        low, high = ((low + high) / 2, high) if five((low + high) / 2) < share else (low, (low + high) / 2)
    return share / (five(low) - tail(low) * low**2.5 / 15)


def _beside(rows: DataFrame, estimates: DataFrame, n: int) -> DataFrame:
    """``rows`` with the estimates of their group. ``n`` is how many there are: many are not broadcast, but copied for salted parts of each group."""
    if n <= _FEW:
        return rows.join(F.broadcast(estimates), "grp")
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*[f"x{i}" for i in _N]), F.lit(32)).cast("int")).join(salted.hint("merge"), ["grp", "salt"]).drop("salt")


def _middle(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The least bin up to which ``share`` of the counts lie, per key; ``counts``: keys, bin, n."""
    by = Window.partitionBy(*keys)
    upto = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(by)).groupBy(*keys).agg(
        F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin"))).alias("bin"))


def _factored(moments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, centre m, Cholesky factor l and log determinant of centres m and covariances c; no pivot falls below its floor."""
    for j in _N:
        for i in range(j, len(FLOORS)):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floor keeps the determinant from 0 where a statistic hardly varies
            rest = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            moments = moments.withColumn(f"l{i}{j}", rest)
    det = sum((F.log(F.col(f"l{i}{i}")) for i in _N), F.lit(0.0))
    return moments.select(*keys, *[f"m{i}" for i in _N], *[f"l{i}{j}" for i, j in _PAIRS], det.alias("det"))


def _starts(vectors: DataFrame, n: int) -> DataFrame:
    """grp, start, m, l, det: three first estimates of each group, from medians and quartile spreads."""
    width = 64.0
    bins = vectors.select("grp", F.posexplode(F.array(*[F.col(f"x{i}") for i in _N])).alias("dim", "v"))
    counts = written(bins.groupBy("grp", "dim", F.floor(F.col("v") * width).alias("bin")).agg(F.count("*").alias("n")), "bins")
    at = {q: _middle(counts, ["grp", "dim"], q).select("grp", "dim", (F.col("bin") / width).alias(f"q{round(100 * q)}")) for q in (0.25, 0.5, 0.75)}
    both = at[0.5].join(at[0.25], ["grp", "dim"]).join(at[0.75], ["grp", "dim"])
    pick = lambda c, i: F.max(F.when(F.col("dim") == i, c))
    spread = (F.col("q75") - F.col("q25")) / 1.349
    middle = written(both.groupBy("grp").agg(
        *[pick(F.col("q50"), i).alias(f"m{i}") for i in _N], *[F.greatest(pick(spread, i), F.lit(FLOORS[i])).alias(f"s{i}") for i in _N]), "middles")
    z = _beside(vectors, middle, n).select("grp", *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in _N])
    length = F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in _N), F.lit(0.0)), F.lit(1e-9))
    shapes = z.groupBy("grp").agg(
        *[F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in _PAIRS], *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / length).alias(f"d{i}{j}") for i, j in _PAIRS])
    shape = {0: lambda i, j: F.lit(1.0 if i == j else 0.0), 1: lambda i, j: F.col(f"t{i}{j}"), 2: lambda i, j: F.col(f"d{i}{j}")}
    joined = middle.join(shapes, "grp")
    several = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), *[(of(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in _PAIRS]) for k, of in shape.items()]))
    return written(_factored(joined.select("grp", *[f"m{i}" for i in _N], several.alias("v")).select("grp", *[f"m{i}" for i in _N], "v.*"), ["grp", "start"]).withColumn("det", F.lit(float("inf"))), "starts")


def _distance() -> Column:
    """The squared Mahalanobis distance of x from m, by forward substitution through the Cholesky factor l."""
    y: list[Column] = []
    for i in _N:
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _concentrate(vectors: DataFrame, estimate: DataFrame, n: int, share: float) -> DataFrame:
    """One concentration step in one pass: counts and moments per bin of distance, then those of the nearest ``share`` of each group. ``better``: whether the determinant fell; else the estimate stays."""
    by = ["grp", "start"]
    x = [F.col(f"x{i}") for i in _N]
    near = _beside(vectors, estimate, n).select(*by, *[f"x{i}" for i in _N], F.floor(32 * F.log2(1 + _distance())).alias("bin"))
    sums = near.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), *[F.sum(x[i]).alias(f"m{i}") for i in _N], *[F.sum(x[i] * x[j]).alias(f"c{i}{j}") for i, j in _PAIRS])
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sums.withColumn("before", before).withColumn("all", F.sum("n").over(group)).filter(F.col("before") < share * F.col("all"))
    moments = kept.groupBy(*by).agg(*[(F.sum(f"m{i}") / F.sum("n")).alias(f"m{i}") for i in _N], *[(F.sum(f"c{i}{j}") / F.sum("n")).alias(f"c{i}{j}") for i, j in _PAIRS])
    moments = moments.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _PAIRS})
    fresh = _factored(moments, by)
    fields = [c for c in fresh.columns if c not in by]
    j = estimate.drop("better").join(fresh.select(*by, *[F.col(c).alias(f"new_{c}") for c in fields]), by)
    better = F.col("new_det") < F.col("det") - 1e-4
    return j.select(*by, *[F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in fields], better.alias("better"))


def mcd_estimates(vectors: DataFrame, n_groups: int, share: float = 0.75, most_steps: int = 50) -> DataFrame:
    """grp, m, l: the MCD estimate of each group of ``vectors`` (grp, x0..x4), a table."""
    estimate = _starts(vectors, n_groups)
    for k in range(most_steps):
        before = estimate
        estimate = written(_concentrate(vectors, before, 3 * n_groups if k < 2 else n_groups, share), "estimate", instead_of=before)
        if k == 1:
            first = Window.partitionBy("grp").orderBy("det", "start")
            estimate = written(estimate.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n"), "best", instead_of=estimate)
        if k > 1 and not estimate.filter("better").limit(1).count():
            break
    return estimate


def robust_outliers(stats: DataFrame, share: float = 0.75, prior: float = 50.0, cutoff: float = 30.0) -> DataFrame:
    """``stats`` (rows of ``text_statistics``, a table) with distance and kept.

    ``distance`` is the squared Mahalanobis distance from the MCD estimate of the
    document's language and source, the covariance made consistent with a normal cloud;
    above ``cutoff`` (about 1 in 70,000 of such a cloud) the document goes. An estimate of
    n rows counts n / (n + ``prior``), that of all rows the rest. Null language and null
    source are values like any other. Rows that fail the base rules have no distance.
    """
    passed = stats.filter(~F.col("base_failed"))
    groups = written(passed.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("grp", F.monotonically_increasing_id()), "groups")
    n_groups = groups.count()
    named = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "grp")
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    few = lambda t: F.broadcast(t) if n_groups <= _FEW else t
    own = passed.join(few(named), on).select("grp", *[v.alias(f"x{i}") for i, v in enumerate(_vector())])
    vectors = written(own.withColumn("grp", F.explode(F.array(F.lit(ALL).cast("long"), "grp"))), "vectors")
    estimate = mcd_estimates(vectors, n_groups + 1, share)
    cov = lambda i, j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(1, j + 1)), F.col(f"l{i}0") * F.col(f"l{j}0"))
    plain = estimate.select("grp", *[f"m{i}" for i in _N], *[cov(i, j).alias(f"c{i}{j}") for i, j in _PAIRS])
    whole = plain.filter(F.col("grp") == ALL).select(*[F.col(c).alias(f"all_{c}") for c in plain.columns])  # one row
    w = F.col("n") / (F.col("n") + prior)
    drawn = lambda c, scale: ((w * F.col(c) + (1 - w) * F.col(f"all_{c}")) * scale).alias(c)
    scale = _consistency(share)
    moments = groups.join(plain, "grp").crossJoin(F.broadcast(whole)).select(
        "lang", "source", *[drawn(f"m{i}", 1.0) for i in _N], *[drawn(f"c{i}{j}", scale) for i, j in _PAIRS])
    final = _factored(moments, ["lang", "source"])
    final = written(final.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[c for c in final.columns if c[0] in "ml" and c != "lang"]), "final")
    discard(vectors, estimate)
    measured = stats.join(few(final), on, "left").withColumns({f"x{i}": v for i, v in enumerate(_vector())})
    distance = F.when(~F.col("base_failed"), _distance())
    return measured.select(*stats.columns, distance.alias("distance")).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def quality_rules(docs: DataFrame, **rules) -> DataFrame:
    """One row per document: its statistics, base_failed, distance and kept.

    Null and empty texts have no words and fail the base rules. Every row is judged by
    itself, so repeated and null ids are ids like any other. An empty table gives an empty
    result; further columns are ignored.
    """
    stats = written(text_statistics(docs), "statistics")
    return robust_outliers(stats, **rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_good_texts(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; ids may repeat or be null."""
    rows = with_rows(docs)
    judged = quality_rules(rows.withColumn("doc_id", F.col("_row")), **rules)
    return rows_kept(rows, judged.filter("kept").select(F.col("doc_id").alias("_row")), docs.columns)
