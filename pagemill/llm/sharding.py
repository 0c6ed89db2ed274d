"""Shards by k-d tree: nodes are split at weighted medians until their bytes reach a target.

Equal texts are one point, weighted by all their bytes, so that they stay together; only a
text whose copies alone are more than a whole leaf is several points, and a hash of the row
says which copy belongs to which. A point's dimensions are
what is known besides the words: language, source, log size and bytes per code point, each
as a number of 30 bits. A node that is to become n leaves is split along the dimension in
which it is widest, measured against the whole table, at the weighted quantile that leaves
n // 2 leaves on the left. Points alike in it are told apart by the text's checksum.

The quantile is found digit by digit: a round adds up bytes per node and digit over all
points, and a window over those few sums takes the digit in which the quantile lies. The
nodes are a table like any other; the driver sees only how many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import numbered, written

DIMENSIONS = ("lang", "source", "x0", "x1")
#: Right shifts that leave one digit more each, of a key of 30 bits of a dimension and 32 of a checksum.
_SHIFTS = (46, 30, 14, 0)
#: Rows of a small table up to which it is broadcast: about 1 MB.
_FEW = 10_000


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, size, text_crc32 and the coordinates of each row; null text has one byte and the checksum of nothing, a missing column is like null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")), F.lit(1 << 30)).alias(c)
    raw = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"),
        F.char_length(text).alias("n"), F.crc32(text).alias("text_crc32"), named("lang"), named("source"))
    most = float((1 << 30) - 1)
    scale = lambda x: F.least(F.lit(most), F.greatest(F.lit(0.0), x * most)).cast("long")
    return raw.select(
        "row", "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", "lang", "source",
        scale(F.log2(F.col("bytes") + 1) / 40).alias("x0"), scale((F.col("bytes") / F.greatest("n", F.lit(1)) - 1) / 3).alias("x1"))


def _beside(rows: DataFrame, small: DataFrame, n: int, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of ``n`` rows, which is broadcast only while it is small."""
    return rows.join(F.broadcast(small) if n <= _FEW else small.hint("merge"), on, how)


def _keyed(points: DataFrame) -> DataFrame:
    """Add ``key``: the coordinate along ``dim``, then the checksum, with the parts of one text set apart."""
    tie = F.pmod(F.col("text_crc32") + F.col("part") * 2_654_435_761, F.lit(1 << 32))
    return points.withColumn("key", F.shiftleft(F.get(F.array(*DIMENSIONS), F.coalesce("dim", F.lit(0))), 32).bitwiseOR(tie))


def _split(points: DataFrame, nodes: DataFrame, n: int, slack: float) -> DataFrame:
    """Points with the node they come to when each of the ``n`` nodes (node, leaves) is split; a node is named by its first leaf."""
    widths = [x for d in DIMENSIONS for x in (F.min(d).alias(f"low_{d}"), F.max(d).alias(f"high_{d}"))]
    whole = points.agg(*[F.greatest(F.max(d) - F.min(d), F.lit(1)).alias(f"all_{d}") for d in DIMENSIONS])  # one row
    stats = points.groupBy("node").agg(F.sum("weight").alias("total"), *widths).crossJoin(F.broadcast(whole))
    wide = F.array(*[(F.col(f"high_{d}") - F.col(f"low_{d}")) / F.col(f"all_{d}") for d in DIMENSIONS])
    state = written(_beside(stats, nodes, n, "node").filter("leaves > 1").select(
        "node", "leaves", "total", (F.array_position(wide, F.array_max(wide)) - 1).cast("int").alias("dim"),
        (F.col("total") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("goal"),
        F.lit(0).cast("long").alias("prefix"), F.lit(62).alias("shift"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("inclusive"), F.lit(True).alias("going")), "nodes")
    for shift in _SHIFTS:
        if not state.filter("going").limit(1).count():
            break
        inside = _keyed(_beside(points, state.filter("going").select("node", "dim", "prefix", "shift"), n, "node")).filter(F.expr("shiftright(key, shift) = prefix"))
        sums = inside.groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("weight").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        reached = _beside(sums.withColumn("upto", upto), state.select("node", "goal", "before"), n, "node").filter(F.col("before") + F.col("upto") >= F.col("goal"))
        found = reached.groupBy("node").agg(F.min(F.struct("digit", "w", "upto")).alias("at"))
        high = F.col("before") + F.col("at.upto")
        low = high - F.col("at.w")
        off = F.least(high - F.col("goal"), F.col("goal") - low)
        hit = F.col("going") & F.col("at").isNotNull()
        step = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
        state = written(state.join(found, "node", "left").select(
            "node", "leaves", "total", "dim", "goal", step(F.col("at.digit"), "prefix"), step(F.lit(shift), "shift"), step(low, "before"),
            step(high - F.col("goal") <= F.col("goal") - low, "inclusive"), (hit & (off > slack * F.col("total"))).alias("going")), "nodes", instead_of=state)
    cut = F.col("prefix") - F.when(F.col("inclusive"), 0).otherwise(1)
    placed = _keyed(_beside(points, state.select("node", "leaves", "dim", "shift", cut.alias("cut")), n, "node", "left"))
    right = F.when(F.expr("shiftright(key, shift) > cut"), F.floor(F.col("leaves") / 2)).otherwise(0)
    return written(placed.withColumn("node", (F.col("node") + right).cast("int")).select(*points.columns), "halves", instead_of=points)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, slack: float = 0.002, apart: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs``; the bytes of shards are near equal.

    There are ``shards`` leaves, any number from 1, or as many as bring each to at most
    about ``target_bytes``. A split may miss its quantile by ``slack`` of the node. Ties in
    all dimensions are one text (or one checksum), and so are repeated rows; they stay
    together, unless they alone are more than a whole leaf: then they are dealt by a hash
    of the row to points of at most ``apart`` of a leaf. Null ids are ids like any other. Tables with fewer
    texts than shards leave shards empty; an empty table gives an empty result.
    """
    rows = written(_rows(docs, "doc_id", "text"), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 1
    leaves = shards or max(1, -(-total // target_bytes))
    leaf = max(1.0, total / leaves)
    heavy = rows.groupBy("text_crc32", "size").agg((F.count("*") * F.col("size")).alias("weight")).filter(F.col("weight") > leaf)
    heavy = written(heavy.select("text_crc32", "size", F.ceil(F.col("weight") / max(1.0, apart * leaf)).alias("parts")), "heavy")  # fewer rows than leaves
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    parted = _beside(rows, heavy, heavy.count(), ["text_crc32", "size"], "left").withColumn("part", part)
    of = ["text_crc32", "size", "part"]
    points = parted.groupBy(*of).agg((F.count("*") * F.col("size")).alias("weight"), *[F.min(d).alias(d) for d in DIMENSIONS])
    points = written(points.withColumn("node", F.lit(0)), "points")
    tree = [(0, leaves)]
    while any(n > 1 for _, n in tree):
        nodes = docs.sparkSession.createDataFrame(tree, "node int, leaves int")
        points = _split(points, nodes, len(tree), slack)
        tree = [x for at, n in tree for x in ([(at, n // 2), (at + n // 2, n - n // 2)] if n > 1 else [(at, n)])]
    placed = parted.join(points.select(*of, F.col("node").alias("shard")), of).select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed, ["shard"], ["doc_id", "text_crc32"], "slot")


def shards_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The shards with the law they keep: ``bytes``. That law does not say what one shard more would do."""
    return kd_shards(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
