"""The trie of conversation prefixes: what training on shared beginnings once would save.

Every prefix of a conversation has a digest of 128 bits, the exclusive-or of digests of
position, role and text, so prefixes are digested by running sums and a long conversation is never
gathered. A count-min sketch counts all prefixes in a bounded number of cells. Where one of a
prefix's cells has counted only one, no other conversation begins so: the prefix is a node of
its own and is settled where it was read. Only prefixes whose cells are all crowded are shuffled and
counted exactly; a sketch that is too small for its input sends more of them, and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import PART_BITS, in_order, null_safe_join, parts, shipped, words, written

#: Each prefix is counted in so many rows of the sketch.
SKETCH_ROWS = 4
#: Bits of one bitmap of ``bitmap_construct_agg``.
BITMAP = 32768
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, at, a, b, n_words: turns of conversations that begin with the first turns of another, in order of ``at``.

    ``a`` and ``b`` are a digest of role and text. Conversation c takes the first h turns of
    c - c % every (all if fewer, none if absent) and then its own turns after its first h, where h is
    crc32(c) % heads. Turns come by turn (null first), role, the first 100 characters of the text and a hash of it.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("long")
    turns = written(
        conversations.filter("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 100).alias("start"), F.xxhash64(text).alias("rest"),
            half(1).alias("a"), half(16).alias("b"), F.size(words(text)).cast("long").alias("n_words"), F.monotonically_increasing_id().alias("row"),
        ),
        "turns",
    )
    order = ["turn", "role", "start", "rest", "row"]
    # the first turns of every conversation: at most heads - 1 of each, and of each task before the shuffle
    first = turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).filter(F.col("place") < heads)
    first = written(first.select("conv_id", "row", "place", "a", "b", "n_words"), "first")
    share = lambda c: F.crc32(c.cast("string")) % heads
    own = turns.join(first.filter(F.col("place") <= share(F.col("conv_id"))).select("row").hint("merge"), "row", "left_anti")
    base = first.filter(F.col("conv_id") % every == 0).withColumnRenamed("conv_id", "base")
    takers = first.filter("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), share(F.col("conv_id")).alias("h"))
    lent = takers.join(base.hint("merge"), "base").filter(F.col("place") <= F.col("h"))
    own = own.select("conv_id", F.lit(heads).alias("place"), *order, "a", "b", "n_words")
    blank = {c: F.lit(None).cast(own.schema[c].dataType) for c in order}
    both = own.unionByName(lent.select("conv_id", "place", "a", "b", "n_words").withColumns(blank))
    return in_order(both, [F.col(c) for c in ("conv_id", "place", *order)], "rebuilt").select("conv_id", "at", "a", "b", "n_words")


def _running(rows: DataFrame, values: dict[str, Column], total: str | None = None) -> DataFrame:
    """Add exclusive-or sums of columns up to each row of its conversation, the row included, and ``depth``; ``total`` names the count of all its rows.

    Parts of a conversation that lie in several partitions of the order are summed apart, and their few totals
    are carried on.
    """
    rows = rows.withColumn("part", F.shiftright("at", PART_BITS))
    within = Window.partitionBy("conv_id", "part").orderBy("at")
    sizes = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    across = Window.partitionBy("conv_id").orderBy("part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"), F.sum("n").over(Window.partitionBy("conv_id")).alias(total or "_n"))
    placed = rows.join(sizes.hint("merge"), ["conv_id", "part"]).withColumn("depth", (F.row_number().over(within) + F.col("shift")).cast("long"))
    placed = written(placed.withColumns(values).drop("shift", "_n"), "placed")
    sums = placed.groupBy("conv_id", "part").agg(*[F.bit_xor(c).alias(c) for c in values])
    shifts = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"_{c}") for c in values])
    out = placed.join(shifts.hint("merge"), ["conv_id", "part"])
    return out.withColumns({c: F.bit_xor(c).over(within).bitwiseXOR(F.col(f"_{c}")) for c in values}).drop(*[f"_{c}" for c in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, part, at, depth, length, x, y, px, py, n_words: each prefix with its digest, that before its last turn, and the conversation's length."""
    turn = {"x": F.xxhash64("depth", "a", "b"), "y": F.xxhash64("b", F.lit("y"), "depth", "a")}
    found = _running(turns, {c: h for c, h in turn.items()}, "length")
    return found.select(
        "conv_id", "part", "at", "depth", "length", "x", "y", *[F.col(c).bitwiseXOR(h).alias(f"p{c}") for c, h in turn.items()], "n_words"
    )


def _cells(x: Column, y: Column, width: int) -> Column:
    """The cells in which a digest is counted: one of each row of the sketch, by double hashing."""
    return F.array(*[F.pmod(x.bitwiseAND(0xFFFFFFFF) + F.lit(j) * F.shiftrightunsigned(y, 31), F.lit(width)) + j * width for j in range(SKETCH_ROWS)])


def crowded(found: DataFrame, width: int) -> np.ndarray:
    """Which cells of the sketch counted more than one prefix: ``SKETCH_ROWS`` rows of ``width`` bits, packed."""
    cells = found.select(F.explode(_cells(F.col("x"), F.col("y"), width)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    bits = cells.filter("n > 1").groupBy(F.floor(F.col("cell") / BITMAP).alias("k")).agg(F.bitmap_construct_agg(F.pmod("cell", F.lit(BITMAP))).alias("bits"))
    held = np.zeros(SKETCH_ROWS * width // 8, dtype=np.uint8)
    for k, b in bits.collect():  # at most SKETCH_ROWS * width bits in all
        held[k * BITMAP // 8 : (k + 1) * BITMAP // 8] = np.frombuffer(bytes(b), dtype=np.uint8)
    return held


def screened(found: DataFrame, width: int) -> DataFrame:
    """``found`` with ``maybe`` and ``parent_maybe``: false where the sketch proves that no other conversation has the prefix, or the one before its last turn."""
    ship = shipped(found.sparkSession, crowded(found, width))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = ship()

        def several(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.ones(len(x), dtype=bool)
            step = (y.astype(np.uint64) >> np.uint64(31)).astype(np.int64)
            for j in range(SKETCH_ROWS):
                cell = ((x & 0xFFFFFFFF) + j * step) % width + j * width
                out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            return out

        for batch in batches:
            x, y, px, py = (batch.column(c).to_numpy() for c in ("x", "y", "px", "py"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(several(x, y)), pa.array(several(px, py))], names=[*batch.schema.names, "maybe", "parent_maybe"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return written(found.mapInArrow(look, f"{kinds}, maybe boolean, parent_maybe boolean"), "screened")


def _digest_of_ids(ends: DataFrame) -> DataFrame:
    """x, y, ends_sha256: of each node's ends (conv_id), sorted, one at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in parts(batches, 10_000):
            done = []
            for x, y, c in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "conv_id")), strict=True):
                if (x, y) != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (x, y), hashlib.sha256(str(c).encode())
                else:
                    digest.update(f",{c}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in zip(*done, strict=True)], names=["x", "y", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([k]) for k in (*now, digest.hexdigest())], names=["x", "y", "ends_sha256"])

    return ends.select("x", "y", "conv_id").repartition("x", "y").sortWithinPartitions("x", "y", "conv_id").mapInArrow(each, "x long, y long, ends_sha256 string")


def _with_parents(children: DataFrame, nodes: DataFrame, share: float = 0.001) -> DataFrame:
    """``children`` with parent_conv_id from ``nodes`` and, where the parent is none of these, their own conversation.

    Parents of more than ``share`` of all children, so at most 1 / share of them, are broadcast; the others meet their children in a shuffle.
    """
    named = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    many = written(children.groupBy("px", "py").agg(F.count("*").alias("n")), "families")
    total = many.agg(F.sum("n")).first()[0] or 0
    large = many.filter(F.col("n") > max(share * total, 1)).select("px", "py")
    known = written(named.join(F.broadcast(large), ["px", "py"]), "large_families")
    hot = children.join(F.broadcast(large), ["px", "py"], "left_semi").join(F.broadcast(known), ["px", "py"], "left")
    cold = children.join(F.broadcast(large), ["px", "py"], "left_anti").join(named.hint("merge"), ["px", "py"], "left")
    return hot.unionByName(cold).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, turns: DataFrame, width: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node of the trie of ``turns``.

    ``turns`` is what ``rebuilt`` gives for ``conversations``; conversations without a turn end at the root.
    Rows without a conv_id belong to no conversation and are left out. Null roles and texts are
    empty, repeated rows are turns of their own, other columns are ignored. Without any conversation there is no node.
    ``width`` is the number of cells in a row of the sketch: by default four times the prefixes, as a power of two
    from 2^16 to 2^22, so that its bits are 2 MB at most.
    """
    every = written(conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), "all")
    found = written(prefixes(turns), "prefixes")
    if width is None:
        width = 1 << min(22, max(16, (4 * found.count()).bit_length()))
    seen = screened(found, width)
    end = F.col("depth") == F.col("length")
    alone = seen.filter("not maybe")
    tails = alone.filter("parent_maybe = false and depth > 1").select("*", F.col("conv_id").alias("parent_conv_id"))
    tops = alone.filter("parent_maybe or depth = 1")
    shared = seen.filter("maybe")
    nodes = written(
        shared.groupBy("x", "y", "px", "py", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_words").alias("n_words"), F.sum(end.cast("long")).alias("n_ends")
        ),
        "nodes",
    )
    children = nodes.select("px", "py").unionByName(tops.select("px", "py")).groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    children = written(children, "children")
    nodes = nodes.join(children.hint("merge"), ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = written(nodes, "nodes_with_children")

    # the least member of a node stands for it: its other members' turns there are what sharing saves
    marks = nodes.select("conv_id", "depth", (F.col("n_children") == 0).alias("leaf"))
    told = shared.join(marks.hint("merge"), ["conv_id", "depth"], "left").select(
        "conv_id", "part", "at", "x", "y", F.when(F.col("leaf").isNull(), F.col("n_words")).otherwise(0).alias("spared"), (F.coalesce("leaf", F.lit(False)) & end).alias("leaf")
    )
    told = written(told, "told")
    single_ends = alone.filter(end).select("conv_id", "part", F.lit(0).cast("long").alias("spared"), F.lit(True).alias("leaf"))
    spans = told.select("conv_id", "part", "spared", "leaf").unionByName(single_ends).groupBy("conv_id", "part").agg(F.sum("spared").alias("spared"), F.bool_or("leaf").alias("leaf"))
    after = Window.partitionBy("conv_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    spans = written(
        spans.select("conv_id", "part", F.col("spared").alias("span_spared"), F.coalesce(F.sum("spared").over(after), F.lit(0)).alias("later"), F.bool_or("leaf").over(Window.partitionBy("conv_id")).alias("ends_leaf")),
        "spans",
    )
    from_here = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    below = told.join(spans.hint("merge"), ["conv_id", "part"]).withColumn("below", F.sum("spared").over(from_here) + F.col("later"))
    sums = below.groupBy("x", "y").agg(F.sum(F.col("ends_leaf").cast("long")).alias("n_leaves"), F.sum("below").alias("saved_tokens"))
    no_turn = every.join(found.filter("depth = 1").select("conv_id").hint("merge"), "conv_id", "left_anti")
    ends = shared.filter(end).select("x", "y", "conv_id").unionByName(no_turn.select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv_id"))
    ends = written(_digest_of_ids(ends), "ends")

    exact = nodes.join(sums.hint("merge"), ["x", "y"]).join(ends.hint("merge"), ["x", "y"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    settled = {
        "n_convs": F.lit(1).cast("long"),
        "n_children": (~end).cast("long"),
        "n_leaves": F.lit(1).cast("long"),
        "saved_tokens": F.lit(0).cast("long"),
        "ends_sha256": F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS),
    }
    families = written(exact.select("px", "py", *[c for c in NODE if c != "parent_conv_id"]).unionByName(tops.withColumns(settled).select("px", "py", *[c for c in NODE if c != "parent_conv_id"])), "families")
    least = every.agg(F.min("conv_id")).first()[0]
    top = families.filter("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    rest = _with_parents(families.filter("depth > 1"), nodes)
    whole = top.select(*NODE).unionByName(rest.select(*NODE)).unionByName(tails.withColumns(settled).select(*NODE))
    if least is None:
        return whole
    firsts = families.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = every.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).crossJoin(firsts).join(F.broadcast(ends.filter("x = 0 and y = 0")), F.lit(True), "left")
    root = root.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return root.unionByName(whole)


def conversation_prefix_trie(conversations: DataFrame, width: int | None = None) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations."""
    return prefix_trie(conversations, rebuilt(conversations), width)
