"""Near-duplicates by min-max hashing.

A text is the set of its distinct five-word shingles. Under each of ``PERMUTATIONS``
permutations both the least and the greatest shingle are kept, so one hash evaluation
gives two values of the signature. Bands of ``ROWS`` minima, or of as many maxima, are the
keys of buckets: values of one band come from different permutations, so they are independent
in sets of a few shingles too. A pair at similarity 0.75 misses one band with probability
1 - 0.75^4, and all 32 with about 5 in a million. Links are confirmed on full shingle sets.

Texts with equal sets are one class, and only its representative goes on. Within a bucket
pairs are not listed: every member is first compared with one hub, and those links give
components. What is left are pairs of different components in a bucket. They count where a
second band agrees as well, in buckets of every size, which leaves out a pair at similarity
0.75 with probability 8 in 100,000 and most of the less similar ones. All members outside
the bucket's largest component visit the blocks over which the bucket is spread, so m
members of which v are outside cost m + v * m / BLOCK rows, and are compared inside tasks:
first by their signatures, then by their least ``SKETCH`` shingles, which are the whole
sets of most texts. Where v is more than BLOCK, members are dealt by the second band first,
which brings the same pairs together with fewer visits. Texts that agree in two bands and
are in different components by the thousand remain quadratic: m * v comparisons in blocks.

Only pairs that still look alike leave the task and are confirmed on their sets. Either
mark lies 4 standard deviations below 0.75, so that it turns a true pair down about once
in 30,000. No bucket is capped. Rows of a hot bucket or component are spread over tasks, and
sets of a hub are copied for salted parts of its pairs. Exchanges of texts and of sets are
deleted before the next of their size are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import collected, discard, parts, rows_kept, salted_join, with_rows, written
from .components import connected_components

SHINGLE = 5
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Least shingles kept of a set; how far 128 values, and a sketch, may fall below the similarity; members in a block.
SKETCH = 512
SLACK = 0.15
SKETCH_SLACK = 0.077
BLOCK = 1024

_random = np.random.default_rng(20_240_601)
_PLACE = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MIX = _random.integers(0, 2**63, (ROWS, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes; remembers the hashes of words it has met."""

    def __init__(self, remembered: int = 100_000):
        self.room, self.known = remembered, {}

    def _missing(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self.known) < self.room and len(word) < 64:
            self.known[word] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes: lower() changes A-Z alone, split() cuts at the six ASCII white spaces alone
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        get = self.known.get
        w = np.array([get(x) or self._missing(x) for x in found], dtype=np.uint64)
        n = len(w) - SHINGLE + 1
        if n < 1:
            part = w * _PLACE[: len(w)]
            return np.unique(_stirred(np.array([part.sum(dtype=np.uint64) + np.uint64(len(w))], dtype=np.uint64))) if len(w) else w
        total = w[:n] * _PLACE[0]
        for i in range(1, SHINGLE):
            total += w[i : i + n] * _PLACE[i]
        return np.unique(_stirred(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """(2, PERMUTATIONS): the least and the greatest value of a non-empty set under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        turned = (shingles[None, at : at + 1024] ^ _SHIFT[:, None]) * _TURN[:, None]
        np.minimum(low, turned.min(axis=1), out=low)
        np.maximum(high, turned.max(axis=1), out=high)
    return np.stack([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a signature."""
    by_band = _stirred(values).reshape(BANDS, ROWS)
    return _stirred((by_band * _MIX.T).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in parts(batches):
        sizes, keys, bands = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingler(text)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bands.append(band_keys(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64))
        columns = [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_shingles", "set_key", "bands"])


def signatures(rows: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, set_key (a 128-bit digest of the set), bands of each of ``rows`` (row, doc_id, text); without words null and no bands."""
    return rows.select("row", "doc_id", "text").mapInArrow(_signed, "row long, doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in parts(batches, 500):
        sets = [shingler(t) for t in batch.column("text").to_pylist()]
        upper = lambda x: (x >> np.uint64(32)).astype(np.uint32).tobytes()
        columns = [
            batch.column("row"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            pa.array([upper(signature(s)) for s in sets], pa.binary()), pa.array([upper(s[:SKETCH]) for s in sets], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["node", "shingles", "signature", "sketch"])


def _agreement(a: np.ndarray, b: np.ndarray) -> tuple[float, bool]:
    """Estimated similarity of two sets from their sketches, and whether the sketches are the whole sets."""
    both = np.intersect1d(a, b)
    if len(a) < SKETCH and len(b) < SKETCH:
        return len(both) / (len(a) + len(b) - len(both)), True
    least = np.union1d(a, b)[:SKETCH]
    return float(np.count_nonzero(both <= least[-1])) / len(least), False


def _alike(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs of different components that look alike, of rows sorted by key and block."""
    held: list[pd.DataFrame] = []
    by = ["key", "block"]

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        marks = rows[by].to_numpy()
        starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
        values = np.frombuffer(b"".join(rows["signature"]), dtype=np.uint32).reshape(len(rows), -1)
        sketch = [np.frombuffer(x, dtype=np.uint32) for x in rows["sketch"]]

        def similar(i: int, j: int) -> bool:
            share, whole = _agreement(sketch[i], sketch[j])
            return share >= similarity - (0.01 if whole else SKETCH_SLACK)

        c, home, outside, n, first_band, second = (rows[x].to_numpy() for x in ("c", "home", "outside", "n", "band", "second"))
        name = rows["node"].to_numpy()
        left, right = [], []
        for a, z in zip(starts, [*starts[1:], len(rows)], strict=True):
            at_home, own = np.arange(a, z)[home[a:z]], c[a:z]
            if not len(at_home) or own.min() == own.max():
                continue
            for i in np.arange(a, z)[outside[a:z]].tolist():
                # two outsiders meet at home of either: the one with the lesser name is the visitor that counts
                other = at_home[(c[at_home] != c[i]) & (~outside[at_home] | (name[at_home] > name[i]))]
                same = values[other] == values[i]
                bands = same.reshape(len(other), BANDS, ROWS).all(axis=2)
                mark = bands.argmax(axis=1) == first_band[a]  # else an earlier band brings the pair
                bands[:, first_band[a]] = False
                mark &= bands.argmax(axis=1) == second[a] if second[a] >= 0 else bands.any(axis=1)
                other = other[(same.mean(axis=1) >= similarity - SLACK) & mark]
                found = [j for j in other.tolist() if similar(i, j)]
                left += [i] * len(found)
                right += found
        node = rows["node"].to_numpy()
        a, b = node[left], node[right]
        swap = a > b
        n_a, n_b = n[left], n[right]
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "n_a": np.where(swap, n_b, n_a), "n_b": np.where(swap, n_a, n_b)}).drop_duplicates()

    for batch in batches:
        if held and len(batch) and (batch[by].iloc[0] != held[-1][by].iloc[-1]).any():
            yield compared(pd.concat(held, ignore_index=True))
            held = []
        last = (batch[by] == batch[by].iloc[-1]).all(axis=1) if len(batch) else None
        if last is not None:
            done = batch[~last]
            if len(done):
                yield compared(pd.concat([*held, done], ignore_index=True))
                held = []
            held.append(batch[last])
    if held:
        yield compared(pd.concat(held, ignore_index=True))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int, salts: int = 32) -> DataFrame:
    """The pairs (a, b, n_a, n_b), a table, whose whole sets are similar enough, in percent.

    The set of b travels to its pairs; that of a is copied once for each salted part of
    its pairs, so no key gathers all pairs of a hub.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    # the same joins at every size: pairs and sets grow with the texts, so neither is ever broadcast
    copies = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")).hint("merge"), "a")
    of_b = salted.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")).hint("merge"), "b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return of_b.join(copies.hint("merge"), ["a", "salt"]).filter(100 * both >= similarity * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _sized(pairs: DataFrame, similarity: int) -> DataFrame:
    return pairs.filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """Members (key, node, c, ...) of buckets with several components, with the bucket's size m, how many are outside its largest component, and whether this one is."""
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("k"))
    whole = sizes.groupBy("key").agg(F.sum("k").alias("m"), F.max(F.struct("k", "c")).alias("most"))
    whole = written(whole.select("key", "m", F.col("most.c").alias("largest"), (F.col("m") - F.col("most.k")).alias("v")), "bucket_sizes")
    return salted_join(placed, whole, "key", "m", ["node"]).filter("v > 0").withColumn("outside", F.col("c") != F.col("largest")).drop("largest")


def _across_components(buckets: DataFrame, component: DataFrame, signed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs of members of one bucket that are in different components and look alike."""
    placed = buckets.join(component, "node", "left").select("key", "band", F.lit(-1).alias("second"), "node", "n", F.coalesce("component", "node").alias("c"))
    first = written(_mixed(placed), "mixed")
    few, many = first.filter(F.col("v") <= BLOCK), first.filter(F.col("v") > BLOCK)
    again = many.select("key", "band", "node", "n", "c").join(signed.select(F.col("row").alias("node"), "bands").hint("merge"), "node")
    again = again.select("key", "band", "node", "n", "c", F.posexplode("bands").alias("second", "other")).filter(F.col("second") > F.col("band"))
    again = _mixed(again.select(F.xxhash64("key", "second", "other").alias("key"), "band", "second", "node", "n", "c"))
    rows = few.unionByName(again).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    visits = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    dealt = rows.withColumn("at", home).select("key", "band", "second", "node", "n", "c", "outside", "at", F.explode(visits).alias("block"))
    dealt = dealt.withColumn("home", F.col("at") == F.col("block")).drop("at").join(sets.select("node", "signature", "sketch").hint("merge"), "node")
    ordered = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return ordered.mapInPandas(lambda batches: _alike(batches, similarity / 100), "a long, b long, n_a long, n_b long")


def near_duplicates(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * |A and B| >= similarity * |A or B|. Texts with fewer
    than five words are one shingle; null, empty and blank texts have none and are linked
    with nothing, as are rows with a null id (their component is null and they stay).
    Every other row is a document: rows that repeat an id may have different texts, and
    then are in the components of those texts. An empty table gives an empty result.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    return _linked(rows, similarity, last_use=True)


def _linked(rows: DataFrame, similarity: int, last_use: bool = False) -> DataFrame:
    """The result of ``near_duplicates`` for a table of rows (row, doc_id, text), which is deleted when read if this is its last use."""
    signed = written(signatures(rows), "signatures")
    named = signed.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = written(named.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    heads = named.select(F.col("row").alias("node"), "n_shingles", "bands").join(classes.select("node").hint("merge"), "node")
    places = heads.select(F.posexplode("bands").alias("band", "key"), "node", F.col("n_shingles").alias("n"))
    shared = places.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("hub")).filter(F.col("members") > 1)
    shared = written(shared.select("key", "members", F.col("hub.node").alias("a"), F.col("hub.n").alias("n_a")), "shared")
    buckets = written(salted_join(places, shared, "key", "members", ["node"]).drop("members"), "buckets", instead_of=shared)
    collected(rows.sparkSession)
    crowd = buckets.select(F.col("node").alias("row")).distinct()
    sets = written(rows.select("row", "text").join(crowd.hint("merge"), "row", "left_semi").mapInArrow(_sets, "node long, shingles array<long>, signature binary, sketch binary"), "sets", instead_of=rows if last_use else None)
    collected(rows.sparkSession)

    with_hub = buckets.filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"), "n_a", F.col("n").alias("n_b"))
    near_hub = written(_sized(with_hub, similarity), "hub_pairs")
    component = connected_components(written(_confirmed(near_hub, sets, similarity), "hub_links"))
    collected(rows.sparkSession)
    rest = _sized(_across_components(buckets, component, signed, sets, similarity), similarity)
    pairs = written(rest.join(near_hub, ["a", "b"], "left_anti"), "pairs")
    collected(rows.sparkSession)
    links = written(_confirmed(pairs, sets, similarity), "links")
    discard(buckets, sets, near_hub, pairs)
    collected(rows.sparkSession)
    # the new links run between components: join those, then lead each node on
    known = component.withColumnRenamed("component", "c")
    links = links.join(known, F.col("a") == F.col("node"), "left").select(F.coalesce("c", "a").alias("a"), "b")
    links = links.join(known, F.col("b") == F.col("node"), "left").select("a", F.coalesce("c", "b").alias("b"))
    merged = connected_components(links)
    led = component.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    led = led.select("node", F.coalesce("to", "component").alias("component"))
    component = written(led.unionByName(merged.join(component.select("node"), "node", "left_anti")), "components")

    joined = classes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = written(joined.groupBy("component").agg(F.min("least").alias("found"), F.count("*").alias("classes")), "least")
    of_class = written(salted_join(joined, least, "component", "classes", ["node"]).select(F.col("set_key").alias("k"), "found", "copies"), "found", instead_of=least)
    return _with_component(signed.select("doc_id", "n_shingles", "set_key"), of_class)


def _with_component(rows: DataFrame, of_class: DataFrame, support: float = 0.001) -> DataFrame:
    """Each row with what was found of its class. Classes of more than ``support`` of all rows, at most 1 / support of them, are broadcast; rows of the others are shuffled."""
    total = of_class.agg(F.sum("copies")).first()[0] or 0
    often = of_class.filter(F.col("copies") > support * total)
    seldom = of_class.filter(F.col("copies") <= support * total).select("k", "found")
    often = often.select(F.col("k").alias("o"), F.col("found").alias("of_often"))
    some = rows.join(F.broadcast(often), F.col("set_key") == F.col("o"), "left")
    key = F.when(F.col("o").isNull(), F.col("set_key"))  # null where the answer is there already
    found = some.withColumn("key", key)
    settled = found.filter(F.col("key").isNull()).withColumn("found", F.col("of_often"))
    other = found.filter(F.col("key").isNotNull()).join(seldom, F.col("key") == F.col("k"), "left").drop("k")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return settled.unionByName(other.select(*settled.columns)).select(
        "doc_id", "n_shingles", linked.alias("component_id"), F.col("doc_id").eqNullSafe(linked).alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: int = 75) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the least id (null last), then the first.

    Every row is a document of its own here, whether its id repeats or is null.
    """
    rows = with_rows(docs)
    linked = _linked(rows.select(F.col("_row").alias("row"), F.col("_row").alias("doc_id"), "text"), similarity).select(F.col("doc_id").alias("_row"), "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row"))
    kept = linked.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(best.alias("best"))
    return rows_kept(rows, kept.select(F.col("best._row").alias("_row")), docs.columns)
