"""Near duplicates among vectors of one label, by products of quantised tiles.

Equal vectors become one class first. The classes of a label are dealt to blocks, and every pair of
blocks is one tile: the matrix product of the blocks' codes of eight bits. Each vector u of
length one is its scale times its code and a rest e, so a product of codes is off by at most
|e_u| + (1 + |e_u|) |e_v|. Only pairs that this error could lift to the threshold are computed in
double precision. A tile gives back a number of links for each vector and a forest that spans its
links, so what leaves it grows with its vectors and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import null_safe_join, numbered, parts, shipped, written
from .components import connected_components

#: Codes reach from -127 to 127; sums of so many products of codes are whole numbers that a float of 32 bits holds.
CODE, SLAB = 127, 1024
#: What rounding in double precision can add to an error bound.
SLACK = 1e-9
#: Rows of a tile that are multiplied at once.
STRIP = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; they are finite and none is zero."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes, scales, rests: rows are codes times scale up to a rest of the length given."""
    scale = np.abs(units).max(axis=1) / CODE
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    rest = units - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) + SLACK


def bound(rest_a: np.ndarray, rest_b: np.ndarray) -> np.ndarray:
    """The most by which scaled products of codes differ from products of the rows, for all pairs."""
    return rest_a[:, None] + (1 + rest_a[:, None]) * rest_b[None, :] + SLACK


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all pairs of codes, exact: by matrix products of floats that hold whole numbers."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLAB):
        out += a[:, at : at + SLAB].astype(np.float32) @ b[:, at : at + SLAB].astype(np.float32).T
    return out


def tile(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b) with a cosine of ``threshold`` or more; of a block with itself, each pair once."""
    (units_a, codes_a, scale_a, rest_a), (units_b, codes_b, scale_b, rest_b) = a, b
    left, right = [], []
    for at in range(0, len(units_a), STRIP):
        to = at + STRIP
        about = _product(codes_a[at:to], codes_b) * scale_a[at:to, None] * scale_b[None, :]
        i, j = np.nonzero(about + bound(rest_a[at:to], rest_b) >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            real = np.einsum("ij,ij->i", units_a[p], units_b[q]) >= threshold
            left.append(p[real])
            right.append(q[real])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that links join it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _classes(rows: DataFrame, id_col: str) -> DataFrame:
    """group (label and dimension), class_id, n, least, embedding: equal vectors of a label once, numbered, written."""
    own = rows.filter("fit").groupBy("label", "digest").agg(F.count("*").alias("n"), F.min(id_col).alias("least"), F.any_value("embedding").alias("embedding"))
    own = own.select("label", F.size("embedding").alias("dim"), "digest", "n", "least", "embedding", F.monotonically_increasing_id().alias("class_id"))
    return written(own, "classes")


def _blocks(classes: DataFrame, size: int) -> DataFrame:
    """label, dim, block, ids, weights, vectors: the classes of a label, ``size`` at a time, packed."""
    dealt = numbered(classes.select("label", "dim", "class_id", "n", "embedding"), ["label", "dim"], ["class_id"], "place")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        vectors = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        kept = [group[c].to_numpy(dtype=np.int64).tobytes() for c in ("class_id", "n")]
        return pd.DataFrame([(first["label"], first["dim"], first["block"], *kept, vectors.tobytes())], columns=["label", "dim", "block", "ids", "weights", "vectors"])

    kind = classes.schema["label"].dataType.simpleString()
    blocks = dealt.withColumn("block", F.floor(F.col("place") / size)).groupBy("label", "dim", "block")
    return written(blocks.applyInPandas(pack, f"label {kind}, dim int, block long, ids binary, weights binary, vectors binary"), "blocks")


def _tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """class_id, links, root: for each class of each tile how many vectors it is linked with there, and the least class that these links join it to; classes without links are left out."""
    ship = shipped(blocks.sparkSession, {"unit": unit, "quantised": quantised, "tile": tile, "forest": forest})
    counts = blocks.groupBy("label", "dim").agg(F.count("*").alias("n_blocks"))
    # a block meets itself and each later one of its label once
    left = blocks.join(counts.hint("merge"), ["label", "dim"]).withColumn("other", F.explode(F.expr("sequence(block, n_blocks - 1)"))).drop("n_blocks")
    right = blocks.select("label", "dim", F.col("block").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("ids", "weights", "vectors")])
    pairs = left.join(right.hint("merge"), ["label", "dim", "other"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = ship()
        for batch in parts(batches, 1):
            r = batch.to_pylist()[0]
            ids, weights, vectors = ([np.frombuffer(r[f"{c}{side}"], dtype=k) for side in ("", "_b")] for c, k in (("ids", np.int64), ("weights", np.int64), ("vectors", np.float64)))
            units = [use["unit"](v.reshape(-1, r["dim"])) for v in vectors]
            a, b = ((u, *use["quantised"](u)) for u in units)
            same = r["block"] == r["other"]
            i, j = use["tile"](a, b, same, threshold)
            j = j if same else j + len(ids[0])
            nodes, heavy = (ids[0], weights[0]) if same else (np.concatenate(ids), np.concatenate(weights))
            links = np.zeros(len(nodes), dtype=np.int64)
            np.add.at(links, i, heavy[j])
            np.add.at(links, j, heavy[i])
            root = nodes[use["forest"](i, j, len(nodes))]
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(root[hit])], names=["class_id", "links", "root"])

    return written(pairs.mapInArrow(each, "class_id long, links long, root long"), "tiles")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, block: int = 2048, support: float = 0.001, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors are linked if their labels are equal and not null, their dimensions are equal, and their
    cosine in double precision is ``threshold`` or more. A null label, a null, empty or zero vector, or one
    with a null or non-finite component links with nothing. n_links counts rows, equal vectors among them;
    component_id is the least id reachable, and kept says whether it is the row's own. A row with a null id is
    kept if nothing with an id is reachable. Repeated rows are vectors of their own. An empty table gives an
    empty result; other columns are ignored, whatever their names.

    ``block`` bounds the classes of a block and does not change results. Classes of more than ``support`` of
    the rows, at most 1 / support of them, are broadcast to their rows.
    """
    v = F.col(vector_col)
    sound = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # a negative zero is a zero
    plain = F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)).otherwise(x))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.coalesce(sound, F.lit(False)).alias("fit"), plain.alias("embedding"))
    rows = rows.withColumn("digest", F.when(F.col("fit"), F.sha2(F.array_join(F.col("embedding").cast("array<string>"), ","), 256)))
    rows = written(rows, "vectors")
    classes = _classes(rows, "vec_id")
    found = _tiles(_blocks(classes, block), threshold)
    components = connected_components(found.filter("class_id <> root").select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    direct = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    info = classes.select("class_id", "label", "digest", "n", "least").join(direct.hint("merge"), "class_id", "left")
    info = info.join(components.withColumnRenamed("node", "class_id").hint("merge"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    info = written(info, "info")
    # the classes of one component are partly summed before they meet, and the least id goes back over the component's number
    least = info.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_classes"))
    told = info.filter("links is null").select("label", "digest", "n", "links", F.col("least").alias("component_id"))
    linked = _with_least(info.filter("links is not null"), least.filter("n_classes > 1"), support)
    told = written(told.unionByName(linked), "told")
    answers = told.select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "n")
    total = rows.filter("fit").count()
    frequent = F.broadcast(answers.filter(F.col("n") > max(support * total, 1)).drop("n"))
    keyed = rows.filter("fit").select("vec_id", "label", "digest")
    hot = keyed.join(frequent, ["label", "digest"])
    cold = keyed.join(F.broadcast(answers.filter(F.col("n") > max(support * total, 1)).select("label", "digest")), ["label", "digest"], "left_anti")
    cold = cold.join(answers.drop("n").hint("merge"), ["label", "digest"])
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    columns = ["vec_id", "n_links", "component_id"]
    whole = hot.select(*columns).unionByName(cold.select(*columns)).unionByName(alone)
    return whole.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_least(info: DataFrame, least: DataFrame, support: float) -> DataFrame:
    """label, digest, n, links, component_id: linked classes with the least id of their component; components of more than ``support`` of them are broadcast."""
    total = least.agg(F.sum("n_classes")).first()[0] or 0
    large = F.broadcast(least.filter(F.col("n_classes") > max(support * total, 1)).select("component", "component_id"))
    hot = info.join(large, "component")
    cold = info.join(large.select("component"), "component", "left_anti").join(least.select("component", "component_id").hint("merge"), "component")
    return hot.unionByName(cold).select("label", "digest", "n", "links", "component_id")


def keep_one_of_each(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """The rows of ``vectors`` that ``near_vectors`` keeps, with all their columns; vec_id tells rows apart, and rows of a null id stay."""
    kept = near_vectors(vectors, threshold).filter("kept").select("vec_id").distinct()
    return null_safe_join(vectors, kept.hint("merge"), ["vec_id"], "left_semi")
