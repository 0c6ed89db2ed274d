"""Near-duplicate vectors against brute force, in small and large tiles, and their edge cases."""

import numpy as np
import pytest

from pagemill.llm import vector_dedup
from pagemill.llm._shared import table

ROW = "vec_id long, embedding array<float>, label int, digest string, class_id string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "d", "c", "k") for i, v, lab in rows], ROW)


def brute(rows, threshold=0.93):
    """vec_id, n_links, component_id, kept of each row, by all pairs."""
    n = len(rows)
    fit = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    units = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if f else None for f, (_, v, _) in zip(fit, rows, strict=True)]
    near = [[b for b in range(n) if b != a and fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold] for a in range(n)]
    out = []
    for a in range(n):
        reach, new = {a}, [a]
        while new:
            new = [b for x in new for b in near[x] if b not in reach and not reach.add(b)]
        ids = [rows[b][0] for b in reach if rows[b][0] is not None]
        least = min(ids, default=None)
        out.append((rows[a][0], len(near[a]), least, rows[a][0] == least))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def planted(seed, n=240, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, dim))
    rows = [(i, base[rng.integers(len(base))] + rng.normal(size=dim) * rng.choice([0, 0.1, 0.25, 0.4]), int(rng.integers(3))) for i in range(n)]
    return [(int(i), v.astype(np.float32).tolist(), lab) for i, v, lab in rows]


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_links_and_components_of_planted_vectors(spark, block):
    rows = planted(block)
    same(vector_dedup.near_vectors(vectors(spark, rows), block=block).collect(), brute(rows))


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    same(vector_dedup.near_vectors(table(spark, sf, "embeddings")).collect(), brute(rows))


ODD = [
    (1, None, 1), (2, [], 1), (3, [0, 0], 1), (4, [1, None], 1), (5, [float("nan"), 1], 1), (6, [float("inf"), 1], 1), (7, [1, 2], None), (8, [1, 2], 1), (8, [1, 2], 1), (None, [2, 4], 1),
    (9, [1, 2, 0], 1), (10, [-0.0, 1], 2), (11, [0.0, 3], 2), (12, [1e-38, 0], 2), (13, [3e38, 0], 2), (None, [5, 1], 3), (None, None, None), (14, [-1, -2], 1),
]


def test_edges(spark):
    same(vector_dedup.near_vectors(vectors(spark, ODD)).collect(), brute(ODD))
    assert vector_dedup.near_vectors(vectors(spark, [])).count() == 0
    kept = vector_dedup.keep_one_of_each(vectors(spark, ODD))
    assert kept.columns == [x.split()[0] for x in ROW.split(", ")]
    assert {r.vec_id for r in kept.collect()} >= {1, 7, 8, 9, 10, 14}


def test_many_copies_are_one_class(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0 + i / 10], 1) for i in range(20)]
    same(vector_dedup.near_vectors(vectors(spark, rows), support=0.1).collect(), brute(rows))


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64, 1500):
        a, b = (vector_dedup.unit(rng.normal(size=(50, dim)) * rng.exponential(size=dim) ** 3) for _ in range(2))
        b[:10] = vector_dedup.unit(a[:10] + rng.normal(size=(10, dim)) * 0.05)
        (ca, sa, ra), (cb, sb, rb) = vector_dedup.quantised(a), vector_dedup.quantised(b)
        codes = vector_dedup._product(ca, cb)
        assert (codes == ca.astype(int) @ cb.astype(int).T).all()
        assert (np.abs(codes * sa[:, None] * sb[None, :] - a @ b.T) <= vector_dedup.bound(ra, rb)).all()


def test_only_what_may_reach_the_threshold_is_computed_again(monkeypatch):
    rng = np.random.default_rng(3)
    units = vector_dedup.unit(rng.normal(size=(400, 64)))
    block, seen = (units, *vector_dedup.quantised(units)), []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda s, a, b: seen.append(len(a)) or einsum(s, a, b))
    i, j = vector_dedup.tile(block, block, True, 0.4)
    want = {(p, q) for p, q in zip(*np.nonzero(units @ units.T >= 0.4), strict=True) if p < q}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert sum(seen) < 0.02 * 400 * 400
