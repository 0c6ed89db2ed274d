"""Near-duplicates among many that share a passage, hot keys, and sets of a few shingles."""

import random

import numpy as np
import pytest

from pagemill.llm import minhash
from pagemill.llm._shared import salted_join, written
from pagemill.llm.components import connected_components

N, SHARED, OWN = 1200, 40, 20


def crowd():
    """Texts with one passage in common (similarity about 0.5), two thirds of them in pairs from below to above the mark."""
    rng = random.Random(11)
    passage = [f"s{i}" for i in range(SHARED)]
    rows = []
    for k in range(N):
        own = [f"o{k}x{i}" for i in range(OWN)]
        if k % 3 == 1:  # like the text before it but for its last words
            cut = rng.randrange(2, 16)
            own = rows[-1][1].split()[SHARED:][:-cut] + own[:cut]
        rows.append((k, " ".join(passage + own)))
    return rows


def true_links(rows):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    known = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(known)), dtype=np.float32)
    for i, s in enumerate(sets):
        has[i, [known[x] for x in s]] = 1
    both, n = has @ has.T, has.sum(axis=1)
    a, b = np.nonzero(100 * both >= 75 * (n[:, None] + n[None, :] - both))
    return {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j}


@pytest.fixture(scope="module")
def planted():
    rows = crowd()
    return rows, true_links(rows)


def test_recall_in_a_planted_crowd(spark, planted, monkeypatch):
    rows, links = planted
    found = {}
    for block in (100, 1024):  # buckets are dealt by a second band, or not: nobody can tell
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        found[block] = {r.doc_id: r.component_id for r in got}
    assert found[100] == found[1024]
    component = found[100]
    assert len(links) > 200 and sum(component[a] == component[b] for a, b in links) == len(links)
    linked = {a for a, b in links} | {b for a, b in links}
    assert all(component[k] == k for k in range(N) if k not in linked)


def test_what_blocks_compare_does_not_depend_on_their_size(spark, planted, monkeypatch):
    rows, _ = planted
    signed = written(minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id row", "doc_id", "text")), "signed")
    sets = written(spark.createDataFrame(rows, "node long, text string").selectExpr("node row", "text").mapInArrow(minhash._sets, "node long, shingles array<long>, signature binary, sketch binary"), "sets")
    buckets = signed.selectExpr("posexplode(bands) as (band, key)", "row node", "n_shingles n")
    nobody = spark.createDataFrame([], "node long, component long")
    found = []
    for block in (5, 100, 1024):
        monkeypatch.setattr(minhash, "BLOCK", block)
        found.append({(r.a, r.b) for r in minhash._across_components(buckets, nobody, signed, sets, 75).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 200


def test_sets_of_a_few_shingles():
    """Three of four shingles in common: a band holds values of different permutations, so it agrees as often as independence says."""
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(3000):
        a = np.unique(rng.integers(0, 2**63, 4, dtype=np.uint64))
        b = np.delete(a, rng.integers(0, 4))
        agree.append((minhash.band_keys(minhash.signature(a)) == minhash.band_keys(minhash.signature(b))).sum())
    agree = np.array(agree)
    assert abs(agree.mean() / minhash.BANDS - 0.75**4) < 0.01
    assert (agree == 0).sum() == 0 and (agree < 2).sum() <= 3


@pytest.mark.parametrize("support", [0.001, 0.1, 1.0])
def test_salted_join(spark, support):
    rows = [(k % 7 if k % 3 else 100, k) for k in range(900)]
    left = spark.createDataFrame(rows, "key long, v long")
    right = written(left.groupBy("key").agg({"v": "min", "*": "count"}).selectExpr("key", "`min(v)` least", "`count(1)` n"), "right")
    got = sorted((r.key, r.v, r.least) for r in salted_join(left, right, "key", "n", ["v"], support).collect())
    least = {}
    for k, v in rows:
        least[k] = min(v, least.get(k, v))
    assert got == sorted((k, v, least[k]) for k, v in rows)


def test_a_hot_key_is_in_many_tasks(spark):
    left = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1L ELSE id END key", "id v")
    right = written(left.groupBy("key").count(), "right")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        joined = salted_join(left, right, "key", "count", ["v"]).selectExpr("spark_partition_id() p", "key")
        sizes = {r.p: r["count"] for r in joined.filter("key = -1").groupBy("p").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 16 and sum(sizes.values()) == 6667 and max(sizes.values()) < 1000


def test_components_of_a_star(spark):
    """A centre with thousands of neighbours, and a chain that hangs on it."""
    links = [(0, k) for k in range(1, 4000)] + [(k, k + 1) for k in range(4000, 4040)] + [(3999, 4000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 4041), 0)
