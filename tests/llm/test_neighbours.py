"""The forest against brute force, on odd vectors, copies and empty tables."""

import datetime as dt

import numpy as np

from ferrule.llm import neighbours as N

SCHEMA = "element_id string, row_id long, indexed_at timestamp_ntz, v array<float>, sim float"
DAY = dt.datetime(2024, 1, 1)


def table(spark, vectors):
    return spark.createDataFrame([(f"e{i}", i, DAY, None if v is None else [None if x is None else float(x) for x in v], 0.5) for i, v in enumerate(vectors)], SCHEMA)


def test_packing_of_vectors_is_close():
    v = np.random.default_rng(1).normal(size=(200, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.abs(N.unpack(N.pack(v)) @ v.T - v @ v.T).max() < 1e-3


def test_recall_against_brute_force(spark):
    g = np.random.default_rng(2)
    base = g.normal(size=(1500, 64))
    near = base[:300] + 0.25 * g.normal(size=(300, 64))
    v = np.concatenate([base, near])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(int(a), int(b)) for a, b in zip(*np.where(s >= 0.9))}
    got = {(r["a"], r["b"]) for r in N.nearest(table(spark, v), ["v"], least=0.9, candidates=lambda n: n / 4).collect() if r["sim"] >= 0.9}
    assert len(want) > 400 and len(got & want) >= 0.9 * len(want) and not {p for p in got - want if s[p] < 0.8995}


def test_recall_of_all_ten_and_exact_mode(spark):
    """Clustered vectors: the ascent finds nine in ten while it scores a third of the pairs; with no end it is exact."""
    g = np.random.default_rng(6)
    centres = g.normal(size=(60, 64))
    v = np.concatenate([c + 0.6 * g.normal(size=(50, 64)) for c in centres])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = {(int(a), int(b)) for a in range(0, 3000, 50) for b in np.argsort(-s[a])[:10]}
    rows = table(spark, v)
    some = {(r["a"], r["b"]) for r in N.nearest(rows, ["v"], candidates=lambda n: n / 3, ask=lambda c: c % 50 == 0).collect()}
    assert 0.9 * len(top) <= len(top & some) and len(some) == len(top)
    every = {(r["a"], r["b"]) for r in N.nearest(rows, ["v"], trees=1, candidates=lambda n: float("inf"), ask=lambda c: c % 50 == 0).collect()}
    assert len(every & top) >= len(top) - 2  # rounding may swap the last places


def test_ascent_ends_at_the_longest_common_prefix_with_enough(spark):
    """With cells as fine as the array the depth is that of brute force over all prefixes."""
    g = np.random.default_rng(7)
    n, trees = 600, 3
    v = N.unpack(N.pack((lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(g.normal(size=(n, 64)))))
    raw, turns = N.pack(v), N.rotations(trees)
    code = [N.codes(v, t) for t in turns]
    bounds = [np.unique(N.keys(c, raw))[1:] for c in code]
    counts = np.zeros(trees * N.CELLS, np.int64)
    for t in range(trees):
        np.add.at(counts, t * N.CELLS + np.searchsorted(bounds[t], N.keys(code[t], raw), side="right"), 1)
    plan = N.planned(counts, bounds, 8)
    got = N.ascent(plan, 0, code, 40)
    for i in range(0, n, 7):
        held = [sum(int(((c & N.PREFIX[d]) == (c[i] & N.PREFIX[d])).sum()) for c in code) for d in range(30)]
        want = max(d for d in range(30) if held[d] >= 40)
        assert abs(int(got[i]) - want) <= 1
    assert (N.ascent(plan, 0, code, float("inf")) == 0).all()


def test_pairs_in_doubt_are_settled_by_the_vectors(spark):
    one, other = np.zeros(64), np.zeros(64)
    one[0], other[1] = 1, 1
    at = lambda c: c * one + np.sqrt(1 - c * c) * other
    rows = table(spark, [one, at(0.9005), at(0.8995), at(0.95), at(0.5)])
    near = spark.createDataFrame([(0, 0, k, 0.9, k) for k in (1, 2)] + [(0, 0, 3, 0.95, 0), (0, 0, 4, 0.5, 0)], "field int, a long, b long, sim float, place int")
    assert {r["b"] for r in N.settled(near, rows, ["v"], 0.9).collect()} == {1, 3}


def test_odd_vectors_versions_and_copies(spark):
    g = np.random.default_rng(3)
    one = g.normal(size=64)
    rows = [None, [], [0.0] * 64, [1.0] * 32, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, *[one * (k + 1) for k in range(30)], one + 0.05 * g.normal(size=64), g.normal(size=64)]
    got = N.nearest(table(spark, rows), ["v"], least=0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r["a"], []).append(r["b"])
    assert set(by) == set(range(7, 38)) and all(len(set(x)) == 10 for x in by.values())
    both = table(spark, [one, g.normal(size=64)]).union(spark.createDataFrame([("e0", 9, DAY + dt.timedelta(1), [float(x) for x in g.normal(size=64)], 0.1)], SCHEMA))
    assert {r["a"] for r in N.nearest(both, ["v"]).collect()} == {1, 9}
    assert N.nearest(spark.createDataFrame([], SCHEMA), ["v"]).count() == 0


def test_no_partition_edge_cuts_the_search(spark):
    """With the whole collection in reach the search is exact, into however many partitions it is cut."""
    g = np.random.default_rng(4)
    v = g.normal(size=(700, 64))
    v[600:] = v[:100]  # copies
    rows = table(spark, v)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({(r["a"], r["b"]): r["sim"] for r in N.nearest(rows, ["v"], trees=2, candidates=lambda n: float("inf"), ask=lambda c: c % 50 == 0).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    w = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = w @ w.T
    for a in range(0, 700, 50):
        sims = sorted((x for (q, _), x in got[0].items() if q == a), reverse=True)
        assert np.allclose(sims, np.sort(np.delete(s[a], a))[::-1][:10], atol=1e-3)
    assert set(got[0]) == set(got[1])


def test_a_hot_node_is_split_and_found(spark):
    """Many near-equal vectors beside others: every one of them finds ten similar ones, wherever parts are cut."""
    g = np.random.default_rng(5)
    v = np.concatenate([g.normal(size=64) + 0.02 * g.normal(size=(800, 64)), g.normal(size=(800, 64))])
    got = N.nearest(table(spark, v), ["v"], least=0.9).groupBy("a").count().collect()
    assert {r["a"] for r in got if r["count"] == 10} == set(range(800))
