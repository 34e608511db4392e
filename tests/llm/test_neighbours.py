import numpy as np

from loomgraph.llm.neighbours import Graph, nearest, pairs, recall, unit

SCHEMA = "vec_id long, value array<float>, u string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, 64))
    return c[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, 64))


def test_graph_recall():
    x = unit(clustered(1500)).astype(np.float32)
    got, _ = Graph(x).search(x[:200], 48)
    true = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(got, true)]) > 0.95


def test_small_sets_are_exact_and_dirt_is_left_out(spark):
    v = clustered(40, 1)
    rows = [(i, v[i]) for i in range(40)]
    dirt = [(100, None), (101, []), (102, v[0][:63]), (103, [0.0] * 64), (104, [float("nan")] + [1.0] * 63), (105, [float("inf")] + [1.0] * 63), (106, [None] + [1.0] * 63)]
    got = {(r.vec_id, r["rank"]): r.neighbour for r in nearest(frame(spark, rows + dirt)).collect()}
    u = unit(np.array(v, np.float32))
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = {(i, k + 1): int(j) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(40), -s[i]))[:5])}
    assert got == want


def test_equal_vectors_scaled_vectors_and_ties(spark):
    v = clustered(3, 2)
    rows = [(i, v[0]) for i in range(20, 0, -1)] + [(50, 2 * v[0]), (60, v[1])]
    got = nearest(frame(spark, rows)).collect()
    of = lambda i: [r.neighbour for r in sorted(got, key=lambda r: r["rank"]) if r.vec_id == i]
    assert of(20) == [1, 2, 3, 4, 5] and of(3) == [1, 2, 4, 5, 6] and of(50) == [1, 2, 3, 4, 5]
    p = {tuple(r) for r in pairs(nearest(frame(spark, rows))).collect()}
    assert all(a < b for a, b in p) and (1, 20) in p


def test_empty_and_single(spark):
    assert nearest(frame(spark, [])).collect() == []
    assert nearest(frame(spark, [(1, np.ones(64))])).collect() == []
    assert recall(frame(spark, []), nearest(frame(spark, []))).first()["queries"] == 0


def test_recall_over_several_shards(spark):
    df = frame(spark, list(enumerate(clustered(900, 3))))
    assert recall(df, nearest(df, shard=150)).first()["recall"] >= 0.9
