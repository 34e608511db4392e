import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.components import components, plain_iri, tail


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a.strip() and b.strip() and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


def run(spark, pairs):
    return {tuple(r) for r in components(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}


@pytest.mark.parametrize("seed, rest", [(1, 10_000), (2, 0)])
def test_random_graph_equals_union_find(spark, monkeypatch, seed, rest):
    monkeypatch.setattr("loomgraph.llm.components.TAIL", rest)
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)]
    assert run(spark, pairs) == groups(pairs)


def test_long_chain_star_nulls_and_repeats(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)]
    star = [("hub", f"s{i}") for i in range(60)]
    dirt = [(None, "x"), ("x", None), ("", "y"), ("z", "z"), ("c001", "c000"), ("hub", "s1")]
    assert run(spark, chain + star + dirt) == groups(chain + star)


def test_tail_equals_union_find():
    rng = random.Random(3)
    for n in (5, 60, 400):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(i, i + 1) for i in range(1000, 1100)]
        pairs = [(a, b) for a, b in pairs if a != b]
        (got,) = tail([pd.DataFrame(pairs, columns=["a", "b"])])
        root = dict(groups([(f"{a:05d}", f"{b:05d}") for a, b in pairs]))
        assert {f"{v:05d}" for v in got["v"]} == set(root)
        label = {}
        for v, c in zip(got["v"], got["c"]):
            assert label.setdefault(root[f"{v:05d}"], c) == c
        assert len(set(label.values())) == len(label)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([("p", "q", 1, "w")], "a string, b string, v int, record string")
    assert {tuple(r) for r in components(df, "a", "b").collect()} == {("p", "p"), ("q", "p")}


def test_plain_iri(spark):
    df = spark.createDataFrame([("<HTTP://Seed.Example/A/b>",), (" http://x.example/Y\t",), ("  ",), (None,)], "i string")
    assert [r[0] for r in df.select(plain_iri(F.col("i"))).collect()] == ["http://seed.example/A/b", "http://x.example/Y", None, None]
