"""Every registered core query against its SQL on the smallest data, and the driver's contract."""

import math
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def rows(rel):
    cols = sorted(rel[0])
    at = [rel[0].index(c) for c in cols]

    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v

    return cols, sorted(str(tuple(norm(r[i]) for i in at)) for r in rel[1])


def core():
    from loomgraph.plans.queries import oracle_sql, queries

    return queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(core()[1]))
def test_query_equals_sql(spark, name):
    import duckdb

    queries, oracle = core()
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, want = queries[name](spark, DATA), c.sql(oracle[name])
    assert rows((df.columns, df.collect())) == rows((want.columns, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(core()[0]) - set(core()[1])))
def test_other_queries_run(spark, name):
    assert core()[0][name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_soft_alignment_covers_the_whole_graph(spark):
    import numpy as np

    from loomgraph.model import LABEL, TYPE
    from loomgraph.operators.similarity import hashed_ngrams
    from loomgraph.plans.derived import graph
    from loomgraph.plans.queries import queries

    rows = [(r.s, r.p, r.o) for r in graph(spark, DATA).select("s", "p", "o").distinct().collect()]
    label, types = {}, {}
    for s, p, o in rows:
        if p == LABEL:
            label[s] = min(o, label.get(s, o))
        elif p == TYPE:
            types.setdefault(s, set()).add(o)
    names = sorted(set(label.values()))
    v = hashed_ngrams(names)
    sim = np.round(v @ v.T, 4)
    best = {n: names[int(sim[i].argmax())] for i, n in enumerate(names) if sim[i].max() >= 0.95}
    named = {}
    for s in label:
        named.setdefault(label[s], []).append(s)
    pairs = {(a, b) for a in label for b in named.get(best.get(label[a]), []) if types.get(a, set()) & types.get(b, set())}
    got = queries()["ref_entity_alignment"](spark, DATA).first()
    assert got.tp == len({b for _, b in pairs}) and got.fp == len(set(label) - {a for a, _ in pairs})
    soft = queries()["ref_alignment_soft"](spark, DATA).first()
    assert soft.tp + soft.fn == len(rows)
