import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.model import LABEL, TYPE, XSD, Ontology, as_graph
from loomgraph.operators import cluster, consistency, construct, fusion, linking, reference, similarity, statistics

N = "http://n/"
T5 = "s string, p string, o string, k string, dt string"


def g(spark, *rows):
    full = [(s, p, o, *(rest or ("iri", None))) if len(rest) != 1 else (s, p, o, rest[0], None) for s, p, o, *rest in rows]
    return as_graph(spark.createDataFrame([tuple(r) for r in full], T5))


def onto(spark):
    classes = [(N + "A", "a", [N + "B"]), (N + "B", "b", [N + "A"])]
    props = [(N + "ab", "object", "ab", [], N + "A", N + "B", None, 1), (N + "int", "datatype", "int", [], N + "A", XSD + "integer", 1, 1), (N + "free", "datatype", "free", [], None, None, None, None)]
    return Ontology.of(spark, classes, props)


def test_inference_hides_domain_violation_unless_disjoint(spark):
    t = g(spark, ("x", N + "ab", "y"), ("z", N + "ab", "y"), ("z", TYPE, N + "B"))
    o = onto(spark)
    assert consistency.infer_types(t, o).where(F.col("p") == TYPE).count() == 4
    d = consistency.domain_check(t, o).first()
    assert (d.good, d.bad, d.score) == (1, 1, 0.5)
    assert [r.s for r in consistency.disjoint_subjects(t, o).collect()] == ["z"]
    assert consistency.disjoint_subjects(t, o, infer=False).count() == 0


def test_metrics_on_empty_graphs(spark):
    e, o = g(spark, ("x", "p", "o")).limit(0), onto(spark)
    assert consistency.range_check(e, o).first().score == 1.0
    assert consistency.domain_check(e, o).first().score == 0.0 == consistency.direction(e, o).first().score
    assert statistics.loose_score(e).first().score == 0.0
    assert reference.confusion(e, e, ["s"]).first().f1 == 0.0


def test_direction_cardinality_datatype_format(spark):
    o = onto(spark)
    t = g(spark, ("a", TYPE, N + "A"), ("b", TYPE, N + "B"), ("a", N + "ab", "b"), ("b", N + "ab", "a"), ("a", N + "int", "1", "literal", XSD + "integer"), ("a", N + "int", "x", "literal", XSD + "string"), ("a", N + "free", "f", "literal", None))
    assert tuple(consistency.direction(t, o).first()) == (1, 1, 0.5)
    assert tuple(consistency.cardinality(t, o).first())[:2] == (3, 1)
    assert tuple(consistency.datatype_check(t, o).first())[:2] == (1, 2)
    assert tuple(consistency.format_check(t, o).first())[:2] == (2, 1)
    assert {r.rule for r in consistency.violations(t, o).collect()} == {"domain", "range", "format", "cardinality"}


def test_subclass_closure_with_cycle(spark):
    s = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
    t = g(spark, ("a", s, "b"), ("b", s, "c"), ("c", s, "b"))
    got = {(r.cls, r.super): r.depth for r in consistency.subclass_closure(t, 6).collect()}
    assert got[("a", "c")] == 2 and got[("b", "b")] == 2


@pytest.mark.parametrize("seed", [0, 1])
def test_components_are_an_equivalence(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {(r.uri, r.cid) for r in cluster.match_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {(x, find(x)) for x in parent}


def test_cluster_lookups(spark):
    c = cluster.match_components(spark.createDataFrame([("http://a/1", "http://q/2"), ("http://q/2", "http://b/3")], "a string, b string"))
    assert {r.match for r in cluster.match_in_namespace(c, "http://q/").collect()} == {"http://q/2"}
    p = spark.createDataFrame([("http://a/1", "http://b/3"), ("http://x/9", "http://y/9"), ("http://u/1", "http://u/2")], "a string, b string")
    assert {(r.a, r.matched) for r in cluster.is_match(p, c).collect()} == {("http://a/1", True), ("http://x/9", True), ("http://u/1", False)}


def test_greedy_matching_equals_sequential(spark):
    rng = random.Random(4)
    rows = {(f"a{rng.randrange(12)}", f"b{rng.randrange(12)}"): rng.randrange(5) / 4 for _ in range(60)}
    used, want = set(), set()
    for (a, b), s in sorted(rows.items(), key=lambda x: (-x[1], x[0])):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in rows.items()], "id_1 string, id_2 string, score double")
    assert {(r.id_1, r.id_2) for r in cluster.greedy_matching(df).collect()} == want


def test_greedy_matching_leaves_no_pair_of_a_chain(spark):
    chain = [(f"a{i // 2 + i % 2:03}", f"b{i // 2:03}", 1.0) for i in range(8)]
    df = spark.createDataFrame(chain, "id_1 string, id_2 string, score double")
    assert {(r.id_1, r.id_2) for r in cluster.greedy_matching(df).collect()} == {(f"a{i:03}", f"b{i:03}") for i in range(4)}
    with pytest.raises(RuntimeError):
        cluster.greedy_matching(df, max_rounds=2)


def test_set_cover_and_agglomeration(spark):
    df = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "b"), ("d3", "c"), ("d4", "c")], "doc string, path string")
    assert [(r.doc, r.new_paths) for r in cluster.set_cover(df).orderBy("step").collect()] == [("d1", 2), ("d3", 1)]
    import numpy as np

    assert cluster.agglomerate(np.array([[1, 0], [0.9, 0.1], [0, 1]])) == [0, 0, 1]


def test_first_value_and_votes(spark):
    o = onto(spark)
    src = g(spark, ("x", N + "int", "2", "literal", XSD + "integer"), ("x", N + "int", "1", "literal", XSD + "integer"), ("y", N + "int", "9", "literal", XSD + "integer"), ("x", N + "free", "n", "literal", None), ("x", N + "unknown", "u", "literal", None))
    tgt = g(spark, ("y", N + "int", "5", "literal", XSD + "integer"))
    out = fusion.select_first_value(src, tgt, o)
    assert {(r.s, r.o) for r in out["graph"].collect()} == {("y", "5"), ("x", "1"), ("x", "n")}
    assert {(r.s, r.o) for r in out["discarded"].collect()} == {("x", "2"), ("y", "9")}
    v = spark.createDataFrame([("k", "a", 0.1, 0, "s"), ("k", "b", 0.9, 1, "t"), ("k", "b", 0.1, 2, "t"), ("k", "a", 0.9, 3, "t")], "key string, value string, score double, seq int, src string")
    assert fusion.majority(v, ["key"]).first().value == "a"
    assert fusion.preferred(v, ["key"], "src", "s").first().value == "a"


def test_union_is_idempotent_and_substitution(spark):
    a = g(spark, ("http://t/1", "p", "http://s/2"))
    assert fusion.union(a, a).count() == 1
    m = spark.createDataFrame([("http://s/2", "http://t/2", 0.9, "entity"), ("http://t/9", "http://s/1", 0.5, "entity")], "id_1 string, id_2 string, score double, id_type string")
    assert {r.o for r in fusion.union_matched(a, a.limit(0), m, "http://t/").collect()} == {"http://t/2"}
    f = spark.createDataFrame([("a_uri", "b_literal", 0.9, "relation"), ("a-", "b", 0.9, "relation"), ("a", "b", 0.5, "relation")], m.schema)
    assert [tuple(r)[:2] for r in fusion.filter_matches(f).collect()] == [("a", "b")]


def test_json_graph(spark):
    body = {"name": "Matrix", "year": 1999, "cast": ["Ann Lee", "Bo Ray"], "studio": {"name": "Old Mill", "town": {"name": "Rill"}}, "tags": [], "none": None, "crew": [{"name": "C"}, {"name": "C"}]}
    d = spark.createDataFrame([("m", json.dumps(body)), ("bad", "{")], "doc string, text string")
    nodes = construct.flatten_json(d)
    assert nodes.where("kind = 'corrupt'").count() == 1
    out = construct.json_triples(nodes, "http://r/", "http://o/")
    t = out["graph"]
    rows = {(r.p.replace("http://o/", ""), r.k, r.o if r.k == "literal" else "*") for r in t.collect() if r.p.startswith("http://o/")}
    assert {("year", "literal", "1999"), ("cast", "iri", "*"), ("studio", "iri", "*"), ("town", "iri", "*"), ("crew", "iri", "*")} <= rows
    assert {r.o for r in t.where(F.col("p") == LABEL).collect()} >= {"Matrix", "Ann Lee", "Old Mill", "Rill", "C"}
    assert t.where(F.col("p") == "http://o/crew").count() == 1  # equal objects merge
    paths = {r.path for r in construct.json_paths(nodes).collect()}
    assert "$.crew[*].name" in paths and "$.studio.town.name" in paths
    te = construct.json_document_triples(nodes)
    assert ("m", "year", "1999") in {(r.subject, r.predicate, r.object) for r in te.collect()}


def test_linked_json(spark):
    d = spark.createDataFrame([("m", json.dumps({"name": "Matrix", "len": "136", "maker": "Old Mill", "junk": "x"}))], "doc string, text string")
    nodes = construct.flatten_json(d)
    ents = spark.createDataFrame([("Matrix", "http://k/matrix", 0.9), ("Old Mill", "http://k/mill", 0.6)], "label string, uri string, score double")
    props = spark.createDataFrame([("len", "http://o/length", 0.9), ("maker", "http://o/maker", 0.8), ("junk", "http://o/junk", 0.2)], "key string, uri string, score double")
    info = spark.createDataFrame([("http://o/length", "http://o/Film", XSD + "integer"), ("http://o/maker", "http://o/Film", "http://o/Studio")], "uri string, domain string, range string")
    t = construct.linked_json(nodes, ents, props, info, "http://r/").collect()
    assert ("http://k/matrix", "http://o/length", "136") in {(r.s, r.p, r.o) for r in t}
    assert {r.o for r in t if r.p == TYPE} == {"http://o/Film", "http://o/Studio"}
    assert not [r for r in t if r.p == "http://o/junk"]


def test_extraction_chain(spark):
    t = spark.createDataFrame([("d", "He", "directed", "Matrix"), ("d", "Ann", "has length", "90")], "doc_id string, subject string, predicate string, object string")
    chains = spark.createDataFrame([("d", "Ann Lee", "he")], "doc_id string, main string, alias string")
    links = spark.createDataFrame([("d", "ann lee", "http://k/ann", "entity", 0.9), ("d", "DIRECTED", N + "ab", "relation", 0.3), ("d", "Matrix", "http://k/m", "entity", 0.4), ("d", "has length", N + "int", "relation", 0.9)], "doc_id string, span string, mapping string, link_type string, score double")
    x = linking.apply_links(linking.apply_chains(t, chains), links)
    got = linking.triples_from_text(x, onto(spark), "http://r/").collect()
    assert ("http://k/ann", N + "ab") in {(r.s, r.p) for r in got} and "http://k/m" not in {r.o for r in got}
    assert linking.triples_from_text(x, onto(spark), "http://r/", mint=False).where(F.col("p") == N + "ab").count() == 0
    docs = spark.createDataFrame([("d", "Ann Lee is a director. It was an error.")], "doc_id string, text string")
    assert ("Ann Lee", "director") in {(r.subject, r.object) for r in linking.pattern_triples(docs).collect()}


def test_documents_merge_and_shades(spark):
    a = spark.createDataFrame([("d", "t", ["x"])], "doc_id string, text string, links array<string>")
    b = spark.createDataFrame([("d", ["y"]), ("e", ["z"])], "doc_id string, links array<string>")
    assert {(r.doc_id, tuple(r.links)) for r in linking.merge_documents([a, b]).collect()} == {("d", ("x", "y")), ("e", ("z",))}
    links = spark.createDataFrame([("S", "u", "entity", 1.0), ("T", "v", "entity", 1.0), ("r", "p", "relation", 1.0)], "span string, mapping string, link_type string, score double")
    shade = spark.createDataFrame([("u", "orig")], "shade string, original string")
    assert {(r.span, r.mapping) for r in linking.filter_links_by_shade(links, shade).collect()} == {("S", "orig"), ("r", "p")}


def test_token_blocking_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.sample("a b c d e f g h".split(), rng.randrange(1, 6)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string")
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    want = {(i, j) for i, x in rows for j, y in rows if jac(x, y) >= 0.6}
    assert {(r.id_1, r.id_2) for r in linking.token_blocks(df, df, "id", "t", min_jaccard=0.6).collect()} == want


def test_nearest_blocks_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    v = [(i, [float(i % 3), 1.0, 0.5 * i]) for i in range(8)]
    df = spark.createDataFrame(v, "id long, v array<double>")
    got = similarity.nearest(df, df, "id", "v", "id", "v", 2).collect()
    assert {(r.id, r.id_2) for r in got if r["rank"] == 1} == {(i, i) for i in range(8)} and len(got) == 16
    assert similarity.similarity_join(df, df.withColumnRenamed("id", "r"), "id", "v", "r", "v", 1.0).count() == 0
    assert similarity.similarity_join(df, df.withColumnRenamed("id", "r"), "id", "v", "r", "v", 1.0, inclusive=True).count() == 8


def test_reference_metrics(spark):
    a = g(spark, ("a", LABEL, "Film A", "literal", None), ("a", TYPE, N + "A"), ("a", "p", "1", "literal", None))
    b = g(spark, ("z", LABEL, "Film A", "literal", None), ("z", TYPE, N + "A"), ("z", "p", "1", "literal", None))
    assert reference.triple_alignment(a, b).first().tp == 0
    assert reference.triple_alignment_soft(a, b).first().f1 == 1.0
    assert reference.triple_alignment_values(a, b).first().tp == 3
    for mode in ("label", "type", "intersecting_type"):
        assert reference.entity_alignment(a, b, mode).first().tp == 1
    other = g(spark, ("z", LABEL, "Film A", "literal", None), ("z", TYPE, N + "B"))
    assert reference.entity_alignment(a, other, "type").first().tp == 0
    v = spark.createDataFrame([("a", "x"), ("q", "Film A"), ("r", "none")], "uri string, label string")
    assert tuple(reference.source_coverage(a, v).first()) == (2, 3, 0.666667)


def test_sweep_matches_direct_count(spark):
    m = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (0.51,), (None,), (float("nan"),)], "score double")
    got = {r.threshold: r.kept for r in reference.threshold_sweep(m, 4).collect()}
    assert got == {t: sum(s > t for s in (0.5, 0.0, 1.0, 0.51)) for t in (0.0, 0.25, 0.5, 0.75, 1.0)}


def test_link_and_json_evaluation(spark):
    links = spark.createDataFrame([("d.txt", "u", "entity"), ("d.txt", "w", "entity")], "doc_id string, mapping string, link_type string")
    want = spark.createDataFrame([("d", "u"), ("d", "v")], "doc_id string, entity_id string")
    r = reference.link_evaluation(links, want).first()
    assert (r.hits, r["false"], r.missing, r.score) == (1, 1, 1, 0.5)
    act = spark.createDataFrame([("f", "$.a", "x"), ("f", "$.b", "loc/1"), ("f", "$.c", "bad"), ("f", "$.d", "extra")], "file string, path string, iri string")
    exp = spark.createDataFrame([("f", "$.a", "x"), ("f", "$.b", "y"), ("f", "$.c", "z")], act.schema)
    assert tuple(reference.json_linking_evaluation(act, exp, "loc/", ["file", "path"]).first())[:3] == (1, 2, 1)


def test_closure_of_a_long_chain_a_cycle_and_a_diamond(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)]
    got = {(r.a, r.b): r.depth for r in cluster.closure(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {(f"n{i:02d}", f"n{j:02d}"): j - i for i in range(31) for j in range(i + 1, 31)}
    odd = [("a", "b"), ("b", "a"), ("c", "d"), ("c", "e"), ("d", "f"), ("e", "f"), (None, "f")]
    got = {(r.a, r.b): r.depth for r in cluster.closure(spark.createDataFrame(odd, "a string, b string")).collect()}
    assert got == {("a", "b"): 1, ("b", "a"): 1, ("a", "a"): 2, ("b", "b"): 2, ("c", "d"): 1, ("c", "e"): 1, ("d", "f"): 1, ("e", "f"): 1, ("c", "f"): 2}
    assert cluster.closure(spark.createDataFrame([], "a string, b string")).collect() == []


def test_rounds_that_do_not_suffice_are_errors(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], "a string, b string")
    with pytest.raises(RuntimeError):
        cluster.match_components(chain, max_rounds=1)
    paths = spark.createDataFrame([("d1", "x"), ("d2", "y")], "doc string, path string")
    with pytest.raises(RuntimeError):
        cluster.set_cover(paths, max_docs=1)
    assert cluster.set_cover(paths).count() == 2


def test_lists_in_lists(spark):
    d = spark.createDataFrame([("d", '{"name": "x", "m": [[1, 2], [3, {"name": "y", "k": [[4]]}]]}')], "doc string, text string")
    nodes = construct.flatten_json(d)
    out = {(r.predicate, r.object) for r in construct.json_document_triples(nodes).collect()}
    assert {("m", "1"), ("m", "2"), ("m", "3"), ("k", "4"), ("name", "y")} <= out
    graph = construct.json_triples(nodes, "http://r/", "http://n/", heuristic=False)["graph"]
    assert {r.o for r in graph.where("k = 'literal'").collect()} >= {"1", "2", "3", "4"}


def no_driver(monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def fail(self, *a, **k):
        raise AssertionError("vectors go through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", fail)


def test_best_texts_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    words = ["red", "Red", "RED ", "blue ring", "Blue ring", "bleu ring", "", "a" * 30, "a" * 31, "x" * 1500 + "y", "x" * 1500 + "z"]
    a = words + ["".join(rng.choice("ab0") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    b = words[1:] + ["".join(rng.choice("ab0") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    left, right = spark.createDataFrame([(x,) for x in a] + [(None,)], "t string"), spark.createDataFrame([(x,) for x in b] + [(None,)], "t string")
    vec = lambda df, n: similarity.embed(df, "t").select(F.col("text").alias(n), F.col("vec").alias(f"{n}v"))
    want = {(r.x, r.y, r.score) for r in similarity.similarity_join(vec(left, "x"), vec(right, "y"), "x", "xv", "y", "yv", 0.8).collect()}
    no_driver(monkeypatch)
    for crowd in (similarity.CROWD, 1):
        monkeypatch.setattr(similarity, "CROWD", crowd)
        monkeypatch.setattr(similarity, "BLOCK", 2000 if crowd > 1 else 7)
        assert {(r.text, r.ref_text, r.score) for r in similarity.best_texts(left, right, 0.8).collect()} == want
    assert similarity.best_texts(left.limit(0), right).count() == similarity.best_texts(left, right.limit(0)).count() == 0


def test_values_are_aligned_without_the_driver(spark, monkeypatch):
    from loomgraph.operators.similarity import hashed_ngrams

    no_driver(monkeypatch)
    near = "the long road to the old harbour of the north"
    a = g(spark, ("a", LABEL, "Film A", "literal", None), ("a", "p", "1", "literal", None), ("a", "p", near + ".", "literal", None), ("a", "p", "other", "literal", None), ("a", "r", "c"), ("a", "q", "5", "literal", None), ("c", LABEL, "City", "literal", None))
    b = g(spark, ("z", LABEL, "Film A", "literal", None), ("z", "p", "1", "literal", None), ("z", "p", near, "literal", None), ("z", "r", "y"), ("y", LABEL, "City", "literal", None), ("y", "u", "7", "literal", None))
    v = hashed_ngrams([near, near + "."])
    assert v[0] @ v[1] > 0.95
    got = reference.triple_alignment_values(a, b).first()
    assert (got.tp, got.fp, got.fn) == (5, 2, 1)


def test_coverage_by_labels_in_another_spelling(spark, monkeypatch):
    no_driver(monkeypatch)
    a = g(spark, ("a", LABEL, "Film A", "literal", None), ("b", LABEL, "Film B", "literal", None))
    v = spark.createDataFrame([("x", "film a"), ("y", "Film A"), ("z", "nothing alike")], "uri string, label string")
    assert tuple(reference.source_coverage_soft(a, v).first()) == (2, 3, 0.666667)


def test_soft_alignment_without_the_driver(spark, monkeypatch):
    no_driver(monkeypatch)
    a = g(spark, ("a", LABEL, "Film A", "literal", None), ("a", "p", "c"), ("c", LABEL, "City", "literal", None))
    b = g(spark, ("z", LABEL, "film a", "literal", None), ("z", "p", "y"), ("y", LABEL, "City", "literal", None))
    got = reference.triple_alignment_soft(a, b).first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 1)


def test_entities_of_one_label_are_counted_not_paired(spark):
    """3.6 thousand million pairs of entities with the same label and type."""
    n = 60_000
    e = spark.range(n).select(F.explode(F.array(*[F.struct(F.concat(F.lit("e"), "id").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("k"), F.lit(None).cast("string").alias("dt")) for p, o, k in ((LABEL, F.lit("ring"), "literal"), (TYPE, F.when(F.col("id") == 7, N + "B").otherwise(N + "A"), "iri"))])).alias("r")).select("r.*")
    one = g(spark, ("z", LABEL, "Ring", "literal", None), ("z", TYPE, N + "A"), ("y", LABEL, "ring", "literal", None), ("y", TYPE, N + "C"))
    got = reference.entity_alignment(e, e, "intersecting_type").first()
    assert (got.tp, got.fp, got.fn) == (n, 0, 0)
    got = reference.entity_alignment(e, one, "type").first()
    assert (got.tp, got.fp, got.fn) == (1, 1, 1)


def test_token_blocks_of_repeated_titles(spark, monkeypatch):
    """Rows with the same tokens are compared once: of 4,000 x 4,000 rows with 40 titles no pair of rows is a candidate."""
    kept = []
    keep = linking.Scratch.keep
    monkeypatch.setattr(linking.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    titles = [f"the old {x} of {y} and {x}{y} lake number {z}" for x in "abcd" for y in "efghi" for z in "12"]
    a = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, titles)), (F.col("id") % 40 + 1).cast("int")).alias("t"))
    got = linking.token_blocks(a, a.select(F.col("id") + 10_000, F.concat("t", F.lit(" Lake!"))).toDF("id", "t"), "id", "t", min_jaccard=0.8)
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    assert got.count() == 100 * 100 * sum(jac(x, y) >= 0.8 for x in titles for y in titles)
    assert max(df.count() for df in kept) <= 40 * 40


def exchanges(plan):
    """(columns, rows) of every exchange by hash in an executed plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return exchanges(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return exchanges(plan.plan())
    by = re.match(r"hashpartitioning\((.*), \d+\)", plan.outputPartitioning().toString()) if plan.nodeName() == "Exchange" else None
    own = [(re.sub(r"#\d+L?", "", by[1]), plan.metrics().apply("shuffleRecordsWritten").value())] if by else []
    return own + [x for i in range(plan.children().size()) for x in exchanges(plan.children().apply(i))]


def test_soft_alignment_does_not_gather_the_rows_of_a_class(spark, monkeypatch):
    """A class that all entities point to is no key of a join, whatever the size of the mapping; rows that repeat count once."""
    n = 5000
    e = lambda name, label: spark.range(n).select(F.explode(F.array(*[F.struct(F.concat(F.lit(name), "id").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("k"), F.lit(None).cast("string").alias("dt")) for p, o, k in ((TYPE, F.lit(N + "A"), "iri"), ("knows", F.concat(F.lit(name), (F.col("id") + 1) % n), "iri"), *label)])).alias("r")).select("r.*")
    label = F.concat(F.lit("Ring "), F.sha2(F.col("id").cast("string"), 256))
    a = e("a/", [(LABEL, label, "literal")]).unionByName(e("order/", []))
    b = e("b/", [(LABEL, label, "literal")]).unionByName(e("order/", []).where("s <> 'order/7'"))
    odd = spark.createDataFrame([("a/1", "p", "a/2", "literal", None), ("a/1", "p", None, "iri", None), (None, "p", "a/2", None, None)], T5)
    small = fusion.small
    for large in (False, True):
        monkeypatch.setattr(fusion, "small", (lambda m: m) if large else small)
        broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if large else broadcast)
        try:
            got = reference.triple_alignment_soft(as_graph(a.unionByName(a).unionByName(odd)), as_graph(b.unionByName(odd)))
            r = got.collect()[0]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        assert (r.tp, r.fp, r.fn) == (3 * n + 2 * n - 2, 2 + 3, 3)
        if large:
            rows = [k for c, k in exchanges(got._jdf.queryExecution().executedPlan()) if c in ("o", "k")]
            assert rows and max(rows) < 3 * n
