import json

import pytest
from pyspark.sql import functions as F

from loomgraph.model import LABEL, OWL, RDFS, TYPE, XSD, Ontology, TripleFrame, as_graph
from loomgraph.functions import text as T
from loomgraph.sources import docs, rdf

EX = "http://ex.org/"


def kg(spark):
    rows = [(EX + "a", TYPE, EX + "Film", "iri", None), (EX + "a", LABEL, "Film A", "literal", XSD + "string"), (EX + "a", EX + "by", EX + "p", "iri", None), (EX + "a", EX + "by", EX + "p", "iri", None), (EX + "b", LABEL, "B", "literal", None)]
    return as_graph(spark.createDataFrame(rows, "s string, p string, o string, k string, dt string"))


def test_graph_is_a_set_and_lookups(spark):
    t = TripleFrame(kg(spark))
    assert t.triples.count() == 4
    assert {r.e for r in t.entities().collect()} == {EX + "a", EX + "b", EX + "p", EX + "Film"}
    assert t.pattern(p=EX + "by").count() == 1 and t.pattern(s=EX + "zz").count() == 0
    assert t.subtract(t).triples.count() == 0 and t.union(t).triples.count() == 4 and t.intersect(t).triples.count() == 4
    assert {(r.s, len(r.types)) for r in t.label_types().collect()} == {(EX + "a", 1), (EX + "b", 0)}


def test_ntriples_round_trip(spark):
    lines = [
        f'<{EX}a> <{EX}p> "x \\"q\\" \\n\\u00e9" .', f"<{EX}a> <{EX}p> <{EX}b> .", f'<{EX}a> <{EX}p> "1"^^<{XSD}integer> .', f'<{EX}a> <{EX}p> "hi"@en .', f"_:b1 <{EX}p> _:b2 .", "# note", "", "broken line", f"<{EX}a> <{EX}p> <{EX}b> .",
    ]
    graph, bad = rdf.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert graph.count() == 5 and [r.line for r in bad.collect()] == ["broken line"]
    again, bad2 = rdf.parse_ntriples(rdf.ntriples(graph))
    assert bad2.count() == 0
    key = lambda g: {tuple(r)[:6] for r in g.collect()}
    assert key(graph) == key(again)
    assert 'x "q" \né' in {r.o for r in graph.collect()}


def test_turtle(spark, tmp_path):
    ttl = f"""@prefix ex: <{EX}> . @prefix xsd: <{XSD}> .
ex:a a ex:Film ; ex:name "A", "B"@de ; ex:len 90 ; ex:ok true ; ex:part [ ex:n 1.5 ] . # end
ex:b ex:name \"\"\"long
text\"\"\"^^xsd:string ."""
    got = rdf.turtle_triples(ttl)
    assert len(got) == 8 and (EX + "a", EX + "len", "90", "literal", XSD + "integer", None) in got
    (tmp_path / "x.nt").write_text(ttl)
    (tmp_path / "y.ttl").write_text("this is no turtle {")
    assert rdf.read_graph(spark, str(tmp_path)).count() == 8


def test_write_and_read(spark, tmp_path):
    rdf.write_ntriples(kg(spark), str(tmp_path / "out"))
    assert rdf.read_graph(spark, str(tmp_path / "out"), "nt").count() == 4
    rdf.write_wide_csv(kg(spark), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_ontology_from_triples(spark):
    rows = [(EX + "A", TYPE, OWL + "Class"), (EX + "B", TYPE, OWL + "Class"), (EX + "A", OWL + "disjointWith", EX + "B"), (EX + "p", TYPE, OWL + "ObjectProperty"), (EX + "p", TYPE, OWL + "FunctionalProperty"), (EX + "p", RDFS + "domain", EX + "A"), ("_:r", OWL + "onProperty", EX + "p"), ("_:r", OWL + "minCardinality", "1")]
    o = Ontology.from_triples(spark.createDataFrame(rows, "s string, p string, o string").withColumn("k", F.lit("iri")))
    assert {(r.uri, tuple(r.disjoint)) for r in o.classes.collect()} == {(EX + "A", (EX + "B",)), (EX + "B", (EX + "A",))}
    p = o.properties.first()
    assert (p.kind, p.domain, p.range, p.min_card, p.max_card) == ("object", EX + "A", None, 1, 1)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("iri,want", [("HTTP://user@WWW.Ex.org:80/a/b%20c/d", "http://ex.org/a/b c/"), ("http://ex.org/x#y", "http://ex.org/x#"), ("http://ex.org/", "http://ex.org/"), ("no iri", None), ("http://ex.org/%zz/q", None)])
def test_namespaces(spark, iri, want):
    assert one(spark, iri, T.uri_namespace) == want


def test_scalars(spark):
    assert one(spark, "Film_Name (2001)", T.clean_label) == "Film Name"
    assert one(spark, "releaseDate of film", T.key_name) == "release_date_of_film"
    assert one(spark, "release_date", T.class_name) == "ReleaseDate"
    assert one(spark, "Ada Lovelace", T.looks_like_name) is True and one(spark, "ada lovelace", T.looks_like_name) is False
    assert [one(spark, v, T.literal_type).split("#")[1] for v in ("true", "12", "1.5", "2001-02-03", "2001-02-03T04:05:06", "x")] == ["boolean", "integer", "double", "date", "dateTime", "string"]
    ok = lambda v, dt: one(spark, v, lambda c: T.valid_datatype(c, F.lit(XSD + dt)))
    assert ok("12", "integer") and not ok("-12", "integer") and ok("-1.5", "double") and not ok("2001", "date") and ok("anything", "string") and ok("--12-24", "gMonthDay")
    df = spark.createDataFrame([("a cat sat", "cat"), ("a cat", "dog")], "t string, w string")
    assert [tuple(r.x) for r in df.select(T.offsets(F.col("t"), F.col("w")).alias("x")).collect()] == [(2, 5), (-1, -1)]
    n = spark.createDataFrame([(5.0, 0.0, 10.0), (20.0, 0.0, 10.0), (1.0, 3.0, 3.0)], "v double, lo double, hi double")
    assert [r.x for r in n.select(T.clamp(F.col("v"), F.col("lo"), F.col("hi")).alias("x")).collect()] == [0.5, 1.0, 0.5]
    lab = spark.createDataFrame([({"title": "T", "z": "long text"},), ({"z": "bb", "a": "c"},)], "m map<string,string>")
    assert [r.x for r in lab.select(T.find_label(F.col("m")).alias("x")).collect()] == ["T", "c"]


def test_exchange_documents(spark, tmp_path):
    er = {"matches": [{"id_1": "a", "id_2": "b", "score": 0.9, "id_type": "entity"}], "blocks": [], "clusters": []}
    (tmp_path / "er.json").write_text(json.dumps(er))
    m = docs.er_matches(docs.read_er(spark, str(tmp_path / "er.json")))
    assert tuple(m.first()) == ("a", "b", 0.9, "entity")
    assert json.loads(docs.er_document(m).first().value)["matches"] == er["matches"]
    span = lambda x: {"start_pos": 0, "end_pos": 1, "surface_form": x, "text": x, "mapping": None}
    te = {"text": "t", "triples": [{"subject": span("S"), "predicate": span("P"), "object": span("O")}], "chains": [{"main": "M", "aliases": [span("he")]}], "links": [{"span": "S", "mapping": "u", "link_type": "entity", "score": 1.0}]}
    (tmp_path / "te").mkdir()
    (tmp_path / "te" / "d1.x.json").write_text(json.dumps(te))
    d = docs.read_te(spark, str(tmp_path / "te"))
    assert tuple(docs.te_triples(d).first()) == ("d1", "S", "P", "O") and tuple(docs.te_chains(d).first()) == ("d1", "M", "he") and docs.te_links(d).first().mapping == "u"


def test_tool_outputs(spark, tmp_path):
    j = lambda o: spark.createDataFrame([("d", json.dumps(o))], "doc_id string, text string")
    sp = docs.spotlight_links(j({"Resources": [{"@surfaceForm": "S", "@URI": "u", "@similarityScore": "0.8"}, {"@surfaceForm": "T", "@URI": "v", "@similarityScore": "0.1"}]}), min_score=0.5)
    assert [tuple(r) for r in sp.collect()] == [("d", "S", "u", "entity", 0.8)]
    fa = docs.falcon_json_links(j({"entities_wikidata": [{"surface form": "S", "URI": "u"}], "relations_wikidata": [{"surface form": "r", "URI": "p"}]}))
    assert {(r.span, r.link_type) for r in fa.collect()} == {("S", "entity"), ("r", "relation")}
    oi = docs.openie(j({"sentences": [{"openie": [{"subject": "a", "relation": "b", "object": "c"}], "tokens": [{"characterOffsetBegin": 0, "characterOffsetEnd": 3}, {"characterOffsetBegin": 4, "characterOffsetEnd": 6}]}], "corefs": {"1": [{"text": "Ann", "sentNum": 1, "startIndex": 1, "endIndex": 2}, {"text": "it", "sentNum": 1, "startIndex": 2, "endIndex": 3}], "2": [{"text": "x", "sentNum": 1, "startIndex": 1, "endIndex": 2}]}}))
    assert tuple(oi["triples"].first()) == ("d", "a", "b", "c") and {(r.main, r.alias, r.start, r.end) for r in oi["chains"].collect()} == {("Ann", "Ann", 0, 3), ("Ann", "it", 4, 6)}
    for name, body in {"0_eqv.tsv": "x:a\tb\t1\n", "1_eqv.tsv": "dbr:A\thttp://k/b\t0.9\nbad line\n", "2_eqv.tsv": "", "0_superrelations1.tsv": "dbo:p\trdfs:label\t0.4\n", "0_superrelations2.tsv": "dbo:q\tdbo:r\t0.3\n"}.items():
        (tmp_path / name).write_text(body)
    got = {(r.id_1, r.id_2, r.id_type) for r in docs.matcher_directory(spark, str(tmp_path)).collect()}
    assert got == {("http://dbpedia.org/resource/A", "http://k/b", "entity"), ("http://dbpedia.org/ontology/p", RDFS + "label", "relation"), ("http://dbpedia.org/ontology/r", "http://dbpedia.org/ontology/q", "relation")}


def test_tables(spark, tmp_path):
    f = tmp_path / "m.tsv"
    f.write_text("left_dataset\tright_dataset\tleft_id\tright_id\tentity_type\na\tb\tx\ty\tfilm\n")
    assert docs.read_fixed(spark, str(f), "verified_matches").first().left_id == "x"
    with pytest.raises(ValueError):
        docs.read_fixed(spark, str(f), "verified_links")
    lines = spark.createDataFrame([("a,b",), ("c\t\td\te",), ("solo",)], "value string")
    assert {tuple(r) for r in docs.cluster_pairs(lines).collect()} == {("a", "b"), ("c", "d"), ("c", "e")}
    ents = spark.createDataFrame([("x",), ("y,Y",), ("z,Z,T",)], "value string")
    assert [tuple(r) for r in docs.entity_dict(ents).collect()] == [("x", "x", None), ("y", "Y", None), ("z", "Z", "T")]
    ev = spark.createDataFrame([("d", json.dumps([{"metric": "count", "summary": "", "measurements": [{"name": "n", "value": 3.14159, "unit": "rows"}, {"value": 1}]}]))], "doc string, value string")
    assert docs.eval_table(docs.eval_results(ev)).first().asDict() == {"doc": "d", "count__n__rows": 3.142}


def test_graphs_that_cannot_be_read_are_errors(spark, tmp_path):
    (tmp_path / "g.nt").write_text("<http://x/a> <http://x/p> <http://x/b> .\nnot a triple\n")
    with pytest.raises(ValueError):
        rdf.read_graph(spark, str(tmp_path), "nt", strict=True)
    with pytest.warns(UserWarning):
        assert rdf.read_graph(spark, str(tmp_path), "nt").count() == 1


def test_scratch_folder_and_checked_broadcast(spark):
    from loomgraph.session import Scratch, scratch_root, small

    assert scratch_root(spark) == scratch_root(spark)
    kept = Scratch(spark, "t").keep(spark.range(5))
    assert kept.count() == 5
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(kept)) and not hinted(small(kept, rows=4)) and not hinted(small(kept, size=10))
