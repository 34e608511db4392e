"""Ontology-driven inference and consistency metrics (semantic aspect).

The ontology is small and broadcast; the graph is joined by subject or object only. Types are inferred from domain and
range first (`infer=True`), so a violation shows through a class that is disjoint with the expected one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import LABEL, OWL, RDF, RDFS, TYPE, VOCABULARY, XSD, Ontology, TripleFrame, as_graph, is_iri
from .cluster import closure


def _props(o: Ontology) -> DataFrame:
    return F.broadcast(o.properties.select(F.col("uri").alias("p"), F.col("kind").alias("p_kind"), "domain", "range", "min_card", "max_card"))


def infer_types(t: DataFrame, o: Ontology) -> DataFrame:
    """The graph with (s type domain) and, for IRI objects, (o type range) added."""
    hit = t.join(_props(o), "p")
    object_range = is_iri() & F.col("range").isNotNull() & ~F.col("range").startswith(XSD)
    added = hit.select(F.explode(F.array(F.struct(F.col("s").alias("e"), F.col("domain").alias("c")), F.when(object_range, F.struct(F.col("o").alias("e"), F.col("range").alias("c"))))).alias("x"))
    added = added.where("x IS NOT NULL AND x.c IS NOT NULL").select(F.col("x.e").alias("s"), F.lit(TYPE).alias("p"), F.col("x.c").alias("o"), F.lit("iri").alias("k")).distinct()
    return as_graph(t.unionByName(added, allowMissingColumns=True))


def type_sets(t: DataFrame) -> DataFrame:
    return TripleFrame(t).types().groupBy("s").agg(F.collect_set("type").alias("types"))


def disjoint_subjects(t: DataFrame, o: Ontology, infer: bool = True) -> DataFrame:
    """(s, a, b): subjects with two classes that exclude each other."""
    full = infer_types(t, o) if infer else t
    types = TripleFrame(full).types().distinct()
    pairs = o.classes.select(F.col("uri").alias("a"), F.explode("disjoint").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = types.select("s", F.col("type").alias("a")).join(F.broadcast(pairs), "a")
    return one.join(types.select("s", F.col("type").alias("b")), ["s", "b"], "left_semi").select("s", "a", "b").distinct()


def disjoint_score(t: DataFrame, o: Ontology, infer: bool = True) -> DataFrame:
    bad = disjoint_subjects(t, o, infer).agg(F.count_distinct("s").alias("bad"))
    n = t.agg(F.count_distinct("s").alias("n"))
    return bad.crossJoin(n).withColumn("score", F.round(1 - T.ratio(F.col("bad"), F.col("n")), 6))


def _typed(t: DataFrame, o: Ontology, infer: bool) -> DataFrame:
    full = infer_types(t, o) if infer else t
    sets = type_sets(full)
    none = F.array().cast("array<string>")
    hit = t.where(~F.col("p").isin(TYPE, LABEL)).join(_props(o), "p")
    hit = hit.join(sets.select("s", F.col("types").alias("s_types")), "s", "left")
    hit = hit.join(sets.select(F.col("s").alias("o"), F.col("types").alias("o_types")), "o", "left")
    return hit.withColumn("s_types", F.coalesce("s_types", none)).withColumn("o_types", F.when(is_iri(), F.coalesce("o_types", none)).otherwise(none))


def direction(t: DataFrame, o: Ontology, infer: bool = False) -> DataFrame:
    """Object triples in the direction of the ontology and against it; a triple may count for both."""
    hit = _typed(t, o, infer).where(is_iri() & (F.col("p_kind") == "object"))
    good = F.array_contains("s_types", F.col("domain")) & F.array_contains("o_types", F.col("range"))
    bad = F.array_contains("s_types", F.col("range")) & F.array_contains("o_types", F.col("domain"))
    return hit.agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad")).withColumn("score", F.round(F.when(F.col("good") + F.col("bad") > 0, 1 - T.ratio(F.col("bad"), F.col("good") + F.col("bad"))).otherwise(0.0), 6))


def cardinality(t: DataFrame, o: Ontology) -> DataFrame:
    """Per (property, subject): whether the number of values lies within the bounds (default 1 to 10,000)."""
    per = t.groupBy("p", "s").agg(F.count("*").alias("n")).join(_props(o), "p")
    ok = F.col("n").between(F.coalesce("min_card", F.lit(1)), F.coalesce("max_card", F.lit(10_000)))
    return per.agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).withColumn("score", F.round(T.ratio(F.col("good"), F.col("good") + F.col("bad")), 6))


def _disjoint_map(o: Ontology) -> DataFrame:
    return F.broadcast(o.classes.select(F.col("uri"), F.col("disjoint")))


def range_check(t: DataFrame, o: Ontology, infer: bool = True) -> DataFrame:
    """Triples whose object has the range: an IRI of that class and of none disjoint with it, or a literal of that datatype."""
    hit = _typed(t, o, infer).join(_disjoint_map(o).withColumnRenamed("uri", "range"), "range", "left")
    iri_ok = F.array_contains("o_types", F.col("range")) & ~F.arrays_overlap("o_types", F.coalesce("disjoint", F.array().cast("array<string>")))
    literal_ok = F.coalesce("dt", F.lit(XSD + "string")) == F.col("range")
    ok = F.coalesce(F.when(is_iri(), iri_ok).otherwise(literal_ok), F.lit(False))
    return hit.agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).withColumn("score", F.round(T.ratio(F.col("good"), F.col("good") + F.col("bad"), 1.0), 6))


def domain_check(t: DataFrame, o: Ontology, infer: bool = True) -> DataFrame:
    hit = _typed(t, o, infer).join(_disjoint_map(o).withColumnRenamed("uri", "domain"), "domain", "left")
    ok = F.coalesce(F.array_contains("s_types", F.col("domain")) & ~F.arrays_overlap("s_types", F.coalesce("disjoint", F.array().cast("array<string>"))), F.lit(False))
    return hit.agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).withColumn("score", F.round(T.ratio(F.col("good"), F.col("good") + F.col("bad")), 6))


def _literals(t: DataFrame, o: Ontology) -> DataFrame:
    return t.where((F.col("k") == "literal") & (F.col("p") != LABEL)).join(_props(o), "p")


def datatype_check(t: DataFrame, o: Ontology) -> DataFrame:
    """Literals whose datatype is the range; a property without a range makes its literals wrong."""
    ok = F.coalesce(F.coalesce("dt", F.lit(XSD + "string")) == F.col("range"), F.lit(False))
    return _literals(t, o).agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).withColumn("score", F.round(T.ratio(F.col("good"), F.col("good") + F.col("bad")), 6))


def format_check(t: DataFrame, o: Ontology) -> DataFrame:
    """Literals whose text has the format of the range; a property without a range accepts everything."""
    ok = T.valid_datatype(F.col("o"), F.coalesce("range", F.lit("")))
    return _literals(t, o).agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).withColumn("score", F.round(T.ratio(F.col("good"), F.col("good") + F.col("bad")), 6))


def coverage(found: DataFrame, expected: DataFrame, col: str = "uri") -> DataFrame:
    """TP, FP, FN and F1 of two sets by one full outer join."""
    both = found.select(col).distinct().withColumn("a", F.lit(1)).join(expected.select(col).distinct().withColumn("b", F.lit(1)), col, "full")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    return out.withColumn("f1", F.round(T.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


def class_coverage(t: DataFrame, o: Ontology) -> DataFrame:
    return coverage(TripleFrame(t).types().select(F.col("type").alias("uri")), o.classes)


def relation_coverage(t: DataFrame, o: Ontology) -> DataFrame:
    vocab = reduce(lambda a, b: a | b, [F.col("p").startswith(x) for x in VOCABULARY])
    return coverage(t.where(~vocab).select(F.col("p").alias("uri")), o.properties)


def property_coverage(t: DataFrame, o: Ontology) -> DataFrame:
    """Coverage of the datatype properties alone."""
    vocab = reduce(lambda a, b: a | b, [F.col("p").startswith(x) for x in VOCABULARY])
    return coverage(t.where(~vocab & (F.col("k") == "literal")).select(F.col("p").alias("uri")), o.properties.where("kind = 'datatype'"))


def namespace_coverage(t: DataFrame, o: Ontology) -> DataFrame:
    return coverage(t.select(T.simple_namespace(F.col("p")).alias("uri")), o.properties.select(T.simple_namespace(F.col("uri")).alias("uri")))


def violations(t: DataFrame, o: Ontology) -> DataFrame:
    """(rule, s, p, o) of explicit violations, without inference."""
    hit = _typed(t, o, infer=False)
    dis = disjoint_subjects(t, o, infer=False).select(F.lit("disjoint").alias("rule"), "s", F.col("a").alias("p"), F.col("b").alias("o"))
    dom = hit.where(F.col("domain").isNotNull() & (F.size("s_types") > 0) & ~F.array_contains("s_types", F.col("domain"))).select(F.lit("domain").alias("rule"), "s", "p", "o")
    rng = hit.where(is_iri() & F.col("range").isNotNull() & ~F.col("range").startswith(XSD) & (F.size("o_types") > 0) & ~F.array_contains("o_types", F.col("range"))).select(F.lit("range").alias("rule"), "s", "p", "o")
    fmt = _literals(t, o).where(~T.valid_datatype(F.col("o"), F.coalesce("range", F.lit("")))).select(F.lit("format").alias("rule"), "s", "p", "o")
    per = t.groupBy("p", "s").agg(F.count("*").alias("n")).join(_props(o), "p")
    card = per.where("n > max_card OR n < min_card").select(F.lit("cardinality").alias("rule"), "s", "p", F.col("n").cast("string").alias("o"))
    return dis.unionByName(dom).unionByName(rng).unionByName(fmt).unionByName(card)


def drop_inconsistent(t: DataFrame, o: Ontology) -> DataFrame:
    """The graph without triples that break a domain or range."""
    bad = violations(t, o).where("rule IN ('domain', 'range')").select("s", "p", "o").distinct()
    return t.join(bad, ["s", "p", "o"], "left_anti")


def drop_empty_literals(t: DataFrame) -> DataFrame:
    return t.where((F.col("k") != "literal") | (F.length(F.trim("o")) > 0))


def ontology_triples(t: DataFrame) -> DataFrame:
    """The triples that define an ontology: terms of its vocabulary as predicate or class."""
    defs = t.where((F.col("p") == TYPE) & (F.col("o").startswith(OWL) | F.col("o").startswith(RDFS))).select("s").distinct()
    return t.join(defs, "s", "left_semi").where(F.col("p").startswith(RDF) | F.col("p").startswith(RDFS) | F.col("p").startswith(OWL) | F.col("p").contains("altLabel"))


def subclass_closure(t: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(cls, super, depth): transitive superclasses of any depth; cycles end with the least depth."""
    up = closure(t.where(F.col("p") == RDFS + "subClassOf"), "s", "o", max_depth)
    return up.select(F.col("a").alias("cls"), F.col("b").alias("super"), "depth")


def shacl_shapes(o: Ontology) -> DataFrame:
    """One row per constraint of a property shape: (target, path, constraint, value)."""
    p = o.properties
    rows = F.array(
        F.struct(F.lit("sh:datatype").alias("constraint"), F.when(F.col("range").startswith(XSD), F.col("range")).alias("value")),
        F.struct(F.lit("sh:class").alias("constraint"), F.when(~F.col("range").startswith(XSD), F.col("range")).alias("value")),
        F.struct(F.lit("sh:minCount").alias("constraint"), F.col("min_card").cast("string").alias("value")),
        F.struct(F.lit("sh:maxCount").alias("constraint"), F.col("max_card").cast("string").alias("value")),
    )
    return p.where("domain IS NOT NULL").select(F.col("domain").alias("target"), F.col("uri").alias("path"), F.explode(rows).alias("x")).where("x.value IS NOT NULL").select("target", "path", "x.constraint", "x.value")
