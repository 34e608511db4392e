"""The triple model: one narrow table (s, p, o, k, dt, lang, g) and the operations every other operator builds on.

k is the kind of the object: iri, literal or bnode. A graph is a set, so ingest removes repeated rows. `p` is a few
dozen values of which rdf:type and rdfs:label are hot: nothing here partitions by `p`; joins go by subject or object.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["s", "p", "o", "k", "dt", "lang", "g"]
SCHEMA = "s string, p string, o string, k string, dt string, lang string, g string"

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, SAME_AS, ALT_LABEL = RDF + "type", RDFS + "label", OWL + "sameAs", SKOS + "altLabel"
VOCABULARY = (RDF, RDFS, OWL)


def as_graph(df: DataFrame, keep_graph: bool = False) -> DataFrame:
    """Missing columns added, repeated triples removed (per graph if `keep_graph`)."""
    have = set(df.columns)
    full = df.select(*[F.col(c) if c in have else F.lit("iri" if c == "k" else None).cast("string").alias(c) for c in COLUMNS])
    return full.dropDuplicates(COLUMNS if keep_graph else COLUMNS[:-1])


def is_iri(c: str = "k") -> Column:
    return F.col(c) == "iri"


@dataclass
class TripleFrame:
    """A graph with the usual lookups. Every method is a lazy transformation."""

    triples: DataFrame

    def pattern(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples with the given terms; None matches anything."""
        bound = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
        return self.triples.where(reduce(lambda a, b: a & b, bound, F.lit(True)))

    def subjects(self) -> DataFrame:
        return self.triples.select("s").distinct()

    def entities(self) -> DataFrame:
        """Subjects and IRI objects."""
        return self.triples.select(F.explode(F.when(is_iri(), F.array("s", "o")).otherwise(F.array("s"))).alias("e")).distinct()

    def relations(self) -> DataFrame:
        return self.triples.select("p").distinct()

    def labels(self) -> DataFrame:
        return self.pattern(p=LABEL).select("s", F.col("o").alias("label"))

    def types(self) -> DataFrame:
        return self.pattern(p=TYPE).select("s", F.col("o").alias("type"))

    def first_label(self) -> DataFrame:
        """One label per subject: the least one, so that the choice never depends on order."""
        return self.labels().groupBy("s").agg(F.min("label").alias("label"))

    def first_type(self) -> DataFrame:
        return self.types().groupBy("s").agg(F.min("type").alias("type"))

    def label_type(self) -> DataFrame:
        return self.first_label().join(self.first_type(), "s")

    def label_types(self) -> DataFrame:
        """Label and the set of types, types empty where there are none."""
        sets = self.types().groupBy("s").agg(F.sort_array(F.collect_set("type")).alias("types"))
        return self.first_label().join(sets, "s", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))

    def union(self, other: "TripleFrame") -> "TripleFrame":
        return TripleFrame(as_graph(self.triples.unionByName(other.triples, allowMissingColumns=True)))

    def subtract(self, other: "TripleFrame") -> "TripleFrame":
        return TripleFrame(self.triples.join(other.triples.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti"))

    def intersect(self, other: "TripleFrame") -> "TripleFrame":
        return TripleFrame(self.triples.join(other.triples.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_semi"))

    def containing(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples whose terms contain the given substrings."""
        bound = [F.col(c).contains(v) for c, v in (("s", s), ("p", p), ("o", o)) if v]
        return self.triples.where(reduce(lambda a, b: a & b, bound, F.lit(True)))

    def without_vocabulary(self, prefixes: tuple[str, ...] = VOCABULARY) -> DataFrame:
        return self.triples.where(~reduce(lambda a, b: a | b, [F.col("p").startswith(x) for x in prefixes]))

    def allowed(self, properties: DataFrame, namespace: str | None = None) -> DataFrame:
        """Triples of the given properties, labels and alternative labels; types only of classes in `namespace`."""
        keep = properties.select(F.col("uri").alias("p")).union(self.triples.sparkSession.createDataFrame([(LABEL,), (TYPE,), (ALT_LABEL,)], "p string")).distinct()
        out = self.triples.join(F.broadcast(keep), "p", "left_semi")
        return out.where((F.col("p") != TYPE) | F.col("o").startswith(namespace)) if namespace else out

    def cache(self) -> "TripleFrame":
        return TripleFrame(self.triples.persist())

    def close(self) -> None:
        self.triples.unpersist()


@dataclass
class Ontology:
    """Classes (uri, label, disjoint) and properties (uri, kind, label, aliases, domain, range, min_card, max_card): small by nature."""

    classes: DataFrame
    properties: DataFrame

    CLASS_SCHEMA = "uri string, label string, disjoint array<string>"
    PROPERTY_SCHEMA = "uri string, kind string, label string, aliases array<string>, domain string, range string, min_card int, max_card int"

    @staticmethod
    def of(spark: SparkSession, classes: list[tuple], properties: list[tuple]) -> "Ontology":
        return Ontology(spark.createDataFrame(classes, Ontology.CLASS_SCHEMA), spark.createDataFrame(properties, Ontology.PROPERTY_SCHEMA))

    @staticmethod
    def from_triples(t: DataFrame) -> "Ontology":
        """Read classes and properties from OWL triples; cardinalities from functional properties and restrictions."""
        f = TripleFrame(t)
        one = lambda p, name: f.pattern(p=p).groupBy("s").agg(F.min("o").alias(name))
        label = one(LABEL, "label")
        alias = f.pattern(p=ALT_LABEL).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("aliases"))
        dis = f.pattern(p=OWL + "disjointWith").select("s", "o")
        dis = dis.union(dis.select("o", "s")).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("disjoint"))
        empty = F.array().cast("array<string>")
        classes = f.types().where(F.col("type").isin(OWL + "Class", RDFS + "Class")).select("s").distinct()
        classes = classes.join(label, "s", "left").join(dis, "s", "left").select(F.col("s").alias("uri"), "label", F.coalesce("disjoint", empty).alias("disjoint"))
        kind = f.types().where(F.col("type").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty")).groupBy("s").agg(F.min(F.when(F.col("type") == OWL + "ObjectProperty", "object").otherwise("datatype")).alias("kind"))
        functional = f.pattern(p=TYPE, o=OWL + "FunctionalProperty").select("s", F.lit(1).alias("fun")).distinct()
        on = f.pattern(p=OWL + "onProperty").select(F.col("s").alias("r"), F.col("o").alias("s"))
        bound = lambda names, agg, out: on.join(f.triples.where(F.col("p").isin(*[OWL + n for n in names])).select(F.col("s").alias("r"), F.col("o").try_cast("int").alias("v")), "r").groupBy("s").agg(agg("v").alias(out))
        props = kind.join(label, "s", "left").join(alias, "s", "left").join(one(RDFS + "domain", "domain"), "s", "left").join(one(RDFS + "range", "range"), "s", "left")
        props = props.join(functional, "s", "left").join(bound(("minCardinality", "cardinality"), F.max, "lo"), "s", "left").join(bound(("maxCardinality", "cardinality"), F.min, "hi"), "s", "left")
        props = props.select(F.col("s").alias("uri"), "kind", "label", F.coalesce("aliases", empty).alias("aliases"), "domain", "range", F.col("lo").alias("min_card"), F.coalesce("hi", "fun").alias("max_card"))
        return Ontology(classes, props)
