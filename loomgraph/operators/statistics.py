"""Counting metrics over a graph (statistical aspect). Results are long rows: metric, measurement, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import LABEL, TYPE, TripleFrame, is_iri


def measures(df: DataFrame, metric: str, **values: Column) -> DataFrame:
    """One aggregated row per named value."""
    row = df.agg(*[v.cast("double").alias(n) for n, v in values.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("measurement"), F.col(n).alias("value")) for n in values])
    return row.select(F.explode(pairs).alias("x")).select(F.lit(metric).alias("metric"), "x.measurement", "x.value")


def count_measures(t: DataFrame) -> DataFrame:
    """Entities, triples, relations, classes and subjects in one pass over the graph, then one small aggregate."""
    tagged = t.select(
        F.explode(
            F.array(
                F.struct(F.lit("triples").alias("m"), F.concat_ws("\x1f", "s", "p", "o", F.coalesce("dt", F.lit("")), F.coalesce("lang", F.lit("")), "k").alias("v")),
                F.struct(F.lit("entities").alias("m"), F.col("s").alias("v")),
                F.struct(F.lit("entities").alias("m"), F.when(is_iri(), F.col("o")).alias("v")),
                F.struct(F.lit("relations").alias("m"), F.col("p").alias("v")),
                F.struct(F.lit("classes").alias("m"), F.when((F.col("p") == TYPE) & is_iri(), F.col("o")).alias("v")),
                F.struct(F.lit("subjects").alias("m"), F.col("s").alias("v")),
            )
        ).alias("x")
    ).select("x.m", "x.v")
    return tagged.where("v IS NOT NULL").distinct().groupBy(F.col("m").alias("measurement")).agg(F.count("*").alias("value"))


def relation_histogram(t: DataFrame) -> DataFrame:
    return t.groupBy("p").agg(F.count("*").alias("n"))


def class_occurrence(t: DataFrame) -> DataFrame:
    return t.where((F.col("p") == TYPE) & is_iri()).groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("n"))


def relation_occurrence(t: DataFrame) -> DataFrame:
    return t.where(is_iri()).groupBy("p").agg(F.count("*").alias("n"))


def property_occurrence(t: DataFrame) -> DataFrame:
    return t.where(F.col("k") == "literal").groupBy("p").agg(F.count("*").alias("n"))


def namespace_usage(t: DataFrame) -> DataFrame:
    iris = t.select(F.explode(F.when(is_iri(), F.array("s", "p", "o")).otherwise(F.array("s", "p"))).alias("iri")).distinct()
    return iris.withColumn("namespace", T.uri_namespace(F.col("iri"))).where("namespace IS NOT NULL").groupBy("namespace").agg(F.count("*").alias("n"))


def loose_entities(t: DataFrame) -> DataFrame:
    """IRI objects, other than of labels and types, that are never a subject."""
    used = t.where(is_iri() & ~F.col("p").isin(LABEL, TYPE)).select(F.col("o").alias("e")).distinct()
    return used.join(t.select(F.col("s").alias("e")).distinct(), "e", "left_anti")


def shallow_entities(t: DataFrame) -> DataFrame:
    """Subjects that have nothing but labels and types."""
    return t.groupBy("s").agg(F.bool_and(F.col("p").isin(LABEL, TYPE)).alias("shallow")).where("shallow").select(F.col("s").alias("e"))


def loose_score(t: DataFrame) -> DataFrame:
    n = TripleFrame(t).entities().agg(F.count("*").alias("n"))
    x = loose_entities(t).agg(F.count("*").alias("x"))
    return n.crossJoin(x).select("x", "n", F.round(1 - T.ratio(F.col("x"), F.col("n"), 1.0), 6).alias("score"))


def shallow_score(t: DataFrame) -> DataFrame:
    n = t.agg(F.count_distinct("s").alias("n"))
    x = shallow_entities(t).agg(F.count("*").alias("x"))
    return n.crossJoin(x).select("x", "n", F.round(1 - T.ratio(F.col("x"), F.col("n"), 1.0), 6).alias("score"))


def density(t: DataFrame) -> DataFrame:
    """Triples per entity, by class of the subject."""
    types = TripleFrame(t).first_type()
    return t.join(types, "s").groupBy(F.col("type").alias("cls")).agg(F.count("*").alias("triples"), F.count_distinct("s").alias("entities")).withColumn("density", F.round(T.ratio(F.col("triples"), F.col("entities")), 6))


def degree(t: DataFrame) -> DataFrame:
    """Distribution of the number of edges per node (in and out); hubs are combined before the shuffle."""
    ends = t.where(is_iri() & (F.col("p") != TYPE)).select(F.explode(F.array("s", "o")).alias("e"))
    per = ends.groupBy("e").agg(F.count("*").alias("degree"))
    return per.groupBy("degree").agg(F.count("*").alias("nodes"))


def line_triples(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of text with at least three words, and their share of all non-empty lines."""
    n = F.size(F.filter(F.split(F.trim(F.col(col)), r"\s+"), lambda w: w != ""))
    return lines.where(F.length(F.trim(F.col(col))) > 0).agg(F.count("*").alias("n_lines"), F.count_if(n >= 3).alias("n_triples")).withColumn("score", F.round(T.ratio(F.col("n_triples"), F.col("n_lines")), 6))


def class_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distance of two class histograms: L1 and L2 of their shares, and cosine similarity."""
    share = lambda t, n: class_occurrence(t).crossJoin(class_occurrence(t).agg(F.sum("n").alias("all"))).select("cls", (F.col("n") / F.col("all")).alias(n))
    x = share(a, "x").join(share(b, "y"), "cls", "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    out = x.agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("l1"), F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("l2"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return out.select(F.round("l1", 6).alias("l1"), F.round("l2", 6).alias("l2"), F.round(T.ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), 6).alias("cosine"))
