"""Registered queries of the core operators with the SQL that checks each of them, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import LABEL, RDFS, TYPE, XSD, Ontology, TripleFrame, as_graph
from ..operators import cluster, consistency, construct, fusion, linking, reference, similarity, statistics
from ..session import table
from . import bgp, params, report
from .derived import KG_SQL, NS, ONTO_SQL, RES, TYPES_SQL, graph, ontology, rows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}

KG = f"WITH {KG_SQL} "
KGO = f"WITH {KG_SQL}, {ONTO_SQL}, {TYPES_SQL} "


def query(sql: str | None = None):
    def wrap(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _ORACLE[fn.__name__] = sql
        return fn

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


# ---------------------------------------------------------------- counts over the graph


@query(KG + f"""SELECT 'triples' AS measurement, COUNT(*) AS value FROM kg
UNION ALL SELECT 'entities', COUNT(*) FROM (SELECT s FROM kg UNION SELECT o FROM kg WHERE k = 'iri') x
UNION ALL SELECT 'relations', COUNT(DISTINCT p) FROM kg UNION ALL SELECT 'subjects', COUNT(DISTINCT s) FROM kg
UNION ALL SELECT 'classes', COUNT(DISTINCT o) FROM kg WHERE p = '{TYPE}'""")
def kg_count_measures(spark, d):
    return statistics.count_measures(graph(spark, d))


@query(KG + "SELECT COUNT(*) AS entities FROM (SELECT s FROM kg UNION SELECT o FROM kg WHERE k = 'iri') x")
def kg_entity_count(spark, d):
    return TripleFrame(graph(spark, d)).entities().agg(F.count("*").alias("entities"))


@query(KG + "SELECT p, COUNT(*) AS n FROM kg GROUP BY p")
def kg_relation_histogram(spark, d):
    return statistics.relation_histogram(graph(spark, d))


@query(KG + f"SELECT o AS cls, COUNT(*) AS n FROM kg WHERE p = '{TYPE}' GROUP BY o")
def kg_class_occurrence(spark, d):
    return statistics.class_occurrence(graph(spark, d))


@query(KG + "SELECT p, COUNT(*) AS n FROM kg WHERE k = 'iri' GROUP BY p")
def kg_relation_occurrence(spark, d):
    return statistics.relation_occurrence(graph(spark, d))


@query(KG + "SELECT p, COUNT(*) AS n FROM kg WHERE k = 'literal' GROUP BY p")
def kg_property_occurrence(spark, d):
    return statistics.property_occurrence(graph(spark, d))


_LOOSE = f"SELECT DISTINCT o AS e FROM kg WHERE k = 'iri' AND p NOT IN ('{TYPE}', '{LABEL}') AND o NOT IN (SELECT s FROM kg)"


def _known(spark, d):
    """The graph without the customers' own triples, so that orders point to entities that are no subjects."""
    return graph(spark, d).where(~F.col("s").startswith(RES + "customer/"))


KNOWN = f"WITH {KG_SQL.replace('kg AS', 'kg0 AS', 1)}, kg AS (SELECT * FROM kg0 WHERE NOT starts_with(s, '{RES}customer/')) "


@query(KNOWN + _LOOSE)
def kg_loose_entities(spark, d):
    return statistics.loose_entities(_known(spark, d))


@query(KNOWN + f"SELECT x, n, ROUND(1 - x / n, 6) AS score FROM (SELECT (SELECT COUNT(*) FROM ({_LOOSE})) AS x, (SELECT COUNT(*) FROM (SELECT s FROM kg UNION SELECT o FROM kg WHERE k = 'iri')) AS n)")
def kg_loose_score(spark, d):
    return statistics.loose_score(_known(spark, d))


@query(KG + f"SELECT s AS e FROM kg GROUP BY s HAVING bool_and(p IN ('{TYPE}', '{LABEL}'))")
def kg_shallow_entities(spark, d):
    return statistics.shallow_entities(graph(spark, d))


@query(KG + f"SELECT x, n, ROUND(1 - x / n, 6) AS score FROM (SELECT (SELECT COUNT(*) FROM (SELECT s FROM kg GROUP BY s HAVING bool_and(p IN ('{TYPE}', '{LABEL}')))) AS x, (SELECT COUNT(DISTINCT s) FROM kg) AS n)")
def kg_shallow_score(spark, d):
    return statistics.shallow_score(graph(spark, d))


@query(KG + f"SELECT c AS cls, COUNT(*) AS triples, COUNT(DISTINCT kg.s) AS entities, ROUND(COUNT(*) / COUNT(DISTINCT kg.s), 6) AS density FROM kg JOIN (SELECT s, MIN(o) AS c FROM kg WHERE p = '{TYPE}' GROUP BY s) t ON kg.s = t.s GROUP BY c")
def kg_density(spark, d):
    return statistics.density(graph(spark, d))


@query(KG + f"SELECT degree, COUNT(*) AS nodes FROM (SELECT e, COUNT(*) AS degree FROM (SELECT s AS e FROM kg WHERE k = 'iri' AND p <> '{TYPE}' UNION ALL SELECT o FROM kg WHERE k = 'iri' AND p <> '{TYPE}') GROUP BY e) GROUP BY degree")
def kg_degree(spark, d):
    return statistics.degree(graph(spark, d))


@query("SELECT COUNT(*) AS n_lines, COUNT(*) FILTER (len(list_filter(regexp_split_to_array(trim(value, E' '), '\\s+'), lambda x: x <> '')) >= 3) AS n_triples, ROUND(COUNT(*) FILTER (len(list_filter(regexp_split_to_array(trim(value, E' '), '\\s+'), lambda x: x <> '')) >= 3) / COUNT(*), 6) AS score FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) WHERE length(trim(value, ' ')) > 0")
def kg_line_triples(spark, d):
    return statistics.line_triples(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@query(f"WITH h AS (SELECT cls, COUNT(*) FILTER (side = 0) AS x, COUNT(*) FILTER (side = 1) AS y FROM (SELECT regexp_extract(subject, '/(film|book|person|company)/', 1) AS cls, CASE WHEN contains(subject, '://rdf') THEN 0 ELSE 1 END AS side FROM (SELECT DISTINCT subject FROM triplets)) GROUP BY cls), q AS (SELECT x / SUM(x) OVER () AS x, y / SUM(y) OVER () AS y FROM h) SELECT ROUND(SUM(ABS(x - y)), 6) AS l1, ROUND(SQRT(SUM((x - y) * (x - y))), 6) AS l2, ROUND(SUM(x * y) / SQRT(SUM(x * x) * SUM(y * y)), 6) AS cosine FROM q")
def kg_class_distance(spark, d):
    t = table(spark, d, "triplets").select(F.col("subject").alias("s")).distinct()
    typed = t.select("s", F.lit(TYPE).alias("p"), F.regexp_extract("s", "/(film|book|person|company)/", 1).alias("o"), F.lit("iri").alias("k"))
    rdf = F.contains("s", F.lit("://rdf"))
    return statistics.class_distance(typed.where(rdf), typed.where(~rdf))


# ---------------------------------------------------------------- patterns and sets


@query(KG + f"SELECT s, o FROM kg WHERE p = '{NS}c_nationkey' AND o = '{RES}nation/7'")
def kg_pattern_scan(spark, d):
    return TripleFrame(graph(spark, d)).pattern(p=NS + "c_nationkey", o=RES + "nation/7").select("s", "o")


@query(KG + "SELECT DISTINCT s FROM kg")
def kg_subjects(spark, d):
    return TripleFrame(graph(spark, d)).subjects()


@query(KG + f"SELECT l.s, label, type FROM (SELECT s, MIN(o) AS label FROM kg WHERE p = '{LABEL}' GROUP BY s) l JOIN (SELECT s, MIN(o) AS type FROM kg WHERE p = '{TYPE}' GROUP BY s) t ON l.s = t.s")
def kg_label_type(spark, d):
    return TripleFrame(graph(spark, d)).label_type()


@query(KG + f"SELECT l.s, label, COALESCE(types, '') AS types FROM (SELECT s, MIN(o) AS label FROM kg WHERE p = '{LABEL}' GROUP BY s) l LEFT JOIN (SELECT s, string_agg(DISTINCT o, ' ' ORDER BY o) AS types FROM kg WHERE p = '{TYPE}' GROUP BY s) t ON l.s = t.s")
def kg_label_types(spark, d):
    return TripleFrame(graph(spark, d)).label_types().select("s", "label", F.array_join("types", " ").alias("types"))


@query(KG + "SELECT s, p, o FROM kg WHERE contains(s, 'customer/1') AND contains(o, 'BUILD')")
def kg_containing(spark, d):
    return TripleFrame(graph(spark, d)).containing(s="customer/1", o="BUILD").select("s", "p", "o")


@query(KG + "SELECT p, COUNT(*) AS n FROM kg WHERE NOT starts_with(p, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#') AND NOT starts_with(p, 'http://www.w3.org/2000/01/rdf-schema#') AND NOT starts_with(p, 'http://www.w3.org/2002/07/owl#') GROUP BY p")
def kg_without_vocabulary(spark, d):
    return TripleFrame(graph(spark, d)).without_vocabulary().groupBy("p").agg(F.count("*").alias("n"))


def _customers(spark, d, condition: str) -> DataFrame:
    """The part of the graph about the customers that meet a condition on their row."""
    c = table(spark, d, "customer").where(condition).select(F.concat(F.lit(RES + "customer/"), F.col("c_custkey").cast("string")).alias("s"))
    return graph(spark, d).join(c, "s", "left_semi")


_A, _B = "c_acctbal >= 0", "c_mktsegment <> 'BUILDING'"


def _part(condition: str) -> str:
    return f"SELECT * FROM kg WHERE s IN (SELECT '{RES}customer/' || CAST(c_custkey AS VARCHAR) FROM customer WHERE {condition})"


HALVES = f"WITH {KG_SQL}, a AS ({_part(_A)}), b AS ({_part(_B)}) "


@query(HALVES + "SELECT COUNT(*) AS n, COUNT(DISTINCT s) AS subjects FROM (SELECT * FROM a UNION SELECT * FROM b)")
def kg_union(spark, d):
    return fusion.union(_customers(spark, d, _A), _customers(spark, d, _B)).agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query(HALVES + "SELECT s, p, o FROM a WHERE (s, p, o) NOT IN (SELECT s, p, o FROM b)")
def kg_subtract(spark, d):
    return TripleFrame(_customers(spark, d, _A)).subtract(TripleFrame(_customers(spark, d, _B))).triples.select("s", "p", "o")


@query(HALVES + "SELECT s, p, o FROM a INTERSECT SELECT s, p, o FROM b")
def kg_intersect(spark, d):
    return TripleFrame(_customers(spark, d, _A)).intersect(TripleFrame(_customers(spark, d, _B))).triples.select("s", "p", "o")


@query("""WITH d AS (SELECT DISTINCT COALESCE(graph, 'none') AS sp, subject AS e FROM triplets), n AS (SELECT sp, COUNT(*) AS n FROM d GROUP BY sp)
SELECT x.sp AS a, y.sp AS b, COUNT(*) AS common, ROUND(COUNT(*) / MAX(nx.n), 6) AS share_a, ROUND(COUNT(*) / MAX(ny.n), 6) AS share_b
FROM d x JOIN d y ON x.e = y.e AND x.sp < y.sp JOIN n nx ON nx.sp = x.sp JOIN n ny ON ny.sp = y.sp GROUP BY x.sp, y.sp""")
def split_overlap(spark, d):
    return reference.split_overlap(table(spark, d, "triplets").withColumn("graph", F.coalesce("graph", F.lit("none"))), "graph", "subject")


@query("""SELECT regexp_replace(subject, '[^/]*$', '') AS namespace, COUNT(*) AS n FROM (SELECT DISTINCT subject FROM triplets UNION SELECT DISTINCT predicate FROM triplets) GROUP BY 1""")
def iri_namespaces_simple(spark, d):
    t = table(spark, d, "triplets").select(F.explode(F.array("subject", "predicate")).alias("iri")).distinct()
    return t.groupBy(T.simple_namespace(F.col("iri")).alias("namespace")).agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT DISTINCT trim(id_1, ' <>' || chr(9)) AS iri FROM er_matches WHERE id_1 IS NOT NULL UNION SELECT DISTINCT trim(id_2, ' <>' || chr(9)) FROM er_matches WHERE id_2 IS NOT NULL),
x AS (SELECT lower(regexp_extract(iri, '^([A-Za-z]+)://', 1)) AS sch, lower(regexp_extract(iri, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_extract(iri, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM i)
SELECT sch || '://' || host || regexp_replace(path, '/[^/]*$', '') || '/' AS namespace, COUNT(*) AS n FROM x WHERE sch <> '' AND host <> '' GROUP BY 1""")
def iri_namespaces(spark, d):
    i = table(spark, d, "er_matches").select(F.explode(F.array("id_1", "id_2")).alias("iri")).select(F.trim(F.col("iri"), F.lit(" <>\t")).alias("iri")).where("iri IS NOT NULL").distinct()
    return i.groupBy(T.uri_namespace(F.col("iri")).alias("namespace")).agg(F.count("*").alias("n")).where("namespace IS NOT NULL")


# ---------------------------------------------------------------- ontology and consistency


@query(KGO + "SELECT s, c AS type FROM inferred")
def onto_type_inference(spark, d):
    return TripleFrame(consistency.infer_types(graph(spark, d), ontology(spark))).types()


@query(KGO + "SELECT DISTINCT x.s, x.c AS a, y.c AS b FROM inferred x JOIN inferred y ON x.s = y.s AND x.c < y.c JOIN cls ON uri = x.c WHERE list_contains(disjoint, y.c)")
def onto_disjoint_subjects(spark, d):
    return consistency.disjoint_subjects(graph(spark, d), ontology(spark))


@query(KGO + "SELECT bad, n, ROUND(1 - bad / n, 6) AS score FROM (SELECT COUNT(DISTINCT x.s) AS bad FROM inferred x JOIN inferred y ON x.s = y.s JOIN cls ON uri = x.c WHERE list_contains(disjoint, y.c)), (SELECT COUNT(DISTINCT s) AS n FROM kg)")
def onto_disjoint_score(spark, d):
    return consistency.disjoint_score(graph(spark, d), ontology(spark))


def _check(good: str, empty: str = "0.0") -> str:
    return f"SELECT COUNT(*) FILTER (ok) AS good, COUNT(*) FILTER (NOT ok) AS bad, CASE WHEN COUNT(*) = 0 THEN {empty} ELSE ROUND(COUNT(*) FILTER (ok) / COUNT(*), 6) END AS score FROM ({good})"


_HIT = f"kg JOIN prop ON p = prop.uri AND p NOT IN ('{TYPE}', '{LABEL}')"


def _has(types: str, node: str, c: str) -> str:
    return f"EXISTS (SELECT 1 FROM {types} t WHERE t.s = {node} AND t.c = {c})"


def _clash(types: str, node: str, c: str) -> str:
    return f"EXISTS (SELECT 1 FROM {types} t JOIN cls ON cls.uri = {c} WHERE t.s = {node} AND list_contains(cls.disjoint, t.c))"


@query(KGO + f"""SELECT good, bad, ROUND(CASE WHEN good + bad > 0 THEN 1 - bad / (good + bad) ELSE 0 END, 6) AS score FROM (SELECT COUNT(*) FILTER ({_has('types', 'kg.s', 'domain')} AND {_has('types', 'kg.o', 'range')}) AS good,
COUNT(*) FILTER ({_has('types', 'kg.s', 'range')} AND {_has('types', 'kg.o', 'domain')}) AS bad FROM {_HIT} WHERE kg.k = 'iri' AND kind = 'object')""")
def onto_direction(spark, d):
    return consistency.direction(graph(spark, d), ontology(spark))


@query(KGO + _check("SELECT COUNT(*) BETWEEN COALESCE(MIN(min_card), 1) AND COALESCE(MAX(max_card), 10000) AS ok FROM kg JOIN prop ON p = uri GROUP BY p, s"))
def onto_cardinality(spark, d):
    return consistency.cardinality(graph(spark, d), ontology(spark))


@query(KGO + _check(f"SELECT COALESCE(CASE WHEN kg.k = 'iri' THEN {_has('inferred', 'kg.o', 'range')} AND NOT {_clash('inferred', 'kg.o', 'range')} ELSE COALESCE(dt, '{XSD}string') = range END, FALSE) AS ok FROM {_HIT}", "1.0"))
def onto_range(spark, d):
    return consistency.range_check(graph(spark, d), ontology(spark))


@query(KGO + _check(f"SELECT COALESCE({_has('inferred', 'kg.s', 'domain')} AND NOT {_clash('inferred', 'kg.s', 'domain')}, FALSE) AS ok FROM {_HIT}"))
def onto_domain(spark, d):
    return consistency.domain_check(graph(spark, d), ontology(spark))


@query(KGO + _check(f"SELECT COALESCE(COALESCE(dt, '{XSD}string') = range, FALSE) AS ok FROM {_HIT} WHERE kg.k = 'literal'"))
def onto_datatype(spark, d):
    return consistency.datatype_check(graph(spark, d), ontology(spark))


_FORMAT = f"CASE WHEN range = '{XSD}integer' THEN regexp_matches(o, '^[0-9]+$') WHEN range = '{XSD}date' THEN regexp_matches(o, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') ELSE TRUE END"


@query(KGO + _check(f"SELECT {_FORMAT} AS ok FROM {_HIT} WHERE kg.k = 'literal'"))
def onto_format(spark, d):
    return consistency.format_check(graph(spark, d), ontology(spark))


def _cover(found: str, want: str) -> str:
    return f"SELECT tp, fp, fn, ROUND(2 * tp / NULLIF(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, COUNT(*) FILTER (b IS NULL) AS fp, COUNT(*) FILTER (a IS NULL) AS fn FROM (SELECT DISTINCT {found}) x FULL JOIN (SELECT DISTINCT {want}) y ON a = b)"


@query(KGO + _cover("c AS a FROM types", "uri AS b FROM cls"))
def onto_class_coverage(spark, d):
    return consistency.class_coverage(graph(spark, d), ontology(spark))


@query(KGO + _cover("p AS a FROM kg WHERE NOT starts_with(p, 'http://www.w3.org/')", "uri AS b FROM prop"))
def onto_relation_coverage(spark, d):
    return consistency.relation_coverage(graph(spark, d), ontology(spark))


@query(KGO + _cover("p AS a FROM kg WHERE NOT starts_with(p, 'http://www.w3.org/') AND k = 'literal'", "uri AS b FROM prop WHERE kind = 'datatype'"))
def onto_property_coverage(spark, d):
    return consistency.property_coverage(graph(spark, d), ontology(spark))


@query(KGO + _cover("CASE WHEN contains(p, '#') THEN split_part(p, '#', 1) || '#' ELSE regexp_replace(p, '[^/]*$', '') END AS a FROM kg", f"'{NS}' AS b"))
def onto_namespace_coverage(spark, d):
    return consistency.namespace_coverage(graph(spark, d), ontology(spark))


@query(KGO + f"""SELECT 'disjoint' AS rule, x.s AS s, x.c AS p, y.c AS o FROM types x JOIN types y ON x.s = y.s AND x.c < y.c JOIN cls ON uri = x.c WHERE list_contains(disjoint, y.c)
UNION ALL SELECT 'domain', kg.s, p, o FROM {_HIT} WHERE domain IS NOT NULL AND kg.s IN (SELECT s FROM types) AND NOT {_has('types', 'kg.s', 'domain')}
UNION ALL SELECT 'range', kg.s, p, o FROM {_HIT} WHERE kg.k = 'iri' AND range IS NOT NULL AND NOT starts_with(range, '{XSD}') AND kg.o IN (SELECT s FROM types) AND NOT {_has('types', 'kg.o', 'range')}
UNION ALL SELECT 'format', kg.s, p, o FROM {_HIT} WHERE kg.k = 'literal' AND NOT {_FORMAT}
UNION ALL SELECT 'cardinality', s, p, CAST(COUNT(*) AS VARCHAR) FROM kg JOIN prop ON p = uri GROUP BY s, p HAVING COUNT(*) > MAX(max_card) OR COUNT(*) < MIN(min_card)""")
def onto_violations(spark, d):
    return consistency.violations(graph(spark, d), ontology(spark))


@query(KGO + f"SELECT COUNT(*) AS n FROM kg WHERE (s, p, o) NOT IN (SELECT kg.s, p, o FROM {_HIT} WHERE domain IS NOT NULL AND kg.s IN (SELECT s FROM types) AND NOT {_has('types', 'kg.s', 'domain')} UNION ALL SELECT kg.s, p, o FROM {_HIT} WHERE kg.k = 'iri' AND range IS NOT NULL AND NOT starts_with(range, '{XSD}') AND kg.o IN (SELECT s FROM types) AND NOT {_has('types', 'kg.o', 'range')})")
def onto_drop_inconsistent(spark, d):
    return consistency.drop_inconsistent(graph(spark, d), ontology(spark)).agg(F.count("*").alias("n"))


@query(f"WITH {ONTO_SQL} SELECT domain AS target, uri AS path, 'sh:datatype' AS constraint, range AS value FROM prop WHERE domain IS NOT NULL AND starts_with(range, '{XSD}') UNION ALL SELECT domain, uri, 'sh:class', range FROM prop WHERE NOT starts_with(range, '{XSD}') UNION ALL SELECT domain, uri, 'sh:minCount', CAST(min_card AS VARCHAR) FROM prop WHERE min_card IS NOT NULL UNION ALL SELECT domain, uri, 'sh:maxCount', CAST(max_card AS VARCHAR) FROM prop WHERE max_card IS NOT NULL")
def onto_shacl_shapes(spark, d):
    return consistency.shacl_shapes(ontology(spark))


def _hierarchy(spark, d) -> DataFrame:
    """Every part type below its first two words, those below the first word, all below Thing."""
    p = table(spark, d, "part").select(F.split("p_type", " ").alias("w")).distinct()
    up = lambda a, b: F.struct(a.alias("s"), F.lit(RDFS + "subClassOf").alias("p"), b.alias("o"), F.lit("iri").alias("k"))
    j = lambda n: F.array_join(F.slice("w", 1, n), " ")
    rows = F.array(F.when(F.size("w") > 2, up(j(3), j(2))), F.when(F.size("w") > 1, up(j(2), j(1))), up(j(1), F.lit("Thing")))
    return as_graph(p.select(F.explode(rows).alias("r")).where("r IS NOT NULL").select("r.*"))


@query("""WITH RECURSIVE w AS (SELECT DISTINCT string_split(p_type, ' ') AS w FROM part), e AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS cls, array_to_string(w[1:2], ' ') AS super FROM w WHERE len(w) > 2 UNION SELECT array_to_string(w[1:2], ' '), w[1] FROM w WHERE len(w) > 1 UNION SELECT w[1], 'Thing' FROM w),
up AS (SELECT cls, super, 1 AS depth FROM e UNION ALL SELECT up.cls, e.super, depth + 1 FROM up JOIN e ON up.super = e.cls) SELECT cls, super, MIN(depth) AS depth FROM up GROUP BY cls, super""")
def onto_subclass_closure(spark, d):
    return consistency.subclass_closure(_hierarchy(spark, d))


# ---------------------------------------------------------------- matches and clusters

_CLEAN = "trim(lower({c}), ' <>' || chr(9))"


@query(f"""WITH RECURSIVE m AS (SELECT {_CLEAN.format(c='left_id')} AS a, {_CLEAN.format(c='right_id')} AS b FROM verified_matches WHERE left_id IS NOT NULL AND right_id IS NOT NULL),
e AS (SELECT a, b FROM m WHERE a <> '' AND b <> '' UNION SELECT b, a FROM m WHERE a <> '' AND b <> ''), r AS (SELECT DISTINCT a AS uri, a AS other FROM e UNION SELECT r.uri, e.b FROM r JOIN e ON r.other = e.a) SELECT uri, MIN(other) AS cid FROM r GROUP BY uri""")
def er_components(spark, d):
    clean = lambda c: F.trim(F.lower(c), F.lit(" <>\t"))
    return cluster.match_components(table(spark, d, "verified_matches").select(clean("left_id").alias("a"), clean("right_id").alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))


@query("SELECT id_type, COUNT(*) FILTER (score > 0.5) AS above, COUNT(*) FILTER (NOT (score > 0.5)) AS below FROM er_matches WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY id_type")
def er_threshold_counts(spark, d):
    return reference.threshold_counts(table(spark, d, "er_matches").where("score IS NOT NULL AND NOT isnan(score)"))


@query("SELECT i / 16 AS threshold, (SELECT COUNT(*) FROM er_matches WHERE score > i / 16 AND NOT isnan(score)) + CASE WHEN i = 0 THEN 0 ELSE 0 END AS kept FROM range(17) t(i)")
def er_threshold_sweep(spark, d):
    return reference.threshold_sweep(table(spark, d, "er_matches"))


@query("""SELECT id_1, id_2, MAX(score) AS score FROM er_matches WHERE id_1 IS NOT NULL AND id_2 IS NOT NULL AND score > 0.5 AND NOT isnan(score) AND NOT suffix(id_1, '-') AND NOT suffix(id_2, '-') AND id_type = 'entity' GROUP BY 1, 2""".replace("NOT suffix(id_1, '-')", "id_1 NOT LIKE '%-'").replace("NOT suffix(id_2, '-')", "id_2 NOT LIKE '%-'"))
def er_filter_matches(spark, d):
    m = table(spark, d, "er_matches").where("NOT isnan(score)")
    return fusion.filter_matches(m, 0.5, "entity").groupBy("id_1", "id_2").agg(F.max("score").alias("score"))


@query()
def er_greedy_matching(spark, d):
    m = table(spark, d, "er_matches").where("id_type = 'entity' AND NOT isnan(score) AND id_1 <> id_2")
    return cluster.greedy_matching(m)


@query("""SELECT subject, predicate, object AS value, votes FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY votes DESC, first) AS r FROM (SELECT subject, predicate, object, COUNT(*) AS votes, MIN(triplet_id) AS first FROM triplets WHERE object IS NOT NULL GROUP BY subject, predicate, object)) WHERE r = 1""")
def er_majority(spark, d):
    t = table(spark, d, "triplets").where("object IS NOT NULL").select("subject", "predicate", F.col("object").alias("value"), F.lit(1.0).alias("score"), F.col("triplet_id").alias("seq"))
    return fusion.majority(t, ["subject", "predicate"])


@query("""SELECT subject, predicate, object AS value FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY (COALESCE(graph, '') = (SELECT MIN(graph) FROM triplets)) DESC, CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, object) AS r FROM triplets WHERE object IS NOT NULL) WHERE r = 1""")
def er_preferred(spark, d):
    t = table(spark, d, "triplets").where("object IS NOT NULL").withColumn("score", F.when(~F.isnan("score"), F.col("score"))).withColumn("src", F.coalesce("graph", F.lit("")))
    first = t.agg(F.min("graph").alias("g")).first()["g"]
    return fusion.preferred(t.select("subject", "predicate", F.col("object").alias("value"), "score", "src"), ["subject", "predicate"], "src", first).select("subject", "predicate", "value")


@query("""WITH m AS (SELECT id_1, id_2, row_number() OVER (ORDER BY id_1, id_2, score) AS seq FROM er_matches WHERE id_type = 'relation' AND id_1 IS NOT NULL AND id_2 IS NOT NULL),
f AS (SELECT id, MIN(seq) AS first FROM (SELECT id_1 AS id, seq FROM m UNION ALL SELECT id_2, seq FROM m) GROUP BY id),
x AS (SELECT regexp_extract(id_1, '([^#/]*)$', 1) = regexp_extract(id_2, '([^#/]*)$', 1) AS ok FROM m JOIN f a ON a.id = id_1 JOIN f b ON b.id = id_2 WHERE a.first = seq OR b.first = seq),
n AS (SELECT COUNT(*) FILTER (ok) AS tp, COUNT(*) FILTER (NOT ok) AS fp FROM x), c AS (SELECT tp, fp, GREATEST(0, 23 - tp - fp) AS fn FROM n)
SELECT tp, fp, fn, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision, ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall, ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def er_relation_eval(spark, d):
    from pyspark.sql.window import Window as W

    m = table(spark, d, "er_matches").where("id_type = 'relation' AND id_1 IS NOT NULL AND id_2 IS NOT NULL")
    return reference.relation_match_evaluation(m.withColumn("seq", F.row_number().over(W.orderBy("id_1", "id_2", "score"))), 23)


@query(f"""WITH RECURSIVE m AS (SELECT {_CLEAN.format(c='left_id')} AS a, {_CLEAN.format(c='right_id')} AS b FROM verified_matches WHERE left_id IS NOT NULL AND right_id IS NOT NULL),
ok AS (SELECT a, b FROM m WHERE a <> '' AND b <> '' AND a <> b), e AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok), r AS (SELECT DISTINCT a AS uri, a AS other FROM e UNION SELECT r.uri, e.b FROM r JOIN e ON r.other = e.a),
f AS (SELECT DISTINCT uri AS l, other AS r FROM r WHERE NOT starts_with(uri, 'http://seedkg') AND starts_with(other, 'http://seedkg')),
t AS (SELECT DISTINCT a AS l, b AS r FROM ok WHERE NOT starts_with(a, 'http://seedkg') AND starts_with(b, 'http://seedkg')),
n AS (SELECT (SELECT COUNT(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM t)) AS tp, (SELECT COUNT(*) FROM f) AS n, (SELECT COUNT(DISTINCT r) FROM t WHERE r NOT IN (SELECT r FROM f)) AS fn)
SELECT tp, n - tp AS fp, fn, ROUND(COALESCE(tp / NULLIF(n, 0), 0), 6) AS precision, ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall, ROUND(COALESCE(2 * tp / NULLIF(tp + n + fn, 0), 0), 6) AS f1 FROM n""")
def er_match_eval(spark, d):
    clean = lambda c: F.trim(F.lower(c), F.lit(" <>\t"))
    v = table(spark, d, "verified_matches").select(clean("left_id").alias("a"), clean("right_id").alias("b")).where("a <> '' AND b <> '' AND a <> b")
    truth = v.where("NOT startswith(a, 'http://seedkg') AND startswith(b, 'http://seedkg')").select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))
    return reference.match_evaluation(cluster.match_components(v), truth, "http://seedkg")


@query("""WITH a AS (SELECT DISTINCT id, title FROM book_source WHERE title IS NOT NULL), b AS (SELECT DISTINCT id, title FROM book_target WHERE title IS NOT NULL),
x AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9à-öø-ÿā-ž]+'), lambda w: w <> '')) AS t FROM a), y AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9à-öø-ÿā-ž]+'), lambda w: w <> '')) AS t FROM b)
SELECT x.id AS id_1, y.id AS id_2, MAX(ROUND(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6)) AS score FROM x, y WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.8 GROUP BY 1, 2""")
def er_token_blocking(spark, d):
    from pyspark.sql.window import Window as W

    # Only pairs of an id that has several titles can come twice; all others need no aggregate.
    many = (F.count("*").over(W.partitionBy("id")) > 1).alias("many")
    side = lambda n: table(spark, d, n).where("title IS NOT NULL").select("id", "title").distinct().select(F.struct("id", many).alias("id"), "title")
    got = linking.token_blocks(side("book_source"), side("book_target"), "id", "title", min_jaccard=0.8)
    out = got.select(F.col("id_1.id").alias("id_1"), F.col("id_2.id").alias("id_2"), "score", (F.col("id_1.many") | F.col("id_2.many")).alias("many"))
    return out.where("NOT many").drop("many").unionByName(out.where("many").groupBy("id_1", "id_2").agg(F.max("score").alias("score")))


@query("SELECT id_type, COUNT(*) AS n FROM (SELECT CASE WHEN id_type = 'str' THEN 'relation' ELSE id_type END AS id_type FROM er_matches UNION ALL SELECT 'entity' FROM verified_matches) GROUP BY id_type")
def er_merge_matches(spark, d):
    cols = ["id_1", "id_2", "score", "id_type"]
    v = table(spark, d, "verified_matches").select(F.col("left_id").alias("id_1"), F.col("right_id").alias("id_2"), F.lit(1.0).alias("score"), F.lit("entity").alias("id_type"))
    return fusion.merge_matches(table(spark, d, "er_matches").select(*cols), v).groupBy("id_type").agg(F.count("*").alias("n"))


@query(f"WITH m AS (SELECT {_CLEAN.format(c='left_id')} AS a, {_CLEAN.format(c='right_id')} AS b FROM verified_matches), d AS (SELECT a AS src, b AS dst FROM m WHERE a <> '' AND b <> '' AND a <> b) SELECT duplicates, entities, ROUND(duplicates / entities, 6) AS ratio FROM (SELECT COUNT(*) AS duplicates FROM (SELECT dst FROM (SELECT DISTINCT src, dst FROM d) GROUP BY dst HAVING COUNT(*) > 1)), (SELECT COUNT(*) AS entities FROM (SELECT src FROM d UNION SELECT dst FROM d))")
def er_duplicates(spark, d):
    clean = lambda c: F.trim(F.lower(c), F.lit(" <>\t"))
    a = table(spark, d, "verified_matches").select(clean("left_id").alias("src"), clean("right_id").alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return reference.duplicates(a, a.select(F.explode(F.array("src", "dst")).alias("e")).distinct())


# ---------------------------------------------------------------- similarity

_DOT = "ROUND(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) + 0.0"
_PAIRS = f"SELECT a.vec_id AS vec_id, b.vec_id AS vec_id_2, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id"


@query(f"SELECT vec_id, vec_id_2, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, vec_id_2) AS rank FROM ({_PAIRS})) WHERE rank <= 5")
def emb_top_k(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.nearest(e, e, "vec_id", "embedding", "vec_id", "embedding", 5, exclude_self=True)


@query(f"SELECT a_id AS a, b_id AS b, score FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {_DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS r FROM (SELECT * FROM embeddings WHERE label < 5) a, (SELECT * FROM embeddings WHERE label >= 5) b) WHERE r = 1 AND score > 0.2")
def emb_similarity_join(spark, d):
    e = table(spark, d, "embeddings")
    x, y = e.where("label < 5").select(F.col("vec_id").alias("a"), "embedding"), e.where("label >= 5").select(F.col("vec_id").alias("b"), "embedding")
    return similarity.similarity_join(x, y, "a", "embedding", "b", "embedding", 0.2)


@query("SELECT label, CAST(dim - 1 AS INT) AS dim, ROUND(AVG(CAST(v AS DOUBLE)), 6) + 0.0 AS value FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim")
def emb_centroids(spark, d):
    return similarity.centroids(table(spark, d, "embeddings"), "label", "embedding")


@query()
def emb_label_index(spark, d):
    o = table(spark, d, "ontology_terms")
    q = table(spark, d, "te_triples").select(F.col("predicate.surface_form").alias("query")).where("length(trim(query)) > 0").distinct()
    return similarity.label_index(o.where("kind = 'relation'").select("uri", "label"), q, 5)


# ---------------------------------------------------------------- coverage and alignment


def _verified(spark, d):
    """Customers as expected entities: those of one segment under another uri, those in debt with another spelling of the label."""
    c = table(spark, d, "customer")
    key = F.when(F.col("c_mktsegment") == "MACHINERY", -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return c.select(F.concat(F.lit(RES + "customer/"), key.cast("string")).alias("uri"), F.when(F.col("c_acctbal") < 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("label"))


VERIFIED = f"v AS (SELECT '{RES}customer/' || CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN -c_custkey ELSE c_custkey END AS VARCHAR) AS uri, CASE WHEN c_acctbal < 0 THEN lower(c_name) ELSE c_name END AS label FROM customer)"


@query(f"WITH {KG_SQL}, {VERIFIED} SELECT overlap, expected, ROUND(LEAST(overlap / expected, 1.0), 6) AS coverage FROM (SELECT COUNT(DISTINCT uri) AS overlap FROM v WHERE uri IN (SELECT s FROM kg) OR label IN (SELECT o FROM kg WHERE p = '{LABEL}')), (SELECT COUNT(DISTINCT uri) AS expected FROM v)")
def src_coverage(spark, d):
    return reference.source_coverage(graph(spark, d), _verified(spark, d))


@query()
def src_coverage_soft(spark, d):
    return reference.source_coverage_soft(graph(spark, d), _verified(spark, d))


@query("""WITH ref AS (SELECT p_name AS label, MIN(p_partkey) AS ref FROM part WHERE p_size <= 25 GROUP BY p_name), h AS (SELECT row_number() OVER (PARTITION BY ref ORDER BY p_partkey) AS r FROM part JOIN ref ON p_name = label)
SELECT COUNT(*) AS found, COUNT(*) FILTER (r > 1) AS duplicates, ROUND((COUNT(*) - COUNT(*) FILTER (r > 1)) / COUNT(*), 6) AS precision FROM h""")
def src_precision(spark, d):
    p = table(spark, d, "part")
    return reference.source_precision(p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("label")), p.where("p_size <= 25").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("label")))


def _confusion(a: str, b: str, cols: str) -> str:
    return f"SELECT tp, fp, fn, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision, ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall, ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT (SELECT COUNT(*) FROM (SELECT {cols} FROM {a} INTERSECT SELECT {cols} FROM {b})) AS tp, (SELECT COUNT(*) FROM (SELECT {cols} FROM {a} EXCEPT SELECT {cols} FROM {b})) AS fp, (SELECT COUNT(*) FROM (SELECT {cols} FROM {b} EXCEPT SELECT {cols} FROM {a})) AS fn)"


@query(HALVES + f", x AS (SELECT s, MIN(o) AS label FROM a WHERE p = '{LABEL}' GROUP BY s), y AS (SELECT s, MIN(o) AS type FROM a WHERE p = '{TYPE}' GROUP BY s), g AS (SELECT label, type FROM x JOIN y ON x.s = y.s), e AS (SELECT c_name AS label, '{NS}Customer' AS type FROM customer WHERE c_nationkey < 20) " + _confusion("g", "e", "label, type"))
def src_typed_coverage(spark, d):
    e = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_name").alias("label"), F.lit(NS + "Customer").alias("type"))
    return reference.typed_coverage(_customers(spark, d, _A), e)


@query(HALVES + f", sd AS ({_part('c_nationkey < 5')}), x AS (SELECT s, p, o FROM a EXCEPT SELECT s, p, o FROM sd), y AS (SELECT s, p, o FROM b EXCEPT SELECT s, p, o FROM sd) " + _confusion("x", "y", "s, p, o"))
def ref_alignment(spark, d):
    return reference.triple_alignment(_customers(spark, d, _A), _customers(spark, d, _B), _customers(spark, d, "c_nationkey < 5"))


def _moved_graphs(spark, d, triples=graph):
    """The whole derived graph with all its entities under other IRIs, and as it is."""
    t = triples(spark, d)
    moved = lambda c: F.when(F.col(c).startswith(RES), F.concat(F.lit(RES + "moved/"), F.substring(c, len(RES) + 1, 1_000_000))).otherwise(F.col(c))
    return t.withColumn("s", moved("s")).withColumn("o", F.when(F.col("k") == "iri", moved("o")).otherwise(F.col("o"))), t


@query()
def ref_alignment_soft(spark, d):
    moved, t = _moved_graphs(spark, d, rows)  # repeated triples count once there
    return reference.triple_alignment_soft(moved, t)


@query()
def ref_alignment_values(spark, d):
    moved, t = _moved_graphs(spark, d)
    return reference.triple_alignment_values(moved, t)


@query()
def ref_entity_alignment(spark, d):
    moved, t = _moved_graphs(spark, d)
    return reference.entity_alignment(moved, t, "intersecting_type")


@query("SELECT tp, fp, fn, tn, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1, ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT COUNT(*) FILTER (p AND a) AS tp, COUNT(*) FILTER (p AND NOT a) AS fp, COUNT(*) FILTER (NOT p AND a) AS fn, COUNT(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT l_quantity > 25 AS p, l_returnflag = 'R' AS a FROM lineitem))")
def binary_metrics(spark, d):
    return reference.binary_metrics(table(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("p"), (F.col("l_returnflag") == "R").alias("a")), "p", "a")


@query(KG + f"SELECT ROUND((SELECT COUNT(*) FROM kg WHERE p IN ('{TYPE}', '{LABEL}')) / COUNT(*), 6) AS allowed_share, ROUND(LEAST(1.0, COUNT(*) / (SELECT COUNT(*) FROM lineitem)), 6) AS size_share FROM kg")
def ref_proxy_quality(spark, d):
    t = graph(spark, d)
    allowed = spark.createDataFrame([(TYPE,), (LABEL,)], "p string")
    return reference.proxy_quality(t, allowed, table(spark, d, "lineitem"))


# ---------------------------------------------------------------- fusion


def _fuse_sides(spark, d):
    """Source: the solvent customers with a segment of their own; target: the customers outside BUILDING, without balances."""
    src = _customers(spark, d, _A).withColumn("o", F.when(F.col("p") == NS + "c_mktsegment", F.lit("SOURCE")).otherwise(F.col("o")))
    return src, _customers(spark, d, _B).where(F.col("p") != NS + "c_cents")


SIDES = f"WITH {KG_SQL}, {ONTO_SQL}, src AS (SELECT s, p, CASE WHEN p = '{NS}c_mktsegment' THEN 'SOURCE' ELSE o END AS o, k, dt FROM ({_part(_A)}) x), tgt AS (SELECT * FROM ({_part(_B)}) x WHERE p <> '{NS}c_cents') "
_FIRST = f""", one AS (SELECT uri AS p FROM prop WHERE max_card = 1 UNION SELECT '{LABEL}' UNION SELECT '{TYPE}'), allowed AS (SELECT uri AS p FROM prop UNION SELECT '{LABEL}' UNION SELECT '{TYPE}'),
sel AS (SELECT s, p, MIN(o) AS o FROM src WHERE p IN (SELECT p FROM one) AND (s, p) NOT IN (SELECT s, p FROM tgt) GROUP BY s, p UNION SELECT s, p, o FROM src WHERE p IN (SELECT p FROM allowed) AND p NOT IN (SELECT p FROM one) AND (s, p, o) NOT IN (SELECT s, p, o FROM tgt)) """


@query(SIDES + _FIRST + "SELECT s, p, o FROM tgt UNION SELECT s, p, o FROM sel")
def fuse_select_first(spark, d):
    src, tgt = _fuse_sides(spark, d)
    return fusion.select_first_value(src, tgt, ontology(spark))["graph"].select("s", "p", "o")


@query(SIDES + _FIRST + "SELECT DISTINCT s, p, o FROM src WHERE (s, p, o) NOT IN (SELECT s, p, o FROM sel)")
def fuse_discarded(spark, d):
    src, tgt = _fuse_sides(spark, d)
    return fusion.select_first_value(src, tgt, ontology(spark))["discarded"].select("s", "p", "o")


def _matched(spark, d):
    """The source under another namespace and a matching of its entities and one predicate."""
    src, tgt = _fuse_sides(spark, d)
    other = src.withColumn("s", F.replace("s", F.lit(RES), F.lit("http://other.example/"))).withColumn("p", F.when(F.col("p") == NS + "c_mktsegment", F.lit("http://other.example/p/segment")).otherwise(F.col("p")))
    m = src.select("s").distinct().select(F.replace("s", F.lit(RES), F.lit("http://other.example/")).alias("id_1"), F.col("s").alias("id_2"), F.lit(0.9).alias("score"), F.lit("entity").alias("id_type"))
    r = spark.createDataFrame([("http://other.example/p/segment", NS + "c_mktsegment", 0.9, "relation")], m.schema)
    return other, tgt, m.unionByName(r)


@query(SIDES + "SELECT s, p, o FROM src UNION SELECT s, p, o FROM tgt")
def fuse_union_matched(spark, d):
    other, tgt, m = _matched(spark, d)
    return fusion.union_matched(other, tgt, m, "http://loom.example/").select("s", "p", "o").distinct()


@query(SIDES + _FIRST + "SELECT s, p, o FROM tgt UNION SELECT s, p, o FROM sel")
def fuse_first_value(spark, d):
    other, tgt, m = _matched(spark, d)
    comp = cluster.match_components(m.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")))
    return fusion.first_value_fusion(other, tgt, ontology(spark), comp, RES, NS)["graph"].select("s", "p", "o")


@query(SIDES + f"SELECT DISTINCT s, 'http://www.w3.org/2002/07/owl#sameAs' AS p, replace(s, '{RES}', 'http://other.example/') AS o FROM src")
def fuse_same_as(spark, d):
    other, tgt, m = _matched(spark, d)
    comp = cluster.match_components(m.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")))
    return fusion.first_value_fusion(other, tgt, ontology(spark), comp, RES, NS)["same_as"].select("s", "p", "o")


@query("""WITH r AS (SELECT DISTINCT id_1, id_2 FROM er_matches WHERE id_type = 'relation' AND id_1 IS NOT NULL AND id_2 IS NOT NULL AND id_1 <> id_2),
f AS (SELECT id_1 AS p, MIN(id_2) AS x FROM r GROUP BY id_1), i AS (SELECT id_2 AS p, MIN(id_1) AS x FROM r GROUP BY id_2)
SELECT q AS p, COUNT(*) AS n FROM (SELECT DISTINCT subject, object, COALESCE(f.x, i.x, predicate) AS q FROM triplets LEFT JOIN f ON predicate = f.p LEFT JOIN i ON predicate = i.p WHERE object IS NOT NULL) GROUP BY q""")
def rewrite_predicates(spark, d):
    t = table(spark, d, "triplets").where("object IS NOT NULL").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.lit("literal").alias("k"))
    return fusion.rewrite_predicates(t, table(spark, d, "er_matches")).groupBy("p").agg(F.count("*").alias("n"))


@query(KG + f"""SELECT s, MAX(v) FILTER (c = 'label_literal') AS label_literal, MAX(v) FILTER (c = 'type_uri') AS type_uri, MAX(v) FILTER (c = 'c_nationkey_uri') AS c_nationkey_uri, MAX(v) FILTER (c = 'c_cents_literal') AS c_cents_literal
FROM (SELECT s, regexp_extract(p, '([^#/]*)$', 1) || CASE WHEN k = 'iri' THEN '_uri' ELSE '_literal' END AS c, string_agg(DISTINCT o, '; ' ORDER BY o) AS v FROM kg WHERE starts_with(s, '{RES}customer/') GROUP BY 1, 2) GROUP BY s""")
def wide_table(spark, d):
    t = graph(spark, d).where(F.col("s").startswith(RES + "customer/"))
    return fusion.wide_table(t, ["label_literal", "type_uri", "c_nationkey_uri", "c_cents_literal"])


# ---------------------------------------------------------------- JSON and text


@query("SELECT DISTINCT 'http://loom.example/ontology/k' AS p, CAST(json_extract(props, '$.k') AS VARCHAR) AS o, md5('{\"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS h FROM events")
def json_to_triples(spark, d):
    nodes = construct.flatten_json(table(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("props").alias("text")))
    g = construct.json_triples(nodes, RES, NS)["graph"]
    return g.where(F.col("p") == NS + "k").select("p", "o", F.substring_index("s", "/", -1).alias("h"))


@query("SELECT '$.k:number' AS path, COUNT(*) AS docs FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_paths(spark, d):
    nodes = construct.flatten_json(table(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("props").alias("text")))
    return construct.json_paths(nodes, with_type=True).groupBy("path").agg(F.count("*").alias("docs"))


@query(f"SELECT '{RES}' || CAST(event_id AS VARCHAR) AS s, '{NS}k' AS p, CAST(json_extract(props, '$.k') AS VARCHAR) AS o FROM events")
def json_mapped(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("props").alias("text"))
    return construct.mapped_json(e, [("$.k", NS + "k", "integer")], resource=RES).select("s", "p", "o")


def _extractions(spark, d):
    t = table(spark, d, "te_triples").select("triple_id", "doc_id", F.col("subject.surface_form").alias("subject"), F.col("predicate.surface_form").alias("predicate"), F.col("object.surface_form").alias("object"))
    l_ = table(spark, d, "falcon_links").select("doc_id", F.col("surface_form").alias("span"), F.col("uri").alias("mapping"), "link_type", F.lit(1.0).alias("score"))
    return t, l_


_BEST = "l AS (SELECT doc_id, lower(surface_form) AS x, link_type, MIN(uri) AS m FROM falcon_links WHERE uri IS NOT NULL AND surface_form IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_BEST} SELECT triple_id, a.m AS s_map, b.m AS p_map, c.m AS o_map FROM te_triples t LEFT JOIN l a ON a.doc_id = t.doc_id AND a.link_type = 'entity' AND a.x = lower(t.subject.surface_form) LEFT JOIN l b ON b.doc_id = t.doc_id AND b.link_type = 'relation' AND b.x = lower(t.predicate.surface_form) LEFT JOIN l c ON c.doc_id = t.doc_id AND c.link_type = 'entity' AND c.x = lower(t.object.surface_form)")
def te_apply_links(spark, d):
    t, l_ = _extractions(spark, d)
    return linking.apply_links(t, l_).select("triple_id", "s_map", "p_map", "o_map")


@query(f"""WITH {_BEST} SELECT COUNT(*) AS n, COUNT(DISTINCT s) AS subjects FROM (SELECT DISTINCT COALESCE(a.m, '{RES}' || sha256(t.subject.surface_form)) AS s, b.m AS p, t.object.surface_form AS o FROM te_triples t JOIN l b ON b.doc_id = t.doc_id AND b.link_type = 'relation' AND b.x = lower(t.predicate.surface_form) LEFT JOIN l a ON a.doc_id = t.doc_id AND a.link_type = 'entity' AND a.x = lower(t.subject.surface_form)
WHERE t.subject.surface_form IS NOT NULL AND t.object.surface_form IS NOT NULL)""")
def te_to_triples(spark, d):
    t, l_ = _extractions(spark, d)
    linked = linking.apply_links(t.where("subject IS NOT NULL AND object IS NOT NULL"), l_)
    uris = l_.where("link_type = 'relation' AND mapping IS NOT NULL").select(F.col("mapping").alias("uri")).distinct()
    props = uris.select("uri", F.lit("datatype").alias("kind"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("range"), F.lit(None).cast("int").alias("min_card"), F.lit(None).cast("int").alias("max_card"))
    g = linking.triples_from_text(linked, Ontology(props, props), RES)
    return g.where(F.col("p") != LABEL).agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query("SELECT doc_id, COUNT(*) AS n FROM (SELECT doc_id FROM te_triples UNION ALL SELECT doc_id FROM falcon_links) GROUP BY doc_id")
def te_merge_documents(spark, d):
    t, l_ = _extractions(spark, d)
    a = t.groupBy("doc_id").agg(F.collect_list(F.concat_ws(" ", "subject", "predicate", "object")).alias("parts"))
    b = l_.groupBy("doc_id").agg(F.collect_list(F.coalesce("span", F.lit(""))).alias("parts"))
    return linking.merge_documents([a, b]).select("doc_id", F.size("parts").cast("long").alias("n"))


@query("""WITH ch AS (SELECT doc_id, lower(surface_form) AS a, MIN(uri) AS main FROM falcon_links WHERE link_type = 'entity' AND uri IS NOT NULL AND surface_form IS NOT NULL GROUP BY ALL)
SELECT triple_id, COALESCE(x.main, t.subject.surface_form) AS subject, COALESCE(y.main, t.object.surface_form) AS object FROM te_triples t LEFT JOIN ch x ON x.doc_id = t.doc_id AND x.a = lower(t.subject.surface_form) LEFT JOIN ch y ON y.doc_id = t.doc_id AND y.a = lower(t.object.surface_form)""")
def te_chains(spark, d):
    t, l_ = _extractions(spark, d)
    c = l_.where("link_type = 'entity' AND mapping IS NOT NULL AND span IS NOT NULL").select("doc_id", F.col("mapping").alias("main"), F.col("span").alias("alias"))
    return linking.apply_chains(t, c).select("triple_id", "subject", "object")


@query("""WITH w AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc, uri AS e FROM falcon_links WHERE link_type = 'entity' AND uri IS NOT NULL AND surface_form IS NOT NULL), g AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc, uri AS e FROM falcon_links WHERE link_type = 'entity' AND uri IS NOT NULL AND (surface_form IS NULL OR length(surface_form) > 12))
SELECT f AS "false", h AS hits, n - h AS missing, ROUND(h / n, 6) AS score FROM (SELECT (SELECT COUNT(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM w)) AS f, (SELECT COUNT(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM w)) AS h, (SELECT COUNT(*) FROM w) AS n)""")
def te_link_eval(spark, d):
    l_ = table(spark, d, "falcon_links").where("link_type = 'entity' AND uri IS NOT NULL")
    got = l_.where("surface_form IS NULL OR length(surface_form) > 12").select("doc_id", F.col("uri").alias("mapping"), "link_type")
    return reference.link_evaluation(got, l_.where("surface_form IS NOT NULL").select("doc_id", F.col("uri").alias("entity_id")))


@query("SELECT ROUND(COUNT(*) FILTER (subject.surface_form IS NOT NULL AND predicate.surface_form IS NOT NULL AND object.surface_form IS NOT NULL) / COUNT(*), 6) AS complete, CAST(1.0 AS DOUBLE) AS mean_score FROM te_triples")
def te_quality(spark, d):
    t, l_ = _extractions(spark, d)
    return reference.extraction_quality(t, l_)


_DONE, _IS = linking.ACTION.replace("'", "''"), linking.IS_A.replace("'", "''")


@query(f"""SELECT doc_id, unnest(regexp_extract_all(text, '{_DONE}', 1)) AS subject, unnest(regexp_extract_all(text, '{_DONE}', 2)) AS predicate, unnest(regexp_extract_all(text, '{_DONE}', 3)) AS object FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '{_IS}', 1)), 'is a', unnest(regexp_extract_all(text, '{_IS}', 2)) FROM documents""")
def te_pattern_triples(spark, d):
    return linking.pattern_triples(table(spark, d, "documents"), actions=True)


# ---------------------------------------------------------------- reporting


def _metrics(spark, d):
    """A long metric table from the events: user groups as pipelines, three stages, event types as metrics."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("pipeline"), F.concat(F.lit("stage_"), (F.col("event_id") % 3 + 1).cast("string")).alias("stage"), F.lit("statistical").alias("aspect"),
        F.col("event_type").alias("metric"), F.floor(F.abs("value")).cast("double").alias("value"), F.lit(None).cast("double").alias("normalized"), (F.col("event_id") % 60).cast("double").alias("duration"), "props", "event_id",
    )


METRICS = "m AS (SELECT 'p' || CAST(user_id % 6 AS VARCHAR) AS pipeline, 'stage_' || CAST(event_id % 3 + 1 AS VARCHAR) AS stage, event_type AS metric, CAST(floor(abs(value)) AS DOUBLE) AS value, CAST(event_id % 60 AS DOUBLE) AS duration, event_id FROM events)"


@query(f"WITH {METRICS} SELECT pipeline, stage, " + ", ".join(f"ROUND(AVG(value) FILTER (metric = '{x}'), 3) AS {x}" for x in ("click", "view", "purchase")) + " FROM m GROUP BY pipeline, stage")
def rep_wide(spark, d):
    return report.wide(_metrics(spark, d), ["pipeline", "stage"], names=["click", "view", "purchase"])


@query(f"WITH {METRICS}, a AS (SELECT pipeline, metric, SUM(value) AS value FROM m GROUP BY ALL) SELECT pipeline, metric, ROUND(COALESCE(CASE WHEN metric = 'view' THEN MIN(value) OVER (PARTITION BY metric) / NULLIF(value, 0) ELSE value / NULLIF(MAX(value) OVER (PARTITION BY metric), 0) END, 0), 6) AS score FROM a")
def rep_normalize(spark, d):
    a = _metrics(spark, d).groupBy("pipeline", "metric").agg(F.sum("value").alias("value"))
    return report.normalize(a, lower_better=("view",)).select("pipeline", "metric", "score")


def _scores(spark, d):
    n = _metrics(spark, d).groupBy("pipeline").agg(F.count_if(F.col("metric") == "click").alias("a"), F.count_if(F.col("metric") == "view").alias("b"), F.count_if(F.col("metric") == "purchase").alias("c"), F.count("*").alias("n"))
    return n.select("pipeline", F.round(F.col("a") / F.col("n"), 4).alias("a"), F.round(F.col("b") / F.col("n"), 4).alias("b"), F.round(F.col("c") / F.col("n"), 4).alias("c"), F.lit(0.5).alias("e"))


SCORES = f"{METRICS}, sc AS (SELECT pipeline, ROUND(COUNT(*) FILTER (metric = 'click') / COUNT(*), 4) AS a, ROUND(COUNT(*) FILTER (metric = 'view') / COUNT(*), 4) AS b, ROUND(COUNT(*) FILTER (metric = 'purchase') / COUNT(*), 4) AS c, CAST(0.5 AS DOUBLE) AS e FROM m GROUP BY pipeline)"


@query(f"WITH {SCORES}, w(preset, w1, w2, w3, w4) AS (VALUES " + ", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({e} AS DOUBLE))" for n, (a, b, c, e) in report.PRESETS.items()) + "), x AS (SELECT preset, pipeline, ROUND(a * w1 + b * w2 + c * w3 + e * w4, 6) AS score FROM sc, w) SELECT *, CAST(row_number() OVER (PARTITION BY preset ORDER BY score DESC, pipeline) AS INT) AS rank FROM x")
def rep_preset_ranking(spark, d):
    return report.preset_ranking(_scores(spark, d), ("a", "b", "c", "e"))


@query(f"WITH {SCORES}, w AS (SELECT i / 20 AS w1, j / 20 AS w2, (20 - i - j) / 20 AS w3 FROM range(21) t(i), range(21) u(j) WHERE i + j <= 20), x AS (SELECT pipeline, w1, w2, w3, ROUND(a * w1 + b * w2 + c * w3, 9) AS score FROM sc, w), r AS (SELECT *, row_number() OVER (PARTITION BY w1, w2, w3 ORDER BY score DESC, pipeline) AS rank FROM x) SELECT pipeline, COUNT(*) FILTER (rank = 1) AS wins, ROUND(COUNT(*) FILTER (rank = 1) / 231, 6) AS win_share, ROUND(AVG(rank), 6) AS mean_rank, ROUND(AVG(score), 6) AS mean_score FROM r GROUP BY pipeline")
def rep_weight_sensitivity(spark, d):
    return report.weight_sensitivity(_scores(spark, d), ("a", "b", "c"))


@query(f"WITH {METRICS}, x AS (SELECT pipeline, event_id, MAX(value) OVER (PARTITION BY pipeline ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best, MAX(value) OVER (PARTITION BY pipeline) AS final FROM m) SELECT pipeline, MAX(final) AS final, MIN(event_id) FILTER (best >= 0.95 * final) AS first_step FROM x GROUP BY pipeline")
def rep_best_so_far(spark, d):
    return report.best_so_far(_metrics(spark, d), "pipeline", "event_id", "value")


@query("""WITH s AS (SELECT o_custkey AS k, CAST(COUNT(*) AS DOUBLE) AS a, ROUND(SUM(o_totalprice), 2) AS b FROM orders GROUP BY o_custkey), x AS (SELECT k, a, ROUND(b / 100000, 4) AS b FROM s), r AS (SELECT *, dense_rank() OVER (ORDER BY a) AS ra, dense_rank() OVER (ORDER BY b) AS rb, row_number() OVER (ORDER BY a DESC, k) AS ta, row_number() OVER (ORDER BY b DESC, k) AS tb FROM x)
SELECT ROUND(corr(a, b), 6) AS pearson, ROUND(corr(ra, rb), 6) AS spearman, ROUND(AVG(abs(a - b)), 6) AS mae, ROUND(stddev_samp(a - b), 6) AS sd, ROUND(COUNT(*) FILTER (ta <= 5 AND tb <= 5) / 5, 6) AS top_k FROM r""")
def rep_agreement(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("a"), F.round(F.sum("o_totalprice"), 2).alias("b"))
    return report.agreement(s.select("k", "a", F.round(F.col("b") / 100000, 4).alias("b")), "a", "b", "k")


@query(f"WITH {METRICS} SELECT pipeline, ROUND(SUM(duration), 3) AS total, ROUND(AVG(duration), 3) AS mean FROM m GROUP BY pipeline")
def rep_durations(spark, d):
    return report.duration_totals(_metrics(spark, d))


@query(f"WITH {METRICS}, p AS (SELECT * FROM m WHERE NOT (pipeline = 'p1' AND stage = 'stage_2')), g AS (SELECT * FROM (SELECT DISTINCT pipeline FROM p), (SELECT DISTINCT stage FROM p)) SELECT g.pipeline, g.stage, COALESCE(SUM(duration), 0) AS duration FROM g LEFT JOIN p ON p.pipeline = g.pipeline AND p.stage = g.stage GROUP BY 1, 2")
def rep_grid(spark, d):
    return report.grid(_metrics(spark, d).where("NOT (pipeline = 'p1' AND stage = 'stage_2')"), ["pipeline", "stage"], "duration")


@query(f"WITH {METRICS}, v AS (SELECT pipeline, MAX(value) FILTER (metric = 'purchase' AND pipeline < 'p3') AS a, MAX(value) FILTER (metric = 'click') AS b FROM m WHERE value >= 0 GROUP BY pipeline) SELECT pipeline, CASE WHEN a IS NOT NULL THEN 'purchase' ELSE 'click' END AS metric, ROUND(COALESCE(a, b), 6) AS value FROM v")
def rep_selected_metric(spark, d):
    m = _metrics(spark, d).where("NOT (metric = 'purchase' AND pipeline >= 'p3')").withColumn("details", F.lit("{}"))
    return report.selected_metric(m, ["purchase", "click"])


@query("""WITH c AS (SELECT c_mktsegment AS cls, COUNT(*) AS n FROM customer GROUP BY 1), q AS (SELECT cls, n * 97 / SUM(n) OVER () AS q FROM c), f AS (SELECT cls, floor(q) AS f, row_number() OVER (ORDER BY ROUND(q - floor(q), 9) DESC, cls) AS r FROM q) SELECT cls, CAST(f + CASE WHEN r <= 97 - (SELECT SUM(f) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def sample_quota(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cls")).agg(F.count("*").alias("n"))
    return report.apportion(c, "cls", "n", 97)


@query()
def sample_members(spark, d):
    return report.sample_by_class(table(spark, d, "customer").select(F.col("c_mktsegment").alias("cls"), "c_custkey"), "cls", "c_custkey", 97)


@query()
def json_set_cover(spark, d):
    t = table(spark, d, "triplets").select("subject", "predicate").distinct()
    return cluster.set_cover(t, "subject", "predicate")


# ---------------------------------------------------------------- graph patterns


@query(KG + f"SELECT a.s AS c, MIN(a.o) AS name, MIN(b.o) AS nation, MIN(g.o) AS segment FROM kg a JOIN kg b ON a.s = b.s AND b.p = '{NS}c_nationkey' LEFT JOIN kg g ON g.s = a.s AND g.p = '{NS}c_mktsegment' WHERE a.p = '{LABEL}' GROUP BY a.s")
def bgp_star(spark, d):
    return bgp.star(graph(spark, d), "c", {"name": LABEL, "nation": NS + "c_nationkey"}, {"segment": NS + "c_mktsegment"})


@query(KG + f"SELECT x.s AS o, y.o AS n, z.o AS name FROM kg x JOIN kg y ON x.o = y.s AND y.p = '{NS}c_nationkey' LEFT JOIN kg z ON z.s = y.o AND z.p = '{LABEL}' WHERE x.p = '{NS}o_custkey'")
def bgp_optional(spark, d):
    q = bgp.Query(where=[("?o", NS + "o_custkey", "?c"), ("?c", NS + "c_nationkey", "?n")], optional=[[("?n", LABEL, "?name")]], select=["o", "n", "name"])
    return q.run(graph(spark, d))


@query(KG + f"SELECT DISTINCT s AS x, o AS n FROM kg WHERE p IN ('{NS}c_nationkey', '{NS}s_nationkey') AND o IN ('{RES}nation/3', '{RES}nation/4')")
def bgp_union_values(spark, d):
    q = bgp.Query(union=[[("?x", NS + "c_nationkey", "?n")], [("?x", NS + "s_nationkey", "?n")]], values={"n": [RES + "nation/3", RES + "nation/4"]}, distinct=True, select=["x", "n"])
    return q.run(graph(spark, d))


@query(KG + f"SELECT a.s AS c, CASE WHEN CAST(a.o AS VARCHAR) LIKE '-%' THEN 'debt' ELSE 'fine' END AS state FROM kg a WHERE a.p = '{NS}c_cents' AND a.o <> 'about ten'")
def bgp_bind_filter(spark, d):
    q = bgp.Query(where=[("?c", NS + "c_cents", "?v")], bind={"state": F.when(F.col("v").startswith("-"), "debt").otherwise("fine")}, filters=[F.col("v") != "about ten"], select=["c", "state"])
    return q.run(graph(spark, d))


@query(KG + f"SELECT a.o AS n, string_agg(DISTINCT b.o, ', ' ORDER BY b.o) AS segments FROM kg a JOIN kg b ON a.s = b.s AND b.p = '{NS}c_mktsegment' WHERE a.p = '{NS}c_nationkey' GROUP BY a.o")
def bgp_group_concat(spark, d):
    q = bgp.Query(where=[("?c", NS + "c_nationkey", "?n"), ("?c", NS + "c_mktsegment", "?s")], group=["n"], aggregates={"segments": F.array_join(F.sort_array(F.collect_set("s")), ", ")})
    return q.run(graph(spark, d))


@query(KG + f"SELECT DISTINCT b.o AS s, '{NS}buys_from' AS p, a.s AS o FROM kg a JOIN kg b ON a.o = b.s AND b.p = '{NS}c_nationkey' WHERE a.p = '{NS}o_custkey'")
def bgp_construct(spark, d):
    b = bgp.bgp(graph(spark, d), [("?o", NS + "o_custkey", "?c"), ("?c", NS + "c_nationkey", "?n")])
    return bgp.construct(b, [("?n", NS + "buys_from", "?o")])


@query("""WITH RECURSIVE w AS (SELECT DISTINCT string_split(p_type, ' ') AS w FROM part), e AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS cls, array_to_string(w[1:2], ' ') AS super FROM w WHERE len(w) > 2 UNION SELECT array_to_string(w[1:2], ' '), w[1] FROM w WHERE len(w) > 1 UNION SELECT w[1], 'Thing' FROM w),
up AS (SELECT cls AS a, super AS b FROM e UNION SELECT up.a, e.super FROM up JOIN e ON up.b = e.cls) SELECT a, b FROM up""")
def bgp_path_plus(spark, d):
    return bgp.path_plus(_hierarchy(spark, d), RDFS + "subClassOf")


# ---------------------------------------------------------------- scalar functions and parameters


@query("""SELECT term_id, lower(trim(translate(label, '_-', '  '))) AS norm, 'label: ' || label || CASE WHEN len(alt_labels) > 0 THEN '; altLabels: ' || array_to_string(alt_labels, ', ') ELSE '' END AS txt, regexp_extract(uri, '([^#/]*)$', 1) AS local, sha256(uri) AS h FROM ontology_terms""")
def fn_labels(spark, d):
    o = table(spark, d, "ontology_terms")
    return o.select("term_id", T.normalize_label(F.col("label")).alias("norm"), T.property_text(F.col("label"), F.col("alt_labels")).alias("txt"), T.local_name(F.col("uri")).alias("local"), F.sha2("uri", 256).alias("h"))


@query("""SELECT object, CASE WHEN lower(object) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(object, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(object, '^[+-]?[0-9]*[.][0-9]+([eE][+-]?[0-9]+)?$') THEN 'double' WHEN regexp_matches(object, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' ELSE 'string' END AS dt FROM (SELECT DISTINCT object FROM triplets WHERE object IS NOT NULL)""")
def fn_literal_type(spark, d):
    t = table(spark, d, "triplets").where("object IS NOT NULL").select("object").distinct()
    return t.select("object", F.substring_index(T.literal_type(F.col("object")), "#", -1).alias("dt"))


HELP = """usage: tool [options]
  --input PATH           file to read (required)
  -t, --threshold FLOAT  score from which pairs count [default: 0.5]
  --mode {fast,exact}    how to search
  --verbose              say more
  --max-rows INTEGER     rows at most (default: 1000)
"""


@query("SELECT * FROM (VALUES ('input', 'string', CAST(NULL AS VARCHAR), TRUE), ('threshold', 'number', '0.5', FALSE), ('mode', 'enum', NULL, FALSE), ('verbose', 'boolean', NULL, FALSE), ('max_rows', 'integer', '1000', FALSE)) t(name, datatype, \"default\", required)")
def params_cli(spark, d):
    f = spark.createDataFrame([("tool.txt", HELP)], "path string, text string")
    return params.cli_parameters(f).select("name", "datatype", "default", "required")


@query("SELECT * FROM (VALUES ('port', 'integer', '8080'), ('model_name', 'string', CAST(NULL AS VARCHAR)), ('debug', 'boolean', 'false')) t(name, datatype, \"default\")")
def params_env(spark, d):
    f = spark.createDataFrame([("Dockerfile", "FROM base\nENV PORT=8080\nARG MODEL_NAME\nENV DEBUG false\n")], "path string, text string")
    return params.env_parameters(f).select("name", "datatype", "default")


@query("SELECT i AS id, ROUND(0.45 * (i / 10) + 0.30 * (1 - i / 10) + 0.25 * (i / 20), 6) AS quality FROM range(11) t(i)")
def cfg_quality_estimate(spark, d):
    x = F.col("id") / 10
    return spark.range(11).select("id", F.round(params.quality(x, 1 - x, F.col("id") / 20), 6).alias("quality"))
