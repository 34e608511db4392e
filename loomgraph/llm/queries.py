"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, small, table
from . import canonical
from . import components as comp
from . import entity_match, leakage, mojibake, neighbours
from . import packing
from . import survivors as surv


def surface_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, row_id, list, form) of all extracted predicates and links; a link of another type than relation or entity has no list."""
    te = table(spark, sf_dir, "te_triples").select(F.lit("te_triples").alias("origin"), F.col("triple_id").alias("row_id"), F.lit("relation").alias("list"), F.col("predicate.surface_form").alias("form"))
    links = table(spark, sf_dir, "falcon_links").where("link_type IN ('relation', 'entity')")
    links = links.select(F.lit("falcon_links").alias("origin"), F.col("link_id").alias("row_id"), F.col("link_type").alias("list"), F.col("surface_form").alias("form"))
    return te.unionByName(links)


def term_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(list, term_id, label) of the canonical list, one row for each label and alternative label."""
    terms = table(spark, sf_dir, "ontology_terms")
    names = F.explode(F.concat(F.array("label"), F.coalesce("alt_labels", F.array().cast("array<string>"))))
    return terms.select(F.when(F.col("kind") == "relation", "relation").otherwise("entity").alias("list"), "term_id", names.alias("label"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = term_labels(spark, sf_dir)
    rows = surface_rows(spark, sf_dir).where(r"form RLIKE '[^\\s\\p{Z}\\p{Cf}\\p{Cc}]'")
    rows = rows.join(small(terms.select("list", F.col("label").alias("form"))), ["list", "form"], "left_anti")
    found = canonical.map_to_canonical(rows, terms)
    return rows.join(found, ["list", "form"]).select("origin", "row_id", "term_id")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings_cache"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairs(p2_neighbours(spark, sf_dir))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.recall(table(spark, sf_dir, "embeddings_cache"), p2_neighbours(spark, sf_dir))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.match(table(spark, sf_dir, "book_source"), table(spark, sf_dir, "book_target"), ("id", "title", "author", "isbn13"), ("id", "title", "author", "isbn"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("source_id", "target_id").distinct()


def single_valued_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of triplets about properties with a maximal cardinality of 1."""
    terms = table(spark, sf_dir, "ontology_terms").where("max_cardinality = 1").select(F.col("uri").alias("property"), surv.kind_of(F.col("label")).alias("kind"))
    t = table(spark, sf_dir, "triplets").select("subject", F.col("predicate").alias("property"), F.col("object").alias("value"), "score", F.col("extracted_at").alias("at"), F.col("triplet_id").alias("row_id"), F.col("graph").alias("source"))
    return t.join(small(terms), "property")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surv.survivors(single_valued_claims(spark, sf_dir)).where("claims > 1")
    return found.select("subject", F.col("property").alias("predicate"), F.col("row_id").alias("triplet_id"))


#: Properties that describe one event or release and are taken from one source together.
BUNDLES = {"birth": ("date of birth", "place of birth"), "death": ("date of death", "place of death"), "release": ("release date", "running time"), "print": ("publication date", "number of pages")}
#: Properties of which the first says what the second must be, where sources agree on it.
LINKED = (("original title", "original language"), ("birth name", "native language"), ("original title", "age rating"), ("headquarters", "chief executive"))


def p4_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, predicate, bundle, triplet_id, searched): records put together from whole bundles, with the dependencies that the sources' own claims show."""
    names = table(spark, sf_dir, "ontology_terms").where("max_cardinality = 1").select("uri", "label")
    claims = single_valued_claims(spark, sf_dir)
    uri = {r.label: r.uri for r in names.where(F.col("label").isin([x for b in (*BUNDLES.values(), *LINKED) for x in b])).collect()}
    bundles = {b: tuple(uri[x] for x in fields) for b, fields in BUNDLES.items()}
    found = surv.survivors(claims, bundles, surv.mined_dependencies(claims, [(uri[a], uri[b]) for a, b in LINKED]))
    return found.select("subject", F.col("property").alias("predicate"), "bundle", F.col("row_id").alias("triplet_id"), "searched")


def match_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links between records, in plain IRIs: entity matches with a score of 0.5 or more, and verified matches."""
    er = table(spark, sf_dir, "er_matches").where("id_type = 'entity' AND score >= 0.5 AND NOT isnan(score)")
    er = er.select(F.col("id_1").alias("a"), F.col("id_2").alias("b"))
    ok = table(spark, sf_dir, "verified_matches").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    # Different spellings are put in plain form once each and written, so that no later filter or projection repeats it.
    raw = er.unionByName(ok).where("length(trim(a)) > 0 AND length(trim(b)) > 0").distinct()
    return Scratch(spark, "links").keep(raw.select(comp.plain_iri(F.col("a")).alias("a"), comp.plain_iri(F.col("b")).alias("b")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.components(match_links(spark, sf_dir), "a", "b")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p6_containers(spark, sf_dir))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item the number of documents that hold a passage of it."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(table(spark, sf_dir, "documents"))


def queries():
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_recall": p2_recall, "p3_found": p3_found, "p3_matches": p3_matches, "p4_found": p4_found, "p4_bundles": p4_bundles, "p5_found": p5_found, "p6_containers": p6_containers, "p6_report": p6_report, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_report": p7_report, "p8_found": p8_found, "p8_restored": p8_restored}


_PLAIN = "lower(regexp_extract({c}, '^[A-Za-z]+://[^/]*')) || substr({c}, length(regexp_extract({c}, '^[A-Za-z]+://[^/]*')) + 1)"
_TRIM = "trim({c}, ' <>' || chr(9) || chr(10) || chr(34))"

P5_SQL = f"""WITH RECURSIVE l AS (SELECT {_TRIM.format(c="id_1")} AS a, {_TRIM.format(c="id_2")} AS b FROM er_matches WHERE id_type = 'entity' AND score >= 0.5 AND NOT isnan(score)
  UNION SELECT {_TRIM.format(c="left_id")}, {_TRIM.format(c="right_id")} FROM verified_matches),
p AS (SELECT {_PLAIN.format(c="a")} AS a, {_PLAIN.format(c="b")} AS b FROM l WHERE a <> '' AND b <> ''), e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
r AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS record_id, MIN(y) AS group_id FROM r GROUP BY x"""


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_MONTH = "list_position([" + ", ".join(f"'{m}'" for m in surv.MONTHS) + "], regexp_extract(l, '^(?:[0-9]{1,2}[.]? )?([a-z]+) [0-9]{4}$', 1))"

P4_SQL = f"""WITH t AS (SELECT subject, predicate, object, triplet_id, CASE WHEN score IS NULL OR isnan(score) OR score < 0 THEN -1 WHEN score > 1 THEN score / 100 ELSE score END AS trust, extracted_at AS seen,
  CASE {" ".join(f"WHEN lower(label) IN {_list(labels)} THEN '{kind}'" for kind, labels in surv.KINDS.items())} ELSE 'text' END AS kind, trim(regexp_replace(object, '[\\s\\p{{Z}}\\p{{Cf}}]+', ' ', 'g')) AS v
  FROM triplets JOIN ontology_terms ON predicate = uri WHERE max_cardinality = 1),
n AS (SELECT subject, predicate FROM t GROUP BY 1, 2 HAVING COUNT(*) > 1),
k AS (SELECT DISTINCT subject, predicate, object, kind, v, lower(v) AS l FROM t WHERE v IS NOT NULL AND lower(v) NOT IN {_list(surv.NO_VALUE)} AND NOT regexp_matches(v, '^[�?.\\s]*$')),
d0 AS (SELECT *, CASE WHEN kind = 'date' THEN {_MONTH} END AS mo FROM k),
d1 AS (SELECT *, CASE WHEN kind = 'date' THEN coalesce(try_cast(nullif(regexp_extract(l, '^([0-9]{{4}})(-[0-9]{{2}}){{0,2}}$', 1), '') AS INT), try_cast(nullif(regexp_extract(l, '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.]([0-9]{{4}})$', 1), '') AS INT), CASE WHEN mo > 0 THEN try_cast(regexp_extract(l, '([0-9]{{4}})$', 1) AS INT) END) END AS y,
  CASE WHEN kind = 'date' THEN coalesce(try_cast(nullif(regexp_extract(l, '^[0-9]{{4}}-([0-9]{{2}})', 1), '') AS INT), try_cast(nullif(regexp_extract(l, '^[0-9]{{1,2}}[.]([0-9]{{1,2}})[.][0-9]{{4}}$', 1), '') AS INT), CASE WHEN mo > 0 THEN mo END) END AS m,
  CASE WHEN kind = 'date' THEN coalesce(try_cast(nullif(regexp_extract(l, '^[0-9]{{4}}-[0-9]{{2}}-([0-9]{{2}})$', 1), '') AS INT), try_cast(nullif(regexp_extract(l, '^([0-9]{{1,2}})[.][0-9]{{1,2}}[.][0-9]{{4}}$', 1), '') AS INT), CASE WHEN mo > 0 THEN try_cast(nullif(regexp_extract(l, '^([0-9]{{1,2}})[.]? [a-z]+ [0-9]{{4}}$', 1), '') AS INT) END) END AS d FROM d0),
u AS (SELECT *, rtrim(regexp_replace(v, '\\s*(\\[\\s*([.]{{3}}|…)\\s*\\]|[.]{{3}}|…)\\s*$', '')) AS form FROM d1 WHERE CASE WHEN kind = 'date' THEN y BETWEEN 1 AND 2999 AND try_cast(printf('%04d-%02d-%02d', y, coalesce(m, 1), coalesce(d, 1)) AS DATE) IS NOT NULL
  WHEN kind = 'number' THEN regexp_matches(v, '^[+]?([0-9]+|[0-9]{{1,3}}([,. ][0-9]{{3}})+)([.,][0-9]+)?$') ELSE TRUE END),
w AS (SELECT *, trim(CASE WHEN contains(form, ',') THEN split_part(form, ',', 1) ELSE string_split(form, ' ')[-1] END) AS sur, trim(CASE WHEN contains(form, ',') THEN string_split(form, ',')[-1] ELSE left(form, length(form) - length(string_split(form, ' ')[-1])) END) AS giv FROM u),
x AS (SELECT *, left(giv, 1) AS ini, regexp_matches(giv, '^\\p{{L}}[.]?( ?\\p{{L}}[.])*$') AS short FROM w),
gone AS (SELECT DISTINCT a.subject, a.predicate, a.object FROM x a JOIN x b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object WHERE
  a.kind = 'date' AND a.y = b.y AND (a.m IS NULL AND b.m IS NOT NULL OR a.m = b.m AND a.d IS NULL AND b.d IS NOT NULL)
  OR a.kind = 'person' AND a.sur = b.sur AND a.ini = b.ini AND a.sur <> '' AND a.ini <> '' AND a.short AND NOT b.short
  OR a.kind IN ('text', 'person') AND a.form <> '' AND starts_with(b.form, a.form) AND (a.form <> b.form OR a.v <> a.form AND b.v = b.form))
SELECT subject, predicate, triplet_id FROM (SELECT t.subject, t.predicate, t.triplet_id, row_number() OVER (PARTITION BY t.subject, t.predicate ORDER BY trust DESC, seen DESC NULLS LAST, triplet_id) AS r
  FROM t SEMI JOIN n USING (subject, predicate) SEMI JOIN x USING (subject, predicate, object) ANTI JOIN gone USING (subject, predicate, object)) WHERE r = 1"""

_NORM = "list_transform(CAST(value AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(value AS DOUBLE[]), lambda y: y * y))))"

P2_SQL = f"""WITH v AS (SELECT vec_id, {_NORM} AS u FROM embeddings_cache WHERE len(value) = 64 AND len(list_filter(value, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(value, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, ROUND(list_dot_product(a.u, b.u), 9) AS sim FROM v a, v b WHERE a.vec_id <> b.vec_id),
r AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s) WHERE r <= 5)
SELECT DISTINCT least(a, b) AS vec_id_1, greatest(a, b) AS vec_id_2 FROM r"""


def oracle_sql():
    return {"p2_found": P2_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
