"""Text extractions: applying links and coreference, merging documents, pattern extraction, blocked matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..model import LABEL, TYPE, XSD, Ontology, as_graph
from ..session import Scratch, small

IS_A = r"\b([A-Z][\p{L}\p{N}'-]*(?: [A-Z][\p{L}\p{N}'-]*)*) (?:is|was) an? ([a-z][\p{L}-]*(?: [a-z][\p{L}-]*)?)"


ACTION = r"([A-Z][\p{L}'-]+ [A-Z][\p{L}'-]+) ([a-z]+s) (?:an|a|the) ([a-z]+ [a-z]+)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern_triples(docs: DataFrame, key: str = "doc_id", text: str = "text", actions: bool = False) -> DataFrame:
    """(key, subject, predicate, object) of sentences of the form `X is a(n) Y` and, with `actions`, `Given Surname does a(n) Y`."""
    hits = docs.select(key, F.explode(F.expr(f"regexp_extract_all({text}, {_quoted(IS_A)}, 0)")).alias("m"))
    out = hits.select(key, F.regexp_extract("m", IS_A, 1).alias("subject"), F.lit("is a").alias("predicate"), F.regexp_extract("m", IS_A, 2).alias("object"))
    if not actions:
        return out
    done = docs.select(key, F.explode(F.expr(f"regexp_extract_all({text}, {_quoted(ACTION)}, 0)")).alias("m"))
    return out.unionByName(done.select(key, *[F.regexp_extract("m", ACTION, i + 1).alias(n) for i, n in enumerate(("subject", "predicate", "object"))]))


def best_links(links: DataFrame, key: str = "doc_id") -> DataFrame:
    """One mapping per (document, span in lower case, type): highest score, then the least mapping."""
    w = W.partitionBy(key, "span_l", "link_type").orderBy(F.desc_nulls_last("score"), "mapping")
    return links.where("mapping IS NOT NULL AND span IS NOT NULL").withColumn("span_l", F.lower("span")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_chains(triples: DataFrame, chains: DataFrame, key: str = "doc_id") -> DataFrame:
    """Subjects and objects that are an alias of a chain replaced by its main mention; chains: (key, main, alias)."""
    c = chains.groupBy(key, F.lower("alias").alias("a")).agg(F.min("main").alias("main"))
    out = triples
    for col in ("subject", "object"):
        out = out.withColumn("a", F.lower(col)).join(c, [key, "a"], "left").withColumn(col, F.coalesce("main", col)).drop("a", "main")
    return out


def apply_links(triples: DataFrame, links: DataFrame, key: str = "doc_id", entity_min: float = 0.5, relation_min: float = 0.3) -> DataFrame:
    """Adds s_map, p_map, o_map: the mappings of the three surface forms in the same document, above their thresholds."""
    ok = links.where(((F.col("link_type") == "entity") & (F.col("score") >= entity_min)) | ((F.col("link_type") == "relation") & (F.col("score") >= relation_min)))
    b = best_links(ok, key)
    out = triples
    for col, kind, name in (("subject", "entity", "s_map"), ("predicate", "relation", "p_map"), ("object", "entity", "o_map")):
        side = b.where(F.col("link_type") == kind).select(key, F.col("span_l").alias("_x"), F.col("mapping").alias(name))
        out = out.withColumn("_x", F.lower(col)).join(side, [key, "_x"], "left").drop("_x")
    return out


def triples_from_text(linked: DataFrame, o: Ontology, namespace: str, mint: bool = True) -> DataFrame:
    """Graph from linked extractions: the predicate must be mapped; unmapped subjects and objects are minted (sha256) or skipped.

    A property whose range is no datatype takes IRIs; domain and range give the types; surface forms become labels.
    """
    p = F.broadcast(o.properties.select(F.col("uri").alias("p_map"), "domain", "range"))
    x = linked.where("p_map IS NOT NULL").join(p, "p_map")
    minted = lambda c: T.seed_uri(namespace, F.col(c)) if mint else F.lit(None).cast("string")
    x = x.withColumn("s", F.coalesce("s_map", minted("subject"))).withColumn("is_obj", F.col("range").isNotNull() & ~F.col("range").startswith(XSD))
    x = x.withColumn("o_iri", F.when(F.col("is_obj"), F.coalesce("o_map", minted("object"))))
    x = x.where("s IS NOT NULL AND (NOT is_obj OR o_iri IS NOT NULL)")
    t = lambda s, p_, o_, k, dt=None: F.struct(s.alias("s"), p_.alias("p"), o_.alias("o"), F.lit(k).alias("k"), (dt if dt is not None else F.lit(None).cast("string")).alias("dt"))
    obj = F.col("is_obj")
    rows = F.array(
        F.when(obj, t(F.col("s"), F.col("p_map"), F.col("o_iri"), "iri")).otherwise(t(F.col("s"), F.col("p_map"), F.col("object"), "literal", F.coalesce("range", F.lit(XSD + "string")))),
        t(F.col("s"), F.lit(LABEL), F.col("subject"), "literal", F.lit(XSD + "string")),
        F.when(obj, t(F.col("o_iri"), F.lit(LABEL), F.col("object"), "literal", F.lit(XSD + "string"))),
        F.when(F.col("domain").isNotNull(), t(F.col("s"), F.lit(TYPE), F.col("domain"), "iri")),
        F.when(obj, t(F.col("o_iri"), F.lit(TYPE), F.col("range"), "iri")),
    )
    return as_graph(x.select(F.explode(rows).alias("r")).where("r IS NOT NULL AND r.o IS NOT NULL").select("r.*"))


def merge_documents(docs: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Documents of several tools with the same key as one: arrays concatenated in order of the tools, the longest text kept."""
    tagged = [d.withColumn("_n", F.lit(i)) for i, d in enumerate(docs)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    arrays = [c for c, t in out.dtypes if t.startswith("array") and c != key]
    pick = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])).alias("v")))), lambda x: x["v"])).alias(c) for c in arrays]
    texts = [F.max_by("text", F.length("text")).alias("text")] if "text" in out.columns else []
    return out.groupBy(key).agg(*texts, *pick)


def filter_links_by_shade(links: DataFrame, shade: DataFrame) -> DataFrame:
    """Entity links whose mapping is a known shade are mapped back to its original; other entity links drop, other links pass."""
    ent = links.where("link_type = 'entity'").join(small(shade.select(F.col("shade").alias("mapping"), "original")), "mapping").withColumn("mapping", F.col("original")).drop("original")
    return ent.unionByName(links.where("link_type <> 'entity'"))


def token_blocks(a: DataFrame, b: DataFrame, key: str, text: str, max_df: float = 0.05, min_jaccard: float = 0.5) -> DataFrame:
    """(id_1, id_2, score): pairs that share a token, by Jaccard of their token sets.

    Sets are compared, not rows: rows with the same tokens are one set, and their ids come in at the end. Different sets
    of n1 and n2 tokens with Jaccard >= t have o = ceil(t * (n1 + n2) / (1 + t)) tokens in common, so in order of
    frequency the first common one is among the first n1 - o + 1 and n2 - o + 1. A set is looked up there only for the
    sizes that leave room for o, which is exact for the threshold. A pair is scored where its first common token is met,
    so no table of candidates is written.
    """
    scratch = Scratch(a.sparkSession, "blocks")
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    toks = lambda d, i: d.select(words.alias("toks"), *[(F.col(key) if i == j else F.lit(None)).cast(d.schema[key].dataType).alias(f"id_{j}") for j in (1, 2)]).where("size(toks) > 0")
    sets = toks(a, 1).unionByName(toks(b, 2)).groupBy("toks").agg(F.collect_list("id_1").alias("ids_1"), F.collect_list("id_2").alias("ids_2"))
    sets = scratch.keep(sets.withColumn("sid", F.monotonically_increasing_id()))
    each = sets.select("sid", (F.size("ids_1") > 0).alias("in_1"), (F.size("ids_2") > 0).alias("in_2"), F.explode("toks").alias("tok"))
    df = small(each.groupBy("tok").agg(F.count("*").alias("df")))
    ordered = each.join(df, "tok").groupBy("sid").agg(F.first("in_1").alias("in_1"), F.first("in_2").alias("in_2"), F.array_sort(F.collect_list(F.struct("df", "tok")))["tok"].alias("toks"))
    ordered = scratch.keep(ordered.withColumn("n", F.size("toks")))
    t, most = min_jaccard, ordered.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    head = F.expr(f"slice(toks, 1, cast(n - ceil({t} * n) + 1 AS INT))")
    one = lambda i: ordered.where(f"in_{i}").select(F.posexplode(head).alias(f"at_{i}", "tok"), F.col("sid").alias(f"sid_{i}"), F.col("n").alias(f"n_{i}"), F.col("toks").alias(f"t{i}"))
    sizes = F.expr(f"sequence(cast(ceil({t} * n_1 - 1e-9D) AS INT), cast({f'least({most}, floor(n_1 / {t} + 1e-9D))' if t > 0 else most} AS INT))")
    left = one(1).withColumn("n_2", F.explode(sizes)).withColumn("o", F.expr(f"greatest(1, cast(ceil({t} * (n_1 + n_2) / (1 + {t}) - 1e-9D) AS INT))"))
    left = left.where("at_1 + o <= n_1 AND o <= n_2 AND NOT (n_1 = n_2 AND o = n_1)")
    cand = left.join(one(2), ["tok", "n_2"]).where("at_2 + o <= n_2 AND sid_1 <> sid_2")
    cand = cand.withColumn("both", F.array_intersect("t1", "t2")).where(F.get("both", F.lit(0)) == F.col("tok"))
    pairs = cand.select("sid_1", "sid_2", (F.size("both") / (F.col("n_1") + F.col("n_2") - F.size("both"))).alias("score"))
    pairs = pairs.unionByName(ordered.where("in_1 AND in_2").select(F.col("sid").alias("sid_1"), F.col("sid").alias("sid_2"), F.lit(1.0).alias("score"))).where(F.col("score") >= t)
    pairs = scratch.keep(pairs.withColumn("score", F.round("score", 6)))
    for i in (1, 2):
        pairs = pairs.join(sets.select(F.col("sid").alias(f"sid_{i}"), f"ids_{i}"), f"sid_{i}")
    return pairs.select("score", "ids_2", F.explode("ids_1").alias("id_1")).select("id_1", F.explode("ids_2").alias("id_2"), "score")
