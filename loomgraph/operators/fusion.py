"""Fusing graphs: union, substitution by matches, first-value and vote-based choice, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..model import LABEL, OWL, SAME_AS, TYPE, Ontology, as_graph, is_iri
from ..session import BROADCAST_ROWS, Scratch, small


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return as_graph(a.unionByName(b, allowMissingColumns=True))


def substitute(t: DataFrame, mapping: DataFrame, predicates: bool = False) -> DataFrame:
    """Subjects and IRI objects (and predicates, if asked) replaced by `mapping` (src, dst); the least dst counts."""
    m = small(mapping.groupBy("src").agg(F.min("dst").alias("dst")))
    out = t.join(m.select(F.col("src").alias("s"), F.col("dst").alias("_s")), "s", "left")
    out = out.join(m.select(F.col("src").alias("o"), F.col("dst").alias("_o")), "o", "left")
    if predicates:
        out = out.join(m.select(F.col("src").alias("p"), F.col("dst").alias("_p")), "p", "left").withColumn("p", F.coalesce("_p", "p")).drop("_p")
    out = out.withColumn("s", F.coalesce("_s", "s")).withColumn("o", F.when(is_iri(), F.coalesce("_o", "o")).otherwise(F.col("o")))
    return as_graph(out.drop("_s", "_o"))


def _key_bits(keys: DataFrame, n: int) -> DataFrame:
    """One row with a bitmap of `n` keys (one column), a Bloom filter: three bits in one of `words` words, 8 to 16 bits a key up to 8 MB."""
    words = 1 << min(max((n // 8).bit_length(), 12), 20)
    h = F.xxhash64(F.col(keys.columns[0]))
    one = keys.groupBy(_word(h, F.lit(words)).alias("w")).agg(F.bit_or(_bits(h)).alias("b"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(one, "w", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("r"))
    return rows.select(F.transform("r", lambda x: x["b"]).alias("bits"), F.lit(words).alias("words"))


def _word(h: Column, words: Column) -> Column:
    return F.pmod(F.shiftright(h, 18), words).cast("int")


def _bits(h: Column) -> Column:
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def replaced_terms(t: DataFrame, mapping: DataFrame) -> DataFrame:
    """(s, p, o) of `t`, subjects and IRI objects replaced by `mapping` (src, dst; every src once); rows can repeat.

    The terms that `substitute` gives. If the mapping is too large to be broadcast, literals and objects without an entry
    are not joined by object: a bitmap of the sources tells nearly all of them, among them the classes, to each of which
    a good part of all rows points. The mapping is the hashed side of its joins, so the graph is not sorted.
    """
    n = mapping.count()
    m = small(mapping) if n <= BROADCAST_ROWS else mapping
    rows = t.select("s", "p", "o", F.coalesce(is_iri(), F.lit(False)).alias("iri"))
    by = lambda c: m.select(F.col("src").alias(c), F.col("dst").alias("_to"))
    to = lambda x, c: x.withColumn(c, F.coalesce("_to", c)).select("s", "p", "o")
    if m is not mapping:
        return to(to(rows.join(by("k"), F.col("iri") & (F.col("o") == F.col("k")), "left"), "o").join(by("s"), "s", "left"), "s")
    m, h = m.hint("shuffle_hash"), F.xxhash64("o")
    hit = F.get("bits", _word(h, F.col("words"))).bitwiseAND(_bits(h)) == _bits(h)
    rows = rows.crossJoin(F.broadcast(_key_bits(mapping.select("src"), n))).select("s", "p", "o", (F.col("iri") & F.coalesce(hit, F.lit(False))).alias("open"))
    objects = to(rows.where("open").join(by("o"), "o", "left"), "o").unionByName(rows.where("NOT open").select("s", "p", "o"))
    return to(objects.join(by("s"), "s", "left"), "s")


def oriented(matches: DataFrame, target_prefix: str, threshold: float = 0.5) -> DataFrame:
    """(src, dst) of matches above the threshold, dst being the side in the target namespace."""
    m = matches.where((F.col("score") > threshold) & F.col("id_1").isNotNull() & F.col("id_2").isNotNull())
    first = F.col("id_1").startswith(target_prefix)
    return m.where(first | F.col("id_2").startswith(target_prefix)).select(F.when(first, F.col("id_2")).otherwise(F.col("id_1")).alias("src"), F.when(first, F.col("id_1")).otherwise(F.col("id_2")).alias("dst")).where("src <> dst").distinct()


def union_matched(source: DataFrame, target: DataFrame, matches: DataFrame, target_prefix: str, threshold: float = 0.5) -> DataFrame:
    """Source terms rewritten to the target's by matches, then set union."""
    return union(substitute(source, oriented(matches, target_prefix, threshold), predicates=True), target)


def rewrite_predicates(t: DataFrame, matches: DataFrame) -> DataFrame:
    """Predicates replaced by their match in either direction (id_1 to id_2 first); labels and types are no targets."""
    rel = matches.where("id_type = 'relation' AND id_1 IS NOT NULL AND id_2 IS NOT NULL AND id_1 <> id_2")
    fwd = rel.where(~F.col("id_2").isin(LABEL, TYPE)).groupBy(F.col("id_1").alias("p")).agg(F.min("id_2").alias("_f"))
    inv = rel.where(~F.col("id_1").isin(LABEL, TYPE)).groupBy(F.col("id_2").alias("p")).agg(F.min("id_1").alias("_i"))
    out = t.join(small(fwd), "p", "left").join(small(inv), "p", "left")
    return as_graph(out.withColumn("p", F.coalesce("_f", "_i", "p")).drop("_f", "_i"))


def fusable(o: Ontology) -> DataFrame:
    """Properties that take one value: maximal cardinality 1, label and type."""
    return o.properties.where("max_card = 1").select(F.col("uri").alias("p")).union(o.properties.sparkSession.createDataFrame([(LABEL,), (TYPE,)], "p string")).distinct()


def select_first_value(source: DataFrame, target: DataFrame, o: Ontology) -> dict[str, DataFrame]:
    """Target plus what the source adds: {graph, selected, discarded}.

    Only ontology properties, labels and types pass. A single-valued property is added only where the target has no
    value for it, with the least object; any other triple is added if it is new.
    """
    allowed = o.properties.select(F.col("uri").alias("p")).union(o.properties.sparkSession.createDataFrame([(LABEL,), (TYPE,)], "p string")).distinct()
    # both sides are read several times below: written once, with lineage cut
    scratch = Scratch(source.sparkSession, "fusion")
    src = scratch.keep(as_graph(source.join(F.broadcast(allowed), "p", "left_semi")))
    tgt = scratch.keep(as_graph(target))
    one = F.broadcast(fusable(o))
    single = src.join(one, "p", "left_semi").join(tgt.select("s", "p").distinct(), ["s", "p"], "left_anti")
    single = single.withColumn("_r", F.row_number().over(W.partitionBy("s", "p").orderBy("o", "k", "dt", "lang"))).where("_r = 1").drop("_r")
    many = src.join(one, "p", "left_anti").join(tgt.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")
    selected = single.unionByName(many)
    discarded = src.join(selected.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")
    return {"graph": as_graph(tgt.unionByName(selected)), "selected": selected, "discarded": discarded}


def first_value_fusion(source: DataFrame, target: DataFrame, o: Ontology, components: DataFrame, target_prefix: str, property_prefix: str) -> dict[str, DataFrame]:
    """Entities and predicates of the source made canonical by match clusters, then `select_first_value`; adds `same_as`."""
    first = lambda prefix: components.where(F.col("uri").startswith(prefix)).groupBy("cid").agg(F.min("uri").alias("dst"))
    entity = components.join(first(target_prefix), "cid").where("uri <> dst").select(F.col("uri").alias("src"), "dst")
    prop = components.join(first(property_prefix), "cid").where("uri <> dst").select(F.col("uri").alias("p"), F.col("dst").alias("_p"))
    src = substitute(source, entity).join(small(prop.groupBy("p").agg(F.min("_p").alias("_p"))), "p", "left")
    src = as_graph(src.withColumn("p", F.coalesce("_p", "p")).drop("_p"))
    out = select_first_value(src, target, o)
    used = source.select(F.col("s").alias("src")).distinct()
    out["same_as"] = entity.join(used, "src", "left_semi").select(F.col("dst").alias("s"), F.lit(SAME_AS).alias("p"), F.col("src").alias("o"), F.lit("iri").alias("k"))
    return out


def majority(values: DataFrame, key: list[str], value: str = "value", score: str = "score", seq: str = "seq") -> DataFrame:
    """Per key the most frequent value; ties to the higher mean score, then the one seen first."""
    g = values.groupBy(*key, value).agg(F.count("*").alias("votes"), F.avg(score).alias("mean"), F.min(seq).alias("first"))
    best = g.groupBy(*key).agg(F.max(F.struct("votes", "mean", (-F.col("first")).alias("neg"), F.col(value).alias("v"))).alias("b"))
    return best.select(*key, F.col("b.v").alias(value), F.col("b.votes").alias("votes"))


def preferred(values: DataFrame, key: list[str], source: str, prefer: str, value: str = "value", score: str = "score") -> DataFrame:
    """Per key the value of the preferred source, else the one with the highest score; ties to the smaller value."""
    w = W.partitionBy(*key).orderBy(F.desc(F.col(source) == prefer), F.desc_nulls_last(score), value)
    return values.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_matches(*docs: DataFrame) -> DataFrame:
    """Bag union of match tables; an id_type of `str` means relation."""
    out = docs[0]
    for d in docs[1:]:
        out = out.unionByName(d)
    return out.withColumn("id_type", F.when(F.col("id_type") == "str", "relation").otherwise(F.col("id_type")))


def filter_matches(matches: DataFrame, threshold: float = 0.5, id_type: str | None = None) -> DataFrame:
    """Matches above the threshold without inverse relations (ids ending in '-'), suffixes of table columns removed."""
    strip = lambda c: F.regexp_replace(c, r"_(uri|literal)$", "")
    m = matches.where((F.col("score") > threshold) & ~F.col("id_1").endswith("-") & ~F.col("id_2").endswith("-"))
    m = m.where(F.col("id_type") == id_type) if id_type else m
    return m.withColumn("id_1", strip("id_1")).withColumn("id_2", strip("id_2"))


def wide_table(t: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per subject; per predicate and object kind the sorted values joined by '; '. `columns` (as `<name>_<literal|uri>`) saves the pass that finds them."""
    name = F.concat(F.regexp_extract("p", r"([^#/]*)$", 1), F.when(is_iri(), "_uri").otherwise("_literal"))
    cells = t.select("s", name.alias("c"), "o").groupBy("s", "c").agg(F.array_join(F.sort_array(F.collect_set("o")), "; ").alias("v"))
    g = cells.groupBy("s")
    return (g.pivot("c", columns) if columns else g.pivot("c")).agg(F.first("v"))


def wide_by_type(t: DataFrame, cls: str) -> DataFrame:
    return wide_table(t.join(t.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct(), "s", "left_semi"))


def ontology_of(o: Ontology) -> DataFrame:
    """Ontology frames back as triples."""
    c = o.classes.select(F.col("uri").alias("s"), F.explode(F.concat(F.array(F.struct(F.lit(TYPE).alias("p"), F.lit(OWL + "Class").alias("o"))), F.transform("disjoint", lambda d: F.struct(F.lit(OWL + "disjointWith").alias("p"), d.alias("o"))))).alias("x")).select("s", "x.p", "x.o", F.lit("iri").alias("k"))
    return as_graph(c)
