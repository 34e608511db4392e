"""Metrics against a reference: source coverage and precision, triple alignment, entity alignment, match and link evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..model import TYPE, TripleFrame, is_iri
from ..session import Scratch
from . import similarity as S


def prf(tp, fp, fn) -> list:
    p, r = T.ratio(tp, tp + fp), T.ratio(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(T.f1(tp, fp, fn), 6).alias("f1")]


def confusion(found: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two row sets by one full outer join."""
    both = found.select(*on).distinct().withColumn("a", F.lit(1)).join(expected.select(*on).distinct().withColumn("b", F.lit(1)), on, "full")
    n = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    return n.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def binary_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    p, a = F.col(predicted).cast("boolean"), F.col(actual).cast("boolean")
    n = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    acc = T.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return n.select("tp", "fp", "fn", "tn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), F.round(acc, 6).alias("accuracy"))


def source_coverage(t: DataFrame, verified: DataFrame) -> DataFrame:
    """Expected entities (uri, label) that the graph has by uri or by label: two semi joins instead of an OR join."""
    by_uri = verified.join(t.select(F.col("s").alias("uri")).distinct(), "uri", "left_semi")
    labels = TripleFrame(t).labels().select("label").distinct()
    by_label = verified.join(labels, "label", "left_semi")
    hit = by_uri.select("uri").union(by_label.select("uri")).distinct().agg(F.count("*").alias("overlap"))
    n = verified.agg(F.count_distinct("uri").alias("expected"))
    return hit.crossJoin(n).withColumn("coverage", F.round(F.least(T.ratio(F.col("overlap"), F.col("expected")), F.lit(1.0)), 6))


def source_coverage_soft(t: DataFrame, verified: DataFrame, threshold: float = 0.95, embedder=S.hashed_ngrams) -> DataFrame:
    """The same with labels compared by cosine (inclusive threshold)."""
    hit = S.best_texts(verified.select("label"), TripleFrame(t).labels().select("label"), threshold, True, embedder).withColumnRenamed("text", "want")
    n = verified.select("label").distinct().agg(F.count("*").alias("expected"))
    return hit.agg(F.count_distinct("want").alias("overlap")).crossJoin(n).withColumn("coverage", F.round(F.least(T.ratio(F.col("overlap"), F.col("expected")), F.lit(1.0)), 6))


def source_precision(found: DataFrame, verified: DataFrame) -> DataFrame:
    """found (pos, label) against verified (uri, label): the first label for a reference counts, later ones are duplicates."""
    ref = verified.groupBy("label").agg(F.min("uri").alias("ref"))
    hit = found.join(ref, "label").withColumn("r", F.row_number().over(W.partitionBy("ref").orderBy("pos")))
    n = hit.agg(F.count("*").alias("found"), F.count_if(F.col("r") > 1).alias("duplicates"))
    return n.withColumn("precision", F.round(T.ratio(F.col("found") - F.col("duplicates"), F.col("found")), 6))


def typed_coverage(t: DataFrame, expected: DataFrame) -> DataFrame:
    """(label, type) pairs of the graph against expected pairs."""
    return confusion(TripleFrame(t).label_type().select("label", "type"), expected, ["label", "type"])


def triple_alignment(t: DataFrame, ref: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Strict: terms compared as text, the seed's triples taken out of both sides."""
    a, b = TripleFrame(t), TripleFrame(ref)
    if seed is not None:
        a, b = a.subtract(TripleFrame(seed)), b.subtract(TripleFrame(seed))
    return confusion(a.triples, b.triples, ["s", "p", "o"])


def entity_mapping(t: DataFrame, ref: DataFrame, threshold: float = 0.95, embedder=S.hashed_ngrams) -> DataFrame:
    """(src, dst): entities of the graph and the reference entity with the nearest label above the threshold."""
    scratch = Scratch(t.sparkSession, "mapping")
    la, lb = (scratch.keep(TripleFrame(x).first_label()) for x in (t, ref))  # each graph is read once for its labels
    hit = S.best_texts(la.select("label"), lb.select("label"), threshold, False, embedder)
    dst = lb.groupBy("label").agg(F.min("s").alias("dst"))
    to = hit.join(dst.select(F.col("label").alias("ref_text"), "dst"), "ref_text").select(F.col("text").alias("label"), "dst")
    return scratch.keep(la.join(to, "label").select(F.col("s").alias("src"), "dst"))


def triple_alignment_soft(t: DataFrame, ref: DataFrame, seed: DataFrame | None = None, threshold: float = 0.95, embedder=S.hashed_ngrams) -> DataFrame:
    """Strict alignment after entities are replaced by the reference entity with the nearest label.

    Both sides are grouped by their terms at once, so that repeated rows on either side, also those of `t` and `ref`, count once.
    """
    from .fusion import replaced_terms

    a, b = TripleFrame(replaced_terms(t, entity_mapping(t, ref, threshold, embedder))), TripleFrame(ref.select("s", "p", "o"))
    if seed is not None:
        a, b = a.subtract(TripleFrame(seed)), b.subtract(TripleFrame(seed))
    rows = a.triples.withColumn("side", F.lit(1)).unionByName(b.triples.withColumn("side", F.lit(2)))
    # Spread before they are grouped: rows that hardly repeat fill the tables of a partial count and are sorted for nothing.
    sides = rows.repartition("s", "p", "o").groupBy("s", "p", "o").agg(F.bit_or("side").alias("side"))
    null = F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull()
    both = (F.col("side") == 3) & ~null
    n = sides.agg(F.count_if(both).alias("tp"), F.count_if((F.col("side") != 2) & ~both).alias("fp"), F.count_if((F.col("side") != 1) & ~both).alias("fn"))
    return n.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def triple_alignment_values(t: DataFrame, ref: DataFrame, threshold: float = 0.95, exclude_type: bool = False, embedder=S.hashed_ngrams) -> DataFrame:
    """Entities by label, IRI objects by their label, values by cosine per (s, p); fn: reference triples of unseen (s, p)."""
    from .fusion import substitute

    a = substitute(t, entity_mapping(t, ref, threshold, embedder))

    def lexical(x: DataFrame) -> DataFrame:
        lab = TripleFrame(x).first_label().select(F.col("s").alias("o"), F.col("label").alias("ol"))
        x = x.where(F.col("p") != TYPE) if exclude_type else x
        iri = x.where(is_iri()).select("s", "p", "o").join(lab, "o", "left").select("s", "p", F.coalesce("ol", "o").alias("o"))
        return iri.unionByName(x.where(~F.coalesce(is_iri(), F.lit(False))).select("s", "p", "o"))

    # Values in plain text: equal ones have cosine 1, so that only values without an equal one are embedded, pair by pair.
    flag = lambda x, left: lexical(x).select("s", "p", "o", F.lit(left).alias("a"), F.lit(not left).alias("b"))
    both = flag(a, True).unionByName(flag(ref, False)).repartition("s", "p").groupBy("s", "p", "o").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    group = W.partitionBy("s", "p")
    both = both.withColumn("seen", F.max("a").over(group)).withColumn("open", F.max(F.expr("a AND NOT b")).over(group))
    # What is settled is kept as flags only, in one pass.
    needed = F.expr("open")
    both = Scratch(t.sparkSession, "values").keep(both.select(*[F.when(needed, F.col(c)).alias(c) for c in ("s", "p", "o")], "a", "b", "seen", "open"))
    n = both.agg(F.count_if("a").alias("n"), F.count_if(F.expr("a AND b")).alias("same"), F.count_if(F.expr("b AND NOT seen")).alias("fn"))
    pairs = both.where("open AND a AND NOT b").select("s", "p", "o").join(both.where("open AND b").select("s", "p", F.col("o").alias("o2")), ["s", "p"])
    near = S.value_scores(pairs, embedder).where(F.col("score") > threshold)
    hit = pairs.join(near, ["o", "o2"]).select("s", "p", "o").distinct().agg(F.count("*").alias("near"))
    out = n.crossJoin(hit).withColumn("tp", F.col("same") + F.col("near")).withColumn("fp", F.col("n") - F.col("tp"))
    return out.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def entity_alignment(gen: DataFrame, ref: DataFrame, mode: str = "label", threshold: float = 0.95, ignored: DataFrame | None = None, embedder=S.hashed_ngrams) -> DataFrame:
    """tp, fp, fn of entities aligned by nearest label (inclusive threshold); mode label, type or intersecting_type.

    `ignored` (s) is left out on both sides. With a type mode the aligned entities must have the same least type, or at
    least one type in common.
    """
    drop = lambda d: d.join(ignored.select("s"), "s", "left_anti") if ignored is not None else d
    a, b = drop(TripleFrame(gen).label_types()), drop(TripleFrame(ref).label_types())
    hit = S.best_texts(a.select("label"), b.select("label"), threshold, True, embedder)
    # Entities with the same label and types have the same fate: they are counted, never paired with one another.
    scratch = Scratch(gen.sparkSession, "entities")
    ga = scratch.keep(a.groupBy(F.col("label").alias("text"), F.col("types").alias("ta")).agg(F.count("*").alias("na")))
    gb = scratch.keep(b.groupBy(F.col("label").alias("ref_text"), F.col("types").alias("tb")).agg(F.count("*").alias("nb")))
    pairs = ga.join(hit, "text").join(gb, "ref_text")
    if mode == "type":
        pairs = pairs.where(F.get("ta", F.lit(0)).eqNullSafe(F.get("tb", F.lit(0))))
    elif mode == "intersecting_type":
        pairs = pairs.where(F.arrays_overlap("ta", "tb"))
    pairs = scratch.keep(pairs.select("text", "ta", "na", "ref_text", "tb", "nb"))
    total = lambda df, n, name: df.agg(F.coalesce(F.sum(n), F.lit(0)).alias(name))
    tp = total(pairs.select("ref_text", "tb", "nb").distinct(), "nb", "tp")
    met = total(pairs.select("text", "ta", "na").distinct(), "na", "met")
    out = tp.crossJoin(met).crossJoin(total(ga, "na", "gen")).crossJoin(total(gb, "nb", "ref"))
    out = out.select("tp", (F.col("gen") - F.col("met")).alias("fp"), (F.col("ref") - F.col("tp")).alias("fn"))
    return out.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def duplicates(alignment: DataFrame, entities: DataFrame) -> DataFrame:
    """Targets with two or more aligned sources, and their share of all entities; alignment (src, dst)."""
    d = alignment.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicates"))
    return d.crossJoin(entities.agg(F.count("*").alias("entities"))).withColumn("ratio", F.round(T.ratio(F.col("duplicates"), F.col("entities")), 6))


def match_evaluation(components: DataFrame, truth: DataFrame, seed_prefix: str) -> DataFrame:
    """Clusters against true pairs (left_id, right_id): every (source, seed) pair of a cluster counts; fn: true seeds not seen."""
    seed = components.where(F.col("uri").startswith(seed_prefix)).select("cid", F.col("uri").alias("right_id"))
    other = components.where(~F.col("uri").startswith(seed_prefix)).select("cid", F.col("uri").alias("left_id"))
    found = other.join(seed, "cid").select("left_id", "right_id").distinct()
    ok = found.join(truth.select("left_id", "right_id").distinct(), ["left_id", "right_id"], "left_semi").agg(F.count("*").alias("tp"))
    n = found.agg(F.count("*").alias("n"))
    fn = truth.select("right_id").distinct().join(found.select("right_id"), "right_id", "left_anti").agg(F.count("*").alias("fn"))
    return ok.crossJoin(n).crossJoin(fn).withColumn("fp", F.col("n") - F.col("tp")).select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def relation_match_evaluation(matches: DataFrame, expected_relations: int) -> DataFrame:
    """Relation matches in order (seq, id_1, id_2): right if the last path parts agree; a match whose ids were both seen is skipped."""
    m = matches.where("id_type = 'relation' AND id_1 IS NOT NULL AND id_2 IS NOT NULL")
    ends = m.select("seq", F.explode(F.array("id_1", "id_2")).alias("id")).groupBy("id").agg(F.min("seq").alias("first"))
    x = m.join(ends.select(F.col("id").alias("id_1"), F.col("first").alias("f1")), "id_1").join(ends.select(F.col("id").alias("id_2"), F.col("first").alias("f2")), "id_2")
    x = x.where("f1 = seq OR f2 = seq").withColumn("ok", T.local_name(F.col("id_1")) == T.local_name(F.col("id_2")))
    n = x.agg(F.count_if("ok").alias("tp"), F.count_if(~F.col("ok")).alias("fp")).withColumn("fn", F.greatest(F.lit(0), F.lit(expected_relations) - F.col("tp") - F.col("fp")))
    return n.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_counts(matches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Matches per id_type above the threshold and not above it."""
    return matches.groupBy("id_type").agg(F.count_if(F.col("score") > threshold).alias("above"), F.count_if(~(F.col("score") > threshold)).alias("below"))


def threshold_sweep(matches: DataFrame, steps: int = 16) -> DataFrame:
    """Matches kept at thresholds 0, 1/steps, ... 1 in one pass over a histogram."""
    bucket = matches.where("score IS NOT NULL AND NOT isnan(score)").select(F.least(F.lit(steps), F.greatest(F.lit(0), F.ceil(F.col("score") * steps))).cast("int").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    ts = matches.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    # score > i/steps exactly if its bucket ceil(score*steps) > i
    return ts.join(F.broadcast(bucket), F.col("b") > F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept")).select((F.col("i") / steps).alias("threshold"), "kept")


def link_evaluation(links: DataFrame, expected: DataFrame, seed_namespace: str | None = None, link_type: str = "entity") -> DataFrame:
    """Links (doc_id, mapping) against expected (doc_id, entity_id): hits by the entity or its seed uri, false, missing, score."""
    doc = lambda c: F.substring_index(F.col(c).cast("string"), ".", 1)
    want = expected.select(doc("doc_id").alias("doc"), "entity_id").distinct()
    alt = want.select("doc", "entity_id", F.explode(F.array("entity_id", T.seed_uri(seed_namespace, F.col("entity_id"))) if seed_namespace else F.array("entity_id")).alias("mapping"))
    got = links.where(F.col("link_type") == link_type).select(doc("doc_id").alias("doc"), "mapping").where("mapping IS NOT NULL").distinct()
    hit = got.join(alt, ["doc", "mapping"], "left")
    n = hit.agg(F.count_if(F.col("entity_id").isNull()).alias("false"), F.count_distinct(F.when(F.col("entity_id").isNotNull(), F.struct("doc", "entity_id"))).alias("hits"))
    m = want.agg(F.count("*").alias("expected"))
    out = n.crossJoin(m).withColumn("missing", F.col("expected") - F.col("hits"))
    denominator = F.col("hits") + (F.col("missing") if link_type == "entity" else F.col("false"))
    return out.withColumn("score", F.round(T.ratio(F.col("hits"), denominator), 6)).drop("expected")


def json_linking_evaluation(actual: DataFrame, expected: DataFrame, local_prefix: str, on: list[str]) -> DataFrame:
    """Actual against expected iri per key: equal tp; different but still local fn; different fp; unexpected and not local fp."""
    x = actual.select(*on, F.col("iri").alias("got")).join(expected.select(*on, F.col("iri").alias("want")), on, "full")
    local = F.col("got").startswith(local_prefix)
    kind = F.when(F.col("want").isNull(), F.when(~local, "fp")).when(F.col("got").isNull(), "fn").when(F.col("got") == F.col("want"), "tp").when(local, "fn").otherwise("fp")
    n = x.withColumn("c", kind).agg(*[F.count_if(F.col("c") == k).alias(k) for k in ("tp", "fp", "fn")])
    return n.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def pair_evaluation(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) of two tables compared as sets."""
    norm = lambda d: d.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return confusion(norm(actual), norm(expected), ["a", "b"])


def proxy_quality(t: DataFrame, allowed: DataFrame, union: DataFrame) -> DataFrame:
    """Share of triples with an allowed predicate, and the graph's size against the union's."""
    n = t.join(F.broadcast(allowed.select("p", F.lit(1).alias("ok")).distinct()), "p", "left").agg(F.count("*").alias("n"), F.count("ok").alias("allowed"))
    return n.crossJoin(union.agg(F.count("*").alias("u"))).select(F.round(T.ratio(F.col("allowed"), F.col("n")), 6).alias("allowed_share"), F.round(F.least(F.lit(1.0), T.ratio(F.col("n"), F.col("u"))), 6).alias("size_share"))


def extraction_quality(triples: DataFrame, links: DataFrame) -> DataFrame:
    """Share of extracted triples with all three parts, and the mean link score."""
    full = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull()
    a = triples.agg(F.count("*").alias("n"), F.count_if(full).alias("c")).select(F.round(T.ratio(F.col("c"), F.col("n")), 6).alias("complete"))
    return a.crossJoin(links.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean_score")))


def split_overlap(index: DataFrame, split: str, entity: str) -> DataFrame:
    """Common entities of each pair of splits with their share of both sides."""
    d = index.select(F.col(split).alias("sp"), F.col(entity).alias("e")).distinct()
    size = d.groupBy("sp").agg(F.count("*").alias("n"))
    both = d.groupBy("e").agg(F.sort_array(F.collect_set("sp")).alias("sps")).where("size(sps) > 1")
    pair = both.select(F.explode(F.expr("flatten(transform(sequence(0, size(sps) - 2), i -> transform(sequence(i + 1, size(sps) - 1), j -> struct(sps[i] AS a, sps[j] AS b))))")).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("common"))
    na, nb = size.select(F.col("sp").alias("a"), F.col("n").alias("na")), size.select(F.col("sp").alias("b"), F.col("n").alias("nb"))
    return pair.join(na, "a").join(nb, "b").select("a", "b", "common", F.round(F.col("common") / F.col("na"), 6).alias("share_a"), F.round(F.col("common") / F.col("nb"), 6).alias("share_b"))


