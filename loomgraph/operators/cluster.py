"""Match graphs: connected components, cluster lookups, greedy one-to-one matching, set cover, agglomerative grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch


def closure(edges: DataFrame, a: str = "a", b: str = "b", max_depth: int | None = None) -> DataFrame:
    """(a, b, depth): b is reached from a by one or more edges, depth being the least number of them.

    Rounds over written tables: what the last round reached is joined with the edges, and what was known before is taken
    out, until nothing is new; so cycles end and no path is walked twice. Without `max_depth` there is no limit.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    step = scratch.keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    known = new = scratch.keep(step.withColumn("depth", F.lit(1)))
    depth = 1
    while (max_depth is None or depth < max_depth) and new.take(1):
        depth += 1
        further = new.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        new = scratch.keep(further.join(known, ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(new)
    return known


def match_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(uri, cid): components by alternating star contractions; cid is the least uri of the component.

    Every round links each node's larger neighbours, then its smaller ones, to the least node it knows. That halves long
    chains, so the number of rounds is logarithmic; each round is two aggregates and a checkpointed table.
    """
    scratch = Scratch(pairs.sparkSession, "stars")
    edges = pairs.where(f"length({a}) > 0 AND length({b}) > 0").select(F.col(a).alias("x"), F.col(b).alias("y"))
    nodes = scratch.keep(edges.select(F.explode(F.array("x", "y")).alias("uri")).distinct())
    edges = scratch.keep(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least2 = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(least2, "x")
        small = joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least2.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        nxt = scratch.keep(small)
        state = nxt.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        scratch.drop(edges)
        edges = nxt
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components are not done after {max_rounds} rounds")
    return nodes.join(edges.select(F.col("x").alias("uri"), F.col("y").alias("cid")), "uri", "left").select("uri", F.coalesce("cid", "uri").alias("cid"))


def clusters_with(components: DataFrame, seeds: DataFrame, seed_col: str = "uri") -> DataFrame:
    """Members of the clusters that hold at least one seed."""
    hit = components.join(seeds.select(F.col(seed_col).alias("uri")).distinct(), "uri", "left_semi").select("cid").distinct()
    return components.join(hit, "cid", "left_semi")


def match_in_namespace(components: DataFrame, prefix: str) -> DataFrame:
    """(uri, match): for every member the least member of its cluster with the given prefix, if there is one."""
    first = components.where(F.col("uri").startswith(prefix)).groupBy("cid").agg(F.min("uri").alias("match"))
    return components.join(first, "cid").select("uri", "match")


def is_match(pairs: DataFrame, components: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds `matched`: same last path segment, or same cluster; two unknown uris do not match."""
    c = components
    out = pairs.join(c.select(F.col("uri").alias(a), F.col("cid").alias("_ca")), a, "left").join(c.select(F.col("uri").alias(b), F.col("cid").alias("_cb")), b, "left")
    same = F.substring_index(F.col(a), "/", -1) == F.substring_index(F.col(b), "/", -1)
    return out.withColumn("matched", same | F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).drop("_ca", "_cb")


def greedy_matching(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """One-to-one subset of (id_1, id_2, score): what taking pairs by descending score would choose.

    Ties go to the smaller ids. A pair that ranks first for both of its ends is in the result whatever else there is; its
    ends are removed and the rest is ranked again, until nothing is left. The best pair of all is taken in every round, so
    that ends; with `max_rounds`, pairs left after so many rounds are an error.
    """
    scratch = Scratch(pairs.sparkSession, "greedy")
    left = scratch.keep(pairs.where("id_1 IS NOT NULL AND id_2 IS NOT NULL AND score IS NOT NULL").groupBy("id_1", "id_2").agg(F.max("score").alias("score")))
    chosen = None
    order = [F.desc("score"), F.asc("id_1"), F.asc("id_2")]
    rounds = 0
    while True:
        ranked = left.withColumn("r1", F.row_number().over(W.partitionBy("id_1").orderBy(*order))).withColumn("r2", F.row_number().over(W.partitionBy("id_2").orderBy(*order)))
        take = scratch.keep(ranked.where("r1 = 1 AND r2 = 1").select("id_1", "id_2", "score"))
        if not take.take(1):
            break
        if rounds == max_rounds:
            raise RuntimeError(f"greedy matching has pairs left after {max_rounds} rounds")
        rounds += 1
        chosen = take if chosen is None else chosen.unionByName(take)
        nxt = scratch.keep(left.join(take.select("id_1"), "id_1", "left_anti").join(take.select("id_2"), "id_2", "left_anti"))
        scratch.drop(left)
        left = nxt
    return chosen if chosen is not None else left


def set_cover(doc_paths: DataFrame, doc: str = "doc", path: str = "path", max_docs: int | None = None) -> DataFrame:
    """Greedy cover of all paths by documents: the document with the most uncovered paths first, ties to the smaller id.

    Goes on until every path is covered; with `max_docs`, paths left after so many documents are an error.
    Documents are reduced to their distinct path sets first; per step one aggregate over what is uncovered.
    """
    scratch = Scratch(doc_paths.sparkSession, "cover")
    left = doc_paths.select(F.col(doc).alias("doc"), F.col(path).alias("path")).distinct()
    sets = left.groupBy("doc").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("path")), "\x1f"), 256).alias("h"))
    keep = sets.groupBy("h").agg(F.min("doc").alias("doc")).select("doc")
    left = scratch.keep(left.join(keep, "doc", "left_semi"))
    rows: list[tuple] = []
    step = 0
    while True:
        top = left.groupBy("doc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc").first()
        if top is None:
            break
        if step == max_docs:
            raise RuntimeError(f"paths are left after {max_docs} documents")
        rows.append((step + 1, top["doc"], top["n"]))
        covered = left.where(F.col("doc") == F.lit(top["doc"])).select("path")
        nxt = scratch.keep(left.join(covered, "path", "left_anti"))
        scratch.drop(left)
        left = nxt
        step += 1
    kind = doc_paths.schema[doc].dataType.simpleString()
    return doc_paths.sparkSession.createDataFrame(rows, f"step int, doc {kind}, new_paths long")


def agglomerate(vectors: np.ndarray, threshold: float = 0.55) -> list[int]:
    """Average-linkage clustering by cosine distance; numbers of the clusters in order of first member."""
    n = len(vectors)
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - x @ x.T
    size = np.ones(n)
    group = list(range(n))
    live = list(range(n))
    np.fill_diagonal(d, np.inf)
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        if sub[i, j] > threshold:
            break
        a, b = sorted((live[i], live[j]))
        d[a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        size[a] += size[b]
        live.remove(b)
        group = [a if g == b else g for g in group]
    names: dict[int, int] = {}
    return [names.setdefault(g, len(names)) for g in group]


def agglomerate_groups(df: DataFrame, group: str, key: str, vector: str, threshold: float = 0.55) -> DataFrame:
    """(group, key, cluster) by average linkage inside each group; groups are meant to be small (names of parameters)."""
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": agglomerate(np.stack(pdf[vector].to_list()), threshold)})

    return df.select(group, key, vector).groupBy(group).applyInPandas(run, schema)
