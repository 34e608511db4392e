"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every node draws an exponential shift; the node with the larger shift starts its cluster earlier, and clusters grow one
hop per unit of time, so a node belongs to the cluster that reaches it first. Growth is a min-plus fixpoint: the arrival
of a node is the least of its own start and of one more than the arrivals of its neighbours. With shifts cut at
`max_shift` no arrival changes after `max_shift` hops, so a level is a fixed number of joins with a partial (map-side)
minimum. Clusters then become super-nodes, and the edges between different clusters form the next, smaller level; once
at most TAIL of them are left, one task goes on with the same levels in memory. The assignments of all levels are
composed at the end.

Scale: one level shuffles the edges once and a combined minimum per hop; levels shrink geometrically. A hub's messages
are combined before the shuffle; its edges are one hot key of a sort-merge join, which adaptive execution splits. No
node, edge or label reaches the driver, only the count of edges that are left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

BETA = 0.35
MAX_SHIFT = 6
MAX_LEVELS = 60
TAIL = 10_000  # edges between super-nodes from which down one task does the remaining levels


def plain_iri(c: Column) -> Column:
    """An IRI without blanks, quotes or angle brackets around it, scheme and host in lower case; null if nothing is left."""
    inner = F.regexp_replace(c, r"^[\s\p{Cf}<\"']+|[\s\p{Cf}>\"']+$", "")
    head = F.regexp_extract(inner, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    out = F.concat(F.lower(head), F.substring(inner, F.length(head) + 1, F.length(inner)))
    return F.when(F.length(out) > 0, out)


def _shifts(v: np.ndarray, beta: float, max_shift: int, seed: int) -> np.ndarray:
    """Exponential shifts of nodes, cut at `max_shift`, from a hash of node and level."""
    h = v.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for k in (30, 27):
        h = (h ^ (h >> np.uint64(k))) * np.uint64(0xBF58476D1CE4E5B9)
    unit = ((h >> np.uint64(12)).astype(np.float64) + 1.0) / float(1 << 52)
    return np.minimum(-np.log(np.minimum(unit, 1.0)) / beta, float(max_shift))


def tail(batches: Iterable[pd.DataFrame], beta: float = BETA, max_shift: int = MAX_SHIFT, seed: int = 0) -> Iterator[pd.DataFrame]:
    """(v, c) of all levels of the decomposition of edges (a, b) that fit into memory."""
    pdf = pd.concat(list(batches))
    node, place = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    place = place.reshape(-1, 2)
    group = np.arange(len(node))  # node -> its super-node
    edges = place
    for _ in range(1000):
        if not len(edges):
            break
        seed += 1
        live = np.unique(edges)
        arrive = np.full(len(node), np.inf)
        arrive[live] = max_shift - _shifts(live, beta, max_shift, seed)
        centre = np.arange(len(node))
        both = np.concatenate([edges, edges[:, ::-1]])
        for _ in range(max_shift):
            order = np.lexsort((centre[both[:, 0]], arrive[both[:, 0]], both[:, 1]))
            first = order[np.concatenate([[True], np.diff(both[order, 1]) != 0])]
            to, t, c = both[first, 1], arrive[both[first, 0]] + 1.0, centre[both[first, 0]]
            better = (t < arrive[to]) | ((t == arrive[to]) & (c < centre[to]))
            if not better.any():
                break
            arrive[to[better]], centre[to[better]] = t[better], c[better]
        group = centre[group]
        edges = np.sort(centre[edges], axis=1)
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
    else:
        raise RuntimeError("edges are left after 1000 levels")
    yield pd.DataFrame({"v": node, "c": node[group]})


def components(links: DataFrame, left: str, right: str, beta: float = BETA, max_shift: int = MAX_SHIFT, seed: int = 17) -> DataFrame:
    """(record_id, group_id) for every record that is linked to another one; group_id is the least record_id of the group.

    Nulls and blanks on either side, self links, repeated and turned pairs have no effect; an empty input gives an empty
    result; other columns of `links` are ignored, whatever their names.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = (
        links.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b"))
        .where("length(trim(a)) > 0 AND length(trim(b)) > 0 AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    pairs = scratch.keep(pairs)
    named = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("record")).distinct().withColumn("v", F.monotonically_increasing_id()))
    ids = lambda side: named.select(F.col("record").alias(side), F.col("v").alias(f"{side}v"))
    edges = scratch.keep(pairs.join(ids("a"), "a").join(ids("b"), "b").select(F.col("av").alias("a"), F.col("bv").alias("b")))
    scratch.drop(pairs)

    levels: list[DataFrame] = []
    for level in range(MAX_LEVELS):
        left_over = edges.count()
        if not left_over:
            break
        if level and left_over <= TAIL:
            # what is left fits one task, which goes through the remaining levels in memory
            levels.append(scratch.keep(edges.coalesce(1).mapInPandas(lambda batches, lv=level: tail(batches, beta, max_shift, seed + lv), "v long, c long")))
            break
        # Every node also sends to itself at no cost, so a hop is one join and one aggregate, and the plan grows by that.
        node = edges.select(F.explode(F.array("a", "b")).alias("a")).distinct()
        both = edges.select("a", "b", F.lit(1.0).alias("hop")).union(edges.select("b", "a", F.lit(1.0))).union(node.select("a", "a", F.lit(0.0)))
        both = scratch.keep(both)
        # the shift comes from a hash of node and level, so a task that runs again draws the same one
        unit = (F.pmod(F.xxhash64("v", F.lit(seed + level)), F.lit(1 << 40)) + F.lit(1.0)) / F.lit(float((1 << 40) + 1))
        shift = F.least(-F.log(unit) / F.lit(beta), F.lit(float(max_shift)))
        state = both.where("hop = 0").select(F.col("a").alias("v")).select("v", F.struct((F.lit(float(max_shift)) - shift).alias("t"), F.col("v").alias("c")).alias("best"))
        for _ in range(max_shift):
            sent = both.join(state, F.col("a") == F.col("v")).select(F.col("b").alias("v"), F.struct((F.col("best.t") + F.col("hop")).alias("t"), F.col("best.c").alias("c")).alias("best"))
            state = sent.groupBy("v").agg(F.min("best").alias("best"))
        own = scratch.keep(state.select("v", F.col("best.c").alias("c")))
        levels.append(own)
        side = lambda x: own.select(F.col("v").alias(x), F.col("c").alias(f"{x}c"))
        nxt = scratch.keep(
            edges.join(side("a"), "a")
            .join(side("b"), "b")
            .where("ac <> bc")
            .select(F.least("ac", "bc").alias("a"), F.greatest("ac", "bc").alias("b"))
            .distinct()
        )
        scratch.drop(edges)
        scratch.drop(both)
        edges = nxt
    else:
        raise RuntimeError(f"edges are left after {MAX_LEVELS} levels")

    # Each level is composed and written before the next one, so plans stay short and the driver's memory flat.
    root = None
    for own in reversed(levels):
        if root is None:
            root = own.select("v", F.col("c").alias("r"))
            continue
        up = root.select(F.col("v").alias("c"), F.col("r").alias("up"))
        composed = scratch.keep(own.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("r")))
        scratch.drop(root)
        root = composed
    if root is None:
        root = named.select("v", F.col("v").alias("r"))
    member = scratch.keep(root.join(named, "v").select("r", F.col("record").alias("record_id")))
    label = member.groupBy("r").agg(F.min("record_id").alias("group_id"))
    return member.join(label, "r").select("record_id", "group_id")
