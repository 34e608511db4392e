"""Most similar vectors for every vector: robust-pruned directed graphs over shards, searched with a beam.

1. Equal vectors are one point with its smallest ids, so a vector that a third of all rows share is indexed once.
2. Points are sharded by the nearest of S centroids (fitted on a bounded sample; every point is assigned). A shard that
   is too large is split by hash, and a query to it goes to all of its parts.
3. Per shard a directed graph is built in batches: a greedy beam search over the graph so far proposes neighbours, and
   relaxed pruning keeps a neighbour only if no kept one is closer to it by the factor `alpha`, so edges stay diverse.
   Reverse edges are added and pruned in the same way. Graphs are written as one row per shard.
4. Each point queries the graphs of its nearest shards by beam search; chunks of queries meet a copy of the graph, so no
   task holds more than a shard and a chunk.
5. Candidates are scored again in double precision from the stored components, rounded to nine decimals, and ranked.

Accuracy: `recall` compares with brute force for the points whose id is divisible by 20.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch, small

DIM = 64
K = 5
SHARD = 4000
PROBES = 4
DEGREE = 32
BEAM = 48
SEARCH_BEAM = 72
ALPHA = 1.1
EXPAND = 4
ENTRIES = 256
CHUNK = 8000
SAMPLE = 20_000  # points that the centroids are fitted on
MAX_SHARDS = 4096


def is_usable(v: Column, dim: int = DIM) -> Column:
    """A vector of `dim` finite components that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # vectors of tiny or huge components are scaled first, so that squares neither vanish nor overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Robust-pruned graph over unit vectors of one shard."""

    def __init__(self, x: np.ndarray, adj: np.ndarray | None = None, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x = np.ascontiguousarray(x, np.float32)
        self.n, self.degree, self.beam, self.alpha = len(x), degree, beam, alpha
        rng = np.random.default_rng(7)
        self.entries = rng.permutation(self.n)[: max(1, min(self.n, ENTRIES))]
        self.adj = np.full((self.n, degree), -1, np.int32) if adj is None else adj
        if adj is None:
            self._build(rng.permutation(self.n))

    def _build(self, order: np.ndarray) -> None:
        # entries are inserted first, so that every search can start
        order = np.concatenate([self.entries, order[~np.isin(order, self.entries)]])
        done, size = 0, max(1, len(self.entries))
        while done < self.n:
            batch = order[done : done + size]
            if done == 0:
                cand = np.broadcast_to(batch, (len(batch), len(batch))).copy()
            else:
                cand = self.search(self.x[batch], self.beam)[0]
            self._link(batch, cand)
            done += len(batch)
            size = min(512, done)

    def _prune(self, node: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """The kept neighbours of each node among its candidates (-1: none)."""
        own = self.x[node]
        cx = self.x[np.maximum(cand, 0)]
        d = 2.0 - 2.0 * np.einsum("bcd,bd->bc", cx, own)
        d[(cand < 0) | (cand == node[:, None])] = np.inf
        order = np.argsort(d, axis=1)
        d = np.take_along_axis(d, order, 1)
        cand = np.take_along_axis(cand, order, 1)
        cx = np.take_along_axis(cx, order[:, :, None], 1)
        # the same candidate twice counts once
        by = np.argsort(cand, axis=1, kind="stable")
        again = np.zeros(cand.shape, bool)
        sorted_c = np.take_along_axis(cand, by, 1)
        dup = np.zeros(cand.shape, bool)
        dup[:, 1:] = sorted_c[:, 1:] == sorted_c[:, :-1]
        np.put_along_axis(again, by, dup, 1)
        alive = np.isfinite(d) & ~again
        out = np.full((len(node), self.degree), -1, np.int32)
        rows = np.arange(len(node))
        for r in range(self.degree):
            any_left = alive.any(axis=1)
            if not any_left.any():
                break
            pick = alive.argmax(axis=1)
            out[any_left, r] = cand[rows, pick][any_left]
            near = 2.0 - 2.0 * np.einsum("bcd,bd->bc", cx, cx[rows, pick])
            alive &= ~(self.alpha * self.alpha * near <= d)
            alive[rows, pick] = False
        return out

    def _link(self, batch: np.ndarray, cand: np.ndarray) -> None:
        self.adj[batch] = self._prune(batch, cand)
        src = np.repeat(batch, self.degree)
        dst = self.adj[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        have = (self.adj[nodes] >= 0).sum(axis=1)
        fits = have + count <= self.degree
        for v, f, c, h in zip(nodes[fits], first[fits], count[fits], have[fits]):
            self.adj[v, h : h + c] = src[f : f + c]
        over = np.flatnonzero(~fits)
        if len(over):
            most = int(count[over].max())
            rows = np.full((len(over), self.degree + most), -1, np.int64)
            rows[:, : self.degree] = self.adj[nodes[over]]
            for j, o in enumerate(over):
                rows[j, self.degree : self.degree + count[o]] = src[first[o] : first[o] + count[o]]
            for a in range(0, len(over), 256):
                part = over[a : a + 256]
                self.adj[nodes[part]] = self._prune(nodes[part], rows[a : a + 256])

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: (ids, similarities), best first; -1 where there are fewer points."""
        b, rows = len(q), np.arange(len(q))[:, None]
        q = np.ascontiguousarray(q, np.float32)
        start = q @ self.x[self.entries].T
        width = min(beam, start.shape[1])
        top = np.argpartition(-start, width - 1, axis=1)[:, :width]
        ids = np.full((b, beam), -1, np.int64)
        sim = np.full((b, beam), -np.inf, np.float32)
        ids[:, :width] = self.entries[top]
        sim[:, :width] = np.take_along_axis(start, top, 1)
        opened = np.zeros((b, beam), bool)
        seen = np.zeros((b, self.n + 1), bool)  # the last column stands for "no point"
        seen[:, self.n] = True
        seen[rows, ids] = True
        live = np.arange(b)
        while len(live):
            r = np.arange(len(live))[:, None]
            score = np.where(opened[live] | (ids[live] < 0), -np.inf, sim[live])
            pick = np.argpartition(-score, EXPAND - 1, axis=1)[:, :EXPAND] if beam > EXPAND else np.argsort(-score, axis=1)
            real = np.isfinite(np.take_along_axis(score, pick, 1))
            alive = real.any(axis=1)
            if not alive.all():
                live, pick, real, r = live[alive], pick[alive], real[alive], np.arange(int(alive.sum()))[:, None]
                if not len(live):
                    break
            opened[live[:, None], pick] = True
            nodes = np.where(real, ids[live[:, None], pick], self.n)
            nxt = np.where(nodes[:, :, None] < self.n, self.adj[np.minimum(nodes, self.n - 1)], -1).reshape(len(live), -1).astype(np.int64)
            nxt[nxt < 0] = self.n
            new = ~seen[live[:, None], nxt]
            seen[live[:, None], nxt] = True
            flat = np.flatnonzero(new.ravel())
            s = np.full(nxt.size, -np.inf, np.float32)
            who = flat // nxt.shape[1]
            s[flat] = np.einsum("ij,ij->i", self.x[nxt.ravel()[flat]], q[live[who]])
            s = s.reshape(nxt.shape)
            # a point that two opened nodes share in one step was new to both: keep it once
            o = np.argsort(nxt, axis=1, kind="stable")
            so = np.take_along_axis(nxt, o, 1)
            twice = np.zeros(nxt.shape, bool)
            twice[:, 1:] = so[:, 1:] == so[:, :-1]
            drop = np.zeros(nxt.shape, bool)
            np.put_along_axis(drop, o, twice, 1)
            s[drop] = -np.inf
            all_s = np.concatenate([sim[live], s], 1)
            all_i = np.concatenate([ids[live], np.where(np.isfinite(s), nxt, -1)], 1)
            all_o = np.concatenate([opened[live], np.zeros(s.shape, bool)], 1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sim[live] = np.take_along_axis(all_s, keep, 1)
            ids[live] = np.take_along_axis(all_i, keep, 1)
            opened[live] = np.take_along_axis(all_o, keep, 1)
        order = np.argsort(-sim, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def fit_centroids(x: np.ndarray, s: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a sample."""
    rng = np.random.default_rng(11)
    c = x[rng.permutation(len(x))[:s]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        for j in range(len(c)):
            m = x[near == j]
            if len(m):
                v = m.sum(axis=0)
                c[j] = v / max(float(np.linalg.norm(v)), 1e-12)
    return c


def nearest(vectors: DataFrame, key: str = "vec_id", value: str = "value", k: int = K, shard: int = SHARD, probes: int = PROBES, dim: int = DIM) -> DataFrame:
    """(key, neighbour, similarity, rank): for every usable vector the `k` most similar other ones, nearly always.

    Null, empty, short, long, zero and non-finite vectors have no row and are nobody's neighbour. Equal vectors under
    several keys are neighbours of each other with similarity 1. Ties in the similarity, rounded to nine decimals, go to
    the smaller key. `key` must be unique; other columns are ignored; fewer than two usable vectors give an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    v = F.transform(F.col(value), lambda x: x.cast("float"))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(is_usable(F.col("v"), dim))
    rows = scratch.keep(rows.select("id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")))
    # The k + 1 smallest ids of each point, first within salted parts, so that a hot value is not sorted in one task.
    part = rows.select("id", "h1", "h2", F.pmod("id", F.lit(16)).alias("part"))
    some = part.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2", "part").orderBy("id"))).where(f"r <= {k + 1}")
    ids = some.withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(f"r <= {k + 1}")
    groups = ids.groupBy("h1", "h2").agg(F.min("id").alias("u"), F.sort_array(F.collect_list("id")).alias("ids"))
    groups = scratch.keep(groups)
    points = rows.join(groups.select(F.col("u").alias("id"), "u"), "id").select("u", "v")
    points = scratch.keep(points)
    n = points.count()

    sample = points.orderBy(F.xxhash64("u")).limit(SAMPLE).select("v").toPandas()
    shards = min(MAX_SHARDS, max(1, -(-n // shard)))
    cent = fit_centroids(unit(np.stack(sample["v"].to_list())).astype(np.float32), shards) if n else np.zeros((1, dim), np.float32)
    probes = min(probes, len(cent))

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(np.stack(pdf["v"].to_list())).astype(np.float32)
            s = x @ cent.T
            top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
            yield pdf.assign(near=list(top.astype(np.int32)))

    placed = scratch.keep(points.mapInPandas(assign, "u long, v array<float>, near array<int>"))
    size = {r["s"]: r["c"] for r in placed.groupBy(F.col("near")[0].alias("s")).agg(F.count("*").alias("c")).collect()}
    parts = [max(1, -(-size.get(s, 0) // (2 * shard))) for s in range(len(cent))]
    n_parts = F.array(*map(F.lit, parts)) if len(parts) <= 512 else None
    table = spark.createDataFrame([(s, p) for s, p in enumerate(parts)], "s int, parts int")
    with_parts = lambda df: df.withColumn("parts", F.element_at(n_parts, F.col("s") + 1)) if n_parts is not None else df.join(F.broadcast(table), "s")
    home = with_parts(placed.select("u", "v", F.col("near")[0].alias("s"))).select("u", "v", "s", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("p"))

    def build(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(pdf["v"].to_list()).astype(np.float32)
        g = Graph(unit(raw))
        return pd.DataFrame({"s": [key_[0]], "p": [key_[1]], "ids": [pdf["u"].to_numpy(np.int64).tobytes()], "raw": [raw.tobytes()], "adj": [g.adj.tobytes()]})

    graphs = scratch.keep(home.groupBy("s", "p").applyInPandas(build, "s int, p int, ids binary, raw binary, adj binary"))
    visits = with_parts(placed.select("u", "v", F.explode("near").alias("s"))).where("parts > 0")
    visits = visits.select("u", "v", "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    visits = scratch.keep(visits)
    chunks = small(scratch.keep(visits.groupBy("s", "p").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))))
    copies = graphs.join(chunks, ["s", "p"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    asked = visits.join(chunks, ["s", "p"]).withColumn("chunk", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int")).drop("chunks")
    most = k + 1

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"u": pd.Series(dtype="int64"), "w": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        g = left.iloc[0]
        pid = np.frombuffer(g["ids"], np.int64)
        exact = unit(np.frombuffer(g["raw"], np.float32).reshape(len(pid), dim))
        graph = Graph(exact, np.frombuffer(g["adj"], np.int32).reshape(len(pid), DEGREE))
        out = []
        for a in range(0, len(right), 512):
            q = unit(np.stack(right["v"].iloc[a : a + 512].to_list()))
            u = right["u"].iloc[a : a + 512].to_numpy()
            got, _ = graph.search(q.astype(np.float32), SEARCH_BEAM)
            # the whole beam is scored in double precision, rounded and ranked with ties by id before it is cut
            w = pid[np.maximum(got, 0)]
            sim = np.round(np.einsum("bkd,bd->bk", exact[np.maximum(got, 0)], q), 9)
            sim[w == u[:, None]] = 1.0
            sim[got < 0] = -9.0
            order = np.lexsort((w, -sim), axis=1)[:, :most]
            w, sim = np.take_along_axis(w, order, 1), np.take_along_axis(sim, order, 1)
            ok = (sim > -9).ravel()
            out.append(pd.DataFrame({"u": np.repeat(u, w.shape[1])[ok], "w": w.ravel()[ok], "sim": sim.ravel()[ok]}))
        return pd.concat(out) if out else empty

    found = copies.groupBy("s", "p", "chunk").cogroup(asked.groupBy("s", "p", "chunk")).applyInPandas(answer, "u long, w long, sim double")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "w"))).where(f"r <= {most}")
    named = best.join(groups.select(F.col("u").alias("w"), "ids"), "w").select("u", "sim", F.explode("ids").alias("id"))
    lists = named.groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("neg"), "id"))), 1, most).alias("list"))
    lists = scratch.keep(lists)
    member = rows.select("id", "h1", "h2").join(groups.select("h1", "h2", "u"), ["h1", "h2"]).select("id", "u")
    mine = member.join(lists, "u").select(F.col("id").alias("me"), F.expr(f"slice(filter(list, x -> x.id <> id), 1, {k})").alias("list"))
    return mine.select(F.col("me").alias(key), F.posexplode("list").alias("pos", "x")).select(key, F.col("x.id").alias("neighbour"), (-F.col("x.neg")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def pairs(found: DataFrame, key: str = "vec_id") -> DataFrame:
    """Distinct pairs of which at least one is a neighbour of the other, smaller key first."""
    return found.select(F.least(key, "neighbour").alias(f"{key}_1"), F.greatest(key, "neighbour").alias(f"{key}_2")).distinct()


def recall(vectors: DataFrame, found: DataFrame, key: str = "vec_id", value: str = "value", k: int = K, every: int = 20, block: int = 2000) -> DataFrame:
    """One row (queries, expected, hit, recall): the neighbours found against brute force for keys divisible by `every`.

    The queries go against all rows in blocks of `block`; each task keeps its `k` best for a block.
    """
    rows = vectors.where(is_usable(F.col(value))).select(F.col(key).cast("long").alias("id"), F.transform(F.col(value), lambda x: x.cast("float")).alias("v"))
    stated = rows.where(F.col("id") % every == 0).select("id", "v").orderBy("id").toPandas()
    exact = None
    for a in range(0, len(stated), block):
        q, qid = unit(np.stack(stated["v"].iloc[a : a + block].to_list())), stated["id"].iloc[a : a + block].to_numpy()

        def scan(batches, q=q, qid=qid):
            for pdf in batches:
                x, xid = unit(np.stack(pdf["v"].to_list())), pdf["id"].to_numpy()
                s = np.round(q @ x.T, 9)
                s[qid[:, None] == xid[None, :]] = -2
                order = np.lexsort((np.broadcast_to(xid, s.shape), -s), axis=1)[:, :k]
                top = np.take_along_axis(s, order, 1)
                ok = (top > -2).ravel()
                yield pd.DataFrame({"id": np.repeat(qid, order.shape[1])[ok], "w": xid[order].ravel()[ok], "sim": top.ravel()[ok]})

        part = rows.mapInPandas(scan, "id long, w long, sim double")
        exact = part if exact is None else exact.unionByName(part)
    if exact is None:
        return vectors.sparkSession.createDataFrame([(0, 0, 0, None)], "queries long, expected long, hit long, recall double")
    true = exact.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "w"))).where(f"r <= {k}")
    both = true.join(found.select(F.col(key).alias("id"), F.col("neighbour").alias("w"), F.lit(1).alias("ok")), ["id", "w"], "left")
    out = both.agg(F.count_distinct("id").alias("queries"), F.count("*").alias("expected"), F.count("ok").alias("hit"))
    return out.withColumn("recall", F.round(F.col("hit") / F.col("expected"), 4))
