"""Embedding and label similarity: a deterministic embedder, exact nearest neighbours by block products, alignments."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch

BLOCK = 2000  # reference vectors that are shipped to a task at a time
CROWD = 64  # different vectors with one signature, beyond which the signature does not tell enough


def hashed_ngrams(texts: list[str], dim: int = 256, n: int = 3) -> np.ndarray:
    """Unit vectors of hashed character n-grams; the same text gives the same vector everywhere."""
    parts = [f"  {(t or '').lower().strip()} ".encode() for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    if len(b) < n:
        return np.zeros((len(texts), dim), np.float64)
    row, end = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    windows = len(b) - n + 1
    h = np.zeros(windows, np.uint64)
    for k in range(n):
        h = h * np.uint64(1_000_003) + b[k : windows + k]
    h = (h ^ (h >> np.uint64(13))) * np.uint64(0x9E3779B97F4A7C15)
    inside = np.arange(windows) + n <= end[:windows]  # a window does not reach into the next text
    at = row[:windows] * dim + ((h >> np.uint64(40)) % np.uint64(dim)).astype(np.int64)
    out = np.bincount(at[inside], minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray] = hashed_ngrams, cache: DataFrame | None = None) -> DataFrame:
    """(text, vec) of the distinct texts; texts that `cache` (text, vec) has are not embedded again."""
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    todo = texts.join(cache.select("text"), "text", "left_anti") if cache is not None else texts

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"text": pdf["text"], "vec": list(embedder(pdf["text"].tolist()))})

    fresh = todo.mapInPandas(run, "text string, vec array<double>")
    return fresh.unionByName(texts.join(cache.select("text", "vec"), "text")) if cache is not None else fresh


def nearest(left: DataFrame, right: DataFrame, lid: str, lvec: str, rid: str, rvec: str, k: int = 1, digits: int = 4, exclude_self: bool = False) -> DataFrame:
    """Exact `k` most similar rows of `right` for every row of `left`: (lid, rid, score, rank); ties to the smaller rid.

    The right side goes out in blocks of BLOCK vectors; the left side is scanned once per block and keeps its `k` best of
    each, so no pair table is built. Vectors are compared by cosine in double precision, rounded to `digits`.
    """
    kind_l, kind_r = left.schema[lid].dataType.simpleString(), right.schema[rid].dataType.simpleString()
    ref = right.where(f"size({rvec}) > 0").select(F.col(rid).alias("_r"), F.col(rvec).alias("_v")).orderBy("_r").toLocalIterator()
    base = left.where(f"size({lvec}) > 0").select(F.col(lid).alias("_l"), F.col(lvec).alias("_v"))
    found, ids, vecs = None, [], []

    def add(found, ids, vecs):
        m = np.array(vecs, np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        rids = np.array(ids)

        def scan(batches, m=m, rids=rids):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["_v"].to_list()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                s = np.round(x @ m.T, digits) + 0.0
                lids = pdf["_l"].to_numpy()
                if exclude_self:
                    s[lids[:, None] == rids[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, top, 1)
                ok = np.isfinite(score).ravel()
                yield pd.DataFrame({"_l": np.repeat(lids, top.shape[1])[ok], "_r": rids[top].ravel()[ok], "score": score.ravel()[ok]})

        part = base.mapInPandas(scan, f"_l {kind_l}, _r {kind_r}, score double")
        return part if found is None else found.unionByName(part)

    for row in ref:
        ids.append(row["_r"])
        vecs.append(row["_v"])
        if len(ids) == BLOCK:
            found, ids, vecs = add(found, ids, vecs), [], []
    if ids or found is None:
        found = add(found, ids, vecs) if ids else left.sparkSession.createDataFrame([], f"_l {kind_l}, _r {kind_r}, score double")
    out = found.withColumn("rank", F.row_number().over(W.partitionBy("_l").orderBy(F.desc("score"), "_r"))).where(f"rank <= {k}")
    return out.select(F.col("_l").alias(lid), F.col("_r").alias(rid if rid != lid else f"{rid}_2"), "score", "rank")


def similarity_join(left: DataFrame, right: DataFrame, lid: str, lvec: str, rid: str, rvec: str, threshold: float = 0.95, inclusive: bool = False, digits: int = 4) -> DataFrame:
    """Best match of every left row if it reaches the threshold (`>` or, if inclusive, `>=`)."""
    best = nearest(left, right, lid, lvec, rid, rvec, 1, digits).drop("rank")
    return best.where(F.col("score") >= threshold if inclusive else F.col("score") > threshold)


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def best_texts(left: DataFrame, right: DataFrame, threshold: float = 0.95, inclusive: bool = False, embedder: Callable[[list[str]], np.ndarray] = hashed_ngrams, digits: int = 4) -> DataFrame:
    """(text, ref_text, score): for every text of `left` the most similar one of `right` (one column each) if it reaches the threshold; ties to the smaller text.

    The same as `similarity_join` over both sides embedded, without comparing all pairs. A score that rounds to 1 cannot
    be beaten, and two unit vectors with such a score differ by no more than r = 10^(-digits/2) in any coordinate. So they
    have the same signature, the set of coordinates beyond 2r, unless a coordinate of the left one lies between r and 3r:
    one keyed join finds all of them, and the least of them is the answer. Left vectors that are unclear in this sense,
    whose signature more than CROWD different vectors share, or that have no such partner, are compared with the whole
    right side in blocks of texts, which are embedded where they are compared. Nothing goes through the driver.
    """
    scratch = Scratch(left.sparkSession, "best-texts")
    r = 10 ** (-digits / 2) * 1.001

    def mark(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m = _unit(embedder(pdf["text"].tolist()))
            size, zero = np.abs(m), ~m.any(axis=1)
            clear = ~((size > r) & (size < 3 * r)).any(axis=1) & ~zero
            bits = np.packbits(size > 2 * r, axis=1)
            yield pdf.assign(sig=[x.tobytes() for x in bits], vid=[hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in m], clear=clear)

    # A text of both sides is embedded once.
    side = lambda df, l: df.toDF("text").where("text IS NOT NULL").select("text", F.lit(l).alias("l"), F.lit(not l).alias("r"))
    texts = side(left, True).unionByName(side(right, False)).groupBy("text").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    texts = scratch.keep(texts.mapInPandas(mark, "text string, l boolean, r boolean, sig binary, vid binary, clear boolean"))
    a, b = texts.where("l"), texts.where("r")

    def same(batches):
        for pdf in batches:
            ok = (pdf["vid"] == pdf["ref_vid"]).to_numpy(copy=True)
            other = np.flatnonzero(~ok)
            if len(other):
                x, y = (_unit(embedder(pdf[c].iloc[other].tolist())) for c in ("one", "ref_text"))
                ok[other] = np.round((x * y).sum(axis=1), digits) >= 1
            yield pdf.loc[ok, ["vid", "ref_text"]]

    vectors = lambda df, name: df.repartition("sig").groupBy("sig", "vid").agg(F.min("text").alias(name))
    known = vectors(b, "ref_text").groupBy("sig").agg(F.collect_list(F.struct("vid", "ref_text")).alias("refs")).where(f"size(refs) <= {CROWD}")
    pairs = vectors(a.where("clear"), "one").join(known, "sig").select("vid", "one", F.explode("refs").alias("ref"))
    pairs = pairs.select("vid", "one", F.col("ref.vid").alias("ref_vid"), F.col("ref.ref_text").alias("ref_text"))
    top = pairs.mapInPandas(same, "vid binary, ref_text string").groupBy("vid").agg(F.min("ref_text").alias("ref_text"))
    found = scratch.keep(a.join(top, "vid", "left").select("text", "ref_text", F.when(F.col("ref_text").isNotNull(), 1.0).alias("score")))
    rest = found.where("ref_text IS NULL").select("text")
    left_over = rest.count()
    found = found.where("ref_text IS NOT NULL")
    if left_over:
        found = found.unionByName(_best_of_all(rest, left_over, b.select("text"), b.count(), embedder, digits))
    return found.where(F.col("score") >= threshold if inclusive else F.col("score") > threshold)


def _best_of_all(left: DataFrame, n_left: int, right: DataFrame, n_right: int, embedder, digits: int) -> DataFrame:
    """(text, ref_text, score): the most similar text of `right`, by products of blocks of BLOCK texts; a task has a few blocks of each side."""
    size = BLOCK

    def pack(batches):
        held: list[str] = []
        for pdf in batches:
            held += pdf["text"].tolist()
            while len(held) >= size:
                yield pd.DataFrame({"texts": [held[:size]]})
                held = held[size:]
        if held:
            yield pd.DataFrame({"texts": [held]})

    def scan(batches):
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["y"]):
                x, y = list(x), sorted(y)
                s = np.round(_unit(embedder(x)) @ _unit(embedder(y)).T, digits) + 0.0
                at = s.argmax(axis=1)
                yield pd.DataFrame({"text": x, "ref_text": [y[i] for i in at], "score": s[np.arange(len(x)), at]})

    blocks = lambda df, n, name: df.repartition(max(1, -(-n // (4 * size)))).mapInPandas(pack, "texts array<string>").withColumnRenamed("texts", name)
    best = blocks(left, n_left, "x").crossJoin(blocks(right, n_right, "y")).mapInPandas(scan, "text string, ref_text string, score double")
    least = best.groupBy("text").agg(F.min(F.struct((-F.col("score")).alias("neg"), "ref_text")).alias("b"))
    return least.select("text", F.col("b.ref_text").alias("ref_text"), (-F.col("b.neg") + 0.0).alias("score"))


def label_index(labels: DataFrame, queries: DataFrame, k: int = 5, accept: float = 0.7, embedder=hashed_ngrams) -> DataFrame:
    """(query, uri, label, score, decision): the best label of each of the `k` nearest uris; accepted from `accept` on, else to review."""
    lv = labels.select("uri", "label").distinct().join(embed(labels, "label", embedder).withColumnRenamed("text", "label"), "label")
    key = lv.withColumn("row", F.concat_ws("\x1f", "uri", "label"))
    qv = embed(queries, "query", embedder)
    hit = nearest(qv.withColumnRenamed("text", "query"), key, "query", "vec", "row", "vec", k)
    hit = hit.join(key.select("row", "uri", "label"), "row")
    best = hit.groupBy("query", "uri").agg(F.max(F.struct("score", "label")).alias("b"))
    return best.select("query", "uri", F.col("b.label").alias("label"), F.col("b.score").alias("score"), F.when(F.col("b.score") >= accept, "accept").otherwise("review").alias("decision"))


def centroids(df: DataFrame, group: str, vector: str, digits: int = 6) -> DataFrame:
    """(group, dim, value): mean vectors, one partial aggregate per dimension."""
    return df.select(group, F.posexplode(vector).alias("dim", "v")).groupBy(group, "dim").agg((F.round(F.avg(F.col("v").cast("double")), digits) + 0.0).alias("value"))


def value_scores(pairs: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed_ngrams, digits: int = 6) -> DataFrame:
    """(o, o2, score): cosine of two texts, for each different pair of `pairs` once; vectors stay in the task that compares them."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x, y = (_unit(embedder(pdf[c].tolist())) for c in ("o", "o2"))
                yield pdf.assign(score=np.round((x * y).sum(axis=1), digits))

    return pairs.select("o", "o2").distinct().mapInPandas(run, "o string, o2 string, score double")


def value_alignment(a: DataFrame, b: DataFrame, vec: str = "vec", threshold: float = 0.95) -> DataFrame:
    """Per left (s, p, o) the best cosine among the values of the same (s, p) on the right, and whether it passes."""
    from ..functions.text import cosine

    pairs = a.select("s", "p", "o", F.col(vec).alias("va")).join(b.select("s", "p", F.col("o").alias("o2"), F.col(vec).alias("vb")), ["s", "p"])
    best = pairs.groupBy("s", "p", "o").agg(F.round(F.max(cosine(F.col("va"), F.col("vb"))), 6).alias("score"))
    return best.withColumn("hit", F.col("score") > threshold)
