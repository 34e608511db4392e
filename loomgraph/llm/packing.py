"""Filling fixed-capacity containers with texts, planned on the histogram of their lengths.

1. Token counts come from a public tokenizer in Arrow batches. A text longer than the capacity is cut into full pieces
   and one rest; full pieces fill a container each.
2. The plan is made from counts per length, never from documents: at most `capacity` numbers reach the driver. Best fit
   over counts opens a container with the longest length that is left and keeps adding the longest length that fits; the
   resulting pattern is repeated as often as the counts allow, so a plan has few rows however many documents there are.
3. Pieces take their planned slots by joining on the rank within their length. Ranks come from counts per
   (length, part) and a running number inside a part, so a length that a third of all texts share is ranked in many tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PARTS = 64  # parts of a length that are ranked on their own, at least

# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer at `path`, loaded once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens); a null text counts as empty. The strings of special tokens are ordinary text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_t"]]
            yield pd.DataFrame({"_k": pdf["_k"], "n_tokens": n})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(count, f"_k {kind}, n_tokens long")
    return out.withColumnRenamed("_k", key)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit over counts: [(pattern as [(length, copies)], times)] that uses up `counts` of lengths in 1..capacity."""
    left = {n: c for n, c in counts.items() if c > 0 and 0 < n <= capacity}
    open_lengths = sorted(left)  # ascending
    out: list[tuple[list[tuple[int, int]], int]] = []
    import bisect

    while open_lengths:
        room, pattern = capacity, []
        used: dict[int, int] = {}
        at = len(open_lengths) - 1
        while at >= 0:
            n = open_lengths[at]
            copies = min(room // n, left[n])
            if copies:
                used[n] = copies
                pattern.append((n, copies))
                room -= n * copies
            at = min(at - 1, bisect.bisect_right(open_lengths, room) - 1)
        times = min(left[n] // c for n, c in pattern)
        for n, c in pattern:
            left[n] -= c * times
            if not left[n]:
                open_lengths.pop(bisect.bisect_left(open_lengths, n))
        out.append((pattern, times))
    return out


def pack(pieces: DataFrame, key: list[str], length: str, capacity: int = CAPACITY) -> DataFrame:
    """`key` columns, length and `slot` (container number from 0) for pieces of at most `capacity`.

    Pieces of no length take no room and go to container 0. An empty table gives an empty result. Ties within a length
    are broken by the part and the key, so the assignment is the same whenever the input is.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    parts = max(PARTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    base = scratch.keep(pieces.select(*key, F.col(length).cast("int").alias("_n"), part.alias("_part")))
    counted = base.groupBy("_n", "_part").count()
    offsets = counted.withColumn("_before", F.sum("count").over(W.partitionBy("_n").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    offsets = offsets.select("_n", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    # At most `capacity` lengths: a bounded histogram.
    hist = {r["_n"]: r["c"] for r in base.where("_n > 0").groupBy("_n").agg(F.count("*").alias("c")).collect()}
    if hist and max(hist) > capacity:
        raise ValueError("a piece is longer than the capacity")
    ranges, first_bin = [], 0
    given: dict[int, int] = {}
    for pattern, times in plan(hist, capacity):
        for n, copies in pattern:
            start = given.get(n, 0)
            given[n] = start + copies * times
            ranges.append((n, start, given[n], copies, first_bin))
        first_bin += times
    # Rows with a rank are cut into blocks of ranks, so that the join with the planned ranges is on (length, block).
    block = max(1, sum(hist.values()) // 16_384)
    rows = [(n, b, lo, hi, c, bin0) for n, lo, hi, c, bin0 in ranges for b in range(lo // block, (hi - 1) // block + 1)]
    slots = spark.createDataFrame(rows, "_n int, _block long, _lo long, _hi long, _copies long, _bin long")
    inside = F.row_number().over(W.partitionBy("_n", "_part").orderBy(*key)) - 1
    ranked = base.withColumn("_in", inside).join(offsets, ["_n", "_part"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {block}"))
    full = ranked.where("_n > 0").join(slots, ["_n", "_block"]).where("_rank >= _lo AND _rank < _hi")
    full = full.select(*key, F.col("_n").alias(length), F.expr("_bin + (_rank - _lo) div _copies").alias("slot"))
    none = base.where("_n = 0").select(*key, F.col("_n").alias(length), F.lit(0).cast("long").alias("slot"))
    return full.unionByName(none)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece, token_start, n_tokens, container_id): every document in containers of `capacity` tokens.

    A text is split only if it alone exceeds the capacity: into full pieces, each with a container of its own, and a
    rest that is packed like any other text. Null and empty texts are one piece of no tokens. `key` must be unique.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    counts = scratch.keep(token_counts(docs, key, text, tokenizer))
    cut = counts.withColumn("piece", F.explode(F.expr(f"sequence(0, CAST(greatest(0, (n_tokens - 1) div {capacity}) AS INT))")))
    cut = cut.select(key, "piece", F.expr(f"piece * {capacity}L").alias("token_start"), F.expr(f"CAST(least({capacity}L, n_tokens - piece * {capacity}L) AS INT)").alias("n_tokens"))
    packed = pack(cut, [key, "piece"], "n_tokens", capacity)
    return packed.select(key, "piece", F.expr(f"piece * {capacity}L").alias("token_start"), "n_tokens", F.col("slot").alias("container_id"))


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, the fewest that could do, and the share of room that is used."""
    used = packed.where("n_tokens > 0")
    out = used.agg(F.count("*").alias("pieces"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count_distinct("container_id").alias("containers"))
    return out.withColumn("fewest", F.ceil(F.col("tokens") / capacity)).withColumn("fill", F.when(F.col("containers") > 0, F.round(F.col("tokens") / (F.col("containers") * capacity), 6)))
