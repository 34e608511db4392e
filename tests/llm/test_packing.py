import random
from collections import defaultdict

from loomgraph.llm.packing import encoder, pack, pack_documents, plan, report, TOKENIZER


def test_plan_uses_everything_once_and_fits():
    rng = random.Random(2)
    for _ in range(20):
        counts = {rng.randrange(1, 100): rng.randrange(1, 500) for _ in range(30)}
        used = defaultdict(int)
        for pattern, times in plan(counts, 100):
            assert sum(n * c for n, c in pattern) <= 100 and times > 0
            for n, c in pattern:
                used[n] += c * times
        assert dict(used) == counts


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, 1 + int(rng.expovariate(1 / 300)))] += 1
    bins, total = sum(t for _, t in plan(counts, 2048)), sum(n * c for n, c in counts.items())
    assert bins <= total / 2048 * 1.01 + 1


def test_pack_hot_length(spark):
    df = spark.range(3000).selectExpr("id", "CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS INT) AS n", "'x' AS slot_name")
    rows = pack(df, ["id"], "n", 64).collect()
    room = defaultdict(int)
    for r in rows:
        room[r.slot] += r.n
    assert len(rows) == 3000 == len({r.id for r in rows}) and max(room.values()) <= 64
    assert len([x for x in room.values() if x]) <= sum(r.n for r in rows) / 64 * 1.02 + 1


def test_documents(spark):
    enc = encoder(TOKENIZER)
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 7000), (5, "<|endoftext|>"), (6, "same"), (7, "same"), (8, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in texts], "doc_id long, text string, piece int, slot int")
    got = defaultdict(list)
    rows = pack_documents(df, capacity=2048).collect()
    for r in rows:
        got[r.doc_id].append((r.piece, r.token_start, r.n_tokens))
    for i, t in texts:
        n = len(enc.encode_ordinary(t or ""))
        pieces = sorted(got[i])
        assert sum(x[2] for x in pieces) == n and len(pieces) == max(1, -(-n // 2048))
        assert [x[1] for x in pieces] == [k * 2048 for k in range(len(pieces))]
    room = defaultdict(int)
    for r in rows:
        room[r.container_id] += r.n_tokens
    assert max(room.values()) <= 2048
    one = report(pack_documents(df)).first()
    assert one.tokens == sum(room.values()) and one.containers >= one.fewest


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty).collect() == []
    assert report(pack_documents(empty)).first().containers == 0
