import random
import string

from loomgraph.llm.canonical import garbled, map_to_canonical, similar, slips_between

TERMS = [("r", 1, "director"), ("r", 1, "directed by"), ("r", 2, "place of birth"), ("r", 2, "birthplace"), ("r", 3, "executive producer"), ("r", 4, "age"), ("e", 5, "Čebobrück"), ("e", 6, "Old Kroshami")]


def terms(spark):
    return spark.createDataFrame(TERMS, "list string, term_id long, label string")


def mapped(spark, forms, kind="r"):
    df = spark.createDataFrame([(kind, f) for f in forms], "list string, form string")
    return {r.form: r.term_id for r in map_to_canonical(df, terms(spark)).collect()}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pigeonhole_join_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    refs = [(word(rng.randrange(3, 13))) for _ in range(40)]
    values = [word(rng.randrange(2, 14)) for _ in range(60)] + [r[:2] + rng.choice(string.ascii_lowercase) + r[3:] for r in refs]
    k = lambda r: 0 if len(r) <= 3 else 2 if len(r) <= 5 else 3 if len(r) <= 9 else 4
    e = spark.createDataFrame([("l", r, len(r), k(r)) for r in set(refs)], "list string, ref string, n int, k int")
    v = spark.createDataFrame([("l", x) for x in set(values)], "list string, x string")
    got = {(r.x, r.ref, r.d) for r in similar(v, e).collect()}
    want = {(x, r, lev(x, r)) for x in set(values) for r in set(refs) if lev(x, r) <= k(r)}
    assert got == want


def test_gapped_segments_keep_every_pair_within_the_slips(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))

    def slip(x):
        i = rng.randrange(len(x) - 1)
        return rng.choice([x[:i] + x[i + 1] + x[i] + x[i + 2 :], x[:i] + x[i + 1 :], x[:i] + rng.choice("abcde") + x[i:], x[:i] + rng.choice("abcde") + x[i + 1 :]])

    refs = sorted({word(rng.randrange(3, 18)) for _ in range(50)})
    k = lambda r: 0 if len(r) <= 3 else 1 if len(r) <= 5 else 2 if len(r) <= 9 else 3
    values = set(refs)
    for r in refs:
        for _ in range(8):
            x = r
            for _ in range(k(r)):
                x = slip(x)
            values.add(x)
    e = spark.createDataFrame([("l", r, len(r), k(r)) for r in refs], "list string, ref string, n int, k int")
    got = {(r.x, r.ref) for r in similar(spark.createDataFrame([("l", x) for x in values], "list string, x string"), e, swaps=True).collect()}
    assert {(x, r) for x in values for r in refs if slips_between(x, r) <= k(r)} <= got
    assert all(lev(x, r) <= 2 * k(r) for x, r in got)


def test_spellings_reach_their_term(spark):
    got = mapped(spark, ["DIRECTOR", "driector", "by, directed", "whose place-of-birth", "executiveProducer (film)", "birth, place of", "plcae of brith", "onto#director name", "tomato soup", "age", "agw", "ega"])
    assert got["tomato soup"] == 0 and got["ega"] == 0
    assert all(got[f] == 1 for f in ("DIRECTOR", "driector", "by, directed", "onto#director name"))
    assert all(got[f] == 2 for f in ("whose place-of-birth", "birth, place of", "plcae of brith"))
    assert got["executiveProducer (film)"] == 3


def test_garbled_and_plain_letters(spark):
    wrong = "".join(garbled(c) if not c.isascii() else c for c in "Čebobrück")
    twice = "".join(garbled(c) if not c.isascii() else c for c in wrong)
    got = mapped(spark, [wrong, twice, "cebobruck", "the Čebobrück ltd.", "Kroshami, Old", "Zorobrück"], "e")
    assert got == {wrong: 5, twice: 5, "cebobruck": 5, "the Čebobrück ltd.": 5, "Kroshami, Old": 6, "Zorobrück": 0}


def test_dirt(spark):
    long = "x" * 20_000
    got = mapped(spark, [None, "", "  ", "​", "?", long, "director", "director"])
    assert got == {"?": 0, long: 0, "director": 1}
    assert mapped(spark, []) == {}
    empty = map_to_canonical(spark.createDataFrame([("r", "director", 9)], "list string, form string, ref int"), terms(spark).limit(0)).collect()
    assert [(r.form, r.term_id) for r in empty] == [("director", 0)]


def test_ties_go_to_the_smaller_term(spark):
    t = spark.createDataFrame([("l", 8, "abcdefgh"), ("l", 7, "abcdefgi")], "list string, term_id long, label string")
    f = spark.createDataFrame([("l", "abcdefgx")], "list string, form string")
    assert map_to_canonical(f, t).first().term_id == 7


def test_swaps_cost_one_slip_each(spark):
    t = spark.createDataFrame([("l", 1, "composer"), ("l", 2, "production budget"), ("l", 3, "Bovatelu Books")], "list string, term_id long, label string")
    forms = ["comopsre", "productino bigdet", "rpoduciton budgte", "Botelva Koobs"]
    f = spark.createDataFrame([("l", x) for x in forms], "list string, form string")
    assert {r.form: r.term_id for r in map_to_canonical(f, t).collect()} == {"comopsre": 1, "productino bigdet": 2, "rpoduciton budgte": 2, "Botelva Koobs": 0}
