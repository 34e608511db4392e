import numpy as np
import pandas as pd

from loomgraph.llm.entity_match import attributes, band_keys, fit_logistic, match, weights, FEATURES

COLS = ("id", "title", "author", "isbn")
S = "id string, title string, author string, isbn string"


def found(spark, a, b):
    out = match(spark.createDataFrame(a, S), spark.createDataFrame(b, S), COLS, COLS)
    return {(r.source_id, r.target_id) for r in out.collect()}


def test_attributes(spark):
    rows = [
        ("1", "The Broken Kitchen, Part II: a novel (Paperback)", "KITTEL Anna", "978-2-345-67891-1"), ("2", "broken  kitchen (vol. 2)", "Kittel, A.", "2345678911"),
        ("3", "Broken Kitchen, The", "Anonymous", "0000000000000"), ("4", None, None, None), ("5", "A Map for the Bridge – reprint", "A. Kittel et al.", "9.78E+12"),
    ]
    got = {r.id: r for r in attributes(spark.createDataFrame(rows, S), *COLS).collect()}
    assert (got["1"].t, got["1"].vol, got["1"].sur, got["1"].ini, got["1"].code) == ("broken kitchen", 2, "kittel", "a", "234567891")
    assert (got["2"].t, got["2"].vol, got["2"].sur, got["2"].ini, got["2"].code) == ("broken kitchen", 2, "kittel", "a", "234567891")
    assert (got["3"].t, got["3"].vol, got["3"].sur, got["3"].code) == ("broken kitchen", 0, None, None)
    assert (got["4"].t, got["4"].sur, got["4"].code) == (None, None, None)
    assert (got["5"].t, got["5"].sur, got["5"].code) == ("map for the bridge", "kittel", None)


def test_same_work_matches_other_volume_does_not(spark):
    a = [("s1", "The Broken Kitchen, Part I", "Anna Kittel", "9782345678911"), ("s2", "The Broken Kitchen, Part II", "Anna Kittel", None), ("s3", "A Lantern for the Harbour", "Jon Brask", "9787777777771")]
    b = [("t1", "Teh Broken Kitchen (vol. 1): a novel", "Kittel, A.", ""), ("t2", "BROKEN KITCHEN: BOOK TWO", "A. Kittel", "9785555555555"), ("t3", "A Lantern for the Harbour", "Mara Oswin", None), ("t4", "A Lantrn for the Harbour", "Brask, Jon", "978-7-777-77777-1")]
    assert found(spark, a, b) == {("s1", "t1"), ("s2", "t2"), ("s3", "t4")}


def test_dirt(spark):
    row = ("x", "Quiet Orchard and Salted Bridge", "Ida Holm", None)
    assert found(spark, [], [row]) == set() == found(spark, [row], [])
    rows = [row, row, (None, "Quiet Orchard and Salted Bridge", "Ida Holm", None), ("n", None, None, None), ("e", "", " ", ""), ("l", "w " * 8000, "Ida Holm", None)]
    assert found(spark, rows, rows) == {("x", "x"), ("l", "l")}


def test_extra_columns_with_clashing_names(spark):
    row = ("x", "Quiet Orchard and Salted Bridge", "Ida Holm", None, 1, "a")
    df = spark.createDataFrame([row], S + ", c int, t string")
    assert match(df, df, COLS, COLS).count() == 1


def test_classifier_separates_held_out_labels():
    rng = np.random.default_rng(0)
    x = np.zeros((400, len(FEATURES)))
    x[:, 0] = 1
    x[:, 1] = rng.uniform(0, 1, 400)
    y = (x[:, 1] + 0.05 * rng.normal(size=400) < 0.3).astype(int)
    w, learned = weights(pd.DataFrame(x[:300], columns=list(FEATURES)).assign(label=y[:300]))
    assert learned == "calibrated" and weights(pd.DataFrame(x[:5], columns=list(FEATURES)).assign(label=y[:5]))[1] == "prior"
    assert (((x[300:] @ w) > 0) == y[300:]).mean() > 0.93
    assert np.isfinite(fit_logistic(x, y)).all()


def test_bands_meet_for_slips():
    known, both, alone = band_keys(["kitchen bridge harbour", "kitchen brigde harbour", "lantern meadow", "q"], ["holmqvist", "holmqvist", "holmqvist", None])
    assert known.tolist() == [0, 1, 2] and both.shape == (3, 40) and alone.shape == (4, 24)
    assert set(both[0]) & set(both[1]) and set(alone[0]) & set(alone[1]) and not set(alone[0]) & set(alone[2])
    one = [band_keys([t], [s]) for t, s in (("kitchen bridge harbour", "holmqvist"), ("lantern meadow", "holmqvist"))]
    assert (one[0][1] == both[0]).all() and (one[1][2] == alone[2]).all()  # a record's keys do not depend on its batch


def test_titles_of_other_scripts(spark):
    titles, names = ["война и мир", "мастер и маргарита", "ο γέρος και η θάλασσα", "老人与海的故事"], ["толстой", "булгаков", "χέμινγουεϊ", "海明威"]
    _, both, alone = band_keys(titles, names)
    for i in range(4):
        for j in range(i):
            assert not set(both[i]) & set(both[j]) and not set(alone[i]) & set(alone[j])
    rows = [(f"r{i}", t, f"{n} ann", None) for i, (t, n) in enumerate(zip(titles, names))]
    assert found(spark, rows, [(f"u{i}", t.upper(), a, None) for i, (_, t, a, _) in enumerate(rows)]) == {(f"r{i}", f"u{i}") for i in range(4)}


def test_title_alone_meets_where_a_side_knows_no_author(spark):
    a = [("s1", "Quiet Orchard and Salted Bridge", None, None), ("s2", "Lantern for the Northern Harbour", "Ida Holm", None)]
    b = [("t1", "Quiet Orchard and Salted Bridge", "Jon Brask", None), ("t2", "Lantern for the Northern Harbour", None, None), ("t3", "Quiet Orchard and Salted Bridge", None, None)]
    assert found(spark, a, b) == {("s1", "t1"), ("s1", "t3"), ("s2", "t2")}
