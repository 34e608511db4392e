import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import leakage
from loomgraph.llm.leakage import Index, Item, align, find, grams, leaks, own_texts, word_names, words_of

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghiklmnoprstuv") for _ in range(RNG.randrange(3, 10))) for _ in range(900)]


def text(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEMS = [(i, text(90, i)) for i in range(8)]


def index(items):
    """What `with_counts` counts in Spark, counted plainly."""
    parts = [(i, *words_of(t)) for i, t in items]
    words = Counter(w for _, c, n in parts for w in set(word_names(c, n)))
    held = Counter(g for _, c, _ in parts for g in set(grams(c).tolist()))
    return Index([Item([i], c, n, np.array([words[w] for w in word_names(c, n)]), np.array([held[g] for g in grams(c).tolist()])) for i, c, n in parts])


def hits(texts, items=ITEMS):
    return {(d, i) for d, i, _ in find(texts, index(items))}


def around(passage, seed=77):
    return f"{text(60, seed)} {passage} {text(60, seed + 1)}"


def test_grams_are_equal_where_the_letters_are():
    codes = np.array([RNG.randrange(4) + 2 for _ in range(3000)], np.uint32)
    for q in (3, 5, 8, 11):
        g, names = grams(codes, q), [codes[i : i + q].tobytes() for i in range(len(codes) - q + 1)]
        assert len(g) == len(names) and len(set(g.tolist())) == len(set(names)) == len(set(zip(g.tolist(), names)))


def test_alignment_is_the_best_path_of_its_band():
    rng = random.Random(2)
    for _ in range(20):
        item = np.array([rng.randrange(5) + 2 for _ in range(30)], np.uint32)
        doc = np.concatenate([[9] * 6, np.delete(item, rng.randrange(30)), [9] * 6]).astype(np.uint32)
        doc[rng.randrange(10, 20)] = 8
        half, m = 4, 6
        (covered, diagonal), = align([(doc, item, m)], half)
        best = {b: 0 for b in range(2 * half + 1)}
        for i in range(len(item)):  # plain dynamic programming over the same cells
            row = {}
            for b in best:
                j = m - half + i + b
                same = 0 <= j < len(doc) and doc[j] == item[i]
                row[b] = max(best[b] + (leakage.EQUAL if same else -leakage.UNEQUAL), best.get(b + 1, -999) - leakage.GAP, row.get(b - 1, -999) - leakage.GAP)
            best = row
        assert all(item[i] == doc[i + diagonal[i]] for i in np.flatnonzero(covered))
        assert np.abs(diagonal - m).max() <= half
        shifts = int(np.abs(np.diff(diagonal)).sum())
        # letters left out on either side shift the diagonal by one each, other uncovered letters are unequal
        assert max(best.values()) == leakage.EQUAL * covered.sum() - leakage.GAP * shifts - leakage.UNEQUAL * (len(item) - covered.sum() - shifts)


def test_whole_and_partial_passages():
    w = ITEMS[2][1].split()
    assert hits([around(ITEMS[2][1]), around(" ".join(w[20:32])), around(" ".join(w[20:28])), text(300, 5_000)]) == {(0, 2), (1, 2)}


def test_altered_passages():
    w = ITEMS[3][1].split()
    p = w[10:34]
    marked = " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(p))
    lines = "\n> ".join(" ".join(p[i : i + 5]) for i in range(0, 24, 5))
    hyphen = " ".join(x[:2] + "-\n" + x[2:] if i % 4 == 0 and len(x) > 4 else x for i, x in enumerate(p))
    changed = " ".join("other" if i in (6, 15) else x for i, x in enumerate(p))
    damaged = " ".join(x[:-1] + "q" if i in (3, 9, 17) else x for i, x in enumerate(p))
    variants = [marked, lines, hyphen, changed, damaged, " ".join(p).upper(), " ,\t ".join(p)]
    assert hits([around(v, 100 + 3 * i) for i, v in enumerate(variants)]) == {(i, 3) for i in range(len(variants))}


def test_changed_words_in_a_passage_of_common_words():
    rng = random.Random(6)
    few = [w for w in WORDS if len(w) > 5][:40]
    items = [(i, " ".join(rng.choice(few) for _ in range(90))) for i in range(8)]
    p = items[4][1].split()[30:42]
    changed = " ".join("xxqxxq" if i in (4, 8) else x for i, x in enumerate(p))
    left_out = " ".join(x for i, x in enumerate(p) if i not in (4, 8))
    assert hits([around(changed), around(left_out)], items) == {(0, 4)}


def test_passage_that_several_items_share():
    shared = text(30, 4_000)
    items = [(i, f"{text(40, 200 + i)} {shared if i < 4 else text(30, 300 + i)} {text(20, 400 + i)}") for i in range(8)]
    assert hits([around(" ".join(shared.split()[8:22]))], items) == {(0, i) for i in range(4)}


def test_short_words_between_changed_words():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40)) + " camera of the sunken harbour la vista brave teacher inherits walls and orchards " + text(30, 600 + i)) for i in range(2)]
    assert hits([around("camera of the sunken xxqxxq la yyqyyq brave teacher inherits walls and orchards")], items) == {(0, 0), (0, 1)}


def test_standing_instruction_does_not_count(spark):
    line = "Read the passage below and then answer the question that follows it in one short sentence of your own."
    items = spark.createDataFrame([(i, f"{line}\n{t}") for i, t in ITEMS] + [(50, line)], "item_id long, text string")
    docs = spark.createDataFrame([(0, around(line)), (1, around(" ".join(ITEMS[1][1].split()[:20])))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(0, 50), (1, 1)}  # the last line of an item is its own text


def test_own_texts_and_equal_items(spark):
    rows = [(1, "Say it:\nalpha one"), (2, "say  it:\r\nbeta two"), (3, "Say it:\ngamma three"), (4, "Say it:\ngamma three"), (5, "delta\nsix"), (6, None), (7, "")]
    got = {(r.own, tuple(r.ids)) for r in own_texts(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text").collect()}
    assert got == {("alpha one", (1,)), ("beta two", (2,)), ("gamma three", (3, 4)), ("delta\nsix", (5,))}


CYRILLIC = "старый капитан медленно открыл тяжёлую дверь маяка и увидел на столе забытую тетрадь с рисунками далёкого острова"
CHINESE = "老船长慢慢推开灯塔沉重的大门看见桌上放着一本被遗忘的笔记本里面画着远方的岛屿和暴风雨中的港口"
GREEK = "ο γέρος καπετάνιος άνοιξε αργά τη βαριά πόρτα του φάρου και είδε στο τραπέζι ένα ξεχασμένο τετράδιο με σχέδια"


@pytest.mark.parametrize("passage", [CYRILLIC, CHINESE, GREEK])
def test_other_scripts(passage):
    items = [*ITEMS, (70, passage)]
    half = passage.split()
    part = " ".join(half[1:14]) if len(half) > 1 else passage[5:33]
    assert hits([around(passage), around(passage.upper()), around(part), text(200, 8_001)], items) == {(0, 70), (1, 70), (2, 70)}


def test_repeated_items_and_blocks(spark, monkeypatch):
    items = spark.createDataFrame([*ITEMS, *[(100 + k, ITEMS[3][1]) for k in range(3)], (200, CYRILLIC)], "item_id long, text string")
    docs = spark.createDataFrame([(1, around(ITEMS[3][1])), (2, around(" ".join(ITEMS[5][1].split()[30:50]))), (3, CYRILLIC)], "doc_id long, text string")
    want = {(1, 3), (1, 100), (1, 101), (1, 102), (2, 5), (3, 200)}
    for block, blocks in ((5000, 8), (2, 8), (1, 2)):
        monkeypatch.setattr(leakage, "BLOCK", block)
        monkeypatch.setattr(leakage, "BLOCKS", blocks)
        assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == want


def test_passages_with_changed_words_are_found_as_a_rule():
    rng = random.Random(12)
    docs, want = [], set()
    for d in range(120):
        i, n = rng.randrange(8), rng.choice([14, 16, 20])
        w = ITEMS[i][1].split()
        at = rng.randrange(len(w) - n)
        p = w[at : at + n]
        for x in rng.sample(range(1, n - 1), 2):
            p[x] = "qzxjvk"
        docs.append(around(" ".join(p), 2000 + d))
        want.add((d, i))
    got = hits(docs)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_brute_force_agreement_on_exact_passages():
    rng = random.Random(9)
    docs, want = [], set()
    for d in range(40):
        i, n = rng.randrange(8), rng.choice([5, 8, 13, 20])
        w = ITEMS[i][1].split()
        at = rng.randrange(len(w) - n)
        docs.append(around(" ".join(w[at : at + n]), 1000 + d))
        if n >= 12:
            want.add((d, i))
    assert hits(docs) == want


def test_frames_with_dirt(spark):
    p = " ".join(ITEMS[5][1].split()[:30])
    long = text(40_000, 9_999) + " " + p
    docs = spark.createDataFrame([(1, p, 0), (2, None, 0), (3, "", 0), (4, long, 0), (5, p, 0), (6, "​", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, t) for i, t in ITEMS] + [(90, None), (91, ""), (92, "short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(1, 5), (4, 5), (5, 5)}
    assert leaks(docs.limit(0), items).collect() == [] == leaks(docs, items.limit(0)).collect()
