"""Matching entities across sources without keys: MinHash blocking, pairwise features, a calibrated logistic classifier.

1. Every record is reduced to comparable attributes (core title, volume, surname, initial, ISBN core). Records with the
   same attributes form a class; only classes are compared, and pairs of records come out by joining the classes back.
2. Blocking: MinHash bands over the marked character trigrams of title and surname together find noisy copies; bands over
   the title alone are used where one side states no author; a shared ISBN core is a block of its own.
3. Features of a candidate pair are SQL expressions: edit distance and word overlap of the titles, volume and ISBN
   agreement, surname and initial, and how many authors share the title in the whole corpus.
4. Labelling functions vote on a bounded sample of candidates (`TRAIN` pairs, taken by hash); a logistic model is fitted on
   half of them and its scores are calibrated on the other half (Platt scaling). Scoring runs in SQL over all candidates.

Scale: attributes and MinHash are narrow maps; candidates come from equality joins on band keys over distinct classes, so
repeated rows do not multiply; adaptive execution splits hot bands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .canonical import fold, repaired

ROWS, BANDS = 6, 40
TITLE_ROWS, TITLE_BANDS = 6, 24
TRAIN = 40_000
THRESHOLD = 0.5

# What stands for no author, and ISBNs that stand for none.
NO_AUTHOR = ("", "anonymous", "various", "various authors", "n n", "nn", "unknown", "anon", "none", "null", "n a", "na", "author unknown", "unknown author", "diverse", "collective", "nan", "tba", "todo")
NO_ISBN = ("0000000000000", "9780000000002", "9999999999999", "1234567890123", "9781234567897", "0000000000", "1234567890", "9790000000001")

NUMBER = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "first": 1, "second": 2, "third": 3, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9}
STOP = ("a", "an", "the", "of", "for", "and")
MARKED = [chr(c) for c in [*range(0xC0, 0x180), 0x2013, 0x2019, 0xA0] if chr(c).isalpha() or c in (0x2013, 0x2019, 0xA0)]


def attributes(df: DataFrame, id_: str, title: str, author: str, isbn: str) -> DataFrame:
    """(id, t, words, vol, sur, ini, code): core title, its words, volume (0: none), surname, initial, ISBN core; null where not stated."""
    raw = F.lower(F.coalesce(F.col(title).cast("string"), F.lit("")))
    raw = F.trim(F.regexp_replace(raw, r"[\s\p{Z}]+", " "))
    num = "|".join(sorted(NUMBER, key=len, reverse=True))
    marker = rf"(?:[,:(]? ?\b(?:vol(?:ume)?|part|book|band|tome)\b\.? ?({num})\b\)?)"
    bare = r"(?<=\p{L}) (i{1,3}|iv|v|vi)(?= *(?:$|[:;,(\[\-–]| or ))"
    edition = r"\((?:paperback|hardcover|[0-9]+(?:st|nd|rd|th) ed\.?|[^()]*edition)\)|\[[^\]]*\]|\s[–-] reprint\b"
    clean = F.regexp_replace(raw, edition, " ")
    found = F.coalesce(F.nullif(F.regexp_extract(clean, marker, 1), F.lit("")), F.nullif(F.regexp_extract(clean, bare, 1), F.lit("")))
    vol = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NUMBER.items() for x in kv]), found), F.lit(0))
    main = F.regexp_replace(F.regexp_replace(clean, marker, " : "), bare, " : ")
    main = F.regexp_replace(main, r"(?:\s*[:;]|\s[–-]\s|, or ).*$", "")
    main = F.regexp_replace(F.trim(main), r"^(.*), (the|a|an)$", "$2 $1")
    plain = F.trim(F.regexp_replace(fold(repaired(main, [c.lower() for c in MARKED])), r"[^\p{L}\p{N}]+", " "))
    plain = F.regexp_replace(plain, r"^(?:the|a|an|teh|hte|th|te|he|thee|tthe|thhe|t\p{L}e|th\p{L}|\p{L}he) ", "")  # an article, or one slip away from it
    words = F.filter(F.split(plain, " "), lambda w: (F.length(w) > 0) & ~w.isin(*STOP))

    a = F.regexp_replace(F.coalesce(F.col(author).cast("string"), F.lit("")), r"\(author\)|\bet al\.?|[;*]", " ")
    a = F.trim(F.regexp_replace(a, r"[\s\p{Z}]+", " "))
    shout = F.regexp_extract(a, r"^(\p{Lu}{3,}) \p{Lu}\p{Ll}", 1)  # SURNAME Given
    comma = F.when(F.instr(a, ",") > 0, F.substring_index(a, ",", 1)).when(F.length(shout) > 0, shout)
    only = fold(F.trim(F.regexp_replace(a, r"[^\p{L}\p{N}]+", " ")))
    parts = F.filter(F.split(only, " "), lambda w: F.length(w) > 0)
    long = F.filter(parts, lambda w: F.length(w) > 2)
    sur = F.coalesce(F.trim(F.regexp_replace(fold(comma), r"[^\p{L}]+", "")), F.try_element_at(long, F.lit(-1)), F.try_element_at(parts, F.lit(-1)))
    ini = F.substring(F.try_element_at(F.filter(parts, lambda w: w != sur), F.lit(1)), 1, 1)
    known = ~only.isin(*NO_AUTHOR)
    # letters that stand for digits in scanned numbers
    written = F.translate(F.regexp_replace(F.coalesce(F.col(isbn).cast("string"), F.lit("")), r"(?i)isbn(?:-?1[03])?:?", ""), "OoIl", "0011")
    digits = F.upper(F.regexp_replace(written, r"[^0-9xX]", ""))
    stated = ~digits.isin(*NO_ISBN) & ~F.col(isbn).cast("string").rlike(r"[eE]\+")
    code = F.when(stated & (F.length(digits) == 13), F.substring(digits, 4, 9)).when(stated & (F.length(digits) == 10), F.substring(digits, 1, 9))
    out = df.where(F.col(id_).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.nullif(plain, F.lit("")).alias("t"), words.alias("words"), vol.alias("vol"), F.when(known, sur).alias("sur"), F.when(known, ini).alias("ini"), code.alias("code"))
    return out.distinct()


def _trigrams(texts: list[str], mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams of code points of all texts, blanks around each, and how many each text has."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    c = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    g = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    g = (g ^ np.uint64(mark << 62)) * np.uint64(0x9E3779B97F4A7C15)
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    g = (g >> np.uint64(32)).astype(np.uint32)
    inside = np.ones(len(c), bool)  # trigrams that reach into the next text do not count
    end = np.cumsum(sizes)
    inside[end - 1] = inside[end - 2] = False
    return g[inside[:-2]], sizes - 2


def _keys(grams: np.ndarray, sizes: np.ndarray, rows: int, bands: int, tag: int) -> np.ndarray:
    """Band keys (texts, bands) of texts that have at least one trigram each."""
    rng = np.random.default_rng(5)
    mul = rng.integers(1, 2**32, rows * bands, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, rows * bands, dtype=np.uint64).astype(np.uint32)
    begin = np.cumsum(sizes) - sizes
    out = np.full((len(sizes), bands), np.uint64(tag)) + np.arange(bands, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for band in range(bands):
        for k in range(band * rows, band * rows + rows):
            h = grams * mul[k] + add[k]
            h = np.minimum.reduceat(h ^ (h >> np.uint32(15)), begin).astype(np.uint64)
            out[:, band] = (out[:, band] ^ h) * np.uint64(0x9E3779B97F4A7C15)
            out[:, band] ^= out[:, band] >> np.uint64(29)
    return out.view(np.int64)


def band_keys(title: list[str], sur: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the records with a surname, their band keys of title with surname, band keys of the title alone of all records)."""
    g, n = _trigrams(title, 1)
    alone = _keys(g, n, TITLE_ROWS, TITLE_BANDS, 2) if len(title) else np.zeros((0, TITLE_BANDS), np.int64)
    known = np.array([i for i, s in enumerate(sur) if s], np.int64)
    if not len(known):
        return known, np.zeros((0, BANDS), np.int64), alone
    gs, ns = _trigrams([sur[i] for i in known], 2)
    owner = np.concatenate([np.repeat(np.arange(len(title)), n), np.repeat(known, ns)])
    both = np.concatenate([g, gs])
    keep = np.isin(owner, known)
    order = np.argsort(owner[keep], kind="stable")
    return known, _keys(both[keep][order], n[known] + ns, ROWS, BANDS, 1), alone


def blocks(classes: DataFrame, side: str) -> DataFrame:
    """(c, kind, key) of classes: kind 0 ISBN, 1 title with surname, 2 and 3 title alone.

    Titles alone meet only where a side knows no author: kind 2 are sources without one and all targets, kind 3 all other
    sources and targets without one.
    """

    def keyed(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            known, both, alone = band_keys(pdf["flat"].tolist(), pdf["sur"].tolist())
            c = pdf["c"].to_numpy()
            states = np.isin(np.arange(len(c)), known)
            parts = [(c[known], 1, both)]
            if side == "s":
                parts += [(c[~states], 2, alone[~states]), (c[states], 3, alone[states])]
            else:
                parts += [(c, 2, alone), (c[~states], 3, alone[~states])]
            yield pd.concat([pd.DataFrame({"c": np.repeat(x, k.shape[1]), "kind": kind, "key": k.ravel()}) for x, kind, k in parts])

    flat = classes.where("t IS NOT NULL").select("c", F.array_join("words", " ").alias("flat"), F.nullif("sur", F.lit("")).alias("sur")).where("flat <> ''")
    return flat.mapInPandas(keyed, "c long, kind int, key long").unionByName(classes.where("code IS NOT NULL").select("c", F.lit(0).alias("kind"), F.xxhash64("code").alias("key")))


FEATURES = ("bias", "title_far", "title_words", "rest_far", "title_cut", "vol_same", "vol_differ", "vol_one", "author_unknown", "sur_far", "ini_differ", "isbn_same", "isbn_differ", "shared_title")


def features(pairs: DataFrame) -> DataFrame:
    """Adds the feature columns to pairs that carry both sides' attributes (s_*, t_*) and `authors`, the authors of the title."""
    far = lambda a, b: F.when(F.greatest(F.length(a), F.length(b)) > 0, F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(1.0)
    a, b = F.coalesce("s_t", F.lit("")), F.coalesce("t_t", F.lit(""))
    na, nb = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    words = F.when(F.greatest(F.size("s_words"), F.size("t_words")) > 0, F.size(F.array_intersect("s_words", "t_words")) / F.greatest(F.size("s_words"), F.size("t_words"))).otherwise(0.0)
    shorter, longer = F.when(F.length(na) <= F.length(nb), na).otherwise(nb), F.when(F.length(na) <= F.length(nb), nb).otherwise(na)
    cut = (F.length(shorter) >= 10) & (F.levenshtein(shorter, F.substring(longer, F.lit(1), F.length(shorter))) <= 2)
    sur_known = F.col("s_sur").isNotNull() & F.col("t_sur").isNotNull()
    # letters in any order: a title whose words changed places is still near
    tokens = lambda c: F.array_join(F.array_sort(c), "")
    title_far = F.least(far(na, nb), far(tokens("s_words"), tokens("t_words")))
    # the words that only one side has, against each other: a slip leaves them alike, another work does not
    rest = far(F.array_join(F.array_except("s_words", "t_words"), ""), F.array_join(F.array_except("t_words", "s_words"), ""))
    rest = F.when(F.size(F.array_except("s_words", "t_words")) + F.size(F.array_except("t_words", "s_words")) == 0, 0.0).otherwise(rest)
    vol_cut = (F.col("s_vol") > 0) & (F.col("t_vol") > 0)
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return pairs.select(
        "*",
        F.lit(1.0).alias("bias"),
        title_far.alias("title_far"),
        words.alias("title_words"),
        rest.alias("rest_far"),
        number(cut).alias("title_cut"),
        number(F.col("s_vol") == F.col("t_vol")).alias("vol_same"),
        number(vol_cut & (F.col("s_vol") != F.col("t_vol"))).alias("vol_differ"),
        number(((F.col("s_vol") > 0) != (F.col("t_vol") > 0))).alias("vol_one"),
        number(~sur_known).alias("author_unknown"),
        F.when(sur_known, far(F.col("s_sur"), F.col("t_sur"))).otherwise(0.0).alias("sur_far"),
        number(sur_known & (F.col("s_ini") != F.col("t_ini"))).alias("ini_differ"),
        number(F.col("s_code") == F.col("t_code")).alias("isbn_same"),
        number(F.col("s_code") != F.col("t_code")).alias("isbn_differ"),
        F.when(sur_known, 0.0).otherwise(F.least(F.coalesce("authors", F.lit(1)), F.lit(5)) - 1.0).alias("shared_title"),
    )


def weak_label() -> Column:
    """1, 0 or null: what labelling functions say of a pair from its features."""
    near = ((F.col("title_far") <= 0.12) & (F.col("rest_far") <= 0.5)) | ((F.col("title_cut") == 1) & (F.col("title_far") <= 0.6))
    far = (F.col("title_far") > 0.3) & (F.col("title_cut") == 0)
    same_author = (F.col("author_unknown") == 0) & (F.col("sur_far") <= 0.3) & (F.col("ini_differ") == 0)
    other_author = (F.col("author_unknown") == 0) & (F.col("sur_far") > 0.5)
    return (
        F.when((F.col("vol_differ") == 1) | (F.col("vol_one") == 1) | far | other_author, 0)
        .when(near & same_author, 1)
        .when(near & (F.col("author_unknown") == 1) & (F.col("isbn_same") == 1), 1)
        .when(near & (F.col("author_unknown") == 1) & (F.col("shared_title") >= 1), 0)
        .when(near & (F.col("author_unknown") == 1) & (F.col("shared_title") == 0), 1)
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + (penalty + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def match(source: DataFrame, target: DataFrame, source_cols: tuple[str, str, str, str], target_cols: tuple[str, str, str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(source_id, target_id, confidence, model) of record pairs with a confidence of at least `threshold`.

    model is "calibrated"; "fitted" if the labelled pairs left for calibration are all of one kind; "prior" if there are
    fewer than 20 labelled pairs or all are of one kind, so that hand-set weights stand in and confidences are no more than
    an order.

    The columns are (id, title, author, isbn). Rows with a null id are ignored; nulls and blanks elsewhere mean "not
    stated"; a row sent twice counts once, and an id with several different rows matches through each of them (the best
    confidence counts). Empty tables give an empty result. Other columns are ignored.
    """
    spark = source.sparkSession
    scratch = Scratch(spark, "entities")
    sides = {}
    cols = ["t", "words", "vol", "sur", "ini", "code"]
    for name, df, c in (("s", source, source_cols), ("t", target, target_cols)):
        rows = scratch.keep(attributes(df, *c).withColumn("h", F.xxhash64("t", "vol", "sur", "ini", "code")).withColumn("h2", F.hash("t", "vol", "sur", "ini", "code")))
        one = scratch.keep(rows.groupBy("h", "h2").agg(*[F.first(x).alias(x) for x in cols]).withColumn("c", F.monotonically_increasing_id()))
        member = scratch.keep(rows.select("id", "h", "h2").join(one.select("h", "h2", "c"), ["h", "h2"]).select("id", "c").distinct())
        scratch.drop(rows)
        sides[name] = (one, member, scratch.keep(blocks(one, name)))
    s_cls, s_mem, s_key = sides["s"]
    t_cls, t_mem, t_key = sides["t"]
    # How many authors the whole corpus knows for a title.
    by_title = s_cls.select("t", "vol", "sur").unionByName(t_cls.select("t", "vol", "sur")).where("t IS NOT NULL AND sur IS NOT NULL")
    authors = by_title.groupBy("t").agg(F.count_distinct(F.concat(F.substring("sur", 1, 2), F.substring("sur", -2, 2))).cast("int").alias("authors"))
    joined = s_key.withColumnRenamed("c", "s_c").join(t_key.withColumnRenamed("c", "t_c"), ["kind", "key"])
    candidates = joined.select("s_c", "t_c").distinct()
    pairs = (
        candidates.join(s_cls.select(F.col("c").alias("s_c"), F.col("h").alias("s_h"), *[F.col(x).alias(f"s_{x}") for x in cols]), "s_c")
        .join(t_cls.select(F.col("c").alias("t_c"), F.col("h").alias("t_h"), *[F.col(x).alias(f"t_{x}") for x in cols]), "t_c")
        .join(authors.select(F.col("t").alias("s_t"), F.col("authors").alias("sa")), "s_t", "left")
        .join(authors.select(F.col("t").alias("t_t"), F.col("authors").alias("ta")), "t_t", "left")
        .withColumn("authors", F.greatest(F.coalesce("sa", F.lit(1)), F.coalesce("ta", F.lit(1))))
    )
    scored = scratch.keep(features(pairs).select("s_c", "t_c", F.xxhash64("s_h", "t_h").alias("draw"), *FEATURES))
    scratch.drop(s_key)
    scratch.drop(t_key)
    # drawn by a hash of what the records state, so the model does not depend on the partitioning
    sample = scored.withColumn("label", weak_label()).where("label IS NOT NULL").orderBy("draw", *FEATURES).limit(TRAIN).select(*FEATURES, "label").toPandas()
    w, learned = weights(sample)
    z = sum((F.col(f) * F.lit(float(v)) for f, v in zip(FEATURES, w)), F.lit(0.0))
    kept = scored.withColumn("confidence", F.round(1 / (1 + F.exp(-z)), 4)).where(F.col("confidence") >= threshold).select("s_c", "t_c", "confidence")
    out = kept.join(s_mem.select(F.col("id").alias("source_id"), F.col("c").alias("s_c")), "s_c").join(t_mem.select(F.col("id").alias("target_id"), F.col("c").alias("t_c")), "t_c")
    return out.groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence")).withColumn("model", F.lit(learned))


def weights(sample: pd.DataFrame) -> tuple[np.ndarray, str]:
    """Logistic weights fitted on one half of the labelled sample, with Platt scaling fitted on the other half folded in, and how far that went."""
    if len(sample) < 20 or sample["label"].nunique() < 2:
        # too little to learn from: the labelling functions' own order of importance
        prior = dict(bias=4.0, title_far=-30.0, title_words=2.0, rest_far=-4.0, title_cut=4.0, vol_same=1.0, vol_differ=-12.0, vol_one=-8.0, author_unknown=-1.0, sur_far=-14.0, ini_differ=-4.0, isbn_same=3.0, isbn_differ=0.0, shared_title=-5.0)
        return np.array([prior[f] for f in FEATURES]), "prior"
    x, y = sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float)
    half = np.arange(len(y)) % 2 == 0
    w = fit_logistic(x[half], y[half])
    z = x[~half] @ w
    if len(set(y[~half])) < 2:
        return w, "fitted"
    a, b = fit_logistic(np.stack([z, np.ones_like(z)], 1), y[~half], penalty=0.01)
    w = w * a
    w[0] += b
    return w, "calibrated"
