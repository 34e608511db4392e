"""Mapping free-entered values to a canonical list by a partition-based (pigeonhole) similarity join, in SQL functions
but for the counting of slips in pairs far apart.

1. Values are reduced to their distinct forms per list before anything else, so a value that a third of all rows share
   is handled once.
2. A form is cleaned (wrongly decoded letters of the list's own alphabet, invisible characters, case, accents,
   separators) and unfolded into variants: without a leading or trailing addition ("whose ...", "... (film)"), and with
   "B, A" turned into "A B".
3. Each entry of the list is cut into k+1 segments with one letter between them, so that a swap of neighbours harms no
   more than one. Within k slips at least one segment survives unharmed, at a position that is shifted by no more than the
   slips left over for it. The join is an equality join on (list, entry length, segment number, segment text).
4. Candidates are verified with the built-in levenshtein. A swap of neighbours costs two there but is one slip, so the
   slips are estimated as b + ceil((d - b) / 2), b being the letters that the two strings do not have in common. Beyond
   SURE edits the estimate is only a bound, and the slips of what passes it are counted in Arrow batches.
5. Forms without a match come out of an anti-join.

An entry accepts 0 slips up to 3 letters, 1 up to 5, 2 up to 9, and 3 beyond; from 10 to 13 letters
only if no other entry of its list is within `isolation` edits (names built from common syllables do not get the third). Nearest entry first; ties go to the form
with the least raw distance, then to the smaller term_id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, small

#: Slips up to which candidates are looked for, by length of the entry: (up to this length, slips). A slip is an edit or a
#: swap of neighbours.
SLIPS = ((3, 0), (5, 1), (9, 2), (10_000, 3))
SURE = ((9, 3), (10_000, 4))  # edits up to which slips are estimated, by length of the entry; beyond, where letters may have moved further, they are counted
ISOLATION = 5
ALPHABET = 2000  # different letters outside ASCII that a list may have

# Additions around a value that do not change what it means.
LEADING = ("the", "its", "was", "has", "whose", "dbx", "onto", "is", "in", "a", "an")
TRAILING_ONE = ("ltd", "name", "film", "the", "inc", "gmbh")
TRAILING_TWO = ("et al",)
TRAILING_THREE = ("place or firm", "of the work")

# Letters without their marks where decomposition does not give them.
PLAIN = {"ø": "o", "ł": "l", "đ": "d", "ß": "s", "æ": "a", "œ": "o", "ð": "d", "þ": "t", "ı": "i", "0": "o", "1": "l"}


def _fold_table(letters: set[str]) -> tuple[str, str]:
    src, dst = "", ""
    for ch in sorted(letters):
        low = PLAIN.get(ch) or unicodedata.normalize("NFKD", ch)[0]
        if low != ch:
            src, dst = src + ch, dst + low
    return src, dst


#: Latin letters with marks, by rule: every lower-case letter of the two Latin blocks that has a plain base letter.
LETTERS = {chr(c).lower() for c in range(0xC0, 0x250) if chr(c).isalpha() and len(chr(c).lower()) == 1} | set(PLAIN)
FOLD = _fold_table({c for c in LETTERS if PLAIN.get(c) or unicodedata.normalize("NFKD", c)[0].isascii()})


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}", ""), *FOLD)


def garbled(ch: str) -> str:
    """`ch` as its UTF-8 bytes look in the Western single-byte encoding."""
    out = ""
    for b in ch.encode("utf-8"):
        try:
            out += bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            out += chr(b)
    return out


def repaired(c: Column, alphabet: list[str]) -> Column:
    """`c` with the garbled letters of `alphabet` put right (`alphabet`: the marked letters of the list, a bounded set)."""
    once = {garbled(ch): ch for ch in alphabet}
    twice = {"".join(garbled(x) if not x.isascii() else x for x in g): ch for g, ch in once.items()}
    out = c
    for g, ch in sorted({**once, **twice}.items(), key=lambda x: -len(x[0])):
        out = F.replace(out, F.lit(g), F.lit(ch))
    # garbled letters are never plain ASCII, so most values skip the whole chain
    return F.when(c.rlike(r"[^\x00-\x7f]"), out).otherwise(c)


def cleaned(c: Column) -> Column:
    """Words of a value in plain lower-case letters, separated by one blank; a comma stays as a word of its own."""
    c = F.regexp_replace(c, r"\p{Cf}", "")
    c = F.regexp_replace(c, r"\[\d+\]|\(\?\)", " ")
    c = F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    c = fold(c)
    c = F.regexp_replace(c, r"[^\p{L}\p{N}&,]+", " ")
    c = F.regexp_replace(c, r"\s*,[\s,]*", " , ")
    return F.regexp_replace(F.trim(c), r"^[, ]+|[, ]+$", "")


def _near(c: Column, words: tuple[str, ...], edits: int) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | (F.levenshtein(c, F.lit(w)) <= F.lit(edits if len(w) >= 3 else 0))
    return hit


def _steps(x: Column) -> list[Column]:
    first = F.substring_index(x, " ", 1)
    tail = lambda n: F.substring_index(x, " ", -n)
    cut = lambda n: F.trim(F.substring(x, F.lit(1), F.length(x) - F.length(tail(n))))
    lead = F.when(_near(first, LEADING, 1), F.trim(F.substring(x, F.length(first) + 1, F.length(x)))).otherwise(x)
    trail = (
        F.when(_near(tail(3), TRAILING_THREE, 2), cut(3)).when(_near(tail(2), TRAILING_TWO, 1), cut(2)).when(_near(tail(1), TRAILING_ONE, 1), cut(1)).otherwise(x)
    )
    turned = F.when(F.instr(x, " , ") > 0, F.concat_ws(" ", F.substring_index(x, " , ", -1), F.substring(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, " , ", -1)) - 3))).otherwise(x)
    glued = F.regexp_replace(x, r"^(whose|the|has|was|its|dbx|onto)(?=\p{L}{4})", "")
    return [x, lead, trail, turned, glued]


def variants(c: Column, rounds: int = 3) -> Column:
    """Distinct compact variants of a cleaned value."""
    out = F.array(c)
    for _ in range(rounds):
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: F.array(*_steps(x)))))
    return F.array_distinct(F.filter(F.transform(out, lambda x: F.regexp_replace(x, r"[ ,]+", "")), lambda x: F.length(x) > 0))


def slips_for(length: Column) -> Column:
    out = F.lit(SLIPS[-1][1])
    for upto, k in reversed(SLIPS[:-1]):
        out = F.when(length <= upto, F.lit(k)).otherwise(out)
    return out


def segments(entries: DataFrame, gap: int = 0) -> DataFrame:
    """Each entry `ref` of length `n` with `k`, cut into k+1 segments with `gap` letters between them: (list, n, k, i, p, w, seg); the last ones are the longer ones."""
    e = entries.withColumn("i", F.explode(F.expr("sequence(0, k)")))
    base = F.expr(f"greatest(0, n - k * {gap}) div (k + 1)")
    longer = F.expr(f"greatest(0, n - k * {gap}) % (k + 1)")
    start = F.col("i") * (base + gap) + F.greatest(F.lit(0), F.col("i") - (F.col("k") + 1 - longer)) + 1
    width = base + (F.col("i") >= (F.col("k") + 1 - longer)).cast("int")
    e = e.withColumn("p", start.cast("int")).withColumn("w", width.cast("int"))
    return e.where("w > 0").withColumn("seg", F.expr("substring(ref, p, w)"))


def similar(values: DataFrame, entries: DataFrame, swaps: bool = False) -> DataFrame:
    """Pairs (list, x, ref, d) of values `x` and entries `ref` (columns list, ref, n, k) within k edits, by segments.

    With `swaps` all pairs within k slips are among the result, and none beyond 2 k edits; entries then need 2 k + 1 letters.
    """
    seg = segments(entries, int(swaps))
    shape = seg.select("list", "n", "k", "i", "p", "w").distinct()
    # Every value is taken apart into very many more rows: a number of partitions of its own keeps small tables from being one task.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = values.select("list", "x", F.length("x").alias("m")).distinct().repartition(tasks, "x")
    # Windows of the positions at which a segment can survive: i edits before it and k - i after it.
    probe = (
        v.join(small(shape), "list")
        .where("abs(m - n) <= k")
        .withColumn("lo", F.expr("greatest(1, p - i, p + (m - n) - (k - i))"))
        .withColumn("hi", F.expr("least(m - w + 1, p + i, p + (m - n) + (k - i))"))
        .where("lo <= hi")
        .select("list", "x", "n", "i", F.explode(F.expr("transform(sequence(lo, hi), s -> substring(x, s, w))")).alias("seg"))
        .distinct()
    )
    hits = probe.join(small(seg.select("list", "n", "k", "i", "seg", "ref")), ["list", "n", "i", "seg"]).select("list", "x", "ref", "k").distinct()
    return hits.withColumn("d", F.levenshtein("x", "ref")).where("d <= 2 * k" if swaps else "d <= k").drop("k")


def _shared(a: str, b: str) -> str:
    count = lambda s: f"(length({s}) - length(replace({s}, ch, '')))"
    return f"aggregate(array_distinct(split({b}, '')), 0, (acc, ch) -> acc + IF(ch = '', 0, least({count(a)}, {count(b)})))"


def slips_between(a: str, b: str) -> int:
    """Edits of which a swap of neighbours is one (optimal string alignment)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            least = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, before[j - 2] + 1)
            new.append(least)
        before, row = row, new
    return row[-1]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with the slips of those beyond SURE edits counted instead of estimated."""
    for pdf in batches:
        far = [slips_between(x, r) if d > next(k for upto, k in SURE if len(r) <= upto) else s for x, r, d, s in zip(pdf["x"], pdf["ref"], pdf["d"], pdf["slips"])]
        yield pdf.assign(slips=pd.Series(far, index=pdf.index, dtype="int32"))


def map_to_canonical(forms: DataFrame, terms: DataFrame, isolation: int = ISOLATION) -> DataFrame:
    """(list, form, term_id) for every distinct (list, form) of `forms`; term_id 0 where the list has no entry for it.

    `terms` has (list, term_id, label), one row for each label or alternative label. Null and blank forms give no row;
    repeated rows and other columns have no effect; an empty list maps every form to 0; very long forms are matched like
    any other (no entry is near them); of equally near terms the smallest term_id is taken.
    """
    spark = forms.sparkSession
    scratch = Scratch(spark, "canonical")
    terms = terms.select("list", F.col("term_id").cast("long").alias("term_id"), "label").where("label IS NOT NULL").distinct()
    marked = terms.select(F.explode(F.split(F.regexp_replace("label", r"[\x00-\x7f]", ""), "")).alias("ch")).where("ch <> ''").distinct().limit(ALPHABET + 1).collect()
    if len(marked) > ALPHABET:
        raise ValueError(f"the list has more than {ALPHABET} different letters outside ASCII: too many to look for in garbled form")
    alphabet = sorted({r.ch for r in marked} | {r.ch.upper() for r in marked if len(r.ch.upper()) == 1} | {" ", "​", "–", "’", "­"})
    named = scratch.keep(
        terms.withColumn("ref", F.regexp_replace(cleaned(F.col("label")), r"[ ,]+", "")).where("ref <> ''").withColumn("n", F.length("ref")).withColumn("k", slips_for(F.col("n")))
    )
    entries = named.select("list", "ref", "n", "k").distinct()
    forms = forms.select("list", "form").where(r"form RLIKE '[^\\s\\p{Z}\\p{Cf}\\p{Cc}]'").distinct()
    unfolded = scratch.keep(forms.withColumn("x", F.explode(variants(cleaned(repaired(F.col("form"), alphabet))))))

    exact = unfolded.join(small(entries.select("list", F.col("ref").alias("x"))), ["list", "x"]).select("list", "form", F.col("x").alias("ref"), F.lit(0).alias("slips"))
    exact = scratch.keep(exact)
    rest = unfolded.join(exact.select("list", "form").distinct(), ["list", "form"], "left_anti")
    pairs = similar(rest, entries, swaps=True)
    # How far an entry is from the next one of another term: the list joined with itself in the same way.
    near = similar(entries.select("list", F.col("ref").alias("x")), entries.select("list", "ref", "n", F.when(F.col("n") >= isolation + 1, F.lit(isolation - 1)).otherwise(2 * F.col("k")).alias("k")))
    by = named.select("list", "ref", "term_id").distinct()
    crowded = (
        near.where("x <> ref")
        .join(by, ["list", "ref"])
        .join(by.select("list", F.col("ref").alias("x"), F.col("term_id").alias("other")), ["list", "x"])
        .where("term_id <> other")
        .select("list", "ref")
        .distinct()
        .withColumn("crowded", F.lit(True))
    )
    crowded = scratch.keep(crowded)
    fuzzy = (
        pairs.withColumn("b", F.expr(f"greatest(length(x), length(ref)) - {_shared('x', 'ref')}"))
        .withColumn("slips", F.expr("CAST(b + ceil((d - b) / 2.0) AS INT)"))
        .join(small(crowded), ["list", "ref"], "left")
        .withColumn("n", F.length("ref"))
        .select("list", "x", "ref", "d", "slips", F.expr("CASE WHEN n <= 3 THEN 0 WHEN n <= 5 THEN 1 WHEN n <= 9 OR (crowded AND n < 14) THEN 2 ELSE 3 END").alias("most"))
        .where("slips <= most")
    )
    fuzzy = fuzzy.mapInPandas(_counted, fuzzy.schema).where("slips <= most").select("list", "x", "ref", "slips")
    fuzzy = rest.join(fuzzy, ["list", "x"]).select("list", "form", "ref", "slips")
    best = (
        exact.unionByName(fuzzy)
        .join(small(named.select("list", "ref", "term_id", "label")), ["list", "ref"])
        .groupBy("list", "form")
        .agg(F.min(F.struct("slips", F.levenshtein(F.lower("form"), F.lower("label")).alias("raw"), "term_id")).alias("best"))
        .select("list", "form", F.col("best.term_id").alias("term_id"))
    )
    best = scratch.keep(best)
    none = forms.join(best, ["list", "form"], "left_anti").withColumn("term_id", F.lit(0).cast("long"))
    return best.unionByName(none)
