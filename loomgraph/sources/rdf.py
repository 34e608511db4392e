"""Reading and writing graphs: N-Triples by line, a Turtle subset by file, wide CSV, provenance side tables."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ALT_LABEL, RDF, XSD, as_graph

TERM = r'(?:<([^<>"{}|^`\\\s]*)>|(_:[^\s]+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)'
NT_LINE = r"^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+" + TERM + r"\s*\.\s*(?:#.*)?$"


def unescape(c: Column) -> Column:
    """Backslash escapes of a literal; \\u escapes are decoded too."""
    marked = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    coded = F.regexp_extract_all(marked, F.lit(r"\\u([0-9A-Fa-f]{4})"), F.lit(1))
    plain = F.aggregate(coded, marked, lambda acc, h: F.replace(acc, F.concat(F.lit("\\u"), h), F.decode(F.unhex(h), "UTF-16BE")))
    return F.replace(plain, F.lit("\x00"), F.lit("\\"))


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parse_ntriples(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(graph, corrupt lines) of N-Triples text, in the JVM; comments and empty lines are skipped."""
    x = lines.select(F.col(col).alias("line")).where("length(trim(line)) > 0 AND NOT startswith(trim(line), '#')")
    g = lambda n: F.regexp_extract("line", NT_LINE, n)
    ok = F.col("line").rlike(NT_LINE)
    lit = F.when((g(4) == "") & (g(5) == ""), unescape(g(6)))
    iri = F.col("line").rlike(r"^\s*\S+\s+\S+\s+<")
    bnode = g(5) != ""
    t = x.where(ok).select(
        F.when(g(1) != "", g(1)).otherwise(g(2)).alias("s"),
        g(3).alias("p"),
        F.when(iri, g(4)).when(bnode, g(5)).otherwise(lit).alias("o"),
        F.when(iri, "iri").when(bnode, "bnode").otherwise("literal").alias("k"),
        F.when(~iri & ~bnode, F.when(g(7) != "", g(7)).when(g(8) != "", RDF + "langString").otherwise(XSD + "string")).alias("dt"),
        F.when(~iri & ~bnode & (g(8) != ""), g(8)).alias("lang"),
    )
    return as_graph(t), x.where(~ok)


_TOKEN = re.compile(r"""\s*(?:\#[^\n]*\n|(@prefix|@base|PREFIX|BASE)\b|(<[^<>\s]*>)|("{3}(?:.|\n)*?"{3}|"(?:[^"\\\n]|\\.)*")|(@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(\^\^)|(_:[\w.-]*\w)|([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false)\b|(a)(?=\s)|([\w.-]*:(?:[\w.%-]*[\w%-])?)|([\[\];,.()]))""")


def turtle_triples(text: str) -> list[tuple]:
    """Triples of the usual Turtle: prefixes, base, lists of predicates and objects, blank nodes in brackets, literals."""
    prefixes: dict[str, str] = {}
    base, pos, toks = "", 0, []
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            if text[pos:].strip() == "":
                break
            raise ValueError(f"can't read Turtle at {text[pos:pos + 40]!r}")
        pos = m.end()
        if m.lastindex:
            toks.append((m.lastindex, m.group(m.lastindex)))
    out, i, blank = [], 0, 0

    def iri(tok: tuple[int, str]) -> str:
        kind, v = tok
        if kind == 2:
            v = v[1:-1]
            return v if re.match(r"[A-Za-z][\w+.-]*:", v) else base + v
        if kind == 9:
            return RDF + "type"
        name, local = v.split(":", 1)
        return prefixes[name] + local

    def node(i: int) -> tuple[tuple, int]:
        nonlocal blank
        kind, v = toks[i]
        if kind in (2, 9, 10):
            return (iri(toks[i]), "iri", None, None), i + 1
        if kind == 6:
            return (v, "bnode", None, None), i + 1
        if kind == 3:
            s = v[3:-3] if v.startswith('"""') else v[1:-1]
            s = re.sub(r'\\(u[0-9A-Fa-f]{4}|.)', lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)
            if i + 1 < len(toks) and toks[i + 1][0] == 4:
                return (s, "literal", RDF + "langString", toks[i + 1][1][1:]), i + 2
            if i + 1 < len(toks) and toks[i + 1][0] == 5:
                return (s, "literal", iri(toks[i + 2]), None), i + 3
            return (s, "literal", XSD + "string", None), i + 1
        if kind == 7:
            return (v, "literal", XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"), None), i + 1
        if kind == 8:
            return (v, "literal", XSD + "boolean", None), i + 1
        if v == "[":
            blank += 1
            name = f"_:g{blank}"
            if toks[i + 1][1] == "]":
                return (name, "bnode", None, None), i + 2
            i = statements(name, i + 1)
            return (name, "bnode", None, None), i + 1
        raise ValueError(f"unexpected {v!r}")

    def statements(s: str, i: int) -> int:
        while True:
            p = iri(toks[i])
            i += 1
            while True:
                o, i = node(i)
                out.append((s, p, *o))
                if i < len(toks) and toks[i][1] == ",":
                    i += 1
                    continue
                break
            while i < len(toks) and toks[i][1] == ";":
                i += 1
            if i >= len(toks) or toks[i][1] in (".", "]"):
                return i

    while i < len(toks):
        kind, v = toks[i]
        if kind == 1:
            if "prefix" in v.lower():
                prefixes[toks[i + 1][1][:-1]] = toks[i + 2][1][1:-1]
                i += 3
            else:
                base = toks[i + 1][1][1:-1]
                i += 2
            if i < len(toks) and toks[i][1] == ".":
                i += 1
            continue
        s, i = node(i)
        if toks[i][1] != ".":
            i = statements(s[0], i)
        i += 1
    return out


def parse_files(files: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(graph, failed files) of whole files (path, content) in Turtle or N-Triples; a file that can't be read is reported, not fatal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["_t"]):
                try:
                    rows += [(path, *t, None) for t in turtle_triples(body)]
                except Exception as e:  # whatever is wrong with one file must not end the others
                    rows.append((path, None, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "s", "p", "o", "k", "dt", "lang", "error"])

    x = files.select("path", F.col(text).alias("_t")).mapInPandas(run, "path string, s string, p string, o string, k string, dt string, lang string, error string")
    return as_graph(x.where("error IS NULL")), x.where("error IS NOT NULL").select("path", "error")


def read_graph(spark: SparkSession, paths: str | list[str], format: str = "auto", drop_alt_labels: bool = True, strict: bool = False) -> DataFrame:
    """Union of files or directories. `auto` reads N-Triples by line if every line parses, else each file as Turtle.

    A line or file that cannot be read is left out with a warning, or an error if `strict`; `parse_ntriples` and
    `parse_files` give them as rows. A Turtle file is read by one task, as prefixes hold for the rest of the file: split very large ones.
    """
    bad = None
    if format in ("auto", "nt"):
        graph, corrupt = parse_ntriples(spark.read.text(paths))
        bad = corrupt
        if format == "auto" and not corrupt.isEmpty():
            format = "ttl"
    if format == "ttl":
        files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
        graph, bad = parse_files(files)
    if bad is not None and (first := bad.first()) is not None:
        if strict:
            raise ValueError(f"cannot be read: {first.asDict()}")
        warnings.warn(f"left out, as it cannot be read: {first.asDict()} and possibly more", stacklevel=2)
    return graph.where(F.col("p") != ALT_LABEL) if drop_alt_labels else graph


def ntriples(t: DataFrame) -> DataFrame:
    """One line of N-Triples per triple (column value)."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    suffix = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("dt").isNotNull() & (F.col("dt") != XSD + "string"), F.concat(F.lit("^^<"), "dt", F.lit(">"))).otherwise("")
    lit = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), suffix)
    o = F.when(F.col("k") == "literal", lit).otherwise(node("o"))
    return t.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write_ntriples(t: DataFrame, path: str) -> None:
    ntriples(t).write.mode("overwrite").text(path)


def write_wide_csv(t: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Wide table of a graph, ordered by label, else subject."""
    from ..operators.fusion import wide_table

    w = wide_table(t, columns)
    order = [F.coalesce("label_literal", "s")] if "label_literal" in w.columns else [F.col("s")]
    w.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_fusion(out: dict[str, DataFrame], path: str) -> None:
    """Graph and provenance of a fusion: N-Triples, selected and discarded as JSON, sameAs links."""
    write_ntriples(out["graph"], f"{path}/graph")
    for part in ("selected", "discarded"):
        if part in out:
            out[part].write.mode("overwrite").json(f"{path}/{part}")
    if "same_as" in out:
        write_ntriples(as_graph(out["same_as"]), f"{path}/prov")
