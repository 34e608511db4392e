"""Scalar functions as Column builders: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"


def local_name(c: Column) -> Column:
    """Part after the last '#' or '/'."""
    return F.regexp_extract(c, r"([^#/]*)$", 1)


def simple_namespace(c: Column) -> Column:
    """Up to and with '#', else up to and with the last '/'."""
    return F.when(F.instr(c, "#") > 0, F.concat(F.substring_index(c, "#", 1), F.lit("#"))).otherwise(F.regexp_replace(c, r"[^/]*$", ""))


def uri_namespace(c: Column) -> Column:
    """Namespace of an IRI: scheme and host in lower case without user, port and `www.`; with a fragment the whole path and
    '#', else the path without its last segment; path segments percent-decoded. Null if it is no absolute IRI."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^[^@]*@|:\d+$", ""), r"^www\.", "")
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    parent = F.regexp_replace(decoded, r"/[^/]*$", "")
    tail = F.when(F.instr(c, "#") > 0, F.concat(decoded, F.lit("#"))).otherwise(F.concat(parent, F.lit("/")))
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, tail))


def clean_label(c: Column) -> Column:
    """Underscores as blanks, parts in round brackets removed, trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "_", " "), r"\([^)]*\)", ""))


def normalize_label(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, "_-", "  ")))


def key_name(c: Column) -> Column:
    """snake_case of a JSON key: camel case split, blanks as underscores, lower case."""
    split = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.trim(split), r"[\s\-]+", "_"))


def class_name(c: Column) -> Column:
    """PascalCase of a JSON key."""
    return F.array_join(F.transform(F.split(key_name(c), "_"), F.initcap), "")


def seed_uri(namespace: str, c: Column) -> Column:
    return F.concat(F.lit(namespace), F.sha2(c, 256))


def cache_key(*parts: Column) -> Column:
    """Short stable key over several values."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


FORMATS = {
    "integer": r"^\d+$",
    "double": r"^-?\d*\.?\d+$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "gYear": r"^\d{4}$",
    "gMonth": r"^--\d{2}$",
    "gDay": r"^---\d{2}$",
    "gYearMonth": r"^\d{4}-\d{2}$",
    "gMonthDay": r"^--\d{2}-\d{2}$",
}


def valid_datatype(value: Column, datatype: Column) -> Column:
    """Whether a lexical value has the format of an XSD datatype; other datatypes accept everything."""
    out = F.lit(True)
    for name, pattern in FORMATS.items():
        out = F.when(datatype == XSD + name, value.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def literal_type(value: Column) -> Column:
    """XSD datatype of an untyped lexical value."""
    return (
        F.when(F.lower(value).isin("true", "false"), XSD + "boolean")
        .when(value.rlike(r"^[+-]?\d+$"), XSD + "integer")
        .when(value.rlike(r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$"), XSD + "double")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), XSD + "date")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?"), XSD + "dateTime")
        .otherwise(XSD + "string")
    )


def looks_like_name(value: Column) -> Column:
    """Two or more words of which at least two begin with a capital."""
    words = F.split(F.trim(value), r"\s+")
    return (F.size(words) >= 2) & (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= 2)


def looks_like_enum(value: Column) -> Column:
    return value.rlike(r"^[A-Z0-9_]{2,20}$")


def object_score(value: Column, is_dict: Column, is_dict_list: Column, name_share: Column) -> Column:
    """Share of the evidence that a JSON value is an object rather than a literal: object / (object + literal)."""
    w = lambda cond, weight: F.when(cond, weight).otherwise(0.0)
    v = F.coalesce(value, F.lit(""))
    obj = w(is_dict, 1.0) + w(is_dict_list, 1.0) + F.coalesce(name_share, F.lit(0.0)) + w(looks_like_name(v), 0.6)
    lit = (
        w(v.rlike(r"^\d{4}-\d{2}-\d{2}"), 0.8)
        + w(v.rlike(r"^[+-]?\d[\d.,]*\s*(?:[a-zA-Z%]{1,4})?$"), 0.8)
        + w(v.rlike(r"^(?:https?://\S+|[^@\s]+@[^@\s]+\.[a-z]+|[0-9a-fA-F\-]{16,})$"), 0.8)
        + w(F.length(v) > 80, 0.6)
        + w(looks_like_enum(v), 0.6)
    )
    return obj / (obj + lit + 1e-9)


def find_label(entries: Column) -> Column:
    """Label of a map of strings: the first of the usual keys, else the shortest short value."""
    keys = ("name", "label", "title", "prefLabel", "fullName")
    named = F.coalesce(*[F.element_at(entries, k) for k in keys])
    short = F.filter(F.map_values(entries), lambda v: v.isNotNull() & F.length(v).between(1, 80))
    shortest = F.array_min(F.transform(short, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    return F.coalesce(named, shortest["v"])


def key_values(entries: Column) -> Column:
    """`k: v` of a map, sorted by key, joined by ` | `."""
    rows = F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(rows), " | ")


def property_text(label: Column, aliases: Column) -> Column:
    return F.when(F.size(aliases) > 0, F.concat(F.lit("label: "), label, F.lit("; altLabels: "), F.array_join(aliases, ", "))).otherwise(F.concat(F.lit("label: "), label))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a floor of 1e-12 under the norms."""
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Position between low and high, kept in 0..1; 0.5 where low = high."""
    return F.when(low == high, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0)))))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, `empty` where b is 0 or null."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(empty))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def offsets(text: Column, part: Column) -> Column:
    """(start, end) of a part in a text, counted from 0; start -1 where it is absent."""
    start = F.call_function("instr", text, part) - 1
    return F.struct(start.alias("start"), F.when(start >= 0, start + F.length(part)).otherwise(F.lit(-1)).alias("end"))


def verbalize(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws(" ", local_name(s), F.translate(local_name(p), "_", " "), F.when(o.startswith("http"), local_name(o)).otherwise(o))


def parse_default(c: Column) -> Column:
    """Datatype of a parameter default written as text: integer, boolean, number or string."""
    v = F.trim(c)
    return F.when(v.rlike(r"^[+-]?\d+$"), "integer").when(F.lower(v).isin("true", "false", "yes", "no"), "boolean").when(v.rlike(r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$"), "number").otherwise("string")
