"""Graphs from tables and nested JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import LABEL, TYPE, XSD, as_graph

NODES = "doc string, path string, parent string, key string, value string, kind string, hash string, label string, own string"


def table_triples(df: DataFrame, cls: str, key: str, resource: str, namespace: str, label: str | None = None, literals: dict[str, str] | None = None, edges: dict[str, str] | None = None) -> DataFrame:
    """Rows of a table as triples in one scan: type, label, literals {column: xsd name} and edges {column: target table}."""
    s = F.concat(F.lit(f"{resource}{df_name(cls)}/"), F.col(key).cast("string"))
    t = lambda p, o, k, dt=None: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("k"), F.lit(dt).cast("string").alias("dt"))
    rows = [t(TYPE, F.lit(namespace + cls), "iri")]
    if label:
        rows.append(t(LABEL, F.col(label), "literal", XSD + "string"))
    rows += [t(namespace + c, F.col(c).cast("string"), "literal", XSD + x) for c, x in (literals or {}).items()]
    rows += [t(namespace + c, F.concat(F.lit(f"{resource}{target}/"), F.col(c).cast("string")), "iri") for c, target in (edges or {}).items()]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("o IS NOT NULL")


def df_name(cls: str) -> str:
    return cls.lower()


def flatten_json(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Nodes of nested JSON of any depth: one row per value with its path, parent path, key, kind, label and `own`, the path of the nearest dict above it.

    kind: dict, list, string, number, boolean, null; malformed documents give one row of kind `corrupt`. Dicts carry the
    md5 of their content (keys sorted) and a label: a value under one of the usual keys, else the shortest short string.
    """

    def walk(name: str, value, path: str, parent: str, key: str, own: str | None) -> Iterator[tuple]:
        if isinstance(value, dict):
            flat = {k: str(v) for k, v in value.items() if isinstance(v, (str, int, float)) and not isinstance(v, bool)}
            label = next((flat[k] for k in ("name", "label", "title", "prefLabel", "fullName") if flat.get(k)), None)
            if label is None:
                short = [v for v in flat.values() if 0 < len(v) <= 80 and not v.replace(".", "").isdigit()]
                label = min(short, key=lambda v: (len(v), v)) if short else None
            digest = hashlib.md5(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
            yield (name, path, parent, key, None, "dict", digest, label, own)
            for k in value:
                yield from walk(name, value[k], f"{path}.{k}", path, k, path)
        elif isinstance(value, list):
            yield (name, path, parent, key, None, "list", None, None, own)
            for i, v in enumerate(value):
                yield from walk(name, v, f"{path}[{i}]", path, key, own)
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
            shown = None if value is None else json.dumps(value) if kind != "string" else value
            yield (name, path, parent, key, shown, kind, None, None, own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, text_ in zip(pdf["_d"], pdf["_t"]):
                try:
                    rows += walk(str(name), json.loads(text_), "$", "", "", None)
                except (ValueError, TypeError):
                    rows.append((str(name), "$", "", "", text_, "corrupt", None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return docs.select(F.col(doc).cast("string").alias("_d"), F.col(text).alias("_t")).mapInPandas(run, NODES)


def json_paths(nodes: DataFrame, with_type: bool = False) -> DataFrame:
    """(doc, path) with list positions as [*], optionally with the type of the value."""
    p = F.regexp_replace("path", r"\[\d+\]", "[*]")
    return nodes.where("kind NOT IN ('dict', 'list', 'corrupt')").select("doc", (F.concat(p, F.lit(":"), F.col("kind")) if with_type else p).alias("path")).distinct()


def json_triples(nodes: DataFrame, resource: str, namespace: str, heuristic: bool = True, by_kind: bool = False, typed: bool = True) -> dict[str, DataFrame]:
    """Triples of flattened JSON: {graph, entities, relations, sameas}.

    Dicts become entities named by the md5 of their content (with the class of their key, if `by_kind`), so equal objects
    merge. A scalar becomes a literal, or, if `heuristic` finds it more like an object, an entity named by the md5 of its
    text and labelled with it. Values of a list, and of lists in it, belong to the node that holds the list. `entities` and `relations` say
    where each node and property came from.
    """
    ns = F.lit(namespace)
    cls = F.when(F.col("key") == "", F.lit("Root")).otherwise(T.class_name(F.col("key")))
    iri = lambda h: F.concat(F.lit(resource), *([cls, F.lit("/")] if by_kind else []), h)
    score = T.object_score(F.col("value"), F.lit(False), F.lit(False), F.lit(0.0))
    scalar_object = F.col("kind").isin("string") & (score >= 0.5) if heuristic else F.lit(False)
    node = nodes.where("kind NOT IN ('list', 'null', 'corrupt')").withColumn("is_obj", (F.col("kind") == "dict") | scalar_object)
    node = node.withColumn("iri", F.when(F.col("kind") == "dict", iri(F.col("hash"))).when(F.col("is_obj"), iri(F.md5("value"))))
    node = node.withColumn("label", F.when(F.col("kind") == "dict", F.col("label")).when(F.col("is_obj"), F.col("value")))
    # the owner of a value: the nearest dict above it, whatever lists lie between
    holder = nodes.where("kind = 'dict'").select("doc", F.col("path").alias("own"), iri(F.col("hash")).alias("s"))
    edge = node.where("path <> '$'").join(holder.select("doc", "own", "s"), ["doc", "own"])
    prop = F.concat(ns, T.key_name(F.col("key")))
    lit_type = F.when(F.col("kind") == "boolean", XSD + "boolean").otherwise(T.literal_type(F.col("value")))
    links = edge.select("s", prop.alias("p"), F.when(F.col("is_obj"), F.col("iri")).otherwise(F.col("value")).alias("o"), F.when(F.col("is_obj"), "iri").otherwise("literal").alias("k"), F.when(~F.col("is_obj"), lit_type).alias("dt"))
    objects = node.where("is_obj")
    labels = objects.where("label IS NOT NULL").select(F.col("iri").alias("s"), F.lit(LABEL).alias("p"), F.col("label").alias("o"), F.lit("literal").alias("k"), F.lit(XSD + "string").alias("dt"))
    graph = links.unionByName(labels)
    if typed:
        graph = graph.unionByName(objects.select(F.col("iri").alias("s"), F.lit(TYPE).alias("p"), F.concat(ns, cls).alias("o"), F.lit("iri").alias("k"), F.lit(None).cast("string").alias("dt")))
    return {
        "graph": as_graph(graph),
        "entities": objects.select(F.col("doc").alias("file"), F.col("path").alias("json_path"), "iri"),
        "relations": node.where("key <> ''").select("key", prop.alias("iri")).distinct(),
    }


def json_document_triples(nodes: DataFrame) -> DataFrame:
    """Extraction-style triples of flattened JSON: (doc, subject, predicate, object, mapping); the root is the document."""
    owner = nodes.where("kind = 'dict'").select("doc", F.col("path").alias("own"), F.when(F.col("path") == "$", F.col("doc")).otherwise(F.sha2("hash", 256)).alias("subject"))
    val = nodes.where("kind NOT IN ('list', 'corrupt', 'null') AND path <> '$'")
    obj = F.when(F.col("kind") == "dict", F.sha2("hash", 256)).otherwise(F.col("value"))
    return val.join(owner, ["doc", "own"]).select("doc", "subject", F.col("key").alias("predicate"), obj.alias("object"), F.when(F.col("value").startswith("http"), F.col("value")).alias("mapping"))


def mapped_json(docs: DataFrame, mappings: list[tuple[str, str, str]], doc: str = "doc", text: str = "text", resource: str = "http://loom.example/resource/") -> DataFrame:
    """Triples by explicit mapping rows (JSON path, property, datatype or 'iri'), all read in the JVM."""
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.get_json_object(F.col(text), path).alias("o"), F.lit("iri" if dt == "iri" else "literal").alias("k"), F.lit(None if dt == "iri" else XSD + dt).cast("string").alias("dt")) for path, p, dt in mappings])
    out = docs.select(F.concat(F.lit(resource), F.col(doc).cast("string")).alias("s"), F.explode(rows).alias("r")).select("s", "r.*").where("o IS NOT NULL")
    return as_graph(out)


def linked_json(nodes: DataFrame, entity_links: DataFrame, property_links: DataFrame, properties: DataFrame, resource: str, min_score: float = 0.7) -> DataFrame:
    """Triples of flattened JSON against an existing graph: labels linked to entities and keys to properties from `min_score` on.

    entity_links (label, uri, score), property_links (key, uri, score). Unlinked keys are dropped, unlinked objects named
    by md5; the property's domain and range give types and datatypes.
    """
    ent = entity_links.where(F.col("score") >= min_score).groupBy("label").agg(F.max_by("uri", "score").alias("linked"))
    prop = property_links.where(F.col("score") >= min_score).groupBy("key").agg(F.max_by("uri", "score").alias("p"))
    info = F.broadcast(properties.select(F.col("uri").alias("p"), "domain", "range"))
    d = nodes.where("kind = 'dict'").join(ent, "label", "left").select("doc", F.col("path").alias("own"), "label", F.coalesce("linked", F.concat(F.lit(resource), F.col("hash"))).alias("s"))
    val = nodes.where("kind NOT IN ('list', 'null', 'corrupt') AND path <> '$'").drop("label")
    x = val.join(d, ["doc", "own"]).join(prop, "key").join(info, "p", "left")
    inner = d.select("doc", F.col("own").alias("path"), F.col("s").alias("node"))
    x = x.join(inner, ["doc", "path"], "left").join(ent.select(F.col("label").alias("value"), F.col("linked").alias("v_link")), "value", "left")
    is_obj = F.col("node").isNotNull() | (F.col("range").isNotNull() & ~F.col("range").startswith(XSD))
    o = F.coalesce("node", F.when(is_obj, F.coalesce("v_link", F.concat(F.lit(resource), F.md5("value")))), F.col("value"))
    t = lambda s, p, o_, k, dt: F.struct(s.alias("s"), p.alias("p"), o_.alias("o"), F.lit(k).alias("k"), dt.alias("dt"))
    none = F.lit(None).cast("string")
    rows = F.array(
        F.when(is_obj, t(F.col("s"), F.col("p"), o, "iri", none)).otherwise(t(F.col("s"), F.col("p"), o, "literal", F.coalesce("range", T.literal_type(F.col("value"))))),
        F.when(F.col("label").isNotNull(), t(F.col("s"), F.lit(LABEL), F.col("label"), "literal", F.lit(XSD + "string"))),
        F.when(F.col("domain").isNotNull(), t(F.col("s"), F.lit(TYPE), F.col("domain"), "iri", none)),
        F.when(is_obj & F.col("range").isNotNull(), t(o, F.lit(TYPE), F.col("range"), "iri", none)),
        F.when(is_obj & F.col("node").isNull(), t(o, F.lit(LABEL), F.col("value"), "literal", F.lit(XSD + "string"))),
    )
    return as_graph(x.select(F.explode(rows).alias("r")).where("r IS NOT NULL AND r.o IS NOT NULL").select("r.*"))
