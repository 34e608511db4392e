"""External extractors and text models behind one interface: off by default, injected by the caller, offline stubs for tests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ontology

Client = Callable[[str], str]

TRIPLES = "doc_id string, subject string, predicate string, object string, error string"


def run_client(docs: DataFrame, make_client: Callable[[], Client], prompt: str = "{text}", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, answer, error): one client per task, made there; an answer that fails is an error row, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_k"], pdf["_t"]):
                try:
                    rows.append((str(k), client(prompt.replace("{text}", t or "")), None))
                except Exception as e:
                    rows.append((str(k), None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["doc_id", "answer", "error"])

    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, "doc_id string, answer string, error string")


def parsed_triples(answers: DataFrame) -> DataFrame:
    """Triples of JSON answers ({"triples": [{subject, predicate, object}]}); malformed answers give none."""
    x = answers.where("answer IS NOT NULL").select("doc_id", F.explode(F.from_json("answer", "triples array<struct<subject:string,predicate:string,object:string>>").triples).alias("t"))
    return x.select("doc_id", "t.subject", "t.predicate", "t.object")


def tab_triples(lines: DataFrame, col: str = "value") -> DataFrame:
    """Tab-separated triples; a line without exactly three parts is an error."""
    f = F.split(col, "\t")
    part = lambda i: F.when(F.size(f) == 3, f[i]).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.col(col))).cast("string"))
    return lines.select(part(0).alias("subject"), part(1).alias("predicate"), part(2).alias("object"))


def ontology_snippet(o: Ontology, form: str = "lines") -> str:
    """The ontology as text for a prompt: lines, JSON, or signatures. Ontologies are small."""
    classes = [r["uri"] for r in o.classes.orderBy("uri").collect()]
    props = o.properties.orderBy("uri").collect()
    if form == "json":
        return json.dumps({"classes": classes, "properties": [{"uri": p["uri"], "domain": p["domain"], "range": p["range"]} for p in props]})
    if form == "signatures":
        return "\n".join(f"{p['label'] or p['uri']}({p['domain'] or 'any'}, {p['range'] or 'any'})" for p in props)
    return "\n".join([*(f"class {c}" for c in classes), *(f"property {p['uri']} domain {p['domain']} range {p['range']}" for p in props)])


def echo_client() -> Client:
    """Offline stub: finds `X is a Y` and answers in the agreed JSON."""
    import re

    def answer(text: str) -> str:
        found = re.findall(r"([A-Z]\w+) is an? (\w+)", text)
        return json.dumps({"triples": [{"subject": a, "predicate": "is a", "object": b} for a, b in found]})

    return answer
