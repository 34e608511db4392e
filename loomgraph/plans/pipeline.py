"""Registry, tasks, planning by format, execution with caching by plan hash, and run records.

A task is a function from named DataFrames to named DataFrames. A plan is a list of steps wired by format; steps stay
lazy, so a whole stage is one Catalyst plan, and only results that are asked to be kept are written.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

KINDS = ("string", "integer", "number", "boolean", "array", "object", "enum")


@dataclass(frozen=True)
class Parameter:
    name: str
    datatype: str = "string"
    default: Any = None
    required: bool = False
    allowed: tuple = ()
    minimum: float | None = None
    maximum: float | None = None
    native_keys: tuple[str, ...] = ()

    def check(self, value: Any) -> Any:
        if self.datatype == "integer" and (isinstance(value, bool) or not isinstance(value, int)):
            raise ValueError(f"{self.name}: {value!r} is no integer")
        if self.datatype == "number" and (isinstance(value, bool) or not isinstance(value, (int, float))):
            raise ValueError(f"{self.name}: {value!r} is no number")
        if self.datatype == "boolean" and not isinstance(value, bool):
            raise ValueError(f"{self.name}: {value!r} is no boolean")
        if self.datatype == "string" and not isinstance(value, str):
            raise ValueError(f"{self.name}: {value!r} is no string")
        if self.allowed and value not in self.allowed:
            raise ValueError(f"{self.name}: {value!r} is not one of {self.allowed}")
        if self.minimum is not None and value < self.minimum or self.maximum is not None and value > self.maximum:
            raise ValueError(f"{self.name}: {value!r} is out of bounds")
        return value


def bind(spec: list[Parameter], given: dict[str, Any]) -> dict[str, Any]:
    """Values of all parameters: given ones (by name or native key) checked, defaults for the rest."""
    alias = {k: p for p in spec for k in (p.name, *p.native_keys)}
    unknown = [k for k in given if k not in alias]
    if unknown:
        raise ValueError(f"unknown parameters: {unknown}")
    out = {alias[k].name: alias[k].check(v) for k, v in given.items()}
    for p in spec:
        if p.name not in out:
            if p.required and p.default is None:
                raise ValueError(f"{p.name} is required")
            out[p.name] = p.default
    return out


@dataclass
class Task:
    name: str
    fn: Callable
    inputs: dict[str, str]
    outputs: dict[str, str]
    description: str = ""
    category: tuple[str, ...] = ()
    config: list[Parameter] = field(default_factory=list)

    def call(self, frames: dict[str, DataFrame], config: dict[str, Any]) -> dict[str, DataFrame]:
        out = self.fn(frames, config) if len(inspect.signature(self.fn).parameters) > 1 else self.fn(frames)
        return out if isinstance(out, dict) else {next(iter(self.outputs)): out}


@dataclass
class Dataset:
    format: str
    frame: DataFrame | None = None
    name: str = ""


@dataclass
class Step:
    task: Task
    inputs: dict[str, str]
    outputs: dict[str, str]
    config: dict[str, Any]
    digest: str


class Registry:
    """Named things by kind; names are kept in lower case."""

    items: dict[tuple[str, str], Any] = {}

    @classmethod
    def register(cls, kind: str, name: str, item: Any) -> Any:
        cls.items[(kind, name.lower())] = item
        return item

    @classmethod
    def get(cls, kind: str, name: str) -> Any:
        return cls.items[(kind, name.lower())]

    @classmethod
    def names(cls, kind: str) -> list[str]:
        return sorted(n for k, n in cls.items if k == kind)

    @classmethod
    def task(cls, inputs: dict[str, str], outputs: dict[str, str], description: str = "", category: tuple[str, ...] = (), config: list[Parameter] | None = None):
        def wrap(fn: Callable) -> Task:
            return cls.register("task", fn.__name__, Task(fn.__name__, fn, inputs, outputs, description, category, config or []))

        return wrap

    @classmethod
    def metric(cls, name: str | None = None):
        def wrap(fn: Callable) -> Callable:
            return cls.register("metric", name or fn.__name__, fn)

        return wrap


class Plan:
    """Steps wired by format: an input takes the newest dataset of its format (`any` takes any); `kg` names the last graph."""

    def __init__(self, tasks: list[Task | str], source: Dataset, seed: Dataset | None = None, configs: dict[str, dict] | None = None):
        self.steps: list[Step] = []
        self.catalogue: list[tuple[str, str]] = [("source", source.format)] + ([("seed", seed.format)] if seed else [])
        self.frames = {"source": source.frame} | ({"seed": seed.frame} if seed else {})
        chain = hashlib.sha256(source.format.encode()).hexdigest()
        for n, t in enumerate(tasks):
            task = Registry.get("task", t) if isinstance(t, str) else t
            config = bind(task.config, (configs or {}).get(task.name, {}))
            wired: dict[str, str] = {}
            for name, fmt in task.inputs.items():
                free = [d for d, f in self.catalogue if (f == fmt or fmt == "any") and d not in wired.values()]
                if not free:
                    raise ValueError(f"{task.name}: nothing of format {fmt} for input {name}")
                wired[name] = next((d for d in reversed(free) if d == "seed"), free[-1]) if name in ("kg", "target", "seed") and not self.steps else free[0]
            chain = hashlib.sha256(json.dumps([chain, task.name, config, wired], sort_keys=True, default=str).encode()).hexdigest()
            outs = {name: f"{n}_{task.name}_{name}" for name in task.outputs}
            self.steps.append(Step(task, wired, outs, config, chain[:16]))
            self.catalogue = [(d, task.outputs[name]) for name, d in outs.items()] + self.catalogue

    def explain(self) -> list[dict[str, Any]]:
        return [{"task": s.task.name, "input": s.inputs, "output": s.outputs, "config": s.config, "digest": s.digest} for s in self.steps]

    def run(self, spark: SparkSession, keep: str | None = None) -> tuple[DataFrame | None, list[dict[str, Any]]]:
        """The last output and a report per step. With `keep`, outputs are parquet tables named by the plan hash and are
        reused while everything before them was; after the first step that runs, all later ones run."""
        reports, last, forced, frames = [], None, False, dict(self.frames)
        for s in self.steps:
            start, status, error = time.time(), "success", None
            paths = {o: f"{keep}/{s.digest}/{o}" for o in s.outputs} if keep else {}
            try:
                if keep and not forced and all(_there(spark, p) for p in paths.values()):
                    got, status = {o: spark.read.parquet(p) for o, p in paths.items()}, "skipped"
                else:
                    forced = True
                    got = s.task.call({n: frames[d] for n, d in s.inputs.items()}, s.config)
                    if keep:
                        for o, p in paths.items():
                            got[o].write.mode("overwrite").parquet(p)
                        got = {o: spark.read.parquet(p) for o, p in paths.items()}
            except Exception as e:  # a failed step is reported, and the run ends
                status, error, got = "failed", str(e)[:500], {}
            reports.append({"task": s.task.name, "status": status, "start": start, "duration": time.time() - start, "error": error})
            if status == "failed":
                return None, reports
            frames |= {s.outputs[o]: f for o, f in got.items()}
            last = next(reversed(got.values()))
        return last, reports


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def report_rows(spark: SparkSession, pipeline: str, stage: str, reports: list[dict[str, Any]]) -> DataFrame:
    """Run records as rows of the long metric table."""
    rows = [(pipeline, stage, "efficiency", r["task"], r["duration"], None, r["duration"], json.dumps({"status": r["status"], "error": r["error"]})) for r in reports]
    from .report import LONG

    return spark.createDataFrame(rows, LONG)


def run_triples(spark: SparkSession, pipeline: str, reports: list[dict[str, Any]], namespace: str = "http://loom.example/meta/") -> DataFrame:
    """Run records as triples, to be asked by graph patterns."""
    rows = []
    for i, r in enumerate(reports):
        s = f"{namespace}run/{pipeline}/{i}"
        rows += [(s, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", namespace + "TaskRun", "iri"), (s, namespace + "task", namespace + "task/" + r["task"], "iri"), (s, namespace + "status", r["status"], "literal"), (s, namespace + "duration", f"{r['duration']:.3f}", "literal")]
    return spark.createDataFrame(rows, "s string, p string, o string, k string")


def levels(edges: list[tuple[str, str]], nodes: list[str] | None = None) -> list[list[str]]:
    """Topological levels of a small graph of steps; a cycle is an error."""
    left = set(nodes or []) | {x for e in edges for x in e}
    need = {n: {a for a, b in edges if b == n} for n in left}
    out = []
    while left:
        free = sorted(n for n in left if not need[n] & left)
        if not free:
            raise ValueError(f"cycle among {sorted(left)}")
        out.append(free)
        left -= set(free)
    return out


def run_stages(spark: SparkSession, build: Callable[[int, DataFrame], DataFrame], seed: DataFrame, stages: int, keep: str) -> list[DataFrame]:
    """Stage k takes the result of stage k-1 as its target; each result is written and read back."""
    out, target = [], seed
    for k in range(1, stages + 1):
        path = f"{keep}/stage_{k}"
        build(k, target).write.mode("overwrite").parquet(path)
        target = spark.read.parquet(path)
        out.append(target)
    return out


def evaluate(metrics: dict[str, Callable[[DataFrame], DataFrame]], t: DataFrame, pipeline: str, stage: str, aspect: str) -> list[tuple]:
    """Rows of the long table: each metric's first row; a metric that fails gives a row with its error and value -1."""
    rows = []
    for name, fn in metrics.items():
        start = time.time()
        try:
            r = fn(t).first().asDict()
            value = float(next((r[c] for c in ("score", "f1", "value", "n") if r.get(c) is not None), next(iter(r.values()))))
            rows.append((pipeline, stage, aspect, name, value, min(1.0, max(0.0, value)), time.time() - start, json.dumps(r, default=str)))
        except Exception as e:
            rows.append((pipeline, stage, aspect, name, -1.0, 0.0, time.time() - start, json.dumps({"error": str(e)[:200]})))
    return rows
