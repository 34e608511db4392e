"""Mining parameters of tools from help texts, container files, API descriptions, readmes and source code; search over configurations."""

from __future__ import annotations

import ast
import json
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PARAM = "path string, source string, name string, native string, datatype string, default string, required boolean, choices string, description string"

CLI = r"(?m)^\s{1,12}(?:-(\w), ?)?--([A-Za-z][\w-]*)(?:[ =]([A-Z_]{2,}|<[^>]+>|\{[^}]+\}|INTEGER|FLOAT|TEXT|PATH))?[ \t]*([^\n]*)"
ENV = r"(?m)^\s*(?:ENV|ARG)\s+([A-Za-z_]\w*)(?:[= ]\s*(\S.*))?$"
README = r"(?m)^\s*(?:[-*]\s*)?`(-{0,2}[A-Za-z][\w.-]*)`\s*(?:\(([^)]*)\))?\s*[:–-]\s*(.+)$"
KEYWORDS = ("parameter", "option", "argument", "default", "flag", "config", "usage", "threshold", "--", "env")
NOISE = ("http", "https", "todo", "note", "example", "usage", "help", "version", "the", "and")


def signal(c: Column) -> Column:
    """Number of different keywords that a chunk of text holds."""
    low = F.lower(c)
    return sum((F.contains(low, F.lit(k)).cast("int") for k in KEYWORDS), F.lit(0))


def chunks_with_signal(files: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """Paragraphs with at least `least` keywords; configuration and markup files need one less."""
    x = files.select("path", F.posexplode(F.split(text, r"\n\s*\n")).alias("n", "chunk")).withColumn("signal", signal(F.col("chunk")))
    low = F.col("path").rlike(r"\.(properties|xml|java)$")
    return x.where(F.col("signal") >= F.lit(least) - low.cast("int"))


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(c, r"^-+", ""), r"([a-z0-9])([A-Z])", "$1_$2")), r"[^a-z0-9]+", "_"), F.lit("_"))


def _clean(df: DataFrame) -> DataFrame:
    return df.where((F.length("name") >= 2) & ~F.col("name").isin(*NOISE)).dropDuplicates(["path", "source", "name"])


def _all(pattern: str, group: int, col: str) -> Column:
    return F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(group))


def cli_parameters(files: DataFrame, text: str = "text") -> DataFrame:
    """Options of command-line help texts, found by regular expressions in the JVM."""
    hits = F.arrays_zip(_all(CLI, 2, text).alias("o"), _all(CLI, 3, text).alias("m"), _all(CLI, 4, text).alias("d"))
    x = files.select("path", F.explode(hits).alias("h")).select("path", F.col("h.o").alias("o"), F.col("h.m").alias("m"), F.col("h.d").alias("d"))
    default = F.nullif(F.regexp_extract("d", r"[\[(]?default:? ?=? ?([^\])\s,;]+)", 1), F.lit(""))
    choices = F.nullif(F.regexp_extract("m", r"^\{(.*)\}$", 1), F.lit(""))
    kind = F.when(choices.isNotNull(), "enum").when(F.col("m").isin("INTEGER", "INT", "N"), "integer").when(F.col("m") == "FLOAT", "number").when(F.col("m") == "", "boolean").otherwise(F.coalesce(T.parse_default(default), F.lit("string")))
    out = x.select("path", F.lit("cli").alias("source"), normalized(F.col("o")).alias("name"), F.concat(F.lit("--"), "o").alias("native"), kind.alias("datatype"), default.alias("default"), F.col("d").rlike("(?i)required").alias("required"), choices.alias("choices"), F.trim("d").alias("description"))
    return _clean(out)


def env_parameters(files: DataFrame, text: str = "text") -> DataFrame:
    """ENV and ARG of container files."""
    hits = F.arrays_zip(_all(ENV, 1, text).alias("o"), _all(ENV, 2, text).alias("d"))
    x = files.select("path", F.explode(hits).alias("h")).select("path", F.col("h.o").alias("o"), F.nullif(F.trim(F.regexp_replace("h.d", r'^"|"$', "")), F.lit("")).alias("d"))
    return _clean(x.select("path", F.lit("env").alias("source"), normalized(F.col("o")).alias("name"), F.col("o").alias("native"), F.coalesce(T.parse_default(F.col("d")), F.lit("string")).alias("datatype"), F.col("d").alias("default"), F.col("d").isNull().alias("required"), F.lit(None).cast("string").alias("choices"), F.lit("").alias("description")))


def readme_parameters(files: DataFrame, text: str = "text") -> DataFrame:
    """Listed names in backticks with a description."""
    hits = F.arrays_zip(_all(README, 1, text).alias("o"), _all(README, 2, text).alias("k"), _all(README, 3, text).alias("d"))
    x = files.select("path", F.explode(hits).alias("h")).select("path", F.col("h.o").alias("o"), F.lower("h.k").alias("k"), F.col("h.d").alias("d"))
    default = F.nullif(F.regexp_extract("d", r"(?i)default:? ?`?([^`\s,;).]+)", 1), F.lit(""))
    kind = F.when(F.col("k").contains("int"), "integer").when(F.col("k").rlike("float|number|double"), "number").when(F.col("k").contains("bool"), "boolean").otherwise(F.coalesce(T.parse_default(default), F.lit("string")))
    return _clean(x.select("path", F.lit("readme").alias("source"), normalized(F.col("o")).alias("name"), F.col("o").alias("native"), kind.alias("datatype"), default.alias("default"), F.lower("d").contains("required").alias("required"), F.lit(None).cast("string").alias("choices"), F.trim("d").alias("description")))


def _python_rows(path: str, code: str) -> Iterator[tuple]:
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = node.args.posonlyargs + node.args.args
            values = [None] * (len(args) - len(node.args.defaults)) + list(node.args.defaults)
            pairs = [*zip(args, values), *zip(node.args.kwonlyargs, node.args.kw_defaults)]
            for a, v in pairs:
                if a.arg in ("self", "cls") or a.arg.startswith("_"):
                    continue
                note = ast.unparse(a.annotation) if a.annotation else ""
                default = ast.unparse(v) if v is not None else None
                kind = {"int": "integer", "float": "number", "bool": "boolean", "str": "string"}.get(note)
                if kind is None:
                    kind = {int: "integer", float: "number", bool: "boolean"}.get(type(getattr(v, "value", None)), "string")
                yield (path, "python", a.arg, f"{node.name}.{a.arg}", kind, default, v is None, None, note)


def _api_rows(path: str, body: str) -> Iterator[tuple]:
    for route, ops in json.loads(body).get("paths", {}).items():
        for op in ops.values():
            for p in op.get("parameters", []) if isinstance(op, dict) else []:
                s = p.get("schema", p)
                choices = json.dumps(s["enum"]) if s.get("enum") else None
                default = None if s.get("default") is None else str(s["default"])
                yield (path, "api", p["name"], f"{route}?{p['name']}", "enum" if choices else s.get("type", "string"), default, bool(p.get("required")), choices, p.get("description", ""))


def code_parameters(files: DataFrame, text: str = "text") -> DataFrame:
    """Function parameters of Python files and parameters of API descriptions (JSON); files that can't be parsed give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, body in zip(pdf["path"], pdf["_t"]):
                try:
                    rows += _python_rows(path, body) if path.endswith(".py") else _api_rows(path, body)
                except (SyntaxError, ValueError, KeyError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARAM.split(", ")])

    out = files.where(F.col("path").rlike(r"\.(py|json)$")).select("path", F.col(text).alias("_t")).mapInPandas(run, PARAM)
    return _clean(out.withColumn("name", normalized(F.col("name"))))


def mine(files: DataFrame, text: str = "text") -> DataFrame:
    """All miners over a table of files, each on the files it is made for."""
    f = files.withColumn("low", F.lower("path"))
    env = f.where(F.col("low").rlike(r"dockerfile|compose"))
    readme = f.where(F.col("low").rlike(r"\.md$|readme"))
    code = f.where(F.col("low").rlike(r"\.(py|json)$"))
    help_ = f.where(F.col("low").rlike(r"\.(txt|help)$"))
    return cli_parameters(help_, text).unionByName(env_parameters(env, text)).unionByName(readme_parameters(readme, text)).unionByName(code_parameters(code, text))


def parameter_clusters(params: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(group, name, cluster): names of parameters grouped by average linkage of their n-gram vectors."""
    from ..operators.cluster import agglomerate_groups
    from ..operators.similarity import embed

    names = params.select("name").distinct()
    return agglomerate_groups(embed(names, "name").select(F.lit(0).alias("grp"), F.col("text").alias("name"), "vec"), "grp", "name", "vec", threshold)


@dataclass
class Space:
    """Choices and ranges of a configuration."""

    choices: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    def default(self) -> dict:
        return {k: v[0] for k, v in self.choices.items()} | {k: (a + b) / 2 for k, (a, b) in self.ranges.items()}

    def sample(self, rng: random.Random) -> dict:
        return {k: rng.choice(v) for k, v in self.choices.items()} | {k: rng.uniform(*r) for k, r in self.ranges.items()}

    def mutate(self, config: dict, rng: random.Random, rate: float = 0.3) -> dict:
        fresh = self.sample(rng)
        return {k: fresh[k] if rng.random() < rate else v for k, v in config.items()}


def quality(accuracy: Column, recall: Column, cost: Column) -> Column:
    """Weighted quality: 0.45, 0.30, 0.25."""
    return F.lit(0.45) * accuracy + F.lit(0.30) * recall + F.lit(0.25) * cost


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def search(space: Space, score: Callable[[dict], float], budget: int = 20, seed: int = 0, strategy: str = "quality", estimate: Callable[[dict], float] | None = None, pool: int = 12, explore: float = 0.35) -> list[tuple[int, dict, float]]:
    """Evaluated configurations in order: only the default, random ones, or those an estimate likes best out of a pool."""
    rng, out = random.Random(seed), []
    for i in range(1 if strategy == "default" else budget):
        if i == 0:
            config = space.default()
        elif strategy == "random" or estimate is None or rng.random() < explore:
            config = space.sample(rng)
        else:
            best = max(out, key=lambda x: x[2])[1]
            config = max((space.mutate(best, rng) for _ in range(pool)), key=estimate)
        out.append((i, config, score(config)))
    return out


def file_table(spark, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


