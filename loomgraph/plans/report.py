"""Analytics over the long metric table (pipeline, stage, aspect, metric, value, normalized, duration, details)."""

from __future__ import annotations

import csv
import html
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

LONG = "pipeline string, stage string, aspect string, metric string, value double, normalized double, duration double, details string"

#: Weights of the ranking presets over (size, consistency, reference, efficiency): fixed values.
PRESETS = {
    "equal": (0.25, 0.25, 0.25, 0.25),
    "quantity_focused": (0.5, 0.1, 0.1, 0.3),
    "quality_focused": (0.0, 0.5, 0.5, 0.0),
    "reference_alignment_focused": (0.0, 0.2, 0.8, 0.0),
    "efficiency_oriented": (0.2, 0.2, 0.2, 0.4),
}


def stage_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def wide(m: DataFrame, index: list[str], column: str = "metric", value: str = "value", names: list[str] | None = None, how: str = "avg", digits: int = 3) -> DataFrame:
    """Pivot with avg, sum, max or min, rounded."""
    g = m.groupBy(*index)
    p = g.pivot(column, names) if names else g.pivot(column)
    return p.agg(F.round({"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how](value), digits))


def detail(name: str, default: float | None = None) -> Column:
    got = F.get_json_object("details", f"$.{name}").try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def valid(m: DataFrame) -> DataFrame:
    """Rows without an error in their details and without the sentinel -1."""
    return m.where(F.get_json_object("details", "$.error").isNull() & (F.col("value") >= 0))


def stage_matrix(m: DataFrame, metric: str, stages: int = 3) -> DataFrame:
    """precision and recall of the details per pipeline, one column per stage."""
    x = m.where(F.col("metric") == metric).withColumn("n", stage_number(F.col("stage")))
    return x.groupBy("pipeline").pivot("n", list(range(1, stages + 1))).agg(F.round(F.max(detail("precision")), 3).alias("p"), F.round(F.max(detail("recall")), 3).alias("r"))


def class_counts(m: DataFrame, metric: str, main: list[str]) -> DataFrame:
    """Class counts from the details of a metric; classes outside `main` as Other."""
    x = m.where(F.col("metric") == metric).select("pipeline", "stage", F.explode(F.from_json("details", "map<string,long>")).alias("cls", "n"))
    return x.withColumn("cls", F.when(F.col("cls").isin(*main), F.col("cls")).otherwise("Other")).groupBy("pipeline", "stage", "cls").agg(F.sum("n").alias("n"))


def grid(m: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All combinations of the keys' values with their summed value, 0 where there is none (keys are names: few)."""
    full = None
    for k in keys:
        d = m.select(k).distinct()
        full = d if full is None else full.crossJoin(F.broadcast(d))
    got = m.groupBy(*keys).agg(F.sum(value).alias(value))
    return full.join(got, keys, "left").withColumn(value, F.coalesce(value, F.lit(0).cast(dict(got.dtypes)[value])))


def normalize(m: DataFrame, by: str = "metric", value: str = "value", lower_better: tuple[str, ...] = ("duration", "memory")) -> DataFrame:
    """min/v for metrics where less is better, v/max for the others."""
    w = W.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    best = F.when(F.col(by).isin(*lower_better), T.ratio(lo, F.col(value))).otherwise(T.ratio(F.col(value), hi))
    return m.withColumn("score", F.round(best, 6))


def ranking(scores: DataFrame, weights: dict[str, float], key: str = "pipeline") -> DataFrame:
    """Rank by weighted sum of columns; ties to the smaller key."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    x = scores.select(key, F.round(total, 6).alias("score"))
    return x.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def preset_ranking(scores: DataFrame, columns: tuple[str, str, str, str], key: str = "pipeline") -> DataFrame:
    """(preset, key, score, rank) for all presets in one pass: weights as rows, one window per preset."""
    spark = scores.sparkSession
    w = spark.createDataFrame([(n, *map(float, v)) for n, v in PRESETS.items()], "preset string, w1 double, w2 double, w3 double, w4 double")
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.col(f"w{i + 1}") for i, c in enumerate(columns)), F.lit(0.0))
    x = scores.crossJoin(F.broadcast(w)).select("preset", key, F.round(total, 6).alias("score"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("preset").orderBy(F.desc("score"), key)))


def simplex(spark, steps: int = 20) -> DataFrame:
    """Weights (w1, w2, w3) that add to 1 in steps of 1/steps: 231 rows for 20."""
    a = spark.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    return a.select("i", F.explode(F.expr(f"sequence(0, {steps} - i)")).alias("j")).select((F.col("i") / steps).alias("w1"), (F.col("j") / steps).alias("w2"), ((F.lit(steps) - F.col("i") - F.col("j")) / steps).alias("w3"))


def weight_sensitivity(scores: DataFrame, columns: tuple[str, str, str], key: str = "pipeline", steps: int = 20) -> DataFrame:
    """Over the weight simplex: wins, share of wins, mean rank and mean score of every pipeline."""
    w = simplex(scores.sparkSession, steps)
    x = scores.crossJoin(F.broadcast(w)).withColumn("score", F.round(sum((F.col(c) * F.col(f"w{i + 1}") for i, c in enumerate(columns)), F.lit(0.0)), 9))
    r = x.withColumn("rank", F.row_number().over(W.partitionBy("w1", "w2", "w3").orderBy(F.desc("score"), key)))
    n = (steps + 1) * (steps + 2) // 2
    return r.groupBy(key).agg(F.count_if(F.col("rank") == 1).alias("wins"), F.round(F.count_if(F.col("rank") == 1) / n, 6).alias("win_share"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg("score"), 6).alias("mean_score"))


def best_so_far(runs: DataFrame, group: str, step: str, value: str, share: float = 0.95) -> DataFrame:
    """Per group: final best and the first step whose best so far reaches `share` of it."""
    w = W.partitionBy(group).orderBy(step)
    x = runs.withColumn("best", F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("final", F.max(value).over(W.partitionBy(group)))
    return x.groupBy(group).agg(F.max("final").alias("final"), F.min(F.when(F.col("best") >= share * F.col("final"), F.col(step))).alias("first_step"))


def agreement(df: DataFrame, a: str, b: str, key: str, k: int = 5) -> DataFrame:
    """Pearson, Spearman (dense ranks), mean absolute error, sample deviation of the error, and overlap of the top k."""
    r = df.withColumn("ra", F.dense_rank().over(W.orderBy(a))).withColumn("rb", F.dense_rank().over(W.orderBy(b)))
    r = r.withColumn("ta", F.row_number().over(W.orderBy(F.desc(a), key))).withColumn("tb", F.row_number().over(W.orderBy(F.desc(b), key)))
    return r.agg(
        F.round(F.corr(a, b), 6).alias("pearson"),
        F.round(F.corr("ra", "rb"), 6).alias("spearman"),
        F.round(F.avg(F.abs(F.col(a) - F.col(b))), 6).alias("mae"),
        F.round(F.stddev_samp(F.col(a) - F.col(b)), 6).alias("sd"),
        F.round(F.count_if((F.col("ta") <= k) & (F.col("tb") <= k)) / k, 6).alias("top_k"),
    )


def duration_totals(m: DataFrame) -> DataFrame:
    return m.groupBy("pipeline").agg(F.round(F.sum("duration"), 3).alias("total"), F.round(F.avg("duration"), 3).alias("mean"))


def selected_metric(m: DataFrame, priority: list[str]) -> DataFrame:
    """Per pipeline the first metric of the priority list that has a valid value."""
    v = valid(m)
    per = v.groupBy("pipeline").agg(*[F.max(F.when(F.col("metric") == p, F.col("value"))).alias(f"m{i}") for i, p in enumerate(priority)])
    pick = F.coalesce(*[F.when(F.col(f"m{i}").isNotNull(), F.struct(F.lit(p).alias("metric"), F.col(f"m{i}").alias("value"))) for i, p in enumerate(priority)])
    return per.select("pipeline", pick.alias("x")).select("pipeline", "x.metric", F.round("x.value", 6).alias("value"))


def source_f1(m: DataFrame) -> DataFrame:
    """F1 of precision strict/overlap and recall overlap/expected from the details, both capped at 1."""
    p, r = F.least(F.lit(1.0), T.ratio(detail("strict"), detail("overlap"))), F.least(F.lit(1.0), T.ratio(detail("overlap"), detail("expected")))
    return m.select("pipeline", "stage", F.round(T.ratio(2 * p * r, p + r), 6).alias("f1"))


def apportion(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Largest-remainder quotas of `total` in proportion to counts; ties to the smaller key."""
    s = counts.crossJoin(counts.agg(F.sum(n).alias("_all"))).withColumn("_q", F.col(n) * total / F.col("_all")).withColumn("_f", F.floor("_q"))
    s = s.withColumn("_r", F.row_number().over(W.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), key)))
    left = s.agg((F.lit(total) - F.sum("_f")).alias("_left"))
    return s.crossJoin(left).select(key, (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def sample_by_class(members: DataFrame, cls: str, key: str, total: int) -> DataFrame:
    """`total` members that keep the shares of the classes; inside a class by hash of the key."""
    q = apportion(members.groupBy(cls).agg(F.count("*").alias("n")), cls, "n", total)
    r = members.withColumn("_r", F.row_number().over(W.partitionBy(cls).orderBy(F.sha2(F.col(key).cast("string"), 256), key)))
    return r.join(F.broadcast(q), cls).where("_r <= quota").drop("_r", "quota")


def closed_sample(t: DataFrame, per_predicate: int, type_p: str, label_p: str) -> DataFrame:
    """A small subgraph with at least `per_predicate` triples of every predicate that has them, few entities and no loose ends.

    Subjects that have many predicates come first, so one subject serves several of them; every entity in the sample
    keeps its types and labels, and IRI objects that would be left without either are kept out.
    """
    described = t.where(F.col("p").isin(type_p, label_p)).select(F.col("s").alias("o")).distinct()
    usable = t.where(F.col("k") != "iri").unionByName(t.where((F.col("k") == "iri") & (F.col("p") == type_p))).unionByName(t.where((F.col("k") == "iri") & (F.col("p") != type_p)).join(described, "o", "left_semi").select(*t.columns))
    reach = usable.groupBy("s").agg(F.count_distinct("p").alias("_reach"))
    ranked = usable.join(reach, "s").withColumn("_r", F.row_number().over(W.partitionBy("p").orderBy(F.desc("_reach"), "s", "o")))
    picked = ranked.where(F.col("_r") <= per_predicate).select(*t.columns)
    ends = picked.select(F.explode(F.when((F.col("k") == "iri") & (F.col("p") != type_p), F.array("s", "o")).otherwise(F.array("s"))).alias("s")).distinct()
    extra = t.where(F.col("p").isin(type_p, label_p)).join(ends, "s", "left_semi").select(*t.columns)
    return picked.unionByName(extra).dropDuplicates()


def to_text(df: DataFrame, style: str = "markdown") -> str:
    """A small report as markdown, csv, html or aligned text."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.collect()]
    head = df.columns
    if style == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([head, *rows])
        return out.getvalue().rstrip("\n")
    if style == "markdown":
        return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *["| " + " | ".join(r) + " |" for r in rows]])
    if style == "html":
        cells = lambda r, t: "<tr>" + "".join(f"<{t}>{html.escape(v)}</{t}>" for v in r) + "</tr>"
        return "<table>" + cells(head, "th") + "".join(cells(r, "td") for r in rows) + "</table>"
    width = [max(map(len, c)) for c in zip(head, *rows)] if rows else list(map(len, head))
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in [head, *rows])


def mermaid(edges: DataFrame, a: str, b: str, label: str | None = None) -> str:
    """A small graph of names as a mermaid diagram."""
    lines = ["graph LR"]
    for r in edges.orderBy(a, b).collect():
        lines.append(f"  {r[a]} -->{'|' + str(r[label]) + '|' if label else ''} {r[b]}")
    return "\n".join(lines)
