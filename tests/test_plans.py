import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.model import as_graph
from loomgraph.plans import bgp, extractors, params, pipeline, report
from loomgraph.plans.pipeline import Dataset, Parameter, Plan, Registry, Task, bind, levels
from loomgraph.streaming import ingest


def test_graph_patterns(spark):
    t = as_graph(spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("a", "name", "A"), ("b", "name", "B")], "s string, p string, o string"))
    q = bgp.Query(where=[("?x", "knows", "?y")], optional=[[("?y", "name", "?n")]], order=["x"])
    assert [tuple(r) for r in q.run(t).select("x", "y", "n").collect()] == [("a", "b", "B"), ("b", "c", None)]
    assert bgp.bgp(t, [("?x", "knows", "?x")]).count() == 0
    assert {(r.a, r.b) for r in bgp.path_plus(t, "knows").collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    assert bgp.star(t, "x", {"k": "knows"}, {"n": "name"}).count() == 2
    assert bgp.first_non_empty(lambda: t.limit(0), lambda: t).count() == 4
    assert bgp.construct(bgp.bgp(t, [("?x", "knows", "?y")]), [("?y", "known_by", "?x")]).count() == 2


def test_parameters_are_checked():
    spec = [Parameter("t", "number", 0.5, minimum=0, maximum=1, native_keys=("threshold",)), Parameter("mode", allowed=("a", "b"), required=True)]
    assert bind(spec, {"threshold": 0.7, "mode": "a"}) == {"t": 0.7, "mode": "a"}
    for bad in ({"mode": "c"}, {"mode": "a", "x": 1}, {"t": 2, "mode": "a"}, {"t": "no", "mode": "a"}, {}):
        with pytest.raises(ValueError):
            bind(spec, bad)


def test_plan_runs_keeps_and_skips(spark, tmp_path):
    calls = []

    @Registry.task({"source": "nt"}, {"output": "er"}, config=[Parameter("n", "integer", 1)])
    def first(frames, config):
        calls.append("first")
        return {"output": frames["source"].withColumn("n", F.lit(config["n"]))}

    second = Task("second", lambda f: f["m"].where("n > 0"), {"m": "er"}, {"output": "nt"})
    src = Dataset("nt", spark.range(3))
    plan = Plan(["first", second], src)
    assert [s["input"] for s in plan.explain()] == [{"source": "source"}, {"m": "0_first_output"}]
    out, rep = plan.run(spark, str(tmp_path))
    assert out.count() == 3 and [r["status"] for r in rep] == ["success", "success"]
    _, again = Plan(["first", second], src).run(spark, str(tmp_path))
    assert [r["status"] for r in again] == ["skipped", "skipped"] and calls == ["first"]
    _, other = Plan(["first", second], src, configs={"first": {"n": 2}}).run(spark, str(tmp_path))
    assert [r["status"] for r in other] == ["success", "success"]
    with pytest.raises(ValueError):
        Plan([Task("x", lambda f: f, {"a": "csv"}, {"o": "nt"})], src)
    bad, rep = Plan([Task("boom", lambda f: 1 / 0, {"a": "nt"}, {"o": "nt"})], src).run(spark)
    assert bad is None and rep[0]["status"] == "failed"
    assert pipeline.report_rows(spark, "p", "stage_1", rep).count() == 1 and pipeline.run_triples(spark, "p", rep).count() == 4


def test_levels_and_stages(spark, tmp_path):
    assert levels([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(ValueError):
        levels([("a", "b"), ("b", "a")])
    out = pipeline.run_stages(spark, lambda k, t: t.union(spark.range(k, k + 1)), spark.range(1), 3, str(tmp_path))
    assert [x.count() for x in out] == [2, 3, 4]
    rows = pipeline.evaluate({"ok": lambda t: t.agg(F.count("*").alias("n")), "bad": lambda t: t.select("nope")}, spark.range(2), "p", "s", "a")
    assert rows[0][4] == 2.0 and rows[1][4] == -1.0 and "error" in json.loads(rows[1][7])


METRICS = [
    ("p", "stage_1", "a", "m", 0.5, 0.5, 1.0, '{"precision": 0.5, "recall": 1.0, "strict": 2, "overlap": 4, "expected": 5}'), ("p", "stage_2", "a", "m", -1.0, 0.0, 2.0, "{}"),
    ("q", "stage_1", "a", "m", 0.9, 0.9, 3.0, '{"error": "x"}'), ("q", "stage_1", "a", "n", 0.7, 0.7, 3.0, "{}"),
]


def test_reports(spark):
    m = spark.createDataFrame(METRICS, report.LONG)
    assert report.valid(m).count() == 2
    assert {(r.pipeline, r.metric, r.value) for r in report.selected_metric(m, ["m", "n"]).collect()} == {("p", "m", 0.5), ("q", "n", 0.7)}
    s = report.stage_matrix(m, "m").where("pipeline = 'p'").first()
    assert s["1_p"] == 0.5 and s["1_r"] == 1.0 and s["2_p"] is None
    assert report.source_f1(m.limit(1)).first().f1 == round(2 * 0.5 * 0.8 / 1.3, 6)
    sc = spark.createDataFrame([("x", 1.0, 0.0, 0.2), ("y", 0.0, 1.0, 0.2)], "pipeline string, a double, b double, c double")
    w = {r.pipeline: r.wins for r in report.weight_sensitivity(sc, ("a", "b", "c")).collect()}
    assert sum(w.values()) == 231
    assert report.ranking(sc, {"a": 1.0}).where("rank = 1").first().pipeline == "x"
    q = {r.cls: r.quota for r in report.apportion(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "cls string, n int"), "cls", "n", 10).collect()}
    assert q == {"a": 4, "b": 3, "c": 3}
    assert report.to_text(sc.select("pipeline").orderBy("pipeline"), "csv") == "pipeline\nx\ny" and "| x |" in report.to_text(sc.select("pipeline")) and "<td>x</td>" in report.to_text(sc, "html")
    assert "a --> b" in report.mermaid(spark.createDataFrame([("a", "b")], "f string, t string"), "f", "t")


def test_parameter_mining(spark):
    files = spark.createDataFrame(
        [
            ("tool.txt", "  -t, --threshold FLOAT  score [default: 0.5]\n  --verbose   say more\n"), ("Dockerfile", 'ENV PORT="8080"\nARG NAME\n'), ("README.md", "- `maxRows` (int): rows at most, default: 5\n"),
            ("a.py", "def run(x: int, y=0.5, *, flag: bool = False):\n    pass\n"), ("bad.py", "def ("), ("api.json", json.dumps({"paths": {"/q": {"get": {"parameters": [{"name": "limit", "required": True, "schema": {"type": "integer", "default": 3}}]}}}})),
        ],
        "path string, text string",
    )
    got = {(r.source, r.name): (r.datatype, r.default) for r in params.mine(files).collect()}
    assert got[("cli", "threshold")] == ("number", "0.5") and got[("cli", "verbose")][0] == "boolean" and got[("env", "port")] == ("integer", "8080")
    assert got[("readme", "max_rows")] == ("integer", "5") and got[("python", "flag")] == ("boolean", "False") and got[("api", "limit")] == ("integer", "3")
    assert params.parameter_clusters(params.mine(files)).count() == len({n for _, n in got})
    assert params.chunks_with_signal(spark.createDataFrame([("r.md", "The default option is x.\n\nNothing here.")], "path string, text string")).count() == 1


def test_search():
    space = params.Space({"m": ["a", "b"]}, {"t": (0.0, 1.0)})
    score = lambda c: (c["m"] == "b") + c["t"]
    runs = params.search(space, score, 20, 1, "quality", score)
    assert len(runs) == 20 and max(r[2] for r in runs) > runs[0][2]
    assert len(params.search(space, score, 20, strategy="default")) == 1
    assert set(space.mutate(space.default(), random.Random(0))) == {"m", "t"}


def test_extractor_interface(spark):
    d = spark.createDataFrame([("1", "Ann is a pilot"), ("2", None)], "doc_id string, text string")
    a = extractors.run_client(d, extractors.echo_client)
    assert [tuple(r) for r in extractors.parsed_triples(a).collect()] == [("1", "Ann", "is a", "pilot")]

    def broken():
        def fail(_):
            raise RuntimeError("down")

        return fail

    assert {r.error for r in extractors.run_client(d, broken).collect()} == {"down"}
    assert tuple(extractors.tab_triples(spark.createDataFrame([("a\tb\tc",)], "value string")).first()) == ("a", "b", "c")


def test_streaming(spark, tmp_path):
    rows = [("a", "p", "b", "2024-01-01 00:00:00"), ("a", "p", "b", "2024-01-01 00:01:00"), ("c", "p", "d", "2024-01-01 03:00:00")]
    spark.createDataFrame(rows, "s string, p string, o string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("s string, p string, o string, ts timestamp").parquet(str(tmp_path / "in"))
    q = ingest.distinct_triples(stream()).writeStream.format("memory").queryName("distinct_t").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("distinct_t").count() == 2
    q = ingest.windowed_counts(stream(), "ts", "p").writeStream.outputMode("complete").format("memory").queryName("counts_t").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.n for r in spark.table("counts_t").collect()} == {2, 1}
    kept = {}
    q = ingest.fuse_stream(stream(), lambda: spark.createDataFrame([("z", "p", "z")], "s string, p string, o string"), lambda b, t: b.select("s", "p", "o").union(t).distinct(), lambda g, n: kept.update({n: g.count()}), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert list(kept.values()) == [3]


def test_configurations(tmp_path):
    from loomgraph.plans import config

    text = json.dumps({"vars": {"root": "data"}, "defaults": {"threshold": 0.5, "opt": {"a": 1}}, "metrics": {"m": {"ref_path": "$root/x.nt", "opt": {"b": "${root}"}}, "n": None}})
    got = config.metric_configs(text, str(tmp_path), {"root": "other"})
    assert got["m"] == {"threshold": 0.5, "opt": {"a": 1, "b": "other"}, "ref_path": str((tmp_path / "other/x.nt").resolve())} and got["n"] == {"threshold": 0.5, "opt": {"a": 1}}
    with pytest.raises(KeyError):
        config.interpolate("$nope", {})
    assert config.catalogue(json.dumps({"p": {"tasks": ["a"]}}))["p"]["tasks"] == ["a"]
    with pytest.raises(ValueError):
        config.catalogue(json.dumps({"p": {}}))
    assert config.template({"m": [Parameter("t", "number", 0.5)]})["metrics"] == {"m": {"t": 0.5}}


def test_closed_sample(spark):
    rows = [(f"s{i}", p, f"v{i}", "literal") for i in range(9) for p in ("p", "q")] + [(f"s{i}", "link", f"s{i + 1}", "iri") for i in range(8)] + [("s0", "link", "nowhere", "iri")]
    rows += [(f"s{i}", "type", "C", "iri") for i in range(9)] + [(f"s{i}", "label", f"S{i}", "literal") for i in range(9)]
    t = spark.createDataFrame(rows, "s string, p string, o string, k string")
    got = report.closed_sample(t, 3, "type", "label").collect()
    assert all(sum(r.p == p for r in got) >= 3 for p in ("p", "q", "link", "type", "label"))
    known = {r.s for r in got if r.p == "label"}
    assert all(r.o in known for r in got if r.p == "link") and "nowhere" not in {r.o for r in got} and len({r.s for r in got}) < 9


def test_command_line(spark, tmp_path, capsys):
    from loomgraph.cli import main

    assert main(["list"], {"b": None, "a": None}) == 0 and capsys.readouterr().out == "a\nb\n"
    q = {"one": lambda s, d: s.range(1)}
    assert main(["run", "one", "d", "--out", str(tmp_path / "o")], q, spark) == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 1
    assert main(["show", "one", "d"], q, spark) == 0 and main(["run", "two", "d"], q, spark) == 2
    (tmp_path / "g.nt").write_text('<http://e/a> <http://e/p> "x" .\n')
    capsys.readouterr()
    assert main(["count", str(tmp_path / "g.nt"), "--style", "csv"], {}, spark) == 0 and "triples,1" in capsys.readouterr().out
    assert main(["convert", str(tmp_path / "g.nt"), str(tmp_path / "c"), "--to", "csv"], {}, spark) == 0
