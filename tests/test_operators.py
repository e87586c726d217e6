"""Core operators on small fixtures: nulls, empty tables, ties, repeats and clashing columns."""

import datetime as dt
import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodeflow.functions import scalars as fn
from lodeflow.operators import baselines, cascade, feedback, flows, graphs, provider, reports, tables, text
from lodeflow.sources import code
from lodeflow.streaming import windows


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


# --- scalar functions -------------------------------------------------------------------------


def test_scalars(spark):
    df = spark.createDataFrame([("CRITICAL ", "a/B.PY", "CWE-89"), ("odd", "x", "CWE-1"), (None, None, None)], "s string, p string, c string")
    got = values(df.select(fn.severity_rank(F.col("s")).alias("r"), fn.language_of_path(F.col("p")).alias("l"), fn.described(F.col("c")).alias("d"), fn.enum_or_default(F.col("s"), fn.SEVERITIES, "info").alias("e")))
    assert got == sorted([(1, "python", "SQL Injection", "critical"), (6, None, "Unknown (CWE-1)", "info"), (6, None, None, "info")], key=repr)


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.py", "a/b.py", True), ("test_*", "a/test_x", True), ("**/x/**", "a/x/b", True), ("**/x/**", "x/b", False), ("a?c", "abc", True), ("[!a]b", "ab", False), ("a.b", "axb", False), ("*", None, False)])
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(fn.matches_glob(F.col("p"), [glob])).first()[0] is hit


def test_first_json_object(spark):
    df = spark.createDataFrame([('say {"a": "x"} {"a": "y"}',), ("none",), ("{broken",), (None,)], "t string")
    assert [r[0] for r in df.select(fn.first_json_object(F.col("t"), "a string")["a"]).collect()] == ["x", None, None, None]


# --- flows and cascade ------------------------------------------------------------------------


def test_pairing(spark):
    s = spark.createDataFrame([("f", "s1", ["A", "B"], 1), ("f", "s2", ["C"], 5), (None, "s3", ["A"], 1), ("f", "s4", None, 1)], "file string, n string, c array<string>, line int")
    k = spark.createDataFrame([("f", "k1", ["B", "A"], 9), ("g", "k2", ["A"], 9), ("f", "k3", [], 9)], "file string, n string, c array<string>, line int")
    out = flows.pair_flows(s, k, ["file"], "c", "line")
    assert values(out, "source_n", "sink_n", "shared", "distance") == [("s1", "k1", ["A", "B"], 8)]
    assert flows.pair_flows(s.limit(0), k, ["file"], "c", "line").count() == 0


def test_score_boundaries(spark):
    df = spark.createDataFrame([(True, True, 1, True), (True, False, 9, False), (False, False, 10, False), (None, None, None, None)], "a boolean, t boolean, d int, s boolean")
    got = [r[0] for r in df.select(flows.heuristic_score(F.col("a"), F.col("t"), F.col("d"), F.col("s"))).collect()]
    assert got == [0.94, 1.0 if False else min(0.5 + 0.3 + 0.2, 0.94), 0.6, 0.5]
    assert 0.5 + 0.2 + 0.15 >= 0.85 and 0.65 - 0.2 <= 0.45


def test_typed_pairs(spark):
    s = spark.createDataFrame([("a", ["X", "Y"]), ("b", None)], "m string, t array<string>")
    k = spark.createDataFrame([("c", ["Y", "Z"]), ("d", [])], "m string, t array<string>")
    assert values(flows.typed_pairs(s, k, "m", "t"), "source", "sink", "type") == [("a", "c", "Y"), ("a", "d", "X"), ("a", "d", "Y"), ("b", "c", "Y"), ("b", "c", "Z"), ("b", "d", "DATA_FLOW")]


def test_primary(spark):
    df = spark.createDataFrame([(["CWE-79", "CWE-89"],), (["CWE-999", "CWE-5"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(flows.primary_category(F.col("c"))).collect()] == ["CWE-89", "CWE-5", None, None]


def test_routes(spark):
    rows = [("req.body.id", "q(`${id}`)", 'x = "a" + b', True, True), ("req.id", "escape(id)", "y = escape(id)", True, True), ("a.b", "c", None, False, False), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, k string, c string, t boolean, f boolean")
    score, route = cascade.first_tier(F.col("s"), F.col("k"), F.col("c"), F.col("t"), F.col("f"))
    assert [tuple(r) for r in df.select(score, route).collect()] == [(1.0, "high"), (0.0, "filtered"), (0.5, "review"), (0.5, "review")]


# --- graphs -----------------------------------------------------------------------------------


def plain_rank(nodes, edges, rounds):
    out = {n: {d for s, d in edges if s == n and d != n} for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * loose / len(nodes) + 0.85 * sum(rank[s] / len(out[s]) for s in nodes if n in out[s]) for n in nodes}
    return rank


def test_pagerank(spark):
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(12)]
    edges = [(rng.choice(nodes[:9]), rng.choice(nodes)) for _ in range(25)]
    got = {r.node: r.score for r in graphs.pagerank(nodes_of(spark, nodes), edges_of(spark, edges + edges[:4]), 8).collect()}
    expected = plain_rank(nodes, edges, 8)
    assert all(math.isclose(got[n], expected[n], abs_tol=1e-9) for n in nodes) and abs(sum(got.values()) - 1) < 1e-9
    assert values(graphs.pagerank(nodes_of(spark, ["a"]), edges_of(spark, []), 5)) == [("a", 1.0)]
    assert graphs.pagerank(nodes_of(spark, []), edges_of(spark, []), 5).count() == 0
    early = graphs.pagerank(nodes_of(spark, nodes), edges_of(spark, edges), 60, tolerance=1e-6).agg(F.sum("score")).first()[0]
    assert abs(early - 1) < 1e-9


def test_closure_and_cycles(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("a", "b")])
    assert {(s, d) for s, d in values(graphs.closure(e)) if s == "b"} == {("b", "a"), ("b", "b"), ("b", "c"), ("b", "d")}
    assert values(graphs.cycle_nodes(e)) == [("a",), ("b",), ("c",), ("e",)]
    assert graphs.closure(edges_of(spark, [])).count() == 0
    assert values(graphs.closure(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d")]), depth=2)) == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")]


def test_reach(spark):
    e = edges_of(spark, [("s", "x"), ("x", "t"), ("s", "c"), ("c", "u"), ("c", "t"), ("u", "v")])
    starts, wall = nodes_of(spark, ["s"]), nodes_of(spark, ["c"])
    assert values(graphs.reachable(starts, e, 2, wall)) == [("s", "t", 2), ("s", "x", 1)]
    assert values(graphs.sanitized_paths(starts, nodes_of(spark, ["t", "u", "q"]), e, wall, 3)) == [("s", "t", False), ("s", "u", True)]


def test_degrees_orphans_propagation(spark):
    n, e = nodes_of(spark, ["a", "b", "c", "c"]), edges_of(spark, [("a", "b"), ("a", "b"), ("z", "a")])
    assert values(graphs.degrees(n, e)) == [("a", 1, 1), ("b", 0, 1), ("c", 0, 0)]
    assert values(graphs.orphans(n, e)) == [("c",)]
    assert values(graphs.propagate(nodes_of(spark, ["b"]), e)) == [("a",)]
    assert values(graphs.propagate(nodes_of(spark, ["b"]), e, transitive=True)) == [("a",), ("z",)]


def test_min_max(spark):
    assert values(graphs.min_max(spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double"), "x")) == [(0.0,), (0.5,), (1.0,)]
    assert values(graphs.min_max(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x")) == [(1.0,), (1.0,)]


# --- text and tables --------------------------------------------------------------------------


def test_slices(spark):
    df = spark.createDataFrame([(1, "a\nb\nHIT\nc\nd\ne"), (2, "none"), (3, None), (4, "HIT"), (5, "")], "k int, t string")
    assert values(text.slice_around(df, "k", "t", "HIT", 1)) == [(1, 2, "b", False), (1, 3, "HIT", True), (1, 4, "c", False), (4, 1, "HIT", True)]
    assert values(text.slice_around(df, "k", "t", "HIT", 2, 2), "k", "line") == [(1, 1), (1, 3), (4, 1)]
    assert values(text.lines_of(df.where("k > 2"), "k", "t")) == [(4, 1, "HIT"), (5, 1, "")]


def test_text_scores(spark):
    df = spark.createDataFrame([("exec(run(x), if (y))",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.called_names(F.col("t"), ("if",))).collect()] == [["exec", "run"], [], []]
    assert [r[0] for r in df.select(text.best_pattern(F.col("t"), [("run", 0.4), ("exec", 0.7)])).collect()] == [0.7, 0.0, 0.0]
    assert [r[0] for r in df.select(text.term_score(F.col("t"), ["exec", "run", "x", "y"])).collect()] == [0.5, 0.0, 0.0]


def test_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 2), (None, 5)], "g string, v int")
    assert values(tables.top_k_per(df, ["g"], 1, F.desc("v")), "g", "v") == sorted([("a", 3), ("b", 2), (None, 5)], key=repr)
    assert [r.v for r in tables.page(df, 2, 2, F.desc("v"), "g").collect()] == [2, 2]
    assert values(tables.zero_filled(df, ["g"], "v", (1, 9))) == sorted([("a", 1, 0), ("b", 0, 0), (None, 0, 0)], key=repr)
    assert values(tables.overlay(df.where("g is not null").dropDuplicates(["g"]).withColumn("v", F.lit(0)), spark.createDataFrame([("b", 7), ("c", 8)], "g string, v int"), "g")) == [("a", 0), ("b", 7), ("c", 8)]
    assert tables.confusion(df.limit(0), F.col("v") > 1, F.col("v") > 1).first().accuracy == 0.0
    balanced = tables.balanced(spark.range(100).selectExpr("id", "int(id < 20) as label"), "label", "id")
    assert values(balanced.groupBy("label").count()) == [(0, 20), (1, 20)] and values(balanced) == values(tables.balanced(spark.range(100).selectExpr("id", "int(id < 20) as label").repartition(7), "label", "id"))


def test_lookup_priority(spark):
    wanted = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3), (None, 4)], "key string, n int")
    first = spark.createDataFrame([("k1", "z"), ("k1", "a")], "k string, t string")
    second = spark.createDataFrame([("k1", "0"), ("k2", "b"), (None, "n")], "k string, t string")
    assert values(tables.resolve_by_priority(wanted, "key", [(first, "k", "t"), (second, "k", "t")]), "n", "target", "priority") == [(1, "a", 0), (2, "b", 1), (3, None, None), (4, None, None)]


def test_nearest(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = values(tables.nearest(df.where("id % 20 = 0"), df, "id", "v", 3), "query_id", "rank", "id")
    expected = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((round(math.dist(v, w), 5), i) for i, w in rows if i != q)[:3]
            expected += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    assert got == sorted(expected, key=repr)


# --- baselines, provider, feedback, reports ---------------------------------------------------


def test_baselines(spark):
    t = [dt.datetime(2025, 1, d) for d in range(1, 5)]
    old = spark.createDataFrame([("a", t[0], t[0], "active"), ("b", t[0], t[0], "active"), ("c", t[0], t[0], "suppressed"), ("d", t[0], t[0], "resolved")], "fingerprint string, first_seen timestamp, last_seen timestamp, status string")
    now = spark.createDataFrame([("a", t[2]), ("a", t[1]), ("d", t[2]), ("e", t[3]), (None, t[3])], "fingerprint string, seen timestamp")
    assert values(baselines.compare(now, old)) == [("a", "existing"), ("b", "resolved"), ("d", "existing"), ("e", "new")]
    assert values(baselines.upsert(old, now)) == [("a", t[0], t[2], "active"), ("b", t[0], t[0], "resolved"), ("c", t[0], t[0], "resolved"), ("d", t[0], t[2], "active"), ("e", t[3], t[3], "active")]
    assert ("c", t[0], t[0], "suppressed") in values(baselines.upsert(old, now, keep_suppressed=True))
    mark = spark.range(1).select(baselines.fingerprint(b=F.lit("x"), a=F.lit(None).cast("string"), c=F.lit("y")), F.substring(F.sha2(F.lit("b:x|c:y"), 256), 1, 16)).first()
    assert mark[0] == mark[1] and len(mark[0]) == 16


def stub_provider(prompts):
    """Labels and confidences that a digest of the prompt gives."""
    digests = [hashlib.sha256(p.encode()).digest() for p in prompts]
    return [(("vulnerable", "safe", "uncertain")[d[0] % 3], round(0.3 + d[1] / 255 * 0.7, 4)) for d in digests]


def test_provider(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None)], "id int, prompt string").withColumn("answer", F.lit("old"))

    def failing(prompts):
        raise RuntimeError("no network")

    asked = {r.id: (r.answer, r.answer_confidence) for r in provider.complete(df, "prompt", stub_provider).collect()}
    assert asked[1] == asked[2] == stub_provider(["p"])[0] and asked[4] == (None, None)
    assert {r.id: r.answer for r in provider.complete(df, "prompt", failing).collect()} == {1: "error", 2: "error", 3: "error", 4: None}
    cache = spark.range(1).select(F.sha2(F.lit("p"), 256).alias("key"), F.lit("kept").alias("answer"), F.lit(0.5).alias("answer_confidence"))
    assert {r.id: r.answer for r in provider.complete(df, "prompt", failing, cache=cache).collect()} == {1: "kept", 2: "kept", 3: "error", 4: None}
    settled = provider.feedback(spark.range(40).selectExpr("id", "concat('p', id) as prompt"), "id", "prompt", stub_provider).collect()
    assert len(settled) == 40 and {r["round"] for r in settled} <= {1, 2, 3}


FINDINGS = "id long, scan_id string, vulnerability_type string, severity string, confidence double, title string, verification struct<verdict string, confidence double>"


def test_feedback_and_reports(spark, tmp_path):
    rows = [(1, "s", "CWE-89", "HIGH", 0.9, "a|<b>", ("false_positive", 0.8)), (2, "s", "CWE-79", "low", 0.5, None, None), (3, None, None, None, None, None, ("false_positive", 0.2))]
    f = spark.createDataFrame(rows, FINDINGS)
    s = spark.createDataFrame([(1, 1, 5, "x = clean(v)", "Sanitizer"), (1, 2, 6, None, "sanitizer"), (1, 3, 7, "y(v)", "sink"), (3, 4, 8, "z(v)", "sanitizer")], "finding_id long, step_id long, line int, code_snippet string, step_type string")
    assert values(feedback.learned_sanitizers(f, s), "method", "line", "confidence") == [("clean", 5, 0.8 * 0.9), ("sanitizer_line_6", 6, 0.8 * 0.9)]
    assert values(reports.summary(f)) == [("critical", 0, 0), ("high", 1, 1), ("info", 0, 0), ("low", 1, 0), ("medium", 0, 0)]
    assert values(reports.filtered(f, "high", keep_false_positives=False), "id") == []
    assert reports.fails(f, "high") and not reports.fails(f, "critical")
    for form in ("markdown", "html"):
        reports.write(f, str(tmp_path / form), form)
        assert "CWE-89" in (tmp_path / form).read_text()
    reports.write(f, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError, match="unknown report form"):
        reports.write(f, "x", "pdf")


# --- sources and streams ----------------------------------------------------------------------


def test_repository_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text('import os\nfrom b.c import d\n\nclass A:\n    def _m(self, x=1):\n        pass\n\ndef f():\n    return 1\n')
    (tmp_path / "src" / "b.ts").write_text("import x from './y';\nexport class B {}\nexport const g = async (a) => 1;\nfunction h(b) {}\nitems.map(x => x);\n")
    (tmp_path / "src" / "broken.py").write_text("def (")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe\x00x = 1")
    (tmp_path / "src" / "skip.min.js").write_text("x")
    (tmp_path / "notes.txt").write_text("x")
    files = code.scan_repository(spark, str(tmp_path), exclude=["*.min.js"])
    assert values(files, "path", "language", "lines") == [("src/a.py", "python", 10), ("src/b.ts", "typescript", 6), ("src/bad.py", "python", 0), ("src/broken.py", "python", 1)]
    assert values(code.symbols(files), "name", "type", "line", "visibility") == [("A", "class", 4, "public"), ("B", "class", 2, "public"), ("_m", "method", 5, "protected"), ("f", "function", 8, "public"), ("g", "function", 3, "public"), ("h", "function", 4, "public")]
    assert values(code.imports(files), "path", "module") == [("src/a.py", "b.c"), ("src/a.py", "os"), ("src/b.ts", "./y")]
    assert values(code.scan_repository(spark, str(tmp_path), languages=["typescript"]), "path") == [("src/b.ts",)]
    assert code.scan_repository(spark, str(tmp_path), max_mb=0.0).count() == 0


def test_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"kind": "sink", "name": "n", "pattern": "p", "type": "t", "confidence": 0.5, "cwe_types": ["CWE-1"]}, {"name": "bad", "pattern": "p", "type": "t", "confidence": 2.0, "cwe_types": ["1"]}]))
    rules = code.load_rules(spark, str(tmp_path))
    assert values(rules.where("enabled"), "name") == [("bad",), ("n",)]
    assert len(values(code.rule_errors(rules))) == 2


def test_stream_of_findings(spark, tmp_path):
    source, kept = tmp_path / "in", tmp_path / "baseline"
    t = [dt.datetime(2025, 1, d) for d in range(1, 4)]
    schema = "fingerprint string, seen timestamp"
    for rows in ([("a", t[0]), ("b", t[0])], [("a", t[2])]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        windows.keep_baseline(spark.readStream.schema(schema).parquet(str(source)), str(kept), str(tmp_path / "ckpt")).awaitTermination()
    assert values(spark.read.parquet(str(kept / "v1"))) == [("a", t[0], t[2], "active"), ("b", t[0], t[0], "resolved")]


def test_windows(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("u", t, 1.0), ("u", t + dt.timedelta(hours=1), 2.0), ("u", t + dt.timedelta(hours=30), 4.0), ("v", t, None)]
    e = spark.createDataFrame(rows, "user string, ts timestamp, value double")
    assert values(windows.sessions(e, "ts", "user", "6 hours"), "user", "n") == [("u", 1), ("u", 2), ("v", 1)]
    assert values(windows.tumbling(e, "ts", "user", "1 day"), "user", "n", "total") == sorted([("u", 2, 3.0), ("u", 1, 4.0), ("v", 1, None)], key=repr)


def test_versions(spark, tmp_path):
    from lodeflow.sources import versions as v

    path, schema = str(tmp_path / "specs"), "method string, label string, confidence double"
    assert v.read_latest(spark, path, schema).count() == 0
    first = spark.createDataFrame([("f", "source", 0.9), ("g", "sink", None)], schema)
    assert v.write_version(first, path) == 1
    assert v.merge_version(spark.createDataFrame([("f", "source", 0.1), ("h", "sink", 0.5)], schema), path, schema, ["method", "label"]) == 2
    assert values(v.read_latest(spark, path, schema)) == sorted([("f", "source", 0.9), ("g", "sink", None), ("h", "sink", 0.5)], key=repr)
    assert v.versions(spark, path) == [1, 2]


def test_function_source(spark):
    df = spark.createDataFrame([(1, "x\ndef f():\n    a\n    def g(): pass\n\n  \ndef h():\n  b"), (2, "x = 1"), (3, None), (4, "  def f():\n    " + "a\n    " * 80)], "k int, t string")
    assert values(text.function_source(df, "k", "t"), "k", "n_lines") == [(1, 5), (4, 50)]
