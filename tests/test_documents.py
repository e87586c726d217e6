"""Drift ingestion and shredding on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lodeflow.operators import drift, shred

GOOD = {
    "metadata": {
        "tool": {"name": "scanner", "version": "1.0.0"},
        "scan": {"id": "scan-1", "repository": "r", "status": "completed", "started_at": "2025-01-01T00:00:00", "completed_at": "2025-01-01T00:00:01", "duration_seconds": 1.5},
        "generated_at": "2025-01-01T00:00:02",
    },
    "summary": {
        "files_scanned": 1, "lines_scanned": 2, "total_findings": 0, "by_severity": {"high": 1},
        "by_verdict": {"true_positive": 0, "false_positive": 0, "uncertain": 0, "unverified": 0},
        "spec_inference": {"sources": 1, "sinks": 1, "sanitizers": 1},
    },
    "findings": [],
}


def changed(**edits):
    doc = json.loads(json.dumps(GOOD))
    for path, value in edits.items():
        *parents, last = path.split("__")
        at = doc
        for p in parents:
            at = at[p]
        if value is KeyError:
            del at[last]
        else:
            at[last] = value
    return doc


CASES = {
    "same": (GOOD, set()),
    "null is no change": (changed(metadata__tool__version=None), set()),
    "removed": (changed(summary__by_verdict__uncertain=KeyError), {("summary.by_verdict.uncertain", "removed")}),
    "removed object": (changed(summary__spec_inference=KeyError), {("summary.spec_inference", "removed")}),
    "added": (changed(metadata__ci={"job": 1}), {("metadata.ci", "added")}),
    "free keys": (changed(summary__by_severity={"odd": 1}), set()),
    "retyped": (changed(summary__lines_scanned="2"), {("summary.lines_scanned", "retyped")}),
    "a fraction is no integer": (changed(summary__lines_scanned=2.0), {("summary.lines_scanned", "retyped")}),
    "an integer is a number": (changed(metadata__scan__duration_seconds=2), set()),
    "retyped object": (changed(metadata__tool="scanner 1.0.0"), {("metadata.tool", "retyped")}),
    "renamed": (changed(metadata__tool__version=KeyError, metadata__tool__semver="1.0.0"), {("metadata.tool.version", "renamed")}),
    "moved": (changed(metadata__tool__version=KeyError, metadata__version="1.0.0"), {("metadata.tool.version", "renamed")}),
    "renamed and retyped": (
        changed(summary__by_verdict__uncertain=KeyError, summary__by_verdict__undecided="0"),
        {("summary.by_verdict.uncertain", "renamed"), ("summary.by_verdict.uncertain", "retyped")},
    ),
    "removed beside an unlike field": (changed(metadata__tool__version=KeyError, metadata__host="linux"), {("metadata.tool.version", "removed"), ("metadata.host", "added")}),
    "renamed object": (changed(summary__spec_inference=KeyError, summary__specs={"sources": 1, "sinks": 1, "sanitizers": 1}), {("summary.spec_inference", "renamed")}),
}


def test_changes(spark):
    rows = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(CASES.values())]
    rows += [(90, rows[2][1][:50]), (91, None), (92, ""), (93, "[1]"), (94, "﻿" + rows[2][1] + "\n"), (2, rows[2][1])]
    found = {}
    for r in drift.changes(spark.createDataFrame(rows, "report_id long, body string"), ["report_id"], "body", drift.REPORT_SCHEMA).collect():
        assert (r.field_path, r.change) not in found.setdefault(r.report_id, set())
        found[r.report_id].add((r.field_path, r.change))
    for i, (name, (_, expected)) in enumerate(CASES.items()):
        assert found.get(i, set()) == expected, name
    assert found[94] == CASES["removed"][1]
    assert not {90, 91, 92, 93} & set(found)


def test_ingest_replays(spark):
    rows = [(1, json.dumps(changed(metadata__tool__version=KeyError, metadata__version="2.0.0", metadata__ci={"job": 1}))), (2, json.dumps(changed(summary__lines_scanned="7", metadata__scan__duration_seconds="3.5s"))), (3, "{")]
    out = {r.report_id: r for r in drift.ingest(spark.createDataFrame(rows, "report_id long, body string"), ["report_id"], "body", drift.REPORT_SCHEMA).collect()}
    assert out[1].metadata_tool_version == "2.0.0"
    assert json.loads(out[1]["_rescued"]) == {"metadata.ci": '{"job":1}'}
    assert (out[2].summary_lines_scanned, out[2].metadata_scan_duration_seconds) == (7, 3.5)
    assert out[3].is_damaged and out[3].metadata_tool_name is None


def test_replay_loses_nothing(spark):
    edits = {
        1: changed(summary__lines_scanned="1,234"),
        2: changed(summary__lines_scanned="12 of 40"),
        3: changed(metadata__scan__duration_seconds="5 min"),
        4: changed(metadata__scan__duration_seconds="9007199254740993"),
        5: changed(summary__lines_scanned="9007199254740993"),
        6: changed(summary__lines_scanned=2.0),
        7: changed(summary__lines_scanned=2.5),
        8: changed(metadata__tool__version=3),
        9: changed(metadata__scan__duration_seconds="5 s"),
        10: changed(summary__lines_scanned=99999999999999999999),
        11: changed(metadata__scan__started_at=1735689600, metadata__tool__version=[1, 2, 3]),
        12: changed(summary__lines_scanned=True, metadata__scan__status={"a": 1}),
    }
    rows = [(k, json.dumps(d)) for k, d in edits.items()]
    out = {r.report_id: r for r in drift.ingest(spark.createDataFrame(rows, "report_id long, body string"), ["report_id"], "body", drift.REPORT_SCHEMA).collect()}
    held = {k: json.loads(r["_rescued"]) for k, r in out.items()}
    lines, seconds = "summary.lines_scanned", "metadata.scan.duration_seconds"
    assert (out[1].summary_lines_scanned, held[1]) == (None, {lines: '"1,234"'})
    assert (out[2].summary_lines_scanned, held[2]) == (None, {lines: '"12 of 40"'})
    assert (out[3].metadata_scan_duration_seconds, held[3]) == (None, {seconds: '"5 min"'})
    assert (out[4].metadata_scan_duration_seconds, held[4]) == (None, {seconds: '"9007199254740993"'})
    assert (out[5].summary_lines_scanned, held[5]) == (9007199254740993, {})
    assert (out[6].summary_lines_scanned, held[6]) == (2, {})
    assert out[7].summary_lines_scanned is None and list(held[7]) == [lines]
    assert (out[8].metadata_tool_version, held[8]) == ("3", {})
    assert (out[9].metadata_scan_duration_seconds, held[9]) == (5.0, {seconds: '"5 s"'})
    assert out[10].summary_lines_scanned is None and list(held[10]) == [lines]
    assert out[11].metadata_scan_started_at.startswith("2025-01-01T00:00:00") and out[11].metadata_tool_version == "1.2.3"
    assert set(held[11]) == {"metadata.scan.started_at", "metadata.tool.version"}
    assert out[12].summary_lines_scanned is None and set(held[12]) == {lines, "metadata.scan.status"}


def test_only_approved_fields_are_promoted(spark):
    doc = changed(metadata__tool__version=KeyError, metadata__tool__semver="1.0.0", metadata__ci={"job": 1}, metadata__host="7")
    df = spark.createDataFrame([(1, json.dumps(doc))], "report_id long, body string")
    assert [tuple(r) for r in drift.proposals(df, "body", drift.REPORT_SCHEMA).collect()] == [("metadata.tool.semver", "metadata.tool.version", 1)]
    none = drift.ingest(df, ["report_id"], "body", drift.REPORT_SCHEMA, approved={})
    row = none.first()
    assert row.metadata_tool_version is None and json.loads(row["_rescued"]) == {"metadata.tool.semver": '"1.0.0"', "metadata.ci": '{"job":1}', "metadata.host": '"7"'}
    some = drift.ingest(df, ["report_id"], "body", drift.REPORT_SCHEMA, approved={"metadata.tool.semver": "metadata.tool.version"}).first()
    assert some.metadata_tool_version == "1.0.0" and set(json.loads(some["_rescued"])) == {"metadata.ci", "metadata.host"}
    later = drift.promote(none, [drift.Field("metadata.host", drift.INT), drift.Field("metadata.tool.semver", drift.INT)]).first()
    assert later.metadata_host == 7 and later.metadata_tool_semver is None and set(json.loads(later["_rescued"])) == {"metadata.ci", "metadata.tool.semver"}


def test_deep_nesting_and_arrays_of_end_points(spark):
    doc = {"x": 1}
    for _ in range(40):
        doc = {"d": [doc]}
    rows = [(1, json.dumps(doc)), (2, json.dumps({"findings": [{"source": [{"method": "f"}, {"method": "g"}], "sink": "h"}]})), (3, '{"a": NaN}'), (4, '{"a": "\\ud800b"}')]
    nodes = shred.shred(spark.createDataFrame(rows, "report_id long, body string"), ["report_id"], "body", embedded=shred.EMBEDDED)
    assert nodes.where("report_id = 1").count() == 82
    assert sorted((r.node, r.node_no, r.name) for r in shred.report_parts(nodes).collect()) == [("sink", 0, "h"), ("source", 0, "f"), ("source", 1, "g")]
    assert {r.report_id for r in nodes.collect()} == {1, 2, 4}


def test_verification_and_slice_keep_their_links(spark):
    finding = {
        "verification": {"verdict": "uncertain", "confidence": 0.5, "attacker": {"exploitable": True, "steps": ["a"]}, "defender": {"safe": False, "lines": []}},
        "slice": {"lines": [{"line_number": 3, "code": "c", "is_trace": True, "tainted_variables": ["v", "w"]}, None]},
    }
    rows = [(1, json.dumps({"metadata": {"tool": {"version": "2"}}, "findings": [None, finding]}))]
    nodes = shred.shred(spark.createDataFrame(rows, "report_id long, body string"), ["report_id"], "body", embedded=shred.EMBEDDED)
    assert sorted(map(tuple, shred.report_verifications(nodes).collect()), key=repr) == [
        (1, 1, "attacker", None, None, True, '["a"]'), (1, 1, "defender", None, None, False, None), (1, 1, "verification", "uncertain", 0.5, None, None)]
    assert [tuple(r) for r in shred.report_slices(nodes).collect()] == [(1, 1, 0, 3, "c", True, '["v","w"]')]
    assert [tuple(r) for r in shred.report_values(nodes).collect()] == [(1, "metadata.tool.version", "2")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "report_id long, body string")
    assert drift.changes(empty, ["report_id"], "body", drift.REPORT_SCHEMA).count() == 0
    assert shred.report_parts(shred.shred(empty, ["report_id"], "body")).count() == 0


def test_shredding(spark):
    steps = [{"step_type": "source", "code": "a"}, None, {"code": "b", "step_type": None}]
    doc = {
        "findings": [
            {"source": {"method": "f", "line": 1}, "sink": [{"method": "g"}], "trace": steps},
            None,
            {"source": "h", "sink": None, "trace": {"step_type": "sink"}},
            {"trace": json.dumps(steps[:1])},
            {"source": {}, "trace": None},
        ]
    }
    rows = [(1, json.dumps(doc)), (1, json.dumps(doc)), (2, json.dumps({"findings": None})), (3, '{"findings": [')]
    nodes = shred.shred(spark.createDataFrame(rows, "report_id long, body string"), ["report_id"], "body", embedded=shred.EMBEDDED)
    parts = sorted((r.finding_no, r.node, r.node_no, r.name) for r in shred.report_parts(nodes).collect())
    assert parts == [
        (0, "sink", 0, "g"), (0, "source", 0, "f"), (0, "step", 0, "source"), (0, "step", 2, ""),
        (2, "source", 0, "h"), (2, "step", 0, "sink"), (3, "step", 0, "source"), (4, "source", 0, ""),
    ]


def test_adjacency_round_trip(spark):
    doc = {"a": [1, {"b": None}], "c": "x", "": {"d": True}, "e.f[0]": "y"}
    nodes = {r.node: r for r in shred.shred(spark.createDataFrame([(1, json.dumps(doc))], "k long, body string"), ["k"], "body").collect()}

    def build(node):
        kids = sorted((n for n in nodes.values() if n.parent == node.node and n.node != node.node), key=lambda n: n.ordinal)
        if node.kind == "object":
            return {k.label: build(k) for k in kids}
        if node.kind == "array":
            return [build(k) for k in kids]
        return None if node.kind == "null" else json.loads(node.scalar) if node.scalar in ("1", "true") else node.scalar

    assert build(nodes[""]) == doc


@pytest.mark.parametrize("extra", ["_doc", "_fields", "change", "node"])
def test_clashing_columns(spark, extra):
    df = spark.createDataFrame([(1, json.dumps(GOOD), "x")], f"report_id long, body string, {extra} string")
    assert drift.changes(df, ["report_id"], "body", drift.REPORT_SCHEMA).count() == 0
    assert shred.shred(df, ["report_id"], "body").where(F.col("kind") == "object").count() > 0
