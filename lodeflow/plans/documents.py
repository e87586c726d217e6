"""Queries over the JSON report tables (problems 1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeflow.operators import drift, shred
from lodeflow.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a report against the declared schema."""
    return drift.changes(table(spark, sf_dir, "findings_files"), ["report_id"], "body", drift.REPORT_SCHEMA)


@_query
def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports in one consistent table, with what fits no column in the rescue column."""
    return drift.ingest(table(spark, sf_dir, "findings_files"), ["report_id"], "body", drift.REPORT_SCHEMA)


@_query
def p1_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reports have each change."""
    return drift.drift_report(p1_found(spark, sf_dir))


_FINDINGS = (
    "with r as (select distinct report_id, regexp_replace(body, '^[\\x{FEFF}\\s]+', '') as b from cerberus_results), v as (select report_id, b::JSON as j from r where json_valid(b)), "
    "n as (select report_id, j, unnest(range(json_array_length(j, '$.findings')::BIGINT)) as i from v where json_type(j, '$.findings') = 'ARRAY'), "
    "f as (select report_id, i::INT as finding_no, json_extract(j, '$.findings[' || i || ']') as x from n) "
)
_END = (
    "select report_id, finding_no, '{0}' as node, 0 as node_no, coalesce(case json_type(x, '$.{0}') when 'VARCHAR' then json_extract_string(x, '$.{0}') when 'ARRAY' then json_extract_string(x, '$.{0}[0].method') "
    "else json_extract_string(x, '$.{0}.method') end, '') as name from f where json_type(x, '$.{0}') in ('OBJECT', 'VARCHAR') or json_type(x, '$.{0}[0]') in ('OBJECT', 'VARCHAR')"
)
ORACLE["p2_found"] = (
    _FINDINGS
    + _END.format("source")
    + " union all "
    + _END.format("sink")
    + " union all select report_id, finding_no, 'step', k::INT, coalesce(json_extract_string(t, '$[' || k || '].step_type'), '') from (select report_id, finding_no, t, unnest(range(json_array_length(t)::BIGINT)) as k from "
    "(select report_id, finding_no, case json_type(x, '$.trace') when 'VARCHAR' then json_extract_string(x, '$.trace')::JSON when 'OBJECT' then json_array(json_extract(x, '$.trace')) else json_extract(x, '$.trace') end as t "
    "from f where json_type(x, '$.trace') in ('VARCHAR', 'OBJECT', 'ARRAY'))) where json_type(t, '$[' || k || ']') = 'OBJECT'"
)
ORACLE["p2_findings"] = _FINDINGS + (
    "select report_id, finding_no, json_extract_string(x, '$.id') as finding_id, json_extract_string(x, '$.vulnerability_type') as vulnerability_type, json_extract_string(x, '$.severity') as severity, "
    "json_extract_string(x, '$.description') as description from f where json_type(x) = 'OBJECT'"
)


_VERIFIED = _FINDINGS + (
    "select distinct report_id, finding_no, node, verdict, confidence, holds, details from ("
    "select report_id, finding_no, 'verification' as node, json_extract_string(x, '$.verification.verdict') as verdict, json_extract_string(x, '$.verification.confidence')::DOUBLE as confidence, null::BOOLEAN as holds, null::VARCHAR as details "
    "from f where json_type(x, '$.verification') = 'OBJECT' union all "
    "select report_id, finding_no, 'attacker', null, null, json_extract_string(x, '$.verification.attacker.exploitable')::BOOLEAN, nullif(json_extract(x, '$.verification.attacker.steps')::VARCHAR, '[]') "
    "from f where json_type(x, '$.verification.attacker') = 'OBJECT' union all "
    "select report_id, finding_no, 'defender', null, null, json_extract_string(x, '$.verification.defender.safe')::BOOLEAN, nullif(json_extract(x, '$.verification.defender.lines')::VARCHAR, '[]') "
    "from f where json_type(x, '$.verification.defender') = 'OBJECT')"
)
_SLICED = _FINDINGS + (
    "select report_id, finding_no, k::INT as line_no, json_extract_string(l, '$[' || k || '].line_number')::INT as line_number, json_extract_string(l, '$[' || k || '].code') as code, "
    "json_extract_string(l, '$[' || k || '].is_trace')::BOOLEAN as is_trace, nullif(json_extract(l, '$[' || k || '].tainted_variables')::VARCHAR, '[]') as variables from "
    "(select report_id, finding_no, l, unnest(range(json_array_length(l)::BIGINT)) as k from (select report_id, finding_no, json_extract(x, '$.slice.lines') as l from f where json_type(x, '$.slice.lines') = 'ARRAY')) "
    "where json_type(l, '$[' || k || ']') = 'OBJECT'"
)
#: The children that a part takes as columns; a code of several lines is a JSON array.
_PART = "json_extract_string({0}, '$.file') as file, try_cast(json_extract_string({0}, '$.line') as INT) as line, case when json_type({0}, '$.code') = 'ARRAY' then json_extract({0}, '$.code')::VARCHAR else json_extract_string({0}, '$.code') end as code"
_ENDS = (
    "select report_id, finding_no, '{0}' as node, case when json_type(x, '$.{0}') = 'VARCHAR' then json_extract_string(x, '$.{0}') else coalesce(json_extract_string(e, '$.method'), '') end as name, "
    + _PART.format("e")
    + " from (select report_id, finding_no, x, case json_type(x, '$.{0}') when 'ARRAY' then json_extract(x, '$.{0}[0]') else json_extract(x, '$.{0}') end as e from f where json_type(x, '$.{0}') in ('OBJECT', 'ARRAY', 'VARCHAR'))"
)
_STEPS = (
    "select report_id, finding_no, 'step' as node, k::INT as node_no, coalesce(json_extract_string(s, '$.step_type'), '') as name, "
    + _PART.format("s")
    + " from (select report_id, finding_no, k, json_extract(t, '$[' || k || ']') as s from (select report_id, finding_no, t, unnest(range(json_array_length(t)::BIGINT)) as k from "
    "(select report_id, finding_no, case json_type(x, '$.trace') when 'VARCHAR' then json_extract_string(x, '$.trace')::JSON when 'OBJECT' then json_array(json_extract(x, '$.trace')) else json_extract(x, '$.trace') end as t "
    "from f where json_type(x, '$.trace') in ('VARCHAR', 'OBJECT', 'ARRAY')))) where json_type(s) = 'OBJECT'"
)
ORACLE["p2_verifications"] = _VERIFIED
ORACLE["p2_slices"] = _SLICED
ORACLE["p2_parts"] = (
    _FINDINGS
    + " select report_id, finding_no, node, 0 as node_no, name, file, line, code from ("
    + _ENDS.replace("{0}", "source")
    + " union all "
    + _ENDS.replace("{0}", "sink")
    + ") union all select report_id, finding_no, node, node_no, name, file, line, code from ("
    + _STEPS
    + ")"
)
_TREE = (
    "with r as (select distinct report_id, regexp_replace(body, '^[\\x{FEFF}\\s]+', '') as b from cerberus_results), v as (select report_id, b::JSON as j from r where json_valid(b)), "
    "t as (select report_id, e.* from v, json_tree(v.j) e) "
)
ORACLE["p2_values"] = _TREE + (
    "select report_id, replace(ltrim(fullkey, '$.'), '\"', '') as path, trim(value::VARCHAR, '\"') as value from t where (fullkey like '$.metadata.%' or fullkey like '$.summary.%') and type not in ('OBJECT', 'ARRAY', 'NULL')"
)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shred(table(spark, sf_dir, "cerberus_results"), ["report_id"], "body", embedded=shred.EMBEDDED)


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, sinks and trace steps with the keys of their report and finding."""
    return shred.report_parts(_nodes(spark, sf_dir)).select("report_id", "finding_no", "node", "node_no", "name")


@_query
def p2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of findings."""
    return shred.report_findings(_nodes(spark, sf_dir))


@_query
def p2_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End points and steps with file, line and code."""
    return shred.report_parts(_nodes(spark, sf_dir))


@_query
def p2_verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifications with the opinions they rest on."""
    return shred.report_verifications(_nodes(spark, sf_dir))


@_query
def p2_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the slices."""
    return shred.report_slices(_nodes(spark, sf_dir))


@_query
def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalars of the reports' metadata and summaries."""
    return shred.report_values(_nodes(spark, sf_dir))


@_query
def p2_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the adjacency tables by label and kind, over all reports; re-delivered ones count once."""
    return _nodes(spark, sf_dir).dropDuplicates(["report_id", "node"]).groupBy("label", "kind").agg(F.count("*").alias("n_nodes"))
