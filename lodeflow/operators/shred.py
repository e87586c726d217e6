"""Adjacency-table shredding of nested JSON documents into related flat tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeflow.session import spread

_COLUMNS = ("node", "parent", "label", "ordinal", "kind", "scalar")
_FORM = "node string, parent string, label string, ordinal int, kind string, scalar string"
#: Nodes that leave a task in one batch.
OUT_ROWS = 100_000
_PLAIN = re.compile(r"[^.\[\]]+")


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def _whole(text: str) -> str:
    """A text that can be written as UTF-8: half surrogate pairs become the replacement character."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Number(str):
    """A number as it was written."""


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_no_constant)


def _encode(value: object) -> str:
    """Compact JSON of a parsed value, numbers as they were written."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_encode(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_encode, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _nodes(body: str | None, embedded: frozenset[str]) -> Iterator[tuple[str, str | None, str, int, str, str | None]]:
    """The nodes of one document, parents first; nothing if it is damaged."""
    if body is None:
        return
    try:
        root = _DECODER.decode(body.strip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return
    open_nodes: list[tuple[str, str | None, str, int, object]] = [("", None, "", 0, root)]
    while open_nodes:
        node, parent, label, ordinal, value = open_nodes.pop()
        if isinstance(value, str) and label in embedded and not isinstance(value, _Number) and value.lstrip()[:1] in ("[", "{"):
            try:
                value = _DECODER.decode(value.strip())
            except (ValueError, RecursionError):
                pass
        if isinstance(value, dict):
            yield node, parent, label, ordinal, "object", None
            start = f"{node}." if parent is not None or node else ""
            names = [(k, k if _PLAIN.fullmatch(k) else f'"{k}"') for k in value]
            open_nodes += [(start + _whole(n), node, _whole(k), i, value[k]) for i, (k, n) in reversed(list(enumerate(names)))]
        elif isinstance(value, list):
            leaves = value and not any(isinstance(x, dict | list) for x in value)
            yield node, parent, label, ordinal, "array", _whole(_encode(value)) if leaves else None
            open_nodes += [(f"{node}[{i}]", node, label, i, x) for i, x in reversed(list(enumerate(value)))]
        elif value is None:
            yield node, parent, label, ordinal, "null", None
        elif isinstance(value, bool):
            yield node, parent, label, ordinal, "scalar", "true" if value else "false"
        else:
            yield node, parent, label, ordinal, "scalar", _whole(value)


def shred(df: DataFrame, keys: list[str], body: str, embedded: list[str] | None = None) -> DataFrame:
    """The adjacency table of JSON documents: keys, node, parent, label, ordinal, kind, scalar.

    ``node`` is the path of a node and unique in its document (field names that are empty or hold
    dots or brackets are quoted); ``parent`` points to the node that holds it; ``label`` is the field name
    (array elements carry their array's); ``ordinal`` is the place among the siblings; ``kind`` is object,
    array, null or scalar; ``scalar`` the text of a scalar, numbers as written, or the JSON of an array of scalars. Nodes are followed to any depth; as in
    Spark's own readers a document whose nesting can't be parsed (some thousand levels) is damaged.
    Fields named in ``embedded`` may hold their JSON as text, which is then looked into.
    Damaged, empty and null documents give no rows; a null element keeps its ordinal; of repeated field names in an object
    the last counts. Depth has no bound that columns could be declared for, so documents are walked in
    Arrow batches: one pass, no shuffle.
    """
    inner = frozenset(embedded or [])
    rows = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(body).cast("string").alias("body"))
    form = ", ".join(f"k{i} {kind}" for i, (_, kind) in enumerate(rows.drop("body").dtypes))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(i) for i in range(len(keys))]
            at: list[int] = []
            found: list[tuple] = []

            def flush() -> pa.RecordBatch:
                take = pa.array(at, pa.int64())
                columns = list(zip(*found, strict=True)) or [[]] * len(_COLUMNS)
                kinds = [pa.int32() if c == "ordinal" else pa.string() for c in _COLUMNS]
                out = pa.RecordBatch.from_arrays([*(h.take(take) for h in held), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*(f"k{i}" for i in range(len(keys))), *_COLUMNS])
                at.clear()
                found.clear()
                return out

            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                before = len(found)
                found += _nodes(text, inner)
                at += [row] * (len(found) - before)
                if len(found) >= OUT_ROWS:
                    yield flush()
            yield flush()

    nodes = spread(rows).mapInArrow(walk, f"{form}, {_FORM}" if form else _FORM)
    return nodes.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *_COLUMNS)


def entities(nodes: DataFrame, keys: list[str], is_entity: str, fields: dict[str, str]) -> DataFrame:
    """Join object nodes with their scalar children and pivot: one row per entity node.

    ``is_entity`` is a condition on the adjacency columns; ``fields`` maps child labels to
    column names (an array of scalars gives its JSON). An entity that is itself a scalar has its text in ``own``. Rows of an entity
    and of its children meet in one grouped pass over the adjacency table, which only holds the
    rows concerned when it is shuffled.
    """
    wanted = ", ".join(f"'{x}'" for x in fields)
    rows = nodes.withColumn("_is", F.expr(f"({is_entity}) and kind != 'null'")).where(f"_is or (label in ({wanted}) and scalar is not null)")
    rows = rows.withColumn("_entity", F.expr("if(_is, node, parent)"))
    found = [F.max(F.expr(f"if(not _is and label = '{label}', scalar, null)")).alias(name) for label, name in fields.items()]
    own = [F.max(F.expr(f"if(_is, {c}, null)")).alias(c) for c in ("label", "ordinal", "kind")]
    return (
        rows.groupBy(*keys, "_entity")
        .agg(F.max("_is").alias("_is"), *own, F.max(F.expr("if(_is and kind = 'scalar', scalar, null)")).alias("own"), *found)
        .where("_is")
        .drop("_is")
        .withColumnRenamed("_entity", "node")
    )


_AT = "^findings(\\\\[[0-9]+\\\\])?"
#: An end point of a finding: an object or a bare method name, alone or in an array.
END_POINT = f"node rlike '{_AT}\\\\.(source|sink)(\\\\[[0-9]+\\\\])?$' and kind in ('object', 'scalar')"
#: A step of a trace: an element of the array, or a lone object.
STEP = f"node rlike '{_AT}\\\\.trace(\\\\[[0-9]+\\\\])?$' and kind in ('object', 'scalar')"
FINDING = f"node rlike '{_AT}$' and kind = 'object'"
VERIFICATION = f"node rlike '{_AT}\\\\.verification$' and kind = 'object'"
OPINION = f"node rlike '{_AT}\\\\.verification\\\\.(attacker|defender)$' and kind = 'object'"
SLICE_LINE = f"node rlike '{_AT}\\\\.slice\\\\.lines\\\\[[0-9]+\\\\]$' and kind = 'object'"
EMBEDDED = ["findings", "source", "sink", "trace", "verification", "slice"]


def _finding_no() -> F.Column:
    return F.expr("coalesce(try_cast(regexp_extract(node, '^findings\\\\[([0-9]+)\\\\]', 1) as int), 0)")


def _place() -> F.Column:
    """The place of a node in the array that holds it, 0 for a lone one."""
    return F.expr("coalesce(try_cast(regexp_extract(node, '[^.]\\\\[([0-9]+)\\\\]$', 1) as int), 0)")


def report_findings(nodes: DataFrame) -> DataFrame:
    """One row per finding: report_id, finding_no, finding_id, vulnerability_type, severity, description."""
    rows = entities(nodes, ["report_id"], FINDING, {"id": "finding_id", "vulnerability_type": "vulnerability_type", "severity": "severity", "description": "description"})
    return rows.select("report_id", _finding_no().alias("finding_no"), "finding_id", "vulnerability_type", "severity", "description")


def report_parts(nodes: DataFrame) -> DataFrame:
    """One row per source, sink and step: report_id, finding_no, node, node_no, name, file, line, code.

    A part in another shape counts as its usual one: a bare string as an end point's method, a lone trace object as the
    only step, JSON text as what it holds. End points in an array are one row each, numbered by their place like steps.
    """
    rows = entities(
        nodes, ["report_id"], f"({END_POINT}) or ({STEP})", {"method": "method", "step_type": "step_type", "file": "file", "line": "line", "code": "code"}
    )
    step = F.col("label") == "trace"
    return rows.select(
        "report_id",
        _finding_no().alias("finding_no"),
        F.when(step, "step").otherwise(F.col("label")).alias("node"),
        _place().alias("node_no"),
        F.when(step, F.coalesce("step_type", F.lit(""))).otherwise(F.coalesce("method", "own", F.lit(""))).alias("name"),
        "file",
        F.expr("try_cast(line as int)").alias("line"),
        "code",
    )


def report_verifications(nodes: DataFrame) -> DataFrame:
    """One row per verification and opinion in it: report_id, finding_no, node, verdict, confidence, holds, details.

    ``node`` is verification, attacker or defender; ``holds`` whether the attacker found it exploitable or the
    defender safe; ``details`` the attacker's steps or the defender's lines as JSON.
    """
    fields = {"verdict": "verdict", "confidence": "confidence", "exploitable": "exploitable", "safe": "safe", "steps": "steps", "lines": "lines"}
    rows = entities(nodes, ["report_id"], f"({VERIFICATION}) or ({OPINION})", fields)
    return rows.select(
        "report_id",
        _finding_no().alias("finding_no"),
        F.col("label").alias("node"),
        "verdict",
        F.expr("try_cast(confidence as double)").alias("confidence"),
        F.expr("try_cast(coalesce(exploitable, safe) as boolean)").alias("holds"),
        F.coalesce("steps", "lines").alias("details"),
    )


def report_slices(nodes: DataFrame) -> DataFrame:
    """One row per line of a slice: report_id, finding_no, line_no (from 0), line_number, code, is_trace, variables (JSON)."""
    fields = {"line_number": "line_number", "code": "code", "is_trace": "is_trace", "tainted_variables": "variables"}
    rows = entities(nodes, ["report_id"], SLICE_LINE, fields)
    return rows.select(
        "report_id",
        _finding_no().alias("finding_no"),
        _place().alias("line_no"),
        F.expr("try_cast(line_number as int)").alias("line_number"),
        "code",
        F.expr("try_cast(is_trace as boolean)").alias("is_trace"),
        "variables",
    )


def report_values(nodes: DataFrame) -> DataFrame:
    """Scalars of a report's metadata and summary: report_id, path, value."""
    return nodes.where("kind = 'scalar' and node rlike '^(metadata|summary)[.]'").select("report_id", F.col("node").alias("path"), F.col("scalar").alias("value")).distinct()
