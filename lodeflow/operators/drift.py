"""Schema drift: rescue-column ingestion of JSON documents against a declared schema.

The documents are parsed once as variants. Fields that match the declared schema fill typed
columns; everything else stays in a rescue map (path -> JSON text), from which promoted
fields and convertible values are replayed into the typed columns. All work is row-local
JVM expressions: no shuffle, whatever the number of documents.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from lodeflow.session import spread

INT, NUMBER, STRING, OBJECT, ARRAY = "int", "number", "string", "object", "array"


@dataclass(frozen=True)
class Field:
    """A declared field.

    ``shape`` is a regex that the text of its values matches, if it has one; ``loose`` one that
    the JSON text of the same value matches when it is written as another type. ``unit`` is a regex of
    the unit that a number may carry in text; ``reader`` an expression over ``{raw}`` (JSON text) that reads
    a value of another type as this field's text, null where it can't.
    """

    path: str
    kind: str
    shape: str | None = None
    loose: str | None = None
    unit: str | None = None
    reader: str | None = None

    @property
    def parent(self) -> str:
        return self.path.rpartition(".")[0]

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]


@dataclass(frozen=True)
class DeclaredSchema:
    """Leaf fields plus objects with free keys; parents of leaves are objects that are looked into."""

    leaves: tuple[Field, ...]
    parents: tuple[Field, ...] = field(init=False)

    def __post_init__(self) -> None:
        seen: dict[str, None] = {}
        for leaf in self.leaves:
            parts = leaf.path.split(".")
            for i in range(1, len(parts)):
                seen.setdefault(".".join(parts[:i]))
        object.__setattr__(self, "parents", tuple(Field(p, OBJECT) for p in sorted(seen, key=lambda p: p.count("."))))

    @property
    def nodes(self) -> tuple[Field, ...]:
        return self.parents + self.leaves

    def children(self, parent: str) -> list[str]:
        return [n.name for n in self.nodes if n.parent == parent]


def _kind_sql(kind_of: str) -> str:
    """The JSON kind of a variant's schema text.

    A whole number beyond 18 digits is a decimal of scale 0; a shorter decimal of scale 0
    was written with a fraction (``1.0``) and is a number.
    """
    precision = f"int(regexp_extract({kind_of}, 'DECIMAL\\\\((\\\\d+),', 1))"
    return (
        f"case when {kind_of} is null then null when {kind_of} = 'VOID' then 'null'"
        f" when {kind_of} like 'OBJECT%' then 'object' when {kind_of} like 'ARRAY%' then 'array'"
        f" when {kind_of} = 'STRING' then 'string' when {kind_of} = 'BOOLEAN' then 'boolean' when {kind_of} = 'BIGINT' then 'int'"
        f" when {kind_of} like 'DECIMAL%,0)' and {precision} > 18 then 'int'"
        f" when {kind_of} like 'DECIMAL%' or {kind_of} in ('DOUBLE', 'FLOAT') then 'number' else lower({kind_of}) end"
    )


def _entries_sql(doc: str, parent: str) -> str:
    """The fields directly under an object: path, parent, name, kind, and the value ``v`` as it is."""
    at = f"$.{parent}" if parent else "$"
    prefix = f"'{parent}.' || " if parent else ""
    members = f"try_variant_get({doc}, '{at}', 'map<string,variant>')"
    return (
        f"coalesce(transform(map_entries({members}), e -> named_struct('path', {prefix}e.key, 'parent', '{parent}', 'name', e.key,"
        f" 'kind', {_kind_sql('schema_of_variant(e.value)')}, 'v', e.value)), array())"
    )


#: What is written out of a value, of those fields only that are looked at: its plain text and its JSON.
_TEXT, _RAW = "try_variant_get(f.v, '$', 'string')", "to_json(f.v)"


def _plain(name: str) -> str:
    return f"regexp_replace(lower({name}), '[^a-z0-9]', '')"


def _score_sql(node: Field, schema: DeclaredSchema) -> str:
    """How well an undeclared field ``a`` carries the value of the missing field; 0 is not at all.

    The same kind of value counts under the same parent (or anywhere if the value has a telling
    shape); elsewhere, or with another kind, the names must be related.
    """
    mine = "'" + re.sub("[^a-z0-9]", "", node.name.lower()) + "'"
    related = f"(contains(a.plain, {mine}) or (length(a.plain) >= 3 and contains({mine}, a.plain)))"
    near = f"a.parent = '{node.parent}'"
    if node.kind == OBJECT and node in schema.parents:
        inner = "array(" + ",".join(f"'{c}'" for c in schema.children(node.path)) + ")"
        fits = f"a.kind = 'object' and size(array_intersect(a.keys, {inner})) * 2 >= size({inner})"
        return f"case when {fits} then 4 + int({near}) + 2 * int({related}) when {near} and a.plain = {mine} then 3 else 0 end"
    kinds = {INT: "('int')", NUMBER: "('int','number')"}.get(node.kind, f"('{node.kind}')")
    same = f"a.kind in {kinds}"
    if node.shape:
        shaped = f"{same} and a.text rlike '{node.shape}'"
        loose = f"a.raw rlike '{node.loose}'" if node.loose else "false"
        return f"case when {shaped} then 4 + int({near}) + 2 * int({related}) when {related} or ({near} and {loose}) then 1 + int({near}) + int({related}) else 0 end"
    if node.kind in (INT, NUMBER):
        loose = "a.kind in ('string', 'number') and try_cast(a.text as double) is not null"
        return f"case when {same} and ({near} or {related}) then 4 + int({near}) + 2 * int({related}) when {related} or ({near} and {loose}) then 1 + int({near}) + int({related}) + int({loose}) else 0 end"
    return f"case when {same} and {related} then 4 + int({near}) when {near} and a.plain = {mine} then 2 else 0 end"


def _fits_sql(node: Field, kind: str) -> str:
    """Whether a JSON kind is the declared one (null is no value of any; an integer is a number too)."""
    return f"{kind} in " + ({NUMBER: "('number','int')"}.get(node.kind, f"('{node.kind}')"))


def enforce(df: DataFrame, body: str, schema: DeclaredSchema, prefix: str = "_") -> DataFrame:
    """Enforce the declared schema: add ``_typed``, ``_rescue``, ``_missing`` and ``_renamed``.

    ``_typed`` holds the fields of the declared JSON type (path -> text and raw JSON); ``_rescue`` all others, unknown
    or of another type, with their path, kind, text and raw JSON; ``_missing`` the declared fields that aren't there, and ``_renamed``
    those of them that a rescued field carries (declared -> found path). Null values are in none.
    Damaged documents (null, empty, cut off, or no object) have null in all four. A byte order
    mark or blanks around the document do no harm.
    """
    doc = F.try_parse_json(F.regexp_replace(F.col(body), "^[\\uFEFF\\s]+|\\s+$", ""))
    out = df.withColumn(f"{prefix}doc", doc).withColumn(
        f"{prefix}doc", F.expr(f"case when schema_of_variant({prefix}doc) like 'OBJECT%' then {prefix}doc end")
    )
    entries = ", ".join(_entries_sql(f"{prefix}doc", p) for p in ["", *(n.path for n in schema.parents)])
    out = out.withColumn(f"{prefix}fields", F.expr(f"case when {prefix}doc is not null then concat({entries}) end"))
    by_path: dict[str, list[str]] = {}
    for n in schema.nodes:
        by_path.setdefault(_fits_sql(n, "f.kind"), []).append(n.path)
    fits = " or ".join(f"({kind} and f.path in ({', '.join(repr(p) for p in paths)}))" for kind, paths in by_path.items())
    kept = "f.kind != 'null'"
    rescued = (
        f"transform(filter({prefix}fields, f -> {kept} and not ({fits})), f -> named_struct('path', f.path, 'parent', f.parent, 'name', f.name, 'kind', f.kind, 'raw', {_RAW}, 'text', {_TEXT},"
        " 'keys', coalesce(map_keys(try_variant_get(f.v, '$', 'map<string,variant>')), array())))"
    )
    out = out.withColumn(f"{prefix}rescue", F.expr(rescued))
    out = out.withColumn(f"{prefix}typed", F.expr(f"map_from_entries(transform(filter({prefix}fields, f -> {kept} and ({fits})), f -> struct(f.path, struct({_TEXT} as text, {_RAW} as raw))))"))
    out = out.withColumn(f"{prefix}there", F.expr(f"map_from_entries(transform({prefix}fields, f -> struct(f.path, f.kind)))"))
    declared = "array(" + ", ".join(f"'{n.path}'" for n in schema.nodes) + ")"
    missing = ", ".join(
        f"case when {prefix}there['{n.path}'] is null" + (f" and {prefix}there['{n.parent}'] = 'object'" if n.parent else "") + f" then '{n.path}' end" for n in schema.nodes
    )
    out = out.withColumn(f"{prefix}missing", F.expr(f"case when {prefix}doc is not null then array_compact(array({missing})) end"))
    bare = f"filter({prefix}rescue, a -> not array_contains({declared}, a.path))"
    extra = f"transform({bare}, a -> named_struct('path', a.path, 'parent', a.parent, 'name', a.name, 'kind', a.kind, 'raw', a.raw, 'text', a.text, 'keys', a.keys, 'plain', {_plain('a.name')}))"
    pairs = ", ".join(
        f"if(array_contains({prefix}missing, '{n.path}'), filter(transform({prefix}extra, a -> named_struct('score', {_score_sql(n, schema)}, 'declared', '{n.path}', 'found', a.path)), s -> s.score > 0), array())"
        for n in schema.nodes
    )
    out = out.withColumn(f"{prefix}extra", F.expr(f"case when size({prefix}missing) > 0 then {extra} else array() end"))
    # Greedy matching of the best pairs first; each side is used once.
    out = out.withColumn(f"{prefix}pairs", F.expr(f"case when size({prefix}missing) > 0 and size({prefix}extra) > 0 then reverse(array_sort(flatten(array({pairs})))) end"))
    pick = (
        f"aggregate(coalesce({prefix}pairs, array()), cast(array() as array<struct<score:int,declared:string,found:string>>),"
        " (acc, p) -> if(exists(acc, q -> q.declared = p.declared or q.found = p.found), acc, concat(acc, array(p))))"
    )
    out = out.withColumn(f"{prefix}renamed", F.expr(f"case when {prefix}doc is not null then map_from_entries(transform({pick}, p -> struct(p.declared, p.found))) end"))
    return out.drop(*(f"{prefix}{c}" for c in ("doc", "fields", "there", "extra", "pairs")))


def changes(df: DataFrame, keys: list[str], body: str, schema: DeclaredSchema) -> DataFrame:
    """One row per document and changed field: ``field_path``, ``change``.

    removed, renamed, retyped or added, as the rescue column of the enforced schema tells: what it holds under a
    declared path (or one that carries a declared field) is retyped, what no declared field takes is added.
    A change of an object is one row with nothing below it.
    Null values are no change; damaged documents give no rows. Re-delivered documents count
    once (the result is made distinct on the keys, after the bodies are gone).
    """
    held = enforce(spread(df.select(*keys, body)), body, schema)
    declared = "array(" + ", ".join(f"'{n.path}'" for n in schema.nodes) + ")"
    # The declared path that a rescued one stands for, itself or by promotion.
    carried = "map_from_entries(transform(map_entries(_renamed), e -> struct(e.value, e.key)))"
    kinds = "map_from_arrays(array(" + ", ".join(f"'{n.path}'" for n in schema.nodes) + "), array(" + ", ".join(f"'{n.kind}'" for n in schema.nodes) + "))"
    held = held.withColumn("_carried", F.expr(carried))
    fits = f"(r.kind = {kinds}[_carried[r.path]] or (r.kind = 'int' and {kinds}[_carried[r.path]] = '{NUMBER}'))"
    lists = [
        "transform(filter(_missing, m -> not map_contains_key(_renamed, m)), m -> struct(m as field_path, 'removed' as change))",
        "transform(map_keys(_renamed), m -> struct(m as field_path, 'renamed' as change))",
        f"transform(filter(_rescue, r -> not array_contains({declared}, r.path) and _carried[r.path] is null), r -> struct(r.path as field_path, 'added' as change))",
        f"transform(filter(_rescue, r -> array_contains({declared}, r.path) or (_carried[r.path] is not null and not {fits})), r -> struct(coalesce(_carried[r.path], r.path) as field_path, 'retyped' as change))",
    ]
    rows = held.select(*keys, F.explode(F.expr(f"concat({', '.join(lists)})")).alias("c"))
    return rows.select(*keys, "c.field_path", "c.change").distinct()


_NUMBER = "[-+]?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?"


def _readings_sql(rescue: str) -> str:
    """What the values of a rescue column read as: path, kind, raw, text, unit, plain, as_int, as_double.

    A number must be written out in full, with nothing but a unit behind it; one that the type can't hold exactly is null.
    ``plain`` is true where nothing else stands around it.
    """
    text = "trim(r.text)"
    digits = (
        f"transform({rescue}, r -> named_struct('path', r.path, 'kind', r.kind, 'raw', r.raw, 'text', r.text, 'plain', r.text rlike '^{_NUMBER}$',"
        f" 'unit', regexp_extract({text}, '^{_NUMBER}[ ]*([a-zA-Z]*)$', 1), 'digits', if(r.kind in ('string', 'int', 'number'), regexp_extract({text}, '^({_NUMBER})[ ]*[a-zA-Z]*$', 1), null)))"
    )
    cast = f"transform({digits}, r -> named_struct('r', r, 'exact', try_cast(r.digits as decimal(38, 9)), 'd', try_cast(r.digits as double), 'i', try_cast(r.digits as bigint)))"
    return (
        f"transform({cast}, c -> named_struct('path', c.r.path, 'kind', c.r.kind, 'raw', c.r.raw, 'text', c.r.text, 'plain', c.r.plain, 'unit', c.r.unit,"
        " 'as_int', coalesce(c.i, if(c.exact = floor(c.exact), try_cast(c.exact as bigint), null)), 'as_double', if(try_cast(c.d as decimal(38, 9)) = c.exact or cast(c.d as string) = c.r.digits, c.d, null)))"
    )


def _replay_sql(leaf: Field, at: str) -> tuple[str, str]:
    """The value of a reading as the declared type, null where it doesn't convert, and whether nothing is lost by it.

    Scalars become the text they are written as; what a field's reader makes of another type keeps its original.
    """
    if leaf.kind in (INT, NUMBER):
        value = f"{at}.as_{'int' if leaf.kind == INT else 'double'}"
        unit = f"if({at}.unit = ''" + (f" or {at}.unit rlike '^(?i)(?:{leaf.unit})$'" if leaf.unit else "") + f", {value}, null)"
        return unit, f"({at}.plain and {value} is not null)"
    if leaf.kind == STRING:
        read = leaf.reader.replace("{raw}", f"{at}.raw") if leaf.reader else "cast(null as string)"
        scalar = f"if({at}.kind not in ('object', 'array'), {at}.text, null)"
        return f"case when {at}.kind = 'string' then {at}.text when {at}.kind is not null then coalesce({read}, {scalar}) end", f"(({at}.kind in ('string', 'boolean') or ({at}.kind in ('int', 'number') and {read} is null)))"
    return f"if({at}.kind = '{leaf.kind}', {at}.raw, null)", f"({at}.kind = '{leaf.kind}')"


def ingest(df: DataFrame, keys: list[str], body: str, schema: DeclaredSchema, rescue: str = "_rescued", approved: dict[str, str] | None = None) -> DataFrame:
    """One consistent table: a typed column per declared leaf (dots as ``_``) and a rescue column.

    A value comes from its declared place, from the rescued field that carries it (promotion), and where it is
    of another type from what that converts to (replay), in this order. ``approved`` names the promotions that may be made (found -> declared
    path); with null all that are found are, as ``proposals`` lists them. The rescue column keeps, as JSON text by path, what finds no typed column,
    what doesn't convert, and every original that isn't equal to its typed value after conversion. Damaged documents keep their keys
    with ``is_damaged`` true and null fields. Of re-delivered documents (equal keys) one stays, the smallest by body digest.
    """
    held = enforce(spread(df.select(*keys, body)), body, schema).withColumn("_digest", F.xxhash64(F.col(body)))
    if approved is not None:
        allowed = "array(" + ", ".join(f"'{f} {d}'" for f, d in approved.items()) + ")"
        held = held.withColumn("_renamed", F.expr(f"map_filter(_renamed, (d, f) -> array_contains(cast({allowed} as array<string>), f || ' ' || d))"))
    held = held.withColumn("_readings", F.expr(_readings_sql("_rescue")))
    held = held.withColumn("_by", F.expr("map_from_entries(transform(_readings, r -> struct(r.path, r)))"))
    # The reading that fills each leaf: of its own place, else of the promoted one.
    held = held.select("*", *(F.expr(f"coalesce(_by['{leaf.path}'], _by[_renamed['{leaf.path}']])").alias(f"_r{i}") for i, leaf in enumerate(schema.leaves)))
    columns, taken, over = [], [], []
    for i, leaf in enumerate(schema.leaves):
        replayed, whole = _replay_sql(leaf, f"_r{i}")
        own = f"_typed['{leaf.path}']"
        first = {INT: f"try_cast({own}.text as bigint)", NUMBER: f"try_cast({own}.text as double)", STRING: f"{own}.text"}.get(leaf.kind, f"{own}.raw")
        columns.append(F.expr(f"coalesce({first}, {replayed})").alias(leaf.path.replace(".", "_")))
        taken.append(f"if({whole}, _r{i}.path, null)")
        if leaf.kind == INT:  # an integer of more digits than the column holds
            over.append(f"if({own} is not null and {first} is null, struct('{leaf.path}' as path, {own}.raw as raw), null)")
    left = "transform(filter(_readings, r -> not array_contains(_taken, r.path)), r -> struct(r.path as path, r.raw as raw))"
    held = held.withColumn("_taken", F.expr(f"array_compact(array({', '.join(taken)}))"))
    rescued = F.expr(f"to_json(map_from_entries(concat({left}, array_compact(array({', '.join(over)})))))" if over else f"to_json(map_from_entries({left}))")
    rows = held.select(*keys, F.col("_rescue").isNull().alias("is_damaged"), *columns, rescued.alias(rescue), "_digest")
    names = [c for c in rows.columns if c not in keys and c != "_digest"]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("is_damaged", "_digest")).alias("_one"))
    return one.select(*keys, "_one.*")


def proposals(df: DataFrame, body: str, schema: DeclaredSchema) -> DataFrame:
    """Promotions to approve: found path, declared path, and in how many documents the one carries the other."""
    held = enforce(spread(df.select(body)), body, schema)
    pairs = F.explode(F.expr("transform(map_entries(_renamed), e -> struct(e.value as found, e.key as declared))")).alias("p")
    return held.select(pairs).groupBy("p.found", "p.declared").agg(F.count("*").alias("n_documents"))


def promote(table: DataFrame, fields: list[Field], rescue: str = "_rescued") -> DataFrame:
    """Promote approved fields of an ingested table: a typed column each, filled by replaying the rescue column.

    No document is read again. Values that don't convert exactly stay in the rescue column, as do all other fields.
    """
    out = table.withColumn("_held", F.from_json(rescue, "map<string,string>"))
    paths = "array(" + ", ".join(f"'{f.path}'" for f in fields) + ")"
    parsed = f"transform(filter(map_entries(_held), e -> array_contains({paths}, e.key)), e -> struct(e.key as path, e.value as raw, try_parse_json(e.value) as v))"
    entries = f"transform({parsed}, e -> struct(e.path as path, {_kind_sql('schema_of_variant(e.v)')} as kind, e.raw as raw, try_variant_get(e.v, '$', 'string') as text))"
    out = out.withColumn("_by", F.expr(f"map_from_entries(transform({_readings_sql(entries)}, r -> struct(r.path, r)))"))
    out = out.select("*", *(F.expr(f"_by['{f.path}']").alias(f"_r{i}") for i, f in enumerate(fields)))
    done = []
    for i, f in enumerate(fields):
        value, whole = _replay_sql(f, f"_r{i}")
        out = out.withColumn(f.path.replace(".", "_"), F.expr(value))
        done.append(f"if({whole}, '{f.path}', null)")
    kept = F.expr(f"to_json(map_filter(_held, (k, v) -> not array_contains(array_compact(array({', '.join(done)})), k)))")
    return out.withColumn(rescue, kept).drop("_held", "_by", *(f"_r{i}" for i in range(len(fields))))


def drift_report(found: DataFrame) -> DataFrame:
    """How often each change occurs, over all documents: ``field_path``, ``change``, ``n_documents``."""
    return found.groupBy("field_path", "change").agg(F.count("*").alias("n_documents"))


def schema_from_json(text: str) -> DeclaredSchema:
    """A declared schema from ``{"path": "kind" | ["kind", "shape"]}``."""
    return DeclaredSchema(tuple(Field(p, *([k] if isinstance(k, str) else k)) for p, k in json.loads(text).items()))


_STAMP = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"
_EPOCH = "^[0-9]{10}([0-9]{3})?([.][0-9]+)?$"
_VERSION = "^v?[0-9]+([.][0-9]+)+"
_PARTS_READ = "coalesce(array_join(from_json({raw}, 'array<int>'), '.'), array_join(map_values(from_json({raw}, 'map<string,int>')), '.'))"
_STAMP_READ = (
    "case when {raw} rlike '^[0-9]{10}([.][0-9]+)?$' then date_format(timestamp_micros(try_cast(try_cast({raw} as decimal(20, 6)) * 1000000 as bigint)), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")"
    " when {raw} rlike '^[0-9]{13}$' then date_format(timestamp_millis(try_cast({raw} as bigint)), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\") end"
)
_VERSION_PARTS = '^[{]"major"|^\\\\[[0-9]+(,[0-9]+)+\\\\]$'
#: The declared schema of the scan reports.
REPORT_SCHEMA = DeclaredSchema(
    (
        Field("metadata.tool.name", STRING),
        Field("metadata.tool.version", STRING, _VERSION, _VERSION_PARTS, reader=_PARTS_READ),
        Field("metadata.scan.id", STRING, "^scan-"),
        Field("metadata.scan.repository", STRING),
        Field("metadata.scan.status", STRING, "^(completed|partial|failed|running|pending|cancelled)$"),
        Field("metadata.scan.started_at", STRING, _STAMP, _EPOCH, reader=_STAMP_READ),
        Field("metadata.scan.completed_at", STRING, _STAMP, _EPOCH, reader=_STAMP_READ),
        Field("metadata.scan.duration_seconds", NUMBER, unit="s|secs?|seconds?"),
        Field("metadata.generated_at", STRING, _STAMP, _EPOCH, reader=_STAMP_READ),
        Field("summary.files_scanned", INT),
        Field("summary.lines_scanned", INT),
        Field("summary.total_findings", INT),
        Field("summary.by_verdict.true_positive", INT),
        Field("summary.by_verdict.false_positive", INT),
        Field("summary.by_verdict.uncertain", INT),
        Field("summary.by_verdict.unverified", INT),
        Field("summary.spec_inference.sources", INT),
        Field("summary.spec_inference.sinks", INT),
        Field("summary.spec_inference.sanitizers", INT),
        Field("summary.by_severity", OBJECT),
        Field("findings", ARRAY),
    )
)
