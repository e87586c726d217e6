"""Queries over code: sources, sinks, flows and candidate functions, and views of the specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeflow.functions import scalars as fn
from lodeflow.operators import graphs, tables, taint
from lodeflow.plans import corpus, findings
from lodeflow.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLE[func.__name__] = sql
        return func

    return register


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the code contexts; where the path tells no language the code does."""
    e = table(spark, sf_dir, "training_examples").dropDuplicates(["example_id"])
    guessed = F.when(F.col("code_context").rlike(r"(?m)^\s*def "), "python").otherwise("javascript")
    named = e.withColumn("lang", F.coalesce(fn.language_of_path(F.trim("file_path")), guessed))
    return taint.code_lines(named, "example_id", "code_context", "lang")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(patterns: dict) -> str:
    rows = [f"({_quoted(lang)}, {n}, {_quoted(p)}, '{kind}', '{cwes}')" for lang, own in patterns.items() for n, (p, kind, cwes) in enumerate(own)]
    return "(values " + ", ".join(rows) + ") t(lang, ord, pattern, kind, cwes)"


_LANG = "case lower(regexp_extract(trim(file_path), '\\.([^./\\\\]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in fn.LANGUAGES.items()) + " end"
_FN = "coalesce(nullif(regexp_extract(text, '(?:\\bdef\\s+|\\bfunction\\s*\\*?\\s*)([A-Za-z_$][\\w$]*)\\s*\\(', 1), ''), nullif(regexp_extract(text, '(?:const|let|var)\\s+([A-Za-z_$][\\w$]*)\\s*=\\s*(?:async\\s*)?(?:\\([^)]*\\)|[\\w$]+)\\s*=>', 1), ''), case when regexp_matches(text, '\\([^()]*\\)\\s*=>') then '__anonymous_handler_L' || line end)"
_CODE = (
    "e as (select distinct on (example_id) * from training_examples order by example_id), "
    f"c as (select example_id, coalesce({_LANG}, case when regexp_matches(code_context, '(?m)^\\s*def ') then 'python' else 'javascript' end) as lang, string_split(code_context, chr(10)) as ls from e where code_context is not null), "
    "u as (select example_id, lang, unnest(ls) as text, generate_subscripts(ls, 1)::INT as line from c), "
    f"l as (select *, last_value(own ignore nulls) over (partition by example_id order by line) as function from (select *, {_FN} as own from u))"
)
_SOURCES = (
    "s0 as (select distinct example_id, line, function, lang, unnest(regexp_extract_all(text, '[A-Za-z_$@][\\w$]*(?:\\.[\\w$]+|\\[[^\\]]*\\])+')) as expression from l), "
    f"s1 as (select s0.*, kind, cwes, row_number() over (partition by example_id, line, expression order by ord) as rn from s0 join {_values(taint.SOURCES)} on t.lang = s0.lang "
    "and (case when s0.lang in ('javascript', 'typescript') then starts_with(expression, pattern) else contains(expression, pattern) end)), "
    "s as (select example_id, line, function, expression, kind, cwes from s1 where rn = 1)"
)
_SINKS = (
    "k0 as (select distinct example_id, line, function, lang, text, unnest(regexp_extract_all(regexp_replace(text, '(?:\\bdef|\\bfunction)\\s+[\\w$]+\\s*\\(', '(', 'g'), '[\\w$.]+\\s*\\(')) as call from l), "
    "k1 as (select *, case when lang in ('javascript', 'typescript', 'go', 'java') then regexp_replace(regexp_replace(call, '\\s*\\($', ''), '^.*\\.', '') else regexp_replace(call, '\\s*\\($', '') end as callee, substr(text, greatest(strpos(text, call), 1)) as rest from k0), "
    f"k2 as (select k1.*, kind, cwes, row_number() over (partition by example_id, line, call order by ord) as rn from k1 join {_values(taint.SINKS)} on t.lang = k1.lang and ends_with(callee, pattern)), "
    "k as (select example_id, line, function, callee, substr(rest, 1, 200) as expression, kind, cwes, case when lang = 'python' then contains(rest, 'f\"') or contains(rest, 'f' || chr(39)) else lang in ('javascript', 'typescript') and contains(rest, '`') end as uses_template from k2 where rn = 1)"
)


@_query(f"with {_CODE}, {_SOURCES} select example_id, line, function, expression, kind as source_type, cwes from s")
def taint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where code takes in untrusted data."""
    return taint.sources(_lines(spark, sf_dir), "example_id").select("example_id", "line", "function", "expression", "source_type", F.array_join("cwes", " ").alias("cwes"))


@_query(f"with {_CODE}, {_SINKS} select example_id, line, function, callee, expression, kind as sink_type, cwes, uses_template from k")
def taint_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that do harm with untrusted data."""
    return taint.sinks(_lines(spark, sf_dir), "example_id").select("example_id", "line", "function", "callee", "expression", "sink_type", F.array_join("cwes", " ").alias("cwes"), "uses_template")


_PAIRED = (
    f"with {_CODE}, {_SOURCES}, {_SINKS}, p as (select distinct s.example_id, s.line as source_line, s.expression as source_expression, k.line as sink_line, k.callee as sink_callee, k.expression as sink_expression, "
    "array_to_string(list_sort(list_intersect(string_split(s.cwes, ' '), string_split(k.cwes, ' '))), ' ') as shared, coalesce(s.function = k.function, false) as same_function, k.uses_template, abs(k.line - s.line) as distance "
    "from s join k on s.example_id = k.example_id and list_has_any(string_split(s.cwes, ' '), string_split(k.cwes, ' ')))"
)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return taint.flows(taint.sources(lines, "example_id"), taint.sinks(lines, "example_id"), "example_id")


@_query(
    _PAIRED
    + " select example_id, source_line, source_expression, sink_line, sink_callee, sink_expression, shared, same_function, round(least(0.5::DOUBLE + case when same_function then 0.3::DOUBLE else 0.0::DOUBLE end + "
    "case when uses_template then 0.4::DOUBLE else 0.0::DOUBLE end + case when distance < 10 then 0.2::DOUBLE when distance < 20 then 0.1::DOUBLE else 0.0::DOUBLE end + 0.1::DOUBLE, 0.94::DOUBLE), 6) as score from p"
)
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from sources to sinks of the same code that share a weakness, scored."""
    return _flows(spark, sf_dir).select(
        "example_id", "source_line", "source_expression", "sink_line", "sink_callee", "sink_expression", F.array_join("shared", " ").alias("shared"), "same_function", F.round("score", 6).alias("score")
    )


@_query(
    _PAIRED
    + " select factor, count(*)::BIGINT as n from (select unnest(list_filter(['base', case when same_function then 'same_function' end, case when uses_template then 'template' end, case when distance < 20 then 'near' end, 'same_file'], lambda x: x is not null)) as factor from p) group by 1"
)
def flow_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many flows each part of the score counts for."""
    return _flows(spark, sf_dir).select(F.explode(F.map_keys("factors")).alias("factor")).groupBy("factor").agg(F.count("*").alias("n"))


@_query(
    _PAIRED + ", r as (select *, row_number() over (partition by example_id order by distance, source_line, sink_line, source_expression, sink_callee, sink_expression) as rn from p) select example_id, source_line, source_expression, sink_line, sink_callee from r where rn = 1"
)
def nearest_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow of each example whose ends are nearest."""
    order = F.struct("distance", "source_line", "sink_line", "source_expression", "sink_callee", "sink_expression")
    best = _flows(spark, sf_dir).groupBy("example_id").agg(F.min(order).alias("b"))
    return best.select("example_id", "b.source_line", "b.source_expression", "b.sink_line", "b.sink_callee")


def _import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = corpus.import_edges(spark, sf_dir).where("target is not null and target != src")
    return edges.select("src", F.col("target").alias("dst")).distinct()


_IMPORTED = f"e as materialized (select distinct src, target as dst from ({corpus.ORACLE['import_edges']}) where target is not null and target <> src)"


def _ranks_sql(rounds: int) -> str:
    steps = ["v as materialized (select distinct path as node from repo_files)", "o as materialized (select src, count(*) as n from e group by 1)", "r0 as materialized (select node, 1.0::DOUBLE / (select count(*) from v) as score from v)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} as materialized (select r.node, (0.15::DOUBLE + 0.85::DOUBLE * (select coalesce(sum(score), 0) from r{i} where node not in (select src from o))) / (select count(*) from v) + 0.85::DOUBLE * coalesce(g.got, 0) as score "
            f"from r{i} r left join (select e.dst as node, sum(q.score / o.n) as got from e join r{i} q on q.node = e.src join o on o.src = e.src group by 1) g on g.node = r.node)"
        )
    return ", ".join(steps)


_BEST = "(select max(s) from (values " + "{rows}" + ") w(p, s) where regexp_matches(lower(name), p))"


def _candidate_sql(kind: str) -> str:
    rows = ", ".join(f"({_quoted(p)}, {s}::DOUBLE)" for p, s in taint.NAMES[kind])
    told = " + ".join(f"contains(imported, '{w}')::INT" for w in taint.IMPORTS[kind].split())
    return f"select path, name, '{kind}' as kind, 0.5::DOUBLE * coalesce({_BEST.format(rows=rows)}, 0) as part, 0.2::DOUBLE * least(0.5::DOUBLE, ({told}) * 0.2::DOUBLE) + 0.3::DOUBLE * rank as more from x"


_CANDIDATES = (
    f"with {_IMPORTED}, {_ranks_sql(10)}, b as (select min(score) as lo, max(score) as hi from r10), m as (select node, case when hi = lo then 1.0::DOUBLE else (score - lo) / (hi - lo) end as rank from r10, b), "
    "f as (select distinct on (path) * from repo_files order by path), x as (select distinct path, unnest(exports) as name, lower(array_to_string(coalesce(imports, []), ' ')) as imported, coalesce(rank, 0) as rank from f left join m on m.node = path), "
    "c as (select path, name, kind, part + more as score from (" + " union all ".join(_candidate_sql(k) for k in taint.NAMES) + ") where part > 0)"
)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.files(spark, sf_dir)
    ranks = graphs.min_max(graphs.pagerank(files.select(F.col("path").alias("node")), _import_graph(spark, sf_dir), 10), "score").select(F.col("node").alias("path"), F.col("score").alias("rank"))
    named = files.select("path", "imports", F.explode(F.array_distinct("exports")).alias("name")).join(ranks, "path", "left")
    return taint.candidates(named, "name", "imports", "rank").select("path", "name", "kind", F.round("score", 6).alias("score"))


@_query(_CANDIDATES + " select path, name, kind, round(score, 6) as score from c")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported functions as candidates, by their names, the imports of their file and its rank."""
    return _candidates(spark, sf_dir)


@_query(_CANDIDATES + ", t as (select path, name, kind, round(score, 6) as score from c) select * from t where score >= 0.1 order by score desc, path, name, kind limit 100")
def candidate_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best candidates of all kinds: a report's top list."""
    return tables.top_k(_candidates(spark, sf_dir).where("score >= 0.1"), 100, F.desc("score"), "path", "name", "kind")


@_query(f"with {_IMPORTED} select dst as path, count(*)::BIGINT as n_importing from e group by 1 order by n_importing desc, path limit 20")
def most_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty files that most others import: a top list."""
    return tables.top_k(_import_graph(spark, sf_dir).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_importing")), 20, F.desc("n_importing"), "path")


@_query(f"with {_IMPORTED}, f as (select distinct path from repo_files) select path, (select count(*) from e where src = path)::BIGINT as n_dependencies, (select count(*) from e where dst = path)::BIGINT as n_dependents from f")
def file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies and dependents of each file in the import graph."""
    found = graphs.degrees(corpus.files(spark, sf_dir).select(F.col("path").alias("node")), _import_graph(spark, sf_dir))
    return found.select(F.col("node").alias("path"), F.col("out_degree").alias("n_dependencies"), F.col("in_degree").alias("n_dependents"))


@_query(
    "select coalesce(language, 'other') as language, string_agg(ext, ',' order by ext) as extensions, sum(n)::BIGINT as n_files from (select "
    + "case lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in fn.LANGUAGES.items()) + " end as language, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ext, count(distinct path) as n from repo_files group by 1, 2) group by 1"
)
def language_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extensions of each language with their files."""
    f = corpus.files(spark, sf_dir).select(F.coalesce(fn.language_of_path(F.col("path")), F.lit("other")).alias("language"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    return f.groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"), F.count("*").alias("n_files"))


_METHODS = "(select 'source' as kind, source.method as method, confidence, vulnerability_type as type from {0} where source.method is not null union all select 'sink', sink.method, confidence, vulnerability_type from {0} where sink.method is not null)".format("(select distinct on (id) * from findings order by id)")


@_query(
    f"select kind, count(distinct method)::BIGINT as n_methods, count(distinct case when confidence >= 0.8::DOUBLE then method end)::BIGINT as n_sure, count(distinct case when kind = 'sink' then type end)::BIGINT as n_types from {_METHODS} group by 1"
)
def spec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by role, those that are sure, and the weaknesses of sinks."""
    f = findings.findings(spark, sf_dir)
    sides = F.array(*(F.struct(F.lit(s).alias("kind"), F.col(f"{s}.method").alias("method")) for s in ("source", "sink")))
    rows = f.select("confidence", F.col("vulnerability_type").alias("type"), F.explode(sides).alias("s")).where("s.method is not null")
    sure, typed = F.when(F.col("confidence") >= 0.8, F.col("s.method")), F.when(F.col("s.kind") == "sink", F.col("type"))
    return rows.groupBy("s.kind").agg(F.count_distinct("s.method").alias("n_methods"), F.count_distinct(sure).alias("n_sure"), F.count_distinct(typed).alias("n_types"))


@_query("with b as (select distinct on (entry_id) * from baseline_entries order by entry_id) select coalesce(lower(trim(status)), 'active') as status, count(*)::BIGINT as n, count(distinct vulnerability_type)::BIGINT as n_types, max(last_seen) as newest from b group by 1")
def baseline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline entries by status."""
    b = table(spark, sf_dir, "baseline_entries").dropDuplicates(["entry_id"])
    return b.groupBy(F.coalesce(F.lower(F.trim("status")), F.lit("active")).alias("status")).agg(F.count("*").alias("n"), F.count_distinct("vulnerability_type").alias("n_types"), F.max("last_seen").alias("newest"))
