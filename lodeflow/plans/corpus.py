"""Queries over code files, training examples, documents, responses and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodeflow.functions import scalars as fn
from lodeflow.operators import cascade, flows, tables, text
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


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_files").dropDuplicates(["path"])


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "training_examples").dropDuplicates(["example_id"])


_R = "(select distinct on (path) * from repo_files order by path)"
_E = "(select distinct on (example_id) * from training_examples order by example_id)"
_L = "(select distinct on (call_id) * from llm_responses order by call_id)"
_LANG = "case lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in fn.LANGUAGES.items()) + " end"


@_query(f"select coalesce({_LANG}, 'other') as suffix_language, coalesce(lower(language), 'none') as given, count(*)::BIGINT as n from {_R} group by 1, 2")
def ext_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by suffix against the given ones."""
    by = files(spark, sf_dir).select(F.coalesce(fn.language_of_path(F.col("path")), F.lit("other")).alias("suffix_language"), F.coalesce(F.lower("language"), F.lit("none")).alias("given"))
    return by.groupBy("suffix_language", "given").agg(F.count("*").alias("n"))


@_query(f"select repository, count(*)::BIGINT as n_files, sum(lines)::BIGINT as n_lines, sum(size_bytes)::BIGINT as n_bytes, count(distinct lower(language))::BIGINT as n_languages from {_R} group by 1")
def repository_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines, bytes and languages of each repository."""
    return files(spark, sf_dir).groupBy("repository").agg(
        F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"), F.sum("size_bytes").alias("n_bytes"), F.count_distinct(F.lower("language")).alias("n_languages")
    )


@_query(f"select path from {_R} where not (regexp_matches(path, '^.*/internal/.*$') or regexp_matches(path, '^.*\\.ts$') or regexp_matches(regexp_replace(path, '^.*/', ''), '^test_.*$'))")
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no exclusion glob matches."""
    return files(spark, sf_dir).where(~fn.matches_glob(F.col("path"), ["*/internal/*", "*.ts", "test_*"])).select("path")


@_query(f"select hash, count(*)::BIGINT as n, min(path) as first_path from {_R} where hash is not null group by 1")
def hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by content hash."""
    return files(spark, sf_dir).where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


_TERMS = ("os", "sys", "http", "request", "sql", "exec", "auth")


@_query(f"select path, round(least(({' + '.join(f'''(contains(lower(array_to_string(coalesce(imports, []), ' ')), '{t}'))::INT''' for t in _TERMS)}) * 0.2::DOUBLE, 0.5::DOUBLE), 6) as score from {_R}")
def import_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling imports of each file, capped."""
    joined = F.array_join(F.coalesce("imports", F.array().cast("array<string>")), " ")
    return files(spark, sf_dir).select("path", F.round(text.term_score(joined, list(_TERMS)), 6).alias("score"))


_STEM = "regexp_replace(regexp_extract(path, '([^/]+)\\.[^.]+$', 1), '_[a-z0-9]{6}$', '')"
_DIR = "regexp_extract(path, '([^/]+)/[^/]+$', 1)"


@_query(
    f"with f as {_R}, w as (select distinct path as src, repository, unnest(imports) as module from f), "
    f"k as (select repository || ':' || {_STEM} as key, 0 as priority, path as target from f union all select repository || ':' || {_DIR}, 1, path from f), "
    "b as (select w.src, w.module, k.priority, k.target, row_number() over (partition by w.src, w.module order by k.priority, k.target) as rn from w left join k on k.key = w.repository || ':' || w.module) "
    "select src, module, target, priority::INT as priority from b where rn = 1"
)
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports resolved to a file of the repository: by stem, else by folder."""
    f = files(spark, sf_dir)
    wanted = f.select(F.col("path").alias("src"), "repository", F.explode("imports").alias("module")).distinct().withColumn("key", F.concat_ws(":", "repository", "module"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1), "_[a-z0-9]{6}$", "")
    by_stem = f.select(F.concat_ws(":", "repository", stem).alias("k"), "path")
    by_dir = f.select(F.concat_ws(":", F.col("repository"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("k"), "path")
    resolved = tables.resolve_by_priority(wanted, "key", [(by_stem, "k", "path"), (by_dir, "k", "path")])
    return resolved.select("src", "module", "target", "priority")


_SHARED = f"select example_id, {{}} from {_E}"


@_query(
    _SHARED.format(
        "round(least(0.5::DOUBLE + case when in_same_function then 0.3::DOUBLE else 0.0::DOUBLE end + case when uses_template_literal then 0.4::DOUBLE else 0.0::DOUBLE end + "
        "case when distance_lines < 10 then 0.2::DOUBLE when distance_lines < 20 then 0.1::DOUBLE else 0.0::DOUBLE end + case when in_same_file then 0.1::DOUBLE else 0.0::DOUBLE end, 0.94::DOUBLE), 6) as score"
    )
)
def flow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic scores of candidate flows."""
    score = flows.heuristic_score(F.col("in_same_function"), F.col("uses_template_literal"), F.col("distance_lines"), F.col("in_same_file"))
    return examples(spark, sf_dir).select("example_id", F.round(score, 6).alias("score"))


@_query(_SHARED.format("coalesce(" + ", ".join(f"case when list_contains(cwe_types, '{c}') then '{c}' end" for c in flows.PRIMARY_ORDER) + ", list_min(cwe_types)) as primary_cwe"))
def primary_weakness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakness that names each candidate."""
    return examples(spark, sf_dir).select("example_id", flows.primary_category(F.col("cwe_types")).alias("primary_cwe"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, route = cascade.first_tier(F.col("source_expression"), F.col("sink_expression"), F.col("code_context"), F.col("uses_template_literal"), F.col("in_same_function"))
    return examples(spark, sf_dir).withColumn("score", score).withColumn("route", route)


def _yes(condition: str, value: float) -> str:
    return f"case when coalesce({condition}, false) then {value}::DOUBLE else 0.0::DOUBLE end"


def _has(column: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_CLEAN = f"(coalesce(regexp_matches(code_context, '{cascade.SANITIZERS}'), false) or coalesce(regexp_matches(source_expression, '{cascade.SANITIZERS}'), false))"
_CONCAT = cascade.CONCATENATION.replace("'", "''")
_DIRECT = "(length(list_last(string_split(source_expression, '.'))) > 0 and contains(sink_expression, list_last(string_split(source_expression, '.'))))"
_TIER1 = (
    f"(select *, case when {_CLEAN} then 'filtered' when score >= 0.85::DOUBLE then 'high' when score >= 0.45::DOUBLE then 'review' else 'filtered' end as route from (select *, case when {_CLEAN} then 0.0::DOUBLE else least("
    f"0.5::DOUBLE + {_yes('uses_template_literal', 0.3)} + {_yes('in_same_function', 0.2)} + {_yes(f'''regexp_matches(code_context, '{_CONCAT}')''', 0.25)} + {_yes(_DIRECT, 0.15)}, 1.0::DOUBLE) end as score from {_E}))"
)


@_query(f"select example_id, round(score, 6) as score, route from {_TIER1}")
def tier1_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-tier scores and routes."""
    return _routed(spark, sf_dir).select("example_id", F.round("score", 6).alias("score"), "route")


@_query(f"select route, count(*)::BIGINT as n from {_TIER1} group by 1")
def tier1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by route."""
    return cascade.counted(_routed(spark, sf_dir), "route")


_SINK, _SRC = "lower(sink_expression)", "lower(source_expression)"
_TO_PATH, _TO_MARKUP = _has(_SINK, cascade.PATH_SINKS), _has(_SINK, cascade.MARKUP_SINKS)
_CALLEE = "lower(regexp_extract(sink_expression, '^([\\w.]+)', 1))"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TIER2 = (
    f"(select *, case when tier2 >= 0.75::DOUBLE then 'vulnerable' when tier2 <= 0.45::DOUBLE then 'safe' else 'uncertain' end as decision from (select *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
    f"score + {_yes('uses_template_literal', 0.25)} + {_yes('in_same_function', 0.15)} + {_yes('distance_lines < 10', 0.1)} + {_yes(f'list_has_any(cwe_types, {_LIST(cascade.CRITICAL)})', 0.1)}"
    f" + {_yes(_TO_PATH, 0.35)} + {_yes(f'{_TO_PATH} and {_has(_SRC, cascade.PATH_SOURCES)}', 0.15)} + {_yes(f'''{_TO_PATH} and (contains({_SRC}, '..') or contains(coalesce(code_context, ''), '..'))''', 0.2)}"
    f" + {_yes(_TO_MARKUP, 0.25)} + {_yes(f'{_TO_MARKUP} and {_has(_SRC, cascade.MARKUP_SOURCES)}', 0.1)} + {_yes(f'''{_TO_MARKUP} and {_has(_SINK, ('innerhtml', 'document.write'))}''', 0.15)} + {_yes(f'''{_TO_MARKUP} and {_has(_SINK, ('bypasssecuritytrust',))}''', 0.2)}"
    f" + {_yes('not coalesce(in_same_file, false)', -0.2)} + case when distance_lines > 100 then -0.3::DOUBLE when distance_lines > 50 then -0.15::DOUBLE else 0.0::DOUBLE end"
    f" + {_yes(_has(_CALLEE, cascade.QUIET_SINKS), -0.4)} + {_yes(_has(_SRC, cascade.QUIET_SOURCES), -0.3)} + {_yes(f'len(cwe_types) > 0 and list_has_all({_LIST(cascade.MILD)}, cwe_types)', -0.15)}"
    f" + {_yes('not (coalesce(uses_template_literal, false) or coalesce(in_same_function, false) or coalesce(distance_lines < 10, false))', -0.2)})) as tier2 from {_TIER1}))"
)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    callee = F.regexp_extract("sink_expression", r"^([\w.]+)", 1)
    score, decision = cascade.second_tier(
        F.col("score"), F.col("source_expression"), F.col("sink_expression"), callee, F.col("code_context"), F.col("cwe_types"), F.col("uses_template_literal"), F.col("in_same_function"), F.col("in_same_file"), F.col("distance_lines")
    )
    return _routed(spark, sf_dir).withColumn("tier2", score).withColumn("decision", decision)


@_query(f"select example_id, round(tier2, 6) as score, decision from {_TIER2}")
def tier2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-tier scores and decisions."""
    return _decided(spark, sf_dir).select("example_id", F.round("tier2", 6).alias("score"), "decision")


@_query(f"select route, decision, count(*)::BIGINT as n from {_TIER2} group by 1, 2")
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by route and decision."""
    return _decided(spark, sf_dir).groupBy("route", "decision").agg(F.count("*").alias("n"))


_C = f"(select count(*) filter (where label = 1 and decision = 'vulnerable') as tp, count(*) filter (where coalesce(label, 0) <> 1 and decision = 'vulnerable') as fp, count(*) filter (where label = 1 and decision <> 'vulnerable') as fn, count(*) filter (where coalesce(label, 0) <> 1 and decision <> 'vulnerable') as tn from {_TIER2})"


@_query(
    f"select (tp + fp + fn + tn)::BIGINT as n, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) as accuracy, round(tp::DOUBLE / (tp + fp), 6) as precision, round(tp::DOUBLE / (tp + fn), 6) as recall, "
    f"round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / ((tp::DOUBLE / (tp + fp)) + (tp::DOUBLE / (tp + fn))), 6) as f1, round(fp::DOUBLE / (fp + tn), 6) as fpr from {_C}"
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the second tier agrees with the labels."""
    return tables.confusion(_decided(spark, sf_dir), F.col("label") == 1, F.col("decision") == "vulnerable")


_MARK = "VULNERABILITY: (CWE-\\d+) - [^\\n]*\\(Line (\\d+)\\)"


@_query(
    f"with a as (select example_id, sink_line, unnest(regexp_extract_all(code_context, '{_MARK}', 1)) as cwe, try_cast(unnest(regexp_extract_all(code_context, '{_MARK}', 2)) as INT) as ln from {_E}) "
    "select distinct example_id, cwe, ln as annotated_line, coalesce((abs(sink_line - ln) <= 3)::INT, 0)::INT as near, max(coalesce((abs(sink_line - ln) <= 3)::INT, 0)) over (partition by example_id)::INT as label from a"
)
def annotation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All annotations in code contexts, which of them stand within three lines of the sink, and whether any does."""
    marks = F.arrays_zip(F.regexp_extract_all("code_context", F.lit(_MARK), F.lit(1)).alias("cwe"), F.regexp_extract_all("code_context", F.lit(_MARK), F.lit(2)).alias("line"))
    a = examples(spark, sf_dir).select("example_id", "sink_line", F.explode(marks).alias("m")).select("example_id", "sink_line", "m.cwe", F.expr("try_cast(m.line as int)").alias("annotated_line"))
    near = F.coalesce((F.abs(F.col("sink_line") - F.col("annotated_line")) <= 3).cast("int"), F.lit(0))
    rows = a.select("example_id", "cwe", "annotated_line", near.alias("near")).distinct()
    return rows.withColumn("label", F.max("near").over(Window.partitionBy("example_id")))  # the annotations of one text


@_query(
    f"with c as (select coalesce(label, -1) as label, count(*) as n from {_E} group by 1), r as (select example_id, coalesce(label, -1) as label, row_number() over (partition by coalesce(label, -1) order by sha256(example_id::VARCHAR), example_id) as rn from {_E}) select example_id, label::INT as label from r where rn <= (select min(n) from c)"
)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many examples of each label, chosen by digest."""
    e = examples(spark, sf_dir).select("example_id", F.coalesce("label", F.lit(-1)).alias("label"))
    return tables.balanced(e, "label", "example_id")


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as code, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)"


@_query(
    f"with l as {_LINES}, a as (select doc_id, min(line) as hit from l where regexp_matches(code, 'CWE-89') group by 1), r as (select l.doc_id, line, code, line = hit as is_hit, row_number() over (partition by l.doc_id order by (line = hit) desc, line) as rn from l join a on l.doc_id = a.doc_id and l.line between hit - 2 and hit + 2) "
    "select doc_id, line::INT as line, code, is_hit from r where is_hit or rn <= 4"
)
def slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four lines around the first mention of a weakness in each document."""
    return text.slice_around(table(spark, sf_dir, "documents"), "doc_id", "text", "CWE-89", 2, 4)


@_query(f"select doc_id, count(*)::BIGINT as n_lines, max(length(code))::INT as longest from {_LINES} group by 1")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document."""
    return text.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("code")).alias("longest"))


@_query("select source, coalesce(lang, 'none') as lang, count(*)::BIGINT as n, sum(length(text))::BIGINT as n_chars, count(distinct substr(sha256(text), 1, 16))::BIGINT as n_texts from documents group by 1, 2")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and distinct texts by source and language."""
    d = table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang"))
    return d.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count_distinct(fn.short_digest(F.col("text"))).alias("n_texts"))


@_query(
    "select kind, count(*)::BIGINT as n_documents from (select case when regexp_matches(text, '[\\w.]+@[\\w.]+\\.[a-z]+') then 'email' end as kind from documents union all "
    "select case when regexp_matches(text, '\\b\\d{1,3}(\\.\\d{1,3}){3}\\b') then 'ipv4' end from documents union all select case when regexp_matches(text, 'CWE-\\d+') then 'weakness' end from documents) where kind is not null group by 1"
)
def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the kinds of patterns they hold."""
    forms = {"email": r"[\w.]+@[\w.]+\.[a-z]+", "ipv4": r"\b\d{1,3}(\.\d{1,3}){3}\b", "weakness": r"CWE-\d+"}
    kinds = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in forms.items())))
    return table(spark, sf_dir, "documents").select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_documents"))


@_query(f"select provider, count(*)::BIGINT as n_calls, sum(input_tokens)::BIGINT as n_input, sum(output_tokens)::BIGINT as n_output, round(sum(latency_ms), 3) as latency_ms from {_L} group by 1")
def provider_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and latency by provider."""
    calls = table(spark, sf_dir, "llm_responses").dropDuplicates(["call_id"])
    return calls.groupBy("provider").agg(F.count("*").alias("n_calls"), F.sum("input_tokens").alias("n_input"), F.sum("output_tokens").alias("n_output"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"))


@_query(
    f"select call_id, coalesce(case when lower(json_extract_string(o, '$.label')) in ('source', 'sink', 'sanitizer', 'propagator', 'none') then lower(json_extract_string(o, '$.label')) end, 'none') as label from (select call_id, case when json_valid(nullif(regexp_extract(content, '(\\{{[^{{}}]*\\}})', 1), '')) then regexp_extract(content, '(\\{{[^{{}}]*\\}})', 1) end as o from {_L})"
)
def reply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the first JSON object in each reply, ``none`` where there is none."""
    calls = table(spark, sf_dir, "llm_responses").dropDuplicates(["call_id"])
    label = fn.first_json_object(F.col("content"), "label string")["label"]
    return calls.select("call_id", fn.enum_or_default(label, ["source", "sink", "sanitizer", "propagator", "none"], "none").alias("label"))


@_query(
    "select q.vec_id as query_id, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) as distance, rank::INT as rank from (select q.vec_id as qid, v.vec_id as vid, row_number() over (partition by q.vec_id order by round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5), v.vec_id) as rank "
    "from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id) r join embeddings q on q.vec_id = qid join embeddings v on v.vec_id = vid where rank <= 5"
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query."""
    v = table(spark, sf_dir, "embeddings")
    return tables.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5)


@_query(
    f"with base as {_R}, over as (select path, repository, 'checked' as language, size_bytes, 0 as lines from base where size_bytes % 7 = 0) select path, repository, language, lines::INT as lines from (select path, repository, language, lines from base where path not in (select path from over) union all select path, repository, language, lines from over)"
)
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with those that were read again replaced by key."""
    base = files(spark, sf_dir).select("path", "repository", "language", "lines", "size_bytes")
    again = base.where("size_bytes % 7 = 0").withColumn("language", F.lit("checked")).withColumn("lines", F.lit(0))
    return tables.overlay(base, again, "path").select("path", "repository", "language", "lines")


@_query(
    f"with l as {_LINES}, a as (select doc_id, min(line) as hit from l where regexp_matches(code, 'CWE-22') group by 1) "
    "select l.doc_id, string_agg(lpad(line::VARCHAR, 4, ' ') || '| ' || code, chr(10) order by line) as rendered from l join a on l.doc_id = a.doc_id and l.line between hit - 1 and hit + 1 group by 1"
)
def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines around the first mention of a weakness."""
    cut = text.slice_around(table(spark, sf_dir, "documents"), "doc_id", "text", "CWE-22", 1)
    return text.rendered(cut, ["doc_id"], "line", text.numbered(F.col("line"), F.col("code")))


@_query()
def function_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first function of each code context."""
    return text.function_source(examples(spark, sf_dir), "example_id", "code_context")


@_query(
    f"select path as id, path || ' (' || coalesce(lower(language), 'unknown') || '): ' || array_to_string(coalesce(exports, [])[1:10], ' ') as content from {_R}"
)
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts under which files are put into a vector index: path, language, first exports."""
    names = F.array_join(F.slice(F.coalesce("exports", F.array().cast("array<string>")), 1, 10), " ")
    return files(spark, sf_dir).select(F.col("path").alias("id"), F.concat(F.col("path"), F.lit(" ("), F.coalesce(F.lower("language"), F.lit("unknown")), F.lit("): "), names).alias("content"))


@_query(
    f"with c as (select sha256(prompt) as key, content, created_at, call_id, max(created_at) over () as newest from {_L} where prompt is not null) select key, call_id from (select *, row_number() over (partition by key order by created_at desc, call_id desc) as rn from c where created_at >= newest - interval '30 days') where rn = 1"
)
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest answer of each prompt that is at most thirty days older than the newest call."""
    calls = table(spark, sf_dir, "llm_responses").dropDuplicates(["call_id"]).where("prompt is not null")
    newest = calls.agg(F.max("created_at").alias("newest"))
    fresh = calls.crossJoin(F.broadcast(newest)).where("created_at >= newest - interval 30 days")  # one row
    return flows.keep_first(fresh.select(F.sha2("prompt", 256).alias("key"), "call_id", "created_at"), ["key"], [F.desc("created_at"), F.desc("call_id")]).select("key", "call_id")


@_query()
def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples as JSON lines: text, label and features."""
    e = examples(spark, sf_dir)
    body = F.concat_ws("\n", F.concat(F.lit("source: "), F.col("source_expression")), F.concat(F.lit("sink: "), F.col("sink_expression")), F.col("code_context"))
    return e.select("example_id", F.to_json(F.struct(body.alias("text"), "label", "source_type", "sink_type", "cwe_types", "distance_lines", "in_same_function", "uses_template_literal")).alias("line"))
