"""Queries over findings, traces and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeflow.functions import scalars as fn
from lodeflow.operators import baselines, feedback, flows, reports, tables, text
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


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, re-delivered rows once."""
    return table(spark, sf_dir, "findings").dropDuplicates(["id"])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "trace_steps").dropDuplicates(["step_id"])


_F = "(select distinct on (id) * from findings order by id)"
_S = "(select distinct on (step_id) * from trace_steps order by step_id)"
_RANK = "case lower(trim(severity)) when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 when 'info' then 5 else 6 end"


@_query(
    "select vulnerability_type, "
    + ", ".join(f"count(*) filter (where lower(severity) = '{s}')::BIGINT as n_{s}" for s in fn.SEVERITIES)
    + f" from {_F} group by 1"
)
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by weakness, one zero-filled column per severity."""
    return tables.zero_filled(findings(spark, sf_dir).withColumn("severity", F.lower("severity")), ["vulnerability_type"], "severity", fn.SEVERITIES)


@_query("select v as verdict, count(*)::BIGINT as n from (select coalesce(lower(verification.verdict), 'unverified') as v from " + _F + ") group by 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by verdict; without one they are unverified."""
    return findings(spark, sf_dir).groupBy(F.coalesce(F.lower("verification.verdict"), F.lit("unverified")).alias("verdict")).agg(F.count("*").alias("n"))


@_query(
    "select count(verification.verdict)::BIGINT as verified, (count(*) filter (where verification.verdict = 'false_positive'))::BIGINT as false_positives, "
    f"round(coalesce((count(*) filter (where verification.verdict = 'false_positive'))::DOUBLE / nullif(count(verification.verdict), 0), 0.0::DOUBLE), 6) as fp_rate from {_F}"
)
def verification_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified findings and the share of false positives among them."""
    wrong = F.count_if(F.col("verification.verdict") == "false_positive")
    done = F.count("verification.verdict")
    return findings(spark, sf_dir).agg(done.alias("verified"), wrong.alias("false_positives"), F.round(F.coalesce(F.try_divide(wrong, done), F.lit(0.0)), 6).alias("fp_rate"))


@_query(
    f"select id, {_RANK} as rank, coalesce(verification.confidence, 1.0::DOUBLE) as confidence from {_F} where {_RANK} <= 2 and coalesce(verification.confidence, 1.0::DOUBLE) >= 0.5::DOUBLE "
    "order by rank, confidence desc, id limit 200"
)
def filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most severe and certain findings: a report's top list."""
    f = findings(spark, sf_dir).select("id", fn.severity_rank(F.col("severity")).alias("rank"), F.coalesce("verification.confidence", F.lit(1.0)).alias("confidence"))
    return tables.top_k(f.where("rank <= 2 and confidence >= 0.5D"), 200, "rank", F.desc("confidence"), "id")


@_query(
    "select vulnerability_type, id, confidence from (select *, row_number() over (partition by vulnerability_type order by confidence desc nulls last, id) as rn from "
    + _F
    + ") where rn <= 5"
)
def topk_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most confident findings of each weakness."""
    return tables.top_k_per(findings(spark, sf_dir).select("vulnerability_type", "id", "confidence"), ["vulnerability_type"], 5, F.desc_nulls_last("confidence"), "id")


@_query(f"select vulnerability_type, lower(severity) as severity, count(*)::BIGINT as n, grouping(vulnerability_type, lower(severity))::BIGINT as level from {_F} group by cube (vulnerability_type, lower(severity))")
def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by weakness and severity with all subtotals."""
    f = findings(spark, sf_dir).select("vulnerability_type", F.lower("severity").alias("severity"))
    return f.cube("vulnerability_type", "severity").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


@_query(
    "select vulnerability_type, case vulnerability_type "
    + " ".join(f"when '{k}' then '{v}'" for k, v in fn.WEAKNESSES.items())
    + f" else 'Unknown (' || vulnerability_type || ')' end as description, count(*)::BIGINT as n from {_F} where vulnerability_type is not null group by 1, 2"
)
def weakness_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each weakness means, with its count."""
    f = findings(spark, sf_dir).where("vulnerability_type is not null")
    return f.groupBy("vulnerability_type", fn.described(F.col("vulnerability_type")).alias("description")).agg(F.count("*").alias("n"))


@_query(f"select tag, count(*)::BIGINT as n from (select unnest(tags) as tag from {_F}) group by 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by tag."""
    return findings(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@_query(f"select scan_id, count(*)::BIGINT as n, count(distinct vulnerability_type)::BIGINT as n_types, min({_RANK})::INT as worst, round(sum(confidence), 3) as total_confidence from {_F} group by 1")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, weaknesses, worst severity and summed confidence of each scan."""
    return findings(spark, sf_dir).groupBy("scan_id").agg(
        F.count("*").alias("n"), F.count_distinct("vulnerability_type").alias("n_types"), F.min(fn.severity_rank(F.col("severity"))).alias("worst"), F.round(F.sum("confidence"), 3).alias("total_confidence")
    )


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    file = F.coalesce("sink.file_path", "source.file_path")
    mark = baselines.fingerprint(sink=F.col("sink.method"), sink_file=file, source=F.col("source.method"), type=F.col("vulnerability_type"))
    return f.select(mark.alias("fingerprint"), F.col("created_at").cast("timestamp_ntz").alias("seen"), F.col("verification.verdict").alias("verdict"))


_PRINTS = (
    "(select substr(sha256(concat_ws('|', 'sink:' || sink.method, 'sink_file:' || coalesce(sink.file_path, source.file_path), 'source:' || source.method, 'type:' || vulnerability_type)), 1, 16) as fingerprint, "
    f"created_at::TIMESTAMP as seen, verification.verdict as verdict from {_F})"
)
_CUT = "2025-07-01"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prints = _prints(spark, sf_dir)
    old = prints.where(f"seen < timestamp_ntz'{_CUT} 00:00:00'").groupBy("fingerprint").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.lit("active").alias("status"))
    now = prints.where(f"seen >= timestamp_ntz'{_CUT} 00:00:00' and coalesce(verdict, '') != 'false_positive'")
    return old, now


_OLD = f"(select fingerprint, min(seen) as first_seen, max(seen) as last_seen from {_PRINTS} where seen < timestamp '{_CUT}' group by 1)"
_NOW = f"(select fingerprint, min(seen) as lo, max(seen) as hi from {_PRINTS} where seen >= timestamp '{_CUT}' and coalesce(verdict, '') <> 'false_positive' group by 1)"


@_query(
    f"select coalesce(o.fingerprint, n.fingerprint) as fingerprint, case when o.fingerprint is null then 'new' when n.fingerprint is null then 'resolved' else 'existing' end as state "
    f"from {_OLD} o full outer join {_NOW} n on o.fingerprint = n.fingerprint"
)
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, existing and resolved findings against the first half year."""
    old, now = _snapshots(spark, sf_dir)
    return baselines.compare(now, old)


@_query(
    f"select coalesce(o.fingerprint, n.fingerprint) as fingerprint, coalesce(first_seen, lo) as first_seen, coalesce(greatest(last_seen, hi), last_seen, hi) as last_seen, "
    f"case when n.fingerprint is null then 'resolved' else 'active' end as status from {_OLD} o full outer join {_NOW} n on o.fingerprint = n.fingerprint"
)
def baseline_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline after the second half year is taken in."""
    old, now = _snapshots(spark, sf_dir)
    return baselines.upsert(old, now)


@_query(
    "select step_id, finding_id, case when rn = 1 then 'source' when rn = n then 'sink' else 'propagation' end as typed from "
    f"(select step_id, finding_id, row_number() over (partition by finding_id order by step_no, step_id) as rn, count(*) over (partition by finding_id) as n from {_S})"
)
def trace_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps typed by their place in the trace."""
    from pyspark.sql import Window

    w = Window.partitionBy("finding_id")
    s = steps(spark, sf_dir).select("step_id", "finding_id", F.row_number().over(w.orderBy("step_no", "step_id")).alias("rn"), F.count("*").over(w).alias("n"))
    return s.select("step_id", "finding_id", F.when(F.col("rn") == 1, "source").when(F.col("rn") == F.col("n"), "sink").otherwise("propagation").alias("typed"))


@_query(f"select finding_id, string_agg(coalesce(step_no::VARCHAR, '?') || '| ' || coalesce(code_snippet, ''), chr(10) order by step_id) as rendered from {_S} group by 1")
def trace_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each trace in order, with step numbers."""
    line = F.concat(F.coalesce(F.col("step_no").cast("string"), F.lit("?")), F.lit("| "), F.coalesce("code_snippet", F.lit("")))
    return text.rendered(steps(spark, sf_dir), ["finding_id"], "step_id", line)


@_query(f"select id from {_F} f where not exists (select 1 from trace_steps s where s.finding_id = f.id)")
def findings_without_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that have no trace (anti join)."""
    return findings(spark, sf_dir).select("id").join(steps(spark, sf_dir).select(F.col("finding_id").alias("id")), "id", "left_anti")


@_query(f"select id from {_F} f where exists (select 1 from trace_steps s where s.finding_id = f.id and lower(trim(s.step_type)) = 'sanitizer')")
def sanitized_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a sanitizer on their trace (semi join)."""
    clean = steps(spark, sf_dir).where(F.lower(F.trim("step_type")) == "sanitizer").select(F.col("finding_id").alias("id"))
    return findings(spark, sf_dir).select("id").join(clean, "id", "left_semi")


_NAMES = "list_sort(list_distinct(regexp_extract_all(lower(code_snippet), '[a-z_][a-z_0-9]*')))"
_PAIRS = (
    f"(select a.finding_id, a.step_id as source_step_id, b.step_id as sink_step_id, list_sort(list_intersect(a.names, b.names)) as shared, abs(b.line - a.line) as distance, a.file_path = b.file_path as same_file "
    f"from (select *, {_NAMES} as names from {_S} where lower(trim(step_type)) = 'source') a join (select *, {_NAMES} as names from {_S} where lower(trim(step_type)) = 'sink') b "
    "on a.finding_id = b.finding_id and list_has_any(a.names, b.names))"
)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("code_snippet"), F.lit("[a-z_][a-z_0-9]*"), F.lit(0))))
    s = steps(spark, sf_dir).select("finding_id", "step_id", "file_path", "line", names.alias("names"), F.lower(F.trim("step_type")).alias("kind"))
    sources, sinks = s.where("kind = 'source'").drop("kind"), s.where("kind = 'sink'").drop("kind")
    return flows.pair_flows(sources, sinks, ["finding_id"], "names", "line")


@_query(f"select finding_id, source_step_id, sink_step_id, array_to_string(shared, ',') as shared, distance from {_PAIRS}")
def flow_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and sink steps of a finding that share a name."""
    return _flows(spark, sf_dir).select("finding_id", "source_step_id", "sink_step_id", F.array_join("shared", ",").alias("shared"), "distance")


@_query(
    "select finding_id, source_step_id, sink_step_id, round(least(0.5::DOUBLE + case when same_file then 0.3::DOUBLE else 0.0::DOUBLE end + "
    "case when distance < 10 then 0.2::DOUBLE when distance < 20 then 0.1::DOUBLE else 0.0::DOUBLE end + case when same_file then 0.1::DOUBLE else 0.0::DOUBLE end, 0.94::DOUBLE), 6) as score from "
    f"(select *, row_number() over (partition by finding_id, sink_step_id order by distance nulls last, source_step_id) as rn from {_PAIRS}) where rn = 1"
)
def flow_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest source of each sink step, scored."""
    f = _flows(spark, sf_dir).withColumn("same_file", F.col("source_file_path") == F.col("sink_file_path"))
    first = flows.keep_first(f, ["finding_id", "sink_step_id"], [F.asc_nulls_last("distance"), "source_step_id"])
    score = flows.heuristic_score(F.col("same_file"), F.lit(False), F.col("distance"), F.col("same_file"))
    return first.select("finding_id", "source_step_id", "sink_step_id", F.round(score, 6).alias("score"))


_SPECS = (
    "(select split_part({side}.method, '_', 1) as verb, list_distinct(list(vulnerability_type)) as types from " + _F + " where {side}.method is not null and vulnerability_type is not null and confidence >= {least}::DOUBLE group by 1)"
)


def _specs(spark: SparkSession, sf_dir: str, side: str, least: float) -> DataFrame:
    f = findings(spark, sf_dir).where(F.col(f"{side}.method").isNotNull() & F.col("vulnerability_type").isNotNull() & (F.col("confidence") >= least))
    return f.groupBy(F.split_part(F.col(f"{side}.method"), F.lit("_"), F.lit(1)).alias("verb")).agg(F.collect_set("vulnerability_type").alias("types"))


@_query(
    f"select distinct s.verb as source, k.verb as sink, s.type from (select verb, unnest(types) as type from {_SPECS.format(side='source', least=0.0)}) s join (select verb, unnest(types) as type from {_SPECS.format(side='sink', least=0.0)}) k on s.type = k.type"
)
def pair_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs of source and sink methods that meet under a weakness."""
    return flows.typed_pairs(_specs(spark, sf_dir, "source", 0.0), _specs(spark, sf_dir, "sink", 0.0), "verb", "types")


@_query(
    f"with p as (select distinct s.verb as source, k.verb as sink, s.type from (select verb, unnest(types) as type from {_SPECS.format(side='source', least=0.0)}) s join (select verb, unnest(types) as type from {_SPECS.format(side='sink', least=0.0)}) k on s.type = k.type), "
    f"z as (select f.vulnerability_type as type, count(*) as n from trace_steps t join {_F} f on f.id = t.finding_id where lower(trim(t.step_type)) = 'sanitizer' and f.confidence >= 0.0::DOUBLE group by 1) "
    "select source, sink, p.type, coalesce(n, 0)::BIGINT as n_sanitizers, round(0.9::DOUBLE * case when coalesce(n, 0) > 0 then 0.5::DOUBLE else 0.85::DOUBLE end, 6) as adjusted from p left join z on p.type = z.type"
)
def pair_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with the sanitizers of their weakness and the adjusted confidence."""
    pairs = flows.typed_pairs(_specs(spark, sf_dir, "source", 0.0), _specs(spark, sf_dir, "sink", 0.0), "verb", "types").withColumn("confidence", F.lit(0.9))
    f = findings(spark, sf_dir).where("confidence >= 0.0D").select(F.col("id").alias("finding_id"), F.col("vulnerability_type").alias("type"))
    clean = table(spark, sf_dir, "trace_steps").where(F.lower(F.trim("step_type")) == "sanitizer").select("finding_id").join(f, "finding_id")
    return flows.with_sanitizers(pairs, clean, "type", "confidence").select("source", "sink", "type", "n_sanitizers", F.round("adjusted", 6).alias("adjusted"))


@_query(
    f"with s as (select source.method as method, 'source' as label, confidence, id from {_F} where source.method is not null union all select sink.method, 'sink', confidence, id from {_F} where sink.method is not null), "
    "k as (select *, row_number() over (partition by method order by confidence desc, label, id) as rn from s where coalesce(nullif(confidence, 0), 1.0::DOUBLE) >= 0.6::DOUBLE) select method, label, round(confidence, 6) as confidence from k where rn = 1"
)
def spec_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and sink methods in one table, the most certain label of each; confidence 0 counts as unknown."""
    f = findings(spark, sf_dir)
    both = [f.where(F.col(f"{s}.method").isNotNull()).select(F.col(f"{s}.method").alias("method"), F.lit(s).alias("label"), "confidence", "id") for s in ("source", "sink")]
    sure = both[0].unionByName(both[1]).where(F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) >= 0.6)
    return flows.keep_first(sure, ["method"], [F.desc("confidence"), "label", "id"]).select("method", "label", F.round("confidence", 6).alias("confidence"))


@_query(
    f"select file_path, batch, count(*)::BIGINT as n_lines, min(line)::INT as first_line from (select file_path, line, ((row_number() over (partition by file_path order by line)) - 1) // 6 as batch from (select distinct file_path, line from {_S} where file_path is not null and line is not null)) group by 1, 2"
)
def per_file_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of each file in batches of six."""
    from pyspark.sql import Window

    lines = steps(spark, sf_dir).where("file_path is not null and line is not null").select("file_path", "line").distinct()
    batch = F.floor((F.row_number().over(Window.partitionBy("file_path").orderBy("line")) - 1) / 6)
    return lines.withColumn("batch", batch.cast("bigint")).groupBy("file_path", "batch").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


@_query(
    f"select name, count(*)::BIGINT as n from (select unnest(regexp_extract_all(coalesce(code_snippet, ''), '(\\w+)\\s*\\(', 1)) as name from {_S}) where name not in ('if', 'for', 'while', 'return', 'function', 'def') group by 1"
)
def call_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called names in trace code with their counts."""
    names = text.called_names(F.col("code_snippet"), ("if", "for", "while", "return", "function", "def"))
    return steps(spark, sf_dir).select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@_query()
def report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON report per scan: rules, results with locations, and artifacts."""
    f = findings(spark, sf_dir)
    level = F.when(fn.severity_rank(F.col("severity")) <= 2, "error").when(fn.severity_rank(F.col("severity")) == 3, "warning").otherwise("note")
    place = F.struct(F.col("sink.file_path").alias("uri"), F.col("sink.line").alias("startLine"))
    result = F.struct(F.col("id").alias("o"), F.struct(F.col("vulnerability_type").alias("ruleId"), level.alias("level"), F.col("title").alias("message"), place.alias("location")).alias("r"))
    grouped = f.groupBy("scan_id").agg(F.sort_array(F.collect_list(result)).alias("rs"), F.array_sort(F.collect_set("vulnerability_type")).alias("rules"), F.array_sort(F.collect_set("sink.file_path")).alias("artifacts"))
    return grouped.select("scan_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), "rules", F.transform("rs", lambda x: x["r"]).alias("results"), "artifacts")).alias("report"))


_CALL = "list_filter(regexp_extract_all(coalesce(code_snippet, ''), '(\\w+)\\s*\\(', 1), lambda n: n not in (" + ", ".join(f"'{w}'" for w in feedback.NO_CALLS) + "))"


@_query(
    f"with h as (select id as finding_id, verification.confidence * 0.9::DOUBLE as confidence from {_F} where verification.verdict = 'false_positive' and verification.confidence >= 0.5::DOUBLE), "
    f"n as (select s.finding_id, s.step_id, s.line, h.confidence, coalesce({_CALL}[1], 'sanitizer_line_' || s.line::VARCHAR) as method from {_S} s join h on s.finding_id = h.finding_id where lower(trim(s.step_type)) = 'sanitizer' and s.line is not null) "
    "select method, line, round(confidence, 6) as confidence, finding_id from (select *, row_number() over (partition by method, line order by finding_id, step_id) as rn from n) where rn = 1"
)
def learned_sanitizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitizers read from the traces of false positives."""
    return feedback.learned_sanitizers(findings(spark, sf_dir), steps(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@_query(
    f"with c as (select lower(severity) as severity, count(*) as n, count(*) filter (where verification.verdict = 'false_positive') as w from {_F} group by 1) "
    "select s.severity, coalesce(n, 0)::BIGINT as n, coalesce(w, 0)::BIGINT as n_false_positive from (values " + ", ".join(f"('{s}')" for s in fn.SEVERITIES) + ") s(severity) left join c on s.severity = c.severity"
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a report: findings by severity, all five listed."""
    return reports.summary(findings(spark, sf_dir))


@_query(
    f"with s as (select finding_id, file_path, min(line) as lo, max(line) as hi, count(distinct line) as n from {_S} where file_path is not null and line is not null group by 1, 2) "
    "select finding_id, file_path, lo::INT as first_line, hi::INT as last_line, n::BIGINT as n_slice, round((1 - n::DOUBLE / (hi - lo + 1)) * 100, 4) as reduction from s"
)
def slice_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the lines between the first and last step of a trace in a file its slice leaves out."""
    s = steps(spark, sf_dir).where("file_path is not null and line is not null").groupBy("finding_id", "file_path")
    own = s.agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count_distinct("line").alias("n_slice"))
    ratio = (1 - F.col("n_slice") / (F.col("last_line") - F.col("first_line") + 1)) * 100
    return own.withColumn("reduction", F.round(ratio, 4))


@_query(
    "select id, " + "case vulnerability_type " + " ".join(f"when '{k}' then '{v}'" for k, v in fn.WEAKNESSES.items()) + " else 'Unknown (' || vulnerability_type || ')' end"
    " || ' from ' || substr(coalesce(source.method, '?'), 1, 30) || ' to ' || substr(coalesce(sink.method, '?'), 1, 30) as title, "
    f"coalesce(sink.file_path, source.file_path, '?') || ':' || coalesce(coalesce(sink.line, source.line)::VARCHAR, '?') as place from {_F} where vulnerability_type is not null"
)
def finding_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and places of findings as reports show them."""
    f = findings(spark, sf_dir).where("vulnerability_type is not null")
    short = lambda c: F.substring(F.coalesce(F.col(c), F.lit("?")), 1, 30)
    title = F.concat(fn.described(F.col("vulnerability_type")), F.lit(" from "), short("source.method"), F.lit(" to "), short("sink.method"))
    place = F.concat(F.coalesce("sink.file_path", "source.file_path", F.lit("?")), F.lit(":"), F.coalesce(F.coalesce("sink.line", "source.line").cast("string"), F.lit("?")))
    return f.select("id", title.alias("title"), place.alias("place"))


@_query(f"select finding_id, step_id as first_sink from (select *, row_number() over (partition by finding_id order by step_no nulls first, step_id) as rn from {_S} where lower(trim(step_type)) = 'sink') where rn = 1")
def first_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sink step of each trace."""
    s = steps(spark, sf_dir).where(F.lower(F.trim("step_type")) == "sink")
    return s.groupBy("finding_id").agg(F.min_by("step_id", F.struct("step_no", "step_id")).alias("first_sink"))
