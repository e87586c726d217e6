"""Registered queries of this subpackage and the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeflow.llm import history, leaks, packing, pairs, pii, secrets, splits
from lodeflow.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


_CODE = (("training_examples", "example_id", "code_context"), ("trace_steps", "step_id", "code_snippet"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [secrets.records(table(spark, sf_dir, name), name, key, text) for name, key, text in _CODE]
    return rows[0].unionByName(rows[1])


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential values in the code of training examples and trace steps."""
    return secrets.find_secrets(_code(spark, sf_dir))


@_query
def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of training examples and trace steps with credentials blanked out; records without code keep null."""
    empty = [
        table(spark, sf_dir, name).where(F.coalesce(F.length(text), F.lit(0)) == 0).select(F.lit(name).alias("record_table"), F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("redacted")).distinct()
        for name, key, text in _CODE
    ]
    return secrets.redact_records(_code(spark, sf_dir)).unionByName(empty[0]).unionByName(empty[1])


@_query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in the documents."""
    return pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query
def p9_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with placeholders for personal information."""
    return pii.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "sanitised")


@_query
def p9_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly terms disclose a person, over all documents."""
    return pii.term_statistics(table(spark, sf_dir, "documents"), "text").withColumn("disclosure", F.round("disclosure", 6))


@_query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give away benchmark items."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark_items"), "item_id", "text")


@_query
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items by the number of documents they leaked into."""
    return leaks.leak_report(p8_found(spark, sf_dir))


@_query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of new batches that repeat an accepted entry."""
    return history.found(history.link(table(spark, sf_dir, "baseline_entries")))


@_query
def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted entries with their cluster and the last_seen that their repeats moved on."""
    return history.clusters(history.link(table(spark, sf_dir, "baseline_entries")))


@_query
def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries that repeat none by the rule, but nearly do by the learned weights."""
    entries = table(spark, sf_dir, "baseline_entries")
    return history.near_duplicates(entries, history.link(entries))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.groups(table(spark, sf_dir, "training_examples"), table(spark, sf_dir, "repo_files"), ["label", "cwe_types", "vulnerability_type"])


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples with the group that must stay together."""
    return _groups(spark, sf_dir).select("example_id", "group_key")


@_query
def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples with their split, like in label, weaknesses and vulnerability type."""
    return splits.assign(_groups(spark, sf_dir), labels="labels").select("example_id", "split")


@_query
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and label shares of the splits."""
    grouped = _groups(spark, sf_dir)
    return splits.split_report(grouped, splits.assign(grouped, labels="labels"))


@_query
def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the examples of each label are shared out over the splits."""
    grouped = _groups(spark, sf_dir)
    return splits.label_report(grouped, splits.assign(grouped, labels="labels"))


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of prompt and response with their defect."""
    return pairs.find_defects(table(spark, sf_dir, "llm_responses"))


@_query
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by defect."""
    return pairs.defect_report(p5_found(spark, sf_dir))


@_query
def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", "n_tokens")


@_query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and filling of the containers."""
    return packing.packing_report(p7_pack(spark, sf_dir))


#: Instruction data: a container holds so many tokens, turns, and tokens of answers, which alone bear loss.
TURNS = packing.Limits(1280, 8, 512)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "llm_responses").select("call_id", "prompt", "content").dropDuplicates(["call_id"])
    counted = [F.coalesce(packing.count_tokens(F.col(c)), F.lit(0)) for c in ("prompt", "content")]
    return calls.select(F.col("call_id").alias("doc_id"), (counted[0] + counted[1]).alias("n"), counted[1].alias("loss_tokens"))


@_query
def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and responses in containers under limits on tokens, turns and loss-bearing tokens."""
    turns = _turns(spark, sf_dir).withColumn("text", F.lit(""))
    return packing.pack(turns, "doc_id", "text", "n", TURNS, "loss_tokens")


@_query
def p7_turns_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the three limits bind."""
    return packing.vector_report(p7_turns(spark, sf_dir), _turns(spark, sf_dir).select("doc_id", "loss_tokens"), TURNS)


_CLEAN = "regexp_replace(trim(file_path), '\\\\', '/', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '^([A-Za-z][A-Za-z0-9+.-]+:/+|[A-Za-z]:/*)', '/')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
for _ in range(4):
    _CLEAN = f"regexp_replace({_CLEAN}, '(^|/)[^/.][^/]*/\\.\\./', '\\1')"
ORACLE["p4_found"] = (
    f"with recursive e as (select distinct on (example_id) example_id, string_split(ltrim({_CLEAN}, '/'), '/') as parts, "
    "nullif(regexp_replace(regexp_replace(code_context, '(?m)^[ \\t]*(?:#|//|/\\*[^\\n]*\\*/[ \\t]*$)[^\\n]*$', '', 'g'), '\\s+', '', 'g'), '') as code from training_examples order by example_id), "
    "s as (select example_id, i, array_to_string(parts[i:], '/') as path from (select example_id, parts, unnest(range(1, len(parts) + 1)) as i from e)), "
    "m as (select example_id, arg_min(s.path, i) as path from s join (select distinct path from repo_files) f on s.path = f.path group by 1), "
    "x as (select e.example_id, m.path, e.code from e left join m on e.example_id = m.example_id), "
    "c as (select distinct path, code from x where path is not null and code is not null), "
    "l as (select distinct a.path as p, b.path as q from c a join c b on a.code = b.code and a.path <> b.path), "
    "r as (select p, q from l union select r.p, l.q from r join l on r.q = l.p), "
    "k as (select p as path, least(p, min(q)) as key from r group by p), "
    "y as (select x.*, coalesce(k.key, x.path) as path_key from x left join k on x.path = k.path), "
    "z as (select code, min(path_key) as code_path, min(example_id) as code_first from y where code is not null group by 1) "
    "select y.example_id, coalesce(path_key, code_path, 'example:' || coalesce(code_first, y.example_id)) as group_key from y left join z on y.code = z.code"
)
