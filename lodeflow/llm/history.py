"""Deduplicating new batches against all accepted history: incremental record linkage.

A store holds the blocking keys of accepted entries, partitioned by key hash. A batch is handed to ``link_batch``, which
reads the partitions of the batch's own keys, links it, and appends what is new: keys, links and representatives. Candidate pairs are verified by the exact rule; where several accepted entries
remain, field weights learned before the batch choose the best. Entries of a batch that repeat each other are settled by rounds of
local minima. Clusters that an entry connects are merged by union-find over representatives, of touched clusters only.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodeflow.llm.splits import components
from lodeflow.session import checkpoint, new_folder, written

#: Compared fields.
FIELDS = ("fp", "vt", "base", "src", "snk")
#: Into how many partitions of keys a store is cut; to be chosen so that one of them is a few files.
PARTS = 8
#: Agreement that is assumed before links are seen, and how many links the assumption counts for.
PRIOR, PRIOR_LINKS = 0.9, 20
#: Score in bits from which an entry that repeats none by the exact rule is reported as a near-duplicate.
NEAR_BITS = 8.0

_FIELD_TYPES = ", ".join(f"{f} string" for f in FIELDS)
_FORMS = {
    "index": f"batch_no int, part int, key string, entry_id bigint, {_FIELD_TYPES}",
    "accepted": "batch_no int, entry_id bigint, fingerprint string, status string, first_seen timestamp, last_seen timestamp",
    "links": "batch_no int, entry_id bigint, kept_entry_id bigint, best boolean, last_seen timestamp, agree int",
    "reps": "batch_no int, entry_id bigint, rep bigint",
    "stats": "batch_no int, field string, n double, agree double, chance double",
}


def bare_method(c: F.Column) -> F.Column:
    """A method without brackets, qualifiers, underscores and letter case; blank is null."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"\(.*$|[\[\]{}<>;\s]", "")
    plain = F.regexp_replace(plain, r"^.*(?:\.|::|->|#|/|\\)", "")
    plain = F.regexp_replace(plain, "_", "")
    return F.when(plain != "", plain)


def with_keys(df: DataFrame) -> DataFrame:
    """Add the normalised fields and the blocking keys of entries.

    ``fp``: the hash however written (case, prefix, separators); ``vt``, ``base``, ``src``, ``snk``: the fields
    of the second rule; ``k_fp`` and ``k_fields``: the blocking keys, null where a rule can't match
    (no fingerprint; no file name).
    """
    fp = F.regexp_replace(F.lower(F.trim("fingerprint")), r"^(?:0x|[a-z]+[0-9]*[:=])", "")
    fp = F.regexp_replace(fp, "[^0-9a-z]", "")
    base = F.regexp_replace(F.trim("file_path"), r"^.*[/\\]", "")
    vt = F.upper(F.trim("vulnerability_type"))
    out = df.withColumns(
        {"fp": F.when(fp != "", fp), "vt": F.when(vt != "", vt), "base": F.when(base != "", F.lower(base)), "src": bare_method(F.col("source_method")), "snk": bare_method(F.col("sink_method"))}
    )
    fields = F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\x00")) for c in ("base", "vt", "src", "snk")))
    return out.withColumns({"k_fp": F.when(F.col("fp").isNotNull(), F.concat(F.lit("f"), "fp")), "k_fields": F.when(F.col("base").isNotNull(), F.concat(F.lit("s"), F.md5(fields)))})


def _exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per blocking key of the entries: the columns, key, part."""
    keyed = rows.select(*columns, F.explode(F.array_compact(F.array("k_fp", "k_fields"))).alias("key"))
    return keyed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))


class Store:
    """The tables of a linkage under a path, one folder per batch; a batch that is linked again replaces its folders."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self, name: str) -> list[int]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(root)) if fs.exists(root) else []

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """A table, of the batches before one if it is given."""
        numbers = [n for n in self.batches(name) if before is None or n < before]
        form = _FORMS[name]
        if not numbers:
            return self.spark.range(0).select(*(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in form.split(", ")))
        # The folders by name: nothing of other batches is listed or opened.
        return self.spark.read.schema(form).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/batch_no={n}" for n in numbers))

    def write(self, name: str, batch_no: int, df: DataFrame) -> None:
        columns = [c.split()[0] for c in _FORMS[name].split(", ")][1:]
        rows = df.select(*columns)
        writer = rows.repartition(PARTS, "part").sortWithinPartitions("key").write.partitionBy("part") if "part" in columns else rows.write
        writer.mode("overwrite").parquet(f"{self.path}/{name}/batch_no={batch_no}")


def _plain(entries: DataFrame) -> DataFrame:
    """Entries with keys; re-delivered rows count once, statuses are in lower case and null is active."""
    keyed = with_keys(entries).withColumn("status", F.coalesce(F.lower(F.trim("status")), F.lit("active")))
    columns = ("entry_id", "fingerprint", "status", "first_seen", "last_seen", *FIELDS, "k_fp", "k_fields")
    return keyed.select(*columns).dropDuplicates(["entry_id"])


def _kept(keyed: DataFrame) -> DataFrame:
    """Index rows of accepted entries: of those that share a key the earliest; combined before the shuffle."""
    return keyed.groupBy("part", "key").agg(F.min(F.struct("entry_id", *FIELDS)).alias("k")).select("part", "key", "k.*")


def start(spark: SparkSession, path: str, history: DataFrame) -> Store:
    """A store with a history that has no repeats. Resolved entries aren't accepted."""
    store = Store(spark, path)
    rows = written(_plain(history).where("status != 'resolved'"), "history")
    store.write("accepted", 0, rows)
    store.write("index", 0, _kept(_exploded(rows, "entry_id", *FIELDS)))
    # The chance that a field of two random entries agrees, from the frequencies of its values over the whole history.
    pieces = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))).alias("p")
    counts = rows.select(pieces).groupBy("p").agg(F.count("*").cast("double").alias("c"))
    chance = counts.groupBy("p.field").agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("chance"))
    store.write("stats", 0, chance.select("field", F.lit(0.0).alias("n"), F.lit(0.0).alias("agree"), "chance"))
    return store


def learned_weights(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Fellegi-Sunter weights in bits per field, for agreement and disagreement.

    u, the chance that a field of two random entries agrees, comes from the value frequencies of the
    history; m, the chance that it does in repeated findings, from the links of all batches so far (and a prior that
    counts for few). A row per field and batch reaches the driver.
    """
    found = {r["field"]: r for r in stats.groupBy("field").agg(F.sum("n").alias("n"), F.sum("agree").alias("agree"), F.max("chance").alias("chance")).collect()}
    weights = {}
    for f in FIELDS:
        r = found.get(f)
        n, agree, chance = (r["n"], r["agree"], r["chance"]) if r else (0.0, 0.0, None)
        m = min(max((agree + PRIOR * PRIOR_LINKS) / (n + PRIOR_LINKS), 0.05), 0.999)
        u = min(max(chance or 0.0, 1e-9), 0.5)
        weights[f] = (log2(m / u), log2((1 - m) / (1 - u)))
    return weights


def score(weights: dict[str, tuple[float, float]], left: str, right: str) -> F.Column:
    """The summed weights of a candidate pair."""
    total = F.lit(0.0)
    for f, (yes, no) in weights.items():
        total = total + F.when(F.col(f"{left}{f}").eqNullSafe(F.col(f"{right}{f}")), F.lit(yes)).otherwise(F.lit(no))
    return total


def _verified(left: str, right: str) -> F.Column:
    """The exact rule: the same hash, or the same type, file name and methods (null equals null)."""
    same_fields = F.col(f"{left}base").isNotNull()
    for f in ("vt", "base", "src", "snk"):
        same_fields = same_fields & F.col(f"{left}{f}").eqNullSafe(F.col(f"{right}{f}"))
    return F.coalesce(F.col(f"{left}fp") == F.col(f"{right}fp"), F.lit(False)) | same_fields


def _pairs(keyed: DataFrame, index: DataFrame, within: bool) -> DataFrame:
    """Verified pairs of keyed entries and index rows: entry_id, its fields and last_seen, and the struct ``k``; one per pair."""
    right = index.select("part", "key", F.col("entry_id").alias("k_id"), F.struct(*FIELDS).alias("k"))
    pairs = keyed.join(right, ["part", "key"]).where(_verified("", "k."))
    pairs = pairs.where("k_id < entry_id") if within else pairs
    return pairs.select("entry_id", "last_seen", *FIELDS, "k_id", "k", F.lit(within).alias("within")).dropDuplicates(["entry_id", "k_id"])


def settle(keyed: DataFrame) -> DataFrame:
    """The entries of a batch that repeat an earlier one of it: entry_id. ``keyed`` has entry_id, status, key.

    Each round decides every open entry that is the earliest open one under all its keys, and gives
    its later partners to it. A resolved entry is never accepted; it is decided once no
    earlier open entry shares a key with it. Only entries that share a key with another take part. Rounds end when nothing is
    open: at least the earliest is decided in each, and chains over changing keys are the only reason for more.
    """
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_keys, repeats = keyed.select("entry_id", "status", "key").join(shared, "key", "left_semi"), None
    while True:
        open_keys = checkpoint(open_keys)
        if open_keys.isEmpty():
            break
        first = open_keys.where("status != 'resolved'").groupBy("key").agg(F.min("entry_id").alias("first"))
        behind = open_keys.join(first, "key", "left").groupBy("entry_id").agg(F.max(F.coalesce(F.col("first") < F.col("entry_id"), F.lit(False))).alias("behind"))
        marked = open_keys.join(behind, "entry_id")
        # The earliest accepted one is enough to tell a repeat, so that a key of many entries is no product.
        least = marked.where("not behind and status != 'resolved'").groupBy("key").agg(F.min("entry_id").alias("kept"))
        told = marked.where("behind").join(least, "key", "left").groupBy("entry_id").agg(F.max(F.coalesce(F.col("kept") < F.col("entry_id"), F.lit(False))).alias("told"))
        told = checkpoint(told)
        found = told.where("told").select("entry_id")
        repeats = found if repeats is None else repeats.unionByName(found)
        open_keys = open_keys.join(told.where("not told").select("entry_id"), "entry_id", "left_semi")
    return repeats if repeats is not None else keyed.select("entry_id").limit(0)


def merge(store: Store, batch_no: int, links: DataFrame) -> None:
    """Union-find: entries that a repeat links to several accepted ones bring their clusters together.

    Only the representatives of those entries form a graph; the rows of the clusters that change are written anew.
    """
    several = links.groupBy("entry_id").agg(F.min("kept_entry_id").alias("a"), F.max("kept_entry_id").alias("z")).where("a != z").select("entry_id", "a")
    edges = links.join(several, "entry_id").where("kept_entry_id != a").select(F.col("a"), F.col("kept_entry_id").alias("b")).distinct()
    known = representatives(store, batch_no)
    for side in ("a", "b"):
        edges = edges.join(known.select(F.col("entry_id").alias(side), F.col("rep").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    joined = components(edges, "a", "b")
    members = known.join(joined.select(F.col("node").alias("rep"), "component"), "rep").select("entry_id", F.col("component").alias("rep"))
    store.write("reps", batch_no, members.unionByName(joined.select(F.col("node").alias("entry_id"), F.col("component").alias("rep"))).distinct())


def representatives(store: Store, before: int | None = None) -> DataFrame:
    """entry_id, rep: the latest representative of each entry of a merged cluster; all other entries stand for themselves."""
    return store.read("reps", before).groupBy("entry_id").agg(F.max_by("rep", "batch_no").alias("rep"))


def link_batch(store: Store, batch_no: int, batch: DataFrame) -> DataFrame:
    """Link a batch to what was accepted before it: kept_entry_id, dup_entry_id; the store takes in the rest.

    Read are the batch and the key partitions that its keys lie in, whose numbers are collected (at most PARTS). Written are rows of the
    batch: keys and entries that become accepted, all links with the last_seen that they move on, and new representatives.
    """
    rows = written(_plain(batch), "batch")
    keyed = _exploded(rows, "entry_id", "status", "last_seen", *FIELDS)
    parts = [r["part"] for r in keyed.select("part").distinct().collect()]
    index = store.read("index", batch_no).where(F.col("part").isin(parts))
    weights = learned_weights(store.read("stats", batch_no))
    hits = written(_pairs(keyed, index, False), "hits")
    old = hits.select("entry_id").distinct()
    within = settle(keyed.join(old, "entry_id", "left_anti"))
    repeats = written(old.unionByName(within), "repeats")
    new = rows.join(repeats, "entry_id", "left_anti").where("status != 'resolved'")
    store.write("accepted", batch_no, new)
    store.write("index", batch_no, _exploded(new, "entry_id", *FIELDS))  # accepted entries of a batch never share a key
    own = store.read("index").where(F.col("batch_no") == batch_no)
    pairs = hits.unionByName(_pairs(keyed.join(repeats, "entry_id", "left_semi"), own, True))
    # Accepted earlier comes first, then the score, then the earlier entry; an entry has at most two partners at a time, one for each key.
    order = Window.partitionBy("entry_id").orderBy("within", F.round(-score(weights, "", "k."), 6), "k_id")
    agree = sum((F.col(f).eqNullSafe(F.col(f"k.{f}")).cast("int") * (1 << i) for i, f in enumerate(FIELDS)), F.lit(0))
    links = pairs.select("entry_id", F.col("k_id").alias("kept_entry_id"), (F.row_number().over(order) == 1).alias("best"), "last_seen", agree.cast("int").alias("agree"))
    store.write("links", batch_no, links)
    links = store.read("links").where(F.col("batch_no") == batch_no)
    counts = links.agg(F.count("*").alias("n"), F.count_if("best").alias("entries"), *(F.count_if(F.col("agree").bitwiseAND(1 << i) != 0).alias(f) for i, f in enumerate(FIELDS))).first()
    stats = ", ".join(f"('{f}', {counts['n']}D, {counts[f]}D, cast(null as double))" for f in FIELDS)
    store.write("stats", batch_no, store.spark.sql(f"select * from values {stats} t(field, n, agree, chance)").coalesce(1))
    if counts["n"] > counts["entries"]:
        merge(store, batch_no, links)
    return links.where("best").select("kept_entry_id", F.col("entry_id").alias("dup_entry_id"))


def link(entries: DataFrame, path: str | None = None) -> Store:
    """Link all batches one after the other; batch 0 (and null) is the history. Returns the store.

    Each batch only sees the store and itself. Without a path the store lies among the intermediate tables.
    """
    spark = entries.sparkSession
    number = F.coalesce("batch_no", F.lit(0))
    store = start(spark, path or new_folder(spark, "store"), entries.where(number == 0))
    for n in sorted(r[0] for r in entries.where(number > 0).select("batch_no").distinct().collect()):  # a handful of batch numbers
        link_batch(store, n, entries.where(F.col("batch_no") == n))
    return store


def found(store: Store) -> DataFrame:
    """One row per repeat: kept_entry_id, dup_entry_id."""
    return store.read("links").where("best").select("kept_entry_id", F.col("entry_id").alias("dup_entry_id"))


def clusters(store: Store) -> DataFrame:
    """Accepted entries: entry_id, cluster_id, fingerprint, status, first_seen, last_seen (moved on by repeats), n_repeats."""
    moved = store.read("links").groupBy(F.col("kept_entry_id").alias("entry_id")).agg(F.max("last_seen").alias("seen"), F.count("*").alias("n_repeats"))
    named = store.read("accepted").join(moved, "entry_id", "left").join(representatives(store), "entry_id", "left")
    return named.select(
        "entry_id", F.coalesce("rep", "entry_id").alias("cluster_id"), "fingerprint", "status", "first_seen", F.greatest("last_seen", "seen").alias("last_seen"), F.coalesce("n_repeats", F.lit(0)).cast("bigint").alias("n_repeats")
    )


def near_duplicates(entries: DataFrame, store: Store) -> DataFrame:
    """Accepted entries of batches that no rule links but the learned weights do: entry_id, near_entry_id, bits.

    Loose keys leave one of the fields out. Each is represented by its earliest accepted entry, so that a key of many
    entries is no group of pairs; of the candidates the best-scored stays, if it has NEAR_BITS or more.
    """
    weights = learned_weights(store.read("stats"))
    rows = written(store.read("accepted").select("entry_id", "batch_no").join(_plain(entries).select("entry_id", *FIELDS), "entry_id"), "near")
    loose = F.array(*(F.md5(F.concat_ws("\x1f", F.lit(left_out), *(F.coalesce(F.col(f), F.lit("\x00")) for f in FIELDS[1:] if f != left_out))) for left_out in FIELDS[1:]))
    keyed = rows.select("entry_id", "batch_no", *FIELDS, F.explode(loose).alias("key"))
    first = keyed.groupBy("key").agg(F.min(F.struct("batch_no", "entry_id", *FIELDS)).alias("k"))
    pairs = keyed.where("batch_no > 0").join(first, "key").where("k.entry_id < entry_id").withColumn("bits", F.round(score(weights, "", "k."), 6))
    best = pairs.where(F.col("bits") >= NEAR_BITS).groupBy("entry_id").agg(F.max_by(F.struct("k.entry_id", "bits"), F.struct("bits", -F.col("k.entry_id"))).alias("b"))
    return best.select("entry_id", F.col("b.entry_id").alias("near_entry_id"), "b.bits")
