"""Train, validation and test splits that keep related records together.

Records are related by source file and by equal code; components of that graph are found with
alternating star rounds, and placed by grouped iterative stratification: rarest outstanding label first,
into the split that needs it most. Labels are any number of tags per record.
"""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodeflow.session import checkpoint, written

#: Splits and their shares.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Groups that are placed at a time; those above HEAVY of all records or of a label's come first, at most (labels + 1) / HEAVY of them.
SHARD_GROUPS, HEAVY = 20_000, 0.001


def clean_path(c: F.Column) -> F.Column:
    """A path with forward slashes, without scheme, drive, leading and doubled slashes, ``.`` and ``..`` segments."""
    p = F.regexp_replace(F.trim(c), r"\\", "/")
    p = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.\-]+:/+", "/")
    p = F.regexp_replace(p, r"^[A-Za-z]:/*", "/")
    # Each parent takes back the segment before it, however deep they are nested.
    kept = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, x)),
    )
    p = F.array_join(kept, "/")
    return F.when(p != "", p)


def code_key(c: F.Column) -> F.Column:
    """A digest of code without white space and whole-line comments; null if nothing is left."""
    bare = F.regexp_replace(c, r"(?m)^[ \t]*(?:#|//|/\*[^\n]*\*/[ \t]*$)[^\n]*$", "")
    bare = F.regexp_replace(bare, r"[\s\u00A0\uFEFF]+", "")
    return F.when(bare != "", F.substring(F.sha2(bare, 256), 1, 32))


def resolve_paths(raw: DataFrame, column: str, files: DataFrame, path: str) -> DataFrame:
    """Each distinct raw path with the known path it means (the longest known suffix): column, known.

    Paths that mean no known file are left out.
    """
    known = files.select(F.col(path).alias("known")).where("known is not null").distinct()
    parts = raw.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_p", F.split(clean_path(F.col(column)), "/"))
    suffixes = parts.select(column, F.explode(F.expr("transform(sequence(1, size(_p)), i -> struct(i as at, array_join(slice(_p, i, size(_p)), '/') as known))")).alias("s")).select(column, "s.*")
    return suffixes.join(known, "known").groupBy(column).agg(F.min(F.struct("at", "known")).alias("m")).select(column, "m.known")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of an edge table: node, component (the smallest node of the component).

    Large-star and small-star rounds, each a combined minimum per node and a join back, until the
    stars don't change; O(log^2) rounds. Hot nodes meet one row of minima, never each other.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = checkpoint(e)
    signature = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == signature:
            break
        signature = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _named(column: str, value: F.Column) -> F.Column:
    return F.concat(F.lit(f"{column}:"), value.cast("string"))


def groups(examples: DataFrame, files: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """One row per example: example_id, group_key, label; with ``tags`` (columns, plain or arrays) also ``labels``.

    Examples of the same known file, or with equal code that isn't blank, are together, and so is all
    that these relations connect. The key is the smallest known path of the group, or ``example:`` and
    the smallest id. Repeated rows of an id count once, with their largest label; null labels count as 0.
    """
    kinds = dict(examples.dtypes)
    named = [F.transform(F.col(c) if kinds[c].startswith("array") else F.array(c), partial(_named, c)) for c in tags or []]
    labels = F.array_compact(F.concat(*(F.coalesce(n, F.array().cast("array<string>")) for n in named))) if named else F.lit(None).cast("array<string>")
    # Digests are shuffled, no texts.
    keyed = examples.select("example_id", F.coalesce("label", F.lit(0)).alias("label"), "file_path", code_key(F.col("code_context")).alias("code"), labels.alias("labels"))
    rows = keyed.groupBy("example_id").agg(F.max("label").alias("label"), F.min("file_path").alias("file_path"), F.min("code").alias("code"), F.max("labels").alias("labels"))
    resolved = resolve_paths(rows, "file_path", files, "path")
    rows = written(rows.join(resolved, "file_path", "left").select("example_id", "label", F.col("known").alias("path"), "code", "labels"), "examples")
    # Only codes of several files connect anything: the graph holds one edge for each such file and code.
    # A code without a file connects its examples by itself.
    pairs = rows.where("path is not null and code is not null").select("path", "code").distinct()
    shared = pairs.groupBy("code").agg(F.count("*").alias("n"), F.min("path").alias("one")).where("n > 1")
    edges = pairs.join(shared.select("code"), "code").select(F.concat(F.lit("p"), "path").alias("a"), F.concat(F.lit("c"), "code").alias("b"))
    found = components(edges, "a", "b")
    paths = found.where("node like 'p%'").select(F.expr("substring(node, 2)").alias("path"), "component")
    keys = paths.groupBy("component").agg(F.min("path").alias("key"))
    path_key = paths.join(keys, "component").select("path", F.col("key").alias("path_key"))
    by_path = rows.join(path_key, "path", "left").withColumn("path_key", F.coalesce("path_key", "path"))
    # Examples without a file follow their code: to the file group that has it, or to its smallest example.
    code_key_of = by_path.where("code is not null").groupBy("code").agg(F.min("path_key").alias("code_path"), F.min("example_id").alias("code_first"))
    joined = by_path.join(code_key_of, "code", "left")
    return joined.select("example_id", F.coalesce("path_key", "code_path", F.concat(F.lit("example:"), F.coalesce("code_first", "example_id").cast("string"))).alias("group_key"), "label", *(["labels"] if tags else []))


def _stratify(rows: pd.DataFrame, needs: dict[str, dict[str, float]]) -> list[str]:
    """The split of each group, by iterative stratification.

    Again and again the label with the fewest outstanding records is taken; its groups, largest first, go into the split that
    needs most of it (then most records). ``rows`` has group_key, n and labels (label -> count).
    """
    vectors = [dict(v) for v in rows["labels"]]
    sizes, keys = rows["n"].tolist(), rows["group_key"].tolist()
    outstanding: dict[str, int] = {}
    holders: dict[str, list[int]] = {}
    for i, v in enumerate(vectors):
        for label, c in v.items():
            outstanding[label] = outstanding.get(label, 0) + c
            holders.setdefault(label, []).append(i)
    holders[""] = list(range(len(vectors)))  # groups without labels are placed last, by their size
    chosen: list[str | None] = [None] * len(vectors)
    while outstanding or holders.get("") is not None:
        label = min(outstanding, key=lambda x: (outstanding[x], x)) if outstanding else ""
        outstanding.pop(label, None)
        own = [i for i in holders.pop(label) if chosen[i] is None]
        for i in sorted(own, key=lambda i: (-vectors[i].get(label, 0), -sizes[i], keys[i])):
            best = max(needs, key=lambda s: (needs[s].get(label, 0.0) if label else 0.0, needs[s]["n"]))
            chosen[i] = best
            needs[best]["n"] -= sizes[i]
            for other, c in vectors[i].items():
                needs[best][other] = needs[best].get(other, 0.0) - c
                if other in outstanding:
                    outstanding[other] -= c
    return chosen


def assign(grouped: DataFrame, shares: dict[str, float] | None = None, labels: str | None = None) -> DataFrame:
    """One row per example: example_id, group_key, split; groups never part.

    ``labels`` names an array column of the labels of an example (with null its ``label`` alone). Label vectors are aggregated
    per group. Groups that hold more than HEAVY of all records or of a label's are few by counting and are placed first, in one task; all others
    are hashed into shards of about SHARD_GROUPS groups, which are placed at once by the same rules, each with the part of what is still needed
    that its own labels make up. Totals of labels reach the driver, one number each.
    """
    shares = shares or SHARES
    tags = F.array_distinct(F.col(labels)) if labels else F.array(F.col("label").cast("string"))
    tags = F.transform(F.array_compact(tags), lambda x: F.concat(F.lit("="), x))  # so that no label has the name of the record count
    tagged = grouped.select("group_key", F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
    sizes = tagged.groupBy("group_key").agg(F.count("*").alias("n"))
    counts = tagged.select("group_key", F.explode("tags").alias("tag")).groupBy("group_key", "tag").agg(F.count("*").alias("c"))
    vectors = counts.groupBy("group_key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "c"))).alias("labels"))  # an entry per label
    vectors = sizes.join(vectors, "group_key", "left").withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,bigint>")))
    comps = written(vectors, "groups")

    def totals(df: DataFrame, *by: str) -> list:
        pairs = df.select(*by, F.explode(F.map_concat("labels", F.create_map(F.lit(""), "n"))).alias("label", "c"))
        return pairs.groupBy(*by, "label").agg(F.sum("c").alias("c")).collect()

    total = {r["label"]: r["c"] for r in totals(comps)}
    if not total:
        return grouped.select("example_id", "group_key", F.lit("train").alias("split"))
    limit = F.create_map(*(F.lit(x) for label, c in total.items() if label for x in (label, HEAVY * c))) if len(total) > 1 else None
    heavy = F.col("n") > HEAVY * total[""]
    if limit is not None:
        heavy = heavy | F.exists(F.map_entries("labels"), lambda e: e["value"] > F.element_at(limit, e["key"]))
    comps = comps.withColumn("heavy", heavy)
    needs = {s: {label or "n": share * c for label, c in total.items()} for s, share in shares.items()}
    form = "group_key string, n bigint, labels map<string,bigint>, split string"

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(split=_stratify(rows, {s: dict(v) for s, v in needs.items()}))[["group_key", "n", "labels", "split"]]

    placed = checkpoint(comps.where("heavy").withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(first, form))
    for r in totals(placed, "split"):
        needs[r["split"]][r["label"] or "n"] -= r["c"]
    light = comps.where("not heavy")
    rest = {(r["label"] or "n"): r["c"] for r in totals(light)}
    shards = max(1, -(-light.count() // SHARD_GROUPS))

    def one_shard(rows: pd.DataFrame) -> pd.DataFrame:
        own: dict[str, float] = {"n": float(rows["n"].sum())}
        for v in rows["labels"]:
            for label, c in dict(v).items():
                own[label] = own.get(label, 0.0) + c
        part = {s: {label: v.get(label, 0.0) * c / rest[label] for label, c in own.items()} for s, v in needs.items()}
        return rows.assign(split=_stratify(rows, part))[["group_key", "n", "labels", "split"]]

    sharded = light.withColumn("_s", F.pmod(F.xxhash64("group_key"), F.lit(shards)))
    others = sharded.groupBy("_s").applyInPandas(one_shard, form)
    return grouped.join(placed.unionByName(others).select("group_key", "split"), "group_key").select("example_id", "group_key", "split")


def split_report(grouped: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per split: n_examples, n_groups, share of the examples and of label 1."""
    joined = grouped.select("example_id", "label").join(assigned, "example_id")
    total = Window.partitionBy()  # a row per split
    return (
        joined.groupBy("split")
        .agg(F.count("*").alias("n_examples"), F.count_distinct("group_key").alias("n_groups"), F.avg("label").alias("share_of_ones"))
        .withColumn("share", F.col("n_examples") / F.sum("n_examples").over(total))
    )


def label_report(grouped: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per label and split: n_examples, and the share of the label's examples that the split has."""
    rows = grouped.select("example_id", F.explode(F.array_distinct("labels")).alias("label")).join(assigned.select("example_id", "split"), "example_id")
    counts = rows.groupBy("label", "split").agg(F.count("*").alias("n_examples"))
    return counts.withColumn("share", F.round(F.col("n_examples") / F.sum("n_examples").over(Window.partitionBy("label")), 6))  # a row per split
