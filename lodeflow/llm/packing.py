"""Filling containers of fixed capacity with texts: vector bin packing with the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodeflow.session import written


@dataclass(frozen=True)
class Limits:
    """What a container holds at most: tokens, segments, and tokens that bear loss (null: as many as tokens)."""

    tokens: int = 2048
    segments: int | None = None
    loss_tokens: int | None = None


#: Tokens and segments that one task packs at a time; a shard wastes at most one container's room.
SHARD_TOKENS, SHARD_SEGMENTS = 1_000_000, 50_000
#: How many shards' unfinished containers are packed again together; from which filling on a container is finished.
MERGE, FULL = 64, 0.995
#: Partitions per shard, so that hardly two shards share a task; what shares one is packed one after the other.
SPREAD_SHARDS = 4


def count_tokens(text: F.Column) -> F.Column:
    """Runs of letters or digits, and every other non-blank character, as one token each."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{Z}\x{85}\x{1c}-\x{1f}\p{L}\p{N}]")).cast("int")


def segments(df: DataFrame, doc_id: str, text: str, n_tokens: str, limits: Limits, loss: str | None = None) -> DataFrame:
    """Pieces of documents: piece, doc_id, token_start, token_end, loss_tokens.

    ``piece`` is a number of its own for each piece, whatever its document's id is (null and repeated ids too);
    it holds once the pieces are written.

    A text is whole unless it exceeds a container in some limit; then only its last piece is shorter than
    the others. Token counts come from ``n_tokens`` or, where null, from the text. Texts without tokens
    (null or empty) have no piece. Loss-bearing tokens are spread over the pieces by length.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(n_tokens).cast("int"), count_tokens(F.col(text))).alias("n"), (F.col(loss) if loss else F.lit(None)).cast("double").alias("loss"))
    # No more tokens bear loss than there are; a piece is as long as all limits allow.
    rows = rows.where("n > 0").withColumn("loss", F.coalesce(F.greatest(F.lit(0.0), F.least(F.col("loss"), F.col("n"))), F.col("n").cast("double")))
    room = F.floor(F.lit(limits.loss_tokens or limits.tokens) * F.col("n") / F.col("loss"))
    rows = rows.withColumn("size", F.when(F.col("loss") > 0, F.least(F.lit(limits.tokens), room)).otherwise(limits.tokens))
    pieces = rows.select("doc_id", "n", "loss", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("size")))).alias("i"))
    start, end = F.col("i") * F.col("size"), F.least((F.col("i") + 1) * F.col("size"), F.col("n"))
    return pieces.select(F.monotonically_increasing_id().alias("piece"), "doc_id", start.cast("int").alias("token_start"), end.cast("int").alias("token_end"), F.ceil(F.round((end - start) * F.col("loss") / F.col("n"), 6)).cast("int").alias("loss_tokens"))


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, int]:
    """The container number of each item, and the number of containers.

    One container after the other is filled. Items of equal demand form classes; the class whose
    demand has the greatest dot product with what is left of the container, over the root of the demand's own length (so that
    shape counts beside size), goes in next, unless one item (or a pair, where tokens are all that differs) ends the room exactly.
    """
    cap = np.array([limits.tokens, limits.segments or limits.tokens, limits.loss_tokens or limits.tokens], float)
    classes, member = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    order = np.argsort(member.ravel(), kind="stable")
    left = np.bincount(member.ravel(), minlength=len(classes))
    next_item = np.concatenate(([0], np.cumsum(left)[:-1]))
    demand = np.stack([classes[:, 0], np.ones(len(classes)), classes[:, 1]], 1).astype(float)
    parts = demand / cap
    length = np.sqrt(np.linalg.norm(parts, axis=1))
    by_size: dict[int, list[int]] = {}
    for k, t in enumerate(classes[:, 0].tolist()):
        by_size.setdefault(t, []).append(k)
    sizes = np.array(sorted(by_size))
    plain = len(by_size) == len(classes)  # tokens alone tell items apart; with loss-bearing tokens of their own pairs would be too many to try
    place = np.empty(len(tokens), np.int64)
    bins, remaining = 0, len(tokens)

    def fits(k: int, room: np.ndarray, n: int = 1) -> bool:
        return left[k] >= n and bool((demand[k] <= room + 1e-9).all())

    def exact(room: np.ndarray) -> list[int] | None:
        gap = int(room[0])
        for k in by_size.get(gap, ()):
            if fits(k, room):
                return [k]
        for a in sizes[sizes <= gap // 2][::-1].tolist() if plain else ():
            for k in by_size[a]:
                if fits(k, room):
                    for m in by_size.get(gap - a, ()):
                        if left[m] >= 1 + (m == k) and bool((demand[m] <= room - demand[k] + 1e-9).all()):
                            return [k, m]
        return None

    while remaining:
        room = cap.copy()
        while remaining:
            ok = (left > 0) & (demand <= room + 1e-9).all(axis=1)
            if not ok.any():
                break
            chosen = exact(room) if room[0] < cap[0] else None
            if chosen is None:
                score = np.where(ok, parts @ (room / cap) / length, -1.0)
                chosen = [int(score.argmax())]
            for k in chosen:
                place[order[next_item[k]]] = bins
                next_item[k] += 1
                left[k] -= 1
                remaining -= 1
                room -= demand[k]
        bins += 1
    return place, bins


def _packer(limits: Limits, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs a shard; pieces in containers that aren't full are left for the next level."""

    def one_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "token_start", "piece"]).reset_index(drop=True)
        lengths = (rows["token_end"] - rows["token_start"]).to_numpy()
        place, bins = fill(lengths, rows["loss_tokens"].to_numpy(), limits)
        full = np.bincount(place, weights=lengths, minlength=bins) >= FULL * limits.tokens
        return rows.assign(level=level, number=place, done=last | full[place])[["level", "shard", "number", "piece", "doc_id", "token_start", "token_end", "loss_tokens", "done"]]

    return one_shard


def pack(df: DataFrame, doc_id: str, text: str, n_tokens: str, limits: Limits | None = None, loss: str | None = None) -> DataFrame:
    """The containers: container, doc_id, token_start, token_end.

    Whole pieces of a container's size fill one each, named by the piece. All others are packed in shards of bounded
    size, spread by hash; what stands in a shard's last, unfinished containers is packed again with that
    of MERGE shards, until one shard is left. So the loss to sharding is a few containers
    altogether. No step sees more than a shard.
    """
    limits = limits or Limits()
    pieces = written(segments(df, doc_id, text, n_tokens, limits, loss), "pieces")
    kind = dict(pieces.dtypes)["doc_id"]
    whole = pieces.where(F.col("token_end") - F.col("token_start") >= limits.tokens)
    rest = pieces.where(F.col("token_end") - F.col("token_start") < limits.tokens)
    size = rest.agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"), F.count("*").alias("n")).first()
    shards = max(1, -(-(size["t"] or 0) // SHARD_TOKENS), -(-size["n"] // SHARD_SEGMENTS))
    form = f"level int, shard bigint, number bigint, piece bigint, doc_id {kind}, token_start int, token_end int, loss_tokens int, done boolean"
    done, level = [whole.select(F.lit(-1).alias("level"), F.col("piece").alias("shard"), F.lit(0).cast("bigint").alias("number"), "doc_id", "token_start", "token_end")], 0
    while True:
        last = shards == 1

        sharded = rest.select("piece", "doc_id", "token_start", "token_end", "loss_tokens", F.pmod(F.xxhash64("piece", F.lit(level)), F.lit(shards)).alias("shard"))
        # A stated number of partitions: small shards would otherwise be merged into one task.
        spread = sharded.repartition(SPREAD_SHARDS * shards, "shard")
        packed = written(spread.groupBy("shard").applyInPandas(_packer(limits, level, last), form), "packed")
        done.append(packed.where("done").select("level", "shard", "number", "doc_id", "token_start", "token_end"))
        if last:
            break
        rest, level = packed.where("not done"), level + 1
        left = rest.agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"), F.count("*").alias("n")).first()
        # Fewer shards each time, but none larger than the first ones.
        shards = max(1, min(shards - 1, max(-(-shards // MERGE), -(-(left["t"] or 0) // SHARD_TOKENS), -(-left["n"] // SHARD_SEGMENTS))))
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    return rows.select(F.concat_ws("-", "level", "shard", "number").alias("container"), "doc_id", "token_start", "token_end")


def packing_report(packed: DataFrame, limits: Limits | None = None) -> DataFrame:
    """n_containers, n_tokens, fill (share of all room), least_containers (by tokens alone), fullest."""
    size = (limits or Limits()).tokens
    used = packed.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"))
    return used.agg(
        F.count("*").alias("n_containers"),
        F.sum("t").alias("n_tokens"),
        F.round(F.sum("t") / (F.count("*") * size), 6).alias("fill"),
        F.ceil(F.sum("t") / size).alias("least_containers"),
        F.max("t").alias("fullest"),
    )


def vector_report(packed: DataFrame, loss_tokens: DataFrame, limits: Limits) -> DataFrame:
    """How the limits of containers bind: n_containers, the least number that each limit alone allows, and the greatest use of each.

    ``loss_tokens`` has doc_id and loss_tokens of documents that are shorter than a container.
    """
    used = packed.join(loss_tokens, "doc_id").groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))
    caps = {"t": limits.tokens, "s": limits.segments or limits.tokens, "l": limits.loss_tokens or limits.tokens}
    names = {"t": "tokens", "s": "segments", "l": "loss_tokens"}
    return used.agg(F.count("*").alias("n_containers"), *(F.ceil(F.sum(c) / cap).alias(f"least_by_{names[c]}") for c, cap in caps.items()), *(F.max(c).alias(f"most_{names[c]}") for c in caps))
