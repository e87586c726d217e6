"""Evaluation texts leaking into a corpus: containment search by keys that no leak can lack.

An item leaks if a run of RUN words of it stands in a document, or if most of its words do, in
order, in a passage about as long. Documents are far longer than items, so a signature of a whole
document says nothing about an item. Two kinds of keys name candidates, and neither misses a leak:

* runs of RUN words: the smallest shingle hash of each window (one hash; windows of equal words
  always agree);
* reworded items: pairs of words at most GAP apart. Of the words that stand in order so many must
  be neighbours in both texts that a share of the item's pairs, which follows from its length, stands
  in the passage wherever the changed words are. Items are partitioned by the size of their passage,
  and pairs are counted in overlapping segments of each partition's size.

Candidates are verified by exact containment: the shingles of the run, or the longest common
subsequence with every passage.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodeflow.session import spread

#: Words of a shingle and of a run that counts as a leak; how far apart the words of a pair may be.
SHINGLE, RUN, GAP = 5, 12, 2
#: Share of an item's words that must stand in order, and how much longer than the item the passage may be.
REWORDED, PASSAGE = 0.75, 1.34
#: The smallest partition of passages in words.
LEAST_PASSAGE = 64
#: Items are searched in blocks of about so many characters; a block is what is sent to the tasks.
BLOCK_CHARS = 4_000_000
#: Words whose keys are looked up at once; bits of the table that keys are looked up in first.
PART_WORDS, WANTED_BITS = 50_000, 22

_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20240607)
_P = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """Shingle hashes of word lists; words are hashed once each."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        return np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))

    def shingles(self, words: list[str]) -> np.ndarray:
        h = self.words(words)
        n = len(h) - SHINGLE + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return _mix(sum((h[i : i + n] * _P[i] for i in range(SHINGLE)), np.zeros(n, np.uint64)))


def _run_minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash of the shingles of each run of RUN words."""
    width = RUN - SHINGLE + 1
    if len(shingles) < width:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(shingles, width).min(axis=1)


def _key(kind: int, value: np.ndarray) -> np.ndarray:
    """A signed key for joins: its kind (run: 0, pair: 1) and its value."""
    with np.errstate(over="ignore"):
        return _mix(value + np.uint64(kind) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _need(n: int) -> int:
    """How many words of an item of n words must stand in order."""
    return int(np.ceil(REWORDED * n - 1e-9))


def _passage(n: int) -> int:
    return int(n * PASSAGE)


def _least_pairs(n: int) -> int:
    """How many pairs of an item of n words stand in any passage that holds it reworded, at least.

    Of the need - 1 steps between words in order those are pairs that are at most GAP wide in both
    texts; each wider one takes up GAP of the item's missing or the passage's other words. Positive from SHINGLE words on.
    """
    need = _need(n)
    return need - 1 - (n - need) // GAP - (_passage(n) - need) // GAP


def _partition(n: int) -> int:
    """The size of the partition that the passages of an item of n words belong to."""
    return max(LEAST_PASSAGE, 1 << (_passage(n) - 1).bit_length())


def _pairs(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and keys of all pairs of words of the same owner."""
    at, keys = [], []
    for gap in range(1, GAP + 1):
        same = np.flatnonzero(owners[gap:] == owners[:-gap])
        with np.errstate(over="ignore"):
            keys.append(_key(1, _mix(hashes[same] * _P[0] + hashes[same + gap] * _P[1])))
        at.append(same)
    return np.concatenate(at), np.concatenate(keys)


def item_keys(words: list[str], hasher: _Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of an item: those of its runs, those of its pairs, and how often each pair stands in it."""
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, counts = np.unique(_pairs(hasher.words(words), np.zeros(len(words), np.int8))[1], return_counts=True)
    return _key(0, np.unique(_run_minima(hasher.shingles(words)))), pairs, counts


def run_keys(hashes: np.ndarray, owners: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all runs of some documents that may be wanted: arrays of the places where they begin and keys.

    ``hashes`` are those of all their words in one array, ``owners`` the document of each. A run lies in one document; where
    the smallest shingle stays the same from run to run its key is given once.
    """
    n = len(hashes) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = len(hashes) - SHINGLE + 1
    with np.errstate(over="ignore"):
        shingles = _mix(sum((hashes[i : i + most] * _P[i] for i in range(SHINGLE)), np.zeros(most, np.uint64)))
    minima = shingles[:n].copy()
    for i in range(1, RUN - SHINGLE + 1):
        np.minimum(minima, shingles[i : i + n], out=minima)
    at = np.flatnonzero(owners[:n] == owners[RUN - 1 :])
    own, minima = owners[at], minima[at]
    fresh = np.ones(len(minima), bool)
    fresh[1:] = (minima[1:] != minima[:-1]) | (own[1:] != own[:-1])
    at, keys = at[fresh], _key(0, minima[fresh])
    keep = wanted[keys.view(np.uint64) >> np.uint64(64 - WANTED_BITS)]
    return at[keep], keys[keep]


class _Items:
    """The keys of all items, sorted for searches in many documents."""

    def __init__(self, texts: list[list[str]]) -> None:
        hasher = _Hasher()
        keyed = [item_keys(w, hasher) for w in texts]
        self.runs = [(k, i) for i, (runs, _, _) in enumerate(keyed) for k in runs.tolist()]
        keys = np.concatenate([np.zeros(0, np.int64), *(pairs for _, pairs, _ in keyed)])
        weights = np.concatenate([np.zeros(0, np.int64), *(counts for _, _, counts in keyed)])
        item = np.repeat(np.arange(len(texts)), [len(pairs) for _, pairs, _ in keyed])
        _, which, n_items = np.unique(keys, return_inverse=True, return_counts=True)
        # The pairs that most items share are left out, up to half of those that must be there, and the least number falls by them.
        self.least = np.array([_least_pairs(len(w)) for w in texts], np.int64)
        order = np.lexsort((keys, -n_items[which], item))
        item, keys, weights = item[order], keys[order], weights[order]
        before = np.cumsum(weights)
        starts = np.searchsorted(item, item)
        before -= before[starts] - weights[starts]
        left_out = before <= self.least[item] // 2
        self.least -= np.bincount(item[left_out], weights[left_out], minlength=len(texts)).astype(np.int64)
        order = np.flatnonzero(~left_out)
        order = order[np.argsort(keys[order], kind="stable")]
        self.keys, self.item, self.weights = keys[order], item[order], weights[order]
        self.partition = np.array([_partition(len(w)) for w in texts], np.int64)

    def wanted(self) -> np.ndarray:
        """The table of the prefixes of all keys."""
        table = np.zeros(1 << WANTED_BITS, bool)
        keys = np.concatenate((self.keys, np.array([k for k, _ in self.runs], np.int64)))
        table[keys.view(np.uint64) >> np.uint64(64 - WANTED_BITS)] = True
        return table

    def reworded(self, hashes: np.ndarray, lengths: np.ndarray, doc_of: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Document, item, and start and end of each segment that holds pairs enough of the item."""
        if not len(hashes) or not len(self.keys):
            return
        first = np.cumsum(lengths) - lengths
        at, keys = _pairs(hashes, doc_of)
        keep = wanted[keys.view(np.uint64) >> np.uint64(64 - WANTED_BITS)]
        at, keys = at[keep], keys[keep]
        low = np.searchsorted(self.keys, keys)
        n = np.searchsorted(self.keys, keys, "right") - low
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        for size in np.unique(self.partition[self.item]).tolist():
            own = self.partition[self.item[entry]] == size
            e, p = entry[own], at[own]
            # A passage that starts in a part of the partition's size ends in the next one at the latest.
            n_parts = lengths // size + 1
            base = np.cumsum(n_parts) - n_parts
            d = doc_of[p]
            part = (p - first[d]) // size
            slot = base[d] + part
            slots = np.concatenate((slot, slot[part > 0] - 1))
            once = np.unique(slots * len(self.keys) + np.concatenate((e, e[part > 0])))
            slots, e = once // len(self.keys), once % len(self.keys)
            pairs, which = np.unique(slots * len(self.least) + self.item[e], return_inverse=True)
            enough = np.bincount(which, self.weights[e], minlength=len(pairs)) >= self.least[pairs % len(self.least)]
            for x in pairs[enough].tolist():
                slot, i = divmod(x, len(self.least))
                d = int(np.searchsorted(base, slot, "right")) - 1
                start = (slot - int(base[d])) * size
                yield d, i, start, start + 2 * size


def _parts(docs: list[list[str]], most: int = PART_WORDS) -> Iterator[tuple[int, list[list[str]]]]:
    """Documents in parts of about so many words."""
    start, size = 0, 0
    for n, words in enumerate(docs):
        size += len(words)
        if size >= most:
            yield start, docs[start : n + 1]
            start, size = n + 1, 0
    if start < len(docs):
        yield start, docs[start:]


def _lcs(a: list[str], positions: dict[str, int], b: list[str]) -> int:
    """The length of the longest common subsequence, with a's words as bits."""
    every = (1 << len(a)) - 1
    v = every
    for w in b:
        if m := positions.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def _runs_of(item: list[str]) -> set[tuple[str, ...]]:
    return {tuple(item[p : p + RUN]) for p in range(len(item) - RUN + 1)}


def _run_at(runs: set[tuple[str, ...]], doc: list[str]) -> bool:
    return any(tuple(doc[k : k + RUN]) in runs for k in range(len(doc) - RUN + 1))


def _run_in(item: list[str], doc: list[str]) -> bool:
    """Whether the document holds a run of RUN words of the item."""
    runs = _runs_of(item)
    return bool(runs) and _run_at(runs, doc)


def _reworded_in(item: list[str], doc: list[str]) -> bool:
    """Whether some passage of the document holds the item reworded.

    Every passage is looked at that starts with a word of the item and shares words enough with it.
    """
    n = len(item)
    if n < SHINGLE:
        return False
    need, size = _need(n), _passage(n)
    held = set(doc)
    if sum(w in held for w in item) < need:
        return False
    own, opening = Counter(item), set(item[: n - need + 1])
    positions: dict[str, int] = defaultdict(int)
    for p, w in enumerate(item):
        positions[w] |= 1 << p
    inside: dict[str, int] = defaultdict(int)
    shared = end = next_start = 0
    for start, w in enumerate(doc):
        while end < min(start + size, len(doc)):
            x = doc[end]
            if x in own:
                shared += inside[x] < own[x]
                inside[x] += 1
            end += 1
        if shared >= need and start >= next_start and w in opening:
            found = _lcs(item, positions, doc[start : start + size])
            if found >= need:
                return True
            next_start = start + need - found  # one word on adds one at most
        if w in own:
            inside[w] -= 1
            shared -= inside[w] < own[w]
    return False


def leaks_in(item: list[str], doc: list[str]) -> bool:
    """Whether the document holds a run of RUN words of the item, or the item reworded."""
    return _run_in(item, doc) or _reworded_in(item, doc)


def find_leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """One row per document and item it gives away: doc_id, item_id.

    Null, empty and very short items (below a shingle) and texts leak nothing. Items of the same id count once.
    Items are a stated query set against all documents. Their characters are summed, and they are searched in blocks of BLOCK_CHARS, each by
    the same plan: the keys of a block are sent to the tasks, and the corpus is passed over once for each block, never shuffled. One item is never split.
    """
    corpus = docs.where(F.length(F.col(doc_text)) > 0).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    queries = items.where(F.length(F.col(item_text)) > 0).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).dropDuplicates(["item_id"])
    blocks = -(-(queries.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        part = _search(corpus, own, dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id])
        found = part if found is None else found.unionByName(part)
    return found


def _search(corpus: DataFrame, items: DataFrame, doc_kind: str, item_kind: str) -> DataFrame:
    """The leaks of one block of items."""
    texts = {r["item_id"]: words_of(r["text"]) for r in items.collect()}
    shared = corpus.sparkSession.sparkContext.broadcast((list(texts), list(texts.values()), _Items(list(texts.values()))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, item_words, known = shared.value
        by_key = defaultdict(list)
        for k, i in known.runs:
            by_key[k].append(i)
        wanted = known.wanted()
        runs = [_runs_of(w) for w in item_words]
        local = _Hasher()
        for batch in batches:
            ids = batch["doc_id"].tolist()
            words = [words_of(text) for text in batch["text"]]
            found: set[tuple[int, int]] = set()
            for first, part in _parts(words):
                lengths = np.array([len(w) for w in part], np.int64)
                doc_of = np.repeat(np.arange(len(part)), lengths)
                hashes = local.words([w for own in part for w in own])
                starts = np.cumsum(lengths) - lengths
                for at, key in zip(*(x.tolist() for x in run_keys(hashes, doc_of, wanted)), strict=True):
                    if key in by_key:
                        n = int(doc_of[at])
                        own = part[n][at - int(starts[n]) :][: RUN + RUN - SHINGLE]  # the runs that may have this smallest shingle
                        found |= {(first + n, i) for i in by_key[key] if (first + n, i) not in found and _run_at(runs[i], own)}
                for n, i, start, end in known.reworded(hashes, lengths, doc_of, wanted):
                    if (first + n, i) not in found and _reworded_in(item_words[i], part[n][start:end]):
                        found.add((first + n, i))
            yield pd.DataFrame([(ids[n], names[i]) for n, i in sorted(found)], columns=["doc_id", "item_id"])

    return spread(corpus).mapInPandas(search, f"doc_id {doc_kind}, item_id {item_kind}")


def leak_report(found: DataFrame) -> DataFrame:
    """Per item: in how many documents it leaked (n_documents)."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"))
