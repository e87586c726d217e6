"""Incremental linkage against a sequential pass."""

import random

from lodeflow.llm import history

SCHEMA = "entry_id long, batch_no int, fingerprint string, vulnerability_type string, file_path string, source_method string, sink_method string, severity string, first_seen timestamp, last_seen timestamp, status string"


def sequential(rows):
    by_fp, by_key, out = {}, {}, {}
    for e, b, fp, vt, path, src, snk, _, _, _, status in sorted(set(rows), key=lambda r: (r[1], r[0])):
        key = (vt, path.split("/")[-1], src, snk) if path else None
        hits = [d[k] for d, k in ((by_fp, fp), (by_key, key)) if k is not None and k in d]
        if b and hits:
            out[e] = {h[1] for h in hits}
        elif status != "resolved":
            if fp:
                by_fp.setdefault(fp, (b, e))
            if key:
                by_key.setdefault(key, (b, e))
    return out


def both(df):
    store = history.link(df)
    return history.found(store), history.clusters(store)


def test_random_histories(spark):
    rng = random.Random(3)
    for trial in range(2):
        rows, used = [], set()
        for e in range(260):
            b = 0 if e < 80 else 1 + (e - 80) // 60
            fp, path = rng.choice([None, f"{rng.randrange(70):016x}"]), rng.choice([None, f"a/f{rng.randrange(8)}.py", f"b/f{rng.randrange(8)}.py"])
            src, snk = rng.choice([None, "f", "g"]), rng.choice(["h", "k", None])
            key = ("CWE-1", path and path.split("/")[-1], src, snk)
            if b == 0:  # the history has no repeats
                if fp in used or (path and key in used):
                    continue
                used |= {fp, key} - {None}
            rows.append((e, b, fp, "CWE-1", path, src, snk, "low", None, None, rng.choice(["active", "resolved", "suppressed"])))
        df = spark.createDataFrame(rows + rows[:5], SCHEMA)
        links, clusters = both(df)
        found, expected = {r.dup_entry_id: r.kept_entry_id for r in links.collect()}, sequential(rows)
        assert links.count() == len(found) and found.keys() == expected.keys(), trial
        assert all(found[e] in expected[e] for e in found)
        assert clusters.where("status = 'resolved'").count() == 0


def test_spellings(spark):
    plain = ("CWE-89", "a/b/f.py", "store_order", "run_query")
    other = ("cwe-89", "C:\\x\\F.py", "UserStore::storeOrder(x)", "self._run_query()")
    rows = [(1, 0, "2c72571c986877fa", *plain, "low", None, None, "active"), (2, 1, " 0x2C72571C986877FA ", "CWE-1", None, None, None, "low", None, None, "active"), (3, 1, None, *other, "low", None, None, "active"), (4, 1, "sha256:2c72-571c-9868-77fa", "CWE-2", "z", None, None, "low", None, None, "active"), (5, 1, None, None, None, None, None, None, None, None, None)]
    links, _ = both(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in links.collect()} == {(1, 2), (1, 3), (1, 4)}


def test_last_seen_moves_and_empty(spark):
    from datetime import datetime

    old, new = datetime(2025, 1, 1), datetime(2025, 5, 1)
    rows = [(1, 0, "aa", "t", "f", None, None, "low", old, old, "active"), (2, 1, "aa", "t", "f", None, None, "low", new, new, "active")]
    _, clusters = both(spark.createDataFrame(rows, SCHEMA))
    assert [(r.entry_id, r.last_seen, r.n_repeats) for r in clusters.collect()] == [(1, new, 1)]
    links, clusters = both(spark.createDataFrame([], SCHEMA))
    assert links.count() == 0 and clusters.count() == 0


def test_a_repeat_of_two_accepted_entries_merges_their_clusters(spark):
    a, b, c = ("aa", "t", "x/f.py", "m", "n"), ("bb", "t", "x/g.py", "m", "n"), ("cc", "t", "x/h.py", "m", "n")
    mixed = ("bb", "t", "y/h.py", "m", "n")
    rows = [(1, 0, *a, "low", None, None, "active"), (2, 0, *b, "low", None, None, "active"), (3, 0, *c, "low", None, None, "active"), (4, 1, "aa", "t", "q/g.py", "m", "n", "low", None, None, "active"), (5, 2, *mixed, "low", None, None, "active")]
    store = history.link(spark.createDataFrame(rows, SCHEMA))
    assert {r.entry_id: (r.cluster_id, r.n_repeats) for r in history.clusters(store).collect()} == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


def test_a_batch_is_linked_to_a_store_alone(spark, tmp_path):
    form = SCHEMA
    old = spark.createDataFrame([(1, 0, "aa", "t", "f", None, None, "low", None, None, "active")], form)
    new = spark.createDataFrame([(2, 1, "AA", "t", "g", None, None, "low", None, None, "active"), (3, 1, "bb", "t", "h", None, None, "low", None, None, "active")], form)
    history.start(spark, f"file://{tmp_path}/store", old)
    store = history.Store(spark, f"file://{tmp_path}/store")
    assert [tuple(r) for r in history.link_batch(store, 1, new).collect()] == [(1, 2)]
    assert [tuple(r) for r in history.link_batch(store, 1, new).collect()] == [(1, 2)]  # a repeated run changes nothing
    later = spark.createDataFrame([(4, 2, "bb", *[None] * 8)], form)
    assert [tuple(r) for r in history.link_batch(store, 2, later).collect()] == [(3, 4)]


def test_near_duplicates(spark):
    rows = [(i, 0, f"{i:04x}", f"t{i % 7}", f"x/f{i}.py", f"m{i}", f"n{i}", "low", None, None, "active") for i in range(200)]
    rows.append((900, 1, "ffff", "t3", "x/f3.py", "m3", "renamed", "low", None, None, "active"))
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[:2] for r in history.near_duplicates(df, history.link(df)).collect()] == [(900, 3)]
