"""Leak search against a plain pass over all pairs."""

import random

from lodeflow.llm import leaks


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.randrange(30, 130))) for i in range(25)}
    docs = {}
    for d in range(160):
        words = rng.choices(vocabulary, k=rng.randrange(0, 600))
        if d % 3 == 0:
            item = items[rng.randrange(25)].split()
            kind = rng.randrange(4)
            if kind == 0:
                part = item
            elif kind == 1:
                at = rng.randrange(0, len(item) - 15)
                part = item[at : at + rng.choice([9, 11, 12, 14])]
            else:
                part = [rng.choice(vocabulary) if rng.random() < rng.choice([0.08, 0.15]) else w for w in item]
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = part
        docs[d] = " ".join(words)
    return docs, items


def plain(docs, items):
    found = set()
    for d, t in docs.items():
        w = leaks.words_of(t)
        for i, q in items.items():
            item = leaks.words_of(q)
            runs = {tuple(item[k : k + leaks.RUN]) for k in range(len(item) - leaks.RUN + 1)}
            if any(tuple(w[k : k + leaks.RUN]) in runs for k in range(len(w))) or leaks.leaks_in(item, w):
                found.add((d, i))
    return found


def frames(spark, docs, items):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")


def test_both_ways(spark, monkeypatch):
    docs, items = texts(1)
    d, q = frames(spark, docs, items)
    expected = plain(docs, items)
    assert {tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", q, "item_id", "text").collect()} == expected and expected
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 3000)
    assert {tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", q, "item_id", "text").collect()} == expected


def test_runs_and_layout():
    item = [f"w{i}" for i in range(60)]
    assert leaks.leaks_in(item, ["x"] * 40 + item[10:22] + ["y"] * 40)
    assert not leaks.leaks_in(item, ["x"] * 40 + item[10:21] + ["y"] * 40)
    assert leaks.words_of("A_b, > C-3!\n") == ["a", "b", "c", "3"]


def test_odd_texts(spark):
    d, q = frames(spark, {1: None, 2: "", 3: "a b", 4: "z " * 40_000}, {1: "a b c d e f g h i j k l m", 2: None, 3: "a b"})
    assert leaks.find_leaks(d, "doc_id", "text", q, "item_id", "text").count() == 0
    assert leaks.find_leaks(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0
    assert leaks.find_leaks(d.limit(0).withColumnRenamed("doc_id", "item_id"), "item_id", "text", q, "item_id", "text").count() == 0


def test_run_at_the_start_of_each_document(spark):
    rng = random.Random(5)
    items = {i: " ".join(f"w{rng.randrange(50_000)}" for _ in range(1000)) for i in range(3)}
    docs = {d: " ".join(items[d % 3].split()[7 * d : 7 * d + leaks.RUN] + [f"x{rng.randrange(50_000)}" for _ in range(20)]) for d in range(120)}
    d, q = frames(spark, docs, items)
    found = {tuple(r) for r in leaks.find_leaks(d.coalesce(1), "doc_id", "text", q, "item_id", "text").collect()}
    assert found == {(n, n % 3) for n in docs}


def reworded(rng, item, share, evenly, kinds):
    step = round(1 / share)
    at = set(range(step - 1, len(item), step)) if evenly else set(rng.sample(range(len(item)), int(share * len(item))))
    out = []
    for p, w in enumerate(item):
        kind = rng.choice(kinds) if p in at else "keep"
        out += {"keep": [w], "change": [f"y{rng.randrange(9999)}"], "drop": [], "add": [w, f"y{rng.randrange(9999)}"]}[kind]
    return out


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def both_ways(spark, monkeypatch, docs, items):
    d, q = frames(spark, docs, items)
    found = {tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", q, "item_id", "text").collect()}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 5000)
    assert {tuple(r) for r in leaks.find_leaks(d, "doc_id", "text", q, "item_id", "text").collect()} == found
    return found


def test_recall_of_reworded_items(spark, monkeypatch):
    rng = random.Random(7)
    items = {i: [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 130))] for i in range(20)}
    docs, expected = {}, set()
    for share in (0.1, 0.15, 0.2, 0.25):
        for evenly in (True, False):
            for i, item in items.items():
                around = [f"x{rng.randrange(3000)}" for _ in range(rng.choice([40, 400]))]
                at = rng.randrange(len(around))
                expected.add((len(docs), i))
                docs[len(docs)] = " ".join([*around[:at], *reworded(rng, item, share, evenly, ["change"]), *around[at:]])
    assert both_ways(spark, monkeypatch, docs, {i: " ".join(w) for i, w in items.items()}) == expected


def test_against_plain_lcs_over_all_passages(spark, monkeypatch):
    rng = random.Random(11)
    items = {i: [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 22))] for i in range(8)}
    docs = {}
    for d in range(60):
        around = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))]
        at = rng.randrange(len(around))
        docs[d] = [*around[:at], *reworded(rng, items[d % 8], rng.choice([0.2, 0.25, 0.34]), d % 2, ["change", "drop", "add"]), *around[at:]]
    expected = set()
    for d, w in docs.items():
        for i, item in items.items():
            size = int(len(item) * leaks.PASSAGE)
            runs = any(w[k : k + leaks.RUN] == item[p : p + leaks.RUN] for p in range(len(item) - leaks.RUN + 1) for k in range(len(w) - leaks.RUN + 1))
            if runs or any(plain_lcs(item, w[k : k + size]) >= leaks.REWORDED * len(item) for k in range(len(w))):
                expected.add((d, i))
    assert 0 < len(expected) < len(docs) * len(items)
    assert both_ways(spark, monkeypatch, {d: " ".join(w) for d, w in docs.items()}, {i: " ".join(w) for i, w in items.items()}) == expected
