"""Grouped splits against union-find in plain Python."""

import random

from lodeflow.llm import splits


def brute(rows, known):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, path, code in rows:
        find(("e", i))
        for key in (("p", path) if path in known else None, ("c", code.replace(" ", "")) if code and code.strip() else None):
            if key:
                parent[find(("e", i))] = find(key)
    out = {}
    groups = {}
    for i, path, _ in rows:
        groups.setdefault(find(("e", i)), []).append((i, path))
    for members in groups.values():
        paths = [p for _, p in members if p in known]
        key = min(paths) if paths else f"example:{min(i for i, _ in members)}"
        out |= {i: key for i, _ in members}
    return out


def test_groups_and_splits(spark):
    rng = random.Random(5)
    known = [f"r/src/f{i}.py" for i in range(60)]
    rows = [(i, rng.choice([*known, None, "", "elsewhere/x.py"]) if rng.random() < 0.7 else known[0], rng.choice([None, " ", f"c {rng.randrange(400)}"])) for i in range(900)]
    df = spark.createDataFrame([(i, p, c, int(i % 5 == 0)) for i, p, c in rows] + [(0, rows[0][1], rows[0][2], 1)], "example_id long, file_path string, code_context string, label int")
    files = spark.createDataFrame([(p,) for p in known] + [(None,), (known[0],)], "path string")
    grouped = splits.groups(df, files)
    found = {r.example_id: r.group_key for r in grouped.collect()}
    assert found == brute(rows, set(known))
    assigned = splits.assign(grouped).collect()
    assert len(assigned) == 900
    of = {}
    for r in assigned:
        assert of.setdefault(r.group_key, r.split) == r.split


def test_shares_with_many_groups(spark):
    df = spark.range(20000).selectExpr("id as example_id", "concat('g', id div 4) as group_key", "cast(id % 7 = 0 as int) as label")
    report = {r.split: r for r in splits.split_report(df, splits.assign(df)).collect()}
    for name, share in splits.SHARES.items():
        assert abs(report[name].share - share) < 0.005
        assert abs(report[name].share_of_ones - 1 / 7) < 0.01


def test_paths(spark):
    raw = ["./r/a/f.py", "r//a/f.py", "r\\a\\f.py", "r/a/b/../f.py", "r/./a/f.py", "file:///builds/x/r/a/f.py", "C:\\w\\r\\a\\f.py", "/builds/r/a/f.py", " r/a/f.py ", "other/f.py", None, ""]
    df = spark.createDataFrame([(p,) for p in raw], "p string")
    files = spark.createDataFrame([("r/a/f.py",), ("a/f.py",)], "path string")
    found = {r.p: r.known for r in splits.resolve_paths(df, "p", files, "path").collect()}
    assert found == {p: "r/a/f.py" for p in raw[:9]}


def test_code_key(spark):
    same = ["x = 1\ny = 2", "  x = 1 \n# note\n\ty=2\n", "// a\nx = 1\r\ny = 2", "/* z */\nx=1\ny=2"]
    blank = [None, "", " \n", "# only\n// comments"]
    df = spark.createDataFrame([(c,) for c in same + blank + ["x = 1 # y = 2"]], "c string")
    keys = [r[0] for r in df.select(splits.code_key(df.c)).collect()]
    assert len(set(keys[:4])) == 1 and keys[0]
    assert keys[4:8] == [None] * 4
    assert keys[8] not in (None, keys[0])


def test_empty(spark):
    df = spark.createDataFrame([], "example_id long, file_path string, code_context string, label int")
    grouped = splits.groups(df, spark.createDataFrame([], "path string"))
    assert grouped.count() == 0 and splits.assign(grouped).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(150)] + [("z1", "z1"), (None, "q")], "a string, b string")
    found = {r.node: r.component for r in splits.components(edges, "a", "b").collect()}
    assert len(found) == 151 and set(found.values()) == {"n000"}


def test_several_labels(spark):
    df = spark.range(60000).selectExpr("id as example_id", "concat('g', id div 3) as group_key", "0 as label", "array('all', if(id % 50 < 3, 'rare', null), if(id div 3 % 4 = 0, 'quarter', 'other')) as labels")
    shares = {(r.label, r.split): r.share for r in splits.label_report(df, splits.assign(df, labels="labels")).where("label is not null").collect()}
    assert len(shares) == 12
    for (label, name), share in shares.items():
        assert abs(share - splits.SHARES[name]) < 0.01, (label, name)


def test_a_heavy_group_doesn_t_spoil_the_shares(spark):
    df = spark.range(30000).selectExpr("id as example_id", "if(id < 10000, 'big', concat('g', id div 2)) as group_key", "cast(id % 10 = 0 as int) as label")
    report = {r.split: r for r in splits.split_report(df, splits.assign(df)).collect()}
    for name, share in splits.SHARES.items():
        assert abs(report[name].share - share) < 0.005 and abs(report[name].share_of_ones - 0.1) < 0.005


def test_deep_parents(spark):
    df = spark.createDataFrame([("r/" + "x/" * 20 + "../" * 20 + "a/f.py",)], "p string")
    assert splits.resolve_paths(df, "p", spark.createDataFrame([("r/a/f.py",)], "path string"), "path").first().known == "r/a/f.py"
