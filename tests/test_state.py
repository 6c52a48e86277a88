from __future__ import annotations

import random

from conftest import rows

from palimpsest.operators import state, tree
from palimpsest.operators.listing import list_keys

SCHEMA = "seq long, idx int, chg int, time string, oid string, what string, parent string, name string, size long, etag string"
#: The sample drive: a folder with a file and an empty folder, and a file beside it.
ENTRIES = [("root", "a", "o-a", "folder"), ("o-a", "b.txt", "o-b", "file"), ("o-a", "c", "o-c", "folder"), ("root", "z.txt", "o-z", "file")]
#: Listings of the sample drive that any engine of this data model has to give.
GOLDEN = [
    ("", False, None, 100, ["a/b.txt", "a/c/", "z.txt"], False), ("", True, None, 100, ["a/", "z.txt"], False), ("a/", True, None, 100, ["a/b.txt", "a/c/"], False), ("a/b", False, None, 100, ["a/b.txt"], False),
    ("a/c/", False, None, 100, ["a/c/"], False), ("", False, None, 2, ["a/b.txt", "a/c/"], True), ("", False, "a/c/", 2, ["z.txt"], False), ("", False, "a/", 10, ["a/b.txt", "a/c/", "z.txt"], False), ("nope/", False, None, 100, [], False),
]


def test_golden_listings(spark, table):
    entries = table(ENTRIES, "parent string, name string, oid string, kind string")
    keyed = tree.keys(entries).cache()
    for prefix, delimited, after, limit, keys, more in GOLDEN:
        found = list_keys(keyed, entries, prefix, delimited, after, limit).orderBy("key").collect()
        assert [r["key"] for r in found] == keys
        assert all(r["truncated"] == more for r in found)


def test_fold_is_the_sequential_fold(spark, table):
    rng = random.Random(3)
    log, model = [], {}
    for seq in range(1, 400):
        oid = f"o{rng.randrange(12)}"
        what = rng.choice(["create", "set", "move", "remove"])
        change = {"parent": f"p{rng.randrange(3)}" if what in ("create", "move") else None, "name": None, "size": rng.randrange(9) if what == "set" else None, "etag": None}
        log.append((seq, 0, 0, "t", oid, what, change["parent"], None, change["size"], None))
        now = model.setdefault(oid, {"linked": None})
        now.update({k: v for k, v in change.items() if v is not None}, head=seq)
        if what in ("create", "remove"):
            now["linked"] = what
    changes = table(log, SCHEMA)
    found = {r["oid"]: r for r in state.fold(changes, ["parent", "size"]).collect()}
    assert found.keys() == model.keys()
    for oid, want in model.items():
        assert (found[oid]["parent"], found[oid]["size"], found[oid]["head"]["seq"], found[oid]["linked"]) == (want.get("parent"), want.get("size"), want["head"], want["linked"])


def test_log_stops_at_the_first_gap(spark, table):
    log = table([(n,) for n in [1, 2, 3, 5, 6, 70000]], "seq long")
    assert rows(state.contiguous(log, 0)) == [(1,), (2,), (3,)]
    assert rows(state.contiguous(log, 4)) == [(5,), (6,)]
    assert rows(state.contiguous(log, 3)) == []
    long = spark.range(1, 140_000).withColumnRenamed("id", "seq")
    assert state.contiguous(long, 0).count() == 139_999
    assert state.contiguous(long.where("seq <> 65537"), 0).count() == 65_536
    assert state.contiguous(long.where("seq <= 65536 or seq > 131072"), 0).count() == 65_536


def test_explode_undoes_pack(spark, table):
    txns = table([(1, 0, "t1", "a"), (1, 1, "t1", "b"), (2, 0, "t2", "c")], "seq long, idx int, time string, target string")
    assert rows(state.explode_log(state.pack_log(txns, ["target"]))) == rows(txns)


def test_changed_shape(spark, table):
    a, b = table([("x", 1), ("y", 1), ("z", 1)], "oid string, v int"), table([("x", 1), ("y", 2), ("w", 1)], "oid string, v int")
    assert rows(state.changed_shape(a, b, ["v"])) == [("w", "create"), ("y", "write"), ("z", "delete")]
    assert state.changed_shape(a, a, ["v"]).count() == 0


def test_log_faults(spark, table):
    log = table([(1, 1), (2, 3), (4, 4), (5, 2)], "seq long, time int")
    assert rows(state.violations(log)) == [(4, "gap"), (5, "time")]


def test_cycles_and_orphans_have_no_key(spark, table):
    rows_ = [*ENTRIES, ("o-x", "x", "o-y", "folder"), ("o-y", "y", "o-x", "folder"), ("o-y", "in", "o-w", "file"), ("nowhere", "n", "o-n", "file")]
    found = tree.keys(table(rows_, "parent string, name string, oid string, kind string"))
    assert sorted(r["key"] for r in found.collect()) == ["a/", "a/b.txt", "a/c/", "z.txt"]


def test_deep_keys(spark, table):
    deep = [("root" if i == 0 else f"o{i - 1}", "d", f"o{i}", "folder") for i in range(300)]
    assert tree.keys(table(deep, "parent string, name string, oid string, kind string")).where("depth = 300").first()["key"] == "d/" * 300
