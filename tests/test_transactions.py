from __future__ import annotations

import random

from conftest import rows

from palimpsest.operators import planners, state, transactions, tree

STATE = "oid string, parent string, name string, kind string, size long, etag string"
CHANGES = ", ".join(f"{name} {kind}" for name, kind in transactions.COLUMNS.items())
DRIVE = [("a", "root", "a", "folder", 0, ""), ("b", "a", "b.txt", "file", 3, "e1"), ("c", "a", "c", "folder", 0, ""), ("z", "root", "z.txt", "file", 1, "e2")]


def listing(state_):
    return sorted((r["key"], r["size"] or 0) for r in transactions.keyed(state_).collect())


def change(seq, what, oid, parent=None, name=None, kind=None, size=None, recursive=None, chg=0):
    return (seq, 0, chg, None, oid, what, parent, name, kind, size, None, recursive)


def test_puts_make_what_is_missing(spark, table):
    drive = table(DRIVE, STATE)
    listed = transactions.keyed(drive)
    asked = table([(1, "new/deep/f", 5, "x"), (2, "new/deep/g", 6, "x"), (3, "a/b.txt", 7, "x"), (4, "a", 1, "x"), (5, "z.txt/y", 1, "x"), (6, "made/", 0, "x"), (7, "made/in", 2, "x"), (8, "new/deep/f", 9, "x")], "req long, key string, size long, etag string")
    outcomes, changes = transactions.put(asked, listed)
    assert dict(rows(outcomes.select("req", "outcome"))) == {1: "create", 2: "create", 3: "replace", 4: "conflict", 5: "conflict", 6: "create", 7: "create", 8: "create"}
    assert listing(transactions.apply(drive, changes)) == sorted([("a/", 0), ("a/b.txt", 7), ("a/c/", 0), ("z.txt", 1), ("new/", 0), ("new/deep/", 0), ("new/deep/f", 9), ("new/deep/g", 6), ("made/", 0), ("made/in", 2)])
    assert transactions.faults(changes, drive).count() == 0


def test_writes_deletes_and_renames(spark, table):
    drive = table(DRIVE, STATE)
    listed = transactions.keyed(drive)
    outcomes, changes = transactions.write(table([(1, "a/b.txt", 9, "w"), (2, "q", 4, "w"), (3, "a/", 4, "w")], "req long, key string, size long, etag string"), listed)
    assert dict(rows(outcomes.select("req", "outcome"))) == {1: "write", 2: "create", 3: "refused"}
    assert listing(transactions.apply(drive, changes)) == [("a/", 0), ("a/b.txt", 9), ("a/c/", 0), ("q", 4), ("z.txt", 1)]
    outcomes, changes = transactions.delete(table([(1, "a/"), (2, "a/c/"), (3, "z.txt"), (4, "none"), (5, ""), (6, "z.txt")], "req long, key string"), listed)
    assert listing(transactions.apply(drive, changes)) == [("a/", 0), ("a/b.txt", 3)] and transactions.faults(changes, drive).count() == 0
    outcomes, changes = transactions.rename(table([(1, "a/", "n/m/"), (2, "z.txt", "a/b.txt"), (3, "a/", "a/c/x/"), (4, "a/c/", "z.txt"), (5, "no", "yes")], "req long, source string, target string"), listed)
    assert dict(rows(outcomes.select("req", "outcome"))) == {1: "moved", 2: "replaced", 3: "inside itself", 4: "kind", 5: "missing"}
    assert listing(transactions.apply(drive, changes)) == [("n/", 0), ("n/m/", 0), ("n/m/b.txt", 1), ("n/m/c/", 0)]


def test_a_folder_comes_back(spark, table):
    then = table(DRIVE, STATE)
    now = table([("a", "root", "a", "folder", 0, ""), ("b", "root", "moved", "file", 8, "e9"), ("n", "a", "new", "file", 1, "x"), ("z", "a", "z.txt", "file", 1, "e2")], STATE)
    after = transactions.apply(now, transactions.restore_subtree(then, now, "a"))
    assert rows(after.select("oid", "parent", "name", "size")) == [("a", "root", "a", 0), ("b", "a", "b.txt", 3), ("c", "a", "c", 0)]


def test_faults_are_those_of_one_change_after_another(spark, table):
    """Against a drive kept as a dictionary, on random changes of which many are wrong."""
    rng = random.Random(9)
    log, want, linked, kinds = [], [], {}, {"f0": "folder", "f1": "folder"}
    linked |= {"f0": ("root", "f0"), "f1": ("root", "f1")}
    first = table([("f0", "root", "f0", "folder", 0, ""), ("f1", "root", "f1", "folder", 0, "")], STATE)
    for seq in range(1, 500):
        what, oid = rng.choice(["create", "create", "set", "move", "remove"]), rng.choice(["f0", "f1", "o1", "o2", "o3", "o4", "root"])
        parent, name, kind, recursive = rng.choice(["root", "f0", "f1", "o1", "gone"]), rng.choice("xy"), "folder" if oid[0] == "f" else "file", rng.random() < 0.3
        place = (parent, name) if what in ("create", "move") else (None, None)
        row = change(seq, what, oid, *place, kind if what == "create" else None, recursive=recursive if what == "remove" else None)
        at = linked.get(oid)
        if oid == "root":
            fault = "root"
        elif what != "create" and oid not in kinds:
            fault = "unknown object"
        elif what == "create" and at:
            fault = "already linked"
        elif what in ("move", "remove") and not at:
            fault = "not linked"
        elif place[0] and parent != "root" and parent not in kinds:
            fault = "unknown folder"
        elif place[0] and parent != "root" and kinds[parent] != "folder":
            fault = "not a folder"
        elif place[0] and parent == oid:
            fault = "inside itself"
        elif place[0] and any(p == place and o != oid for o, p in linked.items()):
            fault = "name taken"
        elif what == "remove" and not recursive and any(p[0] == oid for p in linked.values()):
            fault = "folder not empty"
        else:
            fault = None
        if fault:  # kept out of the log, but looked at by itself below
            want.append((row, fault, len(log)))
            continue
        log.append(row)
        if what == "create":
            kinds[oid] = kind
        if what in ("create", "move"):
            linked[oid] = place
        elif what == "remove":
            del linked[oid]
    assert len(log) > 60 and len({f for _, f, _ in want}) == 9
    assert transactions.faults(table(log, CHANGES), first).count() == 0
    shown = {}
    for row, fault, n in want:
        shown.setdefault(fault, (row, n))
    for fault, (row, n) in shown.items():
        found = transactions.faults(table([*log[:n], row], CHANGES), first).collect()
        assert [(r["seq"], r["fault"]) for r in found] == [(row[0], fault)]
    odd = transactions.faults(table([(1, 0, 0, None, None, None, *[None] * 6), change(2, "create", "k", "root", "k", "file"), change(3, "remove", "k"), change(4, "create", "k", "root", "k", "folder")], CHANGES))
    assert [(r["seq"], r["fault"]) for r in odd.orderBy("seq").collect()] == [(1, "unknown change"), (4, "kind")]


def test_loops(spark, table):
    drive = transactions.apply(table([*DRIVE, ("d", "c", "d", "folder", 0, "")], STATE), table([change(1, "move", "a", "d", "a")], CHANGES))
    assert sorted(r["oid"] for r in transactions.loops(drive).collect()) == ["a", "b", "c", "d"]


def test_merging_is_folding_on(spark, table):
    rng = random.Random(2)
    log = [change(s, rng.choice(["create", "set", "remove"]), f"o{rng.randrange(5)}", rng.choice([None, "p"]), None, None, rng.choice([None, s])) for s in range(1, 60)]
    changes, members = table(log, CHANGES), ["parent", "size"]
    half = state.fold(changes.where("seq <= 30"), members)
    columns = ["oid", "parent", "size", "head", "linked"]
    for later in (changes.where("seq > 30"), changes):  # changes held already alter nothing
        assert rows(transactions.merge(half, later, members).select(*columns)) == rows(state.fold(changes, members).select(*columns))


def test_requests_of_one_alias(spark, table):
    ops = ["undelete", "create", "create", "soft_delete", "soft_delete", "create", "undelete", "hard_delete", "undelete", "hard_delete", "hard_delete", None]
    found = planners.drive_requests(table([("d", i, op) for i, op in enumerate(ops)] + [(None, 1, "create"), (None, 2, "create")], "alias string, seq int, op string")).collect()
    assert [r["outcome"] for r in sorted((r for r in found if r["alias"]), key=lambda r: r["seq"])] == ["missing", "done", "exists", "done", "missing", "done", "exists", "done", "done", "done", "missing", "unknown"]
    assert sorted(r["outcome"] for r in found if r["alias"] is None) == ["done", "exists"]


def test_nested_changes(spark, table):
    schema = "seq long, idx int, time timestamp, target string, op string, changes array<struct<create: struct<oid: string, parent: string, name: string, kind: string>, set: struct<oid: string, size: bigint, etag: string>, move: struct<oid: string, parent: string, name: string>, remove: struct<oid: string, recursive: boolean>>>"
    found = transactions.changes_of(table([(1, 0, None, "o", "put", [(("o", "root", "n", "file"), None, None, None), (None, ("o", 4, "e"), None, None), (None, None, None, None), (None, None, ("o", "p", "m"), ("o", True))]), (2, 0, None, "o", "put", []), (3, 0, None, "o", "put", None)], schema)).orderBy("chg").collect()
    assert [(r["what"], r["oid"], r["size"]) for r in found] == [("create", "o", None), ("set", "o", 4), (None, None, None), (None, "o", None)]
    assert tree.keys(transactions.state_of(transactions.changes_of(table([(1, 0, None, "o", "put", [(("o", "root", "n", "file"), None, None, None)])], schema))).select("parent", "name", "oid", "kind")).first()["key"] == "n"
