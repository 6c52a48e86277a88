from __future__ import annotations

import hashlib
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest.functions import http
from palimpsest.operators import log, state
from palimpsest.session import shared_dir
from palimpsest.sources import store
from palimpsest.streaming import feed


def test_pool_descriptors(spark, tmp_path):
    good, bad = tmp_path / "pool.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"format": 1, "hash": "sha256", "features": ["inline-data"]}))
    bad.write_text(json.dumps({"format": 1, "hash": "sha256", "features": ["time-machine"]}))
    assert store.read_pool(spark, str(good)).first()["features"] == ["inline-data"]
    with pytest.raises(store.UnsupportedPool):
        store.read_pool(spark, str(bad))
    assert store.read_drive(spark, str(tmp_path / "none.json")) is None


def test_log_files_shards_and_walk(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for seq in (1, 2, 4):
        (tmp_path / f"log/{seq:016x}.json").write_text(json.dumps({"format": 1, "seq": seq, "time": "2024-01-01T00:00:00Z", "txns": [{"target": "o-1", "op": "put", "changes": [{"create": {"oid": "o-1", "parent": "root", "name": "n", "kind": "file"}}]}]}))
    found = store.read_log(spark, str(tmp_path / "log"))
    assert sorted(r["seq"] for r in found.collect()) == [1, 2]
    assert found.first()["txns"][0]["changes"][0]["set"] is None
    data = b"shard bytes"
    name = hashlib.sha256(data).hexdigest()
    (tmp_path / f"shards/{name[:2]}").mkdir(parents=True)
    (tmp_path / f"shards/{name[:2]}/{name}").write_bytes(data)
    assert store.read_shards(spark, str(tmp_path / "shards")).first()["hash"] == name
    (tmp_path / f"shards/{name[:2]}/{'0' * 64}").write_bytes(data)
    with pytest.raises(Exception, match="does not match"):
        store.read_shards(spark, str(tmp_path / "shards")).collect()
    assert [r["key"] for r in store.walk(spark, str(tmp_path / "log")).collect()] == [f"{s:016x}.json" for s in (1, 2, 4)]


def test_listings_see_every_name(spark, tmp_path):
    """Names that begin with a dot or underscore, empty folders, and links, which are left out."""
    for name in ("a.txt", ".env", "_notes.md", "b/_idx/y", "b/c.txt", ".cfg/x", "_dir/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty/inner").mkdir(parents=True)
    path = f"file://{tmp_path}"
    files = [".cfg/x", ".env", "_dir/z", "_notes.md", "a.txt", "b/_idx/y", "b/c.txt"]
    assert [(r["key"], r["length"]) for r in store.walk(spark, path).collect()] == sorted([*((f, len(f)) for f in files), ("empty/inner/", 0)])
    assert [r["path"] for r in store.list_recursive(spark, path).collect()] == files
    assert [r["path"] for r in store.list_recursive(spark, path, after="_notes.md").collect()] == files[4:]
    assert [r["path"] for r in store.list_files(spark, path).collect()] == [".env", "_notes.md", "a.txt"]
    assert [r["name"] for r in store.list_dirs(spark, path).collect()] == [".cfg", "_dir", "b", "empty"]
    none = tmp_path / "none"
    none.mkdir()
    assert store.walk(spark, str(none)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        shared_dir(Session())


def test_checkpoint_and_append(spark, table, tmp_path):
    rows_ = table([("b", 2), ("a", 1)], "oid string, n int")
    log.write_checkpoint({"objects": (rows_, ["oid"])}, str(tmp_path / "cp"))
    assert rows(store.read_checkpoint(spark, str(tmp_path / "cp"), "objects")) == [("a", 1), ("b", 2)]
    commits = table([(1, "x"), (2, "y")], "seq long, body string")
    assert log.append_commits(commits, str(tmp_path / "log")) == 2
    assert log.append_commits(commits.unionAll(table([(3, "z")], "seq long, body string")), str(tmp_path / "log")) == 1
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    assert log.delete_prefix(spark, str(tmp_path / "log"))


def test_commits_by_bytes(spark, table):
    txns = table([("d", i, 0, n) for i, n in enumerate([50, 60, 200, 10, 10])], "drive string, seq long, idx int, nbytes long")
    found = {r["seq"]: r["commit"] for r in log.group_by_bytes(txns, "drive", "nbytes", 100).collect()}
    assert found == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4}


def test_segments(spark, table):
    names = sorted(f"k{i:05d}" for i in range(9000))
    found = log.segments(table([("t", n) for n in names], "table string, key string"), "table", "key").collect()
    segment = {r["key"]: r["segment"] for r in found}

    def zeros(k):
        tail = int.from_bytes(hashlib.sha256(k.encode()).digest()[-2:], "big")
        return 16 if tail == 0 else (tail & -tail).bit_length() - 1

    want, start, i, fallback, number = {}, 0, 0, None, 0
    while i < len(names):
        n = i + 1 - start
        z = zeros(names[i]) if n >= 256 else 0
        fallback = i + 1 if z >= 10 else fallback
        if z >= 12 or n == 8192:
            end = fallback or i + 1
            want |= dict.fromkeys(names[start:end], number)
            start = i = end
            fallback, number = None, number + 1
        else:
            i += 1
    want |= dict.fromkeys(names[start:], number)
    assert segment == want


def test_golden_invalidations(spark, table):
    changes = table([("put", "a.txt", None, "file"), ("rename", "new/", "old/", "folder"), ("delete", "gone", None, "file"), ("create", "made/", None, "folder")], "op string, key string, from_key string, kind string")
    assert rows(feed.invalidations(changes)) == [("object", "a.txt"), ("object", "gone"), ("object", "made/"), ("object", "new/"), ("object", "old/"), ("subtree", "new/"), ("subtree", "old/")]


def test_feed_order(spark, table):
    changes = table([(1, 0, "t", "restore", "target"), (1, 0, "x", "restore", "other"), (1, 0, "y", "restore", "other"), (1, 0, "n", "restore", "create"), (1, 0, "w", "restore", "other")], "seq long, idx int, oid string, op string, what string")
    before = table([(1, 0, "t", "d/", "folder"), (1, 0, "x", "d/x", "file"), (1, 0, "y", "d/y/", "folder"), (1, 0, "w", "e/w", "file")], "seq long, idx int, oid string, key string, kind string")
    after = table([(1, 0, "t", "d/", "folder"), (1, 0, "n", "d/n/", "folder"), (1, 0, "w", "d/w", "file")], "seq long, idx int, oid string, key string, kind string")
    found = [(r["op"], r["key"], r["from_key"]) for r in feed.feed_of(changes, before, after).orderBy("place").collect()]
    assert found == [("create", "d/n/", None), ("delete", "d/y/", None), ("delete", "d/x", None), ("restore", "d/", None), ("restore", "d/w", "e/w")]


def test_watch_delivers_each_commit_once_in_order_and_resumes(spark, tmp_path):
    """What comes late, after a restart or with a time long past, is neither lost nor out of order."""
    source, seen = tmp_path / "feed", []
    source.mkdir()
    put = lambda name, *seqs: (source / name).write_text("".join(json.dumps({"seq": s, "time": f"2024-01-{s:02d}T00:00:00Z"}) + "\n" for s in seqs))
    deliver = lambda df, n: seen.extend(r["seq"] for r in df.collect())
    run = lambda: feed.watch(feed.read_log_stream(spark, str(source), "seq long, time timestamp"), deliver, str(tmp_path / "cp"), after=1).awaitTermination(120)
    put("a.json", 1, 2, 3, 3, 9)
    run()
    put("b.json", 3, 6, 4, 10)
    run()
    assert seen == [2, 3, 4]
    put("c.json", 8, 7, 5)
    run()
    run()
    assert seen == [2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_fold_stream_of_changes_in_any_order(spark, tmp_path):
    rng, members = random.Random(8), ["size", "parent"]
    changes = [{"seq": s, "idx": 0, "chg": 0, "time": s, "oid": f"o{rng.randrange(4)}", "what": rng.choice(["create", "set", "remove"]), "size": rng.choice([None, s]), "parent": rng.choice([None, f"p{s}"])} for s in range(1, 80)]
    schema = "seq long, idx int, chg int, time long, oid string, what string, size long, parent string"
    rng.shuffle(changes)
    (tmp_path / "c").mkdir()
    for i in range(4):
        (tmp_path / f"c/{i}.json").write_text("\n".join(json.dumps(c) for c in changes[i * 20 : i * 20 + 22]))  # some come twice
        feed.fold_stream(spark.readStream.schema(schema).json(str(tmp_path / "c")), members, str(tmp_path / "cp")).awaitTermination(120)
    found = feed.folded(spark, str(tmp_path / "cp"))
    want = state.fold(spark.createDataFrame([tuple(c.values()) for c in changes], schema), members)
    columns = ["oid", "size", "parent", "linked", "time", "head"]
    assert rows(found.select(*columns)) == rows(want.select(*columns))


@pytest.mark.parametrize(("header", "size", "want"), [
    ("bytes=0-99", 1000, (206, 0, 99)), ("bytes=900-", 1000, (206, 900, 999)), ("bytes=-10", 1000, (206, 990, 999)), ("bytes=-2000", 1000, (206, 0, 999)), ("bytes=5-2", 1000, (200, 0, 999)), ("bytes=0-1,4-5", 1000, (200, 0, 999)),
    ("items=0-1", 1000, (200, 0, 999)), ("bytes=1000-", 1000, (416, 0, 0)), ("bytes=-0", 1000, (416, 0, 0)), ("bytes=x-", 1000, (416, 0, 0)), ("bytes=0-", 0, (416, 0, 0)),
])
def test_ranges(spark, table, header, size, want):
    got = table([(header, size)], "h string, n long").select(http.byte_range(F.col("h"), F.col("n")).alias("r")).first()["r"]
    assert tuple(got) == want


def test_names_and_keys(spark, table):
    names = {"": "empty", "x" * 256: "too long", "é" * 128: "too long", "a/b": "bad character", "a\0": "bad character", ".": "dot", "..": "dot", "été ✓.txt": "ok", "x" * 255: "ok"}
    got = table([(n,) for n in names], "n string").select("n", http.name_error(F.col("n")).alias("e")).collect()
    assert {r["n"]: r["e"] for r in got} == names
    keys = {"": "ok", "/": "empty segment", "/a": "empty segment", "a//b": "empty segment", "a/b/": "ok", "a/../b": "dot", "x" * 1025: "key too long"}
    got = table([(k,) for k in keys], "k string").select("k", http.key_error(F.col("k")).alias("e")).collect()
    assert {r["k"]: r["e"] for r in got} == keys


def test_human_bytes_round_halves_of_a_tenth_to_even(spark, table):
    rng = random.Random(4)
    sizes = [0, 1, 1023, 1024, 1048575, 1048576, (1 << 30) - 1, 1 << 40, (1 << 63) - 1]
    sizes += [(4 * rng.randrange(1, 1000) + k << bits) // 4 for bits in (10, 20, 30, 40) for k in range(4) for _ in range(9)] + [rng.randrange(1 << rng.randrange(1, 63)) for _ in range(300)]

    def want(n: int) -> str:
        bits = next((b for b in (40, 30, 20, 10) if n >= 1 << b), 0)
        return f"{n / (1 << bits):.1f} {dict(zip((10, 20, 30, 40), ('KiB', 'MiB', 'GiB', 'TiB'), strict=True))[bits]}" if bits else f"{n} B"

    found = table([(n,) for n in sizes], "n long").select("n", http.human_bytes(F.col("n")).alias("size")).collect()
    assert {r["n"]: r["size"] for r in found} == {n: want(n) for n in sizes}
