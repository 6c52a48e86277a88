from __future__ import annotations

import hashlib
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest.functions import checksums, chunking, patch
from palimpsest.operators import content, gc, log, temporal


def test_edits_are_those_of_a_buffer(spark, table):
    rng = random.Random(9)
    base, edits, want = [], [], {}
    for doc in range(60):
        data = rng.randbytes(rng.randrange(0, 60))
        buffer = bytearray(data)
        for ord_ in range(rng.randrange(0, 7)):
            off, new = rng.randrange(0, 80), rng.randbytes(rng.randrange(1, 12))
            edits.append((doc, ord_, off, new))
            buffer.extend(b"\0" * (off - len(buffer)))
            buffer[off : off + len(new)] = new
        base.append((doc, bytearray(data)))
        want[doc] = bytes(buffer)
    found = content.apply_edits(table(base, "doc_id long, bytes binary"), table(edits, "doc_id long, ord int, off long, data binary"))
    assert {r["doc_id"]: bytes(r["bytes"]) for r in found.collect()} == want


def test_splice_and_sizes(spark, table):
    df = table([(bytearray(b"abcdef"),)], "b binary")
    got = df.select(content.splice(F.col("b"), F.lit(2), F.lit(3), F.lit(b"XY")), content.set_size(F.col("b"), F.lit(3)), content.set_size(F.col("b"), F.lit(8)), content.write_at(F.col("b"), F.lit(7), F.lit(b"Z"))).first()
    assert [bytes(x) for x in got] == [b"abXYf", b"abc", b"abcdef\0\0", b"abcdef\0Z"]


def test_etag_of_more_extents_than_a_batch(spark, table):
    """Pieces of an object that end before its last extent give no row, and none of them is an error."""
    shas = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    extents = table([(oid, i, sha, oid + i, None) for oid in (1, 2) for i, sha in enumerate(shas)] + [(1, 40, None, None, 4096)], "oid long, pos int, s string, n long, z long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = dict(rows(content.etag(extents.repartition(5))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    body = {oid: b"inline\0" + b"".join(b"s" + bytes.fromhex(sha) + (oid + i).to_bytes(8, "big") for i, sha in enumerate(shas)) for oid in (1, 2)}
    body[1] += b"z" + (4096).to_bytes(8, "big")
    assert found == {oid: hashlib.sha256(x).hexdigest() for oid, x in body.items()}


def test_normalize_and_read_plan(spark, table):
    extents = table([(1, 0, "aa", 10, None), (1, 1, None, None, 5), (1, 2, None, None, 7), (1, 3, "bb", 0, None), (1, 4, "cc", 4, None)], "oid long, pos int, s string, n long, z long")
    normal = content.normalize(extents)
    assert [(r["s"], r["n"], r["z"]) for r in normal.orderBy("pos").collect()] == [("aa", 10, None), (None, None, 12), ("cc", 4, None)]
    asked = table([(1, 8, 16), (1, 20, 99)], "oid long, start long, len long")
    assert rows(content.read_plan(normal, asked).select("pos", "source", "offset", "len")) == [(0, "aa", 8, 2), (1, "zeros", 0, 12), (2, "cc", 0, 2)]


def test_touching_ranges_stay_apart(spark, table):
    ranges = table([(1, 0, 5), (1, 4, 8), (1, 8, 9), (2, 3, 4)], "k int, start long, stop long")
    assert rows(temporal.islands(ranges, "k")) == [(1, 0, 8), (1, 8, 9), (2, 3, 4)]


def test_later_extents_lie_over_earlier(spark, table):
    found = content.overlay_extents(table([(1, 0, 0, 10), (1, 1, 3, 5)], "key int, ord int, start long, stop long"))
    assert rows(found.select("start", "stop", "ord")) == [(0, 3, 0), (3, 5, 1), (5, 10, 0)]


def test_overlays_of_many_extents_are_those_of_a_buffer(spark, table):
    """A file of many edits, one of long extents, touching and empty ones, in small batches."""
    rng = random.Random(6)
    extents = [("hot", i, (a := rng.randrange(2000)), a + rng.randrange(0, 60)) for i in range(1500)] + [("long", i, i * 3, 400 - i) for i in range(80)] + [("one", 0, 5, 9)]
    want = []
    for key in ("hot", "long", "one"):
        cells = {}
        for k, i, a, b in extents:
            if k == key:
                cells |= dict.fromkeys(range(a, b), i)
        for at in sorted(cells):
            if want and want[-1][0] == key and want[-1][2] == at and want[-1][3] == cells[at]:
                want[-1] = (key, want[-1][1], at + 1, cells[at])
            else:
                want.append((key, at, at + 1, cells[at]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    found = content.overlay_extents(table(extents, "key string, ord int, start long, stop long").repartition(5)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["key"], r["start"], r["stop"], r["ord"]) for r in found) == want


def test_manifest_trees_hold_every_extent(spark, table):
    """Three levels; flattened again by their pages, whose names are their hashes; a small object has no tree."""
    rng = random.Random(7)
    extents = [("big", i, hashlib.sha256(b"%d" % i).hexdigest(), 9, None) if i % 50 else ("big", i, None, None, 4) for i in range(2700)] + [("small", i, "ab", 1, None) for i in range(1024)]
    rng.shuffle(extents)
    least, most, bits = log.LEAF_MIN, log.LEAF_MAX, log.LEAF_BITS
    log.LEAF_MIN, log.LEAF_MAX, log.LEAF_BITS = 4, 16, 3
    try:
        roots, pages = log.manifests(table([e for e in extents if e[0] == "big"] + [e for e in extents if e[0] == "small"][:16], "oid string, pos int, s string, n long, z long"))
    finally:
        log.LEAF_MIN, log.LEAF_MAX, log.LEAF_BITS = least, most, bits
    [root] = roots.collect()
    held = {r["hash"]: r["bytes"] for r in pages.collect()}
    assert root["oid"] == "big" and all(hashlib.sha256(b.encode()).hexdigest() == h for h, b in held.items())

    def flat(page):
        found = json.loads(held[page])
        return found["extents"] if found["kind"] == "leaf" else [x for c in found["children"] for x in flat(c["page"])]

    want = [{"s": s, "n": n} if s else {"z": z} for _, _, s, n, z in sorted(e for e in extents if e[0] == "big")]
    assert flat(root["root"]) == want and root["size"] == sum(x.get("n") or x["z"] for x in want)


def test_chunk_sizes(spark, table):
    cases = {(262_144, 2_097_152, 16_777_216): True, (64, 256, 1024): True, (63, 256, 1024): False, (512, 256, 1024): False, (64, 256, 32 << 20): False, (64, 255, 1024): False, (64, 256, None): False}
    df = table([(*k,) for k in cases], "a long, b long, c long")
    assert {(r["a"], r["b"], r["c"]): r["fits"] for r in df.withColumn("fits", chunking.sizes_fit(F.col("a"), F.col("b"), F.col("c"))).collect()} == cases


def test_chunks_do_not_depend_on_the_pieces():
    rng = random.Random(4)
    data = rng.randbytes(20_000)
    whole = chunking.chunks(data, 64, 256, 1024)
    assert b"".join(whole) == data and all(64 <= len(c) <= 1024 for c in whole[:-1])
    for _ in range(10):
        cuts = sorted(rng.randrange(len(data)) for _ in range(9))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert list(chunking.stream_chunks(pieces, 64, 256, 1024)) == whole
    moved = chunking.chunks(b"new bytes in front" + data, 64, 256, 1024)
    assert len(set(whole) & set(moved)) > len(whole) * 0.8
    with pytest.raises(ValueError):
        chunking.check_sizes(512, 256, 1024)


def test_checksums_of_the_standard_input():
    assert checksums.crc(b"123456789", checksums.CRC32C, 32) == 0xE3069283
    assert checksums.crc(b"123456789", checksums.CRC64, 64) == 0xAE8B14860A799888


def test_patch_bodies():
    edits = [(5, b"abc"), (0, b""), (1 << 40, b"z")]
    body = patch.encode(edits)
    assert patch.decode(body) == edits
    for wrong in (b"", b"XXXX" + body[4:], body[:4] + b"\x09" + body[5:], body[:6] + b"\x01" + body[7:], body[:8] + b"\0\0\0\0" + body[12:], body[:-1], body + b"x"):
        with pytest.raises(patch.PatchError):
            patch.decode(wrong)


def test_collection_never_takes_what_is_referenced(spark, table):
    rng = random.Random(1)
    for _ in range(5):
        hashes = [f"h{i}" for i in range(24)]
        stored = table([(h, rng.randrange(100), f"2024-01-0{rng.randrange(1, 9)} 00:00:00") for h in hashes], "hash string, size long, at string").withColumn("modified", F.col("at").cast("timestamp_ntz"))
        refs_then, refs_now = (table([(h,) for h in rng.sample(hashes, 9)], "hash string") for _ in range(2))
        doomed = gc.confirm(stored, gc.candidates(stored, refs_then, "2024-01-05 00:00:00"), refs_now, "2024-01-06 00:00:00")
        kept = stored.join(doomed, "hash", "left_anti")
        assert gc.dangling(refs_now, kept).count() == 0
