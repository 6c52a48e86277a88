"""SimHash near-duplicates with the generalised pigeonhole principle.

A fingerprint's bits are dealt to partitions, correlated bits together, so that values differ as much as they can. Two
fingerprints within DISTANCE bits must come within e_i bits of each other in some partition i, whatever thresholds e_i
are chosen, as long as they sum to DISTANCE - PARTITIONS + 1; a threshold of -1 leaves a partition out. The thresholds
are allocated by dynamic programming on the candidates that each would bring, estimated from the partitions' values.
Each fingerprint is put under its values, and probes all values within the thresholds; candidates are verified.

Links join distinct fingerprints only, and a bucket yields links enough to connect what is connected in it, not all its
pairs. A bucket of over HOT fingerprints is dealt anew by its other bits, of which a part has to be equal too.

Null and empty texts have fingerprint zero and are linked like any other. Copies and repeated rows share a fingerprint.
Rows with a null id count as members but never name a group; a group without ids has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.common import annotate, documents, ids_and_texts, schema_of, settled, slices, unused
from palimpsest.llm.components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Partitions of 16 bits: a histogram has at most 4 x 2 to the 16 entries, whatever the input.
PARTITIONS, WIDTH = 4, 16
#: Fingerprints of a bucket beyond which it is dealt anew by SUBPARTS parts of its other bits.
HOT, SUBPARTS = 20_000, 4
#: Fingerprints of a bucket up to which all its pairs are looked at together with other buckets'.
SMALL = 48


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    hashes, n = [], []
    for text in texts:
        words = text.lower().split()
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)] if words else []
        found = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        hashes.append(found)
        n.append(len(found))
    n = np.array(n, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds fingerprint, as a signed long."""

    def kernel():
        def run(texts: list[bytes]) -> dict:
            return {"fingerprint": np.concatenate([fingerprints(texts[a:b]) for a, b in slices(texts)]).view(np.int64)}

        return run

    return annotate(df, text_col, "fingerprint long", kernel)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(fingerprints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits named, as one number."""
    out = np.zeros(len(fingerprints), np.int64)
    for i, bit in enumerate(bits):
        out |= ((fingerprints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    return out


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def correlated_groups(distinct: DataFrame) -> list[list[int]]:
    """Bits by partition: each partition starts from a bit left and takes the bits that correlate with it most."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS))
        for batch in batches:
            bits = _bits(_numbers(batch)).astype(np.float32)
            total[:BITS] += bits.T @ bits
            total[BITS] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "total"])

    sums = np.zeros((BITS + 1) * BITS)
    for row in distinct.select("fingerprint").mapInArrow(moments, schema_of("place long, total double")).groupBy("place").agg(F.sum("total").alias("total")).collect():
        sums[row["place"]] = row["total"]
    sums = sums.reshape(BITS + 1, BITS)
    n = max(1.0, sums[BITS, 0])
    joint, mean = sums[:BITS] / n, np.diag(sums[:BITS]) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((joint - np.outer(mean, mean)) / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    while left:
        first = max(left, key=lambda b: (tie[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < WIDTH:
            bit = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(bit)
            left.remove(bit)
        groups.append(sorted(group))
    return groups


def histograms(distinct: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """How many fingerprints have each value of each partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTITIONS, 1 << WIDTH), np.int64)
        for batch in batches:
            found = _numbers(batch)
            for i, bits in enumerate(groups):
                total[i] += np.bincount(_values(found, bits), minlength=1 << WIDTH)
        place = np.flatnonzero(total.ravel())
        for a in range(0, len(place), 50_000):
            at = place[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["place", "total"])

    out = np.zeros(PARTITIONS << WIDTH, np.int64)
    found = distinct.select("fingerprint").mapInArrow(count, schema_of("place long, total long")).groupBy("place").agg(F.sum("total").alias("total")).toPandas()
    out[found["place"].to_numpy(np.int64)] = found["total"].to_numpy(np.int64)
    return out.reshape(PARTITIONS, 1 << WIDTH)


def masks(radius: int) -> list[int]:
    """What to flip in a partition's value to come to all values within `radius` bits, nothing flipped first."""
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(WIDTH), r)]


def allocate(counts: np.ndarray) -> list[int]:
    """Thresholds that sum to DISTANCE - PARTITIONS + 1, with the fewest candidates and probes by dynamic programming."""
    cost = np.zeros((PARTITIONS, DISTANCE + 2))
    for i, own in enumerate(counts.astype(np.float64)):
        near = np.zeros_like(own)
        done = 0
        for radius in range(DISTANCE + 1):
            flips = masks(radius)
            for flip in flips[done:]:
                near += own[np.arange(1 << WIDTH) ^ flip]
            done = len(flips)
            cost[i, radius + 1] = (own * near).sum() + 10 * own.sum() * done
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(PARTITIONS):
        following: dict[int, tuple[float, list[int]]] = {}
        for total, (price, chosen) in best.items():
            for e in range(-1, DISTANCE + 1):
                option = (price + cost[i, e + 1], [*chosen, e])
                if total + e not in following or option < following[total + e]:
                    following[total + e] = option
        best = following
    return best[DISTANCE - PARTITIONS + 1][1]


def bucket_keys(found: np.ndarray, groups: list[list[int]], thresholds: list[int], hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each fingerprint, its own values and those it probes, and the fingerprints beside them."""
    keys, owners = [], []
    for i, (bits, radius) in enumerate(zip(groups, thresholds, strict=True)):
        if radius < 0:
            continue
        own = _values(found, bits)
        rest = [b for j, other in enumerate(groups) if j != i for b in other]
        parts = [rest[j::SUBPARTS] for j in range(SUBPARTS)]
        for flip in masks(radius):
            value = own ^ flip
            base = (i << WIDTH | value) << 16
            split = np.isin(value, hot[i])
            keys.append(base[~split])
            owners.append(found[~split])
            for j, sub in enumerate(parts):
                keys.append(base[split] | (j + 1) << 12 | _values(found[split], sub))
                owners.append(found[split])
    return np.concatenate(keys), np.concatenate(owners)


def spanning(found: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect whatever is connected within one bucket, a breadth-first forest of verified links."""
    left, ends, starts = np.unique(found), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= DISTANCE
            if near.any():
                hits = left[near]
                ends.append(hits)
                starts.append(np.full(len(hits), at, np.uint64))
                queue.extend(hits)
                left = left[~near]
    return starts, ends


def bucket_links(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, whose rows stand together."""
    starts, ends = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(edge, len(keys)))
    for a, n in zip(edge[size > SMALL], size[size > SMALL], strict=True):
        more = spanning(found[a : a + n])
        starts += more[0]
        ends += more[1]
    small = np.repeat(size <= SMALL, size)
    keys, found = keys[small], found[small]
    for gap in range(1, int(min(SMALL, size[size <= SMALL].max(initial=1)))):
        same = np.flatnonzero(keys[gap:] == keys[:-gap])
        if not len(same):
            break
        near = same[np.bitwise_count(found[same] ^ found[same + gap]) <= DISTANCE]
        starts.append(found[near])
        ends.append(found[near + gap])
    a, b = np.concatenate(starts), np.concatenate(ends)
    return a[a != b], b[a != b]


def links(distinct: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough to connect all that are within DISTANCE bits by steps."""
    groups = correlated_groups(distinct)
    counts = histograms(distinct, groups)
    thresholds = allocate(counts)
    hot = [np.flatnonzero(own > HOT) for own in counts]

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = bucket_keys(_numbers(batch), groups, thresholds, hot)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners.view(np.int64))], names=["key", "fingerprint"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = np.empty(0, np.int64), np.empty(0, np.uint64)
        out = lambda k, f: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in bucket_links(k, f)], names=["a", "b"])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, found = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1])) if (keys[1:] >= keys[:-1]).all() else 0
            if cut or held and held[0][0][0] != keys[0]:
                held.append((keys[:cut], found[:cut]))
                yield out(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
                held = []
            held.append((keys[cut:], found[cut:]))
        if held:
            yield out(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    spread = distinct.select("fingerprint").mapInArrow(signatures, schema_of("key long, fingerprint long")).repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(verify, schema_of("a long, b long"))


def linked_of(distinct: DataFrame) -> DataFrame:
    """The fingerprints that have links, with their component's root, one of its fingerprints."""
    roots = components(links(distinct)).select(F.col("node").alias("fingerprint"), "root")
    return settled(roots.join(distinct, "fingerprint"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id, the smallest id that links lead to, for every row."""
    rows = settled(with_fingerprint(ids_and_texts(df, id_col, text_col)).select("doc_id", "fingerprint"))
    distinct = settled(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    linked = linked_of(distinct)
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("named")), "root").select("fingerprint", "named")
    # kept on its own, so that both sides of the join are plain shuffles and Spark can split a hot fingerprint's rows
    groups = settled(distinct.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("named", "least").alias("component_id")))
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the smallest id, with the columns it had; null ids come last.

    Rows are told apart by id and text, so an id may stand on different texts, in one group or in several. Of rows
    with one id in a group that with the smallest digest of its text stays, and one of those that agree in both.
    """
    digest = lambda text: F.coalesce(F.md5(F.col(text).cast("string")), F.lit(""))
    narrow = ids_and_texts(df, id_col, text_col).withColumn("digest", digest("text"))
    rows = settled(with_fingerprint(narrow).select("doc_id", "digest", "fingerprint"))
    same = rows.groupBy("fingerprint", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")
    distinct = settled(same.groupBy("fingerprint").agg(F.min(first).alias("least")))
    groups = distinct.join(linked_of(distinct).select("fingerprint", "root"), "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("least").alias("least"))
    own_id, own_digest = unused(df, "id", "digest")
    stays = settled(groups.select(F.col("least.doc_id").alias(f"{own_id}_stays"), F.col("least.digest").alias(f"{own_digest}_stays"), F.col("least.n").alias("n")))
    found = df.withColumns({own_id: F.col(id_col).cast("long"), own_digest: digest(text_col)})

    def among(wanted: DataFrame) -> DataFrame:
        same = F.col(own_id).eqNullSafe(F.col(f"{own_id}_stays")) & (F.col(own_digest) == F.col(f"{own_digest}_stays"))
        return found.join(wanted.drop("n"), same, "left_semi")

    kept = among(stays.where("n = 1"))
    again = stays.where("n > 1")
    if not again.isEmpty():
        kept = kept.unionAll(among(again).dropDuplicates([own_id, own_digest]))
    return kept.drop(own_id, own_digest)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
