"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed, SEED consecutive words, are compared. The longest common runs of
words that no tile covers yet become tiles, longest first, found by running Karp-Rabin with falling search lengths. The
tiles cover a part of the item in whatever order its parts stand in the document, so reordered passages are caught: a
document is contaminated by an item if the tiles cover at least COVERAGE of the item's words.

Words are compared in lower case without ASCII punctuation. Null and empty documents are clean; items with a null text,
and items of fewer than SEED words, can't contaminate; items with a null id do, and give a null item_id. Each row is
judged on its own, whatever its id, so repeated rows and ids get equal results. Documents are read whole. The benchmark
is sent to the executors in blocks whose size is counted first, and each row goes through all blocks with what they
have found so far: the number of blocks changes no result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched, chain, repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.common import annotate, documents, ids_and_texts, settled, slices, unused

#: Words of a seed, which is also the shortest tile, and the least part of an item that tiles must cover.
SEED, COVERAGE = 5, 0.5
#: Bytes of benchmark text in a block that is sent to the executors, and blocks that a Python worker holds at a time.
BLOCK_BYTES, BLOCKS_AT_ONCE = 8_000_000, 4
_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_STEP, _MODULUS = 1_000_003, (1 << 61) - 1


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_GAPS).split()


def _running(tokens: list[int], taken: list[bool], length: int) -> list[tuple[int, int]]:
    """The Karp-Rabin hash of each run of `length` free tokens, and where the run begins."""
    out, value, free, high = [], 0, 0, pow(_STEP, length, _MODULUS)
    for i, token in enumerate(tokens):
        value, free = (value * _STEP + token + 2) % _MODULUS, 0 if taken[i] else free + 1
        if i >= length:
            value = (value - (tokens[i - length] + 2) * high) % _MODULUS
        if free >= length:
            out.append((value, i - length + 1))
    return out


def greedy_tiles(pattern: list[int], text: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in the pattern, place in the text, words), longest first. Tokens below 0 match nothing."""
    in_pattern, in_text = [t < 0 for t in pattern], [t < 0 for t in text]
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(pattern), len(text)) // 2)
    while True:
        places = defaultdict(list)
        for value, at in _running(text, in_text, length):
            places[value].append(at)
        matches, longest = [], 0
        for value, p in _running(pattern, in_pattern, length):
            for t in places.get(value, ()):
                if p and t and pattern[p - 1] == text[t - 1] and not in_pattern[p - 1] and not in_text[t - 1]:
                    continue  # inside a longer match, which is found where it begins
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not in_pattern[p + n] and not in_text[t + n]:
                    n += 1
                if n >= length:
                    matches.append((n, p, t))
                    longest = max(longest, n)
        if longest > 2 * length:
            length = longest  # a much longer match: it has to be marked first
            continue
        queue = [(-n, p, t) for n, p, t in matches]
        heapq.heapify(queue)
        while queue:
            n, p, t = heapq.heappop(queue)
            free = _free_runs(in_pattern[p : p - n], in_text[t : t - n], length)
            if free == [(0, -n)]:
                in_pattern[p : p - n] = in_text[t : t - n] = [True] * -n
                tiles.append((p, t, -n))
            else:  # a tile marked before took a part; what is left waits for its turn
                for start, size in free:
                    heapq.heappush(queue, (-size, p + start, t + start))
        if length <= least:
            return tiles
        length = max(least, length // 2)


def _free_runs(one: list[bool], other: list[bool], least: int) -> list[tuple[int, int]]:
    """Start and length of each run of at least `least` places taken on neither side."""
    runs, start = [], 0
    for i in range(len(one) + 1):
        if i == len(one) or one[i] or other[i]:
            if i - start >= least:
                runs.append((start, i - start))
            start = i + 1
    return runs


class Benchmark:
    """A block of items, with an index of their seeds."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.words: dict[bytes, int] = {}
        self.ids, self.tokens = [], []
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            tokens = [self.words.setdefault(w, len(self.words)) for w in words_of(text.encode())]
            if len(tokens) >= SEED:
                self.ids.append(item)
                self.tokens.append(tokens)
        keys = [(key, i) for i, tokens in enumerate(self.tokens) for key in set(self.seeds(np.array(tokens, np.int64)).tolist())]
        keys.sort()
        self.keys = np.array([k for k, _ in keys], np.uint64)
        self.owners = np.array([i for _, i in keys], np.int64)

    @staticmethod
    def seeds(tokens: np.ndarray) -> np.ndarray:
        value = np.zeros(max(0, len(tokens) - SEED + 1), np.uint64)
        for step in range(SEED):
            value = value * np.uint64(0x9E3779B97F4A7C15) + tokens[step : len(tokens) - SEED + 1 + step].astype(np.uint64) + np.uint64(1)
            value ^= value >> np.uint64(29)
        return value

    def judge(self, texts: list[bytes]) -> list[tuple[float, int | None, int]]:
        """For each text the largest coverage, the item it is of (the smallest of equals, an item without id last; -1 for none), and how many items contaminate."""
        return [(covered, self.ids[item] if item >= 0 else -1, n) for covered, item, n in self._places(texts)]

    def _places(self, texts: list[bytes]) -> list[tuple[float, int, int]]:
        """The same with the item's place among the items."""
        out = [(0.0, -1, 0)] * len(texts)
        if not self.ids:
            return out
        words = [words_of(t) for t in texts]
        n = [len(w) for w in words]
        flat = np.fromiter(map(self.words.get, chain.from_iterable(words), repeat(-1)), np.int64, sum(n))
        known = np.concatenate([[0], np.cumsum(flat >= 0)])
        at = np.flatnonzero(known[SEED:] - known[:-SEED] == SEED) if len(flat) >= SEED else np.empty(0, np.int64)
        if not len(at):
            return out
        values = self.seeds(flat)[at]
        low = np.searchsorted(self.keys, values, "left")
        many = np.searchsorted(self.keys, values, "right") - low
        stops = np.cumsum(n)
        owner = np.searchsorted(stops, at, "right")
        hits = np.flatnonzero((many > 0) & (at + SEED <= stops[owner]))
        for own in np.split(hits, np.flatnonzero(np.diff(owner[hits])) + 1) if len(hits) else []:
            text, reps = int(owner[own[0]]), many[own]
            items = self.owners[np.repeat(low[own] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())]
            order = np.argsort(items, kind="stable")
            items, places = items[order], np.repeat(at[own], reps)[order]
            for group in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1):
                item = int(items[group[0]])
                pattern = self.tokens[item]
                covered = sum(n for _, _, n in greedy_tiles(pattern, regions(flat, places[group], len(pattern)))) / len(pattern)
                best, place, count = out[text]
                if covered > best or covered == best and item < place:
                    best, place = covered, item
                out[text] = (best, place, count + (covered >= COVERAGE))
        return out


def regions(flat: np.ndarray, places: np.ndarray, size: int) -> list[int]:
    """The words that seeds cover, with a word that matches nothing between runs; no tile lies anywhere else.

    An item of `size` words has room for size // SEED tiles. So of equal runs one more than that are enough, as the
    first ones are taken first.
    """
    room = size // SEED + 1
    tokens: list[int] = []
    seen: dict[bytes, int] = defaultdict(int)
    starts = np.append(0, np.flatnonzero(np.diff(places) > SEED) + 1)
    ends = places[np.append(starts[1:], len(places)) - 1] + SEED
    for first, last in zip(places[starts].tolist(), ends.tolist(), strict=True):
        run = shortened(flat[first:last], 2 * room * size)
        key = run.tobytes()
        seen[key] += 1
        if seen[key] <= room:
            tokens.append(-1)
            tokens += run.tolist()
    return tokens


def shortened(run: np.ndarray, most: int) -> np.ndarray:
    """A run of words in which stretches of fewer than SEED words over and over have no more than `most` words.

    What goes is whole periods from their middle. A match inside them is as good a few periods further on, and at both
    ends there is room for all tiles.
    """
    for period in range(1, SEED):
        if len(run) <= most:
            break
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (run[period:] == run[:-period]).view(np.int8), [0]])))
        begins, sizes = edges[::2], edges[1::2] - edges[::2] + period
        stay = np.ones(len(run), bool)
        for i in np.flatnonzero(sizes > most):
            middle = begins[i] + most // 2
            stay[middle : middle + (sizes[i] - most) // period * period] = False
        run = run[stay]
    return run


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The benchmark (item_id, text) in blocks of at most `limit` bytes of text, or of one item that is longer, one by one."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    parts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // limit + 1
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        sizes = rows.groupBy(part.alias("part")).agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("items")).collect()
        if all(r["n"] <= limit or r["items"] == 1 for r in sizes):
            break
        parts *= 2
    for k in sorted(r["part"] for r in sizes):
        yield Benchmark([(r["item_id"], r["text"]) for r in rows.where(part == k).collect()])


def _better(one: tuple, other: tuple) -> tuple:
    """Of two judgements of a text the larger coverage with its item, the smaller item of equals, and the items of both."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    first = min(one, other, key=rank)
    return first[0], first[1], one[2] + other[2]


def _kernel(held: list[Broadcast]):
    def kernel():
        def run(texts: list[bytes]) -> dict:
            found = [(0.0, -1, 0)] * len(texts)
            for a, b in slices(texts):
                for shared in held:
                    found[a:b] = map(_better, found[a:b], shared.value.judge(texts[a:b]))
            hit = [c >= COVERAGE for c, _, _ in found]
            return {"coverage": [c for c, _, _ in found], "item_id": [i for _, i, _ in found], "n_items": [k for _, _, k in found], "contaminated": hit, "clean": [not h for h in hit]}

        return run

    return kernel


def _sent(spark: SparkSession, parts: Iterable[Benchmark]) -> Iterator[list[Broadcast]]:
    """The blocks, each sent to the executors and not kept here, a few at a time; at least one list, if an empty one."""
    sent = batched((spark.sparkContext.broadcast(b) for b in parts), BLOCKS_AT_ONCE)
    yield list(next(sent, ()))
    yield from map(list, sent)


def judge(df: DataFrame, parts: Iterable[Benchmark], text_col: str = "text") -> DataFrame:
    """Adds coverage, item_id, n_items and contaminated to every row.

    More blocks than a worker holds at a time take turns, and the rows with what was found are kept in between.
    """
    fields = "coverage double, item_id long, n_items int, contaminated boolean"
    out: DataFrame | None = None
    for held in _sent(df.sparkSession, parts):
        if out is None:
            out = annotate(df, text_col, fields, _kernel(held))
            continue
        covered, item, n = unused(out, "coverage", "item_id", "n_items")
        out = settled(out).withColumnsRenamed({"coverage": covered, "item_id": item, "n_items": n})
        out = annotate(out, text_col, fields, _kernel(held))
        rank = lambda c, i: F.struct(-F.col(c), F.col(i).isNull(), F.coalesce(F.col(i), F.lit(0)))
        keep = rank(covered, item) <= rank("coverage", "item_id")
        best = {"item_id": F.when(keep, F.col(item)).otherwise(F.col("item_id")), "coverage": F.greatest(covered, "coverage"), "n_items": F.col(n) + F.col("n_items")}
        out = out.withColumns(best | {"contaminated": F.greatest(covered, "coverage") >= COVERAGE}).drop(covered, item, n)
    return out


def drop_contaminated(df: DataFrame, parts: Iterable[Benchmark], text_col: str = "text") -> DataFrame:
    """The rows that no item contaminates, with the columns they had."""
    for turn, held in enumerate(_sent(df.sparkSession, parts)):
        df = annotate(settled(df) if turn else df, text_col, "clean boolean", _kernel(held), keep="clean")
    return df


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: the item that is covered most, how far, and by how many items the document is contaminated."""
    found = judge(ids_and_texts(documents(spark, sf_dir)), blocks(documents(spark, sf_dir, "benchmark")))
    return found.where("contaminated").select("doc_id", "contaminated", "coverage", "item_id", "n_items")
