"""Substring dedup: words in a window of WINDOW words whose sequence starts anywhere else too are removed.

Windows are dealt to reference shards by an anchor, the least hashed GRAM-word gram inside the window, so equal windows
meet in one shard. Neighbouring windows with one anchor travel together as a stretch of words. Of each distinct stretch
one copy goes to its shard with the number of its copies. A shard's suffix automaton counts where each substring ends;
the stretches are streamed through it for matching statistics, the longest suffix at each place that occurs elsewhere,
and the maximal spans of at least WINDOW words are removed. An anchor with one stretch in all makes a shard too where it
is met more than once inside, as in a word over and over.

The shards are dealt out by their anchors, not broadcast: a window can repeat anywhere, so the whole corpus is the
reference, and sending every shard past every document would cost the square of the corpus. An anchor of more than HOT
distinct stretches, such as a common line, makes no shard of its own: its windows are dealt out one by one, each by
anchor and hash, 128 bits together. Of one window a task sends on no more than two; what it meets after that is known
to repeat. So no task gathers a common window either, and nothing is passed over.

Null texts have no words; texts shorter than a window keep all. Repeated rows are copies of each other. Windows are
judged on the input, so all copies of a window go. Rows are told apart by hashes of id and text, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from palimpsest.llm.common import column_bytes, documents, ids_and_texts, pieces, settled, slices

WINDOW, GRAM = 35, 6
#: Distinct stretches beyond which an anchor's windows are dealt out one by one, and windows that a task remembers.
HOT, REMEMBERED = 500, 500_000
#: Windows of a stretch at most; its first, one WINDOW further and its last have to cover all of its words.
LONGEST = 64
_PLACE = 30
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * _A) ^ ((b + _B) * _B)
        h ^= h >> np.uint64(32)
        h *= _A
        h ^= h >> np.uint64(29)
    return h


def _pairs(h: np.ndarray, gap: int) -> np.ndarray:
    return _mix(h[:-gap], h[gap:]) if len(h) > gap else h[:0]


class Stretches:
    """The stretches of some texts: text, first and last window, anchor, a hash of the words from first to last, and
    whether the anchor is met at more than one place inside, without which no window can be there twice."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        n = np.array([len(w) for w in self.words], np.int64)
        flat = np.fromiter((h for w in self.words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(n.sum()))
        stops = np.cumsum(n)
        self.starts = stops - n
        empty = np.empty(0, np.int64)
        self.text, self.first, self.last, self.anchor, self.hash, self.moved = empty, empty, empty, empty, empty, empty.astype(bool)
        if len(flat) < WINDOW:
            return
        two = _pairs(flat, 1)
        four = _pairs(two, 2)
        gram = _pairs(four, GRAM - 4)
        self.window = window = _pairs(_pairs(_pairs(_pairs(four, 4), 8), 16), WINDOW - 32)
        rank = gram >> np.uint64(31) << np.uint64(_PLACE) | np.arange(len(gram), dtype=np.uint64)
        least, span = rank, 1
        while span * 2 <= WINDOW - GRAM + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = WINDOW - GRAM + 1 - span
        least = np.minimum(least[:-rest], least[rest:]) if rest else least
        owner = np.repeat(np.arange(len(texts)), n)
        at = np.flatnonzero(np.arange(len(flat)) + WINDOW <= stops[owner])
        if not len(at):
            return
        met = (least[at] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        anchor = gram[met]
        new = np.append(True, (np.diff(at) != 1) | (anchor[1:] != anchor[:-1]) | (np.diff(owner[at]) != 0))
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= since % LONGEST == 0  # words over and over have one anchor throughout
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        self.text = owner[at[begin]]
        self.first, self.last = at[begin] - self.starts[self.text], at[end] - self.starts[self.text]
        self.anchor = anchor[begin].view(np.int64)
        self.moved = met[begin] != met[end]
        ends = _mix(window[at[begin]], window[at[end]])
        inside = _mix(ends, window[np.minimum(at[begin] + WINDOW, at[end])])  # windows further apart leave words between them
        self.hash = _mix(inside, (at[end] - at[begin]).astype(np.uint64)).view(np.int64)
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def of(self, text: int) -> slice:
        return slice(int(self.bounds[text]), int(self.bounds[text + 1])) if len(self.text) else slice(0, 0)


class SuffixAutomaton:
    """Of the strings of one reference shard; each state knows how often what it stands for occurs, copies included."""

    def __init__(self):
        self.following: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.again: list[int] = []

    def add(self, words: list[bytes], copies: int) -> None:
        following, link, length, count = self.following, self.link, self.length, self.count
        last = 0
        for word in words:
            known = following[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
            else:
                if known is None:
                    state = len(length)
                    following.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    count.append(0)
                    p = last
                    while p >= 0 and word not in following[p]:
                        following[p][word] = state
                        p = link[p]
                    last, before = state, p
                else:
                    state, before = -1, last
                if before >= 0:
                    q = following[before][word]
                    if length[q] == length[before] + 1:
                        link[state] = q
                    else:
                        clone = len(length)
                        following.append(following[q].copy())
                        length.append(length[before] + 1)
                        link.append(link[q])
                        count.append(0)
                        while before >= 0 and following[before].get(word) == q:
                            following[before][word] = clone
                            before = link[before]
                        link[q] = clone
                        if state >= 0:
                            link[state] = clone
                        else:
                            last = clone
            count[last] += copies

    def sum_up(self) -> None:
        """After the last string: counts of suffixes, and the longest suffix of each state that occurs at least twice."""
        order = np.argsort(self.length, kind="stable").tolist()
        for state in reversed(order[1:]):
            self.count[self.link[state]] += self.count[state]
        self.again = [0] * len(self.length)
        for state in order[1:]:
            self.again[state] = self.length[state] if self.count[state] > 1 else self.again[self.link[state]]

    def matching(self, words: list[bytes]) -> Iterator[int]:
        """Streams any string: at each of its words the longest suffix so far that occurs at least twice in the shard."""
        following, link, length, again = self.following, self.link, self.length, self.again
        state = size = 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if (after := following[state].get(word)) is None:
                size = 0
            else:
                state, size = after, size + 1
            yield min(size, again[state])


def repeated_spans(strings: list[list[bytes]], copies: list[int], least: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each string its maximal spans of at least `least` words in which every window of that length occurs again in the strings or their copies."""
    if len(strings) == 1 and copies[0] > 1:  # all of it occurs again
        return [[(0, len(strings[0]))] if len(strings[0]) >= least else []]
    shard = SuffixAutomaton()
    for words, n in zip(strings, copies, strict=True):
        shard.add(words, n)
    shard.sum_up()
    out = []
    for words in strings:
        spans: list[tuple[int, int]] = []
        for end, common in enumerate(shard.matching(words), 1):
            if common >= least:
                start = end - common
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(start, spans[-1][0]), end)
                else:
                    spans.append((start, end))
        out.append(spans)
    return out


def _arrow(run, df: DataFrame, schema: str | pa.Schema) -> DataFrame:
    return df.mapInArrow(run, schema if isinstance(schema, str) else from_arrow_schema(schema))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _anchored(rows: DataFrame) -> DataFrame:
    """The anchor and hash of every stretch, and whether its anchor is met twice inside; row is a number for each row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = column_bytes(batch, "text")
            for a, b in slices(texts):
                found = Stretches(texts[a:b])
                if len(found.text):
                    full = np.flatnonzero(np.diff(found.bounds))
                    bounds = np.append(found.bounds[full], found.bounds[-1])
                    key = batch.slice(a, b - a).take(pa.array(full))
                    yield pa.RecordBatch.from_arrays([key.column(key.schema.names.index("k1")), key.column(key.schema.names.index("k2")), _lists(found.anchor, bounds), _lists(found.hash, bounds), _lists(found.moved, bounds)], names=["k1", "k2", "anchors", "hashes", "moved"])

    # numbered only after it is kept, so a row's number never changes
    kept = settled(_arrow(run, rows.select("text", "k1", "k2"), "k1 long, k2 long, anchors array<long>, hashes array<long>, moved array<boolean>"))
    return kept.withColumn("row", F.monotonically_increasing_id())


def _candidates(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches whose anchor occurs more than once, in others or in themselves, and the distinct ones among them with copies and an owner."""
    every = numbered.select("row", F.posexplode(F.arrays_zip("anchors", "hashes", "moved"))).select("row", F.col("pos").alias("place"), F.col("col.anchors").alias("anchor"), F.col("col.hashes").alias("hash"), F.col("col.moved").alias("moved"))
    # kept on its own, so that both sides of the join are plain shuffles and Spark can split a hot anchor's rows
    again = settled(every.groupBy("anchor").agg(F.count("*").alias("n"), F.max("moved").alias("moved")).where("n > 1 or moved").select("anchor"))
    found = settled(every.drop("moved").join(again, "anchor"))
    distinct = settled(found.groupBy("anchor", "hash").agg(F.count("*").alias("copies"), F.min(F.struct("row", "place")).alias("owner")))
    return found, distinct


#: A stretch's words (part 0), or where a window of it starts and stops (part: the window's hash; known to repeat or not).
PIECE = pa.schema({"anchor": pa.int64(), "part": pa.int64(), "hash": pa.int64(), "copies": pa.int64(), "words": pa.binary(), "start": pa.int32(), "stop": pa.int32(), "known": pa.bool_()})
JUDGED = pa.schema({"anchor": pa.int64(), "hash": pa.int64(), "spans": pa.list_(pa.int32())})


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, schema.types, strict=True)], schema=schema)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of the distinct stretches wanted, from the text of each one's owner."""
    seen: dict[tuple[int, int], int] = {}
    for batch in pieces(batches):
        texts, lists = column_bytes(batch, "text"), batch.column(batch.schema.names.index("wanted")).to_pylist()
        for a, b in slices(texts):
            stretches = Stretches(texts[a:b])
            out: list[tuple] = []
            for i, wants in enumerate(lists[a:b]):
                own = stretches.of(i)
                first, last = stretches.first[own], stretches.last[own]
                for w in wants:
                    begin, end = int(first[w["place"]]), int(last[w["place"]]) + 1
                    if not w["hot"]:
                        out.append((w["anchor"], 0, w["hash"], w["copies"], b" ".join(stretches.words[i][begin : end - 1 + WINDOW]), None, None, None))
                        continue
                    hashes = stretches.window[stretches.starts[i] + begin : stretches.starts[i] + end].view(np.int64).tolist()
                    out += [(w["anchor"], part, w["hash"], w["copies"], None, start, stop, known) for part, start, stop, known in _windows(w, hashes, seen)]
            if out:
                yield _batch(out, PIECE)


def _windows(want: dict, hashes: list[int], seen: dict[tuple[int, int], int]) -> Iterator[tuple[int, int, int, bool]]:
    """part, start, stop and known of a stretch's windows; those this task has met twice join to runs known to repeat."""
    run = None
    for at, window in enumerate(hashes):
        key = want["anchor"], window
        met = seen.get(key, 0)
        if met >= 2:
            run = (run[0] if run else at, at + WINDOW)
            continue
        if len(seen) >= REMEMBERED:
            seen.clear()  # more windows are sent on, no answer changes
        seen[key] = met + 1
        if run:
            yield want["hash"], *run, True
        run = None
        yield window, at, at + WINDOW, False
    if run:
        yield want["hash"], *run, True


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans that repeat in each stretch: whole shards by their automata, windows by whether there is another."""
    out: list[tuple] = []
    shard: dict[int, tuple[int, bytes]] = {}
    at = alone = None

    def answer() -> list[tuple]:
        spans = repeated_spans([w.split() for _, w in shard.values()], [c for c, _ in shard.values()])
        return [(at[0], h, [x for pair in s for x in pair]) for h, s in zip(shard, spans, strict=True) if s]

    for batch in batches:
        for anchor, part, hashed, copies, words, start, stop, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (anchor, part) != at:
                out += answer() if shard else []
                at, shard, alone = (anchor, part), {}, None
                more = False
            if words is not None:
                shard[hashed] = (copies, words)
            elif known or more or copies > 1 or alone:
                out.append((anchor, hashed, [start, stop]))
                if not known:
                    more = True
                    out += [alone] if alone else []
                    alone = None
            else:
                alone = (anchor, hashed, [start, stop])
        if len(out) > 1000:
            yield _batch(out, JUDGED)
            out = []
    out += answer() if shard else []
    yield _batch(out, JUDGED)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left joined by single spaces, for every row."""
    rows = ids_and_texts(df, id_col, text_col).withColumns({"k1": F.xxhash64("doc_id"), "k2": F.xxhash64("text")})
    numbered = _anchored(rows)
    found, distinct = _candidates(numbered)
    crowded = settled(distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor"))
    if crowded.isEmpty():
        distinct = distinct.withColumn("hot", F.lit(False))
    else:
        distinct = distinct.join(crowded.withColumn("hot", F.lit(True)), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    names = numbered.select("row", "k1", "k2")
    owned = distinct.groupBy(F.col("owner.row").alias("row")).agg(F.sort_array(F.collect_list(F.struct(F.col("owner.place").alias("place"), "anchor", "hash", "copies", "hot"))).alias("wanted"))
    wanted = owned.join(names, "row").select("k1", "k2", "wanted")
    dealt = rows.repartition("k1", "k2")  # used twice in one plan, shuffled once
    parts = _arrow(_cut_out, dealt.join(wanted, ["k1", "k2"]), PIECE).repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    judged = _arrow(_judge, parts, JUDGED)
    hits = found.join(judged, ["anchor", "hash"]).select("row", F.struct("place", "spans").alias("hit"))
    told = hits.join(names, "row").groupBy("k1", "k2").agg(F.collect_set("hit").alias("hits"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, lists = column_bytes(batch, "text"), batch.column(batch.schema.names.index("hits")).to_pylist()
            ids = batch.column(batch.schema.names.index("doc_id"))
            for a, b in slices(texts):
                marked = [i for i in range(a, b) if lists[i]]
                stretches = Stretches([texts[i] for i in marked])
                number = {i: k for k, i in enumerate(marked)}
                n_words, n_removed, kept = [], [], []
                for i in range(a, b):
                    words = texts[i].split()
                    stay = np.ones(len(words), bool)
                    if i in number:
                        first = stretches.first[stretches.of(number[i])]
                        for hit in lists[i]:
                            base, spans = first[hit["place"]], hit["spans"]
                            for start, stop in zip(spans[::2], spans[1::2], strict=True):
                                stay[base + start : base + stop] = False
                    n_words.append(len(words))
                    n_removed.append(len(words) - int(stay.sum()))
                    kept.append(b" ".join(words if not n_removed[-1] else [words[j] for j in np.flatnonzero(stay)]))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return _arrow(keep, dealt.join(told, ["k1", "k2"], "left").select("doc_id", "text", "hits"), "doc_id long, n_words long, n_removed long, kept string")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
