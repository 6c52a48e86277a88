"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols, and decoding by vocabulary strings.

Null and empty texts have no ids and decode to the empty text. Ids are exact for every text: a long pre-token costs
n log n, and results for repeated pre-tokens are kept in a bounded table, which is emptied when it is full and never
changes a result. Repeated rows and ties need no care: a row depends on its own text alone.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.llm.common import annotate, documents, ids_and_texts, schema_of
from palimpsest.llm.pretokens import find_pretokens

#: Entries of the table of repeated pre-tokens in a Python worker, at about 200 bytes each.
TABLE_SIZE = 800_000
_SHIFT, _LOW = 32, (1 << 32) - 1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's strings, by its published rule."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocab[x] for x in letters]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << _SHIFT | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        to_byte = {x: b for b, x in enumerate(letters)}
        self.strings: dict[int, bytes] = {i: bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode() for s, i in (vocab | self.special).items()}
        self.table: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbols = [self.byte_ids[b] for b in data]
        n, ranks, merged = len(symbols), self.ranks, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << _SHIFT | i for i in range(n - 1) if (r := ranks.get(symbols[i] << _SHIFT | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> _SHIFT, entry & _LOW
            if symbols[i] < 0 or (j := after[i]) == n or ranks.get(symbols[i] << _SHIFT | symbols[j]) != rank:
                continue  # stale: one of its symbols has been merged since
            symbols[i], symbols[j] = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] << _SHIFT | symbols[k])) is not None:
                    heapq.heappush(queue, r << _SHIFT | i)
            if (k := before[i]) >= 0 and (r := ranks.get(symbols[k] << _SHIFT | symbols[i])) is not None:
                heapq.heappush(queue, r << _SHIFT | k)
        return [s for s in symbols if s >= 0]

    def _ordinary(self, text: str) -> bytes:
        """The ids, four bytes each, of a text without special tokens."""
        table, tokens = self.table, find_pretokens(text)
        try:
            return b"".join(map(table.__getitem__, tokens))
        except KeyError:
            pass
        if len(table) >= TABLE_SIZE:
            table.clear()
        for token in set(tokens).difference(table):
            table[token] = np.array(self.merge(token.encode()), np.int32).tobytes()
        return b"".join(map(table.__getitem__, tokens))

    def encode(self, text: str) -> np.ndarray:
        spans = [text]
        for content in self.special:
            spans = list(chain.from_iterable([s] if s in self.special else _with_separators(s, content) for s in spans))
        if len(spans) == 1 and text not in self.special:
            return np.frombuffer(self._ordinary(text), np.int32)
        return np.frombuffer(b"".join(np.int32(self.special[s]).tobytes() if s in self.special else self._ordinary(s) for s in spans if s), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def _with_separators(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    return [x for part in parts[:-1] for x in (part, separator)] + parts[-1:]


def vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file, read where the query is planned and sent to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_bytes()


_CODECS: dict[int, Codec] = {}


def codec_of(spec: bytes) -> Codec:
    """One codec in each Python worker, so that its tables serve all the worker's tasks."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *lists])))


def encode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens and ids, the token ids of each whole text."""
    spec = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # one vocabulary file

    def kernel():
        codec = codec_of(spec.value)

        def run(texts: list[bytes]) -> dict:
            ids = [codec.encode(t.decode()) for t in texts]
            return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": _id_lists(ids)}

        return run

    return annotate(df, text_col, "n_tokens long, ids array<int>", kernel)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text that each list of ids stands for; null ids give the empty text, unknown ids an error."""
    spec = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    left = [f for f in df.schema.fields if f.name != out_col]

    def run(batches):
        codec = codec_of(spec.value)
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col)).to_pylist()
            texts = pa.array([codec.decode(x or ()) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(f.name)) for f in left), texts], names=[*(f.name for f in left), out_col])

    schema = schema_of(f"`{out_col}` string")
    return df.mapInArrow(run, type(schema)(left + schema.fields))


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """encode() and decode() in one pass: adds n_tokens, ids and decoded, which is made from the ids alone."""
    spec = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def kernel():
        codec = codec_of(spec.value)

        def run(texts: list[bytes]) -> dict:
            ids = [codec.encode(t.decode()) for t in texts]
            return {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": _id_lists(ids), "decoded": pa.array(map(codec.decode, ids), pa.string())}

        return run

    return annotate(df, text_col, "n_tokens long, ids array<int>, decoded string", kernel)


def digests(df: DataFrame) -> DataFrame:
    """The contract's digest columns, from the operator's ids and decoded texts."""
    joined: Column = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return df.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(ids_and_texts(documents(spark, sf_dir))))
