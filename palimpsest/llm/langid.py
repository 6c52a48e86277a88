"""Language identification with a bit-sliced Bloom filter of byte n-grams.

Each slot of the filter is a mask with a bit for each language, as many 64-bit words as there are languages for. An
n-gram's mask is the AND of its slots: all languages that contain it, with some false positives. A text's popcount for a
language is the number of its n-grams whose mask has that bit; the expected false positives, from the filled share of
that language's slice, are taken off, and the largest corrected count decides. Its share of all corrected counts is the
score; ties go to the language with more training texts, then to the smaller name. A filter that learned no language
answers `und`, score 0.

n-grams are three bytes of the lower-cased UTF-8 text around a letter byte; everything but letters is one separator.
An n-gram belongs to a language if it is not much rarer there than where it is most frequent, which keeps foreign
passages in a document from teaching the wrong language. Null texts and texts without a letter are `und`, score 0.

What is learned from is distinct texts, so copies and repeated rows teach once. Their n-grams are counted by the
executors; only counts reach the driver, at most 2 to the 24 for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.common import annotate, column_bytes, documents, pieces, schema_of, slices

#: Distinct training texts of each language at most, about, drawn by a hash of the text; more are not needed for n-gram rates.
TRAIN_ROWS = 1000
#: Parts that the drawn texts are dealt to.
DRAWN_PARTS = 8
#: Slots are 2 to the SLOT_BITS; each n-gram sets one slot for each multiplier.
SLOT_BITS, MULTIPLIERS = 18, (2654435761, 2246822519, 3266489917)
#: Least occurrences in training, and least part of the rate in the language where the n-gram is most frequent.
LEAST_COUNT, LEAST_RATE = 3, 0.2
SEPARATOR = 32

_LETTER = np.full(256, SEPARATOR, np.uint32)
for _b in [*range(ord("a"), ord("z") + 1), *range(128, 256)]:
    _LETTER[_b] = _b


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the texts, one after the other, and how many each has."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    flat = _LETTER[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([len(r) for r in raw])
    at = np.flatnonzero(flat[1:-1] != SEPARATOR) + 1
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    return flat[at - 1] << np.uint32(16) | flat[at] << np.uint32(8) | flat[at + 1], counts


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [(grams * np.uint32(m)) >> np.uint32(32 - SLOT_BITS) for m in MULTIPLIERS]


class LanguageFilter:
    """The filter, learned from each language's n-grams with their counts; rows: each language's training texts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], rows: dict[str, int]):
        self.languages = sorted(counts, key=lambda x: (-rows[x], x))
        rates, found = [], []
        for language in self.languages:
            grams, n = counts[language]
            order = np.argsort(grams)
            keep = order[n[order] >= LEAST_COUNT]
            found.append(grams[keep].astype(np.uint32))
            rates.append(n[keep] / max(1, n.sum()))
        every, at = np.unique(np.concatenate([np.empty(0, np.uint32), *found]), return_inverse=True)
        top = np.zeros(len(every))
        np.maximum.at(top, at, np.concatenate([np.empty(0), *rates]))
        self.masks = np.zeros(((len(self.languages) + 63) // 64, 1 << SLOT_BITS), np.uint64)
        self.false_rate = np.zeros(len(self.languages))
        for bit, (grams, rate) in enumerate(zip(found, rates, strict=True)):
            for slot in _slots(grams[rate >= LEAST_RATE * top[np.searchsorted(every, grams)]]):
                np.bitwise_or.at(self.masks[bit // 64], slot, np.uint64(1 << bit % 64))
            self.false_rate[bit] = ((self.masks[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).mean() ** len(MULTIPLIERS)

    @classmethod
    def of_texts(cls, texts: dict[str, list[str]]) -> LanguageFilter:
        counts = {}
        for language, own in texts.items():
            parts = [np.unique(_grams(own[a : a + 100])[0], return_counts=True) for a in range(0, len(own), 100)]  # few texts at a time
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts[language] = (grams, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))
        return cls(counts, {k: len(v) for k, v in texts.items()})

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """The mask of all languages that contain each n-gram, one row for each 64 languages."""
        first, *rest = _slots(grams)
        masks = self.masks[:, first]
        for slot in rest:
            masks &= self.masks[:, slot]
        return masks

    def counts(self, texts: list[str]) -> np.ndarray:
        """For each language and text the n-grams of that language, false positives taken off."""
        grams, n = _grams(texts)
        masks = self.lookup(grams)
        begins = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        pops = np.zeros((len(self.languages), len(texts)))
        full = n > 0
        if full.any():
            for bit in range(len(self.languages)):
                pops[bit, full] = np.add.reduceat((masks[bit // 64] >> np.uint64(bit % 64)).astype(np.uint32) & np.uint32(1), begins[full], dtype=np.int64)
        return np.maximum(0, (pops - n * self.false_rate[:, None]) / (1 - self.false_rate[:, None]))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        fixed = self.counts(texts)
        total = fixed.sum(axis=0)
        best = fixed.argmax(axis=0)
        score = np.divide(fixed.max(axis=0), total, out=np.zeros(len(texts)), where=total > 0)
        known = np.array([any(map(str.isalpha, t)) for t in texts])
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> LanguageFilter:
    """Learns from at most about `rows` distinct texts of each language; null texts and languages are left out."""
    df = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    df = df.withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in df.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageFilter({}, {})
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    drawn = df.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).groupBy("lang", "h").agg(F.any_value("text").alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, langs = column_bytes(batch, "text"), batch.column("lang").to_pylist()
            for a, b in slices(texts):
                for lang in sorted(set(langs[a:b])):
                    found, n = np.unique(_grams([t.decode() for t, x in zip(texts[a:b], langs[a:b], strict=True) if x == lang])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = drawn.select("lang", "text").repartition(DRAWN_PARTS).mapInArrow(grams, schema_of("lang string, gram int, n long"))
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return LanguageFilter({k: (own["gram"].to_numpy(np.uint32), own["n"].to_numpy(np.int64)) for k, own in found.groupby("lang")}, counts)


def identify(df: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 8 bytes for each slot and 64 languages

    def kernel():
        def run(texts: list[bytes]) -> dict:
            names, scores = [], []
            for a, b in slices(texts):
                name, score = shared.value.predict([t.decode() for t in texts[a:b]])
                names += name
                scores += score.tolist()
            return {"lang_pred": names, "score": scores}

        return run

    return annotate(df, text_col, "lang_pred string, score double", kernel)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
