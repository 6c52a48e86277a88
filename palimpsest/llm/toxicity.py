"""A convolutional text classifier for toxicity, trained in numpy.

Words are hashed, whole and by their beginning, and a word's embedding is the sum of both rows. A hash has a row if it
occurs in enough training texts, found by the hash's slot and confirmed by the whole hash; the others share the row of
rare words. An embedding starts from the log odds of its hash among toxic texts. Filters of several widths slide over
the words, the largest response of each filter over the whole text is kept, and a logistic layer reads those. Thresholds
are calibrated for each language: the threshold on its held-back training rows is moved to 0.7, so one cut serves all.
Which language a text is in is told from its n-grams alone, by a filter learned from the same training rows.

Labels, ids and given languages never enter a score. Without labels of both classes nothing can be learned, and every
score is 0. Null and empty texts score as a text of no words does. Texts are read whole. Equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.common import annotate, documents, slices
from palimpsest.llm.langid import LanguageFilter

#: Labelled ids to train on at most, about, drawn by a hash of the id; texts of more bytes are not trained on, but scored as any.
TRAIN_ROWS, TRAIN_TEXT_BYTES = 6000, 100_000
#: Parts that the drawn rows are gathered in; the driver fetches one at a time.
DRAWN_PARTS = 8
WIDTHS, FILTERS, DIMENSION = (1, 2, 3), 8, 8
#: 2 to the SLOT_BITS rows; the least number of training texts a hash of its own row occurs in.
SLOT_BITS, LEAST_TEXTS = 16, 3
EPOCHS, BATCH, RATE = 4, 64, 0.03
CUT = 0.7
_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
RARE, GAP = 0, 1
#: Bytes of a word's beginning.
BEGINNING = 4


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of hashes, of the texts' words and of the words' beginnings, and each text's number of words."""
    words = [t.lower().translate(_GAPS).split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = list(chain.from_iterable(words))
    out = np.empty((2, len(flat)), np.uint32)
    out[0] = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
    out[1] = np.fromiter(map(zlib.crc32, [w[:BEGINNING] for w in flat], repeat(1)), np.uint32, len(flat))
    return out, n


@dataclass
class Network:
    tags: np.ndarray  # the hash that owns each row; rows RARE and GAP have none
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: positions x dimension x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    cut: float = 0.0  # the threshold of texts in no language that has one
    cuts: dict[str, float] = field(default_factory=dict)
    languages: LanguageFilter | None = None

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint32((1 << SLOT_BITS) - 1)).astype(np.int64)
        return np.where(self.tags[slot] == hashes, slot + 2, RARE)

    def laid_out(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with gaps after each text as long as the widest filter reaches, and where each text begins."""
        wide = max(WIDTHS)
        begins = np.concatenate([[0], np.cumsum(n + wide)[:-1]]).astype(np.int64)
        out = np.full((2, int((n + wide).sum())), GAP, np.int64)
        out[:, np.arange(rows.shape[1]) + np.repeat(np.arange(len(n)) * wide, n)] = rows
        return out, begins

    def projected(self) -> list[list[np.ndarray]]:
        return [[self.embedding @ w for w in width] for width in self.filters]

    def pooled(self, rows: np.ndarray, begins: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of each filter in each text, and the responses.

        A text's places are those of its words and one gap; from a later gap a filter would reach into the next text.
        """
        found, responses = [], []
        stops = np.append(begins[1:], rows.shape[1]) - max(WIDTHS) + 1
        bounds = np.stack([begins, stops], axis=1).ravel()[:-1]  # the last text ends where the responses do
        for width in tables:
            reach = rows.shape[1] - max(WIDTHS) + 1
            response = np.zeros((reach, FILTERS), np.float32)
            for step, table in enumerate(width):
                for kind in rows:
                    response += table[kind[step : step + reach]]
            responses.append(response)
            found.append(np.maximum.reduceat(response, bounds, axis=0)[::2])
        return np.concatenate(found, axis=1), responses

    def logits(self, texts: list[bytes]) -> np.ndarray:
        hashes, n = hashed(texts)
        tables = self.__dict__.setdefault("_tables", self.projected())
        rows, begins = self.laid_out(self.rows(hashes), n)
        top, _ = self.pooled(rows, begins, tables)
        hidden = np.maximum(top + self.bias, 0).astype(np.float64)
        return (hidden * self.weights).sum(axis=1) + self.offset  # summed row by row, so a score never depends on the batch

    def told(self, texts: list[bytes]) -> list[str]:
        """The language each text seems to be in."""
        if self.languages is None:
            return [""] * len(texts)
        return [x for a, b in slices(texts, 1_000_000) for x in self.languages.predict([t.decode() for t in texts[a:b]])[0]]

    def score(self, texts: list[bytes]) -> np.ndarray:
        cuts = np.array([self.cuts.get(x, self.cut) for x in self.told(texts)])
        moved = self.logits(texts) - cuts + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(moved, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, languages: list[str | None] | None = None, seed: int = 7) -> Network:
    """Trains on four fifths of the rows and calibrates on the others, for each language if those of the rows are given."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    hashes, n = hashed(texts)
    starts = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    learn = np.zeros(len(n), bool)
    learn[used] = True
    learn = learn[owner]
    pairs = np.unique(np.concatenate([h[learn].astype(np.int64) << 32 | owner[learn] for h in hashes]))
    common, at, texts_with = np.unique(pairs >> 32, return_inverse=True, return_counts=True)
    toxic_with = np.bincount(at, labels[pairs & 0xFFFFFFFF] == 1, minlength=len(common))
    keep = texts_with >= LEAST_TEXTS
    common, texts_with, toxic_with = common[keep], texts_with[keep], toxic_with[keep]
    toxic, other = labels[used].sum(), len(used) - labels[used].sum()
    odds = np.log((toxic_with + 1) / (toxic + 2)) - np.log((texts_with - toxic_with + 1) / (other + 2))
    tags = np.zeros(1 << SLOT_BITS, np.uint32)
    rarest_first = np.argsort(texts_with, kind="stable")
    slot = (common & ((1 << SLOT_BITS) - 1))[rarest_first]
    tags[slot] = common[rarest_first]  # of two in a slot the more frequent stays
    net = Network(
        tags, (rng.normal(size=((1 << SLOT_BITS) + 2, DIMENSION)) * 0.05).astype(np.float32),
        [(rng.normal(size=(w, DIMENSION, FILTERS)) * (0.5 / w)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), (rng.normal(size=FILTERS * len(WIDTHS)) * 0.2).astype(np.float32),
    )
    net.embedding[:, 0] = 0
    net.embedding[slot + 2, 0] = odds[rarest_first]
    net.embedding[GAP] = 0
    rows = net.rows(hashes)
    share = max(1e-3, labels[used].mean()) if len(used) else 0.5
    squares = {k: np.full_like(v, 1e-6) for k, v in (("embedding", net.embedding), ("bias", net.bias), ("weights", net.weights))}
    squares |= {i: np.full_like(v, 1e-6) for i, v in enumerate(net.filters)}
    for epoch in range(EPOCHS):
        rate = RATE * 4 * (1 - epoch / EPOCHS)
        rng.shuffle(used)
        for a in range(0, len(used), BATCH):
            part = used[a : a + BATCH]
            flat = np.concatenate([rows[:, starts[i] : starts[i + 1]] for i in part], axis=1)
            laid, begins = net.laid_out(flat, n[part])
            _step(net, laid, begins, labels[part], share, rate, squares)
    by_language: dict[str, list[str]] = {}
    for text, language in zip(texts, languages or [], strict=False):
        if language is not None:
            by_language.setdefault(language, []).append(text.decode())
    net.languages = LanguageFilter.of_texts(by_language)
    _calibrate(net, [texts[i] for i in held], labels[held])
    return net


def _step(net: Network, rows: np.ndarray, begins: np.ndarray, labels: np.ndarray, share: float, rate: float, squares: dict) -> None:
    ids, local = np.unique(rows, return_inverse=True)
    top, responses = net.pooled(local.reshape(rows.shape), begins, [[net.embedding[ids] @ w for w in width] for width in net.filters])
    lengths = np.diff(np.append(begins, rows.shape[1]))
    owner = np.repeat(np.arange(len(begins)), lengths)
    inside = np.arange(len(owner)) < np.repeat(begins + lengths - max(WIDTHS) + 1, lengths)
    owner, inside = owner[: responses[0].shape[0]], inside[: responses[0].shape[0]]
    z = top + net.bias
    hidden = np.maximum(z, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.weights + net.offset, -30, 30)))
    error = ((p - labels) * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)).astype(np.float32)
    back = (error[:, None] * net.weights) * (z > 0)

    def move(key, target, gradient, at=slice(None)):
        squares[key][at] += gradient**2
        target[at] -= rate * gradient / np.sqrt(squares[key][at])

    touched, pushed = [], []
    for i, response in enumerate(responses):
        width = net.filters[i]
        gradient = np.zeros_like(width)
        for f in range(FILTERS):
            column = i * FILTERS + f
            hit = np.flatnonzero((response[:, f] == top[owner, column]) & inside)
            _, first = np.unique(owner[hit], return_index=True)
            place, g = hit[first], back[:, column]
            for step in range(width.shape[0]):
                for kind in rows:
                    at = kind[place + step]
                    gradient[step, :, f] += net.embedding[at].T @ g
                    touched.append(at)
                    pushed.append(g[:, None] * width[step, :, f])
        move(i, width, gradient)
    touched = np.concatenate(touched)
    ids, at = np.unique(touched, return_inverse=True)
    total = np.zeros((len(ids), DIMENSION), np.float32)
    np.add.at(total, at, np.concatenate(pushed))
    total[ids == GAP] = 0
    move("embedding", net.embedding, total, ids)
    move("bias", net.bias, back.sum(axis=0))
    move("weights", net.weights, hidden.T @ error)
    net.offset -= rate * float(error.sum())


def _calibrate(net: Network, texts: list[bytes], labels: np.ndarray) -> None:
    """For each language the logit between the classes with the fewest errors on held-back rows, shrunk to that of all rows."""

    def cut(logit: np.ndarray, label: np.ndarray) -> float:
        order = np.argsort(logit)
        x, y = logit[order], label[order]
        wrong = np.concatenate([[0], np.cumsum(y == 1)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
        places = np.flatnonzero(wrong == wrong.min())
        at = int(places[len(places) // 2])
        low, high = x[at - 1] if at else x[0] - 2, x[at] if at < len(x) else x[-1] + 2
        return float((low + high) / 2)

    if not len(texts) or len(set(labels.tolist())) < 2:
        return
    logit = np.concatenate([net.logits(texts[a:b]) for a, b in slices(texts)])
    told = np.array(net.told(texts))
    net.cut = cut(logit, labels)
    for language in set(told.tolist()):
        own = told == language
        n = int(min((labels[own] == 1).sum(), (labels[own] == 0).sum()))
        if n:
            net.cuts[language] = (n * cut(logit[own], labels[own]) + 20 * net.cut) / (n + 20)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | None:
    """Fits on at most about `rows` labelled ids, drawn by a hash of the id; half of them, if there are so many, are toxic.

    docs: doc_id, text and, for thresholds by language, lang. labels: doc_id, toxic; null ids and labels are left out,
    and a row labelled both ways counts as toxic. The drawn labels are bounded by `rows`, so they are broadcast and no
    text is shuffled but the drawn, each once. None without both classes.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, rows / 2 / n)))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("toxic")] * 1_000_000)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.where(F.octet_length("text") <= TRAIN_TEXT_BYTES).select("doc_id", "text", lang.alias("lang"))
    drawn = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", F.xxhash64("text", "lang")).agg(*[F.any_value(c).alias(c) for c in ("text", "lang", "toxic")])
    found = []
    for row in drawn.select("text", "lang", "toxic").repartition(DRAWN_PARTS).toLocalIterator():  # few jobs, however many parts the table has
        found.append((row["text"].encode(), row["toxic"], row["lang"]))
    found.sort(key=lambda x: (zlib.crc32(x[0]), x[0], x[1], x[2] or ""))
    if len({y for _, y, _ in found}) < 2:
        return None
    texts, ys, languages = zip(*found, strict=True)
    return fit(list(texts), np.array(ys), list(languages))


def score(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """Adds score and predicted."""
    return annotate(df, text_col, "score double, predicted int", _kernel(df.sparkSession, net))


def drop_toxic(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with the columns they had."""
    return annotate(df, text_col, "clean boolean", _kernel(df.sparkSession, net), keep="clean")


def _kernel(spark: SparkSession, net: Network | None):
    shared = spark.sparkContext.broadcast(net)  # 2 to the SLOT_BITS rows of DIMENSION numbers

    def kernel():
        def run(texts: list[bytes]) -> dict:
            net = shared.value
            found = np.zeros(len(texts)) if net is None else np.concatenate([net.score(texts[a:b]) for a, b in slices(texts, 1_000_000)])
            return {"score": found.astype(float), "predicted": (found >= CUT).astype(np.int32), "clean": found < CUT}

        return run

    return kernel


def learned(spark: SparkSession, sf_dir: str) -> Network | None:
    """A network from the labels whose rows are not held out."""
    kept = "crc32(cast(doc_id as string)) % 3 != 1"
    return train(documents(spark, sf_dir).select("doc_id", "text", "lang").where(kept), documents(spark, sf_dir, "labels").select("doc_id", "toxic").where(kept))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(True)).alias("held_out"))
    return score(docs, learned(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
