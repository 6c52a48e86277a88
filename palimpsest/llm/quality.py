"""Quality rules on repetition inside a text, found with a suffix array over its words.

The longest-common-prefix intervals of the suffix array are the maximal repeated substrings: a suffix repeats as far as
its longest common prefix with a neighbour in the array reaches. The spans of all repeats of at least REPEAT_WORDS words,
first occurrences included, are united. A text fails if they cover too large a part of it or one of them is too long.

Null texts have no words and fail as too short, as empty texts do. Long texts are examined whole. Equal rows give equal
results; nothing is compared across texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import annotate, documents, ids_and_texts, slices

#: The shortest repeat that counts, in words, and what fails a text: few words, per cent covered, words of one repeat.
REPEAT_WORDS, LEAST_WORDS, MOST_COVERED, MOST_IN_ONE = 8, 20, 30, 100
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"


def suffix_ranks(words: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4... words, each text on its own, until no two are equal.

    A rank is the place in the suffix array where the group of suffixes with that beginning starts.
    """
    n = len(words)
    order = np.argsort(owner.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, kind="stable")
    ranks = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = (np.diff(words[order]) != 0) | (np.diff(owner[order]) != 0)
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks[order] = starts
    levels = [ranks.astype(np.int32)]
    single = new & np.append(new[1:], True)
    active, step = np.sort(order[~single]), 1
    while len(active):
        after = active + step
        key = np.where(after < ends[active], ranks[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((key, ranks[active]))
        at, group, key = active[order], ranks[active[order]], key[order]
        first = np.ones(len(at), bool)
        first[1:] = np.diff(group) != 0
        new = first.copy()
        new[1:] |= np.diff(key) != 0
        place = np.arange(len(at))
        ranks[at] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        levels.append(ranks.astype(np.int32))
        single = new & np.append(new[1:], True)
        active, step = np.sort(at[~single]), step * 2
    return levels


def repeats(levels: list[np.ndarray], least: int = REPEAT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Where a repeat of at least `least` words (a power of 2) begins, and the words of the longest from there."""
    level, none = least.bit_length() - 1, np.empty(0, np.int64)
    if len(levels) <= level:
        return none, none
    at = np.argsort(levels[-1], kind="stable")
    same = levels[level][at[1:]] == levels[level][at[:-1]]
    left, right = at[:-1][same], at[1:][same]
    a, b, common = left.copy(), right.copy(), np.zeros(len(left), np.int64)
    n = len(at)
    for j in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = inside & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        grow = equal.astype(np.int64) << j
        a, b, common = a + grow, b + grow, common + grow
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    begins = np.flatnonzero(longest)
    return begins, longest[begins]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text; n_repeat_words counts the words that repeats cover, longest_repeat those of the longest."""
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    table: dict[bytes, int] = {}
    flat = np.fromiter((table.setdefault(w, len(table)) for w in chain.from_iterable(words)), np.int64, int(n_words.sum()))
    owner = np.repeat(np.arange(len(texts)), n_words)
    stops = np.cumsum(n_words)
    covered, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if len(flat):
        begins, length = repeats(suffix_ranks(flat, owner, stops[owner]))
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + length, -1)
        covered = np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(texts))
        np.maximum.at(longest, owner[begins], length)
    lines = [[x for x in t.split(b"\n") if x.split()] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t.translate(None, SPACES).decode()) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": covered,
        "longest_repeat": longest,
    }


def judge(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_COVERED * found["n_words"])
    return found | {"base_failed": failed, "kept": ~failed & (found["longest_repeat"] <= MOST_IN_ONE)}


def apply_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures, base_failed and kept."""

    def kernel():
        def run(texts: list[bytes]) -> dict:
            parts = [measure(texts[a:b]) for a, b in slices(texts)]
            return judge({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})

        return run

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"
    return annotate(df, text_col, fields, kernel)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(ids_and_texts(documents(spark, sf_dir))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
