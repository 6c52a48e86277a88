"""Secret scans: a pattern finds candidates, and a random forest takes false positives out.

A candidate is a run of at least LEAST_LENGTH key characters, or a value of any length and any characters that is quoted
or assigned beside a secret word (password = "...", pwd=..., the token for x is ..., --secret ..., <key>...</key>). The
forest reads its length, the transitions between character classes, how much of it a dictionary covers, whether it is a
path, and the words beside it. It is trained in numpy on labelled findings, rows of (text before, candidate, text after,
secret); where there are none, findings() makes some by rule, from a seed.

Null texts have no candidates, empty texts neither: redact_secrets() leaves nulls null, scan_secrets() and the query give them
the empty text. Texts are scanned whole; candidates can lie in one
another, what is found a secret is united to spans that don't overlap. Equal rows give equal results. A text without
secrets is left as it is.
"""

from __future__ import annotations

import base64
import math
import random
import re
import zlib
from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm.common import annotate, documents, ids_and_texts, unused

LEAST_LENGTH, MARK = 16, b"[SECRET]"
TREES, DEPTH, LEAF, CUT = 25, 10, 3, 0.5
#: Bytes beside a candidate that its neighbouring words are taken from.
BESIDE = 40
#: Letters of a dictionary word. The words are those of a public vocabulary that follow a space.
WORD_LETTERS = range(4, 15)
#: Words that announce a secret, words that announce a harmless identifier, and words of placeholders.
SECRET_WORDS = {"token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "signature", "passphrase", "client_secret", "api_key", "access_key", "secret_key"}
PLAIN_WORDS = {"commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "id", "hash", "revision", "rev", "version", "etag", "build", "file", "path", "url", "image", "isbn", "order", "card", "phone", "mail", "page", "track", "session", "blob", "merge", "tree"}
PLACEHOLDERS = ("example", "your", "xxxx", "changeme", "dummy", "placeholder", "redacted", "12345678", "abcdef", "test")

_KEY = rb"A-Za-z0-9+/=_.\-"
find_candidates = re.compile(rb"(?<![%s])[%s]{%d,}" % (_KEY, _KEY, LEAST_LENGTH)).finditer
_NAMES = sorted({part for word in SECRET_WORDS for part in word.split("_")}, key=len, reverse=True)
#: A secret word in lower case, with a capital, or in capitals; what may stand on its left is looked at after.
find_names = re.compile("|".join(["(?:%s)s?(?![a-z])" % "|".join(_NAMES), "(?:%s)s?(?![a-z])" % "|".join(w.title() for w in _NAMES), "(?:%s)S?(?![A-Z])" % "|".join(w.upper() for w in _NAMES)]).encode()).finditer
#: Secret words that need no boundary on their left, as in dbpassword.
_PLAINLY = (b"password", b"passwd", b"passphrase", b"secret", b"token", b"credential", b"apikey")
#: From a secret word to a value: the rest of a name and its quote, up to two words, and then an assignment, or only spaces before a quote.
_ASSIGNS = rb"""[A-Za-z0-9_.\-]{0,40}["'`\])]{0,2}(?:[ \t]+[A-Za-z]+){0,2}?(?:\s{0,8}(?:=>|->|:=|==?|:)\s{0,8}|[ \t]+(?:is|was)[ \t]+|>)"""
_SPACES = rb"""[A-Za-z0-9_.\-]{0,40}["'`\])]{0,2}(?:[ \t]+[A-Za-z]+){0,2}?[ \t]+"""
_QUOTED = rb"""(?:"((?:[^"\\\n]|\\.)++)"|'((?:[^'\\\n]|\\.)++)'|`([^`\n]++)`)"""
#: A bare value ends before a space, a closing tag or quote, and before what separates it from the next assignment.
_BARE = rb"""["'`]{0,3}((?:(?!</|["'`](?!\w)|[;,&]\s{0,8}["']?[\w.\-]{1,40}["']?[ \t]{0,8}[=:])\S)+)"""
match_values = [re.compile(lead + value).match for lead, value in ((_ASSIGNS, _QUOTED), (_SPACES, _QUOTED), (_ASSIGNS, _BARE))]
_after_flag = re.compile(rb"[A-Za-z0-9_\-]{0,40}[ \t]+" + _BARE).match
_leads = re.compile(rb"(?:%s|%s)[\"'`]{0,3}" % (_ASSIGNS, _SPACES)).fullmatch
_CLOSERS = {b")": b"(", b"]": b"[", b"}": b"{"}
_KINDS = bytes(ord("d" if 48 <= b <= 57 else "u" if 65 <= b <= 90 else "l" if 97 <= b <= 122 or b >= 128 else "s") for b in range(256))
FEATURES = ("length", "digits", "capitals", "transitions", "distinct", "entropy", "hexadecimal", "covered", "segments", "dots", "dashes", "secret_before", "plain_before", "assigned", "quoted", "placeholder", "secret_after", "vowels", "announced", "symbols", "spaces", "code", "prose")
_code = re.compile(r"^\$?[{(\[].*[})\]]$|^\$\w+$|^<.*>$|\(.*\)$|\w[\[(]|^\*+$|^(?:true|false|none|null|nil|undefined|string|str|int|bytes|bool)$").search
_prose = re.compile(r"\b(?:the|an?|is|are|was|to|and|of|in|on|for|you|your|it|that|this|with|be|not|he|she|they|we|i)\b").findall


def _named(text: bytes, start: int, end: int) -> bool:
    """Whether the secret word found is one by what stands on its left."""
    before = text[start - 1 : start]
    return not before.isalpha() or (before.islower() and text[start : start + 1].isupper()) or text[start:end].lower().startswith(_PLAINLY)


def _announced(before: bytes) -> bool:
    return any(_named(before, *m.span()) and _leads(before, m.end()) for m in find_names(before))


@cache
def dictionary(path: str | None = None) -> frozenset[str]:
    """The words of lower-case letters in a vocabulary file (by default a public one), about 18,000."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = (base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines())
    return frozenset(t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]+", t) and len(t) - 1 in WORD_LETTERS)


def covered(low: str, words: frozenset[str]) -> int:
    """Letters of a lower-case text that words of the dictionary cover, the longest first at each place."""
    at = total = 0
    while at <= len(low) - WORD_LETTERS[0]:
        n = next((k for k in reversed(WORD_LETTERS) if low[at : at + k] in words and at + k <= len(low)), 0)
        total, at = total + n, at + max(1, n)
    return total


def features(before: bytes, found: bytes, after: bytes, words: frozenset[str]) -> list[float]:
    word = found.decode("utf-8", "replace")
    low, n = word.lower(), len(word)
    kinds = found.translate(_KINDS)
    steps = int(np.count_nonzero(np.diff(np.frombuffer(kinds, np.uint8))))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(word).values())
    lead = before.decode("utf-8", "ignore").lower()
    near = re.findall(r"[a-z][a-z0-9_]*", lead)[-3:]
    follow = re.findall(r"[a-z][a-z0-9_]*", after.decode("utf-8", "ignore").lower())[:2]
    letters = sum(c.isalpha() for c in word)
    return [
        n, kinds.count(b"d") / n, kinds.count(b"u") / n, steps / n, len(set(word)) / n, entropy,
        float(not found.translate(None, b"0123456789abcdefABCDEF")), covered(low, words) / n,
        word.count("/") + (lead[-1:] == "/") + lead[-3:].count("://"), word.count("."), word.count("-") + word.count("_"),
        float(bool(SECRET_WORDS.intersection(near))), float(bool(PLAIN_WORDS.intersection(near))),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", lead))), float(lead[-1:] in ("'", '"', "`") and lead != ""), float(any(p in low for p in PLACEHOLDERS)),
        float(bool(SECRET_WORDS.intersection(follow))), sum(c in "aeiou" for c in low) / max(1, letters),
        float(_announced(before)), kinds.count(b"s") / n, word.count(" "), float(bool(_code(low))), len(_prose(low)),
    ]


def announced_values(text: bytes) -> list[tuple[int, int]]:
    """Where values that are quoted or assigned beside a secret word begin and end; each can lie in one before it."""
    out = []
    for name in find_names(text):
        if not _named(text, *name.span()):
            continue
        m = next(filter(None, (match(text, name.end()) for match in match_values)), None)
        if m is None and (name[0].lower() == b"bearer" or re.search(rb"(?:^|\s)--?[\w\-]{0,40}$", text[max(0, name.start() - 48) : name.start()])):
            m = _after_flag(text, name.end())
        if m is None:
            continue
        start, end = m.span(m.lastindex)
        if m.re.groups == 1:  # a bare value: the sentence's own end
            while end > start and ((last := text[end - 1 : end]) in b".,;:\"'`" or (last in _CLOSERS and _CLOSERS[last] not in text[start:end])):
                end -= 1
        if end > start:
            out.append((start, end))
    return out


def scan(text: bytes) -> list[tuple[int, int]]:
    """Where candidates begin and end."""
    out = set(announced_values(text))
    begun = {start for start, _ in out}
    for m in find_candidates(text):
        start, end = m.span()
        name = re.match(rb"[A-Za-z_]{2,24}=(?=[^=])", m[0])  # NAME=value without spaces: the value is the candidate
        if name and start + name.end() in begun:
            continue
        start += name.end() if name and end - start - name.end() >= LEAST_LENGTH else 0
        while end > start and text[end - 1] in b".-":
            end -= 1  # the sentence's own end
        if end - start >= LEAST_LENGTH:
            out.add((start, end))
    return sorted(out)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _half(words: frozenset[str], odd: int) -> list[str]:
    return sorted(w for w in words if zlib.crc32(w.encode()) % 2 == odd)


def announced_findings(n: int = 3000, seed: int = 12, odd: int = 0) -> list[tuple[bytes, bytes, bytes, int]]:
    """Labelled findings made by rule: passwords, passphrases and keys of one case beside secret words, and what else stands there or is long.

    Their words are one half of the dictionary, so findings of the other half (odd) hold words never trained on.
    """
    rng, words_of = random.Random(seed), _half(dictionary(), odd)
    lower, upper, digits, symbols = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!@#$%^&*?-_+.~"
    some = lambda k: [rng.choice(words_of) for _ in range(k)]
    made = lambda least, most: "".join(rng.choice("bcdfghlmnprstvw") * (j % 2 == 0) or rng.choice("aeiou") for j in range(rng.randint(least, most)))
    filler = lambda: " ".join("".join(rng.choice("aeinorstlhdu") for _ in range(rng.randint(2, 9))) for _ in range(3))
    clustered = lambda: "".join(rng.choice("ber er sch ein tz ung keit ver st ach mit gen lich fahr ent eau que tion".split()) for _ in range(7)).ljust(16, "e")
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    name = lambda: rng.choice(["", "", "", "db_", "DB_", "user_", "--"]) + rng.choice([str.lower, str.lower, str.title, str.upper])(rng.choice(sorted(SECRET_WORDS)))
    joins, quotes = [" = ", "=", ": ", ":", " is ", " => "], ["", '"', "'"]
    out = []
    for i in range(n):
        kind = rng.random()
        quote = rng.choice(quotes)
        if i % 2:
            if kind < 0.3:
                value = rng.choice([str.lower, str.title])(rng.choice([rng.choice(words_of), made(5, 9)])) + draw(digits, rng.randint(1, 4)) + (draw(lower + upper + symbols, rng.randint(2, 8)) if rng.random() < 0.6 else some(1)[0].title() + draw(symbols, rng.randint(0, 1)))
            elif kind < 0.45:
                word = rng.choice([rng.choice(words_of), made(6, 9)]).title()
                value = word.translate(str.maketrans("aeios", "43105")) + draw(digits, rng.randint(1, 3)) + draw(symbols, rng.randint(0, 2)) + rng.choice(["", rng.choice(words_of)]) + draw(symbols + digits, 1)
            elif kind < 0.65:
                value = draw(lower + upper + digits + symbols, rng.randint(7, 24))
            elif kind < 0.75:
                value = draw(lower + upper + digits, rng.randint(8, 20))
            elif kind < 0.83:
                value = draw(rng.choice([lower, upper]), rng.randint(12, 28))
            elif kind < 0.9:
                value = rng.choice("-_.") .join([*some(rng.randint(2, 3)), draw(digits + symbols, rng.randint(3, 5))])
            else:
                value, quote = " ".join(rng.choice([some(1)[0], made(4, 8)]) for _ in range(rng.randint(4, 6))), rng.choice(['"', "'"])
            before = f"{filler()} {name()}{rng.choice(joins)}{quote}"
        else:
            before = f"{filler()} {name()}{rng.choice(joins)}{quote}"
            if kind < 0.15:
                value = rng.choice([some(1)[0], made(2, 12)])
            elif kind < 0.25:
                value = rng.choice([str.title, str.upper])(rng.choice([some(1)[0], made(2, 8)]))
            elif kind < 0.35:
                value = rng.choice(["none", "None", "null", "true", "false", "True", "False", "string", "str", "bytes", "undefined", "nil", "****", "********", "...", "()", "[]", "{}", "-", "it", "not", "a", "the", "required", "optional"])
            elif kind < 0.42:
                value = draw(digits, rng.randint(1, 8))
            elif kind < 0.55:
                value = rng.choice(["${%s}", "${%s}", "${%s}", "$%s", "$%s", "{{%s}}", "<%s>", "%s()", "get_%s()", "os.environ[%s]", "config.%s", "self.%s", "process.env.%s", "args.%s", "[%s]", "request.form.get(%s)"]) % rng.choice([str.lower, str.upper])("_".join([*some(rng.randint(0, 1)), rng.choice(["db", "pass", "env", "pwd", "api", *some(3)]), *some(rng.randint(0, 1))]))
            elif kind < 0.62:
                value = rng.choice(["your_password", "your-token-here", "changeme", "xxxxxxxx", "example_secret", "test1234", "placeholder1", "REDACTED", "your password here", "<your_key>", "dummy-secret-1"])
            elif kind < 0.7:
                value = "_".join(some(rng.randint(2, 3)))
            elif kind < 0.78:
                words = [rng.choice(["the", "a", "you", "is", "to", "and", "of", "in", "for", "it"]) if j % 2 else rng.choice([some(1)[0], made(3, 8)]) for j in range(rng.randint(3, 9))]
                value, before = " ".join(words).capitalize() + rng.choice(["", ".", "!"]), before.rstrip("\"'") + '"'
            elif kind < 0.84:
                value = "https://" + ".".join(some(2)) + "/" + "/".join(some(rng.randint(1, 3)))
            else:  # long runs of one case, and lines, with no secret word beside them
                value = (
                    rng.choice([str.lower, str.upper, str.title])(rng.choice([made(16, 26), clustered()])) if kind < 0.88 else "-".join([some(1)[0] if j % 2 else made(2, 6) for j in range(5)]).ljust(16, "e") if kind < 0.92
                    else rng.choice("=-_./+") * rng.randint(16, 80) if kind < 0.94 else rng.choice(lower) * rng.randint(16, 80) if kind < 0.95 else "/".join([*some(3), made(4, 9)]).rjust(16, "/") if kind < 0.97
                    else "".join(w.capitalize() for w in [*some(3), made(4, 8)]).ljust(16, "e")
                )
                before = f"{filler()} " + rng.choice(["", "", '"', "the ", "path: "])
        out.append((before.encode(), value.encode(), f"{quote if before.endswith(quote or ' ') else ''} {filler()}".encode(), i % 2))
    return out


def findings(n: int = 3000, seed: int = 11, odd: int = 0) -> list[tuple[bytes, bytes, bytes, int]]:
    """Labelled findings made by rule: keys of common kinds with names beside them, and harmless runs that look alike."""
    rng, words_of = random.Random(seed), _half(dictionary(), odd)
    chars = {"hex": "0123456789abcdef", "base": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "digits": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    draw = lambda kind, k: "".join(rng.choice(chars[kind]) for _ in range(k))
    some = lambda k: [rng.choice(words_of) for _ in range(k)]
    filler = lambda: " ".join("".join(rng.choice("aeinorstlhdu") for _ in range(rng.randint(2, 9))) for _ in range(3))
    uuid = lambda: "-".join(draw("hex", k) for k in (8, 4, 4, 4, 12))
    out = []
    for i in range(n):
        kind = rng.random()
        if i % 2:
            value = (
                draw("hex", rng.choice([20, 32, 40, 48, 64])) if kind < 0.4 else draw("base", rng.randint(20, 64)) if kind < 0.6
                else rng.choice(["AKIA", "ASIA"]) + draw("upper", 16) if kind < 0.7 else rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + draw("base", rng.randint(20, 36)) if kind < 0.85
                else draw("base", 20) + "." + draw("base", 30) + "." + draw("base", 24) if kind < 0.92 else draw("base", 24) + "/" + draw("base", 15) + "+" + draw("base", 3) + "="
            )
            name = rng.choice(sorted(SECRET_WORDS))
            before = f"{filler()} {name}{rng.choice([' = ', '=', ': ', ':', ' '])}{rng.choice(['', chr(34), chr(39)])}"
            if kind >= 0.6 and rng.random() < 0.4:
                before = filler() + " "
        else:
            value = (
                draw("hex", rng.choice([32, 40, 64])) if kind < 0.15 else uuid() if kind < 0.25 else draw("digits", rng.randint(16, 22)) if kind < 0.4
                else "/".join(some(rng.randint(2, 5))) + rng.choice([".py", ".html", ".json", "/v2", f"-{rng.randint(1, 99)}.tar.gz"]) if kind < 0.6
                else ".".join([*some(rng.randint(1, 3)), f"mail{rng.randint(1, 99)}", "example.com"]) if kind < 0.7 else "".join(w.capitalize() for w in some(rng.randint(3, 5))) + str(rng.randint(1, 99)) if kind < 0.8
                else "_".join(some(rng.randint(3, 5))) + f"_{rng.randint(1, 99)}" if kind < 0.88 else rng.choice(["your_token_here_", "xxxxxxxxxxxxxxxx", "example_key_", "changeme_"]) + draw("digits", 8) if kind < 0.94
                else f"20{draw('digits', 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T12:00:00.000000000Z".replace(":", "-")
            )
            word = rng.choice(sorted(PLAIN_WORDS)) if kind < 0.25 or rng.random() < 0.5 else "".join(rng.choice("aeinorst") for _ in range(5))
            before = f"{filler()} {word}{rng.choice([' ', ': ', ' = ', '='])}{rng.choice(['', '', chr(34)])}"
            if kind >= 0.88 and kind < 0.94:
                before = f"{filler()} {rng.choice(sorted(SECRET_WORDS))} = "
        out.append((before.encode(), value.encode(), f" {filler()}".encode(), i % 2))
    return out


class Forest:
    """Random trees on bootstrap samples, each split the best of a few features by Gini impurity."""

    words: frozenset[str] = frozenset()  # the dictionary that its features were made with

    def __init__(self, rows: np.ndarray, labels: np.ndarray, trees: int = TREES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(rows), len(rows))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(rows[pick], labels[pick], 0, nodes, rng)
            feature, value, left, right, share = zip(*nodes, strict=True)
            self.trees.append((np.array(feature), np.array(value), np.array(left), np.array(right), np.array(share)))

    def _grow(self, rows: np.ndarray, labels: np.ndarray, depth: int, nodes: list, rng: np.random.Generator) -> int:
        at, share = len(nodes), float(labels.mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
            return at
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for feature in rng.choice(rows.shape[1], max(2, int(rows.shape[1] ** 0.5)), replace=False):
            order = np.argsort(rows[:, feature], kind="stable")
            x, ones = rows[order, feature], np.cumsum(labels[order])
            n = np.arange(1, len(x))
            cut = np.flatnonzero((x[1:] > x[:-1]) & (n >= LEAF) & (len(x) - n >= LEAF))
            if len(cut):
                k, a = n[cut], ones[cut]
                b = ones[-1] - a
                cost = a * (k - a) / k + b * (len(x) - k - b) / (len(x) - k)
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (float(cost[i]), int(feature), float((x[cut[i]] + x[cut[i] + 1]) / 2))
        if best[1] < 0:
            return at
        low = rows[:, best[1]] <= best[2]
        left = self._grow(rows[low], labels[low], depth + 1, nodes, rng)
        right = self._grow(rows[~low], labels[~low], depth + 1, nodes, rng)
        nodes[at] = (best[1], best[2], left, right, share)
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, value, left, right, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                goes = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= value[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def train(labelled: list[tuple[bytes, bytes, bytes, int]] | None = None, words: frozenset[str] | None = None) -> Forest:
    labelled = findings() + announced_findings() if labelled is None else labelled
    words = dictionary() if words is None else words
    forest = Forest(np.array([features(b, w, a, words) for b, w, a, _ in labelled]), np.array([float(y) for *_, y in labelled]))
    forest.words = words
    return forest


def find_secrets(texts: list[bytes], forest: Forest) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """The spans of the secrets in each text, and its number of candidates."""
    spans = [scan(t) for t in texts]
    rows = [features(t[max(0, a - BESIDE) : a], t[a:b], t[b : b + BESIDE], forest.words) for t, found in zip(texts, spans, strict=True) for a, b in found]
    kept = iter(forest.score(np.array(rows)) >= CUT) if rows else iter(())
    return [united([s for s in found if next(kept)]) for found in spans], [len(s) for s in spans]


def redact(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, end = [], 0
    for a, b in spans:
        out += [text[end:a], MARK]
        end = b
    return b"".join([*out, text[end:]])


def _kernel(spark: SparkSession, forest: Forest):
    shared = spark.sparkContext.broadcast(forest)  # TREES trees of at most 2 to the DEPTH + 1 nodes

    def kernel():
        def run(texts: list[bytes]) -> dict:
            spans, n = find_secrets(texts, shared.value)
            return {"n_candidates": n, "n_secrets": [len(s) for s in spans], "spans": pa.array(spans and [[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "redacted": pa.array([redact(t, s).decode() for t, s in zip(texts, spans, strict=True)], pa.string())}

        return run

    return kernel


def scan_secrets(df: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """Adds n_candidates, n_secrets, spans (bytes of the UTF-8 text) and redacted, the text with secrets marked out; null texts redact to the empty text."""
    return annotate(df, text_col, "n_candidates long, n_secrets long, spans array<struct<start: long, stop: long>>, redacted string", _kernel(df.sparkSession, forest))


def redact_secrets(df: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with secrets marked out of the text; null texts stay null."""
    [null] = unused(df, "text_was_null")
    out = annotate(df.withColumn(null, F.col(text_col).isNull()), text_col, "redacted string", _kernel(df.sparkSession, forest), replace="redacted")
    return out.withColumn(text_col, F.when(~F.col(null), F.col(text_col))).drop(null)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(ids_and_texts(documents(spark, sf_dir)), train())
    return found.select("doc_id", "n_candidates", "n_secrets", F.sha2("redacted", 256).alias("redacted_sha256"), "spans")
