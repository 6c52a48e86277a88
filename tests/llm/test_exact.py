"""Each operator against a plain brute-force version, on small texts with nulls, blanks, ties, repeats and long runs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import bpe, components, decontamination, langid, quality, secrets, sharding, simhash, substrings, tokencounts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n\t ", "a", "word", "É é \x1c\x85  x", "<|endoftext|>", "a" * 5000, "no " * 4000, "tab\tand\vvertical\fform\rreturn", "😀 emoji 中文字", "same text twice", "same text twice"]
#: Columns that clash with what operators add.
CLASHES = "doc_id long, text string, score double, shard int, ids string, fingerprint string, kept string, n_words string, `_1` int"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, 1, "x", "y", "z", "w", 2) for i, t in enumerate(texts)], CLASHES)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sentences(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 2: byte-pair encoding


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_is_the_library_s(spark, reference):
    rng = random.Random(0)
    alphabet = "ab  \n\t'sté<|>endoftext12½中😀.,!$​İ"
    texts = EDGE + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + ["<|endoftext|>x<|endoftext|><|endoftext|> y"]
    found = by_id(bpe.round_trip(table(spark, texts)))
    digest = by_id(bpe.digests(bpe.round_trip(table(spark, texts))))
    for i, text in enumerate(texts):
        want = reference.encode(text or "", add_special_tokens=False).ids
        assert list(found[i]["ids"]) == want and found[i]["n_tokens"] == len(want)
        assert found[i]["decoded"] == reference.decode(want, skip_special_tokens=False) == (text or "")
        assert digest[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_decodes_what_encode_gives_and_broken_bytes(spark, reference):
    out = bpe.decode(bpe.encode(table(spark, EDGE)).select("doc_id", "ids"))
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == {i: t or "" for i, t in enumerate(EDGE)}
    ids = reference.encode("é中", add_special_tokens=False).ids[:1]
    assert bpe.codec_of(bpe.vocabulary()).decode(ids) == reference.decode(ids)


# 5: token counts


def test_counts_are_those_of_the_best_cut(spark):
    ranks = tokencounts.parse_ranks(tokencounts.vocabulary())
    scores = tokencounts.ForwardTrie(ranks).scores

    def best(data: bytes) -> int:
        table = [(0.0, 0)]
        for end in range(1, len(data) + 1):
            options = [(table[start][0] + scores[data[start:end]], table[start][1] + 1) for start in range(max(0, end - 130), end) if data[start:end] in scores]
            top = max(s for s, _ in options)
            table.append((top, min(n for s, n in options if s == top)))
        return table[-1][1]

    rng = random.Random(2)
    texts = EDGE + ["".join(rng.choice("abcdeé th ing'12\n") for _ in range(50)) for _ in range(60)]
    found = by_id(tokencounts.count_tokens(table(spark, texts)))
    for i, text in enumerate(texts):
        tokens = tokencounts.find_pretokens(text or "")
        assert (found[i]["n_pretokens"], found[i]["n_tokens"]) == (len(tokens), sum(best(t.encode()) for t in tokens))


# 6: quality


def brute_quality(text):
    words = WORD.findall(text or "")
    n, seen, dup = len(words), set(), 0
    grams = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = EDGE + ["".join(rng.choice(["\n", " ", "  "]) + rng.choice(["ab", "a", "é", "#x|"]) for _ in range(rng.randrange(90))) for _ in range(150)]
    texts += [sentences(rng, 60, 500) + "\n" + (line := sentences(rng, 9, 500)) + "\n" + line for _ in range(20)]
    texts += [(long := sentences(rng, 150, 10**6)) + " " + sentences(rng, 900, 10**6) + " " + long]
    found = by_id(quality.apply_rules(table(spark, texts)))
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(text)
        assert r["kept"] == (not r["base_failed"] and r["longest_repeat"] <= quality.MOST_IN_ONE)
    last = found[len(texts) - 1]
    assert not last["base_failed"] and last["longest_repeat"] == 150 and not last["kept"]


# 7: SimHash


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    prints = np.array(prints, np.uint64)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_groups(spark):
    rng = random.Random(8)
    base = [sentences(rng, 400, 3000) for _ in range(20)]
    texts = EDGE + base + base[:5] + [" ".join(w if rng.random() > 0.01 else "changed" for w in b.split()) for b in base for _ in range(4)]
    found = by_id(simhash.near_duplicates(table(spark, texts)))
    prints = [brute_fingerprint(t) for t in texts]
    assert [found[i]["fingerprint"] % (1 << 64) for i in range(len(texts))] == prints
    assert [found[i]["component_id"] for i in range(len(texts))] == brute_components(prints)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_connect_what_is_near(spark, seed, monkeypatch):
    """Fingerprints with chains, a dense group, and a hot value that has to be dealt anew."""
    monkeypatch.setattr(simhash, "HOT", 50)
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(200):
        prints.append(flip(rng.choice(prints), rng.randrange(1, 5)))
    centre = rng.getrandbits(64)
    prints += [flip(centre, rng.randrange(0, 3)) for _ in range(200)] + [(centre & 0xFFFF) | rng.getrandbits(48) << 16 for _ in range(200)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"))
    assert all(bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= 3 for r in links.collect())
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    groups, want = {}, {}
    for s, w in zip(signed, brute_components(prints), strict=True):
        groups.setdefault(root.get(s, s), set()).add(s)
        want.setdefault(w, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_thresholds_are_the_cheapest_that_sum_up():
    rng = np.random.default_rng(0)
    even = rng.integers(0, 3, (4, 1 << 16))
    assert sum(simhash.allocate(even)) == 0
    skewed = even.copy()
    skewed[2] = 0
    skewed[2, 5] = 100_000  # all in one value: leave it out
    assert simhash.allocate(skewed)[2] == -1 and sum(simhash.allocate(skewed)) == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    a, b = sentences(rng, 100, 900), sentences(rng, 100, 900)
    docs = spark.createDataFrame([(5, a), (3, a), (3, a), (9, b), (None, a), (None, None), (1, "")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in simhash.keep_one(docs).collect() if r["doc_id"] is not None) == [(1, ""), (3, a), (9, b)]


def test_one_of_each_group_stays_where_ids_repeat_or_are_null(spark):
    rng = random.Random(14)
    a, b, c, d, e = (sentences(rng, 100, 900) for _ in range(5))
    cases = [
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),  # 5 is a copy in one group and the only row of another
        ([(5, b), (5, c)], [(5, b), (5, c)]),  # two groups of one name
        ([(7, a), (None, a), (None, d), (None, d), (None, e)], [(7, a), (None, d), (None, e)]),
        ([(4, a), (4, a), (4, b), (4, b), (None, ""), (None, None)], [(4, a), (4, b), (None, None)]),
    ]
    for rows, want in cases:
        found = simhash.keep_one(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3))
        assert found.columns == ["doc_id", "text", "n"]
        got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in found.collect()))
        assert got == sorted((i or -1, t or "") for i, t in want)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4: substrings


def brute_removed(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeated_windows_go(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(hot)
    passage, line, own = sentences(rng, 50, 9999), sentences(rng, 20, 9999), lambda n: sentences(rng, n, 9999)
    texts = EDGE + [own(60) + " " + passage + " " + own(30) for _ in range(6)] + [own(40) + " " + line + " " + own(40) for _ in range(12)] + ["x y " * 60, passage, passage[:-3]]
    texts += [(doc := own(200)), doc, doc.replace("w1", "v1", 2), own(34), own(35)] + [(twice := own(40)) + " " + own(10) + " " + twice]
    texts += [own(rng.randrange(40)) + " " + passage + " " + own(rng.randrange(40)) for _ in range(50)] + [sentences(rng, 300, 2) for _ in range(4)]
    found = by_id(substrings.remove_repeats(table(spark, texts)))
    for i, want in enumerate(brute_removed(texts)):
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept"]) == want


def test_windows_that_repeat_in_one_stretch_only(spark):
    """Words over and over whose anchor no other stretch has: all windows there are may be in one."""
    rng = random.Random(8)
    texts = [f"{sentences(rng, 40, 9999)} {' '.join([word] * n)} {sentences(rng, 40, 9999)}" for word, n in (("ho", 36), ("hum", 38), ("hey", 60), ("hoo", 130), ("one", 35))]
    texts += ["la li " * 19, " ".join(f"v{i % 20}" for i in range(60))]
    found = by_id(substrings.remove_repeats(table(spark, texts)))
    want = brute_removed(texts)
    assert [n for _, n, _ in want] == [36, 38, 60, 130, 0, 38, 60]
    for i, row in enumerate(want):
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept"]) == row


def test_a_stretch_is_all_of_its_words():
    """One anchor every 25 words makes a stretch of so many windows that the first and the last leave words between them."""
    rng = random.Random(9)
    n = 0
    for _ in range(2000):
        gram = [f"w{rng.randrange(10**6)}" for _ in range(6)]
        words = [w for block in "abcde" for w in [*gram, *(f"{block}{i}" for i in range(19))]]
        one, two = (substrings.Stretches([" ".join(text).encode()]) for text in (words, [*words[:45], "other", *words[46:]]))
        if one.first[0] == 0 and one.last[0] == two.last[0] == 63 and one.anchor[0] == two.anchor[0]:
            n += 1
            assert one.hash[0] != two.hash[0]
    assert n


def test_automaton_spans():
    rng = random.Random(5)
    for _ in range(800):
        base = [rng.choice([b"a", b"b", b"c"]) for _ in range(30)]
        strings = list({tuple(base[(i := rng.randrange(20)) : i + rng.randrange(1, 12)]) for _ in range(4)})
        copies = [rng.choice([1, 1, 2]) for _ in strings]
        least = rng.choice([2, 3, 4])
        counts = Counter()
        for s, c in zip(strings, copies, strict=True):
            for i in range(len(s) - least + 1):
                counts[s[i : i + least]] += c
        for s, spans in zip(strings, substrings.repeated_spans([list(s) for s in strings], copies, least), strict=True):
            want = {j for i in range(len(s) - least + 1) if counts[s[i : i + least]] > 1 for j in range(i, i + least)}
            assert {j for a, b in spans for j in range(a, b)} == want


# 1: decontamination


def test_tiles_are_the_greedy_ones():
    def brute(pattern, text, least):
        in_p, in_t, tiles = [False] * len(pattern), [False] * len(text), []
        while True:
            best, found = least, []
            for p in range(len(pattern)):
                for t in range(len(text)):
                    n = 0
                    while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] >= 0 and not in_p[p + n] and not in_t[t + n]:
                        n += 1
                    if n > best:
                        best, found = n, []
                    if n == best:
                        found.append((p, t))
            if not found:
                return tiles
            for p, t in found:
                if not any(in_p[p : p + best]) and not any(in_t[t : t + best]):
                    in_p[p : p + best] = in_t[t : t + best] = [True] * best
                    tiles.append((p, t, best))

    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice([2, 3, 6, 30])
        pattern, text = ([rng.randrange(low, letters) for _ in range(rng.randrange(40))] for low in (0, -1))
        got, want = decontamination.greedy_tiles(pattern, text, 3), brute(pattern, text, 3)
        assert sum(n for *_, n in got) == sum(n for *_, n in want)


def test_benchmark_passages_are_caught(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, sentences(rng, 40, 5000)) for i in range(30)] + [(90, None), (91, ""), (92, "too few words"), (None, "no id at all for this item here")]
    w = items[3][1].split()
    texts = EDGE + [sentences(rng, 100, 5000) + " " + items[4][1].upper() + ". " + sentences(rng, 50, 5000), " ".join(w[20:]) + " x y " + " ".join(w[:20]), " ".join(w[:15]), sentences(rng, 300, 5000), ", ".join(x if i % 9 else "new" for i, x in enumerate(items[5][1].split()))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    base = len(EDGE)
    want = {base: 4, base + 1: 3, base + 4: 5}
    for limit in (8_000_000, 900):
        parts = list(decontamination.blocks(benchmark, limit))
        found = decontamination.judge(table(spark, texts), parts).where("contaminated").collect()
        assert {r["doc_id"]: r["item_id"] for r in found} == want
        assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(clashing(spark, texts), parts).collect()) == sorted(set(range(len(texts))) - set(want))
    none = list(decontamination.blocks(benchmark.limit(0)))
    assert decontamination.judge(table(spark, texts), none).where("contaminated").count() == 0


def test_items_without_an_id_contaminate(spark):
    rng = random.Random(17)
    a, b = sentences(rng, 40, 5000), sentences(rng, 40, 5000)
    benchmark = spark.createDataFrame([(None, a), (None, b), (6, b), (7, None)], "item_id long, text string")
    docs = table(spark, [sentences(rng, 30, 5000) + " " + a, b, sentences(rng, 60, 5000)])
    for limit in (8_000_000, 200):
        parts = list(decontamination.blocks(benchmark, limit))
        found = decontamination.judge(docs, parts).where("contaminated").collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} >= {(0, None), (1, 6)} and {r["doc_id"] for r in found} == {0, 1}
        assert [r["doc_id"] for r in decontamination.drop_contaminated(docs, parts).collect()] == [2]


def test_any_number_of_blocks_gives_the_same_rows(spark, monkeypatch):
    """Repeated rows, equal and null ids; each row is judged on its own."""
    rng = random.Random(27)
    items = [(i, sentences(rng, 30, 5000)) for i in range(9)] + [(20, "p q r s t u v w x y")] * 2
    both = items[0][1] + " . " + items[7][1]
    docs = [(1, both), (1, both), (1, items[3][1]), (None, both), (None, both), (None, items[2][1]), (4, "clean text " * 9), (5, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, 0.1, "mine") for d in docs], "doc_id long, text string, coverage double, _n_items string")
    want = sorted([("1", 1.0, 0, 2)] * 2 + [("1", 1.0, 3, 1)] + [("None", 1.0, 0, 2)] * 2 + [("None", 1.0, 2, 1)])
    for limit, at_once in ((8_000_000, 4), (400, 100), (400, 2)):
        monkeypatch.setattr(decontamination, "BLOCKS_AT_ONCE", at_once)
        parts = list(decontamination.blocks(benchmark, limit))
        assert sum(len(b.ids) for b in parts) == 10 and (limit > 400 or len(parts) > 3)
        out = decontamination.judge(df.repartition(3), parts)
        assert out.count() == len(docs) and set(out.columns) == {"doc_id", "text", "_n_items", "coverage", "item_id", "n_items", "contaminated"}
        assert sorted((str(r["doc_id"]), r["coverage"], r["item_id"], r["n_items"]) for r in out.where("contaminated").collect()) == want
        assert sorted(str(r["doc_id"]) for r in decontamination.drop_contaminated(df, parts).collect()) == ["4", "5"]


def test_words_over_and_over_take_no_square_time():
    """What regions() leaves out changes no coverage, and a million equal words are judged at once."""
    rng = random.Random(31)
    for _ in range(400):
        period = [rng.randrange(4) for _ in range(rng.randrange(1, 5))]
        pattern = ([rng.randrange(4) for _ in range(rng.randrange(4))] + period * 9)[: rng.randrange(5, 16)]
        text = [rng.randrange(4) for _ in range(rng.randrange(6))] + period * rng.randrange(30, 60) + [rng.randrange(4) for _ in range(rng.randrange(6))] + pattern * rng.randrange(3)
        flat, grams = np.array(text), {tuple(pattern[i : i + decontamination.SEED]) for i in range(len(pattern))}
        places = np.array([i for i in range(len(text) - 4) if tuple(text[i : i + 5]) in grams], np.int64)
        if len(places):
            whole = [t for a, b in zip([-99, *places], places, strict=False) for t in ([-1] if b - a > 5 else []) + text[max(b, a + 5) : b + 5]]
            left = decontamination.regions(flat, places, len(pattern))
            assert sum(n for *_, n in decontamination.greedy_tiles(pattern, left)) == sum(n for *_, n in decontamination.greedy_tiles(pattern, whole))
    block = decontamination.Benchmark([(1, "no " * 60), (2, "so it goes " * 20), (3, "no so it goes on " * 12)])
    assert block.judge([b"no " * 10**6, b"so it goes " * 300_000, b"other words " * 10**5]) == [(1.0, 1, 1), (1.0, 2, 1), (0.0, -1, 0)]


# 10: sharding


def test_jump_hash_moves_rows_only_into_the_new_shard():
    def scalar(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rng = random.Random(0)
    keys = [rng.getrandbits(64) for _ in range(2000)]
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [scalar(k, n) for k in keys]
    a, b = sharding.jump(np.array(keys, np.uint64), 40), sharding.jump(np.array(keys, np.uint64), 41)
    assert set(b[a != b]) == {40} and 0 < (a != b).mean() < 0.06


def test_slots_are_gapless(spark):
    df = table(spark, ["t"] * 500 + EDGE, ids=[i % 90 if i % 7 else None for i in range(500 + len(EDGE))])
    rows = sharding.number(sharding.assign(df.select("doc_id", F.crc32("text").alias("c"))), ["doc_id", "c"]).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 500 + len(EDGE) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def test_one_row_over_and_over_is_numbered_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = sharding.assign(spark.range(0, 20_000, 1, 4).select(F.lit(7).cast("long").alias("doc_id")))
    out = sharding.number(rows, ["doc_id"])
    found = out.withColumn("task", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["task"] for r in found}) > 1
    assert sorted(r["slot"] for r in found) == list(range(20_000)) and out.columns == ["doc_id", "shard", "grown_shard", "slot"]


# 3, 8, 9: learned operators


def test_secrets_on_findings_not_trained_on():
    """Their words are of the half of the dictionary that training left out."""
    held = secrets.findings(1500, seed=77, odd=1)
    scores = secrets.train().score(np.array([secrets.features(b, w, a, secrets.dictionary()) for b, w, a, _ in held]))
    assert ((scores >= secrets.CUT) == np.array([y for *_, y in held])).mean() > 0.98


def test_secrets_are_marked_out(spark):
    key = "9f3c2a7b1e4d5068a1b2c3d4e5f60718293a4b5c"
    texts = EDGE + [f'some words token = "{key}" and more', f"the commit {key} fixed it", f"password={key[:20]}", "order 1234567890123456 shipped", "see src/main/python/module_handler_v2.py there", "mail7.example.com.internal.host1"]
    base = len(EDGE)
    found = by_id(secrets.scan_secrets(table(spark, texts), secrets.train()))
    assert [found[base + i]["n_secrets"] for i in range(6)] == [1, 0, 1, 0, 0, 0]
    assert found[base]["redacted"] == 'some words token = "[SECRET]" and more'
    out = by_id(secrets.redact_secrets(clashing(spark, texts), secrets.train()))
    assert out[0]["text"] is None and out[base + 2]["text"] == "password=[SECRET]" and out[base + 1]["text"] == texts[base + 1]
    assert all(out[i]["text"] == t for i, t in enumerate(EDGE)) and len(out[0]) == 9


def test_secrets_of_any_length_and_characters_beside_secret_words():
    values = ["hunter2Secret", "S3cr3tP@ssw0rd!", "Tr0ub4dor&3!longer#pass", "QWZXPLMKOIJNUHBYGVTF", "qpwoeirutyalskdjfhgz", "p\u00e4ssw\u00f6rd99!x"]
    leads = ['password = "%s"', "pwd=%s and", "DB_PASSWORD=%s;User=bob", '{"password": "%s", "user": "bob"}', "auth: password: %s", "login --password %s now", "the password for root is %s", "<password>%s</password>"]
    harmless = ["password: string", "token = get_token()", "the key: value pairs", 'The secret: "I never liked it," she said', "token: None", "author: Tolstoy", "access: public", "monkey = banana123X", "internationalization of standards", "DEM!! DEN!! MIT!! ERSCHSCHBERBERTZ", "=" * 40, "password = ${DB_PASS}"]
    texts = [(lead % v, lead % "[SECRET]") for lead in leads for v in values] + [(h, h) for h in harmless]
    raw = [t.encode() for t, _ in texts]
    spans, _ = secrets.find_secrets(raw, secrets.train())
    assert [secrets.redact(t, s).decode() for t, s in zip(raw, spans, strict=True)] == [want for _, want in texts]
    assert secrets.united([(5, 9), (0, 3), (7, 12), (12, 14)]) == [(0, 3), (5, 12), (12, 14)]


def test_announced_findings_not_trained_on():
    held = secrets.announced_findings(1500, seed=78, odd=1)
    scores = secrets.train().score(np.array([secrets.features(b, w, a, secrets.dictionary()) for b, w, a, _ in held]))
    assert ((scores >= secrets.CUT) == np.array([y for *_, y in held])).mean() > 0.98


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ta", "to", "ki", "lo"], "bb": ["sch", "ung", "keit", "ver"], "cc": ["eau", "ier", "oi", "que"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    docs = [(lang, make(lang)) for lang in syllables for _ in range(40)]
    model = langid.train(spark.createDataFrame([*docs, (None, "x"), ("aa", None)], "lang string, text string"))
    tests = [(lang, make(lang)) for lang in syllables for _ in range(30)]
    found = by_id(langid.identify(clashing(spark, [t for _, t in tests] + EDGE + ["123 ,.!"]), model))
    assert sum(found[i]["lang_pred"] == lang for i, (lang, _) in enumerate(tests)) == len(tests)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    end = len(tests)
    assert [found[end + i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and found[end + len(EDGE)]["lang_pred"] == "und" and found[end + 3]["lang_pred"] != "und"


def test_filter_masks_hold_every_language_of_a_gram():
    texts = {"a": ["abc abc abc"], "b": ["abc abc abc xyz xyz xyz"]}
    model = langid.LanguageFilter.of_texts(texts)
    for bit, lang in enumerate(model.languages):
        grams, n = np.unique(langid._grams(texts[lang])[0], return_counts=True)
        assert (model.lookup(grams[n >= langid.LEAST_COUNT])[0] >> np.uint64(bit) & np.uint64(1)).all()


def test_more_languages_than_a_word_has_bits():
    names = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrs"]
    model = langid.LanguageFilter.of_texts({n: [f"{n}{n}x {n}y " * 5] for n in names})
    assert len(names) == 90 and model.predict([f"{n}{n}x" for n in names])[0] == names


def test_copies_teach_a_language_once(spark):
    """A text with very many copies, drawn or not, neither thins out the other texts nor reaches the driver."""
    rng = random.Random(19)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(12))
    few, many = [make(["ta", "to", "ki"]) for _ in range(6)], make(["sch", "ung", "ver"])
    copies = spark.range(0, 100_000, 1, 4).select(F.lit("aa").alias("lang"), F.lit(few[0]).alias("text"))
    docs = copies.unionByName(spark.createDataFrame([("aa", t) for t in few[1:]] + [("bb", many)] * 3, "lang string, text string"))
    model = langid.train(docs, rows=6)
    alone = langid.train(docs.distinct(), rows=6)
    assert model.languages == alone.languages == ["aa", "bb"] and (model.masks == alone.masks).all()
    assert model.predict([make(["ta", "to", "ki"]), make(["sch", "ung", "ver"])])[0] == ["aa", "bb"]


def test_toxicity_learns_words_and_scores_all_texts(spark):
    rng = random.Random(2)
    bad = ["nasty", "vile", "horrid"]
    docs, labels = [], []
    for i in range(600):
        words = sentences(rng, rng.randrange(10, 80), 300).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    label_rows = spark.createDataFrame([*labels[:400], (5, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(spark.createDataFrame(docs[:400], "doc_id long, text string"), label_rows)
    found = by_id(toxicity.score(clashing(spark, [t for _, t in docs[400:]] + EDGE), net))
    right = sum(found[i]["predicted"] == labels[400 + i][1] for i in range(200))
    assert right >= 194
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    texts = [(t or "").encode() for t in [t for _, t in docs[400:]] + EDGE]
    assert net.score(texts).tolist() == [float(net.score([t])[0]) for t in texts] == [found[i]["score"] for i in range(len(texts))]
    kept = toxicity.drop_toxic(clashing(spark, [t for _, t in docs[400:]]), net)
    assert kept.columns == clashing(spark, []).columns and kept.count() == sum(found[i]["predicted"] == 0 for i in range(200))
    assert net.languages.languages == [] and net.cuts.keys() <= {"", "und"}
    unlearned = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), label_rows.where("toxic = 1"))
    assert {(r["score"], r["predicted"]) for r in toxicity.score(table(spark, EDGE), unlearned).collect()} == {(0.0, 0)}


def test_thresholds_are_each_language_s_own(spark):
    """One language's harmless words lie near the other's toxic ones, so each needs its own threshold; copies teach once."""
    rng = random.Random(12)
    syllables = {"aa": ["ta", "to", "ki", "lo"], "bb": ["sch", "ung", "keit", "ver"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    docs = [(i, make(lang := "ab"[i % 2] * 2) + (" vile" if (toxic := i % 6 < 2) else ""), lang, int(toxic)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(df.unionByName(df.where("doc_id = 3").crossJoin(spark.range(2000)).select(df.columns)), df.select("doc_id", "toxic"))
    assert sorted(net.languages.languages) == ["aa", "bb"] and set(net.cuts) >= {"aa", "bb"}
    tests = [(make(lang) + " vile" * bad, bad) for lang in syllables for bad in (0, 1) for _ in range(25)]
    scores = net.score([t.encode() for t, _ in tests])
    assert ((scores >= toxicity.CUT) == np.array([b for _, b in tests])).mean() > 0.95


# names, sizes, tables without rows, and rows that repeat


def test_columns_that_clash_with_names_used_inside(spark):
    text = "some words of a text"
    df = spark.createDataFrame([(1, text, 3, "x", "y", None), (2, text, 4, "x", "y", None), (3, None, 5, "x", "y", True)], "doc_id long, text string, __id int, `_ID` string, id_stays string, __text_was_null boolean")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    out = secrets.redact_secrets(df, secrets.train())
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_long_texts_keep_to_their_bounds():
    """A pre-token of a million bytes leaves the trie as it was; a long candidate is read in passing."""
    trie = tokencounts.ForwardTrie(tokencounts.parse_ranks(tokencounts.vocabulary()))
    rng = random.Random(3)
    for _ in range(5):
        data = bytes(rng.choice(b"etaoin") for _ in range(1500))
        assert trie.alone(data) == trie.insert(data)
    trie.reset()
    n = trie.count("a" * 100_000 + " b")
    assert n[0] == 2 and n[1] > 100 and len(trie.forward) < 10
    raw = b"key = " + b"x9Y" * 300_000
    spans, _ = secrets.find_secrets([raw, b"no " * 10**6], secrets.train())
    assert len(secrets.redact(raw, spans[0])) < 100 and spans[1] == []


def test_a_million_equal_words(spark):
    """One word or one line over and over, beside a long text of many words, through every operator."""
    rng = random.Random(41)
    texts = ["no " * 10**6, "so it goes on\n" * 150_000, sentences(rng, 200_000, 10**6), None]
    df = table(spark, texts).coalesce(2)
    n = [len(WORD.findall(t or "")) for t in texts]
    found = by_id(substrings.remove_repeats(df).drop("kept"))
    assert [(found[i]["n_words"], found[i]["n_removed"]) for i in range(4)] == [(n[0], n[0]), (n[1], n[1]), (n[2], 0), (0, 0)]
    found = by_id(quality.apply_rules(df))
    assert [(found[i]["n_repeat_words"], found[i]["longest_repeat"]) for i in range(4)] == [(n[0], n[0] - 1), (n[1], n[1] - 4), (0, 0), (0, 0)]
    found = by_id(bpe.round_trip(df))
    assert [found[i]["decoded"] for i in range(4)] == [t or "" for t in texts] and [len(r["ids"]) for r in found.values()] == [r["n_tokens"] for r in found.values()]
    assert [by_id(tokencounts.count_tokens(df))[i]["n_pretokens"] for i in (0, 3)] == [n[0] + 1, 0]
    assert [r["fingerprint"] % (1 << 64) for _, r in sorted(by_id(simhash.near_duplicates(df)).items())][:2] == [brute_fingerprint("no no no"), brute_fingerprint("so it goes on\n" * 50)]
    benchmark = spark.createDataFrame([(1, "no " * 30), (2, "goes on so it " * 8)], "item_id long, text string")
    judged = by_id(decontamination.judge(df, decontamination.blocks(benchmark)))
    assert [judged[i]["contaminated"] for i in range(4)] == [True, True, False, False]
    assert [by_id(secrets.scan_secrets(df, secrets.train()))[i]["n_secrets"] for i in range(4)] == [0] * 4
    model = langid.train(spark.createDataFrame([("aa", "no so it goes on " * 9)], "lang string, text string"))
    assert [by_id(langid.identify(df, model))[i]["lang_pred"] for i in (0, 3)] == ["aa", "und"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    net = toxicity.train(table(spark, [f"{'vile' if i % 2 else 'kind'} words {i}" for i in range(40)]), labels)
    assert len({r["score"] for r in toxicity.score(df, net).collect()}) >= 1
    assert sharding.assign(df).count() == 4


# tables without rows, and rows that repeat


def test_columns_of_odd_names(spark):
    odd = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, `N_Tokens` int, `a.b` int")
    out = tokencounts.count_tokens(odd)
    assert out.columns == ["doc_id", "text", "a.b", "n_pretokens", "n_tokens"] and tuple(out.first())[2:] == (3, 2, 2)


def test_empty_tables(spark):
    empty = table(spark, [])
    model = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(table(spark, EDGE), model).collect()} == {"und"}
    for out in (
        bpe.round_trip(empty), tokencounts.count_tokens(empty), quality.apply_rules(empty), simhash.near_duplicates(empty), simhash.keep_one(empty), substrings.remove_repeats(empty), langid.identify(empty, model),
        toxicity.score(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))), secrets.scan_secrets(empty, secrets.train()), decontamination.judge(empty, decontamination.blocks(spark.createDataFrame([], "item_id long, text string"))), sharding.number(sharding.assign(empty.select("doc_id")), ["doc_id"]),
    ):
        assert out.count() == 0


def test_repeated_rows_and_null_ids(spark):
    texts = [sentences(random.Random(1), 60, 99)] * 3 + [None, None]
    df = table(spark, texts, ids=[1, 1, None, None, 7])
    assert substrings.remove_repeats(df).count() == 5
    assert {r["n_removed"] for r in substrings.remove_repeats(df).where("n_words > 0").collect()} == {60}
    groups = simhash.near_duplicates(df).collect()
    assert len(groups) == 5 and {r["component_id"] for r in groups if r["fingerprint"]} == {1} and {r["component_id"] for r in groups if not r["fingerprint"]} == {7}
    assert zlib.crc32(b"") == 0
