"""The pipeline on the smallest tables, stage by stage, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
from test_exact import brute_components, brute_fingerprint

from palimpsest.llm import bpe, decontamination, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [{r["doc_id"]: r["text"] for r in k.select("doc_id", "text").collect()} for k in kept[:-1]]

    net = toxicity.learned(spark, SF)
    clean = {i for i, t in rows[0].items() if net.score([t.encode()])[0] < toxicity.CUT}
    assert set(rows[1]) == clean

    ids = sorted(rows[1])
    groups = brute_components([brute_fingerprint(rows[1][i]) for i in ids])
    assert set(rows[2]) == {ids[g] for g in groups}

    items = [r["text"].split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, t in rows[2].items() if any(f" {' '.join(w)} " in f" {' '.join(t.split())} " for w in items)}
    assert set(rows[3]) == set(rows[2]) - holds

    forest = secrets.train()
    for i, text in rows[4].items():
        raw = rows[3][i].encode()
        assert text.encode() == secrets.redact(raw, secrets.find_secrets([raw], forest)[0][0])
    assert set(rows[4]) == set(rows[3])

    codec = bpe.codec_of(bpe.vocabulary())
    found = {r["doc_id"]: r for r in kept[-1].collect()}
    assert set(found) == set(rows[4])
    for i, text in rows[4].items():
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, codec.encode(text).tolist())).encode()).hexdigest()
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in found.items()}


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, a column of each stage's inner names; and no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, item_id long, fingerprint long, n_secrets int, __id string"
    text = "some words that are of no harm at all and of no use"
    odd = [(None, None), (None, ""), (1, text), (1, text), (2, text), (2, "another text " + "x" * 30_000), (3, 'token = "9f3c2a7b1e4d5068a1b2c3d4e5f6"'), (3, None), (4, " \n\t ")]
    docs = spark.createDataFrame([(i, t, None, None, None, 0.5, 7, None, 1, "mine") for i, t in odd], schema)
    for df in (docs.repartition(3), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns, name
            kept = sorted(((r["doc_id"] or -1) for r in out.collect()))
            want = [] if df.isEmpty() else [1, 2, 3, 3] if name == "simhash" else sorted((i or -1) for i, _ in odd)
            assert kept == want, name


def test_every_query_runs_over_all_documents(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    found = queries.queries()
    assert [k for k in found if k.startswith("op")] == ["op1_decontamination", "op2_bpe", "op3_secrets", "op4_substrings", "op5_token_counts", "op6_quality", "op7_simhash", "op8_toxicity", "op9_language", "op10_sharding"]
    for name in ("op2_bpe", "op3_secrets", "op4_substrings", "op5_token_counts", "op6_quality", "op7_simhash", "op8_toxicity", "op9_language", "op10_sharding"):
        assert found[name](spark, SF).count() == n, name


def test_shards_and_contaminated_documents_by_value(spark):
    """op10 against a scalar jump hash, op1 against the words of the benchmark that stand in a row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "xxhash64(doc_id) as key").collect()

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()), "key", jump(r["key"] % (1 << 64), 40), jump(r["key"] % (1 << 64), 41)) for r in docs)
    found = queries.queries()["op10_sharding"](spark, SF).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found) == want
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())

    words = lambda t: decontamination.words_of((t or "").encode())
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def longest(text, item):  # words of the longest part of the item that the text holds
        grams = {tuple(text[i : i + n]): n for n in range(5, len(item) + 1) for i in range(len(text) - n + 1)} if len(text) < 400 else {}
        return max((n for i in range(len(item)) for n in range(5, len(item) - i + 1) if tuple(item[i : i + n]) in grams), default=0)

    got = {r["doc_id"]: r for r in queries.queries()["op1_decontamination"](spark, SF).collect()}
    whole = {r["doc_id"] for r in docs if any(b" " + b" ".join(i) + b" " in b" " + b" ".join(words(r["text"])) + b" " for i in items)}
    assert whole <= set(got) and all(r["contaminated"] and r["coverage"] >= 0.5 and r["n_items"] >= 1 for r in got.values())
    for r in [r for r in docs if r["doc_id"] not in got and len(words(r["text"])) < 400][:40]:
        assert all(2 * longest(words(r["text"]), item) < len(item) for item in items)


def test_languages_of_held_out_documents(spark):
    out = queries.queries()["op9_language"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95


def test_secrets_of_the_documents(spark):
    """Every value announced as a token goes, and no card number, address or long word does."""
    texts = [r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").collect()]
    spans, _ = secrets.find_secrets(texts, secrets.train())
    planted = [{m.span(1) for m in re.finditer(rb'token = "([^"]+)"', t)} for t in texts]
    assert sum(map(len, planted)) > 10 and [set(s) for s in spans] == planted


def test_toxicity_of_held_out_documents(spark):
    """Labels of held-out rows are only read here; all languages together and each by itself."""
    sf = "/root/testdata/sf0.1"
    out = queries.queries()["op8_toxicity"](spark, sf).where("held_out")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").join(docs, "doc_id").collect()

    def auc(found):
        good, bad = ([r["score"] for r in found if r["toxic"] == k] for k in (0, 1))
        return np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])

    assert auc(rows) > 0.97
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        if 5 < sum(r["toxic"] for r in own) < len(own):
            assert auc(own) > 0.95, lang
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95
