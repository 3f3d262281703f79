"""Secrets, quality rules, language of words, capture index."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexquarry.llm import capture_index, decision_list, language_crf, secrets


# ---------------------------------------------------------------- secrets
def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def slow_best(s, chars, window):
    return max((entropy(s[i : i + window]) for i in range(len(s) - window + 1) if set(s[i : i + window]) <= chars), default=-1.0)


def test_sliding_entropy_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        s = "".join(rng.choice("abcdef0123456789XYZ+/") for _ in range(rng.randint(15, 60)))
        for _, chars, window, _ in secrets.CLASSES:
            assert abs(secrets.max_entropy(s, frozenset(chars), window) - slow_best(s, set(chars), window)) < 1e-9


KEY, HEX = "AKq8Zr3LmW0xTy7BvN2cJd5e", "9f86d081884c7d659a2feaa0c55ad015"


def test_secrets_are_found_and_replaced(documents):
    extra = [(50, f"token={KEY} and {HEX}.", "en", "s", 1), (51, f"{KEY} {KEY} " + "x" * 30_000 + f" {HEX}", "en", "s", 1), (52, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa internationalizationandlocalization 2024-01-02-03-04-05-06-07-08", "en", "s", 1)]
    extra += [(53, f"EXAMPLE_{KEY} 123e4567-e89b-12d3-a456-426614174000 12345678901234567890", "en", "s", 1), (None, f"x {HEX}", "en", "s", 1)]
    df = documents(extra)
    got = sorted(((r.doc_id, r.secret) for r in secrets.scan(df).collect()), key=str)
    assert got == sorted([(50, f"token={KEY}"), (50, HEX), (51, KEY), (51, KEY), (51, HEX), (None, HEX)], key=str)
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert KEY not in texts[51].text and HEX not in texts[51].text and texts[51].text.count(secrets.MARK) == 3 and texts[51].n_chars == len(texts[51].text)
    same = {r.doc_id: r for r in df.collect()}
    assert all(texts[d] == same[d] for d in (0, 20, 21, 22, 23, 52, 53))
    assert secrets.scan(df.where("false")).count() == 0 and secrets.redact(df.where("false")).count() == 0


# ---------------------------------------------------------------- quality rules
def quality_docs(spark, make_text, n, seed=0):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        bad = i % 3 == 0
        t = make_text(seed * 10_000 + i, 100)
        if bad and i % 2:
            t = " ".join([t.split()[0]] * 100)
        elif bad:
            t = t + " " + "!$#@^ 123456 " * 30
        docs.append((i, t))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_hold_on_documents_held_out(spark, make_text):
    docs, labels = quality_docs(spark, make_text, 300)
    got = {r.doc_id: r for r in decision_list.judge(docs, labels.where("doc_id < 150")).collect()}
    right = sum(got[i].keep == (i % 3 != 0) for i in range(150, 300))
    assert right >= 0.95 * 150
    assert all((r.rule == 0) == r.keep and (r.reason == "") == r.keep for r in got.values())


def test_expression_equals_the_rules(spark, make_text):
    docs, labels = quality_docs(spark, make_text, 120)
    rules = decision_list.fit(docs, labels)
    assert rules and all(r.share >= 0.8 for r in rules)
    stats = docs.select("doc_id", *[c.alias(k) for k, c in decision_list.statistics(F.col("text")).items()]).toPandas()
    names = [c for c in stats.columns if c != "doc_id"]
    x = stats[names].to_numpy(float)
    want = np.zeros(len(x), int)
    for i, r in reversed(list(enumerate(rules, 1))):
        want[r.covers(x, names)] = i
    got = {r.doc_id: r.rule for r in decision_list.judge(docs, labels).collect()}
    assert [got[d] for d in stats.doc_id] == want.tolist()


def test_statistics_of_plain_texts(spark):
    df = spark.createDataFrame([("The cat sat.\nThe cat sat.\nAB 12!",), (None,), ("",)], "text string")
    r = df.select(*[c.alias(k) for k, c in decision_list.statistics(F.col("text")).items()]).collect()
    assert r[0].n_words == 8 and abs(r[0].repeated_lines - 1 / 3) < 1e-9 and abs(r[0].digits - 2 / 32) < 1e-9 and abs(r[0].distinct_words - 5 / 8) < 1e-9 and r[0].shouts == 1 / 32
    assert all(v == 0 for x in r[1:] for v in x)


def test_odd_rows_are_judged(spark, documents):
    labels = spark.createDataFrame([(1, 0, 0, "x"), (1, 1, 0, "x"), (None, 0, 0, "x"), (2, None, None, "x"), (3, 9, 0, "x"), (4, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    df = documents()
    out = decision_list.judge(df, labels)
    assert out.count() == df.count()
    assert decision_list.judge(df, labels.where("false")).where("keep").count() == df.count()
    assert decision_list.judge(df.where("false"), labels).count() == 0


# ---------------------------------------------------------------- language of words
def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    k = 3
    for n in (1, 2, 5):
        emit, trans, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
        p, log_z = language_crf.forward_backward(emit, np.array([0, n]), trans, start, 2)
        want, total = np.zeros((n, k)), 0.0
        for path in itertools.product(range(k), repeat=n):
            s = math.exp(start[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += s
            for i, y in enumerate(path):
                want[i, y] += s
        assert np.allclose(p, want / total) and abs(log_z[0] - math.log(total)) < 1e-9


def test_chunks_do_not_matter():
    rng = np.random.default_rng(3)
    off = np.array([0, 0, 70, 71, 200, 200])
    emit, trans, start = rng.normal(size=(200, 4)) * 3, rng.normal(size=(4, 4)), rng.normal(size=4)
    one = language_crf.forward_backward(emit, off, trans, start, 1000)
    for size in (1, 7, 32):
        two = language_crf.forward_backward(emit, off, trans, start, size)
        assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])


def test_pair_marginals_sum_to_words():
    rng = np.random.default_rng(4)
    off = np.array([0, 5, 9])
    p, pair = language_crf._marginals(rng.normal(size=(9, 3)), off, rng.normal(size=(3, 3)), rng.normal(size=3))
    assert abs(pair.sum() - 7) < 1e-9 and np.allclose(p.sum(axis=1), 1)


def test_switched_words_are_labelled(spark, data):
    """Held-out documents, and sequences made of pieces of two languages, word by word."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang is not null and length(text) > 200")
    rows = sorted(docs.select("doc_id", "text", "lang").collect())
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    model = language_crf.fit(docs.join(spark.createDataFrame([(r.doc_id,) for r in held], "held long"), F.col("doc_id") == F.col("held"), "left_anti"))
    right = words = 0
    for a, b in zip(held, held[1:]):
        parts = []
        for r in (a, b):
            codes, uniq, _ = language_crf.word_table(pa.array([r.text]))
            parts.append([uniq[int(c)].as_py() for c in codes[:40]])
        seq, gold = parts[0] + parts[1], [a.lang] * len(parts[0]) + [b.lang] * len(parts[1])
        p, _ = language_crf.forward_backward(model.emissions(seq), np.array([0, len(seq)]), model.transitions, model.start)
        right += sum(model.labels[i] == g for i, g in zip(p.argmax(axis=1), gold))
        words += len(seq)
    assert right >= 0.9 * words
    got = {r.doc_id: r.lang_top for r in language_crf.label(docs, model).collect()}
    assert sum(got[r.doc_id] == r.lang for r in held) >= 0.9 * len(held)


def test_odd_texts_are_labelled(documents):
    df = documents()
    out = {r.doc_id: r for r in language_crf.judge(df, per_label=4).collect()}
    assert language_crf.judge(df, per_label=4).count() == df.count()
    assert all(out[d].lang_top is None and out[d].n_words == 0 and not out[d].keep for d in (20, 21, 22)) and out[23].n_words == 40_000
    kept = language_crf.accepted(df, per_label=4)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if r.keep}
    assert language_crf.judge(df.where("false")).count() == 0 and language_crf.accepted(df.where("false")).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert language_crf.judge(unlabelled).where("keep").count() == language_crf.accepted(unlabelled).count() == df.count()


def test_long_and_short_texts_are_learned_from(spark, make_text):
    rows = [(i, make_text(i, 5000) if i % 2 else " ".join(f"w\u00e4r{j % 7}e" for j in range(5 + i % 3)), ["de", "en"][i % 2]) for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert max(len(r[1]) for r in rows) > 20_000 and language_crf.fit(df).labels == ["de", "en"]
    got = {r.doc_id: r for r in language_crf.judge(df).collect()}
    assert all(got[i].keep and got[i].lang_top == lang for i, _, lang in rows) and language_crf.accepted(df).count() == 16


# ---------------------------------------------------------------- capture index
def test_keys():
    k = capture_index.url_key
    assert k("HTTPS://www.Example.com:443/A/B/?b=2&a=1#f") == "com,example)/a/b?a=1&b=2"
    assert k("http://sub.example.org:8080") == "org,example,sub:8080)/" and k("no url") == "no%20url" and k("http://[bad") == "http://[bad"
    assert k("http://ü.de/ä") == "de,%C3%BC)/%C3%A4"


def test_every_capture_is_found_again(spark, tmp_path):
    rows = [(i, f"https://h{i % 7}.example.com/p{i // 2}?z=1&a={i % 3}", f"<p>{i}</p>\r\n" * (i % 5)) for i in range(400)]
    rows += [(900 + i, "http://many.example.org/", f"copy {i}") for i in range(50)]  # a key that goes on over blocks
    rows += [(1000, "http://x.de/ü", "ü\n"), (1001, "http://x.de/null", None), (None, "http://x.de/", "a"), (1002, None, "b"), (1003, "not a url\nat all", "c"), (1000, "http://x.de/ü", "ü\n"), (1004, "http://long.de/", "y" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, offset long, key string")
    warc, cdx = f"file://{tmp_path}/w", f"file://{tmp_path}/c"
    captures = capture_index.write_warc(df, warc)
    directory = capture_index.write_index(captures, cdx, block=16)
    good = [r for r in rows if r[0] is not None and r[1] is not None]
    assert captures.count() == len(good) and directory.agg(F.sum("captures")).first()[0] == len(good)
    got = capture_index.lookup(df, directory, cdx, warc).collect()
    import hashlib

    want = sorted((capture_index.url_key(u), i, len((h or "").encode()), hashlib.md5((h or "").encode()).hexdigest()) for i, u, h in good)
    # the key of the page without an id is looked up too, and has a capture only if another page has it
    assert sorted((r.key, r.page_id, r.n_bytes, r.body_md5) for r in got) == want
    one = directory.orderBy("first").first()
    reader = capture_index.Reader(cdx, one.file)
    assert reader.lookup("zzz") == [] and reader.lookup("") == []
    some = captures.first()
    headers, body = capture_index.read_record(reader.read(f"{tmp_path}/w/{some.file}", some.offset, some.length))
    assert headers["WARC-Type"] == "response" and capture_index.url_key(headers["WARC-Target-URI"]) == some.key


def test_no_pages(spark):
    assert capture_index.build_and_look_up(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
