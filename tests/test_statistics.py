"""Byte-pair statistics, quotas, shards, files and streams."""

import gzip
import json

import numpy as np
import pytest

from lexquarry.functions.weights import WeightTable
from lexquarry.operators import bigrams, quotas
from lexquarry.operators.search import SearchOptions, search
from lexquarry.sources import files, shards, store
from lexquarry.streaming import maintain


def test_pairs_do_not_span_values(spark):
    df = spark.createDataFrame([("ab", bytearray(b"xy"), ("cd",), 1), (None, None, (None,), 2), ("", bytearray(b"z"), ("abab",), 3)], "a string, b binary, s struct<t: string>, n int")
    got = {(r.c1, r.c2): r.cnt for r in bigrams.pair_counts(df).collect()}
    want = {}
    for v in ("ab", "xy", "cd", "abab"):
        for x, y in zip(v, v[1:]):
            want[(ord(x), ord(y))] = want.get((ord(x), ord(y)), 0) + 1
    assert got == want
    assert bigrams.pair_counts(df.where("false"), "a").count() == 0
    assert tuple(bigrams.totals(df, "a").first()) == (1, 2, 2)


def test_mint_equals_the_table(spark):
    df = spark.createDataFrame([("hello world", 1), ("hello", 2)], "text string, n int")
    counter = bigrams.PairCounter()
    counter.add(df, "text")
    assert counter.pairs == 14 and counter.bytes == 16 and counter.values == 2 and counter.count(ord("l"), ord("l")) == 2
    again = bigrams.PairCounter.restore(counter.snapshot())
    again.merge(counter)
    again.add_value(b"ll")
    assert again.count(ord("l"), ord("l")) == 5
    assert WeightTable.from_frame(bigrams.mint(bigrams.pair_counts(df, "text"))) == WeightTable.from_counts(counter.counts)
    w = WeightTable.from_counts(counter.counts)
    assert WeightTable.from_frame(w.frame(spark)) == w
    with pytest.raises(ValueError):
        bigrams.PairCounter.restore(b"x")


def test_divergence(spark):
    df = spark.createDataFrame([("abcabcabc",)], "text string")
    counts = bigrams.pair_counts(df, "text")
    kl = bigrams.divergence(counts, bigrams.mint(counts)).first().kl
    c = np.zeros(65536)
    for x, y in zip(b"abcabcabc", b"bcabcabc"):
        c[x * 256 + y] += 1
    p = (c + 1) / (c + 1).sum()
    w = np.where(c > 0, c.sum() // np.maximum(c, 1), 2**32 - 1)
    q = np.where(w >= 2**32 - 1, 1e-15, 1 / w + 1e-15)
    q /= q.sum()
    assert abs(kl - (p * np.log(p / q)).sum()) < 1e-6
    assert bigrams.contributors(counts, bigrams.mint(counts), 2).count() == 4


def test_byte_prefix_stops_at_the_first_row_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 6, "a"), (3, 1, "a"), (4, 3, "b"), (5, None, "b")], "i int, size int, g string")
    assert [r.i for r in quotas.byte_prefix(df, 10, "size", ["i"]).collect()] == [1]
    assert {r.i for r in quotas.byte_prefix(df, 10, "size", ["i"], ["g"]).collect()} == {1, 4, 5}


def test_weighted_order_keeps_to_the_ceilings():
    all_ = [quotas.Shard(f"{f}{s}{i}", 10, f, f + s) for f in "xy" for s in "ab" for i in range(20)]
    ledger = quotas.Ledger()
    order = quotas.WeightedOrder(all_, {"x": 300, "y": 100}, {s: 1000 for s in ("xa", "xb", "ya", "yb")}, ledger)
    took = []
    while (i := order.next()) is not None:
        took.append(all_[i])
        ledger.add(all_[i], 10)
        ledger.finish(all_[i])
    assert ledger.family_bytes == {"x": 300, "y": 100}
    assert [s.source for s in took if s.family == "x"][:4] == ["xa", "xb", "xa", "xb"]
    assert abs(sum(s.family == "x" for s in took[:12]) - 9) <= 1
    again = quotas.WeightedOrder(all_, {"x": 300, "y": 100}, {s: 1000 for s in ("xa", "xb", "ya", "yb")}, quotas.Ledger(), order.state())
    assert again.at == order.at


def test_shard_layouts(spark, tmp_path):
    nested = spark.createDataFrame([("r", [("x = 1", "py", False, 5), (None, "c", True, 9)]), ("q", [("y", None, True, 1)])], "repo string, files array<struct<content: string, language: string, is_vendor: boolean, size_bytes: long>>")
    nested.write.parquet(str(tmp_path / "n"))
    got = shards.read(spark, [str(tmp_path / "n")], shards.Layout("nested"))
    assert sorted(r.content for r in got.collect()) == ["x = 1", "y"]
    assert {(r.language, r.bytes) for r in shards.language_bytes(got).collect()} == {("py", 5), ("unknown", 1)}
    assert tuple(shards.vendor_files(got).first()) == (1, 2)
    spark.createDataFrame([("a", 1), (None, 2)], "Body string, n int").write.parquet(str(tmp_path / "c"))
    assert [r.content for r in shards.read(spark, [str(tmp_path / "c")], shards.Layout("column", "Body")).collect()] == ["a"]
    with pytest.raises(ValueError):
        shards.read(spark, [str(tmp_path / "c")], shards.Layout("column", "text"))
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write("\n".join([json.dumps({"text": "one"}), json.dumps({"text": 5}), json.dumps({"other": 1}), json.dumps({"text": None}), "broken", json.dumps({"text": "two\nlines"})]))
    assert sorted(r.content for r in shards.read(spark, [str(tmp_path / "s.jsonl.gz")], shards.Layout("jsonl", "text")).collect()) == ["one", "two\nlines"]


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("x") from TimeoutError()
        return 5

    waits = []
    assert shards.with_retries(flaky, sleep=waits.append) == 5 and waits == [2.0, 4.0]
    with pytest.raises(KeyError):
        shards.with_retries(lambda: {}["x"], sleep=waits.append)


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"import os\n")
    (tmp_path / "a" / "y.txt").write_bytes(b"\xff\xfe" + "wide import".encode("utf-16-le"))
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"inside import"))
    (tmp_path / ".hidden").write_bytes(b"import")
    (tmp_path / "bin").write_bytes(b"ab\0import")
    root = str(tmp_path)
    names = lambda **k: {r.path for r in files.paths(files.walk(spark, root, **k)).collect()}
    assert names() == {"a/x.py", "a/y.txt", "z.gz", "bin"} and ".hidden" in names(hidden=True)
    assert names(types=["py"]) == {"a/x.py"} and names(globs=["!*.gz"]) == {"a/x.py", "a/y.txt", "bin"} and names(max_depth=1) == {"z.gz", "bin"}
    assert names(max_size=10) == {"a/x.py", "bin"} and names(ignore=["# c", "*.txt", "bin"]) == {"a/x.py", "z.gz"} and names(globs=["*.py"], explicit=["bin"]) == {"a/x.py", "bin"}
    text = files.as_text(files.decompressed(files.walk(spark, root)))
    assert {r.path for r in search(text, SearchOptions("import", mode="files_with_matches"), "path").collect()} == {"a/x.py", "a/y.txt", "z.gz"}
    assert {r.path for r in text.where("is_binary").collect()} == {"bin"}
    up = files.preprocessed(files.walk(spark, root), ["tr", "a-z", "A-Z"], ["*.py"])
    assert {r.path for r in search(files.as_text(up), SearchOptions("IMPORT", mode="files_with_matches"), "path").collect()} == {"a/x.py"}
    assert {r.path for r in files.histogram_files(files.walk(spark, root), cap=10).collect()} == {"a/x.py"}
    assert files.type_list(spark).where("type = 'rust'").first().globs == ["*.rs"]


def test_manifest_differences(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, c string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, c string")
    got = {(r.path, r.change) for r in maintain.differences(maintain.manifest(old, content="c"), maintain.manifest(new, content="c")).collect()}
    assert got == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_ledger_refresh_and_fold(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} needle{i % 3}") for i in range(60)], "doc_id long, text string")
    root = str(tmp_path / "ix")
    ledger = maintain.Ledger(spark, str(tmp_path / "dirty"), "doc_id")
    assert ledger.rows().count() == 0 and ledger.heard_at() == 0
    ix = maintain.refresh(lambda: docs, root, WeightTable.synthetic(), ledger)
    changed = docs.where("doc_id < 4")
    changed.write.parquet(str(tmp_path / "in"))
    maintain.watch(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), ledger, str(tmp_path / "cp")).awaitTermination()
    now = docs.where("doc_id >= 4").union(spark.createDataFrame([(0, "changedneedle"), (1, "changedneedle")], docs.schema))
    o = SearchOptions("changedneedle", mode="files_with_matches")
    assert {r.doc_id for r in maintain.fresh_search(now, ix, ledger, o).collect()} == {0, 1}
    ledger.append(changed, 0)  # comes again
    assert ledger.rows().count() == 4 and ledger.covers(0) and not ledger.covers(9e18)
    again = maintain.refresh(lambda: now, root, WeightTable.synthetic(), ledger)
    assert again.path != ix.path and ledger.last_batch() == -1
    assert maintain.refresh(lambda: now, root, WeightTable.synthetic(), ledger).path == again.path


def test_counts_of_a_stream_are_exactly_once(spark, tmp_path):
    df = spark.createDataFrame([("abc",), ("bcd",)], "text string")
    state = maintain.CountState(spark, str(tmp_path / "s"), "corpus 1")
    state.append(df, 0, "text")
    state.append(df, 0, "text")
    state.append(df, 1, "text")
    assert {(r.c1, r.c2): r.cnt for r in state.counts().collect()}[(98, 99)] == 4
    with pytest.raises(ValueError):
        maintain.CountState(spark, str(tmp_path / "s"), "corpus 2")
    assert store.read_json(str(tmp_path / "s" / "BINDING")) == "corpus 1"


def test_rates_are_those_of_a_window_and_take_more_than_one_task(spark, capsys):
    rows = [(i, None if i % 11 == 0 else float(i * 7 % 40) / 2, None if i % 5 == 0 else i % 4) for i in range(200)] + [(900, 500.0, None)]
    df = spark.createDataFrame(rows, "i long, s double, n long").selectExpr("i", "timestamp_micros(cast(s * 1e6 as long) + 1700000000000000) as ts", "n")
    got = maintain.windowed_rate(df, "ts", "n", 3)
    t = lambda x: 1_700_000_000 + x
    first, nothing = min(t(s) for _, s, _ in rows if s is not None), [n for _, s, n in rows if s is None and n is not None]
    for r in got.collect():
        s = next(s for i, s, _ in rows if i == r.i)
        window = nothing if s is None else [n for _, x, n in rows if x is not None and n is not None and s - 3 <= x <= s]
        every = nothing if s is None else nothing + [n for _, x, n in rows if x is not None and n is not None and x <= s]
        assert (r.rate, r.average) == (sum(window) / 3 if window else None, sum(every) / (1.0 if s is None else max(t(s) - first, 1.0)))
    assert got.count() == len(rows) and got.columns == [*df.columns, "rate", "average"]
    fractions = maintain.windowed_rate(df.withColumn("n", df.n.cast("double")), "ts", "n", 3)
    assert sorted(map(tuple, fractions.select("i", "rate", "average").collect())) == sorted(map(tuple, got.select("i", "rate", "average").collect()))
    got.explain()
    assert "rangeframe" not in capsys.readouterr().out.lower()


def test_pairs_of_large_batches_take_little_memory():
    """Counting a whole batch at once took 8 bytes and more a byte of text."""
    import tracemalloc

    import pyarrow as pa

    words = [b"ab" * 150_000, b"", b"xyz" * 100_000, b"q"] * 25
    values = pa.array(words, pa.binary())
    want = np.zeros(65536, np.int64)
    for w in words:
        b = np.frombuffer(w, np.uint8).astype(np.int64)
        want += np.bincount(b[:-1] * 256 + b[1:], minlength=65536)
    tracemalloc.start()
    got = bigrams._counts_of(values)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and most < sum(map(len, words))


@pytest.mark.parametrize("parts", [1, 8])
def test_streamed_texts_lie_in_as_many_files_as_they_are_read_in(spark, data, tmp_path, monkeypatch, parts):
    """They were brought into four files, each of which one task read and wrote."""
    from lexquarry import queries

    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.repartition(parts).write.parquet(str(tmp_path / "d" / "documents.parquet"))
    monkeypatch.setattr(queries.store, "fresh_path", lambda s, n: str(tmp_path / n))
    monkeypatch.setattr(queries, "table", lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet").repartition(parts))
    got = queries.QUERIES["stream_bigram_counts"](spark, str(tmp_path / "d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bigrams.pair_counts(docs, "text").collect()))
    assert len(list((tmp_path / "stream" / "in").glob("part-*"))) == max(4, parts)
    assert len(store.folders(str(tmp_path / "stream" / "state"))) == 4
