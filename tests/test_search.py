"""Search modes over small tables, and indexed search against the scan."""

import re

import pytest

from lexquarry.functions.weights import WeightTable
from lexquarry.operators import index
from lexquarry.operators.search import SearchOptions as S
from lexquarry.operators.search import search
from lexquarry.plans.syntax import NeedsNewline, PatternError

TEXTS = {
    1: "alpha\nbeta gamma\nalpha beta\n", 2: "", 3: None, 4: "no match here", 5: "Alpha\n\nALPHA alpha alpha\nlast", 6: "für dich\nalpha\r\nomega", 7: "été alphaé", 8: "\n\n", 9: "x" * 300 + "alpha",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def lines(t):
    parts = (t or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def hits(p, flags=0, invert=False):
    return [(d, i, x) for d, t in TEXTS.items() for i, x in enumerate(lines(t), 1) if bool(re.search(p, x, flags)) != invert]


def test_lines_and_their_modes(docs):
    for p in ("alpha", "a$", "^al", "alpha|beta", "[a-c]+", "^$"):
        want = hits(p)
        assert rows(search(docs, S(p))) == sorted(want), p
        assert {r[0] for r in rows(search(docs, S(p, mode="files_with_matches")))} == {h[0] for h in want}
        assert {r[0] for r in rows(search(docs, S(p, mode="files_without_match")))} == set(TEXTS) - {h[0] for h in want}
        assert dict(rows(search(docs, S(p, mode="count")))) == {d: sum(h[0] == d for h in want) for d in {h[0] for h in want}}
        assert search(docs, S(p, mode="quiet")).first()[0] is True
        n = {d: sum(len(re.findall(p, x)) for x in lines(t)) for d, t in TEXTS.items()}
        assert dict(rows(search(docs, S(p, mode="count_matches")))) == {d: c for d, c in n.items() if c}
        assert rows(search(docs, S(p, invert=True))) == sorted(hits(p, invert=True))
        assert dict(rows(search(docs, S(p, mode="count", include_zero=True)))) == {d: sum(h[0] == d for h in want) for d in TEXTS}
    assert search(docs, S("zz", mode="quiet")).first()[0] is False


def test_each_match_and_places(docs):
    got = rows(search(docs, S("[Aa]lpha", mode="only_matching", byte_offset=True)).select("doc_id", "line_no", "col", "byte_offset", "match"))
    want = []
    for d, t in TEXTS.items():
        at = 0
        for i, x in enumerate(lines(t), 1):
            for m in re.finditer("[Aa]lpha", x):
                b = len(x[: m.start()].encode())
                want.append((d, i, b + 1, at + b, m.group()))
            at += len(x.encode()) + 1
    assert got == sorted(want)
    assert rows(search(docs, S("a", mode="vimgrep")).select("doc_id", "line_no", "col")) == sorted((d, i, len(x[: m.start()].encode()) + 1) for d, t in TEXTS.items() for i, x in enumerate(lines(t), 1) for m in re.finditer("a", x))
    assert rows(search(docs, S("é", column=True)).select("col")) == [(1,)]


def test_options(docs):
    ids = lambda **k: {r[0] for r in search(docs, S(mode="files_with_matches", **k)).collect()}
    assert ids(patterns="alpha", ignore_case=True) == {1, 5, 6, 7, 9}
    assert ids(patterns="alpha", smart_case=True) == {1, 5, 6, 7, 9} and ids(patterns="Alpha", smart_case=True) == {5}
    assert ids(patterns="alpha", word=True) == {1, 5, 6}
    assert ids(patterns="alpha", whole_line=True) == {1} and ids(patterns="alpha", whole_line=True, crlf=True) == {1, 6}
    assert ids(patterns=("beta", "für")) == {1, 6} and ids(patterns="a.p", fixed=True) == set()
    assert ids(patterns="gamma\\nalpha", multiline=True) == {1} and ids(patterns="(?s)alpha.*gamma", multiline=True) == {1}
    assert ids(patterns="a", invert=True) == {5, 8, 4, 6} - {4, 6} | {d for d, _, _ in hits("a", invert=True)}
    assert rows(search(docs, S("alpha", max_count=1)))[0] == (1, 1, "alpha") and search(docs, S("alpha", max_count=0)).count() == 0
    assert [r[1] for r in rows(search(docs.where("doc_id = 1"), S("a", stop_on_nonmatch=True)))] == [1, 2, 3]
    assert [r[1] for r in rows(search(docs.where("doc_id = 1"), S("^alpha", stop_on_nonmatch=True)))] == [1]
    assert rows(search(docs.where("doc_id = 1"), S("(al)(pha)", replace="$2-$1"))) == [(1, 1, "pha-al"), (1, 3, "pha-al beta")]
    assert rows(search(docs.where("doc_id = 9"), S("alpha", max_columns=20))) == [(9, 1, "[Omitted long matching line]")]
    with pytest.raises(NeedsNewline):
        S(r"a\nb").tree()
    with pytest.raises(PatternError):
        S("(").tree()
    with pytest.raises(ValueError):
        S("a", mode="nothing")


def test_context_blocks(spark):
    df = spark.createDataFrame([(1, "\n".join("hit" if i in (3, 5, 12) else f"l{i}" for i in range(1, 15)))], "doc_id long, text string")
    got = rows(search(df, S("hit", before=1, after=1)).select("line_no", "is_match", "block"))
    assert got == [(2, False, 1), (3, True, 1), (4, False, 1), (5, True, 1), (6, False, 1), (11, False, 2), (12, True, 2), (13, False, 2)]


def test_clashing_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a\nb", 5, "x")], "doc_id long, text string, line_no long, line string")
    assert rows(search(df, S("b"))) == [(1, 2, "b")]


def test_null_data(spark):
    df = spark.createDataFrame([(1, "a\nb\0cc\0")], "doc_id long, text string")
    assert rows(search(df, S("c", null_data=True)).select("line_no", "line")) == [(2, "cc")]


PATTERNS = [
    "license", "thble", "nicht", r"[0-9]{3}-[0-9]{4}", r"[0-9]+\.[0-9]+\.[0-9]+", "(?i)LICENSE", "^The", r"\bthe\b", "für [a-z]+", "zzqxpassword", "(thing|attion)er?", "the.*of", "[A-Z]{3,}", r"e\.$", "^$", "ü", "a+b+", "q[^u]", r"\p{Lu}\p{Ll}{9,}",
]


@pytest.fixture(scope="module")
def indexed(spark, data, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000_001, "%PDF license held"), (10_000_002, "BM" + " long license text" * 100), (10_000_003, None), (10_000_004, ""), (10_000_005, "license\r\nthe\r\n")], "doc_id long, text string")
    docs = docs.union(extra)
    return docs, index.build(docs, root, WeightTable.synthetic()), root


@pytest.mark.parametrize("force", [True, False])
def test_index_finds_what_a_scan_finds(indexed, force):
    docs, ix, _ = indexed
    used = 0
    for p in PATTERNS:
        for extra in ({}, {"word": True}, {"ignore_case": True}, {"multiline": True}, {"crlf": True}):
            o = S(p, mode="files_with_matches", **extra)
            d = index.decide(ix, o, force)
            if force or not extra and d.reason is None:
                used += d.reason is None
                assert {r[0] for r in index.indexed_search(docs, ix, o, force).collect()} == {r[0] for r in search(docs, o).collect()}, (p, extra)
    assert used >= 5


def test_index_in_all_modes(indexed):
    docs, ix, _ = indexed
    for p, extra in (("license", {}), ("nicht", {"word": True}), ("LICENSE", {"ignore_case": True}), ("license", {"crlf": True}), (r"license\s+", {"multiline": True})):
        for mode in ("count", "count_matches", "files_without_match", "lines"):
            o = S(p, mode=mode, **extra)
            assert rows(index.indexed_search(docs, ix, o, True)) == rows(search(docs, o)), (p, extra, mode)
        o = S(p, mode="count", include_zero=True, **extra)
        assert rows(index.indexed_search(docs, ix, o, True)) == rows(search(docs, o))


def test_none_plans_and_decisions(indexed):
    docs, ix, _ = indexed
    assert index.decide(ix, S("foo$bar")).plan.op == "none" and index.indexed_search(docs, ix, S("foo$bar")).count() == 0
    assert index.decide(ix, S(".*")).reason and index.decide(ix, S("license", invert=True)).reason and index.decide(None, S("license")).reason == "no index"
    assert index.decide(ix, S("zzqxpassword")).reason is None


def test_generations(spark, indexed):
    docs, ix, root = indexed
    again = index.build(docs.limit(5), root, WeightTable.synthetic())
    assert again.path != ix.path and index.open_index(spark, root).total == 5
    from lexquarry.sources import store

    index.build(docs.limit(4), root, WeightTable.synthetic())
    assert len([f for f in store.folders(root) if f.startswith("gen-")]) == 2
    store.write_text(f"{root}/CURRENT", "gen-nowhere")
    assert index.open_index(spark, root) is None


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ix = index.build(docs, str(tmp_path / "i"), WeightTable.synthetic())
    assert index.indexed_search(docs, ix, S("abc", mode="count"), True).count() == 0 and search(docs, S("abc")).count() == 0


def test_columns_where_texts_hold_record_separators(spark):
    """Byte columns and offsets by Python's own regex, for texts that hold what stands for a match inside."""
    import re

    texts = ["a\x1eb 12 cc 34\n\x1e\x1e7", "12\x1e", "no \x1e digit", "plain 5 and 67\nü 8"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((d, n, len(line[: m.start()].encode()) + 1, m[0]) for d, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1) for m in re.finditer("[0-9]+", line))
    got = search(df, S("[0-9]+", mode="only_matching")).collect()
    assert sorted((r.doc_id, r.line_no, r.col, r.match) for r in got) == want
    assert sorted((r.doc_id, r.line_no, r.col) for r in search(df, S("[0-9]+", mode="vimgrep")).collect()) == [w[:3] for w in want]
    offsets = sorted((d, len(t[: m.start()].encode())) for d, t in enumerate(texts) for m in re.finditer("[0-9]+", t))
    assert sorted((r.doc_id, r.byte_offset) for r in search(df, S("[0-9]+", mode="only_matching", byte_offset=True)).collect()) == offsets
    assert sorted((r.doc_id, r.byte_offset) for r in search(df, S("[0-9]+", mode="lines", multiline=True)).collect()) == offsets


def test_context_offsets_and_stop_move_no_line(spark, capsys):
    df = spark.createDataFrame([(1, "a\nx\nb\nc\nd\nx\nx\ne"), (2, "q"), (3, None), (4, "x"), (5, "x\n\nx\n")], "doc_id long, text string")
    found = search(df, S("x", before=1, after=1))
    assert sorted(map(tuple, found.select("doc_id", "line_no", "line", "is_match", "block").collect())) == sorted(
        [(1, 1, "a", False, 1), (1, 2, "x", True, 1), (1, 3, "b", False, 1), (1, 5, "d", False, 2), (1, 6, "x", True, 2), (1, 7, "x", True, 2), (1, 8, "e", False, 2), (4, 1, "x", True, 1), (5, 1, "x", True, 1), (5, 2, "", False, 1), (5, 3, "x", True, 1)]
    )
    offset = search(df, S("x", byte_offset=True))
    assert sorted((r.doc_id, r.byte_offset) for r in offset.collect()) == [(1, 2), (1, 10), (1, 12), (4, 0), (5, 0), (5, 3)]
    stop = search(df, S("x", stop_on_nonmatch=True))
    assert sorted((r.doc_id, r.line_no) for r in stop.collect()) == [(1, 2), (4, 1), (5, 1)]
    for plan in (found, offset, stop):
        plan.explain()
        assert "Exchange" not in capsys.readouterr().out


def test_lookups_of_many_keys_name_each_key(spark, tmp_path, capsys):
    from lexquarry.plans.compile import among

    spark.range(2000).selectExpr("id as gram").write.parquet(str(tmp_path / "p"))
    keys = list(range(0, 1000, 40))
    found = spark.read.parquet(str(tmp_path / "p")).where(among("gram", keys))
    found.explain("formatted")
    shown = capsys.readouterr().out
    assert shown.count("In(gram") >= 3 or shown.count("In(") >= 3
    assert sorted(r.gram for r in found.collect()) == keys and spark.range(5).withColumnRenamed("id", "gram").where(among("gram", [])).count() == 0
