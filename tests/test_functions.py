"""Weight tables, keys, grams, summaries, content kinds, paths and units, against plain loops."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.functions import content as C
from lexquarry.functions import grams as G
from lexquarry.functions import hashing as H
from lexquarry.functions import paths as P
from lexquarry.functions import weights as W
from lexquarry.operators.scan import KNOWN, SKIPPED, UNKNOWN, classify, facts, scan_value

TABLE = W.WeightTable.synthetic()


def slow_grams(s: bytes):
    out = set()
    for a in range(len(s)):
        for n in range(3, 17):
            if a + n <= len(s):
                w = [TABLE.weight(s[i], s[i + 1]) for i in range(a, a + n - 1)]
                if n == 3 or max(w[1:-1]) < min(w[0], w[-1]):
                    out.add((a, a + n))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(b"abAB \n\r_z"[x % 9] for x in b)), max_size=4))
def test_grams_equal_a_plain_loop(docs):
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    g = G.extract(np.frombuffer(b"".join(docs), np.uint8), off, TABLE.weights)
    for r, d in enumerate(docs):
        want = set()
        if d:
            s = b"\n" + d + b"\n"
            low = s.lower()
            clamp = lambda a: min(max(a - 1, 0), len(d))
            want = {(H.key_of(s[a:b]), clamp(a), clamp(b)) for a, b in slow_grams(s)}
            want |= {(H.key_of(low[a:b], H.folded()), clamp(a), clamp(b)) for a, b in slow_grams(low) if low[a:b] != s[a:b]}
        at = g.row == r
        assert set(zip(g.key[at].view(np.int64).tolist(), g.start[at].tolist(), g.end[at].tolist())) == want


def test_grams_of_a_literal_are_in_every_text_with_it():
    rng = random.Random(2)
    for _ in range(100):
        lit = bytes(rng.choice(b"abcxyz_ ") for _ in range(rng.randint(3, 30)))
        text = bytes(rng.choice(b"abcxyz_ ") for _ in range(9)) + lit + bytes(rng.choice(b"abcxyz_ ") for _ in range(9))
        have = {text[a:b] for a, b in G.literal_grams(text, TABLE.weights)}
        for a, b in G.literal_grams(lit, TABLE.weights):
            assert lit[a:b] in have
        cover = G.minimal_cover(lit, TABLE.weights)
        assert set(cover) <= set(G.maximal_grams(lit, TABLE.weights)) and cover[0][0] == 0 and cover[-1][1] == len(lit)
        assert all(x[1] > y[0] for x, y in zip(cover, cover[1:]))


def test_blocks_do_not_matter(monkeypatch):
    text = np.random.default_rng(1).integers(97, 110, 5000).astype(np.uint8)
    off = np.array([0, 5000])
    one = G.extract(text, off, TABLE.weights)
    monkeypatch.setattr(G, "BLOCK", 100)
    two = G.extract(text, off, TABLE.weights)
    assert sorted(zip(one.key.tolist(), one.start.tolist())) == sorted(zip(two.key.tolist(), two.start.tolist()))


def test_masks():
    text = b"main\nxx main_y\r\nfoo"
    grams, summary = scan_value(text, TABLE)
    by = {}
    for a, b, _, m in grams:
        by.setdefault(text[a:b], []).append(m)
    assert any(m & G.LINE_START for m in by[b"mai"]) and any(not m & G.LINE_START for m in by[b"mai"])
    assert all(not m & G.WORD_END for m in by[b"mai"])
    assert all(m & G.LINE_END for m in by[b"n_y"]) and all(m & G.LINE_END for m in by[b"foo"])
    assert summary["line_count"] == 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r", max_size=20).map(str.encode), min_size=1, max_size=4))
def test_facts_equal_a_plain_loop(docs):
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    f = facts(np.frombuffer(b"".join(docs), np.uint8), off)
    for i, d in enumerate(docs):
        lines = d.split(b"\n")
        if not d or d.endswith(b"\n"):
            lines = lines[:-1]
        assert f["line_count"][i] == len(lines)
        assert f["empty_lines"][i] == sum(not x for x in lines)
        assert f["longest_line"][i] == max(map(len, lines), default=0)
        assert bool(f["flags"][i] & 2) == (b"\r\n" in d) and bool(f["flags"][i] & 4) == d.endswith(b"\n")
        starts = {x[0] for x in lines if x}
        assert {b for b in range(256) if f["line_start"][i][b >> 3] >> (b & 7) & 1} == starts


def test_weight_table_codec():
    t = TABLE.with_provenance("from a test")
    assert W.WeightTable.from_bytes(t.to_bytes()) == t and t.version == 2 and TABLE.version == 1
    assert len(TABLE.to_bytes()) == 16 + 4 * 65536 and W.WeightTable.from_bytes(TABLE.to_bytes()) == TABLE
    good = t.to_bytes()
    for bad, error in ((good[:10], W.Truncated), (b"XXXX" + good[4:], W.BadMagic), (good[:4] + b"\7\0\0\0" + good[8:], W.BadVersion), (TABLE.to_bytes() + b"x", W.BadSize), (good[:20] + b"\xff" + good[21:], W.BadChecksum), (good + b"x", W.BadProvenance)):
        with pytest.raises(error):
            W.WeightTable.from_bytes(bad)
    with pytest.raises(W.BadProvenance):
        TABLE.with_provenance("x" * 1025)
    assert TABLE.weight(3, 4) == zlib.crc32(b"\3\4") == int(TABLE.matrix()[3, 4])


def test_minting(tmp_path):
    counts = np.zeros(65536, np.int64)
    counts[[1, 2, 3]] = 10, 5, 1
    t = W.WeightTable.from_counts(counts)
    assert [int(t.weights[i]) for i in (0, 1, 2, 3)] == [W.UNSEEN, 1, 3, 16]
    t.save(str(tmp_path / "t"))
    assert W.WeightTable.load(str(tmp_path / "t")) == t


def test_content_kinds():
    assert len(C.SIGNATURES) == 38 and C.has_signature(b"%PDF-1") and not C.has_signature(b"plain")
    assert C.is_likely_binary(b"\1\2\3abcdefg") and not C.is_likely_binary(b"\1\2\3") and not C.is_likely_binary(b"tab\tand\r\nfeeds")
    assert classify(None)[0] == SKIPPED and classify(b"")[0] == SKIPPED and classify(b"\0abc")[0] == SKIPPED
    assert classify(b"\xff\xfea\0")[:2] == (UNKNOWN, True)
    assert classify(b"\xef\xbb\xbfabc") == (KNOWN, False, None, b"abc")
    assert classify(b"abc\0def") == (KNOWN, False, None, b"abc") and classify(b"abc\0def", True)[:2] == (UNKNOWN, True)
    assert classify(b"MZ small")[:3] == (UNKNOWN, False, b"MZ small") and classify(b"MZ" + b"x" * 2000)[:2] == (UNKNOWN, True)
    assert C.is_high_entropy(4096, 6145) and not C.is_high_entropy(4096, 6144) and not C.is_high_entropy(4095, 9999)


def test_paths_and_units():
    import re

    for glob, yes, no in (("*.py", "a/b.py", "a/b.pyc"), ("src/*.c", "src/a.c", "src/x/a.c"), ("**/t/*.c", "a/b/t/x.c", "a/t.c"), ("*.{c,h}", "x/y.h", "y.hh"), ("[!a]b", "xb", "ab"), ("dir/", "x/dir/y", "x/dirs"), ("/top", "top/x", "a/top")):
        assert re.search(P.glob_regex(glob), yes) and not re.search(P.glob_regex(glob), no), glob
    assert P.normalized("/a/./b/../c//d") == "/a/c/d" and P.normalized("../x") == "../x"
    assert P.relative("a/b/c", "a") == "b/c" and P.relative("ab", "a") is None
    assert P.shared_ancestor(["a/b/c", "a/b/d", "a/b"]) == "a/b"
    assert P.parse_size("1.5 GB") == 1_500_000_000 and P.parse_size("4MiB") == 4 << 20 and P.show_bytes(1234567) == "1.23 MB" and P.show_rate(2.5e6) == "2 MB/s"
    with pytest.raises(ValueError):
        P.parse_size("ten")
    assert H.fnv1a(b"a") == 0xAF63DC4C8601EC8C
