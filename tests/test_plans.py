"""Parser, translation and planner. Plans must never lose a match."""

import itertools
import random
import re

import numpy as np
import pytest

from lexquarry.functions import grams as G
from lexquarry.functions.weights import WeightTable
from lexquarry.plans import syntax
from lexquarry.plans.java import replacement, to_java
from lexquarry.plans.planner import make_plan
from lexquarry.plans.syntax import Flags, PatternError, PatternTooLong, parse
from lexquarry.plans.tree import Need, Needle, Plan

TABLE = WeightTable.synthetic()


def toy_index(docs):
    buf = np.frombuffer(b"".join(docs), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    g = G.extract(buf, off, TABLE.weights)
    row, key, mask = G.collapse(g, G.masks(g, buf, off))
    posts, summaries = {}, {}
    for r, k, m in zip(row.tolist(), key.view(np.int64).tolist(), mask.tolist()):
        posts.setdefault(k, {})[r] = m
    for i, d in enumerate(docs):
        starts, ends = bytearray(32), bytearray(32)
        for line in d.split(b"\n"):
            if line:
                starts[line[0] >> 3] |= 1 << (line[0] & 7)
                ends[line[-1] >> 3] |= 1 << (line[-1] & 7)
        summaries[i] = {
            "byte_len": len(d), "longest_line": max(map(len, d.split(b"\n"))), "counts": np.minimum(np.bincount(np.frombuffer(d, np.uint8), minlength=256), 255),
            "line_start": bytes(starts), "line_end": bytes(ends), "prefix": d[:16], "suffix": d[-16:],
        }
    return posts, summaries


def candidates(pattern, posts, summaries, flags=Flags(), lines=True):
    return set(make_plan(pattern, TABLE, flags, lines).run(lambda k: posts.get(k, {}), summaries, block=lines))


def lines_of(d):
    t = d.decode()
    parts = t.split("\n")
    return parts[:-1] if t.endswith("\n") or not t else parts


ATOMS = ["a", "b", "ab", "[ab]", "(?:a|b)", "a+", "b*", "(?:ab)+", "a?", "b{2}", "a{1,3}", "^", "$", r"\b", r"\B", "c", "abc", ".", "(?:aab|c)", "(ab|ba)"]


@pytest.mark.parametrize("fold", [False, True])
def test_no_match_is_lost(fold):
    rng = random.Random(5)
    patterns = {"".join(rng.choice(ATOMS) for _ in range(rng.randint(1, 5))) for _ in range(400)}
    docs = ["".join(x).encode() for n in range(1, 6) for x in itertools.product("abC" if fold else "abc", repeat=n)]
    docs += [a + b"\n" + b for a, b in zip(rng.sample(docs, 60), rng.sample(docs, 60))]
    posts, summaries = toy_index(docs)
    for p in patterns:
        got, java = candidates(p, posts, summaries, Flags(i=fold)), re.compile(p, re.I if fold else 0)
        for i, d in enumerate(docs):
            if any(java.search(x) for x in lines_of(d)):
                assert i in got, (p, d)


def test_whole_text_matches_are_not_lost():
    docs = [b"one two\nthree", b"three\none", b"two\nthree four\n", b"one", b"two\n\nthree"]
    posts, summaries = toy_index(docs)
    for p in (r"two\nthree", r"\Athree", r"three\z", r"(?s)one.*three", r"two\s+three"):
        got = candidates(p, posts, summaries, lines=False)
        assert {i for i, d in enumerate(docs) if re.search(p.replace(r"\z", r"\Z"), d.decode(), re.M)} <= got, p


def test_known_shapes():
    assert str(make_plan(".*", TABLE)) == "+"
    ab = make_plan("ab", TABLE)
    assert not ab.has_grams() and Need("min_len", 2) in ab.needs
    for p in (r"[^\s\S]", r"ab\bc", "foo$bar", "t\\bhe"):
        assert make_plan(p, TABLE).op == "none", p
    assert str(make_plan("x{5}", TABLE)).split(" <")[0] == str(make_plan("xxxxx", TABLE)).split(" <")[0]
    assert make_plan("h{3,5}i", TABLE).keys() == make_plan("hhhi|hhhhi|hhhhhi", TABLE).keys()
    assert make_plan("ab[cd]ef", TABLE).keys() == make_plan("abcef|abdef", TABLE).keys()


def test_near_misses_are_rejected():
    for pattern, doc in (("h{3,5}i", b"ahhi"), ("mem+set", b"memory mset here"), ("rea+d_lock", b"realized ad_lock"), ("(?i)max_file_size", b"max_ file_ size fil max")):
        posts, summaries = toy_index([doc])
        assert not candidates(pattern, posts, summaries), pattern


def test_lines_and_words_narrow():
    pad = [b"nothing here %d" % i for i in range(10)]
    far = b"alpha_gap_needle" + b"\nfiller" * 200 + b"\nomega_gap_needle"
    near = b"alpha_gap_needle and omega_gap_needle"
    posts, summaries = toy_index([far, near, *pad])
    assert 1 in candidates("alpha_gap_needle.*omega_gap_needle", posts, summaries)
    assert candidates("(?s)alpha_gap_needle.*omega_gap_needle", posts, summaries, lines=False) == {0, 1}
    posts, summaries = toy_index([b"the domain remains", b"fn main() {"])
    assert candidates(r"\bmain\b", posts, summaries) == {1}
    assert candidates("main", posts, summaries) == {0, 1}


def test_tuning_keeps_plans_sound():
    plan = Plan("and", [Needle((1,)), Needle((2,)), Needle((3,))], [], [Plan("or", [Needle((4,)), Needle((5,))])])
    df = {1: 50, 2: 5, 3: 99, 4: 60, 5: 60}.get
    tuned = plan.tuned(df, 100, 40)
    assert [n.keys for n in tuned.needles] == [(2,)] and not tuned.subs
    assert plan.estimate(df, 100) == 5
    only = Plan("and", [Needle((1,)), Needle((3,))]).tuned(df, 100, 10)
    assert [n.keys for n in only.needles] == [(1,)]


def test_parser_refuses():
    for p in ("(", ")", "[a", "a{2,1}", "*a", r"\1", "(?=a)", "(?<!a)", "(?z)", r"\p{", "a{1001}"):
        with pytest.raises(PatternError):
            parse(p)
    with pytest.raises(PatternTooLong):
        parse("a" * 5000)
    with pytest.raises(PatternError):
        parse("(" * 300 + ")" * 300)


def test_plans_stay_small():
    for p in ("(a|b|c|d|e|f){20}", "[a-z]{30}foo", "(" * 50 + "x" + ")+" * 50, "|".join(f"word{i}" for i in range(300)), "(ab?c?d?e?f?){10}"):
        assert make_plan(p, TABLE).gram_count() <= 2048


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        (r"\p{Greek}+", "αβγ", "abc"), (r"(?i)k", "\u212a", "x"), (r"(?i)straße", "STRASSE".replace("SS", "\u1e9e"), "strasse"), (r"(?-u:\w)", "a", "é"), (r"\w", "é", "-"), (r"[[:alpha:]]", "a", "1"), (r"[\w--\d]", "a", "5"),
        (r"[a-z&&[^aeiou]]", "b", "a"), (r"[a-c~~b-d]", "a", "b"), (r"(?P<x>a)b", "ab", "b"), (r"\bé", "é", "aé"), (r"[^\d\s]", "x", "7"), (r"(?x) a b # c", "ab", "a b"), (r"\x{61}\u0062", "ab", "a"), ("^$", "", "a"),
        (r"a$", "a", "ab"), (r"\<ab\>", "x ab y", "xab"), (r"(?U)a+", "aa", "b"), ("[]a]", "]", "b"), ("[^]a]", "b", "]"),
    ],
)
def test_translation(spark, pattern, yes, no):
    from pyspark.sql import functions as F

    java = to_java(parse(pattern))
    df = spark.createDataFrame([(yes,), (no,)], "t string").select(F.rlike("t", F.lit(java)).alias("m"))
    assert [r.m for r in df.collect()] == [True, False]


def test_replacement_templates(spark):
    from pyspark.sql import functions as F

    tree = parse(r"(?P<first>\w+) (\w+)")
    for template, want in (("$2 $1", "b a"), ("${first}x", "ax"), ("$$5", "$5"), ("$nope!", "!"), (r"\n", r"\n"), ("$9", "")):
        got = spark.range(1).select(F.regexp_replace(F.lit("a b"), F.lit(to_java(tree)), F.lit(replacement(template, tree)))).first()[0]
        assert got == want, template


def test_smart_case_and_inline_flags():
    assert syntax.literal_letters(parse(r"\W\w")) == (False, False)
    assert syntax.literal_letters(parse("foo")) == (True, False)
    assert syntax.literal_letters(parse("[A-Z]x")) == (True, True)
    assert syntax.folds("a(?i)b") and syntax.folds("(?i:x)") and not syntax.folds("(?-i)x") and not syntax.folds(r"\(?i")
