"""SuperMinHash groups, suffix levels and the embedding join, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lexquarry.llm import embedding_join, suffix_levels, superminhash
from lexquarry.llm.common import _union_find, components, shingles, split_words


# ---------------------------------------------------------------- SuperMinHash
def one_by_one(elements, m):
    """The published loop over elements, with the early stop, on the module's random numbers."""
    h = [None] * m
    q, p = [-1] * m, list(range(m))
    b, a = [0] * m, m - 1
    b[m - 1] = m
    for i, e in enumerate(elements):
        j = 0
        while j <= a:
            f, k = superminhash._draw(np.array([e], np.uint64), j, m)
            f, k = int(f[0]), int(k[0])
            if q[j] != i:
                q[j], p[j] = i, j
            if q[k] != i:
                q[k], p[k] = i, k
            p[j], p[k] = p[k], p[j]
            if h[p[j]] is None or f < h[p[j]]:
                old = m - 1 if h[p[j]] is None else min(h[p[j]] >> 32, m - 1)
                h[p[j]] = f
                if j < old:
                    b[old] -= 1
                    b[j] += 1
                    while b[a] == 0:
                        a -= 1
            j += 1
    return h


def test_signatures_equal_the_one_by_one_algorithm():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40, 300):
        e = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert superminhash.signatures(e, np.array([0, n]), 32)[0].tolist() == one_by_one(e.tolist(), 32)


def test_signatures_estimate_jaccard_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        both, own = 30, 15
        x = rng.integers(0, 1 << 63, both + 2 * own).astype(np.uint64)
        t = superminhash.signatures(np.concatenate([x[: both + own], x[:both], x[both + own :]]), np.array([0, both + own, 2 * (both + own)]), 64)
        errors.append((t[0] == t[1]).mean() - both / (both + 2 * own))
    assert abs(np.mean(errors)) < 0.02
    assert np.mean(np.square(errors)) < 0.95 * 0.25 / 64


def brute_groups(texts, threshold):
    sets = {}
    for d, t in texts:
        if d is None or not t:
            continue
        sh, _ = shingles(pa.array([t], pa.string()), 3)
        if len(sh):
            sets.setdefault(d, []).append(frozenset(sh.tolist()))
    pairs = [(x, y) for x, y in itertools.combinations(sorted(sets), 2) if any(len(p & q) >= threshold * len(p | q) for p in sets[x] for q in sets[y])]
    if not pairs:
        return {}, pairs
    nodes, roots = _union_find(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    return dict(zip(nodes.tolist(), roots.tolist())), pairs


def changed(text, share, seed, words):
    rng, w = random.Random(seed), text.split()
    for i in rng.sample(range(len(w)), int(share * len(w))):
        w[i] = rng.choice(words) + "x"
    return " ".join(w)


def test_groups_equal_brute_force(spark, documents, make_text, words):
    extra = [(100 + i, changed(make_text(i % 4, 120), 0.04, i, words), "en", "s", 1) for i in range(24)]
    extra += [(200 + i, "Same  Words, here\tagain and again", "en", "s", 1) for i in range(30)] + [(300, make_text(2, 120).upper(), "en", "s", 1)]
    df = documents(extra)
    got = {r.doc_id: (r.group_id, r.group_size, r.keep) for r in superminhash.near_groups(df).collect()}
    want, _ = brute_groups([(r.doc_id, r.text) for r in df.collect()], superminhash.THRESHOLD)
    assert {d: g for d, (g, _, _) in got.items()} == want
    assert all(keep == (d == g) for d, (g, _, keep) in got.items())
    kept = superminhash.keep_one_each(df)
    assert kept.columns == df.columns
    left = [r.doc_id for r in kept.collect()]
    assert set(left) == {r.doc_id for r in df.collect()} - {d for d, g in want.items() if d != g} and None in left


def test_candidates_are_found_near_the_threshold(spark, make_text, words):
    rows = []
    for i in range(60):
        t = make_text(1000 + i, 200)
        rows += [(2 * i, t), (2 * i + 1, changed(t, 0.10, i, words))]
    want, pairs = brute_groups(rows, superminhash.THRESHOLD)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in superminhash.near_groups(df).collect()}
    assert len(got & set(want)) >= 0.9 * len(want) and got <= set(want)


def test_empty_tables(no_documents):
    assert superminhash.near_groups(no_documents).count() == 0 and superminhash.keep_one_each(no_documents).count() == 0
    assert suffix_levels.repeats(no_documents).count() == 0


@pytest.mark.parametrize("limit", [10, 4_000_000])
def test_components(spark, limit):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), limit).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    nodes, roots = _union_find(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert got == dict(zip(nodes.tolist(), roots.tolist()))


# ---------------------------------------------------------------- repeated passages
def brute_repeats(rows, long):
    where: dict = {}
    for d, t in rows:
        if d is None:
            continue
        w = split_words(pa.array([t], pa.string()))
        tokens = [w[1][int(c)].as_py() for c in w[0]]
        for s in range(len(tokens) - long + 1):
            where.setdefault(tuple(tokens[s : s + long]), set()).add((d, s))
    starts: dict = {}
    for spots in where.values():
        ids = sorted({d for d, _ in spots})
        if len(ids) > 1:
            for d, s in spots:
                lo, hi = starts.setdefault(d, {}).get(s, (ids[0], ids[-1]))
                starts[d][s] = min((lo, hi), (ids[0], ids[-1]))
    out = []
    for d, found in starts.items():
        for s in sorted(found):
            if s - 1 in found:
                continue
            e = s
            while e + 1 in found:
                e += 1
            out.append((d, s, e + long, e + long - s, *found[s]))
    return sorted(out)


@pytest.mark.parametrize("filter_keys", [16_000_000, 0])
def test_repeats_equal_brute_force(spark, documents, make_text, monkeypatch, filter_keys):
    monkeypatch.setattr(suffix_levels, "FILTER_KEYS", filter_keys)
    passage, other = make_text(500, 70), make_text(501, 55)
    extra = [(100, f"{make_text(1, 30)} {passage} {make_text(2, 20)}", "en", "s", 1), (101, f"{passage} {make_text(3, 80)}", "en", "s", 1), (102, f"{make_text(4, 10)}\n\n{passage}", "en", "s", 1)]
    extra += [(110 + i, f"{make_text(50 + i, 15)} {other} {make_text(70 + i, 15)}", "en", "s", 1) for i in range(6)] + [(130, make_text(6, 49), "en", "s", 1), (131, make_text(6, 49), "en", "s", 1), (132, passage + " " + passage, "en", "s", 1)]
    df = documents(extra)
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id != 23]
    got = sorted(tuple(r) for r in suffix_levels.repeats(df.where("doc_id <> 23 or doc_id is null")).collect())
    assert got == brute_repeats(rows, suffix_levels.LONG)
    assert any(r[0] == 100 and r[3] >= 70 for r in got) and not any(r[0] in (130, 131) for r in got)


def test_levels_merge_geometrically(spark):
    family = suffix_levels.Levels()
    sizes = []
    for i in range(6):
        df = spark.createDataFrame([(k, i) for k in range(i, i + 3)], "key long, doc_id long")
        found = {r.key for r in family.add(df).collect()}
        assert found == ({i, i + 1} if i else set()) if i else found == set()
        sizes.append([s for s, _, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]


def test_filter_tells_of_every_key(spark):
    keys = [(i * 7919 - 5_000,) for i in range(3000)]
    f = suffix_levels.Filter.of(spark.createDataFrame(keys, "key long"), 3000)
    assert f.has(np.array(keys, np.int64)[:, 0]).all()
    assert f.has(np.arange(10**12, 10**12 + 20_000)).mean() < 0.1


# ---------------------------------------------------------------- embeddings
def brute_classes(rows, cosine):
    """{id: (class, size, links, copies)}; an id with several vectors has those of each."""
    vectors: dict = {}
    for i, v in rows:
        if i is not None and v and not any(x is None or x != x for x in v) and any(v):
            vectors.setdefault(tuple(v), set()).add(i)
    unit = {v: np.array(v) / np.linalg.norm(v) for v in vectors}
    links, edges = dict.fromkeys(vectors, 0), [(min(ids), i) for ids in vectors.values() for i in ids]
    for x, y in itertools.combinations(vectors, 2):
        if len(x) == len(y) and unit[x] @ unit[y] >= cosine:
            links[x] += 1
            links[y] += 1
            edges.append((min(vectors[x]), min(vectors[y])))
    nodes, roots = _union_find(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    root = dict(zip(nodes.tolist(), roots.tolist()))
    size = {r: list(root.values()).count(r) for r in root.values()}
    return {i: (root[i], size[root[i]], sum(links[v] for v in vectors if i in vectors[v]), sum(len(ids) - 1 for ids in vectors.values() if i in ids)) for i in root}


@pytest.mark.parametrize("split", [8192, 40])
def test_classes_equal_brute_force(spark, monkeypatch, split):
    """Groups of near and of equal vectors, some at the very limit, other dimensions, ids with several vectors, cells in parts."""
    monkeypatch.setattr(embedding_join, "SPLIT", split)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 20] + rng.normal(scale=s, size=16)).astype(np.float32).tolist()) for i, s in enumerate(np.linspace(0.01, 0.5, 80))]
    rows += [(700 + i, (base[3] + rng.normal(scale=0.1, size=16)).astype(np.float32).tolist()) for i in range(90)]
    x, y = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    rows += [(600, x.tolist())] + [(601 + i, (np.cos(a) * x + np.sin(a) * y).tolist()) for i, a in enumerate(np.arccos(0.95) + np.linspace(-1e-4, 1e-4, 9) + 1e-6)]
    rows += [(300 + i, base[7].tolist()) for i in range(25)] + [(5, base[5].tolist()), (5, base[9].tolist()), (400, None), (None, base[1].tolist()), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0, 2.0]), (404, [1.0, 2.1]), (405, [-2.0, 1.0]), (406, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, k int, cell string, a int").repartition(5)
    got = {r.vec_id: (r.class_id, r.class_size, r.n_links, r.n_copies) for r in embedding_join.near_classes(df).collect()}
    want = brute_classes(rows, embedding_join.COSINE)
    assert got == want and sum(w[2] for w in want.values()) > 2000 and max(w[1] for w in want.values()) > 60 and got[403][:3] == (403, 2, 1)


def test_no_vector_is_shuffled_many_times(spark, monkeypatch):
    """At sixteen tiles or more, the shuffles take less than four times the vectors; classes are as by brute force."""
    monkeypatch.setattr(embedding_join, "SPLIT", 100)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1000, 64)).astype(np.float32)
    v[900:] = v[0] + rng.normal(scale=0.02, size=(100, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = embedding_join.written(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), "vectors")

    def shuffled():
        return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = shuffled()
    got = {r.vec_id: (r.class_id, r.class_size, r.n_links, r.n_copies) for r in embedding_join.near_classes(df).collect()}
    times = (shuffled() - before) / v.nbytes
    print("shuffled, times the vectors", times)
    assert got == brute_classes(rows, embedding_join.COSINE) and got[0] == (0, 101, 100, 0) and 0 < times < 4


def test_budgets_are_shared_in_proportion_and_sum_to_the_whole():
    parts = embedding_join.shares(np.array([4.0, 2.0, 1.0, 1.0]), 2)
    assert [p[:2] for p in parts] == [(0, 2), (2, 4)] and [p[2] for p in parts] == [0.75, 0.25]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_join.near_classes(df).count() == 0
    one = embedding_join.near_classes(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in one] == [(1, 1, 1, 0, 0)]
