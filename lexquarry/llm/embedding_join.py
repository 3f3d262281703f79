"""Near-duplicate embeddings: rotated vectors in tiles of a tree, low-dimensional distances first, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import Scratch, _union_find, bytes_as_rows, components, rows_as_bytes, written

COSINE, BLOCK = 0.95, 8
SCALE, SPLIT, MODEL, APART = 32_767, 8192, 1 << 21, 5  # of numbers in 16 bits; rows of a tile; numbers of the sample; see _near()


def rotation(dim: int, covariance: np.ndarray | None = None, seed: int = 3) -> np.ndarray:
    """An orthogonal matrix: the principal axes, the strongest first; without a covariance a seeded random one."""
    if covariance is None:
        return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    _, axes = np.linalg.eigh(covariance)
    return axes[:, ::-1]


def shares(variance: np.ndarray, block: int) -> list[tuple[int, int, float]]:
    """(first, last, share of the squared distance) of each block: in proportion to the variance that it holds; sums to 1."""
    parts = [(a, min(a + block, len(variance))) for a in range(0, len(variance), block)]
    weight = np.array([max(variance[a:b].sum(), 1e-12) for a, b in parts])
    return [(a, b, float(w)) for (a, b), w in zip(parts, weight / weight.sum())]


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, scaled to length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int16)


def _tree(q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of a complete tree's nodes, root at 1: each halves its part of a sample where that is the widest."""
    axis, cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    todo = [(1, np.arange(len(q)))]
    while todo:
        node, at = todo.pop()
        if node < len(axis) and len(at) > 1:
            axis[node] = np.argmax(q[at].astype(np.float32).var(axis=0))
            y = q[at, axis[node]]
            cut[node] = np.median(y)
            todo += [(2 * node, at[y < cut[node]]), (2 * node + 1, at[y >= cut[node]])]
    return axis, cut


def _leaf(q: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node, rows = np.ones(len(q), np.int64), np.arange(len(q))
    for _ in range(len(axis).bit_length() - 1):
        node = 2 * node + (q[rows, axis[node]] >= cut[node])
    return node - len(axis)


def _boxes(axis: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest numbers that a leaf may have, on the axes that the tree cuts."""
    used, place = np.unique(axis[1:], return_inverse=True)
    lo = np.full((2 * len(axis), len(used)), -np.inf, np.float32)
    hi = -lo
    for node in range(1, len(axis)):
        lo[2 * node : 2 * node + 2], hi[2 * node : 2 * node + 2] = lo[node], hi[node]
        hi[2 * node, place[node - 1]] = lo[2 * node + 1, place[node - 1]] = cut[node]
    return lo[len(axis) :], hi[len(axis) :]


def _pairs(x: np.ndarray, y: np.ndarray, prefix: int, limit: float):
    """(i, j, squared distance) of the rows i of x and j of y within `limit`, i < j if they are one table. Numbers are 16-bit and
    sums of integers, whatever the order of rows. Most pairs are told by their first `prefix` numbers."""
    # one product gives |x|^2 + |y|^2 - 2xy; its 32 bits err by less than the margin, and what is left is counted in integers
    left, right = ((z[:, :prefix] / SCALE).astype(np.float32) for z in (x, y))
    left = np.concatenate([left, (left * left).sum(axis=1, keepdims=True), np.ones((len(x), 1), np.float32)], axis=1)
    right = np.ascontiguousarray(np.concatenate([-2 * right, np.ones((len(y), 1), np.float32), (right * right).sum(axis=1, keepdims=True)], axis=1).T)
    margin = np.float32(limit / SCALE**2 + 1e-5)
    for at in range(0, len(x), 256):
        for to in range(at if x is y else 0, len(y), 2048):
            some = left[at : at + 256] @ right[:, to : to + 2048]
            i, j = np.divmod(np.flatnonzero(some <= margin), some.shape[1])
            i, j = at + i, to + j
            if x is y:
                i, j = i[i < j], j[i < j]
            for lo in range(0, len(i), 1 << 14):
                i_, j_ = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                diff = x[i_].astype(np.float64) - y[j_]
                d = np.einsum("ij,ij->i", diff, diff)
                yield i_[d <= limit], j_[d <= limit], d[d <= limit]


def _compare(one: tuple, two: tuple, prefix: int, limit: float, budget: float, slack: float) -> pa.RecordBatch:
    """What two tiles (node, rep, q), or one with itself, have in common: (a, b, n). n > 0: vector a has n near ones here; n = 0: ids
    a and b are near, only as many such pairs as connect what is near; n = -1: vectors a and b are so close to the limit that the
    whole ones must tell."""
    begin = 0 if one is two else len(one[0])
    node, rep = one[:2] if one is two else (np.concatenate(c) for c in zip(one[:2], two[:2]))
    links, forest, unsure = np.zeros(len(node), np.int64), np.arange(len(node)), [np.zeros((2, 0), np.int64)]
    for i, j, d in _pairs(one[2], two[2], prefix, limit):
        j = begin + j
        far = np.sqrt(d) / SCALE
        near, edge = far + slack <= np.sqrt(budget), far - slack <= np.sqrt(budget)
        unsure.append(np.stack([node[i[edge & ~near]], node[j[edge & ~near]]]))
        if near.any():
            links += np.bincount(np.concatenate([i[near], j[near]]), minlength=len(node))
            nodes, roots = _union_find(np.concatenate([forest[i[near]], i[near]]), np.concatenate([i[near], j[near]]))
            forest[nodes] = roots
    some, apart, unsure = links > 0, forest != np.arange(len(node)), np.concatenate(unsure, axis=1)
    a, b = np.concatenate([node[some], rep[apart], unsure[0]]), np.concatenate([node[some], rep[forest[apart]], unsure[1]])
    n = np.concatenate([links[some], np.zeros(apart.sum(), np.int64), np.full(unsure.shape[1], -1)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])


def _tile(path: str, number: int, dim: int) -> tuple:
    disk, where = fs.FileSystem.from_uri(f"{path}/tile={number}")
    if disk.get_file_info(where).type == fs.FileType.NotFound:  # no row fell to this part of a leaf
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim), np.int16)
    t = pq.read_table(where, filesystem=disk, columns=["node", "rep", "q"], partitioning=None)
    return t["node"].to_numpy(), t["rep"].to_numpy(), bytes_as_rows(t["q"], np.int16, dim)


def _near(src: DataFrame, n: int, dim: int, cosine: float, block: int, tmp: Scratch) -> DataFrame | None:
    """What _compare() finds among the n different vectors of src (id, node, second, v), all of one dimension, the exact comparisons
    made. A pair is first compared by as many blocks as set vectors at random sqrt(APART) times as far apart as the limit."""
    if n < 2:
        return None
    sample = src.where(F.pmod("second", F.lit(max(1, n * dim // MODEL))) == 0).dropDuplicates(["node", "second"]).select("node", "v").toArrow().sort_by("node")
    sample = _units(sample["v"].combine_chunks(), dim)
    covariance = np.cov(sample.T, bias=True) if len(sample) > 1 else np.eye(dim)
    axes = rotation(dim, covariance)
    budget = 2 - 2 * cosine + 1e-9
    slack = 1.01 * np.sqrt(dim) / SCALE + 1e-6  # of numbers rounded to 1 / SCALE
    limit = np.ceil(((np.sqrt(budget) + slack) * SCALE) ** 2)
    variance = np.maximum(np.diag(axes.T @ covariance @ axes), 0)
    parts = shares(variance, block)
    held = np.cumsum([share for _, _, share in parts]) * 2 * variance.sum()
    prefix = parts[min(np.searchsorted(held, APART * budget), len(parts) - 1)][1]
    tree = _tree(_rounded(sample @ axes), max(0, (n - 1) // SPLIT).bit_length())

    def placed(batches):
        for b in batches:
            for part in (b.slice(at, 2000) for at in range(0, b.num_rows, 2000)):
                q = _rounded(_units(part["v"], dim) @ axes)
                yield pa.RecordBatch.from_arrays([part["id"], part["node"], part["second"], pa.array(_leaf(q, *tree).astype(np.int32)), rows_as_bytes(q)], ["id", "node", "second", "leaf", "q"])

    rows = src.select("id", "node", "second", "v").mapInArrow(placed, "id long, node long, second int, leaf int, q binary")
    rows = tmp.written(rows.groupBy("node", "second").agg(F.min("id").alias("rep"), F.first("leaf").alias("leaf"), F.first("q").alias("q")), "rows")
    leaves = sorted(map(tuple, rows.groupBy("leaf").count().collect()))
    several = np.array([-(-count // SPLIT) for _, count in leaves])  # tiles of a leaf
    begin = np.cumsum(several) - several
    names = src.sparkSession.createDataFrame([(leaf, int(k), int(at)) for (leaf, _), k, at in zip(leaves, several, begin)], "leaf int, several int, begin int")
    tiled = rows.join(F.broadcast(names), "leaf").select((F.col("begin") + F.pmod("node", "several")).cast("int").alias("tile"), "node", "rep", "q")
    path = tmp.folder(tiled.repartition("tile"), "tiles", "tile")
    tmp.drop(rows)
    tiles = int(several.sum())
    lo, hi = (x[np.repeat([leaf for leaf, _ in leaves], several)] for x in _boxes(*tree))
    # tile i meets those up to half the way round after it, and itself; a unit is one tile and `step` of these
    step = max(1, tiles // 64)
    units = -(-(tiles // 2 + 1) // step)

    def meet(batches):
        own = (-1, None)
        for b in batches:
            for i, k in zip(*(x.tolist() for x in np.divmod(b["id"].to_numpy(), units))):
                away = np.arange(k * step, min((k + 1) * step, tiles // 2 + 1))
                away = away[(2 * away < tiles) | (i < tiles // 2)]  # what is half the way round meets once
                others = (i + away) % tiles
                gap = np.maximum(np.maximum(lo[i] - hi[others], lo[others] - hi[i]), 0).astype(np.float64)
                for j in others[(gap * gap).sum(axis=1) <= limit].tolist():
                    if own[0] != i:
                        own = (i, _tile(path, i, dim))
                    found = _compare(own[1], own[1] if i == j else _tile(path, j, dim), prefix, limit, budget, slack)
                    if found.num_rows:
                        yield found

    found = src.sparkSession.range(0, tiles * units, 1, min(tiles * units, 1024)).mapInArrow(meet, "a long, b long, n long")
    found = tmp.written(found, "found")
    tmp.drop(path)
    told, unsure = found.where("n >= 0"), found.where("n = -1").select("a", "b")
    if unsure.isEmpty():
        return told
    whole = src.join(unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").groupBy("node", "second").agg(F.min("id").alias("rep"), F.first("v").alias("v"))

    def scaled(batches):
        for b in batches:
            v = _units(b["v"], dim)
            yield pa.RecordBatch.from_arrays([b["node"], b["rep"], pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.ravel()))], ["node", "rep", "v"])

    whole = tmp.written(whole.select("node", "rep", "v").mapInArrow(scaled, "node long, rep long, v array<double>"), "whole")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    left, right = (whole.select(F.col("node").alias(x), F.col("rep").alias(f"r{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
    exact = tmp.written(unsure.join(left, "a").join(right, "b").where(dot >= cosine).select("a", "b", "ra", "rb"), "exact")
    tmp.drop(whole)
    one = F.lit(1).cast("long")
    return told.union(exact.select("a", "a", one)).union(exact.select("b", "b", one)).union(exact.select("ra", "rb", F.lit(0).cast("long")))


def near_classes(table: DataFrame, cosine: float = COSINE, block: int = BLOCK, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, class_id, class_size, n_links, n_copies), one row for each id: its class of near-duplicates, told by its least id,
    how many different vectors are near to its own (a cosine of at least `cosine`), and how many other ids have an equal vector.
    Ids without any are a class of their own. Equal vectors are joined as one, and no pairs are listed, so that groups of
    thousands cost their comparisons alone, while every link between different vectors counts.

    cosine >= c means squared distance <= 2 - 2c of vectors of length 1. Vectors are rotated, rounded to 16 bits and written once, in
    tiles of some SPLIT rows: leaves of a tree over the principal axes, those of more rows in parts. Tasks read pairs of tiles
    from the shared folder, those whose boxes are within the distance, so that a vector is shuffled twice at any
    size, and those near the limit once more; what is compared grows with the square of the rows, less what the boxes spare. A pair is told by the strongest blocks
    of axes, which hold less than the whole distance, then by all numbers, and by the whole vectors where 16 bits can't tell.

    Null vectors and ids, vectors of length 0, with nulls, NaN or infinite numbers are left out. Vectors are compared with those of
    their dimension. Repeated rows of one id and vector are one; an id with several vectors has the links and copies of each, and
    is in one class with all of them; an empty table gives no rows; other columns aren't looked at.
    """
    kind = "float" if dict(table.dtypes)[vector] == "array<float>" else "double"
    src = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    src = src.where("id is not null and v is not null and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    # two hashes stand for a vector; adding 0 makes -0 and 0 one
    src = src.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind))).withColumns({"node": F.xxhash64("v"), "second": F.hash("v")})
    with Scratch(table.sparkSession) as tmp:
        own = tmp.written(src.select("id", "node", "second", F.size("v").alias("d")).distinct(), "own")
        firsts = own.groupBy("node", "second").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        whose = tmp.written(own.join(firsts, ["node", "second"]).select("id", "node", "rep", (F.col("copies") - 1).alias("copies")), "whose")
        sizes = own.groupBy("d").agg(F.countDistinct("node", "second").alias("n")).orderBy("d").collect()
        found = [_near(src.where(F.size("v") == r["d"]), r["n"], r["d"], cosine, block, tmp) for r in sizes]
        edges, links = whose.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")), None
        for f in found:
            if f is not None:
                edges = edges.union(f.where("n = 0").select("a", "b"))
                links = f.where("n > 0").select("a", "n") if links is None else links.union(f.where("n > 0").select("a", "n"))
        counts = whose.select("id", "copies", F.lit(0).cast("long").alias("n"))
        if links is not None:
            counts = counts.union(whose.join(links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "node").select("id", F.lit(0).cast("long"), "n"))
        counts = written(counts.groupBy("id").agg(F.sum("n").cast("int").alias("n_links"), F.sum("copies").cast("int").alias("n_copies")), "links")
        classes = written(components(edges, tmp=tmp), "classes")
    sizes = classes.groupBy("root").agg(F.count("*").cast("int").alias("size"))
    told = counts.join(classes.join(sizes, "root"), F.col("id") == F.col("node"), "left")
    return told.select(F.col("id").alias("vec_id"), F.coalesce("root", "id").alias("class_id"), F.coalesce("size", F.lit(1)).alias("class_size"), "n_links", "n_copies")
