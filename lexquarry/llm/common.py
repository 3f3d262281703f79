"""What the training-data operators share: word splitting, hashing, written tables, components.

Words are maximal runs of characters other than ASCII white space; a null text has no words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.sources.store import fresh_path as new_path

GOLD = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES, TEXTS = 1 << 20, 1000


# ---------------------------------------------------------------- written tables
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _written(df: DataFrame, name: str, batch: int | None = None, by: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path, use = new_path(spark, name), {_CLEAN: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in use}
    try:
        for k, v in use.items():
            spark.conf.set(k, v)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: later uses neither recompute it nor depend on any executor. Once it
    is written, the shuffles that made it are removed."""
    return _written(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables that go when the context ends, or before by drop(): an operator leaves only what its result is read from."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """batch: how many rows Python gets at once; TEXTS of those with texts, which bounds a worker's memory."""
        table, path = _written(df, name, batch)
        self.paths.append((table, path))
        return table

    def folder(self, df: DataFrame, name: str, by: str) -> str:
        """The path of df, written with a folder for each value of `by`, which tasks may read by themselves."""
        path = _written(df, name, by=by)[1]
        self.paths.append((path, path))
        return path

    def drop(self, *tables: DataFrame | str) -> None:
        for _, path in [x for x in self.paths if any(x[0] is t for t in tables)]:
            delete(self.spark, path)
        self.paths = [x for x in self.paths if not any(x[0] is t for t in tables)]

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.paths])


# ---------------------------------------------------------------- decisions about rows
class _Here:
    """Which ids of a file are listed: `parts` are the list's files, sorted by (file, id), with the first and the last file in each.

    A task reads the rows of its own files only, and keeps the last one's.
    """

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts, self.last = parts, (None, None)

    def ids(self, file: int) -> np.ndarray:
        if self.last[0] != file:
            found = [np.zeros(0, np.int64)]
            for path, lo, hi in self.parts:
                if lo <= file <= hi:
                    disk, where = fs.FileSystem.from_uri(path)
                    found.append(pq.read_table(where, filesystem=disk, columns=["id"], filters=[("file", "=", file)])["id"].to_numpy())
            self.last = (file, np.sort(np.concatenate(found)))
        return self.last[1]

    def has(self, files: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        for f in np.unique(files):
            at, listed = np.flatnonzero(files == f), self.ids(int(f))
            if len(listed):
                place = np.minimum(np.searchsorted(listed, ids[at]), len(listed) - 1)
                out[at] = listed[place] == ids[at]
        return out


def _file():
    return F.xxhash64(F.input_file_name())


def _here(docs: DataFrame, ids: DataFrame) -> _Here | None:
    """Where in docs' files the ids are; None if docs come from no file."""
    with Scratch(docs.sparkSession) as tmp:
        own = docs.select(_file().alias("file"), docs["doc_id"].cast("long").alias("id")).where("id is not null")
        found = tmp.written(own.join(ids.select("id").distinct(), "id", "left_semi").select("file", "id"), "found")
        if not found.where(F.col("file") == F.xxhash64(F.lit(""))).isEmpty():
            return None
        where = written(found.repartitionByRange("file", "id").sortWithinPartitions("file", "id"), "rows")
    parts = where.groupBy(F.input_file_name().alias("path")).agg(F.min("file").alias("lo"), F.max("file").alias("hi")).collect()
    return _Here(sorted((r["path"], r["lo"], r["hi"]) for r in parts))


def rows_of(docs: DataFrame, ids: DataFrame, listed: bool = True) -> DataFrame:
    """The rows of docs whose doc_id is one of ids (column id), or, if not `listed`, is none of them; a null doc_id is none.

    No text is shuffled or goes through Python at any size. ids are brought together with (file, doc_id) of docs, which is a scan
    of one column, and are written sorted by the file of docs that they lie in; the task that reads a part of a file then looks
    up that file's ids. The driver holds one entry a file of this list. Docs that come from no file are joined.
    """
    here, own = _here(docs, ids), docs["doc_id"].cast("long")
    if here is None:
        names = ids.select(F.col("id").alias("__id")).distinct()
        return docs.join(names, own == names["__id"], "left_semi" if listed else "left_anti")

    @F.arrow_udf("boolean")
    def stays(files: pa.Array, doc_ids: pa.Array) -> pa.Array:
        null = doc_ids.is_null().to_numpy(zero_copy_only=False)
        has = here.has(files.to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~null
        return pa.array(has == listed)

    return docs.where(stays(_file(), own))


def map_rows_of(docs: DataFrame, ids: DataFrame, function, schema: str) -> DataFrame:
    """rows_of() of docs (doc_id long, text) and mapInArrow of `function` over them, by one Python worker a task."""
    here = _here(docs, ids)
    if here is None:
        return rows_of(docs, ids).mapInArrow(function, schema)

    def some(batches):
        for b in batches:
            has = here.has(b["file"].to_numpy(zero_copy_only=False), b["doc_id"].fill_null(0).to_numpy(zero_copy_only=False))
            yield b.filter(pc.and_(pa.array(has), b["doc_id"].is_valid())).drop_columns(["file"])

    return docs.select(_file().alias("file"), "doc_id", "text").mapInArrow(lambda it: function(some(it)), schema)


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; x: uint64, left as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and their inverses modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        m = 1 << max(16, n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all beginnings of a sequence; (of the end - of the begin) * inverse power of the begin is a run's."""
    up, _ = powers(len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])


def hash_strings(values: pa.Array) -> np.ndarray:
    """64 bits of each string, from its bytes."""
    values = values.cast(pa.large_string())
    _, raw, data = values.buffers()
    if data is None or not len(values):
        return np.zeros(len(values), np.uint64)
    off, data = np.frombuffer(raw, np.int64)[values.offset : values.offset + len(values) + 1], np.frombuffer(data, np.uint8)
    out = np.empty(len(values), np.uint64)
    cuts = np.searchsorted(off, np.arange(off[0], off[-1], 1 << 18))
    for lo, hi in zip(cuts, [*cuts[1:], len(values)]):  # parts of some 256 kB bound the tables of powers
        at = off[lo : hi + 1] - off[lo]
        prefix = prefix_hashes(_BYTES[data[off[lo] : off[hi]]])
        out[lo:hi] = mix((prefix[at[1:]] - prefix[at[:-1]]) * powers(len(prefix))[1][at[:-1]])
    if not len(cuts):
        out[:] = mix(np.zeros(1, np.uint64))
    return out


def rows_as_bytes(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32)), pa.py_buffer(matrix)])


def bytes_as_rows(values: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """What rows_as_bytes() made, of `width` numbers a row; no nulls."""
    parts = []
    for c in values.chunks if isinstance(values, pa.ChunkedArray) else [values]:
        size = 8 if pa.types.is_large_binary(c.type) else 4
        off = np.frombuffer(c.buffers()[1], f"i{size}")[c.offset : c.offset + len(c) + 1] if len(c) else [0, 0]
        if off[-1] > off[0]:
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return flat.view(dtype).reshape(-1, width)


def strings(values: pa.Array) -> list:
    """to_pylist() of strings or binaries, several times as fast."""
    return values.to_numpy(zero_copy_only=False).tolist()


# ---------------------------------------------------------------- words
def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """The batch in runs of rows of about `limit` bytes of text: bounds a worker's memory; no row is split or left out."""
    return slices(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64), limit)


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int):
    """The batch in runs of rows whose sizes come to about `limit`, by at most a row more; no row is split or left out."""
    if not len(sizes):
        return
    group = np.maximum(np.cumsum(sizes) - 1, 0) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)
    give_back()


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on from stage to stage, and its executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the distinct words, and where each row's words begin (one longer than the rows)."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    d = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = d.indices.to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    words = d.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        codes, offsets = drop_codes(codes, offsets, codes != empty)
    return codes, words, offsets


def drop_codes(codes: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[offsets]


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def normal_words(words: pa.Array) -> pa.Array:
    """Lower case, letters and digits only; may be empty."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}\p{N}]+", ""))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all normalised words in order, each row's offsets, and how many words, normalised or not, each row has."""
    codes, words, offsets = split_words(texts)
    counts = np.diff(offsets)
    normal = normal_words(words)
    empty = pc.equal(normal, "").to_numpy(zero_copy_only=False)
    codes, offsets = drop_codes(codes, offsets, ~empty[codes] if len(codes) else np.zeros(0, bool))
    return hash_strings(normal)[codes] if len(codes) else np.zeros(0, np.uint64), offsets, counts


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k normalised words in order, and each row's offsets. A shorter text that has words is one shingle."""
    h, offsets, _ = hashed_words(texts)
    return runs(h, offsets, k)


def runs(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of hashed words."""
    n = np.diff(offsets)
    out = np.zeros(len(h), np.uint64)
    for j in range(k):
        out *= np.uint64(0x100000001B3)
        out[: len(h) - j] += h[j:]
    position = np.arange(len(h)) - np.repeat(offsets[:-1], n)
    size = np.repeat(n, n)
    keep = position + k <= size
    short = (position == 0) & (size < k)
    for i in np.flatnonzero(short):  # these texts have fewer than k words
        v = np.uint64(0)
        for x in h[i : i + size[i]]:
            v = np.uint64((int(v) * 0x100000001B3 + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[i] = v
    out, offsets = drop_codes(out, offsets, keep | short)
    return mix(out), offsets


# ---------------------------------------------------------------- components
def _union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, the least node of its component."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            nxt = parent[parent]
            if np.array_equal(nxt, parent):
                break
            parent = nxt
        if np.array_equal(before, parent):
            return nodes, nodes[parent]


_anywhere = written


def components(edges: DataFrame, in_one_task: int = 4_000_000, tmp: Scratch | None = None) -> DataFrame:
    """(node, root) of the graph of edges (u, v); root is the least node of the component.

    Up to `in_one_task` edges a single task runs union-find. Beyond, large-star and small-star steps contract the graph
    over the cluster until nothing changes. The result is the same. It is read from tables of `tmp`, if there is one.
    """
    written = tmp.written if tmp else _anywhere
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if edges.count() <= in_one_task:

        def run(batches):
            all_ = [b for b in batches if b.num_rows]
            if all_:
                t = pa.Table.from_batches(all_)
                nodes, roots = _union_find(t["u"].to_numpy(), t["v"].to_numpy())
                for i in range(0, len(nodes), 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 20)]), pa.array(roots[i : i + (1 << 20)])], ["node", "root"])

        return edges.coalesce(1).mapInArrow(run, "node long, root long")
    last = None
    while True:
        sym = edges.union(edges.select("v", "u"))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, written(small, "edges")
        if tmp:
            tmp.drop(before)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
