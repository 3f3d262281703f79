"""Segments of an index: the postings of some megabytes of text, sorted by gram and packed into blocks, beside the summaries of the texts.

One pass over the texts writes them: nothing is staged, shuffled or sorted by Spark. A posting takes two to three bytes: of a gram's key
the upper 40 bits are kept (two grams that share them have postings of their own, and a look-up of either finds both: more candidates,
none lost), documents are told by their distance in the gram's list, and masks apart, as lines and edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions.weights import WeightTable
from lexquarry.operators.scan import SUMMARY_FIELDS, SUMMARY_SCHEMA, slices, summarised

POSTINGS, BLOCK = 1 << 23, 1 << 14
MOST_DOCS, MASK_BITS = 1 << 21, 10
DROPPED = 24
_SIGN = np.uint64(1 << 63)
RANGES = 64
LINES, EDGES = 31, 5
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PACKED = ["lo", "hi", "base", "n", "grams", "keys", "counts", "ids", "lines", "edges", "names"]
#: few rows a page, so that a look-up's filter on lo and hi reaches the pages of its blocks
WRITE = {"compression": "zstd", "parquet.page.row.count.limit": "8", "parquet.block.size": str(32 << 20)}


def schema(kind: str) -> str:
    """A row holds either summaries of some documents, or a block: grams lo to hi, n postings."""
    return f"docs array<struct<key {kind}, {SUMMARY_SCHEMA}>>, lo long, hi long, base long, n int, grams int, keys binary, counts binary, ids binary, lines binary, edges binary, names array<{kind}>"


def prefixes(keys: np.ndarray) -> np.ndarray:
    """The kept bits of keys, in the order of the signed keys."""
    return (np.asarray(keys, np.int64).view(np.uint64) ^ _SIGN) >> np.uint64(DROPPED)


def _pack(codec: pa.Codec, a: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest needs, first bytes first, compressed."""
    a = np.ascontiguousarray(a, "<u8")
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    return bytes([width]) + codec.compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True)


def _unpack(codec: pa.Codec, data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(codec.decompress(data[1:], n * data[0]), np.uint8).reshape(data[0], n).T
    return out.view("<u8").ravel()


class _Segment:
    """Postings of texts until there are enough of them: as they come, in 256 parts by their keys' first byte."""

    def __init__(self, integral: bool):
        self.codec, self.integral = pa.Codec("zstd", compression_level=3), integral
        self.clear()

    def clear(self) -> None:
        self.parts, self.keys, self.docs, self.size = [], [], 0, 0

    def add(self, keys: pa.Array, row: np.ndarray, key: np.ndarray, mask: np.ndarray) -> None:
        key = key ^ _SIGN
        first = (key >> np.uint64(56)).astype(np.uint8)
        order = np.argsort(first, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=256))])
        self.parts.append((bounds, key[order], (((row + self.docs) << MASK_BITS) | mask).astype(np.uint32)[order]))
        self.keys.append(keys.take(pa.array(np.arange(len(keys)))))  # a copy: a slice would hold its whole batch
        self.docs, self.size = self.docs + len(keys), self.size + len(key)

    def blocks(self):
        """Record batches of packed blocks; the segment is empty then."""
        names = pa.concat_arrays(self.keys)
        numbers = names.cast(pa.int64()).to_numpy() if self.integral and not names.null_count else None
        rank = None
        if numbers is not None and (np.diff(numbers) < 0).any():
            by = np.argsort(numbers, kind="stable")
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            numbers = numbers[by]
        left, rows = [np.zeros(0, np.uint64), np.zeros(0, np.uint32)], []
        for b in range(256):
            key, at = (np.concatenate([p[i][p[0][b] : p[0][b + 1]] for p in self.parts]) for i in (1, 2))
            if rank is not None:
                at = (rank[at >> MASK_BITS] << MASK_BITS) | (at & ((1 << MASK_BITS) - 1))
                order = np.lexsort((at, key))
            else:
                order = np.argsort(key, kind="stable")  # documents come in order
            left = [np.concatenate([x, y[order]]) for x, y in zip(left, (key, at))]
            while len(left[0]) >= BLOCK or (b == 255 and len(left[0])):
                rows.append(self._row(*(x[:BLOCK] for x in left), names, numbers))
                left = [x[BLOCK:] for x in left]
                if len(rows) == 64:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)
        self.clear()

    def _row(self, key, doc, names, numbers) -> tuple:
        doc, mask = doc >> MASK_BITS, doc & ((1 << MASK_BITS) - 1)
        new = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(new)
        kept = key[at] >> np.uint64(DROPPED)
        pack = lambda a: _pack(self.codec, a)
        base, ids, listed = None, None, None
        if numbers is None:
            listed = names.take(pa.array(doc))
        else:
            base = int(numbers[0])
            far = (numbers.view(np.uint64) - numbers.view(np.uint64)[0])[doc]
            step = np.diff(far, prepend=far[:1])
            step[at] = far[at]
            ids = pack(step)
        return int(kept[0]), int(kept[-1]), base, len(key), len(at), pack(np.diff(kept, prepend=kept[:1])), pack(np.diff(np.append(at, len(key))) - 1), ids, pack(mask & LINES), pack(mask >> EDGES), listed

    def _batch(self, rows: list[tuple]) -> list[pa.Array]:
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        out = [pa.array(c, t) for c, t in zip(cols, kinds)]
        kind = self.keys[0].type
        lists = [x if x is not None else pa.array([], kind) for x in cols[10]]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return [*out, pa.ListArray.from_arrays(pa.array(ends, mask=np.append([x is None for x in cols[10]], False)), pa.concat_arrays(lists))]


def write(docs: DataFrame, path: str, table: WeightTable, key: str, content: str, explicit: str | None = None) -> None:
    """Each task fills segments of about POSTINGS postings, of which it holds one."""
    src = docs.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"), (F.col(explicit) if explicit else F.lit(False)).alias("explicit"))
    weights = docs.sparkSession.sparkContext.broadcast(np.array(table.weights))  # 256 kB
    kind = docs.schema[key].dataType
    integral = isinstance(kind, _INTEGRAL)

    def run(batches):
        segment = _Segment(integral)
        struct = ["key", *SUMMARY_FIELDS]

        def batch(docs_col, packed, n):
            nothing = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(kind_of)]
            packed = packed or [pa.nulls(n, t) for t in nothing]
            return pa.RecordBatch.from_arrays([docs_col, *packed], ["docs", *_PACKED])

        for b in batches:
            for p in slices(b):
                summary, row, gram, mask = summarised(p["content"].to_pylist(), p["explicit"].to_pylist(), weights.value, 0, True)
                kind_of = p["key"].type
                all_ = pa.StructArray.from_arrays([p["key"], *summary], struct)
                list_of = all_.type
                yield batch(pa.ListArray.from_arrays(pa.array([0, len(all_)], pa.int32()), all_), None, 1)
                segment.add(p["key"], row, gram, mask)
                del summary, row, gram, mask, all_
                if segment.size >= POSTINGS or segment.docs >= MOST_DOCS:
                    for rows in segment.blocks():
                        yield batch(pa.nulls(len(rows[0]), pa.list_(list_of)), rows, len(rows[0]))
        if segment.size:
            for rows in segment.blocks():
                yield batch(pa.nulls(len(rows[0]), pa.list_(list_of)), rows, len(rows[0]))

    src.mapInArrow(run, schema(kind.simpleString())).write.options(**WRITE).parquet(path)


# ---------------------------------------------------------------- reading
def summaries(segments: DataFrame, key: str) -> DataFrame:
    return segments.where("docs is not null").select(F.explode("docs").alias("d")).select("d.*").withColumnRenamed("key", key)


def near(keys) -> Column:
    """Blocks in which any of the keys may be: at most RANGES conditions, which Parquet's pages are told by."""
    kept = np.unique(prefixes(sorted(keys))).astype(np.int64)
    cuts = np.sort(np.argsort(np.diff(kept))[::-1][: RANGES - 1]) + 1  # at the widest gaps
    return F.expr(" or ".join(f"(lo <= {r[-1]} and hi >= {r[0]})" for r in np.split(kept, cuts)) if len(kept) else "false")


def _blocks(segments: DataFrame, keys, columns: list[str]) -> DataFrame:
    return segments.where(F.col("n").isNotNull() if keys is None else F.col("n").isNotNull() & near(keys)).select(*columns)


def _grams(codec, r: dict, wanted: np.ndarray | None, full: np.ndarray | None):
    """(gram, does it count, postings of each) of a block, more than once where keys that are looked up share what is kept of them."""
    kept = np.uint64(r["lo"]) + np.cumsum(_unpack(codec, r["keys"], r["grams"]), dtype=np.uint64)
    counts = _unpack(codec, r["counts"], r["grams"]).astype(np.int64) + 1
    if wanted is None:
        yield ((kept << np.uint64(DROPPED)) ^ _SIGN).view(np.int64), np.ones(len(kept), bool), counts
        return
    a, z = np.searchsorted(wanted, kept), np.searchsorted(wanted, kept, "right")
    for i in range(int((z - a).max())):
        ok = z - a > i
        yield full[np.minimum(a + i, len(full) - 1)], ok, counts


def _looked_up(keys) -> tuple[np.ndarray | None, np.ndarray | None]:
    if keys is None:
        return None, None
    full = np.array(sorted({int(k) for k in keys}), np.int64)
    return prefixes(full), full


def postings(segments: DataFrame, key: str, kind: str, keys=None) -> DataFrame:
    """(gram, key, mask) of the keys that are looked up, or of all, whose grams are told by what is kept of them: the lower DROPPED
    bits are 0."""
    wanted, full = _looked_up(keys)

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            for r in b.to_pylist():
                for gram, ok, counts in _grams(codec, r, wanted, full):
                    if not ok.any():
                        continue
                    hit = np.repeat(ok, counts)
                    mask = (_unpack(codec, r["lines"], r["n"]) | (_unpack(codec, r["edges"], r["n"]) << np.uint64(EDGES)))[hit]
                    if r["ids"] is None:
                        ids = pa.array(r["names"], b.schema.field("names").type.value_type).filter(pa.array(hit))
                    else:
                        step = _unpack(codec, r["ids"], r["n"])
                        far = np.cumsum(step, dtype=np.uint64)
                        at = np.cumsum(counts) - counts
                        far -= np.repeat(far[at] - step[at], counts)
                        ids = pa.array((far[hit] + np.int64(r["base"]).view(np.uint64)).view(np.int64)).cast(b.schema.field("names").type.value_type)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gram[ok], counts[ok])), ids, pa.array(mask.astype(np.int16))], ["gram", "key", "mask"])

    return _blocks(segments, keys, [c for c in _PACKED if c != "hi"]).mapInArrow(run, f"gram long, key {kind}, mask smallint").withColumnRenamed("key", key)


def frequencies(segments: DataFrame, keys=None) -> DataFrame:
    """(gram, df): postings of each key in all segments together."""
    wanted, full = _looked_up(keys)

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            for r in b.to_pylist():
                for gram, ok, counts in _grams(codec, r, wanted, full):
                    yield pa.RecordBatch.from_arrays([pa.array(gram[ok]), pa.array(counts[ok])], ["gram", "df"])

    return _blocks(segments, keys, ["lo", "grams", "keys", "counts"]).mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def by_mask(segments: DataFrame) -> DataFrame:
    """(mask, n): postings with each mask. Each task counts in one array."""

    def run(batches):
        codec, total = pa.Codec("zstd"), np.zeros(1024, np.int64)
        for b in batches:
            for r in b.to_pylist():
                mask = _unpack(codec, r["lines"], r["n"]) | (_unpack(codec, r["edges"], r["n"]) << np.uint64(EDGES))
                total += np.bincount(mask.astype(np.int64), minlength=1024)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int16)), pa.array(total[at])], ["mask", "n"])

    return _blocks(segments, None, ["n", "lines", "edges"]).mapInArrow(run, "mask smallint, n long").groupBy("mask").agg(F.sum("n").alias("n"))
