"""Gram scan: every text's gram keys with masks, its summary, and what kind of content it is, in one pass of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import content as C
from lexquarry.functions import grams as G
from lexquarry.functions.weights import WeightTable

SKIPPED, UNKNOWN, KNOWN = 0, 1, 2
LF, CRLF, ENDS_LF, UPPER, LOWER, DIGIT, SPACE, WORD, NON_ASCII = (1 << i for i in range(9))
SLICE = 1 << 20
EDGE = 16

SCHEMA = (
    "status tinyint, forced boolean, held binary, byte_len long, line_count int, empty_lines int, longest_line int, gram_count int, "
    "flags int, counts binary, line_start binary, line_end binary, prefix binary, suffix binary, keys array<bigint>, masks array<smallint>"
)
SUMMARY_SCHEMA = SCHEMA.rsplit(", keys", 1)[0]
_FIELDS = ["status", "forced", "held", "byte_len", "line_count", "empty_lines", "longest_line", "gram_count", "flags", "counts", "line_start", "line_end", "prefix", "suffix", "keys", "masks"]
SUMMARY_FIELDS = _FIELDS[:-2]


def _byte_flags() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for b in range(256):
        c = chr(b)
        out[b] = (LF if b == 10 else 0) | (UPPER if "A" <= c <= "Z" else 0) | (LOWER if "a" <= c <= "z" else 0) | (DIGIT if "0" <= c <= "9" else 0)
        out[b] |= (SPACE if b in (9, 10, 11, 12, 13, 32) else 0) | (WORD if b < 128 and (c.isalnum() or c == "_") else 0) | (NON_ASCII if b > 127 else 0)
    return out


_FLAGS = _byte_flags()


def classify(content: bytes | None, explicit: bool = False) -> tuple[int, bool, bytes | None, bytes]:
    """(status, forced, held bytes, bytes to scan). Nothing that a search may match is lost: what isn't scanned is a candidate
    always (forced), or kept itself (held)."""
    if content is None:
        return SKIPPED, False, None, b""
    if len(content) >= C.OVERSIZED or C.has_decoding_bom(content):
        return UNKNOWN, True, None, b""
    if content.startswith(C.UTF8_BOM):
        content = content[3:]
    prefix = C.searchable_prefix(content)
    if explicit and len(prefix) < len(content):
        return UNKNOWN, True, None, b""
    if not prefix:
        return SKIPPED, False, None, b""
    if C.has_signature(prefix) or C.is_likely_binary(prefix):
        return (UNKNOWN, False, prefix, b"") if len(prefix) <= C.HELD else (UNKNOWN, True, None, b"")
    return KNOWN, False, None, prefix


def facts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Summary facts of texts that lie end to end."""
    n = len(off) - 1
    size = np.diff(off)
    rows = np.repeat(np.arange(n), size)
    counts = np.bincount(rows * 256 + buf, minlength=n * 256).reshape(n, 256) if n else np.zeros((0, 256), np.int64)
    has = counts > 0
    flags = np.zeros(n, np.int32)
    for bit in (LF, UPPER, LOWER, DIGIT, SPACE, WORD, NON_ASCII):
        flags |= np.where(has[:, (_FLAGS & bit) > 0].any(axis=1), bit, 0).astype(np.int32)
    feeds = np.flatnonzero(buf == 10)
    feed_rows = rows[feeds] if len(feeds) else np.zeros(0, np.int64)
    crlf = feeds[(feeds > off[feed_rows]) & (buf[np.maximum(feeds - 1, 0)] == 13)] if len(feeds) else feeds
    if len(crlf):
        flags[np.unique(rows[crlf])] |= CRLF
    full = np.flatnonzero(size > 0)
    last = buf[off[1:][full] - 1] if len(full) else np.zeros(0, np.uint8)
    flags[full[last == 10]] |= ENDS_LF
    open_rows = full[last != 10]  # their last line has no feed
    stops = np.concatenate([feeds, off[1:][open_rows]])
    stop_rows = np.concatenate([feed_rows, open_rows])
    order = np.lexsort((stops, stop_rows))
    stops, stop_rows = stops[order], stop_rows[order]
    begins = off[:-1][stop_rows].copy() if len(stops) else stops
    if len(stops) > 1:
        same = stop_rows[1:] == stop_rows[:-1]
        begins[1:][same] = stops[:-1][same] + 1
    length = stops - begins
    line_count = np.bincount(stop_rows, minlength=n)
    empty = np.bincount(stop_rows[length == 0], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, stop_rows, length)
    starts, ends = np.zeros((n, 256), bool), np.zeros((n, 256), bool)
    filled = length > 0
    starts[stop_rows[filled], buf[begins[filled]]] = True
    ends[stop_rows[filled], buf[stops[filled] - 1]] = True
    bits = lambda x: np.packbits(x, axis=1, bitorder="little")
    return {"byte_len": size, "line_count": line_count, "empty_lines": empty, "longest_line": longest, "flags": flags, "counts": np.minimum(counts, 255).astype(np.uint8), "line_start": bits(starts), "line_end": bits(ends)}


def _binary(values: np.ndarray, present: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() if p else None for v, p in zip(values, present)], pa.binary())


def summarised(contents: list, explicit: list, weights: np.ndarray | None, secret: int, keep_grams: bool) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """Columns of SUMMARY_FIELDS; and row, key and mask of each text's distinct grams, sorted by row. Without weights there are no grams,
    their count is null, and no text is forced for having many."""
    kinds = [classify(c, bool(e)) for c, e in zip(contents, explicit)]
    texts = [k[3] for k in kinds]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(kinds)
    status = np.array([k[0] for k in kinds], np.int8)
    known = status == KNOWN
    f = facts(buf, off)
    g = G.extract(buf, off, weights, secret) if weights is not None else G.NO_GRAMS
    if keep_grams:
        row, key, mask = G.collapse(g, G.masks(g, buf, off))
        per = np.bincount(row, minlength=n)
    else:  # only how many different ones each text has
        by = np.lexsort((g.key, g.row))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(g.row[by]) != 0) | (g.key[by][1:] != g.key[by][:-1])
        per = np.bincount(g.row[by][new], minlength=n)
        row, key, mask = g.row[:0], g.key[:0], np.zeros(0, np.uint16)
    dense = np.array([C.is_high_entropy(int(s), int(p)) for s, p in zip(f["byte_len"], per)], bool) if n else np.zeros(0, bool)
    forced = np.array([k[1] for k in kinds], bool) | dense
    if dense.any():
        ok = ~dense[row]
        row, key, mask = row[ok], key[ok], mask[ok]
    ints = lambda name, t: pa.array(f[name].astype(t), mask=~known)
    summary = [
        pa.array(status), pa.array(forced), pa.array([k[2] for k in kinds], pa.binary()), ints("byte_len", np.int64), ints("line_count", np.int32), ints("empty_lines", np.int32),
        ints("longest_line", np.int32), pa.array(np.bincount(g.row, minlength=n).astype(np.int32), mask=~known if weights is not None else np.ones(n, bool)), ints("flags", np.int32),
        _binary(f["counts"], known), _binary(f["line_start"], known), _binary(f["line_end"], known),
        pa.array([t[:EDGE] if k else None for t, k in zip(texts, known)], pa.binary()), pa.array([t[-EDGE:] if k else None for t, k in zip(texts, known)], pa.binary()),
    ]
    return summary, row, key, mask


def _columns(contents: list, explicit: list, weights: np.ndarray, secret: int, keep_grams: bool) -> list[pa.Array]:
    summary, row, key, mask = summarised(contents, explicit, weights, secret, keep_grams)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(contents)))]).astype(np.int32)
    return [*summary, pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64))), pa.ListArray.from_arrays(pa.array(ends), pa.array(mask.view(np.int16)))]


def slices(b: pa.RecordBatch):
    """The batch in runs of rows of about SLICE bytes of content."""
    size = pc.fill_null(pc.binary_length(b["content"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return
    group = np.maximum(np.cumsum(size) - 1, 0) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, z in zip(cuts, cuts[1:]):
        yield b.slice(a, z - a)


def scan(docs: DataFrame, table: WeightTable | None, key: str = "doc_id", content: str = "text", explicit: str | None = None, secret: int = 0, grams: bool = True) -> DataFrame:
    """One row a row of docs: key, and SCHEMA. content: string or binary; explicit: a boolean column of texts named by the user.

    keys are distinct in a row, each with its joined mask. Rows of kind other than KNOWN have null facts. grams=False leaves keys
    and masks empty. table=None looks for no grams at all: gram_count is null and no text is forced for its grams' number. A null content is SKIPPED. Arrow batches are cut into runs of about a megabyte, which bounds a worker's
    memory; no text is split.
    """
    src = docs.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"), (F.col(explicit) if explicit else F.lit(False)).alias("explicit"))
    weights = docs.sparkSession.sparkContext.broadcast(np.array(table.weights) if table else None)  # 256 kB
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for p in slices(b):
                yield pa.RecordBatch.from_arrays([p["key"], *_columns(p["content"].to_pylist(), p["explicit"].to_pylist(), weights.value, secret, grams)], ["key", *_FIELDS])

    return src.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def scan_value(content: bytes, table: WeightTable, secret: int = 0) -> tuple[list[tuple[int, int, int, int]], dict] | None:
    """((start, end, key, mask) of every gram, summary) of one text; None if it is rejected as binary."""
    if C.has_signature(content) or C.is_likely_binary(content):
        return None
    buf, off = np.frombuffer(content, np.uint8), np.array([0, len(content)], np.int64)
    g = G.extract(buf, off, np.asarray(table.weights), secret)
    m = G.masks(g, buf, off)
    f = facts(buf, off)
    summary = {k: (v[0].tobytes() if v.ndim > 1 else int(v[0])) for k, v in f.items()} | {"prefix": content[:EDGE], "suffix": content[-EDGE:], "gram_count": len(g.row)}
    return sorted(zip(g.start.tolist(), g.end.tolist(), g.key.view(np.int64).tolist(), m.tolist())), summary


def postings(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """(gram, key, mask): one row for each distinct gram of each text."""
    return scanned.select(key, F.explode(F.arrays_zip("keys", "masks")).alias("g")).select(F.col("g.keys").alias("gram"), key, F.col("g.masks").alias("mask"))


def summaries(scanned: DataFrame) -> DataFrame:
    return scanned.drop("keys", "masks")


def bit_set(c: Column, byte: int) -> Column:
    """Is the byte in a 32-byte set?"""
    return F.expr(f"ascii(decode(substring({_name(c)}, {(byte >> 3) + 1}, 1), 'ISO-8859-1')) & {1 << (byte & 7)} <> 0")


def byte_count(c: Column, byte: int) -> Column:
    """A byte's count in a 256-byte histogram, 255 for that many or more."""
    return F.expr(f"ascii(decode(substring({_name(c)}, {byte + 1}, 1), 'ISO-8859-1'))")


def _name(c) -> str:
    return c if isinstance(c, str) else c._jc.toString()


def grams(docs: DataFrame, table: WeightTable, key: str = "doc_id", content: str = "text", secret: int = 0) -> DataFrame:
    """(key, start, end, gram, folded): one row for each gram at each of its places, in whole texts, without classification."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(content).cast("binary"), F.lit(bytearray())).alias("content"))
    weights = docs.sparkSession.sparkContext.broadcast(np.array(table.weights))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            size = pc.binary_length(b["content"]).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.maximum(np.cumsum(size) - 1, 0) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)] if len(size) else []
            for a, z in zip(cuts, cuts[1:]):
                p = b.slice(a, z - a)
                off = np.concatenate([[0], np.cumsum(size[a:z])]).astype(np.int64)
                g = G.extract(np.frombuffer(b"".join(p["content"].to_pylist()), np.uint8), off, weights.value, secret)
                yield pa.RecordBatch.from_arrays([p["key"].take(pa.array(g.row)), pa.array(g.start.astype(np.int32)), pa.array(g.end.astype(np.int32)), pa.array(g.key.view(np.int64)), pa.array(g.folded)], ["key", "start", "end", "gram", "folded"])

    return src.mapInArrow(run, f"key {kind}, start int, end int, gram long, folded boolean").withColumnRenamed("key", key)
