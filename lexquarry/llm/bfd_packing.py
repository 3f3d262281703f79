"""Token ids packed into rows of one length by best-fit decreasing, with a segment tree over the rows' free places."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import text_slices
from lexquarry.llm.tokens import END, VOCABULARY, encode

LENGTH, GROUP = 2048, 8_000_000


class CapacityTree:
    """Rows by their free places: the least number of free places that is at least n, in log steps."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves < most + 1:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i //= 2

    def take(self, n: int) -> tuple[int, int] | None:
        """Free places and number of the fullest row with at least n free, which leaves the tree."""
        i = n + self.leaves
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        free = i - self.leaves
        row = self.rows[free].pop()
        if not self.rows[free]:
            self.any[i] = 0
            i //= 2
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i //= 2
        return free, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces in each row; every size is from 1 to length. Longest first, of equal ones the first first."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([i])
            free, row = length - sizes[i], len(rows) - 1
        else:
            rows[found[1]].append(i)
            free, row = found[0] - sizes[i], found[1]
        if free:
            tree.add(free, row)
    return rows


SCHEMA = "part int, row int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<bigint>, starts array<int>"


def pack_ids(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int = END) -> list[tuple]:
    """Packs documents' ids: (n_tokens, ids, positions, cumulative lengths, doc_ids, starts) a row.

    A document longer than a row is cut into whole rows and a rest; `starts` tells where in its document each segment begins.
    Positions begin at 0 in each segment, and in the padding.
    """
    pieces = [(d, s, ids[s : s + length]) for d, ids in docs for s in range(0, len(ids), length)]
    out = []
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        parts = [pieces[i] for i in row]
        ids = np.full(length, pad, np.uint16)
        positions = np.zeros(length, np.uint16)
        ends = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])]).astype(np.int32)
        for p, at in zip(parts, ends):
            ids[at : at + len(p[2])] = p[2]
            positions[at : at + len(p[2])] = np.arange(len(p[2]))
        positions[ends[-1] :] = np.arange(length - ends[-1])
        out.append((int(ends[-1]), ids.astype("<u2").tobytes(), positions.astype("<u2").tobytes(), ends, [p[0] for p in parts], [p[1] for p in parts]))
    return out


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """Packed rows of all documents' token ids: SCHEMA; every document's ids end with the end-of-text id.

    input_ids and position_ids are `length` little-endian 16-bit numbers; cu_seqlens has where each segment begins and, last,
    how many ids are no padding; doc_ids and starts tell what document each segment is of and from where in it.
    Each task packs its own rows in groups of about `group` ids, so that nothing is shuffled and memory is bounded. part is the
    task; (part, row) is unique. length: up to 65,536.

    Null and empty texts have no tokens and are in no row; null doc_ids stay null; repeated rows are packed each; an empty
    table gives no rows; other columns aren't looked at.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size, row = [], 0, 0

        def flush():
            nonlocal size, row
            rows = pack_ids(held, length)
            held.clear()
            size = 0
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                n, ids, positions, ends, names, starts = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int32()), pa.array(np.arange(row, row + len(some), dtype=np.int32)), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(positions, pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))],
                    ["part", "row", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"],
                )
                row += len(some)

        for batch in batches:
            for p in text_slices(batch):
                ids, offsets = encode(p.column("text"), vocabulary)
                for d, a, b in zip(p.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    if b > a:
                        held.append((d, np.append(ids[a:b], np.uint16(END))))
                        size += b - a + 1
                if size >= group:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Writes packed rows as binary files, one a task: NAME.ids and NAME.pos are matrices of 16-bit numbers, NAME.cu has for each
    row the number of its cumulative lengths and these, as 32-bit numbers. Returns (name, rows); files of tasks that failed are
    in no row of it."""

    def run(batches):
        import uuid

        disk, root = fs.FileSystem.from_uri(path)
        disk.create_dir(root, recursive=True)
        name, rows, out = uuid.uuid4().hex, 0, None
        for b in batches:
            if b.num_rows:
                out = out or [disk.open_output_stream(f"{root}/{name}.{x}") for x in ("ids", "pos", "cu")]
                out[0].write(b"".join(b["input_ids"].to_pylist()))
                out[1].write(b"".join(b["position_ids"].to_pylist()))
                out[2].write(b"".join(struct.pack(f"<{len(c) + 1}i", len(c), *c) for c in b["cu_seqlens"].to_pylist()))
                rows += b.num_rows
        if out:
            for o in out:
                o.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["name", "rows"])

    return packed.select("input_ids", "position_ids", "cu_seqlens").mapInArrow(run, "name string, rows long")


def read_matrices(path: str, name: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    disk, root = fs.FileSystem.from_uri(path)
    read = lambda x: disk.open_input_stream(f"{root}/{name}.{x}").read()
    cu, flat = [], np.frombuffer(read("cu"), "<i4")
    at = 0
    while at < len(flat):
        cu.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + flat[at]
    return np.frombuffer(read("ids"), "<u2").reshape(-1, length), np.frombuffer(read("pos"), "<u2").reshape(-1, length), cu
