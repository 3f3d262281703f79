"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import GOLD, TEXTS, Scratch, components, map_rows_of, mix, row_of, rows_of, shingles, text_slices, written

SLOTS, ROWS, SHINGLE, THRESHOLD = 144, 4, 3, 0.5
LOW = np.uint64(0xFFFFFFFF)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _draw(seed: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Each element's j-th random number (32 bits, after j) and its place among the slots j..m-1."""
    x = mix(seed + np.uint64((j + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
    place = ((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)
    return (x & LOW) | np.uint64(j << 32), place.astype(np.int64) + j


def signatures(elements: np.ndarray, offsets: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each row's elements: one row of m values (rank << 32 | fraction) a row; of no elements, all ones.

    Every element walks through its own random permutation of the slots: in step j it offers rank j plus a random fraction to
    the j-th slot of the permutation. A row is over as soon as all its slots hold ranks up to j: later steps can't lower any.
    All rows' elements take a step together; minima don't depend on the order, so that the values are those of the
    one-by-one algorithm.
    """
    rows = len(offsets) - 1
    values = np.full(rows * m, NONE, np.uint64)
    base = row_of(offsets) * m
    fraction, slot = _draw(elements, 0, m)
    np.minimum.at(values, base + slot, fraction)
    table = values.reshape(rows, m)
    open_rows = (table == NONE).any(axis=1)
    live = open_rows[base // m] if len(base) else np.zeros(0, bool)
    elements, base, slot = elements[live], base[live], slot[live]
    if not len(elements):
        return table
    order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    at = np.arange(len(elements))
    order[at, slot], order[at, 0] = order[at, 0].copy(), order[at, slot].copy()
    for j in range(1, m):
        fraction, place = _draw(elements, j, m)
        slot = order[at, place].copy()
        order[at, place] = order[at, j]
        order[at, j] = slot
        np.minimum.at(values, base + slot, fraction)
        open_rows = (table == NONE).any(axis=1)
        live = open_rows[base // m]
        n = int(live.sum())
        if not n:
            break
        if n < 0.8 * len(live):
            elements, base, order = elements[live], base[live], order[live]
            at = np.arange(n)
    return table


def bands(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of `rows` slots, with the band's number in it."""
    n, m = table.shape
    parts = table.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for i in range(rows):
        out = mix(out * np.uint64(31) + parts[:, :, i])
    return out.view(np.int64)


def _band_rows(batches, m, rows, k):
    for batch in batches:
        for part in text_slices(batch):
            sh, offsets = shingles(part.column("text"), k)
            has = np.diff(offsets) > 0
            n = np.diff(offsets)
            # the same shingles in the same order: the same words
            weight = mix(sh + (np.arange(len(sh), dtype=np.uint64) - np.repeat(offsets[:-1], n).astype(np.uint64)) * GOLD)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight, dtype=np.uint64)])
            whole = mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)).view(np.int64)[has]
            b = bands(signatures(sh, offsets, m), rows)[has]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.size + 1, b.shape[1], dtype=np.int32)), pa.array(b.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(pa.array(has)), pa.array(whole), lists], ["doc_id", "whole", "bands"])


def _sets(batches, k):
    for batch in batches:
        for part in text_slices(batch):
            sh, offsets = shingles(part.column("text"), k)
            sh = (sh >> np.uint64(32)).astype(np.uint32).view(np.int32)
            sets = [np.unique(sh[a:b]) for a, b in zip(offsets, offsets[1:])]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "sh"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have that Jaccard similarity."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a").join(b, "b")
        .withColumn("both", both)
        .where(F.col("both") >= threshold * (F.size("sa") + F.size("sb") - F.col("both")))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _apart(members: DataFrame, roots: DataFrame, tmp: Scratch) -> DataFrame:
    """(bucket, lo, hi, root, id) of the documents of the buckets that hold documents of different roots."""
    labelled = members.select("bucket", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    labelled = tmp.written(labelled, "labelled")
    apart = labelled.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2")
    out = tmp.written(labelled.join(apart.select("bucket", "lo", "hi"), "bucket").select("bucket", "lo", "hi", "root", "id"), "apart")
    tmp.drop(labelled)
    return out


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of every document in a group of at least two; one row a document.

    Two documents are near if the Jaccard similarity of their sets of k-word shingles (letters and digits, lower case) is at
    least `threshold`; groups are the connected parts; group_id is the least doc_id, and only that document has keep.
    Candidates share a band of `rows` of the `slots` SuperMinHash values (at the defaults a pair at the threshold is found with
    90 %, at 0.6 with 99 %). Documents of the same words are one from the start. Each document is first compared with the least
    one of the largest bucket that it is in; then, in buckets that still hold different groups, with the least and the greatest;
    then all pairs that are in different groups even so: thousands of copies cost no more than their number while no candidate
    is left out. In the exact comparison, 32-bit hashes stand for shingles.

    A null, empty or wordless text is in no group; rows without doc_id are left out; rows that repeat a doc_id are one
    document with all their texts; an empty table gives no rows; other columns are not looked at.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    with Scratch(docs.sparkSession) as tmp:
        sig = tmp.written(src.mapInArrow(lambda it: _band_rows(it, slots, rows, k), "doc_id long, whole long, bands array<long>"), "bands", TEXTS)
        # distinct texts
        first = sig.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"))
        first = tmp.written(first, "firsts")
        same = tmp.written(
            sig.select("whole", "doc_id").join(first.where("doc_id <> last").select("whole", F.col("doc_id").alias("rep")), "whole")
            .where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")),
            "same",
        )
        tmp.drop(sig)
        # buckets: the documents that share a band. Bands often have the same ones, told by their number and the sum of their
        # hashes; one band stands for all of these. Sums are partial before the shuffle, so that no band's documents are one row
        banded = first.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
        shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(id))").alias("x")).where("n > 1")
        shared = tmp.written(shared.groupBy("n", "x").agg(F.min("band").alias("band")).select("band", "n"), "shared")
        members = tmp.written(banded.join(shared, "band").select(F.col("band").alias("bucket"), "n", "id"), "members")
        tmp.drop(first, shared)
        sets = map_rows_of(src, members.select("id"), lambda it: _sets(it, k), "doc_id long, sh array<int>").where(F.size("sh") > 0)
        sets = tmp.written(sets, "sets", TEXTS)
        # first, each document with the least one of its largest bucket
        least = members.groupBy("bucket").agg(F.min("id").alias("lo"))
        main = members.groupBy("id").agg(F.max(F.struct("n", "bucket")).alias("m")).select(F.col("m.bucket").alias("bucket"), "id").join(least, "bucket")
        main = main.select(F.col("lo").alias("a"), F.col("id").alias("b")).where("a < b")
        main = tmp.written(main, "main")
        edges = tmp.written(_verified(main, sets, threshold), "near")
        # then, in buckets that this leaves apart, each with the least and the greatest one
        ids = _apart(members, components(edges, tmp=tmp), tmp)
        ends = ids.select("id", "lo", "hi")
        star = ends.select(F.col("lo").alias("a"), F.col("id").alias("b")).union(ends.select(F.col("id").alias("a"), F.col("hi").alias("b"))).where("a < b").distinct()
        star = tmp.written(star.join(main, ["a", "b"], "left_anti"), "star")
        edges = tmp.written(edges.union(_verified(star, sets, threshold)), "near")
        # and then all pairs that are still apart
        ids = _apart(members, components(edges, tmp=tmp), tmp)
        other = ids.select("bucket", F.col("root").alias("root2"), F.col("id").alias("b"))
        rest = (
            ids.withColumnRenamed("id", "a").join(other, "bucket").where("root < root2")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            .join(main, ["a", "b"], "left_anti").join(star, ["a", "b"], "left_anti")
        )
        groups = written(components(edges.union(_verified(rest, sets, threshold)).union(same), tmp=tmp), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").cast("int").alias("group_size"))
    return groups.join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), "group_size", (F.col("node") == F.col("root")).alias("keep"))


def keep_one_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs without those that near_groups() doesn't keep. Rows without doc_id stay; rows of one doc_id stay or go together. Only
    ids are shuffled; see rows_of()."""
    return rows_of(docs, near_groups(docs, **parameters).where("not keep").select(F.col("doc_id").alias("id")), listed=False)
