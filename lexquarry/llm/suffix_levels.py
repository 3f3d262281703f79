"""Repeated passages by a logarithmic family of suffix indexes: each batch of documents gets a sparse suffix array, is
merge-scanned against the levels there are, and levels of the same size merge.

Suffixes begin at anchors. A passage of LONG words has LONG - REACH + 1 runs of REACH words; the one of the least hash is its
anchor, so that equal passages have equal anchors wherever they are, and one suffix in about 13 is in the index. Suffixes are
ordered by the fingerprint of their first REACH words, which brings suffixes that share a prefix of this length together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import hash_strings, mix, powers, prefix_hashes, split_words, text_slices, written

LONG, REACH, BATCHES = 50, 25, 4
FILTER_KEYS = 16_000_000


def runs(prefix: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k words, whatever text they begin in."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(prefix))
    return mix((prefix[k:] - prefix[:-k]) * down[:n])


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` values in a row."""
    size, out = 1, x
    while 2 * size <= width:
        out = f(out[:-size], out[size:])
        size *= 2
    if size < width:
        out = f(out[: len(out) - (width - size)], out[width - size :])
    return out


def anchors(words: np.ndarray, offsets: np.ndarray, long: int = LONG, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, the fingerprints of all runs of `reach` words, the places where passages of `long` words begin, and
    the least fingerprint in each of these passages."""
    prefix = prefix_hashes(words)
    v = runs(prefix, reach)
    width = long - reach + 1
    if len(v) < width:
        return np.zeros(0, np.int64), v, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(v, width, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    begins = np.flatnonzero(np.arange(len(least)) + long <= ends[: len(least)])
    ok = np.zeros(len(least), np.uint64)
    ok[begins] = least[begins]
    padded = np.concatenate([np.zeros(width - 1, np.uint64), ok, np.zeros(width - 1, np.uint64)])
    cover = _sliding(padded, width, np.maximum)[: len(v)]
    return np.flatnonzero((cover == v) & (cover > 0)), v, begins, least[begins]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, words, offsets = split_words(texts)
    return hash_strings(words)[codes] if len(codes) else np.zeros(0, np.uint64), offsets


def _suffixes(batches, long, reach):
    for batch in batches:
        for part in text_slices(batch):
            words, offsets = _words(part.column("text"))
            at, v, _, _ = anchors(words, offsets, long, reach)
            row = np.searchsorted(offsets, at, "right") - 1
            # one entry for each anchor of a document: a passage within one document is no repeat across documents
            both = np.unique(np.stack([row, v[at].view(np.int64)], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 1]), part.column("doc_id").take(pa.array(both[:, 0]))], ["key", "doc_id"])


class Filter:
    """A set of keys as a Bloom filter of eight bits a key: tells of every key of the set that it is in, of others seldom."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(8 * len(bits))

    @staticmethod
    def _places(keys: np.ndarray, size: np.uint64) -> list[np.ndarray]:
        k = keys.view(np.uint64)
        return [mix(k + np.uint64(i)) % size for i in (1, 2, 3)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self._places(keys, self.size):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> "Filter":
        """keys: one long column; n of them. Each task sets its bits in an array of its own; the driver joins the arrays."""
        size = max(1024, n)

        def run(batches):
            bits = np.zeros(size, np.uint8)
            for b in batches:
                for p in cls._places(b.column(0).to_numpy(), np.uint64(8 * size)):
                    np.bitwise_or.at(bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

        bits = np.zeros(size, np.uint8)
        for r in keys.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
            bits |= np.frombuffer(r["bits"], np.uint8)
        return cls(bits)


def _passages(batches, long, reach, known=None):
    """The passages whose anchor is among the row's `keys`, or in the filter: (fingerprint, doc_id, first word)."""
    for batch in batches:
        for part in text_slices(batch):
            words, offsets = _words(part.column("text"))
            _, _, begins, least = anchors(words, offsets, long, reach)
            row = np.searchsorted(offsets, begins, "right") - 1
            if known is not None:
                hit = known.value.has(least.view(np.int64)) if len(least) else np.zeros(0, bool)
            else:
                keys = part.column("keys")
                n = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
                wanted = mix(keys.flatten().to_numpy().view(np.uint64) ^ np.repeat(mix(np.arange(1, len(n) + 1, dtype=np.uint64)), n))
                mine = mix(least ^ mix(np.arange(1, len(n) + 1, dtype=np.uint64))[row])
                hit = np.isin(mine, wanted)
            begins, row = begins[hit], row[hit]
            fp = runs(prefix_hashes(words), long)[begins]
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array((begins - offsets[:-1][row]).astype(np.int32))], ["fp", "doc_id", "start"])


class Levels:
    """The index family. add() returns the keys that the new batch shares with what is there, or within itself."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame, bool]] = []  # (size in batches, suffix array: key, lo, hi, is it yet to be written?)

    def add(self, suffixes: DataFrame) -> DataFrame:
        """suffixes: (key, doc_id). A level has each key once, with its least and greatest document, so that thousands of
        copies are one entry. One pass over the batch and all levels, brought together by key, does the merge-scan; where levels
        of the same size merge, it gives their suffix array too, which is written when the next batch comes."""
        for i, (size, level, merged) in enumerate(self.levels):
            if merged:
                self.levels[i] = (size, written(level, "level"), False)
        rows = suffixes.select("key", F.col("doc_id").alias("lo"), F.col("doc_id").alias("hi"), F.lit(0).alias("age"))
        size, joins = 1, []
        for at in range(len(self.levels) - 1, -1, -1):
            if self.levels[at][0] == size:
                joins.append(at)
                size *= 2
            else:
                break
        for at, (_, level, _) in enumerate(self.levels):
            rows = rows.union(level.select("key", "lo", "hi", F.lit(1 if at in joins else 2).alias("age")))
        mine = lambda f, c, age: f(F.when(F.col("age") <= age, F.col(c)))
        scanned = rows.groupBy("key").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("age").alias("age"), mine(F.min, "lo", 1).alias("lo1"), mine(F.max, "hi", 1).alias("hi1")
        )
        found = written(scanned.where("age = 0 and lo <> hi").select("key"), "shared")
        array = scanned.where("age <= 1").select("key", F.col("lo1").alias("lo"), F.col("hi1").alias("hi"))
        self.levels = [x for at, x in enumerate(self.levels) if at not in joins] + [(size, array.sortWithinPartitions("key"), True)]
        return found


def repeats(docs: DataFrame, long: int = LONG, reach: int = REACH, batches: int = BATCHES) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id, last_doc_id): maximal runs of words of a document in which every
    passage of `long` words also is in another document, word for word. start_word counts from 0, end_word is the one after;
    first_doc_id and last_doc_id are the least and the greatest document that hold the run's first passage.

    Documents come in `batches` batches by a hash of doc_id. Fingerprints of 64 bits stand for words and passages. Memory and
    rows follow the text, not the number of pairs of copies.

    Null and empty texts and those of fewer words hold no passage; rows without doc_id are left out; rows that share a doc_id are
    one document, whose texts' passages are reported with their places in their own text, overlapping ones as one run; an empty
    table gives no rows; other columns aren't looked at.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    all_ = src.mapInArrow(lambda it: _suffixes(it, long, reach), "key long, doc_id long").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    all_ = written(all_, "suffixes")
    family, shared = Levels(), None
    for i in range(batches):
        found = family.add(all_.where(F.col("batch") == i).select("key", "doc_id"))
        shared = found if shared is None else shared.union(found)
    shared = written(shared.distinct(), "keys")
    n = shared.count()
    if n <= FILTER_KEYS:  # a byte each; beyond that the texts are joined with their keys
        known = docs.sparkSession.sparkContext.broadcast(Filter.of(shared, n))
        passages = src.mapInArrow(lambda it: _passages(it, long, reach, known), "fp long, doc_id long, start int")
    else:
        hits = all_.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
        passages = src.join(hits, "doc_id").select("doc_id", "text", "keys").mapInArrow(lambda it: _passages(it, long, reach), "fp long, doc_id long, start int")
    same = Window.partitionBy("fp")
    # one shuffle, by fp, for both steps
    repeated = passages.repartition("fp").distinct().withColumns({"lo": F.min("doc_id").over(same), "hi": F.max("doc_id").over(same)}).where("lo <> hi").drop("fp")
    order = Window.partitionBy("doc_id").orderBy("start", "lo", "hi")
    steps = repeated.withColumn("new", F.when(F.col("start") - F.lag("start").over(order) <= 1, 0).otherwise(1))
    spans = steps.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "run").agg(
        F.min("start").alias("start_word"), (F.max("start") + long).alias("end_word"), F.min(F.struct("start", "lo", "hi")).alias("f")
    )
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("f.lo").alias("first_doc_id"), F.col("f.hi").alias("last_doc_id"))
