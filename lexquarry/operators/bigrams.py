"""Byte-pair statistics: counts over any text columns, weights, smoothing, divergence, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.functions.weights import PAIRS, UNSEEN

STEP = 1 << 18
_TEXT = (T.StringType, T.BinaryType, T.CharType, T.VarcharType)


def text_columns(schema: T.StructType, prefix: str = "") -> list[str]:
    """Names of all string and binary columns, those inside structs too."""
    out = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += text_columns(f.dataType, name + ".")
        elif isinstance(f.dataType, _TEXT):
            out.append(name)
    return out


def _counts_of(values: pa.Array) -> np.ndarray:
    """Counts of the pairs within each value; none spans two values."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.zeros(PAIRS, np.int64)
    values = values.cast(pa.large_binary()).drop_null()
    if not len(values):
        return np.zeros(PAIRS, np.int64)
    _, raw, data = values.buffers()
    off = np.frombuffer(raw, np.int64)[values.offset : values.offset + len(values) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(buf) < 2:
        return np.zeros(PAIRS, np.int64)
    out = np.zeros(PAIRS, np.int64)
    for at in range(0, len(buf) - 1, STEP):  # counting takes eight bytes and more a pair
        part = buf[at : at + STEP + 1]
        out += np.bincount((part[:-1].astype(np.uint16) << 8) | part[1:], minlength=PAIRS)
    seams = np.unique(off[1:-1] - off[0])  # a value ends before each of these
    seams = seams[(seams > 0) & (seams < len(buf))]
    return out - np.bincount((buf[seams - 1].astype(np.uint16) << 8) | buf[seams], minlength=PAIRS)


def pair_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(c1, c2, cnt) of all pairs of neighbouring bytes within values of the columns (all text columns, if none are named).

    Each task counts in one array of 65,536 numbers; only its non-zero ones are shuffled.
    """
    names = [f"`{c}`" if "`" not in c and "." not in c else c for c in columns] or text_columns(df.schema)
    src = df.select(*[F.col(n).cast("binary").alias(f"c{i}") for i, n in enumerate(names)])

    def run(batches):
        total = np.zeros(PAIRS, np.int64)
        for b in batches:
            for c in b.columns:
                total += _counts_of(c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at >> 8).astype(np.int32)), pa.array((at & 255).astype(np.int32)), pa.array(total[at])], ["c1", "c2", "cnt"])

    return src.mapInArrow(run, "c1 int, c2 int, cnt long").groupBy("c1", "c2").agg(F.sum("cnt").alias("cnt"))


def totals(df: DataFrame, column: str) -> DataFrame:
    """One row: pairs, bytes, values."""
    n = F.octet_length(F.col(column).cast("binary")).cast("long")
    return df.agg(F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).alias("pairs"), F.coalesce(F.sum(n), F.lit(0)).alias("bytes"), F.count(column).alias("values"))


def grid(spark: SparkSession) -> DataFrame:
    """All 65,536 pairs."""
    return spark.range(PAIRS).select(F.expr("cast(id div 256 as int)").alias("c1"), F.expr("cast(id % 256 as int)").alias("c2"))


def mint(counts: DataFrame) -> DataFrame:
    """(c1, c2, weight) for all pairs: total div count, at most 2**32 - 1, which unseen pairs get."""
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
    full = grid(counts.sparkSession).join(counts, ["c1", "c2"], "left").crossJoin(F.broadcast(total))  # one row
    return full.select("c1", "c2", F.when(F.coalesce("cnt", F.lit(0)) == 0, F.lit(UNSEEN)).otherwise(F.least(F.expr("total div cnt"), F.lit(UNSEEN))).cast("long").alias("weight"))


def boundary_discount(weights: DataFrame, by: int = 16) -> DataFrame:
    """Weights of pairs that touch a word boundary ('_', '.', '/', '-', ':', line ends, lower before upper case) divided, 1 at least."""
    edge = [F.col(c).isin(*b"_./-:\n\r") for c in ("c1", "c2")]
    camel = F.col("c1").between(97, 122) & F.col("c2").between(65, 90)
    return weights.withColumn("weight", F.when(edge[0] | edge[1] | camel, F.greatest(F.expr(f"weight div {by}"), F.lit(1))).otherwise(F.col("weight")))


def inspect(weights: DataFrame, k: int = 10) -> DataFrame:
    """The k lightest and the k heaviest pairs: (side, rank, c1, c2, weight)."""
    low = weights.orderBy("weight", "c1", "c2").limit(k).withColumn("side", F.lit("lowest"))
    high = weights.orderBy(F.desc("weight"), "c1", "c2").limit(k).withColumn("side", F.lit("highest"))
    rank = lambda w: F.row_number().over(Window.partitionBy("side").orderBy(w, "c1", "c2"))
    return low.withColumn("rank", rank(F.col("weight"))).union(high.withColumn("rank", rank(F.desc("weight")))).select("side", "rank", "c1", "c2", "weight")


def top_pairs(counts: DataFrame, k: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "c1", "c2").limit(k)


# ---------------------------------------------------------------- divergence
def probabilities(counts: DataFrame) -> DataFrame:
    """(c1, c2, p) of all pairs, one added to each count."""
    full = grid(counts.sparkSession).join(counts, ["c1", "c2"], "left").withColumn("n", F.coalesce("cnt", F.lit(0)) + 1)
    total = full.agg(F.sum("n").alias("total"))
    return full.crossJoin(F.broadcast(total)).select("c1", "c2", (F.col("n") / F.col("total")).alias("p"))


def table_frequencies(weights: DataFrame) -> DataFrame:
    """(c1, c2, q): what frequencies a weight table stands for: 1 / weight plus a floor, the floor alone for unseen pairs."""
    raw = weights.withColumn("f", F.when(F.col("weight") >= UNSEEN, F.lit(1e-15)).otherwise(1.0 / F.col("weight") + F.lit(1e-15)))
    total = raw.agg(F.sum("f").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select("c1", "c2", (F.col("f") / F.col("total")).alias("q"))


def divergence(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: Kullback-Leibler divergence of the counts from the table, in nats."""
    both = probabilities(counts).join(table_frequencies(weights), ["c1", "c2"])
    return both.agg(F.greatest(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), F.lit(0.0)).alias("kl"))


def contributors(counts: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """The k pairs that add most on either side: (side, c1, c2, contribution)."""
    both = probabilities(counts).join(table_frequencies(weights), ["c1", "c2"])
    p, q = F.col("p"), F.col("q")
    under = both.where(p > q).select(F.lit("under").alias("side"), "c1", "c2", (p * F.log(p / q)).alias("contribution")).orderBy(F.desc("contribution"), "c1", "c2").limit(k)
    over = both.where(q > p).select(F.lit("over").alias("side"), "c1", "c2", (q * F.log(q / p)).alias("contribution")).orderBy(F.desc("contribution"), "c1", "c2").limit(k)
    return under.union(over)


class PairCounter:
    """Counts kept between runs: add(), merge(), snapshot() and restore()."""

    def __init__(self) -> None:
        self.counts = np.zeros(PAIRS, np.uint64)
        self.bytes = self.values = 0

    def add(self, df: DataFrame, *columns: str) -> None:
        """Adds a DataFrame's pairs: at most 65,536 rows come to the driver."""
        for r in pair_counts(df, *columns).collect():
            self.counts[(r["c1"] << 8) | r["c2"]] += np.uint64(r["cnt"])
        for c in columns:
            t = totals(df, c).first()
            self.bytes, self.values = self.bytes + t["bytes"], self.values + t["values"]

    def add_value(self, value: bytes) -> None:
        self.counts += _counts_of(pa.array([value], pa.binary())).astype(np.uint64)
        self.bytes, self.values = self.bytes + len(value), self.values + 1

    def merge(self, other: "PairCounter") -> None:
        self.counts += other.counts
        self.bytes, self.values = self.bytes + other.bytes, self.values + other.values

    @property
    def pairs(self) -> int:
        return int(self.counts.sum())

    def count(self, c1: int, c2: int) -> int:
        return int(self.counts[(c1 << 8) | c2])

    def snapshot(self) -> bytes:
        return np.array([self.bytes, self.values], "<u8").tobytes() + self.counts.astype("<u8").tobytes()

    @classmethod
    def restore(cls, data: bytes) -> "PairCounter":
        if len(data) != 8 * (PAIRS + 2):
            raise ValueError("no snapshot of a counter")
        head, out = np.frombuffer(data, "<u8"), cls()
        out.bytes, out.values, out.counts = int(head[0]), int(head[1]), head[2:].astype(np.uint64)
        return out


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part; '' without one."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1))


def bytes_by_extension(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    return files.groupBy(extension(F.col(path)).alias("extension")).agg(F.sum(length).cast("long").alias("bytes"), F.count("*").alias("files"))
