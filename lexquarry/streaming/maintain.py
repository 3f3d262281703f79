"""Keeping an index and statistics up to date: manifests and their differences, a ledger of changed paths fed by a stream,
answers that fold changes in, and exactly-once pair counts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexquarry.functions.weights import WeightTable
from lexquarry.operators import bigrams, quotas
from lexquarry.operators.index import Index, build, indexed_search, open_index
from lexquarry.operators.search import SearchOptions, search
from lexquarry.sources import store

MOST_DIRTY = 1024
FOLD_AT_MOST = 128


# ---------------------------------------------------------------- manifests
def manifest(files: DataFrame, path: str = "path", content: str | None = None) -> DataFrame:
    """(path, length, modified, digest): digest only where content is given."""
    digest = F.md5(F.col(content).cast("binary")) if content else F.lit(None).cast("string")
    cols = files.columns
    return files.select(F.col(path).alias("path"), (F.col("length") if "length" in cols else F.octet_length(content)).cast("long").alias("length"), (F.col("modified") if "modified" in cols else F.lit(None).cast("timestamp")).alias("modified"), digest.alias("digest"))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed; unchanged paths are in no row."""
    o = old.select("path", F.struct("length", "modified", "digest").alias("o"))
    n = new.select("path", F.struct("length", "modified", "digest").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def untracked(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Adds is_untracked: is the path in no row of tracked?"""
    t = tracked.select("path").distinct().withColumn("__t", F.lit(True))
    return files.join(t, "path", "left").withColumn("is_untracked", F.col("__t").isNull()).drop("__t")


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that is the path or above it; null if none is. roots are few (a column root)."""
    # each path has as many ancestors as parts: an equi-join on these instead of a join by prefix
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    best = up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").join(best, "path", "left")


# ---------------------------------------------------------------- dirty ledger
@dataclass
class Ledger:
    """Changed keys, batch by batch, below a folder; and how far it has heard."""

    spark: SparkSession
    root: str
    key: str
    kind: str = "bigint"

    def _schema(self) -> str:
        return f"{self.key} {self.kind}, changed_at timestamp, batch long"

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """A batch that comes again replaces itself."""
        rows = batch.select(self.key).distinct().withColumns({"changed_at": F.current_timestamp(), "batch": F.lit(batch_id).cast("long")})
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id:012d}")
        store.write_json(f"{self.root}/HEARD", {"batch": batch_id, "at": time.time()})

    def heard_at(self) -> float:
        """When the last change was taken in; 0 before the first."""
        got = store.read_json(f"{self.root}/HEARD")
        return got["at"] if got else 0.0

    def rows(self) -> DataFrame:
        names = [n for n in store.folders(self.root) if n.startswith("batch=")]
        if not names:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*[f"{self.root}/{n}" for n in names])

    def covers(self, floor: float, wait: float = 0.03) -> bool:
        """Has the ledger heard of everything up to `floor`? Waits a little."""
        end = time.time() + wait
        while True:
            if self.heard_at() >= floor:
                return True
            if time.time() >= end:
                return False
            time.sleep(0.005)

    def changed(self) -> DataFrame | None:
        """Distinct changed keys; None if there are too many to list."""
        keys = self.rows().select(self.key).distinct()
        return keys if keys.limit(MOST_DIRTY + 1).count() <= MOST_DIRTY else None

    def clear_until(self, batch: int) -> None:
        """After an index was built from a state that has these batches in it; later ones stay."""
        for n in store.folders(self.root):
            if n.startswith("batch=") and int(n[6:]) <= batch:
                store.remove(f"{self.root}/{n}")

    def last_batch(self) -> int:
        return max((int(n[6:]) for n in store.folders(self.root) if n.startswith("batch=")), default=-1)


def watch(changes: DataFrame, ledger: Ledger, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Feeds a stream of changed rows to the ledger. Without an interval it takes what there is and ends."""
    writer = changes.writeStream.foreachBatch(lambda df, i: ledger.append(df, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def fresh_search(docs: DataFrame, index: Index | None, ledger: Ledger, o: SearchOptions, floor: float | None = None) -> DataFrame:
    """Indexed search with the ledger's changes folded in; a scan if they are too many or the ledger isn't up to date."""
    if index is None or (floor is not None and not ledger.covers(floor)):
        return search(docs, o, ledger.key)
    changed = ledger.changed()
    if changed is None or changed.count() > FOLD_AT_MOST:
        return search(docs, o, index.key, index.text)
    return indexed_search(docs, index, o, changed=changed)


def refresh(docs: Callable[[], DataFrame], root: str, table: WeightTable, ledger: Ledger, key: str = "doc_id", text: str = "text", force: bool = False) -> Index:
    """Builds a new generation if anything changed; what comes in meanwhile stays in the ledger."""
    last = ledger.last_batch()
    have = open_index(ledger.spark, root)
    if have is not None and last < 0 and not force:
        return have
    out = build(docs(), root, table, key, text)
    if last >= 0:
        ledger.clear_until(last)
    return out


# ---------------------------------------------------------------- exactly-once statistics
class CountState:
    """Pair counts of a stream: each batch's counts lie in a folder of its own, so that a batch that comes again counts once.
    binding: what the state is of (corpus, revision); another one is refused."""

    def __init__(self, spark: SparkSession, root: str, binding: str):
        self.spark, self.root = spark, root
        had = store.read_json(f"{root}/BINDING")
        if had is None:
            store.write_json(f"{root}/BINDING", binding)
        elif had != binding:
            raise ValueError(f"this state is of {had}, not of {binding}")

    def append(self, batch: DataFrame, batch_id: int, column: str) -> None:
        bigrams.pair_counts(batch, column).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batch={batch_id:012d}")

    def counts(self) -> DataFrame:
        names = [n for n in store.folders(self.root) if n.startswith("batch=")]
        if not names:
            return self.spark.createDataFrame([], "c1 int, c2 int, cnt long")
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in names]).groupBy("c1", "c2").agg(F.sum("cnt").alias("cnt"))


def count_stream(texts: DataFrame, state: CountState, column: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    writer = texts.writeStream.foreachBatch(lambda df, i: state.append(df, i, column)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# ---------------------------------------------------------------- rates
def windowed_rate(events: DataFrame, ts: str, size: str, seconds: int = 30) -> DataFrame:
    """Adds rate: units a second over the `seconds` before and at each event, and average since the first.

    Whole numbers are summed once a time and from the first time on; a window's sum is what lies between two such sums, so that it
    costs no more for many events. Of fractions and decimals such differences aren't exact: their windows are added up in one task.
    """
    t = F.col(ts).cast("timestamp").cast("double")
    out = events.withColumn("__t", t)
    if not isinstance(events.schema[size].dataType, T.IntegralType):
        return _added_up(out, size, seconds).drop("__t")
    names = {"__s": F.sum(size).cast("long"), "__n": F.count(size)}
    each = store.written(out.groupBy("__t").agg(*[v.alias(k) for k, v in names.items()]), "rates")
    timed = each.where("__t is not null")
    zero = F.lit(0).cast("long")
    ends = timed.select(F.col("__t").alias("__x"), F.lit(1).alias("__k"), "__t", *names)
    begins = timed.select((F.col("__t") - seconds).alias("__x"), F.lit(0).alias("__k"), "__t", *[zero.alias(k) for k in names])
    summed = ends.union(begins)  # where a window begins, what is there belongs to it
    for k in names:
        summed = quotas.running_sum(summed, F.col(k), f"{k}_to", ["__x", "__k"])
    at = lambda k, kind: F.max(F.when(F.col("__k") == kind, F.col(f"{k}_to")))
    sums = summed.groupBy("__t").agg(*[at(k, 1).alias(f"{k}_to") for k in names], *[(at(k, 1) - at(k, 0)).alias(f"{k}_in") for k in names])
    missing = F.col("__t").isNull()  # such events come first, and are a window of their own
    one = each.agg(F.min("__t").alias("__first"), *[F.coalesce(F.sum(F.when(missing, F.col(k))), zero).alias(f"{k}_0") for k in names])
    total = lambda k, of: F.when(missing, F.col(f"{k}_0")).otherwise(F.col(f"{k}_in") if of == "in" else F.col(f"{k}_0") + F.col(f"{k}_to"))
    known = lambda of: F.when(total("__n", of) > 0, total("__s", of))
    span = F.when(missing, F.lit(1.0)).otherwise(F.greatest(F.col("__t") - F.col("__first"), F.lit(1.0)))
    found = out.join(sums, "__t", "left").crossJoin(F.broadcast(one))  # one row
    return found.select(*[F.col(f"`{c}`") for c in events.columns], (known("in") / seconds).alias("rate"), (known("all") / span).alias("average"))


def _added_up(events: DataFrame, size: str, seconds: int) -> DataFrame:
    order = Window.partitionBy(F.lit(0)).orderBy("__t")
    every = order.rangeBetween(Window.unboundedPreceding, 0)
    span = F.greatest(F.col("__t") - F.min("__t").over(every), F.lit(1.0))
    return events.withColumn("rate", F.sum(size).over(order.rangeBetween(-seconds, 0)) / seconds).withColumn("average", F.sum(size).over(every) / span)
