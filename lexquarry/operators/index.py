"""The inverted gram index: generations of Parquet tables, candidates of a plan, and searches that come to the same as a scan."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.weights import WeightTable
from lexquarry.operators import segments
from lexquarry.operators.scan import KNOWN, SKIPPED
from lexquarry.operators.search import SearchOptions, search
from lexquarry.plans.compile import candidates, needles
from lexquarry.plans.planner import plan_tree
from lexquarry.plans.tree import Plan
from lexquarry.sources import store

SCHEMA_VERSION = 2
CEILING_PERCENT, FLOOR_DOCS = 30, 32
MOST_NEEDLES = 400
MOST_BROADCAST = 1_000_000


@dataclass
class Index:
    """One generation. key: name of the documents' key column."""

    spark: SparkSession
    path: str
    key: str
    text: str
    total: int
    text_docs: int
    text_bytes: int
    fingerprint: int
    table: WeightTable
    meta: dict

    @property
    def segments(self) -> DataFrame:
        """The schema is known: no job to find it."""
        return self.spark.read.schema(segments.schema(self.meta["kind"])).parquet(f"{self.path}/segments")

    @property
    def postings(self) -> DataFrame:
        """All of them; grams are told by the kept bits of their keys. See look_up() for some keys' own."""
        return segments.postings(self.segments, self.key, self.meta["kind"])

    @property
    def df(self) -> DataFrame:
        return segments.frequencies(self.segments)

    @property
    def summaries(self) -> DataFrame:
        return segments.summaries(self.segments, self.key)

    def look_up(self, keys) -> DataFrame:
        """Postings of the keys: of each segment the blocks are read in which they may be."""
        return segments.postings(self.segments, self.key, self.meta["kind"], keys)

    @property
    def exceptions(self) -> int:
        """Documents that are candidates whatever their grams, or kept whole."""
        return self.meta["forced"] + self.meta["held"]

    @property
    def ceiling(self) -> int:
        return max(FLOOR_DOCS, self.text_docs * CEILING_PERCENT // 100)

    def frequencies(self, keys) -> dict[int, int]:
        """Documents that have each key; keys in none are left out. A plan has at most a few thousand keys."""
        keys = sorted({int(k) for k in keys})
        if not keys:
            return {}
        return {r["gram"]: r["df"] for r in segments.frequencies(self.segments, keys).collect()}

    def bytes(self) -> int:
        return store.total_bytes(self.path)


def build(docs: DataFrame, root: str, table: WeightTable, key: str = "doc_id", text: str = "text", explicit: str | None = None, keep: int = 2) -> Index:
    """Writes a new generation below root and makes it the current one; of older ones the last `keep` - 1 stay.

    One pass writes segments (see there), so that a build takes no disk but the index's own. Readers of the old generation aren't
    disturbed: the pointer file is moved into place at the end.
    """
    spark = docs.sparkSession
    name = f"gen-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/{name}"
    kind = docs.schema[key].dataType.simpleString()
    segments.write(docs, f"{path}/segments", table, key, text, explicit)
    known = F.col("status") == KNOWN
    t = segments.summaries(spark.read.schema(segments.schema(kind)).parquet(f"{path}/segments"), key).agg(
        F.count("*").alias("total"), F.coalesce(F.sum((F.col("status") != SKIPPED).cast("long")), F.lit(0)).alias("text_docs"), F.coalesce(F.sum(F.when(known, F.col("byte_len"))), F.lit(0)).alias("text_bytes"),
        F.coalesce(F.sum(F.col("forced").cast("long")), F.lit(0)).alias("forced"), F.coalesce(F.sum(F.col("held").isNotNull().cast("long")), F.lit(0)).alias("held"),
    ).first()
    store.write_text(f"{path}/table.hex", table.to_bytes().hex())
    store.write_json(f"{path}/meta.json", {"version": SCHEMA_VERSION, "key": key, "kind": kind, "text": text, "fingerprint": str(table.fingerprint), **t.asDict()})
    store.write_text(f"{root.rstrip('/')}/CURRENT", name)
    for old in [g for g in store.folders(root) if g.startswith("gen-") and g < name][: -(keep - 1) or None]:
        store.remove(f"{root.rstrip('/')}/{old}")
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> Index | None:
    """The current generation; None if there is none, or one of another version or that isn't whole."""
    name = store.read_text(f"{root.rstrip('/')}/CURRENT")
    if not name:
        return None
    path = f"{root.rstrip('/')}/{name}"
    meta, table = store.read_json(f"{path}/meta.json"), store.read_text(f"{path}/table.hex")
    if not meta or not table or meta.get("version") != SCHEMA_VERSION:
        return None
    weights = WeightTable.from_bytes(bytes.fromhex(table))  # has a checksum of its own
    return Index(spark, path, meta["key"], meta["text"], meta["total"], meta["text_docs"], meta["text_bytes"], int(meta["fingerprint"]), weights, meta)


@dataclass
class Decision:
    """How a search will run: by the index with `plan`, or by a scan and why."""

    plan: Plan | None
    reason: str | None
    estimate: int | None = None

    def __str__(self) -> str:
        return f"scan: {self.reason}" if self.reason else f"index: {self.plan} (at most {self.estimate} documents)"


def decide(index: Index | None, o: SearchOptions, force: bool = False) -> Decision:
    """Index or scan. force: use the index even if many documents are candidates."""
    why = o.indexable()
    if why or index is None:
        return Decision(None, why or "no index")
    plan = plan_tree(o.tree(), index.table, o.folding(), lines=not o.multiline)
    if plan.op == "none":
        return Decision(plan, None, 0)
    if plan.op == "all" or not plan.has_grams():
        return Decision(None, "the plan has no grams")
    known = index.frequencies(plan.keys())
    df = lambda k: known.get(k, 0)
    tuned = plan.tuned(df, index.text_docs, index.ceiling)
    if not tuned.has_grams():
        return Decision(None, "no gram is rare enough")
    if tuned.always_grams() and tuned.estimate(df, index.text_docs) * 8 <= index.ceiling:
        tuned = tuned.without_needs()  # reading the few candidates costs less than joining their summaries
    estimate = min(tuned.estimate(df, index.text_docs) + index.exceptions, index.text_docs)
    if not force:
        if estimate > index.ceiling:
            return Decision(None, f"{estimate} of {index.text_docs} documents may match", estimate)
        if len(needles(tuned)) > MOST_NEEDLES:
            return Decision(None, "the plan is too wide", estimate)
    return Decision(tuned, None, estimate)


def candidate_keys(index: Index, plan: Plan, o: SearchOptions) -> DataFrame:
    """Keys of the documents that may match: those that meet the plan, and held ones."""
    found = candidates(plan, index.look_up, index.summaries, index.key, not o.multiline, bool(index.meta["forced"]))
    if plan.op == "none" or not index.meta["held"]:
        return found
    return found.union(index.summaries.where(F.col("held").isNotNull()).select(index.key))


def indexed_search(docs: DataFrame, index: Index | None, o: SearchOptions, force: bool = False, changed: DataFrame | None = None) -> DataFrame:
    """Same result as search(docs, o); reads only candidate documents where the index helps.

    changed: keys of documents that changed since the index was built, or are new; the index's word on them isn't asked.
    """
    key, text = (index.key, index.text) if index else ("doc_id", "text")
    d = decide(index, o, force)
    if d.reason:
        return search(docs, o, key, text)
    if d.estimate == 0 and changed is None:  # no document has all that the plan asks for
        return search(docs.where("false"), o, key, text, docs if o.mode == "files_without_match" or o.include_zero else None)
    if d.estimate + (changed.count() if changed is not None else 0) > MOST_BROADCAST:
        return search(docs, o, key, text)  # a join by key would read all documents too, and shuffle their texts
    keys = candidate_keys(index, d.plan, o)
    if changed is not None:
        keys = keys.join(changed.select(key), key, "left_anti").union(changed.select(key))
    few = docs.join(F.broadcast(keys), key, "left_semi")
    whole = docs if o.mode == "files_without_match" or o.include_zero else None
    return search(few, o, key, text, whole)


def report(docs: DataFrame, index: Index, suite: list[tuple[str, SearchOptions]]) -> DataFrame:
    """One row a pattern: label, class, indexed, candidates, matching, false positives, lost documents, and seconds of either way."""
    spark, rows = index.spark, []
    key = index.key
    for label, o in suite:
        d = decide(index, o)
        t = time.time()
        truth = {r[0] for r in search(docs, o, key, index.text).collect()}
        scan_s = time.time() - t
        found, index_s, lost = None, None, 0
        if not d.reason:
            found = {r[0] for r in candidate_keys(index, d.plan, o).distinct().collect()}
            t = time.time()
            got = {r[0] for r in indexed_search(docs, index, o).collect()}
            index_s, lost = time.time() - t, len(truth - got) + len(got - truth)
        rows.append((label, label.split("_")[0], not d.reason, len(found) if found is not None else None, len(truth), len(found - truth) if found is not None else None, lost, scan_s, index_s))
    return spark.createDataFrame(rows, "label string, class string, indexed boolean, candidates long, matching long, false_positives long, lost long, scan_s double, index_s double")


def summarised(reported: DataFrame) -> DataFrame:
    """Totals of a report by class and over all."""
    return reported.rollup("class").agg(
        F.count("*").alias("queries"), F.sum(F.col("indexed").cast("long")).alias("indexed"), F.sum("candidates").alias("candidates"), F.sum("matching").alias("matching"),
        F.sum("false_positives").alias("false_positives"), F.round(F.try_divide(F.lit(100.0) * F.sum("false_positives"), F.sum("candidates")), 2).alias("fp_percent"), F.sum("lost").alias("lost"),
        F.round(F.try_divide(F.sum(F.when(F.col("indexed"), F.col("scan_s"))), F.sum("index_s")), 3).alias("speedup"),
    )
