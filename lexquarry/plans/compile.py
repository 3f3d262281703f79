"""An index plan as one aggregation over postings and one condition over summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.operators.scan import KNOWN, SKIPPED, bit_set, byte_count
from lexquarry.plans.tree import Need, Needle, Plan

FULL = 1023
BLOCK = 31


def need_column(n: Need) -> Column:
    """A need as a condition on summary columns."""
    v = n.value
    if n.kind == "min_len":
        return F.col("byte_len") >= v
    if n.kind == "min_longest_line":
        return F.col("longest_line") >= v
    if n.kind == "starts_with":
        return F.substring("prefix", 1, len(v)) == F.lit(bytearray(v))
    if n.kind == "ends_with":
        return F.expr(f"substring(suffix, greatest(length(suffix) - {len(v) - 1}, 1), {len(v)})") == F.lit(bytearray(v))
    if n.kind == "min_counts":
        out = F.lit(True)
        for b, least in v:
            out = out & (byte_count("counts", b) >= min(least, 255))
        return out
    out = F.lit(False)
    for b in sorted(v):
        out = out | ((byte_count("counts", b) > 0) if n.kind == "any_byte" else bit_set(n.kind, b))
    return out


def status_aware(n: Need) -> Column:
    """Texts of unknown content meet every need, skipped ones none."""
    return F.when(F.col("status") == KNOWN, need_column(n)).otherwise(F.col("status") != SKIPPED)


def needles(plan: Plan) -> list[Needle]:
    out = list(dict.fromkeys(plan.needles))
    for s in plan.subs:
        out += [n for n in needles(s) if n not in out]
    return out


def mask_columns(found: list[Needle]) -> list[Column]:
    """For each needle the joined mask of a document's postings that are its; null if there are none."""
    out = []
    for i, n in enumerate(found):
        hit = F.col("gram").isin([int(k) for k in n.keys])
        if n.edges:
            hit = hit & (F.col("mask").cast("int").bitwiseAND(n.edges) == n.edges)
        out.append(F.bit_or(F.when(hit, F.col("mask").cast("int"))).alias(f"m{i}"))
    return out


def mask_of(plan: Plan, found: list[Needle], block: bool) -> Column:
    """The mask with which a document meets the plan; null if it doesn't. block: all grams of a conjunction must share a line's
    bit, as those of a match within one line do."""
    null = F.lit(None).cast("int")
    if plan.op == "all":
        return F.lit(FULL)
    if plan.op == "none":
        return null
    at = {n: i for i, n in enumerate(found)}
    parts = [F.col(f"m{at[n]}") if block else F.col(f"m{at[n]}").bitwiseOR(BLOCK) for n in plan.needles]
    parts += [mask_of(s, found, block) for s in plan.subs]
    parts += [F.when(status_aware(n), F.lit(FULL)).otherwise(null) for n in plan.needs]
    if not parts:
        return F.lit(FULL)
    if plan.op == "or":
        out = F.coalesce(parts[0], F.lit(0))
        for p in parts[1:]:
            out = out.bitwiseOR(F.coalesce(p, F.lit(0)))
        return F.when(out != 0, out)
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseAND(p)  # null if any is
    return F.when(out.bitwiseAND(BLOCK) != 0, out)


def summary_filter(plan: Plan) -> Column:
    """The plan's condition on summaries alone, every gram taken to be there."""
    if plan.op == "all":
        return F.lit(True)
    if plan.op == "none":
        return F.lit(False)
    parts = [status_aware(n) for n in plan.needs] + [summary_filter(s) for s in plan.subs]
    if plan.op == "or" and plan.needles:
        return F.lit(True)
    out = F.lit(plan.op == "and")
    for p in parts:
        out = (out & p) if plan.op == "and" else (out | p)
    return out


def candidates(plan: Plan, look_up: Callable[[list[int]], DataFrame], summaries: DataFrame, key: str, block: bool = True, any_forced: bool = True) -> DataFrame:
    """Documents (key) that meet the plan, with the forced ones that meet its needs. One aggregation over the postings of the
    plan's keys; summaries are joined only for what these can't say. any_forced: are there forced documents at all?"""
    if plan.op == "none":
        return summaries.where("false").select(key)
    found = needles(plan)
    forced = summaries.where(F.col("forced") & (F.col("status") != SKIPPED) & summary_filter(plan)).select(key)
    if not found:
        return summaries.where((F.col("status") != SKIPPED) & (F.col("forced") | (summary_filter(plan) & (F.col("status") == KNOWN)))).select(key)
    keys = sorted({int(k) for n in found for k in n.keys})
    hits = look_up(keys).groupBy(key).agg(*mask_columns(found))
    needs_summary = ["status", "byte_len", "longest_line", "counts", "line_start", "line_end", "prefix", "suffix"]
    if plan.always_grams():
        if not _has_needs(plan):
            out = hits.where(mask_of(plan, found, block).isNotNull()).select(key)
            return out.union(forced) if any_forced else out
        joined = hits.join(summaries.where(~F.col("forced")).select(key, *needs_summary), key)
    else:
        joined = summaries.where(~F.col("forced") & (F.col("status") == KNOWN)).select(key, *needs_summary).join(hits, key, "left")
    out = joined.where(mask_of(plan, found, block).isNotNull()).select(key)
    return out.union(forced) if any_forced else out


def among(column: str, keys: list[int]) -> Column:
    """Is the column one of the keys? In tens, as Spark's reader of Parquet tells row groups by each of up to ten values, but of more
    only by the least and the greatest."""
    parts = [F.col(column).isin(keys[i : i + 10]) for i in range(0, len(keys), 10)] or [F.lit(False)]
    while len(parts) > 1:  # a balanced tree: conditions are walked by recursion
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _has_needs(plan: Plan) -> bool:
    return bool(plan.needs) or any(_has_needs(s) for s in plan.subs)
