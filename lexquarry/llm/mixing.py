"""Mixing sources to target weights: exact token budgets by subset sums of the documents' lengths."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.common import rows_of, written
from lexquarry.llm.tokens import VOCABULARY, count

#: production target: what a source has beyond the typical size counts to this power
TEMPER = 0.7
#: tokens that the knapsack distributes, as bits of one number a step
ROOM = 1 << 20


def knapsack(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length to take so that the sum is the greatest that is at most budget. items: (length, how many).

    Dynamic programming over reachable sums, held as the bits of one integer; each length's copies come in powers of two. It
    ends as soon as the budget itself is reached.
    """
    full, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for length, many in items:
        k = 1
        while many > 0 and length <= budget:
            take = min(k, many)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full if length * take <= budget else 0
            many -= take
            k *= 2
            if reach >> budget & 1:
                break
        if reach >> budget & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def choose(lengths: dict[int, int], budget: int, seed: int = 0) -> dict[int, int]:
    """How many documents of each length to take: at most lengths[n], together at most budget and as near to it as can be.

    Most of the budget goes to all lengths in proportion, by cumulative rounding, so that the selection keeps the lengths'
    distribution. What is left of it is at most ROOM, after the longest documents that still fit where it was more; it goes to a
    bounded knapsack over the other documents, in seeded order of their lengths. So the sums that the driver holds are bounded,
    however long a document is.
    """
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    available = sum(n * c for n, c in lengths.items())
    if available <= budget:
        return dict(lengths)
    if budget <= 0:
        return {}
    room = min(budget, ROOM, 4 * max(n for n in lengths if n <= budget)) if any(n <= budget for n in lengths) else budget
    share, exact, given, out, used = (budget - room) / available, 0.0, 0, {}, 0
    for n in sorted(lengths):
        exact += lengths[n] * share
        take = min(lengths[n], int(exact) - given, (budget - used) // n)
        given = int(exact)
        if take > 0:
            out[n] = take
            used += take * n
    for n in sorted(lengths, reverse=True):
        take = min(lengths[n] - out.get(n, 0), (budget - used - ROOM // 2) // n) if budget - used > ROOM else 0
        if take > 0:
            out[n] = out.get(n, 0) + take
            used += take * n
    rest = [(n, c - out.get(n, 0)) for n, c in sorted(lengths.items()) if c > out.get(n, 0) and n <= budget - used]
    random.Random(seed).shuffle(rest)
    for n, c in knapsack(rest, budget - used).items():
        out[n] = out.get(n, 0) + c
    return out


def budgets(available: dict, weights: dict | None, total: int | None) -> dict:
    """Tokens for each source. Without weights all sources weigh the same; a source that weights lacks gets nothing. Without a
    total it is the greatest for which every source has enough."""
    weights = {s: (1.0 if weights is None else float(weights.get(s, 0.0))) for s in available}
    weights = {s: w for s, w in weights.items() if w > 0 and available[s] > 0}
    all_ = sum(weights.values())
    if not weights:
        return {}
    if total is None:
        total = min(int(available[s] * all_ / w) for s, w in weights.items())
    return {s: int(total * w / all_) for s, w in weights.items()}


def tempered(available: dict, temper: float = TEMPER) -> dict:
    """The production targets, tokens for each source: a source of up to the typical size gives all it has, a larger one its size
    over the typical one to the power of `temper`. Typical is the size of the source that the mean token is in, which no small
    source moves; the total is the sum."""
    all_ = sum(available.values())
    typical = sum(n * n for n in available.values()) / all_ if all_ else 0
    return {s: n if n <= typical else int(typical * (n / typical) ** temper) for s, n in available.items()}


def kept(docs: DataFrame, chosen: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, n_tokens, kept_tokens, share): what select() kept of each source."""
    all_ = sizes(docs, vocabulary).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    some = chosen.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return all_.join(some, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n_tokens", k.alias("kept_tokens"), (k / F.col("n_tokens")).alias("share"))


def sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count(F.col("text"), vocabulary).alias("n"))
    return rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n").alias("n_tokens")).where("n_tokens > 0")


def select(docs: DataFrame, weights: dict | None = None, total: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents selected; see choose() and budgets(). Within a source and length, those of the
    least seeded hashes of doc_id are taken. Without weights and total, the budgets are those of tempered().

    Rows that share a doc_id are one document with all their tokens, of their least source. Documents without tokens (null or
    empty texts) are never selected, as they add nothing; rows without doc_id aren't either; null is a source of its own (None
    in weights); an empty table gives no rows; other columns aren't looked at.
    """
    spark = docs.sparkSession
    sized = written(sizes(docs, vocabulary), "sizes")
    counts: dict = {}
    for r in sized.groupBy("source", "n_tokens").count().toLocalIterator():  # as many rows as sources have different lengths
        counts.setdefault(r["source"], {})[r["n_tokens"]] = r["count"]
    available = {s: sum(n * c for n, c in x.items()) for s, x in counts.items()}
    given = tempered(available) if weights is None and total is None else budgets(available, weights, total)
    # a source whose shortest document is longer than its budget gives that one rather than vanish
    takes = [(s, n, c) for s, b in given.items() if b > 0 for n, c in choose(counts[s], max(b, min(counts[s])), seed).items()]
    schema = T.StructType([T.StructField("t_source", T.StringType()), T.StructField("t_n", T.LongType()), T.StructField("take", T.LongType())])
    take = spark.createDataFrame(takes, schema)
    order = Window.partitionBy("source", "n_tokens").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    ranked = sized.withColumn("r", F.row_number().over(order))
    same = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("n_tokens") == F.col("t_n")) & (F.col("r") <= F.col("take"))
    return ranked.join(take, same, "left_semi").select("doc_id", "source", "n_tokens")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that select() selects, all columns as they are. Only ids and lengths are shuffled; see rows_of()."""
    return rows_of(docs, select(docs, **parameters).select(F.col("doc_id").alias("id")))
