"""Quality rules: a decision list learned by sequential covering, emitted as one ordered Spark condition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = "the of and to in is was that for with on as by at be this it he die der und von zu den das nicht für le la de et les des un une que en el los las por con para del se su".split()


def statistics(text: Column) -> dict[str, Column]:
    """The texts' statistics, all inside the JVM; a null text counts as empty, for which all are 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t)
    words = F.filter(F.split(t, "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda w: F.trim(w) != "")
    share = lambda part, whole: F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
    without = lambda chars: n - F.length(F.translate(t, chars, ""))
    lower = "abcdefghijklmnopqrstuvwxyz"
    return {
        "n_words": F.size(words).cast("double"),
        "mean_word": share(n - without(" \t\n\r\f\x0b"), F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "stop_words": share(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))), F.size(words)),
        "repeated_lines": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "digits": share(without("0123456789"), n),
        "upper": share(without(lower.upper()), n),
        "symbols": share(without("#$%&*+<=>@[]^_`{|}~/\\"), n),
        "marks": share(without(".,;:!?"), n),
        "shouts": share(without("!"), n),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at least?, threshold); share: how many labelled rows that it covers are bad."""

    conditions: tuple[tuple[str, bool, float], ...]
    share: float

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, least, cut in self.conditions:
            v = x[:, names.index(name)]
            hit &= v >= cut if least else v < cut
        return hit

    def column(self, row: Column) -> Column:
        out = F.lit(True)
        for name, least, cut in self.conditions:
            v = row[name]
            out = out & ((v >= F.lit(cut)) if least else (v < F.lit(cut)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if least else '<'} {cut:.6g}" for n, least, cut in self.conditions)


def _grow(x, y, names, cuts) -> list[tuple[str, bool, float]]:
    """Adds the condition of the highest FOIL gain until no bad row's company is left or nothing gains."""
    out, live = [], np.ones(len(x), bool)
    while len(out) < 6:
        p0, n0 = int(y[live].sum()), int((~y[live]).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in range(len(names)):
            v = x[live, f]
            order = np.searchsorted(cuts[f], v, "right")
            pos = np.bincount(order[y[live]], minlength=len(cuts[f]) + 1)
            neg = np.bincount(order[~y[live]], minlength=len(cuts[f]) + 1)
            below_p, below_n = np.cumsum(pos)[:-1], np.cumsum(neg)[:-1]
            for least, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
                i = int(np.argmax(gain)) if len(gain) else -1
                if i >= 0 and gain[i] > best[0]:
                    best = (float(gain[i]), (names[f], least, float(cuts[f][i])))
        if best[1] is None or best[1] in out:
            break
        out.append(best[1])
        live &= Rule((best[1],), 0).covers(x, names)
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.8, least: int = 5, cuts: int = 64, seed: int = 7) -> list[Rule]:
    """Rules for bad rows, in order. Each is grown on two thirds of the rows left, pruned from its end on the others for
    (p - n) / (p + n), and taken if at least `precision` of at least `least` rows that it covers are bad; else learning ends."""
    rng, rules = np.random.default_rng(seed), []
    edges = [np.unique(np.concatenate([np.quantile(x[:, f], np.linspace(0, 1, cuts)), np.quantile(x[bad, f], np.linspace(0, 1, cuts))])) if bad.any() else np.zeros(0) for f in range(len(names))]
    while bad.any() and len(rules) < 32:
        grow = np.zeros(len(x), bool)
        for kind in (True, False):  # both parts get their share of each kind
            at = rng.permutation(np.flatnonzero(bad == kind))
            grow[at[: -(-2 * len(at) // 3)]] = True
        conditions = _grow(x[grow], bad[grow], names, edges)
        best = (-2.0, None)
        for k in range(len(conditions), 0, -1):
            hit = Rule(tuple(conditions[:k]), 0).covers(x[~grow], names)
            p, n = int(bad[~grow][hit].sum()), int((~bad[~grow])[hit].sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if worth >= best[0]:
                best = (worth, tuple(conditions[:k]))
        if best[1] is None:
            break
        hit = Rule(best[1], 0).covers(x, names)
        share = float(bad[hit].mean()) if hit.any() else 0.0
        if share < precision or hit.sum() < least:
            break
        rules.append(Rule(best[1], round(share, 6)))
        x, bad = x[~hit], bad[~hit]
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Learns from at most `sample` labelled documents, those of the least hashes of doc_id. quality 0 is bad, 1 is good."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    )
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("l_id"))
    stats = statistics(F.col("text"))
    rows = joined.select("l_id", "quality", *[c.alias(k) for k, c in stats.items()]).toPandas().sort_values(["l_id", *stats])
    return learn(rows[list(stats)].to_numpy(float), rows["quality"].to_numpy() == 0, list(stats))


def expression(rules: list[Rule], row: Column) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(row), F.lit(i)) if out is None else out.when(r.column(row), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """(doc_id, rule, reason, keep) for every row of docs: the rule that throws it out, or 0, '' and true.

    Null texts count as empty ones; labels without doc_id or of another quality than 0 or 1 are left out, and of several for a
    doc_id the worst holds; without labels no rule is learned and all rows are kept; repeated rows are judged each;
    an empty table gives no rows; other columns aren't looked at.
    """
    rules = fit(docs, labels, sample)
    stats = F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()])
    reasons = F.array(*[F.lit(x) for x in ["", *map(str, rules)]])
    judged = docs.select("doc_id", stats.alias("s"))
    return judged.select("doc_id", expression(rules, F.col("s")).alias("rule")).select("doc_id", "rule", F.element_at(reasons, F.col("rule") + 1).alias("reason"), (F.col("rule") == 0).alias("keep"))
