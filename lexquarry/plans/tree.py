"""Index plans: trees of conditions that every matching document meets, their simplification, display and tuning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

MOST_IN_ALL = 32


# ---------------------------------------------------------------- needs: conditions on a document's summary
@dataclass(frozen=True)
class Need:
    """kind and value: min_len n, min_longest_line n, any_byte set, min_counts ((byte, n), ...), line_start set, line_end set,
    starts_with bytes, ends_with bytes. Sets are frozensets of byte values."""

    kind: str
    value: object

    def __str__(self) -> str:
        v = self.value
        if isinstance(v, frozenset):
            v = "{" + ",".join(str(x) for x in sorted(v)) + "}"
        return f"<{self.kind} {v}>"

    def met_by(self, s: dict) -> bool:
        """By a summary as operators.scan gives it, for use without Spark."""
        v = self.value
        if self.kind == "min_len":
            return s["byte_len"] >= v
        if self.kind == "min_longest_line":
            return s["longest_line"] >= v
        counts = s["counts"]
        if self.kind == "any_byte":
            return any(counts[b] for b in v)
        if self.kind == "min_counts":
            return all(counts[b] >= min(n, 255) for b, n in v)
        if self.kind in ("line_start", "line_end"):
            bits = s[self.kind]
            return any(bits[b >> 3] >> (b & 7) & 1 for b in v)
        if self.kind == "starts_with":
            return s["prefix"].startswith(v)
        if self.kind == "ends_with":
            return s["suffix"].endswith(v)
        raise ValueError(self.kind)


# ---------------------------------------------------------------- queries over grams of bytes (before keys)
@dataclass(frozen=True)
class Query:
    """op: all, none, and, or. grams: byte strings that must be in the text."""

    op: str
    grams: frozenset = frozenset()
    subs: frozenset = frozenset()


ALL, NONE = Query("all"), Query("none")


def both(*qs: Query) -> Query:
    grams, subs = set(), set()
    for q in qs:
        if q.op == "none":
            return NONE
        if q.op == "and":
            grams |= q.grams
            subs |= q.subs
        elif q.op == "or":
            subs.add(q)
    # an alternative that a required gram fulfils asks nothing more
    subs = {s for s in subs if not (s.grams & grams)}
    # of two alternatives, the one whose parts are all parts of the other is stronger
    subs = {s for s in subs if not any(o is not s and o.grams <= s.grams and o.subs <= s.subs and (o.grams, o.subs) != (s.grams, s.subs) for o in subs)}
    if not grams and not subs:
        return ALL
    if not grams and len(subs) == 1:
        return next(iter(subs))
    return Query("and", frozenset(grams), frozenset(subs))


def either(*qs: Query) -> Query:
    qs = tuple(q for q in qs if q.op != "none")
    if not qs:
        return NONE
    if any(q.op == "all" for q in qs):
        return ALL
    # what all of them ask is asked once
    ands = [q if q.op == "and" else Query("and", frozenset(), frozenset([q])) for q in qs]
    grams = frozenset.intersection(*[q.grams for q in ands])
    subs = frozenset.intersection(*[q.subs for q in ands])
    rest = [both(Query("and", q.grams - grams, q.subs - subs)) if (q.grams - grams) or (q.subs - subs) else ALL for q in ands]
    common = Query("and", grams, subs) if grams or subs else ALL
    if any(r.op == "all" for r in rest):
        return both(common)
    one, many = set(), set()
    for r in rest:
        if r.op == "and" and len(r.grams) == 1 and not r.subs:
            one |= r.grams
        elif r.op == "or":
            one |= r.grams
            many |= r.subs
        else:
            many.add(r)
    # a branch that asks for one of the single grams and more is weaker as an alternative than the gram alone
    many = {m for m in many if not (m.op == "and" and m.grams & one)}
    if len(one) == 1 and not many:
        return both(common, Query("and", frozenset(one)))
    return both(common, Query("or", frozenset(one), frozenset(many)))


# ---------------------------------------------------------------- plans over keys
@dataclass(frozen=True)
class Needle:
    """Any of `keys` (signed 64-bit), with all bits of `edges` in its mask."""

    keys: tuple[int, ...]
    edges: int = 0

    def __str__(self) -> str:
        names = "".join(c for bit, c in ((32, "<"), (64, ">"), (128, "<>"), (256, "^"), (512, "$")) if self.edges & bit)
        text = "/".join(f"{k & (1 << 64) - 1:016x}" for k in self.keys)
        return f"{text}@{names}" if names else text


@dataclass
class Plan:
    """op: all, none, and, or."""

    op: str
    needles: list[Needle] = field(default_factory=list)
    needs: list[Need] = field(default_factory=list)
    subs: list["Plan"] = field(default_factory=list)

    def __str__(self) -> str:
        if self.op == "all":
            return "+"
        if self.op == "none":
            return "-"
        parts = [*map(str, self.needles), *map(str, self.needs), *(f"({s})" for s in self.subs)]
        return (" " if self.op == "and" else "|").join(parts)

    def keys(self) -> set[int]:
        return {k for n in self.needles for k in n.keys} | {k for s in self.subs for k in s.keys()}

    def gram_count(self) -> int:
        return len(self.needles) + sum(s.gram_count() for s in self.subs)

    def has_grams(self) -> bool:
        return bool(self.needles) or any(s.has_grams() for s in self.subs)

    def always_grams(self) -> bool:
        """Must every document that meets the plan have one of its grams?"""
        if self.op == "and":
            return bool(self.needles) or any(s.always_grams() for s in self.subs)
        if self.op == "or":
            return not self.needs and all(s.always_grams() for s in self.subs)
        return self.op == "none"

    def without_needs(self) -> "Plan":
        """A weaker plan; alternatives with needs stay as they are."""
        if self.op != "and":
            return self
        return Plan(self.op, list(self.needles), [], [s.without_needs() for s in self.subs])

    # tuning
    def tuned(self, df: Callable[[int], int], total: int, stop: int) -> "Plan":
        """Rarest first; in conjunctions, grams in `stop` documents or more and weak alternatives go as long as others stay."""
        subs = [s.tuned(df, total, stop) for s in self.subs]
        cost = lambda n: min(sum(map(df, n.keys)), total)
        needles = [Needle(tuple(sorted(dict.fromkeys(n.keys), key=df)), n.edges) for n in self.needles]
        needles = sorted(needles, key=cost)
        if self.op == "and":
            needles = [n for i, n in enumerate(needles[:MOST_IN_ALL]) if cost(n) < stop or (i == 0 and not subs)]
            weak = [s.op == "or" and not s.needs and not s.subs and sum(cost(n) for n in s.needles) >= stop for s in subs]
            if needles or not all(weak):
                subs = [s for s, w in zip(subs, weak) if not w]
        return Plan(self.op, needles, list(self.needs), subs)

    def estimate(self, df: Callable[[int], int], total: int) -> int:
        """At most so many documents are candidates by the grams: least of a conjunction's parts, sum of an alternative's."""
        if self.op == "all":
            return total
        if self.op == "none":
            return 0
        parts = [min(sum(map(df, n.keys)), total) for n in self.needles] + [s.estimate(df, total) for s in self.subs]
        if self.op == "and":
            return min(parts, default=total)
        return min(sum(parts) + (total if self.needs else 0), total)

    # execution without Spark
    def run(self, masks: Callable[[int], dict], summaries: dict, block: bool = True) -> dict:
        """{document: mask} that meet the plan. masks(key): {document: mask}; summaries: {document: summary}."""
        if self.op == "none":
            return {}
        if self.op == "all":
            return dict.fromkeys(summaries, 1023)
        parts = []
        for n in self.needles:
            out: dict = {}
            for k in n.keys:
                for d, m in masks(k).items():
                    if m & n.edges == n.edges:
                        out[d] = out.get(d, 0) | m | (0 if block else 31)
            parts.append(out)
        parts += [s.run(masks, summaries, block) for s in self.subs]
        for n in self.needs:
            parts.append({d: 1023 for d, s in summaries.items() if n.met_by(s)})
        if self.op == "or":
            out = {}
            for p in parts:
                for d, m in p.items():
                    out[d] = out.get(d, 0) | m
            return out
        out = dict.fromkeys(summaries, 1023)
        for p in parts:
            out = {d: m & p[d] for d, m in out.items() if d in p and m & p[d] & 31}
        return out
