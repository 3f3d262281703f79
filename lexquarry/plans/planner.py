"""From a regex to an index plan. Each part of the pattern is summed up by the strings that its matches are, or begin and end
with, and by a query that every text with a match meets; strings turn into grams when they can grow no more.

Everything here errs on the side of too many candidates: what can't be said about a part is `any`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lexquarry.functions.grams import LINE_END, LINE_START, WORD_BOTH, WORD_END, WORD_START, maximal_grams
from lexquarry.functions.hashing import folded, key_of
from lexquarry.functions.weights import WeightTable
from lexquarry.plans.syntax import Alt, Cat, Cls, Empty, Flags, Group, Lit, Look, Rep, folds, parse
from lexquarry.plans.tree import ALL, NONE, Need, Plan, Needle, Query, both, either

MOST_EXACT, MOST_SET, LONG, STUB, MOST_CLASS = 512, 128, 48, 8, 100
GRAM_BUDGET, MOST_EXPANDED = 1024, 6
ANY = frozenset([b""])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


@dataclass(frozen=True)
class Info:
    """exact: all matches, if they are few; else prefix and suffix: every match begins (ends) with one of these."""

    empty: bool
    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    query: Query
    plus: frozenset | None = None  # the part is one or more of these strings

    @property
    def heads(self) -> frozenset:
        return self.exact if self.exact is not None else self.prefix

    @property
    def tails(self) -> frozenset:
        return self.exact if self.exact is not None else self.suffix


def exactly(strings) -> Info:
    s = frozenset(strings)
    return Info(b"" in s, s, s, s, ALL if s else NONE)


NOTHING = Info(False, frozenset(), frozenset(), frozenset(), NONE)
UNKNOWN = Info(True, None, ANY, ANY, ALL)
ONE = Info(False, None, ANY, ANY, ALL)


class Planner:
    def __init__(self, table: WeightTable, fold: bool, secret: int = 0):
        self.weights, self.fold, self.secret = np.asarray(table.weights), fold, secret
        self.budget = GRAM_BUDGET
        self.memory: dict[bytes, tuple[bytes, ...]] = {}

    # ---- strings to grams
    def grams(self, s: bytes) -> tuple[bytes, ...]:
        g = self.memory.get(s)
        if g is None:
            g = self.memory[s] = tuple(dict.fromkeys(s[a:b] for a, b in maximal_grams(s, self.weights)))
        return g

    def cover(self, strings: frozenset) -> Query:
        """One of the strings is in the text."""
        if not strings:
            return NONE
        if min(map(len, strings)) < 3:
            return ALL
        strings = minimal(strings)
        sets = [self.grams(s) for s in strings]
        allowance = max(self.budget // 2, 256)
        if sum(map(len, sets)) > allowance:  # the longest gram of each
            sets = [(max(g, key=len),) for g in sets]
            if len(sets) > allowance:
                return ALL
        self.budget -= sum(map(len, sets))
        return either(*[both(Query("and", frozenset(g))) for g in sets])

    def bounded(self, s: frozenset, head: bool) -> tuple[frozenset, Query]:
        """The set within bounds, and what is known of it before it was cut."""
        if len(s) <= MOST_SET and all(len(x) <= LONG for x in s):
            return s, ALL
        q = self.cover(s)
        n = STUB
        out = frozenset(x[:n] if head else x[-n:] for x in s)
        while len(out) > MOST_SET and n > 1:
            n -= 1
            out = frozenset(x[:n] if head else x[-n:] for x in s)
        return (out if len(out) <= MOST_SET else ANY), q

    def opened(self, x: Info) -> Info:
        """An exact info as an inexact one."""
        if x.exact is None:
            return x
        p, q1 = self.bounded(x.exact, True)
        s, q2 = self.bounded(x.exact, False)
        return Info(x.empty, None, p, s, both(x.query, q1, q2))

    # ---- nodes
    def lower(self, s: str) -> bytes:
        b = s.encode("utf-8", "surrogatepass")
        return b.translate(_LOWER) if self.fold else b

    def info(self, node, lead: bool = False, trail: bool = False) -> Info:
        if isinstance(node, Empty):
            return exactly([b""])
        if isinstance(node, Lit):
            return exactly([self.lower(node.text)])
        if isinstance(node, Cls):
            if node.nothing():
                return NOTHING
            m = node.members(MOST_CLASS)
            if m is None:
                return self.wide(node)
            return exactly(self.lower(c) for c in m)
        if isinstance(node, Group):
            return self.info(node.sub, lead, trail)
        if isinstance(node, Alt):
            return self.alternation([self.info(p, lead, trail) for p in node.parts])
        if isinstance(node, Rep):
            return self.repetition(node)
        if isinstance(node, Look):
            return self.edge(node, lead, trail) or exactly([b""])
        if isinstance(node, Cat):
            return self.concat(node.parts, lead, trail)
        raise TypeError(node)

    def edge(self, node: Look, lead: bool, trail: bool) -> Info | None:
        ends = [b"\n", b"\r"] if node.crlf else [b"\n"]
        if lead and node.kind in ("start_line", "start_text"):
            return exactly(ends if node.kind == "start_line" else [b"\n"])
        if trail and node.kind in ("end_line", "end_text"):
            return exactly(ends if node.kind == "end_line" else [b"\n"])
        return None

    def wide(self, node: Cls) -> Info:
        """A class of many members: their first and last bytes, if these are few."""
        if node.named or node.negated or node.both or node.minus or node.nested:
            return ONE
        low = [(lo, min(hi, 127)) for lo, hi in node.ranges if lo < 128]
        if sum(hi - lo + 1 for lo, hi in low) > 64 or any(hi > 127 and lo < 128 for lo, hi in node.ranges):
            return ONE
        high = [r for r in node.ranges if r[0] >= 128]
        first = {self.lower(chr(c)) for lo, hi in low for c in range(lo, hi + 1)}
        if high:
            lead = {chr(lo).encode("utf-8", "surrogatepass")[0] for lo, _ in high} | {chr(hi).encode("utf-8", "surrogatepass")[0] for _, hi in high}
            first |= {bytes([b]) for b in range(min(lead), max(lead) + 1)}
            last = {self.lower(chr(c)) for lo, hi in low for c in range(lo, hi + 1)} | {bytes([b]) for b in range(0x80, 0xC0)}
        else:
            last = first
        return Info(False, None, frozenset(first) if len(first) <= MOST_SET else ANY, frozenset(last) if len(last) <= MOST_SET else ANY, ALL)

    def alternation(self, parts: list[Info]) -> Info:
        parts = [p for p in parts if p.query.op != "none"]
        if not parts:
            return NOTHING
        if all(p.exact is not None for p in parts):
            s = frozenset().union(*[p.exact for p in parts])
            if len(s) <= MOST_EXACT:
                return Info(b"" in s, s, s, s, either(*[p.query for p in parts]))
        # what is exact beside what is not becomes a query of its own branch
        qs = [both(p.query, self.cover(p.exact)) if p.exact is not None else p.query for p in parts]
        parts = [self.opened(p) for p in parts]
        pre, q1 = self.bounded(frozenset().union(*[p.prefix for p in parts]), True)
        suf, q2 = self.bounded(frozenset().union(*[p.suffix for p in parts]), False)
        return Info(any(p.empty for p in parts), None, pre, suf, both(either(*qs), q1, q2))

    def concat(self, nodes, lead: bool, trail: bool) -> Info:
        nodes = list(nodes)
        out: Info | None = None
        looks: list[Look] = []
        for i, n in enumerate(nodes):
            first, last = lead and i == 0, trail and i == len(nodes) - 1
            if isinstance(n, Look):
                e = self.edge(n, first, last)
                if e is None:
                    looks.append(n)
                    continue
                y = e
            else:
                y = self.info(n, first, last)
            if out is None:
                # a look before everything: what the first string begins with is all that is known
                out = self.ahead(looks, y)
            else:
                out = self.pair(out, y, looks)
            looks = []
            if out.query.op == "none":
                return NOTHING
        if out is None:
            out = exactly([b""])
        return self.after(out, looks)

    def ahead(self, looks: list[Look], y: Info) -> Info:
        for k in looks:
            keep = frozenset(s for s in y.heads if compatible(k, None, s))
            if not keep:
                return NOTHING
            if y.exact is not None:
                y = exactly(keep) if y.query.op == "all" else Info(b"" in keep, keep, keep, keep, y.query)
        return y

    def after(self, x: Info, looks: list[Look]) -> Info:
        for k in looks:
            keep = frozenset(s for s in x.tails if compatible(k, s, None))
            if not keep:
                return NOTHING
            if x.exact is not None:
                x = Info(b"" in keep, keep, keep, keep, x.query)
        return x

    def pair(self, x: Info, y: Info, looks: list[Look] = ()) -> Info:
        ok = lambda a, b: all(compatible(k, a or None, b or None) for k in looks)
        query = both(x.query, y.query)
        if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST_EXACT:
            s = frozenset(a + b for a in x.exact for b in y.exact if ok(a, b))
            if not s:
                return NOTHING
            if sum(map(len, s)) <= 65536:
                return Info(b"" in s, s, s, s, query)
        tails, heads = x.tails, y.heads
        if b"" not in tails and b"" not in heads and looks and not any(ok(a, b) for a in tails for b in heads):
            return NOTHING
        seam = ALL
        if b"" not in tails and b"" not in heads and not x.empty and not y.empty and (x.exact is None and y.exact is None or len(tails) * len(heads) > MOST_EXACT):
            if len(tails) * len(heads) <= 2048:
                seam = self.cover(frozenset(a + b for a in tails for b in heads if ok(a, b)))
        # prefix
        if x.plus and len(x.plus) * (len(heads) + len(x.plus)) <= MOST_EXACT:  # one of them before y, or two of them
            pre = frozenset(a + b for a in x.plus for b in heads | x.plus)
        elif x.exact is not None and len(x.exact) * len(heads) <= MOST_EXACT:
            pre = frozenset(a + b for a in x.exact for b in heads if ok(a, b))
        else:
            x = self.opened(x)
            pre = x.prefix | heads if x.empty else x.prefix
        if y.plus and len(y.plus) * (len(tails) + len(y.plus)) <= MOST_EXACT:
            suf = frozenset(a + b for a in tails | y.plus for b in y.plus)
        elif y.exact is not None and len(tails) * len(y.exact) <= MOST_EXACT:
            suf = frozenset(a + b for a in tails for b in y.exact if ok(a, b))
        else:
            y = self.opened(y)
            suf = y.suffix | tails if y.empty else y.suffix
        pre, q1 = self.bounded(pre, True)
        suf, q2 = self.bounded(suf, False)
        return Info(x.empty and y.empty, None, pre, suf, both(query, x.query, y.query, seam, q1, q2))

    def repetition(self, node: Rep) -> Info:
        lo, hi = node.least, node.most
        if hi == 0:
            return exactly([b""])
        x = self.info(node.sub)
        if x.query.op == "none" and (x.exact is not None and not x.exact):
            return exactly([b""]) if lo == 0 else NOTHING
        if lo == 0 and hi == 1:
            return self.alternation([x, exactly([b""])])
        if lo == 0:
            return UNKNOWN if b"" in x.heads or b"" in x.tails else Info(True, None, ANY, ANY, ALL)
        copies = self.times(x, min(lo, 64))
        if lo <= 64 and hi is not None and hi - lo <= MOST_EXPANDED:
            if hi == lo:
                return copies
            if x.exact is not None:
                out, now = [copies], copies
                for _ in range(hi - lo):
                    now = self.pair(now, x)
                    if now.exact is None:
                        break
                    out.append(now)
                else:
                    return self.alternation(out)
        # at least lo: begins and ends with lo copies
        if lo == 1 and hi is None and x.exact and b"" not in x.exact and len(x.exact) <= 16:
            return Info(False, None, x.exact, x.exact, both(x.query, self.cover(x.exact)), x.exact)
        c = self.opened(copies)
        return Info(x.empty, None, c.prefix, c.suffix, both(c.query, copies.query, self.cover(copies.exact) if copies.exact else ALL))

    def times(self, x: Info, n: int) -> Info:
        out = x
        for _ in range(n - 1):
            out = self.pair(out, x)
        return out

    def finished(self, x: Info) -> Query:
        if x.exact is not None:
            return both(x.query, self.cover(x.exact))
        return both(x.query, self.cover(x.prefix), self.cover(x.suffix))

    # ---- keys
    def needle(self, gram: bytes, edges: int = 0) -> Needle:
        keys = [key_of(gram, self.secret)]
        if self.fold and any(97 <= c <= 122 for c in gram):
            keys.append(key_of(gram, folded(self.secret)))
        return Needle(tuple(keys), edges)

    def plan(self, q: Query) -> Plan:
        subs = sorted((self.plan(s) for s in q.subs), key=str)
        return Plan(q.op, [self.needle(g) for g in sorted(q.grams)], [], subs)


def minimal(strings: frozenset) -> frozenset:
    """Without those that have another of them inside."""
    if len(strings) > 256:
        return strings
    out: list[bytes] = []
    for s in sorted(strings, key=len):
        if not any(o in s for o in out):
            out.append(s)
    return frozenset(out)


def compatible(k: Look, before: bytes | None, after: bytes | None) -> bool:
    """Can the look hold between two strings? None or an empty string: nothing is known of that side."""
    b = before[-1] if before else None
    a = after[0] if after else None
    if k.kind in ("start_line", "end_line"):
        if k.crlf:
            return (b in (None, 10, 13)) if k.kind == "start_line" else (a in (None, 10, 13))
        return (b in (None, 10)) if k.kind == "start_line" else (a in (None, 10))
    if k.kind == "start_text":
        return before in (None, b"")
    if k.kind == "end_text":
        return after in (None, b"")
    if b is not None and b >= 128 or a is not None and a >= 128:
        return True
    wb = None if b is None else b in _WORD
    wa = None if a is None else a in _WORD
    if k.kind == "word":
        return wb is None or wa is None or wb != wa
    if k.kind == "not_word":
        return wb is None or wa is None or wb == wa
    if k.kind == "word_start":
        return wa is not False and wb is not True
    if k.kind == "word_end":
        return wb is not False and wa is not True
    if k.kind == "half_start":
        return wb is not True
    if k.kind == "half_end":
        return wa is not True
    return True


# ---------------------------------------------------------------- facts for needs
def shortest(node) -> int:
    """Bytes that any match has at least; a class counts 1."""
    if isinstance(node, Lit):
        return len(node.text.encode("utf-8", "surrogatepass"))
    if isinstance(node, Cls):
        return 1
    if isinstance(node, Cat):
        return sum(map(shortest, node.parts))
    if isinstance(node, Alt):
        return min(map(shortest, node.parts))
    if isinstance(node, Group):
        return shortest(node.sub)
    if isinstance(node, Rep):
        return node.least * shortest(node.sub)
    return 0


def byte_counts(node) -> dict[int, int]:
    """Bytes that any match has, and how many of each at least. Only literals count."""
    if isinstance(node, Lit):
        out: dict[int, int] = {}
        for b in node.text.encode("utf-8", "surrogatepass"):
            out[b] = out.get(b, 0) + 1
        return out
    if isinstance(node, Cat):
        out = {}
        for p in node.parts:
            for b, n in byte_counts(p).items():
                out[b] = out.get(b, 0) + n
        return out
    if isinstance(node, Alt):
        parts = [byte_counts(p) for p in node.parts]
        return {b: min(p.get(b, 0) for p in parts) for b in parts[0] if all(b in p for p in parts)}
    if isinstance(node, Group):
        return byte_counts(node.sub)
    if isinstance(node, Rep) and node.least:
        return {b: n * node.least for b, n in byte_counts(node.sub).items()}
    return {}


def required_classes(node) -> list[frozenset]:
    """Byte sets of which any match has a member: first bytes of classes that must occur."""
    if isinstance(node, Cls):
        m = node.members(128)
        return [frozenset(c.encode("utf-8", "surrogatepass")[0] for c in m)] if m else []
    if isinstance(node, Cat):
        return [s for p in node.parts for s in required_classes(p)]
    if isinstance(node, Group):
        return required_classes(node.sub)
    if isinstance(node, Rep) and node.least:
        return required_classes(node.sub)
    return []


def crosses_lines(node) -> bool:
    """May a match hold a line feed?"""
    if isinstance(node, Lit):
        return "\n" in node.text
    if isinstance(node, Cls):
        if node.negated and not (node.both or node.minus or node.nested or node.named):
            return not any(lo <= 10 <= hi for lo, hi in node.ranges)
        if node.negated or node.named or node.nested or node.both or node.minus:
            return True
        return any(lo <= 10 <= hi for lo, hi in node.ranges)
    if isinstance(node, (Cat, Alt)):
        return any(map(crosses_lines, node.parts))
    if isinstance(node, (Group, Rep)):
        return crosses_lines(node.sub)
    return False


def _ends(node, kinds: tuple[str, ...], last: bool) -> bool:
    """Does every match begin (end) with such a look?"""
    if isinstance(node, Look):
        return node.kind in kinds
    if isinstance(node, Cat):
        return _ends(node.parts[-1 if last else 0], kinds, last)
    if isinstance(node, Alt):
        return all(_ends(p, kinds, last) for p in node.parts)
    if isinstance(node, Group):
        return _ends(node.sub, kinds, last)
    return False


def root_needs(node, info: Info, fold: bool, lines: bool) -> list[Need]:
    out = []
    n = shortest(node)
    if n:
        out.append(Need("min_len", n))
        if lines or not crosses_lines(node):
            out.append(Need("min_longest_line", n))
    counts = {b: min(c, 255) for b, c in byte_counts(node).items() if not (fold and (65 <= b <= 90 or 97 <= b <= 122))}
    counts = {b: c for b, c in counts.items() if b < 128 or not fold}
    if counts:
        out.append(Need("min_counts", tuple(sorted(counts.items()))))
    out += [Need("any_byte", s) for s in dict.fromkeys(required_classes(node)) if len(s) <= 128][:4]
    crlf = _has_crlf(node)
    for kinds, last, kind, edge in ((("start_line", "start_text"), False, "line_start", "starts_with"), (("end_line", "end_text"), True, "line_end", "ends_with")):
        if not _ends(node, kinds, last) or crlf:
            continue
        strings = info.tails if last else info.heads
        inner = [s[:-1] if last and s.endswith(b"\n") else s[1:] if not last and s.startswith(b"\n") else None for s in strings]
        if not inner or None in inner or b"" in inner:
            continue
        ends = frozenset(s[-1] if last else s[0] for s in inner)
        if fold:
            ends |= frozenset(b - 32 for b in ends if 97 <= b <= 122)
        if b"\n"[0] not in ends and len(ends) <= 128:
            out.append(Need(kind, ends))
        text_only = _ends(node, (kinds[1],), last)
        if text_only and not lines and len(inner) == 1 and not fold:
            out.append(Need(edge, inner[0][-16:] if last else inner[0][:16]))
    return out


def _has_crlf(node) -> bool:
    if isinstance(node, Look):
        return node.crlf
    if isinstance(node, (Cat, Alt)):
        return any(map(_has_crlf, node.parts))
    if isinstance(node, (Group, Rep)):
        return _has_crlf(node.sub)
    return False


def _whole_literal(node) -> tuple[str, Lit] | None:
    """('word' or 'line', literal) if the pattern is one literal between word boundaries or line ends."""
    if isinstance(node, Group):
        return _whole_literal(node.sub)
    if isinstance(node, Cat) and len(node.parts) == 3 and isinstance(node.parts[0], Look) and isinstance(node.parts[2], Look):
        a, middle, b = node.parts
        while isinstance(middle, Group):
            middle = middle.sub
        if isinstance(middle, Lit):
            if (a.kind, b.kind) in (("word", "word"), ("half_start", "half_end"), ("word_start", "word_end")):
                return "word", middle
            if (a.kind, b.kind) == ("start_line", "end_line"):
                return "line", middle
    return None


def make_plan(pattern: str, table: WeightTable, flags: Flags = Flags(), lines: bool = True, secret: int = 0) -> Plan:
    """The plan of a pattern. lines: matches are looked for line by line."""
    fold = flags.i or folds(pattern)
    return plan_tree(parse(pattern, flags), table, fold, lines, secret)


def plan_tree(node, table: WeightTable, fold: bool = False, lines: bool = True, secret: int = 0) -> Plan:
    planner = Planner(table, fold, secret)
    info = planner.info(node, True, True)
    query = planner.finished(info)
    if query.op == "none":
        return Plan("none")
    plan = planner.plan(query)
    special = _whole_literal(node)
    if special:
        kind, lit = special
        text = planner.lower(lit.text)
        ends_are_words = len(text) > 0 and text[0] in _WORD and text[-1] in _WORD
        if kind == "line" or ends_are_words:
            edged = []
            for a, b in maximal_grams(text, planner.weights):
                whole = a == 0 and b == len(text)
                if kind == "word":
                    bits = (WORD_BOTH if whole else 0) | (WORD_START if a == 0 else 0) | (WORD_END if b == len(text) else 0)
                else:
                    bits = (LINE_START if a == 0 else 0) | (LINE_END if b == len(text) else 0)
                if bits and "\n" not in lit.text:
                    edged.append(planner.needle(text[a:b], bits))
            if edged:
                if plan.op == "and":
                    plain = {n.keys for n in edged}
                    plan.needles = [n for n in plan.needles if n.keys not in plain] + edged
                elif plan.op == "all":
                    plan = Plan("and", edged)
    needs = root_needs(node, info, fold, lines)
    if plan.op == "all":
        return Plan("and", [], needs) if needs else plan
    if plan.op == "or":
        plan = Plan("and", [], [], [plan])
    plan.needs = needs
    return plan
