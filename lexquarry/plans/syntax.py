"""Parser of the search dialect: a linear-time regex syntax with inline flags, Unicode classes and class set operations.

The tree has case folding, line mode, dot mode and greed resolved into its nodes, so that translation and planning need no flags.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace
from functools import lru_cache

MAX_PATTERN, MAX_NEST, MAX_CODE = 4096, 250, 0x10FFFF
sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))  # a level of nesting takes a few frames


class PatternError(ValueError):
    """A pattern that is no regex of this dialect."""


class PatternTooLong(PatternError):
    pass


class NeedsNewline(PatternError):
    """A pattern that asks for a line feed where lines are searched one by one."""


# ---------------------------------------------------------------- tree
@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Lit:
    text: str


@dataclass(frozen=True)
class Cls:
    """A set of characters: ranges of code points, named sets ('w', 'd', 's', 'p:Greek', each with '^' before it if negated) and
    nested classes; `minus` and `both` are set operations. fold: named sets match without regard to case."""

    ranges: tuple[tuple[int, int], ...] = ()
    named: tuple[str, ...] = ()
    nested: tuple["Cls", ...] = ()
    negated: bool = False
    both: tuple["Cls", ...] = ()
    minus: tuple["Cls", ...] = ()
    fold: bool = False
    unicode: bool = True

    def members(self, most: int) -> list[str] | None:
        """All members if there are at most `most` and they are listed; else None."""
        if self.negated or self.named or self.both or self.minus:
            return None
        parts = [*self.ranges]
        out: set[int] = set()
        for lo, hi in parts:
            if hi - lo + 1 > most:
                return None
            out.update(range(lo, hi + 1))
            if len(out) > most:
                return None
        for n in self.nested:
            m = n.members(most)
            if m is None:
                return None
            out.update(map(ord, m))
        return [chr(c) for c in sorted(out)] if len(out) <= most else None

    def nothing(self) -> bool:
        """Is this the empty set for sure? ('[^\\s\\S]' and the like)"""
        if self.negated:
            whole = set(self.named)
            return any(("^" + n in whole) for n in whole) or (0, MAX_CODE) in self.ranges
        return not (self.ranges or self.named or self.nested)


@dataclass(frozen=True)
class Look:
    """kind: start_line, end_line, start_text, end_text, word, not_word, word_start, word_end, half_start, half_end."""

    kind: str
    crlf: bool = False
    unicode: bool = True


@dataclass(frozen=True)
class Cat:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Rep:
    sub: object
    least: int
    most: int | None
    greedy: bool = True


@dataclass(frozen=True)
class Group:
    sub: object
    index: int
    name: str | None = None


@dataclass(frozen=True)
class Flags:
    i: bool = False
    m: bool = True
    s: bool = False
    U: bool = False
    u: bool = True
    x: bool = False
    R: bool = False


# ---------------------------------------------------------------- case folding
def simple_fold(c: str) -> str:
    f = c.casefold()
    if len(f) != 1:
        f = c.lower()
    return f if len(f) == 1 else c


@lru_cache(1)
def _fold_groups() -> dict[str, tuple[str, ...]]:
    groups: dict[str, list[str]] = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        f = simple_fold(c)
        if f != c:
            groups.setdefault(f, [f]).append(c)
    return {c: tuple(sorted(g)) for g in groups.values() for c in g}


def equivalents(c: str, unicode: bool = True) -> tuple[str, ...]:
    """All characters that match c where case doesn't count, c among them."""
    if not unicode:
        return tuple(sorted({c, c.lower(), c.upper()})) if c.isascii() else (c,)
    return _fold_groups().get(c, (c,))


def folded_ranges(ranges, unicode: bool = True) -> tuple[tuple[int, int], ...]:
    out = list(ranges)
    cased = _fold_groups() if unicode else {c: equivalents(c, False) for c in map(chr, range(65, 123)) if c.isalpha()}
    for lo, hi in ranges:
        if hi - lo < 64:
            inside = [c for c in map(chr, range(lo, hi + 1)) if c in cased]
        else:
            inside = [c for c in cased if lo <= ord(c) <= hi]
        for c in inside:
            out += [(ord(e), ord(e)) for e in cased[c]]
    return merged(out)


def merged(ranges) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((a, b) for a, b in out)


POSIX = {
    "alpha": [(65, 90), (97, 122)], "digit": [(48, 57)], "alnum": [(48, 57), (65, 90), (97, 122)], "upper": [(65, 90)], "lower": [(97, 122)],
    "space": [(9, 13), (32, 32)], "blank": [(9, 9), (32, 32)], "punct": [(33, 47), (58, 64), (91, 96), (123, 126)], "xdigit": [(48, 57), (65, 70), (97, 102)],
    "word": [(48, 57), (65, 90), (95, 95), (97, 122)], "cntrl": [(0, 31), (127, 127)], "graph": [(33, 126)], "print": [(32, 126)], "ascii": [(0, 127)],
}
ASCII_NAMED = {"w": POSIX["word"], "d": POSIX["digit"], "s": POSIX["space"]}
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}


def complement(ranges) -> tuple[tuple[int, int], ...]:
    out, at = [], 0
    for lo, hi in merged(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= MAX_CODE:
        out.append((at, MAX_CODE))
    return tuple(out)


# ---------------------------------------------------------------- parser
class _Parser:
    def __init__(self, pattern: str, flags: Flags):
        self.p, self.i, self.flags, self.groups, self.depth, self.names = pattern, 0, flags, 0, 0, set()

    def fail(self, why: str):
        raise PatternError(f"{why} at {self.i} in {self.p!r}")

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def starts(self, s: str) -> bool:
        return self.p.startswith(s, self.i)

    def alternation(self):
        self.depth += 1
        if self.depth > MAX_NEST:
            self.fail("nested too deep")
        before = self.flags
        parts = [self.concat()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.concat())
        self.flags = before
        self.depth -= 1
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def concat(self):
        parts: list = []
        while self.i < len(self.p) and self.peek() not in "|)":
            if self.flags.x and self.peek().isspace():
                self.i += 1
                continue
            if self.flags.x and self.peek() == "#":
                while self.i < len(self.p) and self.peek() != "\n":
                    self.i += 1
                continue
            atom = self.atom()
            if atom is None:  # a flag group
                continue
            parts.append(self.repeats(atom))
        return _joined(parts)

    def repeats(self, atom):
        while True:
            while self.flags.x and self.peek().isspace():
                self.i += 1
            c = self.peek()
            if c == "*":
                lo, hi = 0, None
            elif c == "+":
                lo, hi = 1, None
            elif c == "?":
                lo, hi = 0, 1
            elif c == "{":
                end = self.p.find("}", self.i)
                if end < 0:
                    self.fail("unclosed repetition")
                body = self.p[self.i + 1 : end].replace(" ", "")
                a, comma, b = body.partition(",")
                if (a and not a.isdigit()) or (b and not b.isdigit()) or not (a or b):
                    self.fail("no number in repetition")
                lo = int(a or 0)
                hi = lo if not comma else int(b) if b else None
                if hi is not None and hi < lo:
                    self.fail("repetition from more to less")
                if max(lo, hi or 0) > 1000:
                    self.fail("repetition of more than 1000")
                self.i = end
            else:
                return atom
            if isinstance(atom, Look) and c in "*+?":
                pass  # allowed, if useless
            self.i += 1
            greedy = True
            if self.peek() == "?":
                self.i += 1
                greedy = False
            atom = Rep(atom, lo, hi, greedy != self.flags.U)

    def atom(self):
        c = self.peek()
        f = self.flags
        if c == "(":
            return self.group()
        if c in "*+?":
            self.fail("nothing to repeat")
        if c == "{" :
            self.fail("nothing to repeat")
        self.i += 1
        if c == ".":
            if f.s:
                return Cls(((0, MAX_CODE),))
            return Cls(((10, 10), (13, 13)) if f.R else ((10, 10),), negated=True)
        if c == "^":
            return Look("start_line" if f.m else "start_text", f.R)
        if c == "$":
            return Look("end_line" if f.m else "end_text", f.R)
        if c == "[":
            return self.cls()
        if c == "\\":
            return self.escape()
        return self.literal(c)

    def literal(self, c: str):
        if self.flags.i:
            e = equivalents(c, self.flags.u)
            if len(e) > 1:
                return Cls(merged((ord(x), ord(x)) for x in e))
        return Lit(c)

    def group(self):
        self.i += 1
        before, name, capture = self.flags, None, True
        if self.starts("?P<") or self.starts("?<"):
            self.i += 3 if self.starts("?P<") else 2
            if self.peek() in "=!":
                self.fail("look-behind isn't supported")
            end = self.p.find(">", self.i)
            name = self.p[self.i : end] if end > 0 else ""
            if not name or not (name[0].isalpha() or name[0] == "_") or not all(x.isalnum() or x in "_.[]" for x in name):
                self.fail("bad group name")
            if name in self.names:
                self.fail("group name used twice")
            self.names.add(name)
            self.i = end + 1
        elif self.starts("?"):
            self.i += 1
            on, new, any_flag = True, {}, False
            if self.peek() in ("=", "!", "") or self.starts("<"):
                self.fail("look-around isn't supported")
            while self.peek() not in ":)":
                x = self.peek()
                if not x:
                    self.fail("unclosed group")
                if x == "-":
                    if not on:
                        self.fail("two minus signs in flags")
                    on = False
                elif x in "imsUuxR":
                    if x in new:
                        self.fail("flag given twice")
                    new[x] = on
                    any_flag = True
                else:
                    self.fail("unknown flag")
                self.i += 1
            if self.peek() == ")":
                if not any_flag:
                    self.fail("no flags")
                self.i += 1
                self.flags = replace(self.flags, **new)
                return None
            self.i += 1
            self.flags = replace(self.flags, **new)
            capture = False
        index = 0
        if capture:
            self.groups += 1
            index = self.groups
        sub = self.alternation()
        if self.peek() != ")":
            self.fail("unclosed group")
        self.i += 1
        self.flags = before
        return Group(sub, index, name) if capture else sub

    def code(self, kind: str) -> str:
        """The character of \\x, \\u or \\U; the letter is read already."""
        if self.peek() == "{":
            end = self.p.find("}", self.i)
            digits, self.i = self.p[self.i + 1 : end], end + 1
            if end < 0:
                self.fail("unclosed escape")
        else:
            n = {"x": 2, "u": 4, "U": 8}[kind]
            digits, self.i = self.p[self.i : self.i + n], self.i + n
        try:
            v = int(digits, 16)
            if 0xD800 <= v <= 0xDFFF:
                raise ValueError
            return chr(v)
        except ValueError:
            self.fail("no such character")

    def property(self, negated: bool) -> str:
        if self.peek() == "{":
            end = self.p.find("}", self.i)
            if end < 0:
                self.fail("unclosed property")
            name, self.i = self.p[self.i + 1 : end], end + 1
        else:
            name, self.i = self.peek(), self.i + 1
        if name.startswith("^"):
            negated, name = not negated, name[1:]
        if not name:
            self.fail("no property")
        return ("^" if negated else "") + "p:" + name

    def named(self, c: str, unicode: bool) -> Cls:
        """\\w, \\d, \\s and their negations."""
        if unicode:
            return Cls(named=(("^" if c.isupper() else "") + c.lower(),))
        r = merged(ASCII_NAMED[c.lower()])
        return Cls(complement(r) if c.isupper() else r, unicode=False)

    def escape(self):
        c = self.peek()
        if not c:
            self.fail("nothing after a backslash")
        self.i += 1
        f = self.flags
        if c in "wWdDsS":
            return self.named(c, f.u)
        if c in "pP":
            return Cls(named=(self.property(c == "P"),), fold=f.i)
        if c in "xuU":
            ch = self.code(c)
            if not f.u and c == "x" and ord(ch) > 127:
                self.fail("single bytes over 7F aren't supported")
            return self.literal(ch)
        if c in "bB":
            if c == "b" and self.peek() == "{":
                for text, kind in (("{start}", "word_start"), ("{end}", "word_end"), ("{start-half}", "half_start"), ("{end-half}", "half_end")):
                    if self.starts(text):
                        self.i += len(text)
                        return Look(kind, unicode=f.u)
            return Look("word" if c == "b" else "not_word", unicode=f.u)
        if c in "<>":
            return Look("word_start" if c == "<" else "word_end", unicode=f.u)
        if c == "A":
            return Look("start_text")
        if c == "z":
            return Look("end_text")
        if c in _SIMPLE:
            return self.literal(_SIMPLE[c])
        if c.isdigit():
            self.fail("back references and octal codes aren't supported")
        if c.isascii() and c.isalpha():
            self.fail("unknown escape")
        return self.literal(c)

    # classes
    def cls(self) -> Cls:
        """A bracketed class; its '[' is read already."""
        self.depth += 1
        if self.depth > MAX_NEST:
            self.fail("nested too deep")
        negated = False
        if self.peek() == "^":
            negated, self.i = True, self.i + 1
        left, ops, first = self.items(True), [], True
        while True:
            if self.starts("&&") or self.starts("--") or self.starts("~~"):
                op = self.p[self.i : self.i + 2]
                self.i += 2
                ops.append((op, self.items(False)))
            elif self.peek() == "]":
                self.i += 1
                break
            else:
                self.fail("unclosed class")
        out = left
        for op, right in ops:
            if op == "&&":
                out = Cls(nested=(out,), both=(right,))
            elif op == "--":
                out = Cls(nested=(out,), minus=(right,))
            else:
                out = Cls(nested=(Cls(nested=(out,), minus=(right,)), Cls(nested=(right,), minus=(out,))))
        self.depth -= 1
        if negated:
            out = Cls(nested=(out,), negated=True) if out.both or out.minus or out.negated else replace(out, negated=True)
        return out

    def items(self, first: bool) -> Cls:
        ranges: list[tuple[int, int]] = []
        named: list[str] = []
        nested: list[Cls] = []
        f = self.flags
        while True:
            if self.i >= len(self.p):
                self.fail("unclosed class")
            c = self.peek()
            if c == "]" and not first:
                break
            if not first and (self.starts("&&") or self.starts("--") or self.starts("~~")):
                break
            if f.x and c.isspace():
                self.i += 1
                continue
            first = False
            if self.starts("[:"):
                end = self.p.find(":]", self.i)
                name = self.p[self.i + 2 : end] if end > 0 else ""
                neg = name.startswith("^")
                if name.lstrip("^") in POSIX:
                    self.i = end + 2
                    r = POSIX[name.lstrip("^")]
                    ranges += complement(r) if neg else r
                    continue
            if c == "[":
                self.i += 1
                nested.append(self.cls())
                continue
            lo = self.item()
            if isinstance(lo, Cls):
                ranges += lo.ranges
                named += lo.named
                continue
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", "-", ""):
                self.i += 1
                hi = self.item()
                if isinstance(hi, Cls) or ord(hi) < ord(lo):
                    self.fail("bad range")
                ranges.append((ord(lo), ord(hi)))
            else:
                ranges.append((ord(lo), ord(lo)))
        r = merged(ranges)
        if f.i:
            r = folded_ranges(r, f.u)
        return Cls(r, tuple(dict.fromkeys(named)), tuple(nested), fold=f.i, unicode=f.u)

    def item(self):
        c = self.peek()
        self.i += 1
        if c != "\\":
            return c
        c = self.peek()
        if not c:
            self.fail("unclosed class")
        self.i += 1
        if c in "wWdDsS":
            return self.named(c, self.flags.u)
        if c in "pP":
            return Cls(named=(self.property(c == "P"),))
        if c in "xuU":
            return self.code(c)
        if c in _SIMPLE:
            return _SIMPLE[c]
        if c.isascii() and c.isalnum():
            self.fail("unknown escape in a class")
        return c


def _joined(parts: list):
    """Neighbouring literals become one."""
    out: list = []
    for p in parts:
        if isinstance(p, Cat):
            out += p.parts
        elif isinstance(p, Lit) and out and isinstance(out[-1], Lit):
            out[-1] = Lit(out[-1].text + p.text)
        elif not isinstance(p, Empty):
            out.append(p)
    if not out:
        return Empty()
    return out[0] if len(out) == 1 else Cat(tuple(out))


def parse(pattern: str, flags: Flags = Flags()):
    """The tree of a pattern. At most 4,096 bytes."""
    if len(pattern.encode("utf-8", "surrogatepass")) > MAX_PATTERN:
        raise PatternTooLong(f"a pattern has at most {MAX_PATTERN} bytes")
    p = _Parser(pattern, flags)
    tree = p.alternation()
    if p.i < len(pattern):
        p.fail("a group closes that isn't open")
    return tree


def children(node) -> tuple:
    if isinstance(node, (Cat, Alt)):
        return node.parts
    if isinstance(node, (Rep, Group)):
        return (node.sub,)
    return ()


def has_newline(node) -> bool:
    """Does the pattern name a line feed itself?"""
    if isinstance(node, Lit):
        return "\n" in node.text
    if isinstance(node, Cls):
        m = node.members(1)
        return m == ["\n"]
    return any(has_newline(c) for c in children(node))


def folds(pattern: str) -> bool:
    """Does any part of the pattern ignore case?"""
    i = 0
    while (i := pattern.find("(?", i)) >= 0:
        j = i + 2
        on = True
        while j < len(pattern) and pattern[j] in "imsUuxR-":
            if pattern[j] == "-":
                on = False
            elif pattern[j] == "i" and on and not _escaped(pattern, i):
                return True
            j += 1
        i += 2
    return False


def _escaped(pattern: str, at: int) -> bool:
    n = 0
    while at > 0 and pattern[at - 1] == "\\":
        at, n = at - 1, n + 1
    return n % 2 == 1


def literal_letters(node) -> tuple[bool, bool]:
    """(has a literal character, has an upper-case one): what smart case asks. Classes' named sets are no literals."""
    if isinstance(node, Lit):
        return bool(node.text), any(c.isupper() for c in node.text)
    if isinstance(node, Cls):
        ends = [chr(x) for r in node.ranges for x in r] if not (len(node.ranges) == 1 and node.ranges[0][1] == MAX_CODE) else []
        if node.negated and node.ranges in (((10, 10),), ((10, 10), (13, 13))):
            ends = []  # a dot
        inner = [literal_letters(n) for n in node.nested + node.both + node.minus]
        return bool(ends) or any(a for a, _ in inner), any(c.isupper() for c in ends) or any(b for _, b in inner)
    inner = [literal_letters(c) for c in children(node)]
    return any(a for a, _ in inner), any(b for _, b in inner)
