"""Translation of a pattern's tree to java.util.regex, which the JVM-side functions run. No mode of the JVM's is relied on."""

from __future__ import annotations

import re

from lexquarry.plans.syntax import MAX_CODE, Alt, Cat, Cls, Empty, Group, Lit, Look, Rep

_WORD = r"\p{IsAlphabetic}\p{Mn}\p{Me}\p{Mc}\p{Nd}\p{Pc}\p{IsJoin_Control}"
_SETS = {"w": _WORD, "d": r"\p{Nd}", "s": r"\p{IsWhite_Space}"}
#: general categories and properties that Java knows by these names; everything else is a script
_GENERAL = {"L", "Lu", "Ll", "Lt", "Lm", "Lo", "M", "Mn", "Mc", "Me", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "S", "Sm", "Sc", "Sk", "So", "Z", "Zs", "Zl", "Zp", "C", "Cc", "Cf", "Cs", "Co", "Cn"}
_LONG = {"letter": "L", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "mark": "M", "number": "N", "decimal_number": "Nd", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C", "control": "Cc"}
_PROPERTIES = {"alphabetic": "IsAlphabetic", "uppercase": "IsUppercase", "lowercase": "IsLowercase", "white_space": "IsWhite_Space", "alpha": "IsAlphabetic", "upper": "IsUppercase", "lower": "IsLowercase", "ideographic": "IsIdeographic"}


def quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-&#])", r"\\\1", text).replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\x00")


def _char(c: int) -> str:
    if c < 128 and chr(c).isalnum():
        return chr(c)
    return f"\\x{{{c:x}}}"


def _property(name: str) -> str:
    key, eq, value = name.partition("=")
    if eq:
        name = value
    low = name.lower().replace("-", "_").replace(" ", "_")
    if low in _LONG:
        return f"\\p{{{_LONG[low]}}}"
    short = name[:1].upper() + name[1:].lower()
    if short in _GENERAL:
        return f"\\p{{{short}}}"
    if low in _PROPERTIES:
        return f"\\p{{{_PROPERTIES[low]}}}"
    return f"\\p{{Is{name}}}"


def cls(c: Cls) -> str:
    """A bracketed class."""
    if c.ranges == ((0, MAX_CODE),) and not (c.negated or c.both or c.minus):
        return "(?s:.)"
    inside = _inside(c)
    return f"[{'^' if c.negated else ''}{inside}]"


def _bracket(c: Cls) -> str:
    return f"[{'^' if c.negated else ''}{_inside(c)}]"


def _inside(c: Cls) -> str:
    out = "".join(_char(lo) if lo == hi else f"{_char(lo)}-{_char(hi)}" for lo, hi in c.ranges)
    for n in c.named:
        negative, n = n.startswith("^"), n.lstrip("^")
        body = _property(n[2:]) if n.startswith("p:") else _SETS[n]
        out += f"[^{body}]" if negative else body
    out += "".join(_bracket(n) for n in c.nested)
    if not out and not c.both and not c.minus:
        return r"\x{0}-\x{10ffff}&&[^\x{0}-\x{10ffff}]"
    for b in c.both:
        out = f"[{out}]&&{_bracket(b)}"
    for m in c.minus:
        out = f"[{out}]&&[^{_bracket(m)}]"
    return f"[{out}]" if c.negated and (c.both or c.minus) else out


def look(node: Look) -> str:
    w = f"[{_WORD}]" if node.unicode else "[0-9A-Za-z_]"
    return {
        "start_text": r"\A",
        "end_text": r"\z",
        "start_line": r"(?<![^\r\n])(?!(?<=\r)\n)" if node.crlf else r"(?<![^\n])",
        "end_line": r"(?![^\r\n])(?!(?<=\r)\n)" if node.crlf else r"(?![^\n])",
        "word": f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))",
        "not_word": f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))",
        "word_start": f"(?<!{w})(?={w})",
        "word_end": f"(?<={w})(?!{w})",
        "half_start": f"(?<!{w})",
        "half_end": f"(?!{w})",
    }[node.kind]


def _group_name(name: str) -> str:
    return "n" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}x" for c in name)


def to_java(node) -> str:
    if isinstance(node, Empty):
        return ""
    if isinstance(node, Lit):
        return quote(node.text)
    if isinstance(node, Cls):
        out = cls(node)
        return f"(?iu:{out})" if node.fold and any("p:" in n for n in node.named) else out
    if isinstance(node, Look):
        return look(node)
    if isinstance(node, Cat):
        return "".join(f"(?:{to_java(p)})" if isinstance(p, Alt) else to_java(p) for p in node.parts)
    if isinstance(node, Alt):
        return "|".join(to_java(p) for p in node.parts)
    if isinstance(node, Group):
        return f"(?<{_group_name(node.name)}>{to_java(node.sub)})" if node.name else f"({to_java(node.sub)})"
    if isinstance(node, Rep):
        inner = to_java(node.sub)
        if not (isinstance(node.sub, (Cls, Group)) or (isinstance(node.sub, Lit) and len(node.sub.text) == 1)):
            inner = f"(?:{inner})"
        times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((node.least, node.most))
        if times is None:
            times = f"{{{node.least}{'' if node.most == node.least else ',' if node.most is None else f',{node.most}'}}}"
        return inner + times + ("" if node.greedy else "?")
    raise TypeError(node)


def group_names(node) -> dict[str, str]:
    """Names of groups as the pattern has them, with those of the translation."""
    out = {node.name: _group_name(node.name)} if isinstance(node, Group) and node.name else {}
    from lexquarry.plans.syntax import children

    for c in children(node):
        out |= group_names(c)
    return out


def count_groups(node) -> int:
    from lexquarry.plans.syntax import children

    return isinstance(node, Group) + sum(count_groups(c) for c in children(node))


def replacement(template: str, node) -> str:
    """A '$1', '$name', '${n}x', '$$' template for regexp_replace; unknown groups become empty."""
    names, n = group_names(node), count_groups(node)
    out, i = [], 0
    for m in re.finditer(r"\$(?:\$|\{([^}]*)\}|([0-9A-Za-z_]+))|.", template, re.S):
        braced, plain = m.group(1), m.group(2)
        ref = braced if braced is not None else plain
        if m.group() == "$$":
            out.append(r"\$")
        elif ref is not None and m.group().startswith("$"):
            if ref.isdigit():
                # a digit may follow, which must not extend the number: a named or quoted one follows anyway
                out.append(f"${int(ref)}" if int(ref) <= n else "")
                nxt = template[m.end() : m.end() + 1]
                if int(ref) <= n and nxt.isdigit():
                    out.append("\\")
            elif ref in names:
                out.append(f"${{{names[ref]}}}")
        else:
            c = m.group()
            out.append("\\" + c if c in "\\$" else c)
        i = m.end()
    return "".join(out)
