"""Regex search over a table of texts in all result modes, by exact scan. Indexed search (operators.index) ends in the same code."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import lines as L
from lexquarry.plans import syntax
from lexquarry.plans.java import replacement, to_java
from lexquarry.plans.syntax import Alt, Cat, Flags, Lit, Look, NeedsNewline, PatternError

MODES = ("lines", "files_with_matches", "files_without_match", "count", "count_matches", "only_matching", "replace", "passthru", "vimgrep", "json", "quiet", "stats")


@dataclass(frozen=True)
class SearchOptions:
    """What to look for and how to tell of it. patterns are alternatives."""

    patterns: tuple[str, ...]
    mode: str = "lines"
    fixed: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    word: bool = False
    whole_line: bool = False
    invert: bool = False
    crlf: bool = False
    unicode: bool = True
    multiline: bool = False
    dotall: bool = False
    null_data: bool = False
    before: int = 0
    after: int = 0
    max_count: int | None = None
    stop_on_nonmatch: bool = False
    include_zero: bool = False
    column: bool = False
    byte_offset: bool = False
    trim: bool = False
    max_columns: int = 0
    max_columns_preview: bool = False
    replace: str | None = None
    search_binary: bool = False

    def __post_init__(self):
        if isinstance(self.patterns, str):
            object.__setattr__(self, "patterns", (self.patterns,))
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if not self.patterns:
            raise ValueError("no pattern")
        if self.word and self.whole_line:  # the later one would hold; as fields have no order: the stricter
            object.__setattr__(self, "word", False)

    # ---- the pattern
    def flags(self) -> Flags:
        f = Flags(i=self.ignore_case, s=self.dotall and self.multiline, u=self.unicode, R=self.crlf)
        if self.smart_case and not self.ignore_case:
            trees = [Lit(p) if self.fixed else syntax.parse(p, f) for p in self.patterns]
            found = [syntax.literal_letters(t) for t in trees]
            if any(a for a, _ in found) and not any(b for _, b in found):
                f = replace(f, i=True)
        return f

    def tree(self):
        """The pattern's tree with boundaries; raises PatternError."""
        f = self.flags()
        trees = []
        for p in self.patterns:
            if self.fixed:
                p = "".join("\\" + c if c in "\\.+*?()|[]{}^$#&-~" else c for c in p)
            trees.append(syntax.parse(p, f))
        node = trees[0] if len(trees) == 1 else Alt(tuple(trees))
        if not self.multiline and syntax.has_newline(node):
            raise NeedsNewline("a pattern with a line feed needs multiline=True")
        if self.word:
            return Cat((Look("half_start", unicode=f.u), node, Look("half_end", unicode=f.u)))
        if self.whole_line:
            return Cat((Look("start_line", f.R), node, Look("end_line", f.R)))
        return node

    def java(self) -> str:
        return to_java(self.tree())

    def folding(self) -> bool:
        return self.flags().i or any(not self.fixed and syntax.folds(p) for p in self.patterns)

    def indexable(self) -> str | None:
        """Why an index can't answer this; None if it can."""
        for on, why in ((self.invert, "inverted matches"), (self.null_data, "null data"), (self.search_binary, "binary texts"), (self.mode == "passthru", "all lines are wanted"), (self.stop_on_nonmatch, "stop on non-match")):
            if on:
                return why
        return None


def _lines(docs: DataFrame, o: SearchOptions, key: str, text: str) -> DataFrame:
    return L.explode_lines(docs, text, [key], "\0" if o.null_data else "\n", offsets=o.byte_offset)


def _hit(o: SearchOptions, java: str, c: Column) -> Column:
    h = L.matches(c, java)
    return ~h if o.invert else h


def _shown(o: SearchOptions, java: str, c: Column) -> Column:
    """A line as it is shown: replaced, trimmed, or left out for its length."""
    if o.replace is not None:
        c = F.regexp_replace(c, F.lit(java), F.lit(replacement(o.replace, o.tree())))
    if o.trim:
        c = F.regexp_replace(c, F.lit("^[ \\t\\n\\x0B\\f\\r]+"), F.lit(""))
    if o.max_columns:
        if o.max_columns_preview:
            c = F.when(F.octet_length(c) > o.max_columns, F.concat(F.substring(c, 1, o.max_columns), F.lit(" [... omitted end of long line]"))).otherwise(c)
        else:
            c = F.when(F.octet_length(c) > o.max_columns, F.lit("[Omitted long matching line]")).otherwise(c)
    return c


def _text(docs: DataFrame, text: str) -> Column:
    return F.col(text).cast("string")


def search(docs: DataFrame, o: SearchOptions, key: str = "doc_id", text: str = "text", whole: DataFrame | None = None) -> DataFrame:
    """The result of a search, by mode:

    lines (key, line_no, line[, col][, byte_offset][, is_match, block with context]); files_with_matches and
    files_without_match (key); count and count_matches (key, n); only_matching, vimgrep (key, line_no, col, match or line) one row
    a match; replace (key, line_no, line); passthru (key, line_no, is_match, line); json (message); quiet (found); stats (one row).

    A null text has no lines. Rows with the same key are told apart by nothing and counted together only where a mode aggregates
    over lines. whole: all documents, where docs are candidates only; needed by the modes that name files without a match.
    """
    tree = o.tree()
    java = to_java(tree)
    if o.mode in ("files_with_matches", "files_without_match", "quiet") or o.include_zero:
        whole = docs if whole is None else whole
    if o.max_count == 0 and o.mode not in ("files_without_match", "quiet"):
        docs = docs.where("false")
    if o.multiline:
        return _multiline(docs, o, java, key, text, whole)
    t = _text(docs, text)
    simple = not (o.null_data or o.stop_on_nonmatch)
    if o.mode == "files_with_matches":
        return docs.where(_any(o, java, t)).select(key)
    if o.mode == "files_without_match":
        if whole is docs:
            return docs.where(~_any(o, java, t)).select(key)
        return whole.select(key).join(docs.where(_any(o, java, t)).select(key), key, "left_anti")
    if o.mode == "quiet":
        return docs.where(_any(o, java, t)).limit(1).agg((F.count("*") > 0).alias("found"))
    if o.mode in ("count", "count_matches"):
        if o.mode == "count" and simple or o.invert and simple:
            n = L.matching_line_count(t, java, o.invert)
            n = F.least(n, F.lit(o.max_count)) if o.max_count is not None else n
            counts = docs.select(key, n.cast("long").alias("n"))
        elif simple and o.max_count is None:
            counts = docs.select(key, L.match_count(t, java).alias("n"))
        else:
            hits = _limited(docs, o, java, key, text)
            n = F.count("*") if o.mode == "count" or o.invert else F.sum(F.regexp_count("line", F.lit(java)).cast("long"))
            counts = hits.groupBy(key).agg(n.cast("long").alias("n"))
        if o.include_zero:
            if simple and o.max_count is None and whole is docs:
                return counts
            return whole.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        return counts.where("n > 0")
    if not o.invert and o.mode in ("lines", "only_matching", "vimgrep", "json") and (o.byte_offset or o.before or o.after):
        docs = docs.where(_any(o, java, t))  # other texts have no row in the result
    if o.mode == "lines" and (o.before or o.after):
        out = L.context(docs, key, text, lambda x: _hit(o, java, x), o.before, o.after, "\0" if o.null_data else "\n")
        return out.select(key, "line_no", "is_match", "block", F.when(F.col("is_match"), _shown(o, java, F.col("line"))).otherwise(F.col("line")).alias("line"))
    rows = _lines(docs, o, key, text)
    hit = _hit(o, java, F.col("line"))
    if o.mode == "stats":
        each = rows.where(hit)
        n = F.lit(0).cast("long") if o.invert else F.regexp_count("line", F.lit(java)).cast("long")
        found = each.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("matches"), F.count("*").cast("long").alias("matched_lines"), F.countDistinct(key).cast("long").alias("files_with_match"))
        total = docs.agg(F.count("*").cast("long").alias("files_searched"), F.coalesce(F.sum(F.octet_length(t)), F.lit(0)).cast("long").alias("bytes_searched"))
        return found.crossJoin(total)  # one row each
    if o.mode == "passthru":
        return rows.select(key, "line_no", hit.alias("is_match"), F.when(hit, _shown(o, java, F.col("line"))).otherwise(F.col("line")).alias("line"))
    rows = _limited(docs, o, java, key, text)
    if o.mode in ("only_matching", "vimgrep"):
        return _each_match(rows, o, java, key)
    extra = ([L.match_column(F.col("line"), java).cast("long").alias("col")] if o.column else []) + ([F.col("byte_offset")] if o.byte_offset else [])
    out = rows.select(key, "line_no", *extra, _shown(o, java, F.col("line")).alias("line"))
    if o.mode == "json":
        return out.select(F.to_json(F.struct(F.lit("match").alias("type"), F.struct(F.col(key).alias("path"), F.col("line_no").alias("line_number"), F.struct(F.col("line").alias("text")).alias("lines")).alias("data"))).alias("message"))
    return out


def _any(o: SearchOptions, java: str, t: Column) -> Column:
    """Of a null text: false."""
    if o.null_data:
        hit = lambda x: (~F.rlike(x, F.lit(java))) if o.invert else F.rlike(x, F.lit(java))
        return F.exists(F.filter(F.split(F.coalesce(t, F.lit("")), "\\x00"), lambda x: x != ""), hit)
    return L.any_line_matches(t, java, o.invert)


def _limited(docs: DataFrame, o: SearchOptions, java: str, key: str, text: str) -> DataFrame:
    keep = (lambda lines: L.until_nonmatch(lines, lambda x: _hit(o, java, x))) if o.stop_on_nonmatch else None
    out = L.explode_lines(docs, text, [key], "\0" if o.null_data else "\n", offsets=o.byte_offset, keep_lines=keep).where(_hit(o, java, F.col("line")))
    return L.first_matches(out, key, o.max_count) if o.max_count is not None else out


def _gaps(c: Column, java: str) -> Column:
    """What lies before, between and after the matches. The mark that stands for a match is in no text: a record separator, or, where
    the text has one, a text's own hash between two, which it can't hold."""
    mark = F.when(F.contains(c, F.lit("\x1e")), F.concat(F.lit("\x1e"), F.sha2(c, 256), F.lit("\x1e"))).otherwise(F.lit("\x1e"))
    return F.split(F.regexp_replace(c, F.lit(f"(?:{java})"), mark), mark, -1)


def _each_match(rows: DataFrame, o: SearchOptions, java: str, key: str) -> DataFrame:
    """One row a match, with its number in the line, and the byte at which it begins."""
    ms = F.regexp_extract_all("line", F.lit(java), F.lit(0))
    pieces = _gaps(F.col("line"), java)
    step = rows.withColumn("ms", ms).withColumn("gaps", pieces)
    # bytes before the i-th match: the gaps and the matches before it
    step = step.withColumn("m", F.explode(F.expr(
        "transform(sequence(1, size(ms)), i -> struct(i as i, ms[i - 1] as match, 1 + aggregate(slice(gaps, 1, i), 0, (a, x) -> a + octet_length(x)) + aggregate(slice(ms, 1, i - 1), 0, (a, x) -> a + octet_length(x)) as col))"
    ))).where("m.match <> ''")
    extra = [(F.col("byte_offset") + F.col("m.col") - 1).alias("byte_offset")] if o.byte_offset else []
    if o.mode == "vimgrep":
        return step.select(key, "line_no", F.col("m.col").cast("long").alias("col"), _shown(o, java, F.col("line")).alias("line"))
    shown = F.col("m.match")
    if o.replace is not None:
        shown = F.regexp_replace(shown, F.lit(java), F.lit(replacement(o.replace, o.tree())))
    return step.select(key, "line_no", F.col("m.col").cast("long").alias("col"), *extra, shown.alias("match"))


def _multiline(docs: DataFrame, o: SearchOptions, java: str, key: str, text: str, whole: DataFrame | None) -> DataFrame:
    """Matches may span lines: the pattern sees whole texts."""
    t = F.coalesce(_text(docs, text), F.lit(""))
    hit = F.rlike(t, F.lit(java)) & (t != "")
    if o.invert:
        if o.mode != "files_without_match":
            raise PatternError("multiline search can't be inverted here")
    if o.mode == "files_with_matches":
        return docs.where(hit).select(key)
    if o.mode == "files_without_match":
        base = docs if whole is None else whole
        return docs.where(~hit).select(key) if base is docs else base.select(key).join(docs.where(hit).select(key), key, "left_anti")
    if o.mode == "quiet":
        return docs.where(hit).limit(1).agg((F.count("*") > 0).alias("found"))
    if o.mode in ("count", "count_matches"):
        counts = docs.select(key, F.regexp_count(t, F.lit(java)).cast("long").alias("n"))
        if o.include_zero:
            base = docs if whole is None else whole
            return counts if base is docs else base.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        return counts.where("n > 0")
    # rows: each match with the line at which it begins
    found = docs.where(hit).select(key, t.alias("t")).withColumn("ms", F.regexp_extract_all("t", F.lit(java), F.lit(0)))
    found = found.withColumn("gaps", _gaps(F.col("t"), java))
    found = found.select(key, F.explode(F.expr("transform(sequence(1, size(ms)), i -> struct(ms[i - 1] as match, concat(array_join(slice(gaps, 1, i), ''), array_join(slice(ms, 1, i - 1), '')) as before, gaps[i - 1] as gap))")).alias("m"))
    feeds = F.length("m.before") - F.length(F.replace(F.col("m.before"), F.lit("\n"), F.lit("")))
    out = found.where("m.match <> ''").select(key, (feeds + 1).cast("int").alias("line_no"), (F.octet_length("m.before")).cast("long").alias("byte_offset"), F.col("m.match").alias("match"))
    if o.mode == "stats":
        return out.agg(F.count("*").cast("long").alias("matches"), F.countDistinct(key).cast("long").alias("files_with_match"))
    return out

