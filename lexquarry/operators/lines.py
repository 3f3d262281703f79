"""Texts as lines, and the expressions over them that searches are made of. All of it runs inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_array(text: Column) -> Column:
    """The lines of a text; a feed at the end ends the last line and begins no other. No text, no lines."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.split(t, "\n", -1)
    n = F.size(parts) - F.when((t == "") | F.endswith(t, F.lit("\n")), 1).otherwise(0)
    return F.slice(parts, F.lit(1), n)


def cut_lines(text: Column, terminator: str = "\n") -> Column:
    """line_array() for any terminator."""
    if terminator == "\n":
        return line_array(text)
    t = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.split(t, f"\\x{ord(terminator):02x}", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - F.when((t == "") | F.endswith(t, F.lit(terminator)), 1).otherwise(0))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _starts(sizes: pa.Array) -> pa.Array:
    """Where each line begins, given all lines' sizes in bytes; every one ends with one more."""
    flat, n = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1, pc.list_value_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
    end, first = np.cumsum(flat), np.cumsum(n) - n
    base = np.concatenate([[0], end])[first]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(end - flat - np.repeat(base, n)))


def explode_lines(docs: DataFrame, text: str = "text", keep: list[str] | None = None, terminator: str = "\n", offsets: bool = False, keep_lines=None) -> DataFrame:
    """One row a line: the columns of `keep` (all others but the text, if None), line_no from 1, line, and with `offsets`
    byte_offset, the bytes of the text before it.

    Lines have no feed. With another terminator ('\\0' for null data) texts are cut there. keep_lines: a function of the array of
    lines that gives how many are left out at its begin and how many are kept. No line is shuffled; of offsets only the lines'
    sizes go through Python.
    """
    names = [c for c in docs.columns if c != text] if keep is None else keep
    lines = cut_lines(F.col(text), terminator)
    if not offsets and keep_lines is None:
        return docs.select(*names, F.posexplode(lines).alias("pos", "line")).select(*names, (F.col("pos") + 1).alias("line_no"), "line")
    cut = docs.select(*names, lines.alias("__lines"))
    if offsets:
        cut = cut.withColumn("__at", _starts(F.transform("__lines", F.octet_length)))
    before, many = keep_lines(F.col("__lines")) if keep_lines else (F.lit(0), F.size("__lines"))
    part = lambda c: F.slice(F.col(c), before + 1, many)
    cut = cut.select(*names, before.alias("__before"), F.posexplode(F.arrays_zip(part("__lines"), *([part("__at")] if offsets else []))).alias("pos", "x"))
    fields = [F.col("x").getField("0").alias("line"), *([F.col("x").getField("1").alias("byte_offset")] if offsets else [])]
    return cut.select(*names, (F.col("__before") + F.col("pos") + 1).cast("int").alias("line_no"), *fields)


def matches(line: Column, java: str) -> Column:
    return F.rlike(line, F.lit(java))


def any_line_matches(text: Column, java: str, invert: bool = False) -> Column:
    """Does any line of the text match (not match)? No line is exploded."""
    hit = lambda x: ~F.rlike(x, F.lit(java)) if invert else F.rlike(x, F.lit(java))
    return F.exists(line_array(text), hit)


def matching_line_count(text: Column, java: str, invert: bool = False) -> Column:
    hit = lambda x: ~F.rlike(x, F.lit(java)) if invert else F.rlike(x, F.lit(java))
    return F.size(F.filter(line_array(text), hit)).cast("long")


def match_count(text: Column, java: str) -> Column:
    """Matches of all lines, empty ones too."""
    return F.aggregate(F.transform(line_array(text), lambda x: F.regexp_count(x, F.lit(java)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def match_column(line: Column, java: str) -> Column:
    """1-based byte at which the first match of a line begins; null without one."""
    at = F.regexp_instr(line, F.lit(java))
    return F.when(matches(line, java), F.octet_length(F.substring(line, F.lit(1), F.greatest(at - 1, F.lit(0)))) + 1)


def context(docs: DataFrame, key: str, text: str, hit, before: int, after: int, terminator: str = "\n") -> DataFrame:
    """(key, line_no, line, is_match, block): the lines that `hit` holds for and their context; block counts the runs of
    neighbouring lines of a text from 1. No line is shuffled; only the answers of `hit` go through Python."""

    @F.arrow_udf("array<struct<line_no:int,is_match:boolean,block:int>>")
    def near(hits: pa.Array) -> pa.Array:
        flat, n = hits.flatten().to_numpy(zero_copy_only=False).astype(bool), pc.list_value_length(hits).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(n)
        row = np.repeat(np.arange(len(n)), n)
        at = np.flatnonzero(flat)
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, np.maximum(at - before, (end - n)[row[at]]), 1)
        np.add.at(change, np.minimum(at + after + 1, end[row[at]]), -1)
        shown = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        whose = row[shown]
        first = np.searchsorted(whose, np.arange(len(n)))
        run = np.ones(len(shown), np.int64)
        run[1:] = (np.diff(shown) > 1) | (np.diff(whose) > 0)
        count = np.cumsum(run)
        block = count - np.concatenate([[0], count])[first[whose]]
        rows = pa.StructArray.from_arrays([pa.array((shown - (end - n)[whose] + 1).astype(np.int32)), pa.array(flat[shown]), pa.array(block.astype(np.int32))], ["line_no", "is_match", "block"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(n) + 1)).astype(np.int32)), rows)

    cut = docs.select(key, cut_lines(F.col(text), terminator).alias("__lines"))
    cut = cut.withColumn("__near", near(F.transform("__lines", lambda x: F.coalesce(hit(x), F.lit(False)))))
    return cut.select(key, "__lines", F.explode("__near").alias("x")).select(key, "x.line_no", F.element_at("__lines", F.col("x.line_no")).alias("line"), "x.is_match", "x.block")


def first_matches(lines: DataFrame, key: str, most: int) -> DataFrame:
    """Of lines that match, the first `most` of each text."""
    order = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def until_nonmatch(lines: Column, hit) -> tuple[Column, Column]:
    """Of an array of lines: how many come before the first that `hit` holds for, and how many it holds for from there on."""
    hits = F.transform(lines, lambda x: F.coalesce(hit(x), F.lit(False)))
    first = F.array_position(hits, True).cast("int")
    rest = F.slice(hits, F.greatest(first, F.lit(1)), F.size(hits))
    end = F.array_position(rest, False).cast("int")
    return F.greatest(first - 1, F.lit(0)), F.when(first == 0, 0).when(end == 0, F.size(rest)).otherwise(end - 1)
