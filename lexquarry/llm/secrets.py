"""Secret scan: sliding-window Shannon entropy per character class over candidate strings, with an allow-list."""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: class, its characters, window, least entropy in bits
CLASSES = (
    ("hex", "0123456789abcdefABCDEF", 20, 3.0),
    ("alnum", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 3.8),
    ("base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-=", 24, 4.2),
)
#: candidates that any of these matches from end to end are no secrets: words, numbers, rulers, dates and UUIDs
ALLOW = (
    "[A-Za-z+/_=-]*",
    "[0-9+/_=-]*",
    "(?i)[a-z0-9_-]*(?:example|sample|placeholder|dummy|changeme|xxxx)[a-z0-9_+/=-]*",
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
)
MARK = "[SECRET]"


@lru_cache(None)
def _gain(n: int) -> float:
    return n * math.log2(n) if n else 0.0


def max_entropy(s: str, chars: frozenset, window: int) -> float:
    """Highest entropy in bits of any `window` characters in a row that are all of the class; -1 if there are none.

    The counts and the sum of n*log2(n) are kept as the window moves: one character enters, one leaves.
    """
    best, counts, total, run = -1.0, {}, 0.0, 0
    for i, c in enumerate(s):
        if c not in chars:
            counts, total, run = {}, 0.0, 0
            continue
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _gain(n + 1) - _gain(n)
        run += 1
        if run > window:
            out = s[i - window]
            n = counts[out]
            counts[out] = n - 1
            total += _gain(n - 1) - _gain(n)
        if run >= window:
            best = max(best, math.log2(window) - total / window)
    return best


def findings(candidates: list, classes=CLASSES) -> list[dict]:
    """Secrets among one text's candidates: for each, the first class whose entropy suffices."""
    out = []
    for i, s in enumerate(candidates or []):
        for name, chars, window, least in classes:
            e = round(max_entropy(s, frozenset(chars), window), 6)
            if e >= least:
                out.append({"ordinal": i, "secret": s, "char_class": name, "entropy": e})
                break
    return out


_TYPE = pa.list_(pa.struct([("ordinal", pa.int32()), ("secret", pa.string()), ("char_class", pa.string()), ("entropy", pa.float64())]))


def _findings(column) -> Column:
    @F.arrow_udf("array<struct<ordinal:int,secret:string,char_class:string,entropy:double>>")
    def run(candidates: pa.Array) -> pa.Array:
        return pa.array([findings(c) if c else [] for c in candidates.to_pylist()], _TYPE)

    return run(column)


def candidates(text: Column, allow=ALLOW) -> Column:
    """Candidate strings of a text that the allow-list leaves, in order; found inside the JVM."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CANDIDATE), F.lit(0))
    return F.filter(found, lambda s: ~F.rlike(s, F.lit("^(?:" + "|".join(allow) + ")$")))


def scan(docs: DataFrame, allow=ALLOW) -> DataFrame:
    """(doc_id, ordinal, secret, char_class, entropy) of every secret; ordinal: its number among the text's candidates.

    Whole texts are searched. A null or empty text has no secrets; a null doc_id stays null in the result; repeated rows
    give repeated findings, as do secrets that occur again; an empty table gives no rows; other columns aren't looked at.
    """
    found = docs.select("doc_id", candidates(F.col("text"), allow).alias("c")).where(F.size("c") > 0)
    return found.select("doc_id", F.explode(_findings("c")).alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, allow=ALLOW, mark: str = MARK) -> DataFrame:
    """docs with every secret in text replaced by `mark`, and n_chars, if there, as long as the new text.

    Only the candidates go through Python; the texts stay in the JVM and nothing is shuffled. All rows and columns stay.
    """
    found = docs.withColumn("__found", _findings(candidates(F.col("text"), allow)))
    # longer secrets first: one may be part of another
    longest = F.expr("array_sort(array_distinct(transform(__found, f -> f.secret)), (a, b) -> length(b) - length(a))")
    text = F.when(F.size("__found") > 0, F.aggregate(longest, F.col("text").cast("string"), lambda t, s: F.replace(t, s, F.lit(mark)))).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("__found") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
