"""Prints one JSON line with the seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lexquarry.operators import bigrams, index
from lexquarry.operators.search import SearchOptions
from lexquarry.queries import QUERIES
from lexquarry.sources import store

HEADLINE = [
    "grep_files_with_matches", "grep_files_without_match", "grep_lines", "grep_count", "grep_count_matches", "grep_context", "grep_word", "grep_ignore_case", "grep_multi_pattern", "html_grep_pages",
    "indexed_literal", "indexed_zero_match", "indexed_word", "indexed_ignore_case", "indexed_repetition", "indexed_unicode", "summary_facts", "bigram_counts", "mint_weights", "kl_benchmark",
]
SUITE = [
    ("lit_license", SearchOptions("license", mode="files_with_matches")), ("word_nicht", SearchOptions("nicht", mode="files_with_matches", word=True)), ("ci_license", SearchOptions("(?i)LICENSE", mode="files_with_matches")),
    ("none_zzqx", SearchOptions("zzqxpassword", mode="files_with_matches")), ("uni_fuer", SearchOptions("für [a-z]+en", mode="files_with_matches")), ("rep_version", SearchOptions(r"[0-9]+\.[0-9]+\.[0-9]+", mode="files_with_matches")),
    ("anchor_x", SearchOptions("^Eriner", mode="files_with_matches")), ("lit_the", SearchOptions(r"\bthe\b", mode="files_with_matches")), ("gap_x", SearchOptions("license.*und", mode="files_with_matches")),
]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f):
        t = time.time()
        out = f()
        took[name] = round(time.time() - t, 3)
        return out

    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs.count()
    weights = timed("mint_table", lambda: index.WeightTable.from_frame(bigrams.mint(bigrams.pair_counts(docs, "text"))))
    root = store.fresh_path(spark, "bench-index")
    ix = timed("index_build", lambda: index.build(docs, root, weights))
    import lexquarry.queries as q

    q._INDEXES[(spark.sparkContext.applicationId, d)] = root
    for name in HEADLINE:
        timed(name, lambda n=name: QUERIES[n](spark, d).write.format("noop").mode("overwrite").save())
    total = index.summarised(index.report(docs, ix, SUITE)).where("class is null").first().asDict()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
        "index_bytes": ix.bytes(), "text_bytes": ix.text_bytes, "index_ratio": round(ix.bytes() / max(ix.text_bytes, 1), 3), "suite": {k: total[k] for k in ("queries", "indexed", "candidates", "matching", "fp_percent", "lost", "speedup")},
    }, default=float))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
