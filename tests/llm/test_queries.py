"""The registered queries and the pipeline over the smallest tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexquarry.llm import bfd_packing, decision_list, language_crf, mixing, related_packing, secrets, superminhash


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_embedding_pigeonhole", "op4_secret_scan", "op6_capture_index", "op7_suffix_repeats"])
def test_sql_has_the_same_rows(spark, data, name):
    import duckdb

    got = entry.queries()[name](spark, data)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table().select(cols).to_pylist()
    tidy = lambda r: str([(k, round(v, 5) if isinstance(v, float) else v) for k, v in sorted(r.items())])
    assert sorted(tidy(r.asDict()) for r in got.collect()) == sorted(map(tidy, want))


def test_pipeline_stages(spark, data, monkeypatch):
    """Each stage's rows are what its operator decides over what the one before kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    all_ids = {r.doc_id for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, data), f"test-{name}")
        assert docs.columns == before.columns
        seen[name] = (before, docs)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["language"]
    assert ids(after) == {r.doc_id for r in language_crf.judge(before).where("keep").collect()} and len(ids(after)) > 0.8 * len(all_ids)
    before, after = seen["near_duplicates"]
    gone = {r.doc_id for r in superminhash.near_groups(before).where("not keep").collect()}
    assert ids(after) == ids(before) - gone and gone
    before, after = seen["secrets"]
    assert ids(after) == ids(before) and secrets.scan(after).count() == 0
    before, after = seen["mixing"]
    assert ids(after) == {r.doc_id for r in mixing.select(before).collect()}
    got = sorted(map(tuple, corpus_pipeline.run(spark, data).collect()))
    assert got == sorted(map(tuple, related_packing.pack(docs).collect()))
    assert {r[3] for r in got} == ids(docs)


def test_without_the_folders_the_rest_works(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/lexquarry", tmp_path / "lexquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode == 0


def test_constants_are_the_production_ones():
    assert bfd_packing.LENGTH == 2048 and superminhash.THRESHOLD == 0.5 and decision_list.STOP_WORDS
