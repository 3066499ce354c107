"""Registered text queries over a whole small data set, and the pipeline stage by stage."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from check_oracle import compare, connect  # noqa: E402
from feedloom.llm.common import documents  # noqa: E402
from feedloom.llm.queries import ORACLES, QUERIES  # noqa: E402
from twins import kept_lines, jaccard_components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op2_secret_links", "op5_language_codes", "op7_kd_shards"])
def test_query_has_a_row_per_document(spark, name):
    ids = [r[0] for r in documents(spark, FOLDER).select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, FOLDER).collect()) == sorted(ids)


def test_pipeline_stages(spark):
    docs = documents(spark, FOLDER)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        assert len(rows) == len({r["doc_id"] for r in rows}) and {r["doc_id"] for r in rows} <= set(before)
        if name == "tokens":
            assert len(rows) == len(before)
            assert all(hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] for r in rows)
            break
        assert out.columns == columns
        given = [(k, r["text"]) for k, r in before.items()]
        if name == "language":
            assert {r["lang"] for r in rows} == {r["lang"] for r in before.values()} and len(rows) >= 0.9 * len(before)
        if name == "lines":
            want = kept_lines(given)
            assert {r["doc_id"]: r["text"] for r in rows} == {k: want[k, t] for k, t in given}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "near_duplicates":
            want = {k for k, n, c in jaccard_components(given, 5, 80) if not n or k == c}
            assert {r["doc_id"] for r in rows} == want
        if name == "benchmark":
            items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            hit = {k for k, t in given if any(i in t for i in items)}
            assert {r["doc_id"] for r in rows} <= set(before) - hit
        docs = spark.createDataFrame(rows, out.schema)
