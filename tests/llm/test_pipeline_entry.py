import subprocess
import sys
from pathlib import Path

import pytest

from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD_ROWS, documents, words
from tests.llm.test_jaccard import brute

REPO = Path(__file__).resolve().parents[2]


def test_thirteen_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and "op7_url_rules" in entry.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "tremor").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tremor.llm" not in path.read_text(), path
    code = ("import sys\nclass Gone:\n    def find_spec(self, name, *a):\n        if name.split('.')[:2] == ['tremor', 'llm'] or name == 'corpus_pipeline':\n"
            "            raise ImportError(name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
            "q = e.queries()\nassert len(q) > 90 and not any(n.startswith('op1_') or n == 'pipeline' for n in q)\nassert e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_stages_one_by_one(spark, tmpdir_path):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmpdir_path}/{number}")
        out = spark.read.parquet(f"{tmpdir_path}/{number}")
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            assert "sequence_id" in out.columns
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "jaccard_join":
            want = {d for d, _, c in brute(sorted(before.items()), 5, 80, 100) if c == d}
            assert set(after) == want and len(after) < len(before)
        elif name == "secret_scan":
            from tremor.llm.secret_scan import redact
            assert after == {d: redact(t) for d, t in before.items()} and after != before
        else:
            assert all(before[d] == t for d, t in after.items())
            assert len(after) >= 0.7 * len(before)
        docs = out


def test_run_equals_its_stages_on_odd_rows(spark, tmpdir_path):
    import corpus_pipeline as P
    rows = [(100 + i, words(i, 40, 300), "en" if i % 2 else "fr") for i in range(30)] + [(200, words(1, 40, 300), "en")] + ODD_ROWS
    documents(spark, rows).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    out = P.run(spark, tmpdir_path)
    packed = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert packed >= {100 + i for i in range(30)} and not packed & {1, 2, 3, 4, 5, 6, 7, 200}


def test_pipeline_on_empty_tables(spark, tmpdir_path):
    import corpus_pipeline as P
    documents(spark, ODD_ROWS).limit(0).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    assert P.run(spark, tmpdir_path).collect() == []


@pytest.mark.parametrize("name", ["op1_projection_tree_search", "op2_bpe_transducer", "op3_retrieval_packing", "op4_jaccard_components",
                                  "op5_boosted_toxicity", "op6_language_families", "op7_url_rules", "op8_license_windows",
                                  "op9_ngram_likelihood_ratio", "op10_secret_worklist"])
def test_query_runs_over_its_whole_table(spark, name):
    import __spark_entry__ as entry
    out = entry.queries()[name](spark, SF_SMALL)
    n = out.count()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    if name[:4] in ("op2_", "op4_", "op5_", "op6_", "op9_", "op10"):
        assert n == docs
    else:
        assert n > 0
