"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import compare, connect

QUERIES = entry_point.queries()
CHECKS = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in CHECKS:
        assert compare(spark, con, sf_dir, QUERIES[name], CHECKS[name]) == []
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["vec_id", "rank", "class_idx"]


def test_tasks_run_without_the_package_installed(tmp_path):
    """Functions shipped to tasks carry everything they need; the driver alone imports the package."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry_point.__file__).resolve().parent
    script = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("outside", r"{root / '__spark_entry__.py'}")
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("m4_document_vectors", "f5_text_sequences", "m7_centroid_scores", "e6_bootstrap_multinomial", "m5_topic_classifier",
             "f11_term_phrases", "s1_tsv_scan", "m12_pca", "w3_frequent_words", "m10_user_scorer", "m10_bounded_recommendations", "m5_descent_topic",
             "m9_out_of_fold"):
    assert module.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("done")
"""
    result = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "done" in result.stdout, result.stderr[-2000:]
