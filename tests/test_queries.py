import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_point
from compare import compare, duck
from conftest import SF_ORACLE, plan_of

QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, connection, name):
    difference = compare(spark, connection, QUERIES[name], ORACLE[name], SF_ORACLE)
    assert difference is None, difference


def test_every_query_is_known_and_runs(spark):
    assert set(ORACLE) <= set(QUERIES)
    recalls = QUERIES["ann_trained_recall"](spark, SF_ORACLE).collect()
    assert len(recalls) == 10 and all(0 < r.recall <= 1 for r in recalls)


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns[0] == "query_id" and result.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_everything(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from lodeseek import build_session
spark = build_session("local[2]", **{"spark.ui.enabled": "false"})
queries = __spark_entry__.queries()
for name in ("search_chunks", "ann_topk", "model_plugin", "dense_score", "tokenize", "pool_tokens", "cosine_pairs"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_workers_need_no_installation(tmp_path):
    # Started elsewhere, Python workers cannot import the package.
    root = Path(entry_point.__file__).resolve().parent
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(root)], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=300,
    )
    assert run.returncode == 0, run.stderr[-2000:]
