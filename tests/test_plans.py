"""Plan-shape guards for the optimizations that matter at scale (static plans, broadcast off)."""

import pytest

import __spark_entry__ as se
from tests.conftest import SF_SMALL


@pytest.fixture
def static_spark(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                           "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan_of(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_shape(static_spark):
    plan = plan_of(static_spark, "context_rank")
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 8
    assert "WindowGroupLimit" in plan and ", Partial" in plan and ", Final" in plan
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["block_bounds", "apply_edits", "rewrite_targets"])
def test_extraction_is_read_from_its_table(static_spark, name):
    assert plan_of(static_spark, name).count("MapInArrow") == 0


def test_scans_are_pruned(static_spark):
    plan = plan_of(static_spark, "context_rank")
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_type:string,p_size:int>" in plan
    assert "p_name" not in plan


def test_docstring_text_is_not_carried_to_the_ranking(static_spark):
    plan = plan_of(static_spark, "context_rank")
    for line in plan.splitlines():
        if "Exchange" in line or "Window" in line or "HashAggregate" in line:
            assert "docstring" not in line and "p_type" not in line


@pytest.mark.parametrize("name", ["block_bounds", "edits_per_file", "apply_edits"])
def test_edit_plans_are_row_local(static_spark, name):
    plan = plan_of(static_spark, name)
    assert "Window" not in plan and "ArrowEvalPython" not in plan
    # requests and texts meet by file; grouping the edits and applying them are one more each
    most = {"block_bounds": 2, "edits_per_file": 3, "apply_edits": 4}[name]
    assert plan.count("Exchange hashpartitioning") <= most


def test_splitter_is_native(static_spark):
    plan = plan_of(static_spark, "split_pack")
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_target_filter_reaches_the_stored_scan(spark, tmpdir_path):
    from chunkgraph.operators import rank
    from chunkgraph.plans.index_build import build_index, load_index, save_index
    files = spark.createDataFrame([("m.py", "def a():\n    b()\n\ndef b():\n    '''Doc.'''\n")],
                                  "path string, content string")
    save_index(build_index(files), tmpdir_path)
    chunks, _ = load_index(spark, tmpdir_path)
    plan = rank.undocumented_targets(chunks).select("id", "name") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(docstring)" in plan
    assert "ReadSchema: struct<id:bigint,name:string,docstring:string>" in plan
