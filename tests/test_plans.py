import re

import __spark_entry__ as E
from conftest import SF001

KEYS = ["fixing_commits", "szz_oldest", "fixed_files", "fixed_files_renamed", "failure_prone_named", "snapshot",
        "proc_churn", "metrics_dataset", "label_flag", "lineage", "prod_entropy", "sentence_tokens"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_or_cartesian_joins(spark):
    qs = E.queries()
    for key in KEYS:
        plan = _plan(qs[key](spark, SF001))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, key


def test_document_scans_are_pruned(spark):
    plan = _plan(E.queries()["sentence_tokens"](spark, SF001))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(len(s.split(",")) == 2 for s in schemas), schemas   # doc_id, text of 5 columns
