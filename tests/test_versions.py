import re

from pyspark.sql import functions as F

from faultline.operators.snapshot import alive_intervals, checkpoint_axis, snapshot
from faultline.operators.versions import keyed, measure, version_table
from faultline.plans import profiles, queries

from conftest import SF001

FILES = "repo string, idx long, pos int, change_type string, old_path string, new_path string, content string, content_before string"
DOC = "- name: a\n  copy:\n    src: x\n"
ROWS = [("r", 0, 0, "ADD", None, "roles/a.yml", DOC, None), ("r", 1, 0, "RENAME", "roles/a.yml", "roles/b.yml", DOC, DOC),
        ("r", 2, 0, "MODIFY", "roles/b.yml", "roles/b.yml", "", DOC), ("r", 3, 0, "MODIFY", "roles/b.yml", "roles/b.yml", "- copy: [", ""),
        ("r", 3, 1, "ADD", None, "src/x.py", DOC, None), ("s", 0, 0, "ADD", None, "roles/a.yml", DOC, None),
        ("s", 1, 0, "DELETE", "roles/a.yml", None, None, DOC)]


def test_every_content_is_stored_and_measured_once(spark):
    files = spark.createDataFrame(ROWS, FILES).repartition(4)
    keep = profiles.ANSIBLE.keep
    assert sorted(r.content for r in version_table(files, keep).collect()) == ["", "- copy: [", DOC]
    seen = []

    def metrics(contents, keys):
        seen.append(contents.count())
        return profiles.ANSIBLE.product_metrics(contents, keys)

    got = {r.content_key: r.num_tasks for r in measure(files, keep, metrics).collect()}
    assert seen == [3] and sorted(got.values(), key=str) == [1, None, None]
    events = keyed(files, keep)
    assert "content" not in events.columns and "content_before" not in events.columns
    assert {(r.repo, r.idx, r.pos): r.kept for r in events.collect()} == {
        ("r", 0, 0): True, ("r", 1, 0): True, ("r", 2, 0): False, ("r", 3, 0): True, ("r", 3, 1): False, ("s", 0, 0): True, ("s", 1, 0): False}


def test_snapshot_carries_keys(spark):
    files = spark.createDataFrame(ROWS, FILES)
    commits = spark.createDataFrame([(r, i) for r in "rs" for i in range(5)], "repo string, idx long")
    cps = spark.createDataFrame([("r", 1, 0), ("r", 4, 1), ("s", 0, 0), ("s", 4, 1)], "repo string, idx long, rel_no long")
    got = snapshot(keyed(files, profiles.ANSIBLE.keep), checkpoint_axis(commits, cps), ["kept"]).collect()
    assert sorted((r.repo, r.rel_no, r.path, r.idx, r.kept) for r in got) == [
        ("r", 0, "roles/b.yml", 1, True), ("r", 1, "roles/b.yml", 3, True), ("r", 1, "src/x.py", 3, False), ("s", 0, "roles/a.yml", 0, True)]


def test_contents_are_not_shuffled(spark):
    """Intervals of a profile's versions: no exchange of the plan carries a content."""
    h = queries.history(spark, SF001)
    df = alive_intervals(keyed(h.files, profiles.TOSCA.keep), ["content_key", "kept"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "content_key" in plan
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    assert scans and all("content_before" not in line for line in scans)
    for line in plan.splitlines():
        if re.search(r"Exchange|Sort|Aggregate|Window|Join", line):
            assert not re.search(r"\bcontent#", line), line
