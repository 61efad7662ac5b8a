from pyspark.sql import functions as F

from faultline.plans import miner, profiles
from faultline.sources.binding import bind
from faultline.sources.history import History

from conftest import SF001


def test_empty_history_flows_through(spark):
    h = bind(spark, SF001)
    none = F.col("repo") == "no-such-repo"
    empty = History(h.commits.filter(none), h.files.filter(none), h.diff_lines.filter(none), h.tags.filter(none))
    m = miner.mine(empty, profiles.ANSIBLE)
    assert m.fixing.count() == 0 and m.fixed.count() == 0 and m.failure_prone.count() == 0


def test_profile_hooks(spark):
    df = spark.createDataFrame([(1, "- name: a\n  copy:\n    src: b\n")], "id long, content string")
    assert profiles.BASE.product_metrics(df, ["id"]) is None
    assert profiles.ANSIBLE.product_metrics(df, ["id"]).first().num_tasks == 1
    p = spark.createDataFrame([("roles/x/tasks/a.yml", None), ("src/a.py", None)], "path string, content string")
    assert [r[0] for r in p.select(profiles.ANSIBLE.ignore(F.col("path"), F.col("content"))).collect()] == [False, True]


def test_branch_scoped_mining(spark):
    h = bind(spark, SF001)
    on_f = miner.mine_fixing_commits(h, profiles.ANSIBLE, branch="F")
    every = miner.mine_fixing_commits(h, profiles.ANSIBLE)
    f_hashes = h.commits.filter(F.col("branch") == "F").select("repo", "commit_hash")
    assert on_f.count() == every.join(f_hashes, ["repo", "commit_hash"], "left_semi").count() > 0
