import os
import tempfile

from pyspark.sql import functions as F

from faultline.functions import text
from faultline.operators import classify
from faultline.operators.lives import file_lives
from faultline.operators.process import PROCESS_METRICS
from faultline.operators.snapshot import read_text_files
from faultline.plans import dataset, profiles
from faultline.sources.binding import bind
from faultline.sources.history import commit_checkpoints

from conftest import SF001


def test_read_text_files(spark):
    d = tempfile.mkdtemp(prefix="faultline-files-")
    os.makedirs(os.path.join(d, "sub"))
    with open(os.path.join(d, "bad.bin"), "wb") as f:
        f.write(b"\x81")
    with open(os.path.join(d, "ok.txt"), "w") as f:
        f.write("hooray!")
    got = {os.path.basename(r.path): r.content for r in read_text_files(spark, d).collect()}
    assert got == {"bad.bin": None, "ok.txt": "hooray!"}


def test_sentence_token_lists(spark):
    df = spark.createDataFrame([("Initial commit",), ("Fix it. Now!",)], "msg string")
    assert [r[0] for r in df.select(text.sentence_token_lists(F.col("msg"))).collect()] == [
        [["Initial", "commit"]], [["Fix", "it"], ["Now"]]]


def test_focus_words_restrict_categories(spark):
    commits = spark.createDataFrame([("r", "0", 0, "Fix the server config", ["fix config"]),
                                     ("r", "1", 1, "Fix the server config", ["fix server"])],
                                    "repo string, commit_hash string, idx long, msg string, focus array<string>")
    got = [list(r.labels) for r in classify.classify(commits, focus="focus").orderBy("idx").collect()]
    assert got == [[], ["SERVICE"]]


def test_dataset_shapes_commit_mode(spark):
    h = bind(spark, SF001)
    lives = file_lives(h.files).checkpoint()
    cps = commit_checkpoints(h.commits)
    plain = dataset.build_dataset(h, profiles.BASE, cps, lives, None, product=True, process=False)
    assert plain.columns[3:] == dataset.ID_COLUMNS and plain.count() > 0
    full = dataset.build_dataset(h, profiles.BASE, cps.filter(F.col("idx") < 60), lives, None,
                                 product=True, process=True, delta=True)
    metric_cols = full.columns[3:]
    assert len(metric_cols) == 4 + 16 + 16
    assert metric_cols[4:20] == PROCESS_METRICS


def test_collapse_whitespace(spark):
    df = spark.createDataFrame([("a \t\n b  c",)], "s string")
    assert df.select(text.collapse_ws(F.col("s"))).first()[0] == "a b c"


def test_snapshot_hides_git_folders(spark):
    from faultline.operators.snapshot import checkpoint_axis, snapshot
    files = spark.createDataFrame([
        ("r", "c0", 0, 0, "ADD", None, ".github/workflows/ci.yml", "x"),
        ("r", "c0", 0, 1, "ADD", None, "README.md", "y"),
        ("r", "c1", 1, 0, "RENAME", "README.md", "docs/README.md", "y"),
        ("r", "c2", 2, 0, "DELETE", "docs/README.md", None, None)],
        "repo string, commit_hash string, idx long, pos int, change_type string, old_path string, "
        "new_path string, content string")
    commits = spark.createDataFrame([("r", f"c{i}", i) for i in range(3)], "repo string, commit_hash string, idx long")
    cps = commits.withColumn("rel_no", F.col("idx"))
    got = sorted((r.rel_no, r.path) for r in snapshot(files, checkpoint_axis(commits, cps)).collect())
    assert got == [(0, "README.md"), (1, "docs/README.md")]
