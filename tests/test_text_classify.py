from pyspark.sql import functions as F

from faultline.functions import text
from faultline.operators import classify


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([("Fixed cache problem. Bump version",),
                                ("fix wrong package dependency for Debian/Ubuntu",), ("Fix wrong condition in main.yml",),
                                ("",)], "msg string")
    got = [r[0] for r in df.select(text.sentence_texts(F.col("msg"))).collect()]
    assert got == [["Fixed cache problem", "Bump version"], ["fix wrong package dependency for"],
                   ["Fix wrong condition in"], [""]]


def _labels(spark, msgs, signals=None):
    commits = spark.createDataFrame([("r", str(i), i, m) for i, m in enumerate(msgs)],
                                    "repo string, commit_hash string, idx long, msg string")
    out = classify.classify(commits, signals).orderBy("idx").collect()
    return [list(r.labels) for r in out]


def test_message_categories(spark):
    msgs = ["Initial commit", "Fix user permissions", "Fix ip address", "Fixed cache problem",
            "fix wrong package dependency for Debian/Ubuntu", "Fix nginx service that did not start the server.",
            "Fix typo", "Fix idempotency of the task", "Fix security issue after the update",
            "Fix broken boolean logic", "Update docs. Fix broken loop", "Fix the README"]
    assert _labels(spark, msgs) == [
        [], ["CONFIGURATION_DATA"], ["CONFIGURATION_DATA"], ["CONFIGURATION_DATA"], ["DEPENDENCY"],
        ["SERVICE"], ["SYNTAX"], ["IDEMPOTENCY"], ["SECURITY"], ["CONDITIONAL"], [], ["DOCUMENTATION"]]


def test_commit_signals_need_a_defect_sentence(spark):
    sig = spark.createDataFrame([("r", "0", True, True, False, True), ("r", "1", True, True, True, True)],
                                "repo string, commit_hash string, comment_changed boolean, data_changed boolean, "
                                "include_changed boolean, service_changed boolean")
    got = _labels(spark, ["Fix broken loop", "Refactor everything"], sig)
    assert got == [["CONFIGURATION_DATA", "DOCUMENTATION", "SERVICE"], []]


def test_comment_changed(spark):
    files = spark.createDataFrame([("r", "a", 0, "MODIFY"), ("r", "b", 0, "ADD"), ("r", "c", 0, "MODIFY")],
                                  "repo string, commit_hash string, pos int, change_type string")
    diff = spark.createDataFrame([("r", "a", 0, "  # note"), ("r", "b", 0, "# added file"), ("r", "c", 0, "x = 1")],
                                 "repo string, commit_hash string, pos int, text string")
    got = [r.commit_hash for r in classify.comment_changed(files, diff).collect()]
    assert got == ["a"]


def test_ansible_signals_first_parsable_file(spark):
    before = "- name: t\n  copy:\n    src: a\n"
    after = "- name: t\n  copy:\n    src: b\n"
    bad = "- name: t\n\tcopy: x\n"
    files = spark.createDataFrame([
        ("r", "c1", 0, "MODIFY", "roles/x/tasks/a.yml", bad, before),   # unparsable -> skipped
        ("r", "c1", 1, "MODIFY", "roles/x/tasks/b.yml", after, before),  # decides: data changed
        ("r", "c1", 2, "MODIFY", "roles/x/tasks/c.yml", before, before),
        ("r", "c2", 0, "MODIFY", "roles/x/tasks/a.yml", before, before.replace("name: t", "name: u")),
    ], "repo string, commit_hash string, pos int, change_type string, new_path string, content string, "
       "content_before string")
    got = {r.commit_hash: (r.data_changed, r.include_changed, r.service_changed)
           for r in classify.ansible_change_signals(files).collect()}
    assert got == {"c1": (True, False, False), "c2": (False, False, False)}


def test_words_end_at_marks_and_clitics(spark):
    cases = {"fix(role): wrong user": "fix role wrong user", "fix:typo": "fix typo", "bug;issue": "bug issue",
             "don't break user's file": "do break user file", "a--b, c,d 3:4 x": "a b c d x", "": "", "v1.2 (beta2)": ""}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    got = {r.m: " ".join(r.t) for r in df.select("m", text.tokens(F.col("m")).alias("t")).collect()}
    assert got == cases


def test_an_emptied_file_decides(spark):
    doc = "- name: t\n  copy:\n    src: a\n"
    rows = [("r", "c1", 0, "MODIFY", "tasks/a.yml", "", doc), ("r", "c2", 0, "MODIFY", "tasks/a.yml", doc, doc),
            ("r", "c3", 0, "MODIFY", "tasks/a.yml", None, doc)]
    df = spark.createDataFrame(rows, "repo string, commit_hash string, pos int, change_type string, new_path string, "
                                     "content string, content_before string")
    got = {r.commit_hash: r.data_changed for r in classify.ansible_change_signals(df).collect()}
    assert got == {"c1": True, "c2": False}
