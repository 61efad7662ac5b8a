import pytest
from pyspark.sql import functions as F

from faultline.functions import paths, rules

RULE_CASES = [
    ("defect", "Resolve an issue with the loop", True), ("defect", "Add a new role", False),
    ("conditional", "broken boolean check", True), ("conditional", "rename variables", False),
    ("storage_configuration", "tune the MySQL pool", True), ("storage_configuration", "rename task", False),
    ("file_configuration", "wrong permissions", True), ("file_configuration", "bump version", False),
    ("network_configuration", "shell script update", True),  # 'ip' inside 'script': substring semantics
    ("network_configuration", "bump version", False),
    ("user_configuration", "reset the password", True), ("user_configuration", "bump version", False),
    ("cache_configuration", "clear caches", True), ("cache_configuration", "bump version", False),
    ("dependency", "the border case", True),  # 'order' inside 'border'
    ("dependency", "bump version", False),
    ("documentation", "docker image", True),  # 'doc' inside 'docker'
    ("documentation", "bump version", False),
    ("idempotency", "Idempotent restart", True), ("idempotency", "bump version", False),
    ("security", "CVE patch", True), ("security", "bump version", False),
    ("service", "restart the server", True), ("service", "bump version", False),
    ("syntax", "fix indentation", True), ("syntax", "bump version", False),
]


def test_rules(spark):
    df = spark.createDataFrame([(r, t) for r, t, _ in RULE_CASES], "rule string, text string")
    got = [row.hit for row in df.select(
        F.coalesce(*[F.when(F.col("rule") == r, rules.has(F.col("text"), r)) for r in rules.RULES]).alias("hit")
    ).collect()]
    assert got == [e for _, _, e in RULE_CASES]


PATHS = [
    ("roles/web/tasks/main.yml", True), ("playbooks/site.yml", True), ("roles/web/tasks/main.yaml", False),
    ("latest/tasks/main.yml", False), ("tests/roles/x/tasks/a.yml", True), ("src/app.py", False), ("", False),
]


def test_is_ansible_file(spark):
    df = spark.createDataFrame(PATHS, "path string, expected boolean")
    for row in df.select("expected", paths.is_ansible_file(F.col("path")).alias("got")).collect():
        assert row.got == row.expected


@pytest.mark.parametrize("path, content, expected", [
    ("a/b.tosca", None, True), ("a/b.tosca.yaml", None, True), ("a/b.tosca.yml", None, True),
    ("test/b.tosca", None, False), ("a/b.yml", None, False),
    ("x.txt", "tosca_definitions_version: tosca_simple_yaml_1_3\n", True),
    ("a/b.tosca", "- name: x\n", False),              # content decides when present
    ("a/b.tosca", "tosca_definitions_version:\n", False),
    ("a/b.tosca", "", True),                           # empty content -> path decides
])
def test_is_tosca_file(spark, path, content, expected):
    df = spark.createDataFrame([(path, content)], "path string, content string")
    assert df.select(paths.is_tosca_file(F.col("path"), F.col("content"))).first()[0] is expected


def test_repo_locator(spark):
    df = spark.createDataFrame([("https://github.com/owner/name.git",), ("git@gitlab.com:o/n",),
                                ("https://gitlab.com/a/b",), ("https://bitbucket.com/a/b",), ("git.com/a/b",)],
                               "url string")
    out = df.select(paths.is_valid_locator(F.col("url")).alias("v"), paths.repo_owner(F.col("url")).alias("o"),
                    paths.repo_name(F.col("url")).alias("n"), paths.is_remote(F.col("url")).alias("r")).collect()
    assert [(r.v, r.o, r.n, r.r) for r in out] == [
        (True, "owner", "name", True), (False, "", "", True), (True, "a", "b", True),
        (False, "", "", True), (False, "", "", False)]
