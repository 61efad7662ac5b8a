from pyspark.sql import functions as F

from faultline.functions import modules
from faultline.operators import classify
from faultline.operators.classify import ansible_change_signals

FILES = "repo string, commit_hash string, pos int, change_type string, new_path string, content string, content_before string"


def _changed(spark, keys, **options):
    rows = [("r", f"c{i}", 0, "MODIFY", "roles/a/tasks/main.yml", f"- {key}:\n    x: 1\n", f"- {key}:\n    x: 2\n") for i, key in enumerate(keys)]
    got = ansible_change_signals(spark.createDataFrame(rows, FILES), **options)
    found = {r.commit_hash: (r.data_changed, r.include_changed, r.service_changed) for r in got.collect()}
    return {key: found[f"c{i}"] for i, key in enumerate(keys)}


def test_families(spark):
    data, include, service, none = (True, False, False), (False, True, False), (False, False, True), (False, False, False)
    want = {"redis": data, "copy": data, "zfs": data, "ipa_user": data, "nxos_vlan": data, "fortios_dlp_sensor": data, "nclu": data,
            "nxos": none, "nxosvlan": none, "_nxos_vlan": none, "my_nxos_vlan": none, "debug": none,
            "include_tasks": include, "import_role": include, "include_x": none, "service": service, "service_facts": none}
    assert _changed(spark, list(want)) == want


def test_callers_add_names_and_large_tables_are_joined(spark, monkeypatch):
    more = spark.createDataFrame([("debug",), ("debug",), ("redis",)], "module string")
    families = modules.family_table(spark, more)
    assert families.where("match = '=redis'").count() == 1
    assert _changed(spark, ["debug", "file", "x"], families=families) == {
        "debug": (True, False, False), "file": (True, False, False), "x": (False, False, False)}
    monkeypatch.setattr(classify, "BROADCAST_FAMILIES", 1)
    assert _changed(spark, ["nxos_vlan", "x"], families=families) == {"nxos_vlan": (True, False, False), "x": (False, False, False)}
    listed = modules.family_table(spark, ["x"])
    assert _changed(spark, ["x"], families=listed) == {"x": (True, False, False)}


def test_first_parsable_file_of_a_commit(spark):
    doc = "- copy:\n    x: {}\n"
    rows = [("r", "c", 0, "MODIFY", "roles/a/tasks/a.yml", "k: [", doc.format(1)), ("r", "c", 1, "MODIFY", "roles/a/tasks/b.yml", doc.format(1), doc.format(1)),
            ("r", "c", 2, "MODIFY", "roles/a/tasks/c.yml", doc.format(1), doc.format(2)), ("r", "d", 0, "MODIFY", "src/a.py", doc.format(1), doc.format(2))]
    got = ansible_change_signals(spark.createDataFrame(rows, FILES)).collect()
    assert [(r.commit_hash, r.data_changed) for r in got] == [("c", False)]
    assert ansible_change_signals(spark.createDataFrame([], FILES)).count() == 0


def test_matches(spark):
    df = spark.createDataFrame([("a_b_c",), ("abc",), ("_x",), (None,)], "k string")
    assert [r.m for r in df.select(modules.matches(F.col("k")).alias("m")).collect()] == [["=a_b_c", "^a_"], ["=abc"], ["=_x"], []]
