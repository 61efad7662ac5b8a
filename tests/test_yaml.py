import time

import pytest

from faultline.functions.yaml import scan, yaml_nodes
from faultline.operators.classify import ansible_change_signals
from faultline.operators.product import product_metrics


def _nodes(spark, doc):
    df = spark.createDataFrame([(doc,)], "content string")
    r = df.select(yaml_nodes("content").alias("n")).first().n
    return None if r is None else [(n.kind, n.key, n.val, n.depth, n.pkey) for n in r]


def test_task_list(spark):
    doc = "---\n- name: Copy file\n  copy:\n    src: a.war\n    dest: /tmp\n  when: x == 1\n"
    assert _nodes(spark, doc) == [
        ("item", None, "", 0, None), ("key", "name", "Copy file", 1, None), ("key", "copy", "", 1, None),
        ("key", "src", "a.war", 2, "copy"), ("key", "dest", "/tmp", 2, "copy"), ("key", "when", "x == 1", 1, None)]


def test_list_under_key_same_column(spark):
    assert _nodes(spark, "imports:\n- a.yml\n- b.yml\nother: 1\n") == [
        ("key", "imports", "", 0, None), ("item", None, "a.yml", 1, "imports"), ("item", None, "b.yml", 1, "imports"),
        ("key", "other", "1", 0, None)]


def test_tab_indented_is_unparsable(spark):
    assert _nodes(spark, "- name: x\n\tcopy: y\n") is None


def test_product_metrics_shapes(spark):
    ans = "---\n- name: Copy WAR file to host\n  copy:\n    src: helloworld.war\n    dest: /tmp\n"
    df = spark.createDataFrame([(1, ans), (2, ans.replace("  copy", "\tcopy"))], "id long, content string")
    out = {r.id: r for r in product_metrics(df, ["id"], "ansible").collect()}
    assert out[1].num_tasks == 1 and out[1].num_parameters == 2 and out[1].num_keys == 4
    assert out[1].lines_code == 5 and out[1].num_distinct_modules == 1 and out[1].num_unique_names == 1
    assert all(out[2][c] is None for c in out[2].asDict() if c != "id")
    tosca = ("tosca_definitions_version: alien_dsl_1_4_0\nmetadata:\n  template_name: t\n"
             "topology_template:\n  node_templates:\n    a:\n      type: x\n    b:\n      type: y\n")
    t = product_metrics(spark.createDataFrame([(1, tosca)], "id long, content string"), ["id"], "tosca").first()
    assert t.num_node_templates == 2 and len(t) == 17


def _scan(doc):
    s = scan(doc)
    return s and [(s.depths[i], s.kinds[i], s.keys[i], s.vals[i]) for i in range(len(s.kinds))]


@pytest.mark.parametrize("doc, nodes", [
    # block scalars: their lines are text
    ("- shell: |\n    a: b\n    - x: y\n\n    # no comment\n  args: z\n", [
        (0, "item", None, ""), (1, "key", "shell", "a: b\n- x: y\n\n# no comment"), (1, "key", "args", "z")]),
    ("a: >-\n  one\n  two\n\n  three\nb: |2\n    x\n   y\n", [(0, "key", "a", "one two\n\nthree"), (0, "key", "b", "  x\n y")]),
    ("k: |\n  x\n\ty\nj: 1\n", None),
    ("- |\n  a\n- b\n", [(0, "item", None, "a"), (0, "item", None, "b")]),
    ("k: !vault |  # c\n  12\n", [(0, "key", "k", "12")]),
    ("k: |\n    a\n  b\n", None),
    # flow collections, over lines too
    ("k: {src: a, dest: [b, 'c, d'],\n  e: {f: 1}} # c\n", [
        (0, "key", "k", ""), (1, "key", "src", "a"), (1, "key", "dest", ""), (2, "item", None, "b"), (2, "item", None, "c, d"),
        (1, "key", "e", ""), (2, "key", "f", "1")]),
    ("k: [a: b, {}, []]\n", [(0, "key", "k", ""), (1, "item", None, ""), (2, "key", "a", "b"), (1, "item", None, ""), (1, "item", None, "")]),
    ("[a, b]\n", [(0, "scalar", None, ""), (1, "item", None, "a"), (1, "item", None, "b")]),
    ("k: [unclosed\nj: 1\n", None), ("k: [a]]\n", None), ("k: [a}\n", None), ("k: {{ x }}\n", None), ("k: [a b: c d]\n", [
        (0, "key", "k", ""), (1, "item", None, ""), (2, "key", "a b", "c d")]),
    # quotes
    ("k: \"a # b: c\" # d\nj: 'it''s'\n", [(0, "key", "k", "a # b: c"), (0, "key", "j", "it's")]),
    ("k: 'one\n  two'\nj: \"x \\\" y\"\n", [(0, "key", "k", "one two"), (0, "key", "j", 'x " y')]),
    ("k: 'open\nj: 1\n", None), ("k: \"a\" b\n", None), ('"q: r": 1\n', [(0, "key", "q: r", "1")]),
    # plain text, anchors, nulls
    ("k: one\n  two # c\nurl: http://x/y#z\n", [(0, "key", "k", "one two"), (0, "key", "url", "http://x/y#z")]),
    ("k:\n  text\nj: ~\n", [(0, "key", "k", "text"), (0, "key", "j", "")]),
    ("k: &x\n  a: 1\nj: *x\n", [(0, "key", "k", ""), (1, "key", "a", "1"), (0, "key", "j", "*x")]),
    ("%YAML 1.2\n---\nk: 1\n...\n", [(0, "key", "k", "1")]), ("a: 1\n---\nb: 1\n", None),
    ("a: 1\r\nb: 2\r\n", [(0, "key", "a", "1"), (0, "key", "b", "2")]),
    # indentation
    ("a:\n  b: 1\n c: 2\n", None), ("  a: 1\nb: 2\n", None), ("a: 1\n  b: 2\n", None), ("a: b: c\n", None), ("a: 1\ntext\n", None),
    ("a:\n    - b\n  - c\n", None), ("- - a\n  - b\n-\n  c: 1\n", [
        (0, "item", None, ""), (1, "item", None, "a"), (1, "item", None, "b"), (0, "item", None, ""), (1, "key", "c", "1")]),
    ("# nothing\n", []), ("", None), (None, None), ("just\ntext\n", [(0, "scalar", None, "just text")]),
])
def test_documents(doc, nodes):
    assert _scan(doc) == nodes


def test_missing_and_broken_documents_are_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "# c"), (4, "a: [b"), (5, "a: 1")], "id long, content string")
    got = {r.id: r.n for r in df.select("id", yaml_nodes("content").alias("n")).collect()}
    assert [got[1], got[2], got[3], got[4]] == [None, None, [], None] and len(got[5]) == 1


def _form(doc):
    s = scan(doc)
    return s.hashes()[0]


@pytest.mark.parametrize("one, two, same", [
    ("k:\n  a: 1\n  b: 2\n", "k: {b: 2, a: 1}\n", True),            # a mapping has no order
    ("k:\n- 1\n- 2\n", "k: [1, 2]\n", True), ("k: [1, 2]\n", "k: [2, 1]\n", False),
    ("k: 'x'\n", "k: x\n", True), ("k: '1'\n", "k: 1\n", False), ("k: yes\n", "k: True\n", True), ("k: yes\n", "k: 'yes'\n", False),
    ("k:\n", "k: null\n", True), ("k: ''\n", "k:\n", False), ("k: []\n", "k: {}\n", False), ("k: {a: {b: c}}\n", "k: {a: {b: d}}\n", False),
    ("k:\n  a: 1\n  a: 2\n", "k: {a: 2}\n", True), ("k: |\n  x\n", "k: x\n", True), ("k: [a, [b]]\n", "k: [a, b]\n", False),
])
def test_equal_values_have_equal_forms(one, two, same):
    assert (_form(one) == _form(two)) == same


def test_time_is_linear():
    def cost(lines):
        doc = "".join(f"- name: t{i}\n  shell: |\n    a: b\n  copy: {{src: a, dest: [b]}}\n  when: x\n" for i in range(lines // 5))
        deep = "".join("  " * (i % 50) + f"k{i}:\n" for i in range(lines))
        best = []
        for _ in range(3):
            t = time.process_time()
            scan(doc).hashes()
            scan(deep)
            best.append(time.process_time() - t)
        return min(best)

    assert cost(20_000) < 12 * cost(4_000)


def test_signals_on_nested_values(spark):
    """A moved unrelated block changes nothing; a changed nested value, a changed order of list entries do."""
    base = "- name: a\n  copy:\n    src: x\n    opts: [1, 2]\n- name: b\n  debug:\n    msg: hello\n"
    moved = "- name: b\n  debug:\n    msg: hello\n- name: a\n  copy:\n    opts: [1, 2]\n    src: x\n"
    nested = base.replace("[1, 2]", "[1, 3]")
    block = base.replace("src: x", "content: |\n      service: no\n      - q")
    rows = [("r", f"c{i}", 0, "MODIFY", "roles/a/tasks/main.yml", now, then) for i, (now, then) in enumerate(
        [(moved, base), (nested, base), (base, base.replace("[1, 2]", "[2, 1]")), (block, base), (block, block), (base, ""), (base, "a: [b")])]
    files = spark.createDataFrame(rows, "repo string, commit_hash string, pos int, change_type string, new_path string, content string, content_before string")
    got = {r.commit_hash: (r.data_changed, r.service_changed) for r in ansible_change_signals(files).collect()}
    assert got == {"c0": (False, False), "c1": (True, False), "c2": (True, False), "c3": (True, False), "c4": (False, False), "c5": (True, False)}
