"""

``queries()`` maps every implemented operator family to a Spark job (see
``faultline/plans/queries.py``).  ``oracle_sql()`` rebuilds the same change history from the driver
tables in DuckDB SQL (the binding of ``faultline/sources/binding.py``) and answers the same
question.  Values that come from the generated YAML documents are taken from the generator
columns (module, src, condition) instead of re-parsing the text.  The rename-aware interval merge
(``fixed_files_renamed``) is mirrored by a recursive CTE that walks each file lineage newest first,
carrying the rename map and the interval list in the row.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans import queries as _q  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: which commits fix defects, and in which categories (Ansible profile)."""
    return _q.q_fixing_commits(spark, SMOKE_DIR)


def _training_data():
    """The training-data operators (``faultline/llm`` and ``corpus_pipeline.py``), or None where those
    files are not installed.  Any other import error is raised."""
    try:
        import corpus_pipeline
        from faultline.llm import entry as llm_entry
    except ModuleNotFoundError as missing:
        if missing.name in ("corpus_pipeline", "faultline.llm", "faultline.llm.entry"):
            return None
        raise
    return llm_entry, corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(_q.registry())
    if extra := _training_data():
        found |= extra[0].QUERIES | {"pipeline": extra[1].run}
    return found


# ============================================================================ oracle SQL (DuckDB)
NL, TAB = "chr(10)", "chr(9)"

# --- fixed values, written out here so that a slip in the engine's own lists shows up ---
_RULES = {
    "defect": "error|bug|fix|issu|mistake|incorrect|fault|defect|flaw",
    "conditional": "logic|condit|boolean",
    "storage_configuration": "sql|db|databas",
    "file_configuration": "file|permiss",
    "network_configuration": "network|ip|address|port|tcp|dhcp",
    "user_configuration": "user|usernam|password",
    "cache_configuration": "cach",
    "dependency": "requir|depend|relat|order|sync|compat|ensur|inherit",
    "documentation": "doc|comment|spec|licens|copyright|notic|header|readm",
    "idempotency": "idempot",
    "security": "vul|ssl|secr|authent|password|secur|cve",
    "service": "servic|server",
    "syntax": "compil|lint|warn|typo|spell|indent|regex|variabl|whitespac",
}
_LABEL_RULES = {
    "CONDITIONAL": ("conditional",),
    "CONFIGURATION_DATA": ("storage_configuration", "file_configuration", "network_configuration",
                           "user_configuration", "cache_configuration"),
    "DEPENDENCY": ("dependency",),
    "DOCUMENTATION": ("documentation",),
    "IDEMPOTENCY": ("idempotency",),
    "SECURITY": ("security",),
    "SERVICE": ("service",),
    "SYNTAX": ("syntax",),
}
_LABELS = list(_LABEL_RULES)
_MESSAGES = [
    "Fix wrong condition in main.yml",
    "Fixed cache problem. Bump version",
    "fix wrong package dependency for Debian/Ubuntu",
    "Fix task idempotency",
    "Fix lint issue and typo",
    "Fix nginx service",
    "Refactored code",
    "Fix typo in README",
    "Fixed SSL certificate validation",
    "Bump version. Update database password",
    "Update docs. Fix broken loop",
    "Merge branch develop",
    "Correct network port for sshd",
    "Fix incorrect user permissions on file",
    "Resolve issue with ip address",
    "Fix wrong include of tasks",
]
_MODULES = ["copy", "mysql_user", "service", "include_tasks", "zfs",
            "template", "redis", "service", "import_role", "nxos_vlan",
            "nxos", "vyos_config", "systemd", "include_vars", "ipa_user"]
_DATA_MODULES = "('copy', 'mysql_user', 'zfs', 'template', 'redis', 'nxos_vlan', 'vyos_config', 'ipa_user')"
_INCLUDES = "('include_tasks', 'import_role', 'include_vars')"
_ANS = ["lines_code", "lines_blank", "num_conditions", "num_keys", "num_tokens", "text_entropy",
        "avg_play_size", "num_distinct_modules", "num_parameters", "num_tasks", "num_unique_names"]
_TOS = ["lines_code", "lines_blank", "num_keys", "num_suspicious_comments", "num_tokens", "text_entropy",
        "num_imports", "num_inputs", "num_interfaces", "num_node_templates", "num_node_types",
        "num_parameters", "num_properties", "num_relationship_templates", "num_relationship_types",
        "num_shell_scripts"]


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _name(p: str, v: str) -> str:
    return (f"(CASE {p} % 4 WHEN 0 THEN 'roles/web/tasks/f' WHEN 1 THEN 'playbooks/f' WHEN 2 THEN 'topology/f' "
            f"ELSE 'src/f' END || {_s(p)} || '_v' || {_s(v)} || "
            f"CASE {p} % 4 WHEN 2 THEN '.tosca.yml' WHEN 3 THEN '.py' ELSE '.yml' END)")


def _module(slot: str, additions: str = "additions") -> str:
    return f"(CASE {additions} % 3 * 5 + {slot} " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODULES)) + " END)"


def _msg_case() -> str:
    return "CASE o_custkey % 16 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"


def _lines_if(n: str, *groups: tuple[str, ...]) -> str:
    """The lines of the first ``n`` groups."""
    return " || ".join(f"CASE WHEN {n} > {i} THEN " + " || ".join(f"'{line}' || {NL}" for line in group) + " ELSE '' END"
                       for i, group in enumerate(groups))


def _block(n: str, head: str, first: str, second: str) -> str:
    return f"CASE WHEN {n} > 0 THEN '{head}:' || {NL} ELSE '' END || " + _lines_if(n, (f"  {first}",), (f"  {second}",))


_ANSIBLE_DOC = (f"('- name: t' || {_s('slot')} || {NL} || '  ' || {_module('slot')} || ':' || {NL} || "
                f"'    src: f' || {_s('additions')} || {NL} || '  when: a == ' || {_s('hunks')} || {NL} || "
                + _lines_if("additions % 5", ("- name: e1", "  command:", "    cmd: c1", "    chdir: d", "  when: b1"),
                            ("- name: e2", "  shell: |", "    a: b", "    - x: y", "  args:", "    chdir: d"),
                            ("- name: e1", "  command:", "    cmd: c3", "    chdir: d", "  when: b3 < 1 and b4 >= 2"),
                            ("- name: e4", "  copy: {src: a, dest: [b, c]}"))
                + " || " + _lines_if("hunks % 3", ("- hosts: w1",), ("- hosts: w2",)) + " || "
                + _lines_if("(additions // 4) % 3", ("",), ("",)) + ")")
# Entries of each TOSCA section beyond the fixed part of the document.
_TOSCA_MORE = {
    "imports": "(hunks + slot) % 3", "properties": "(additions // 5) % 3", "node_templates": "(additions // 7) % 3",
    "node_types": "additions % 3", "relationship_types": "hunks % 3", "relationship_templates": "(additions + hunks) % 3",
    "inputs": "(additions // 3) % 3", "interfaces": "slot % 3", "parameters": "(additions // 2) % 3"}
_TOSCA_DOC = (f"('tosca_definitions_version: tosca_simple_yaml_1_3' || {NL} || "
              + _lines_if("hunks % 2", ("description: >", "  inputs: all", "  - of them")) + " || "
              f"CASE WHEN slot = 0 THEN '# TODO: pin versions' || {NL} ELSE '' END || "
              + _lines_if("additions % 2", ("# FIXME names",)) +
              f" || 'imports:' || {NL} || '  - types' || {_s('slot')} || '.yml' || {NL} || "
              + _lines_if(_TOSCA_MORE["imports"], ("  - lib1.yml",), ("  - lib2.yml",)) +
              f" || 'topology_template:' || {NL} || '  node_templates:' || {NL} || '    app:' || {NL} || "
              f"'      type: my.nodes.App' || {NL} || '      properties:' || {NL} || "
              f"'        port: ' || {_s('additions')} || {NL} || '        script: run' || {_s('hunks')} || '.sh' || {NL} || "
              + " || ".join([
                  _lines_if(_TOSCA_MORE["properties"], ("        q1: 1",), ("        q2: 2",)),
                  _lines_if(_TOSCA_MORE["node_templates"], ("    n1:", "      type: t.N1"), ("    n2:", "      type: t.N2")),
                  _block(_TOSCA_MORE["node_types"], "node_types", "t.N1: root", "t.N2: root"),
                  _block(_TOSCA_MORE["relationship_types"], "relationship_types", "t.R1: root", "t.R2: root"),
                  _block(_TOSCA_MORE["relationship_templates"], "relationship_templates", "r1: t.R1", "r2: t.R2"),
                  _block(_TOSCA_MORE["inputs"], "inputs", "i1: string", "i2: string"),
                  _block(_TOSCA_MORE["interfaces"], "interfaces", "start: s1.sh", "stop: s2.sh"),
                  _block(_TOSCA_MORE["parameters"], "parameters", "p1: int", "p2: int"),
                  _lines_if("(additions // 4) % 3", ("",), ("",))]) + ")")


def _is_ansible(p: str) -> str:
    folders = " OR ".join(f"contains({p}, '{f}')" for f in ["playbooks/", "meta/", "tasks/", "handlers/", "roles/"])
    return f"coalesce(length({p}) > 0 AND NOT contains({p}, 'test/') AND ({folders}) AND ends_with({p}, '.yml'), false)"


def _is_tosca(p: str, c: str | None) -> str:
    by_path = (f"coalesce(length({p}) > 0 AND NOT contains({p}, 'test') AND (ends_with({p}, '.tosca') OR "
               f"ends_with({p}, '.tosca.yaml') OR ends_with({p}, '.tosca.yml')), false)")
    if c is None:
        return by_path
    by_content = f"coalesce(regexp_matches({c}, '^tosca_definitions_version[ \\t\\n\\r\\f]*:[^\\n]'), false)"
    return f"(CASE WHEN length({c}) > 0 THEN {by_content} ELSE {by_path} END)"


def _parsable(c: str, additions: str = "additions") -> str:
    """Documents with a tab in an indentation or an open bracket or quote do not parse."""
    return f"coalesce(length({c}) > 0 AND {additions} % 17 <> 0 AND {additions} % 19 <> 0, false)"


def _broken(doc: str, tab_at: str, open_at: str, opened: str) -> str:
    tabbed = f"CASE WHEN additions % 17 = 0 THEN replace({doc}, {NL} || '  {tab_at}', {NL} || {TAB} || '{tab_at}') ELSE {doc} END"
    return f"CASE WHEN additions % 19 = 0 THEN replace({tabbed}, '{open_at}', '{opened}') ELSE {tabbed} END"


def _tokens(s: str) -> str:
    s = f"regexp_replace({s}, '--+|\\.\\.\\.|[()\\[\\]{{}}<>;@#$%&?!\"]', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '[:,]([^0-9])', ' \\1', 'g'), 'n''t\\b|''(?:s|m|d|ll|re|ve)\\b', ' ', 'gi')"
    return ("list_filter(list_transform(regexp_split_to_array(" + s + ", '[ \\t\\n\\r\\f]+'), "
            "lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), "
            "lambda w: regexp_matches(w, '^\\p{L}+$'))")


def _sentences(t: str) -> str:
    return f"string_split(regexp_replace(coalesce({t}, ''), '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1))"


def _rx(*rule_names: str) -> str:
    return "|".join(_RULES[r] for r in rule_names)


_CTES = [
    ("h_commits", f"""
  SELECT 'r' || {_s('CAST(floor(o_orderkey / 375) AS BIGINT)')} AS repo, {_s('o_orderkey')} AS commit_hash,
         o_orderkey AS okey, o_orderstatus AS branch, 'dev' || {_s('o_custkey % 9')} AS author,
         o_orderdate AS committed_at, {_msg_case()} AS msg,
         CAST(row_number() OVER (PARTITION BY CAST(floor(o_orderkey / 375) AS BIGINT)
                                 ORDER BY o_orderdate, {_s('o_orderkey')}) - 1 AS BIGINT) AS idx
  FROM orders"""),
    ("h_ev0", """
  SELECT c.repo, c.commit_hash, c.idx, g.p,
         CASE g.ct WHEN 0 THEN 'ADD' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'RENAME' ELSE 'MODIFY' END AS change_type,
         g.additions, g.deletions, g.hunks, g.hunks % 5 AS slot
  FROM (SELECT l_orderkey AS okey, l_partkey % 40 AS p, min(l_suppkey % 10) AS ct,
               CAST(sum(l_quantity) AS BIGINT) AS additions, CAST(sum(round(l_discount * 100)) AS BIGINT) AS deletions,
               max(l_linenumber) AS hunks
        FROM lineitem GROUP BY l_orderkey, l_partkey % 40) g
  JOIN h_commits c ON c.okey = g.okey"""),
    ("h_ev1", """
  SELECT *, CAST(sum(CASE WHEN change_type = 'RENAME' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY repo, p ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ver
  FROM h_ev0"""),
    ("h_ev2", f"""
  SELECT *, {_name('p', 'born_ver')} || '@' || {_s('born')} AS life,
    CASE WHEN change_type = 'DELETE' THEN NULL
         WHEN p % 4 <= 1 THEN {_broken(_ANSIBLE_DOC, 'when', 'src: f', 'src: [f')}
         WHEN p % 4 = 2 THEN {_broken(_TOSCA_DOC, 'node_templates', 'type: my.nodes', 'type: "my.nodes')}
         ELSE 'x = ' || {_s('additions')} || {NL} END AS content,
    CASE WHEN change_type = 'DELETE' THEN NULL ELSE {_name('p', 'ver')} END AS new_path,
    CASE WHEN change_type = 'ADD' THEN NULL WHEN change_type = 'RENAME' THEN {_name('p', 'ver - 1')}
         ELSE {_name('p', 'ver')} END AS old_path,
    {_name('p', '0')} AS lineage
  FROM (SELECT *, coalesce(max(CASE WHEN change_type = 'ADD' THEN idx END) OVER w, -1) AS born,
               coalesce(max(CASE WHEN change_type = 'ADD' THEN ver END) OVER w, 0) AS born_ver
        FROM h_ev1 WINDOW w AS (PARTITION BY repo, p ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""),
    ("h_files", """
  SELECT *, CASE WHEN change_type = 'ADD' THEN NULL ELSE lag(content) OVER w END AS content_before,
         lag(slot) OVER w AS b_slot, lag(additions) OVER w AS b_add
  FROM h_ev2 WINDOW w AS (PARTITION BY repo, p ORDER BY idx)"""),
    # Two hunks an event: at old line a (da lines go, ia come) and at old line b (db go, ib come).
    ("h_hunks", """
  SELECT *, slot + 1 AS a, hunks + 8 AS b, CASE WHEN deletions > 0 THEN 1 + hunks % 2 ELSE 0 END AS da,
         CASE WHEN deletions > 0 AND deletions % 3 = 0 THEN 1 ELSE 0 END AS db, 1 + additions % 2 AS ia, additions % 3 AS ib
  FROM h_files"""),
    ("h_diff", """
  SELECT repo, commit_hash, idx, p AS pos, coalesce(new_path, old_path) AS path, 'added' AS side,
         unnest(CASE WHEN change_type = 'ADD' THEN range(1, 11 + additions % 8)
                     ELSE range(a, a + ia) || range(b + ia - da, b + ia - da + ib) END) AS line_no,
         CASE WHEN hunks % 3 = 0 THEN '  # c' || CAST(additions AS VARCHAR) ELSE 'x = ' || CAST(additions AS VARCHAR) END AS text,
         life
  FROM h_hunks WHERE change_type <> 'DELETE'
  UNION ALL
  SELECT repo, commit_hash, idx, p, coalesce(new_path, old_path), 'deleted', unnest(range(a, a + da) || range(b, b + db)),
         CASE WHEN deletions % 4 = 0 THEN '# note ' || CAST(deletions AS VARCHAR) ELSE 'y = ' || CAST(deletions AS VARCHAR) END,
         life
  FROM h_hunks WHERE change_type <> 'ADD' AND deletions > 0"""),
    ("h_msg", f"""
  SELECT repo, commit_hash, idx, committed_at,
         list_transform({_sentences('msg')}, lambda s: lower(array_to_string({_tokens('s')}, ' '))) AS st
  FROM h_commits"""),
    ("h_cls", "\n  SELECT repo, commit_hash, idx, committed_at, "
              f"coalesce(list_bool_or(list_transform(st, lambda s: regexp_matches(s, '{_rx('defect')}'))), false) AS has_defect, "
     + ", ".join(f"coalesce(list_bool_or(list_transform(st, lambda s: regexp_matches(s, '{_rx('defect')}') AND "
                 f"regexp_matches(s, '{_rx(*_LABEL_RULES[n])}'))), false) AS m_{n.lower()}" for n in _LABELS)
     + "\n  FROM h_msg"),
    ("h_comment", """
  SELECT DISTINCT d.repo, d.commit_hash FROM h_diff d
  JOIN h_files f ON f.repo = d.repo AND f.commit_hash = d.commit_hash AND f.p = d.pos
  WHERE f.change_type = 'MODIFY' AND regexp_matches(d.text, '^[ \\t\\r\\f]*#')"""),
    ("h_cand", f"""
  SELECT repo, commit_hash, p AS pos,
    CASE WHEN {_module('slot')} IN {_DATA_MODULES} THEN '1:src=f' || {_s('additions')} ELSE '' END
      || CASE WHEN additions % 5 = 4 THEN ' e4' ELSE '' END AS d_now,
    CASE WHEN {_module('b_slot', 'b_add')} IN {_DATA_MODULES} THEN '1:src=f' || {_s('b_add')} ELSE '' END
      || CASE WHEN b_add % 5 = 4 THEN ' e4' ELSE '' END AS d_then,
    CASE WHEN {_module('slot')} IN {_INCLUDES} THEN '1:src=f' || {_s('additions')} ELSE '' END AS i_now,
    CASE WHEN {_module('b_slot', 'b_add')} IN {_INCLUDES} THEN '1:src=f' || {_s('b_add')} ELSE '' END AS i_then,
    CASE WHEN {_module('slot')} = 'service' THEN '1:src=f' || {_s('additions')} ELSE '' END AS s_now,
    CASE WHEN {_module('b_slot', 'b_add')} = 'service' THEN '1:src=f' || {_s('b_add')} ELSE '' END AS s_then
  FROM h_files
  WHERE change_type = 'MODIFY' AND {_is_ansible('new_path')} AND {_parsable('content')} AND {_parsable('content_before', 'b_add')}"""),
    ("h_sig", """
  SELECT repo, commit_hash, arg_min(d_now <> d_then, pos) AS data_changed,
         arg_min(i_now <> i_then, pos) AS include_changed, arg_min(s_now <> s_then, pos) AS service_changed
  FROM h_cand GROUP BY repo, commit_hash"""),
    ("h_lab", """
  SELECT c.*, cm.commit_hash IS NOT NULL AS comment_changed,
         coalesce(s.data_changed, false) AS data_changed, coalesce(s.include_changed, false) AS include_changed,
         coalesce(s.service_changed, false) AS service_changed
  FROM h_cls c LEFT JOIN h_sig s USING (repo, commit_hash) LEFT JOIN h_comment cm USING (repo, commit_hash)"""),
]

_SIGNAL_OF = {"CONFIGURATION_DATA": "data_changed", "DEPENDENCY": "include_changed",
              "DOCUMENTATION": "comment_changed", "SERVICE": "service_changed"}


def _flag(label: str, signals: bool) -> str:
    base = f"m_{label.lower()}"
    sig = _SIGNAL_OF.get(label)
    if sig and (signals or sig == "comment_changed"):
        return f"({base} OR (has_defect AND {sig}))"
    return base


def _labels_sql(signals: bool) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_flag(n, signals)} THEN '{n}' END" for n in _LABELS) + ")"


def _any_label(signals: bool) -> str:
    return "(" + " OR ".join(_flag(n, signals) for n in _LABELS) + ")"


_CTES += [
    ("h_fix", f"""
  SELECT repo, commit_hash, idx, committed_at, {_labels_sql(True)} AS labels FROM h_lab l
  WHERE {_any_label(True)} AND EXISTS (SELECT 1 FROM h_files f WHERE f.repo = l.repo AND f.commit_hash = l.commit_hash
                                       AND f.change_type = 'MODIFY' AND {_is_ansible('f.new_path')})"""),
    ("h_fix_tosca", f"""
  SELECT repo, commit_hash, idx, {_labels_sql(False)} AS labels FROM h_lab l
  WHERE {_any_label(False)} AND EXISTS (SELECT 1 FROM h_files f WHERE f.repo = l.repo AND f.commit_hash = l.commit_hash
                                        AND f.change_type = 'MODIFY' AND {_is_tosca('f.new_path', 'f.content')})"""),
    ("h_fixev", f"""
  SELECT f.* FROM h_files f JOIN h_fix x ON x.repo = f.repo AND x.commit_hash = f.commit_hash
  WHERE f.change_type IN ('MODIFY', 'RENAME') AND {_is_ansible('f.new_path')}"""),
    ("h_prev", """
  SELECT repo, life, line_no, idx,
         max(idx) OVER (PARTITION BY repo, life, line_no ORDER BY idx
                        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_idx
  FROM (SELECT DISTINCT repo, life, line_no, idx FROM h_diff)"""),
    ("h_blame", """
  SELECT d.repo, d.commit_hash, d.pos, d.line_no, pr.prev_idx
  FROM h_diff d
  JOIN h_fixev e ON e.repo = d.repo AND e.commit_hash = d.commit_hash AND e.p = d.pos
  JOIN h_prev pr ON pr.repo = d.repo AND pr.life = d.life AND pr.line_no = d.line_no AND pr.idx = d.idx
  WHERE d.side = 'deleted'"""),
    # Real line numbers: every life is replayed event by event, the row carrying the writer of each line.
    ("l_ev", """
  SELECT repo, life, idx, commit_hash, p, change_type, a, b, da, db, ia, ib, additions,
         row_number() OVER (PARTITION BY repo, life ORDER BY idx) AS rn FROM h_hunks"""),
    ("l_walk(repo, life, rn, known, after)", """
  SELECT DISTINCT repo, life, CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[] FROM l_ev
  UNION ALL
  SELECT repo, life, rn, o, CASE change_type
      WHEN 'ADD' THEN list_resize([]::BIGINT[], 10 + additions % 8, idx)
      WHEN 'DELETE' THEN []::BIGINT[]
      ELSE o[1:a - 1] || list_resize([]::BIGINT[], ia, idx) || o[a + da:b - 1] || list_resize([]::BIGINT[], ib, idx) || o[b + db:] END
  FROM (SELECT e.*, list_resize(w.after, greatest(len(w.after), 40), NULL) AS o
        FROM l_walk w JOIN l_ev e ON e.repo = w.repo AND e.life = w.life AND e.rn = w.rn + 1)"""),
    ("h_lines", """
  SELECT e.repo, e.commit_hash, e.p AS pos, d.line_no, w.known[d.line_no] AS prev_idx
  FROM h_fixev e JOIN h_diff d ON d.repo = e.repo AND d.commit_hash = e.commit_hash AND d.pos = e.p AND d.side = 'deleted'
  JOIN l_ev l ON l.repo = e.repo AND l.commit_hash = e.commit_hash AND l.p = e.p
  JOIN l_walk w ON w.repo = l.repo AND w.life = l.life AND w.rn = l.rn
  WHERE w.known[d.line_no] IS NOT NULL"""),
    ("h_oldest", """
  SELECT repo, commit_hash, pos, min(prev_idx) AS bic_idx FROM h_lines
  GROUP BY repo, commit_hash, pos"""),
    ("h_w2a", """
  SELECT e.repo, e.new_path AS filepath, e.idx AS fic_idx, o.bic_idx,
         min(o.bic_idx) OVER (PARTITION BY e.repo, e.new_path ORDER BY e.idx DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min
  FROM h_fixev e JOIN h_oldest o ON o.repo = e.repo AND o.commit_hash = e.commit_hash AND o.pos = e.p"""),
    ("h_w2b", """
  SELECT *, sum(CASE WHEN fic_idx < prev_min THEN 1 ELSE 0 END)
              OVER (PARTITION BY repo, filepath ORDER BY fic_idx DESC
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM h_w2a"""),
    ("h_w2", """
  SELECT repo, filepath, max(fic_idx) AS fic_idx, min(bic_idx) AS bic_idx FROM h_w2b WHERE island = 0
  GROUP BY repo, filepath
  UNION ALL SELECT repo, filepath, fic_idx, bic_idx FROM h_w2b WHERE island > 0"""),
    ("h_fixed", """
  SELECT w.repo, w.filepath, cf.commit_hash AS fic, cb.commit_hash AS bic, w.fic_idx, w.bic_idx
  FROM h_w2 w JOIN h_commits cf ON cf.repo = w.repo AND cf.idx = w.fic_idx
              JOIN h_commits cb ON cb.repo = w.repo AND cb.idx = w.bic_idx"""),
    # Per file lineage, walk rename and fix events newest first; the row carries the rename map and
    # the list of intervals (first match by path decides).
    ("w1_fix", """
  SELECT e.repo, e.p, e.idx, o.bic_idx FROM h_fixev e
           JOIN h_oldest o ON o.repo = e.repo AND o.commit_hash = e.commit_hash AND o.pos = e.p"""),
    ("w1_range", """
  SELECT repo, min(idx) AS lo, max(idx) AS hi FROM h_fix GROUP BY repo"""),
    ("w1_ev", """
  SELECT f.repo, f.p, f.idx, f.change_type, f.old_path, f.new_path, x.bic_idx,
         row_number() OVER (PARTITION BY f.repo, f.p ORDER BY f.idx DESC) AS rn
  FROM h_files f JOIN w1_range r ON r.repo = f.repo
  LEFT JOIN w1_fix x ON x.repo = f.repo AND x.p = f.p AND x.idx = f.idx
  WHERE f.idx BETWEEN r.lo AND r.hi AND (f.change_type = 'RENAME' OR x.bic_idx IS NOT NULL)"""),
    ("w1_walk(repo, p, rn, renamed, fixed)", """
  SELECT DISTINCT repo, p, CAST(0 AS BIGINT), MAP {}::MAP(VARCHAR, VARCHAR),
         []::STRUCT(fp VARCHAR, fic BIGINT, bic BIGINT)[]
  FROM w1_ev
  UNION ALL
  SELECT repo, p, rn,
         CASE WHEN bic IS NOT NULL AND j IS NOT NULL AND fic < ex_bic
              THEN map_from_entries(list_filter(map_entries(r1), lambda x: x.key <> new_path)) ELSE r1 END,
         CASE WHEN bic IS NULL THEN fixed
              WHEN j IS NULL THEN list_append(fixed, {'fp': fp, 'fic': fic, 'bic': bic})
              WHEN fic < ex_bic THEN list_append(fixed, {'fp': new_path, 'fic': fic, 'bic': bic})
              WHEN bic < ex_bic THEN list_transform(fixed, lambda x, i: CASE WHEN i = j
                                                     THEN {'fp': x.fp, 'fic': x.fic, 'bic': bic} ELSE x END)
              ELSE fixed END
  FROM (SELECT *, fixed[j].bic AS ex_bic
        FROM (SELECT *, list_position(list_transform(fixed, lambda x: x.fp), fp) AS j
              FROM (SELECT *, coalesce(r1[new_path], new_path) AS fp
                    FROM (SELECT w.repo, w.p, e.rn, e.idx AS fic, e.new_path, e.bic_idx AS bic, w.fixed,
                                 CASE WHEN e.change_type = 'RENAME'
                                      THEN map_concat(w.renamed, map([e.old_path], [coalesce(w.renamed[e.new_path], e.new_path)]))
                                      ELSE w.renamed END AS r1
                          FROM w1_walk w JOIN w1_ev e ON e.repo = w.repo AND e.p = w.p AND e.rn = w.rn + 1))))"""),
    ("w1_out", """
  SELECT repo, unnest(fixed) AS f FROM (SELECT repo, p, arg_max(fixed, rn) AS fixed FROM w1_walk GROUP BY repo, p)"""),
    ("h_named_fixed", """
  SELECT x.repo, x.f.fp AS filepath, cf.commit_hash AS fic, cb.commit_hash AS bic,
       CAST(x.f.fic AS BIGINT) AS fic_idx, CAST(x.f.bic AS BIGINT) AS bic_idx
FROM w1_out x JOIN h_commits cf ON cf.repo = x.repo AND cf.idx = x.f.fic
              JOIN h_commits cb ON cb.repo = x.repo AND cb.idx = x.f.bic"""),
    ("h_prone", """
  SELECT f.repo, f.filepath, c.commit_hash AS commit, f.fic AS fixing_commit, c.idx
  FROM h_named_fixed f JOIN h_commits c ON c.repo = f.repo AND c.idx >= f.bic_idx AND c.idx < f.fic_idx"""),
    ("h_ren", """
  SELECT f.repo, f.new_path, f.idx AS r_idx, f.old_path
  FROM h_files f JOIN (SELECT repo, max(idx) AS hi FROM h_fix GROUP BY repo) l ON l.repo = f.repo
  WHERE f.change_type = 'RENAME' AND f.idx <= l.hi"""),
    ("h_prone_named", """
  SELECT p.repo, coalesce(arg_min(r.old_path, r.r_idx), p.filepath) AS filepath, p.commit, p.fixing_commit
  FROM h_prone p LEFT JOIN h_ren r ON r.repo = p.repo AND r.new_path = p.filepath AND r.r_idx > p.idx
  GROUP BY p.repo, p.filepath, p.commit, p.fixing_commit"""),
    ("h_cps", """
  SELECT repo, commit_hash, idx AS cp_idx, CAST(row_number() OVER (PARTITION BY repo ORDER BY idx) - 1 AS BIGINT) AS rel_no
  FROM h_commits WHERE idx % 25 = 24"""),
    ("h_states", """
  SELECT repo, path, idx, arg_max(alive, pos) AS alive, arg_max_null(content, pos) AS content,
         arg_max(life, pos) AS life
  FROM (SELECT repo, new_path AS path, idx, p AS pos, true AS alive, content, life FROM h_files WHERE change_type <> 'DELETE'
        UNION ALL
        SELECT repo, old_path, idx, p, false, NULL, life FROM h_files
        WHERE change_type = 'DELETE' OR (change_type = 'RENAME' AND old_path <> new_path))
  WHERE path IS NOT NULL GROUP BY repo, path, idx"""),
    ("h_snap", """
  SELECT c.repo, c.rel_no, c.commit_hash AS commit, s.path, arg_max(s.alive, s.idx) AS alive,
         arg_max_null(s.content, s.idx) AS content, arg_max(s.life, s.idx) AS life, max(s.idx) AS state_idx
  FROM h_cps c JOIN h_states s ON s.repo = c.repo AND s.idx <= c.cp_idx
  GROUP BY c.repo, c.rel_no, c.commit_hash, s.path"""),
    # Names along all renames: from the commit where the fixed file has its name, back from rename to rename.
    ("c_ren", """
  SELECT repo, idx, old_path, new_path FROM h_files WHERE change_type = 'RENAME' AND old_path <> new_path"""),
    ("c_birth", """
  SELECT repo, new_path AS path, idx, true AS renamed FROM c_ren
  UNION ALL SELECT repo, new_path, idx, false FROM h_files WHERE change_type = 'ADD'"""),
    ("c_pred", """
  SELECT r.repo, r.idx, r.old_path, CASE WHEN arg_max(b.renamed, b.idx) THEN max(b.idx) END AS since
  FROM c_ren r LEFT JOIN c_birth b ON b.repo = r.repo AND b.path = r.old_path AND b.idx < r.idx
  GROUP BY r.repo, r.idx, r.old_path"""),
    ("c_held", """
  SELECT f.repo, f.filepath, f.fic, f.fic_idx, f.bic_idx,
         CASE WHEN arg_max(s.alive, s.idx) FILTER (WHERE s.idx <= f.fic_idx) THEN f.fic_idx
              ELSE min(s.idx) FILTER (WHERE s.alive AND s.idx > f.fic_idx) END AS bound
  FROM h_named_fixed f LEFT JOIN h_states s ON s.repo = f.repo AND s.path = f.filepath
  GROUP BY f.repo, f.filepath, f.fic, f.fic_idx, f.bic_idx"""),
    ("c_start", """
  SELECT h.repo, h.filepath, h.fic, h.fic_idx, h.bic_idx, h.bound, CASE WHEN arg_max(b.renamed, b.idx) THEN max(b.idx) END AS since
  FROM c_held h LEFT JOIN c_birth b ON b.repo = h.repo AND b.path = h.filepath AND b.idx <= h.bound
  GROUP BY h.repo, h.filepath, h.fic, h.fic_idx, h.bic_idx, h.bound"""),
    ("c_walk(repo, fic, fic_idx, bic_idx, path, name, since, until)", """
  SELECT repo, fic, fic_idx, bic_idx, filepath, filepath, since, bound + 1 FROM c_start
  UNION ALL
  SELECT w.repo, w.fic, w.fic_idx, w.bic_idx, r.old_path, r.old_path, p.since, w.since
  FROM c_walk w JOIN c_ren r ON r.repo = w.repo AND r.idx = w.since AND r.new_path = w.name
  JOIN c_pred p ON p.repo = r.repo AND p.idx = r.idx AND p.old_path = r.old_path"""),
    ("h_alive", """
  SELECT * FROM h_snap WHERE alive AND NOT contains(regexp_extract(path, '^(.*)/', 1), '.git')"""),
    ("h_win", """
  SELECT repo, rel_no, coalesce(lag(cp_idx) OVER (PARTITION BY repo ORDER BY rel_no), cp_idx) AS lo, cp_idx AS hi
  FROM h_cps"""),
    ("h_wev", """
  SELECT w.repo, w.rel_no, f.commit_hash, f.idx, f.p, f.change_type, coalesce(f.new_path, f.old_path) AS path,
         f.additions, f.deletions, f.hunks, f.life, c.author
  FROM h_win w JOIN h_files f ON f.repo = w.repo AND f.idx BETWEEN w.lo AND w.hi
  JOIN h_commits c ON c.repo = f.repo AND c.commit_hash = f.commit_hash"""),
    ("h_pc", """
  SELECT repo, rel_no, life, commit_hash, any_value(author) AS author, sum(additions) AS adds,
         sum(deletions) AS dels, sum(hunks) AS hunks,
         sum(CASE WHEN change_type <> 'ADD' THEN additions - deletions END) AS churn,
         arg_max(path, idx * 1000 + p) AS path, max(idx * 1000 + p) AS at_key
  FROM h_wev GROUP BY repo, rel_no, life, commit_hash"""),
    ("h_pf", """
  SELECT repo, rel_no, life, arg_max(path, at_key) AS filepath,
         CAST(coalesce(sum(churn), 0) AS BIGINT) AS code_churn_count,
         CAST(coalesce(max(churn), 0) AS BIGINT) AS code_churn_max,
         coalesce(avg(churn), 0.0) AS code_churn_avg, CAST(count(*) AS BIGINT) AS commits_count,
         CAST(count(DISTINCT author) AS BIGINT) AS contributors_count, CAST(median(hunks) AS DOUBLE) AS hunks_median,
         CAST(sum(adds) AS BIGINT) AS additions, CAST(max(adds) AS BIGINT) AS additions_max, avg(adds) AS additions_avg,
         CAST(sum(dels) AS BIGINT) AS deletions, CAST(max(dels) AS BIGINT) AS deletions_max, avg(dels) AS deletions_avg
  FROM h_pc GROUP BY repo, rel_no, life"""),
    ("h_pe", """
  SELECT repo, rel_no, life, CAST(count(*) FILTER (WHERE share < 0.05) AS BIGINT) AS minor_contributors_count,
         coalesce(max(share), 0.0) * 100 AS highest_contributor_experience
  FROM (SELECT *, CASE WHEN sum(lines) OVER g > 0 THEN lines / sum(lines) OVER g END AS share
        FROM (SELECT repo, rel_no, life, author, sum(adds + dels) AS lines FROM h_pc GROUP BY repo, rel_no, life, author)
        WINDOW g AS (PARTITION BY repo, rel_no, life))
  GROUP BY repo, rel_no, life"""),
    ("h_pcs", """
  SELECT repo, rel_no, CAST(max(n) AS BIGINT) AS change_set_max, avg(n) AS change_set_avg
  FROM (SELECT repo, rel_no, commit_hash, count(*) AS n FROM h_wev GROUP BY repo, rel_no, commit_hash)
  GROUP BY repo, rel_no"""),
    ("h_proc", """
  SELECT f.*, e.minor_contributors_count, e.highest_contributor_experience, c.change_set_max, c.change_set_avg
  FROM h_pf f JOIN h_pe e USING (repo, rel_no, life) JOIN h_pcs c USING (repo, rel_no)"""),
]


def _with(**instead: str) -> str:
    """The history's common tables; ``instead`` replaces some of them by name."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({instead.get(name, body)}\n)" for name, body in _CTES) + "\n"


_WITH = _with()
# The same tables with every document as a commit message of its own.
_TEXTS = """SELECT repo, commit_hash, idx, committed_at, msg FROM h_commits
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), NULL, NULL, text FROM documents"""
_WITH_TEXTS = _with(h_msg=f"""
  SELECT repo, commit_hash, idx, committed_at, list_transform({_sentences('msg')}, lambda s: lower(array_to_string({_tokens('s')}, ' '))) AS st
  FROM ({_TEXTS})""").rstrip() + f",\nh_texts AS ({_TEXTS})\n"
# The same tables with a checkpoint at every commit, and with the fixes of the TOSCA profile.
_WITH_COMMITS = _with(h_cps="SELECT repo, commit_hash, idx AS cp_idx, idx AS rel_no FROM h_commits")
_WITH_TOSCA = _with(h_fix=dict(_CTES)["h_fix_tosca"], h_fixev=f"""
  SELECT f.* FROM h_files f JOIN h_fix x ON x.repo = f.repo AND x.commit_hash = f.commit_hash
  WHERE f.change_type IN ('MODIFY', 'RENAME') AND {_is_tosca('f.new_path', 'f.content')}""")


def _big(c: str, alias: str | None = None) -> str:
    return f"CAST({c} AS BIGINT) AS {alias or c.split('.')[-1]}"


def _r6(c: str, alias: str | None = None) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) AS {alias or c.split('.')[-1]}"


def _lines_code(c: str) -> str:
    return (f"CAST(len(list_filter(string_split(coalesce({c}, ''), chr(10)), lambda l: "
            f"regexp_replace(l, '[ \\t\\r\\f]+', '', 'g') <> '' AND NOT regexp_matches(l, '^[ \\t\\r\\f]*#'))) AS BIGINT)")


def _lines_blank(c: str) -> str:
    return (f"CAST(len(list_filter(string_split(coalesce({c}, ''), chr(10)), lambda l: "
            f"regexp_replace(l, '[ \\t\\r\\f]+', '', 'g') = '')) AS BIGINT)")


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


def _entropy_sql(rel: str, keys: list[str], c: str) -> str:
    """``keys, text_entropy`` for every row of ``rel`` (0 when there is no token)."""
    k = ", ".join(keys)
    return f"""
  SELECT {k}, coalesce(e.h, 0.0) AS text_entropy FROM (SELECT DISTINCT {k} FROM {rel}) d
  LEFT JOIN (SELECT {k}, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h
             FROM (SELECT {k}, t, count(*) AS n FROM (SELECT {k}, unnest({_words(c)}) AS t FROM {rel})
                   GROUP BY {k}, t) GROUP BY {k}) e USING ({k})"""


def _product_rel(kind: str) -> str:
    """Non-deleted versions of Ansible / TOSCA files with their metrics (generator-derived structure)."""
    ok = _parsable("content")
    keep = _is_ansible("new_path") if kind == "ansible" else _is_tosca("new_path", "content")
    more = "additions % 5"
    if kind == "ansible":
        counts = {
            "num_conditions": f"[1, 2, 2, 4, 4][{more} + 1]", "num_keys": f"[4, 9, 13, 18, 22][{more} + 1] + hunks % 3",
            "num_distinct_modules": f"least(1 + {more}, 3) + CASE WHEN {more} = 4 AND (slot <> 0 OR additions % 3 <> 0) THEN 1 ELSE 0 END",
            "num_parameters": f"[1, 3, 3, 5, 7][{more} + 1]",
            "num_tasks": f"1 + {more}", "num_unique_names": f"[1, 2, 3, 3, 4][{more} + 1]"}
    else:
        base = {"imports": 1, "node_templates": 1, "properties": 2}
        counts = {f"num_{k}": f"{base.get(k, 0)} + {v}" for k, v in _TOSCA_MORE.items()}
        counts["num_shell_scripts"] = "1 + slot % 3"
        counts["num_suspicious_comments"] = "CASE WHEN slot = 0 THEN 1 ELSE 0 END + additions % 2"
        counts["num_keys"] = "9 + hunks % 2 + " + " + ".join(
            [_TOSCA_MORE["properties"], f"2 * ({_TOSCA_MORE['node_templates']})"]
            + [f"{v} + CASE WHEN {v} > 0 THEN 1 ELSE 0 END" for k, v in _TOSCA_MORE.items()
               if k not in ("imports", "properties", "node_templates")])
    struct = ", ".join(f"CASE WHEN {ok} THEN CAST({v} AS BIGINT) END AS {n}" for n, v in counts.items())
    if kind == "ansible":
        struct += (f", CASE WHEN {ok} THEN CAST({_lines_code('content')} AS DOUBLE) / greatest(1, hunks % 3) END "
                   f"AS avg_play_size")
    return f"""(SELECT repo, commit_hash, idx, p AS pos, new_path, content,
       CASE WHEN {ok} THEN {_lines_code('content')} END AS lines_code,
       CASE WHEN {ok} THEN {_lines_blank('content')} END AS lines_blank,
       CASE WHEN {ok} THEN CAST(len({_words('content')}) AS BIGINT) END AS num_tokens, {ok} AS ok, {struct}
     FROM h_files WHERE change_type <> 'DELETE' AND {keep})"""


def _product_sql(kind: str) -> str:
    names = _ANS if kind == "ansible" else _TOS
    cols = ", ".join(_m(n, "m.") if n != "text_entropy" else "CASE WHEN m.ok THEN e.text_entropy END AS text_entropy"
                     for n in names)
    ent = _entropy_sql("pv", ["repo", "commit_hash", "pos"], "content")
    return (_WITH.rstrip() + f",\npv AS {_product_rel(kind)},\nent AS ({ent})\n"
            f"SELECT m.repo, m.commit_hash, CAST(m.pos AS BIGINT) AS pos, {cols} "
            f"FROM pv m JOIN ent e USING (repo, commit_hash, pos)")


def _entries(*rows: tuple) -> str:
    """Nodes (depth, key or None for a list entry, SQL of the value)."""
    return "[" + ", ".join(f"{{'d': {d}, 'k': {k if k else 'NULL::VARCHAR'}, 'v': {v}}}" for d, k, v in rows) + "]"


def _more_nodes(n: str, at_least: int, *rows: tuple) -> str:
    return f"CASE WHEN {n} > {at_least} THEN {_entries(*rows)} ELSE [] END"


# Every node of a generated Ansible document in reading order.
_ITEM = (0, None, "''")
_ANSIBLE_NODES = " || ".join([
    _entries(_ITEM, (1, "'name'", f"'t' || {_s('slot')}"), (1, _module("slot"), "''"), (2, "'src'", f"'f' || {_s('additions')}"),
             (1, "'when'", f"'a == ' || {_s('hunks')}")),
    _more_nodes("additions % 5", 0, _ITEM, (1, "'name'", "'e1'"), (1, "'command'", "''"), (2, "'cmd'", "'c1'"), (2, "'chdir'", "'d'"),
                (1, "'when'", "'b1'")),
    _more_nodes("additions % 5", 1, _ITEM, (1, "'name'", "'e2'"), (1, "'shell'", f"'a: b' || {NL} || '- x: y'"), (1, "'args'", "''"),
                (2, "'chdir'", "'d'")),
    _more_nodes("additions % 5", 2, _ITEM, (1, "'name'", "'e1'"), (1, "'command'", "''"), (2, "'cmd'", "'c3'"), (2, "'chdir'", "'d'"),
                (1, "'when'", "'b3 < 1 and b4 >= 2'")),
    _more_nodes("additions % 5", 3, _ITEM, (1, "'name'", "'e4'"), (1, "'copy'", "''"), (2, "'src'", "'a'"), (2, "'dest'", "''"),
                (3, None, "'b'"), (3, None, "'c'")),
    _more_nodes("hunks % 3", 0, _ITEM, (1, "'hosts'", "'w1'")), _more_nodes("hunks % 3", 1, _ITEM, (1, "'hosts'", "'w2'"))])


def _sel(body: str) -> str:
    return _WITH + body


_PROC_GROUPS = _q.PROC_GROUPS
_DOUBLE = _q.DOUBLE_METRICS


def _m(c: str, prefix: str = "") -> str:
    return _r6(prefix + c, c) if c in _DOUBLE else _big(prefix + c, c)


def _dataset_rel(kind: str = "ansible") -> str:
    """Dataset rows of a profile: files at a checkpoint with the metrics of the version they show."""
    names = [n for n in (_ANS if kind == "ansible" else _TOS) if n != "text_entropy"]
    ent = _entropy_sql("pv", ["repo", "commit_hash", "pos"], "content")
    return f"""pv AS {_product_rel(kind)},
ds_ent AS ({ent}),
ds AS (SELECT a.repo, a.rel_no, a.path AS filepath, a.commit, a.life, {", ".join("pv." + n for n in names)},
              CASE WHEN pv.ok THEN e.text_entropy END AS text_entropy
       FROM h_alive a JOIN pv ON pv.repo = a.repo AND pv.idx = a.state_idx AND pv.new_path = a.path
       JOIN ds_ent e ON e.repo = pv.repo AND e.commit_hash = pv.commit_hash AND e.pos = pv.pos
       WHERE length(a.content) > 0)"""


def _delta_sql() -> str:
    """Deltas to the previous checkpoint of the same life of the file."""
    prev = ", ".join(f"lag({m}) OVER w AS p_{m}" for m in _ANS)
    deltas = ", ".join(f"round(round(coalesce(CAST({m} AS DOUBLE), 0.0) - CAST(p_{m} AS DOUBLE), 3), 6) "
                       f"AS delta_{m}" for m in _ANS)
    return (_WITH.rstrip() + ",\n" + _dataset_rel() +
            f"\nSELECT repo, CAST(rel_no AS BIGINT) AS rel_no, filepath, {deltas} "
            f"FROM (SELECT ds.*, {prev} FROM ds WINDOW w AS (PARTITION BY repo, life ORDER BY rel_no))")


def _dataset_sql(tables: str = _WITH, kind: str = "ansible", delta: bool = False) -> str:
    """Ids, label, process and product metrics (and the deltas of both) of every dataset row."""
    names = _ANS if kind == "ansible" else _TOS
    by_file = [c for c in _q.PROCESS_METRICS if c not in ("change_set_max", "change_set_avg")]
    of = {c: f"coalesce(p.{c}, 0)" for c in by_file} | {c: f"d.{c}" for c in names}
    of |= {c: f"coalesce(pe.{c}, 0)" for c in ("minor_contributors_count", "highest_contributor_experience")}
    of = {c: f"coalesce(s.{c}, 0)" for c in ("change_set_max", "change_set_avg")} | of
    rows = f"""full_rows AS (
SELECT d.repo, d.rel_no, d.life, d.filepath, d.commit, CAST(c.committed_at AS VARCHAR) AS committed_at,
       CAST(CASE WHEN fp.filepath IS NULL THEN 0 ELSE 1 END AS BIGINT) AS failure_prone,
       {", ".join(f"{v} AS {c}" for c, v in of.items())}
FROM ds d
JOIN h_commits c ON c.repo = d.repo AND c.commit_hash = d.commit
LEFT JOIN (SELECT DISTINCT repo, filepath, commit FROM h_prone_named) fp
       ON fp.repo = d.repo AND fp.filepath = d.filepath AND fp.commit = d.commit
LEFT JOIN h_pf p ON p.repo = d.repo AND p.rel_no = d.rel_no AND p.life = d.life
LEFT JOIN h_pe pe ON pe.repo = d.repo AND pe.rel_no = d.rel_no AND pe.life = d.life
LEFT JOIN h_pcs s ON s.repo = d.repo AND s.rel_no = d.rel_no)"""
    cols = [_m(c) for c in of]
    if delta:
        cols += [f"round(round(coalesce(CAST({c} AS DOUBLE), 0.0) - CAST(lag({c}) OVER w AS DOUBLE), 3), 6) AS delta_{c}"
                 for c in of]
    window = " WINDOW w AS (PARTITION BY repo, life ORDER BY rel_no)" if delta else ""
    return (tables.rstrip() + ",\n" + _dataset_rel(kind) + ",\n" + rows +
            f"\nSELECT repo, filepath, commit, committed_at, failure_prone, {', '.join(cols)} FROM full_rows{window}")


def _locator_sql() -> str:
    rest = "regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1)"
    loc = (f"CASE WHEN regexp_matches(url, '\\.example\\.com') THEN 'https://github.com' || {rest} "
           f"WHEN regexp_matches(url, '\\.example\\.net') THEN 'https://gitlab.com' || {rest} || '.git' "
           f"ELSE 'git@bitbucket.com:' || {rest} END")
    bare = "regexp_replace(locator, '\\.git$', '')"
    rx = "(github|gitlab)\\.com/([^/]+)/([^/]+)"
    return f"""SELECT page_id, locator, (starts_with(locator, 'git@') OR starts_with(locator, 'https://')) AS is_remote,
       regexp_matches({bare}, '{rx}') AS is_valid, regexp_extract({bare}, '{rx}', 2) AS owner,
       regexp_extract({bare}, '{rx}', 3) AS name
FROM (SELECT CAST(page_id AS BIGINT) AS page_id, {loc} AS locator FROM pages)"""


def _focus_sql() -> str:
    """Labels where a sentence has a defect word and its first or last word has a word of the category."""
    ends = "(string_split(s, ' ')[1] || ' ' || string_split(s, ' ')[-1])"
    hit = lambda n: (f"coalesce(list_bool_or(list_transform(st, lambda s: regexp_matches(s, '{_rx('defect')}') "  # noqa: E731
                     f"AND regexp_matches({ends}, '{_rx(*_LABEL_RULES[n])}'))), false)")
    return _WITH_TEXTS + ("SELECT repo, commit_hash, concat_ws(',', " + ", ".join(f"CASE WHEN {hit(n)} THEN '{n}' END" for n in _LABELS)
                          + ") AS labels FROM h_msg")


def _sentence_sql() -> str:
    st = f"list_transform({_sentences('text')}, lambda s: array_to_string({_tokens('s')}, ' '))"
    return f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len({_sentences('text')}) AS BIGINT) AS n_sentences,
       CAST(list_sum(list_transform({_sentences('text')}, lambda s: len({_tokens('s')}))) AS BIGINT) AS n_tokens,
       array_to_string({st}, '|') AS norm
FROM documents"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {
        "commit_order": _sel("SELECT repo, commit_hash, idx FROM h_commits"),
        "branch_scan": _sel("SELECT repo, commit_hash, idx FROM h_commits WHERE branch = 'F'"),
        "range_scan": _sel("SELECT repo, commit_hash, idx FROM h_commits WHERE idx BETWEEN 120 AND 250"),
        "point_scan": _sel("SELECT repo, commit_hash, idx, CAST(committed_at AS VARCHAR) AS committed_at "
                           "FROM h_commits WHERE idx % 25 = 24"),
        "release_checkpoints": _sel("SELECT repo, commit_hash, cp_idx AS idx, rel_no, "
                                    "CAST(lag(cp_idx) OVER (PARTITION BY repo ORDER BY rel_no) AS BIGINT) AS prev_idx FROM h_cps"),
        "commit_checkpoints": _sel("SELECT repo, commit_hash, idx, idx AS rel_no FROM h_commits"),
        "file_events": _sel("SELECT repo, commit_hash, idx, CAST(p AS BIGINT) AS pos, change_type, old_path, new_path, "
                            "CAST(additions AS BIGINT) AS additions, CAST(deletions AS BIGINT) AS deletions, "
                            "CAST(hunks AS BIGINT) AS hunks FROM h_files WHERE change_type IN ('MODIFY', 'RENAME')"),
        "diff_scan": _sel("SELECT repo, commit_hash, CAST(pos AS BIGINT) AS pos, path, side, "
                          "CAST(line_no AS BIGINT) AS line_no, text FROM h_diff"),
        "repo_locator": _locator_sql(),
        "ansible_filter": _sel(f"SELECT repo, path, {_is_ansible('path')} AS is_ansible, "
                               f"{_is_tosca('path', None)} AS is_tosca_path FROM (SELECT DISTINCT repo, path FROM "
                               f"(SELECT repo, old_path AS path FROM h_files UNION ALL SELECT repo, new_path FROM h_files) "
                               f"WHERE path IS NOT NULL)"),
        "tosca_filter": _sel(f"SELECT repo, commit_hash, CAST(p AS BIGINT) AS pos, {_is_tosca('new_path', 'content')} "
                             f"AS is_tosca FROM h_files WHERE change_type <> 'DELETE'"),
        "profile_ignore": _sel(f"SELECT repo, commit_hash, CAST(p AS BIGINT) AS pos, true AS keep_base, "
                               f"{_is_ansible('new_path')} AS keep_ansible, {_is_tosca('new_path', 'content')} AS keep_tosca "
                               f"FROM h_files WHERE change_type <> 'DELETE'"),
    }
    for rule in _RULES:
        o[f"rule_{rule}"] = _WITH_TEXTS + (f"SELECT repo, commit_hash, coalesce(regexp_matches(lower(msg), '{_rx(rule)}'), false) AS hit "
                                           f"FROM h_texts")
    o["sentence_tokens"] = _sentence_sql()
    for label in _LABELS:
        o[f"fix_{label.lower()}"] = _WITH_TEXTS + f"SELECT repo, commit_hash, {_flag(label, False)} AS hit FROM h_lab"
    o["fix_focus"] = _focus_sql()
    o.update({
        "fixing_commits": _sel("SELECT repo, commit_hash, idx, labels FROM h_fix"),
        "fixing_commits_tosca": _sel("SELECT repo, commit_hash, idx, labels FROM h_fix_tosca"),
        "resume_known": _sel("SELECT repo, commit_hash, idx, committed_at >= TIMESTAMP '1998-01-01' AS is_new FROM h_fix"),
        "sort_commits": _sel("SELECT repo, commit_hash, idx FROM h_fix"),
        "comment_changed": _sel("SELECT repo, commit_hash FROM h_comment"),
        "data_changed": _sel("SELECT repo, commit_hash, data_changed AS changed FROM h_sig"),
        "include_changed": _sel("SELECT repo, commit_hash, include_changed AS changed FROM h_sig"),
        "service_changed": _sel("SELECT repo, commit_hash, service_changed AS changed FROM h_sig"),
        "yaml_entries": _sel(f"""SELECT repo, commit_hash, pos, CAST(n.o AS BIGINT) AS ord, CAST(n.d AS BIGINT) AS depth, n.k AS key, n.v AS val
FROM (SELECT repo, commit_hash, CAST(p AS BIGINT) AS pos,
             unnest(list_transform({_ANSIBLE_NODES}, lambda n, i: {{'o': i - 1, 'd': n.d, 'k': n.k, 'v': n.v}})) AS n
      FROM h_files WHERE change_type <> 'DELETE' AND {_is_ansible('new_path')} AND {_parsable('content')})
WHERE n.k IS NOT NULL"""),
        "szz_blame": _sel("SELECT repo, commit_hash, CAST(pos AS BIGINT) AS pos, CAST(line_no AS BIGINT) AS line_no, "
                          "CAST(prev_idx AS BIGINT) AS prev_idx FROM h_blame"),
        "szz_lines": _sel("SELECT repo, commit_hash, CAST(pos AS BIGINT) AS pos, CAST(line_no AS BIGINT) AS line_no, "
                          "CAST(prev_idx AS BIGINT) AS prev_idx FROM h_lines"),
        "szz_oldest": _sel("SELECT o.repo, o.commit_hash, CAST(o.pos AS BIGINT) AS pos, c.commit_hash AS bic, "
                           "CAST(o.bic_idx AS BIGINT) AS bic_idx FROM h_oldest o "
                           "JOIN h_commits c ON c.repo = o.repo AND c.idx = o.bic_idx"),
        "lineage": _sel("SELECT DISTINCT repo, path, lineage FROM (SELECT repo, new_path AS path, lineage FROM h_files "
                        "UNION ALL SELECT repo, old_path, lineage FROM h_files) WHERE path IS NOT NULL"),
        "file_lives": _sel("SELECT repo, commit_hash, CAST(p AS BIGINT) AS pos, coalesce(new_path, old_path) AS path, life "
                           "FROM h_files"),
        "fixed_files": _sel("SELECT repo, filepath, fic, bic, CAST(fic_idx AS BIGINT) AS fic_idx, "
                            "CAST(bic_idx AS BIGINT) AS bic_idx FROM h_fixed"),
        "fixed_files_renamed": _sel("SELECT repo, filepath, fic, bic, fic_idx, bic_idx FROM h_named_fixed"),
        "failure_prone": _sel("SELECT repo, filepath, commit, fixing_commit FROM h_prone"),
        "failure_prone_named": _sel("SELECT repo, filepath, commit, fixing_commit FROM h_prone_named"),
        "failure_prone_chain": _sel("SELECT w.repo, w.name AS filepath, c.commit_hash AS commit, w.fic AS fixing_commit FROM c_walk w "
                                    "JOIN h_commits c ON c.repo = w.repo AND c.idx >= w.bic_idx AND c.idx < w.fic_idx "
                                    "AND c.idx >= coalesce(w.since, -1) AND c.idx < w.until"),
        "label_flag": _sel("SELECT a.repo, a.rel_no, a.path AS filepath, CAST(CASE WHEN fp.filepath IS NULL THEN 0 ELSE 1 END "
                           "AS BIGINT) AS failure_prone FROM h_alive a LEFT JOIN (SELECT DISTINCT repo, filepath, commit "
                           "FROM h_prone_named) fp ON fp.repo = a.repo AND fp.filepath = a.path AND fp.commit = a.commit"),
        "snapshot": _sel("SELECT repo, rel_no, path FROM h_alive"),
    })
    for name, cols in _PROC_GROUPS.items():
        o[name] = _sel("SELECT repo, rel_no, life, filepath, " + ", ".join(_m(c) for c in cols) + " FROM h_proc")
    bad = "(doc_id % 11 <> 5 AND (doc_id % 7 = 3 OR doc_id % 13 = 4))"
    body = "CASE WHEN doc_id % 11 = 5 THEN '' ELSE coalesce(text, '') END"
    o["content_scan"] = f"""SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CAST(strlen({body}) + CASE WHEN {bad} THEN 1 ELSE 0 END AS BIGINT) AS n_bytes, NOT {bad} AS is_text,
       CASE WHEN NOT {bad} THEN CAST(length({body}) AS BIGINT) END AS n_chars, CASE WHEN NOT {bad} THEN md5({body}) END AS content_md5
FROM documents"""
    o.update({
        "valid_content": "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(text) AS BIGINT) AS n_chars "
                         "FROM documents WHERE text IS NOT NULL AND length(text) > 0",
        "prod_lines": f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {_lines_code('text')} AS lines_code, "
                      f"{_lines_blank('text')} AS lines_blank FROM documents",
        "prod_tokens": f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len({_words('text')}) AS BIGINT) AS num_tokens "
                       f"FROM documents",
        "prod_entropy": "WITH " + "ent AS (" + _entropy_sql("documents", ["doc_id"], "text") + ")\n"
                        "SELECT CAST(doc_id AS BIGINT) AS doc_id, round(text_entropy, 6) AS text_entropy FROM ent",
        "prod_ansible": _product_sql("ansible"),
        "prod_tosca": _product_sql("tosca"),
        "delta_metrics": _delta_sql(),
        "metrics_dataset": _dataset_sql(),
        "dataset_process_delta": _dataset_sql(delta=True),
        "dataset_commit_mode": _dataset_sql(_WITH_COMMITS),
        "dataset_tosca": _dataset_sql(_WITH_TOSCA, "tosca"),
        "prone_json_codec": _sel("""SELECT filepath, commit, fixing_commit, '{"filepath":"' || filepath || '","commit":"' || commit
       || '","fixing_commit":"' || fixing_commit || '"}' AS json FROM h_prone_named"""),
        "json_roundtrip": _sel("SELECT repo, filepath, fic, bic FROM h_named_fixed"),
        "csv_sink": _sel("SELECT repo, filepath, commit, fixing_commit FROM h_prone_named"),
    })
    if extra := _training_data():
        o |= extra[0].ORACLE_SQL
        if extra[1].ORACLE_SQL:
            o["pipeline"] = extra[1].ORACLE_SQL
    return o
