"""Product metrics M1-M21 of a text / YAML document column.

Our definitions (the original delegates to metric libraries).  Line and token metrics work on any
text; key/structure metrics use the YAML nodes of ``functions.yaml`` and are NULL -- all of them,
as in the original -- when the document does not parse.  For file versions every metric
is a row-local array expression (no shuffle); for long free text the entropy counts tokens with
an explode + partial aggregation instead.

* lines_code: lines that are neither blank nor a ``#`` comment; lines_blank: blank lines
  (lines = the text split on ``\\n``, so a final newline yields one blank line);
* num_tokens: whitespace-separated tokens; text_entropy: Shannon entropy (bits) of their counts;
* num_keys: mapping keys that carry a value (inline or nested);
* Ansible: a *module key* is a key of a list item that is not a task keyword; num_tasks = list
  items with a module key, num_distinct_modules, num_parameters = children of module keys,
  num_conditions = comparison operators in ``when`` values (at least 1 each),
  num_unique_names = distinct ``name`` values of list items, avg_play_size = lines_code /
  max(1, plays) where a play is a top-level list item with ``hosts``;
* TOSCA: num_<x> = children of ``<x>`` keys (imports, inputs, interfaces, node_templates,
  node_types, parameters, properties, relationship_templates, relationship_types),
  num_shell_scripts = values ending ``.sh``, num_suspicious_comments = comment lines with
  TODO / FIXME / HACK / XXX / BUG.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.functions.modules import sql_in_list
from faultline.functions.yaml import yaml_nodes

# --- our task keywords: keys of a task that are not its module ---
TASK_KEYWORDS = ["name", "when", "loop", "loop_control", "register", "tags", "become", "become_user",
                 "become_method", "vars", "notify", "ignore_errors", "changed_when", "failed_when", "until",
                 "retries", "delay", "args", "environment", "no_log", "delegate_to", "run_once", "block",
                 "rescue", "always", "listen", "check_mode", "any_errors_fatal", "hosts", "roles", "tasks",
                 "handlers", "pre_tasks", "post_tasks", "gather_facts", "remote_user", "connection",
                 "local_action", "async", "poll", "throttle", "debugger", "diff", "collections", "module_defaults"]
TOSCA_SECTIONS = ["imports", "inputs", "interfaces", "node_templates", "node_types", "parameters", "properties",
                  "relationship_templates", "relationship_types"]
SUSPICIOUS = r"TODO|FIXME|HACK|XXX|BUG"
COMPARISON = r"==|!=|<=|>=|<|>"

ANSIBLE_METRICS = ["lines_code", "lines_blank", "num_conditions", "num_keys", "num_tokens", "text_entropy",
                   "avg_play_size", "num_distinct_modules", "num_parameters", "num_tasks", "num_unique_names"]
TOSCA_METRICS = ["lines_code", "lines_blank", "num_keys", "num_suspicious_comments", "num_tokens", "text_entropy",
                 "num_imports", "num_inputs", "num_interfaces", "num_node_templates", "num_node_types",
                 "num_parameters", "num_properties", "num_relationship_templates", "num_relationship_types",
                 "num_shell_scripts"]
TEXT_METRICS = ["lines_code", "lines_blank", "num_tokens", "text_entropy"]


def _lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n")


def _blank(l: Column) -> Column:
    return F.regexp_replace(l, r"[ \t\r\f]+", "") == ""


def lines_code(c: Column) -> Column:
    return F.size(F.filter(_lines(c), lambda l: ~_blank(l) & ~text.is_comment_line(l))).cast("bigint")


def lines_blank(c: Column) -> Column:
    return F.size(F.filter(_lines(c), _blank)).cast("bigint")


def num_tokens(c: Column) -> Column:
    return F.size(text.words(c)).cast("bigint")


def suspicious_comments(c: Column) -> Column:
    return F.size(F.filter(_lines(c), lambda l: text.is_comment_line(l) & l.rlike(SUSPICIOUS))).cast("bigint")


def entropy_col(c: Column) -> Column:
    """M5 for one document, row-local: Shannon entropy (bits) of its token counts, 0 for
    no token.  Tokens are sorted inside the row and equal runs folded into ``sum(c * log2 c)``, so
    ``H = log2(n) - sum(c * log2 c) / n`` needs no shuffle of the tokens."""
    def close(run):
        return F.when(run > 0, run * F.log2(run)).otherwise(F.lit(0.0))

    s = F.array_sort(text.words(c))
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("bigint").alias("run"),
                    F.lit(0.0).alias("acc"))
    folded = F.aggregate(
        s, init,
        lambda a, x: F.when(x == a["prev"], F.struct(x.alias("prev"), (a["run"] + 1).alias("run"), a["acc"].alias("acc")))
                      .otherwise(F.struct(x.alias("prev"), F.lit(1).cast("bigint").alias("run"),
                                          (a["acc"] + close(a["run"])).alias("acc"))),
        lambda a: a["acc"] + close(a["run"]))
    n = F.size(s)
    return F.when(n == 0, F.lit(0.0)).otherwise((F.log2(n) - folded / n)).cast("double")


def entropy(df: DataFrame, keys: list[str], content: str = "content", out: str = "text_entropy") -> DataFrame:
    """M5 for long free text: ``keys + [out]``.  Tokens are exploded and counted per (document,
    token) with map-side partial aggregation (vectorised hash aggregation beats the per-token
    lambda fold on long documents); a second aggregation per document folds
    ``log2(n) - sum(c*log2 c)/n``.  Same values as ``entropy_col``."""
    tok = df.select(*keys, F.explode(text.words(F.col(content))).alias("_t"))
    counts = tok.groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_c"))
    per_doc = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"))
    h = F.log2("_n") - F.col("_s") / F.col("_n")
    ent = per_doc.select(*keys, h.cast("double").alias(out))
    return (df.select(*keys).join(ent, keys, "left")
              .withColumn(out, F.coalesce(F.col(out), F.lit(0.0))))


def _count(nodes: str, cond: str) -> str:
    return f"cast(size(filter({nodes}, x -> {cond})) AS bigint)"


def _module_key(x: str = "x") -> str:
    return (f"({x}.kind = 'key' AND {x}.pkind = 'item' AND NOT {x}.key IN ({sql_in_list(TASK_KEYWORDS)}) "
            f"AND NOT {x}.key LIKE 'with\\\\_%')")


def yaml_metric_exprs(nodes: str, content: str) -> dict[str, Column]:
    """All structure metrics as expressions of a nodes column; NULL when ``nodes`` is NULL."""
    mod = _module_key()
    child_of_mod = (f"(x.pkind = 'key' AND x.gpkind = 'item' AND NOT x.pkey IN ({sql_in_list(TASK_KEYWORDS)}) "
                    f"AND NOT x.pkey LIKE 'with\\\\_%')")
    e = {
        "num_keys": _count(nodes, "x.kind = 'key' AND (x.val <> '' OR x.has_children)"),
        "num_tasks": f"cast(size(array_distinct(transform(filter({nodes}, x -> {mod}), x -> x.parent))) AS bigint)",
        "num_distinct_modules": f"cast(size(array_distinct(transform(filter({nodes}, x -> {mod}), x -> x.key))) AS bigint)",
        "num_parameters_ansible": _count(nodes, child_of_mod),
        "num_conditions": (f"cast(aggregate(filter({nodes}, x -> x.kind = 'key' AND x.key = 'when' AND x.val <> ''), "
                           f"0, (acc, x) -> acc + greatest(1, size(split(x.val, '{COMPARISON}')) - 1)) AS bigint)"),
        "num_unique_names": (f"cast(size(array_distinct(transform(filter({nodes}, x -> x.kind = 'key' AND "
                             f"x.key = 'name' AND x.pkind = 'item' AND x.val <> ''), x -> x.val))) AS bigint)"),
        "_plays": _count(nodes, "x.kind = 'key' AND x.key = 'hosts' AND x.pkind = 'item' AND x.depth = 1"),
        "num_shell_scripts": _count(nodes, "x.val LIKE '%.sh'"),
    }
    for s in TOSCA_SECTIONS:
        e[f"num_{s}"] = _count(nodes, f"x.pkey = '{s}'")
    out = {k: F.expr(v) for k, v in e.items()}
    return out


def product_metrics(df: DataFrame, keys: list[str], profile: str, content: str = "content") -> DataFrame:
    """``keys + metrics`` for each row of ``df`` (one document per row).

    ``profile``: ``ansible`` (11 metrics), ``tosca`` (16) or ``text`` (4: lines, tokens, entropy;
    no parse check).
    """
    c = F.col(content)
    if profile == "text":
        base = df.select(*keys, lines_code(c).alias("lines_code"), lines_blank(c).alias("lines_blank"),
                         num_tokens(c).alias("num_tokens"))
        return base.join(entropy(df, keys, content), keys).select(*keys, *TEXT_METRICS)

    with_nodes = df.select(*keys, content, yaml_nodes(content).alias("_nodes"))
    ok = F.col("_nodes").isNotNull()
    m = yaml_metric_exprs("_nodes", content)
    common = {
        "lines_code": lines_code(c), "lines_blank": lines_blank(c), "num_tokens": num_tokens(c),
        "num_keys": m["num_keys"],
    }
    if profile == "ansible":
        cols = dict(common)
        cols.update({
            "num_conditions": m["num_conditions"],
            "avg_play_size": (lines_code(c) / F.greatest(F.lit(1), m["_plays"])).cast("double"),
            "num_distinct_modules": m["num_distinct_modules"],
            "num_parameters": m["num_parameters_ansible"],
            "num_tasks": m["num_tasks"],
            "num_unique_names": m["num_unique_names"],
        })
        names = ANSIBLE_METRICS
    elif profile == "tosca":
        cols = dict(common)
        cols["num_suspicious_comments"] = suspicious_comments(c)
        for s in TOSCA_SECTIONS:
            cols[f"num_{s}"] = m[f"num_{s}"]
        cols["num_shell_scripts"] = m["num_shell_scripts"]
        names = TOSCA_METRICS
    else:
        raise ValueError(f"unknown profile {profile!r}")
    cols["text_entropy"] = entropy_col(c)
    sel = with_nodes.select(*keys, *[F.when(ok, v).alias(k) for k, v in cols.items()])
    return sel.select(*keys, *[F.col(n) for n in names])
