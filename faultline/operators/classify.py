"""Commit classification C1-C13.

Message rules are evaluated once per commit with higher-order functions over its sentences (no
shuffle, no Python).  A category holds when one sentence has a defect word (R1) *and* the
category's words -- or, for four categories, when some sentence has a defect word and a
commit-level change signal is set (comment, data, include, service).

``focus`` (optional ``ARRAY<STRING>``, one string per sentence) lets callers that own a dependency
parser restrict category words to the parser's root/object words.  Without it every alphabetic
token of the sentence is a focus word -- a superset of any parser's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import modules, rules, text
from faultline.functions.paths import is_ansible_file
from faultline.functions.yaml import NODE_TYPE, yaml_nodes
from faultline.operators.versions import content_key
from faultline.session import materialise

LABEL_NAMES = [name for name, _ in rules.LABELS]
# Which commit-level signal also lets a category hold (besides its words).
SIGNAL_OF = {"CONFIGURATION_DATA": "data_changed", "DEPENDENCY": "include_changed",
             "DOCUMENTATION": "comment_changed", "SERVICE": "service_changed"}
SIGNALS = ["comment_changed", "data_changed", "include_changed", "service_changed"]


def _category_in_sentence(sents: Column, focus: Column | None, rule_names: list[str]) -> Column:
    if focus is None:
        return F.exists(sents, lambda s: rules.has(s, "defect") & rules.has(s, *rule_names))
    return F.exists(F.arrays_zip(sents.alias("s"), focus.alias("f")),
                    lambda z: rules.has(z["s"], "defect") & rules.has(z["f"], *rule_names))


def message_flags(commits: DataFrame, focus: str | None = None) -> DataFrame:
    """Adds ``has_defect`` and one boolean per label (message part only, C5-C12 without signals)."""
    sents = text.sentence_texts(F.col("msg"))
    f = F.col(focus) if focus else None
    out = commits.withColumn("_sents", sents).withColumn(
        "has_defect", F.exists(F.col("_sents"), lambda s: rules.has(s, "defect")))
    for name, rule_names in rules.LABELS:
        out = out.withColumn(f"msg_{name.lower()}", _category_in_sentence(F.col("_sents"), f, rule_names))
    return out.drop("_sents")


def comment_changed(files: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """Commits with a MODIFY file whose added or deleted lines include a ``#`` comment line."""
    hits = diff_lines.filter(text.is_comment_line(F.col("text"))).select("repo", "commit_hash", "pos")
    modify = files.filter(F.col("change_type") == "MODIFY").select("repo", "commit_hash", "pos")
    return (hits.join(modify, ["repo", "commit_hash", "pos"], "left_semi")
                .select("repo", "commit_hash").distinct()
                .withColumn("comment_changed", F.lit(True)))


#: A table of families up to this many rows is sent to every task; a larger one is shuffled by name.
BROADCAST_FAMILIES = 100_000
_FAMILIES = {"data": "data_changed", "include": "include_changed", "service": "service_changed"}


def ansible_change_signals(files: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """C2-C4 for Ansible: per commit, whether configuration-data, include or service values differ
    between the two sides of the first MODIFY Ansible file (by position) whose two sides parse.
    Empty text has no entries; a missing side does not count as parsed.

    Only keys with a value (null is none) count; ``sub`` stands for the whole value, nested ones carrying the hash
    of their subtree.  A content is one side of an event and the other side of the next, so each distinct one is
    parsed once; events carry keys of their contents and meet what was found there in equi-joins.
    """
    families = modules.family_table(files.sparkSession) if families is None else families
    cand = files.filter((F.col("change_type") == "MODIFY") & is_ansible_file(F.col("new_path"))
                        & F.col("content").isNotNull() & F.col("content_before").isNotNull())
    contents = cand.select(F.explode(F.array("content", "content_before")).alias("content")).distinct()
    found = materialise(family_values(contents, families), "family-values")
    events = cand.select("repo", "commit_hash", "pos", content_key(F.col("content")).alias("now"),
                         content_key(F.col("content_before")).alias("then"))
    for side in ("now", "then"):
        events = events.join(found.select(F.col("content_key").alias(side), *[F.col(f).alias(f"{side}_{f}") for f in _FAMILIES]), side)
    # The flags of an event as bits below its position: their minimum is the first file's.
    bits = [F.when(~F.col(f"now_{f}").eqNullSafe(F.col(f"then_{f}")), 1 << i).otherwise(0) for i, f in enumerate(_FAMILIES)]
    first = events.groupBy("repo", "commit_hash").agg(
        F.min(F.col("pos").cast("long") * 8 + sum(bits, F.lit(0))).alias("first"))
    return first.select("repo", "commit_hash", *[F.coalesce(F.col("first").bitwiseAND(1 << i) != 0, F.lit(False)).alias(out)
                                                 for i, out in enumerate(_FAMILIES.values())])


def family_values(contents: DataFrame, families: DataFrame) -> DataFrame:
    """``(content_key, data, include, service)`` of every one of ``contents(content)`` that parses: for each family
    128 bits of the values of its keys in reading order, null without such a key.  Keys meet the table of
    ``families`` in an equi-join."""
    nodes = F.coalesce(yaml_nodes("content", hashes=True), F.when(F.col("content") == "", F.array().cast(NODE_TYPE)))
    wanted = F.filter(nodes, lambda x: (x["kind"] == "key") & (x["sub"] != "n"))
    parsed = materialise(contents.select(
        content_key(F.col("content")).alias("content_key"),
        F.transform(wanted, lambda x: F.struct(x["ord"].alias("ord"), x["key"].alias("key"), x["sub"].alias("sub"))).alias("keys"))
        .filter("keys IS NOT NULL"), "parsed")
    keys = parsed.select("content_key", F.explode("keys").alias("k")).select(
        "content_key", "k.ord", "k.sub", F.explode(modules.matches(F.col("k.key"))).alias("match"))
    small = families.limit(BROADCAST_FAMILIES + 1).count() <= BROADCAST_FAMILIES
    hits = keys.join(F.broadcast(families) if small else families, "match").filter(F.col("family").isin(*_FAMILIES))
    values = hits.groupBy("content_key").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("family") == f, F.struct("ord", "sub")))).alias(f) for f in _FAMILIES])
    digests = [F.when(F.size(f) > 0, F.md5(F.to_json(F.col(f)["sub"]))).alias(f) for f in _FAMILIES]
    return parsed.select("content_key").join(values.select("content_key", *digests), "content_key", "left")


def change_signals(files: DataFrame, diff_lines: DataFrame, ansible: bool,
                   families: DataFrame | None = None) -> DataFrame:
    """Commit-level signals ``(repo, commit_hash, comment_changed, data_changed, include_changed,
    service_changed)``; only commits with at least one signal set appear."""
    c1 = comment_changed(files, diff_lines)
    if not ansible:
        return c1.select("repo", "commit_hash", "comment_changed", *[F.lit(False).alias(s) for s in SIGNALS[1:]])
    c24 = ansible_change_signals(files, families)
    return (c1.join(c24, ["repo", "commit_hash"], "full")
              .select("repo", "commit_hash", *[F.coalesce(F.col(s), F.lit(False)).alias(s) for s in SIGNALS]))


def classify(commits: DataFrame, signals: DataFrame | None = None, focus: str | None = None) -> DataFrame:
    """One row per commit with ``labels ARRAY<STRING>`` in the fixed label order (possibly
    empty) and one boolean column per label (``fixes_<label>``)."""
    flags = message_flags(commits, focus)
    if signals is not None:
        flags = flags.join(signals, ["repo", "commit_hash"], "left")
    else:
        flags = flags.select("*", *[F.lit(None).cast("boolean").alias(s) for s in SIGNALS])
    for name in LABEL_NAMES:
        cond = F.col(f"msg_{name.lower()}")
        if name in SIGNAL_OF:
            cond = cond | (F.col("has_defect") & F.coalesce(F.col(SIGNAL_OF[name]), F.lit(False)))
        flags = flags.withColumn(f"fixes_{name.lower()}", cond)
    labels = F.array_compact(F.array(*[F.when(F.col(f"fixes_{n.lower()}"), F.lit(n)) for n in LABEL_NAMES]))
    return flags.withColumn("labels", labels).drop(*[f"msg_{n.lower()}" for n in LABEL_NAMES], *SIGNALS)


def defect_commits(commits: DataFrame) -> DataFrame:
    """Commits whose message has a defect word in some sentence: the only ones whose files need
    change signals (the signals never decide alone)."""
    return message_flags(commits).filter("has_defect").select("repo", "commit_hash")
