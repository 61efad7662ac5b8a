"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator family.

Every query reads the driver tables (through the binding, or ``documents`` / ``pages`` directly)
over whole tables and whole texts; none is restricted to a sample.  Output columns are aliased and
typed (BIGINT / DOUBLE / STRING / BOOLEAN) so they line up with the SQL oracle; averages and
entropies are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import paths, rules, text
from faultline.functions.yaml import yaml_nodes
from faultline.operators import classify, product
from faultline.operators.blame import blame
from faultline.operators.fixes import merge_known, sort_commits
from faultline.operators.line_identity import blame_lines, by_line
from faultline.operators.lineage import path_lineage
from faultline.operators.lives import file_lives
from faultline.operators.process import PROCESS_METRICS, process_metrics
from faultline.operators.snapshot import checkpoint_axis, snapshot
from faultline.operators.versions import content_key, measure
from faultline.plans import dataset, miner, profiles
from faultline.session import ensure_checkpoint_dir, materialise
from faultline.sources import sinks
from faultline.sources.binding import bind
from faultline.sources.history import (History, commit_checkpoints, diff_scan, file_events, on_branch, point_scan,
                                       range_scan, release_checkpoints)

_BOUND: dict[tuple[str, str], History] = {}
_CACHE: dict[tuple[str, str, str], DataFrame] = {}


def history(spark: SparkSession, sf_dir: str) -> History:
    """The bound history of ``sf_dir``, built once per session (its tables are Parquet)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOUND:
        _BOUND[key] = bind(spark, sf_dir)
    return _BOUND[key]


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A shared intermediate (lineage, fixing commits) written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _CACHE:
        _CACHE[key] = materialise(build(), name.replace(":", "-"))
    return _CACHE[key]


def lineage_of(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "lineage", lambda: path_lineage(history(spark, sf_dir).files))


def lives_of(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "lives", lambda: file_lives(history(spark, sf_dir).files))


def fixing_of(spark, sf_dir, profile: str = "ansible") -> DataFrame:
    h = history(spark, sf_dir)
    return _once(spark, sf_dir, f"fixing:{profile}",
                 lambda: miner.mine_fixing_commits(h, profiles.get(profile)))


def releases_of(spark, sf_dir) -> DataFrame:
    h = history(spark, sf_dir)
    return release_checkpoints(h.commits, h.tags)


def axis_of(spark, sf_dir) -> DataFrame:
    """Checkpoint axis of the release checkpoints, computed once per session."""
    h = history(spark, sf_dir)
    return _once(spark, sf_dir, "axis:releases", lambda: checkpoint_axis(h.commits, releases_of(spark, sf_dir)))


def _big(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


def _r6(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


# ---------------------------------------------------------------- scans
def q_commit_order(spark, sf):
    return history(spark, sf).commits.select("repo", "commit_hash", "idx")


def q_branch_scan(spark, sf):
    return on_branch(history(spark, sf).commits, "F").select("repo", "commit_hash", "idx")


def q_range_scan(spark, sf):
    c = history(spark, sf).commits
    # Bounds given newest-first, as a reverse traversal would name them.
    bounds = (c.filter(F.col("idx") == 250).select("repo", F.col("commit_hash").alias("from_hash"))
               .join(c.filter(F.col("idx") == 120).select("repo", F.col("commit_hash").alias("to_hash")), "repo"))
    return range_scan(c, bounds).select("repo", "commit_hash", "idx")


def q_point_scan(spark, sf):
    h = history(spark, sf)
    return point_scan(h.commits, h.tags).select("repo", "commit_hash", "idx", F.col("committed_at").cast("string")
                                                .alias("committed_at"))


def q_release_checkpoints(spark, sf):
    cp = releases_of(spark, sf)
    prev = F.lag("idx").over(Window.partitionBy("repo").orderBy("rel_no"))
    return cp.select("repo", "commit_hash", "idx", _big("rel_no"), prev.cast("bigint").alias("prev_idx"))


def q_commit_checkpoints(spark, sf):
    return commit_checkpoints(history(spark, sf).commits).select("repo", "commit_hash", "idx", _big("rel_no"))


def q_file_events(spark, sf):
    f = file_events(history(spark, sf).files, ["MODIFY", "RENAME"])
    return f.select("repo", "commit_hash", "idx", _big("pos"), "change_type", "old_path", "new_path",
                    _big("additions"), _big("deletions"), _big("hunks"))


def q_diff_scan(spark, sf):
    d = diff_scan(history(spark, sf).diff_lines)
    return d.select("repo", "commit_hash", _big("pos"), "path", "side", _big("line_no"), "text")


def _locator(url: F.Column) -> F.Column:
    rest = F.regexp_extract(url, r"^[a-z]+://[^/]+(.*)$", 1)
    return (F.when(url.rlike(r"\.example\.com"), F.concat(F.lit("https://github.com"), rest))
             .when(url.rlike(r"\.example\.net"), F.concat(F.lit("https://gitlab.com"), rest, F.lit(".git")))
             .otherwise(F.concat(F.lit("git@bitbucket.com:"), rest)))


def q_repo_locator(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    loc = pages.select(_big("page_id"), _locator(F.col("url")).alias("locator"))
    l = F.col("locator")
    return loc.select("page_id", "locator", paths.is_remote(l).alias("is_remote"),
                      paths.is_valid_locator(l).alias("is_valid"), paths.repo_owner(l).alias("owner"),
                      paths.repo_name(l).alias("name"))


# ---------------------------------------------------------------- predicates
def q_ansible_filter(spark, sf):
    f = history(spark, sf).files
    p = (f.select("repo", F.explode(F.array("old_path", "new_path")).alias("path"))
          .filter(F.col("path").isNotNull()).distinct())
    return p.select("repo", "path", paths.is_ansible_file(F.col("path")).alias("is_ansible"),
                    paths.is_tosca_file(F.col("path")).alias("is_tosca_path"))


def q_tosca_filter(spark, sf):
    f = history(spark, sf).files.filter(F.col("change_type") != "DELETE")
    return f.select("repo", "commit_hash", _big("pos"),
                    paths.is_tosca_file(F.col("new_path"), F.col("content")).alias("is_tosca"))


def q_profile_ignore(spark, sf):
    f = history(spark, sf).files.filter(F.col("change_type") != "DELETE")
    p, c = F.col("new_path"), F.col("content")
    return f.select("repo", "commit_hash", _big("pos"),
                    *[profiles.get(n).keep(p, c).alias(f"keep_{n}") for n in ("base", "ansible", "tosca")])


def messages(spark, sf) -> DataFrame:
    """Commit messages and, as messages of a further repository, the whole text of every document."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = d.select(F.lit("documents").alias("repo"), F.col("doc_id").cast("string").alias("commit_hash"), F.col("text").alias("msg"))
    return history(spark, sf).commits.select("repo", "commit_hash", "msg").unionByName(texts)


def _rule_query(rule: str):
    def q(spark, sf):
        c = messages(spark, sf)
        return c.select("repo", "commit_hash", rules.has(F.col("msg"), rule).alias("hit"))
    q.__name__ = f"q_rule_{rule}"
    return q


RULE_KEYS = {f"rule_{r}": r for r in rules.RULES}


def q_sentence_tokens(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    st = text.sentence_texts(F.col("text"))
    return d.select(_big("doc_id"), F.size(text.sentences(F.col("text"))).cast("bigint").alias("n_sentences"),
                    F.aggregate(F.transform(st, lambda s: F.size(F.split(s, " ")) - F.when(s == "", 1).otherwise(0)),
                                F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_tokens"),
                    F.array_join(st, "|").alias("norm"))


# ---------------------------------------------------------------- classification
def base_classified(spark, sf) -> DataFrame:
    h = history(spark, sf)
    return classify.classify(messages(spark, sf), classify.change_signals(h.files, h.diff_lines, ansible=False))


def _fix_query(label: str):
    col = f"fixes_{label.lower()}"

    def q(spark, sf):
        return base_classified(spark, sf).select("repo", "commit_hash", F.col(col).alias("hit"))
    q.__name__ = f"q_fix_{label.lower()}"
    return q


def q_fix_focus(spark, sf):
    """T5: category words are looked for in the caller's focus words only -- here the first and the last
    word of a sentence, blanks collapsed (T4), in place of a parser's choice."""
    m = messages(spark, sf)
    ends = F.transform(text.sentence_texts(F.col("msg")), lambda s: text.collapse_ws(F.concat(
        F.substring_index(s, " ", 1), F.lit("  \t"), F.substring_index(s, " ", -1))))
    return classify.classify(m.withColumn("focus", ends), focus="focus").select(
        "repo", "commit_hash", F.array_join("labels", ",").alias("labels"))


def q_fixing_commits(spark, sf):
    return fixing_of(spark, sf, "ansible").select("repo", "commit_hash", "idx",
                                                   F.array_join("labels", ",").alias("labels"))


def q_fixing_commits_tosca(spark, sf):
    return fixing_of(spark, sf, "tosca").select("repo", "commit_hash", "idx",
                                                 F.array_join("labels", ",").alias("labels"))


def q_resume_known(spark, sf):
    h = history(spark, sf)
    prof = profiles.ANSIBLE
    # A previous run covered history before 1998: its fixing commits are "known".
    before = h.commits.filter(F.col("committed_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    known = materialise(miner.mine_fixing_commits(History(before, h.files, h.diff_lines, h.tags), prof), "known")
    new = miner.mine_fixing_commits(h, prof, known=known)
    merged = merge_known(new, known, h.commits)
    return (merged.join(new.select("repo", "commit_hash", F.lit(True).alias("is_new")), ["repo", "commit_hash"], "left")
                  .select("repo", "commit_hash", "idx", F.coalesce("is_new", F.lit(False)).alias("is_new")))


def q_sort_commits(spark, sf):
    h = history(spark, sf)
    fx = fixing_of(spark, sf).select("repo", "commit_hash")
    hashes = fx.unionByName(fx).unionByName(fx.select("repo", F.concat(F.lit("x"), "commit_hash").alias("commit_hash")))
    return sort_commits(hashes, h.commits).select("repo", "commit_hash", "idx")


def q_comment_changed(spark, sf):
    h = history(spark, sf)
    return classify.comment_changed(h.files, h.diff_lines).select("repo", "commit_hash")


def _signal_query(sig: str):
    def q(spark, sf):
        h = history(spark, sf)
        return classify.ansible_change_signals(h.files).select("repo", "commit_hash", F.col(sig).alias("changed"))
    q.__name__ = f"q_{sig}"
    return q


def q_yaml_entries(spark, sf):
    f = history(spark, sf).files.filter((F.col("change_type") != "DELETE") & paths.is_ansible_file(F.col("new_path")))
    n = f.select("repo", "commit_hash", "pos", F.explode(yaml_nodes("content")).alias("n"))
    return (n.filter(F.col("n.kind") == "key")
             .select("repo", "commit_hash", _big("pos"), F.col("n.ord").cast("bigint").alias("ord"),
                     F.col("n.depth").cast("bigint").alias("depth"), F.col("n.key").alias("key"),
                     F.col("n.val").alias("val")))


# ---------------------------------------------------------------- SZZ, lineage, fixed files, labels
def _fix_events(spark, sf):
    return miner.fix_events(history(spark, sf), profiles.ANSIBLE, fixing_of(spark, sf))


def q_szz_blame(spark, sf):
    h = history(spark, sf)
    b = blame(_fix_events(spark, sf), h.diff_lines, lives_of(spark, sf))
    return b.select("repo", "commit_hash", _big("pos"), _big("line_no"), _big("prev_idx"))


def q_szz_lines(spark, sf):
    h = history(spark, sf)
    b = by_line(blame_lines(_fix_events(spark, sf), h.files, h.diff_lines, lives_of(spark, sf)))
    return b.select("repo", "commit_hash", _big("pos"), _big("line_no"), _big("prev_idx"))


def szz_of(spark, sf) -> DataFrame:
    """J4+J5 for the Ansible fixing commits, computed once per session."""
    h = history(spark, sf)
    return _once(spark, sf, "szz", lambda: miner.szz_fixes(h, profiles.ANSIBLE, fixing_of(spark, sf),
                                                           lineage_of(spark, sf), lives_of(spark, sf)))


def q_szz_oldest(spark, sf):
    return szz_of(spark, sf).select("repo", "commit_hash", _big("pos"), "bic", _big("bic_idx"))


def q_lineage(spark, sf):
    return lineage_of(spark, sf).select("repo", "path", "lineage")


def q_file_lives(spark, sf):
    return lives_of(spark, sf).select("repo", "commit_hash", _big("pos"), "path", "life")


def fixed_by_path(spark, sf) -> DataFrame:
    h = history(spark, sf)
    return _once(spark, sf, "fixed:w2", lambda: miner.fixed_files(
        h, profiles.ANSIBLE, fixing_of(spark, sf), lineage_of(spark, sf), follow_renames=False,
        fixes=szz_of(spark, sf)))


def q_fixed_files(spark, sf):
    return fixed_by_path(spark, sf).select("repo", "filepath", "fic", "bic", _big("fic_idx"), _big("bic_idx"))


def fixed_renamed(spark, sf) -> DataFrame:
    """Intervals merged along renames; every label query starts from these."""
    h = history(spark, sf)
    return _once(spark, sf, "fixed:w1", lambda: miner.fixed_files(
        h, profiles.ANSIBLE, fixing_of(spark, sf), lineage_of(spark, sf), follow_renames=True,
        fixes=szz_of(spark, sf)))


def q_fixed_files_renamed(spark, sf):
    return fixed_renamed(spark, sf).select("repo", "filepath", "fic", "bic", _big("fic_idx"), _big("bic_idx"))


def q_failure_prone(spark, sf):
    h = history(spark, sf)
    fp = miner.label(h, fixed_renamed(spark, sf), fixing_of(spark, sf), follow_names=False)
    return fp.select("repo", "filepath", "commit", "fixing_commit")


def prone_named(spark, sf) -> DataFrame:
    h = history(spark, sf)
    return _once(spark, sf, "prone:named",
                 lambda: miner.label(h, fixed_renamed(spark, sf), fixing_of(spark, sf), follow_names=True))


def q_failure_prone_named(spark, sf):
    return prone_named(spark, sf).select("repo", "filepath", "commit", "fixing_commit")


def q_failure_prone_chain(spark, sf):
    h = history(spark, sf)
    fp = miner.label(h, fixed_renamed(spark, sf), fixing_of(spark, sf), follow_chain=True, lives=lives_of(spark, sf))
    return fp.select("repo", "filepath", "commit", "fixing_commit")


def q_label_flag(spark, sf):
    from faultline.operators.labels import label_flag
    h = history(spark, sf)
    cps = releases_of(spark, sf)
    snap = snapshot(h.files, axis_of(spark, sf))
    rows = (snap.join(cps.select("repo", "rel_no", F.col("commit_hash").alias("commit")), ["repo", "rel_no"])
                .withColumnRenamed("path", "filepath"))
    return label_flag(rows, prone_named(spark, sf)).select("repo", _big("rel_no"), "filepath",
                                                           _big("failure_prone"))


# ---------------------------------------------------------------- snapshot, process metrics
def q_snapshot(spark, sf):
    h = history(spark, sf)
    s = snapshot(h.files, axis_of(spark, sf))
    return s.select("repo", _big("rel_no"), "path")


def process_at_releases(spark, sf) -> DataFrame:
    h = history(spark, sf)
    return _once(spark, sf, "process", lambda: process_metrics(
        h.files, h.commits, axis_of(spark, sf), lives_of(spark, sf)))


PROC_GROUPS = {
    "proc_change_set": ["change_set_max", "change_set_avg"],
    "proc_churn": ["code_churn_count", "code_churn_max", "code_churn_avg"],
    "proc_commits": ["commits_count"],
    "proc_contributors": ["contributors_count"],
    "proc_minor": ["minor_contributors_count"],
    "proc_experience": ["highest_contributor_experience"],
    "proc_hunks": ["hunks_median"],
    "proc_additions": ["additions", "additions_max", "additions_avg"],
    "proc_deletions": ["deletions", "deletions_max", "deletions_avg"],
}
DOUBLE_METRICS = {"change_set_avg", "code_churn_avg", "highest_contributor_experience", "hunks_median",
                  "additions_avg", "deletions_avg", "text_entropy", "avg_play_size"}


def _metric(c: str) -> F.Column:
    return (_r6(c) if c in DOUBLE_METRICS else F.col(c).cast("bigint")).alias(c)


def _proc_query(name: str):
    cols = PROC_GROUPS[name]

    def q(spark, sf):
        p = process_at_releases(spark, sf)
        return p.select("repo", _big("rel_no"), "life", "filepath", *[_metric(c) for c in cols])
    q.__name__ = f"q_{name}"
    return q


# ---------------------------------------------------------------- product metrics
def q_valid_content(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    from faultline.operators.snapshot import valid_content
    return valid_content(d, "text").select(_big("doc_id"), F.length("text").cast("bigint").alias("n_chars"))


def q_content_scan(spark, sf):
    """Every document as a file, some with bytes that are no UTF-8 and some empty, and read back."""
    from faultline.operators.snapshot import read_text_files, write_text_files
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text_ = F.coalesce("text", F.lit("")).cast("binary")
    body = (F.when(F.col("doc_id") % 11 == 5, F.lit(b"")).when(F.col("doc_id") % 7 == 3, F.concat(text_, F.lit(b"\xff")))
             .when(F.col("doc_id") % 13 == 4, F.concat(F.lit(b"\xc3"), text_)).otherwise(text_))
    path = _scratch(spark)
    write_text_files(d.select("doc_id", body.alias("body")), "doc_id", "body", path)
    found = read_text_files(spark, path, final_newline=True)
    return found.select(_big("doc_id"), F.col("length").alias("n_bytes"), F.col("content").isNotNull().alias("is_text"),
                        F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5"))


def _doc_metrics(spark, sf) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    return product.product_metrics(d, ["doc_id"], "text")


def q_prod_lines(spark, sf):
    return _doc_metrics(spark, sf).select(_big("doc_id"), _metric("lines_code"), _metric("lines_blank"))


def q_prod_tokens(spark, sf):
    return _doc_metrics(spark, sf).select(_big("doc_id"), _metric("num_tokens"))


def q_prod_entropy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    return product.entropy(d, ["doc_id"]).select(_big("doc_id"), _metric("text_entropy"))


def _yaml_versions(spark, sf, tech: str) -> DataFrame:
    """Product metrics of every file version of a profile, keyed by event and by (repo, idx, path); each distinct
    content is measured once."""
    h, profile = history(spark, sf), profiles.get(tech)
    files = h.files.filter((F.col("change_type") != "DELETE") & profile.keep(F.col("new_path"), F.col("content")))
    events = files.select("repo", "commit_hash", "pos", "idx", F.col("new_path").alias("path"), content_key(F.col("content")).alias("content_key"))
    return events.join(measure(h.files, profile.keep, profile.product_metrics), "content_key", "left").drop("content_key")


def ansible_versions(spark, sf) -> DataFrame:
    return _once(spark, sf, "product:ansible", lambda: _yaml_versions(spark, sf, "ansible"))


def q_prod_ansible(spark, sf):
    m = ansible_versions(spark, sf)
    return m.select("repo", "commit_hash", _big("pos"), *[_metric(c) for c in product.ANSIBLE_METRICS])


def q_prod_tosca(spark, sf):
    m = _yaml_versions(spark, sf, "tosca")
    return m.select("repo", "commit_hash", _big("pos"), *[_metric(c) for c in product.TOSCA_METRICS])


# ---------------------------------------------------------------- dataset, deltas, sinks
def q_delta_metrics(spark, sf):
    h = history(spark, sf)
    pm = ansible_versions(spark, sf).select("repo", "idx", "path", *product.ANSIBLE_METRICS)
    ds = dataset.build_dataset(h, profiles.ANSIBLE, releases_of(spark, sf), lives_of(spark, sf), None,
                               product=True, process=False, delta=True, product_df=pm, axis=axis_of(spark, sf))
    cols = [f"delta_{m}" for m in product.ANSIBLE_METRICS]
    return ds.select("repo", _big("rel_no"), "filepath", *[_r6(c).alias(c) for c in cols])


def q_metrics_dataset(spark, sf):
    h = history(spark, sf)
    pm = ansible_versions(spark, sf).select("repo", "idx", "path", *product.ANSIBLE_METRICS)
    ds = dataset.build_dataset(h, profiles.ANSIBLE, releases_of(spark, sf), lives_of(spark, sf),
                               prone_named(spark, sf), product=True, process=True, delta=False,
                               process_df=process_at_releases(spark, sf), product_df=pm, axis=axis_of(spark, sf))
    return ds.select("repo", "filepath", "commit", "committed_at", _big("failure_prone"),
                     *[_metric(c) for c in PROCESS_METRICS + product.ANSIBLE_METRICS])


def q_dataset_process_delta(spark, sf):
    """Process and product metrics with the deltas of both."""
    h = history(spark, sf)
    pm = ansible_versions(spark, sf).select("repo", "idx", "path", *product.ANSIBLE_METRICS)
    ds = dataset.build_dataset(h, profiles.ANSIBLE, releases_of(spark, sf), lives_of(spark, sf),
                               prone_named(spark, sf), product=True, process=True, delta=True,
                               process_df=process_at_releases(spark, sf), product_df=pm, axis=axis_of(spark, sf))
    cols = PROCESS_METRICS + product.ANSIBLE_METRICS
    return ds.select("repo", "filepath", "commit", "committed_at", _big("failure_prone"), *[_metric(c) for c in cols],
                     *[_r6(f"delta_{c}").alias(f"delta_{c}") for c in cols])


def q_dataset_commit_mode(spark, sf):
    """The dataset with a checkpoint at every commit."""
    h = history(spark, sf)
    pm = ansible_versions(spark, sf).select("repo", "idx", "path", *product.ANSIBLE_METRICS)
    ds = dataset.build_dataset(h, profiles.ANSIBLE, commit_checkpoints(h.commits), lives_of(spark, sf),
                               prone_named(spark, sf), product=True, process=True, product_df=pm)
    return ds.select("repo", "filepath", "commit", "committed_at", _big("failure_prone"),
                     *[_metric(c) for c in PROCESS_METRICS + product.ANSIBLE_METRICS])


def prone_tosca(spark, sf) -> DataFrame:
    h, p = history(spark, sf), profiles.TOSCA
    fixing = fixing_of(spark, sf, "tosca")
    fixes = _once(spark, sf, "szz:tosca", lambda: miner.szz_fixes(h, p, fixing, lineage_of(spark, sf), lives_of(spark, sf)))
    fixed = _once(spark, sf, "fixed:tosca", lambda: miner.fixed_files(h, p, fixing, lineage_of(spark, sf), fixes=fixes))
    return _once(spark, sf, "prone:tosca", lambda: miner.label(h, fixed, fixing))


def q_dataset_tosca(spark, sf):
    """The dataset of the TOSCA profile, its labels from TOSCA fixes."""
    h = history(spark, sf)
    ds = dataset.build_dataset(h, profiles.TOSCA, releases_of(spark, sf), lives_of(spark, sf), prone_tosca(spark, sf),
                               product=True, process=True, process_df=process_at_releases(spark, sf),
                               axis=axis_of(spark, sf))
    return ds.select("repo", "filepath", "commit", "committed_at", _big("failure_prone"),
                     *[_metric(c) for c in PROCESS_METRICS + product.TOSCA_METRICS])


def q_prone_json_codec(spark, sf):
    """Failure-prone files encoded as JSON strings, decoded, and encoded again."""
    back = sinks.decode_failure_prone(sinks.encode_failure_prone(prone_named(spark, sf)))
    return back.select("filepath", "commit", "fixing_commit",
                       F.to_json(F.struct("filepath", "commit", "fixing_commit")).alias("json"))


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"


def q_json_roundtrip(spark, sf):
    ff = fixed_renamed(spark, sf).select("repo", "filepath", "fic", "bic")
    path = _scratch(spark)
    sinks.write_fixed_files_json(ff, path)
    back = sinks.read_fixed_files_json(spark, path)
    return back.select("repo", "filepath", "fic", "bic")


def q_csv_sink(spark, sf):
    fp = prone_named(spark, sf).select("repo", "filepath", "commit", "fixing_commit")
    path = _scratch(spark)
    sinks.to_csv(fp, path)
    back = sinks.read_csv(spark, path, "repo string, filepath string, commit string, fixing_commit string")
    return back


def registry() -> dict:
    q = {
        "commit_order": q_commit_order,
        "branch_scan": q_branch_scan,
        "range_scan": q_range_scan,
        "point_scan": q_point_scan,
        "release_checkpoints": q_release_checkpoints,
        "commit_checkpoints": q_commit_checkpoints,
        "file_events": q_file_events,
        "diff_scan": q_diff_scan,
        "repo_locator": q_repo_locator,
        "ansible_filter": q_ansible_filter,
        "tosca_filter": q_tosca_filter,
        "profile_ignore": q_profile_ignore,
    }
    for key, rule in RULE_KEYS.items():
        q[key] = _rule_query(rule)
    q["sentence_tokens"] = q_sentence_tokens
    for label in classify.LABEL_NAMES:
        q[f"fix_{label.lower()}"] = _fix_query(label)
    q.update({
        "fix_focus": q_fix_focus,
        "fixing_commits": q_fixing_commits,
        "fixing_commits_tosca": q_fixing_commits_tosca,
        "resume_known": q_resume_known,
        "sort_commits": q_sort_commits,
        "comment_changed": q_comment_changed,
        "data_changed": _signal_query("data_changed"),
        "include_changed": _signal_query("include_changed"),
        "service_changed": _signal_query("service_changed"),
        "yaml_entries": q_yaml_entries,
        "szz_blame": q_szz_blame,
        "szz_lines": q_szz_lines,
        "szz_oldest": q_szz_oldest,
        "lineage": q_lineage,
        "file_lives": q_file_lives,
        "fixed_files": q_fixed_files,
        "fixed_files_renamed": q_fixed_files_renamed,
        "failure_prone": q_failure_prone,
        "failure_prone_named": q_failure_prone_named,
        "failure_prone_chain": q_failure_prone_chain,
        "label_flag": q_label_flag,
        "snapshot": q_snapshot,
    })
    for name in PROC_GROUPS:
        q[name] = _proc_query(name)
    q.update({
        "valid_content": q_valid_content,
        "content_scan": q_content_scan,
        "prod_lines": q_prod_lines,
        "prod_tokens": q_prod_tokens,
        "prod_entropy": q_prod_entropy,
        "prod_ansible": q_prod_ansible,
        "prod_tosca": q_prod_tosca,
        "delta_metrics": q_delta_metrics,
        "metrics_dataset": q_metrics_dataset,
        "dataset_process_delta": q_dataset_process_delta,
        "dataset_commit_mode": q_dataset_commit_mode,
        "dataset_tosca": q_dataset_tosca,
        "json_roundtrip": q_json_roundtrip,
        "prone_json_codec": q_prone_json_codec,
        "csv_sink": q_csv_sink,
    })
    return q
