import os
import tempfile

import pytest
from pyspark.sql import functions as F

from faultline.plans import miner, profiles
from faultline.sources.binding import bind
from faultline.streaming import incremental

from conftest import SF001


@pytest.fixture(scope="module")
def feeds(spark):
    h = bind(spark, SF001)
    commits = h.commits.select(*[c.split()[0] for c in incremental.COMMITS_SCHEMA.split(", ")])
    events = incremental.event_feed(h.files, h.diff_lines)
    base = tempfile.mkdtemp(prefix="faultline-feeds-")
    events.write.parquet(os.path.join(base, "events"))
    want = sorted((r.repo, r.commit_hash, list(r.labels)) for r in miner.mine_fixing_commits(h, profiles.ANSIBLE).collect())
    assert want
    return commits, spark.read.schema(incremental.EVENTS_SCHEMA).parquet(os.path.join(base, "events")), want


def folders():
    base = tempfile.mkdtemp(prefix="faultline-stream-")
    return [os.path.join(base, d) for d in ("commits", "events", "out", "ckpt")]


def result(spark, out):
    return sorted((r.repo, r.commit_hash, list(r.labels)) for r in spark.read.parquet(out).collect())


def run(spark, src, ev, out, ckpt, **options):
    q = incremental.start(spark, src, ev, profiles.ANSIBLE, out, ckpt, **options)
    q.awaitTermination()
    return q


def test_late_rows_in_either_feed(spark, feeds):
    """Events lag behind commits, then run ahead of them; the events of one commit are split over batches."""
    commits, events, want = feeds
    src, ev, out, ckpt = folders()
    commits.where("idx < 200").write.mode("append").parquet(src)
    events.where("idx < 100").write.mode("append").parquet(ev)
    run(spark, src, ev, out, ckpt)
    first = result(spark, out)
    assert 0 < len(first) < len(want) and set(map(str, first)) <= set(map(str, want))
    events.where("idx >= 100 AND pos % 2 = 0").write.mode("append").parquet(ev)
    run(spark, src, ev, out, ckpt)
    events.where("idx >= 100 AND pos % 2 = 1").write.mode("append").parquet(ev)
    commits.where("idx >= 200").write.mode("append").parquet(src)
    run(spark, src, ev, out, ckpt)
    assert result(spark, out) == want


def test_repeated_rows_and_restart(spark, feeds):
    """Rows that producers send again, within a batch and later, change nothing; a restart goes on from the state."""
    commits, events, want = feeds
    src, ev, out, ckpt = folders()
    for _ in range(2):
        commits.where("idx < 300").write.mode("append").parquet(src)
        events.where("idx < 250").write.mode("append").parquet(ev)
    run(spark, src, ev, out, ckpt)
    run(spark, src, ev, out, ckpt)                       # nothing new
    commits.write.mode("append").parquet(src)            # everything again, and the rest
    events.write.mode("append").parquet(ev)
    run(spark, src, ev, out, ckpt)
    assert result(spark, out) == want


def test_an_epoch_that_runs_again_writes_the_same_rows(spark, feeds):
    """The epoch wrote its rows but was not committed: another checkpoint runs it again."""
    commits, events, want = feeds
    src, ev, out, _ = folders()
    commits.write.parquet(src)
    events.write.parquet(ev)
    for attempt in ("one", "two"):
        run(spark, src, ev, out, os.path.join(os.path.dirname(out), attempt))
        assert result(spark, out) == want


def test_work_of_an_epoch_follows_its_input(spark, feeds):
    """After a long history an epoch with one commit reads that commit's rows only, and no output of before."""
    commits, events, _ = feeds
    src, ev, out, ckpt = folders()
    last = commits.agg(F.max("idx")).first()[0]
    commits.where(F.col("idx") < last).write.mode("append").parquet(src)
    events.where(F.col("idx") < last).write.mode("append").parquet(ev)
    run(spark, src, ev, out, ckpt)
    new, more = commits.where(F.col("idx") == last), events.where(F.col("idx") == last)
    new.write.mode("append").parquet(src)
    more.write.mode("append").parquet(ev)
    for folder in os.listdir(out):
        if folder.startswith("epoch="):                  # earlier output is out of reach
            os.rename(os.path.join(out, folder), os.path.join(out, "_" + folder))
    q = run(spark, src, ev, out, ckpt)
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    assert sum(p["numInputRows"] for p in progress) == new.count() + more.count()
    state = progress[-1]["stateOperators"][0]
    assert state["numRowsUpdated"] <= new.count()


def test_known_commits_are_skipped(spark, feeds):
    commits, events, want = feeds
    src, ev, out, ckpt = folders()
    commits.write.parquet(src)
    events.write.parquet(ev)
    known = spark.createDataFrame([w[:2] for w in want[:100]], "repo string, commit_hash string")
    run(spark, src, ev, out, ckpt, known=known, files_a_batch=1)
    assert result(spark, out) == want[100:]
