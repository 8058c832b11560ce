"""Kept tables: upserts, replays, failed attempts, folds and restarts against plain Python."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import kept

AT = dt.datetime(2024, 5, 1)
REVIEWS = "organization_id long, field_id string, signature string, rule_kind string, example string, process_id long, reviewer_id long, at timestamp"


def review(i, rng):
    return (rng.randrange(2), rng.choice(["a", "b"]), rng.choice(["x || y", "z", "", None]), "TEXT_ALIAS", f"e{i}", i, i % 5, AT + dt.timedelta(minutes=i))


def expected(rows):
    out = {}
    for org, field, sign, kind, example, process, reviewer, at in rows:
        if sign:
            n, _, _, _, first, last = out.get((org, field, sign), (0, None, None, None, at, at))
            out[org, field, sign] = (n + 1, example, process, reviewer, min(first, at), max(last, at))
    return out


def state(table):
    return {(r.organization_id, r.field_id, r.signature): (r.occurrence_count, r.example, r.last_process_id, r.last_reviewer_id, r.created_at, r.updated_at) for r in table.rows().collect()}


@pytest.fixture
def batches():
    rng = random.Random(4)
    return [[review(100 * b + i, rng) for i in range(12)] for b in range(9)]


def test_upserts_replays_and_folds(spark, tmp_path, batches):
    table = kept.learned_rules(spark, str(tmp_path / "t"), fold_after=3)
    assert state(table) == {}
    done = []
    for b, rows in enumerate(batches):
        df = kept.approvals(spark.createDataFrame(rows, REVIEWS))
        assert table.put(df, b) and not table.put(df, b) and (b < 2 or not table.put(df, b - 2))
        done += rows
        assert state(table) == expected(done)
    # Three folds were made: what the first one replaced is gone, and no batch since the last is left.
    assert len(glob.glob(f"{tmp_path}/t/commits/fold-*.json")) == 2 and len(glob.glob(f"{tmp_path}/t/data/*")) <= 6
    assert not glob.glob(f"{tmp_path}/t/commits/*.tmp")


def test_failed_attempts_are_never_read(spark, tmp_path, batches, monkeypatch):
    table = kept.learned_rules(spark, str(tmp_path / "t"))
    table.put(kept.approvals(spark.createDataFrame(batches[0], REVIEWS)), 0)
    df = kept.approvals(spark.createDataFrame(batches[1], REVIEWS))
    with monkeypatch.context() as m:
        m.setattr(table.files, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.put(df, 1)
    assert len(glob.glob(f"{tmp_path}/t/data/*")) == 2 and state(table) == expected(batches[0])
    assert table.put(df, 1) and state(table) == expected(batches[0] + batches[1])


def test_reading_starts_no_job_for_a_batch(spark, tmp_path, batches):
    table = kept.learned_rules(spark, str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for b, rows in enumerate(batches):
        table.put(kept.approvals(spark.createDataFrame(rows, REVIEWS)), b)
        if b in (1, 8):
            spark.sparkContext.setJobGroup(f"read-{b}", "")
            table.rows()
            counts.append(len(tracker.getJobIdsForGroup(f"read-{b}")))
            spark.sparkContext._jsc.clearJobGroup()
    assert counts[0] == counts[1] <= 1


def test_stream_goes_on_after_a_failure(spark, tmp_path, batches, monkeypatch):
    """The query fails after a batch's data are written and before it is published; started again it takes that batch once."""
    table = kept.learned_rules(spark, str(tmp_path / "t"), fold_after=4)
    for rows in batches[:5]:
        spark.createDataFrame(rows, REVIEWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: kept.approvals(spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    real, calls = table.files.publish, []

    def flaky(name, text):
        calls.append(name)
        if len(calls) == 3:
            raise OSError("lost")
        return real(name, text)

    monkeypatch.setattr(table.files, "publish", flaky)
    with pytest.raises(Exception, match="lost"):
        table.follow(source(), f"{tmp_path}/state")
    table.follow(source(), f"{tmp_path}/state")
    assert state(table) == expected(sum(batches[:5], []))
    table.follow(source(), f"{tmp_path}/state")
    assert state(table) == expected(sum(batches[:5], []))


def test_audit_log(spark, tmp_path):
    log = kept.audit_log(spark, str(tmp_path / "log"), fold_after=2)
    rows = lambda b: spark.range(b, b + 3).select(F.lit(1).cast("long").alias("organization_id"), F.lit("a").alias("actor_id"), F.lit("REVIEW_APPROVED").alias("event_type"), F.lit("r").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit(AT).cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("metadata"))
    for b in range(5):
        assert log.put(rows(b), b) and not log.put(rows(b), b)
    assert sorted(r.entity_id for r in log.rows().collect()) == sorted(str(b + i) for b in range(5) for i in range(3))
    assert os.listdir(tmp_path / "log" / "data")
