"""Keyed streams against plain Python and against their table twins: late, repeated and unordered events, restarts."""

import datetime as dt
import random

import pytest

from tallyspark.streaming import keyed

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
LOG = "event_id long, event_type string, actor_id string, entity_id string, created_at timestamp"
RULES = {"LOGIN_FAILED": (15, 3), "DOCUMENT_VIEWED": (60, 5)}


def ms(t):
    return int(t.timestamp() * 1000)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def expected_alerts(rows, rules, before):
    out, by = set(), {}
    for event_id, kind, actor, entity, at in {tuple(r) for r in rows}:
        if kind in rules:
            by.setdefault((kind, actor or entity or "unknown"), []).append((ms(at), event_id))
    for (kind, who), times in by.items():
        minutes, least = rules[kind]
        times, since, end, n = [t for t, _ in sorted(times)], None, None, 0
        for i, t in enumerate(times):
            if since is not None and t > end:
                out.add((kind, who, "LAPSED", end, n))
                since = None
            if i + 1 >= least and t - times[i + 1 - least] <= minutes * 60_000:
                end = times[i + 1 - least] + minutes * 60_000
                n = n + 1 if since is not None else least
                if since is None:
                    since = t
                    out.add((kind, who, "RAISED", t, least))
        if since is not None:
            out.add((kind, who, "LAPSED", end, n))
    return {r for r in out if r[3] <= before}


@pytest.fixture(scope="module")
def log():
    rng = random.Random(5)
    rows = []
    for i in range(500):
        at = START + dt.timedelta(minutes=rng.choice([0, 0, 200, 700]) + rng.random() * 90, milliseconds=rng.randrange(1000))
        rows.append((i, rng.choice([*RULES, "OTHER"]), rng.choice(["a", "b", None]), rng.choice(["e", None]), at))
    rows += [(1000 + i, "LOGIN_FAILED", "tie", None, START + dt.timedelta(minutes=k)) for i, k in enumerate((0, 0, 0, 15, 15, 15, 31))]
    return rows


def test_alerts_of_a_table(spark, log):
    found = {tuple(r) for r in keyed.lookback_changes(spark.createDataFrame(log + log[:50], LOG), RULES).collect()}
    assert found == expected_alerts(log, RULES, 2**62) and len(found) > 15
    assert keyed.lookback_changes(spark.createDataFrame([], LOG), RULES).count() == 0
    now = ms(START) + 10 * 60_000
    stand = {(r.event_type, r.actor) for r in keyed.standing(keyed.lookback_changes(spark.createDataFrame(log, LOG), RULES).where(f"ms <= {now}")).collect()}
    past = [r for r in log if ms(r[4]) <= now]
    count = lambda k, a: sum(r[1] == k and (r[2] or r[3] or "unknown") == a and now - ms(r[4]) <= RULES[k][0] * 60_000 for r in past)
    assert stand == {(k, a) for k in RULES for a in ("a", "b", "e", "unknown", "tie") if count(k, a) >= RULES[k][1]}


def test_alerts_of_a_stream(spark, log, tmp_path):
    """Events come unordered within the delay, twice, and one far too late; the query is stopped and started between files."""
    rows = sorted(log, key=lambda r: (r[4], r[0]))
    rng = random.Random(1)
    path, folder = f"{tmp_path}/in", f"{tmp_path}/q"
    parts = [rows[:200], rows[200:330], rows[330:]]
    for part in parts:
        sent = part + part[: len(part) // 3]
        rng.shuffle(sent)
        write(spark, sent, LOG, path)
        found = keyed.run(keyed.lookback_alerts(stream(spark, LOG, path), RULES, "2 hours"), folder)
    write(spark, [(5000 + i, "LOGIN_FAILED", "late", None, START) for i in range(3)], LOG, path)
    last = max(ms(r[4]) for r in rows if r[1] in RULES)
    found = {tuple(r) for r in keyed.run(keyed.lookback_alerts(stream(spark, LOG, path), RULES, "2 hours"), folder).collect()}
    assert found == expected_alerts(rows, RULES, last - 2 * 3_600_000)
    write(spark, [(6000, "LOGIN_FAILED", "z", None, START + dt.timedelta(days=3))], LOG, path)
    found = [tuple(r) for r in keyed.run(keyed.lookback_alerts(stream(spark, LOG, path), RULES, "2 hours"), folder).collect()]
    assert len(found) == len(set(found)) and set(found) == expected_alerts(rows, RULES, 2**62)


STEPS = "process_id long, event_id long, status string, at timestamp"


def expected_watch(rows, before, seconds=45):
    out, by = set(), {}
    for p, i, status, at in {tuple(r) for r in rows}:
        by.setdefault(p, []).append((ms(at), i, status))
    for p, events in by.items():
        status, last, stale = "", None, False
        for t, _, what in [*sorted(events), (2**62, 0, None)]:
            active = status in ("PENDING", "EXTRACTING", "COMPARING")
            if active and not stale and t - last > seconds * 1000:
                stale = True
                out.add((p, "STALE", status, status, last + seconds * 1000))
            if what is None:
                break
            legal = active if what == "HEARTBEAT" else what in keyed.FOLLOWS.get(status, ()) or stale and status in ("EXTRACTING", "COMPARING") and what == "EXTRACTING"
            if not legal:
                out.add((p, "REFUSED", status, what, t))
                continue
            to = status if what == "HEARTBEAT" else what
            if stale or what != "HEARTBEAT":
                out.add((p, "RESUMED" if stale else "STEP", status, to, t))
            status, last, stale = to, t, False
    return {r for r in out if r[4] <= before}


def test_processes_of_a_stream(spark, tmp_path):
    rng, rows = random.Random(2), []
    for p in range(25):
        at, plan = START + dt.timedelta(seconds=rng.random() * 100), ["PENDING", "EXTRACTING", "HEARTBEAT", "HEARTBEAT", "COMPARING", "HEARTBEAT", rng.choice(["DONE", "FAILED", "HEARTBEAT"])]
        if p % 3 == 0:
            rng.shuffle(plan)
        if p % 4 == 0:
            plan += ["EXTRACTING", "HEARTBEAT", "PENDING"]
        for i, status in enumerate(plan):
            at += dt.timedelta(seconds=rng.choice([5, 20, 45, 46, 90]))
            rows.append((p, 100 * p + i, status, at))
    rows.sort(key=lambda r: r[3])
    path, folder = f"{tmp_path}/in", f"{tmp_path}/q"
    for part in (rows[:80], rows[80:]):
        sent = part + part[:20]
        rng.shuffle(sent)
        write(spark, sent, STEPS, path)
        keyed.run(keyed.watched(stream(spark, STEPS, path), late="3 minutes"), folder)
    write(spark, [(99, 1, "PENDING", START + dt.timedelta(hours=2))], STEPS, path)
    found = [tuple(r) for r in keyed.run(keyed.watched(stream(spark, STEPS, path), late="3 minutes"), folder).collect()]
    want = expected_watch(rows, 2**62)
    assert len(found) == len(set(found)) and set(found) == want and {r[1] for r in want} == {"STEP", "REFUSED", "STALE", "RESUMED"}


def started(spark, rows, folder):
    """Runs a stream until its source is read; the states that its batches left, as counted by Spark."""
    with keyed.keyed_state(spark):
        query = rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


def test_states_grow_with_buckets_not_with_processes(spark, tmp_path, monkeypatch):
    """What Spark calls Python for is a bucket; the processes in it stay apart, between restarts too."""
    monkeypatch.setattr(keyed, "BUCKETS", 3, raising=False)
    rng, rows = random.Random(7), []
    for p in range(600):
        at, plan = START + dt.timedelta(seconds=rng.randrange(40)), ["PENDING", "EXTRACTING", "HEARTBEAT", "COMPARING", rng.choice(["DONE", "FAILED"])]
        if p % 5 == 0:
            rng.shuffle(plan)
        for status in plan:
            at += dt.timedelta(seconds=rng.choice([0, 20, 45, 46]))
            rows.append((p, rng.randrange(3) if p % 7 else None, status, at))
    rows = [r for r in rows if r[3] <= START + dt.timedelta(seconds=170)]
    rows.sort(key=lambda r: r[3])
    path, folder, states = f"{tmp_path}/in", f"{tmp_path}/q", []
    for part in (rows[:1200], rows[1200:]):
        sent = part + part[:100]
        rng.shuffle(sent)
        write(spark, sent, STEPS, path)
        states += started(spark, keyed.watched(stream(spark, STEPS, path), late="4 minutes"), folder)
    write(spark, [(9999, 1, "PENDING", START + dt.timedelta(hours=2))], STEPS, path)
    states += started(spark, keyed.watched(stream(spark, STEPS, path), late="4 minutes"), folder)
    found = [tuple(r) for r in spark.read.parquet(f"{folder}/table").collect()]
    assert len(found) == len(set(found)) and set(found) == expected_watch([(p, -1 if i is None else i, s, at) for p, i, s, at in rows], 2**62)
    assert 0 < max(states) < 100


def test_alerts_of_actors_in_one_bucket(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 1, raising=False)
    rows = [(i, kind, f"{actor}{n}", entity, at) for n in range(9) for i, kind, actor, entity, at in log]
    path, folder = f"{tmp_path}/in", f"{tmp_path}/q"
    write(spark, rows, LOG, path)
    write(spark, [(6000, "LOGIN_FAILED", "z", None, START + dt.timedelta(days=3))], LOG, path)
    states = started(spark, keyed.lookback_alerts(stream(spark, LOG, path), RULES, "2 hours"), folder)
    found = [tuple(r) for r in spark.read.parquet(f"{folder}/table").collect()]
    assert len(found) == len(set(found)) and set(found) == expected_alerts(rows, RULES, 2**62)
    assert 0 < max(states) < 20
