"""Registered queries of keyed streams and kept tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import ops
from tallyspark.sources import adapters as a
from tallyspark.sources import kept, storage
from tallyspark.streaming import keyed


def _source(spark, sf_dir: str, table: str, mapping: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """A mapping over a table that is read as a stream, and tables beside it."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parquet*")
    return spark.sql(mapping, **{table: stream}, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in beside})


def _own_clock(df: DataFrame, column: str) -> DataFrame:
    """Moments of the table's own clock, whatever the session's time zone is."""
    return df.withColumn(column, F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def stream_lookback_alerts(spark, sf_dir):
    """Alerts raised and lapsed over the audit log, by the fixed thresholds, run until the log is read."""
    log = _own_clock(_source(spark, sf_dir, "events", a.BURSTS), "created_at")
    return keyed.run(keyed.lookback_alerts(log), storage.new_path(spark, "lookback"))


def lookback_alerts(spark, sf_dir):
    """The same of the whole log as a table."""
    return keyed.lookback_changes(_own_clock(a.read(spark, sf_dir, a.BURSTS), "created_at"))


def stream_process_watch(spark, sf_dir):
    """Steps, refused steps, silences and returns of processes, run until their signs are read."""
    signs = _own_clock(_source(spark, sf_dir, "orders", a.SIGNS), "told_at").withColumnRenamed("told_at", "at")
    return keyed.run(keyed.watched(signs), storage.new_path(spark, "watch"))


def stream_rules_kept(spark, sf_dir):
    """The table of learned rules, kept by a stream of approved reviews and folded once."""
    reviews = _own_clock(_source(spark, sf_dir, "orders", a.APPROVED, ("customer",)), "at")
    folder = storage.new_path(spark, "rules")
    table = kept.learned_rules(spark, f"{folder}/table")
    table.follow(kept.approvals(reviews), f"{folder}/state")
    table.fold()
    plain = lambda c: F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").alias(c)
    return table.rows().select("organization_id", "field_id", "signature", "rule_kind", "occurrence_count", "example", "last_process_id", "last_reviewer_id", plain("created_at"), plain("updated_at"))


def stream_audit_kept(spark, sf_dir):
    """The audit log that a stream of reviews appends to."""
    log = ops.review_events(_source(spark, sf_dir, "labels", a.REVIEW_LOG))
    folder = storage.new_path(spark, "audit")
    table = kept.audit_log(spark, f"{folder}/table")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    table.follow(log.select(none("organization_id", "long"), "actor_id", "event_type", "entity_type", "entity_id", none("created_at", "timestamp"), none("metadata", "string")), f"{folder}/state")
    return table.rows().select("actor_id", "event_type", "entity_type", "entity_id")


_CHANGES = f"""
WITH e AS (
  SELECT event_type, CASE WHEN event_type = 'DOCUMENT_RETENTION_FAILED' THEN 'retention' ELSE coalesce(CAST(actor_id AS VARCHAR), entity_id, 'unknown') END AS actor, event_id, epoch_us(created_at) // 1000 AS ms
  FROM {a.duck(a.BURSTS)} AS b WHERE event_type IN ('LOGIN_FAILED', 'DOCUMENT_VIEWED', 'PROCESS_CREATED', 'DOCUMENT_RETENTION_FAILED')),
w AS (SELECT *, CASE event_type WHEN 'LOGIN_FAILED' THEN lag(ms, 2) OVER k + 900000 WHEN 'DOCUMENT_VIEWED' THEN lag(ms, 49) OVER k + 3600000 WHEN 'PROCESS_CREATED' THEN lag(ms, 24) OVER k + 3600000 ELSE ms + 86400000 END AS until
  FROM e WINDOW k AS (PARTITION BY event_type, actor ORDER BY ms, event_id)),
held AS (SELECT * FROM w WHERE ms <= until),
f AS (SELECT *, CASE WHEN ms <= lag(until) OVER (PARTITION BY event_type, actor ORDER BY ms, event_id) THEN 0 ELSE 1 END AS fresh FROM held),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, actor ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS alert FROM f),
g AS (SELECT event_type, actor, alert, min(ms) AS since, max(until) AS until, count(*) AS m, CASE event_type WHEN 'LOGIN_FAILED' THEN 3 WHEN 'DOCUMENT_VIEWED' THEN 50 WHEN 'PROCESS_CREATED' THEN 25 ELSE 1 END AS least FROM i GROUP BY event_type, actor, alert),
c AS (SELECT event_type, actor, 'RAISED' AS change, since AS ms, CAST(least AS BIGINT) AS n FROM g UNION ALL SELECT event_type, actor, 'LAPSED', until, CAST(least + m - 1 AS BIGINT) FROM g)
"""

_WATCH = f"""
WITH RECURSIVE s AS (SELECT *, epoch_us(told_at) // 1000 AS ms FROM {a.duck(a.SIGNS)} AS x),
o AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY ms, event_id, status) AS nth FROM s),
follows(before, after) AS (VALUES ('', 'PENDING'), ('PENDING', 'EXTRACTING'), ('PENDING', 'FAILED'), ('EXTRACTING', 'COMPARING'), ('EXTRACTING', 'DONE'), ('EXTRACTING', 'FAILED'), ('COMPARING', 'DONE'), ('COMPARING', 'FAILED')),
r AS (
  SELECT DISTINCT process_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS ms, '' AS before, '' AS status, CAST(NULL AS BIGINT) AS last, false AS ok, false AS stale, '' AS what FROM o
  UNION ALL
  SELECT process_id, nth, ms, before, CASE WHEN ok AND what <> 'HEARTBEAT' THEN what ELSE before END, CASE WHEN ok THEN ms ELSE last END, ok, stale, what FROM (
    SELECT o.process_id, o.nth, o.ms, r.status AS before, r.last, o.status AS what, r.status IN ('PENDING', 'EXTRACTING', 'COMPARING') AND o.ms - r.last > 45000 AS stale,
      (o.status = 'HEARTBEAT' AND r.status IN ('PENDING', 'EXTRACTING', 'COMPARING')) OR f.after IS NOT NULL
        OR (o.status = 'EXTRACTING' AND r.status IN ('EXTRACTING', 'COMPARING') AND o.ms - r.last > 45000) AS ok
    FROM r JOIN o ON o.process_id = r.process_id AND o.nth = r.nth + 1 LEFT JOIN follows AS f ON f.before = r.status AND f.after = o.status) AS t),
kept AS (SELECT *, lead(ms) OVER (PARTITION BY process_id ORDER BY nth) AS following FROM r WHERE ok),
c AS (
  SELECT process_id, CASE WHEN NOT ok THEN 'REFUSED' WHEN stale THEN 'RESUMED' ELSE 'STEP' END AS change, before, CASE WHEN ok THEN status ELSE what END AS after, ms FROM r WHERE nth > 0 AND (NOT ok OR stale OR what <> 'HEARTBEAT')
  UNION ALL SELECT process_id, 'STALE', status, status, ms + 45000 FROM kept WHERE status IN ('PENDING', 'EXTRACTING', 'COMPARING') AND (following IS NULL OR following - ms > 45000))
SELECT * FROM c WHERE ms <= (SELECT max(ms) - 60000 FROM s)
"""

QUERIES = {f.__name__: f for f in (stream_lookback_alerts, lookback_alerts, stream_process_watch, stream_rules_kept, stream_audit_kept)}
ORACLE = {
    "lookback_alerts": _CHANGES + "SELECT * FROM c",
    # What the stream has told is what lies behind its last watermark, two hours before the newest event.
    "stream_lookback_alerts": _CHANGES + "SELECT * FROM c WHERE ms <= (SELECT max(ms) - 7200000 FROM e)",
    "stream_process_watch": _WATCH,
    "stream_rules_kept": f"""SELECT organization_id, field_id, signature, any_value(rule_kind) AS rule_kind, count(*) AS occurrence_count, arg_max(example, process_id) AS example, max(process_id) AS last_process_id, arg_max(reviewer_id, process_id) AS last_reviewer_id,
        CAST(min(at_) AS TIMESTAMP) AS created_at, CAST(max(at_) AS TIMESTAMP) AS updated_at FROM {a.duck(a.APPROVED).replace("AS at", "AS at_")} AS x WHERE signature <> '' GROUP BY organization_id, field_id, signature""",
    "stream_audit_kept": f"SELECT CAST(reviewer_id AS VARCHAR) AS actor_id, CASE WHEN action = 'REVOKED' THEN 'REVIEW_REVOKED' ELSE 'REVIEW_APPROVED' END AS event_type, 'validation_result' AS entity_type, CAST(process_id AS VARCHAR) || ':' || field_id AS entity_id FROM {a.duck(a.REVIEW_LOG)} AS x",
}
