"""Operations: visibility, metrics, anomalies, alerts, retention and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import reconcile

APPROVED = "FULLY_CHECKED"


def visible(rows: DataFrame, viewer: dict) -> DataFrame:
    """Rows a profile may see: a master all, an administrator those of the organisation, others their own. A predicate, so it reaches the scan."""
    if viewer["is_master"]:
        return rows
    rows = rows.where(F.col("organization_id") == viewer["organization_id"])
    return rows if viewer["role"] == "ADMIN" else rows.where(F.col("user_id") == viewer["user_id"])


def dashboard(processes: DataFrame, keys: list[str]) -> DataFrame:
    """processes (final_status, minutes, n_documents): active, documents of finished ones, pending, approval in per cent, average minutes."""
    finished = ~F.col("final_status").isin("IN_PROGRESS", "FAILED")
    n, ok = F.count_if(finished), F.count_if(F.col("final_status") == APPROVED)
    return processes.groupBy(*keys).agg(
        F.count_if(F.col("final_status") == "IN_PROGRESS").alias("active"), F.coalesce(F.sum(F.when(finished, F.col("n_documents"))), F.lit(0)).alias("documents"),
        F.count_if(F.col("final_status") == "PENDING_REVIEW").alias("pending"), F.when(n > 0, F.floor((ok * 200 + n) / (n * 2))).otherwise(0).cast("int").alias("approval"),
        F.coalesce(F.floor(F.sum(F.when(finished, F.col("minutes"))) * 60 / F.nullif(n, F.lit(0))), F.lit(0)).cast("long").alias("average_seconds"),
    )


def anomaly() -> Column:
    """The first finding of a process, or null. Columns n_documents, final_status, minutes (null where the end is before the start), alert (the severity of its extraction alert, or null)."""
    return F.when(F.col("minutes").isNotNull(), (
        F.when(F.col("n_documents") == 0, "NO_DOCUMENTS").when(F.col("final_status") == "FAILED", "FAILED").when((F.col("final_status") == "IN_PROGRESS") & (F.col("minutes") >= 30), "STUCK")
        .when(F.col("alert").isNotNull(), F.concat(F.lit("EXTRACTION_"), F.upper("alert"))).when((F.col("minutes") >= 10) & (F.col("final_status") == "IN_PROGRESS"), "SLOW_RUNNING").when(F.col("minutes") >= 10, "SLOW_DONE")
    ))


#: Events of one actor that raise an alert: minutes to look back, and the least number.
ALERT_RULES = {"LOGIN_FAILED": (15, 3), "DOCUMENT_VIEWED": (60, 50), "PROCESS_CREATED": (60, 25)}
RETENTION_FAILURE, RETENTION_MINUTES = "DOCUMENT_RETENTION_FAILED", 24 * 60


def alerts(events: DataFrame, now: str, rules: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(event_type, actor, n): actors at or over a rule's number of events in its minutes before now, and one row where retention failed in the last day.

    An event without an actor counts for its entity, and without both for `unknown`. One pass: each event is held to the rule of its own kind.
    """
    rules = rules or ALERT_RULES
    at = F.lit(now).cast("timestamp")
    of = F.create_map(*[F.lit(x) for k, v in (rules | {RETENTION_FAILURE: (RETENTION_MINUTES, 1)}).items() for x in (k, v[0])])
    least = F.create_map(*[F.lit(x) for k, v in rules.items() for x in (k, v[1])])
    since = at - F.make_dt_interval(mins=F.element_at(of, F.col("event_type")))
    recent = events.where(F.col("event_type").isin(*rules, RETENTION_FAILURE) & (F.col("created_at") <= at)).where(F.col("created_at") >= since)
    failed = F.col("event_type") == RETENTION_FAILURE
    actor = F.when(failed, "retention").otherwise(F.coalesce(F.col("actor_id").cast("string"), F.col("entity_id").cast("string"), F.lit("unknown")))
    found = recent.groupBy("event_type", actor.alias("actor")).agg(F.count("*").alias("n"))
    return found.where(failed | (F.col("n") >= F.try_element_at(least, F.col("event_type"))))


def retention_batch(documents: DataFrame, now: str, days: int = 40, batch: int = 100) -> DataFrame:
    """The oldest stored documents past the cutoff that aren't purged yet: one batch."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    due = documents.where(F.col("storage_path").isNotNull() & F.col("purged_at").isNull() & (F.col("created_at") <= cutoff))
    return due.orderBy("created_at", *[c for c in documents.columns if c != "created_at"]).limit(batch)


def retention_outcome(batch: DataFrame, now: str, error: str | None = None) -> DataFrame:
    """The batch's documents after their files were removed (error is None) or weren't: marked as purged with the reason, or with one more attempt and the error."""
    text = lambda v: F.lit(v).cast("string")
    if error is None:
        return batch.withColumns({"storage_path": text(None), "purged_at": F.lit(now).cast("timestamp"), "purge_reason": text("RETENTION_40_DAYS"), "purge_error": text(None)})
    return batch.withColumns({"purge_attempts": F.col("purge_attempts") + 1, "purge_reason": text(None), "purge_error": text(error[:1000])})


def retention_events(batch: DataFrame, error: str | None = None) -> DataFrame:
    """An audit row for each organisation of the batch."""
    kind = "DOCUMENTS_PURGED" if error is None else RETENTION_FAILURE
    return batch.groupBy("organization_id").agg(F.count("*").alias("count")).select("organization_id", F.lit(None).cast("string").alias("actor_id"), F.lit(kind).alias("event_type"), F.lit("document_retention").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"), "count")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: the row of the largest order for each key. An aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put over those of equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def review_state(log: DataFrame) -> DataFrame:
    """(process_id, field_id, status, reviewer_id) from the log of reviews (seq: their order): the last word on each field, without those that were taken back."""
    last = latest(log, ["process_id", "field_id"], ["seq", "action"])
    return last.where("action != 'REVOKED'").select("process_id", "field_id", F.col("action").alias("status"), "reviewer_id")


def review_events(log: DataFrame) -> DataFrame:
    """What the audit log says of each review."""
    kind = F.when(F.col("action") == "REVOKED", "REVIEW_REVOKED").otherwise("REVIEW_APPROVED")
    return log.select(F.col("reviewer_id").cast("string").alias("actor_id"), kind.alias("event_type"), F.lit("validation_result").alias("entity_type"), F.concat_ws(":", F.col("process_id").cast("string"), "field_id").alias("entity_id"))


def final_status(verdicts: DataFrame, reviews: DataFrame) -> DataFrame:
    """(process_id, final_status): checked where every verdict that is no match has an approved review of its own field."""
    each = reconcile.reviewed(verdicts, reviews)
    pending = F.bool_or((F.col("status") != "MATCH") & ~F.col("approved"))
    return each.groupBy("process_id").agg(F.when(pending, "PENDING_REVIEW").otherwise(APPROVED).alias("final_status"))


def persisted(processes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Processes (process_id, status, updated_at) as they are stored: final_status from the lifecycle and the verdicts, completed_at where they are over."""
    per = verdicts.groupBy("process_id").agg(F.bool_or(F.col("status") != "MATCH").alias("open"))
    each = processes.join(per, "process_id", "left")
    status = F.when(F.col("status") == "FAILED", "FAILED").when((F.col("status") != "DONE") | F.col("open").isNull(), "IN_PROGRESS").when(F.col("open"), "PENDING_REVIEW").otherwise(APPROVED)
    return each.withColumns({"final_status": status, "completed_at": F.when(F.col("status").isin("DONE", "FAILED"), F.col("updated_at"))}).drop("open")


def lifecycle(events: DataFrame) -> DataFrame:
    """(process_id, status, updated_at): the state a process is in by its events (status, at); a later state of the same moment counts, and nothing follows the end."""
    # The states in their order.
    order = F.array(*map(F.lit, ["PENDING", "EXTRACTING", "COMPARING", "DONE", "FAILED"]))
    stamped = events.withColumn("step", F.array_position(order, F.col("status")).cast("int")).where("step > 0")
    over = F.col("step") >= 4
    best = F.struct(over.alias("over"), F.when(over, -F.unix_micros("at")).otherwise(F.unix_micros("at")).alias("when"), "step")
    return stamped.groupBy("process_id").agg(F.max_by(F.struct("status", F.col("at").alias("updated_at")), best).alias("s")).select("process_id", "s.*")


def admin_metrics(processes: DataFrame) -> DataFrame:
    """One row: processes by status and their documents. What has run for 30 minutes or more is stuck, and isn't in progress."""
    running = (F.col("final_status") == "IN_PROGRESS") & (F.col("minutes") < 30)
    finished = F.col("final_status") != "IN_PROGRESS"  # failed ones were analysed too
    docs = lambda c: F.coalesce(F.sum(F.when(c, F.col("n_documents"))), F.lit(0))
    count = lambda s: F.count_if(F.col("final_status") == s)
    return processes.agg(
        F.count_if(running).alias("in_progress"), count("PENDING_REVIEW").alias("pending"), count(APPROVED).alias("checked"), count("FAILED").alias("failed"),
        docs(running).alias("documents_in_progress"), docs(finished).alias("documents_analysed"), docs(F.lit(True)).alias("documents_total"),
    )


def login_limits(events: DataFrame, now: str, minutes: int = 15, most: int = 8) -> DataFrame:
    """(actor_id, n, limited): failed logins in the minutes before now, and whether they block the next one."""
    at = F.lit(now).cast("timestamp")
    recent = events.where((F.col("event_type") == "LOGIN_FAILED") & (F.col("created_at") >= at - F.expr(f"interval {minutes} minutes")) & (F.col("created_at") <= at))
    return recent.groupBy("actor_id").agg(F.count("*").alias("n")).select("actor_id", "n", (F.col("n") >= most).alias("limited"))


def stale(processes: DataFrame, now: str, seconds: int = 45) -> DataFrame:
    """Unfinished processes (column updated_at) without a heartbeat for so long: they may be resumed."""
    return processes.where((F.col("final_status") == "IN_PROGRESS") & (F.col("updated_at") <= F.lit(now).cast("timestamp") - F.expr(f"interval {seconds} seconds")))


def recent_processes(processes: DataFrame, status: str | None = None, user_id: int | None = None, top: int = 100) -> DataFrame:
    """The latest processes, of one status or one analyst where asked."""
    for column, wanted in (("final_status", status), ("user_id", user_id)):
        processes = processes if wanted is None else processes.where(F.col(column) == wanted)
    return processes.orderBy(F.desc("started_at"), "process_id").limit(top)


def review_progress(verdicts: DataFrame, reviews: DataFrame) -> DataFrame:
    """(process_id, total, reviewed, unresolved, checked_percent): an approved review settles the verdict of its field."""
    each = reconcile.reviewed(verdicts, reviews)
    is_open = F.col("status") != "MATCH"
    per = each.groupBy("process_id").agg(F.count("*").alias("total"), F.count_if(is_open & F.col("approved")).alias("reviewed"), F.count_if(is_open & ~F.col("approved")).alias("unresolved"))
    share = F.floor(((F.col("total") - F.col("unresolved")) * 200 + F.col("total")) / (F.col("total") * 2)).cast("int")
    return per.select("process_id", "total", "reviewed", "unresolved", share.alias("checked_percent"))


def with_documents(processes: DataFrame, profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """Processes with the analyst's role and their documents nested, in order of creation."""
    rest = [c for c in documents.columns if c not in ("process_id", "created_at")]
    nested = documents.groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("created_at", *rest))).alias("documents"))
    return processes.join(profiles.select("user_id", "role"), "user_id", "left").join(nested, "process_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast(nested.schema["documents"].dataType)))


def upload_documents(stored: DataFrame, sent: DataFrame) -> DataFrame:
    """Document rows with those sent put over them by id."""
    return merge(stored, sent, ["document_id"])


def slowest(processes: DataFrame, top: int = 12) -> DataFrame:
    """The processes with a finding that took longest."""
    return processes.where("finding is not null").orderBy(F.desc("minutes"), "process_id").limit(top)


def new_uploads(uploads: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Uploads whose keys (name and size, say) aren't known yet, one of each."""
    return uploads.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)
