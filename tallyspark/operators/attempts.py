"""Attempts at reading a registry, document openings and what is told of how sources were read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.operators import ops

#: The events of an attempt.
STARTED, FINISHED, FAILED = "DEVELOPMENT_EXTRACTION_STARTED", "DEVELOPMENT_EXTRACTION_FINISHED", "DEVELOPMENT_EXTRACTION_FAILED"


def attempts(events: DataFrame) -> DataFrame:
    """(upload, attempt, started_at, ended_at, outcome, stage, page_count, duration_ms) of each attempt at each upload.

    events: (event_id, upload, event_type, created_at, stage, page_count). An end
    belongs to the latest start before it that has no end yet. FINISHED and
    FAILED attempts have ended, a start that another one follows without an end
    is REPEATED, the last one without an end is OPEN. An end without a start (an
    upload that is refused at once, a sheet that is read at once) is an attempt
    without one. Events of one moment go by their id; repeated ones count once.

    One shuffle, by upload: both windows and the aggregate share it.
    """
    kept = events.where(F.col("event_type").isin(STARTED, FINISHED, FAILED) & F.col("upload").isNotNull()).dropDuplicates(["upload", "event_id"])
    of_upload = Window.partitionBy("upload").orderBy("created_at", "event_id")
    start = F.col("event_type") == STARTED
    placed = kept.withColumn("round", F.sum(start.cast("int")).over(of_upload))
    placed = placed.withColumn("last_round", F.max("round").over(Window.partitionBy("upload")))
    of_round = Window.partitionBy("upload", "round").orderBy("created_at", "event_id")
    # Within a round the first end is the start's; others, and all before the first start, stand alone.
    placed = placed.withColumn("nth_end", F.sum((~start).cast("int")).over(of_round))
    alone = ~start & ((F.col("round") == 0) | (F.col("nth_end") > 1))
    placed = placed.withColumn("single", F.when(alone, F.col("event_id")))
    end = F.when(~start, F.struct("created_at", "event_type", "stage", "page_count"))
    each = placed.groupBy("upload", "round", "single").agg(
        F.max(F.when(start, F.col("created_at"))).alias("started_at"), F.max(end).alias("e"), F.max(F.when(start, F.struct("stage", "page_count"))).alias("s"), F.max("last_round").alias("last_round"), F.min(F.struct("created_at", "event_id")).alias("first")
    )
    outcome = F.when(F.col("e").isNotNull(), F.when(F.col("e.event_type") == FINISHED, "FINISHED").otherwise("FAILED")).when(F.col("round") < F.col("last_round"), "REPEATED").otherwise("OPEN")
    span = F.unix_millis(F.col("e.created_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    number = F.row_number().over(Window.partitionBy("upload").orderBy("first"))
    return each.select("upload", number.alias("attempt"), "started_at", F.col("e.created_at").alias("ended_at"), outcome.alias("outcome"), F.coalesce("e.stage", "s.stage").alias("stage"), F.coalesce("e.page_count", "s.page_count").alias("page_count"), span.alias("duration_ms"))


def attempt_totals(found: DataFrame) -> DataFrame:
    """(outcome, stage, n, mean_ms): where attempts end, and how long those took that began."""
    return found.groupBy("outcome", "stage").agg(F.count("*").alias("n"), F.floor(F.avg("duration_ms")).alias("mean_ms"))


#: What is told of a document that can't be opened.
PURGED, MISSING, UNKNOWN = "Arquivo original removido após o período de retenção de 40 dias.", "O arquivo original não está disponível.", "Processo não encontrado."


def opened(requests: DataFrame, processes: DataFrame, documents: DataFrame, viewer: dict) -> DataFrame:
    """requests (request_id, process_id, document_id) with the storage_path that may be opened, or the message why not.

    A process must be visible to the viewer (ops.visible()), and the document be
    of it and of the viewer's organisation.
    """
    seen = ops.visible(processes, viewer).select("process_id").distinct().withColumn("seen", F.lit(True))
    held = documents.where(F.col("organization_id") == viewer["organization_id"]).select("process_id", "document_id", "storage_path", "purged_at")
    each = requests.join(seen, "process_id", "left").join(held, ["process_id", "document_id"], "left")
    message = F.when(F.col("seen").isNull(), UNKNOWN).when(F.col("storage_path").isNull() | (F.col("storage_path") == ""), F.when(F.col("purged_at").isNotNull(), PURGED).otherwise(MISSING))
    return each.withColumn("message", message).select("request_id", "process_id", "document_id", F.when(F.col("message").isNull(), F.col("storage_path")).alias("storage_path"), "message")


def opening_events(found: DataFrame, viewer: dict) -> DataFrame:
    """The audit log's row for each document that opened() lets through."""
    return found.where("message is null").select(
        F.lit(viewer["organization_id"]).cast("long").alias("organization_id"), F.lit(str(viewer["user_id"])).alias("actor_id"), F.lit("DOCUMENT_VIEWED").alias("event_type"), F.lit("process_document").alias("entity_type"), F.col("document_id").alias("entity_id"), "process_id"
    )


def method_notices(reports: DataFrame) -> DataFrame:
    """(process_id, notice) of reports (process_id, source_ord, source, status, error, method): a line for each source that failed with a reason, else which sources had to be read as images."""
    labels = catalog.constant_map(catalog.SOURCES)
    failed = (F.col("status") == "FAILED") & (F.coalesce("error", F.lit("")) != "")
    seen = F.col("method").isin("OCR", "MIXED")
    name = F.element_at(labels, F.col("source"))
    ordered = lambda cond, text: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("source_ord", text.alias("t"))))), lambda x: x["t"])
    per = reports.groupBy("process_id").agg(ordered(failed, F.concat(name, F.lit(": "), "error")).alias("errors"), ordered(seen, name).alias("images"))
    # Fixed value: the notice's wording.
    told = F.concat(F.array_join("images", ", "), F.lit(" exigiu OCR porque o PDF tinha pouco ou nenhum texto selecionável."))
    return per.where((F.size("errors") > 0) | (F.size("images") > 0)).select("process_id", F.when(F.size("errors") > 0, F.array_join("errors", "\n")).otherwise(told).alias("notice"))
