"""Tables that micro-batches keep current: upserts by key, or an append-only log.

A batch is written into a folder of its own and then published by one rename of
a small file named after it; readers see whole batches. A batch that is sent
again under its number is left alone, and what a failed attempt wrote is never
read. Batches hold changes alone, so an upsert costs what it brings; reading
combines the base with the batches since, by key, and fold() makes them the new
base. A table has one writer at a time, as a streaming query is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.sources.storage import Folder

#: Batches that may lie beside the base before a batch folds them.
FOLD_AFTER = 50


class KeptTable:
    """A table in a folder that driver and executors share.

    keys name what a row is of; without keys rows are only appended. Columns in
    counted are added up over all batches, and those in least or most keep the
    smallest or largest value; the others are those of the newest row, by order
    (columns of the rows, the batch decides before them).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = (), counted: tuple[str, ...] = (), least: tuple[str, ...] = (), most: tuple[str, ...] = (), order: tuple[str, ...] = (), fold_after: int = FOLD_AFTER):
        self.spark, self.path, self.keys, self.counted, self.least, self.most, self.order, self.fold_after = spark, path.rstrip("/"), keys, counted, least, most, order, fold_after
        self.schema = spark.createDataFrame([], schema).schema
        self.files = Folder(spark, self.path)

    def _state(self) -> tuple[dict, dict[int, str]]:
        """The newest fold, and the folders of the batches after it: one listing and at most fold_after small files."""
        names = self.files.names("commits")
        folds = [n for n in names if n.startswith("fold-") and n.endswith(".json")]
        fold = json.loads(self.files.text(f"commits/{folds[-1]}")) if folds else {"upto": -1, "folders": []}
        numbers = [int(n[6:18]) for n in names if n.startswith("batch-") and n.endswith(".json")]
        return fold, {n: self.files.text(f"commits/batch-{n:012d}.json") for n in numbers if n > fold["upto"]}

    def _rows(self, folders: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_batch", T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def _combined(self, rows: DataFrame) -> DataFrame:
        """Sums, extremes and the newest of the rest are aggregates, so they combine before the shuffle."""
        if not self.keys:
            return rows
        plain = [c for c in self.schema.names if c not in (*self.keys, *self.counted, *self.least, *self.most)]
        found = [F.sum(c).alias(c) for c in self.counted] + [F.min(c).alias(c) for c in self.least] + [F.max(c).alias(c) for c in self.most]
        # All of a row decides in the end, so ties are settled alike in every run.
        found.append(F.max_by(F.struct("_batch", *plain), F.struct("_batch", *self.order, *plain)).alias("_newest"))
        merged = rows.groupBy(*self.keys).agg(*found)
        return merged.select(*[F.col(f"_newest.{c}" if c in plain else c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names], "_newest._batch")

    def rows(self) -> DataFrame:
        """The table as it stands: all published batches."""
        fold, batches = self._state()
        return self._combined(self._rows([*fold["folders"], *batches.values()])).drop("_batch")

    def put(self, df: DataFrame, batch: int) -> bool:
        """Publishes the rows of df as a batch, combined by key; False where that batch is in already. Batches come in ascending numbers, as a streaming query's do."""
        fold, batches = self._state()
        if batch in batches or batch <= fold["upto"]:
            return False
        folder = f"{batch:012d}-{uuid.uuid4().hex}"
        self._combined(df.select(*self.schema.names).withColumn("_batch", F.lit(batch).cast("long"))).write.parquet(f"{self.path}/data/{folder}")
        done = self.files.publish(f"commits/batch-{batch:012d}.json", folder)
        if len(batches) + 1 >= self.fold_after:
            self.fold()
        return done

    def fold(self) -> None:
        """Puts the batches into one folder: with keys together with the base, which they replace; of a log by themselves."""
        fold, batches = self._state()
        if not batches:
            return
        upto, base = max(batches), fold["folders"] if self.keys else []
        folder = f"{upto:012d}-fold-{uuid.uuid4().hex}"
        self._combined(self._rows([*base, *batches.values()])).write.parquet(f"{self.path}/data/{folder}")
        self.files.publish(f"commits/fold-{upto:012d}.json", json.dumps({"upto": upto, "folders": [folder] if self.keys else [*fold["folders"], folder]}))
        self._prune(fold)

    def _prune(self, fold: dict) -> None:
        """Deletes what the fold before this one had replaced, and what attempts that failed before it left: its readers have had a whole fold's time."""
        now, _ = self._state()
        names = [n for n in self.files.names("commits") if n.endswith(".json")]
        old = [n for n in names if n.startswith("batch-") and int(n[6:18]) <= fold["upto"]] + [n for n in names if n.startswith("fold-") and int(n[5:17]) < fold["upto"]]
        kept = {*now["folders"], *fold["folders"]}
        gone = [n for n in self.files.names("data") if int(n[:12]) <= fold["upto"] and n not in kept]
        for n in [f"commits/{n}" for n in old] + [f"data/{n}" for n in gone]:
            self.files.delete(n)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Puts a stream's micro-batches into the table until the source is read; a second call goes on from there."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: self.put(df, batch) and None).start()
        query.awaitTermination()


def learned_rules(spark: SparkSession, path: str, **more) -> KeptTable:
    """Rules that reviewers have approved, by organisation, field and signature: how often, with the example, process and reviewer of the newest approval."""
    schema = "organization_id long, field_id string, signature string, rule_kind string, occurrence_count long, example string, last_process_id long, last_reviewer_id long, created_at timestamp, updated_at timestamp"
    return KeptTable(spark, path, schema, ("organization_id", "field_id", "signature"), ("occurrence_count",), ("created_at",), ("updated_at",), ("last_process_id",), **more)


def approvals(reviews: DataFrame) -> DataFrame:
    """Approved reviews (organization_id, field_id, signature, rule_kind, example, process_id, reviewer_id, at) as rows of learned_rules(): each counts once."""
    return reviews.where("signature is not null and signature <> ''").select(
        "organization_id", "field_id", "signature", "rule_kind", F.lit(1).cast("long").alias("occurrence_count"), "example", F.col("process_id").alias("last_process_id"), F.col("reviewer_id").alias("last_reviewer_id"), F.col("at").alias("created_at"), F.col("at").alias("updated_at")
    )


def audit_log(spark: SparkSession, path: str, **more) -> KeptTable:
    """The audit log: rows are appended and never change."""
    return KeptTable(spark, path, "organization_id long, actor_id string, event_type string, entity_type string, entity_id string, created_at timestamp, metadata string", **more)
