"""What the operators share: reading tables, shared storage, shipping code."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of text stay small, because one text may have many thousand words.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with more than this part of all rows is hot; fewer than so many keys can be.
HOT = 1000

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches (ARROW_CONF; Spark has no such setting for one query) and makes this package importable on executors.

    The package is added to the application as a zip file once, so that
    functions given to ``mapInArrow`` resolve on machines without a checkout.
    """
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, f"tallyspark/{p.relative_to(package)}")
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode (tests) gets a folder of its own; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext.getCheckpointDir()
        if not have:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-shared-"))
            have = spark.sparkContext.getCheckpointDir()
        found = have
    return found.rstrip("/")


_open: list[list[str]] = []
#: Where stored() put the tables that are still in use.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which an open scratch() deletes at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what operators stored inside it. For callers that have written their result by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: it cuts the lineage, and lost executors cost no recomputation. codec: a Parquet codec other than the session's."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def freed(*tables: DataFrame) -> None:
    """Deletes tables as stored() gave them, which nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, _places.pop(df))


def hot_join(rows: DataFrame, lookup: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """rows joined with lookup by keys. Where lookup says hot, which fewer than HOT keys may, it is broadcast, and those rows stay where they are."""
    sent = F.broadcast(lookup.where(hot))
    cold = rows.join(F.broadcast(lookup.where(hot).select(*keys).distinct()), keys, "left_anti")
    return rows.join(sent, keys).unionByName(cold.join(lookup.where(~hot), keys))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """Lower-cases A-Z alone. Pure ASCII takes the short way, which gives the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(text: str = "text") -> Column:
    """With doc_id it tells rows apart that repeat an id with other text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def carried(df: DataFrame, text: str = "text") -> tuple[Column, list[Column]]:
    """All columns of df but the text as one struct, and what selects df's columns back from it and text: whatever their names are, they can't clash with an operator's own."""
    rest = [c for c in df.columns if c != text]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("whole")
    return whole, [F.col(text) if c == text else F.col(f"whole.`{c}`") for c in df.columns]
