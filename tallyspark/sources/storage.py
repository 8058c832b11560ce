"""Shared folders, and this package on executors: what operators with Python workers or kept tables need."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application once, so that functions sent to executors resolve on machines without a checkout."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark-engine.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, f"tallyspark/{p.relative_to(package)}")
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode (tests) gets one of its own; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key over the session's shuffle partitions, for work on each row that costs much more than moving it. A small table lies in one file, often in one row group, which one task reads; its rows are then read as texts, or multiplied, by that task alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Small files of a folder through Spark's file systems, without a job."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.jvm, self.path = jvm, path.rstrip("/")
        self.fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder) if folder else self.jvm.org.apache.hadoop.fs.Path(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file under another name and renames it: readers see all of it or none. False where the name is taken."""
        staged = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(staged)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self._at(name)
        if not self.fs.exists(target) and self.fs.rename(staged, target):
            return True
        self.fs.delete(staged, False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
