"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed rows: an
insert adds a document and its tokens, a delete takes them off, and a revised
count takes the old ones off and adds the new. A batch is aggregated and written
under a name of its own attempt; one rename of a small file, commits/<batch id>,
which names that attempt, publishes it. Until then no reader sees it, so a
failed attempt leaves nothing behind but files that nobody reads. A batch id
that is committed already is left as it is, whatever comes with it again.

fold() adds what is committed to the rollup of totals, a table of a row for each
key, published in the same way; readers then add only the batches since. Its
batches' ids go to a table of taken ids, by which commits know them, and their
commit files go: what a reader or a fold looks at is as long as the batches
since the last folds, not as the history. Small files are read through the file
system, without a job. One writer at a time works on a rollup; readers may come
at any time.
"""

from __future__ import annotations

import uuid
from functools import partial

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import delete, prepare, shared_path, stored, table
from tallyspark.llm.packing import default_tokenizer, encoder
from tallyspark.sources.storage import Folder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(events: DataFrame) -> DataFrame:
    """Rows of KEYS, n_docs and n_tokens from events (op, source, lang, tokenizer, tokens, old_tokens).

    op is insert, delete (tokens are those it had) or revise. An event stands
    for one document, or for as many as a column docs says, and its counts are
    their sums. A null count is 0, null docs are 1; null keys are values of
    their own. Other ops are an error.
    """
    docs = F.coalesce("docs", F.lit(1)).cast("long") if "docs" in events.columns else F.lit(1).cast("long")
    old, new = F.coalesce("old_tokens", F.lit(0)).cast("long"), F.coalesce("tokens", F.lit(0)).cast("long")
    one = lambda sign, t: F.struct((sign * docs).alias("n_docs"), t.alias("n_tokens"))
    rows = (
        F.when(F.col("op") == "insert", F.array(one(1, new))).when(F.col("op") == "delete", F.array(one(-1, -new)))
        .when(F.col("op") == "revise", F.array(one(-1, -old), one(1, new))).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    )
    return events.select(*[F.col(k).cast("string").alias(k) for k in KEYS], F.explode(rows).alias("r")).select(*KEYS, "r.*")


def _publish(files: Folder, name: str, lines: list[str]) -> None:
    """A small file that appears whole, by a rename."""
    if not files.publish(name, "\n".join(lines)):
        raise OSError(f"could not publish {files.path}/{name}")


def _published(files: Folder, folder: str) -> dict[str, list[str]]:
    """Name and lines of each published file of a folder."""
    found = {}
    for n in files.names(folder):
        if not n.endswith(".tmp"):
            try:
                found[n] = files.text(f"{folder}/{n}").split("\n")
            except Py4JJavaError:  # a fold has taken the batch meanwhile
                if n in files.names(folder):
                    raise
    return found


def _taken(spark: SparkSession, files: Folder, batch_id: str) -> bool:
    """Whether a fold has taken a batch in. One job, over a table of ids."""
    if not files.names("taken"):
        return False
    return bool(spark.read.schema("batch_id string").parquet(f"{files.path}/taken").where(F.col("batch_id") == batch_id).take(1))


def commit(path: str, batch_id: str, events: DataFrame) -> bool:
    """Applies a batch of events to the rollup at path. False, and nothing done, where the batch_id is committed already."""
    if not batch_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch id has letters, digits, - and _")
    files = Folder(events.sparkSession, path)
    if files.exists(f"commits/{batch_id}") or _taken(events.sparkSession, files, batch_id):
        return False
    attempt = f"{path}/batches/{batch_id}-{uuid.uuid4().hex}"
    signed(events).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(attempt)
    _publish(files, f"commits/{batch_id}", [attempt])
    return True


def _folds(files: Folder) -> dict[int, tuple[str, dict[str, str]]]:
    """Number, totals and batches (id to folder) of the folds that are kept: the newest ones."""
    return {int(n): (lines[0], dict(x.split("\t") for x in lines[1:])) for n, lines in _published(files, "folds").items()}


def _state(files: Folder) -> tuple[int, list[str], dict[str, str]]:
    """The number of the newest fold, the folders that make up the totals, and the batches that it hasn't taken in: id to folder."""
    while True:
        folds = _folds(files)
        newest = max(folds, default=0)
        base, taken = folds.get(newest, (None, {}))
        fresh = {b: lines[0] for b, lines in _published(files, "commits").items() if b not in taken}
        if max(_folds(files), default=0) == newest:  # else a fold came between the two looks
            return newest, [base] if base else [], fresh


def fold(spark: SparkSession, path: str) -> int:
    """Adds all committed batches to the totals and gives how many there were. The batches of the fold before, which no reader of the newest totals needs, are deleted."""
    files = Folder(spark, path)
    newest, base, fresh = _state(files)
    if not fresh:
        return 0
    folds = _folds(files)
    _forget(files, folds.get(newest, (None, {}))[1])  # what a fold that broke off may have left
    attempt = f"{path}/totals/{newest + 1}-{uuid.uuid4().hex}"
    _sums(spark, [*base, *fresh.values()]).write.parquet(attempt)
    spark.createDataFrame([(b,) for b in sorted(fresh)], "batch_id string").coalesce(1).write.mode("append").parquet(f"{path}/taken")
    _publish(files, f"folds/{newest + 1:08}", [attempt, *(f"{b}\t{f}" for b, f in fresh.items())])
    _forget(files, fresh)
    # What the fold before the last was made of may still be read by those who began before that; what is older may not.
    for n in [n for n in folds if n < newest]:
        totals_of, batches = folds[n]
        for folder in [totals_of, *batches.values()]:
            delete(spark, folder)
        files.delete(f"folds/{n:08}")
    return len(fresh)


def _forget(files: Folder, batches: dict[str, str]) -> None:
    """Takes the commit files of batches away that a published fold names."""
    for b in batches:
        if files.exists(f"commits/{b}"):
            files.delete(f"commits/{b}")


def _sums(spark: SparkSession, folders: list[str]) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs != 0 or n_tokens != 0")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """KEYS, n_docs, n_tokens over the folded totals and all batches committed since; keys whose documents are all gone have no row."""
    _, base, fresh = _state(Folder(spark, path))
    return _sums(spark, [*base, *fresh.values()])


def squeezed(text: str) -> str:
    """The text as the revision counts it: without white space at its ends and with single spaces."""
    text = text.strip()
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def _count(batches, path: str, at: int):
    ids = encoder(path).ids
    for b in batches:
        counts = []
        for t in b.column(at):
            text = t.as_py() or ""
            n = len(ids(text)) // 4
            other = squeezed(text)
            counts.append((n, n if other == text else len(ids(other)) // 4))
        a, z = zip(*counts, strict=True) if counts else ((), ())
        rest = [i for i in range(b.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in rest], pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=[*[b.schema.names[i] for i in rest], "tokens", "revised"])


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, digest, tokens, revised) per row of docs: the tokens of the whole text, and of the text squeezed. Null is the empty text."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    return rows.mapInArrow(partial(_count, path=tokenizer, at=4), "doc_id long, source string, lang string, digest string, tokens long, revised long")


def query(spark, sf_dir):
    """A corpus' history in four batches: both halves of the documents come in, counts are revised to the squeezed texts, and rows whose text a smaller doc_id (or an earlier equal row) has are deleted. The first two are folded; the second is sent once more, as after a lost answer."""
    rows = stored(counted(table(spark, sf_dir, "documents"), default_tokenizer()), "token-counts").withColumn("tokenizer", F.lit("byte_bpe_50k"))
    path = shared_path(spark, "token-rollup")

    def event(df, op, tokens, old=None, docs=None):
        old, docs = F.lit(None).cast("long") if old is None else old, F.lit(1).cast("long") if docs is None else docs
        return df.select(F.lit(op).alias("op"), *KEYS, tokens.alias("tokens"), old.alias("old_tokens"), docs.alias("docs"))

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    late = event(rows.where(~half), "insert", F.col("tokens"))
    commit(path, "insert-1", event(rows.where(half), "insert", F.col("tokens")))
    commit(path, "insert-2", late)
    fold(spark, path)
    commit(path, "insert-2", late)  # left as it is
    commit(path, "revise-1", event(rows.where("tokens != revised"), "revise", F.col("revised"), F.col("tokens")))
    # A text's rows are summed by key before its digest gathers them, so a group of copies is a few rows. All of it goes, and the first comes back.
    groups = rows.groupBy("digest", *KEYS).agg(F.count("*").alias("docs"), F.sum("revised").alias("revised"), F.min(F.struct("doc_id", "source", "lang", "revised", "tokenizer")).alias("r"))
    groups = stored(groups, "token-groups")
    first = groups.groupBy("digest").agg(F.min("r").alias("r"), F.sum("docs").alias("n")).where("n > 1")
    copies = groups.join(first.select("digest"), "digest", "left_semi")
    gone = event(copies, "delete", F.col("revised"), docs=F.col("docs"))
    commit(path, "delete-1", gone.unionByName(event(first.select("r.*"), "insert", F.col("revised"))))
    return totals(spark, path)
