"""Secret scan with corpus-wide ownership frequency.

A map pass finds candidates in every whole text; only their digests and places
leave it, never the values. Digests are counted over the corpus by distinct
repositories and owners: values that many owners hold are widely copied
examples, values of one owner look live. Long tokens without a label, which a
pattern alone can't judge, become spans where their ownership says so.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import HOT, hot_join, prepare, row_key, stored, table

#: A value held by more owners, or by more repositories, is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 4
MIN_ENTROPY = 3.0
KINDS = ("assign", "access", "hex", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
_TOKEN = re.compile("[A-Za-z0-9+/_-]{32,}={0,2}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_LABELS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PLACEHOLDER = re.compile("example|changeme|placeholder|dummy|sample|your_|xxxx|1234567", re.IGNORECASE)

CANDIDATES = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("digest", pa.string()), ("strong", pa.bool_())]))


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, stop, value): the base kinds, and tokens of mixed characters that no base span touches."""
    out, low = [], text.lower()
    if any(x in low for x in _LABELS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    # Tokens come in order, so base spans are swept once: those that end before a token never touch a later one.
    taken, at, held = sorted((a, b) for a, _, b, _ in out), 0, 0
    for m in _TOKEN.finditer(text):
        v = m[0]
        while at < len(taken) and taken[at][0] < m.end():
            held, at = max(held, taken[at][1]), at + 1
        if held <= m.start() and _DIGIT.search(v) and _LETTER.search(v) and entropy(v) >= MIN_ENTROPY + 0.5:
            out.append((m.start(), 3, m.end(), v))
    return sorted(out)


def _scan(batches):
    for b in batches:
        found = [
            [{"start": a, "kind": k, "stop": z, "digest": hashlib.sha256(v.encode()).hexdigest()[:32], "strong": entropy(v) >= MIN_ENTROPY and not _PLACEHOLDER.search(v)} for a, k, z, v in candidates(t.as_py() or "")]
            for t in b.column(4)
        ]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, CANDIDATES)], names=["doc_id", "row_key", "repository", "owner", "found"])


def _spans(found: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, KINDS)), found["kind"] + 1)
    return F.concat_ws(":", name, found["start"].cast("string"), found["stop"].cast("string"))


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """(doc_id, row_key, found, judged) per row of docs.

    found: all candidates by start and kind; judged: those of rows with any,
    each with its owners, repositories and whether it looks live (at most
    MAX_OWNERS owners and MAX_REPOSITORIES repositories hold it, and it is no
    placeholder). Null text is empty; null repositories and owners count as one
    of their own. Rows that repeat an id are judged each by its text.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col("text"))
    seen = stored(rows.mapInArrow(_scan, "doc_id long, row_key long, repository string, owner string, found array<struct<start:int,kind:int,stop:int,digest:string,strong:boolean>>"), "secret-candidates")
    held = seen.where(F.size("found") > 0).select("doc_id", "row_key", "repository", "owner", F.explode("found").alias("f"))
    # (value, repository, owner) is counted first: a value in a third of all rows is a few rows from each task.
    frequency = held.groupBy(F.col("f.digest").alias("digest"), "repository", "owner").agg(F.count("*").alias("rows")).groupBy("digest")
    frequency = stored(frequency.agg(F.sum("rows").alias("rows"), F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners")), "secret-owners")
    hot = F.col("rows") > frequency.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] / HOT
    each = held.select("doc_id", "row_key", "f", F.col("f.digest").alias("digest")).dropDuplicates(["doc_id", "row_key", "f"])
    each = hot_join(each, frequency, ["digest"], hot)
    live = F.col("f.strong") & (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES)
    judged = each.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("f.start", "f.kind", "f.stop", "f.digest", "owners", "repositories", live.alias("live")))).alias("judged"))
    judged = judged.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    return seen.join(judged, seen["doc_id"].eqNullSafe(judged["_id"]) & (seen["row_key"] == judged["_key"]), "left").select("doc_id", "row_key", "found", "judged")


def query(spark, sf_dir):
    """Owner: the document's source. Repository: its part in one language."""
    found = scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))
    base = F.filter("found", lambda f: f["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long")
    kept = F.filter(F.coalesce("judged", F.array().cast("array<struct<start:int,kind:int,stop:int,digest:string,owners:long,repositories:long,live:boolean>>")), lambda f: (f["kind"] < 3) | f["live"])
    joined = lambda spans: F.array_join(F.transform(spans, _spans), ",")
    live = F.size(F.filter(kept, lambda f: f["live"])).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(kept).alias("spans"), live.alias("n_live"), (F.size(kept) - live).alias("n_copied"))
