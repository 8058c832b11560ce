"""Benchmark decontamination as a prefix-filtered join of word shingles.

Every window of 10 consecutive item words holds six five-word shingles. A
document can contain the window only if it holds its rarest shingle, so that
shingle, by the order of corpus frequency, is the window's whole necessary
prefix. Documents meet windows on prefix shingles alone; the shingle's place in
the window gives the one place where the window can start (positional bound),
it has to end inside the document (length bound), and the words there are then
compared.

A Bloom filter of fixed largest size keeps shingles of no benchmark item on the
map side, so that only benchmark shingles and a few words around them move.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import HOT, carried, prepare, row_key, stored, table

WINDOW, SHINGLE = 10, 5
#: Bits of the filter for each shingle, and the most there are (16 MB).
FILTER_BITS, FILTER_MOST = 32, 1 << 27
#: Parts a hot shingle's hits are dealt in, and the powers a worker keeps.
SALTS, POWERS = 64, 1 << 20
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Words:
    """The words of a text: bytes with other bytes blanked, where words start and end, and a hash of each."""

    powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
        b = np.frombuffer(self.raw, np.uint8)
        edges = np.diff(np.concatenate(([0], (b != 32).view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.n = len(self.start)
        up, down = _Words.powers
        if len(up) <= len(b):
            size = max(1 << 16, 2 * len(b))
            up, down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, np.uint64(x))))) for x in (BASE, INVERSE))
            if size <= POWERS:  # those of a longer text go with it
                _Words.powers = up, down
        sums = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
        self.hash = _mix((sums[self.end] - sums[self.start]) * down[self.start])

    def shingles(self, k: int) -> np.ndarray:
        """A code for every k consecutive words, as many as there are."""
        out = np.full(max(0, self.n - k + 1), np.uint64(k))
        for i in range(k):
            out = _mix(out * np.uint64(BASE) + self.hash[i : i + len(out)])
        return out

    def words(self, a: int, b: int) -> list[str]:
        return self.raw[self.start[a] : self.end[b - 1]].decode("utf-8", "surrogatepass").split(" ") if a < b else []

    def context(self, a: int, b: int) -> list[str]:
        return [w for w in self.words(a, b) if w]


def _item_rows(batches, window: int, shingle: int):
    for b in batches:
        out = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = _Words(text)
            n = min(window, w.n)
            codes = w.shingles(min(shingle, n)).view(np.int64) if n else []
            words = w.context(0, w.n) if n else []
            for i in range(w.n - n + 1 if n else 0):
                out.append({"item_id": item, "win": " ".join(words[i : i + n]), "n": n, "codes": codes[i : i + n - min(shingle, n) + 1].tolist()})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("item_id", pa.string()), ("win", pa.string()), ("n", pa.int32()), ("codes", pa.list_(pa.int64()))]))


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id as string, win, n, codes): every window of every item; an item of fewer words is one window, one of none (null, empty) has none."""
    prepare(benchmark.sparkSession)
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), "text").mapInArrow(partial(_item_rows, window=window, shingle=shingle), "item_id string, win string, n int, codes array<long>")


def _slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four filter bits of each code."""
    return [(codes >> np.uint64(s) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 11, 23, 36)]


def shingle_filter(codes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the code column: as bytes, and its bits. At most FILTER_MOST bits come to the driver, however large the benchmark is."""
    n = codes.count()
    bits = min(FILTER_MOST, 1 << max(10, (n * FILTER_BITS - 1).bit_length() if n else 10))
    slot = F.explode(F.array(*[F.shiftrightunsigned("code", s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in (0, 11, 23, 36)]))
    held = codes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toPandas()
    words = np.zeros(bits // 32, np.uint32)
    words[held["word"].to_numpy()] = held["bits"].to_numpy().astype(np.uint32)
    return np.unpackbits(words.view(np.uint8), bitorder="little") if bits <= 1 << 20 else words.view(np.uint8), bits


def _held(filter_, bits: int, slots: np.ndarray) -> np.ndarray:
    return filter_[slots] != 0 if len(filter_) == bits else filter_[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 != 0


def _document_rows(batches, held, bits: int, lengths: list[int], window: int):
    filter_ = held.value
    for b in batches:
        n_words, hits = [], []
        for text in b.column(2).to_pylist():
            w, found = _Words(text), []
            for k in lengths:
                codes = w.shingles(k)
                at, slots = np.arange(len(codes)), None
                for s in range(4):
                    if not len(at):
                        break
                    slots = _slots(codes[at], bits)[s]
                    at = at[_held(filter_, bits, slots)]
                for p in at.tolist():
                    a = max(0, p - (window - k))
                    found.append({"code": int(codes[p].view(np.int64)), "pos": p, "from": a, "words": w.context(a, min(w.n, p + window))})
            n_words.append(w.n)
            hits.append(found)
        kind = pa.list_(pa.struct([("code", pa.int64()), ("pos", pa.int32()), ("from", pa.int32()), ("words", pa.list_(pa.string()))]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(hits, kind)], names=["doc_id", "row_key", "n_words", "hits"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, items): one row for each row of docs.

    n_hit counts the words inside any occurrence of a window, items are the
    item_ids, as strings and sorted, of which a window occurs. Null and empty
    texts have no words. Rows that repeat a doc_id are judged each by its own
    text; a null doc_id is kept; items without item_id are ignored. With an
    empty benchmark nothing is hit. Extra columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    items = stored(item_windows(benchmark, window, shingle), "benchmark-windows")
    wins = items.dropDuplicates(["win"])
    filter_, bits = shingle_filter(wins.select(F.explode("codes").alias("code")).distinct())
    lengths = [r[0] for r in items.select(F.least(F.lit(shingle), "n")).distinct().collect()]  # 1 to shingle
    scan = partial(_document_rows, held=spark.sparkContext.broadcast(filter_), bits=bits, lengths=sorted(lengths), window=window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    seen = stored(rows.mapInArrow(scan, "doc_id long, row_key long, n_words long, hits array<struct<code:long,pos:int,from:int,words:array<string>>>"), "benchmark-hits")
    # The same text under the same id, repeated, is hit alike: judged once.
    hits = seen.where(F.size("hits") > 0).dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", "n_words", F.explode("hits").alias("h")).select("doc_id", "row_key", "n_words", "h.*")
    frequency = stored(hits.groupBy("code").count(), "benchmark-frequency")  # of benchmark shingles alone
    placed = wins.select("win", "n", F.posexplode("codes").alias("offset", "code")).join(frequency, "code")
    prefix = placed.groupBy("win", "n").agg(F.min(F.struct("count", "code", "offset")).alias("p")).select("win", "n", "p.code", "p.offset")
    # A shingle of very many hits (a one-word item that is a common word) is dealt in SALTS parts, each of which meets its windows.
    hot = frequency.where(F.col("count") > frequency.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] / HOT).select("code", F.lit(SALTS).alias("salts"))
    salted = lambda df: df.join(F.broadcast(hot), "code", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    prefix = salted(prefix).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = salted(hits).withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.col("salts")).cast("int")).drop("salts")
    met = met.join(prefix, ["code", "salt"]).withColumn("start", F.col("pos") - F.col("offset"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    met = met.where(F.array_join(F.slice("words", F.col("start") - F.col("from") + 1, F.col("n")), " ") == F.col("win"))
    per_doc = met.select("doc_id", "row_key", "start", "n", "win").join(items.select("win", "item_id").distinct(), "win")
    per_doc = per_doc.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), "items")
    out = seen.join(per_doc, seen["doc_id"].eqNullSafe(per_doc["_id"]) & (seen["row_key"] == per_doc["_key"]), "left")
    return out.select("doc_id", "row_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item."""
    hit = contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    whole, back = carried(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"), whole, "text")
    return rows.join(hit, F.col("id").eqNullSafe(hit["_id"]) & (F.col("key") == hit["_key"]), "left_anti").select(*back)


def query(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
