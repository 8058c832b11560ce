"""Line dedup over a corpus, in DataFrame functions alone.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys are hashed to 128 bits; only hashes, document ids and positions move. They
are range-partitioned by hash and sorted by document, the largest first, and
position; a window streams over the sorted ranges, in which a key's first
occurrence names the document that keeps it. A key that many lines share is
hot: its documents are dealt over SLOTS ranges, and the heads of those ranges
(a row each) are stitched afterwards. The result per document is a compressed
bitmap of the lines that stay, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import HOT, ascii_lower, carried, row_key, stored, table

SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: Lines a bitmap word covers.
WORD = 62
FULL = (1 << WORD) - 1
#: Ranges of a hot key.
SLOTS = 256


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def hot_hashes(keyed: DataFrame, hot: int = HOT) -> list[int]:
    """The h1 of keys that more than a part in hot of all rows have, and maybe of a few others: fewer than 2 * hot numbers. It decides on balance alone."""
    found = keyed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {hot}, {20 * hot})").alias("top")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] > found["n"] / hot]


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, hot: int = HOT) -> DataFrame:
    """(doc_id, row_key, pos): the lines that go. See keep_bitmaps()."""
    rows = docs.select("doc_id", row_key().alias("row_key"), "text").where("doc_id is not null")
    lines = rows.select("doc_id", "row_key", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "row_key", "pos", _key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    keyed = stored(keyed.select("doc_id", "row_key", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")), "line-hashes")
    many = hot_hashes(keyed, hot)
    by = ["h1", "h2", "slot"] if many else ["h1", "h2"]
    if many:
        keyed = keyed.withColumn("slot", F.when(F.col("h1").isin(many), F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")).otherwise(-1))
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by, F.desc("doc_id"), "pos")
    # The ranges hold whole groups in this order, so both windows read them as they lie.
    key = Window.partitionBy(*by)
    streamed = ranged.withColumns({"nth": F.dense_rank().over(key.orderBy(F.desc("doc_id"))), "keeper": F.first("doc_id").over(key.orderBy(F.desc("doc_id")))})
    streamed = streamed.withColumn("n", F.max("nth").over(key))
    goes = (F.col("n") >= min_documents) & (F.col("doc_id") != F.col("keeper"))
    if not many:
        return streamed.where(goes).select("doc_id", "row_key", "pos")
    marks = stored(streamed.where(goes | (F.col("slot") >= 0)).drop("nth"), "line-marks")
    heads = marks.where("slot >= 0").groupBy("h1", "h2", "slot").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))
    heads = heads.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))  # a row for each hot key
    hot_rows = marks.where("slot >= 0").drop("n", "keeper").join(F.broadcast(heads), ["h1", "h2"])
    return marks.where("slot < 0").select("doc_id", "row_key", "pos").unionByName(hot_rows.where(goes).select("doc_id", "row_key", "pos"))


def _bitmaps(gone: DataFrame) -> DataFrame:
    words = gone.groupBy("doc_id", "row_key", (F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    kept = F.struct("word", F.col("bits").bitwiseXOR(F.lit(FULL)).alias("bits"))
    return words.groupBy("doc_id", "row_key").agg(F.map_from_entries(F.collect_list(kept)).alias("keep_bitmap"))


def keep_bitmaps(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, row_key, n_lines, keep_bitmap) for each row of docs.

    keep_bitmap maps a word number to 62 bits; bit b of word w stands for line
    62 w + b, and set bits stay. Words that are all ones are left out, so the
    bitmap of a document that keeps all lines is empty and one with a few
    repeated lines has a few bytes.

    Keys of at least min_chars code points in at least min_documents documents
    lose all lines but those in the largest doc_id that holds the key. Null or
    empty text is one empty line and never goes. Rows without a doc_id keep
    their lines and don't count as holders. Rows that repeat a doc_id count as
    one document and have a bitmap each. Extra columns are ignored.
    """
    rows = docs.select("doc_id", row_key().alias("row_key"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"))
    empty = F.create_map().cast("map<int,bigint>")
    return rows.join(_bitmaps(repeated_lines(docs, **limits)), ["doc_id", "row_key"], "left").withColumn("keep_bitmap", F.coalesce("keep_bitmap", empty))


def kept(lines: Column, bitmap: Column) -> Column:
    """The lines that a bitmap leaves; all of them for a null bitmap."""
    stays = lambda i: F.coalesce(F.try_element_at(bitmap, (i / WORD).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD)), F.lit(1).cast("long")) != 0
    return F.when(bitmap.isNull(), lines).otherwise(F.filter(lines, lambda _, i: stays(i)))


def drop_repeated_lines(docs: DataFrame, **limits) -> DataFrame:
    """docs with the lines that keep_bitmaps() drops taken out of text; adds n_lines and n_dropped (columns of these names are replaced). Null text turns into the empty text.

    Bitmaps that Spark finds small enough to broadcast leave the texts where they are; larger ones are joined by document.
    """
    docs = docs.drop("n_lines", "n_dropped")
    whole, back = carried(docs)
    marks = _bitmaps(repeated_lines(docs, **limits))
    joined = docs.select(F.col("doc_id"), row_key().alias("row_key"), whole, _lines(F.col("text")).alias("lines")).join(marks, ["doc_id", "row_key"], "left")
    split = joined.select("whole", "lines", kept(F.col("lines"), F.col("keep_bitmap")).alias("kept"))
    done = split.select("whole", F.array_join("kept", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
    return done.select(*back, "n_lines", "n_dropped")


def query(spark, sf_dir):
    done = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
