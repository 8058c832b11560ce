"""Search over codes, analysts, document names and values by an index of their trigrams.

The index is a folder of three tables: who owns which text, sorted by text; the
distinct texts in blocks, which are texts that differ in the two signs up to
their last digit alone; and for each trigram the blocks that hold it, in buckets
and sorted. A search reads the postings of its own trigrams, looks through the
texts of the blocks that have all of them, and reads owners in the ranges where
those texts lie; so it costs what its rarest words bring, not the whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.normalize import opened
from tallyspark.operators.textops import keyword

#: Signs of a gram, folders of postings and files of each, signs in which texts of a block differ, ranges of texts that a search reads.
GRAM, BUCKETS, SHARES, TAIL, RANGES = 3, 64, 4, 2, 32


def _levelled(text: str) -> Column:
    """keyword of a column. Pure ASCII takes a short way to the same result."""
    v = F.coalesce(F.col(text), F.lit(""))
    bare = F.when(F.contains(v, F.lit("`")) | F.contains(v, F.lit("^")), F.regexp_replace(v, "[`^]", "")).otherwise(v)
    return F.when(F.octet_length(v) == F.char_length(v), F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))).otherwise(keyword(v))


def _grams(text) -> Column:
    """The trigrams of a text; of a shorter one, none."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1), F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))


def _bucket(gram) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(entries: DataFrame, key: str, path: str) -> None:
    """Writes the index of entries (key, text) into path, a new folder. Texts are levelled (case, accents, punctuation) once; blank ones are left out."""
    levelled = opened(entries, F.array(_levelled("text")), "text", key).where("text != ''")
    # Dealt by text and key: a text that everyone has lies in all files.
    levelled.distinct().sortWithinPartitions("text", key).write.parquet(f"{path}/owners")
    text = F.col("text")
    upto = F.length(F.rtrim(text, F.lit("abcdefghijklmnopqrstuvwxyz ")))
    cut = F.greatest(upto - TAIL, F.lit(0))
    parts = entries.sparkSession.read.parquet(f"{path}/owners").select("text").distinct().select(F.substring(text, F.lit(1), cut).alias("head"), F.substring(text, cut + 1, upto - cut).alias("tail"), F.substring(text, upto + 1, F.length(text)).alias("end"))
    # A block's number needn't be its own: texts are looked through before they count.
    blocks = parts.groupBy("head", "end").agg(F.collect_list("tail").alias("tails")).select(F.xxhash64("head", "end").alias("block"), "head", "tails", "end")
    blocks.write.parquet(f"{path}/texts")
    stored = entries.sparkSession.read.parquet(f"{path}/texts")
    # What a text has besides the trigrams of its head and end goes over where they meet its tail.
    over = F.transform("tails", lambda t: F.concat(F.substring("head", 1 - GRAM, GRAM - 1), t, F.substring("end", 1, GRAM - 1)))
    grams = F.array_distinct(F.concat(_grams(F.col("head")), _grams(F.col("end")), F.flatten(F.transform(over, _grams))))
    postings = opened(stored, grams, "gram", "block").withColumn("bucket", _bucket(F.col("gram")))
    # A bucket lies in SHARES files, however frequent a gram is, each sorted by gram.
    postings.repartition("bucket", F.pmod("block", F.lit(SHARES))).sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")


def _wanted(spark: SparkSession, query: str) -> str:
    return spark.range(1).select(keyword(F.lit(query)).alias("q")).first().q


def matching_texts(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(text) that hold the query. One shorter than a trigram has no postings and looks through the distinct texts."""
    wanted = _wanted(spark, query)
    blocks = spark.read.parquet(f"{path}/texts")
    if len(wanted) >= GRAM:
        grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        buckets = [r.b for r in spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(g)) for g in grams])).alias("b")).distinct().collect()]  # as many as the query has trigrams, at most
        postings = spark.read.schema("block long, gram string, bucket int").parquet(f"{path}/postings")
        held = postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") >= len(grams))
        blocks = blocks.join(held.select("block"), "block")
    return opened(blocks, F.transform("tails", lambda t: F.concat("head", t, "end")), "text").where(F.contains("text", F.lit(wanted)))


def search(spark: SparkSession, path: str, key: str, query: str) -> DataFrame:
    """The keys of which a text holds the query, whatever its case, accents and punctuation."""
    wanted, owners = _wanted(spark, query), spark.read.parquet(f"{path}/owners")
    holds = F.contains("text", F.lit(wanted))
    if len(wanted) < GRAM:
        return owners.where(holds).select(key).distinct()
    found = matching_texts(spark, path, query)
    lies = found.groupBy(F.substring("text", 1, GRAM).alias("begins")).agg(F.min("text").alias("least"), F.max("text").alias("most")).limit(RANGES + 1).collect()
    if len(lies) <= RANGES:
        within = F.lit(False)
        for r in lies:
            within = within | F.col("text").between(r.least, r.most)
        owners = owners.where(within)
    return owners.where(holds).join(found, "text", "left_semi").select(key).distinct()
