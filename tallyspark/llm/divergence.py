"""How the sources of a language differ in the words they use.

Each language keeps the terms of at least MIN_DOCUMENTS of its documents. A
source gives a kept term the price p = 1 + floor(SCALE * (count + SMOOTH) / (N +
SMOOTH * V)), where N is the sum of its counts and V the number of kept terms, so
all terms it lacks have one price z. The divergence of two sources A and B is the
sum of |pA - pB| over all kept terms, without a row for what a source lacks:

* terms of A as if B lacked them, and the other way round, from the histogram of
  A's prices: a running sum over it, met by every other source's z in order.
  Prices above all z of the language need no order and are one entry;
* terms that both have: postings joined by term take back what was priced twice
  and add the right difference;
* terms that neither has: how many there are times |zA - zB|.

Terms are counted in bounded pieces inside the tasks that read the texts; a
group, a term or a language that holds most rows is summed before it is shuffled,
and what is shuffled has a row for each source and term.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, stored, table

MIN_DOCUMENTS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Distinct terms that a task holds before it hands its counts on.
HELD = 200_000
#: Parts of a group that are ranked by themselves first.
SLOTS = 32
#: A-Z to a-z; letters and bytes of other code points stay; all else separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _counted(batches, held: int):
    """Per group (lang, source): a row without a term, and for each term its occurrences and documents."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in groups.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.binary()), pa.array([0]), pa.array([0])], names=["lang", "source", "term", "n", "docs"])
            keys = list(n)
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part]), pa.array([docs[t] for t in part])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text.as_py())
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in groups.values()) > held:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group of docs, and a row without a term for each group. Null lang, source and text are empty; each row is a document."""
    prepare(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sent = docs.select(plain("lang"), plain("source"), F.col("text").cast("binary").alias("text"))
    rows = sent.mapInArrow(partial(_counted, held=held), "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exactly; null where the divisor is 0."""
    above = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", above, F.nullif((total + SMOOTH * kept).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))


def _sum(c: str, name: str | None = None) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name or c)


def _priced(docs: DataFrame, min_documents: int) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, source, term, p, q: the language's price, z, top), and stats of groups (lang, source, has: its kept terms, kept, z, top: the largest z of the language)."""
    counts = stored(term_counts(docs), "term-counts")
    of_term = Window.partitionBy("lang", "term")
    known = counts.where("term is not null").withColumns({"held": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
    postings = stored(known.where(F.col("held") >= min_documents).select("lang", "source", "term", "n", "n_lang", (F.col("nth") == 1).cast("long").alias("first")), "postings")

    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"), F.sum("first").alias("firsts"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["total", "has", "firsts"])
    langs = groups.groupBy("lang").agg(_sum("firsts", "kept"), _sum("total", "total_lang"))
    stats = groups.join(langs, "lang").withColumn("z", F.coalesce(price(F.lit(0).cast("long"), F.col("total"), F.col("kept")), F.lit(0)))
    stats = stats.join(stats.groupBy("lang").agg(F.max("z").alias("top")), "lang").drop("firsts")
    stats = stored(stats, "group-stats")
    p, q = (price(F.col(n), F.col(t), F.col("kept")) for n, t in (("n", "total"), ("n_lang", "total_lang")))
    priced = postings.join(stats, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "z", "top")
    return stored(priced, "priced"), stats


def _one_sided(priced: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, source, other, value): the source's terms against the price of terms that the other one lacks."""
    entry = F.least("p", "top")
    hist = priced.groupBy("lang", "source", entry.alias("at")).agg(F.count("*").alias("m"), F.sum("p").alias("w")).withColumn("other", F.lit(None).cast("string"))
    probes = pairs.select("lang", "source", F.col("z_other").alias("at"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("w"), "other")
    of_group = Window.partitionBy("lang", "source")
    # A probe stands before the entry of its own price: that one may hold higher ones.
    upto = of_group.orderBy("at", F.col("other").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = hist.unionByName(probes).withColumns({"all_m": F.sum("m").over(of_group), "all_w": F.sum("w").over(of_group), "low_m": F.sum("m").over(upto), "low_w": F.sum("w").over(upto)})
    value = F.col("all_w") - 2 * F.col("low_w") + F.col("at") * (2 * F.col("low_m") - F.col("all_m"))
    return line.where("other is not null").select("lang", "source", "other", value.alias("value"))


def _both_sided(priced: DataFrame) -> DataFrame:
    """(lang, source, other, value): what the terms that both have add to their two one-sided prices and to the terms that neither has; source < other."""
    a = priced.select("lang", "term", "source", "p", "z")
    b = priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("z").alias("y"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("source < other")
    return both.groupBy("lang", "source", "other").agg(F.sum(gap("p", "r") - gap("p", "y") - gap("z", "r") + gap("z", "y")).alias("value"))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = [F.desc("value"), F.asc("item")]
    if top:
        slot = F.pmod(F.xxhash64("item"), F.lit(SLOTS))
        rows = rows.withColumn("slot", slot).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "slot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top) if top else ranked
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text), by value descending and item.

    part pair: item is each other source of the language, value the divergence
    from it; all ranks. part term: item is a kept term that the source has and
    prices above the language as a whole, value by how much; ranks up to top.

    Null lang, source and text are empty, and an empty source is a source. A
    group without kept terms lacks them all; in a language that keeps none every
    divergence is 0. Rows that repeat others are documents of their own. A
    language of one source has no pairs. Extra columns are ignored; an empty
    table gives no rows. Sums are exact up to 2**63.
    """
    priced, stats = _priced(docs, min_documents)
    mine = stats.select("lang", "source", "has", "kept", "z")
    theirs = stats.select("lang", F.col("source").alias("other"), F.col("has").alias("has_other"), F.col("z").alias("z_other"))
    pairs = mine.join(theirs, "lang").where("source <> other")
    neither = pairs.select("lang", "source", "other", ((F.col("kept") - F.col("has") - F.col("has_other")) * F.abs(F.col("z") - F.col("z_other"))).alias("value"))
    priced_once = _one_sided(priced, pairs).unionByName(_both_sided(priced))
    mirrored = priced_once.select("lang", "value", F.explode(F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other")))).alias("s")).select("lang", "s.source", "s.other", "value")
    apart = mirrored.unionByName(neither).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    above = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(apart, "pair").unionByName(_ranked(above, "term", top))


def query(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang FROM g JOIN kept AS k ON g.lang = k.lang
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) + 5 * count(*) AS below, sum(n_lang) + 5 * count(*) AS below_lang FROM dense GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + CAST(1000000000 AS HUGEINT) * (x.n + 5) // t.below AS p, 1 + CAST(1000000000 AS HUGEINT) * (x.n_lang + 5) // t.below_lang AS q
    FROM dense AS x JOIN t ON x.lang = t.lang AND x.source = t.source),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(gap.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
