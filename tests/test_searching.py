"""The search index: what it holds, how often entries are read, and which owners a search looks at."""

import random

from pyspark.sql import functions as F

from tallyspark.operators import searching, textops


def _keys(df) -> set:
    return {r.k for r in df.collect()}


def test_entries_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"Código {i % 50}"

    searching.build(spark.range(400).select(F.col("id").alias("k"), text("id").alias("text")), "k", f"{tmp_path}/index")
    assert made.value == 400
    assert _keys(searching.search(spark, f"{tmp_path}/index", "k", "codigo 49")) == set(range(49, 400, 50))


def test_postings_are_of_blocks(spark, tmp_path):
    """Texts that differ in the two signs up to their last digit share postings, and a search still tells them apart. Before, each text had its own."""
    path = f"{tmp_path}/index"
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("OP-"), F.col("id"))).otherwise(F.concat(F.lit("Doc "), F.col("id"), F.lit(".pdf")))
    df = spark.range(10_000, 14_000).select(F.col("id").alias("k"), name.alias("text"))
    searching.build(df, "k", path)
    assert spark.read.parquet(f"{path}/postings").count() < 4_000 * len("op 10000") / 4
    for query in ("op 1", "123", "3999", "10 0", "op 12345", "doc 14", "doc 1234", "99", "9 p", "45 pdf", "p 11"):
        assert _keys(searching.search(spark, path, "k", query)) == _keys(textops.search(df, "k", [F.col("text")], query)), query


def test_every_trigram_of_a_text_is_posted(spark, tmp_path):
    rng = random.Random(5)
    texts = sorted({" ".join("".join(rng.choices("ab12", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(300)} | {"1", "12", "a", "ab", "a1", "1a", "123", "abc", "a1b", "12abc", "abc12", "1 a", "a 1 b"})
    path = f"{tmp_path}/index"
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    searching.build(df, "k", path)
    blocks = {}
    for r in spark.read.parquet(f"{path}/texts").collect():
        blocks.update({f"{r.head}{t}{r.end}": r.block for t in r.tails})
    assert set(blocks) == set(texts)
    posted = {}
    for r in spark.read.parquet(f"{path}/postings").collect():
        posted.setdefault(r.block, set()).add(r.gram)
    want = {}
    for t in texts:
        want.setdefault(blocks[t], set()).update(t[i : i + 3] for i in range(len(t) - 2))
    assert posted == {b: g for b, g in want.items() if g}


def test_owners_of_a_frequent_text_lie_in_many_files(spark, tmp_path):
    path = f"{tmp_path}/index"
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        searching.build(spark.range(2_000).select(F.col("id").alias("k"), F.lit("R$ 0,00").alias("text")), "k", path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    files = spark.read.parquet(f"{path}/owners").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 1_000
    assert searching.search(spark, path, "k", "0 00").count() == 2_000


def test_a_search_reads_the_ranges_of_its_texts(spark, tmp_path):
    path = f"{tmp_path}/index"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Contrato 12.pdf", "contrato 120", "Ana", "Zoé", "contrato 13", "outro contrato 12"])], "k long, text string")
    searching.build(df, "k", path)
    found = searching.search(spark, path, "k", "contrato 12")
    assert _keys(found) == {0, 1, 5}
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = searching.search(spark, path, "k", "contrato 12")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", kept)
    pushed = next(line for line in plan.splitlines() if "FileScan" in line and f"{path}/owners" in line).split("PushedFilters")[1]
    assert "And(GreaterThanOrEqual(text,contrato 12 pdf),LessThanOrEqual(text,contrato 120))" in pushed


def test_more_beginnings_than_ranges(spark, tmp_path):
    path, signs = f"{tmp_path}/index", "abcdefghijklmnopqrstuvwxyz0123456789"
    df = spark.createDataFrame([(i, f"{a}{b} vila") for i, (a, b) in enumerate((a, b) for a in signs for b in signs)] + [(-1, "outra")], "k long, text string")
    searching.build(df, "k", path)
    assert _keys(searching.search(spark, path, "k", "Vila")) == set(range(len(signs) ** 2))


def test_nothing_to_search(spark, tmp_path):
    searching.build(spark.createDataFrame([(1, None), (2, " - ")], "k long, text string"), "k", f"{tmp_path}/blank")
    searching.build(spark.createDataFrame([], "k long, text string"), "k", f"{tmp_path}/empty")
    for folder in ("blank", "empty"):
        assert [_keys(searching.search(spark, f"{tmp_path}/{folder}", "k", q)) for q in ("vila nova", "x", "")] == [set(), set(), set()]


def test_levelled_is_keyword(spark):
    rng = random.Random(3)
    rows = [None, "", "^", "`^`", *[f"a{chr(i)}B{chr(i)}{chr(i)}9" for i in range(1, 0x250)], *["".join(chr(rng.choice([*range(1, 128), 0xCD, 0x301, 0xA8, 0x130, 0x20AC, 0x1F600])) for _ in range(rng.randint(0, 9))) for _ in range(500)], *["".join(chr(rng.randint(1, 127)) for _ in range(12)) for _ in range(500)]]
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    assert df.where(~searching._levelled("text").eqNullSafe(textops.keyword(F.coalesce("text", F.lit(""))))).count() == 0
