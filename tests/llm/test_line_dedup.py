import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, word int, pos string"


def brute(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 20:
                held[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < 20 or len(held[key(x)]) < 3 or d == max(held[key(x)])]
        out.append((len(lines) - len(keep), d, hashlib.sha256("\n".join(keep).encode()).hexdigest(), len(lines)))
    return out


def test_oracle(spark, sf, oracle, rows):
    assert rows(line_dedup.query(spark, sf)) == oracle(line_dedup.ORACLE, sf)


def test_edges(spark):
    long = "A repeated line of more than twenty characters"
    docs = [
        (1, f"  {long.upper()}\r\nown\n{long}"), (2, f"{long}\n"), (3, f"{long}\nx\n{long}"), (4, None), (5, ""), (5, f"{long}\nsame id"), (None, long), (6, "É" * 25), (7, "é" * 25), (8, "É" * 25),
        (9, "É" * 25 + "  \t"), (10, ("w" * 30 + "\n") * 200), (11, "w" * 30), (12, "w" * 30), (13, "short"), (14, "short"), (15, "short"), (15, "short"),
    ]
    df = spark.createDataFrame([(d, t, "x", 1, "p") for d, t in docs], SCHEMA)
    got = line_dedup.drop_repeated_lines(df)
    assert set(got.columns) == {*df.columns, "n_lines", "n_dropped"}
    found = [(r.n_dropped, r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_lines) for r in got.collect()]
    by = lambda x: str(x)
    assert sorted(found, key=by) == sorted(brute(docs), key=by)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [10, 1000])
def test_hot_and_other_keys_alike(spark, hot):
    common, other = "this line is in nearly every document", "and this one is in a few of them only"
    docs = [(i, "\n".join([common] * (1 + i % 3) + [f"own line number {i} of this document"] + [other] * (i % 40 == 0))) for i in range(400)] + [(7, common), (None, common)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lines = df.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("h1"))
    assert bool(line_dedup.hot_hashes(lines, 1000)) and len(line_dedup.hot_hashes(lines, 10)) == 1
    got = [(r.n_dropped, r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_lines) for r in line_dedup.drop_repeated_lines(df, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(brute(docs), key=str)


def test_names_of_its_own_do_not_clash(spark):
    long = "A repeated line of more than twenty characters"
    df = spark.createDataFrame([(i, f"{long}\nx{i}", 1, 2, 3, 4, 5, 6) for i in range(4)], "doc_id long, text string, drop_bitmap int, row_key int, _id int, _lines int, `keep_bitmap` int, `a.b` int")
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"x{i}" if i < 3 else f"{long}\nx3", 1, 2, 3, 4, 5, 6, 2, int(i < 3)) for i in range(4)]


def test_bitmaps_hold_every_document(spark):
    long = "A repeated line of more than twenty characters"
    df = spark.createDataFrame([(1, "\n" * 100 + long), (2, long), (3, long), (4, None), (None, long)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.keep_bitmap) for r in line_dedup.keep_bitmaps(df).collect()}
    assert got == {1: (101, {1: line_dedup.FULL ^ 1 << 38}), 2: (1, {0: line_dedup.FULL ^ 1}), 3: (1, {}), 4: (1, {}), None: (1, {})}


def test_ranges_are_streamed_without_another_shuffle(spark, sf, monkeypatch):
    kept = {}
    stored = line_dedup.stored

    def keep(df, name):
        kept[name] = df
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", keep)
    one = line_dedup.repeated_lines(spark.read.parquet(f"{sf}/documents.parquet"), hot=1)
    line_dedup.repeated_lines(spark.read.parquet(f"{sf}/documents.parquet"), hot=1000)
    for df in (one, kept["line-marks"]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Exchange rangepartitioning" in plan and plan.count("Sort [") == 1
