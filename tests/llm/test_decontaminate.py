import hashlib
import re

from tallyspark.llm import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit |= set(range(p, p + n))
                        got.add(str(i))
        out.append((d, len(w), len(hit), sorted(got)))
    return sorted(out, key=str)


def test_oracle(spark, sf, oracle, rows):
    assert rows(decontaminate.query(spark, sf)) == oracle(decontaminate.ORACLE, sf)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    items = [(1, long), (10, "Tiny"), (2, "three Word item"), (3, None), (4, "!!"), (5, long.upper()), (6, " ".join(f"w{i}" for i in range(5, 15))), (7, "été à l'œuvre"), (8, "a a a a a a a a a a a a")]
    docs = [
        (1, long), (2, f"x {long[:25]} y"), (3, None), (4, ""), (5, "tiny."), (5, "not tInY"), (6, "x three  word, ITEM three"), (7, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (8, "w5 w6 w7 w8 w9 w10 w11 w12 w13"),
        (None, long), (9, "ÉTÉ été À à L œuvre été à l œuvre"), (10, "a " * 30), (11, (long + " ") * 300), (1, long), (12, "w" * 200_000), (13, "a " * 9),
    ]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, item_id int, win string")
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench).collect()], key=str)
    assert got == brute(docs, items)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 8, 12, 13]
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(df, bench.limit(0)).collect()} == {0}
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in [spark.sql("select sha2('', 256) items_sha256").first()]}


def test_hot_shingles_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT", 2)
    docs = [(i, f"the cat {i} the dog and the bird") for i in range(80)] + [(90, "one two three"), (91, "nothing here")]
    items = [(1, "the"), (2, "one two three")]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, row_key int, key int, whole int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(df, bench).collect()], key=str)
    assert got == brute(docs, items)
    assert [tuple(r) for r in decontaminate.clean(df, bench).collect()] == [(91, "nothing here", 1, 2, 3)]


def test_a_long_text_leaves_no_powers_behind():
    decontaminate._Words("x" * 3_000_000)
    assert len(decontaminate._Words.powers[0]) <= 2 * decontaminate.POWERS
