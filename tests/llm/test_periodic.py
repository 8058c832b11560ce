import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import periodic


def brute(w):
    """Every lag word by word; a period counts where no shorter one holds."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(6, 4 * q) and not any(w[s : s + size - d] == w[s + d : s + size] for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20), st.integers(0, 70)), max_size=4))
def test_runs(words, spans):
    for a, q, e in spans:
        for i in range(a, min(e, len(words))):
            words[i] = words[a + (i - a) % q]
    assert periodic.periodic_runs(words) == brute(words)


def test_longer_runs():
    rng = random.Random(3)
    for _ in range(60):
        n, words = rng.randint(200, 700), []
        words = [b"%d" % rng.randrange(rng.choice([2, 9, 400])) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(n)
            q, e = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
            for i in range(a, e):
                words[i] = words[a + (i - a) % q]
        assert periodic.periodic_runs(words) == brute(words)
    with pytest.raises(ValueError):
        periodic.periodic_runs([b"a"] * 9, min_power=3)


def test_long_texts_do_not_try_every_lag():
    """A million words: one number over and over, and copies with a word between them."""
    assert periodic.periodic_runs([b"a"] * 1_000_000) == [(0, 1_000_000, 1)]
    part = [b"a"] * 300_000
    assert periodic.periodic_runs([*part, b"b", *part, b"c", *part]) == [(0, 300_000, 1), (300_001, 300_000, 1), (600_002, 300_000, 1)]


def expected(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_query(spark, sf):
    found = {tuple(r) for r in periodic.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert found == {expected(r.doc_id, r.text) for r in docs}
    assert sum(r[1] > 0 for r in found) > 10


def test_edges(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a b a b a b a b", "x " * 100, "x " * 100, "é é é é é é ende", "a\x1ca a\x85a  a a a", "w" * 1_000_000, "Ja " * 200_000]
    rows = [(i if i != 5 else 4, t, 7, "s") for i, t in enumerate(texts)] + [(None, "n n n n n n n", 7, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, whole string")
    out = periodic.with_runs(df.withColumn("copy", F.col("text")))
    assert out.columns == ["doc_id", "whole", "copy", "n_words", "runs", "collapsed"]
    got = {(r.doc_id, r.copy): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    for i, t in [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 1000]:
        w = (t or "").encode().split()
        runs = brute(w)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        assert got[i, t] == (len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    assert got[9, texts[9]] == (200_000, [(0, 200_000, 1)], "Ja") and got[8, texts[8]][:2] == (1, [])
    assert len(out.collect()) == len(rows) and periodic.with_runs(df.limit(0)).count() == 0
