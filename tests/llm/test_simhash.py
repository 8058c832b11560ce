import random

import xxhash

from tallyspark.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(prints):
    """prints: (doc_id, fp). By all pairs."""
    root = {d: d for d, _ in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, f) in enumerate(prints):
        for e, g in prints[:i]:
            if (f ^ g).bit_count() <= 2:
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d: top(d) for d, _ in prints}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in prints}


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "É a b c"), (8, "é a b c"), (9, "w" * 100_000), (9, "repeated id here"), (None, "no id at all"), (10, "a b " * 40_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, vertex string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    for d, t in texts:
        f = brute_print(t)
        assert (d, f - (1 << 64) if f >> 63 else f) in by
    assert {by[d, 0] for d in (1, 2, 3)} == {1} and [c for (d, _), c in by.items() if d == 5] == [4] and [c for (d, _), c in by.items() if d is None] == [None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_linked_through_it(spark):
    texts = [(3, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "quite another text here"), (9, "quite another text here"), (9, "a third one of its own"), (12, "nobody has this text at all")]
    prints = [(d, brute_print(t)) for d, t in texts]
    want = brute_components(prints)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == set(want.items()) == {(3, 3), (5, 3), (9, 3), (12, 12)}


def test_links_of_random_and_dense_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:  # chains of neighbours
        for _ in range(6):
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(500)}
    prints = list(enumerate(prints))
    want = brute_components(prints)
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in prints], "vertex long, fp long")
    for limit in (4096, 20):  # 20: nodes are factored down to the last level
        monkeypatch.setattr(simhash, "NODE_ROWS", limit)
        got = {r.vertex: r.component for r in simhash.components(simhash.links(df)).collect()}
        assert {d: got.get(d, d) for d, _ in prints} == want
