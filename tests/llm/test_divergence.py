import random
import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import divergence


def brute(docs, least, top=50):
    """Every term of every pair, by the prices as they are defined."""
    occ, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        occ[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        every = Counter()
        for (of, _), n in occ.items():
            if of == lang:
                every.update({t: n[t] for t in kept})

        def prices(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}  # noqa: B023

        mine, whole = prices(occ[lang, source]), prices(every)
        pair = [(sum(abs(mine[t] - p) for t, p in prices(occ[lang, o]).items()), o) for of, o in groups if of == lang and o != source]
        term = [(mine[t] - whole[t], t) for t in kept if occ[lang, source][t] and mine[t] > whole[t]]
        for part, rows in (("pair", pair), ("term", term)):
            rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(rows) if part == "pair" or i < top]
    return sorted(out)


SCHEMA = "lang string, source string, text string, n long, p string"


@pytest.mark.parametrize("seed", range(3))
def test_against_every_term(spark, seed):
    """Sources of very different sizes, so that what one lacks may cost more than what it has."""
    rng = random.Random(seed)
    words = ["a", "B", "cc", "Éa", "日本", "x-y", "zz9z", *(f"w{chr(97 + i)}" for i in range(20))]
    docs = []
    for _ in range(150):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "", None, "ß"])
        docs.append((rng.choice(["en", "en", "de", None]), source, rng.choice(["", None, *[" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 400 if source == "s0" else 12))) for _ in range(8)]])))
    docs += docs[:20]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)
    assert sorted(tuple(r) for r in divergence.source_divergence(df, 4, 7).collect()) == brute(docs, 4, 7)


def test_edges(spark):
    df = spark.createDataFrame([("en", "one", "only source", 1, "")], SCHEMA)
    assert divergence.source_divergence(df).count() == 0 and divergence.source_divergence(df.limit(0)).count() == 0
    docs = [("en", "a", None), ("en", "b", "7 +- 8"), ("en", "c", "word " * 300_000), ("fr", "x", "mot"), ("fr", "y", "")]
    df = spark.createDataFrame([(*d, 1, "") for d in docs], SCHEMA)
    found = sorted(tuple(r) for r in divergence.source_divergence(df, 2).collect())
    assert found == brute(docs, 2) and {r[4] for r in found} == {0}
    assert sorted(tuple(r) for r in divergence.source_divergence(df, 1).collect()) == brute(docs, 1)


def test_counts_are_handed_on_in_pieces(spark):
    df = spark.createDataFrame([("en", f"s{i % 3}", f"w{chr(97 + i % 26)} common x{chr(97 + i % 7)}", 1, "") for i in range(400)], SCHEMA)
    one, many = (sorted(tuple(r) for r in divergence.term_counts(df, h).na.fill("").collect()) for h in (10**6, 1))
    assert one == many and sum(r[3] for r in one) == 1200


def test_large_counts_are_exact(spark):
    n = 9_000_000_000_000_000
    rows = spark.createDataFrame([(n, 4 * n, 3)], "n long, total long, kept long")
    from pyspark.sql import functions as F

    got = rows.select(divergence.price(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (4 * n + 15)


def test_query(spark, sf, oracle, rows):
    assert rows(divergence.query(spark, sf)) == oracle(divergence.ORACLE, sf)
