import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import quality, toxicity


def area_under_curve(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert area_under_curve(*map(np.array, zip(*unseen, strict=True))) > 0.8


def test_attention_gradient():
    rng = np.random.default_rng(0)
    w = {"enc": rng.normal(size=(6, 4)), "enc0": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "c0": rng.normal(size=1)}
    model, x, first, y = quality.Model(np.zeros(6), np.ones(6), w), rng.normal(size=(9, 6)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, first)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradient(x, first, y)
    for name, value in w.items():
        for i in list(np.ndindex(value.shape))[:5]:
            old = value[i]
            value[i] = old + 1e-5
            up = loss()
            value[i] = old - 1e-5
            down = loss()
            value[i] = old
            assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-6


def test_quality_edges(spark):
    texts = [(1, None), (2, ""), (3, "word " * 50_000), (3, "same id"), (None, "no id"), (4, "\n\n a"), (5, "x" * 100_000), (6, "é\n")]
    df = spark.createDataFrame([(d, t, 0.7) for d, t in texts], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality.score(df, quality.fit(df, labels)).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(df, quality.fit(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), None).count() == 0


def test_quality_takes_the_smaller_of_two_labels(spark):
    rows = [(i, ("good words in a row " if i % 2 else "|| ## || $$ ") * 30) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once = [(i, i % 2) for i in range(60)]
    twice = once + [(i, 1) for i in range(0, 60, 2)]  # the even ones have both labels
    scores = lambda labels: [r.score for r in quality.score(df, quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))).orderBy("doc_id").collect()]
    assert np.allclose(scores(once), scores(twice))


def test_toxicity_of_held_out_documents(spark):
    """Fitted on two thirds of the labels, measured on the rest. (Shares at 0.1: 150 or so toxic rows unseen.)"""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 1
    chain = toxicity.fit(docs, labels.where(~unseen))
    rows = toxicity.score(docs, chain).join(labels.where(unseen & F.col("toxic").isNotNull()).select("doc_id", "toxic"), "doc_id").select("is_toxic", "toxic").collect()
    toxic, clean = [r.is_toxic for r in rows if r.toxic], [r.is_toxic for r in rows if not r.toxic]
    print(f"held out: {sum(toxic)} of {len(toxic)} toxic, {sum(clean)} of {len(clean)} others")
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_query(spark, sf):
    rows = toxicity.query(spark, sf)
    assert rows.columns == ["doc_id", "p_theme_1", "p_theme_2", "p_toxic", "is_toxic"] and rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def own(i):
    """A word of letters for a number."""
    return "".join(chr(97 + int(c)) for c in f"{i:05}")


def test_toxicity_categories_of_the_caller(spark):
    """Labels with columns of their own lead the chain; one category follows from words, the last from both."""
    kinds = {(0, 0): "calm words of no harm", (1, 0): "grim threat at once", (0, 1): "vile slur again", (1, 1): "grim threat and vile slur"}
    docs, labels = [], []
    for i in range(240):
        threat, slur = i % 2, i // 2 % 2
        docs.append((i, f"{kinds[threat, slur]} {own(i)} {own(i * 7)} {own(i * 13)}"))
        labels.append((i, threat, slur, int(threat or slur)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, threat int, slur int, toxic int")
    chain = toxicity.fit(df, lab, categories=("threat", "slur"))
    assert chain.categories == ("threat", "slur", "toxic") and [len(w) - 1 - len(chain.vocabulary) for w in chain.weights] == [0, 1, 2]
    rows = toxicity.score(df, chain).collect()
    assert all((r.p_threat > 0.5, r.p_slur > 0.5, r.is_toxic) == (bool(r.doc_id % 2), bool(r.doc_id // 2 % 2), bool(r.doc_id % 4)) for r in rows)


def test_toxicity_takes_the_larger_of_two_labels_and_keeps_texts_around_a_shared_passage(spark):
    shared = " ".join(own(i) for i in range(300, 306))
    docs = [(i, f"{shared} {'rotten filth' if i % 2 else 'fine day'} {own(i)}") for i in range(200)]
    labels = [(i, i % 2) for i in range(200)] + [(i, 0) for i in range(1, 200, 2)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert [r.is_toxic for r in toxicity.score(df, toxicity.fit(df, lab)).orderBy("doc_id").collect()] == [bool(i % 2) for i in range(200)]


def test_themes_are_words_that_stand_together():
    rng = np.random.default_rng(1)
    first = rng.random((200, 1)) < 0.5
    x = np.hstack([(first & (rng.random((200, 3)) < 0.8)), (~first & (rng.random((200, 3)) < 0.8))]).astype(float)
    assert list(toxicity.themes(x)) == [0, 0, 0, 1, 1, 1]
    assert list(toxicity.themes(x[:, :1])) == [0] and not len(toxicity.themes(x[:, :0]))


def test_toxicity_edges(spark):
    texts = [(1, None), (2, ""), (3, "idiot moron " * 20_000), (3, "nice"), (None, "no id"), (4, "12 !!")]
    df = spark.createDataFrame([(d, t, True) for d, t in texts], "doc_id long, text string, is_toxic boolean")
    none = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(df, none) is None
    assert toxicity.clean(df, none).columns == ["doc_id", "text"] or len(toxicity.clean(df, none).collect()) == len(texts)
    assert [r.is_toxic for r in toxicity.score(df, None).collect()] == [False] * len(texts)
    assert toxicity.score(df.limit(0), None).count() == 0
