from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing, token_rollup

EVENT = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_history_of_the_corpus(spark, sf):
    model = Tokenizer.from_file(packing.default_tokenizer())
    first = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text or ""
        if text not in first or (r.doc_id, r.source, r.lang) < first[text]:
            first[text] = (r.doc_id, r.source, r.lang)
    want = defaultdict(lambda: [0, 0])
    for text, (_, source, lang) in first.items():
        total = want[source, lang, "byte_bpe_50k"]
        total[0] += 1
        total[1] += len(model.encode(token_rollup.squeezed(text), add_special_tokens=False).ids)
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in token_rollup.query(spark, sf).collect()}
    assert got == dict(want)


def test_commits(spark, tmp_path):
    path = str(tmp_path / "rollup")
    batch = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    now = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.totals(spark, path).collect()}
    assert token_rollup.totals(spark, path).count() == 0 and token_rollup.fold(spark, path) == 0
    one = batch(("insert", "a", "x", "t", 10, None), ("insert", "a", "x", "t", 10, None), ("insert", None, "x", "t", None, None))
    assert token_rollup.commit(path, "b1", one)
    assert not token_rollup.commit(path, "b1", one)  # a retry
    assert not token_rollup.commit(path, "b1", batch(("insert", "other", "x", "t", 1, None)))  # an id used again
    token_rollup.commit(path, "b2", batch(("revise", "a", "x", "t", 7, 10), ("insert", "b", "x", "t", 4, None)))
    token_rollup.commit(path, "b3", batch(("delete", "b", "x", "t", 4, None)).limit(1))
    token_rollup.commit(path, "b4", one.limit(0))
    (tmp_path / "rollup" / "batches" / "lost").mkdir()  # an attempt that failed
    want = {("a", "x", "t"): (2, 17), (None, "x", "t"): (1, 0)}
    assert now() == want
    with pytest.raises(Exception, match="unknown op"):
        token_rollup.commit(path, "b5", batch(("upsert", "a", "x", "t", 1, None)))
    with pytest.raises(ValueError):
        token_rollup.commit(path, "../b", one)
    assert now() == want


def test_a_failed_retry_leaves_the_committed_batch(spark, tmp_path):
    path = str(tmp_path / "rollup")
    batch = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    token_rollup.commit(path, "b1", batch(("insert", "a", "x", "t", 10, None)))
    bad = batch(("upsert", "a", "x", "t", 1, None))
    assert not token_rollup.commit(path, "b1", bad)
    with pytest.raises(Exception, match="unknown op"):
        token_rollup.commit(path, "b2", bad)
    assert token_rollup.totals(spark, path).first().n_tokens == 10
    assert token_rollup.commit(path, "b2", batch(("insert", "a", "x", "t", 5, None)))
    assert token_rollup.totals(spark, path).first().n_tokens == 15


def test_folds_keep_the_totals(spark, tmp_path):
    path = str(tmp_path / "rollup")
    batch = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    now = lambda: {r.source: (r.n_docs, r.n_tokens) for r in token_rollup.totals(spark, path).collect()}
    for k in range(4):
        token_rollup.commit(path, f"in-{k}", batch(("insert", "a", "x", "t", 10 + k, None), ("insert", f"s{k}", "x", "t", 1, None)))
        want = now()
        reader = token_rollup.totals(spark, path)
        assert token_rollup.fold(spark, path) == 1 and now() == want
        assert reader.count() == len(want)  # one who began before the fold
        assert token_rollup.fold(spark, path) == 0
        assert not token_rollup.commit(path, f"in-{k}", batch(("insert", "a", "x", "t", 10, None)))
    token_rollup.commit(path, "out", batch(("delete", "s0", "x", "t", 1, None)))
    assert now() == {"a": (4, 46), "s1": (1, 1), "s2": (1, 1), "s3": (1, 1)}
    assert len(list((tmp_path / "rollup" / "batches").iterdir())) < 5


def test_counts_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "a", "x", 3), (2, "  two  words ", None, None, 4), (2, "w " * 50_000, "a", "x", 5)], "doc_id long, text string, source string, lang string, tokens int")
    got = sorted((r.tokens, r.revised) for r in token_rollup.counted(df, packing.default_tokenizer()).collect())
    assert got[0] == (0, 0) and got[1][0] > got[1][1] == 2


def test_the_past_costs_nothing(spark, tmp_path):
    """Reading starts as many jobs after four commits as after forty, ids that folds took are still known, and few small files are left."""
    path = str(tmp_path / "rollup")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    batch = spark.createDataFrame([("insert", "a", "x", "t", 1, None)], EVENT)
    for i in range(40):
        assert token_rollup.commit(path, f"b{i}", batch)
        if i % 4 == 3:
            assert token_rollup.fold(spark, path) == 4
        if i in (4, 36):
            spark.sparkContext.setJobGroup(f"totals-{i}", "")
            found = token_rollup.totals(spark, path)
            jobs.append(len(tracker.getJobIdsForGroup(f"totals-{i}")))
            spark.sparkContext._jsc.clearJobGroup()
            assert found.first().n_docs == i + 1
    assert jobs[0] == jobs[1] <= 1
    assert not any(token_rollup.commit(path, f"b{i}", batch) for i in (0, 3, 20, 39)) and token_rollup.totals(spark, path).first().n_docs == 40
    count = lambda folder: len([p for p in (tmp_path / "rollup" / folder).iterdir() if not p.name.startswith(".")])
    assert count("commits") == 0 and count("folds") <= 2 and count("batches") <= 8 and count("totals") <= 2


def test_a_fold_that_breaks_off(spark, tmp_path, monkeypatch):
    """The totals are published and the commit files still there: they aren't added twice, and the next fold takes them away."""
    path = str(tmp_path / "rollup")
    batch = spark.createDataFrame([("insert", "a", "x", "t", 1, None)], EVENT)
    token_rollup.commit(path, "b1", batch)
    with monkeypatch.context() as m:
        m.setattr(token_rollup, "_forget", lambda *a: None)
        token_rollup.fold(spark, path)
    assert token_rollup.totals(spark, path).first().n_docs == 1 and token_rollup.fold(spark, path) == 0
    token_rollup.commit(path, "b2", batch)
    assert token_rollup.fold(spark, path) == 1 and token_rollup.totals(spark, path).first().n_docs == 2 and not token_rollup.commit(path, "b1", batch)
