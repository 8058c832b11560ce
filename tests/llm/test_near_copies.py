import os
import random

import corpus_pipeline
from tallyspark.llm import common, near_copies


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted():
    """Texts with edited copies of many degrees, and (smaller id, larger id) of all pairs at 0.8 and more, by brute force."""
    rng, out = random.Random(5), []
    for k in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 150, 400]))]
        out.append(" ".join(words))
        for _ in range(2):
            new = list(words)
            for _ in range(max(1, len(words) * rng.choice([1, 2, 3, 5]) // 200)):
                i = rng.randrange(len(new))
                new[i : i + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [new[i], "more"]])
            out.append(" ".join(new))
    out += ["", None, "  ", "Just few words", "just  FEW words", "just few others"]
    rng.shuffle(out)
    docs = list(enumerate(out, 1))
    sets = [(d, shingles(t or "")) for d, t in docs]
    pairs = [(d, e) for i, (d, a) in enumerate(sets) for e, b in sets[i + 1 :] if similarity(a, b) >= 0.8]
    return docs, pairs


def tops(docs, pairs):
    root = {d: d for d, _ in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {d: top(d) for d in root}


def test_links_are_those_of_all_pairs(spark):
    docs, pairs = planted()
    want = tops(docs, pairs)
    assert len(pairs) > 150
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_links_reach_on_where_no_pivot_is_near(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [(i + 1, " ".join(words[8 * i : 8 * i + 200])) for i in range(12)]  # neighbours are similar, ends are not
    got = near_copies.near_copies(spark.createDataFrame([*chain, (None, chain[0][1])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 1 for i in range(1, 13)} | {None: None}
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_judges_rows_by_their_text(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, ""), (9, None), (None, a), (None, a)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, whole string")
    got = near_copies.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (5, b), (7, c), (8, ""), (None, a), (None, a)], key=str)


def test_a_bucket_of_many_classes_that_are_not_similar(spark, monkeypatch):
    """Texts that share a long passage: nearly all pairs meet, and few are links. In several blocks."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    docs = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(22)]
        docs.append((2 * k + 1, " ".join(shared + own)))
        if k % 3 == 0:
            docs.append((2 * k, " ".join(shared + own[:-1] + [f"e{k}"])))
    rng.shuffle(docs)
    sets = [(d, shingles(t)) for d, t in docs]
    pairs = [(d, e) for i, (d, a) in enumerate(sets) for e, b in sets[i + 1 :] if similarity(a, b) >= 0.8]
    assert 0 < len(pairs) < 100
    monkeypatch.setattr(near_copies, "BLOCK", 12)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == tops(docs, pairs)


def test_disk_holds_the_texts_and_what_is_still_read(spark, monkeypatch):
    """What a step has used up goes, and buckets that the pivots cover aren't packed with their shingles again."""
    docs, pairs = planted()
    rows, kept = {}, common.stored

    def stored(df, name, *more):
        rows[name] = (out := kept(df, name, *more)).count()
        return out

    monkeypatch.setattr(near_copies, "stored", stored)
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = near_copies.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"))
    left = {name.rpartition("-")[0] for name in set(os.listdir(folder)) - before}
    assert rows["copies-named"] > 0 and rows["copies-blocks"] == 0
    assert {name for name in left if name.startswith("copies-")} == {"copies-rows", "copies-labels"}
    assert {r.doc_id for r in out.collect()} == set(tops(docs, pairs).values())


def test_pipeline_stages_on_planted_copies(spark, tmp_path):
    """All stages: of each group that brute force finds, the document of the smallest id is packed and no other."""
    docs, pairs = planted()
    want = tops(docs, pairs)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(want.values())
