import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import packing


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(packing.default_tokenizer())


def whole(model, text):
    return np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def verify(model, docs, found, limit=1024):
    left = defaultdict(list)
    for d, t in docs:
        left[d].append(whole(model, t))
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        seqs[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(left)
    for d, texts in left.items():
        want = sorted((i, min(limit, len(x) - i), zlib.crc32(x[i : i + limit].tobytes()), len(x)) for x in texts for i in range(0, len(x), limit))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[d]) == want
    used = padded = 0
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit and len(rows) <= packing.MAX_SEGMENTS
        used += at
        padded += 0 if at & (at - 1) == 0 else limit - at
    return padded / used


def test_documents(spark, sf, model):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert verify(model, docs, packing.query(spark, sf).collect()) < 0.02


def test_edges(spark, model):
    docs = [(1, None), (2, ""), (3, "word " * 30_000), (4, "x" * 50_000), (4, "same id"), (None, "no id"), (5, "a <|endoftext|>  b"), (6, "tabs\t \n  and  spaces  "), *[(i, "tiny") for i in range(100, 600)]]
    df = spark.createDataFrame([(d, t, 3, 4) for d, t in docs], "doc_id long, text string, length int, offset int")
    verify(model, docs, packing.pack_documents(df).collect())
    assert packing.pack_documents(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.sampled_from(list("ab Z9'.,\n\t\r  é\x1c\x85  　😀!#")), max_size=60), st.text(max_size=40)))
def test_ranks_encode_as_the_library(text):
    e = packing.encoder(packing.default_tokenizer())
    assert e.ranked is not None
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", " \n\t", "\u3000"])
def test_long_white_space(model, space):
    """tiktoken panics on runs of over about a million."""
    e = packing.encoder(packing.default_tokenizer())
    for n in (packing.LONG_SPACE - 1, packing.LONG_SPACE, packing.LONG_SPACE + 1, 2_500_000):
        run = (space * n)[:n]
        for text in (f"a{run}b c", run):
            assert packing._has_long_space(text) == (n >= packing.LONG_SPACE)
            assert e.ids(text) == np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ranks_encode_every_code_point_as_the_library(model):
    """The pattern's classes are all that the two could see differently; every seventh code point, and all below U+3000."""
    e = packing.encoder(packing.default_tokenizer())
    points = [c for c in range(0x110000) if (c < 0x3000 or c % 7 == 0) and not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} '{chr(c)}" for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    for text, found in zip(texts, model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.ids(text), "<u4").tolist() == found.ids


def test_other_tokenizers_take_the_library():
    path = packing.default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k")
    e = packing.encoder(path)
    assert e.ranked is None and np.frombuffer(e.ids("Some words"), "<u4").tolist() == e.model.encode("Some words", add_special_tokens=False).ids


def test_limits_hold_in_every_dimension():
    rng = np.random.default_rng(1)
    sizes = np.stack([rng.integers(1, 101, 3000), rng.integers(1, 5, 3000), rng.integers(0, 60, 3000)], axis=1)
    limits = np.array([100, 8, 70])
    bins, place, n = packing.fill(sizes, limits)
    total = np.zeros((n, 3), int)
    np.add.at(total, bins, sizes)
    assert (total <= limits).all() and n <= 1.1 * max(sizes.sum(axis=0) / limits)
    assert len(set(zip(bins.tolist(), place.tolist(), strict=True))) == 3000
    with pytest.raises(ValueError):
        packing.fill(np.array([[101, 1, 1]]), limits)


def test_conversations_keep_three_limits_at_once(spark, sf):
    limits = {"tokens": 700, "segments": 6, "loss_tokens": 250}
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame([("big", 0, "user", "word " * 2000), ("long", 0, "assistant", "word " * 300), (None, 0, None, None), *[("many", i, "user", "a") for i in range(7)]], "conv_id string, turn int, role string, text string")
    every = turns.select(packing.F.col("conv_id").cast("string"), "turn", "role", "text").unionByName(odd)
    rows = packing.pack_conversations(every, limits).collect()
    sizes = {r.conv_id: (r.tokens, r.segments, r.loss_tokens) for r in rows}
    assert len(rows) == every.select("conv_id").distinct().count()
    model = packing.encoder(packing.default_tokenizer())
    want = {}
    for r in every.collect():
        t, s, loss = want.get(r.conv_id, (0, 0, 0))
        k = len(model.ids(r.text or "")) // 4 + 1
        want[r.conv_id] = (t + k, s + 1, loss + k * (r.role == "assistant"))
    assert sizes == want
    held = {}
    for r in rows:
        over = any(v > m for v, m in zip(sizes[r.conv_id], limits.values(), strict=True))
        assert (r.sequence_id is None) == over == (r.offset is None)
        if not over:
            held.setdefault(r.sequence_id, []).append(r)
    for group in held.values():
        assert all(sum(getattr(r, c) for r in group) <= m for c, m in limits.items())
        ends = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.tokens
    assert {"big", "long", "many"} <= {r.conv_id for r in rows if r.sequence_id is None}


def test_conversations_of_the_table(spark, sf, model):
    """Every conversation once, whole, by the library's counts; every sequence within all three limits, without gaps, and not many more than any packing needs."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    sizes = defaultdict(lambda: [0, 0, 0])
    for t in turns:
        n = len(whole(model, t.text))
        for i, x in enumerate((n, 1, n if t.role == "assistant" else 0)):
            sizes[str(t.conv_id)][i] += x
    limits = (packing.MAX_TOKENS, packing.MAX_SEGMENTS, packing.MAX_TOKENS // 2)
    found = packing.conversations_query(spark, sf).collect()
    assert {r.conv_id: [r.tokens, r.segments, r.loss_tokens] for r in found} == dict(sizes) and len(found) == len(sizes)
    sequences = defaultdict(list)
    for r in found:
        fits = all(x <= m for x, m in zip((r.tokens, r.segments, r.loss_tokens), limits, strict=True))
        assert (r.sequence_id is not None) == fits == (r.offset is not None)
        if fits:
            sequences[r.sequence_id].append(r)
    used = [0, 0, 0]
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.tokens
        sums = [sum(getattr(r, c) for r in rows) for c in ("tokens", "segments", "loss_tokens")]
        assert all(x <= m for x, m in zip(sums, limits, strict=True))
        used = [a + b for a, b in zip(used, sums, strict=True)]
    least = max(-(-u // m) for u, m in zip(used, limits, strict=True))
    assert len(sequences) <= 1.25 * least + 8

