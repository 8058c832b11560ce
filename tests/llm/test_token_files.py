import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import packing, token_files


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(token_files.default_tokenizer())


def one(encoder, text):
    values, counts = encoder.ids(pa.array([text], pa.string()))
    assert counts.tolist() == [len(values)]
    return values.tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("ab Z9'.,sStTdD\n\t\r  \x00\x1c\x7f\x85　é́ΣİßΑ日!#<|>")), max_size=40), st.text(max_size=30)), max_size=5))
def test_word_by_word_encodes_as_the_library(texts):
    e = token_files.encoder(token_files.default_tokenizer())
    assert e.by_word
    values, counts = e.ids(pa.array(texts, pa.string()))
    whole = [e.model.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in whole] and values.tolist() == sum(whole, [])


def test_every_code_point(model):
    e = token_files.encoder(token_files.default_tokenizer())
    points = [chr(c) for c in range(0x110000) if (c < 0x3000 or c % 11 == 0) and not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 500):
        text = " ".join(f"a{c}b{c} {c}x {c}" for c in points[i : i + 500])
        assert one(e, text) == model.encode(text, add_special_tokens=False).ids


def test_plain_signs_between_all_kinds(model):
    """Each sign that words are cut by here, beside letters, digits, signs and apostrophes."""
    e = token_files.encoder(token_files.default_tokenizer())
    signs = [chr(c) for c in range(0x21, 0x180)]
    for c in signs:
        words = [f"a{c}B", f"{c}{c}", f"'{c}", f"9{c}1", f".{c},", f"it'{c}{c}s", f"É{c}é", f"{c}'ll'S"]
        for w in words:
            assert one(e, w) == model.encode(w, add_special_tokens=False).ids, w
    low = sorted({c for s in signs for c in s.lower() if token_files.PLAIN.fullmatch(s)})
    assert [token_files._PIECES.findall(c + d) for c in low for d in low] == [regex.findall(token_files.PIECES, c + d) for c in low for d in low]
    assert token_files.PLAIN.fullmatch("Ünïcode'S1") and not token_files.PLAIN.fullmatch("İ") and not token_files.PLAIN.fullmatch("a\u0301")


def test_special_and_long(model, monkeypatch):
    e = token_files.WordEncoder(token_files.default_tokenizer())
    monkeypatch.setattr(token_files, "KNOWN", 20)  # the memory is emptied over and over
    for text in ("a <|endoftext|>b<|startoftext|> <|endoftext|>", "x" * 300_000, "don't I'LL 's " * 50, " ".join(f"w{i}" for i in range(3000)), "　".join("ab cd"), " \n" * 500_000):
        assert one(e, text) == model.encode(text, add_special_tokens=False).ids
    other = token_files.WordEncoder(packing.default_tokenizer())
    assert not other.by_word and one(other, " a  b\n") == other.model.encode(" a  b\n", add_special_tokens=False).ids


def expected(model, docs):
    """Per document in order of id: (doc_id, start, n_tokens, crc)."""
    out, at = [], 0
    for doc_id, text in docs:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark, sf, model):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in token_files.query(spark, sf).collect()) == expected(model, docs)


def test_edges(spark, tmp_path, model):
    docs = [(3, None), (1, ""), (2, "word " * 100_000), (9, " \t\n"), (5, "same"), (5, "same"), (5, "other"), (None, "no id"), (-4, "x" * 20_000)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, ids int, shard string")
    token_files.write(df, f"{tmp_path}/a")
    found = sorted((tuple(r) for r in token_files.checksums(token_files.documents(spark, f"{tmp_path}/a")).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, -4, 1, 2, 3, 5, 5, 5, 9]
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found[:-1])]).tolist()
    count = lambda rows: sorted(((r[0] is None, r[0] or 0), r[2], r[3]) for r in rows)
    assert count(found) == count(expected(model, docs))
    token_files.write(df.limit(0), f"{tmp_path}/none")
    assert token_files.documents(spark, f"{tmp_path}/none").count() == 0 and token_files.token_range(spark, f"{tmp_path}/none", 0, 9).count() == 0


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('tokens')}/files"
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("number"), F.col("id").cast("string"), F.repeat(F.lit("and more "), (F.col("id") % 40).cast("int"))).alias("text"))
    token_files.write(df, path, row_group=40_000, page=2_000, page_rows=100)
    return path


def test_files_are_laid_out_as_asked(files):
    names = sorted(glob.glob(f"{files}/tokens/*.parquet"))
    last = None
    for name in names:
        f = pq.ParquetFile(name)
        ids = f.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (last is None or ids[0] > last)  # ascending in files and across them
        last = ids[-1]
        assert f.metadata.num_row_groups > 1
        for g in range(f.metadata.num_row_groups):
            by = {f.metadata.row_group(g).column(c).path_in_schema: f.metadata.row_group(g).column(c) for c in range(f.metadata.num_columns)}
            assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings)
            for c in ("doc_id", "shard_start", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in by[c].encodings and by[c].has_offset_index and by[c].has_column_index
            assert by["ids.list.element"].has_offset_index
    assert last == 5999


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_selective_reads(spark, files):
    assert "ids" not in scans(token_files.metadata(spark, files))[0].split("ReadSchema")[1]
    some = token_files.documents(spark, files, 1000, 1010)
    assert any("GreaterThanOrEqual(doc_id,1000)" in s for s in scans(some)) and sorted(r.doc_id for r in some.collect()) == list(range(1000, 1011))


def test_ranges_of_the_stream(spark, files):
    rows = sorted(token_files.documents(spark, files).collect(), key=lambda r: r.start)
    stream = []
    for r in rows:
        assert r.start == len(stream) and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        stream += r.ids
    for begin, end in ((0, 1), (5, 5000), (len(stream) // 2, len(stream) // 2 + 77_777), (len(stream) - 3, len(stream) + 50), (len(stream), len(stream) + 9), (40, 40)):
        got = sorted(token_files.token_range(spark, files, begin, end).collect(), key=lambda r: r.start)
        assert sum((r.ids for r in got), []) == stream[begin:end]
        assert [r.start for r in got] == (np.cumsum([begin, *(len(r.ids) for r in got[:-1])]).tolist() if got else [])
