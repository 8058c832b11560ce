import hashlib
import re

from pyspark.sql import functions as F

from tallyspark.llm import secrets

KINDS = {
    "assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("(AKIA[A-Z0-9]+)"),
    "hex": re.compile("([0-9a-f]+)"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def base(text):
    found = []
    for k, (name, p) in enumerate(KINDS.items()):
        found += [(m.start(), k, m.end(), name) for m in p.finditer(text or "") if len(m[1]) >= LEAST[name]]
    return [(name, a, z) for a, _, z, name in sorted(found)]


def test_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = secrets.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in want) for k in KINDS]
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_ownership_and_edges(spark):
    live, copied = "Zq8xW2mP7tLk4Rv9", "Hh3Kd9Qw5Zx1Lm7T"
    docs = [
        (1, f"password = {live}", "a"), (2, f"password = {copied}", "a"), (3, f"TOKEN: '{copied}'", "b"), (4, None, "a"), (5, "", None), (5, f"secret={live}x", None), (None, f"api_key:{live}y", "c"),
        (6, "w " * 100_000 + "token=abc", "a"), (7, "é token = abcdef1 AKIA" + "A" * 16 + " " + "0a" * 12, "a"), (8, f"password = {copied}", "c"), (8, f"password = {copied}", "c"),
    ]
    df = spark.createDataFrame([(d, t, s, "x") for d, t, s in docs], "doc_id long, text string, source string, owners string")
    rows = secrets.scan(df, F.col("source"), F.col("source")).collect()
    assert len(rows) == len(docs)
    judged = {(r.doc_id, j.digest): j for r in rows for j in r.judged or []}
    digest = lambda v: hashlib.sha256(v.encode()).hexdigest()[:32]
    assert judged[1, digest(live)].live and not judged[2, digest(copied)].live and judged[2, digest(copied)].owners == 3
    assert judged[None, digest(live + "y")].live and judged[5, digest(live + "x")].live
    assert [(f.start, f.kind) for r in rows if r.doc_id == 7 for f in r.found] == [(2, 0), (18, 1), (39, 2)]
    assert secrets.scan(df.limit(0), F.col("source"), F.col("source")).count() == 0


def test_hot_values_are_judged_like_others(spark, monkeypatch):
    monkeypatch.setattr(secrets, "HOT", 3)
    docs = [(i, f"password = Zq8xW2mP7tLk4Rv9 token={i}abcdefgh", f"o{i % 3}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = secrets.scan(df, F.col("source"), F.col("source")).collect()
    assert sorted((r.doc_id, [(j.owners, j.repositories, j.live) for j in r.judged]) for r in rows) == [(i, [(3, 3, False), (1, 1, True)]) for i in range(30)]


def test_very_many_spans_are_swept(spark):
    text = " ".join(f"password = secret{i:06}" for i in range(20_000)) + " " + "Ab3" * 12
    import time

    began = time.perf_counter()
    found = secrets.candidates(text)
    assert len(found) == 20_000 and time.perf_counter() - began < 3
    token = "q7Rk2ZpX9vLm4TnB8cWd1FgH6jKs3QyE"
    assert [k for _, k, _, _ in secrets.candidates(f"{token} password={token} {token}")] == [3, 0, 3]
