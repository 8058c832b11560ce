"""Attempts, openings, notices and the search index on rows made for them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyspark.operators import attempts as at
from tallyspark.operators import searching, textops

T0 = dt.datetime(2024, 1, 1)


def test_attempts(spark):
    s, f, x = at.STARTED, at.FINISHED, at.FAILED
    log = {"a": [(s, 0, "EXTRACTION"), (f, 5, "RECONCILIATION")], "b": [(x, 0, "VALIDATION"), (s, 1, "EXTRACTION"), (s, 4, "EXTRACTION"), (x, 9, "RECONCILIATION"), (f, 11, "XLSX_PARSER"), (s, 20, "EXTRACTION")], "c": [(f, 3, "XLSX_PARSER")], "d": [(s, 1, "EXTRACTION"), ("OTHER", 2, "")], "e": [(s, 1, "EXTRACTION"), (f, 1, "RECONCILIATION")]}
    rows, i = [], 0
    for upload, events in log.items():
        for kind, sec, stage in events:
            i += 1
            rows.append((i, upload, kind, T0 + dt.timedelta(seconds=sec), stage, 3))
    df = spark.createDataFrame(rows + rows[:3] + [(99, None, s, T0, "", 1)], "event_id long, upload string, event_type string, created_at timestamp, stage string, page_count int")
    got = [(r.upload, r.attempt, r.outcome, r.stage, r.duration_ms, r.started_at is None, r.ended_at is None) for r in at.attempts(df).orderBy("upload", "attempt").collect()]
    assert got == [
        ("a", 1, "FINISHED", "RECONCILIATION", 5000, False, False), ("b", 1, "FAILED", "VALIDATION", None, True, False), ("b", 2, "REPEATED", "EXTRACTION", None, False, True), ("b", 3, "FAILED", "RECONCILIATION", 5000, False, False),
        ("b", 4, "FINISHED", "XLSX_PARSER", None, True, False), ("b", 5, "OPEN", "EXTRACTION", None, False, True), ("c", 1, "FINISHED", "XLSX_PARSER", None, True, False), ("d", 1, "OPEN", "EXTRACTION", None, False, True), ("e", 1, "FINISHED", "RECONCILIATION", 0, False, False),
    ]
    totals = {(r.outcome, r.stage): (r.n, r.mean_ms) for r in at.attempt_totals(at.attempts(df)).collect()}
    assert totals["OPEN", "EXTRACTION"] == (2, None) and totals["FINISHED", "RECONCILIATION"] == (2, 2500)


def test_openings(spark):
    processes = spark.createDataFrame([(1, 7, 50), (2, 7, 51), (3, 8, 50)], "process_id long, organization_id long, user_id long")
    documents = spark.createDataFrame([("d1", 1, "files/1", None, 7), ("d2", 1, None, T0, 7), ("d3", 1, None, None, 7), ("d4", 2, "files/4", None, 7), ("d5", 1, "files/5", None, 8)], "document_id string, process_id long, storage_path string, purged_at timestamp, organization_id long")
    requests = spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate([(1, "d1"), (1, "d2"), (1, "d3"), (2, "d4"), (3, "d1"), (1, "d4"), (1, "d5"), (9, "d1")])], "request_id long, process_id long, document_id string")
    run = lambda role: {r.request_id: r.message or r.storage_path for r in at.opened(requests, processes, documents, {"is_master": False, "role": role, "organization_id": 7, "user_id": 50}).collect()}
    assert run("ANALYST") == {0: "files/1", 1: at.PURGED, 2: at.MISSING, 3: at.UNKNOWN, 4: at.UNKNOWN, 5: at.MISSING, 6: at.MISSING, 7: at.UNKNOWN}
    assert run("ADMIN")[3] == "files/4"
    events = at.opening_events(at.opened(requests, processes, documents, {"is_master": False, "role": "ADMIN", "organization_id": 7, "user_id": 50}), {"organization_id": 7, "user_id": 50}).collect()
    assert {(r.entity_id, r.event_type, r.actor_id) for r in events} == {("d1", "DOCUMENT_VIEWED", "50"), ("d4", "DOCUMENT_VIEWED", "50")}


def test_notices(spark):
    rows = [(1, 1, "MINUTA", "COMPLETE", None, "OCR"), (1, 0, "SIOPI", "PARTIAL", None, "MIXED"), (2, 0, "SIOPI", "FAILED", "ilegível", "OCR"), (2, 2, "ITBI", "FAILED", "", "TEXT"), (3, 0, "SIOPI", "COMPLETE", "x", "TEXT"), (4, 1, "MINUTA", "FAILED", "b", None), (4, 0, "SIOPI", "FAILED", "a", None)]
    found = {r.process_id: r.notice for r in at.method_notices(spark.createDataFrame(rows, "process_id long, source_ord int, source string, status string, error string, method string")).collect()}
    assert found == {1: "Espelho SIOPI, Minuta exigiu OCR porque o PDF tinha pouco ou nenhum texto selecionável.", 2: "Espelho SIOPI: ilegível", 4: "Espelho SIOPI: a\nMinuta: b"}


def test_search_index(spark, tmp_path):
    rng = random.Random(1)
    words = ["João", "contrato", "ab", "Vila-Nova", "x", "Ção", "minuta.pdf", "OP-1234", ""]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(200)] + [(7, None)]
    df = spark.createDataFrame(rows, "k long, text string")
    path = f"{tmp_path}/index"
    searching.build(df, "k", path)
    for query in ("joao", "VILA NOVA", "minuta pdf op", "x", "ab", "contrato joao ab", "nothing here", "ção", "", "op 1234"):
        want = {r.k for r in textops.search(df, "k", [F.col("text")], query).collect()} if query else None
        got = {r.k for r in searching.search(spark, path, "k", query).collect()}
        assert got == want or query == "" and got, query
    plan = searching.search(spark, path, "k", "vila nova")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "postings" in line)
    assert "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(gram" in scan
