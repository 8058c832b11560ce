"""Rules that the tables' rows don't single out, each on a few rows made for it."""

from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions import normalize as n
from tallyspark.operators import evidence, ops, reconcile, registry

EVIDENCE = "process_id long, source_ord int, source string, field_id string, participant_id string, value string, confidence int"
CONTEXT = "process_id long, participating array<string>, unreadable array<string>, conflicts array<string>, issues array<string>, errors map<string,string>"
ALL = ["SIOPI", "MINUTA", "ITBI", "DADOS_RESERVA"]


def verdicts(spark, rows, participating=ALL, unreadable=(), conflicts=(), issues=(), errors=None, fields=None, rules=None):
    ev = spark.createDataFrame([(1, ALL.index(s), s, f, p, v, c) for s, f, p, v, c in rows], EVIDENCE)
    ctx = spark.createDataFrame([(1, list(participating), list(unreadable), list(conflicts), list(issues), errors or {})], CONTEXT)
    return reconcile.reconcile(ev, ctx, fields, rules)


def by_field(df):
    return {(r.field_id, r.participant_id): (r.status, r.rung, r.observation) for r in df.collect()}


def test_each_step_of_the_ladder(spark):
    row = lambda s, v, c=90, f="contract.number": (s, f, None, v, c)
    run = lambda rows, **kw: by_field(verdicts(spark, rows, fields=["contract.number"], **kw))["contract.number", None][:2]
    two = [row("SIOPI", "A 1"), row("MINUTA", " a  1 ")]
    assert run(two) == ("MATCH", 6) and run(two, conflicts=["SIOPI:contract.number"]) == ("REVIEW_REQUIRED", 1) and run(two, issues=["MINUTA:contract.number"]) == ("REVIEW_REQUIRED", 2)
    assert run(two, unreadable=["SIOPI"]) == ("SOURCE_UNREADABLE", 3) and run(two, unreadable=["ITBI"]) == ("MATCH", 6)  # the field isn't expected of it
    assert run([row("SIOPI", "A"), row("MINUTA", None)]) == ("REVIEW_REQUIRED", 4) and run([]) == ("REVIEW_REQUIRED", 4)
    assert run([row("SIOPI", "A", 69), row("MINUTA", "A")]) == ("REVIEW_REQUIRED", 5)
    assert run([row("SIOPI", "CONTRATO 123456789"), row("MINUTA", "CONTRATO 123456780")]) == ("REVIEW_REQUIRED", 8) and run([row("SIOPI", "A"), row("MINUTA", "B")]) == ("DIVERGENCE", 9)
    assert by_field(verdicts(spark, two, participating=["ITBI"], fields=["contract.date"])) == {}


def test_optional_amounts(spark):
    run = lambda rows, **kw: by_field(verdicts(spark, [(s, "financial.fgts", None, v, 90) for s, v in rows], fields=["financial.fgts"], **kw))
    assert run([("SIOPI", None), ("MINUTA", None)]) == {} and run([("SIOPI", "R$ 5,00"), ("DADOS_RESERVA", " ")]) == {}  # the reservation takes part and says nothing
    assert run([("SIOPI", None)], participating=["SIOPI", "MINUTA"])["financial.fgts", None][:2] == ("MATCH", 4) and run([("DADOS_RESERVA", "0,00")])["financial.fgts", None][:2] == ("MATCH", 4)
    assert run([("DADOS_RESERVA", "0,00"), ("SIOPI", "R$ 5,00")])["financial.fgts", None][:2] == ("DIVERGENCE", 9)


def test_buyers_are_kept_apart(spark):
    rows = [("SIOPI", "buyer.name", "b1", "Ana", 90), ("MINUTA", "buyer.name", "b1", "ANA", 90), ("SIOPI", "buyer.name", "b2", None, 90), ("SIOPI", "buyer.rg", "b2", "12", 90), ("MINUTA", "buyer.rg", "b2", "13", 90), ("SIOPI", "buyer.rg", "b3", "9", 90)]
    got = by_field(verdicts(spark, rows, fields=["buyer.name", "buyer.rg"]))
    assert set(got) == {("buyer.name", "b1"), ("buyer.name", "b2"), ("buyer.rg", "b1"), ("buyer.rg", "b2")}  # nobody names b3
    assert got["buyer.name", "b1"][0] == "MATCH" and got["buyer.rg", "b2"][0] == "DIVERGENCE" and "o comprador Comprador 2 não encontrado" in got["buyer.name", "b2"][2] and "o comprador Ana não encontrado" in got["buyer.rg", "b1"][2]
    assert {(r.participant_id, r.label) for r in reconcile.participants(verdicts(spark, rows, fields=["buyer.name"])).collect()} == {("b1", "Ana"), ("b2", "Comprador 2")}
    told = by_field(verdicts(spark, rows, unreadable=["SIOPI"], errors={"SIOPI": "ilegível"}, fields=["buyer.name"]))
    assert told["buyer.name", "b1"][2].endswith("porque a fonte Espelho SIOPI não foi interpretada. Motivo: Espelho SIOPI: ilegível")


def test_one_approved_field_settles_itself_alone(spark):
    rows = [(s, f, None, f"{s} {f}", 90) for f in ("contract.number", "signature.city") for s in ("SIOPI", "MINUTA")]
    found = verdicts(spark, rows, fields=["contract.number", "signature.city"])
    log = lambda *r: spark.createDataFrame([(1, f, q, 7, a) for f, q, a in r], "process_id long, field_id string, seq int, reviewer_id int, action string")
    status = lambda *r: ops.final_status(found, ops.review_state(log(*r))).first().final_status
    one = ("contract.number", 1, "APPROVED")
    assert status(one) == "PENDING_REVIEW" and status(one, ("signature.city", 2, "APPROVED")) == "FULLY_CHECKED"
    assert status(one, ("signature.city", 2, "APPROVED"), ("contract.number", 3, "REVOKED")) == "PENDING_REVIEW" and status(one, ("signature.city", 2, "REJECTED")) == "PENDING_REVIEW"
    got = ops.review_progress(found, ops.review_state(log(one))).first()
    assert (got.total, got.reviewed, got.unresolved, got.checked_percent) == (2, 1, 1, 50)
    kept = reconcile.filter_results(found, ops.review_state(log(one)), "MATCH").collect()
    assert [r.field_id for r in kept] == ["contract.number"]
    empty = spark.createDataFrame([], "process_id long, status string, updated_at date")
    assert ops.persisted(empty, found).count() == 0


def test_quality_reports_on_every_source(spark):
    rows = spark.createDataFrame([(1, "IPTU", "property.iptu", "1", 80), (1, "FRACOES", "property.iptu", "1", 74), (1, "FRACOES", "property.privateArea", " ", 99)], "process_id long, source string, field_id string, value string, confidence int")
    taking = spark.createDataFrame([(1, s, s == "ITBI") for s in ("IPTU", "FRACOES", "ITBI", "CERTIDAO", "MATRICULA")] + [(2, "CERTIDAO", True)], "process_id long, source string, failed boolean")
    keys = lambda *r: spark.createDataFrame(list(r), "process_id long, source string, field_id string")
    got = {(r.process_id, r.source): (r.status, r.coverage, r.n_missing, r.n_low) for r in evidence.quality(rows, taking, keys(), keys()).collect()}
    assert got == {(1, "IPTU"): ("COMPLETE", 100, 0, 0), (1, "FRACOES"): ("PARTIAL", 50, 1, 1), (1, "ITBI"): ("FAILED", 0, 7, 0), (1, "CERTIDAO"): ("NOT_ASSESSED", 100, 0, 0), (1, "MATRICULA"): ("PARTIAL", 0, 4, 0), (2, "CERTIDAO"): ("FAILED", 0, 0, 0)}
    marked = lambda **kw: {r.source: r.status for r in evidence.quality(rows, taking, kw.get("a", keys()), kw.get("b", keys())).where("process_id = 1").collect()}["IPTU"]
    assert marked(a=keys((1, "IPTU", "property.iptu"))) == "PARTIAL" and marked(b=keys((1, "IPTU", "property.iptu::b1"))) == "PARTIAL"


def test_alerts_take_the_entity_where_no_actor_is(spark):
    at = "2024-01-01 12:00:00"
    rows = [("LOGIN_FAILED", None, "p1", m) for m in (1, 5, 14)] + [("LOGIN_FAILED", 7, None, m) for m in (1, 16, 17)] + [("LOGIN_FAILED", None, None, m) for m in (1, 2, 3)] + [("DOCUMENT_RETENTION_FAILED", None, None, 1439), ("DOCUMENT_VIEWED", 1, None, 1)]
    events = spark.createDataFrame(rows, "event_type string, actor_id long, entity_id string, m int").withColumn("created_at", F.lit(at).cast("timestamp") - F.make_dt_interval(mins=F.col("m")))
    assert {tuple(r) for r in ops.alerts(events, at).collect()} == {("LOGIN_FAILED", "p1", 3), ("LOGIN_FAILED", "unknown", 3), ("DOCUMENT_RETENTION_FAILED", "retention", 1)}


def test_units(spark):
    kind = "unit_key string, tower string, unit string, typology string, private_area string, common_area string, total_area string, ideal_fraction string, iptu string, confidence int"
    row = lambda k, unit, area="50,0", common=None, c=80: (k, "A", unit, None, area, common, None, None, None, c)
    ocr = spark.createDataFrame([row("1", None), row("2", "2"), row("3", "3", c=60), row("4", "4")], kind)
    vision = spark.createDataFrame([row("1", None, "50.0", ""), row("2", "2", common="9"), row("5", "5", c=98)], kind)
    got = {r.unit_key: (r.outcome, r.confidence, r.review) for r in registry.reconcile_units(ocr, vision).collect()}
    assert got["1"] == ("AGREED", 85, None) and got["2"] == ("DIVERGED", 69, "Torre A · apartamento 2 tem divergência entre OCR e visão da IA.") and got["3"][:2] == ("ONLY_OCR", 60) and got["5"][:2] == ("ONLY_VISION", 69)
    keys = spark.createDataFrame([("T 9",), ("T 10",), ("T 1234567890123",), ("T 234567890123",), ("T 010",)], "v string").select("v", registry.natural_order("v").alias("k")).orderBy("k", "v").collect()
    assert [r.v for r in keys] == ["T 9", "T 010", "T 10", "T 234567890123", "T 1234567890123"]


def test_amounts_and_dates(spark):
    cases = {"R$ 1.234,56": "1234.56", "1,234.56": "1234.56", "1.234": "1234.00", "12,5": "125.00", "0,0022143433": "22143433.00", "12-3": "12.00", "-5,00": "-5.00", "sem valor": "SEM VALOR", "": "", "1.2.3,40": "123.40", " R$  7 ": "7.00"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", n.money("v").alias("x")).collect()
    assert {r.v: r.x for r in got} == cases
    dates = {"1/2/21": "2021-02-01", "31-02-2024": "2024-02-31", "5 de março de 2020": "2020-03-05", "5 de foo de 2020": "2020-01-05", "sem data": "SEM DATA", "Çedilha  ñ": "CEDILHA N", "straße^": "STRASSE", "": ""}
    assert {r.v: r.x for r in spark.createDataFrame([(k,) for k in dates], "v string").select("v", n.date("v").alias("x")).collect()} == dates


def test_the_checklist_is_a_real_union(spark):
    rows = {r.field_id: r for r in catalog.checklist(spark).collect()}
    assert len(rows) == 53 and [f for f, *_ in catalog.fields()] == sorted(rows, key=lambda f: rows[f].ord)
    assert rows["buyer.cpf"].category == "Dados do adquirente" and rows["buyer.cpf"].ord == 7 and rows["property.type"].label == "Tipo do imóvel" and "financial.financedValue" not in rows
    assert all((rows[f].field_type, rows[f].allow_multiple, rows[f].expected_sources) == (k, m, s) for f, _, k, m, s in catalog.fields())


def test_kinds_of_processes(spark):
    rows = spark.createDataFrame([(1, 0, "PRINT", "buyer.cpf", "123.456.789-01", 70), (1, 1, "TIFF", "buyer.cpf", "12345678902", 90), (1, 2, "PDF", "buyer.cpf", "12345678901", 95), (1, 3, "WORD", "buyer.name", " ", 99)], "process_id long, doc_ord int, type string, field_id string, value string, confidence int")
    sides = evidence.two_sides(rows)
    assert {(r.source, r.field_id): r.value for r in sides.collect()} == {("IMAGE", "buyer.cpf"): "12345678902", ("DOCUMENT", "buyer.cpf"): "12345678901"}
    got = {r.field_id: (r.status, r.observation) for r in reconcile.checked("ITBI", sides).collect()}
    assert len(got) == 28 and got["buyer.cpf"] == ("DIVERGENCE", "CPF diverge na posição 11: imagem mostra ...345678902, documento mostra ...345678901.")
    assert got["buyer.name"][0] == "NOT_FOUND" and got["fortaleza.guideNumber"][0] == "NOT_APPLICABLE"
    ctx = spark.createDataFrame([(1, ["SIOPI", "MINUTA"], [], [], [])], CONTEXT.replace(", errors map<string,string>", ""))
    ev = spark.createDataFrame([(1, 0, "SIOPI", "buyer.cpf", None, "1", 90)], EVIDENCE)
    assert {r.field_id for r in reconcile.checked("RECONCILIATION", ev, ctx).collect()} >= {"buyer.cpf", "contract.date"}


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], EVIDENCE)
    ctx = spark.createDataFrame([], CONTEXT)
    assert reconcile.reconcile(none, ctx).count() == 0 and reconcile.rule_candidates(none).count() == 0
    assert evidence.missing_critical(none).count() == 0 and reconcile.missing_by_source(reconcile.reconcile(none, ctx), ctx).count() == 0
    taking = spark.createDataFrame([], "process_id long, source string, failed boolean")
    keys = spark.createDataFrame([], "process_id long, source string, field_id string")
    assert evidence.quality(none, taking, keys, keys).count() == 0


def test_rules_decide_in_the_ladder(spark):
    """Words that a name may carry leave nothing of one source's value, and the others agree: a rule makes them equal, and says how often people approved it."""
    row = lambda s, v: (s, "property.development", None, v, 95)
    rules = lambda *r: spark.createDataFrame(list(r), "field_id string, rule_kind string, signature string, occurrence_count int")
    three = [row("SIOPI", "Residencial"), row("MINUTA", "Vista Costeira Condomínio Clube"), row("ITBI", "VISTA COSTEIRA")]
    sign = "RESIDENCIAL || VISTA COSTEIRA || VISTA COSTEIRA CONDOMINIO CLUBE"
    run = lambda rows, r: by_field(verdicts(spark, rows, fields=["property.development", "buyer.maritalStatus"], rules=r))["property.development", None]
    known = "Valores equivalentes: variação textual já normalizada para este campo."
    assert run(three, None) == ("MATCH", 7, known) == run(three, rules(("property.development", "TEXT_ALIAS", "other", 3)))
    assert run(three, rules(("property.development", "TEXT_ALIAS", sign, 1)))[2] == "Valores equivalentes por aprendizado supervisionado (1 validação humana anterior)."
    many = rules(("property.development", "TEXT_ALIAS", sign, 4), ("property.development", "TEXT_ALIAS", sign, 2), ("buyer.maritalStatus", "TEXT_ALIAS", sign, 9))
    assert run(three, many)[2] == "Valores equivalentes por aprendizado supervisionado (4 validaçãoões humanas anteriores)."
    # Two that agree after folding need no rule, one with words doesn't make two, and a third name is a divergence.
    assert run(three[1:], many) == ("MATCH", 6, "Valores equivalentes após normalização.")
    assert run(three[:2], many)[0] != "MATCH" and run([*three[1:], row("SIOPI", "Outra Torre")], many)[0] == "DIVERGENCE"
    # What comes before it in the ladder still does.
    assert by_field(verdicts(spark, three, fields=["property.development"], rules=many, issues=["SIOPI:property.development"]))["property.development", None][1] == 2


def test_rules_by_broadcast_and_by_shuffle(spark, monkeypatch):
    each = spark.createDataFrame([(i, "f", "k", f"s{i % 3}" if i % 4 else None) for i in range(40)], "id long, field_id string, rule_kind string, signature string")
    rules = spark.createDataFrame([("f", "k", "s1", 5), ("f", "k", "s1", 2), ("g", "k", "s2", 1)], "field_id string, rule_kind string, signature string, occurrence_count int")
    want = sorted((i, f"s{i % 3}" if i % 4 else None, 5 if i % 4 and i % 3 == 1 else None) for i in range(40))
    for limit in (100, 1):
        monkeypatch.setattr(reconcile, "RULES_SENT", limit)
        got = reconcile.with_rules(each, rules)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (limit == 100)
        assert sorted((r.id, r.signature, r.occurrence_count) for r in got.collect()) == want
