"""Layered readings: cases of one document each, and the way from texts to consolidated fields."""

import pytest

from tallyspark.functions import catalog
from tallyspark.operators import layers

DOCS = "process_id long, source string, doc_ord int, text string, failed boolean"
READINGS = "process_id long, source string, doc_ord int, layer string, nth int, field_id string, participant_id string, value string, confidence int, raw string"


def run(spark, source, text, readings, failed=False):
    docs = spark.createDataFrame([(1, source, 0, text, failed)], DOCS)
    rows = spark.createDataFrame([(1, source, 0, layer, i, f, None, v, c, raw) for i, (layer, f, v, c, raw) in enumerate(readings)], READINGS)
    return layers.layered(docs, rows, sources=[source])


def one(df):
    r = df.collect()
    assert len(r) == 1
    r = r[0]
    return r.deterministic, r.asked, r.recovered, list(r.reread), {x.field_id: (x.layer, x.value) for x in r.chosen}


def test_texts(spark):
    text = "Instrumento\nnº do contrato: 8.5.77"
    model = [("PROVIDER", "contract.number", "other", 99, ""), ("PROVIDER", "buyer.name", "Ana", 90, "Ana"), ("PROVIDER", "buyer.cpf", "  ", 90, ""), ("RECOVERY", "buyer.cpf", "123", 60, ""), ("RECOVERY", "buyer.name", "Eva", 99, ""), ("RECOVERY", "signature.city", "X", 99, "")]
    deterministic, asked, recovered, reread, chosen = one(run(spark, "MINUTA", text, model))
    assert deterministic == ["contract.number"] and recovered == ["buyer.cpf"] and reread == []
    assert asked == sorted(set(catalog.CRITICAL["MINUTA"].split()) - {"contract.number", "buyer.name"})
    # Patterns before the model, the model before rereading, and rereading only of what was asked for.
    assert chosen == {"contract.number": ("DETERMINISTIC", "8.5.77"), "buyer.name": ("PROVIDER", "Ana"), "buyer.cpf": ("RECOVERY", "123")}
    # The model didn't answer: nothing is asked again.
    assert one(run(spark, "MINUTA", text, [("RECOVERY", "buyer.cpf", "123", 60, "")], failed=True)) == (["contract.number"], [], [], [], {"contract.number": ("DETERMINISTIC", "8.5.77")})
    # A source without critical fields, and a null text.
    assert one(run(spark, "CERTIDAO", None, [("PROVIDER", "buyer.name", "Ana", 90, "")])) == ([], [], [], [], {"buyer.name": ("PROVIDER", "Ana")})


NAME = ("FOCUSED", "buyer.name", "Ana Souza", 90, "cliente Ana Souza")
TOTAL, FINANCING = ("FOCUSED", "financial.totalValue", "R$ 5,00", 85, "valor total R$ 5,00"), ("FOCUSED", "financial.financing", "R$ 4,00", 85, "financiamento R$ 4,00")


@pytest.mark.parametrize(
    ("text", "readings", "asked", "reread"),
    [
        ("", [], ["identity", "payment", "unit"], ["IDENTITY", "UNIT", "PAYMENT", "GENERIC"]), ("", [NAME], ["identity"], ["IDENTITY", "GENERIC"]), ("", [NAME, TOTAL], ["identity", "payment"], ["PAYMENT", "IDENTITY", "GENERIC"]),
        ("ver matrícula", [TOTAL, FINANCING], ["unit"], ["UNIT", "GENERIC"]), ("sinal e mensal", [TOTAL, FINANCING], [], []), ("sinal", [TOTAL], ["payment"], ["PAYMENT", "GENERIC"]), ("valor aprovado", [FINANCING, NAME], ["identity", "payment"], ["PAYMENT", "SUMMARY", "IDENTITY", "GENERIC"]),
        # Nothing with a text to show for it: the amounts are read besides what the text speaks of.
        ("e-mail", [("FOCUSED", "buyer.phone", "85 99999", 60, "85 99999")], ["identity", "payment"], ["PAYMENT", "IDENTITY", "GENERIC"]),
    ],
)
def test_reservations_are_read_again(spark, text, readings, asked, reread):
    got = one(run(spark, "DADOS_RESERVA", text, readings))
    assert got[1] == asked and sorted(got[3]) == sorted(reread)


def test_the_generic_reading_is_the_last_resort(spark):
    """What the directed readings complete needs no more; what none was asked for doesn't count."""
    again = [("PAYMENT", "financial.totalValue", "R$ 9,00", 99, "valor do contrato R$ 9,00"), ("PAYMENT", "financial.financing", "R$ 3,00", 80, "financiamento R$ 3,00"), ("GENERIC", "buyer.name", "Eva Lima", 99, "Eva Lima"), ("UNIT", "property.unit", "302", 99, "unidade 302")]
    _, asked, recovered, reread, chosen = one(run(spark, "DADOS_RESERVA", "sinal", [TOTAL, *again]))
    assert (asked, recovered, reread) == (["payment"], ["financial.financing"], ["PAYMENT"])
    assert chosen == {"financial.totalValue": ("PAYMENT", "R$ 9,00"), "financial.financing": ("PAYMENT", "R$ 3,00"), "financial.downPayment": ("CALCULATED", "R$\xa06,00")}  # 174 points before 160
    # A value that its text doesn't hold is no reading.
    assert one(run(spark, "DADOS_RESERVA", "sinal", [TOTAL, ("PAYMENT", "financial.totalValue", "R$ 9,00", 99, "nada")]))[4] == {"financial.totalValue": ("FOCUSED", "R$ 5,00")}


def test_from_texts_to_consolidated_fields(spark):
    docs = spark.createDataFrame([(1, "MINUTA", 0, "nº do contrato: 8.5.77", False), (1, "MINUTA", 1, "nº do contrato: 8.6.77\nAgência: 12-5", False), (2, "MINUTA", 0, "", False)], DOCS)
    rows = spark.createDataFrame([(1, "MINUTA", 0, "PROVIDER", 0, "buyer.name", None, "Ana Souza", 90, "a compradora Ana Souza"), (1, "MINUTA", 1, "PROVIDER", 0, "buyer.name", "buyer_1", "ANA SOUZA", 95, "ANA SOUZA"), (2, "MINUTA", 0, "PROVIDER", 0, "buyer.name", None, "Rui", 90, "sem nome")], READINGS)
    values, conflicts, issues = layers.consolidated(layers.layered(docs, rows, sources=["MINUTA"]))
    assert {(r.process_id, r.field_id, r.participant_id): (r.value, r.confidence) for r in values.collect()} == {(1, "contract.number", None): ("8.5.77", 94), (1, "contract.agencyCode", None): ("12-5", 90), (1, "buyer.name", "buyer_1"): ("ANA SOUZA", 95)}
    assert {(r.process_id, r.field_id) for r in conflicts.collect()} == {(1, "contract.number")}
    assert {(r.process_id, r.field_id) for r in issues.collect()} == {(2, "buyer.name::buyer_1")}


def test_empty(spark):
    assert layers.layered(spark.createDataFrame([], DOCS), spark.createDataFrame([], READINGS), sources=["MINUTA"]).count() == 0


@pytest.mark.parametrize(
    ("text", "more", "own"),
    [
        ("", [], "R$\xa072.346,53"), ("", [("FOCUSED", "financial.downPayment", "R$ 500,00", 98, "entrada: sinal 1 R$ 500,00")], "R$\xa072.346,53"), ("subsídio", [("FOCUSED", "financial.downPayment", "R$ 500,00", 98, "entrada: sinal 1 R$ 500,00")], None), ("desconto de FGTS", [], None),
        ("FGTS", [("FOCUSED", "financial.fgts", "R$ 46,53", 90, "FGTS R$ 46,53")], "R$\xa072.300,00"), ("", [("FOCUSED", "financial.fgts", "R$ 46,53", 74, "FGTS R$ 46,53")], None), ("", [("FOCUSED", "financial.downPayment", "R$ 1,00", 90, "recursos próprios R$ 1,00")], "R$ 1,00"),
        ("", [("FOCUSED", "financial.subsidy", "R$ 99.000,00", 90, "subsídio R$ 99.000,00")], None),
    ],
)
def test_own_resources(spark, text, more, own):
    """What the parts leave of the total: calculated, told by itself, or not safe to say."""
    two = [("FOCUSED", "financial.totalValue", "R$ 261.946,53", 98, "valor total R$ 261.946,53"), ("FOCUSED", "financial.financing", "R$ 189.600,00", 98, "financiamento R$ 189.600,00")]
    found = run(spark, "DADOS_RESERVA", text, [*two, *more]).first()
    rows = {r.field_id: r for r in found.chosen}
    assert (rows["financial.downPayment"].value if "financial.downPayment" in rows else None) == own
    if own == "R$\xa072.300,00":
        assert rows["financial.downPayment"].layer == "CALCULATED" and rows["financial.downPayment"].raw == "Valor do contrato: R$ 261.946,53 | Financiamento: R$ 189.600,00 | FGTS: R$ 46,53 | Recursos próprios calculados: R$\xa072.300,00"

