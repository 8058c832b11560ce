"""Fields that texts of known wording give."""

from pyspark.sql import functions as F

from tallyspark.functions import patterns
from tallyspark.operators import extract


def read(spark, source, text, catalogue=None):
    rows = extract.extracted_rows(spark.createDataFrame([(1, source, text)], "doc_id long, source string, text string"), "doc_id", catalogue=catalogue).collect()
    return {r.field_id: (r.value, r.confidence) for r in rows}


def test_contract(spark):
    text = """CONTRATO nº do contrato: 8.7877.1234567-0
    FORTALEZA, CE 12 de março de 2024
    Agência: 1234-5
    Programa habitacional: Minha Casa Minha Vida;
    B.4.1 Valor do financiamento: R$ 150.000,00
    B.4.2 Recursos próprios: | R$ 30.000,00
    Valor destinado à aquisição do imóvel é R$ 180.000,00
    apartamento nº 302 da torre B, 3º pavimento, tipo C, matrícula nº 55.123
    o terreno possui 2.500,00 m²"""
    got = read(spark, "MINUTA", text)
    assert got["contract.number"] == ("8.7877.1234567-0", 94) and got["contract.date"] == ("12 de março de 2024", 98)
    assert got["contract.agencyCode"] == ("1234-5", 90) and got["contract.housingProgram"] == ("Minha Casa Minha Vida", 90)
    assert got["financial.financing"] == ("R$ 150.000,00", 100) and got["financial.downPayment"] == ("R$ 30.000,00", 100) and got["financial.totalValue"] == ("R$ 180.000,00", 98)
    assert got["property.unit"] == ("302", 99) and got["property.tower"] == ("B", 99) and got["property.floor"] == ("3º Pavimento", 99) and got["property.type"] == ("Tipo C", 99)
    assert got["property.terrainArea"] == ("2.500,00 m²", 96) and got["property.registration"] == ("55.123", 90)
    assert read(spark, "MINUTA", None) == read(spark, "MINUTA", "nada") == read(spark, "CERTIDAO", text) == {}


def test_composition_table_pairs_labels_with_amounts(spark):
    text = "B.4.1 Valor do financiamento B.4.2 Recursos próprios B.4.3 FGTS B.4.4 Outros B.4.5 Desconto\nR$ 100.000,00 R$ 20.000,00 R$ 5.000,00 R$ 0,00 R$ 3.500,50 B.5 Fim R$ 9,00"
    got = read(spark, "MINUTA", text)
    assert {k: v for k, v in got.items() if k.startswith("financial")} == {
        "financial.financing": ("R$ 100.000,00", 100), "financial.downPayment": ("R$ 20.000,00", 100), "financial.fgts": ("R$ 5.000,00", 100), "financial.subsidy": ("R$ 3.500,50", 100),
    }
    few = read(spark, "MINUTA", "B.4.1 Valor do financiamento B.4.2 Recursos R$ 100.000,00 R$ 20.000,00")
    assert "financial.subsidy" not in few


def test_reservation(spark):
    text = "NOME DO CLIENTE CPF / CNPJ RG CELULAR\nANA SOUZA 123.456.789-01 123.456.789-01 85 99999-8888\nESTADO CIVIL: Casada\nENDEREÇO\nRua A\nBAIRRO\nCentro\nfnanciamento 1 150.000,00\nVALOR DO CONTRATO\nR$ 200.000,00\nana@mail.com"
    got = read(spark, "DADOS_RESERVA", text)
    assert got["buyer.name"] == ("ANA SOUZA", 90) and got["buyer.cpf"] == ("123.456.789-01", 90) and "buyer.rg" not in got  # the tax id again
    assert got["buyer.maritalStatus"] == ("Casada", 90) and got["financial.totalValue"] == ("R$ 200.000,00", 90) and got["financial.financing"] == ("150.000,00", 70)
    assert got["buyer.address"] == ("Rua A, Centro", 90) and got["buyer.email"] == ("ana@mail.com", 90)


def test_declaration_is_read_as_one_whatever_its_source(spark):
    text = """DTI [CAMPOS DE FORMULARIO] DADOS DO ADQUIRENTE Nome: ANA SOUZA CPF / CNPJ: 123.456.789-01 Endereço: Rua A, 10 Email: ana@mail.com Telefone: 85 99999-8888
    DADOS DO TRANSMITENTE Nome / Razão Social: OBRAS LTDA CPF / CNPJ: 12.345.678/0001-90 Endereço: Av B Telefone: 85 3333-4444
    NATUREZA DA TRANSAÇÃO: Compra e venda DADOS DO IMÓVEL OBJETO DA TRANSAÇÃO Inscrição do IPTU: 998-1 Endereço: Rua C Complemento: APTO 302 TORRE 02 Tipo de Imóvel: Apartamento Matrícula: 5512 Área Privativa: 50,25 m² Área do terreno: 900,00 m²
    DECLARAÇÃO DE VALORES Valor TOTAL DECLARADO: 200.000,00 Valor financiado (SFH): 150.000,00 Valor não financiado: 50.000,00 RESPONSÁVEL PELAS INFORMAÇÕES"""
    got = read(spark, "CERTIDAO", text)
    assert {f: got[f][0] for f in ("seller.legalName", "seller.cnpj", "property.privateArea", "property.landArea", "financial.nonFinancedValue", "property.type", "property.tower", "buyer.phone", "transaction.nature")} == {
        "seller.legalName": "OBRAS LTDA", "seller.cnpj": "12.345.678/0001-90", "property.privateArea": "50,25", "property.landArea": "900,00", "financial.nonFinancedValue": "50.000,00", "property.type": "Apartamento", "property.tower": "2",
        "buyer.phone": "85 99999-8888", "transaction.nature": "Compra e venda",
    }
    assert got["property.registration"][0] == "5512" and "seller.email" not in got


def test_a_pattern_of_the_users_own(spark):
    mine = patterns.registered("CERTIDAO", "contract.number", "Certidão", 80, [r"\bprotocolo\s+(\d+)$"])
    assert read(spark, "CERTIDAO", "Protocolo 991", mine) == {"contract.number": ("991", 80)}
    assert len(patterns.CATALOGUE["MINUTA"]) == len(mine["MINUTA"]) and "CERTIDAO" not in patterns.CATALOGUE


def test_small_parts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = F.lit
    assert one(extract.match_starts(t("a1bb22c333"), "[0-9]+")) == [1, 4, 7]
    assert one(extract.safe_file_name(t("  Ação (1)/x.pdf "))) == "Acao-1-x.pdf" and one(extract.safe_file_name(t("???"))) == "documento"
    assert one(extract.structured_value(t(" (m) Rua  A , 3 "))) == "Rua A, 3" and one(extract.structured_number(t(" 1.2 3,5 m² "))) == "1.23,5" and one(extract.structured_value(t(" "))) is None
    assert one(extract.label_value(t("Bairro: Centro\nCIDADE\n\nFortaleza."), ["CIDADE"])) == "Fortaleza" and one(extract.label_value(t("x"), ["CIDADE"])) == ""
    assert one(extract.composition_line(t("a B.4.1 nada\nb B.4.1 x R$ 12,50 y"), "B.4.1")["value"]) == "R$ 12,50"
    assert one(extract.between(t("xx INI abc FIM INI"), "INI", "FIM")) == "abc"


def test_columns_of_a_reservation(spark):
    """Headings of several columns above their values: what a later grid says counts, and an address is made of two grids."""
    civil = "ESTADO CIVIL: PROFISSÃO: LOGRADOURO: END:\nCASADO(A) ENGENHEIRO RUA RUA DAS FLORES 12\n"
    contact = "TELEFONE: TELEFONE 2: E-MAIL: OUTRO\n+55 85999998888 8533332222 ANA.SOUZA&MAIL.COM\n"
    place = "CIDADE ESTADO BAIRRO: CEP:\nFORTALEZA CE CENTRO 60000-123\n"
    got = read(spark, "DADOS_RESERVA", civil + contact + place)
    assert got["buyer.maritalStatus"] == ("CASADO(A)", 90) and got["buyer.address"] == ("RUA DAS FLORES 12, CENTRO, FORTALEZA, CE, 60000-123", 90)
    assert got["buyer.email"] == ("ANA.SOUZA@MAIL.COM", 90) and got["buyer.phone"] == ("+5585999998888", 90)
    assert read(spark, "DADOS_RESERVA", place)["buyer.address"][0].endswith("CENTRO, FORTALEZA, CE, 60000-123")
    grid = read(spark, "DADOS_RESERVA", "NASCIMENTO ESTADO CIVIL PROFISSÃO ENDEREÇO\n01/02/1980 Divorciada — AVENIDA Beira Mar 100\n")
    assert grid["buyer.maritalStatus"] == ("Divorciada", 90) and grid["buyer.address"] == ("Beira Mar 100", 90)

