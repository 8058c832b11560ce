"""Readers of office files, deeds and uploads on small files made here."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from tallyspark.operators import deeds, uploads
from tallyspark.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda *t: f"<w:tc>{''.join(map(p, t))}</w:tc>"
    return packed(**{"word/document.xml": f"<w:document {W}><w:body>{p('Um  contrato')}<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:tbl><w:tr>{cell('x', 'y')}{cell('1')}</w:tr></w:tbl></w:body></w:document>"})


def xlsx(rows, shared=()):
    strings = "".join(f"<si><t>{t}</t></si>" for t in shared)
    body = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
    more = f'<row><c r="A99" t="s"><v>0</v></c></row>' if shared else ""
    return packed(**{"xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{body}{more}</sheetData></worksheet>", "xl/sharedStrings.xml": f"<sst {S}>{strings}</sst>"})


def test_word_files(spark):
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\gen x}Ol\'e1 \u233? mundo\par linha\tab dois \{x\}\line {\uc2\u225??b}}"
    files = spark.createDataFrame([("d", "docx", docx()), ("r", "rtf", rtf), ("bad", "docx", b"PK no"), ("worse", "rtf", b"plain"), ("x", "xlsx", xlsx([["a"]]))], "file_id string, kind string, content binary")
    got = {r.file_id: (r.text, r.error) for r in office.word_texts(files).collect()}
    assert got["d"] == ("Um contrato\n\na b\nc\n\nx | 1\n\ny", None)
    assert got["r"] == ("Olá é mundo\nlinha dois {x}\náb", None)
    assert set(got) == {"d", "r", "bad", "worse"} and got["bad"][0] is None and got["bad"][1] and got["worse"][1]


def test_workbooks(spark):
    rows = [["Lista"], ["Torre", "Unidade", "Tipo", "Área Privativa (m²)", "Fração Ideal"], ["A", "101", "tipo b", "1.050,50", "0,0123"], ["A", "102", None, "40.5", None], [None, None, None, "9", None], ["B", "103", "c", None, None]]
    files = spark.createDataFrame([("u", "xlsx", xlsx(rows)), ("s", "xlsx", xlsx([["Nome", "CPF"], ["Ana", "1"], ["Bia", None, "z"]], ["do fim"])), ("bad", "xlsx", b"no")], "file_id string, kind string, content binary")
    cells = office.workbook_cells(files)
    text = {r.file_id: r.text for r in office.workbook_text(cells).collect()}
    assert text["s"] == "sheet1:\nNome: Ana | CPF: 1\nNome: Bia | Coluna 3: z\nNome: do fim"
    best = office.best_tables(cells).collect()
    assert [(r.file_id, r.row, r.score) for r in best] == [("u", 1, 26)]
    units = sorted(tuple(r)[1:9] for r in office.workbook_units(cells).collect())
    assert units == [("A", "101", "Tipo B", "1050,5", None, None, "0,0123", None), ("A", "102", "", "40,5", None, None, None, None)]
    assert office.workbook_units(cells.limit(0)).count() == 0


def test_image_pages(spark):
    directory = lambda following: struct.pack("<H", 1) + b"\0" * 12 + struct.pack("<I", following)
    tiff = b"II*\0" + struct.pack("<I", 8) + directory(26) + directory(0)
    files = spark.createDataFrame([("t", "tiff", tiff), ("bad", "tiff", b"II")], "file_id string, kind string, content binary")
    assert [tuple(r) for r in office.image_pages(files).orderBy("page").collect()] == [("t", 1, 8), ("t", 2, 26)]


def test_deeds(spark):
    text = """Matrícula: 12.345. denominado CONDOMÍNIO VILA SOL, no município de Fortaleza-CE. Incorporadora: OBRAS LTDA CNPJ 12.345.678/0001-90 [PÁGINA 2] apartamento tipo A com uma área privativa de 50,25 m²,
    área de uso comum de 10,50 m², área total real de 60,750 m² e fração ideal de 0,012345. [PÁGINA 3] Inscrição municipal: 77-1 tipo B área privativa coberta: 70.10 m"""
    one = lambda c: spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first().x
    a, b = one(deeds.prose_units(F.col("t")))
    assert (a.private_area, a.common_area, a.total_area, a.ideal_fraction, a.typology, a.confidence, a.pages) == ("50,25", "10,50", "60,750", "0,012345", "Tipo A", 88, [2])
    assert (b.private_area, b.total_area, b.iptu, b.typology, b.confidence, b.pages) == ("70,10", None, "77-1", "Tipo B", 82, [3])
    d = one(deeds.development(F.col("t")))
    assert (d.name, d.city, d.registration, d.seller_cnpj) == ("Condominio Vila Sol", "Fortaleza", "12345", "12.345.678/0001-90")
    assert one(deeds.typologies(F.col("t"))) == ["Tipo A", "Tipo B"]
    rows = spark.createDataFrame([("[PÁGINA 4] 1 101 a 50,25 60.755 0,012345 [PÁGINA 5] 2 202 B-c 51,00 61,000 0,0123456",)], "t string").select(deeds.table_units(F.col("t")).alias("x")).first().x
    assert [(r.tower, r.unit, r.typology, r.private_area, r.total_area, r.page) for r in rows] == [("1", "101", "Tipo A", "50,25", "60,755", 4), ("2", "202", "Tipo B-C", "51,00", "61,000", 5)]
    empty = spark.createDataFrame([(None,), ("",)], "t string").select(F.size(deeds.prose_units(F.col("t"))).alias("n"), F.size(deeds.table_units(F.col("t"))).alias("m"), deeds.development(F.col("t"))["name"].alias("name")).collect()
    assert [tuple(r) for r in empty] == [(0, 0, "Empreendimento sem nome")] * 2


def test_uploads(spark):
    files = [
        (1, "a.PDF", 10, b"%PDF-1"), (1, "b.png", 10, b"\x89PNG"), (2, "c.pdf", 10, b"PK\x03\x04"), (3, "d.rtf", 10, b"\xef\xbb\xbf  {\\RTF1"), (3, "e.docx", 10, b"PK\x05\x06"), (4, "f.tif", 10, b"MM\0*"), (4, "g.tif", 10, b"MM\0+"), (5, "h.jpeg", 0, b"\xff\xd8\xff"),
        (6, "i.exe", 5, b"MZ"), (7, "j.pdf", 15 * 1024 * 1024 + 1, b"%PDF"), *[(8, f"k{i}.pdf", 4 * 1024 * 1024, b"%PDF") for i in range(16)], *[(9, f"l{i}.pdf", 1, b"%PDF") for i in range(21)],
    ]
    df = spark.createDataFrame(files, "upload int, name string, size long, content binary")
    assert {r.upload: (r.n_rejected, r.accepted) for r in uploads.gate(df, "upload").collect()} == {1: (0, True), 2: (1, False), 3: (0, True), 4: (1, False), 5: (1, False), 6: (1, False), 7: (1, False), 8: (0, False), 9: (0, False)}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = F.lit
    assert one(uploads.mime_type(t("X.TIFF"), t("a/b"))) == "image/tiff" and one(uploads.mime_type(t("x"), t("text/rtf"))) == "text/rtf" and one(uploads.mime_type(t("x"), t("a/b"))) == "application/octet-stream"
    assert [one(uploads.document_type(t(name), t(mime), kind)) for name, mime, kind in (("guia.pdf", "application/pdf", "ITBI"), ("a.png", "image/png", "ITBI"), ("a.tif", "image/tiff", "MINUTA"), ("a.pdf", "application/pdf", "MINUTA"), ("a.pdf", "x", "ITBI"), ("a.docx", "x", "ITBI"), ("a", "x", "ITBI"), ("a", "x", "MINUTA"))] == [
        "ITBI_GUIDE", "IMAGE", "TIFF", "CONTRACT", "PDF", "WORD", "COMPLEMENTARY", "CONTRACT",
    ]
    assert one(uploads.page_list(t("1-3, 8 ,2"), t(10))) == [1, 2, 3, 8] and all(one(uploads.page_list(t(x), t(10))) is None for x in ("", "3-1", "0", "9-11", "x", "1,,a"))
    assert one(uploads.source_list(t('["SIOPI","ITBI"]'), t(2))) == ["SIOPI", "ITBI"] and all(one(uploads.source_list(t(x), t(2))) is None for x in ('["SIOPI"]', '["SIOPI","NADA"]', "{", '["SIOPI","CADASTRO_EMPREENDIMENTO"]'))
    assert one(uploads.inferred_name(t("Lista_Unidades_vila-do sol_12.34 (2).xlsx"))) == "Vila Do Sol" and one(uploads.inferred_registration(t("lista_12-345.678 (1).xlsx"))) == "12.345.678" and one(uploads.inferred_name(t("lista_unidades_.xlsx"))) == "Empreendimento sem nome"
    assert one(uploads.sanitised_error(t("Bearer abc.def x sk-12_a y"))) == "Bearer [oculto] x [chave oculta] y" and one(uploads.explained_error(t("Bad XRef"), t("a.pdf"))).startswith("PDF corrompido")
    assert one(uploads.login_name(t(" Ana "), "x.y")) == "ana@x.y" and one(uploads.request_metadata(t("1.2.3.4, 5"), t("z" * 400))["ip"]) == "1.2.3.4"
