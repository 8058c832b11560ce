"""Readers of office files and multi-page images: bytes in, rows out.

Spark deals the files; a small parser opens one at a time. What tables mean is
worked out afterwards on rows, by DataFrame operations: cells become lines of
labelled text, or the unit table that a workbook holds.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import normalize as n

#: Rows of a sheet and characters of a workbook's text that are read, rows in which a header may stand, and pages of an image file.
MAX_ROWS, MAX_TEXT, HEADER_ROWS, MAX_PAGES = 2_000, 500_000, 50, 12


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _below(node, name: str):
    return [x for x in node.iter() if x is not node and _local(x) == name]


def _compact(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _paragraph(node) -> str:
    said = {"t": lambda x: x.text or "", "tab": lambda _: "\t", "br": lambda _: "\n"}
    return re.sub(r"[ \t]+", " ", "".join(said[_local(x)](x) for x in node.iter() if _local(x) in said)).strip()


def docx_text(data: bytes) -> str:
    """Paragraphs, and tables as lines: the first paragraphs of a row's cells, then the second ones, each joined by bars."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    blocks = []
    for node in _below(root, "body")[0]:
        if _local(node) == "p":
            blocks.append(_paragraph(node))
        elif _local(node) == "tbl":
            for row in (x for x in node if _local(x) == "tr"):
                cells = [[t for t in map(_paragraph, _below(cell, "p")) if t] for cell in row if _local(cell) == "tc"]
                blocks += [" | ".join(c[i] for c in cells if i < len(c)) for i in range(max(map(len, cells), default=0))]
    return _compact("\n\n".join(b for b in blocks if b))


#: Groups of an RTF file that hold no text, and the control words that stand for a sign.
_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "filetbl"}
_SIGN = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t"}
_TOKEN = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}]+)", re.DOTALL)


def rtf_text(data: bytes) -> str:
    """The text of an RTF file. A group's settings (silence, characters that stand in for one of \\u) end with it."""
    source = data.removeprefix(b"\xef\xbb\xbf").decode("latin-1")
    if not re.match(r"\s*\{\\rtf", source, re.IGNORECASE):
        raise ValueError("not an RTF file")
    out, outer, silent, stand_ins, skip = [], [], False, 1, 0

    def put(text: str, units: int = 0):
        """Adds text, without what only stands in for the last \\u: so many signs of it."""
        nonlocal skip
        gone = min(skip, units or len(text))
        skip -= gone
        if not silent:
            out.append(("" if units else text[gone:]) if gone else text)

    for hex_, word, number, sign, brace, plain in (m.groups() for m in _TOKEN.finditer(source)):
        if brace == "{":
            outer.append((silent, stand_ins))
        elif brace:
            silent, stand_ins = outer.pop() if outer else (False, 1)
        elif hex_:
            put(bytes.fromhex(hex_).decode("latin-1"), 1)
        elif plain:
            put(plain)
        elif sign:
            if sign == "*":
                silent = True
            elif sign in "\\{}":
                put(sign)
        elif word.lower() in _SILENT:
            silent = True
        elif word.lower() == "uc" and number:
            stand_ins = max(0, int(number))
        elif word.lower() == "u" and number:
            put(chr(int(number) % 65536))
            skip = stand_ins
        elif word.lower() in _SIGN:
            put(_SIGN[word.lower()], 0)
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(out)))
    return _compact(text)


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of every cell that isn't empty; rows and columns from 0."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in _below(item, "t")) for item in _below(ElementTree.fromstring(book.read("xl/sharedStrings.xml")), "si")]
    out = []
    for path in sorted(x for x in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
        name = path.rpartition("/")[2].removesuffix(".xml")
        for r, row in enumerate(_below(ElementTree.fromstring(book.read(path)), "row")):
            for cell in _below(row, "c"):
                column = 0
                for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                held = next((x.text for x in _below(cell, "v")), None) or next((x.text for x in _below(cell, "t")), None) or ""
                if cell.get("t") == "s" and held:
                    held = shared[int(held)] if int(held) < len(shared) else ""
                if held.strip():
                    out.append((name, r, column - 1, held.strip()))
    return out


def tiff_pages(data: bytes) -> list[int]:
    """Where the pages of an image file begin: the offsets of its directories."""
    order = "<" if data[:2] == b"II" else ">"
    found, at = [], struct.unpack_from(order + "I", data, 4)[0]
    while at and at not in found and len(found) < MAX_PAGES:
        found.append(at)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]
    return found


def _texts(batches):
    for b in batches:
        texts, errors = [], []
        for kind, data in zip(b.column("kind").to_pylist(), b.column("content").to_pylist(), strict=True):
            text = error = None
            try:
                text = {"docx": docx_text, "rtf": rtf_text}[kind](data)
                error = None if text else "no text"
            except Exception as e:  # noqa: BLE001 - a broken file is a row with its error, not the end of the job
                error = f"{type(e).__name__}: {e}"[:500]
            texts.append(text or None)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["file_id", "text", "error"])


def word_texts(files: DataFrame) -> DataFrame:
    """(file_id, text, error) of files (file_id, kind: docx or rtf, content). A file that can't be read has its error and no text."""
    rows = files.where("kind in ('docx', 'rtf')").select(F.col("file_id").cast("string").alias("file_id"), "kind", "content")
    return rows.mapInArrow(_texts, "file_id string, text string, error string")


def _cells(batches):
    for b in batches:
        for file, data in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                cells = xlsx_cells(data)
            except Exception:  # noqa: BLE001 - a broken workbook has no cells
                cells = []
            columns = list(zip(*cells, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(cells), pa.string()), pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:3]], pa.array(columns[3], pa.string())], names=["file_id", "sheet", "row", "col", "value"])


def workbook_cells(files: DataFrame) -> DataFrame:
    """(file_id, sheet, row, col, value) of the workbooks among files. Broken ones have no cells."""
    rows = files.where("kind = 'xlsx'").select(F.col("file_id").cast("string").alias("file_id"), "content")
    return rows.mapInArrow(_cells, "file_id string, sheet string, row int, col int, value string")


def _pages(batches):
    for b in batches:
        out = []
        for file, data in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                out += [(file, i, at) for i, at in enumerate(tiff_pages(data), 1)]
            except struct.error:
                continue
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["file_id", "page", "offset"])


def image_pages(files: DataFrame) -> DataFrame:
    """(file_id, page, offset): a row for each of the first pages of a multi-page image, with the place of its directory."""
    rows = files.where("kind = 'tiff'").select(F.col("file_id").cast("string").alias("file_id"), "content")
    return rows.mapInArrow(_pages, "file_id string, page int, offset long")


def clean(v) -> Column:
    return F.trim(F.regexp_replace(v, n.WS + "+", " "))


def workbook_text(cells: DataFrame) -> DataFrame:
    """(file_id, text): each sheet's rows as lines of `heading: value`, by the headings of its first row. At most MAX_ROWS rows of a sheet and MAX_TEXT characters."""
    filled = cells.withColumn("value", clean("value")).where("value != ''")
    sheet = Window.partitionBy("file_id", "sheet")
    ranked = filled.withColumn("nth", F.dense_rank().over(sheet.orderBy("row"))).where(F.col("nth") <= MAX_ROWS + 1)
    head = ranked.where("nth = 1").select("file_id", "sheet", "col", F.col("value").alias("heading"))
    labelled = ranked.where("nth > 1").join(head, ["file_id", "sheet", "col"], "left")
    said = F.concat_ws(": ", F.coalesce("heading", F.concat(F.lit("Coluna "), F.col("col") + 1)), "value")
    lines = labelled.groupBy("file_id", "sheet", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", said.alias("said")))), lambda x: x["said"]), " | ").alias("line"))
    sheets = lines.groupBy("file_id", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    whole = sheets.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "lines"))), lambda x: F.concat(x["sheet"], F.lit(":\n"), x["lines"])), "\n\n").alias("text"))
    return whole.select("file_id", F.trim(F.substring("text", 1, MAX_TEXT)).alias("text"))


#: What a unit table's columns may be called.
COLUMNS = {
    "tower": ["torre", "bloco", "block", "edificio", "predio", "modulo"], "unit": ["unidade", "apartamento", "apto", "apt", "unid", "numero unidade", "codigo unidade"], "typology": ["tipo", "tipologia", "modelo unidade"],
    "private_area": ["area privativa", "area util", "area exclusiva"], "common_area": ["area comum", "area uso comum", "area de uso comum"], "total_area": ["area total", "area global"], "ideal_fraction": ["fracao ideal", "fracao"],
    "iptu": ["inscricao iptu", "inscricao imobiliaria", "cadastro imobiliario", "iptu"],
}


def heading(v) -> Column:
    """A heading without accents, remarks in parentheses and signs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(n.unaccent(v)), r"\s*\([^)]*\)", ""), "[^a-z0-9]+", " "))


def number(v) -> Column:
    """A number of a cell as it is shown: comma for the point, no thousands; other texts as they are, null where blank."""
    raw = clean(F.coalesce(v, F.lit("")))
    plain = F.when(F.contains(raw, F.lit(",")), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(raw)
    shown = F.regexp_replace(F.regexp_replace(F.round(plain.try_cast("decimal(38,14)"), 12).cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(raw != "", F.coalesce(F.replace(shown, F.lit("."), F.lit(",")), raw))


def best_tables(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, row, columns, score): the header of each workbook's unit table.

    Of the first rows of each sheet, one that names a private area scores ten,
    five for each of tower, unit and type, one for each other column; the
    highest score wins, then the longest sheet, then the first one. columns maps
    a column's name to the first place whose heading is, or holds, one of its names.
    """
    size = cells.groupBy("file_id", "sheet").agg((F.max("row") + 1).alias("n_rows"))
    named = cells.where(F.col("row") < HEADER_ROWS).withColumn("h", heading("value"))
    # Fewer than a hundred literal names: a predicate, not a join.
    holds = lambda names: F.regexp_like("h", F.lit("|".join(names)))
    per = named.groupBy("file_id", "sheet", "row").agg(*[F.min(F.when(holds(names), F.col("col"))).alias(c) for c, names in COLUMNS.items()])
    many = lambda *names: sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    score = F.when(F.col("private_area").isNotNull(), 10 + 5 * many("tower", "unit", "typology") + many("common_area", "total_area", "ideal_fraction", "iptu"))
    scored = per.withColumn("score", score).where("score is not null").join(size, ["file_id", "sheet"])
    pick = F.struct(-F.col("score"), -F.col("n_rows"), F.col("sheet"), F.col("row"))
    best = scored.groupBy("file_id").agg(F.min_by(F.struct("sheet", "row", F.struct(*COLUMNS).alias("columns"), "score"), pick).alias("b"))
    return best.select("file_id", "b.*")


def workbook_units(cells: DataFrame) -> DataFrame:
    """(file_id, tower, unit, typology, private_area, common_area, total_area, ideal_fraction, iptu, confidence, evidence) from each workbook's best table: rows with a private area and a tower, unit or type."""
    table = best_tables(cells).withColumnRenamed("row", "header")
    rows = cells.join(table, ["file_id", "sheet"]).where(F.col("row") > F.col("header"))
    value = lambda c: F.max(F.when(F.col("col") == F.col(f"columns.{c}"), F.col("value"))).alias(c)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " | ")
    per = rows.groupBy("file_id", "sheet", "row").agg(*[value(c) for c in COLUMNS], line.alias("line"))
    text = lambda c: F.coalesce(clean(c), F.lit("")).alias(c)
    kind = F.when(F.coalesce(clean("typology"), F.lit("")) != "", F.concat(F.lit("Tipo "), F.upper(F.regexp_replace(clean("typology"), r"(?i)^tipo\s*", "")))).otherwise("")
    evidence = F.substring(F.concat(F.col("sheet"), F.lit(", linha "), (F.col("row") + 1).cast("string"), F.lit(": "), F.col("line")), 1, 500)
    out = per.select("file_id", text("tower"), text("unit"), kind.alias("typology"), *[number(F.col(c)).alias(c) for c in ("private_area", "common_area", "total_area", "ideal_fraction")], F.nullif(clean("iptu"), F.lit("")).alias("iptu"), F.lit(99).alias("confidence"), evidence.alias("evidence"))
    return out.where(F.col("private_area").isNotNull() & ((F.col("typology") != "") | (F.col("tower") != "") | (F.col("unit") != "")))
