"""Units and developments read from the text of a deed that OCR has made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import normalize as n
from tallyspark.functions.normalize import let
from tallyspark.operators.extract import filled, match_starts
from tallyspark.operators.uploads import display_name

PROSE = "private_area:string,common_area:string,total_area:string,ideal_fraction:string,iptu:string,typology:string"

#: The wording by which a deed tells a unit's areas, fraction and registration, in normalised text.
AREA = r"(?:com\s+uma\s+)?area\s+privativa(?:\s+(?:principal|coberta\s+padrao|coberta|total|util))?\s*(?:de|:)?\s*([0-9][0-9.]*[,.][0-9]{2,6})\s*m?"
COMMON = r"(?:area\s+(?:de\s+uso\s+)?comum|area\s+comum\s+real)\s*(?:de|:)?\s*([0-9][0-9.]*[,.][0-9]{2,6})\s*m?"
TOTAL = r"(?:area\s+total\s+real|area\s+real\s+total)\s+de\s+([0-9][0-9.]*[,.][0-9]{3,6})\s*m?"
FRACTION = r"fracao ideal de\s+([0-9][,.][0-9]{6,12})"
IPTU = r"(?:inscricao\s+(?:imobiliaria|municipal)|inscricao\s+do\s+imovel|iptu)\s*[:.]?\s*([a-z0-9./-]{3,30})"
TYPE = r"tipo\s+([a-z0-9-]{1,12})"
ROW = r"(?i)(?<![A-Za-z0-9_])([0-9]{1,3})\s+([0-9]{3,5})\s+([a-z](?:-[a-z]+)?)\s+([0-9]{1,4}[.,][0-9]{2,6})\s+([0-9]{1,4}[.,][0-9]{3,8})\s+([0-9][.,][0-9]{5,14})(?![A-Za-z0-9_])"
NAMED, DEVELOPMENT = r"denominado\s+(condominio\s+[^,.\n]+)", r"empreendimento\s+([a-z0-9]+(?:\s+[a-z0-9]+){0,4})(?=,?\s+(?:que\s+sera|a\s+ser\s+construido|objeto|residencial)|[,.])"
CITY, REGISTRATION, CNPJ = r"municipio de\s+([a-z\s-]+?)(?:-ce|,|\.)", r"mat(?:ricula|\.)?\s*[:.]?\s*([0-9][0-9. -]{2,})", r"(?<![A-Za-z0-9_])cnpj(?![A-Za-z0-9_])[^0-9]*([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2})"
SELLER = r"(?i)(?:proprietario|proprietaria|incorporadora|construtora|transmitente|razao social|denominacao)[^:\n\r]{0,50}:\s*([^\n\r]+)"


def ocr_text(v) -> Column:
    """Small letters without accents, brackets and double spaces."""
    ordinal = F.regexp_replace(F.translate(F.coalesce(v, F.lit("")), "º°“”", "oo\"\""), r"[|()\[\]{}]", " ")
    return F.lower(F.regexp_replace(F.translate(F.regexp_replace(ordinal, "[̀-ͯ]", ""), n.COMPOSED, n.BASE), n.WS + "+", " "))


def shown(v: Column) -> Column:
    return let(v, lambda x: F.when(x != "", n.decimal_display(F.trim(x))))


def compact_evidence(v: Column) -> Column:
    """Without page marks and double spaces, 500 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(v, r"(?i)\[?pagina\s+[0-9]+\]?", ""), r"\s+", " ")), 1, 500)


def pages_in(v: Column) -> Column:
    """All page numbers that a stretch of text names."""
    return F.filter(F.transform(F.regexp_extract_all(v, F.lit(r"(?i)\[?p[aá]gina\s+([0-9]+)\]?"), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x > 0)


def prose_units(text: Column) -> Column:
    """Units told in prose, one for each private area: what stands since the one before names its type, what follows its other areas. Of two that are told alike the last one stands."""

    def units(t):
        # Between two matches lies the text since the one before.
        gaps, starts = F.split(t, AREA, -1), match_starts(t, AREA)

        def unit(at, i):
            before, after = F.get(gaps, i), F.substring(t, at + 1, F.lit(360))
            kinds = F.regexp_extract_all(before, F.lit(TYPE), F.lit(1))
            registration = let(F.regexp_extract(after, IPTU, 1), lambda x: F.coalesce(F.when(x != "", x), filled(F.regexp_extract(before, IPTU, 1))))
            fraction = shown(F.regexp_extract(after, FRACTION, 1))
            return F.struct(
                shown(F.regexp_extract(after, AREA, 1)).alias("private_area"), shown(F.regexp_extract(after, COMMON, 1)).alias("common_area"), shown(F.regexp_extract(after, TOTAL, 1)).alias("total_area"), fraction.alias("ideal_fraction"),
                registration.alias("iptu"), F.when(F.size(kinds) > 0, F.concat(F.lit("Tipo "), F.upper(F.element_at(kinds, -1)))).alias("typology"), F.when(fraction.isNotNull(), 88).otherwise(82).alias("confidence"), pages_in(before).alias("pages"),
                compact_evidence(F.concat_ws(" ", F.substring(before, F.greatest(F.length(before) - 219, F.lit(1)), F.lit(220)), F.substring(after, 1, 180))).alias("evidence"),
            )

        alike = lambda a, b: F.forall(F.array(*[a[c].eqNullSafe(b[c]) for c in ("typology", "private_area", "total_area", "ideal_fraction")]), lambda x: x)
        return let(F.transform(starts, unit), lambda all_: F.filter(all_, lambda u, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda v: alike(u, v))))

    return let(ocr_text(text), units)


def table_units(text: Column) -> Column:
    """Units of an exported table: tower, unit, type, areas and fraction on one line, with the last page named before."""

    def units(t):
        def unit(row, at):
            part = lambda i: F.regexp_extract(row, ROW, i)
            page = F.element_at(pages_in(F.substring(t, F.lit(1), at)), -1)
            return F.struct(part(1).alias("tower"), part(2).alias("unit"), F.concat(F.lit("Tipo "), F.upper(part(3))).alias("typology"), shown(part(4)).alias("private_area"), shown(part(5)).alias("total_area"), shown(part(6)).alias("ideal_fraction"), F.lit(96).alias("confidence"), page.alias("page"))

        return F.zip_with(F.regexp_extract_all(t, F.lit(ROW), F.lit(0)), match_starts(t, ROW), unit)

    return let(ocr_text(text), units)


def typologies(text: Column) -> Column:
    """The types that a deed names, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(ocr_text(text), F.lit(r"(?<![a-z0-9_])" + TYPE), F.lit(1)), lambda x: F.concat(F.lit("Tipo "), F.upper(x))))


def development(text: Column) -> Column:
    """(name, city, registration, seller_name, seller_cnpj) of the development that a deed is about."""

    def told(t):
        name = F.coalesce(filled(F.regexp_extract(t, NAMED, 1)), filled(F.regexp_extract(t, DEVELOPMENT, 1)))
        return F.struct(
            F.coalesce(display_name(name), F.lit("Empreendimento sem nome")).alias("name"), display_name(filled(F.regexp_extract(t, CITY, 1))).alias("city"), filled(n.digits(F.regexp_extract(t, REGISTRATION, 1))).alias("registration"),
            filled(F.trim(F.regexp_extract(t, SELLER, 1))).alias("seller_name"), filled(F.regexp_extract(t, CNPJ, 1)).alias("seller_cnpj"),
        )

    return let(ocr_text(text), told)
