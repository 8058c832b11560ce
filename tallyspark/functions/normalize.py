"""Typed normalisation of field values, as Column expressions (no UDF).

Every function takes a string column and gives the canonical string that values
are compared by; null and empty give the empty string.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the compared values know it: ASCII, no-break and typographic spaces.
WS = r"[\s\u000b   -     　﻿]"
#: ASCII word boundaries: the class \b of the JVM counts accented letters and signs too.
B1, B2 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Months by name.
MONTHS = {"janeiro": "01", "fevereiro": "02", "marco": "03", "abril": "04", "maio": "05", "junho": "06", "julho": "07", "agosto": "08", "setembro": "09", "outubro": "10", "novembro": "11", "dezembro": "12"}
DIGIT_TYPES = ("cpf", "cnpj", "rg", "telefone")
#: Words that don't tell developments apart.
NOISE = ["CONDOMINIO", "CONDOMINIOCLUBE", "CLUBE", "RESIDENCIAL"]


def _accents() -> tuple[str, str]:
    """Composed letters, and the letters they decompose to without marks, by the Unicode database."""
    pairs = []
    for cp in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


COMPOSED, BASE = _accents()


def _s(v) -> Column:
    return F.coalesce(v if isinstance(v, Column) else F.col(v), F.lit(""))


def unaccent(v) -> Column:
    """Without diacritics; the free-standing ones go too."""
    return F.regexp_replace(F.translate(_s(v), COMPOSED, BASE), r"[̀-ͯ^`·¨¯´¸]", "")


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once: a lambda's variable is, where an expression named twice may be evaluated twice."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def opened(df: DataFrame, items: Column, name: str, *keys: str) -> DataFrame:
    """(keys, name): a row for each of a row's items, none of which is null. (explode alone makes the optimizer ask beforehand whether there are any, and that evaluates the items two times more.)"""
    return df.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def settled(df: DataFrame, *keys: str) -> DataFrame:
    """df with all columns but the keys evaluated once, before filters: one on a derived column would go below the steps that derive it and take a copy of all of them along."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.explode_outer(F.array(F.struct(*rest))).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def _is_ascii(v: Column) -> Column:
    return F.octet_length(v) == F.char_length(v)


def text(v) -> Column:
    """Without diacritics, with single spaces, in capitals. Pure ASCII takes a short way to the same result."""
    v = _s(v)
    bare = F.when(F.contains(v, F.lit("`")) | F.contains(v, F.lit("^")), F.regexp_replace(v, "[`^]", "")).otherwise(v)
    short = F.upper(F.trim(F.regexp_replace(bare, r"\s+", " ")))
    full = F.upper(F.replace(F.trim(F.regexp_replace(unaccent(v), WS + "+", " ")), F.lit("ß"), F.lit("SS")))
    return F.when(_is_ascii(v), short).otherwise(full)


def digits(v) -> Column:
    return F.regexp_replace(_s(v), "[^0-9]", "")


def money_decimal(v) -> Column:
    """The amount, or null. With both separators the last one is the decimal one; a single separator is, if two signs follow it."""

    def amount(kept):
        cut = kept.rlike(r"^(?=[^.]*\.)(?=[^,]*,)|^[^.,]*[.,][^.,]{2}\z")
        return F.when(cut, F.translate(F.regexp_replace(kept, "[.,](?=.*[.,])", ""), ",", ".")).otherwise(F.translate(kept, ".,", ""))

    # What stands at the front counts, as in 12-3.
    prefix = lambda plain: F.coalesce(plain.try_cast("decimal(38,10)"), F.nullif(F.regexp_extract(plain, r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0), F.lit("")).try_cast("decimal(38,10)"))
    return F.round(let(let(F.regexp_replace(_s(v), r"[^0-9,.\-]", ""), amount), prefix), 2).cast("decimal(28,2)")


def money(v) -> Column:
    return F.when(_s(v) == "", "").otherwise(F.coalesce(money_decimal(v).cast("string"), text(v)))


def area(v) -> Column:
    """The first number; only the first comma counts as a point."""
    dotted = F.regexp_replace(F.regexp_replace(_s(v), WS, ""), r"^([^,]*),", "$1.")
    number = F.nullif(F.regexp_extract(dotted, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("decimal(38,10)")
    trimmed = F.regexp_replace(F.regexp_replace(F.round(number, 4).cast("decimal(34,4)").cast("string"), "0+$", ""), r"\.$", "")
    return F.coalesce(trimmed, text(v))


def property_identifier(v) -> Column:
    bare = F.regexp_replace(text(v), B1 + "(?:TORRE|BLOCO|APARTAMENTO|APTO|UNIDADE)" + B2, "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}]", ""), "^0+(?=[0-9])", "")


def date(v) -> Column:
    """yyyy-MM-dd, not checked against the calendar; two-digit years are of this century, unknown months January."""
    numeric = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})"

    def of_numbers(found):
        year = F.element_at(found, 3)
        return F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), F.lpad(F.element_at(found, 2), 2, "0"), F.lpad(F.element_at(found, 1), 2, "0"))

    def of_words(low):
        word = lambda i: F.regexp_extract(low, "([0-9]{1,2}) de ([a-z]+) de ([0-9]{4})", i)
        month = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), word(2)), F.lit("01"))
        return F.when(word(3) != "", F.concat_ws("-", word(3), month, F.lpad(word(1), 2, "0"))).otherwise(F.upper(low))

    first = F.regexp_extract(_s(v), numeric, 0)
    return let(first, lambda m: F.when(m != "", let(F.split(m, "[/-]"), of_numbers)).otherwise(let(F.lower(text(v)), of_words)))


def email(v) -> Column:
    return F.lower(F.regexp_replace(_s(v), f"^{WS}+|{WS}+$", ""))


def address(v) -> Column:
    out = text(v)
    for pattern, short in (("AVENIDA" + B2, "AV"), ("AV" + B2 + r"\.?", "AV"), ("RUA" + B2, "R"), ("R" + B2 + r"\.?", "R"), ("N[º°.]?" + "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))", "NUMERO"), ("NO" + B2, "NUMERO"), ("APARTAMENTO" + B2, "AP"), ("APTO" + B2, "AP")):
        out = F.regexp_replace(out, B1 + pattern, short)
    return out


def value(v, kind: Column) -> Column:
    """By the field's type."""
    return (
        F.when(_s(v) == "", "").when(kind.isin(*DIGIT_TYPES), digits(v)).when(kind == "valor_monetario", money(v)).when(kind == "area", area(v))
        .when(kind == "identificador_imovel", property_identifier(v)).when(kind == "data", date(v)).when(kind == "email", email(v)).when(kind == "endereco", address(v)).otherwise(text(v))
    )


def marital_status(normal: Column) -> Column:
    for stem in ("SOLTEIR", "CASAD", "DIVORCIAD", "VIUV"):
        normal = F.regexp_replace(normal, B1 + stem + r"[OA](?:\(A\)|" + B2 + ")", stem + "O")
    return F.trim(F.regexp_replace(normal, WS + "+", " "))


def development_name(normal: Column) -> Column:
    return F.array_join(F.filter(F.split(normal, " "), lambda t: (t != "") & ~t.isin(*NOISE)), " ")


def field_value(v, kind: Column, field: Column) -> Column:
    """By the field's type, then by the field: gender in marital status and noise words in development names don't count."""
    normal = value(v, kind)
    return F.when(field == "buyer.maritalStatus", marital_status(normal)).when(field == "property.development", development_name(normal)).otherwise(normal)


def process_code(identifier: Column) -> Column:
    return F.concat(F.lit("OP-"), F.upper(F.substring(F.replace(identifier, F.lit("-"), F.lit("")), 1, 8)))


def participant_key(cpf: Column, name: Column) -> Column:
    """One key for a person: by tax id, else by name."""
    base = F.when(digits(cpf) != "", F.concat(F.lit("cpf:"), digits(cpf))).otherwise(F.concat(F.lit("name:"), text(name)))
    return F.concat(F.lit("participant_"), F.substring(F.sha2(base, 256), 1, 16))


def decimal_display(v) -> Column:
    """An amount as it is shown: with a comma the dots go, else the first dot becomes the comma."""
    return F.when(F.contains(_s(v), F.lit(",")), F.replace(_s(v), F.lit("."), F.lit(""))).otherwise(F.regexp_replace(_s(v), r"^([^.]*)\.", "$1,"))


def parse_decimal(v) -> Column:
    """A shown amount as a number, or null."""
    return F.replace(F.replace(_s(v), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(28,6)")
