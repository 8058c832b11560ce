"""Fields read from the text of a source by its labels, without a model.

All of it is Column expressions over whole texts: the catalogue of patterns,
then what each kind of source needs besides (composition tables and property
descriptions of contracts, labels above their values in reservations, blocks of
a transfer declaration). A document's fields are one array, so recovered ones
are laid over the others without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import normalize as n
from tallyspark.functions import patterns as p
from tallyspark.functions.normalize import let, opened

FIELD = "struct<field_id:string,value:string,confidence:int,section:string,raw:string>"


def _field(field_id: str, value: Column, confidence, section: str, raw: Column) -> Column:
    number = F.lit(confidence) if isinstance(confidence, int) else confidence
    return F.struct(F.lit(field_id).alias("field_id"), value.alias("value"), number.alias("confidence"), F.lit(section).alias("section"), F.substring(raw, 1, 500).alias("raw"))


def _found(fields: list[Column]) -> Column:
    return F.array_compact(F.array(*fields)) if fields else F.array().cast(f"array<{FIELD}>")


def filled(v: Column) -> Column:
    """Null for the empty string. (nullif would evaluate v twice.)"""
    return let(v, lambda x: F.when(x != "", x))


def trimmed(v) -> Column:
    return F.regexp_replace(v, f"^{n.WS}+|{n.WS}+\\z", "")


def squeezed(v) -> Column:
    return trimmed(F.regexp_replace(v, n.WS + "+", " "))


def cleaned(v) -> Column:
    """A value without line breaks, double spaces and a last stop."""
    return trimmed(F.regexp_replace(F.regexp_replace(v, n.WS + "+", " "), rf"[.;,]{n.WS}*\z", ""))


def structured_value(v) -> Column:
    """A value of a form: without a remark in parentheses at its front, nor spaces before signs; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(v, rf"^{n.WS}*\([^)]*\){n.WS}*", ""), n.WS + "+", " ")
    return filled(F.trim(F.regexp_replace(bare, " +([,.;])", "$1")))


def structured_number(v) -> Column:
    return filled(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, n.WS + "+", ""), "(?i)m[²2]?", ""), r"[^0-9.,\-]", ""))


def safe_file_name(v) -> Column:
    """Without accents; other signs than letters, digits, dots, lines and dashes become one dash; 120 at most."""
    dashed = F.regexp_replace(n.unaccent(v), "[^a-zA-Z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, r"^-+|-+\z", ""), 1, 120), F.lit("")), F.lit("documento"))


def _group(text, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract(text, p.jvm(pattern), i)


def first_match(text, patterns: list[str]) -> Column:
    """(value, raw) of the first pattern whose group 1 isn't blank, or null."""
    tries = [let(F.struct(trimmed(_group(text, q)).alias("value"), _group(text, q, 0).alias("raw")), lambda m: F.when(m["value"] != "", m)) for q in patterns]
    return F.coalesce(*tries)


def laid_over(base: Column, over: Column) -> Column:
    """The fields of over, and those of base that it hasn't."""
    return let(over, lambda over: F.concat(over, F.filter(base, lambda b: ~F.exists(over, lambda o: o["field_id"] == b["field_id"]))))


def _of(fields: Column, field_id: str) -> Column:
    return F.get(F.filter(fields, lambda f: f["field_id"] == field_id), F.lit(0))


def by_catalogue(text, source: str, catalogue: dict | None = None) -> Column:
    rows = []
    for field_id, section, confidence, tries in (catalogue or p.CATALOGUE).get(source, []):
        rows.append(let(first_match(text, tries), lambda m, f=field_id, s=section, c=confidence: F.when(m.isNotNull(), _field(f, cleaned(m["value"]), c, s, m["raw"]))))
    return _found(rows)


def looks_like_declaration(text) -> Column:
    """Whether a text is a declaration of transfer, whatever source it came as: its heading and one of its fields."""
    heading = F.regexp_like(text, F.lit(p.jvm(r"declara[cç][aã]o\s+de\s+transa[cç][aã]o\s+imobili[aá]ria|\bDTI\b")))
    return heading & F.regexp_like(text, F.lit(p.jvm(r"[áa]rea\s+do\s+terreno|valor\s+total\s+declarado|\[CAMPOS\s+DE\s+FORMULARIO\]")))


#: The fields of a composition table's items.
ITEMS = {"1": "financial.financing", "2": "financial.downPayment", "3": "financial.fgts", "5": "financial.subsidy"}


def composition(text, least: int = 4) -> Column:
    """Fields of a table whose labels (B.4.1 to B.4.5) stand apart from their amounts: the first label goes with the first amount, and so on. Nothing where there are fewer than least labels, or fewer amounts than labels."""
    block = F.regexp_extract(text, p.jvm(r"B\s*\.\s*4\s*\.\s*1\b[\s\S]*?(?=\bB\s*\.\s*5\b|$)"), 0)
    label = p.jvm(r"B\s*\.\s*4\s*\.\s*([1-5])\b[\s\S]{0,260}?(?=B\s*\.\s*4\s*\.\s*[1-5]\b|R\$\s*\d|$)")

    def zipped(b):
        items = F.regexp_extract_all(b, F.lit(label), F.lit(1))
        labels = F.regexp_extract_all(b, F.lit(label), F.lit(0))
        amounts = F.transform(F.regexp_extract_all(b, F.lit(p.jvm(r"R\$\s*\d[\d.]*,\d{2}")), F.lit(0)), squeezed)
        return F.struct(items.alias("items"), labels.alias("labels"), amounts.alias("amounts"))

    def rows(z):
        enough = (F.size(z["items"]) >= least) & (F.size(z["amounts"]) >= F.size(z["items"]))
        found = [
            let(F.array_position(z["items"], F.lit(item)).cast("int"), lambda at, f=field: F.when(at > 0, _field(f, F.get(z["amounts"], at - 1), 100, "Composição dos recursos", F.concat_ws(" ", squeezed(F.get(z["labels"], at - 1)), F.get(z["amounts"], at - 1)))))
            for item, field in ITEMS.items()
        ]
        return F.when(enough, _found(found)).otherwise(_found([]))

    return let(let(block, zipped), rows)


def composition_line(text, item: str) -> Column:
    """(value, raw) of the first line that holds the item and an amount, or null."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.contains(x, F.lit(item)) & F.regexp_like(x, F.lit(r"R\$\s*[0-9.,]+")))
    amount = lambda x: F.regexp_extract(x, r"R\$\s*[0-9][0-9.]*,[0-9]{2}|R\$\s*[0-9]+(?:\.[0-9]{2})?", 0)
    return let(F.get(lines, F.lit(0)), lambda x: F.when(x.isNotNull() & (amount(x) != ""), F.struct(amount(x).alias("value"), F.substring(x, 1, 500).alias("raw"))))


def match_starts(text, pattern: str) -> Column:
    """Where each match begins, from 0: the lengths of what stands before it."""
    sizes = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["own"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts"))
    return F.aggregate(F.filter(sizes, lambda x: x["own"].isNotNull()), start, step)["starts"]


#: Where a description of a property may begin, and what it should speak of.
ANCHORS = [
    r"(?:futura\s+)?unidade\s+aut[oô]noma", r"(?:apartamento|apto|unidade)\s*(?:n[ºo.°]*)?\s*[:#-]?\s*\d{1,6}[A-Z]?", r"(?:torre|bloco)\s*(?:n[ºo.°]*)?\s*[:#-]?\s*[A-Z0-9-]{1,12}",
    r"(?:identifica[cç][aã]o|descri[cç][aã]o)\s+do\s+im[oó]vel",
]
TOPICS = [
    r"\b(?:apartamento|apto|ap\.?|unidade)\s*(?:n[ºo.°]*)?\s*[:#-]?\s*\d{1,6}[A-Z]?\b", r"\b(?:torre|bloco|edif[ií]cio)\s*(?:n[ºo.°]*)?\s*[:#-]?\s*[A-Z0-9-]{1,12}\b", r"\b(?:\d{1,2}\s*[ºo]\s*)?(?:pavimento|andar)\b",
    r"\b(?:tipo|tipologia)\s*(?:do\s+im[oó]vel|da\s+unidade)?\s*[:#-]?\s*[A-Z]",
]


def property_context(text) -> Column:
    """The stretch around an anchor that speaks of most topics, two at least; the earliest anchor's, then place's, of several; or null."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("\r"), F.lit(""))

    def best(t):
        stretches = [F.transform(match_starts(t, p.jvm(a)), lambda at: F.substring(t, F.greatest(at - 160, F.lit(0)) + 1, at + 720 - F.greatest(at - 160, F.lit(0)))) for a in ANCHORS]
        score = lambda x: sum((F.regexp_like(x, F.lit(p.jvm(q))).cast("int") for q in TOPICS), F.lit(0))
        scored = F.transform(F.concat(*stretches), lambda x, i: F.struct((-score(x)).alias("minus"), i.alias("i"), x.alias("x")))
        return let(F.array_sort(F.filter(scored, lambda s: s["minus"] <= -2)), lambda s: F.get(s, F.lit(0))["x"])

    return let(plain, best)


def property_description(text) -> Column:
    """Unit, tower, type and floor as a contract's description of the property says them."""
    # The patterns of each, in order.
    unit = [r"\b(?:apartamento|apto|ap\.?|unidade)\s*(?:n[ºo.°]*)?\s*[:#-]?\s*([0-9]{1,6}[A-Z]?)\b", r"\b(?:unidade|apartamento|apto)\s*(?:aut[oô]noma)?\s*[:#-]?\s*([0-9]{1,6}[A-Z]?)\b"]
    tower = [r"\b(?:torre|bloco)\s*(?:n[ºo.°]*)?\s*[:#-]?\s*([A-Z0-9-]{1,12})\b", r"\b(?:edif[ií]cio)\s*(?:n[ºo.°]*)?\s*[:#-]?\s*([A-Z0-9-]{1,12})\b"]
    kind = [r"\b(?:tipo\s+da\s+unidade|tipo\s+do\s+im[oó]vel|tipologia|tipo)\s*[:#-]?\s*([A-Z][A-Z0-9-]{0,15})\b"]
    ordinal, labelled = r"\b(\d{1,2})\s*[ºo]\s*(pavimento|andar)\b", r"\b(pavimento|andar)\s*[:#-]?\s*(\d{1,2})\b"

    def fields(d):
        storey = lambda number, word: F.concat(number, F.lit("º "), F.when(F.lower(word) == "andar", "Andar").otherwise("Pavimento"))
        floor = F.when(_group(d, ordinal) != "", storey(_group(d, ordinal), _group(d, ordinal, 2))).when(_group(d, labelled) != "", storey(_group(d, labelled, 2), _group(d, labelled)))
        said = {"property.unit": F.upper(first_match(d, unit)["value"]), "property.tower": F.upper(first_match(d, tower)["value"]), "property.type": F.concat(F.lit("Tipo "), F.upper(first_match(d, kind)["value"])), "property.floor": floor}
        return F.when(d.isNotNull(), _found([let(v, lambda x, f=f: F.when(x.isNotNull(), _field(f, x, 99, "Descrição do imóvel", squeezed(d)))) for f, v in said.items()])).otherwise(_found([]))

    return let(property_context(text), fields)


def normal_label(v) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(n.unaccent(v)), "[^A-Z0-9/ ]", ""), " +", " "))


def label_value(text, labels: list[str]) -> Column:
    """What follows one of the labels on its line, else the next line that isn't blank; empty where no line begins with one."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: x != "")
    bare = "|".join(sorted({_escaped(x) for x in labels}, key=len, reverse=True))

    def find(lines):
        starts = lambda x: F.exists(F.array(*[normal_label(F.lit(label)) for label in labels]), lambda y: (normal_label(x) == y) | F.startswith(normal_label(x), F.concat(y, F.lit(" "))))
        return let(F.array_position(F.transform(lines, starts), True).cast("int"), lambda at: F.when(at > 0, value(F.get(lines, at - 1), F.get(lines, at))).otherwise(""))

    def value(line, following):
        rest = F.trim(F.regexp_replace(line, f"(?iu)^(?:{bare})\\s*:?\\s*", ""))
        own = (rest != "") & ~F.exists(F.array(*[normal_label(F.lit(label)) for label in labels]), lambda y: normal_label(rest) == y)
        return F.when(own, cleaned(rest)).otherwise(F.coalesce(cleaned(following), F.lit("")))

    return let(lines, find)


def _escaped(text: str) -> str:
    return rf"\Q{text}\E"


def reservation_address(text) -> Column:
    """A reservation's address put together from its labelled parts: a street and one part more, or null."""
    # The labels of each part.
    labels = [["ENDEREÇO", "ENDERECO"], ["NÚMERO", "NUMERO"], ["COMPLEMENTO"], ["BAIRRO"], ["CIDADE"], ["ESTADO"]]

    def joined(parts):
        kept = F.filter(F.transform(parts, lambda x, i: F.when((i == 0) | (x != "-"), x).otherwise("")), lambda x: x != "")
        raw = F.array_join(F.filter(F.zip_with(parts, F.array(*[F.lit(x[0]) for x in labels]), lambda x, label: F.when(x != "", F.concat_ws(" ", label, x))), lambda x: x.isNotNull()), " | ")
        return F.when((F.get(parts, F.lit(0)) != "") & (F.size(kept) >= 2), _field("buyer.address", F.array_join(kept, ", "), 88, "Dados da reserva", raw))

    return let(F.array(*[label_value(text, x) for x in labels]), joined)


def financing_typo(text) -> Column:
    """An amount beside a label of financing that OCR has damaged: a hint at 70, never more."""
    found = r"\bf(?:nandamento|nanciamento)\b\s+\d+\s+(\d[\d.,]*)"
    return F.when(_group(text, found) != "", _field("financial.financing", cleaned(_group(text, found)), 70, "Print de pagamento (OCR a confirmar)", _group(text, found, 0)))


#: Labels of a reservation whose value follows on the line or below it, the part of that line that counts, and how the field's text is quoted. Later ones of a field go over earlier ones.
_AT = r"(?m)(?:^|\n)\s*"
_MONEY = r"((?:R\$\s*)?\d{1,3}(?:\.\d{3})*,\d{2})"
BELOW = [
    ("buyer.name", r"(?:NOME(?:\s+DO\s+CLIENTE)?|CLIENTE|PROPONENTE|COMPRADOR|ADQUIRENTE)", r"([\s\S]+)", "NOME: "),
    ("buyer.cpf", r"(?:CPF\s*\/?\s*CNPJ|CPFC?NPJ|CPF)", r"(\d{3}\.?\d{3}\.?\d{3}-?\d{2})", "CPF/CNPJ: "),
    ("buyer.rg", "RG", r"([A-Z0-9.-]{5,30})", "RG: "),
    ("buyer.maritalStatus", r"ESTADO\s+CIVIL", r"([\s\S]+)", "ESTADO CIVIL: "),
    ("buyer.email", r"(?:E-?MAIL|CORREIO\s+ELETR[OÔ]NICO)", r"([\w.+-]+(?:@|&)[\w.-]+\.[A-Z]{2,})", "E-MAIL: "),
    ("buyer.phone", r"(?:TELEFONE(?:\s*2)?|CELULAR|FONE|WHATSAPP)", r"(\+?\d[\d\s().-]{8,24})", "TELEFONE: "),
    ("financial.totalValue", r"(?:VALOR\s+DO\s+CONTRATO|VALOR\s+TOTAL)", _MONEY, "VALOR DO CONTRATO: "),
    ("financial.financing", r"(?:VALOR\s+)?FINANCIAMENTO", _MONEY, "FINANCIAMENTO: "),
    ("financial.fgts", "FGTS", _MONEY, "FGTS: "),
    ("financial.subsidy", r"(?:SUBS[IÍ]DIO|DESCONTO)", _MONEY, "SUBSÍDIO: "),
    ("financial.downPayment", r"(?:ENTRADA\s+TOTAL|RECURSOS\s+PR[ÓO]PRIOS)", _MONEY, "RECURSOS PRÓPRIOS: "),
]
ADDRESS_BELOW = [
    (r"(?:ENDERE[CÇ]O|LOGRADOURO|END\.?)", r"([\s\S]+)"), (r"(?:N[ÚU]MERO|N[ºO]\.?)", r"(\d{1,8}[A-Z]?)"), ("BAIRRO", r"([\s\S]+)"), ("CIDADE", r"([\s\S]+)"), (r"ESTADO(?!\s+CIVIL)\b", r"([\s\S]+)"), ("CEP", r"(\d{5}-?\d{3})"),
]
#: Columns of civil status and street, and of city, state, quarter and postal code, which make an address together.
CIVIL_COLUMNS = r"ESTADO\s+CIVIL:\s+PROFISS[ÃA]O:\s+LOGRADOURO:\s+END:\s*\r?\n\s*(SOLTEIR[OA](?:\(A\))?|CASAD[OA](?:\(A\))?|DIVORCIAD[OA](?:\(A\))?|VI[ÚU]V[OA](?:\(A\))?)[^\r\n]*?\s+(?:RUA|AV(?:ENIDA)?\.?|ALAMEDA|TRAVESSA)\s+((?:RUA|AV(?:ENIDA)?\.?|ALAMEDA|TRAVESSA)\s+[^\r\n]+)"
LOCATION_COLUMNS = r"CIDADE\s+ESTADO\s+BAIRRO:\s+CEP:\s*\r?\n\s*([A-ZÀ-Úa-zà-ú\s]+?)\s+([A-ZÀ-Úa-zà-ú\s]+?)\s+([A-ZÀ-Úa-zà-ú\s]+?)\s+(\d{5}-?\d{3})"
#: Grids of headings above their values, in the order in which a later one counts, with the fields of their groups.
GRIDS = [
    (r"NOME\s+DO\s+CLIENTE\s+CPF\s*\/?\s*CNPJ\s+RG\s+CELULAR\s*\r?\n\s*([^\r\n]+?)\s+(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\s+([A-Z0-9.-]{5,30})\s+(\+?[\d(][\d\s().-]{8,24})", {1: ("buyer.name", "NOME DO CLIENTE: "), 2: ("buyer.cpf", "CPF/CNPJ: "), 3: ("buyer.rg", "RG: "), 4: ("buyer.phone", "CELULAR: ")}),
    (r"TELEFONE\s+E-?MAIL\s+PROFISS[ÃA]O[\s\S]{0,80}?\r?\n\s*(\+?[\d(][\d\s().-]{8,24})\s+([\w.+-]+(?:@|&|Q)[\w.-]+\.[A-Z]{2,})", {1: ("buyer.phone", "TELEFONE: "), 2: ("buyer.email", "E-MAIL: ")}),
    (r"NASCIMENTO\s+ESTADO\s+CIVIL[\s\S]{0,80}?\r?\n\s*\d{1,2}[/-]\d{1,2}[/-]\d{4}\s+([^\r\n]+?)\s+(?:—|-)?\s*(?:RUA|AV(?:ENIDA)?\.?|ALAMEDA|TRAVESSA)\s+([^\r\n]+)", {1: ("buyer.maritalStatus", "ESTADO CIVIL: "), 2: ("buyer.address", "ENDEREÇO: ")}),
    (r"NOME:\s+NASCIMENTO:\s+CPF\s*\/?\s*CNPJ:\s+RG:\s*\r?\n\s*(.+?)\s+(\d{1,2}[/-]\d{1,2}[/-]\d{4})\s+(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\s+([A-Z0-9.-]{5,30})", {1: ("buyer.name", "NOME: "), 3: ("buyer.cpf", "CPF: "), 4: ("buyer.rg", "RG: ")}),
    (CIVIL_COLUMNS, {1: ("buyer.maritalStatus", "ESTADO CIVIL: ")}),
    (r"TELEFONE:\s+TELEFONE\s*2:\s+E-?MAIL:\s+[^\r\n]*\r?\n\s*([+()\d\s.-]{8,24})\s+[+()\d\s.-]{8,24}\s+([A-Z0-9._%+-]+(?:@|&)[A-Z0-9.-]+\.[A-Z]{2,})", {1: ("buyer.phone", "TELEFONE: "), 2: ("buyer.email", "E-MAIL: ")}),  # without white space in the number
    (LOCATION_COLUMNS, {}),
    (r"NOME\s+DO\s+CLIENTE[^\n\r]*[\n\r]+\s*([A-ZÀ-Ú][A-ZÀ-Ú\s]+?)\s+(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\s+(\d{8,14})\s+(\+?\d{10,15})", {1: ("buyer.name", "NOME DO CLIENTE: "), 2: ("buyer.cpf", "CPF / CNPJ: "), 3: ("buyer.rg", "RG: "), 4: ("buyer.phone", "CELULAR: ")}),
]


def reservation_grid(text) -> Column:
    """Fields of a reservation whose labels stand above or before their values, also in rows of headings. A number that repeats the tax id isn't an identity card's."""

    def below(label: str, part: str) -> Column:
        line = trimmed(_group(text, rf"{_AT}{label}\s*:?\s*(?:\r?\n\s*)?([^\r\n]+)"))
        return filled(trimmed(_group(line, part)))

    rows = []
    for field, label, part, quoted in BELOW:
        v = below(label, part)
        if field == "buyer.email":
            v = F.replace(v, F.lit("&"), F.lit("@"))
        ok = {"buyer.name": lambda x: ~F.regexp_like(x, F.lit(p.jvm(r"^(?:NASCIMENTO|CPF|RG|ESTADO)\b"))), "buyer.rg": lambda x: F.regexp_like(x, F.lit("[0-9]{4}"))}.get(field, lambda x: x.isNotNull())
        rows.append(let(v, lambda x, f=field, q=quoted, ok=ok: F.when(x.isNotNull() & ok(x), _field(f, x, 90, "Dados da reserva", F.concat(F.lit(q), x)))))
    address = F.array_join(F.filter(F.array(*[F.coalesce(below(a, b), F.lit("")) for a, b in ADDRESS_BELOW]), lambda x: ~x.isin("", "-")), ", ")
    rows.append(let(address, lambda x: F.when(x != "", _field("buyer.address", x, 90, "Dados da reserva", F.concat(F.lit("ENDEREÇO: "), x)))))
    found = _found(rows)
    for grid, groups in GRIDS:
        def over(hit, grid=grid, groups=groups):
            if grid == LOCATION_COLUMNS:
                street = F.coalesce(F.nullif(trimmed(_group(text, CIVIL_COLUMNS, 2)), F.lit("")), below(*ADDRESS_BELOW[0]), F.lit(""))
                parts = F.filter(F.array(street, *[trimmed(_group(text, grid, i)) for i in (3, 1, 2, 4)]), lambda x: x != "")
                return F.when(hit != "", let(F.array_join(parts, ", "), lambda v: F.array(_field("buyer.address", v, 90, "Dados da reserva", F.concat(F.lit("ENDEREÇO: "), v))))).otherwise(_found([]))
            each = []
            for i, (f, q) in groups.items():
                v = trimmed(_group(text, grid, i))
                v = F.regexp_replace(v, "[&Q]", "@") if f == "buyer.email" else v
                v = F.regexp_replace(v, r"\s+", "") if f == "buyer.phone" and grid.startswith(r"TELEFONE:") else v
                keep = v != trimmed(_group(text, grid, i - 1)) if f == "buyer.rg" else F.lit(True)
                # A null value takes the field out.
                each.append(_field(f, F.when(keep, v), F.when(keep, 90).otherwise(0), "Dados da reserva", F.concat(F.lit(q), v)))
            return F.when(hit != "", F.array(*each)).otherwise(_found([]))

        found = laid_over(found, let(_group(text, grid, 0), over))
    phone = _group(text, r"TELEFONE[^\n\r]*[\n\r]+\s*(\+?\d{10,15})")
    email = _group(text, r"([\w.+-]+@[\w.-]+\.[A-Z]{2,})")
    last = _found([
        F.when(phone != "", _field("buyer.phone", phone, 90, "Dados da reserva", F.concat(F.lit("TELEFONE: "), phone))),
        F.when((email != "") & ~F.regexp_like(email, F.lit("(?i)[o0]{2}")), _field("buyer.email", email, 90, "Dados da reserva", F.concat(F.lit("E-MAIL: "), email))),
    ])
    return laid_over(found, last)


#: The blocks of a transfer declaration, from one heading to the next.
BLOCKS = {
    "buyer": (r"DADOS\s+DO\s+ADQUIRENTE", r"DADOS\s+DO\s+TRANSMITENTE"), "seller": (r"DADOS\s+DO\s+TRANSMITENTE", r"NATUREZA\s+DA\s+TRANSA[CÇ][AÃ]O"),
    "property": (r"DADOS\s+DO\s+IM[ÓO]VEL\s+OBJETO\s+DA\s+TRANSA[CÇ][AÃ]O", r"DECLARA[CÇ][AÃ]O\s+DE\s+VALORES"), "money": (r"DECLARA[CÇ][AÃ]O\s+DE\s+VALORES", r"RESPONS[ÁA]VEL\s+PELAS\s+INFORMA[CÇ][ÕO]ES"),
}
_ID, _NAME = r"CPF\s*\/\s*CNPJ|CPF\s*\/\s*CPJ|CPFCNPJ", r"Nome(?:\s*\/\s*Raz[ãa]o\s+Social)?"
#: Fields between a label and the next one: block, label, what ends the value.
BETWEEN = [
    ("buyer.name", "buyer", _NAME, _ID + "|Endere[cç]o|Email"), ("buyer.cpf", "buyer", _ID, "Endere[cç]o|Email|Telefone"), ("buyer.address", "buyer", "Endere[cç]o", "Email|Telefone"),
    ("seller.legalName", "seller", _NAME, _ID + "|Endere[cç]o|Email"), ("seller.cnpj", "seller", _ID, "Endere[cç]o|Email|Telefone"), ("seller.address", "seller", "Endere[cç]o", "Email|Telefone"),
    ("transaction.nature", "all", r"NATUREZA\s+DA\s+TRANSA[CÇ][AÃ]O", r"DATA\s+DO|INTERMEDIA[CÇ][AÃ]O|DADOS\s+DO\s+IM[ÓO]VEL"), ("property.iptu", "property", r"(?:Inscri[cç][ãa]o\s+do\s+IPTU|Inscr\.?\s+IPTU)", "Endere[cç]o|N[úu]mero|Complemento"),
    ("property.address", "property", "Endere[cç]o", "Loteamento|N[úu]mero|Complemento|Quadra"), ("property.type", "property", r"Tipo(?:\s+de)?\s+Im[óo]vel", r"N[ºo°]?\.?\s*Matr[íi]cula|Matr[íi]cula|[ÁA]rea"), ("property.registration", "property", r"(?:N[ºo]\s*)?Matr[íi]cula", "[ÁA]rea"),
]
#: Fields that are a number after their label.
NUMBERS = [
    ("property.privateArea", "property", r"[ÁA]rea\s+Privativa"), ("property.commonArea", "property", r"[ÁA]rea\s+Comum"), ("property.totalArea", "property", r"[ÁA]rea\s+Total"), ("property.landArea", "property", r"[ÁA]rea\s+(?:do\s+)?Terreno"),
    ("financial.financing", "money", r"Valor\s+financiado(?:\s*\(SFH\))?"), ("financial.nonFinancedValue", "money", r"Valor\s+n[ãa]o\s+financiado"), ("financial.totalValue", "money", r"Valor\s+TOTAL\s+DECLARADO"),
]
_AREA_END, _MONEY_END = r"(?=\s*m\s*[²2]?\b|\s+(?:FRA[CÇ][AÃ]O|[ÁA]REA|DECLARA[CÇ][AÃ]O|$))", r"(?=\s+(?:VALOR|OBS|RESPONS|$))"


def between(text, start: str, end: str) -> Column:
    """What stands after the first start, up to the next end or the end of the text."""
    return F.trim(F.regexp_extract(text, p.jvm(rf"(?:{start})([\s\S]*?)(?=(?:{end})|$)"), 1))


def declaration(text) -> Column:
    """Fields of a transfer declaration by its blocks. A null value stands for a field that the blocks show isn't there, whatever the catalogue took for it."""

    def fields(b):
        block = lambda name: b[name]
        said = {}
        for field, name, label, end in BETWEEN:
            v = structured_value(F.regexp_replace(between(block(name), label, end), r"^\s*[:*\-]?\s*", ""))
            digits = {"buyer.cpf": r"(\d{3}\D?\d{3}\D?\d{3}\D?\d{2})", "seller.cnpj": r"(\d{2}\D?\d{3}\D?\d{3}\D?\d{4}\D?\d{2})"}.get(field)
            said[field] = filled(_group(v, digits)) if digits else v
        for field, name, label in NUMBERS:
            said[field] = structured_number(_group(block(name), rf"(?:{label})[^\d]{{0,20}}(\d[\d\s.,]*?)" + (_AREA_END if name == "property" else _MONEY_END)))
        for who in ("buyer", "seller"):
            said[f"{who}.email"] = filled(_group(block(who), r"([\w.+-]+@[\w.-]+\.[A-Z]{2,})"))
            phone = trimmed(_group(block(who), r"(?:Telefone|Fone|Celular)\s*:?\s*(\+?\d[\d() .-]{7,}\d)"))
            said[f"{who}.phone"] = let(phone, lambda x: F.when(F.length(n.digits(x)).between(10, 11), x))
        said["property.unit"] = filled(_group(block("property"), r"Complemento[^\n\r]*?(?:A\s*P|APTO?|APARTAMENTO)\s*([A-Z0-9-]+)"))
        said["property.tower"] = filled(_group(block("property"), r"Complemento[^\n\r]*?\b(?:TORRE|T)\s*0*(\d{1,2})\b"))
        gone = {f: block("seller") != "" for f in said if f.startswith("seller.")} | {f: block("property") != "" for f in ("property.type", "property.unit", "property.tower")}
        gone["transaction.nature"] = F.regexp_like(block("all"), F.lit(p.jvm(r"NATUREZA\s+DA\s+TRANSA[CÇ][AÃ]O")))
        none = F.lit(None).cast("string")
        return _found([let(F.trim(v), lambda x, f=f: F.when(x.isNotNull(), _field(f, x, 96, "DTI", x)).when(gone.get(f, F.lit(False)), _field(f, none, 0, "DTI", none))) for f, v in said.items()])

    def blocks(compact):
        parts = {name: between(compact, *ends) for name, ends in BLOCKS.items()}
        parts["money"] = F.coalesce(filled(parts["money"]), compact)
        return F.struct(*[v.alias(k) for k, v in parts.items()], compact.alias("all"))

    return let(let(squeezed(text), blocks), fields)


AREAS = ("property.privateArea", "property.commonArea", "property.totalArea", "property.landArea", "property.terrainArea")


def with_declaration(base: Column, said: Column) -> Column:
    """base with a declaration's fields: they fill what is missing, go over what is below 94 and over areas, and take out what the blocks show isn't there."""
    sure = lambda b: (b["confidence"] >= 94) & ~b["field_id"].isin(*AREAS)
    held = lambda s: F.exists(base, lambda b: (b["field_id"] == s["field_id"]) & sure(b))
    return laid_over(base, F.filter(said, lambda s: s["value"].isNull() | ~held(s)))


def extracted(docs: DataFrame, catalogue: dict | None = None, sources: list[str] | None = None) -> DataFrame:
    """docs (source, text) with fields: all that the text's labels say, one entry a field. A declaration of transfer is read as one, whatever its source. Null text is empty. sources names those that may come, where that is known: the plan then holds no others."""
    text = F.coalesce("text", F.lit(""))

    def of(source: str) -> Column:
        base = by_catalogue(text, source, catalogue)
        if source == "MINUTA":
            return laid_over(laid_over(base, composition(text)), property_description(text))
        if source == "DADOS_RESERVA":
            return let(laid_over(base, _found([reservation_address(text)])), lambda b: laid_over(laid_over(_found([financing_typo(text)]), b), reservation_grid(text)))
        return let(base, lambda b: with_declaration(b, declaration(text))) if source == "ITBI" else base

    resolved = F.when(looks_like_declaration(text), "ITBI").otherwise(F.col("source"))
    fields = _found([])
    for source in sources or catalogue or p.CATALOGUE:
        fields = F.when(F.col("_as") == source, of(source)).otherwise(fields)
    done = docs.withColumn("_as", resolved).withColumn("fields", fields).drop("_as")
    return done.withColumn("fields", F.filter("fields", lambda f: f["value"].isNotNull() & (f["value"] != "")))


def extracted_rows(docs: DataFrame, *keys: str, catalogue: dict | None = None, sources: list[str] | None = None) -> DataFrame:
    """(keys, source, field_id, value, confidence, section, raw): a row for each field of extracted()."""
    return opened(extracted(docs, catalogue, sources), F.col("fields"), "f", *keys, "source").select(*keys, "source", "f.*")
