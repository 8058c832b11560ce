"""The catalogue of labels by which fields are read from a source's text, and how its patterns become JVM ones."""

from __future__ import annotations

import re

# For each source its fields, each with the section it is read
# from, the confidence of a hit, and the patterns in the order they are tried;
# the first that gives a group that isn't blank counts. Case doesn't.
CATALOGUE = {
    "MINUTA": [
        ("contract.number", "Ressalvas / identificação do processo", 94, [
            r"(?:n[úu]mero\s+do\s+(?:contrato|processo)|n[ºo.]?\s*do\s+(?:contrato|processo))\s*[:#-]?\s*([A-Z0-9./-]{3,40})",
            r"\bprocesso\s*(?:n[úu]mero|n[ºo.]?)?\s*[:#-]\s*([A-Z0-9./-]{3,40})",
            r"\b(?:contrato|processo)\b[\s\r\n]*(?:n(?:[º°o.]|[úu]mero|umero)?[\s\r\n]*)?[:#-]?[\s\r\n]*([0-9][A-Z0-9./-]{3,40})",
            r"\bcontrato\s*(?:n[úu]mero|n[ºo.]?)?\s*[:#-]\s*([A-Z0-9./-]{3,40})",
        ]),
        ("contract.date", "Identificação do contrato", 98, [
            r"\b(?:FORTALEZA|FORTALEZA\/CE)\s*,?\s*CE\s+(\d{1,2}\s+de\s+[A-ZÀ-Úa-zà-ú]+\s+de\s+\d{4})",
            r"(?:data\s+(?:do\s+contrato|da\s+contrata[cç][aã]o|de\s+assinatura)|contrato\s+celebrado\s+em)\s*[:\-]?\s*(\d{1,2}[\/.-]\d{1,2}[\/.-]\d{4}|\d{1,2}\s+de\s+[A-ZÀ-Úa-zà-ú]+\s+de\s+\d{4})",
        ]),
        ("contract.agencyCode", "Identificação do contrato", 90, [r"(?:ag[eê]ncia|c[oó]digo\s+da\s+ag[eê]ncia)[^:\n\r]*:\s*([A-Z0-9./-]+)"]),
        ("contract.financingModality", "Identificação do contrato", 90, [r"modalidade\s+de\s+financiamento[^:\n\r]*:\s*([^\n\r]+)"]),
        ("contract.housingProgram", "Identificação do contrato", 90, [r"programa\s+habitacional[^:\n\r]*:\s*([^\n\r]+)"]),
        ("financial.financing", "Composição dos recursos", 100, [r"B\.4\.1[^\n\r:]*:\s*\|?\s*(R\$\s*\d[\d.,]*)", r"B\s*1\s*\.\s*3[^\n\r]*?financiamento[^\n\r]*?(R\$\s*\d[\d.,]*)"]),
        ("financial.downPayment", "Composição dos recursos", 100, [r"B\.4\.2[^\n\r:]*:\s*\|?\s*(R\$\s*\d[\d.,]*)", r"B\s*1\s*\.\s*1[^\n\r]*?recursos\s+pr[oó]prios[^\n\r]*?(R\$\s*\d[\d.,]*)"]),
        ("financial.fgts", "Composição dos recursos", 100, [r"B\.4\.3[^\n\r:]*:\s*\|?\s*(R\$\s*\d[\d.,]*)", r"B\s*1\s*\.\s*2[^\n\r]*?FGTS[^\n\r]*?(R\$\s*\d[\d.,]*)"]),
        ("financial.subsidy", "Composição dos recursos", 100, [r"B\.4\.5[^\n\r:]*:\s*\|?\s*(R\$\s*\d[\d.,]*)"]),
        ("financial.totalValue", "Valor do contrato", 98, [
            r"valor destinado[^.\n\r]*?\s+é\s*(R\$\s*\d[\d.,]*)",
            r"valor (?:total|do imóvel|da venda)[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)",
            r"valor\s+de\s+aquisi[cç][aã]o[^.\n\r]*?objeto\s+deste\s+contrato\s+equivale\s+a\s*(R\$\s*\d[\d.,]*)",
        ]),
        ("financial.appraisalValue", "Valores da operação", 92, [r"valor\s+da\s+avalia[cç][aã]o[^:\n\r]*:\s*(R\$\s*\d[\d.,]*)"]),
        ("financial.housingEntry", "Valores da operação", 90, [r"entrada\s+moradia[^:\n\r]*:\s*(R\$\s*\d[\d.,]*)"]),
        ("property.unit", "Descrição do imóvel", 92, [
            r"\b(?:futura\s+)?unidade\s+aut[oô]noma\s+(?:apartamento|apto)\s*(?:n[ºo.]*)?\s*([0-9]{1,6}[A-Z]?)\b",
            r"\b(?:apartamento|apto)\s*(?:n[ºo.]*)?\s*([0-9]{1,6}[A-Z]?)\b",
            r"\bunidade\s*(?:n[ºo.]*)?\s*([0-9]{1,6}[A-Z]?)\b",
        ]),
        ("property.tower", "Descrição do imóvel", 92, [
            r"\b(?:apartamento|apto)\s*(?:n[ºo.]*)?\s*[0-9]{1,6}[A-Z]?\s+(?:da|do|na|no)\s+(?:torre|bloco)\s*(?:n[ºo.]*)?\s*([A-Z0-9-]{1,12})\b",
            r"\b(?:torre|bloco)\s*(?:n[ºo.]*)?\s*([A-Z0-9-]{1,12})\b",
        ]),
        ("property.registration", "Descrição do imóvel", 90, [r"\bmatr[ií]cula\s*(?:n[ºo.]*)?\s*([A-Z0-9./-]{2,30})\b"]),
        ("property.registryOffice", "Descrição do imóvel", 88, [r"(?:cart[oó]rio|of[ií]cio)\s+(?:de\s+)?registro\s+de\s+im[oó]veis?[^:\n\r]*:?\s*([^\n\r]+)"]),
        ("property.type", "Descrição do imóvel", 88, [r"(?:tipo\s+do\s+im[oó]vel|tipo\s+da\s+unidade)[^:\n\r]*:\s*([^\n\r]+)", r"\b(?:\d{1,2}\s*[ºo]\s*)?pavimento\s*,?\s*(tipo\s+[A-Z0-9-]+)\b"]),
        ("property.floor", "Descrição do imóvel", 88, [r"(\d{1,2}\s*[ºo]\s*pavimento)\b", r"(?:pavimento|andar)[^:\n\r:]*:\s*([A-Z0-9-]+)"]),
        ("property.terrainArea", "Descrição do imóvel", 96, [
            r"área\s+(?:total\s+)?do\s+terreno[^\d]*(\d+[\d.,]*\s*m[²2]?)",
            r"\bterreno\b[^.\n\r]{0,100}?\b(?:possui|tem)\b\s*(\d+[\d.,]*\s*m[²2]?)",
            r"\bterreno\b[^.\n\r]{0,120}?área\s+total\s+(?:de\s*)?(\d+[\d.,]*\s*m[²2]?)",
        ]),
        ("property.landArea", "Descrição do imóvel", 96, [
            r"área\s+(?:total\s+)?do\s+terreno[^\d]*(\d+[\d.,]*\s*m[²2]?)",
            r"\bterreno\b[^.\n\r]{0,100}?\b(?:possui|tem)\b\s*(\d+[\d.,]*\s*m[²2]?)",
            r"\bterreno\b[^.\n\r]{0,120}?área\s+total\s+(?:de\s*)?(\d+[\d.,]*\s*m[²2]?)",
        ]),
    ],
    "DADOS_RESERVA": [
        ("buyer.name", "Dados da reserva", 92, [r"(?:nome(?:\s+do\s+cliente)?|cliente|proponente|comprador|adquirente)\s*:?\s*([^\n\r]+)"]),
        ("buyer.cpf", "Dados da reserva", 94, [r"(?:cpf\s*\/?\s*cnpj|cpfc?npj|cpf)\s*:?\s*(\d{3}\.?\d{3}\.?\d{3}-?\d{2})"]),
        ("buyer.rg", "Dados da reserva", 90, [r"\brg\s*:?\s*([A-Z0-9.-]{5,30})"]),
        ("buyer.maritalStatus", "Dados da reserva", 90, [r"estado\s+civil\s*:?\s*([^\n\r]+)"]),
        ("buyer.email", "Dados da reserva", 96, [r"(?:e-?mail|correio\s+eletr[oô]nico)\s*:?\s*([^\s\n\r]+@[^\s\n\r]+)"]),
        ("buyer.phone", "Dados da reserva", 94, [r"(?:telefone|celular|fone|whatsapp)\s*:?\s*([+()\d\s.-]{8,24})"]),
        ("property.development", "Dados da reserva", 92, [r"unidade\s*:?\s*([^/\n\r]+?)(?:\s*\/\s*torre|\s*\/\s*\d|\n|\r)"]),
        ("property.tower", "Dados da reserva", 94, [r"\/\s*torre\s*([A-Z0-9-]{1,12})"]),
        ("property.unit", "Dados da reserva", 94, [r"\/\s*torre\s*[A-Z0-9-]{1,12}\s*\/\s*([A-Z0-9-]{1,12})"]),
        ("property.registration", "Dados da reserva", 88, [r"matr[ií]cula\s*:?\s*([A-Z0-9./-]+)"]),
        ("financial.totalValue", "Print de pagamento", 94, [r"valor\s+do\s+contrato[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)", r"valor\s+total[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)", r"valor\s+do\s+contrato\s*\n\s*(R\$\s*\d[\d.,]*)"]),
        ("financial.downPayment", "Print de pagamento", 94, [r"(?:entrada|recursos\s+pr[oó]prios)[^\n\r:]*:?\s*(R\$\s*\d[\d.,]*)", r"(?:entrada|recursos\s+pr[oó]prios)\s+\d+\s+(R\$\s*\d[\d.,]*)"]),
        ("financial.financing", "Print de pagamento", 94, [
            r"financiamento[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)", r"financiamento\s+\d+\s+(R\$\s*\d[\d.,]*)", r"valor\s+financiado[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)",
            r"\bfinanciamento\b[^\n\r]{0,80}?(R\$\s*\d[\d.,]*)", r"\bfinanciamento\b\s+\d+\s+(\d[\d.,]*)", r"\bfinanciamento\b[^\n\r]{0,40}?(\d{1,3}(?:\.\d{3})*,\d{2})",
        ]),
        ("financial.fgts", "Print de pagamento", 92, [r"\bFGTS\b[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)", r"\bFGTS\b\s+\d+\s+(R\$\s*\d[\d.,]*)", r"\bFGTS\b\s+\d+\s+(\d[\d.,]*)"]),
        ("financial.subsidy", "Print de pagamento", 92, [r"subs[ií]dio[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)", r"subs[ií]dio\s+\d+\s+(R\$\s*\d[\d.,]*)", r"desconto[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)", r"(?:subs[ií]dio|desconto)\s+\d+\s+(\d[\d.,]*)"]),
    ],
    "SIOPI": [
        ("buyer.cpf", "Espelho SIOPI", 94, [r"\bCPF\b[^\d]*(\d{3}\.?\d{3}\.?\d{3}-?\d{2})"]),
        ("buyer.name", "Espelho SIOPI", 90, [r"(?:cliente|proponente|comprador)[^\n\r:]*:\s*([^\n\r]+)"]),
        ("financial.financing", "Espelho SIOPI", 94, [r"valor (?:do )?financiamento[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)"]),
        ("financial.totalValue", "Espelho SIOPI", 94, [r"valor (?:total|do imóvel|da venda)[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)"]),
    ],
    "ITBI": [
        ("buyer.name", "ITBI", 94, [r"\bNome\s*:\s*([^\n\r]+)", r"Texto1\s*:\s*([A-ZÀ-Ú\s]+?)(?=\d{11}\b)", r"NomeRazão Social_4\s*:\s*([^\n\r]+)", r"Nome\/Razão Social_4\s*:\s*([^\n\r]+)"]),
        ("buyer.cpf", "ITBI", 94, [
            r"CPF\s*\/??\s*CNPJ\s*:\s*(\d{3}\.?\d{3}\.?\d{3}-?\d{2})", r"CPFCNPJ\s*:\s*(\d{3}\.?\d{3}\.?\d{3}-?\d{2})", r"Texto1\s*:\s*[A-ZÀ-Ú\s]+?(\d{11})\b", r"Texto12\s*:\s*(\d{11})\b", r"\bCPF\b[^\d]*(\d{3}\.?\d{3}\.?\d{3}-?\d{2})",
        ]),
        ("buyer.email", "ITBI", 92, [r"Email_4\s*:\s*([^\s\n\r]+@[^\s\n\r]+)", r"\bEmail\s*:\s*([^\s\n\r]+@[^\s\n\r]+)"]),
        ("buyer.address", "ITBI", 94, [r"Endereço\s*:\s*(.+?)(?=\s+(?:Email|Telefone|Text\d+|Texto\d+|Endereço_?2|Inscri[cç][aã]o|$))"]),
        ("seller.legalName", "ITBI", 94, [r"Text1\s*:\s*([^\n\r]+)", r"Texto2\s*:\s*([^\n\r]+)", r"NomeRazão Social\s*:\s*([^\n\r]+)"]),
        ("seller.cnpj", "ITBI", 94, [r"Text2\s*:\s*(\d{2}\.?\d{3}\.?\d{3}\/?\d{4}-?\d{2})", r"Texto3\s*:\s*(\d{2}\.?\d{3}\.?\d{3}\/?\d{4}-?\d{2})", r"Texto11\s*:\s*(\d{2}\.?\d{3}\.?\d{3}\/?\d{4}-?\d{2})", r"\bCNPJ\b[^\d]*(\d{2}\.?\d{3}\.?\d{3}\/?\d{4}-?\d{2})"]),
        ("seller.address", "ITBI", 94, [r"Endereço_?2\s*:\s*(.+?)(?=\s+(?:Inscri[cç][aã]o|Text\d+|Texto\d+|[ÁA]rea|Complemento|Valor\s)|$)"]),
        ("seller.email", "ITBI", 90, [r"(?:Email|E-mail)[^:\n\r]*:\s*([^\s\n\r]+@[^\s\n\r]+)"]),
        ("seller.phone", "ITBI", 88, [r"(?:Telefone|Celular)[^:\n\r]*:\s*([+()\d\s.-]{8,24})"]),
        ("transaction.instrumentDate", "ITBI", 88, [r"(?:data\s+do\s+instrumento|data\s+da\s+transa[cç][aã]o)[^:\n\r]*:\s*([^\n\r]+)"]),
        ("transaction.nature", "ITBI", 88, [r"natureza\s+da\s+transa[cç][aã]o[^:\n\r]*:\s*([^\n\r]+)", r"Compra\s+Venda\s+etc\s*:\s*(.+?)(?=\s+(?:Valor|Check\s*Box|Caucaia:|$))"]),
        ("transaction.transferredPercentage", "ITBI", 88, [r"(?:%\s*transmitido|percentual\s+transmitido)[^:\n\r]*:\s*([\d.,]+\s*%?)"]),
        ("property.iptu", "ITBI", 94, [r"Inscri[cç][aã]o\s+do\s+IPTU\s*:\s*([A-Z0-9./-]+)", r"Texto6\s*:\s*([A-Z0-9./-]+)"]),
        ("property.registration", "ITBI", 94, [r"Matr[ií]cula\s*:\s*([A-Z0-9./-]+)", r"Text4\s*:\s*([A-Z0-9./-]+)"]),
        ("property.type", "ITBI", 88, [r"Text6\s*:\s*(.+?)(?=\s+(?:Text\d+|Texto\d+|[ÁA]rea|Complemento|Valor|$))", r"(?:tipo\s+do\s+im[oó]vel|tipo)[^:\n\r]*:\s*([^\n\r]+)"]),
        ("property.address", "ITBI", 90, [r"Text3\s*:\s*(.+?)(?=\s+(?:Text\d+|Texto\d+|[ÁA]rea|Complemento|Valor|$))", r"Endereço_2\s*:\s*([^\n\r]+)"]),
        ("property.unit", "ITBI", 94, [r"Complemento\s*:\s*[^\n\r]*?\b(?:APARTAMENTO|APTO?|A\s*P)\.?\s*(?:N[ºO.]*)?\s*(\d{1,6}[A-Z]?)\b"]),
        ("property.tower", "ITBI", 90, [r"Complemento\s*:\s*[^\n\r]*?TORRE\s*([A-Z0-9-]+)", r"Complemento\s*:\s*[^\n\r]*?\bT\s*([A-Z0-9-]+)\s*,"]),
        ("property.privateArea", "ITBI", 92, [r"Área privativa m²\s*:\s*([^\n\r]+)"]),
        ("property.commonArea", "ITBI", 92, [r"Área comum m²\s*:\s*([^\n\r]+)"]),
        ("property.totalArea", "ITBI", 92, [r"Área total m²\s*:\s*([^\n\r]+)"]),
        ("property.landArea", "ITBI", 96, [r"área\s+do\s+terreno(?:\s*\(?\s*m[²2]\s*\)?)?\s*:\s*(\d+[\d.,]*\s*m?[²2]?)", r"área\s+terreno[^:\n\r]*[:\-]\s*([^\n\r]+)"]),
        ("property.idealFraction", "ITBI", 92, [r"Fração ideal\s*:\s*([^\n\r]+)"]),
        ("financial.financing", "ITBI", 92, [r"Valor financiado SFH\s*:\s*(\d[\d.,]*)", r"VALOR FINANCIADO\s*R\$\s*(\d[\d.,]*)", r"Valor financiado\s*:\s*(?:R\$\s*)?(\d[\d.,]*)", r"valor financiado[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)"]),
        ("financial.nonFinancedValue", "ITBI", 90, [r"Valor não financiado\s*:\s*(\d[\d.,]*)"]),
        ("financial.totalValue", "ITBI", 92, [r"VALOR TOTAL DECLARADO\s*:\s*(\d[\d.,]*)", r"valor (?:total|declarado|do imóvel)[^\n\r:]*:\s*(R\$\s*\d[\d.,]*)", r"COMPRA E VENDA R\$\s*(\d[\d.,]*)"]),
    ],
    "MATRICULA": [
        ("seller.cnpj", "Matrícula", 94, [r"\bCNPJ\b[^\d]*(\d{2}\.?\d{3}\.?\d{3}\/?\d{4}-?\d{2})"]),
        ("seller.legalName", "Matrícula", 88, [r"(?:propriet[aá]ri[ao]|incorporadora|construtora|transmitente)[^:\n\r]{0,50}:\s*([^\n\r]+)", r"(?:raz[aã]o\s+social|denomina[cç][aã]o)[^:\n\r:]*:\s*([^\n\r]+)"]),
        ("property.registration", "Matrícula", 94, [r"\bmatr[ií]cula\s*(?:n[ºo.]*)?\s*([A-Z0-9./-]{2,30})\b"]),
        ("property.privateArea", "Matrícula", 90, [r"área privativa[^\d]*(\d+[\d.,]*\s*m[²2]?)"]),
        ("property.totalArea", "Matrícula", 88, [r"área total[^\d]*(\d+[\d.,]*\s*m[²2]?)"]),
        ("property.idealFraction", "Matrícula", 88, [r"fração ideal[^\d]*(\d+[\d.,]*)"]),
    ],
    "FRACOES": [
        ("property.iptu", "Frações do empreendimento", 92, [r"(?:inscri[cç][aã]o\s+(?:imobili[aá]ria|municipal)|IPTU)[^:\n\r]*:?\s*([A-Z0-9./-]{3,30})"]),
        ("property.privateArea", "Frações do empreendimento", 90, [r"área privativa[^\d]*(\d+[\d.,]*\s*m[²2]?)"]),
        ("property.totalArea", "Frações do empreendimento", 88, [r"área total[^\d]*(\d+[\d.,]*\s*m[²2]?)"]),
        ("property.idealFraction", "Frações do empreendimento", 88, [r"fração ideal[^\d]*(\d+[\d.,]*)"]),
    ],
    "IPTU": [
        ("property.iptu", "Documento IPTU", 96, [r"(?:inscri[cç][aã]o\s+(?:imobili[aá]ria|municipal)|inscri[cç][aã]o\s+do\s+im[oó]vel|IPTU)[^:\n\r]*:?\s*([A-Z0-9./-]{3,30})"]),
        ("property.address", "Documento IPTU", 88, [r"endere[cç]o[^:\n\r]*:?\s*([^\n\r]+)"]),
    ],
}

_WORD = "[A-Za-z0-9_]"
#: What one of the catalogue's signs means where the JVM means something else: \b knows ASCII words alone, \s also no-break and typographic spaces, $ the very end.
_MEANING = {r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "$": r"\z"}
_SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SIGNS = re.compile(r"\\.|\[|\]|\$", re.DOTALL)


def jvm(pattern: str) -> str:
    """A pattern of the catalogue for the JVM's engine, case-insensitive."""
    inside = False

    def put(m):
        nonlocal inside
        sign = m[0]
        if sign == "[" or sign == "]":
            inside = sign == "["
            return sign
        if sign == r"\s":
            return _SPACES if inside else f"[{_SPACES}]"
        return sign if inside else _MEANING.get(sign, sign)

    return "(?iu)" + _SIGNS.sub(put, pattern)


def registered(source: str, field_id: str, section: str, confidence: int, patterns: list[str], catalogue: dict | None = None) -> dict:
    """The catalogue with one definition more (one of the same source and field is replaced)."""
    whole = {s: list(rows) for s, rows in (catalogue or CATALOGUE).items()}
    whole[source] = [r for r in whole.get(source, []) if r[0] != field_id] + [(field_id, section, confidence, patterns)]
    return whole
