"""DuckDB SQL for the registered queries, built from a few expression helpers."""

from __future__ import annotations

from tallyspark.functions import catalog
from tallyspark.plans import readings, streams
from tallyspark.sources import adapters as a

EV = a.duck(a.EVIDENCE)


def text(x: str) -> str:
    return rf"upper(replace(trim(regexp_replace(regexp_replace(strip_accents(coalesce({x}, '')), '[\^`·¨¯´¸]', '', 'g'), '[\s\x0b]+', ' ', 'g')), 'ß', 'SS'))"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def decimal(x: str) -> str:
    kept = rf"regexp_replace(regexp_replace(coalesce({x}, ''), 'R\$', '', 'gi'), '[^0-9,.\-]', '', 'g')"
    plain = rf"""CASE WHEN (contains({kept}, '.') AND contains({kept}, ',')) OR regexp_full_match({kept}, '[^.,]*[.,][^.,]{{2}}')
      THEN regexp_replace(regexp_extract({kept}, '^(.*)[.,]', 1), '[.,]', '', 'g') || '.' || regexp_extract({kept}, '[.,]([^.,]*)$', 1) ELSE regexp_replace({kept}, '[.,]', '', 'g') END"""
    return rf"CAST(round(TRY_CAST(nullif(regexp_extract({plain}, '^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)'), '') AS DECIMAL(38,10)), 2) AS DECIMAL(28,2))"


def money(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE coalesce(CAST({decimal(x)} AS VARCHAR), {text(x)}) END"


def area(x: str) -> str:
    dotted = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\s', '', 'g'), ',', '.')"
    number = rf"round(TRY_CAST(nullif(regexp_extract({dotted}, '[0-9]+(?:\.[0-9]+)?'), '') AS DECIMAL(38,10)), 4)"
    return rf"coalesce(regexp_replace(regexp_replace(CAST(CAST({number} AS DECIMAL(34,4)) AS VARCHAR), '0+$', ''), '\.$', ''), {text(x)})"


def identifier(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({text(x)}, '\b(TORRE|BLOCO|APARTAMENTO|APTO|UNIDADE)\b', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g'), '^0+([0-9])', '\1')"


def date(x: str) -> str:
    p = "'([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})'"
    part = lambda i: f"regexp_extract(coalesce({x}, ''), {p}, {i})"
    return f"CASE WHEN regexp_matches(coalesce({x}, ''), {p}) THEN CASE WHEN length({part(3)}) = 2 THEN '20' ELSE '' END || {part(3)} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(1)}, 2, '0') ELSE {text(x)} END"


def address(x: str) -> str:
    out = text(x)
    for p, short in ((r"\bAVENIDA\b", "AV"), (r"\bAV\b\.?", "AV"), (r"\bRUA\b", "R"), (r"\bR\b\.?", "R"), (r"\bN[º°.]?\b", "NUMERO"), (r"\bNO\b", "NUMERO"), (r"\bAPARTAMENTO\b", "AP"), (r"\bAPTO\b", "AP")):
        out = f"regexp_replace({out}, '{p}', '{short}', 'g')"
    return out


def same(x: str) -> str:
    return f"regexp_replace({text(x)}, '[^A-Z0-9]', '', 'g')"


def email(x: str) -> str:
    return f"lower(trim(coalesce({x}, '')))"


def marital(x: str) -> str:
    for stem in ("SOLTEIR", "CASAD", "DIVORCIAD", "VIUV"):
        x = rf"regexp_replace({x}, '\b{stem}[OA](\(A\)|\b)', '{stem}O', 'g')"
    return x


def development(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda t: t NOT IN ('', 'CONDOMINIO', 'CONDOMINIOCLUBE', 'CLUBE', 'RESIDENCIAL')), ' ')"


WIDE_NORMAL = f"""CASE WHEN coalesce(value, '') = '' THEN '' WHEN field_type IN ('cpf', 'rg', 'cnpj', 'telefone') THEN {digits('value')} WHEN field_type = 'valor_monetario' THEN {money('value')} WHEN field_type = 'area' THEN {area('value')}
  WHEN field_type = 'identificador_imovel' THEN {identifier('value')} WHEN field_type = 'data' THEN {date('value')} WHEN field_type = 'email' THEN {email('value')} WHEN field_type = 'endereco' THEN {address('value')}
  WHEN field_id = 'buyer.maritalStatus' THEN {marital(text('value'))} WHEN field_id = 'property.development' THEN {development(text('value'))} ELSE {text('value')} END"""
NORMAL = f"CASE WHEN coalesce(value, '') = '' THEN '' WHEN field_type = 'valor_monetario' THEN {money('value')} WHEN field_type = 'data' THEN {date('value')} ELSE {text('value')} END"
LABEL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in catalog.SOURCES.items()) + "}"


def listed(names: str) -> str:
    labels = f"list_transform({names}, lambda s: {LABEL}[s])"
    return f"CASE WHEN len({names}) < 2 THEN array_to_string({labels}, '') ELSE array_to_string(({labels})[1:len({names}) - 1], ', ') || ' e ' || ({labels})[len({names})] END"


_FIELDS = "('buyer.name','financial.totalValue','contract.date','property.type','financial.fgts')"
_EXPECTED = "CASE field_id WHEN 'contract.date' THEN ['SIOPI','MINUTA'] WHEN 'property.type' THEN ['SIOPI','MINUTA','ITBI'] WHEN 'financial.fgts' THEN ['SIOPI','MINUTA','DADOS_RESERVA'] ELSE ['SIOPI','MINUTA','ITBI','DADOS_RESERVA'] END"

VERDICTS = f"""
WITH nv AS (SELECT process_id, source_ord, source, field_id, field_type, confidence, trim(coalesce(value, '')) AS v, {NORMAL} AS norm FROM {EV} e WHERE field_id IN @fields),
r AS (SELECT process_id, field_id, any_value(field_type) AS field_type, list({{'source': source, 'v': v, 'norm': norm, 'c': confidence}} ORDER BY source_ord) AS rows FROM nv GROUP BY ALL),
f AS (SELECT *, list_filter(rows, lambda x: x.v <> '') AS filled, {_EXPECTED} AS expected, @conflict AS conflict, @issue AS issue, @unread AS unread FROM r),
g AS (SELECT *, list_transform(filled, lambda x: x.source) AS have, list_transform(list_filter(filled, lambda x: x.c < 70), lambda x: x.source) AS low, list_distinct(list_transform(filled, lambda x: x.norm)) AS norms,
        field_id = 'financial.fgts' AND len(list_filter(rows, lambda x: x.norm NOT IN ('', '0.00'))) = 0 AS zero,
        list_filter(expected, lambda s: NOT list_contains(list_transform(filled, lambda x: x.source), s) AND NOT (s = 'ITBI' AND unread)) AS missing FROM f
      WHERE field_id <> 'financial.fgts' OR list_contains(list_transform(filled, lambda x: x.source), 'DADOS_RESERVA')),
s AS (SELECT *, len(list_filter(filled, lambda p: len(list_filter(filled, lambda q: 1 - levenshtein(p.norm, q.norm) / greatest(length(p.norm), length(q.norm), 1) < 0.86)) > 0)) = 0 AS small FROM g),
v AS (SELECT *, CASE WHEN conflict AND field_id = 'financial.totalValue' AND list_contains(have, 'SIOPI') THEN 1 WHEN issue AND field_id = 'financial.totalValue' THEN 2 WHEN unread AND list_contains(expected, 'ITBI') THEN 3
  WHEN len(filled) < 2 AND zero THEN 40 WHEN len(filled) < 2 THEN 4 WHEN len(low) > 0 THEN 5 WHEN len(norms) = 1 THEN 6 WHEN zero THEN 7 WHEN field_type = 'texto' AND small THEN 8 ELSE 9 END AS rung0 FROM s),
gr AS (SELECT *, list_transform(list_filter(list_transform(filled, lambda x, i: {{'n': x.norm, 'i': i}}), lambda y: list_position(list_transform(filled, lambda z: z.norm), y.n) = y.i), lambda y: list_transform(list_filter(filled, lambda x: x.norm = y.n), lambda x: x.source)) AS groups FROM v),
w AS (SELECT *, CASE WHEN rung0 IN (6, 7, 40) THEN 'MATCH' WHEN rung0 = 3 THEN 'SOURCE_UNREADABLE' WHEN rung0 = 9 THEN 'DIVERGENCE' ELSE 'REVIEW_REQUIRED' END AS status, CAST(CASE rung0 WHEN 40 THEN 4 ELSE rung0 END AS INT) AS rung,
  CASE WHEN len(missing) > 0 THEN ' Campo não encontrado na fonte ' || {listed('missing')} || '.' ELSE '' END AS absent FROM gr),
o AS (SELECT *, CASE WHEN rung0 = 1 THEN 'Foram encontrados valores conflitantes para o campo entre arquivos da fonte Espelho SIOPI.' WHEN rung0 = 2 THEN 'Evidência insuficiente ou incompatível para o campo na fonte Minuta.'
  WHEN rung0 = 3 THEN 'Campo de o campo não pôde ser conferido completamente porque a fonte ITBI não foi interpretada.' WHEN rung0 IN (40, 7) THEN 'Valores equivalentes por regra segura: campo opcional sem valor foi tratado como R$ 0,00.'
  WHEN rung0 = 4 AND len(filled) > 0 THEN 'Campo de o campo encontrado apenas na fonte ' || {listed('have')} || '. É necessário outro arquivo com o mesmo dado para confirmar.' || absent
  WHEN rung0 = 4 THEN 'Campo de o campo não encontrado nas fontes esperadas para conferência.' || absent WHEN rung0 = 5 THEN 'Extração abaixo de 70% para o campo na fonte ' || {listed('low')} || '.'
  WHEN rung0 = 6 AND len(list_distinct(list_transform(filled, lambda x: x.v))) > 1 THEN 'Valores equivalentes após normalização.' WHEN rung0 = 6 THEN 'Todas as fontes conferem.'
  WHEN rung0 = 8 THEN 'Há pequena diferença textual entre ' || {listed('have')} || '; confirme os valores destacados.'
  WHEN len(list_filter(groups, lambda x: len(x) = 1)) > 0 AND len(list_filter(groups, lambda x: len(x) > 1)) > 0 THEN 'Valor divergente apenas na fonte ' || {LABEL}[list_filter(groups, lambda x: len(x) = 1)[1][1]] || '. ' || {listed('list_filter(groups, lambda x: len(x) > 1)[1]')} || ' apresentam valores equivalentes.'
  ELSE 'Valores divergentes entre as fontes: ' || array_to_string(list_transform(groups, lambda y: {listed('y')}), '; ') || '.' END AS observation FROM w)
"""
FULL = VERDICTS.replace("@fields", _FIELDS).replace("@conflict", "process_id % 23 = 0").replace("@issue", "process_id % 29 = 0").replace("@unread", "process_id % 19 = 0")
BASIC = VERDICTS.replace("@fields", "('financial.totalValue')").replace("@conflict", "false").replace("@issue", "false").replace("@unread", "false")
WIDE_FIELDS = ["buyer.name", "buyer.cpf", "buyer.rg", "buyer.maritalStatus", "buyer.address", "buyer.email", "buyer.phone", "buyer.birthDate", "contract.number", "contract.date", "property.development", "property.registration", "property.unit", "property.privateArea", "property.iptu", "seller.legalName", "seller.cnpj", "seller.address", "financial.totalValue", "financial.fgts", "property.registryOffice"]
_CHECKLIST = "(VALUES " + ", ".join(f"('{f}', '{k}', {str(m).lower()}, {s})" for f, _, k, m, s in catalog.fields() if f in WIDE_FIELDS) + ") AS f(field_id, field_type, multiple, expected)"
WIDE = f"""
WITH nv AS MATERIALIZED (SELECT process_id, source_ord, source, field_id, participant_id, confidence, trim(coalesce(value, '')) AS v, {WIDE_NORMAL} AS norm FROM {a.duck(a.WIDE_EVIDENCE)} e),
ctx AS (SELECT process_id, list(source ORDER BY source_ord) AS participating, coalesce(list(source ORDER BY source_ord) FILTER (WHERE failed), []) AS unreadable, coalesce(list({{'s': source, 'e': error}} ORDER BY source_ord) FILTER (WHERE failed AND error IS NOT NULL), []) AS told FROM {a.duck(a.PARTICIPATION)} p GROUP BY process_id),
mk AS (SELECT process_id, coalesce(list(source || ':' || field_id) FILTER (WHERE kind = 'conflict'), []) AS conflicts, coalesce(list(source || ':' || field_id) FILTER (WHERE kind = 'issue'), []) AS issues FROM {a.duck(a.MARKS)} m GROUP BY process_id),
pp AS (SELECT process_id, participant_id, min(source_ord) FILTER (WHERE field_id IN ('buyer.name', 'buyer.cpf')) AS ia, min(source_ord) AS oa, arg_min(v, source_ord) FILTER (WHERE field_id = 'buyer.name' AND v <> '') AS nm FROM nv WHERE participant_id IS NOT NULL GROUP BY ALL),
pq AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY coalesce(ia, oa), participant_id) AS nr FROM (SELECT *, bool_or(ia IS NOT NULL) OVER (PARTITION BY process_id) AS named FROM pp) WHERE ia IS NOT NULL OR NOT named),
sk AS (SELECT ctx.*, coalesce(mk.conflicts, []) AS conflicts, coalesce(mk.issues, []) AS issues, f.*, pq.participant_id, CASE WHEN pq.participant_id IS NOT NULL THEN coalesce(pq.nm, 'Comprador ' || pq.nr) END AS who FROM ctx LEFT JOIN mk USING (process_id) CROSS JOIN {_CHECKLIST} LEFT JOIN pq ON pq.process_id = ctx.process_id AND f.multiple),
al AS (SELECT process_id, field_id, coalesce(participant_id, '-') AS pid, list({{'source': source, 'v': v, 'norm': norm, 'c': confidence}} ORDER BY source_ord) AS allrows FROM nv GROUP BY ALL),
jn AS (SELECT sk.*, sk.field_id || coalesce('::' || sk.participant_id, '') AS key, coalesce(al.allrows, []) AS allrows, list_filter(coalesce(al.allrows, []), lambda x: list_contains(participating, x.source)) AS rows FROM sk LEFT JOIN al ON al.process_id = sk.process_id AND al.field_id = sk.field_id AND al.pid = coalesce(sk.participant_id, '-')),
fl AS (SELECT *, list_filter(rows, lambda x: x.v <> '') AS filled, list_filter(participating, lambda s: list_contains(expected, s)) AS asked, list_filter(unreadable, lambda s: list_contains(expected, s)) AS unread FROM jn
  WHERE CASE WHEN field_id = 'financial.fgts' AND list_contains(participating, 'DADOS_RESERVA') THEN len(list_filter(allrows, lambda x: x.source = 'DADOS_RESERVA' AND x.v <> '')) > 0 ELSE list_has_any(participating, expected) OR len(allrows) > 0 END),
h AS (SELECT *, list_transform(filled, lambda x: x.source) AS have, list_transform(list_filter(filled, lambda x: x.c < 70), lambda x: x.source) AS low, list_distinct(list_transform(filled, lambda x: x.norm)) AS norms,
  field_id = 'financial.fgts' AND len(list_filter(rows, lambda x: (len(asked) = 0 OR list_contains(asked, x.source)) AND x.norm NOT IN ('', '0.00'))) = 0 AS zero FROM fl),
i AS (SELECT *, list_filter(have, lambda s: list_contains(conflicts, s || ':' || key)) AS conflicting, list_filter(participating, lambda s: list_contains(issues, s || ':' || key)) AS issued, list_filter(asked, lambda s: NOT list_contains(have, s) AND NOT list_contains(unreadable, s)) AS missing,
  len(list_filter(norms, lambda p: len(list_filter(norms, lambda q: 1 - levenshtein(replace(p, 'º', 'o'), replace(q, 'º', 'o')) / greatest(length(p), length(q), 1) < 0.86)) > 0)) = 0 AS small FROM h),
v AS (SELECT *, CASE WHEN len(conflicting) > 0 THEN 1 WHEN len(issued) > 0 THEN 2 WHEN len(unread) > 0 THEN 3 WHEN len(filled) < 2 AND zero THEN 40 WHEN len(filled) < 2 THEN 4 WHEN len(low) > 0 THEN 5 WHEN len(norms) = 1 THEN 6 WHEN field_type IN ('texto', 'endereco') AND small THEN 8 ELSE 9 END AS rung0,
  CASE WHEN len(missing) > 0 THEN ' Campo não encontrado na fonte ' || {listed('missing')} || '.' ELSE '' END AS absent, CASE WHEN who IS NULL THEN 'o campo' ELSE 'o comprador ' || who END AS whose, list_filter(told, lambda t: list_contains(expected, t.s)) AS reasons FROM i),
gr AS (SELECT *, list_transform(list_filter(list_transform(filled, lambda x, i: {{'n': x.norm, 'i': i}}), lambda y: list_position(list_transform(filled, lambda z: z.norm), y.n) = y.i), lambda y: list_transform(list_filter(filled, lambda x: x.norm = y.n), lambda x: x.source)) AS groups FROM v),
o AS (SELECT process_id, field_id, participant_id, who, rows, CASE WHEN rung0 IN (6, 40) THEN 'MATCH' WHEN rung0 = 3 THEN 'SOURCE_UNREADABLE' WHEN rung0 = 9 THEN 'DIVERGENCE' ELSE 'REVIEW_REQUIRED' END AS status, CAST(CASE rung0 WHEN 40 THEN 4 ELSE rung0 END AS INT) AS rung,
  CASE WHEN rung0 = 1 THEN 'Foram encontrados valores conflitantes para ' || whose || ' entre arquivos da fonte ' || {listed('conflicting')} || '.' WHEN rung0 = 2 THEN 'Evidência insuficiente ou incompatível para ' || whose || ' na fonte ' || {listed('issued')} || '.'
  WHEN rung0 = 3 THEN 'Campo de ' || whose || ' não pôde ser conferido completamente porque a fonte ' || {listed('unread')} || ' não foi interpretada.' || CASE WHEN len(reasons) > 0 THEN ' Motivo:' || array_to_string(list_transform(reasons, lambda t: ' ' || {LABEL}[t.s] || ': ' || t.e), '') ELSE '' END
  WHEN rung0 = 40 THEN 'Valores equivalentes por regra segura: campo opcional sem valor foi tratado como R$ 0,00.'
  WHEN rung0 = 4 AND len(filled) > 0 THEN 'Campo de ' || whose || ' encontrado apenas na fonte ' || {listed('have')} || '. É necessário outro arquivo com o mesmo dado para confirmar.' || absent WHEN rung0 = 4 THEN 'Campo de ' || whose || ' não encontrado nas fontes esperadas para conferência.' || absent
  WHEN rung0 = 5 THEN 'Extração abaixo de 70% para ' || whose || ' na fonte ' || {listed('low')} || '.' WHEN rung0 = 6 AND len(list_distinct(list_transform(filled, lambda x: x.v))) > 1 THEN 'Valores equivalentes após normalização.' WHEN rung0 = 6 THEN 'Todas as fontes conferem.'
  WHEN rung0 = 8 THEN 'Há pequena diferença textual entre ' || {listed('have')} || '; confirme os valores destacados.'
  WHEN len(list_filter(groups, lambda x: len(x) = 1)) > 0 AND len(list_filter(groups, lambda x: len(x) > 1)) > 0 THEN 'Valor divergente apenas na fonte ' || {LABEL}[list_filter(groups, lambda x: len(x) = 1)[1][1]] || '. ' || {listed('list_filter(groups, lambda x: len(x) > 1)[1]')} || ' apresentam valores equivalentes.'
  ELSE 'Valores divergentes entre as fontes: ' || array_to_string(list_transform(groups, lambda y: {listed('y')}), '; ') || '.' END AS observation FROM gr)
"""
REVIEWS = f"(SELECT process_id, field_id, action AS status FROM {a.duck(a.REVIEW_LOG)} l QUALIFY row_number() OVER (PARTITION BY process_id, field_id ORDER BY seq DESC, action DESC) = 1 AND action <> 'REVOKED')"
_REVIEWED = f"(SELECT o.*, coalesce(r.status = 'APPROVED', false) AS approved, r.status IS NOT NULL AS has_review FROM o LEFT JOIN {REVIEWS} r ON r.process_id = o.process_id AND r.field_id = o.field_id)"
_COUNTS = "count(*) AS total, count(*) FILTER (WHERE status = 'MATCH') AS matches, count(*) FILTER (WHERE status = 'DIVERGENCE') AS divergences, count(*) FILTER (WHERE status = 'REVIEW_REQUIRED') AS review, count(*) FILTER (WHERE status = 'SOURCE_UNREADABLE') AS unreadable"
_SIDE = f"(SELECT process_id, field_id, field_type, source, confidence, {NORMAL} AS norm FROM {EV} e)"
PROC = f"(SELECT p.*, coalesce(d.n, 0) AS n_documents FROM {a.duck(a.PROCESSES)} p LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) d ON d.k = p.process_id)"
_KEY = f"CASE WHEN trim(coalesce(typology, '')) <> '' THEN {same('typology')} ELSE {same('tower')} || '::' || {same('unit')} END"


def _units(mapping: str, order: str = "-confidence, tower, unit, private_area") -> str:
    return f"(SELECT * FROM (SELECT *, {_KEY} AS unit_key FROM {a.duck(mapping)} u) QUALIFY row_number() OVER (PARTITION BY unit_key ORDER BY {order}) = 1)"


_CRITICAL = "(VALUES " + ", ".join(f"('{s}', '{f}')" for s, names in catalog.CRITICAL.items() for f in names.split()) + ") AS c(source, field_id)"
KEYWORDS = ["the", "und", "price", "de la"]
_KW = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(t), '[\^`·¨¯´¸]', '', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SCORE = " + ".join(f"CASE WHEN contains(k, '{w}') THEN {3 if ' ' in w else 1} ELSE 0 END" for w in KEYWORDS)

ORACLE = {
    "norm_dispatch": f"SELECT process_id, source, field_id, {NORMAL} AS norm FROM {EV} e",
    "norm_text": f"SELECT doc_id, sha256({text('text')}) AS norm FROM documents",
    "norm_digits": f"SELECT doc_id, sha256({digits('text')}) AS norm FROM documents",
    "norm_area": f"SELECT unit, {area('s')} AS norm FROM (SELECT unit, private_area || ' m²' AS s FROM {a.duck(a.UNITS_OCR)} u)",
    "norm_identifier": f"SELECT p_partkey, {identifier('s')} AS norm FROM (SELECT p_partkey, 'Torre 0' || p_partkey || ' Bloco ' || p_brand AS s FROM part)",
    "norm_address": f"SELECT c_custkey, {address('s')} AS norm FROM (SELECT c_custkey, 'Avenida ' || c_name || ', Nº ' || c_custkey || ', Apto 3, Rua R. É N.' AS s FROM customer)",
    "norm_email": "SELECT c_custkey, lower(trim(s)) AS norm FROM (SELECT c_custkey, ' ' || upper(replace(c_name, '#', '.')) || '@EXAMPLE.com ' AS s FROM customer)",
    "reconcile_basic": BASIC + "SELECT process_id, field_id, status, rung FROM o",
    "reconcile_full": FULL + "SELECT process_id, field_id, status, rung, observation FROM o",
    "reconcile_summary": FULL + f"SELECT field_id, {_COUNTS} FROM o GROUP BY field_id",
    "missing_by_source": FULL + f"SELECT s.source, count(*) FILTER (WHERE contains(observation, 'não encontrado na fonte ' || {LABEL}[s.source])) AS missing, count(*) FILTER (WHERE status = 'SOURCE_UNREADABLE' AND list_contains(list_transform(rows, lambda x: x.source), s.source)) AS unreadable FROM o, (VALUES ('SIOPI'), ('MINUTA'), ('ITBI'), ('DADOS_RESERVA')) AS s(source) GROUP BY s.source",
    "report_filter": FULL + f"SELECT process_id, field_id, observation FROM {_REVIEWED} WHERE status = 'DIVERGENCE' AND NOT approved AND contains(lower(observation), 'minuta')",
    "final_status_refresh": FULL + f"SELECT process_id, CASE WHEN count(*) FILTER (WHERE status <> 'MATCH' AND NOT approved) > 0 THEN 'PENDING_REVIEW' ELSE 'FULLY_CHECKED' END AS final_status FROM {_REVIEWED} GROUP BY process_id",
    "diff_tokens": FULL + """, e AS (SELECT process_id, field_id, filled, unnest(filled) AS x FROM o WHERE rung0 IN (8, 9))
SELECT process_id, field_id, x.source AS source, array_to_string(list_filter(string_split(x.norm, ' '), lambda t: t <> '' AND len(list_filter(filled, lambda y: list_contains(string_split(y.norm, ' '), t))) < len(filled)), ' ') AS tokens FROM e""",
    "similarity_pairs": f"SELECT l.process_id, l.source AS left_source, r.source AS right_source, levenshtein(l.norm, r.norm) AS distance FROM {_SIDE} l JOIN {_SIDE} r ON l.process_id = r.process_id AND l.field_id = r.field_id AND l.source < r.source WHERE l.field_id = 'buyer.name' AND l.norm <> '' AND r.norm <> ''",
    "legacy_validation": f"""SELECT process_id, field_id, CASE WHEN a = '' AND b = '' AND field_id = 'financial.fgts' THEN 'NOT_APPLICABLE' WHEN a = '' OR b = '' THEN 'NOT_FOUND' WHEN least(ca, cb) < 70 THEN 'REVIEW_REQUIRED' WHEN a = b THEN 'MATCH' ELSE 'DIVERGENCE' END AS status
FROM (SELECT process_id, field_id, coalesce(max(norm) FILTER (WHERE source = 'SIOPI'), '') AS a, coalesce(max(norm) FILTER (WHERE source = 'MINUTA'), '') AS b, max(confidence) FILTER (WHERE source = 'SIOPI') AS ca, max(confidence) FILTER (WHERE source = 'MINUTA') AS cb FROM {_SIDE} x WHERE source IN ('SIOPI', 'MINUTA') GROUP BY ALL)""",
    "divergence_money": f"SELECT process_id, CAST(abs(y - x) AS DECIMAL(20,2)) AS gap, CAST(round(CAST(abs(y - x) * 100 AS DECIMAL(38,10)) / abs(x), 2) AS DECIMAL(20,2)) AS percent, CASE WHEN y > x THEN 'maior no documento' ELSE 'menor no documento' END AS direction FROM (SELECT l.process_id, CAST(l.norm AS DECIMAL(20,2)) AS x, CAST(r.norm AS DECIMAL(20,2)) AS y FROM {_SIDE} l JOIN {_SIDE} r USING (process_id, field_id) WHERE field_id = 'financial.totalValue' AND l.source = 'SIOPI' AND r.source = 'MINUTA' AND l.norm <> '' AND r.norm <> '' AND l.norm <> r.norm)",
    "divergence_date": f"""SELECT process_id, CASE WHEN d >= 365 AND d % 365 = 0 THEN d // 365 || CASE WHEN d = 365 THEN ' ano' ELSE ' anos' END WHEN d >= 30 AND d % 30 = 0 THEN d // 30 || CASE WHEN d = 30 THEN ' mês' ELSE ' meses' END ELSE d || CASE WHEN d = 1 THEN ' dia' ELSE ' dias' END END AS distance
FROM (SELECT l.process_id, abs(date_diff('day', TRY_CAST(l.norm AS DATE), TRY_CAST(r.norm AS DATE))) AS d FROM {_SIDE} l JOIN {_SIDE} r USING (process_id, field_id) WHERE field_id = 'contract.date' AND l.source = 'SIOPI' AND r.source = 'MINUTA' AND l.norm <> '' AND r.norm <> '' AND l.norm <> r.norm)""",
    "consolidate_best": f"SELECT process_id, field_id, value, confidence FROM {EV} e WHERE trim(coalesce(value, '')) <> '' QUALIFY row_number() OVER (PARTITION BY process_id, field_id ORDER BY confidence DESC, source_ord) = 1",
    "source_conflicts": f"SELECT process_id, field_id, count(DISTINCT norm) AS n_values FROM {_SIDE} x WHERE norm <> '' GROUP BY ALL HAVING count(DISTINCT norm) > 1",
    "quality_coverage": f"""WITH c AS (SELECT source, list(field_id) AS expected FROM {_CRITICAL} GROUP BY source),
p AS (SELECT o_orderkey AS process_id, v.source, v.source = 'ITBI' AND o_orderkey % 19 = 0 AS failed, v.source = 'SIOPI' AND o_orderkey % 23 = 0 AS amb, v.source = 'MINUTA' AND o_orderkey % 29 = 0 AS iss FROM orders, (VALUES ('SIOPI'), ('MINUTA'), ('ITBI'), ('DADOS_RESERVA'), ('CERTIDAO')) AS v(source)),
h AS (SELECT process_id, source, list(DISTINCT field_id) AS got, list(DISTINCT field_id) FILTER (WHERE confidence < 75) AS low FROM {EV} e WHERE trim(coalesce(value, '')) <> '' GROUP BY ALL),
j AS (SELECT p.*, coalesce(c.expected, []) AS expected, list_filter(coalesce(c.expected, []), lambda f: list_contains(coalesce(h.got, []), f)) AS got, list_filter(coalesce(c.expected, []), lambda f: list_contains(coalesce(h.low, []), f)) AS low FROM p LEFT JOIN c USING (source) LEFT JOIN h USING (process_id, source))
SELECT process_id, source, CASE WHEN failed THEN 'FAILED' WHEN len(expected) = 0 THEN 'NOT_ASSESSED' WHEN len(got) < len(expected) OR len(low) > 0 OR amb OR iss THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, CAST(CASE WHEN len(expected) > 0 THEN floor(len(got) * 100.0 / len(expected) + 0.5) WHEN failed THEN 0 ELSE 100 END AS INT) AS coverage,
len(expected) - len(got) AS n_missing, len(low) AS n_low, CAST(amb AS BIGINT) AS n_ambiguous, CAST(iss AS BIGINT) AS n_issues, len(got) AS n_extracted FROM j""",
    "downpayment_derivation": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 AND t - f - s >= 0 THEN CAST(t - f - s AS DECIMAL(20,2)) END AS own_resources FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS t, CAST(100 * (o_orderkey % 2000) AS DECIMAL(20,2)) AS f, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(o_orderkey % 500 AS DECIMAL(20,2)) END AS s FROM orders)",
    "participant_alignment": f"""WITH r AS (SELECT o_orderkey AS process_id, n AS source, c_name AS name, CASE WHEN n = 1 AND o_orderkey % 3 = 0 THEN '' ELSE lpad(CAST(c_custkey AS VARCHAR), 11, '0') END AS cpf FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES (0), (1)) AS v(n)),
k AS (SELECT process_id, {text('name')} AS nm, arg_min(cpf, source) FILTER (WHERE cpf <> '') AS known FROM r GROUP BY ALL)
SELECT r.process_id, r.source, 'participant_' || substring(sha256(CASE WHEN r.cpf <> '' OR known IS NOT NULL THEN 'cpf:' || CASE WHEN r.cpf <> '' THEN r.cpf ELSE known END ELSE 'name:' || nm END), 1, 16) AS participant_key FROM r JOIN k ON r.process_id = k.process_id AND {text('r.name')} = nm""",
    "evidence_check": f"SELECT process_id, source, CASE WHEN norm = '' THEN false ELSE process_id % 5 <> 0 END AS held FROM {_SIDE} x WHERE field_id = 'financial.totalValue'",
    "unit_reconcile": f"""SELECT coalesce(o.unit_key, v.unit_key) AS unit_key, outcome, CAST(CASE outcome WHEN 'AGREED' THEN least(99, greatest(o.confidence, v.confidence) + 5) ELSE least(coalesce(o.confidence, 99), coalesce(v.confidence, 99), 69) END AS INT) AS confidence, CASE WHEN outcome = 'ONLY_VISION' THEN v.private_area ELSE o.private_area END AS private_area
FROM (SELECT o, v, CASE WHEN v.unit_key IS NULL THEN 'ONLY_OCR' WHEN o.unit_key IS NULL THEN 'ONLY_VISION' WHEN {" AND ".join(f"{same('o.' + c)} = {same('v.' + c)}" for c in ("private_area", "common_area", "total_area", "ideal_fraction", "iptu", "typology"))} THEN 'AGREED' ELSE 'DIVERGED' END AS outcome FROM {_units(a.UNITS_OCR, 'seq DESC')} o FULL JOIN {_units(a.UNITS_VISION)} v ON o.unit_key = v.unit_key)""",
    "unit_dedup": f"SELECT unit_key, tower, unit, confidence FROM {_units(a.UNITS_VISION)} u",
    "unit_qc": "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 9 = 0 THEN 'NO_EVIDENCE' END, CASE WHEN t < x THEN 'TOTAL_BELOW_PRIVATE' END, CASE WHEN p_partkey % 6 = 0 THEN 'FRACTION_RANGE' END], lambda s: s IS NOT NULL), ',') AS issues, CASE WHEN p_partkey % 5 = 0 THEN 'INCOMPLETE' ELSE '' END AS warnings FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(20,2)) AS x, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(20,2)) + CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1 END END AS t FROM part)",
    "unit_review": f"SELECT tower AS brand, CAST(1 AS BIGINT) AS n_towers, count(*) AS n_units, count(DISTINCT typology || '::' || private_area || '::' || coalesce(common_area, '-') || '::' || total_area || '::' || coalesce(ideal_fraction, '-')) AS n_types, count(*) FILTER (WHERE typology IS NULL) AS n_incomplete, count(*) FILTER (WHERE confidence < 80) AS n_low, count(*) FILTER (WHERE typology IS NULL) = 0 AS can_save FROM {a.duck(a.UNITS_OCR)} u GROUP BY tower",
    "unit_unpivot": " UNION ALL ".join(f"SELECT unit, 'CADASTRO_EMPREENDIMENTO' AS source, '{f}' AS field_id, CAST({c} AS VARCHAR) AS value, confidence FROM {a.duck(a.UNITS)} u LEFT JOIN {a.duck(a.DEVELOPMENTS)} d USING (development_id) WHERE {w}" for f, c, w in [("property.development", "name", "true"), ("property.registration", "coalesce(registration, development_registration)", "true"), ("property.privateArea", "private_area", "true"), ("property.commonArea", "common_area", "true"), ("property.totalArea", "total_area", "true"), ("property.idealFraction", "ideal_fraction", "true"), ("property.iptu", "iptu", "true"), ("seller.legalName", "seller_name", "trim(seller_name) <> ''"), ("seller.cnpj", "seller_cnpj", "trim(seller_cnpj) <> ''"), ("property.unit", "unit", "trim(unit) <> ''"), ("property.tower", "tower", "trim(tower) <> ''"), ("property.type", "typology", "trim(typology) <> ''")]),
    "unit_signature": f"SELECT unit, seq, coalesce(typology, 'Tipo não informado') || '::' || private_area || '::' || coalesce(common_area, '-') || '::' || total_area || '::' || coalesce(ideal_fraction, '-') AS signature FROM {a.duck(a.UNITS_OCR)} u",
    "unit_natural_sort": "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS position FROM part",
    "checklist_union": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {o}, '{k}', {str(m).lower()}, {len(s)})" for f, o, k, m, s in catalog.fields()) + ") AS t(field_id, ord, field_type, allow_multiple, n_sources)",
    "page_prune": "SELECT conv_id, turn FROM conversations QUALIFY turn <= 1 OR turn > max(turn) OVER (PARTITION BY conv_id) - 1",
    "page_asof_marker": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS page FROM conversations",
    "text_gate": r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\s\x0b]', '', 'g')) >= 250 AS sufficient FROM documents",
    "focus_windows": f"SELECT doc_id, index, score FROM (SELECT doc_id, index, CAST({_SCORE} AS INT) AS score FROM (SELECT doc_id, index, {_KW} AS k FROM (SELECT doc_id, CAST(i // 450 AS INT) AS index, substring(coalesce(text, ''), CAST(i + 1 AS BIGINT), 900) AS t FROM documents, unnest(range(0, greatest(length(coalesce(text, '')) - 1, 0) + 1, 450)) AS u(i)))) WHERE score > 0",
    "regex_catalog_extract": r"SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)', 1)), ''), nullif(trim(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1)), ''), nullif(trim(regexp_extract(text, '([$€] ?[0-9][0-9.,]*)', 1)), '')) AS found FROM documents",
    "json_salvage": f"SELECT process_id, source, field_id, coalesce(value, '') AS value, CAST(confidence AS DOUBLE) AS confidence FROM {EV} e WHERE field_id = 'contract.date'",
    "rls_visible_processes": f"SELECT process_id, user_id FROM {a.duck(a.PROCESSES)} p WHERE organization_id = 2",
    "rls_visible_documents": f"SELECT l_orderkey AS process_id, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM {a.duck(a.PROCESSES)} p WHERE p.process_id = l_orderkey AND organization_id = 1 AND user_id % 10 = 7) GROUP BY 1",
    "ops_dashboard": f"""SELECT organization_id, count(*) FILTER (WHERE final_status = 'IN_PROGRESS') AS active, coalesce(CAST(sum(n_documents) FILTER (WHERE fin) AS BIGINT), 0) AS documents, count(*) FILTER (WHERE final_status = 'PENDING_REVIEW') AS pending,
CAST(CASE WHEN count(*) FILTER (WHERE fin) > 0 THEN floor(count(*) FILTER (WHERE final_status = 'FULLY_CHECKED') * 100.0 / count(*) FILTER (WHERE fin) + 0.5) ELSE 0 END AS INT) AS approval, CAST(coalesce(sum(minutes) FILTER (WHERE fin) * 60 // nullif(count(*) FILTER (WHERE fin), 0), 0) AS BIGINT) AS average_seconds
FROM (SELECT *, final_status NOT IN ('IN_PROGRESS', 'FAILED') AS fin FROM {PROC} p) GROUP BY organization_id""",
    "process_anomalies": f"SELECT process_id, CASE WHEN n_documents = 0 THEN 'NO_DOCUMENTS' WHEN final_status = 'FAILED' THEN 'FAILED' WHEN final_status = 'IN_PROGRESS' AND minutes >= 30 THEN 'STUCK' WHEN process_id % 35 = 0 THEN 'EXTRACTION_CRITICAL' WHEN process_id % 5 = 0 THEN 'EXTRACTION_WARNING' WHEN final_status = 'IN_PROGRESS' AND minutes >= 10 THEN 'SLOW_RUNNING' ELSE 'SLOW_DONE' END AS finding FROM {PROC} p WHERE n_documents = 0 OR final_status = 'FAILED' OR minutes >= 10 OR process_id % 5 = 0",
    "security_alerts": f"SELECT event_type, actor, count(*) AS n FROM (SELECT *, CASE WHEN event_type = 'DOCUMENT_RETENTION_FAILED' THEN 'retention' ELSE coalesce(CAST(actor_id AS VARCHAR), entity_id, 'unknown') END AS actor FROM {a.duck(a.AUDIT)} e WHERE created_at BETWEEN TIMESTAMP '{a.NOW}' - INTERVAL 1440 MINUTE AND TIMESTAMP '{a.NOW}') WHERE event_type IN ('LOGIN_FAILED', 'DOCUMENT_VIEWED', 'PROCESS_CREATED', 'DOCUMENT_RETENTION_FAILED') GROUP BY ALL HAVING count(*) >= CASE event_type WHEN 'LOGIN_FAILED' THEN 2 WHEN 'DOCUMENT_RETENTION_FAILED' THEN 1 ELSE 3 END",
    "retention_batch": f"SELECT document_id, created_at FROM {a.duck(a.DOCUMENTS)} d WHERE storage_path IS NOT NULL AND purged_at IS NULL AND created_at <= TIMESTAMP '{a.NOW}' - INTERVAL 40 DAY ORDER BY created_at, document_id LIMIT 100",
    "process_merge_latest": f"SELECT actor_id, event_id, event_type FROM {a.duck(a.AUDIT)} e QUALIFY row_number() OVER (PARTITION BY actor_id ORDER BY created_at DESC, event_id DESC) = 1",
    "results_merge": f"SELECT process_id, status FROM (SELECT o_orderkey AS process_id, CASE WHEN o_orderkey % 4 = 0 THEN 'RERUN' ELSE o_orderstatus END AS status FROM orders)",
    "stream_login_failures": f"SELECT actor_id, time_bucket(INTERVAL 1 DAY, created_at) AS start, count(*) AS n FROM {a.duck(a.AUDIT)} e WHERE event_type = 'LOGIN_FAILED' GROUP BY ALL HAVING count(*) >= 3",
    "learned_rule_counts": f"SELECT field_id, signature, count(*) AS n FROM (SELECT process_id, field_id, coalesce(array_to_string(list_sort(list_distinct(list(norm) FILTER (WHERE norm <> ''))), ' || '), '') AS signature FROM {_SIDE} x WHERE field_id = 'property.type' GROUP BY ALL) GROUP BY ALL",
    "norm_money": f"SELECT process_id, source, field_id, {money('value')} AS norm FROM {EV} e WHERE field_type = 'valor_monetario'",
    "norm_date": f"SELECT process_id, source, CASE WHEN coalesce(value, '') = '' THEN '' ELSE {date('value')} END AS norm FROM {EV} e WHERE field_type = 'data'",
    "norm_decimal": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '' END || replace(CAST(p AS VARCHAR), '.', ',') AS shown, CAST(CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '' END || CAST(p AS VARCHAR) AS DECIMAL(20,2)) AS number FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(20,2)) AS p FROM part)",
    "process_codes": "SELECT o_orderkey, 'OP-' || substring(upper(to_hex(o_orderkey + 1000000000000)), 1, 8) AS code FROM orders",
    "source_diagnostic": FULL + "SELECT process_id, field_id, observation FROM o WHERE rung0 = 9",
    "optional_zero_equivalence": FULL + "SELECT process_id, field_id, status FROM o WHERE rung0 IN (7, 40)",
    "divergence_email": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'DOMAIN' WHEN c_custkey % 2 = 0 THEN 'USER' END AS part FROM customer",
    "divergence_digits": """SELECT c_custkey, CAST(list_position(list_transform(range(1, 12), lambda i: substring(lpad(CAST(c_custkey AS VARCHAR), 11, '0'), i, 1) <> substring(lpad(CAST(c_custkey + 7 AS VARCHAR), 11, '0'), i, 1)), true) AS INT) AS position,
CASE WHEN c_custkey % 5 = 0 THEN 'DDD' WHEN c_custkey % 2 = 1 THEN '13' END AS phone FROM customer""",
    "result_filter": FULL + f"SELECT process_id, field_id, status FROM {_REVIEWED} WHERE status = 'REVIEW_REQUIRED' AND NOT approved AND contains(lower(observation || ' ' || array_to_string(list_transform(rows, lambda x: x.v), ' ')), 'minuta')",
    "reservation_score_best": f"""SELECT process_id, field_id, value, score FROM (SELECT process_id, field_id, value, source_ord, CAST(confidence + CASE m WHEN 2 THEN 0 ELSE 15 END + CASE WHEN m = 0 AND {digits('value')} <> '' THEN 20 ELSE 0 END + CASE WHEN field_id NOT LIKE 'financial.%' THEN 0 WHEN m = 0 AND field_id = 'financial.totalValue' THEN 40 ELSE -40 END AS INT) AS score
FROM (SELECT *, (process_id + source_ord) % 3 AS m FROM {EV} e WHERE field_id IN ('financial.totalValue', 'financial.fgts', 'contract.date') AND trim(coalesce(value, '')) <> '')) QUALIFY row_number() OVER (PARTITION BY process_id, field_id ORDER BY score DESC, source_ord) = 1""",
    "participant_expand": "SELECT o_orderkey AS process_id, 'SIOPI' AS source, p.participant_id, o_orderkey || p.c AS cpf, p.name, f.field_id FROM orders, (VALUES ('buyer_1', '-0', 'Nome 2'), ('buyer_2', '-1', 'Nome 1')) AS p(participant_id, c, name), (VALUES " + ", ".join(f"('{f}')" for f, _, _, m, _ in catalog.fields() if m) + ") AS f(field_id)",
    "unit_picker": f"SELECT tower, unit, typology FROM {a.duck(a.UNITS_OCR)} u WHERE contains({text("concat_ws(' ', tower, unit, typology, private_area, iptu)")}, 'TIPO 1')",
    "unit_accepted": f"SELECT unit, private_area FROM {a.duck(a.UNITS_OCR)} u WHERE confidence % 3 <> 0",
    "form_fields": "SELECT conv_id, sha256('[CAMPOS DE FORMULARIO]' || chr(10) || string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn, role || ': ' || trim(text))) AS form FROM conversations WHERE turn % 3 <> 2 AND trim(text) NOT IN ('', 'Off') GROUP BY conv_id",
    "label_next_line": "SELECT c_custkey, trim(c_name) AS value FROM customer",
    "tabular_rows": """SELECT p_partkey, p_brand AS tower, CASE n WHEN 0 THEN CAST(p_partkey AS VARCHAR) ELSE '7B' END AS unit, CASE n WHEN 0 THEN 'Tipo A' ELSE 'Loja' END AS typology, s AS private_area, CASE n WHEN 0 THEN '9.' ELSE '' END || s AS total_area, CASE n WHEN 0 THEN '0,0123' ELSE '0,5' END AS ideal_fraction
FROM (SELECT *, replace(CAST(CAST(p_retailprice AS DECIMAL(20,2)) AS VARCHAR), '.', ',') AS s FROM part), (VALUES (0), (1)) AS v(n)""",
    "history_search": f"SELECT DISTINCT process_id FROM (SELECT process_id, coalesce(value, '') AS t FROM {EV} e) WHERE contains({_KW}, 'outro customer')",
    "upload_dedup": f"SELECT DISTINCT source || '-' || part AS name, process_id % 5 AS size FROM {a.duck(a.DOCUMENTS)} d WHERE process_id % 5 <> 0",
    "process_list": f"SELECT process_id, user_id, final_status FROM {a.duck(a.PROCESSES)} p WHERE final_status = 'FULLY_CHECKED' ORDER BY started_at DESC, process_id LIMIT 100",
    "admin_metrics": f"""SELECT count(*) FILTER (WHERE run) AS in_progress, count(*) FILTER (WHERE final_status = 'PENDING_REVIEW') AS pending, count(*) FILTER (WHERE final_status = 'FULLY_CHECKED') AS checked, count(*) FILTER (WHERE final_status = 'FAILED') AS failed,
CAST(coalesce(sum(n_documents) FILTER (WHERE run), 0) AS BIGINT) AS documents_in_progress, CAST(coalesce(sum(n_documents) FILTER (WHERE final_status <> 'IN_PROGRESS'), 0) AS BIGINT) AS documents_analysed, CAST(coalesce(sum(n_documents), 0) AS BIGINT) AS documents_total FROM (SELECT *, final_status = 'IN_PROGRESS' AND minutes < 30 AS run FROM {PROC} p)""",
    "login_rate_limit": f"SELECT actor_id, count(*) AS n, count(*) >= 8 AS limited FROM {a.duck(a.AUDIT)} e WHERE event_type = 'LOGIN_FAILED' AND created_at BETWEEN TIMESTAMP '{a.NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{a.NOW}' GROUP BY actor_id",
    "stale_processes": f"SELECT process_id FROM {a.duck(a.PROCESSES)} p WHERE final_status = 'IN_PROGRESS' AND CAST(started_at AS TIMESTAMP) + to_minutes(minutes) <= TIMESTAMP '1996-01-01 00:19:15'",
    "review_progress": FULL + f"SELECT process_id, count(*) AS total, count(*) FILTER (WHERE status <> 'MATCH' AND approved) AS reviewed, count(*) FILTER (WHERE status <> 'MATCH' AND NOT approved) AS unresolved, CAST(floor(count(*) FILTER (WHERE status = 'MATCH' OR approved) * 100.0 / count(*) + 0.5) AS INT) AS checked_percent FROM {_REVIEWED} GROUP BY process_id",
    "stream_rule_counter": "SELECT 'property.type' AS field_id, o_orderstatus AS signature, count(*) AS n FROM orders GROUP BY 2",
}
_QUALITY = ORACLE["quality_coverage"]
ORACLE["quality_totals"] = f"SELECT count(*) AS n_reports, CAST(sum(n_missing) AS BIGINT) AS n_missing, CAST(sum(n_low) AS BIGINT) AS n_low, CAST(sum(n_ambiguous) AS BIGINT) AS n_ambiguous FROM ({_QUALITY})"
ORACLE["extraction_alerts"] = f"""SELECT process_id, CASE WHEN f THEN 'critical' ELSE 'warning' END AS severity, string_agg(source, ', ' ORDER BY source) AS sources, min(coverage) AS coverage, CAST(sum(n_missing) AS BIGINT) AS n_missing, CAST(sum(n_low) AS BIGINT) AS n_low, CAST(sum(n_ambiguous) AS BIGINT) AS n_ambiguous
FROM (SELECT *, status = 'FAILED' OR coverage = 0 AS f, bool_or(status = 'FAILED' OR coverage = 0) OVER (PARTITION BY process_id) AS any_failed FROM ({_QUALITY}) WHERE status IN ('FAILED', 'PARTIAL') OR coverage = 0) WHERE f = any_failed GROUP BY process_id, f"""


CAND = a.duck(a.CANDIDATES)
_CHECKED = f"""(SELECT process_id, source, doc_ord, field_id, field_type, participant_id, issue, CASE WHEN issue THEN NULL ELSE value END AS value, CASE WHEN issue THEN 0 ELSE confidence END AS confidence
FROM (SELECT *, trim(coalesce(value, '')) <> '' AND field_id <> 'property.type' AND (field_id <> 'contract.date' OR source = 'MINUTA') AND (process_id % 6 = 0 OR process_id % 5 = 0 OR (source = 'MINUTA' AND field_id = 'financial.totalValue' AND process_id % 3 <> 0)) AS issue FROM {CAND} c))"""
_WHOSE = "CASE WHEN field_id = 'buyer.name' THEN coalesce(participant_id, 'buyer_1') END"
_WKEY = f"CASE WHEN field_id = 'buyer.name' THEN field_id || '::' || coalesce(participant_id, 'buyer_1') ELSE field_id END"
_DUE = f"(SELECT * FROM {a.duck(a.DOCUMENTS)} d WHERE storage_path IS NOT NULL AND purged_at IS NULL AND created_at <= TIMESTAMP '{a.NOW}' - INTERVAL 40 DAY ORDER BY created_at, document_id LIMIT 100)"
_FIELD_ROWS = "(VALUES " + ", ".join(f"('{f}')" for f, *_ in catalog.fields()) + ") AS f(field_id)"
_READ = f"(SELECT process_id, source, field_id, doc_ord, CASE WHEN doc_ord = 0 AND process_id % 2 <> 0 THEN NULL ELSE value END AS value FROM {CAND} c WHERE doc_ord = 0 OR process_id % 3 <> 0)"
_HAS = f"(SELECT process_id, source, field_id, bool_or(doc_ord = 0 AND trim(coalesce(value, '')) <> '') AS f, bool_or(doc_ord = 1 AND trim(coalesce(value, '')) <> '') AS s, max(doc_ord) AS l FROM {_READ} r GROUP BY ALL)"
_MINUTE = "(VALUES ('PENDING', 0, 1), ('EXTRACTING', 1, 2), ('COMPARING', 2, 3), ('DONE', 3, 4), ('EXTRACTING', 4, 2), ('FAILED', 5, 5)) AS s(status, minute, step)"


def _nat(x: str) -> str:
    return f"regexp_replace(upper({x}), '[0-9]+', '', 'g') || lpad(regexp_replace({x}, '[^0-9]', '', 'g'), 12, '0')"


ORACLE |= {
    "norm_every_type": f"SELECT process_id, source, field_id, participant_id, {WIDE_NORMAL} AS norm FROM {a.duck(a.WIDE_EVIDENCE)} e",
    "reconcile_every_source": WIDE + "SELECT process_id, field_id, participant_id, status, rung, observation FROM o",
    "every_source_summary": WIDE + f"SELECT field_id, {_COUNTS} FROM o GROUP BY field_id",
    "every_source_missing": WIDE + f"SELECT p.source, CAST(sum(CASE WHEN contains(observation, 'não encontrado na fonte ' || {LABEL}[p.source]) THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN status = 'SOURCE_UNREADABLE' AND list_contains(list_transform(rows, lambda x: x.source), p.source) THEN 1 ELSE 0 END) AS BIGINT) AS unreadable FROM o JOIN {a.duck(a.PARTICIPATION)} p USING (process_id) GROUP BY p.source",
    "participant_summary": WIDE + "SELECT DISTINCT process_id, participant_id, who AS label FROM o WHERE participant_id IS NOT NULL",
    "learned_equivalence": f"""WITH p AS (SELECT process_id, field_id, {text('value')} AS t, CASE field_id WHEN 'buyer.maritalStatus' THEN {marital(text('value'))} ELSE {development(text('value'))} END AS g FROM {a.duck(a.WIDE_EVIDENCE)} e WHERE field_id IN ('buyer.maritalStatus', 'property.development')),
c AS (SELECT process_id, field_id, CASE field_id WHEN 'buyer.maritalStatus' THEN 'MARITAL_STATUS_GENDER' ELSE 'TEXT_ALIAS' END AS rule_kind, array_to_string(list_sort(list(DISTINCT t)), ' || ') AS signature FROM p WHERE t <> '' GROUP BY ALL HAVING count(DISTINCT t) > 1 AND count(DISTINCT g) = 1 AND count(*) FILTER (WHERE g <> '') >= 2)
SELECT c.*, CASE WHEN r.occurrence_count = 1 THEN 'Valores equivalentes por aprendizado supervisionado (1 validação humana anterior).' WHEN r.occurrence_count > 1 THEN 'Valores equivalentes por aprendizado supervisionado (' || r.occurrence_count || ' validaçãoões humanas anteriores).'
WHEN c.rule_kind = 'TEXT_ALIAS' THEN 'Valores equivalentes: variação textual já normalizada para este campo.' ELSE 'Valores equivalentes: variação apenas gramatical do estado civil.' END AS observation FROM c LEFT JOIN {a.duck(a.RULES)} r USING (field_id, rule_kind, signature)""",
    "report_counters": FULL + f"SELECT process_id, count(*) FILTER (WHERE status = 'MATCH' OR approved) AS checked, count(*) FILTER (WHERE status = 'DIVERGENCE' AND NOT approved) AS divergences, count(*) FILTER (WHERE status NOT IN ('MATCH', 'DIVERGENCE') AND NOT approved) AS reviews FROM {_REVIEWED} GROUP BY process_id",
    "report_checked": FULL + f"SELECT process_id, field_id FROM {_REVIEWED} WHERE status = 'MATCH' OR approved",
    "report_pending": FULL + f"SELECT process_id, field_id FROM {_REVIEWED} WHERE status <> 'MATCH' AND NOT approved",
    "result_missing": FULL + f"SELECT process_id, field_id FROM {_REVIEWED} WHERE contains(observation, 'não encontrado na fonte') AND NOT has_review",
    "review_state": f"SELECT process_id, field_id, action AS status, reviewer_id FROM {a.duck(a.REVIEW_LOG)} l QUALIFY row_number() OVER (PARTITION BY process_id, field_id ORDER BY seq DESC, action DESC) = 1 AND action <> 'REVOKED'",
    "review_audit": f"SELECT CAST(reviewer_id AS VARCHAR) AS actor_id, CASE action WHEN 'REVOKED' THEN 'REVIEW_REVOKED' ELSE 'REVIEW_APPROVED' END AS event_type, count(*) AS n, max(process_id || ':' || field_id) AS last_entity FROM {a.duck(a.REVIEW_LOG)} l GROUP BY ALL",
    "retention_purged": f"SELECT document_id, CAST(NULL AS VARCHAR) AS storage_path, TIMESTAMP '{a.NOW}' AS purged_at, 'RETENTION_40_DAYS' AS purge_reason, purge_attempts FROM {_DUE}",
    "retention_failed": f"SELECT document_id, storage_path, purge_attempts + 1 AS purge_attempts, 1000 AS error_length FROM {_DUE}",
    "retention_audit": f"SELECT organization_id, 'DOCUMENTS_PURGED' AS event_type, 'document_retention' AS entity_type, count(*) AS count FROM {_DUE} GROUP BY organization_id",
    "process_persisted": FULL + f"SELECT p.process_id, p.status, p.updated_at, CASE WHEN p.status = 'FAILED' THEN 'FAILED' WHEN p.status <> 'DONE' OR v.bad IS NULL THEN 'IN_PROGRESS' WHEN v.bad THEN 'PENDING_REVIEW' ELSE 'FULLY_CHECKED' END AS final_status, CASE WHEN p.status IN ('DONE', 'FAILED') THEN p.updated_at END AS completed_at FROM (SELECT process_id, started_at AS updated_at, CASE WHEN process_id % 97 = 0 THEN 'FAILED' WHEN process_id % 7 = 0 THEN 'COMPARING' ELSE 'DONE' END AS status FROM {a.duck(a.PROCESSES)} x) p LEFT JOIN (SELECT process_id, bool_or(status <> 'MATCH') AS bad FROM o GROUP BY process_id) v USING (process_id)",
    "process_lifecycle": f"SELECT process_id, status FROM {a.duck(a.PROCESSES)} p CROSS JOIN {_MINUTE} WHERE minute <= process_id % 7 AND (status <> 'DONE' OR process_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY CAST(step >= 4 AS INT) DESC, CASE WHEN step >= 4 THEN minute ELSE -minute END) = 1",
    "processes_with_documents": f"SELECT p.process_id, f.role, coalesce(d.documents, '') AS documents FROM {a.duck(a.PROCESSES)} p LEFT JOIN {a.duck(a.PROFILES)} f USING (user_id) LEFT JOIN (SELECT process_id, string_agg(document_id || '=' || source, ',' ORDER BY created_at, document_id, source) AS documents FROM {a.duck(a.DOCUMENTS)} x GROUP BY process_id) d USING (process_id)",
    "documents_upsert": f"SELECT document_id, CASE WHEN line = 1 THEN 'MATRICULA' ELSE source END AS source FROM {a.duck(a.DOCUMENTS)} d",
    "slowest_processes": f"SELECT process_id, minutes, CASE WHEN n_documents = 0 THEN 'NO_DOCUMENTS' WHEN final_status = 'FAILED' THEN 'FAILED' WHEN final_status = 'IN_PROGRESS' AND minutes >= 30 THEN 'STUCK' WHEN final_status = 'IN_PROGRESS' THEN 'SLOW_RUNNING' ELSE 'SLOW_DONE' END AS finding FROM {PROC} p WHERE n_documents = 0 OR final_status = 'FAILED' OR minutes >= 10 ORDER BY minutes DESC, process_id LIMIT 12",
    "evidence_verified": f"SELECT process_id, source, doc_ord, field_id, value, confidence, issue FROM {_CHECKED} c",
    "consolidated_values": f"SELECT process_id, source, field_id, {_WHOSE} AS participant_id, value, confidence FROM {_CHECKED} c WHERE trim(coalesce(value, '')) <> '' QUALIFY row_number() OVER (PARTITION BY process_id, source, field_id, {_WHOSE} ORDER BY confidence DESC, doc_ord) = 1",
    "consolidated_conflicts": f"SELECT process_id, source, {_WKEY} AS field_id FROM (SELECT *, {NORMAL} AS norm FROM {_CHECKED} c) WHERE trim(coalesce(value, '')) <> '' GROUP BY ALL HAVING count(DISTINCT norm) > 1",
    "consolidated_issues": f"SELECT DISTINCT process_id, source, {_WKEY} AS field_id FROM {_CHECKED} c WHERE issue",
    "coerced_output": f"""SELECT d.doc_id, f.field_id, o.value, coalesce(o.c, 0) AS confidence, o.pid AS participant_id, o.page, o.raw FROM (SELECT c_custkey AS doc_id FROM customer) d CROSS JOIN {_FIELD_ROWS} LEFT JOIN (SELECT doc_id, field_id, value, trim(raw) AS raw,
CASE ord WHEN 1 THEN 87 WHEN 2 THEN 100 WHEN 3 THEN 65 ELSE 0 END AS c, CASE ord WHEN 1 THEN 'buyer_1' WHEN 2 THEN 'co_buyer_' WHEN 7 THEN 'buyer_1' END AS pid, CASE ord WHEN 1 THEN 2 WHEN 7 THEN 4 END AS page FROM {a.duck(a.OUTPUT)} r WHERE ord IN (1, 2, 3, 5, 7)) o ON o.doc_id = d.doc_id AND o.field_id = f.field_id""",
    "missing_critical": f"SELECT p.process_id, c.source, string_agg(c.field_id, ',' ORDER BY c.field_id) AS missing FROM (SELECT DISTINCT process_id, source FROM {EV} e) p JOIN {_CRITICAL} ON c.source = p.source LEFT JOIN (SELECT DISTINCT process_id, source, field_id FROM {EV} e WHERE trim(coalesce(value, '')) <> '') h ON h.process_id = p.process_id AND h.source = c.source AND h.field_id = c.field_id WHERE h.field_id IS NULL GROUP BY p.process_id, c.source",
    "recovery_merge": f"SELECT process_id, source, field_id, doc_ord, value FROM {_READ} r JOIN {_HAS} h USING (process_id, source, field_id) WHERE doc_ord = CASE WHEN f THEN 0 ELSE l END",
    "recovery_preferred": f"SELECT process_id, source, field_id, doc_ord, value FROM {_READ} r JOIN {_HAS} h USING (process_id, source, field_id) WHERE doc_ord = CASE WHEN s THEN 1 WHEN f THEN 0 ELSE l END",
    "reservation_gaps": f"SELECT process_id, true AS financial, true AS identity, bool_or(trim(coalesce(value, '')) <> '' AND confidence >= 70 AND trim(raw) <> '') AS evidenced FROM {CAND} c WHERE source = 'DADOS_RESERVA' GROUP BY process_id",
    "developments_with_units": f"SELECT development_id, name, coalesce(units, '') AS units FROM {a.duck(a.DEVELOPMENTS)} d LEFT JOIN (SELECT development_id, string_agg(tower || '/' || unit, ',' ORDER BY {_nat('tower')}, {_nat('unit')}) AS units FROM {a.duck(a.UNITS)} u GROUP BY development_id) x USING (development_id)",
    "units_replaced": f"SELECT development_id, CASE WHEN saved THEN 'nova' ELSE tower END AS tower, unit FROM (SELECT u.*, d.development_id IS NOT NULL AND u.development_id % 3 = 1 AS saved FROM {a.duck(a.UNITS)} u LEFT JOIN {a.duck(a.DEVELOPMENTS)} d USING (development_id)) WHERE NOT saved OR CAST(unit AS INT) % 5 = 0",
    "development_deleted": f"SELECT development_id, organization_id FROM {a.duck(a.DEVELOPMENTS)} d WHERE development_id % 4 <> 0",
    "development_units_left": f"SELECT development_id, unit FROM {a.duck(a.UNITS)} u WHERE NOT (development_id % 4 = 0 AND development_id IN (SELECT s_suppkey FROM supplier))",
    "towers_by_apartments": "SELECT p_partkey AS group_id, t.tower, a.unit FROM part, unnest(CASE WHEN p_partkey % 4 = 0 THEN [''] ELSE ['A', 'B'] END) AS t(tower), unnest(CASE WHEN p_partkey % 4 = 0 THEN [''] ELSE ['101', p_brand] END) AS a(unit) WHERE p_partkey % 7 <> 0",
    "pages_merged": """WITH p AS (SELECT s_suppkey, page, CASE WHEN page < 3 AND s_suppkey % 2 = 0 THEN 'Empreendimento sem nome' ELSE s_name || ' p' || page END AS name, CASE WHEN (s_suppkey + page) % 2 = 0 THEN 'c' || page END AS city, CASE WHEN (s_suppkey + page) % 3 = 0 THEN 'r' || page END AS registration, CASE WHEN (s_suppkey + page) % 5 = 0 THEN 's' || page END AS seller_name FROM supplier, (VALUES (1), (2), (3)) AS v(page))
SELECT s_suppkey, coalesce(arg_min(name, page) FILTER (WHERE name <> 'Empreendimento sem nome'), 'Empreendimento sem nome') AS name, arg_min(city, page) FILTER (WHERE city IS NOT NULL) AS city, arg_min(registration, page) FILTER (WHERE registration IS NOT NULL) AS registration, arg_min(seller_name, page) FILTER (WHERE seller_name IS NOT NULL) AS seller_name, CAST(NULL AS VARCHAR) AS seller_cnpj FROM p GROUP BY s_suppkey""",
    "notes_merged": "SELECT s_suppkey, array_to_string(CASE WHEN s_suppkey % 2 <> 0 THEN ['OCR: a', 'OCR: b'] ELSE [] END || CASE WHEN s_suppkey % 3 <> 0 THEN ['Visão IA: a', 'Visão IA: b'] ELSE [] END, '|') AS notes FROM supplier",
    "empty_developments": f"SELECT development_id, CASE WHEN development_id % 2 = 0 THEN 'TYPES_WITHOUT_AREA:Tipo A, Tipo B' ELSE 'NO_UNITS' END AS issue FROM {a.duck(a.DEVELOPMENTS)} d WHERE development_id % 5 = 0 OR development_id NOT IN (SELECT development_id FROM {a.duck(a.UNITS)} u)",
}
ORACLE["register_appended"] = f"SELECT 0 AS source_ord, source, field_id, count(*) AS n, count(value) AS n_values FROM {EV} e WHERE source = 'SIOPI' GROUP BY source, field_id UNION ALL SELECT 4, source, field_id, count(*), count(value) FROM ({ORACLE['unit_unpivot']}) GROUP BY source, field_id"


#: Queries that SQL can't express; they have tests of their own.
NO_SQL = {"focus_text"}


def _rows(*rows: tuple[str, str, int]) -> str:
    """Field, value and confidence for each customer; the customer's number stands where # does."""
    return "SELECT c_custkey, f.field_id, replace(f.value, '#', CAST(c_custkey AS VARCHAR)) AS value, CAST(f.c AS INT) AS confidence FROM customer, (VALUES " + ", ".join(f"('{f}', '{v}', {c})" for f, v, c in rows) + ") AS f(field_id, value, c)"


_FILES = """(SELECT l_orderkey AS upload, 'arquivo' || l_linenumber || ['.pdf', '.PNG', '.jpg', '.docx', '.rtf', '.tif', '.exe'][l_partkey % 7 + 1] AS name, l_partkey % 7 AS kind, l_partkey % 10 = 0 AS wrong, l_partkey * 1000 AS size, l_partkey % 3 AS k FROM lineitem)"""
_MONEY = lambda v: f"'R$' || chr(160) || replace(replace(replace(format('{{:,.2f}}', CAST({v} AS DOUBLE)), ',', ';'), '.', ','), ';', '.')"
_DIFF = "coalesce(list_position(list_transform(range(1, greatest(length(a), length(b), 1) + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1)), true), 0)"
_TAIL = lambda v: f"CASE WHEN length({v}) > 9 THEN '...' || substring({v}, length({v}) - 8, 9) ELSE {v} END"
_ONLY = lambda v, w: f"array_to_string(list_filter(string_split({v}, ' '), lambda t: t <> '' AND NOT list_contains(string_split({w}, ' '), t)), ' ')"
_PLAIN = WIDE_NORMAL.replace("CASE WHEN coalesce(value, '') = ''", "CASE WHEN v = ''").replace(f"WHEN field_id = 'buyer.maritalStatus' THEN {marital(text('value'))} WHEN field_id = 'property.development' THEN {development(text('value'))} ", "").replace("coalesce(value, '')", "v")
_VALIDATED = f"""WITH f AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{k}', {str(r).lower()})" for f, _, _, r, k, _ in catalog.MINUTA)}) AS t(field_id, field_type, required)),
e AS (SELECT process_id, field_id, source, arg_max(trim(coalesce(value, '')), coalesce(participant_id, '')) AS v, arg_max(confidence, coalesce(participant_id, '')) AS c FROM {a.duck(a.WIDE_EVIDENCE)} x GROUP BY ALL),
p AS (SELECT DISTINCT process_id FROM e),
s AS (SELECT p.process_id, f.*, coalesce(l.v, '') AS x, coalesce(r.v, '') AS y, least(coalesce(l.c, 0), coalesce(r.c, 0)) AS c FROM p CROSS JOIN f LEFT JOIN e l ON l.process_id = p.process_id AND l.field_id = f.field_id AND l.source = 'SIOPI' LEFT JOIN e r ON r.process_id = p.process_id AND r.field_id = f.field_id AND r.source = 'MINUTA'),
m AS (SELECT *, (SELECT {_PLAIN} FROM (SELECT s.x AS v)) AS a, (SELECT {_PLAIN} FROM (SELECT s.y AS v)) AS b FROM s),
t AS (SELECT *, CASE WHEN a = '' AND b = '' AND NOT required THEN 'NOT_APPLICABLE' WHEN a = '' OR b = '' THEN 'NOT_FOUND' WHEN c < 70 THEN 'REVIEW_REQUIRED' WHEN a = b THEN 'MATCH' ELSE 'DIVERGENCE' END AS status, {_DIFF} AS d, {_ONLY('a', 'b')} AS l, {_ONLY('b', 'a')} AS r,
  abs(date_diff('day', TRY_CAST(a AS DATE), TRY_CAST(b AS DATE))) AS days, TRY_CAST(a AS DECIMAL(20,2)) AS na, TRY_CAST(b AS DECIMAL(20,2)) AS nb FROM m)
SELECT process_id, field_id, status, CASE status WHEN 'MATCH' THEN 'Campo conferido automaticamente após normalização.' WHEN 'NOT_FOUND' THEN 'Informação ausente em uma das fontes.' WHEN 'NOT_APPLICABLE' THEN 'Campo opcional ausente nas duas fontes.' WHEN 'REVIEW_REQUIRED' THEN 'Extração com confiança abaixo de 70%.' ELSE
CASE WHEN field_type IN ('cpf', 'rg', 'cnpj') THEN upper(field_type) || ' diverge na posição ' || d || ': imagem mostra ' || {_TAIL('x')} || ', documento mostra ' || {_TAIL('y')} || '.'
WHEN field_type = 'valor_monetario' THEN 'Valor diverge em ' || {_MONEY('abs(nb - na)')} || ' (' || replace(rtrim(rtrim(format('{{:.2f}}', CAST(round(CAST(abs(nb - na) * 100 AS DECIMAL(38,10)) / abs(na), 2) AS DOUBLE)), '0'), '.'), '.', ',') || '% ' || CASE WHEN nb > na THEN 'maior no documento' ELSE 'menor no documento' END || '): imagem ' || x || ', documento ' || y || '.'
WHEN field_type = 'data' AND days IS NOT NULL THEN 'Data diverge em ' || CASE WHEN days >= 365 AND days % 365 = 0 THEN days // 365 || CASE WHEN days = 365 THEN ' ano' ELSE ' anos' END WHEN days >= 30 AND days % 30 = 0 THEN days // 30 || CASE WHEN days = 30 THEN ' mês' ELSE ' meses' END ELSE days || CASE WHEN days = 1 THEN ' dia' ELSE ' dias' END END || ': imagem ' || x || ', documento ' || y || '.'
WHEN field_type = 'data' THEN 'Data diverge: imagem ' || x || ', documento ' || y || '.'
WHEN l = '' AND r = '' THEN 'Texto diverge por ordem ou formatação dos termos: imagem "' || x || '", documento "' || y || '".'
ELSE 'Diverge no ' || CASE field_type WHEN 'endereco' THEN 'componente do endereço' ELSE 'palavra' END || ': imagem indica "' || CASE l WHEN '' THEN x ELSE l END || '", documento indica "' || CASE r WHEN '' THEN y ELSE r END || '".' END END AS observation FROM t"""

ORACLE |= {
    "legacy_observations": _VALIDATED.replace("TRIM_VALUE", "v"),
    "extract_contract": _rows(("contract.number", "8.#.77", 94), ("contract.agencyCode", "1#-5", 90), ("contract.date", "12 de março de 2024", 98), ("financial.financing", "R$ 1#.000,00", 100), ("financial.totalValue", "R$ 2#.500,00", 98), ("property.unit", "302", 99), ("property.tower", "T#", 99), ("property.floor", "3º Pavimento", 99), ("property.type", "Tipo C", 99), ("property.registration", "55.#", 90)),
    "extract_composition": _rows(("financial.financing", "R$ 1#.000,00", 100), ("financial.downPayment", "R$ 2#,00", 100), ("financial.fgts", "R$ 3#,10", 100), ("financial.subsidy", "R$ 4#,50", 100)),
    "extract_reservation": _rows(("buyer.name", "ANA SOUZA", 90), ("buyer.cpf", "123.456.789-01", 90), ("buyer.rg", "RG1#9999", 90), ("buyer.phone", "85 99999-8888", 90), ("buyer.maritalStatus", "Casada", 90), ("buyer.address", "Rua #, Centro", 90), ("financial.totalValue", "R$ 123.000,00", 90), ("financial.financing", "15#,00", 70)),
    "extract_declaration": _rows(("buyer.address", "Rua #", 94), ("seller.legalName", "OBRAS # LTDA", 96), ("seller.cnpj", "12.345.678/0001-90", 94), ("seller.address", "Av #", 96), ("property.registration", "55#", 94), ("property.privateArea", "5#,25", 96), ("financial.totalValue", "2#.000,00", 96), ("financial.nonFinancedValue", "5#,00", 90), ("transaction.nature", "Compra e venda", 96)),
    "deed_units": "SELECT c_custkey, CASE n WHEN 0 THEN '5' || c_custkey || ',25' ELSE '70,10' END AS private_area, CASE n WHEN 0 THEN '6' || c_custkey || ',750' END AS total_area, CASE n WHEN 0 THEN '0,012345' END AS ideal_fraction, '77-' || c_custkey AS iptu, CASE n WHEN 0 THEN 'Tipo A' ELSE 'Tipo B' END AS typology, CAST(CASE n WHEN 0 THEN 88 ELSE 82 END AS INT) AS confidence, CASE n WHEN 0 THEN '2' ELSE '3' END AS pages FROM customer, (VALUES (0), (1)) AS v(n)",
    "deed_table_units": "SELECT c_custkey, CASE n WHEN 0 THEN '1' ELSE '2' END AS tower, CASE n WHEN 0 THEN '101' ELSE '20200' END AS unit, CASE n WHEN 0 THEN 'Tipo A' ELSE 'Tipo B-C' END AS typology, CASE n WHEN 0 THEN '50,25' ELSE '51,00' END AS private_area, CASE n WHEN 0 THEN '60,755' ELSE '61,000' END AS total_area, CASE n WHEN 0 THEN '0,012345' ELSE '0,0123456' END AS ideal_fraction, CAST(96 AS INT) AS confidence, CAST(CASE n WHEN 0 THEN 4 ELSE 5 END AS INT) AS page FROM customer, (VALUES (0), (1)) AS v(n)",
    "deed_development": "SELECT c_custkey, 'Condominio Vila ' || c_custkey AS name, 'Fortaleza' AS city, '12' || c_custkey AS registration, '12.345.678/0001-90' AS seller_cnpj, 'Tipo A,Tipo B' AS typologies FROM customer",
    "upload_gate": f"SELECT upload, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE kind = 6 OR wrong OR size <= 0 OR size > 15728640) AS n_rejected, count(*) <= 20 AND sum(size) <= 62914560 AND count(*) FILTER (WHERE kind = 6 OR wrong OR size <= 0 OR size > 15728640) = 0 AS accepted FROM {_FILES} f GROUP BY upload",
    "upload_kinds": f"SELECT ['application/pdf', 'image/png', 'image/jpeg', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/rtf', 'image/tiff', 'application/octet-stream'][kind + 1] AS mime_type, ['PDF', 'IMAGE', 'IMAGE', 'WORD', 'WORD', 'TIFF', 'COMPLEMENTARY'][kind + 1] AS itbi_type, ['CONTRACT', 'IMAGE', 'IMAGE', 'WORD', 'WORD', 'TIFF', 'CONTRACT'][kind + 1] AS minuta_type, ['pdf', 'image', 'image', 'docx', 'rtf', 'tiff', NULL][kind + 1] AS reader, count(*) AS n FROM {_FILES} f GROUP BY ALL",
    "upload_sides": f"SELECT upload, bool_or(kind IN (1, 2, 5)) AND bool_or(kind NOT IN (1, 2, 5)) AS both_sides FROM {_FILES} f GROUP BY upload",
    "upload_sources": f"SELECT upload, count(DISTINCT k) + CASE WHEN upload % 5 = 0 THEN 1 ELSE 0 END AS n_sources, count(DISTINCT k) + CASE WHEN upload % 5 = 0 THEN 1 ELSE 0 END >= 2 AS enough FROM {_FILES} f GROUP BY upload",
    "upload_estimates": f"SELECT upload, CASE WHEN big THEN '2 a 6 minutos' WHEN p > 0 AND i > 0 THEN '1 a 3 minutos' WHEN p > 0 THEN '40 segundos a 2 minutos' WHEN i > 2 THEN '1 a 3 minutos' ELSE '30 segundos a 2 minutos' END AS label, CAST(CASE WHEN big THEN 360 WHEN p > 0 AND i > 0 THEN 180 WHEN p > 0 THEN 120 WHEN i > 2 THEN 180 ELSE 120 END AS INT) AS max_seconds FROM (SELECT upload, count(*) FILTER (WHERE kind = 0) AS p, count(*) FILTER (WHERE kind <> 0) AS i, bool_or(kind = 0 AND size >= 3145728) AS big FROM {_FILES} f GROUP BY upload)",
    "upload_source_lists": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'SIOPI,ITBI' WHEN o_orderkey % 8 = 6 THEN 'MINUTA' END AS sources FROM orders",
    "page_lists": "SELECT o_orderkey, CASE WHEN k % 3 = 0 AND k BETWEEN 1 AND 30 THEN array_to_string(list_sort(list_distinct(range(1, k + 1) || [CAST(2 AS BIGINT)])), ',') WHEN k % 3 = 1 AND k BETWEEN 1 AND 30 THEN CAST(k AS VARCHAR) END AS pages FROM (SELECT o_orderkey, o_orderkey % 50 AS k FROM orders)",
    "names_inferred": "SELECT p_partkey, 'Vila ' || regexp_replace(p_brand, '#[0-9]+$', '') AS name, CASE WHEN length(p_brand) > 7 THEN substring(p_brand, 7) || '_' ELSE '' END || '12.' || p_partkey AS registration, 'cao-' || replace(p_brand, '#', '-') || '-x' AS file FROM part",
    "errors_told": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Timeout Bearer [oculto] fim' WHEN 1 THEN 'arquivo encrypted' ELSE 'outro [chave oculta]' END AS hidden, CASE o_orderkey % 3 WHEN 0 THEN 'Tempo excedido ao extrair a.pdf. O arquivo pode ser muito pesado, escaneado em alta resolução ou o provedor de IA/OCR demorou demais.' WHEN 1 THEN 'PDF protegido por senha ou criptografia: a.pdf. Remova a proteção ou envie uma versão desbloqueada.' ELSE 'outro sk-' || o_orderkey END AS told FROM orders",
    "requests_audited": "SELECT c_custkey, c_custkey || '.0.0.1' AS ip, CAST(least(300, length(c_name) * 20) AS INT) AS agent_length, 'u' || c_custkey || '@mail.org' AS login FROM customer",
    "workbook_tables": "SELECT DISTINCT p_brand AS file_id, 'sheet1' AS sheet, CAST(1 AS INT) AS row, CAST(25 AS INT) AS score, CAST(0 AS INT) AS tower, CAST(1 AS INT) AS unit, CAST(2 AS INT) AS typology, CAST(3 AS INT) AS private_area FROM part",
    "workbook_units": r"SELECT p_brand AS file_id, 'T1' AS tower, CAST(p_partkey AS VARCHAR) AS unit, CASE WHEN p_partkey % 3 <> 0 THEN 'Tipo K' || p_partkey % 4 ELSE '' END AS typology, regexp_replace(regexp_replace(replace(CAST(CAST(p_retailprice AS DECIMAL(20,2)) AS VARCHAR), '.', ','), '0+$', ''), ',$', '') AS private_area, CAST(99 AS INT) AS confidence FROM part WHERE p_partkey % 5 <> 0",
    "workbook_texts": "SELECT p_brand AS file_id, CAST(2 + least(count(*), 1999) AS INT) AS n_lines, substring('sheet1:' || chr(10) || 'Lista de unidades: Torre | Coluna 2: Unidade (nº) | Coluna 3: Tipologia', 1, 60) AS start FROM part GROUP BY p_brand",
    "text_shortened": "SELECT doc_id, sha256(CASE WHEN length(t) <= 22000 THEN t ELSE substring(t, 1, 17000) || chr(10) || chr(10) || '[CONTEÚDO INTERMEDIÁRIO OMITIDO]' || chr(10) || chr(10) || substring(t, length(t) - 4999, 5000) END) AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
}
ORACLE |= streams.ORACLE | readings.sql()
