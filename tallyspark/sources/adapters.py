"""The engine's canonical tables over the star schema, by key arithmetic alone.

The mapping is SQL that Spark and DuckDB read alike, with the tables' names in
braces, so tests can feed both engines the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources.storage import spread

#: Fixed point in time of operational queries.
NOW = "2024-01-31 00:00:00"

#: Long table of extracted values: four sources spell five fields of an order their own way; keys decide on errors, gaps and confidence.
EVIDENCE = """
SELECT k AS process_id, s.source_ord, s.source, f.field_id, f.field_type, CAST(60 + (k * 7 + s.source_ord) % 41 AS INT) AS confidence,
  CASE WHEN (k + s.source_ord) % 13 = 0 OR (s.source_ord >= 1 AND k % 17 = 0) THEN NULL
  WHEN f.field_id = 'buyer.name' THEN CASE s.source_ord WHEN 0 THEN concat(other, name) WHEN 1 THEN concat(lower(concat(other, name)), CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END) WHEN 2 THEN concat('  ', other, name, ' ') ELSE upper(concat(other, name)) END
  WHEN f.field_id = 'financial.totalValue' THEN CASE s.source_ord WHEN 0 THEN concat('R$ ', replace(amount, '.', ',')) WHEN 2 THEN concat('R$', replace(amount, '.', ',')) ELSE amount END
  WHEN f.field_id = 'contract.date' THEN CASE s.source_ord WHEN 1 THEN concat(dd, '-', mm, '-', substring(yy, 3, 2)) ELSE concat(dd, '/', mm, '/', yy) END
  WHEN f.field_id = 'property.type' THEN CASE s.source_ord WHEN 1 THEN lower(segment) WHEN 2 THEN replace(segment, 'I', 'Í') ELSE segment END
  ELSE 'R$ 0,00' END AS value
FROM (
  SELECT o_orderkey AS k, src AS s_ord, c_name AS name, c_mktsegment AS segment,
    CASE WHEN (o_orderkey + src) % 11 = 0 THEN 'Outro ' ELSE '' END AS other,
    CAST(CAST(o_totalprice AS DECIMAL(20,2)) + CASE WHEN (o_orderkey + src) % 11 = 0 THEN 1 ELSE 0 END AS STRING) AS amount,
    lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm,
    CAST(year(o_orderdate) + CASE WHEN (o_orderkey + src) % 11 = 0 THEN 1 ELSE 0 END AS STRING) AS yy
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey CROSS JOIN (VALUES (0), (1), (2), (3)) AS n(src)) AS o
JOIN (VALUES (0, 'SIOPI'), (1, 'MINUTA'), (2, 'ITBI'), (3, 'DADOS_RESERVA')) AS s(source_ord, source) ON s.source_ord = o.s_ord
CROSS JOIN (VALUES ('buyer.name', 'texto'), ('financial.totalValue', 'valor_monetario'), ('contract.date', 'data'), ('property.type', 'texto'), ('financial.fgts', 'valor_monetario')) AS f(field_id, field_type)
WHERE f.field_id <> 'financial.fgts' OR s.source_ord = 3
"""

#: What is known of a run besides values: unreadable sources, and source:field keys of conflicts and evidence issues.
CONTEXT = """
SELECT o_orderkey AS process_id, o_orderkey % 19 = 0 AS itbi_unreadable, o_orderkey % 23 = 0 AS total_conflict, o_orderkey % 29 = 0 AS total_issue FROM {orders}
"""

#: Fixed order of the ten sources in the wide tables below.
_TEN = "(VALUES (0, 'SIOPI'), (1, 'MINUTA'), (2, 'ITBI'), (3, 'DADOS_RESERVA'), (4, 'CADASTRO_EMPREENDIMENTO'), (5, 'MATRICULA'), (6, 'FRACOES'), (7, 'IPTU'), (8, 'CERTIDAO'), (9, 'DOCUMENTO_COMPLEMENTAR'))"

#: Ten sources, every type of field, and one buyer or two: a customer is a process. Keys decide on spellings, errors, blanks and rows that are missing.
WIDE_EVIDENCE = f"""
SELECT k AS process_id, s.source_ord, s.source, f.field_id, f.field_type, b.participant_id, CAST(66 + (k * 5 + s.source_ord + f.nr) % 35 AS INT) AS confidence,
  CASE WHEN (k + s.source_ord * 3 + f.nr) % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN ' ' END
  WHEN f.field_type IN ('cpf', 'rg', 'cnpj', 'telefone') THEN CASE WHEN s.source_ord % 2 = 0 THEN lpad(CAST(k * 100 + b.n + off AS STRING), 11, '0') ELSE concat(substring(lpad(CAST(k * 100 + b.n + off AS STRING), 11, '0'), 1, 3), '.', substring(lpad(CAST(k * 100 + b.n + off AS STRING), 11, '0'), 4, 3), '-', substring(lpad(CAST(k * 100 + b.n + off AS STRING), 11, '0'), 7, 5)) END
  WHEN f.field_type = 'email' THEN CASE WHEN s.source_ord % 2 = 0 THEN concat('c', CAST(k + off AS STRING), '@mail.com') ELSE concat(' C', CAST(k + off AS STRING), '@Mail.com ') END
  WHEN f.field_type = 'endereco' THEN CASE WHEN s.source_ord % 2 = 0 THEN concat('Rua das Flores, nº ', CAST(k + off AS STRING), ' Apto 3') ELSE concat('R. das Flores, N ', CAST(k + off AS STRING), ' apartamento 3') END
  WHEN f.field_type = 'data' THEN CASE WHEN s.source_ord % 2 = 0 THEN concat('0', CAST(1 + k % 9 AS STRING), '/0', CAST(1 + off AS STRING), '/2021') ELSE concat(CAST(1 + k % 9 AS STRING), '-', CAST(1 + off AS STRING), '-21') END
  WHEN f.field_type = 'valor_monetario' THEN CASE WHEN s.source_ord % 3 = 0 THEN concat('R$ ', CAST(k + off AS STRING), ',50') WHEN s.source_ord % 3 = 1 THEN concat(CAST(k + off AS STRING), '.50') ELSE concat('1.', lpad(CAST((k + off) % 1000 AS STRING), 3, '0'), ',50') END
  WHEN f.field_type = 'area' THEN CASE WHEN s.source_ord % 2 = 0 THEN concat(CAST(40 + k % 60 + off AS STRING), ',5000 m2') ELSE concat(CAST(40 + k % 60 + off AS STRING), '.5') END
  WHEN f.field_type = 'identificador_imovel' THEN CASE WHEN s.source_ord % 2 = 0 THEN concat('Torre 0', CAST(k + off AS STRING)) ELSE concat('bloco ', CAST(k + off AS STRING), 'º') END
  WHEN f.field_id = 'buyer.maritalStatus' THEN CASE (s.source_ord + off) % 3 WHEN 0 THEN 'Casado(a)' WHEN 1 THEN 'casada' ELSE CASE WHEN off = 0 THEN 'CASADO' ELSE 'Divorciada' END END
  WHEN f.field_id = 'property.development' THEN CASE s.source_ord % 3 WHEN 0 THEN concat('Condomínio Vila ', CAST(k + off AS STRING)) WHEN 1 THEN concat('VILA ', CAST(k + off AS STRING), ' Clube') ELSE concat('Residencial  Vila ', CAST(k + off AS STRING)) END
  WHEN f.field_id = 'buyer.name' THEN CASE WHEN s.source_ord % 2 = 0 THEN concat('Ana Côrtes ', c_name, ' ', CAST(b.n AS STRING)) ELSE concat('ANA CORTES ', c_name, CASE WHEN off > 0 THEN 'x ' ELSE ' ' END, CAST(b.n AS STRING)) END
  ELSE CASE WHEN s.source_ord % 2 = 0 THEN concat(f.field_id, ' ', CAST(k AS STRING)) ELSE upper(concat(f.field_id, '  ', CAST(k + off * 9 AS STRING))) END END AS value
FROM (SELECT c_custkey AS k, c_name FROM {{customer}}) AS c
CROSS JOIN (SELECT *, 0 AS zero FROM {_TEN} AS t(source_ord, source)) AS s
CROSS JOIN (VALUES ('buyer.name', 'texto', 1, '0123'), ('buyer.cpf', 'cpf', 2, '012'), ('buyer.rg', 'rg', 3, '01'), ('buyer.maritalStatus', 'texto', 4, '01'), ('buyer.address', 'endereco', 5, '012'), ('buyer.email', 'email', 6, '0239'), ('buyer.phone', 'telefone', 7, '023'), ('buyer.birthDate', 'data', 8, '01'),
  ('contract.number', 'texto', 9, '01'), ('contract.date', 'data', 10, '018'), ('property.development', 'texto', 11, '01234'), ('property.registration', 'texto', 12, '012345'), ('property.unit', 'identificador_imovel', 13, '01234'), ('property.privateArea', 'area', 14, '012456'), ('property.iptu', 'texto', 15, '12467'), ('seller.legalName', 'texto', 16, '1245'), ('seller.cnpj', 'cnpj', 17, '1245'),
  ('seller.address', 'endereco', 18, '12'), ('financial.totalValue', 'valor_monetario', 19, '0123'), ('financial.fgts', 'valor_monetario', 20, '013'), ('property.registryOffice', 'texto', 21, '156')) AS f(field_id, field_type, nr, held)
CROSS JOIN (VALUES ('buyer_1', 1), ('buyer_2', 2), (CAST(NULL AS STRING), 0)) AS b(participant_id, n)
CROSS JOIN (VALUES (0), (1)) AS o(off)
WHERE instr(f.held, CAST(s.source_ord AS STRING)) > 0 AND (b.participant_id IS NOT NULL) = (f.nr <= 8 AND k % 11 <> 0) AND (coalesce(b.participant_id, '') <> 'buyer_2' OR k % 3 = 0)
  AND o.off = CASE WHEN (k + s.source_ord * 7 + f.nr) % 9 = 0 THEN 1 ELSE 0 END AND (k + s.source_ord + f.nr * 2) % 7 <> 0
"""

#: Which sources take part in a process, whether they could be read, and why not.
PARTICIPATION = f"""
SELECT c_custkey AS process_id, s.source_ord, s.source, (c_custkey + s.source_ord * 3) % 37 = 0 AS failed, CASE WHEN c_custkey % 2 = 0 THEN concat('arquivo ', s.source) END AS error
FROM {{customer}} CROSS JOIN {_TEN} AS s(source_ord, source) WHERE (c_custkey + s.source_ord) % 6 <> 0
"""

#: Fields of a source (field::buyer where a buyer has them) whose documents disagree, or whose evidence doesn't hold them.
MARKS = f"""
SELECT c_custkey AS process_id, s.source, CASE WHEN c_custkey % 11 = 0 THEN m.field_id ELSE m.key END AS field_id, m.kind FROM {{customer}} CROSS JOIN {_TEN} AS s(source_ord, source)
CROSS JOIN (VALUES ('buyer.cpf', 'buyer.cpf::buyer_1', 'conflict', 0), ('financial.totalValue', 'financial.totalValue', 'conflict', 1), ('financial.totalValue', 'financial.totalValue', 'issue', 3), ('buyer.name', 'buyer.name::buyer_2', 'issue', 2)) AS m(field_id, key, kind, source_ord)
WHERE m.source_ord = s.source_ord AND (c_custkey + m.source_ord) % 17 = 0
"""

#: Rules that people have approved.
RULES = """
SELECT 'buyer.maritalStatus' AS field_id, 'MARITAL_STATUS_GENDER' AS rule_kind, 'CASADA || CASADO(A)' AS signature, CAST(1 AS INT) AS occurrence_count
UNION ALL SELECT 'property.development', 'TEXT_ALIAS', concat('CONDOMINIO VILA ', CAST(c_custkey AS STRING), ' || VILA ', CAST(c_custkey AS STRING), ' CLUBE'), CAST(2 + c_custkey % 3 AS INT) FROM {customer} WHERE c_custkey % 4 = 0
"""

#: Three sources name a development; some write only words that many names have, and some another name.
NAMES = """
SELECT c_custkey AS process_id, s.source_ord, s.source, 'property.development' AS field_id, 'texto' AS field_type, CAST(95 AS INT) AS confidence,
  CASE s.source_ord WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Residencial' ELSE concat('Vila ', c_name) END WHEN 1 THEN concat('Condomínio  Vila ', c_name) ELSE CASE WHEN c_custkey % 10 = 7 THEN 'Outra Torre' WHEN c_custkey % 5 = 0 THEN concat('VILA ', upper(c_name)) ELSE concat('Vila ', c_name, ' Clube') END END AS value
FROM {customer} CROSS JOIN (VALUES (0, 'SIOPI'), (1, 'MINUTA'), (2, 'ITBI')) AS s(source_ord, source)
"""

#: Rules about such names, some of them approved many times.
NAME_RULES = """
SELECT 'property.development' AS field_id, 'TEXT_ALIAS' AS rule_kind, concat('CONDOMINIO VILA ', upper(c_name), ' || RESIDENCIAL || VILA ', upper(c_name), CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' CLUBE' END) AS signature, CAST(1 + c_custkey % 3 AS INT) AS occurrence_count
FROM {customer} WHERE c_custkey % 4 <> 1
"""

#: Readers' replies about a customer, each in one of eight forms. < and > stand for braces, ^ for a backslash.
REPLIES = """
SELECT doc_id, form, replace(replace(replace(CASE form WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('Segue o resultado: ', body, ' Espero ter ajudado.') WHEN 3 THEN concat('Lista: [', one, ', ', two, '] fim')
  WHEN 4 THEN concat('<"note": "chaves > e ^" <", "fields": [', one, ', ', two, ']>') WHEN 5 THEN concat('Resultado ', body, ' (use <chaves>] se preciso') WHEN 6 THEN concat('<"fields":[', one, ',<"fieldId":"contract.date","va') ELSE 'não encontrado' END, '<', chr(123)), '>', chr(125)), '^', chr(92)) AS reply
FROM (SELECT doc_id, form, one, two, concat('<"fields":[', one, ',', two, ']>') AS body FROM (
  SELECT c_custkey AS doc_id, CAST(c_custkey % 8 AS INT) AS form, concat('<"fieldId":"buyer.name","value":"', c_name, '","confidence":', CAST(c_custkey % 100 AS STRING), '>') AS one,
    concat('<"fieldId":"buyer.address","value":"<', c_mktsegment, '>","confidence":', CAST(c_custkey % 50 AS STRING), '.5>') AS two FROM {customer}) AS a) AS b
"""

#: A contract and a reservation of each customer, whose texts say more or less.
LAYER_DOCS = """
SELECT c_custkey AS process_id, 'MINUTA' AS source, CAST(0 AS INT) AS doc_ord, concat('Instrumento', CASE WHEN c_custkey % 3 <> 0 THEN concat(chr(10), 'nº do contrato: 8.', CAST(c_custkey AS STRING), '.77') ELSE '' END, CASE WHEN c_custkey % 4 <> 0 THEN concat(chr(10), 'Agência: 1', CAST(c_custkey AS STRING), '-5') ELSE '' END,
  CASE WHEN c_custkey % 5 <> 0 THEN concat(chr(10), 'Valor destinado à aquisição é R$ 2', CAST(c_custkey AS STRING), '.500,00') ELSE '' END) AS text, c_custkey % 11 = 0 AS failed FROM {customer}
UNION ALL SELECT c_custkey, 'DADOS_RESERVA', CAST(1 AS INT), CASE c_custkey % 3 WHEN 1 THEN 'ver matrícula' WHEN 2 THEN 'condição de pagamento' END, false FROM {customer}
"""

#: What models read of them, first and again.
LAYER_READINGS = """
SELECT c_custkey AS process_id, r.source, r.doc_ord, r.layer, r.nth, r.field_id, CAST(NULL AS STRING) AS participant_id, replace(replace(r.value, '#', CAST(c_custkey AS STRING)), '@', c_name) AS value, r.confidence, replace(replace(r.raw, '#', CAST(c_custkey AS STRING)), '@', c_name) AS raw
FROM {customer} CROSS JOIN (VALUES ('MINUTA', 0, 'PROVIDER', 0, 'contract.number', 'P #', 99, 'P #', 1, 0), ('MINUTA', 0, 'PROVIDER', 1, 'buyer.name', '@', 80, 'comprador @', 2, 0), ('MINUTA', 0, 'PROVIDER', 2, 'contract.date', ' ', 80, '', 1, 0), ('MINUTA', 0, 'RECOVERY', 0, 'buyer.name', 'R @', 70, 'R @', 1, 0), ('MINUTA', 0, 'RECOVERY', 1, 'buyer.cpf', '000.000.0#', 70, 'CPF 000.000.0#', 1, 0),
  ('MINUTA', 0, 'RECOVERY', 2, 'contract.agencyCode', 'R#', 70, 'R#', 1, 0), ('MINUTA', 0, 'RECOVERY', 3, 'signature.city', 'Fortaleza', 70, 'Fortaleza', 1, 0), ('DADOS_RESERVA', 1, 'FOCUSED', 0, 'buyer.name', '@', 90, 'cliente @', 2, 0), ('DADOS_RESERVA', 1, 'FOCUSED', 1, 'financial.totalValue', 'R$ 5#,00', 88, 'valor total R$ 5#,00', 5, 1), ('DADOS_RESERVA', 1, 'FOCUSED', 2, 'financial.financing', 'R$ 4#,00', 88, 'financiamento R$ 4#,00', 7, 0),
  ('DADOS_RESERVA', 1, 'PAYMENT', 0, 'financial.totalValue', 'R$ 6#,00', 99, 'valor do contrato R$ 6#,00', 1, 0), ('DADOS_RESERVA', 1, 'PAYMENT', 1, 'financial.financing', 'R$ 7#,00', 99, 'sem o valor', 1, 0), ('DADOS_RESERVA', 1, 'SUMMARY', 0, 'financial.subsidy', 'R$ 1,00', 99, 'subsidio R$ 1,00', 1, 0), ('DADOS_RESERVA', 1, 'IDENTITY', 0, 'buyer.cpf', '000.000.0#', 80, 'cpf 000.000.0#', 1, 0),
  ('DADOS_RESERVA', 1, 'UNIT', 0, 'property.unit', '10#', 80, 'unidade 10#', 1, 0), ('DADOS_RESERVA', 1, 'UNIT', 1, 'property.registration', '77#', 80, 'matrícula 77#', 1, 0), ('DADOS_RESERVA', 1, 'UNIT', 2, 'property.development', 'Vila Sol', 80, 'vila sol', 1, 0), ('DADOS_RESERVA', 1, 'GENERIC', 0, 'property.tower', 'Torre Norte', 60, 'torre norte', 1, 0)) AS r(source, doc_ord, layer, nth, field_id, value, confidence, raw, every, rest)
WHERE CASE WHEN r.rest = 0 THEN c_custkey % r.every = 0 ELSE c_custkey % r.every <> 0 END AND (r.layer <> 'PROVIDER' OR c_custkey % 11 <> 0)
"""

PROCESSES = """
SELECT o_orderkey AS process_id, o_custkey AS user_id, n_regionkey AS organization_id, o_orderdate AS started_at, o_orderkey % 45 AS minutes,
  CASE WHEN o_orderkey % 97 = 0 THEN 'FAILED' WHEN o_orderstatus = 'F' THEN 'FULLY_CHECKED' WHEN o_orderstatus = 'P' THEN 'PENDING_REVIEW' ELSE 'IN_PROGRESS' END AS final_status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

PROFILES = """
SELECT c_custkey AS user_id, n_regionkey AS organization_id, CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'ANALYST' END AS role, c_custkey % 500 = 0 AS is_master
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

DOCUMENTS = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS document_id, l_orderkey AS process_id, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN 'SIOPI' WHEN 1 THEN 'MINUTA' WHEN 2 THEN 'ITBI' ELSE 'DADOS_RESERVA' END AS source, l_shipdate AS created_at, l_partkey AS part,
  CASE WHEN l_linenumber <> 5 THEN concat('files/', CAST(l_partkey AS STRING)) END AS storage_path, CASE WHEN l_orderkey % 31 = 0 THEN l_shipdate END AS purged_at, CAST(l_suppkey % 3 AS INT) AS purge_attempts, l_suppkey % 5 AS organization_id
FROM {lineitem}
"""

AUDIT = """
SELECT event_id, ts AS created_at, CASE WHEN event_id % 11 <> 0 THEN user_id END AS actor_id, CASE WHEN event_id % 22 <> 0 THEN concat('e', CAST(user_id AS STRING)) END AS entity_id, value, CASE WHEN event_id % 1999 = 0 THEN 'DOCUMENT_RETENTION_FAILED' ELSE CASE event_type WHEN 'click' THEN 'LOGIN' WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'view' THEN 'DOCUMENT_VIEWED' WHEN 'purchase' THEN 'PROCESS_CREATED' ELSE 'USER_CREATED' END END AS event_type
FROM {events}
"""

#: The audit log with bursts: keys decide which events come many times over, seconds apart.
BURSTS = f"""
SELECT a.event_id * 100 + t.n * 10 + o.n AS event_id, a.event_type, a.actor_id, a.entity_id, a.created_at + (t.n * 10 + o.n) * INTERVAL '20' SECOND AS created_at
FROM ({AUDIT}) AS a CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(n) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS o(n)
WHERE t.n * 10 + o.n < CASE WHEN a.event_type = 'LOGIN_FAILED' AND a.event_id % 5 = 0 THEN 4 WHEN a.event_type = 'DOCUMENT_VIEWED' AND a.event_id % 8 = 0 THEN 60 WHEN a.event_type = 'PROCESS_CREATED' AND a.event_id % 9 = 0 THEN 30 ELSE 1 END
"""

#: What a process tells of itself: steps, mostly in their order, and heartbeats between them. A customer is a process.
SIGNS = """
SELECT o_custkey AS process_id, o_orderkey AS event_id, TIMESTAMP '2024-01-01 00:00:00' + ((o_orderkey * 7919) % 600) * INTERVAL '1' SECOND AS told_at,
  CASE WHEN o_orderkey % 5 < 2 THEN 'HEARTBEAT' WHEN o_orderkey % 17 = 0 THEN 'EXTRACTING' WHEN (o_orderkey * 7919) % 600 < 120 THEN 'PENDING' WHEN (o_orderkey * 7919) % 600 < 260 THEN 'EXTRACTING' WHEN (o_orderkey * 7919) % 600 < 480 THEN 'COMPARING' WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'DONE' END AS status
FROM {orders}
"""

#: Attempts at reading registries: users are uploads, and their events start and end attempts in any order.
ATTEMPTS = """
SELECT event_id, concat('u', CAST(user_id % 60 AS STRING)) AS upload, CASE event_type WHEN 'click' THEN 'DEVELOPMENT_EXTRACTION_STARTED' WHEN 'view' THEN 'DEVELOPMENT_EXTRACTION_FINISHED' WHEN 'error' THEN 'DEVELOPMENT_EXTRACTION_FAILED' ELSE 'REVIEW_APPROVED' END AS event_type, ts AS created_at,
  CASE event_type WHEN 'click' THEN 'EXTRACTION' WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'XLSX_PARSER' ELSE 'RECONCILIATION' END ELSE CASE event_id % 3 WHEN 0 THEN 'VALIDATION' WHEN 1 THEN 'RENDERING' ELSE 'UNEXPECTED' END END AS stage, CAST(event_id % 9 AS INT) AS page_count FROM {events}
"""

#: Requests to open a document, some of them of another process than its own.
OPENINGS = """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS process_id, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS document_id FROM {lineitem}
"""

#: How the sources of a process were read.
METHODS = """
SELECT c_custkey AS process_id, s.source_ord, s.source, CASE WHEN (c_custkey + s.source_ord) % 9 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status, CASE WHEN c_custkey % 2 = 0 THEN concat('erro ', CAST(c_custkey AS STRING)) END AS error, CASE (c_custkey * 3 + s.source_ord) % 7 WHEN 0 THEN 'OCR' WHEN 1 THEN 'MIXED' ELSE 'TEXT' END AS method
FROM {customer} CROSS JOIN (VALUES (0, 'SIOPI'), (1, 'MINUTA'), (2, 'ITBI')) AS s(source_ord, source)
"""

#: What a process can be found by: its code, its analyst, its documents' names and its values.
HISTORY = f"""
SELECT o_orderkey AS process_id, concat('OP-', CAST(o_orderkey AS STRING)) AS text FROM {{orders}} UNION ALL SELECT o_orderkey, c_name FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION ALL SELECT l_orderkey, concat('Contrato ', CAST(l_partkey AS STRING), '.pdf') FROM {{lineitem}} UNION ALL SELECT process_id, value FROM ({EVIDENCE}) AS e
"""

#: Reviews that approve an equivalence of two names; keys decide on ones without a signature.
APPROVED = """
SELECT c_nationkey AS organization_id, 'property.development' AS field_id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('RESIDENCIAL ', c_mktsegment, ' || VILA ', c_mktsegment) END AS signature, 'TEXT_ALIAS' AS rule_kind, o_orderpriority AS example, o_orderkey AS process_id, o_custkey AS reviewer_id, o_orderdate AS at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: Reviews in the order they were made: each settles one field, or takes its review back.
REVIEW_LOG = """
SELECT l.doc_id AS process_id, f.field_id, f.seq, l.doc_id % 7 AS reviewer_id, CASE WHEN (l.doc_id + f.seq) % 4 = 0 THEN 'REVOKED' WHEN l.quality = 1 OR f.seq = 1 THEN 'APPROVED' ELSE 'REJECTED' END AS action
FROM {labels} AS l CROSS JOIN (VALUES ('financial.totalValue', 1), ('buyer.name', 2), ('contract.date', 3), ('financial.totalValue', 4), ('property.type', 5)) AS f(field_id, seq) WHERE l.doc_id IS NOT NULL
"""

#: Two readers of one registry: the first reads some units twice; the second misses tenths, reads other areas and finds units of its own.
UNITS_OCR = """
SELECT p_brand AS tower, CAST(p_partkey AS STRING) AS unit, CASE WHEN p_partkey % 2 = 0 THEN concat('Tipo ', CAST(p_partkey AS STRING)) END AS typology, replace(CAST(CAST(p_retailprice AS DECIMAL(20,2)) + t.seq AS STRING), '.', ',') AS private_area,
  CASE WHEN p_partkey % 3 = 0 THEN '10,50' END AS common_area, replace(CAST(CAST(p_retailprice AS DECIMAL(20,2)) + 20 AS STRING), '.', ',') AS total_area, CASE WHEN p_partkey % 5 <> 0 THEN '0,0123' END AS ideal_fraction, concat('IPTU ', CAST(p_partkey AS STRING)) AS iptu,
  CAST(70 + p_partkey % 30 AS INT) AS confidence, t.seq FROM {part} CROSS JOIN (VALUES (0), (1)) AS t(seq) WHERE t.seq = 0 OR p_partkey % 8 = 0
"""
UNITS_VISION = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS tower, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE CAST(p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 10000000 ELSE 0 END AS STRING) END AS unit, CASE WHEN p_partkey % 2 = 0 THEN concat('TIPO  ', CAST(p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 10000000 ELSE 0 END AS STRING)) END AS typology,
  replace(CAST(CAST(p_retailprice AS DECIMAL(20,2)) + CASE WHEN p_partkey % 8 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END AS STRING), '.', ',') AS private_area, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 33 = 0 THEN '11,50' ELSE '10,50' END END AS common_area,
  replace(CAST(CAST(p_retailprice AS DECIMAL(20,2)) + 20 AS STRING), '.', ',') AS total_area, CASE WHEN p_partkey % 5 <> 0 OR p_partkey % 35 = 0 THEN '0,0123' END AS ideal_fraction, concat('iptu-', CAST(p_partkey AS STRING)) AS iptu, CAST(75 + p_partkey % 25 AS INT) AS confidence FROM {part} WHERE p_partkey % 10 <> 0
"""

#: Developments and which of them a unit belongs to.
DEVELOPMENTS = """
SELECT s_suppkey AS development_id, s_nationkey % 5 AS organization_id, CASE WHEN s_suppkey % 9 = 0 THEN 'Empreendimento sem nome' ELSE concat('Residencial ', s_name) END AS name, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey * 1000 AS STRING) END AS development_registration,
  CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE concat(s_name, ' LTDA') END AS seller_name, lpad(CAST(s_suppkey AS STRING), 14, '0') AS seller_cnpj FROM {supplier}
"""
UNITS = """
SELECT CAST(floor((p_partkey - 1) / 20) AS BIGINT) + 1 AS development_id, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('T', CAST(p_partkey % 12 AS STRING)) END AS tower, CAST(p_partkey AS STRING) AS unit, CASE WHEN p_partkey % 2 = 0 THEN concat('Tipo ', CAST(p_partkey % 3 AS STRING)) END AS typology,
  CAST(CAST(p_retailprice AS DECIMAL(20,2)) AS STRING) AS private_area, CAST(NULL AS STRING) AS common_area, CASE WHEN p_partkey % 4 = 0 THEN '99' END AS total_area, '0,01' AS ideal_fraction, concat('I', CAST(p_partkey AS STRING)) AS iptu, CASE WHEN p_partkey % 7 = 0 THEN concat('R', CAST(p_partkey AS STRING)) END AS registration, CAST(80 + p_partkey % 20 AS INT) AS confidence FROM {part}
"""


#: What two documents of a source say of each field, with the text they say it in: keys decide on other values, missing and empty texts.
CANDIDATES = f"""
SELECT process_id, source_ord, source, doc_ord, field_id, field_type, participant_id, confidence, value, CASE WHEN process_id % 6 = 0 THEN '' WHEN process_id % 5 = 0 THEN 'nada aqui' ELSE concat(CASE WHEN process_id % 3 = 0 THEN 'valor do contrato ' ELSE 'texto ' END, coalesce(value, '')) END AS raw
FROM (SELECT process_id, source_ord, source, d.doc_ord, field_id, field_type, CASE WHEN field_id = 'buyer.name' AND process_id % 4 = 0 THEN 'buyer_2' END AS participant_id, confidence - d.doc_ord AS confidence, CASE WHEN d.doc_ord = 1 AND process_id % 10 = 7 AND value IS NOT NULL THEN concat(value, '7') ELSE value END AS value
  FROM ({EVIDENCE}) AS e CROSS JOIN (VALUES (0), (1)) AS d(doc_ord)) AS c
"""

#: A reader's raw output: unknown fields, repeated ones, buyers with and without names, confidences of all kinds.
OUTPUT = """
SELECT c_custkey AS doc_id, o.ord, o.field_id, CASE WHEN o.ord = 5 THEN NULL ELSE concat(c_name, CAST(o.ord AS STRING)) END AS value, o.confidence, o.participant_id, o.page, concat('  trecho ', c_name) AS raw FROM {customer}
CROSS JOIN (VALUES (1, 'buyer.name', '0.87', CAST(NULL AS STRING), 2.0), (2, 'buyer.name', '150', ' Co Buyer! ', 1.5), (3, 'contract.number', '64.5', 'x', 0.0), (4, 'contract.number', '99', 'y', 3.0), (5, 'contract.date', 'muito', CAST(NULL AS STRING), -1.0), (6, 'no.such', '88', CAST(NULL AS STRING), 1.0), (7, 'buyer.cpf', '-4', '', 4.0)) AS o(ord, field_id, confidence, participant_id, page)
WHERE o.ord <> 2 OR c_custkey % 2 = 0
"""


#: Orders with their customers, where a mapping says so.
_ORDERS_JOINED = "{orders} JOIN {customer} ON o_custkey = c_custkey"
#: Mappings that make many rows of a customer or an order, or long ones.
MULTIPLIED = (EVIDENCE, WIDE_EVIDENCE, PARTICIPATION, MARKS, NAMES, REPLIES, LAYER_DOCS, LAYER_READINGS, METHODS, CANDIDATES, HISTORY, OUTPUT)


def read(spark: SparkSession, sf_dir: str, mapping: str) -> DataFrame:
    """A canonical table: the mapping over the Parquet tables it names.

    Where it makes many rows of one, customers, or orders with their customers,
    are dealt out by their key before. So all tasks make rows, and what is made
    lies by process: what groups or joins it by process moves none of it.
    """
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    given = {}
    if mapping in MULTIPLIED and _ORDERS_JOINED in mapping:
        both = spark.sql(f"SELECT * FROM {_ORDERS_JOINED}", orders=table("orders"), customer=table("customer"))
        mapping, given["joined"] = mapping.replace(_ORDERS_JOINED, "{joined}"), spread(both, "o_orderkey")
    elif mapping in MULTIPLIED:
        given["customer"] = spread(table("customer"), "c_custkey")
    names = [n for n in ("orders", "customer", "nation", "lineitem", "events", "labels", "part", "supplier") if "{" + n + "}" in mapping and n not in given]
    return spark.sql(mapping, **given, **{n: table(n) for n in names})


def duck(mapping: str) -> str:
    """The mapping as a DuckDB subquery."""
    return "(" + mapping.replace("{", "").replace("}", "") + ")"
