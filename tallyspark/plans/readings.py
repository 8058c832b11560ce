"""Registered queries of rules in the ladder, layered readings and tolerant parsing, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.operators import attempts, layers, reconcile, replies, searching
from tallyspark.sources import adapters as a
from tallyspark.sources import storage

_DEVELOPMENT = ["property.development", "buyer.maritalStatus"]


def reconcile_learned(spark, sf_dir):
    """The ladder with rules that people have approved, over names of which some keep no word of their own."""
    processes = a.read(spark, sf_dir, a.NAMES).select("process_id").distinct()
    none = F.array().cast("array<string>")
    context = processes.select("process_id", F.array(*map(F.lit, ["SIOPI", "MINUTA", "ITBI"])).alias("participating"), none.alias("unreadable"), none.alias("conflicts"), none.alias("issues"))
    found = reconcile.reconcile(a.read(spark, sf_dir, a.NAMES), context, _DEVELOPMENT, a.read(spark, sf_dir, a.NAME_RULES))
    return found.where("field_id = 'property.development'").select("process_id", "status", "rung", F.when(F.col("status") == "MATCH", F.col("observation")).alias("observation"))


def replies_read(spark, sf_dir):
    """Fields of replies in fences, in chatty text, with braces in strings, and cut off."""
    read = a.read(spark, sf_dir, a.REPLIES).select("doc_id", replies.read_fields(F.col("reply")).alias("r"))
    return read.select("doc_id", "r.how", F.posexplode_outer("r.fields").alias("nth", "f")).select("doc_id", "how", "nth", "f.field_id", "f.value", "f.confidence")


def _layered(spark, sf_dir) -> DataFrame:
    return layers.layered(a.read(spark, sf_dir, a.LAYER_DOCS), a.read(spark, sf_dir, a.LAYER_READINGS), sources=["MINUTA", "DADOS_RESERVA"])


def layered_report(spark, sf_dir):
    """What patterns read of each text, what was asked for again, what that gave, and which images were read again."""
    lists = ("deterministic", "asked", "recovered", "reread")
    return _layered(spark, sf_dir).select("process_id", "source", *[F.array_join(c, ",").alias(c) for c in lists])


def layered_fields(spark, sf_dir):
    """The reading of each field that counts."""
    return layers.chosen_rows(_layered(spark, sf_dir)).select("process_id", "source", "layer", "field_id", "value")


def extraction_attempts(spark, sf_dir):
    """Attempts at each upload with their ends, open and repeated ones, and ends without a start."""
    return attempts.attempts(a.read(spark, sf_dir, a.ATTEMPTS))


def extraction_attempt_totals(spark, sf_dir):
    return attempts.attempt_totals(attempts.attempts(a.read(spark, sf_dir, a.ATTEMPTS)))


_VIEWER = {"is_master": False, "role": "ADMIN", "organization_id": 2, "user_id": 50}


def documents_opened(spark, sf_dir):
    return attempts.opened(*[a.read(spark, sf_dir, m) for m in (a.OPENINGS, a.PROCESSES, a.DOCUMENTS)], _VIEWER)


def documents_opened_audit(spark, sf_dir):
    return attempts.opening_events(documents_opened(spark, sf_dir), _VIEWER)


def method_notices(spark, sf_dir):
    return attempts.method_notices(a.read(spark, sf_dir, a.METHODS))


def history_indexed(spark, sf_dir):
    """A search over codes, analysts, document names and values by the index of trigrams."""
    path = storage.new_path(spark, "history")
    searching.build(a.read(spark, sf_dir, a.HISTORY), "process_id", path)
    return searching.search(spark, path, "process_id", "contrato  12")


# The helpers of this SQL (text, development) are those of the other registered queries.
def sql() -> dict[str, str]:
    from tallyspark.plans.oracle import _KW, _MONEY, development, text

    first = "SELECT c_custkey AS doc_id, how, 0 AS nth, 'buyer.name' AS field_id, c_name AS value, CAST(c_custkey % 100 AS DOUBLE) AS confidence"
    forms = "(SELECT *, ['WHOLE', 'WHOLE', 'OBJECT', 'LIST', 'WHOLE', 'SCANNED', 'SALVAGED', NULL][c_custkey % 8 + 1] AS how FROM customer)"
    joined = lambda c: f"array_to_string(list_sort(list_filter({c}, lambda f: f IS NOT NULL)), ',')"
    minuta = "[" + ", ".join(f"'{f}'" for f in catalog.CRITICAL["MINUTA"].split()) + "]"
    # What the two tables of readings hold for a customer k: patterns, the model, rereading; then the groups of a reservation.
    contract = f"""m AS (SELECT c_custkey AS k, c_name, k % 11 = 0 AS failed, [CASE WHEN k % 3 <> 0 THEN 'contract.number' END, CASE WHEN k % 4 <> 0 THEN 'contract.agencyCode' END, CASE WHEN k % 5 <> 0 THEN 'financial.totalValue' END] AS d,
          CASE WHEN k % 11 = 0 THEN [] WHEN k % 2 = 0 THEN ['contract.number', 'buyer.name'] ELSE ['contract.number'] END AS p FROM customer),
        ma AS (SELECT *, CASE WHEN failed THEN [] ELSE list_filter({minuta}, lambda f: NOT list_contains(d, f) AND NOT list_contains(p, f)) END AS asked FROM m),
        mr AS (SELECT *, list_filter(asked, lambda f: f IN ('buyer.name', 'buyer.cpf', 'contract.agencyCode')) AS recovered FROM ma)"""
    images = """g AS (SELECT c_custkey AS k, c_name, k % 2 = 0 AS fn, k % 5 <> 0 AS ft, k % 7 = 0 AS ff, k % 3 = 1 AS su, k % 3 = 2 AS pay FROM customer),
        ga AS (SELECT *, CASE WHEN su THEN ['unit'] WHEN pay THEN CASE WHEN ft AND ff THEN [] ELSE ['payment'] END WHEN fn OR ft OR ff THEN list_filter([CASE WHEN fn THEN 'identity' END, CASE WHEN ft <> ff THEN 'payment' END], lambda x: x IS NOT NULL) ELSE ['identity', 'payment', 'unit'] END AS found FROM g),
        gb AS (SELECT *, CASE WHEN NOT (fn OR ft OR ff) AND NOT list_contains(found, 'payment') THEN list_append(found, 'payment') ELSE found END AS asked FROM ga),
        gc AS (SELECT *, CASE WHEN pay THEN NOT (ft AND ff) ELSE list_contains(asked, 'payment') END AS rp, list_contains(asked, 'identity') AS ri, list_contains(asked, 'unit') AS ru FROM gb),
        gd AS (SELECT *, len(asked) > 0 AND CASE WHEN su THEN true WHEN pay THEN NOT (ff AND (ft OR rp)) ELSE fn OR ri OR ru OR ((ft OR ff OR rp) AND NOT (ff AND (ft OR rp))) OR NOT (fn OR ft OR ff OR rp OR ri OR ru) END AS rg FROM gc),
        ge AS (SELECT *, [CASE WHEN rp AND NOT ft THEN 'financial.totalValue' END, CASE WHEN ri THEN 'buyer.cpf' END, CASE WHEN ru THEN 'property.unit' END, CASE WHEN ru THEN 'property.registration' END, CASE WHEN ru THEN 'property.development' END, CASE WHEN rg THEN 'property.tower' END] AS recovered FROM gd)"""
    some = lambda cond, layer, field, value: f"SELECT k AS process_id, 'DADOS_RESERVA' AS source, '{layer}' AS layer, '{field}' AS field_id, {value} AS value FROM ge WHERE {cond}"
    of = lambda cond, layer, field, value: f"SELECT k AS process_id, 'MINUTA' AS source, '{layer}' AS layer, '{field}' AS field_id, {value} AS value FROM mr WHERE {cond}"
    tried = f"""WITH e AS (SELECT *, event_type = 'DEVELOPMENT_EXTRACTION_STARTED' AS begins, row_number() OVER (PARTITION BY upload ORDER BY created_at, event_id) AS rn FROM {a.duck(a.ATTEMPTS)} AS x WHERE event_type <> 'REVIEW_APPROVED'),
        l AS (SELECT *, max(CASE WHEN begins THEN rn END) OVER w AS ls, max(CASE WHEN NOT begins THEN rn END) OVER w AS le, max(CASE WHEN begins THEN rn END) OVER (PARTITION BY upload) AS last_start FROM e WINDOW w AS (PARTITION BY upload ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        x AS (SELECT *, ls IS NOT NULL AND (le IS NULL OR le < ls) AS fits FROM l WHERE NOT begins),
        b AS (SELECT s.upload, s.rn, s.created_at AS started_at, x.created_at AS ended_at, CASE WHEN x.rn IS NOT NULL THEN split_part(x.event_type, '_', 3) WHEN s.rn < s.last_start THEN 'REPEATED' ELSE 'OPEN' END AS outcome, coalesce(x.stage, s.stage) AS stage, coalesce(x.page_count, s.page_count) AS page_count
            FROM l AS s LEFT JOIN x ON x.upload = s.upload AND x.fits AND x.ls = s.rn WHERE s.begins
          UNION ALL SELECT upload, rn, NULL, created_at, split_part(event_type, '_', 3), stage, page_count FROM x WHERE NOT fits),
        t AS (SELECT upload, CAST(row_number() OVER (PARTITION BY upload ORDER BY rn) AS INT) AS attempt, started_at, ended_at, outcome, stage, page_count, epoch_us(ended_at) // 1000 - epoch_us(started_at) // 1000 AS duration_ms FROM b)"""
    opening = f"""(SELECT r.request_id, r.process_id, r.document_id, CASE WHEN p.process_id IS NULL THEN 'Processo não encontrado.' WHEN coalesce(d.storage_path, '') = '' THEN CASE WHEN d.purged_at IS NOT NULL THEN 'Arquivo original removido após o período de retenção de 40 dias.' ELSE 'O arquivo original não está disponível.' END END AS message, d.storage_path
        FROM {a.duck(a.OPENINGS)} AS r LEFT JOIN (SELECT process_id FROM {a.duck(a.PROCESSES)} AS y WHERE organization_id = 2) AS p ON p.process_id = r.process_id
        LEFT JOIN (SELECT * FROM {a.duck(a.DOCUMENTS)} AS z WHERE organization_id = 2) AS d ON d.process_id = r.process_id AND d.document_id = r.document_id)"""
    label = "CASE source " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in catalog.SOURCES.items()) + " END"
    return {
        "extraction_attempts": tried + "SELECT * FROM t",
        "extraction_attempt_totals": tried + "SELECT outcome, stage, count(*) AS n, CAST(floor(avg(duration_ms)) AS BIGINT) AS mean_ms FROM t GROUP BY outcome, stage",
        "documents_opened": f"SELECT request_id, process_id, document_id, CASE WHEN message IS NULL THEN storage_path END AS storage_path, message FROM {opening} AS o",
        "documents_opened_audit": f"SELECT CAST(2 AS BIGINT) AS organization_id, '50' AS actor_id, 'DOCUMENT_VIEWED' AS event_type, 'process_document' AS entity_type, document_id AS entity_id, process_id FROM {opening} AS o WHERE message IS NULL",
        "method_notices": f"""SELECT process_id, CASE WHEN n > 0 THEN errors ELSE images || ' exigiu OCR porque o PDF tinha pouco ou nenhum texto selecionável.' END AS notice FROM (
            SELECT process_id, count(*) FILTER (WHERE status = 'FAILED' AND error IS NOT NULL) AS n, string_agg({label} || ': ' || error, chr(10) ORDER BY source_ord) FILTER (WHERE status = 'FAILED' AND error IS NOT NULL) AS errors,
              string_agg({label}, ', ' ORDER BY source_ord) FILTER (WHERE method IN ('OCR', 'MIXED')) AS images FROM {a.duck(a.METHODS)} AS m GROUP BY process_id) AS q WHERE n > 0 OR images IS NOT NULL""",
        "history_indexed": f"SELECT DISTINCT process_id FROM (SELECT process_id, {_KW} AS k FROM (SELECT process_id, coalesce(text, '') AS t FROM {a.duck(a.HISTORY)} AS h) AS x) AS y WHERE contains(k, 'contrato 12')",
        "layered_report": f"""WITH {contract}, {images} SELECT k AS process_id, 'MINUTA' AS source, {joined("d")} AS deterministic, {joined("asked")} AS asked, {joined("recovered")} AS recovered, '' AS reread FROM mr
            UNION ALL SELECT k, 'DADOS_RESERVA', '', {joined("asked")}, {joined("recovered")}, array_to_string(list_filter([CASE WHEN rp THEN 'PAYMENT' END, CASE WHEN ri THEN 'IDENTITY' END, CASE WHEN ru THEN 'UNIT' END, CASE WHEN rg THEN 'GENERIC' END], lambda x: x IS NOT NULL), ',') FROM ge""",
        "layered_fields": f"WITH {contract}, {images} " + " UNION ALL ".join([
            of("k % 3 <> 0", "DETERMINISTIC", "contract.number", "'8.' || k || '.77'"), of("k % 4 <> 0", "DETERMINISTIC", "contract.agencyCode", "'1' || k || '-5'"), of("k % 5 <> 0", "DETERMINISTIC", "financial.totalValue", "'R$ 2' || k || '.500,00'"),
            of("k % 3 = 0 AND NOT failed", "PROVIDER", "contract.number", "'P ' || k"), of("k % 2 = 0 AND NOT failed", "PROVIDER", "buyer.name", "c_name"), of("list_contains(recovered, 'buyer.name')", "RECOVERY", "buyer.name", "'R ' || c_name"),
            of("list_contains(recovered, 'buyer.cpf')", "RECOVERY", "buyer.cpf", "'000.000.0' || k"), of("list_contains(recovered, 'contract.agencyCode')", "RECOVERY", "contract.agencyCode", "'R' || k"),
            some("fn", "FOCUSED", "buyer.name", "c_name"), some("ft AND NOT rp", "FOCUSED", "financial.totalValue", "'R$ 5' || k || ',00'"), some("rp", "PAYMENT", "financial.totalValue", "'R$ 6' || k || ',00'"), some("ff", "FOCUSED", "financial.financing", "'R$ 4' || k || ',00'"),
            some("ri", "IDENTITY", "buyer.cpf", "'000.000.0' || k"), some("ff AND (ft OR rp)", "CALCULATED", "financial.downPayment", _MONEY("CAST(CASE WHEN rp THEN '6' ELSE '5' END || k AS BIGINT) - CAST('4' || k AS BIGINT)")), some("ru", "UNIT", "property.unit", "'10' || k"), some("ru", "UNIT", "property.registration", "'77' || k"), some("ru", "UNIT", "property.development", "'Vila Sol'"), some("rg", "GENERIC", "property.tower", "'Torre Norte'"),
        ]),
        "replies_read": f"""{first} FROM {forms} AS x WHERE how IS NOT NULL UNION ALL SELECT c_custkey, how, 1, 'buyer.address', '{{' || c_mktsegment || '}}', c_custkey % 50 + 0.5 FROM {forms} AS x WHERE how <> 'SALVAGED'
            UNION ALL SELECT c_custkey, how, NULL, NULL, NULL, NULL FROM {forms} AS x WHERE how IS NULL""",
        "reconcile_learned": f"""WITH v AS (SELECT process_id, source_ord, {text("value")} AS t FROM {a.duck(a.NAMES)} AS n),
            d AS (SELECT process_id, t, {development("t")} AS g FROM v),
            p AS (SELECT process_id, array_to_string(list_sort(list_distinct(list(t))), ' || ') AS signature, count(DISTINCT g) AS n_groups, count(DISTINCT g) FILTER (WHERE g <> '') AS n_worded, count(*) FILTER (WHERE g <> '') AS worded, count(DISTINCT t) AS n_plain, list(DISTINCT g) AS gs FROM d GROUP BY process_id),
            r AS (SELECT signature, max(occurrence_count) AS n FROM {a.duck(a.NAME_RULES)} AS x GROUP BY signature),
            far AS (SELECT process_id, bool_and(1 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y)) >= 0.86) AS small FROM (SELECT process_id, unnest(gs) AS x, gs FROM p), LATERAL (SELECT unnest(gs) AS y) AS u WHERE x < y GROUP BY process_id),
            s AS (SELECT p.process_id, CASE WHEN n_groups = 1 THEN 6 WHEN worded >= 2 AND n_worded = 1 AND n_plain > 1 THEN 7 WHEN far.small THEN 8 ELSE 9 END AS rung, r.n FROM p LEFT JOIN r ON r.signature = p.signature LEFT JOIN far ON far.process_id = p.process_id)
            SELECT process_id, CASE WHEN rung IN (6, 7) THEN 'MATCH' WHEN rung = 8 THEN 'REVIEW_REQUIRED' ELSE 'DIVERGENCE' END AS status, rung,
              CASE WHEN rung = 6 THEN 'Valores equivalentes após normalização.' WHEN rung = 7 AND n IS NULL THEN 'Valores equivalentes: variação textual já normalizada para este campo.'
                WHEN rung = 7 AND n = 1 THEN 'Valores equivalentes por aprendizado supervisionado (1 validação humana anterior).' WHEN rung = 7 THEN 'Valores equivalentes por aprendizado supervisionado (' || n || ' validaçãoões humanas anteriores).' END AS observation FROM s""",
    }


QUERIES = {f.__name__: f for f in (reconcile_learned, replies_read, layered_report, layered_fields, extraction_attempts, extraction_attempt_totals, documents_opened, documents_opened_audit, method_notices, history_indexed)}
