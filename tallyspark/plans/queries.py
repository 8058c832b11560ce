"""The registered queries of the reconciliation engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions import normalize as n
from tallyspark.operators import deeds, evidence, extract, ops, reconcile, registry, textops, uploads
from tallyspark.plans import readings, streams
from tallyspark.plans.oracle import KEYWORDS, WIDE_FIELDS
from tallyspark.sources import adapters as a
from tallyspark.sources import office, storage
from tallyspark.streaming import alerts, keyed

FIELDS = ["buyer.name", "financial.totalValue", "contract.date", "property.type", "financial.fgts"]
FOUR = list(catalog.SOURCES)[:4]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _evidence(spark, sf_dir) -> DataFrame:
    return a.read(spark, sf_dir, a.EVIDENCE)


def _context(spark, sf_dir, marked: bool) -> DataFrame:
    flags = a.read(spark, sf_dir, a.CONTEXT)
    some = lambda c, v: F.when(F.col(c) & F.lit(marked), F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    return flags.select("process_id", F.array(*map(F.lit, FOUR)).alias("participating"), some("itbi_unreadable", "ITBI").alias("unreadable"), some("total_conflict", "SIOPI:financial.totalValue").alias("conflicts"), some("total_issue", "MINUTA:financial.totalValue").alias("issues"))


def _verdicts(spark, sf_dir) -> DataFrame:
    return reconcile.reconcile(_evidence(spark, sf_dir), _context(spark, sf_dir, True), FIELDS)


def _sides(spark, sf_dir, field: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).where(F.col("field_id") == field).withColumn("norm", n.field_value("value", F.col("field_type"), F.col("field_id")))
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("norm")))
    return rows.groupBy("process_id").agg(pick("SIOPI").alias("x"), pick("MINUTA").alias("y")).where("x != '' and y != '' and x != y")


def norm_dispatch(spark, sf_dir):
    return _evidence(spark, sf_dir).select("process_id", "source", "field_id", n.field_value("value", F.col("field_type"), F.col("field_id")).alias("norm"))


def norm_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(n.text("text"), 256).alias("norm"))


def norm_digits(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(n.digits("text"), 256).alias("norm"))


def norm_area(spark, sf_dir):
    return a.read(spark, sf_dir, a.UNITS_OCR).select("unit", n.area(F.concat("private_area", F.lit(" m²"))).alias("norm"))


def norm_identifier(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", n.property_identifier(F.concat(F.lit("Torre 0"), "p_partkey", F.lit(" Bloco "), "p_brand")).alias("norm"))


def norm_address(spark, sf_dir):
    full = F.concat(F.lit("Avenida "), "c_name", F.lit(", Nº "), "c_custkey", F.lit(", Apto 3, Rua R. É N."))
    return _table(spark, sf_dir, "customer").select("c_custkey", n.address(full).alias("norm"))


def norm_email(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", n.email(F.concat(F.lit(" "), F.upper(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@EXAMPLE.com "))).alias("norm"))


def reconcile_basic(spark, sf_dir):
    total = _evidence(spark, sf_dir).where("field_id = 'financial.totalValue'")
    return reconcile.reconcile(total, _context(spark, sf_dir, False), ["financial.totalValue"]).select("process_id", "field_id", "status", "rung")


def reconcile_full(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("process_id", "field_id", "status", "rung", "observation")


def reconcile_summary(spark, sf_dir):
    return reconcile.summary(_verdicts(spark, sf_dir), "field_id")


def missing_by_source(spark, sf_dir):
    return reconcile.missing_by_source(_verdicts(spark, sf_dir), _context(spark, sf_dir, True))


def _reviews(spark, sf_dir) -> DataFrame:
    return ops.review_state(a.read(spark, sf_dir, a.REVIEW_LOG))


def report_filter(spark, sf_dir):
    return reconcile.report(_verdicts(spark, sf_dir), _reviews(spark, sf_dir), "DIVERGENCES").where(F.contains(F.lower("observation"), F.lit("minuta"))).select("process_id", "field_id", "observation")


def final_status_refresh(spark, sf_dir):
    return ops.final_status(_verdicts(spark, sf_dir), _reviews(spark, sf_dir))


def diff_tokens(spark, sf_dir):
    each = _verdicts(spark, sf_dir).where("diff is not null").select("process_id", "field_id", F.explode("diff").alias("d"))
    return each.select("process_id", "field_id", "d.source", F.array_join("d.tokens", " ").alias("tokens"))


def similarity_pairs(spark, sf_dir):
    """All pairs of at most ten sources of one process: from one array, without a self-join."""
    names = _evidence(spark, sf_dir).where("field_id = 'buyer.name'").select("process_id", "source", n.text("value").alias("norm")).where("norm != ''")
    packed = names.groupBy("process_id").agg(F.collect_list(F.struct("source", "norm")).alias("rows"))
    left = packed.select("process_id", "rows", F.explode("rows").alias("l")).select("process_id", "l", F.explode("rows").alias("r")).where("l.source < r.source")
    return left.select("process_id", F.col("l.source").alias("left_source"), F.col("r.source").alias("right_source"), F.levenshtein("l.norm", "r.norm").cast("long").alias("distance"))


def legacy_validation(spark, sf_dir):
    return reconcile.two_sources(_evidence(spark, sf_dir), "SIOPI", "MINUTA", ["financial.fgts"])


def divergence_money(spark, sf_dir):
    return _sides(spark, sf_dir, "financial.totalValue").select("process_id", reconcile.money_gap(F.col("x"), F.col("y")).alias("g")).select("process_id", "g.*")


def divergence_date(spark, sf_dir):
    return _sides(spark, sf_dir, "contract.date").select("process_id", reconcile.date_gap(F.col("x"), F.col("y")).alias("distance"))


def consolidate_best(spark, sf_dir):
    return evidence.best(_evidence(spark, sf_dir), ["process_id", "field_id"], "source_ord")


def source_conflicts(spark, sf_dir):
    return evidence.conflicts(_evidence(spark, sf_dir), ["process_id", "field_id"])


def quality_coverage(spark, sf_dir):
    flags = a.read(spark, sf_dir, a.CONTEXT)
    some = lambda flag, source: flags.where(flag).select("process_id", F.lit(source).alias("source"), F.lit("financial.totalValue").alias("field_id"))
    taking = flags.select("process_id", F.explode(F.array(*map(F.lit, [*FOUR, "CERTIDAO"]))).alias("source"), "itbi_unreadable").select("process_id", "source", (F.col("itbi_unreadable") & (F.col("source") == "ITBI")).alias("failed"))
    return evidence.quality(_evidence(spark, sf_dir), taking, some("total_conflict", "SIOPI"), some("total_issue", "MINUTA")).drop("missing_fields")


def downpayment_derivation(spark, sf_dir):
    key = F.col("o_orderkey")
    amount = lambda c: F.concat(F.lit("R$ "), F.replace(c.cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")))
    rows = _table(spark, sf_dir, "orders").select(key, amount(F.col("o_totalprice")).alias("total"), amount(100 * (key % 2000)).alias("financing"), F.lit(None).cast("string").alias("fgts"), F.when(key % 3 != 0, amount(key % 500)).alias("subsidy"), (key % 6 == 0).alias("low"))
    return evidence.down_payment(rows).select("o_orderkey", "own_resources")


def participant_alignment(spark, sf_dir):
    both = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("source"))
    cpf = F.when((F.col("source") == 1) & (F.col("o_orderkey") % 3 == 0), "").otherwise(F.lpad(F.col("c_custkey").cast("string"), 11, "0"))
    rows = both.select(F.col("o_orderkey").alias("process_id"), "source", F.lit("buyer_1").alias("participant_id"), F.when(F.col("source") == 1, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), cpf.alias("cpf"))
    return evidence.align_participants(rows).select("process_id", "source", "participant_key")


def evidence_check(spark, sf_dir):
    rows = _evidence(spark, sf_dir).where("field_id = 'financial.totalValue'")
    raw = F.when(F.col("process_id") % 5 == 0, "valor: R$ 0,01").otherwise(F.concat(F.lit("valor 12,00 e valor total de "), F.coalesce("value", F.lit(""))))
    return rows.select("process_id", "source", evidence.holds_value(F.col("value"), raw, F.col("field_type")).alias("held"))


def unit_reconcile(spark, sf_dir):
    return registry.reconcile_units(registry.last_units(a.read(spark, sf_dir, a.UNITS_OCR), "seq"), registry.dedup_units(a.read(spark, sf_dir, a.UNITS_VISION))).drop("review")


def unit_dedup(spark, sf_dir):
    return registry.dedup_units(a.read(spark, sf_dir, a.UNITS_VISION)).select("unit_key", "tower", "unit", "confidence")


def unit_qc(spark, sf_dir):
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(20,2)")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    total, share = F.when(key % 5 != 0, comma(price + F.when(key % 4 == 0, -1).otherwise(1))), F.when(key % 6 == 0, "1,5").otherwise("0,002")
    rows = _table(spark, sf_dir, "part").select("p_partkey", comma(price).alias("private_area"), total.alias("total_area"), share.alias("ideal_fraction"), F.when(key % 9 != 0, "linha 1").alias("evidence"))
    return registry.quality_issues(rows).select("p_partkey", "issues", "warnings")


def unit_review(spark, sf_dir):
    return registry.review(a.read(spark, sf_dir, a.UNITS_OCR).withColumn("brand", F.col("tower")), "brand")


def _units(spark, sf_dir) -> DataFrame:
    return a.read(spark, sf_dir, a.UNITS).join(a.read(spark, sf_dir, a.DEVELOPMENTS), "development_id", "left")


def unit_unpivot(spark, sf_dir):
    units = _units(spark, sf_dir)
    return registry.as_evidence(units.withColumn("_unit", F.col("unit")), "_unit").withColumnRenamed("_unit", "unit")


def unit_signature(spark, sf_dir):
    return a.read(spark, sf_dir, a.UNITS_OCR).select("unit", "seq", registry.type_signature(*map(F.col, registry.SIGNED)).alias("signature"))


def unit_natural_sort(spark, sf_dir):
    """The place of each unit in natural order over the whole table."""
    keyed = _table(spark, sf_dir, "part").select("p_partkey", registry.natural_order(F.concat(F.lit("Torre "), F.col("p_partkey").cast("string"))).alias("k"))
    return registry.natural_ranks(keyed, "k", "p_partkey", lambda df: storage.stored(df, "unit-ranks")).select("p_partkey", "position")


def checklist_union(spark, sf_dir):
    return catalog.checklist(spark).select("field_id", "ord", "field_type", "allow_multiple", F.size("expected_sources").alias("n_sources"))


def page_prune(spark, sf_dir):
    return textops.selected_pages(_table(spark, sf_dir, "conversations"), "conv_id", "turn", 1, 1).select("conv_id", "turn")


def page_asof_marker(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("marker", F.when(F.col("role") == "user", F.col("turn"))).withColumn("order", F.struct("turn", "role", "text"))
    return textops.last_marker(rows, "conv_id", "order", "marker").select("conv_id", "turn", "page")


def text_gate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", textops.sufficient("text").alias("sufficient"))


def focus_windows(spark, sf_dir):
    return textops.window_scores(_table(spark, sf_dir, "documents"), "doc_id", KEYWORDS)


def regex_catalog_extract(spark, sf_dir):
    patterns = [r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", r"([$€] ?[0-9][0-9.,]*)"]
    return _table(spark, sf_dir, "documents").select("doc_id", textops.first_pattern(F.col("text"), patterns).alias("found"))


def json_salvage(spark, sf_dir):
    rows = _evidence(spark, sf_dir).where("field_id = 'contract.date'")
    cut = F.concat(F.lit('{"fields":[{"fieldId":"'), "field_id", F.lit('","value":"'), F.coalesce("value", F.lit("")), F.lit('","confidence":'), F.col("confidence").cast("string"), F.lit(',"page'))
    return rows.select("process_id", "source", F.explode(textops.salvaged(cut)).alias("s")).select("process_id", "source", "s.field_id", "s.value", "s.confidence")


def rls_visible_processes(spark, sf_dir):
    return ops.visible(a.read(spark, sf_dir, a.PROCESSES), {"is_master": False, "role": "ADMIN", "organization_id": 2, "user_id": 50}).select("process_id", "user_id")


def rls_visible_documents(spark, sf_dir):
    seen = a.read(spark, sf_dir, a.PROCESSES).where("organization_id = 1 and user_id % 10 = 7").select("process_id")
    return a.read(spark, sf_dir, a.DOCUMENTS).join(seen, "process_id", "left_semi").groupBy("process_id").agg(F.count("*").alias("n"))


def _processes(spark, sf_dir) -> DataFrame:
    counts = a.read(spark, sf_dir, a.DOCUMENTS).groupBy("process_id").agg(F.count("*").alias("n"))
    return a.read(spark, sf_dir, a.PROCESSES).join(counts, "process_id", "left").withColumn("n_documents", F.coalesce("n", F.lit(0)))


def ops_dashboard(spark, sf_dir):
    return ops.dashboard(_processes(spark, sf_dir), ["organization_id"])


def process_anomalies(spark, sf_dir):
    alert = F.when(F.col("process_id") % 35 == 0, "critical").when(F.col("process_id") % 5 == 0, "warning")
    found = _processes(spark, sf_dir).withColumn("alert", alert).withColumn("finding", ops.anomaly())
    return found.where("finding is not null").select("process_id", "finding")


def security_alerts(spark, sf_dir):
    return ops.alerts(a.read(spark, sf_dir, a.AUDIT), a.NOW, {"LOGIN_FAILED": (1440, 2), "DOCUMENT_VIEWED": (1440, 3), "PROCESS_CREATED": (1440, 3)})


def _due(spark, sf_dir) -> DataFrame:
    return ops.retention_batch(a.read(spark, sf_dir, a.DOCUMENTS), a.NOW)


def retention_batch(spark, sf_dir):
    return _due(spark, sf_dir).select("document_id", "created_at")


def process_merge_latest(spark, sf_dir):
    rows = a.read(spark, sf_dir, a.AUDIT).select("actor_id", "created_at", "event_id", "event_type")
    return ops.latest(rows, ["actor_id"], ["created_at", "event_id"]).select("actor_id", "event_id", "event_type")


def results_merge(spark, sf_dir):
    old = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("process_id"), F.col("o_orderstatus").alias("status"))
    return ops.merge(old, old.where("process_id % 4 = 0").withColumn("status", F.lit("RERUN")), ["process_id"])


def _streamed(spark: SparkSession, found: DataFrame, name: str) -> DataFrame:
    """A streamed aggregate, run until its source is read. Each trigger writes a table of its own; the newest one counts, so nobody meets a half-written one."""
    folder = storage.new_path(spark, name)
    last = []

    def put(df, batch):
        df.write.mode("overwrite").parquet(f"{folder}/table/{batch}")
        last[:] = [batch]

    found.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/table/{last[0]}") if last else spark.createDataFrame([], found.schema)


def stream_login_failures(spark, sf_dir):
    """The stream over the audit log, run until its source is read; each trigger replaces the table of windows."""
    schema = _table(spark, sf_dir, "events").schema
    spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").createOrReplaceTempView("event_stream")
    log = spark.sql(a.AUDIT.replace("{events}", "event_stream"))
    # Days are those of the log's own clock, whatever the session's time zone is.
    log = log.withColumn("created_at", F.from_utc_timestamp(F.col("created_at").cast("timestamp"), F.current_timezone()))
    found = alerts.failures_by_window(log)
    found = found.withColumn("start", F.to_utc_timestamp("start", F.current_timezone()).cast("timestamp_ntz"))
    return _streamed(spark, found, "login-failures")


def learned_rule_counts(spark, sf_dir):
    rows = _evidence(spark, sf_dir).where("field_id = 'property.type'").withColumn("norm", n.text("value"))
    signed = rows.groupBy("process_id", "field_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("norm") != "", F.col("norm")))), " || ").alias("signature"))
    return alerts.rule_counter(signed)


def norm_money(spark, sf_dir):
    return _evidence(spark, sf_dir).where("field_type = 'valor_monetario'").select("process_id", "source", "field_id", n.money("value").alias("norm"))


def norm_date(spark, sf_dir):
    return _evidence(spark, sf_dir).where("field_type = 'data'").select("process_id", "source", n.date("value").alias("norm"))


def norm_decimal(spark, sf_dir):
    price = F.col("p_retailprice").cast("decimal(20,2)").cast("string")
    shown = n.decimal_display(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1."), F.replace(price, F.lit("."), F.lit(",")))).otherwise(price))
    return _table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"), n.parse_decimal(shown).cast("decimal(20,2)").alias("number"))


def process_codes(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", n.process_code(F.lower(F.hex(F.col("o_orderkey") + 1_000_000_000_000))).alias("code"))


def source_diagnostic(spark, sf_dir):
    return _verdicts(spark, sf_dir).where("rung = 9").select("process_id", "field_id", "observation")


def optional_zero_equivalence(spark, sf_dir):
    return reconcile.optional_zero(_verdicts(spark, sf_dir)).select("process_id", "field_id", "status")


def divergence_email(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    other = F.concat(F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(""), key, F.lit("@"), F.when(F.col("c_custkey") % 3 == 0, "b.com").otherwise("a.com"))
    return _table(spark, sf_dir, "customer").select("c_custkey", reconcile.email_gap(F.concat(key, F.lit("@a.com")), other).alias("part"))


def divergence_digits(spark, sf_dir):
    key = F.col("c_custkey")
    number = lambda k: F.lpad(k.cast("string"), 11, "0")
    phone = F.concat(F.when(key % 5 == 0, "11").otherwise("21"), number(key * 10))
    return _table(spark, sf_dir, "customer").select("c_custkey", reconcile.first_difference(number(key), number(key + 7)).cast("int").alias("position"), reconcile.phone_gap(F.concat(F.lit("21"), number(key * 10 + key % 2)), phone).alias("phone"))


def result_filter(spark, sf_dir):
    return reconcile.filter_results(_verdicts(spark, sf_dir), _reviews(spark, sf_dir), "REVIEW_REQUIRED", "Minuta").select("process_id", "field_id", "status")


def reservation_score_best(spark, sf_dir):
    key = F.col("process_id") + F.col("source_ord")
    raw = F.when(key % 3 == 0, F.concat(F.lit("Valor total: "), F.coalesce("value", F.lit("")))).when(key % 3 == 1, "sem rótulo")
    rows = _evidence(spark, sf_dir).where("field_id in ('financial.totalValue', 'financial.fgts', 'contract.date')").withColumn("raw", raw)
    return evidence.scored_best(rows, ["process_id", "field_id"], "source_ord")


def participant_expand(spark, sf_dir):
    each = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("process_id"), F.lit("SIOPI").alias("source"), F.explode(F.array(*map(F.lit, range(3)))).alias("seq"))
    rows = each.select("process_id", "source", "seq", F.when(F.col("seq") == 1, "buyer_2").otherwise("buyer_1").alias("participant_id"), F.when(F.col("seq") == 2, "").otherwise(F.concat("process_id", F.lit("-"), "seq")).alias("cpf"), F.concat(F.lit("Nome "), "seq").alias("name"))
    return evidence.expand_participants(evidence.fold_participants(rows, "seq"))


def quality_totals(spark, sf_dir):
    return evidence.quality_totals(quality_coverage(spark, sf_dir))


def extraction_alerts(spark, sf_dir):
    return evidence.extraction_alerts(quality_coverage(spark, sf_dir))


def unit_picker(spark, sf_dir):
    return registry.pick_units(a.read(spark, sf_dir, a.UNITS_OCR), None, "tipo 1").select("tower", "unit", "typology")


def unit_accepted(spark, sf_dir):
    sheet = a.read(spark, sf_dir, a.UNITS_OCR).withColumn("private_area", F.when(F.col("confidence") % 3 != 0, F.col("private_area")).otherwise(" "))
    return registry.accepted_rows(sheet).select("unit", "private_area")


def form_fields(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn("value", F.when(F.col("turn") % 3 == 2, "Off").otherwise(F.col("text")))
    return textops.form_lines(turns, "conv_id", ["turn"], "role", "value").select("conv_id", F.sha2("form", 256).alias("form"))


def label_next_line(spark, sf_dir):
    text = F.concat(F.lit("Ficha\nNome"), F.when(F.col("c_custkey") % 2 == 0, ": ").otherwise("\n "), F.col("c_name"), F.lit("\nFim"))
    return _table(spark, sf_dir, "customer").select("c_custkey", textops.label_value(text, "NOME").alias("value"))


def tabular_rows(spark, sf_dir):
    area = F.replace(F.col("p_retailprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))
    text = F.concat(F.lit("Quadro de áreas\n"), F.col("p_brand"), F.lit(" "), "p_partkey", F.lit(" Tipo A "), area, F.lit(" 9."), area, F.lit(" 0,0123\nTotal 1 de 2\n"), F.col("p_brand"), F.lit("  7B  Loja "), area, F.lit(" "), area, F.lit(" 0,5"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.explode(textops.tabular_rows(text)).alias("r")).select("p_partkey", "r.*")


def history_search(spark, sf_dir):
    return textops.search(_evidence(spark, sf_dir), "process_id", [n.process_code(F.col("process_id").cast("string")), F.col("value")], "Outro  CUSTOMER")


def upload_dedup(spark, sf_dir):
    files = a.read(spark, sf_dir, a.DOCUMENTS).select(F.concat("source", F.lit("-"), "part").alias("name"), (F.col("process_id") % 5).alias("size"))
    return ops.new_uploads(files, files.where("size = 0"), ["name", "size"])


def process_list(spark, sf_dir):
    return ops.recent_processes(a.read(spark, sf_dir, a.PROCESSES), "FULLY_CHECKED").select("process_id", "user_id", "final_status")


def admin_metrics(spark, sf_dir):
    return ops.admin_metrics(_processes(spark, sf_dir))


def login_rate_limit(spark, sf_dir):
    return ops.login_limits(a.read(spark, sf_dir, a.AUDIT), a.NOW, 10080, 8)


def stale_processes(spark, sf_dir):
    beat = a.read(spark, sf_dir, a.PROCESSES).withColumn("updated_at", F.col("started_at").cast("timestamp") + F.make_dt_interval(mins=F.col("minutes").cast("int")))
    return ops.stale(beat, "1996-01-01 00:20:00").select("process_id")


def review_progress(spark, sf_dir):
    return ops.review_progress(_verdicts(spark, sf_dir), _reviews(spark, sf_dir))


def stream_rule_counter(spark, sf_dir):
    """The counter of approved equivalences kept by a stream."""
    source = spark.readStream.schema(_table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parquet*")
    return _streamed(spark, alerts.rule_counter(source.select(F.lit("property.type").alias("field_id"), F.col("o_orderstatus").alias("signature"))), "rules")


def _wide(spark, sf_dir) -> DataFrame:
    return a.read(spark, sf_dir, a.WIDE_EVIDENCE)


def _wide_context(spark, sf_dir) -> DataFrame:
    sources = a.read(spark, sf_dir, a.PARTICIPATION)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("source_ord", "source")))), lambda x: x["source"])
    told = F.map_from_entries(F.collect_list(F.when(F.col("failed") & F.col("error").isNotNull(), F.struct("source", "error"))))
    per = sources.groupBy("process_id").agg(ordered(F.lit(True)).alias("participating"), ordered(F.col("failed")).alias("unreadable"), told.alias("errors"))
    marked = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.concat_ws(":", "source", "field_id")))
    marks = a.read(spark, sf_dir, a.MARKS).groupBy("process_id").agg(marked("conflict").alias("conflicts"), marked("issue").alias("issues"))
    none = F.array().cast("array<string>")
    return per.join(marks, "process_id", "left").withColumns({c: F.coalesce(c, none) for c in ("conflicts", "issues")})


def _wide_verdicts(spark, sf_dir) -> DataFrame:
    return reconcile.reconcile(_wide(spark, sf_dir), _wide_context(spark, sf_dir), WIDE_FIELDS)


def norm_every_type(spark, sf_dir):
    """Every type of field, with marital statuses and development names folded."""
    return _wide(spark, sf_dir).select("process_id", "source", "field_id", "participant_id", n.field_value("value", F.col("field_type"), F.col("field_id")).alias("norm"))


def reconcile_every_source(spark, sf_dir):
    """Ten sources, every type, one buyer or two, conflicts, issues, unread sources with their reasons."""
    return _wide_verdicts(spark, sf_dir).select("process_id", "field_id", "participant_id", "status", "rung", "observation")


def every_source_summary(spark, sf_dir):
    return reconcile.summary(_wide_verdicts(spark, sf_dir), "field_id")


def every_source_missing(spark, sf_dir):
    return reconcile.missing_by_source(_wide_verdicts(spark, sf_dir), _wide_context(spark, sf_dir))


def participant_summary(spark, sf_dir):
    return reconcile.participants(_wide_verdicts(spark, sf_dir))


def learned_equivalence(spark, sf_dir):
    return reconcile.learned(reconcile.rule_candidates(_wide(spark, sf_dir)), a.read(spark, sf_dir, a.RULES))


def report_counters(spark, sf_dir):
    return reconcile.final_counts(_verdicts(spark, sf_dir), _reviews(spark, sf_dir), "process_id")


def report_checked(spark, sf_dir):
    return reconcile.report(_verdicts(spark, sf_dir), _reviews(spark, sf_dir), "CHECKED").select("process_id", "field_id")


def report_pending(spark, sf_dir):
    return reconcile.report(_verdicts(spark, sf_dir), _reviews(spark, sf_dir), "PENDING").select("process_id", "field_id")


def result_missing(spark, sf_dir):
    return reconcile.filter_results(_verdicts(spark, sf_dir), _reviews(spark, sf_dir), "MISSING").select("process_id", "field_id")


def review_state(spark, sf_dir):
    return _reviews(spark, sf_dir)


def review_audit(spark, sf_dir):
    """The audit rows of all reviews: how many of each kind a reviewer has."""
    return ops.review_events(a.read(spark, sf_dir, a.REVIEW_LOG)).groupBy("actor_id", "event_type").agg(F.count("*").alias("n"), F.max("entity_id").alias("last_entity"))


def retention_purged(spark, sf_dir):
    return ops.retention_outcome(_due(spark, sf_dir), a.NOW).select("document_id", "storage_path", F.col("purged_at").cast("timestamp_ntz").alias("purged_at"), "purge_reason", "purge_attempts")


def retention_failed(spark, sf_dir):
    return ops.retention_outcome(_due(spark, sf_dir), a.NOW, "x" * 1200).select("document_id", "storage_path", "purge_attempts", F.length("purge_error").alias("error_length"))


def retention_audit(spark, sf_dir):
    return ops.retention_events(_due(spark, sf_dir)).select("organization_id", "event_type", "entity_type", "count")


def process_persisted(spark, sf_dir):
    """Lifecycle states of orders and the verdicts on them, as processes are stored."""
    state = F.when(F.col("process_id") % 97 == 0, "FAILED").when(F.col("process_id") % 7 == 0, "COMPARING").otherwise("DONE")
    rows = a.read(spark, sf_dir, a.PROCESSES).select("process_id", state.alias("status"), F.col("started_at").alias("updated_at"))
    return ops.persisted(rows, _verdicts(spark, sf_dir))


def process_lifecycle(spark, sf_dir):
    steps = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(m).alias("minute")) for s, m in (("PENDING", 0), ("EXTRACTING", 1), ("COMPARING", 2), ("DONE", 3), ("EXTRACTING", 4), ("FAILED", 5), ("no state", 6))])
    each = a.read(spark, sf_dir, a.PROCESSES).select("process_id", "started_at", F.explode(steps).alias("s")).where((F.col("s.minute") <= F.col("process_id") % 7) & ((F.col("s.status") != "DONE") | (F.col("process_id") % 2 == 0)))
    return ops.lifecycle(each.select("process_id", "s.status", (F.col("started_at").cast("timestamp") + F.make_dt_interval(mins=F.col("s.minute"))).alias("at"))).select("process_id", "status")


def processes_with_documents(spark, sf_dir):
    nested = ops.with_documents(a.read(spark, sf_dir, a.PROCESSES), a.read(spark, sf_dir, a.PROFILES), a.read(spark, sf_dir, a.DOCUMENTS).select("process_id", "created_at", "document_id", "source"))
    return nested.select("process_id", "role", F.array_join(F.transform("documents", lambda d: F.concat_ws("=", d["document_id"], d["source"])), ",").alias("documents"))


def documents_upsert(spark, sf_dir):
    kept = a.read(spark, sf_dir, a.DOCUMENTS).select("document_id", "source")
    return ops.upload_documents(kept, kept.where("document_id like '%-1'").select("document_id", F.lit("MATRICULA").alias("source")))


def slowest_processes(spark, sf_dir):
    found = _processes(spark, sf_dir).withColumn("alert", F.lit(None).cast("string")).withColumn("finding", ops.anomaly())
    return ops.slowest(found).select("process_id", "minutes", "finding")


def evidence_verified(spark, sf_dir):
    return evidence.verified(a.read(spark, sf_dir, a.CANDIDATES)).select("process_id", "source", "doc_ord", "field_id", "value", "confidence", "issue")


def _consolidated(spark, sf_dir):
    return evidence.consolidate(a.read(spark, sf_dir, a.CANDIDATES))


def consolidated_values(spark, sf_dir):
    return _consolidated(spark, sf_dir)[0]


def consolidated_conflicts(spark, sf_dir):
    return _consolidated(spark, sf_dir)[1]


def consolidated_issues(spark, sf_dir):
    return _consolidated(spark, sf_dir)[2]


def coerced_output(spark, sf_dir):
    return evidence.coerced(a.read(spark, sf_dir, a.OUTPUT))


def missing_critical(spark, sf_dir):
    return evidence.missing_critical(_evidence(spark, sf_dir)).groupBy("process_id", "source").agg(F.array_join(F.array_sort(F.collect_list("field_id")), ",").alias("missing"))


def _readings(spark, sf_dir):
    rows = a.read(spark, sf_dir, a.CANDIDATES).select("process_id", "source", "doc_ord", "field_id", "value", "confidence")
    first, second = rows.where("doc_ord = 0"), rows.where("doc_ord = 1 and process_id % 3 <> 0")
    return first.withColumn("value", F.when(F.col("process_id") % 2 == 0, F.col("value"))), second


def recovery_merge(spark, sf_dir):
    return evidence.recovered(*_readings(spark, sf_dir), ["process_id", "source"]).select("process_id", "source", "field_id", "doc_ord", "value")


def recovery_preferred(spark, sf_dir):
    return evidence.recovered(*_readings(spark, sf_dir), ["process_id", "source"], True).select("process_id", "source", "field_id", "doc_ord", "value")


def reservation_gaps(spark, sf_dir):
    return evidence.reservation_gaps(a.read(spark, sf_dir, a.CANDIDATES).where("source = 'DADOS_RESERVA'"))


def developments_with_units(spark, sf_dir):
    nested = registry.developments_with_units(a.read(spark, sf_dir, a.DEVELOPMENTS), a.read(spark, sf_dir, a.UNITS))
    return nested.select("development_id", "name", F.array_join(F.transform("units", lambda u: F.concat_ws("/", u["tower"], u["unit"])), ",").alias("units"))


def units_replaced(spark, sf_dir):
    units = a.read(spark, sf_dir, a.UNITS).select("development_id", "tower", "unit")
    saved = a.read(spark, sf_dir, a.DEVELOPMENTS).where("development_id % 3 = 1").select("development_id")
    return registry.replace_children(units, units.where("cast(unit as int) % 5 = 0").withColumn("tower", F.lit("nova")), saved)


def _deleted(spark, sf_dir):
    developments, units = a.read(spark, sf_dir, a.DEVELOPMENTS), a.read(spark, sf_dir, a.UNITS)
    gone = developments.where("development_id % 2 = 0").select("development_id", F.when(F.col("development_id") % 4 == 0, F.col("organization_id")).otherwise(F.col("organization_id") + 1).alias("organization_id"))
    return registry.delete_cascade(developments, units, gone)


def development_deleted(spark, sf_dir):
    return _deleted(spark, sf_dir)[0].select("development_id", "organization_id")


def development_units_left(spark, sf_dir):
    return _deleted(spark, sf_dir)[1].select("development_id", "unit")


def register_appended(spark, sf_dir):
    """Evidence of a contract's own source with the register's rows as one more source."""
    units = _units(spark, sf_dir).withColumn("process_id", F.col("unit").cast("long"))
    rows = registry.with_register(_evidence(spark, sf_dir).where("source = 'SIOPI'").select("process_id", "source_ord", "source", "field_id", "value", "confidence"), registry.as_evidence(units, "process_id"), 4)
    return rows.groupBy("source_ord", "source", "field_id").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


def towers_by_apartments(spark, sf_dir):
    part = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(part.alias("group_id"), F.when(part % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("towers"), F.array(F.lit("101"), F.col("p_brand")).alias("apartments"), F.when(part % 7 != 0, F.col("p_name")).otherwise(" ").alias("private_area"))
    return registry.towers_by_apartments(rows).drop("private_area")


def pages_merged(spark, sf_dir):
    key = F.col("s_suppkey")
    of = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)]))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", of.alias("page"))
    name = F.when((F.col("page") < 3) & (key % 2 == 0), "Empreendimento sem nome").otherwise(F.concat("s_name", F.lit(" p"), "page"))
    some = lambda k, c: F.when((key + F.col("page")) % k == 0, F.concat(F.lit(c), "page"))
    return registry.merged_pages(rows.select("s_suppkey", "page", name.alias("name"), some(2, "c").alias("city"), some(3, "r").alias("registration"), some(5, "s").alias("seller_name"), F.lit(None).cast("string").alias("seller_cnpj")), "s_suppkey")


def notes_merged(spark, sf_dir):
    key = F.col("s_suppkey")
    notes = lambda k: F.when(key % k != 0, F.array(F.lit("a"), F.lit("b"), F.lit("a")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(registry.merged_notes(notes(2), notes(3)), "|").alias("notes"))


def empty_developments(spark, sf_dir):
    typologies = F.when(F.col("development_id") % 2 == 0, F.array(F.lit("Tipo A"), F.lit("Tipo B"))).otherwise(F.array().cast("array<string>"))
    return registry.empty_set_issues(a.read(spark, sf_dir, a.DEVELOPMENTS).withColumn("typologies", typologies), a.read(spark, sf_dir, a.UNITS).where("development_id % 5 <> 0"), "development_id")


def legacy_observations(spark, sf_dir):
    """Every field of the contract's checklist, one source against another, with what differs in words."""
    return reconcile.validate(_wide(spark, sf_dir), catalog.MINUTA, "SIOPI", "MINUTA")


def _customer_texts(spark, sf_dir, source: str, template: list[str]) -> DataFrame:
    """A text for each customer, whose number stands where # does."""
    text = F.replace(F.lit("\n".join(template)), F.lit("#"), F.col("c_custkey").cast("string"))
    return storage.spread(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.lit(source).alias("source"), text.alias("text"))


def _read_fields(docs: DataFrame, source: str) -> DataFrame:
    return extract.extracted_rows(docs, "c_custkey", sources=[source]).select("c_custkey", "field_id", "value", "confidence")


CONTRACT = ["nº do contrato: 8.#.77", "Agência: 1#-5", "FORTALEZA, CE 12 de março de 2024", "B.4.1 Valor do financiamento: R$ 1#.000,00", "Valor destinado à aquisição é R$ 2#.500,00", "apartamento nº 302 da torre T#, 3º pavimento, tipo C, matrícula nº 55.#"]
COMPOSITION = ["B.4.1 Valor do financiamento B.4.2 Recursos próprios B.4.3 FGTS B.4.4 Outros B.4.5 Desconto", "R$ 1#.000,00 R$ 2#,00 R$ 3#,10 R$ 0,00 R$ 4#,50 B.5 Fim R$ 9,00"]
RESERVATION = ["NOME DO CLIENTE CPF / CNPJ RG CELULAR", "ANA SOUZA 123.456.789-01 RG1#9999 85 99999-8888", "ESTADO CIVIL: Casada", "ENDEREÇO: Rua #", "BAIRRO: Centro", "VALOR DO CONTRATO", "R$ 123.000,00", "fnanciamento 1 15#,00"]
DECLARATION = ["DTI [CAMPOS DE FORMULARIO] DADOS DO ADQUIRENTE Nome: ANA # CPF / CNPJ: 123.456.789-01 Endereço: Rua # Email: ana#@mail.com", "DADOS DO TRANSMITENTE Nome / Razão Social: OBRAS # LTDA CPF / CNPJ: 12.345.678/0001-90 Endereço: Av #", "NATUREZA DA TRANSAÇÃO: Compra e venda DADOS DO IMÓVEL OBJETO DA TRANSAÇÃO Matrícula: 55# Área Privativa: 5#,25 m²", "DECLARAÇÃO DE VALORES Valor TOTAL DECLARADO: 2#.000,00 Valor não financiado: 5#,00 RESPONSÁVEL PELAS INFORMAÇÕES"]
DEED = ["Matrícula: 12.#. denominado CONDOMÍNIO VILA #, no município de Fortaleza-CE. CNPJ 12.345.678/0001-90 [PÁGINA 2] tipo A com uma área privativa de 5#,25 m², área total real de 6#,750 m² e fração ideal de 0,012345.", "[PÁGINA 3] Inscrição municipal: 77-# tipo B área privativa coberta: 70.10 m"]
DEED_TABLE = ["[PÁGINA 4] 1 101 a 50,25 60.755 0,012345", "[PÁGINA 5] 2 20200 B-c 51,00 61,000 0,0123456 #"]


def extract_contract(spark, sf_dir):
    return _read_fields(_customer_texts(spark, sf_dir, "MINUTA", CONTRACT), "MINUTA")


def extract_composition(spark, sf_dir):
    return _read_fields(_customer_texts(spark, sf_dir, "MINUTA", COMPOSITION), "MINUTA")


def extract_reservation(spark, sf_dir):
    return _read_fields(_customer_texts(spark, sf_dir, "DADOS_RESERVA", RESERVATION), "DADOS_RESERVA")


def extract_declaration(spark, sf_dir):
    """Texts that came as certificates and are declarations."""
    return _read_fields(_customer_texts(spark, sf_dir, "CERTIDAO", DECLARATION), "ITBI").where(F.col("field_id").isin("buyer.address", "seller.legalName", "seller.cnpj", "seller.address", "property.registration", "property.privateArea", "financial.totalValue", "financial.nonFinancedValue", "transaction.nature"))


def deed_units(spark, sf_dir):
    rows = n.opened(_customer_texts(spark, sf_dir, "MATRICULA", DEED), deeds.prose_units(F.col("text")), "u", "c_custkey")
    return rows.select("c_custkey", "u.private_area", "u.total_area", "u.ideal_fraction", "u.iptu", "u.typology", "u.confidence", F.array_join(F.col("u.pages").cast("array<string>"), ",").alias("pages"))


def deed_table_units(spark, sf_dir):
    return n.opened(_customer_texts(spark, sf_dir, "MATRICULA", DEED_TABLE), deeds.table_units(F.col("text")), "u", "c_custkey").select("c_custkey", "u.*")


def deed_development(spark, sf_dir):
    return _customer_texts(spark, sf_dir, "MATRICULA", DEED).select("c_custkey", deeds.development(F.col("text")).alias("d"), F.array_join(deeds.typologies(F.col("text")), ",").alias("typologies")).select("c_custkey", "d.name", "d.city", "d.registration", "d.seller_cnpj", "typologies")


def _files(spark, sf_dir) -> DataFrame:
    """An upload for each order, a file for each of its lines: names and contents that agree or don't."""
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    ending = F.element_at(F.array(*map(F.lit, [".pdf", ".PNG", ".jpg", ".docx", ".rtf", ".tif", ".exe"])), (part % 7 + 1).cast("int"))
    start = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("255044462D", "89504E470D", "FFD8FFE0", "504B0304", "7B5C72746631", "49492A0008", "4D5A")]), F.when(part % 10 == 0, 7).otherwise(part % 7 + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, ["application/pdf", "image/png", "image/jpeg", "x/y", "text/rtf", "image/tiff", "x/y"])), (part % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "lineitem").select(key.alias("upload"), F.concat(F.lit("arquivo"), F.col("l_linenumber"), ending).alias("name"), mime.alias("mime"), (part * 1000).alias("size"), start.alias("content"), (part % 3).alias("k"))


def upload_gate(spark, sf_dir):
    return uploads.gate(_files(spark, sf_dir), "upload")


def upload_kinds(spark, sf_dir):
    rows = _files(spark, sf_dir)
    name, mime = F.col("name"), F.col("mime")
    return rows.groupBy(uploads.mime_type(name, mime).alias("mime_type"), uploads.document_type(name, mime, "ITBI").alias("itbi_type"), uploads.document_type(name, mime, "MINUTA").alias("minuta_type"), uploads.reader(name, mime).alias("reader")).agg(F.count("*").alias("n"))


def upload_sides(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return uploads.sides(rows.withColumn("type", uploads.document_type(F.col("name"), F.col("mime"), "MINUTA")), "upload")


def upload_sources(spark, sf_dir):
    return uploads.enough_sources(_files(spark, sf_dir).select("upload", F.col("k").alias("source"), F.when(F.col("upload") % 5 == 0, "u1").alias("unit")), "upload", "unit")


def upload_estimates(spark, sf_dir):
    return uploads.estimate(_files(spark, sf_dir), "upload")


def upload_source_lists(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, '["SIOPI","ITBI"]').when(key % 4 == 1, '["SIOPI","NADA"]').when(key % 4 == 2, '["MINUTA"]').otherwise("{não")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(uploads.source_list(text, F.when(key % 8 < 4, 2).otherwise(1)), ",").alias("sources"))


def page_lists(spark, sf_dir):
    key = F.col("o_orderkey") % 50
    text = F.when(key % 3 == 0, F.concat(F.lit("2, 1-"), key.cast("string"))).when(key % 3 == 1, key.cast("string")).otherwise("1,x")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(uploads.page_list(text, F.lit(30)).cast("array<string>"), ",").alias("pages"))


def names_inferred(spark, sf_dir):
    file = F.concat(F.lit("Lista_Unidades_vila-"), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("_12-"), "p_partkey", F.lit(" (2).xlsx"))
    return _table(spark, sf_dir, "part").select("p_partkey", uploads.inferred_name(file).alias("name"), uploads.inferred_registration(file).alias("registration"), extract.safe_file_name(F.concat(F.lit("ção "), "p_brand", F.lit("/x"))).alias("file"))


def errors_told(spark, sf_dir):
    key = F.col("o_orderkey")
    error = F.when(key % 3 == 0, F.concat(F.lit("Timeout Bearer abc"), key, F.lit(" fim"))).when(key % 3 == 1, "arquivo encrypted").otherwise(F.concat(F.lit("outro sk-"), key))
    return _table(spark, sf_dir, "orders").select("o_orderkey", uploads.sanitised_error(error).alias("hidden"), uploads.explained_error(error, F.lit("a.pdf")).alias("told"))


def requests_audited(spark, sf_dir):
    meta = uploads.request_metadata(F.concat(F.col("c_custkey"), F.lit(".0.0.1, 9.9.9.9")), F.repeat(F.col("c_name"), 20))
    return _table(spark, sf_dir, "customer").select("c_custkey", meta.alias("m"), uploads.login_name(F.concat(F.lit(" U"), "c_custkey"), "mail.org").alias("login")).select("c_custkey", "m.ip", F.length("m.agent").alias("agent_length"), "login")


def _cells(spark, sf_dir) -> DataFrame:
    """Cells of a workbook for each brand: a title, headings in the second row, and a row for each part."""
    row = (F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1).cast("int")
    values = F.array(F.lit("T1"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("tipo k"), F.col("p_partkey") % 4)), F.when(F.col("p_partkey") % 5 != 0, F.replace(F.col("p_retailprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(","))))
    body = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("file_id"), F.lit("sheet1").alias("sheet"), row.alias("row"), F.posexplode(values).alias("col", "value")).where("value is not null")
    head = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in ((0, 0, "Lista de unidades"), (1, 0, "Torre"), (1, 1, "Unidade (nº)"), (1, 2, "Tipologia"), (1, 3, "ÁREA PRIVATIVA m²"))])
    heads = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("file_id")).distinct().select("file_id", F.lit("sheet1").alias("sheet"), F.explode(head).alias("h")).select("file_id", "sheet", "h.*")
    return heads.unionByName(body)


def workbook_tables(spark, sf_dir):
    return office.best_tables(_cells(spark, sf_dir)).select("file_id", "sheet", "row", "score", "columns.tower", "columns.unit", "columns.typology", "columns.private_area")


def workbook_units(spark, sf_dir):
    return office.workbook_units(_cells(spark, sf_dir)).select("file_id", "tower", "unit", "typology", "private_area", "confidence")


def workbook_texts(spark, sf_dir):
    """Lines of the first 2,000 rows, by the title as the first column's heading."""
    return office.workbook_text(_cells(spark, sf_dir)).select("file_id", F.size(F.split("text", "\n")).alias("n_lines"), F.substring("text", 1, 60).alias("start"))


def text_shortened(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(textops.shortened(F.coalesce("text", F.lit(""))), 256).alias("text"))


def focus_text(spark, sf_dir):
    """Whole texts cut to their budget by the contract's keywords. Too long for SQL; tested against plain Python."""
    return _table(spark, sf_dir, "documents").select("doc_id", textops.focused("text", textops.domain_keywords(catalog.MINUTA)).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_dispatch, norm_text, norm_digits, norm_area, norm_identifier, norm_address, norm_email, reconcile_basic, reconcile_full, reconcile_summary, missing_by_source, report_filter, final_status_refresh, diff_tokens,
        similarity_pairs, legacy_validation, divergence_money, divergence_date, consolidate_best, source_conflicts, quality_coverage, downpayment_derivation, participant_alignment, evidence_check, unit_reconcile, unit_dedup,
        unit_qc, unit_review, unit_unpivot, unit_signature, unit_natural_sort, checklist_union, page_prune, page_asof_marker, text_gate, focus_windows, regex_catalog_extract, json_salvage, rls_visible_processes,
        rls_visible_documents, ops_dashboard, process_anomalies, security_alerts, retention_batch, process_merge_latest, results_merge, stream_login_failures, learned_rule_counts,
        norm_money, norm_date, norm_decimal, process_codes, source_diagnostic, optional_zero_equivalence, divergence_email, divergence_digits, result_filter, reservation_score_best, participant_expand, quality_totals, extraction_alerts,
        unit_picker, unit_accepted, form_fields, label_next_line, tabular_rows, history_search, upload_dedup, process_list, admin_metrics, login_rate_limit, stale_processes, review_progress, stream_rule_counter,
        norm_every_type, reconcile_every_source, every_source_summary, every_source_missing, participant_summary, learned_equivalence, report_counters, report_checked, report_pending, result_missing, review_state, review_audit, retention_purged, retention_failed, retention_audit, process_persisted, process_lifecycle, processes_with_documents, documents_upsert, slowest_processes, evidence_verified, consolidated_values, consolidated_conflicts, consolidated_issues, coerced_output, missing_critical, recovery_merge, recovery_preferred, reservation_gaps, developments_with_units, units_replaced, development_deleted, development_units_left, register_appended, towers_by_apartments, pages_merged, notes_merged, empty_developments,
        legacy_observations, extract_contract, extract_composition, extract_reservation, extract_declaration, deed_units, deed_table_units, deed_development, upload_gate, upload_kinds, upload_sides, upload_sources, upload_estimates, upload_source_lists, page_lists, names_inferred, errors_told, requests_audited, workbook_tables, workbook_units, workbook_texts, text_shortened, focus_text,
    )
} | streams.QUERIES | readings.QUERIES
