"""From extracted values to one value per source and field, and how good they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions import normalize as n


def best(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The value of highest confidence, the earliest of several; blank values don't stand."""
    filled = rows.where(F.trim("value") != "")
    return filled.groupBy(*keys).agg(F.max_by(F.struct("value", "confidence"), F.struct(F.col("confidence"), -F.col(order))).alias("b")).select(*keys, "b.value", "b.confidence")


def conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose values differ after normalisation, with the number of distinct ones."""
    normal = rows.where(F.trim("value") != "").withColumn("norm", n.field_value("value", F.col("field_type"), F.col("field_id")))
    return normal.groupBy(*keys).agg(F.count_distinct("norm").alias("n_values")).where("n_values > 1")


def holds_value(value: Column, raw: Column, kind: Column) -> Column:
    """Whether a raw text holds the value, judged by its type: digits, equal numbers, the address, or three fifths of its words."""
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(r"[0-9][0-9.,]*"), F.lit(0)), lambda x: x)

    def held(normal):
        words = F.filter(F.split(normal, " "), lambda t: F.length(t) > 2)
        enough = lambda words, text: (F.size(words) > 0) & (F.size(F.filter(words, lambda t: F.contains(text, t))) / F.greatest(F.size(words), F.lit(1)) >= 0.6)
        return F.when(normal == "", False).when(kind.isin(*n.DIGIT_TYPES), F.contains(n.digits(raw), normal)).when(
            kind == "valor_monetario", F.exists(numbers, lambda x: n.money(x) == normal)
        ).when(kind == "area", F.exists(numbers, lambda x: n.area(x) == normal)).when(kind == "email", F.contains(F.lower(raw), normal)).otherwise(
            n.let(F.struct(words.alias("words"), n.value(raw, kind).alias("text")), lambda s: enough(s["words"], s["text"]))
        )

    return n.let(n.value(value, kind), held)


def quality(rows: DataFrame, participating: DataFrame, conflicted: DataFrame, issues: DataFrame) -> DataFrame:
    """A report on each participating source of each process: (process_id, source, status, coverage, missing_fields, n_extracted, n_missing, n_low, n_ambiguous, n_issues).

    rows as in best(); participating (process_id, source, failed); conflicted and
    issues (process_id, source, field_id), where a field may be field::buyer. A
    source without critical fields is NOT_ASSESSED with coverage 100, or FAILED
    with 0. One that gave no row at all has its report too.
    """
    critical = catalog.constant_map({s: names.split() for s, names in catalog.CRITICAL.items()})
    base = F.substring_index("field_id", "::", 1)
    # A literal predicate on (source, field): rows of others never leave the scan.
    wanted = F.lit(False)
    for source, names in catalog.CRITICAL.items():
        wanted = wanted | ((F.col("source") == source) & base.isin(names.split()))
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    have = rows.where(wanted & filled).groupBy("process_id", "source").agg(F.collect_set(base).alias("extracted"), F.collect_set(F.when(F.col("confidence") < catalog.LOW_CRITICAL, base)).alias("low"))
    doubt = conflicted.where(wanted).groupBy("process_id", "source").agg(F.count_distinct(base).alias("n_ambiguous"))
    wrong = issues.groupBy("process_id", "source").agg(F.count_distinct("field_id").alias("n_issues"))
    key, none = ["process_id", "source"], F.array().cast("array<string>")
    each = participating.join(have, key, "left").join(doubt, key, "left").join(wrong, key, "left")
    expected = F.coalesce(F.try_element_at(critical, F.col("source")), none)
    each = each.select("process_id", "source", "failed", expected.alias("expected"), F.coalesce("extracted", none).alias("extracted"), F.size(F.coalesce("low", none)).alias("n_low"), F.coalesce("n_ambiguous", F.lit(0)).alias("n_ambiguous"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))
    missing, size, got = F.array_except("expected", "extracted"), F.size("expected"), F.size("extracted")
    assessed = size > 0
    status = (
        F.when(F.col("failed"), "FAILED").when(~assessed, "NOT_ASSESSED")
        .when((F.size(missing) > 0) | (F.col("n_low") > 0) | (F.col("n_ambiguous") > 0) | (F.col("n_issues") > 0), "PARTIAL").otherwise("COMPLETE")
    )
    coverage = F.when(assessed, F.floor((got * 200 + size) / (size * 2))).when(F.col("failed"), 0).otherwise(100).cast("int")
    return each.select(
        "process_id", "source", status.alias("status"), coverage.alias("coverage"), missing.alias("missing_fields"), got.cast("long").alias("n_extracted"), F.size(missing).cast("long").alias("n_missing"), F.col("n_low").cast("long").alias("n_low"),
        "n_ambiguous", F.when(assessed, F.col("n_issues")).otherwise(0).alias("n_issues"),
    )


def down_payment(rows: DataFrame) -> DataFrame:
    """rows with (total, financing, fgts, subsidy: strings; low: whether a component is doubtful): own_resources, null where it can't be derived safely."""
    zero = F.lit(0).cast("decimal(28,2)")
    total, financing = n.money_decimal("total"), n.money_decimal("financing")
    entry = total - financing - F.coalesce(n.money_decimal("fgts"), zero) - F.coalesce(n.money_decimal("subsidy"), zero)
    return rows.withColumn("own_resources", F.when(~F.col("low") & (entry >= 0), entry.cast("decimal(20,2)")))


def align_participants(rows: DataFrame) -> DataFrame:
    """(process_id, source, participant_id, cpf, name) to one participant key per person: by tax id; where that is missing by the id that another source (the last of several) gives the same name; then by name; then by the source's own id."""
    keyed = rows.withColumn("norm_name", n.text("name")).withColumn("cpf", n.digits("cpf"))
    known = keyed.where((F.col("cpf") != "") & (F.col("norm_name") != "")).groupBy("process_id", "norm_name").agg(F.max_by("cpf", "source").alias("known"))
    joined = keyed.join(known, ["process_id", "norm_name"], "left")
    cpf = F.when(F.col("cpf") != "", F.col("cpf")).otherwise(F.col("known"))
    nobody = (F.coalesce(cpf, F.lit("")) == "") & (F.col("norm_name") == "")
    key = F.when(nobody, F.concat_ws("_", F.lower(F.col("source").cast("string")), "participant_id")).otherwise(n.participant_key(cpf, F.col("norm_name")))
    return joined.select("process_id", "source", "participant_id", key.alias("participant_key"))


def conflict_keys(rows: DataFrame) -> DataFrame:
    """(process_id, source, field_id) of fields (field::buyer where a buyer is named) for which one source's documents give values that differ."""
    normal = rows.where(F.trim("value") != "").withColumn("norm", n.value("value", F.col("field_type")))
    key = F.when(F.col("participant_id").isNotNull(), F.concat_ws("::", "field_id", "participant_id")).otherwise(F.col("field_id"))
    return normal.groupBy("process_id", "source", key.alias("field_id")).agg(F.count_distinct("norm").alias("n")).where("n > 1").drop("n")


#: What the text beside an amount of a contract has to hold: patterns of which each inner list's all must be found, of one list at least.
CONTRACT_LABELS = {
    "financial.financing": [[r"B\s*\.?\s*4\s*\.?\s*1(?![A-Za-z0-9_])", r"valor\s+do\s+financiamento(?:\s+concedido\s+pela\s+caixa)?"], [r"B\s*1\s*\.?\s*3(?![A-Za-z0-9_])", r"financiamento\s+concedido\s+pela\s+caixa"]],
    "financial.downPayment": [[r"B\s*\.?\s*4\s*\.?\s*2(?![A-Za-z0-9_])", r"recursos\s+pr[oó]prios"], [r"B\s*1\s*\.?\s*1(?![A-Za-z0-9_])", r"recursos\s+pr[oó]prios"]],
    "financial.housingEntry": [[r"B\s*\.?\s*4\s*\.?\s*2(?![A-Za-z0-9_])", r"recursos\s+pr[oó]prios"], [r"B\s*1\s*\.?\s*1(?![A-Za-z0-9_])", r"recursos\s+pr[oó]prios"]],
    "financial.fgts": [[r"B\s*\.?\s*4\s*\.?\s*3(?![A-Za-z0-9_])", "fgts"], [r"B\s*1\s*\.?\s*2(?![A-Za-z0-9_])", "fgts"]],
    "financial.subsidy": [[r"B\s*\.?\s*4\s*\.?\s*5(?![A-Za-z0-9_])", "(?:desconto|subs[ií]dio)"]],
    "financial.totalValue": [[r"valor\s+destinado\s+[àa]\s+aquisi[cç][aã]o|valor\s+do\s+contrato|valor\s+de\s+aquisi[cç][aã]o[^.]*?equivale"]],
}


def verified(rows: DataFrame) -> DataFrame:
    """rows (source, field_id, field_type, value, confidence, raw) with issue: a critical, financial or identifying value whose raw text doesn't hold it, or lacks the label that a contract's amount stands beside. Such a value is taken out: null, with confidence 0."""
    wanted = F.startswith("field_id", F.lit("financial.")) | F.col("field_id").isin(*catalog.EVIDENCED)
    for source, names in catalog.CRITICAL.items():
        wanted = wanted | ((F.col("source") == source) & F.col("field_id").isin(names.split()))
    raw = F.trim(F.coalesce("raw", F.lit("")))
    compact = F.regexp_replace(raw, n.WS + "+", " ")
    labelled = F.lit(True)
    for field, ways in CONTRACT_LABELS.items():
        found = F.lit(False)
        for all_of in ways:
            one = F.lit(True)
            for p in all_of:
                one = one & compact.rlike(f"(?iu){p}")
            found = found | one
        labelled = F.when(F.col("field_id") == field, found).otherwise(labelled)
    labelled = F.when(F.col("source") == "MINUTA", labelled).otherwise(True)
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    issue = wanted & filled & ((raw == "") | ~holds_value(F.col("value"), raw, F.col("field_type")) | ~labelled)
    # Held by explode, so that a filter on what is taken out doesn't judge each row once more.
    marked = rows.drop("issue").select("*", F.explode_outer(F.array(issue)).alias("issue"))
    return marked.withColumns({"value": F.when(~F.col("issue"), F.col("value")), "confidence": F.when(F.col("issue"), 0).otherwise(F.col("confidence")), "raw": F.when(~F.col("issue"), F.col("raw"))})


def consolidate(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What one source's documents say together, as values, conflicts and issues.

    rows: (process_id, source, doc_ord, field_id, field_type, participant_id,
    value, confidence, raw). Values are checked against their evidence, then the
    surest of each field (and buyer, the first one where none is named) stands,
    the earliest document's of several; fields whose values differ are conflicts.
    """
    repeated = [f for f, _, _, multiple, _ in catalog.fields() if multiple]
    person = F.when(F.col("field_id").isin(repeated), F.coalesce("participant_id", F.lit("buyer_1")))
    checked = verified(rows.withColumn("participant_id", person))
    values = best(checked, ["process_id", "source", "field_id", "participant_id"], "doc_ord")
    key = F.when(F.col("participant_id").isNotNull(), F.concat_ws("::", "field_id", "participant_id")).otherwise(F.col("field_id"))
    issues = checked.where("issue").select("process_id", "source", key.alias("field_id")).distinct()
    return values, conflict_keys(checked), issues


def recovered(initial: DataFrame, recovery: DataFrame, keys: list[str], prefer_recovery: bool = False) -> DataFrame:
    """A field's values after a second reading: the first reading's where it has one, else the second's; the other way round where prefer_recovery is set. (keys and field_id, value, confidence; a field's rows come as a whole from one reading.)"""
    both = initial.withColumn("reading", F.lit(0)).unionByName(recovery.withColumn("reading", F.lit(1)))
    of = Window.partitionBy(*keys, "field_id")
    has = lambda reading: F.coalesce(F.max(F.when(F.col("reading") == reading, F.trim("value") != "")).over(of), F.lit(False))
    by_need = F.when(has(0), 0).otherwise(F.max("reading").over(of))
    chosen = F.when(has(1), 1).otherwise(by_need) if prefer_recovery else by_need
    named = both.where(F.forall(F.array(*[F.col(c).isNotNull() for c in (*keys, "field_id")]), lambda x: x))
    return named.withColumn("_chosen", chosen).where("reading = _chosen").drop("reading", "_chosen")


def missing_critical(rows: DataFrame) -> DataFrame:
    """(process_id, source, field_id): critical fields without a value, of sources that gave any row."""
    critical = F.try_element_at(catalog.constant_map({s: names.split() for s, names in catalog.CRITICAL.items()}), F.col("source"))
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    per = rows.groupBy("process_id", "source").agg(F.collect_set(F.when(filled & F.array_contains(critical, F.col("field_id")), F.col("field_id"))).alias("have"))
    return n.opened(per, F.array_except(critical, "have"), "field_id", "process_id", "source")


def coerced(rows: DataFrame) -> DataFrame:
    """A reader's output as (doc_id, field_id, value, confidence, participant_id, page, raw): exactly the checklist's fields.

    rows: (doc_id, ord, field_id, value, confidence, participant_id, page, raw),
    of which unknown fields go. Of a field that doesn't repeat the first row
    stands; repeated ones are numbered, and a buyer without a name is buyer_<n>.
    A confidence above 0 and up to 1 is a share; others are cut to 0 to 100. A
    field without a row is null with confidence 0.
    """
    # One row of constants a field; the window is over a document's rows of one field.
    fields = F.array(*[F.struct(F.lit(f).alias("field_id"), F.lit(m).alias("multiple")) for f, _, _, m, _ in catalog.fields()])
    known = rows.where(F.col("field_id").isin([f[0] for f in catalog.fields()]))
    numbered = known.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "field_id").orderBy("ord")))
    repeated = F.col("field_id").isin([f[0] for f in catalog.fields() if f[3]])
    numbered = numbered.where(repeated | (F.col("nth") == 1))
    number = F.col("confidence").try_cast("double")
    share = F.when((number > 0) & (number <= 1), number * 100).otherwise(number)
    name = F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce("participant_id", F.lit("")))), "[^a-z0-9_-]+", "_"), 1, 60)
    name = F.when(repeated, F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("buyer_"), F.col("nth").cast("string"))))
    page = F.when((F.col("page") > 0) & (F.col("page") == F.floor("page")), F.col("page").cast("int"))
    have = numbered.select("doc_id", "field_id", "value", F.when(share.isNull() | F.isnan(share), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)) + 0.5)).cast("int").alias("confidence"), name.alias("participant_id"), page.alias("page"), F.nullif(F.substring(F.trim("raw"), 1, 500), F.lit("")).alias("raw"))
    every = rows.select("doc_id").distinct().withColumn("f", F.explode(fields)).select("doc_id", "f.field_id")
    return every.join(have, ["doc_id", "field_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0)))


def reservation_gaps(rows: DataFrame) -> DataFrame:
    """(process_id, financial, identity, evidenced): whether a reservation lacks its total or financing, or one of the seven fields that name it, and whether a value at 70 or more has its text beside it."""
    # The fields that name a reservation.
    identity = ["buyer.name", "buyer.cpf", "buyer.email", "buyer.phone", "property.development", "property.tower", "property.unit"]
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    per = rows.groupBy("process_id").agg(F.collect_set(F.when(filled, F.col("field_id"))).alias("have"), F.bool_or(filled & (F.col("confidence") >= catalog.LOW_CONFIDENCE) & (F.coalesce(F.trim("raw"), F.lit("")) != "")).alias("evidenced"))
    lacks = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), "have")) > 0
    return per.select("process_id", lacks(["financial.totalValue", "financial.financing"]).alias("financial"), lacks(identity).alias("identity"), "evidenced")


#: What the text beside an amount of a reservation says, by field; other amounts go by the down payment's.
RESERVATION_LABELS = {
    "financial.totalValue": r"(?iu)valor\s+(?:do\s+contrato|total)",
    "financial.downPayment": r"(?iu)(?:entrada|recursos\s+pr[oó]prios)",
    "financial.financing": r"(?iu)financiamento|valor\s+financiado",
    "financial.fgts": r"(?iu)fgts",
    "financial.subsidy": r"(?iu)subs[ií]dio|desconto",
}


def reservation_score(field_id: str, value: str, confidence: str, raw: str) -> Column:
    """How much a reading of a reservation counts: its confidence, 15 more with a raw text, 20 more where that holds its digits; for a financial field 40 more where the text has its label, and 40 less where not."""
    text, own = F.coalesce(raw, F.lit("")), n.digits(value)
    label = F.coalesce(F.try_element_at(catalog.constant_map(RESERVATION_LABELS), F.col(field_id)), F.lit(RESERVATION_LABELS["financial.downPayment"]))
    score = F.col(confidence) + F.when(text != "", 15).otherwise(0) + F.when((own != "") & F.contains(n.digits(text), own), 20).otherwise(0)
    return score + F.when(~F.startswith(field_id, F.lit("financial.")), 0).when(label.isNotNull() & F.regexp_like(text, label), 40).otherwise(-40)


def scored_best(rows: DataFrame, keys: list[str], order: str, raw: str = "raw") -> DataFrame:
    """The candidate of the highest reservation_score(), the earliest of several."""
    filled = rows.where(F.trim("value") != "").withColumn("score", reservation_score("field_id", "value", "confidence", raw))
    return filled.groupBy(*keys).agg(F.max_by(F.struct("value", "score"), F.struct(F.col("score"), -F.col(order))).alias("b")).select(*keys, "b.value", "b.score")


def fold_participants(rows: DataFrame, order: str) -> DataFrame:
    """One row per process, source and participant: the last tax id and the last name that aren't blank."""
    last = lambda c: F.max_by(F.col(c), F.when(F.trim(c) != "", F.col(order))).alias(c)
    return rows.groupBy("process_id", "source", "participant_id").agg(last("cpf"), last("name"))


def expand_participants(participants: DataFrame) -> DataFrame:
    """Each participant with each repeatable field of the checklist."""
    repeatable = [F.lit(f) for f, _, _, multiple, _ in catalog.fields() if multiple]
    return participants.select("*", F.explode(F.array(*repeatable)).alias("field_id"))


def quality_totals(reports: DataFrame) -> DataFrame:
    """One row: what all quality reports miss, doubt and find ambiguous."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return reports.agg(F.count("*").alias("n_reports"), total("n_missing"), total("n_low"), total("n_ambiguous"))


def extraction_alerts(reports: DataFrame) -> DataFrame:
    """(process_id, severity, sources, coverage, n_missing, n_low, n_ambiguous): critical where a source failed or gave nothing, a warning where one is partial; the figures are of those sources."""
    failed = (F.col("status") == "FAILED") | (F.col("coverage") == 0)
    partial = (F.col("status") == "PARTIAL") | (F.col("n_missing") > 0) | (F.col("n_low") > 0) | (F.col("n_ambiguous") > 0)
    bad = reports.withColumn("failed", failed).where(failed | partial)
    per = bad.groupBy("process_id", "failed").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.min("coverage").alias("coverage"), F.sum("n_missing").alias("n_missing"), F.sum("n_low").alias("n_low"), F.sum("n_ambiguous").alias("n_ambiguous")
    )
    rest = ["failed", "sources", "coverage", "n_missing", "n_low", "n_ambiguous"]
    worst = per.groupBy("process_id").agg(F.max_by(F.struct(*rest), "failed").alias("w")).select("process_id", "w.*")
    return worst.select("process_id", F.when(F.col("failed"), "critical").otherwise("warning").alias("severity"), *rest[1:])


#: The types of documents that stand for what is compared; all others are what it is compared with.
IMAGES = ("PRINT", "IMAGE", "TIFF")


def two_sides(rows: DataFrame) -> DataFrame:
    """rows (process_id, doc_ord, type, field_id, value, confidence) as evidence of two sources, IMAGE (source_ord 0) and DOCUMENT (1): of each side the surest value of a field, the earliest document's of several."""
    image = F.col("type").isin(*IMAGES)
    sided = rows.withColumns({"source": F.when(image, "IMAGE").otherwise("DOCUMENT"), "source_ord": F.when(image, 0).otherwise(1)})
    return best(sided, ["process_id", "source_ord", "source", "field_id"], "doc_ord")
