"""Layered readings of documents: what patterns read, what a model read, and what was read again where something was missing.

The readings of a document are packed once, by document, after texts were read
where they lie: texts are never shuffled, and packing combines before it
shuffles. What a document lacks, what is to be read again for it, and which
reading of a field counts are then decided on the packed rows. Readings that
nobody asked for don't count, so a table may hold more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions import normalize as n
from tallyspark.operators import evidence, extract, reconcile

KEYS = ["process_id", "source", "doc_ord"]
SAYS = ("says_identity", "says_unit", "payment_table", "summary_table", "says_fgts", "says_subsidy")
RESERVATION = "DADOS_RESERVA"
#: The readings in the order in which the earlier of two equal ones counts: of texts, and of a reservation's images.
TEXT_LAYERS = ("DETERMINISTIC", "PROVIDER", "RECOVERY")
RESERVATION_LAYERS = ("FOCUSED", "DETERMINISTIC", "PAYMENT", "SUMMARY", "IDENTITY", "UNIT", "GENERIC")

#: The groups of fields that a reservation is read again for.
GROUPS = {
    "identity": ("buyer.name", "buyer.cpf", "buyer.rg", "buyer.maritalStatus", "buyer.address", "buyer.email", "buyer.phone"),
    "unit": ("property.development", "property.registration", "property.unit", "property.tower"),
    "payment": ("financial.totalValue", "financial.financing"),
}
#: What a reservation's text says of a group, and of its kind of table.
IDENTITY_WORDS = r"(?iu)nome(?:\s+do\s+cliente)?|cliente|proponente|comprador|adquirente|cpf\s*\/?\s*cnpj|cpfc?npj|estado\s+civil|e-?mail|correio\s+eletr[oô]nico|telefone|celular|fone|whatsapp"
UNIT_WORDS = r"(?i)\bunidade\b|\btorre\b|matr[ií]cula"
PAYMENT_TABLE = r"(?iu)condi[cç][aã]o\s+de\s+pagamento|valor\s+do\s+contrato|\bfinanciamento\b|\bsinal\b|\bmensal\b"
SUMMARY_TABLE = r"(?iu)valor\s+avalia[cç][aã]o|valor\s+aprovado|valor\s+subs[ií]dio|valor\s*fgts"


def _rows_of(docs: DataFrame, readings: DataFrame, catalogue: dict | None, sources: list[str] | None) -> DataFrame:
    """A row for each reading of a field, and one at least for each document, with what its text says of itself."""
    text, plain = F.coalesce("text", F.lit("")), n.text("text")
    says = {"says_identity": text.rlike(IDENTITY_WORDS), "says_unit": text.rlike(UNIT_WORDS), "payment_table": text.rlike(PAYMENT_TABLE), "summary_table": text.rlike(SUMMARY_TABLE), "says_fgts": plain.rlike(r"\bFGTS\b"), "says_subsidy": plain.rlike(r"\bSUBSIDIO\b|\bDESCONTO\b")}
    read = extract.extracted(docs, catalogue, sources).withColumns(says)
    mine = read.select(*KEYS, F.coalesce("failed", F.lit(False)).alias("failed"), *says, F.posexplode_outer("fields").alias("nth", "f")).select(
        *KEYS, "failed", *says, "nth", F.lit("DETERMINISTIC").alias("layer"), "f.field_id", F.lit(None).cast("string").alias("participant_id"), "f.value", F.col("f.confidence").cast("int").alias("confidence"), "f.raw"
    )
    no = F.lit(False)
    theirs = readings.select(*KEYS, no.alias("failed"), *[no.alias(s) for s in says], "nth", "layer", "field_id", "participant_id", "value", F.col("confidence").cast("int").alias("confidence"), "raw")
    return mine.unionByName(theirs)


def _packed(rows: DataFrame) -> DataFrame:
    kinds = catalog.constant_map({f: k for f, _, k, _, _ in catalog.fields()})
    typed = rows.withColumn("field_type", F.coalesce(F.try_element_at(kinds, F.col("field_id")), F.lit("texto")))
    # A reservation's readings are held against the text they were read from at once; a text's when its source is consolidated.
    own, image = ("value", "confidence", "raw"), F.col("source") == RESERVATION
    checked = evidence.verified(typed.withColumns({f"_{c}": F.col(c) for c in own}))
    both = checked.withColumns({c: F.when(image, F.col(c)).otherwise(F.col(f"_{c}")) for c in own})
    order = F.array_position(F.array(*map(F.lit, dict.fromkeys((*TEXT_LAYERS, *RESERVATION_LAYERS)))), F.col("layer"))
    reservation_order = F.array_position(F.array(*map(F.lit, RESERVATION_LAYERS)), F.col("layer"))
    rank = F.when(image, reservation_order).otherwise(order).cast("int")
    filled = F.coalesce(F.trim("value"), F.lit("")) != ""
    row = F.struct((-evidence.reservation_score("field_id", "value", "confidence", "raw")).alias("cost"), rank.alias("rank"), "nth", "layer", "field_id", "participant_id", "value", "confidence", "raw")
    flags = ("failed", *SAYS)
    return both.groupBy(*KEYS).agg(F.collect_list(F.when(filled & (rank > 0), row)).alias("rows"), *[F.bool_or(c).alias(c) for c in flags])


def _ids(rows) -> Column:
    return F.array_distinct(F.transform(rows, lambda r: r["field_id"]))


def _of(rows, *layers: str) -> Column:
    return F.filter(rows, lambda r: r["layer"].isin(*layers))


def _text_plan(rows: Column, critical: Column, failed: Column) -> Column:
    """(asked, recovered, reread, chosen) of a text: patterns count before the model; what both lack of the source's critical fields is asked for again, unless the model didn't answer."""
    by_pattern, by_model, again = _of(rows, "DETERMINISTIC"), _of(rows, "PROVIDER"), _of(rows, "RECOVERY")
    asked = F.when(failed, F.array().cast("array<string>")).otherwise(F.array_except(critical, F.array_union(_ids(by_pattern), _ids(by_model))))
    got = F.array_intersect(asked, _ids(again))
    model = F.filter(by_model, lambda r: ~F.array_contains(_ids(by_pattern), r["field_id"]))
    chosen = F.concat(by_pattern, model, F.filter(again, lambda r: F.array_contains(got, r["field_id"])))
    return F.struct(asked.alias("asked"), got.alias("recovered"), F.array().cast("array<string>").alias("reread"), chosen.alias("chosen"))


def recovery_groups(available: Column, says_identity: Column, says_unit: Column, payment_table: Column) -> Column:
    """The groups of fields that a reservation is to be read again for: those its text speaks of, else those it has something of, that lack a field; all where there is neither."""
    lit = lambda names: F.array(*map(F.lit, names))
    lacks = {g: F.size(F.array_except(lit(names), available)) > 0 for g, names in GROUPS.items()}
    has = {g: F.arrays_overlap(lit(names), available) for g, names in GROUPS.items()}
    said = {"identity": says_identity, "payment": payment_table, "unit": says_unit}
    any_said, any_has = says_identity | says_unit | payment_table, has["identity"] | has["unit"] | has["payment"]
    pick = lambda of: F.array_compact(F.array(*[F.when(of[g] & lacks[g], F.lit(g)) for g in ("identity", "payment", "unit")]))
    return F.when(any_said, pick(said)).when(any_has, pick(has)).otherwise(lit(["identity", "payment", "unit"]))


def composed(chosen: Column, says_fgts: Column, says_subsidy: Column) -> Column:
    """A reservation's rows with its own resources as what its parts leave of the total, unless they are told by themselves.

    A signal alone isn't them. They are taken out where they can't be derived
    safely: without a total or financing, with a doubtful part, or with one that
    the text mentions and nobody could read; and left where they would be below 0.
    """
    own, parts = "financial.downPayment", ("financial.totalValue", "financial.financing", "financial.fgts", "financial.subsidy")

    def of(rows):
        row = lambda f: F.get(F.filter(rows, lambda r: r["field_id"] == f), F.lit(0))
        # What tells own resources, and the wording of what was calculated.
        said = F.coalesce(row(own)["raw"], F.lit(""))
        explicit = row(own).isNotNull() & said.rlike(r"(?iu)recursos\s+pr[oó]prios|entrada\s+total") & ~said.rlike(r"(?i)\bsinal\b")
        low = F.exists(rows, lambda r: r["field_id"].isin(*parts) & (r["confidence"] < catalog.LOW_CRITICAL))
        total, financing, fgts, subsidy = (n.money_decimal(row(f)["value"]) for f in parts)
        zero = F.lit(0).cast("decimal(28,2)")
        left = total - financing - F.coalesce(fgts, zero) - F.coalesce(subsidy, zero)
        unsafe = total.isNull() | financing.isNull() | low | (says_fgts & row(parts[2]).isNull()) | (says_subsidy & row(parts[3]).isNull())
        rest = F.filter(rows, lambda r: r["field_id"] != own)

        def calculated(amount):
            shown = reconcile.money_text(amount)
            labels = ("Valor do contrato: ", "Financiamento: ", "FGTS: ", "Subsídio: ")
            raw = F.concat_ws(" | ", *[F.concat(F.lit(label), row(f)["value"]) for label, f in zip(labels, parts, strict=True)], F.concat(F.lit("Recursos próprios calculados: "), shown))
            new = row(parts[0]).withField("layer", F.lit("CALCULATED")).withField("field_id", F.lit(own)).withField("value", shown).withField("confidence", F.lit(88)).withField("raw", raw)
            return F.when(amount < 0, rows).otherwise(F.concat(rest, F.array(new)))

        return F.when(explicit, rows).when(unsafe, rest).otherwise(n.let(left, calculated))

    return n.let(chosen, of)


def _reservation_plan(rows: Column, says_identity: Column, says_unit: Column, payment_table: Column, summary_table: Column, says_fgts: Column, says_subsidy: Column) -> Column:
    """(asked, recovered, reread, chosen) of a reservation's image: the groups asked for, the fields that only rereading gave, the readings that were made again, and of each field the reading of the highest score."""
    sure = lambda f: F.exists(_of(rows, "FOCUSED"), lambda r: (r["field_id"] == f) & (r["confidence"] >= catalog.RELIABLE) & (F.coalesce(r["raw"], F.lit("")) != ""))
    total = sure("financial.totalValue")
    complete = total & sure("financial.financing")
    first = _of(rows, "FOCUSED", "DETERMINISTIC")
    evident = F.exists(first, lambda r: (r["confidence"] >= catalog.LOW_CONFIDENCE) & (F.coalesce(r["raw"], F.lit("")) != ""))
    groups = lambda seen: recovery_groups(_ids(seen), says_identity, says_unit, payment_table)
    asked = F.when(~evident & ~complete, F.array_union(groups(first), F.array(F.lit("payment")))).otherwise(groups(first))

    def directed(asked):
        wants = lambda g: F.array_contains(asked, g)
        again = {"PAYMENT": F.when(payment_table, ~complete).otherwise(wants("payment")), "SUMMARY": summary_table & ~total, "IDENTITY": wants("identity"), "UNIT": wants("unit")}
        return n.let(F.array_compact(F.array(*[F.when(c, F.lit(layer)) for layer, c in again.items()])), lambda layers: generic(asked, layers))

    def generic(asked, layers):
        seen = F.concat(first, F.filter(rows, lambda r: F.array_contains(layers, r["layer"])))
        more = (F.size(asked) > 0) & (F.size(groups(seen)) > 0)
        return n.let(F.when(more, F.concat(layers, F.array(F.lit("GENERIC")))).otherwise(layers), lambda reread: decided(asked, reread))

    def decided(asked, reread):
        seen = F.concat(first, F.filter(rows, lambda r: F.array_contains(reread, r["layer"])))
        chosen = F.transform(F.array_sort(_ids(seen)), lambda f: F.array_min(F.filter(seen, lambda r: r["field_id"] == f)))
        got = F.array_intersect(F.array_except(_ids(seen), _ids(first)), F.flatten(F.array(*[F.array(*map(F.lit, names)) for names in GROUPS.values()])))
        return F.struct(asked.alias("asked"), got.alias("recovered"), reread.alias("reread"), composed(chosen, says_fgts, says_subsidy).alias("chosen"))

    return n.let(asked, directed)


def layered(docs: DataFrame, readings: DataFrame, catalogue: dict | None = None, sources: list[str] | None = None) -> DataFrame:
    """(process_id, source, doc_ord, deterministic, asked, recovered, reread, chosen) for each document: which fields patterns read, what was asked for again (critical fields of a text, groups of a reservation), which fields that gave, which readings of a reservation were made again, and the rows that count.

    docs: (process_id, source, doc_ord, text, failed), failed where the model gave
    no answer. readings: (process_id, source, doc_ord, layer, nth, field_id,
    participant_id, value, confidence, raw), layer one of TEXT_LAYERS or
    RESERVATION_LAYERS but DETERMINISTIC, which is read here. Blank values don't
    stand. A reading of a document that isn't in docs makes one without a text.
    """
    critical = F.coalesce(F.try_element_at(catalog.constant_map({s: names.split() for s, names in catalog.CRITICAL.items()}), F.col("source")), F.array().cast("array<string>"))
    packed = _packed(_rows_of(docs, readings, catalogue, sources))
    plan = F.when(F.col("source") == RESERVATION, _reservation_plan(F.col("rows"), *map(F.col, SAYS))).otherwise(_text_plan(F.col("rows"), critical, F.col("failed")))
    lists = lambda c: F.array_sort(f"p.{c}").alias(c)
    planned = packed.withColumn("p", plan).withColumn("deterministic", F.array_sort(_ids(_of(F.col("rows"), "DETERMINISTIC"))))
    return planned.select(*KEYS, "deterministic", lists("asked"), lists("recovered"), "p.reread", "p.chosen")


def chosen_rows(found: DataFrame) -> DataFrame:
    """The rows of layered() that count, one each: (process_id, source, doc_ord, layer, field_id, participant_id, value, confidence, raw, field_type)."""
    kinds = catalog.constant_map({f: k for f, _, k, _, _ in catalog.fields()})
    each = n.opened(found, F.col("chosen"), "r", *KEYS).select(*KEYS, "r.layer", "r.field_id", "r.participant_id", "r.value", "r.confidence", "r.raw")
    return each.withColumn("field_type", F.coalesce(F.try_element_at(kinds, F.col("field_id")), F.lit("texto")))


def consolidated(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """evidence.consolidate() of the rows that count: values, conflicts and issues of each source."""
    return evidence.consolidate(chosen_rows(found))
