"""Master data of developments: units from two readers, their quality, and what they say as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import normalize as n


def same_text(v) -> Column:
    """What is compared: letters and digits alone."""
    return F.regexp_replace(n.text(v), r"[^A-Z0-9]", "")


def unit_key(tower, unit, typology) -> Column:
    kind = F.trim(F.coalesce(typology, F.lit("")))
    return F.when(kind != "", same_text(kind)).otherwise(F.concat_ws("::", same_text(tower), same_text(unit)))


def decimal_or_null(v) -> Column:
    return F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(28,8)")


def keyed_units(units: DataFrame) -> DataFrame:
    return units.withColumn("unit_key", unit_key(F.col("tower"), F.col("unit"), F.col("typology")))


def dedup_units(units: DataFrame) -> DataFrame:
    """One row for each key: the most confident, then the least tower, unit and area."""
    pick = keyed_units(units).groupBy("unit_key").agg(F.min_by(F.struct(*units.columns), F.struct(-F.col("confidence"), F.col("tower"), F.col("unit"), F.col("private_area"))).alias("u"))
    return pick.select("unit_key", "u.*")


def last_units(units: DataFrame, order: str) -> DataFrame:
    """One row for each key: the last one read."""
    pick = keyed_units(units).groupBy("unit_key").agg(F.max_by(F.struct(*units.columns), order).alias("u"))
    return pick.select("unit_key", "u.*")


#: What two readers have to agree on.
COMPARED = ("private_area", "common_area", "total_area", "ideal_fraction", "iptu", "typology")


def reconcile_units(ocr: DataFrame, vision: DataFrame) -> DataFrame:
    """A full outer join of both readers' units by key (one row for each, see last_units() and dedup_units()): agreement on all of COMPARED raises confidence, all else caps it at 69 and asks for a review. The first reader's values stand where it has the unit."""
    a, b = ocr.withColumn("here", F.lit(True)).alias("a"), vision.withColumn("here", F.lit(True)).alias("b")
    both = a.join(b, F.col("a.unit_key") == F.col("b.unit_key"), "full_outer")
    same = F.lit(True)
    for c in COMPARED:
        same = same & (same_text(f"a.{c}") == same_text(f"b.{c}"))
    outcome = F.when(F.col("b.here").isNull(), "ONLY_OCR").when(F.col("a.here").isNull(), "ONLY_VISION").when(same, "AGREED").otherwise("DIVERGED")
    sure = F.least(F.lit(99), F.greatest("a.confidence", "b.confidence") + 5)
    confidence = F.when(outcome == "AGREED", sure).otherwise(F.least(F.coalesce("a.confidence", F.lit(99)), F.coalesce("b.confidence", F.lit(99)), F.lit(69)))
    mine = lambda c: F.when(F.col("a.here"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    unit = F.struct(*[mine(c).alias(c) for c in ("tower", "unit", "typology", "private_area")])
    named = F.coalesce(F.trim(unit["typology"]), F.lit("")) != ""
    label = F.when(named, F.concat(unit["typology"], F.lit(" · área "), F.coalesce(unit["private_area"], F.lit("não informada")))).otherwise(F.concat(F.lit("Torre "), unit["tower"], F.lit(" · apartamento "), unit["unit"]))
    # What a review is asked for.
    review = (
        F.when(outcome == "ONLY_OCR", F.concat(label, F.lit(" não foi confirmado pela visão da IA."))).when(outcome == "DIVERGED", F.concat(label, F.lit(" tem divergência entre OCR e visão da IA.")))
        .when(outcome == "ONLY_VISION", F.concat(label, F.lit(" foi encontrada apenas pela visão da IA.")))
    )
    return both.select(F.coalesce("a.unit_key", "b.unit_key").alias("unit_key"), outcome.alias("outcome"), confidence.cast("int").alias("confidence"), mine("private_area").alias("private_area"), review.alias("review"))


def quality_issues(units: DataFrame) -> DataFrame:
    """units (private_area, total_area, ideal_fraction, and evidence where there is a column of that name) with issues, which need a review, and warnings."""
    private, total, share = (decimal_or_null(F.col(c)) for c in ("private_area", "total_area", "ideal_fraction"))
    no_evidence = F.coalesce(F.trim("evidence"), F.lit("")) == "" if "evidence" in units.columns else F.lit(False)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = F.array_compact(F.array(
        F.when(no_evidence, F.lit("NO_EVIDENCE")), F.when(private.isNull() | (private <= 0), F.lit("PRIVATE_AREA")), F.when(total < private, F.lit("TOTAL_BELOW_PRIVATE")),
        F.when((share <= 0) | (share >= 1), F.lit("FRACTION_RANGE")),
    ))
    return units.withColumns({"issues": F.array_join(rules, ","), "warnings": F.when(blank("total_area") | blank("ideal_fraction"), "INCOMPLETE").otherwise("")})


def empty_set_issues(developments: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """(key, issue) of developments without a unit: whether types were seen (an array column typologies) or nothing was."""
    none = developments.join(units.select(key), key, "left_anti")
    return none.select(key, F.when(F.size("typologies") > 0, F.concat(F.lit("TYPES_WITHOUT_AREA:"), F.array_join("typologies", ", "))).otherwise("NO_UNITS").alias("issue"))


def type_signature(typology, *areas) -> Column:
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    return F.concat_ws("::", F.coalesce(F.nullif(F.trim(typology), F.lit("")), F.lit("Tipo não informado")), *[dash(a) for a in areas])


#: The parts of a type's signature.
SIGNED = ("typology", "private_area", "common_area", "total_area", "ideal_fraction")


def review(units: DataFrame, key: str) -> DataFrame:
    """Counts that a reviewer sees before saving. Units without a name for their development (a column name) can't be saved."""
    signature = type_signature(*map(F.col, SIGNED))
    named = F.max(F.trim("name") != "") if "name" in units.columns else F.lit(True)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    incomplete = F.count_if(blank("private_area") | blank("typology"))
    return units.groupBy(key).agg(
        F.count_distinct(F.nullif(F.trim("tower"), F.lit(""))).alias("n_towers"), F.count("*").alias("n_units"), F.count_distinct(F.when(~signature.startswith("Tipo não informado::"), signature)).alias("n_types"),
        incomplete.alias("n_incomplete"), F.count_if(F.col("confidence") < 80).alias("n_low"), (named & (F.count("*") > 0) & (incomplete == 0)).alias("can_save"),
    )


#: The fields that a unit of the register speaks of and the columns they come from. The first stand even without a value.
ALWAYS = {"property.development": "name", "property.registration": "registration", "property.privateArea": "private_area", "property.commonArea": "common_area", "property.totalArea": "total_area", "property.idealFraction": "ideal_fraction", "property.iptu": "iptu"}
IF_FILLED = {"seller.legalName": "seller_name", "seller.cnpj": "seller_cnpj", "property.unit": "unit", "property.tower": "tower", "property.type": "typology"}


def as_evidence(units: DataFrame, key: str) -> DataFrame:
    """Units with their development's columns as evidence of the register: (key, source, field_id, value, confidence). A unit's own registration goes before its development's (development_registration)."""
    registration = F.coalesce("registration", "development_registration") if "development_registration" in units.columns else F.col("registration")
    col = lambda c: registration if c == "registration" else F.col(c)
    pair = lambda f, c: F.struct(F.lit(f).alias("field_id"), col(c).alias("value"))
    rows = F.array_compact(F.array(*[pair(f, c) for f, c in ALWAYS.items()], *[F.when(F.trim(c) != "", pair(f, c)) for f, c in IF_FILLED.items()]))
    return units.select(key, "confidence", F.explode(rows).alias("r")).select(key, F.lit("CADASTRO_EMPREENDIMENTO").alias("source"), "r.field_id", "r.value", "confidence")


def with_register(evidence: DataFrame, register: DataFrame, order: int) -> DataFrame:
    """evidence with the register's rows appended, as the source after all others."""
    return evidence.unionByName(register.withColumn("source_ord", F.lit(order)), allowMissingColumns=True)


def developments_with_units(developments: DataFrame, units: DataFrame, key: str = "development_id") -> DataFrame:
    """Developments with their units nested in natural order (an empty array where there are none). Units of one development are as many as a site has."""
    rest = [c for c in units.columns if c != key]
    order = F.struct(natural_order(F.coalesce("tower", F.lit(""))).alias("_t"), natural_order(F.coalesce("unit", F.lit(""))).alias("_u"), F.struct(*rest).alias("u"))
    nested = units.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["u"]).alias("units"))
    return developments.join(nested, key, "left").withColumn("units", F.coalesce("units", F.array().cast(nested.schema["units"].dataType)))


def replace_children(units: DataFrame, sent: DataFrame, saved: DataFrame, key: str = "development_id") -> DataFrame:
    """units after the developments in saved were saved: their old units go, whatever was sent comes."""
    return units.join(saved.select(key).distinct(), key, "left_anti").unionByName(sent.join(saved.select(key).distinct(), key, "left_semi"))


def delete_cascade(developments: DataFrame, units: DataFrame, gone: DataFrame, key: str = "development_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the developments of gone (key, organization_id), which only their own organisation can delete."""
    left = developments.join(gone, [key, "organization_id"], "left_anti")
    deleted = developments.join(gone, [key, "organization_id"], "left_semi").select(key)
    return left, units.join(deleted, key, "left_anti")


def towers_by_apartments(groups: DataFrame) -> DataFrame:
    """A row for each tower and apartment of a group (arrays towers and apartments, which its other columns hold for). Where either is empty the group is one row with both blank; a group without a private area has none."""
    rest = [c for c in groups.columns if c not in ("towers", "apartments")]
    both = (F.size("towers") > 0) & (F.size("apartments") > 0)
    blank = F.array(F.lit(""))
    each = groups.where(F.coalesce(F.trim("private_area"), F.lit("")) != "").select(*rest, F.when(both, F.col("apartments")).otherwise(blank).alias("_a"), F.explode(F.when(both, F.col("towers")).otherwise(blank)).alias("tower"))
    return each.select(*rest, "tower", F.explode("_a").alias("unit"))


def merged_pages(pages: DataFrame, key: str) -> DataFrame:
    """What the pages of one development say of it: the first name that isn't the stand-in, and the first city, registration and seller that aren't null, by page."""
    first = lambda c, ok: F.min_by(F.col(c), F.when(ok, F.col("page"))).alias(c)
    named = F.col("name") != "Empreendimento sem nome"
    per = pages.groupBy(key).agg(first("name", named), *[first(c, F.col(c).isNotNull()) for c in ("city", "registration", "seller_name", "seller_cnpj")])
    return per.withColumn("name", F.coalesce("name", F.lit("Empreendimento sem nome")))


def merged_notes(ocr: Column, vision: Column) -> Column:
    """Both readers' notes as one list, each with its reader's name, without repeats."""
    tell = lambda notes, who: F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda x: F.concat(F.lit(who), x))
    return F.array_union(tell(ocr, "OCR: "), tell(vision, "Visão IA: "))


def natural_order(v) -> Column:
    """A sort key in which 9 stands before 10: a digit run is its length without leading zeros, as three digits, and then itself."""
    runs = F.regexp_extract_all(n.text(v), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(r)).cast("string"), 3, "0"), bare(r))).otherwise(r)), "")


def natural_ranks(rows: DataFrame, sort_key: str, unique: str, write) -> DataFrame:
    """rows with position, their place (from 1) by sort_key and unique over the whole table.

    The table is range-partitioned and sorted once and written by write (which
    gives it back), each row with its partition and its place there, so a task
    that runs again can't number anything apart. What stands before a partition
    is a running sum over one row a partition.
    """
    ranged = rows.repartitionByRange(sort_key, unique).sortWithinPartitions(sort_key, unique)
    kept = write(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + F.col("_at") + 1).cast("long").alias("position"))


def pick_units(units: DataFrame, tower: str | None = None, query: str = "") -> DataFrame:
    """Units of one development to choose from: of the tower, and those whose tower, unit, typology, area or tax registration holds the query. None where there are several towers and neither is given."""
    if not tower and not query.strip():
        towers = units.agg(F.count_distinct(F.nullif(F.col("tower"), F.lit(""))).alias("_n"))
        units = units.join(F.broadcast(towers.where("_n <= 1")), F.lit(True), "left_semi")
    units = units if not tower else units.where(F.col("tower") == tower)
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("tower", "unit", "typology", "private_area", "iptu") if c in units.columns]
    return units.where(F.contains(n.text(F.concat_ws(" ", *parts)), n.text(F.lit(query))))


def accepted_rows(rows: DataFrame) -> DataFrame:
    """Rows of a unit sheet that stand: a private area, and a typology, tower or unit."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return rows.where(filled("private_area") & (filled("typology") | filled("tower") | filled("unit")))
