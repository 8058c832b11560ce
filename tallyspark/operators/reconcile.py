"""Reconciliation of every field of a process across its sources.

One shuffle by process brings a process' values and its context together: values
are packed by field (and buyer) first, then by process, on the same partitioning.
The checklist is exploded against the packed fields as a literal, and one CASE
over arrays of at most ten sources decides. Nothing is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions import normalize as n

TEXTUAL = ("texto", "endereco")
ZERO_TEXT = "Valores equivalentes por regra segura: campo opcional sem valor foi tratado como R$ 0,00."


def _filled(rows) -> Column:
    return F.filter(rows, lambda r: r["value"] != "")


def _sources(rows) -> Column:
    return F.transform(rows, lambda r: r["source"])


def _labels(sources) -> Column:
    return catalog.listed(F.transform(sources, catalog.source_label))


def similar(a: Column, b: Column, least: float = catalog.SIMILAR) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (longest == 0) | (1 - F.levenshtein(a, b) / longest >= least)


def diff_tokens(rows) -> Column:
    """Per row its tokens, in order, that not all rows hold."""
    tokens = F.transform(rows, lambda r: F.filter(F.split(r["norm"], " "), lambda t: t != ""))
    shared = F.aggregate(tokens, F.element_at(tokens, 1), lambda acc, t: F.array_intersect(acc, t))
    return F.transform(rows, lambda r: F.struct(r["source"].alias("source"), F.filter(F.split(r["norm"], " "), lambda t: (t != "") & ~F.array_contains(shared, t)).alias("tokens")))


def groups(rows) -> Column:
    """Normalised values in order of first appearance, each with its sources."""
    values = F.array_distinct(F.transform(rows, lambda r: r["norm"]))
    return F.transform(values, lambda v: F.struct(v.alias("value"), _sources(F.filter(rows, lambda r: r["norm"] == v)).alias("sources")))


def source_diagnostic(g) -> Column:
    alone, many = F.filter(g, lambda x: F.size(x["sources"]) == 1), F.filter(g, lambda x: F.size(x["sources"]) > 1)
    apart = F.concat(F.lit("Valor divergente apenas na fonte "), _labels(F.get(alone, F.lit(0))["sources"]), F.lit(". "), _labels(F.get(many, F.lit(0))["sources"]), F.lit(" apresentam valores equivalentes."))
    every = F.concat(F.lit("Valores divergentes entre as fontes: "), F.array_join(F.transform(g, lambda x: _labels(x["sources"])), "; "), F.lit("."))
    return F.when((F.size(alone) > 0) & (F.size(many) > 0), apart).otherwise(every)


IDENTITY = ("buyer.name", "buyer.cpf")


def _packed(rows: DataFrame, repeated: list[str]) -> DataFrame:
    """(process_id, by_key, people): a map of key to rows in the sources' order, and the buyers as (id, label) in order of appearance."""
    person = F.when(F.col("field_id").isin(repeated), F.col("participant_id")) if "participant_id" in rows.columns else F.lit(None).cast("string")
    keyed = rows.repartition("process_id").withColumn("person", person).withColumn("key", F.when(F.col("person").isNotNull(), F.concat_ws("::", "field_id", "person")).otherwise(F.col("field_id")))
    each = keyed.groupBy("process_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("source_ord", "source", "value", "norm", "confidence"))).alias("rows"), F.any_value("field_id").alias("field_id"), F.any_value("person").alias("person")
    )
    seen = F.struct((~F.col("field_id").isin(*IDENTITY)).alias("other"), F.element_at("rows", 1)["source_ord"].alias("at"), F.col("person").alias("id"), F.when(F.col("field_id") == "buyer.name", F.get(_filled(F.col("rows")), F.lit(0))["value"]).alias("name"))
    per = each.groupBy("process_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "rows"))).alias("by_key"), F.array_sort(F.collect_list(F.when(F.col("person").isNotNull(), seen))).alias("seen"))
    # Buyers are those that a name or tax id names; without one, all that some value names.
    named = F.filter("seen", lambda x: ~x["other"])
    chosen = F.when(F.size(named) > 0, named).otherwise(F.col("seen"))
    ids = F.array_distinct(F.transform(chosen, lambda x: x["id"]))
    label = lambda i, at: F.coalesce(F.get(F.filter("seen", lambda x: (x["id"] == i) & x["name"].isNotNull()), F.lit(0))["name"], F.concat(F.lit("Comprador "), (at + 1).cast("string")))
    return per.select("process_id", "by_key", F.transform(ids, lambda i, at: F.struct(i.alias("id"), label(i, at).alias("label"))).alias("people"))


#: Fields whose values may be equal by a rule, and the rule's name.
RULE_KINDS = {"buyer.maritalStatus": "MARITAL_STATUS_GENDER", "property.development": "TEXT_ALIAS"}
#: A rule table of so many rows or fewer is broadcast; a larger one is joined by signature.
RULES_SENT = 100_000


def _rule_observation(kind: Column, count: Column) -> Column:
    """What is said of values that are equal by a rule, which people have approved count times (null: never)."""
    one = count == 1
    # The observations' wording.
    told = F.concat(
        F.lit("Valores equivalentes por aprendizado supervisionado ("), count.cast("string"), F.when(one, " validação").otherwise(" validaçãoões"), F.when(one, " humana").otherwise(" humanas"),
        F.when(one, " anterior").otherwise(" anteriores"), F.lit(")."),
    )
    known = F.when(kind == "MARITAL_STATUS_GENDER", "Valores equivalentes: variação apenas gramatical do estado civil.").otherwise("Valores equivalentes: variação textual já normalizada para este campo.")
    return F.coalesce(F.when(count.isNotNull(), told), known)


def with_rules(each: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """each (field_id, rule_kind, signature) with the occurrence_count that rules hold for it, or null. keys (organization_id, say) tell apart whose rules they are.

    Small rules are broadcast, by their number of rows; others are joined by
    signature, where rows without one get a signature of their own each, so that
    they don't meet in one task.
    """
    on = [*keys, "field_id", "rule_kind", "signature"]
    most = rules.groupBy(*on).agg(F.max("occurrence_count").alias("occurrence_count"))
    if most.limit(RULES_SENT + 1).count() <= RULES_SENT:
        return each.join(F.broadcast(most), on, "left")
    alone = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    spread = each.withColumn("_own", F.col("signature")).withColumn("signature", F.coalesce("signature", alone))
    return spread.join(most.hint("shuffle_merge"), on, "left").withColumn("signature", F.col("_own")).drop("_own")


def reconcile(evidence: DataFrame, context: DataFrame, fields: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(process_id, field_id, participant_id, status, observation, rung, rows, diff) per process and field (and buyer, for fields that repeat) with evidence.

    evidence: (process_id, source_ord, source, field_id, value, confidence), one
    row for each source and field, and for each buyer where a column
    participant_id says whose value it is. context: (process_id, participating,
    unreadable, conflicts, issues), arrays of sources and of source:field (or
    source:field::buyer) keys, and maybe errors, a map of source to text.
    rung: the step that decided. A null or blank value is a value looked for
    and not found. Values of sources that don't participate aren't compared.
    fields limits the checklist. rules (field_id, rule_kind, signature,
    occurrence_count), and maybe organization_id if context has one, are what
    people have approved: values that only a rule makes equal match (as one
    without words does beside two that agree), and the observation says how
    often the rule was approved.
    """
    chosen = [f for f in catalog.fields() if fields is None or f[0] in fields]
    kinds = F.create_map(*[F.lit(x) for f in chosen for x in (f[0], f[2])])
    value = F.coalesce(F.trim(F.regexp_replace("value", f"^{n.WS}+|{n.WS}+$", "")), F.lit(""))
    rows = evidence.where(F.col("field_id").isin([f[0] for f in chosen])).withColumn("value", value)
    rows = rows.withColumn("norm", n.field_value("value", F.element_at(kinds, F.col("field_id")), F.col("field_id")))
    packed = _packed(rows, [f[0] for f in chosen if f[3]])
    entry = lambda f, k, s: F.struct(F.lit(f).alias("field_id"), F.lit(k).alias("field_type"), F.array(*map(F.lit, s)).alias("expected"))
    nobody = F.array().cast("array<struct<id:string,label:string>>")
    whose = lambda c, i, label: F.struct(c["field_id"].alias("field_id"), c["field_type"].alias("field_type"), c["expected"].alias("expected"), i.alias("participant_id"), label.alias("who"))
    none = F.lit(None).cast("string")
    once, repeated = ([entry(f, k, s) for f, _, k, m, s in chosen if m == flag] for flag in (False, True))
    parts = [F.transform(F.array(*once), lambda c: whose(c, none, none))] if once else []
    if repeated:
        every = F.array(*repeated)
        by_person = F.flatten(F.transform("people", lambda x: F.transform(every, lambda c: whose(c, x["id"], x["label"]))))
        parts.append(F.when(F.size("people") > 0, by_person).otherwise(F.transform(every, lambda c: whose(c, none, none))))
    each = context.join(packed, "process_id", "left").withColumn("people", F.coalesce("people", nobody))
    each = each.select("*", F.explode(F.concat(*parts)).alias("c")).select("*", "c.*").withColumn("key", F.when(F.col("participant_id").isNotNull(), F.concat_ws("::", "field_id", "participant_id")).otherwise(F.col("field_id")))
    given = F.coalesce(F.try_element_at("by_key", F.col("key")), F.array().cast(packed.schema["by_key"].dataType.valueType))
    each = each.withColumn("all", given).drop("by_key", "people", "c")
    optional = F.col("field_id").isin(*catalog.OPTIONAL_ZERO)
    held = F.exists(_filled(F.col("all")), lambda r: r["source"] == "DADOS_RESERVA")
    kept = F.when(optional & F.array_contains("participating", "DADOS_RESERVA"), held).otherwise(F.arrays_overlap("participating", "expected") | (F.size("all") > 0))
    each = each.where(kept).withColumn("rows", F.filter("all", lambda r: F.array_contains("participating", r["source"]))).withColumn("filled", _filled(F.col("rows")))
    key = lambda s: F.concat(s, F.lit(":"), F.col("key"))
    have = _sources(F.col("filled"))
    asked = F.filter("participating", lambda s: F.array_contains("expected", s))
    zero = lambda rows: F.forall(rows, lambda r: r["norm"].isin("", "0.00"))
    each = each.withColumns({
        "conflicting": F.filter(have, lambda s: F.array_contains("conflicts", key(s))),
        "issued": F.filter("participating", lambda s: F.array_contains("issues", key(s))),
        "unread": F.filter("unreadable", lambda s: F.array_contains("expected", s)),
        "low": _sources(F.filter("filled", lambda r: r["confidence"] < catalog.LOW_CONFIDENCE)),
        "missing": F.filter(asked, lambda s: ~F.array_contains(have, s) & ~F.array_contains("unreadable", s)),
        "groups": groups(F.col("filled")),
        # Where nothing is expected of those that take part, all of them count.
        "zero": optional & zero(F.filter("rows", lambda r: (F.size(asked) == 0) | F.array_contains(asked, r["source"]))),
    })
    # Equal by a rule: all values with words left agree, though they were written in different ways.
    signature = kind = F.lit(None).cast("string")
    if any(f[0] in RULE_KINDS for f in chosen):
        worded = F.filter("filled", lambda r: r["norm"] != "")
        plains = F.array_distinct(F.filter(F.transform("filled", lambda r: n.text(r["value"])), lambda v: v != ""))
        kind = F.try_element_at(catalog.constant_map(RULE_KINDS), F.col("field_id"))
        alias = kind.isNotNull() & (F.size("groups") > 1) & (F.size(worded) >= 2) & (F.size(F.array_distinct(F.transform(worded, lambda r: r["norm"]))) == 1) & (F.size(plains) > 1)
        signature = F.when(alias, F.array_join(F.array_sort(plains), " || "))
    each = each.withColumn("signature", signature).withColumn("rule_kind", F.when(F.col("signature").isNotNull(), kind))
    small = F.forall("groups", lambda a: F.forall("groups", lambda b: (a["value"] >= b["value"]) | similar(a["value"], b["value"])))
    rung = (
        F.when(F.size("conflicting") > 0, 1).when(F.size("issued") > 0, 2).when(F.size("unread") > 0, 3).when((F.size("filled") < 2) & F.col("zero"), 40).when(F.size("filled") < 2, 4)
        .when(F.size("low") > 0, 5).when(F.size("groups") == 1, 6).when(F.col("signature").isNotNull(), 70).when(optional & zero("filled"), 7).when(F.col("field_type").isin(*TEXTUAL) & small, 8).otherwise(9)
    )
    each = each.withColumn("rung", rung)
    if rules is None:
        each = each.withColumn("occurrence_count", F.lit(None).cast("long"))
    else:
        # A signature that a rung before has decided on needs no look-up.
        each = each.withColumn("signature", F.when(F.col("rung") == 70, F.col("signature")))
        each = with_rules(each, rules, ("organization_id",) if {"organization_id"} <= {*rules.columns} & {*each.columns} else ())
    at = F.col("rung")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    who = F.when(F.col("who").isNotNull(), say("o comprador ", F.col("who"))).otherwise("o campo")
    not_in = F.when(F.size("missing") > 0, say(" Campo não encontrado na fonte ", _labels(F.col("missing")), ".")).otherwise("")
    reason = F.lit("")
    if "errors" in context.columns:
        told = F.filter("unread", lambda s: F.try_element_at("errors", s).isNotNull())
        reason = F.when(F.size(told) > 0, say(" Motivo:", F.array_join(F.transform(told, lambda s: say(" ", catalog.source_label(s), ": ", F.element_at("errors", s))), ""))).otherwise("")
    # The observations' wording.
    observation = (
        F.when(at == 1, say("Foram encontrados valores conflitantes para ", who, " entre arquivos da fonte ", _labels(F.col("conflicting")), "."))
        .when(at == 2, say("Evidência insuficiente ou incompatível para ", who, " na fonte ", _labels(F.col("issued")), "."))
        .when(at == 3, say("Campo de ", who, " não pôde ser conferido completamente porque a fonte ", _labels(F.col("unread")), " não foi interpretada.", reason))
        .when(at.isin(40, 7), ZERO_TEXT).when(at == 70, _rule_observation(F.col("rule_kind"), F.col("occurrence_count")))
        .when((at == 4) & (F.size("filled") > 0), say("Campo de ", who, " encontrado apenas na fonte ", _labels(have), ". É necessário outro arquivo com o mesmo dado para confirmar.", not_in))
        .when(at == 4, say("Campo de ", who, " não encontrado nas fontes esperadas para conferência.", not_in))
        .when(at == 5, say("Extração abaixo de 70% para ", who, " na fonte ", _labels(F.col("low")), "."))
        .when((at == 6) & (F.size(F.array_distinct(F.transform("filled", lambda r: r["value"]))) > 1), "Valores equivalentes após normalização.").when(at == 6, "Todas as fontes conferem.")
        .when(at == 8, say("Há pequena diferença textual entre ", _labels(have), "; confirme os valores destacados."))
        .otherwise(source_diagnostic(F.col("groups")))
    )
    status = F.when(at.isin(6, 7, 40, 70), "MATCH").when(at == 3, "SOURCE_UNREADABLE").when(at == 9, "DIVERGENCE").otherwise("REVIEW_REQUIRED")
    diff = F.when(at.isin(8, 9), diff_tokens(F.col("filled")))
    return each.select("process_id", "field_id", "participant_id", status.alias("status"), observation.alias("observation"), F.when(at == 40, 4).when(at == 70, 7).otherwise(at).alias("rung"), "rows", diff.alias("diff"), F.col("who").alias("participant_label"))


def participants(verdicts: DataFrame) -> DataFrame:
    """(process_id, participant_id, label): the buyers that verdicts speak of."""
    return verdicts.where("participant_id is not null").groupBy("process_id", "participant_id").agg(F.max(F.coalesce("participant_label", F.lit("Comprador"))).alias("label"))


def rule_candidates(rows: DataFrame) -> DataFrame:
    """(process_id, field_id, rule_kind, signature) of fields whose values differ as they are and agree by a rule: gender in a marital status, or noise words in a development's name. rows as in reconcile()."""
    of = rows.where(F.col("field_id").isin(*RULE_KINDS)).withColumn("plain", n.text("value")).where("plain != ''")
    folded = F.when(F.col("field_id") == "buyer.maritalStatus", n.marital_status(F.col("plain"))).otherwise(n.development_name(F.col("plain")))
    per = of.withColumn("folded", folded).groupBy("process_id", "field_id").agg(F.collect_set("plain").alias("plains"), F.collect_set("folded").alias("foldeds"), F.count_if(F.col("folded") != "").alias("n"))
    agree = per.where((F.size("plains") > 1) & (F.size("foldeds") == 1) & (F.col("n") >= 2))
    kind = F.element_at(catalog.constant_map(RULE_KINDS), F.col("field_id"))
    return agree.select("process_id", "field_id", kind.alias("rule_kind"), F.array_join(F.array_sort("plains"), " || ").alias("signature"))


def learned(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates with the observation that their rule gives: how often people have approved it (rules: field_id, rule_kind, signature, occurrence_count), or that it is known."""
    found = with_rules(candidates, rules)
    return found.select("process_id", "field_id", "rule_kind", "signature", _rule_observation(F.col("rule_kind"), F.col("occurrence_count")).alias("observation"))


def summary(verdicts: DataFrame, *keys: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return verdicts.groupBy(*keys).agg(F.count("*").alias("total"), count("MATCH").alias("matches"), count("DIVERGENCE").alias("divergences"), count("REVIEW_REQUIRED").alias("review"), count("SOURCE_UNREADABLE").alias("unreadable"))


def missing_by_source(verdicts: DataFrame, context: DataFrame) -> DataFrame:
    """(source, missing, unreadable) of each participating source: observations that name it as missing (the first one of a list), and unreadable verdicts that hold a value row of it."""
    seen = context.select("process_id", F.explode("participating").alias("source"))
    named = F.array_compact(F.array(*[F.when(F.contains("observation", F.lit(f"não encontrado na fonte {label}")), F.lit(s)) for s, label in catalog.SOURCES.items()]))
    # Both are counted in one reading of the verdicts: a verdict gives an entry for each source that it names, and for each that it couldn't read.
    entry = lambda sources, missing, unreadable: F.transform(sources, lambda s: F.struct(s.alias("source"), F.lit(missing).alias("missing"), F.lit(unreadable).alias("unreadable")))
    unread = F.when(F.col("status") == "SOURCE_UNREADABLE", _sources(F.col("rows"))).otherwise(F.array().cast("array<string>"))
    each = n.opened(verdicts, F.concat(entry(named, 1, 0), entry(unread, 0, 1)), "e", "process_id").select("process_id", "e.*")
    found = each.groupBy("process_id", "source").agg(F.sum("missing").alias("missing"), F.sum("unreadable").alias("unreadable"))
    both = seen.join(found, ["process_id", "source"], "left")
    return both.groupBy("source").agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.coalesce(F.sum("unreadable"), F.lit(0)).alias("unreadable"))


def two_sources(evidence: DataFrame, left: str, right: str, optional: list[str]) -> DataFrame:
    """The older check of one source against another: (process_id, field_id, status)."""
    side = lambda s: F.max_by(F.struct("value", "confidence"), F.when(F.col("source") == s, F.col("source_ord")))
    rows = evidence.withColumn("value", n.field_value("value", F.col("field_type"), F.col("field_id"))).where(F.col("source").isin(left, right))
    both = rows.groupBy("process_id", "field_id").agg(side(left).alias("l"), side(right).alias("r"))
    a, b = F.coalesce("l.value", F.lit("")), F.coalesce("r.value", F.lit(""))
    status = (
        F.when((a == "") & (b == "") & F.col("field_id").isin(*optional), "NOT_APPLICABLE").when((a == "") | (b == ""), "NOT_FOUND")
        .when(F.least("l.confidence", "r.confidence") < catalog.LOW_CONFIDENCE, "REVIEW_REQUIRED").when(a == b, "MATCH").otherwise("DIVERGENCE")
    )
    return both.select("process_id", "field_id", status.alias("status"))


def first_difference(a: Column, b: Column) -> Column:
    """The first position, from 1, where two strings differ; 0 where they are equal."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1)))
    return F.coalesce(F.get(F.filter(at, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), F.lit(0)), F.lit(0))


def money_gap(a: Column, b: Column) -> Column:
    """Absolute difference, per cent of the first, and which is larger, of two normalised amounts."""
    x, y = a.try_cast("decimal(20,2)"), b.try_cast("decimal(20,2)")
    share = F.when(x == 0, F.lit(0).cast("decimal(20,2)")).otherwise(F.round(F.abs(y - x) * 100 / F.abs(x), 2).cast("decimal(20,2)"))
    return F.struct(F.abs(y - x).cast("decimal(20,2)").alias("gap"), share.alias("percent"), F.when(y > x, "maior no documento").otherwise("menor no documento").alias("direction"))


def date_gap(a: Column, b: Column) -> Column:
    """The distance of two normalised dates in words: years of 365 or months of 30 days where they divide it."""
    days = F.abs(F.datediff(F.try_to_date(b, "yyyy-MM-dd"), F.try_to_date(a, "yyyy-MM-dd")))
    word = lambda k, one, more: F.concat((days / k).cast("int").cast("string"), F.when(days == k, f" {one}").otherwise(f" {more}"))
    return F.when((days >= 365) & (days % 365 == 0), word(365, "ano", "anos")).when((days >= 30) & (days % 30 == 0), word(30, "mês", "meses")).otherwise(word(1, "dia", "dias"))


def email_gap(a: Column, b: Column) -> Column:
    """Which part of two normalised addresses differs: DOMAIN, else USER; null where they are equal."""
    domain = lambda x: F.substring_index(x, "@", -1)
    return F.when(a == b, F.lit(None)).when(domain(a) != domain(b), "DOMAIN").otherwise("USER")


def phone_gap(a: Column, b: Column) -> Column:
    """Which part of two numbers of digits differs: the area code (the first two), else the position from 1; null where they are equal."""
    return F.when(a == b, F.lit(None)).when(F.substring(a, 1, 2) != F.substring(b, 1, 2), "DDD").otherwise(first_difference(a, b).cast("string"))


def money_text(v: Column) -> Column:
    """As amounts are shown: R$ 1.234,56."""
    return F.concat(F.lit("R$\u00a0"), F.translate(F.format_number(v.cast("decimal(20,2)"), 2), ",.", ".,"))


def _percent_text(v: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.format_number(v.cast("decimal(20,2)"), 2), "0+$", ""), r"\.$", "")
    return F.concat(F.translate(plain, ",.", ".,"), F.lit("%"))


def divergence(kind: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
    """What differs between two values x and y (normalised: a and b) of a type, in words."""
    say = lambda *parts: F.concat(*[F.lit(q) if isinstance(q, str) else q for q in parts])
    # The observations' wording.
    both = lambda what: say(what, ": imagem ", x, ", documento ", y, ".")
    tail = lambda v: F.when(F.length(v) > 9, F.concat(F.lit("..."), F.substring(v, F.length(v) - 8, F.lit(9)))).otherwise(v)
    at = first_difference(a, b)
    name = F.upper(kind)
    document = F.when(at == 0, say(name, " diverge no formato informado: imagem ", x, ", documento ", y, ".")).otherwise(say(name, " diverge na posição ", at.cast("string"), ": imagem mostra ", tail(x), ", documento mostra ", tail(y), "."))
    numbers = a.try_cast("decimal(20,2)").isNotNull() & b.try_cast("decimal(20,2)").isNotNull()
    money = n.let(money_gap(a, b), lambda g: F.when(numbers, say("Valor diverge em ", money_text(g["gap"]), " (", _percent_text(g["percent"]), " ", g["direction"], "): imagem ", x, ", documento ", y, ".")).otherwise(both("Valor monetário diverge")))
    date = n.let(date_gap(a, b), lambda g: F.when(g.isNotNull(), say("Data diverge em ", g, ": imagem ", x, ", documento ", y, ".")).otherwise(both("Data diverge")))
    part = lambda v, i: F.coalesce(F.get(F.split(v, "@"), F.lit(i)), F.lit(""))
    named = lambda v: F.coalesce(F.nullif(part(v, 1), F.lit("")), F.lit("sem domínio"))
    mail = (
        F.when(part(a, 1) != part(b, 1), say("Email diverge no domínio: imagem ", named(a), ", documento ", named(b), ".")).when(part(a, 0) != part(b, 0), say("Email diverge no usuário antes do @: imagem ", part(a, 0), ", documento ", part(b, 0), "."))
        .otherwise(both("Email diverge no formato"))
    )
    area = lambda v: F.when(F.length(v) >= 10, F.substring(v, 1, 2)).otherwise("")
    phone = (
        F.when((area(a) != "") & (area(b) != "") & (area(a) != area(b)), say("Telefone diverge no DDD: imagem (", area(a), "), documento (", area(b), ")."))
        .when(at > 0, say("Telefone diverge no dígito ", at.cast("string"), ": imagem ", x, ", documento ", y, ".")).otherwise(both("Telefone diverge no formato"))
    )
    words = lambda v: F.filter(F.split(v, " "), lambda t: t != "")
    only = lambda v, w: F.array_join(F.filter(words(v), lambda t: ~F.array_contains(words(w), t)), " ")
    what = F.when(kind == "endereco", "componente do endereço").otherwise("palavra")
    told = lambda d, v: F.coalesce(F.nullif(d, F.lit("")), v)
    text = n.let(F.struct(only(a, b).alias("l"), only(b, a).alias("r")), lambda d: F.when(
        (d["l"] == "") & (d["r"] == ""), say('Texto diverge por ordem ou formatação dos termos: imagem "', x, '", documento "', y, '".')
    ).otherwise(say("Diverge no ", what, ': imagem indica "', told(d["l"], x), '", documento indica "', told(d["r"], y), '".')))
    return F.when(kind.isin("cpf", "cnpj", "rg"), document).when(kind == "valor_monetario", money).when(kind == "data", date).when(kind == "email", mail).when(kind == "telefone", phone).otherwise(text)


#: What a status of the older check is explained by.
EXPLAINED = {"MATCH": "Campo conferido automaticamente após normalização.", "NOT_FOUND": "Informação ausente em uma das fontes.", "NOT_APPLICABLE": "Campo opcional ausente nas duas fontes.", "REVIEW_REQUIRED": "Extração com confiança abaixo de 70%."}


def validate(evidence: DataFrame, rows: list[tuple], left: str, right: str) -> DataFrame:
    """The older check of one source against another over all fields of a checklist: (process_id, field_id, status, observation).

    Of a field's rows in a source the last one counts (by participant_id). A
    field that neither has is NOT_APPLICABLE, or NOT_FOUND where it is required.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field_id"), F.lit(k).alias("field_type"), F.lit(r).alias("required")) for f, _, _, r, k, _ in rows])
    value = F.coalesce(F.trim("value"), F.lit(""))
    side = lambda s: F.max_by(F.struct(value.alias("value"), "confidence"), F.when(F.col("source") == s, F.struct(F.coalesce("participant_id", F.lit("")), "source_ord")))
    listed = F.col("source").isin(left, right) & F.col("field_id").isin([f for f, *_ in rows])
    # All by process: its sides are packed by field, and the checklist looks them up. Rows of others only say that there is the process.
    each = evidence.repartition("process_id").select("process_id", F.when(listed, F.col("field_id")).alias("field_id"), "source", "source_ord", "participant_id", F.when(listed, F.col("value")).alias("value"), "confidence")
    held = each.groupBy("process_id", "field_id").agg(side(left).alias("l"), side(right).alias("r"))
    packed = held.groupBy("process_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("field_id").isNotNull(), F.struct("field_id", F.struct("l", "r").alias("sides"))))).alias("by_field"))
    both = packed.select("process_id", "by_field", F.explode(fields).alias("f")).select("process_id", "f.*", F.try_element_at("by_field", F.col("f.field_id")).alias("sides")).select("process_id", "field_id", "field_type", "required", "sides.l", "sides.r")
    x, y = F.coalesce("l.value", F.lit("")), F.coalesce("r.value", F.lit(""))
    both = both.select("process_id", "field_id", "field_type", "required", x.alias("x"), y.alias("y"), n.value(x, F.col("field_type")).alias("a"), n.value(y, F.col("field_type")).alias("b"), F.least(F.coalesce("l.confidence", F.lit(0)), F.coalesce("r.confidence", F.lit(0))).alias("c"))
    status = (
        F.when((F.col("a") == "") & (F.col("b") == "") & ~F.col("required"), "NOT_APPLICABLE").when((F.col("a") == "") | (F.col("b") == ""), "NOT_FOUND").when(F.col("c") < catalog.LOW_CONFIDENCE, "REVIEW_REQUIRED")
        .when(F.col("a") == F.col("b"), "MATCH").otherwise("DIVERGENCE")
    )
    marked = both.withColumn("status", status)
    why = F.coalesce(F.try_element_at(catalog.constant_map(EXPLAINED), F.col("status")), divergence(F.col("field_type"), F.col("x"), F.col("y"), F.col("a"), F.col("b")))
    return marked.select("process_id", "field_id", "status", why.alias("observation"))


def optional_zero(verdicts: DataFrame) -> DataFrame:
    """Verdicts that match because an optional amount without a value counts as zero."""
    return verdicts.where(F.col("field_id").isin(*catalog.OPTIONAL_ZERO) & (F.col("observation") == ZERO_TEXT))


#: What a status is called.
STATUS = {"MATCH": "Conferido", "DIVERGENCE": "Divergência", "NOT_FOUND": "Não encontrado", "NOT_APPLICABLE": "Não aplicável", "REVIEW_REQUIRED": "Revisão necessária", "SOURCE_UNREADABLE": "Fonte ilegível"}


def reviewed(verdicts: DataFrame, reviews: DataFrame) -> DataFrame:
    """verdicts with approved and has_review: reviews are (process_id, field_id, status), one for each process and field (field::buyer where it repeats)."""
    key = F.when(F.col("participant_id").isNotNull(), F.concat_ws("::", "field_id", "participant_id")).otherwise(F.col("field_id"))
    of = reviews.select("process_id", F.col("field_id").alias("_key"), (F.col("status") == "APPROVED").alias("approved"), F.lit(True).alias("has_review"))
    joined = n.settled(verdicts, "process_id").withColumn("_key", key).join(of, ["process_id", "_key"], "left").drop("_key")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("approved", "has_review")})


def filter_results(verdicts: DataFrame, reviews: DataFrame, status: str | None = None, query: str = "") -> DataFrame:
    """Verdicts of a status (an approved one counts as MATCH; MISSING: a source lacks the field, and nobody has reviewed it) whose category, label, values, status name or observation holds the query."""
    each = reviewed(verdicts, reviews)
    if status == "MISSING":
        each = each.where(F.contains("observation", F.lit("não encontrado na fonte")) & ~F.col("has_review"))
    elif status:
        each = each.where(F.when(F.col("approved"), "MATCH").otherwise(F.col("status")) == status)
    if not query:
        return each
    about = {r[0]: f"{r[1]} {r[2]}" for r in catalog.MINUTA + catalog.ITBI}
    text = F.concat_ws(" ", F.try_element_at(catalog.constant_map(about), F.col("field_id")), F.array_join(F.transform("rows", lambda r: r["value"]), " "), F.element_at(catalog.constant_map(STATUS), F.col("status")), "observation")
    return each.where(F.contains(F.lower(text), F.lit(query.lower())))


def report(verdicts: DataFrame, reviews: DataFrame, kind: str = "ALL") -> DataFrame:
    """The rows of a report: ALL, CHECKED (a match, or approved), DIVERGENCES (not approved), or PENDING (not checked)."""
    each = reviewed(verdicts, reviews)
    checked = (F.col("status") == "MATCH") | F.col("approved")
    kept = {"ALL": F.lit(True), "CHECKED": checked, "DIVERGENCES": (F.col("status") == "DIVERGENCE") & ~F.col("approved"), "PENDING": ~checked}
    return each.where(kept[kind])


def final_counts(verdicts: DataFrame, reviews: DataFrame, *keys: str) -> DataFrame:
    """(checked, divergences, reviews) with what people have approved counted as checked."""
    checked = (F.col("status") == "MATCH") | F.col("approved")
    split = F.col("status") == "DIVERGENCE"
    return reviewed(verdicts, reviews).groupBy(*keys).agg(F.count_if(checked).alias("checked"), F.count_if(~checked & split).alias("divergences"), F.count_if(~checked & ~split).alias("reviews"))


def checked(kind: str, evidence: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(process_id, field_id, status, observation) of processes of one kind: RECONCILIATION over all sources, or MINUTA or ITBI, which hold images (source IMAGE) against documents (source DOCUMENT), see evidence.two_sides()."""
    if kind == "RECONCILIATION":
        return reconcile(evidence, context).select("process_id", "field_id", "status", "observation")
    lists = {"MINUTA": catalog.MINUTA, "ITBI": catalog.ITBI}
    rows = evidence if "participant_id" in evidence.columns else evidence.withColumn("participant_id", F.lit(None).cast("string"))
    return validate(rows, lists[kind], "IMAGE", "DOCUMENT")
