"""Text of documents: pages, gates, windows and labelled values."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import normalize as n

GATE = 250


def selected_pages(pages: DataFrame, key: str, page: str, head: int, tail: int) -> DataFrame:
    """The first head and the last tail pages of each document; all of them where both are 0."""
    if not head and not tail:
        return pages
    last = pages.groupBy(key).agg(F.max(page).alias("_last"))
    return pages.join(last, key).where((F.col(page) <= head) | (F.col(page) > F.col("_last") - tail)).drop("_last")


def sufficient(text) -> Column:
    """Whether a text layer is enough to do without reading images."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), n.WS, "")) >= GATE


def keyword(v) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(n.unaccent(v)), r"[^a-z0-9\s]", " "), r"\s+", " "))


SIZE, STEP = 900, 450
_MARKS = r"[̀-ͯ^`·¨¯´¸]"


def windows(text, size: int = SIZE, step: int = STEP) -> Column:
    """Overlapping windows as (index, text)."""
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(at, lambda i: F.struct((i / step).cast("int").alias("index"), F.substring(text, i + 1, F.lit(size)).alias("text")))


def _level(text) -> Column:
    """The text in plain small letters with other signs blanked, each sign in its place."""
    plain = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, n.COMPOSED, n.BASE))
    return F.regexp_replace(F.lower(plain), "[^a-z0-9]", " ")


def _steps(level: Column) -> Column:
    """A text's windows from pieces of STEP signs, each with the one after it: no window is cut out of the whole text anew."""
    pieces = F.regexp_extract_all(level, F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))
    return n.let(pieces, lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get(p, i + 1), F.lit("")))))


def plain_windows(text) -> Column:
    """Each window's text for a search of keywords: levelled, with single or several blanks. Texts with marks that stand alone, which levelling would move, are levelled window by window."""
    return F.when(F.regexp_like(text, F.lit(_MARKS)), F.transform(windows(text), lambda w: keyword(w["text"]))).otherwise(_steps(_level(text)))


def _holds(text, word: str) -> Column:
    return F.regexp_like(text, F.lit(word.replace(" ", " +"))) if " " in word else F.contains(text, F.lit(word))


def window_score(window: Column, words: list[str]) -> Column:
    """One for each keyword that a window holds, three for one of several words."""
    return sum((F.when(_holds(window, w), 3 if " " in w else 1).otherwise(0) for w in dict.fromkeys(words)), F.lit(0))


def window_scores(docs: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(key, index, score) of windows that hold a keyword; one of several words counts three. A text without a keyword isn't cut at all."""
    text = F.coalesce("text", F.lit(""))
    some = F.lit(False)
    for w in words:
        some = some | _holds(F.col("_level"), w)
    levelled = docs.select(key, text.alias("_text"), F.when(F.regexp_like(text, F.lit(_MARKS)), keyword(text)).otherwise(_level(text)).alias("_level")).where(some)
    cut = F.when(F.regexp_like("_text", F.lit(_MARKS)), F.transform(windows(F.col("_text")), lambda w: keyword(w["text"]))).otherwise(_steps(F.col("_level")))
    scored = F.filter(F.transform(cut, lambda w, i: F.struct(i.alias("index"), window_score(w, words).alias("score"))), lambda x: x["score"] > 0)
    return levelled.select(key, F.explode(scored).alias("w")).select(key, "w.index", "w.score")


def fill_budget(ranked: Column, budget: int, used: Column | int) -> Column:
    """Of (length, ...) structs in order, those that still fit when their turn comes; ones that are too long are skipped."""
    start = F.struct((F.lit(used) if isinstance(used, int) else used).alias("used"), F.slice(ranked, 1, 0).alias("taken"))

    def take(state, w):
        fits = state["used"] + w["length"] <= budget
        return F.struct(F.when(fits, state["used"] + w["length"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["taken"], F.array(w))).otherwise(state["taken"]).alias("taken"))

    return F.aggregate(ranked, start, take)["taken"]


#: The characters that a focused text may have, and those of its head and tail; the same for a text that is cut without keywords.
BUDGET, HEAD, TAIL = 13_500, 3_500, 2_000
CUT_AT, CUT_HEAD = 22_000, 17_000
BETWEEN, OMITTED = "\n\n[TRECHO RELEVANTE]\n\n", "\n\n[CONTEÚDO INTERMEDIÁRIO OMITIDO]\n\n"


def focused(text, domains: dict[str, list[str]]) -> Column:
    """A long text cut to BUDGET characters: its head and tail, the best window of each domain of keywords, then the other windows by score, as long as they fit, in the order of the text. A text within BUDGET stays as it is."""
    every = [w for words in domains.values() for w in words]

    def cut(t):
        parts = n.let(F.struct(plain_windows(t).alias("plain"), windows(t).alias("raw")), lambda p: F.zip_with(p["plain"], p["raw"], lambda a, b: F.struct(
            b["index"].alias("index"), b["text"].alias("text"), F.length(b["text"]).alias("length"), window_score(a, every).alias("score"), F.array(*[window_score(a, words) for words in domains.values()]).alias("by"),
        )))

        def chosen(parts):
            ranked = lambda score: F.array_sort(F.filter(F.transform(parts, lambda w: F.struct((-score(w)).alias("minus"), w["index"].alias("index"), w["text"].alias("text"), w["length"].alias("length"))), lambda w: w["minus"] < 0))
            best = F.array_compact(F.array(*[F.get(ranked(lambda w, k=k: w["by"][k]), F.lit(0)) for k in range(len(domains))]))
            # A window comes once; the first one stands in the head.
            turn = F.filter(F.concat(best, ranked(lambda w: w["score"])), lambda w: w["index"] > 0)
            return n.let(turn, lambda turns: fill_budget(F.filter(turns, lambda w, i: ~F.exists(F.slice(turns, F.lit(1), i), lambda v: v["index"] == w["index"])), BUDGET, HEAD + TAIL))

        middle = n.let(parts, chosen)
        inner = F.transform(F.array_sort(F.transform(middle, lambda w: F.struct(w["index"].alias("index"), w["text"].alias("text")))), lambda w: w["text"])
        pieces = F.concat(F.array(F.substring(t, 1, HEAD)), inner, F.array(F.substring(t, F.length(t) - TAIL + 1, F.lit(TAIL))))
        return F.substring(F.array_join(F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, f"^{n.WS}+|{n.WS}+\\z", "")), lambda x: x != ""), BETWEEN), 1, BUDGET)

    return n.let(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), lambda t: F.when(F.length(t) <= BUDGET, t).otherwise(cut(t)))


def shortened(text) -> Column:
    """A text over CUT_AT characters as its head and tail with a mark between."""
    tail = CUT_AT - CUT_HEAD
    return F.when(F.length(text) <= CUT_AT, text).otherwise(F.concat(F.substring(text, F.lit(1), F.lit(CUT_HEAD)), F.lit(OMITTED), F.substring(text, F.length(text) - tail + 1, F.lit(tail))))


#: Words that a domain's fields go by, besides their ids, labels, categories and types.
DOMAIN_WORDS = {
    "buyer": ["comprador", "adquirente", "cliente", "cpf", "rg", "estado civil", "email", "telefone"], "seller": ["vendedor", "transmitente", "cnpj", "razão social"],
    "property": ["imóvel", "matrícula", "unidade", "torre", "empreendimento", "área", "fração ideal", "iptu"], "financial": ["valor", "entrada", "financiamento", "fgts", "subsídio", "recurso", "declaração"],
    "contract": ["contrato", "instrumento", "processo", "ressalvas", "data"], "signature": ["assinatura", "cidade", "local"],
}


def domain_keywords(rows: list[tuple]) -> dict[str, list[str]]:
    """The keywords of each domain (a field id's first part) of a checklist's rows, normalised, of three letters at least."""
    plain = lambda v: re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c)).lower()).strip()
    out: dict[str, list[str]] = {}
    for field, category, label, _, kind, _ in rows:
        words = [*re.split(r"[.\-_]", field), *f"{label} {category}".split(), kind, *[w for d, more in DOMAIN_WORDS.items() if field.startswith(d) for w in more]]
        held = out.setdefault(field.split(".")[0], [])
        held += [w for w in map(plain, words) if len(w) >= 3 and w not in held]
    return out


def needs_broader_text(fields: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, retry): whether a reading filled so little (under 35 % of the required fields, and under six in all) that it is to be tried with more text."""
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    per = fields.groupBy(key).agg(F.count_distinct(F.when(filled & F.col("field_id").isin(required), F.col("field_id"))).alias("n_required"), F.count_if(filled).alias("n_filled"))
    return per.select(key, ((F.col("n_required") / F.lit(max(1, len(required))) < 0.35) & (F.col("n_filled") < 6) & F.lit(bool(required))).alias("retry"))


def checklist_prompt(rows: list[tuple], hints: dict[str, str] | None = None) -> str:
    """A line for each row of a checklist, as a reader is asked for it."""
    # The wording of a line.
    again = "; repetível por participante; retorne uma entrada por pessoa e use o mesmo participantId em todos os campos da mesma pessoa"
    return "\n".join(f"- {f}: {label}; tipo={kind}; categoria={category}{again * many}" + (f"; regra={hints[f]}" if hints and f in hints else "") for f, category, label, _, kind, many in rows)


def last_marker(rows: DataFrame, key: str, order: str, marker: str) -> DataFrame:
    """rows with the last marker at or before each."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("page", F.last(marker, ignorenulls=True).over(upto))


def first_pattern(text, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that finds a non-blank one, or null."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def label_value(text, label: str) -> Column:
    """What follows a label on its line, else the next line."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.startswith(n.text(x), F.lit(label))), True).cast("int")
    rest = F.trim(F.regexp_replace(F.substring(F.trim(F.get(lines, at - 1)), F.lit(len(label) + 1), F.length(text)), r"^\s*:?\s*", ""))
    return F.when(at > 0, F.coalesce(F.nullif(rest, F.lit("")), F.trim(F.get(lines, at))))


def salvaged(json_text) -> Column:
    """(field_id, value, confidence) triples from a list of objects, complete or cut off."""
    found = F.regexp_extract_all(json_text, F.lit(r'"fieldId"\s*:\s*"[^"]+"[^{}]*?"value"\s*:\s*"[^"]*"[^{}]*?"confidence"\s*:\s*[0-9.]+'), F.lit(0))
    one = lambda x, p: F.regexp_extract(x, p, 1)
    return F.transform(found, lambda x: F.struct(one(x, r'"fieldId"\s*:\s*"([^"]+)"').alias("field_id"), one(x, r'"value"\s*:\s*"([^"]*)"').alias("value"), one(x, r'"confidence"\s*:\s*([0-9.]+)').try_cast("double").alias("confidence")))


def form_lines(rows: DataFrame, key: str, order: list[str], name: str, value: str) -> DataFrame:
    """(key, form): the filled form fields of a document as lines under their heading; blank ones and boxes that are Off don't stand."""
    filled = rows.where((F.trim(value) != "") & (F.trim(value) != "Off"))
    line = F.concat(F.col(name), F.lit(": "), F.trim(value))
    per = filled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("l"))
    return per.select(key, F.concat(F.lit("[CAMPOS DE FORMULARIO]\n"), F.array_join(F.transform("l", lambda x: x["_line"]), "\n")).alias("form"))


#: A line of a unit table: tower, unit, type, private area, total area, share.
UNIT_LINE = r"(?m)^[ \t]*(\S+)[ \t]+([0-9]\S*)[ \t]+(\S.*?)[ \t]+([0-9.]+,[0-9]+)[ \t]+([0-9.]+,[0-9]+)[ \t]+(0,[0-9]+)[ \t]*$"
UNIT_COLUMNS = ["tower", "unit", "typology", "private_area", "total_area", "ideal_fraction"]


def tabular_rows(text) -> Column:
    """The unit table's lines of a text, as structs of strings."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT_LINE), F.lit(0)), lambda x: F.struct(*[F.regexp_extract(x, UNIT_LINE, i).alias(c) for i, c in enumerate(UNIT_COLUMNS, 1)]))


def search(rows: DataFrame, key: str, texts: list[Column], query: str) -> DataFrame:
    """Keys of which a text holds the query, whatever its case, accents and punctuation."""
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.contains(keyword(F.coalesce(t, F.lit(""))), keyword(F.lit(query)))
    return rows.where(hit).select(key).distinct()
