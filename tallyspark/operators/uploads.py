"""What comes in: whether files may, what they are, and what requests say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.functions import normalize as n

#: The most bytes of a file, files of an upload, and bytes of all of them.
MAX_FILE, MAX_FILES, MAX_TOTAL = 15 * 1024 * 1024, 20, 60 * 1024 * 1024
#: The first bytes of each kind of file, in hex.
SIGNATURES = {"pdf": ["25504446"], "png": ["89504E47"], "jpeg": ["FFD8FF"], "zip": ["504B03", "504B05", "504B07"], "tiff": ["49492A00", "4D4D002A"]}
#: What a file's extension says its content is, and its type.
KINDS = {".pdf": "pdf", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".docx": "zip", ".xlsx": "zip", ".rtf": "rtf", ".tif": "tiff", ".tiff": "tiff"}
MIME = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".rtf": "application/rtf",
    ".tif": "image/tiff", ".tiff": "image/tiff", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
}
WORD = (MIME[".docx"], MIME[".xlsx"], "application/rtf", "text/rtf")


def _ends(name: Column, ending: str) -> Column:
    return F.endswith(F.lower(name), F.lit(ending))


def is_rtf(content: Column) -> Column:
    """An RTF heading within the first 32 bytes, after a byte order mark and white space."""
    head = F.substring(content, 1, 32)
    text = F.decode(F.when(F.hex(F.substring(head, 1, 3)) == "EFBBBF", F.substring(head, 4, 29)).otherwise(head), "ISO-8859-1")
    return F.regexp_like(text, F.lit(r"(?i)^\s*\{\\rtf"))


def accepted(name: Column, size: Column, content: Column) -> Column:
    """Whether a file may come in: not empty, not too large, and by its first bytes what its name says."""
    head = F.hex(F.substring(content, 1, 4))
    fits = F.lit(False)
    for ending, kind in KINDS.items():
        right = is_rtf(content) if kind == "rtf" else F.lit(False)
        for start in SIGNATURES.get(kind, []):
            right = right | F.startswith(head, F.lit(start))
        fits = fits | (_ends(name, ending) & right)
    return F.coalesce((size > 0) & (size <= MAX_FILE) & fits, F.lit(False))


def gate(files: DataFrame, key: str) -> DataFrame:
    """(key, n_files, n_bytes, n_rejected, accepted) of each upload of files (name, size, content)."""
    ok = accepted(F.col("name"), F.col("size"), F.col("content"))
    per = files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.count_if(~ok).alias("n_rejected"))
    return per.withColumn("accepted", (F.col("n_files") <= MAX_FILES) & (F.col("n_bytes") <= MAX_TOTAL) & (F.col("n_rejected") == 0))


def mime_type(name: Column, given: Column) -> Column:
    """By the name; what was given only for names that say nothing."""
    out = F.when(given.isin(*set(MIME.values()), "text/rtf"), given).otherwise("application/octet-stream")
    for ending, mime in MIME.items():
        out = F.when(_ends(name, ending), mime).otherwise(out)
    return out


def document_type(name: Column, mime: Column, process: str) -> Column:
    """What a file of a process (MINUTA, ITBI or RECONCILIATION) counts as."""
    guide = F.regexp_like(F.lower(name), F.lit("itbi|dti|guia")) if process == "ITBI" else F.lit(False)
    tiff = F.regexp_like(name, F.lit(r"(?i)tiff?\z")) | (mime == "image/tiff")
    office = mime.isin(*WORD) | _ends(name, ".docx") | _ends(name, ".xlsx") | _ends(name, ".rtf")
    return (
        F.when(guide, "ITBI_GUIDE").when(F.contains(mime, F.lit("image")), F.when(tiff, "TIFF").otherwise("IMAGE")).when(office, "WORD")
        .when(F.contains(mime, F.lit("pdf")) | _ends(name, ".pdf"), "CONTRACT" if process == "MINUTA" else "PDF").otherwise("COMPLEMENTARY" if process == "ITBI" else "CONTRACT")
    )


def reader(name: Column, mime: Column) -> Column:
    """Which reader a file takes: docx, rtf, xlsx, tiff, pdf or image."""
    return (
        F.when((mime == MIME[".docx"]) | _ends(name, ".docx"), "docx").when(mime.isin("application/rtf", "text/rtf") | _ends(name, ".rtf"), "rtf").when((mime == MIME[".xlsx"]) | _ends(name, ".xlsx"), "xlsx")
        .when((mime == "image/tiff") | F.regexp_like(name, F.lit(r"(?i)\.tiff?\z")), "tiff").when((mime == "application/pdf") | _ends(name, ".pdf"), "pdf").when(F.startswith(mime, F.lit("image/")), "image")
    )


def sides(documents: DataFrame, key: str) -> DataFrame:
    """(key, both_sides): whether an upload has an image to compare and a document to compare it with."""
    some = lambda *kinds: F.bool_or(F.col("type").isin(*kinds))
    return documents.groupBy(key).agg((some("PRINT", "IMAGE", "TIFF") & some("PDF", "WORD", "CONTRACT", "ITBI_GUIDE", "COMPLEMENTARY")).alias("both_sides"))


def enough_sources(documents: DataFrame, key: str, unit: str) -> DataFrame:
    """(key, n_sources, enough): two distinct sources at least, where a unit of the register counts as one."""
    per = documents.groupBy(key).agg((F.count_distinct("source") + F.max((F.coalesce(F.col(unit), F.lit("")) != "").cast("long"))).alias("n_sources"))
    return per.withColumn("enough", F.col("n_sources") >= 2)


def source_list(text: Column, n_files: Column) -> Column:
    """The sources that a request names, as an array: a JSON list of known codes, one for each file; else null."""
    codes = [s for s in catalog.SOURCES if s != "CADASTRO_EMPREENDIMENTO"]
    listed = F.from_json(text, "array<string>")
    return F.when((F.size(listed) == n_files) & F.forall(listed, lambda s: F.coalesce(s.isin(codes), F.lit(False))), listed)


def estimate(files: DataFrame, key: str) -> DataFrame:
    """(key, label, max_seconds): how long an analysis of these files (name, mime, size) may take."""
    pdf = F.contains("mime", F.lit("pdf")) | _ends(F.col("name"), ".pdf")
    per = files.groupBy(key).agg(F.count_if(pdf).alias("p"), F.count_if(~pdf).alias("i"), F.coalesce(F.bool_or(pdf & (F.col("size") >= 3 * 1024 * 1024)), F.lit(False)).alias("large"))
    # The estimates.
    told = lambda label, seconds: F.struct(F.lit(label).alias("label"), F.lit(seconds).alias("max_seconds"))
    said = (
        F.when(F.col("large"), told("2 a 6 minutos", 360)).when((F.col("p") > 0) & (F.col("i") > 0), told("1 a 3 minutos", 180)).when(F.col("p") > 0, told("40 segundos a 2 minutos", 120))
        .when(F.col("i") > 2, told("1 a 3 minutos", 180)).otherwise(told("30 segundos a 2 minutos", 120))
    )
    return per.select(key, said.alias("s")).select(key, "s.*")


def page_list(text: Column, n_pages: Column, most: int = 40) -> Column:
    """The pages that a selection like `1-3, 8` names, sorted, each once; null for one that isn't valid, names a page beyond n_pages, none, or more than most."""
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")

    def of(tokens):
        first = lambda t: F.regexp_extract(t, "^([0-9]+)", 1).try_cast("int")
        last = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"^[0-9]+\s*-\s*([0-9]+)$", 1), F.lit("")).try_cast("int"), first(t))
        good = lambda t: F.regexp_like(t, F.lit(r"^[0-9]+(\s*-\s*[0-9]+)?$")) & F.coalesce((first(t) >= 1) & (last(t) >= first(t)) & (last(t) <= n_pages), F.lit(False))
        pages = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.sequence(first(t), last(t))))))
        return F.when(F.forall(tokens, good), n.let(pages, lambda x: F.when(F.size(x).between(1, most), x)))

    return n.let(tokens, of)


def display_name(v: Column) -> Column:
    """Each word with a capital."""
    low = F.lower(F.trim(F.regexp_replace(v, n.WS + "+", " ")))
    return F.array_join(F.transform(F.regexp_extract_all(low, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def inferred_name(file: Column) -> Column:
    """A development's name by the file of its units: without the ending, a copy's number, the list's name and numbers at the end."""
    base = file
    for cut in (r"\.[^.]+$", r"\s*\([0-9]+\)\s*$", r"(?i)^lista[_ -]?unidades[_ -]?", r"[_ -]+[0-9]+(?:[._-][0-9]+)*$"):
        base = F.regexp_replace(base, cut, "")
    spaced = F.regexp_replace(F.trim(base), "[_-]+", " ")
    words = F.transform(F.regexp_extract_all(spaced, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.when(F.trim(base) != "", F.array_join(words, "")).otherwise("Empreendimento sem nome")


def inferred_registration(file: Column) -> Column:
    """A registration in a file's name: digits with dots, dashes or lines between before the ending; or null."""
    found = F.regexp_extract(F.regexp_replace(file, r"\s*\([0-9]+\)(?=\.[^.]+$)", ""), r"(?:^|[_ -])([0-9]{2,}(?:[._-][0-9]+)+)(?:\.[^.]+$)", 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit("-"), F.lit("."))


def request_metadata(forwarded: Column, agent: Column) -> Column:
    """(ip, agent) of a request for the audit log: the first address it came through, and 300 characters of its agent."""
    return F.struct(F.nullif(F.trim(F.element_at(F.split(forwarded, ","), 1)), F.lit("")).alias("ip"), F.substring(agent, 1, 300).alias("agent"))


def sanitised_error(text: Column) -> Column:
    """An error without access keys, 500 characters at most."""
    hidden = F.regexp_replace(F.regexp_replace(text, r"(?i)Bearer\s+[^\s]+", "Bearer [oculto]"), r"sk-[A-Za-z0-9_-]+", "[chave oculta]")
    return F.substring(hidden, 1, 500)


def explained_error(message: Column, name: Column) -> Column:
    """An error in words for the one who sent the file, where its cause is known."""
    low = F.lower(message)
    some = lambda *words: F.regexp_like(low, F.lit("|".join(words)))
    # The explanations' wording.
    return (
        F.when(some("password", "encrypted", "senha"), F.concat(F.lit("PDF protegido por senha ou criptografia: "), name, F.lit(". Remova a proteção ou envie uma versão desbloqueada.")))
        .when(some("timeout", "aborted"), F.concat(F.lit("Tempo excedido ao extrair "), name, F.lit(". O arquivo pode ser muito pesado, escaneado em alta resolução ou o provedor de IA/OCR demorou demais.")))
        .when(some("invalid pdf", "corrupt", "bad xref"), F.concat(F.lit("PDF corrompido ou malformado: "), name, F.lit(". Gere uma nova cópia do documento e tente novamente.")))
        .when(some("não configurado", "api key"), F.concat(F.lit("Provider de extração não configurado corretamente para "), name, F.lit(". Verifique as variáveis de ambiente da IA/OCR."))).otherwise(message)
    )


def login_name(v: Column, domain: str) -> Column:
    """A login as an address: one without a domain gets the organisation's."""
    low = F.lower(F.trim(v))
    return F.when(low == "", "").when(F.contains(low, F.lit("@")), low).otherwise(F.concat(low, F.lit("@" + domain)))
