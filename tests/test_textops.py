"""Focus windows and their budget against plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tallyspark.functions import catalog
from tallyspark.operators import textops


def plain(v):
    v = "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c) and c not in "^`·¨¯´¸")
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", v.lower())).strip()


def score(window, words):
    return sum(3 if " " in w else 1 for w in dict.fromkeys(words) if w in plain(window))


def focus(text, domains):
    if len(text) <= 13_500:
        return text
    cut = [text[i : i + 900] for i in range(0, len(text), 450)]
    chosen = {0: text[:3_500], 10**9: text[-2_000:]}

    def take(i):
        if i not in chosen and sum(map(len, chosen.values())) + len(cut[i]) <= 13_500:
            chosen[i] = cut[i]

    for words in domains.values():
        best = min(range(len(cut)), key=lambda i: (-score(cut[i], words), i))
        if score(cut[best], words):
            take(best)
    every = [w for words in domains.values() for w in words]
    for i in sorted((i for i in range(len(cut)) if score(cut[i], every)), key=lambda i: (-score(cut[i], every), i)):
        take(i)
    return "\n\n[TRECHO RELEVANTE]\n\n".join(x.strip() for _, x in sorted(chosen.items()) if x.strip())[:13_500]


def texts():
    rng = random.Random(4)
    words = ["comprador", "Estado  Civil", "matrícula", "VALOR", "fgts", "lorem", "ipsum", "dolor", "estado", "civil", "área", "x^y", "fração\nideal", "amet,"] + ["nada"] * 60
    return [" ".join(rng.choice(words) for _ in range(k)) for k in (3, 900, 3000, 6000)] + ["", "nada " * 5000, "érea " * 3000]


def test_focused_texts(spark):
    domains = textops.domain_keywords(catalog.MINUTA)
    assert "estado civil" in domains["buyer"] and "nome" in domains["buyer"] and "rg" not in domains["buyer"] and "fracao ideal" in domains["property"]
    small = {k: v[:12] for k, v in list(domains.items())[:3]}
    df = spark.createDataFrame(list(enumerate(texts())), "i int, text string")
    got = {r.i: r.x for r in df.select("i", textops.focused("text", small).alias("x")).collect()}
    assert got == {i: focus(t, small) for i, t in enumerate(texts())}


def test_window_scores(spark):
    words = ["comprador", "estado civil", "fracao ideal", "xy"]
    df = spark.createDataFrame([*enumerate(texts()), (99, None)], "i int, text string")
    want = {(i, k // 450, score(t[k : k + 900], words)) for i, t in enumerate(texts()) for k in range(0, len(t), 450)}
    assert {tuple(r) for r in textops.window_scores(df, "i", words).collect()} == {x for x in want if x[2]}


def test_cuts_and_retries(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    long = "".join(chr(97 + i % 26) for i in range(30_000))
    assert one(textops.shortened(F.lit(long))) == long[:17_000] + "\n\n[CONTEÚDO INTERMEDIÁRIO OMITIDO]\n\n" + long[-5_000:] and one(textops.shortened(F.lit("ab"))) == "ab"
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "x"), (2, "b", "y"), (3, "c", ""), *[(4, f"z{i}", "v") for i in range(6)]], "d int, field_id string, value string")
    assert {r.d: r.retry for r in textops.needs_broader_text(rows, "d", ["a", "b", "c", "d"]).collect()} == {1: True, 2: False, 3: True, 4: False}
    lines = textops.checklist_prompt(catalog.ITBI, {"buyer.cpf": "h"}).split("\n")
    assert len(lines) == 28 and lines[0].startswith("- buyer.name: Nome; tipo=texto; categoria=Dados do adquirente; repetível") and lines[1].endswith("; regra=h")
