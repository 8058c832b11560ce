"""Readers' replies: JSON in fences, in chatty text, or cut off.

A reply is read by the first way that gives JSON: whole, from its first brace to
its last, from its first bracket to its last, or its first complete object, which
a fold over the reply's signs finds (braces in strings and after escapes don't
count). Where none does, what is left of a list of fields is picked out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import normalize as n
from tallyspark.operators.textops import salvaged

FIELDS = "array<struct<fieldId:string,value:string,confidence:double>>"


def without_fence(text) -> Column:
    """The reply without a code fence around it."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(plain, r"(?i)^```(?:json|text|markdown)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(plain, F.lit("```")), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(plain)


def _slice(text: Column, opening: str, closing: str) -> Column:
    """From the first opening sign to the last closing one, or null."""
    start, end = F.instr(text, opening), F.length(text) + 1 - F.instr(F.reverse(text), closing)
    return F.when((start > 0) & (F.instr(F.reverse(text), closing) > 0) & (end > start), F.substring(text, start, end - start + 1))


def first_object(text) -> Column:
    """The first object of a text that is complete, or null: from a brace to the one that closes it, whatever strings in it hold."""
    signs = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}]|[^"{}\\]+|\\'), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(a, t):
        opens, closes = (t == "{") & ~a["quoted"], (t == "}") & ~a["quoted"] & (a["depth"] > 0)
        depth = a["depth"] + opens.cast("int") - closes.cast("int")
        return F.when(a["last"] > 0, a).otherwise(F.struct(
            (a["at"] + F.length(t)).alias("at"), depth.alias("depth"), F.when((t == '"') & (a["depth"] > 0), ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"),
            F.when(opens & (a["depth"] == 0), a["at"] + 1).otherwise(a["first"]).alias("first"), F.when(closes & (depth == 0), a["at"] + 1).otherwise(0).alias("last"),
        ))

    return n.let(F.aggregate(signs, start, step), lambda a: F.when(a["last"] > 0, F.substring(text, a["first"], a["last"] - a["first"] + 1)))


def tolerant_json(text) -> Column:
    """(how, json): the JSON that a reply holds and how it was found: WHOLE, OBJECT, LIST or SCANNED; both null where there is none."""
    # Parsers stop behind the first value, so a value has to stand alone in a list and in an object: no text ends both early.
    valid = lambda c: (F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1) & F.call_function("try_parse_json", F.concat(F.lit('{"x":'), c, F.lit("}"))).isNotNull()
    plain = without_fence(text)

    def ways(p):
        tries = [("WHOLE", F.nullif(p, F.lit(""))), ("OBJECT", _slice(p, "{", "}")), ("LIST", _slice(p, "[", "]")), ("SCANNED", first_object(p))]
        found = F.lit(None).cast("struct<how:string,json:string>")
        for how, j in reversed(tries):
            found = n.let(j, lambda v, how=how, rest=found: F.when(valid(v), F.struct(F.lit(how).alias("how"), v.alias("json"))).otherwise(rest))
        return found

    return n.let(plain, ways)


def read_fields(text) -> Column:
    """(how, fields): a reply's fields (field_id, value, confidence). SALVAGED: no JSON, but fields that are whole up to their confidence; null and none where there aren't any.

    A list of fields stands by itself or under "fields". A scanned object without
    fields isn't what was asked for; the rest of the reply is looked through then. Values that are no text
    are given as JSON writes them. Fields without an id are left out.
    """
    named = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast(FIELDS)), lambda f: f["fieldId"].isNotNull()), lambda f: F.struct(f["fieldId"].alias("field_id"), f["value"].alias("value"), f["confidence"].alias("confidence")))

    def parsed(t):
        # A list is read as a list, an object by its "fields".
        listed = F.when(F.startswith(F.ltrim(t["json"]), F.lit("[")), F.concat(F.lit('{"fields":'), t["json"], F.lit("}"))).otherwise(t["json"])
        fields = named(F.from_json(listed, f"struct<fields:{FIELDS}>")["fields"])
        rest = salvaged(F.coalesce(text, F.lit("")))
        return F.when(t["json"].isNotNull() & ((t["how"] != "SCANNED") | (F.size(fields) > 0)), F.struct(t["how"].alias("how"), fields.alias("fields"))).otherwise(n.let(rest, lambda r: F.struct(F.when(F.size(r) > 0, "SALVAGED").alias("how"), r.alias("fields"))))

    return n.let(tolerant_json(text), parsed)
