"""Tolerant parsing of replies: the ways in their order, and odd texts."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import replies

F1 = '{"fieldId":"a","value":"1","confidence":90}'


@pytest.mark.parametrize(
    ("reply", "how", "fields"),
    [
        ('{"fields":[' + F1 + "]}", "WHOLE", [("a", "1", 90.0)]), ("  \n```JSON\n[" + F1 + "]\n```  ", "WHOLE", [("a", "1", 90.0)]), ("```\n{}\n```", "WHOLE", []), ("ok: {\"fields\":[" + F1 + "]}.", "OBJECT", [("a", "1", 90.0)]),
        ("here [" + F1 + "] done", "OBJECT", []), ("here [" + F1 + "," + F1 + "] done", "LIST", [("a", "1", 90.0)] * 2), ("[1] and {", "LIST", []), ('x {"fields":[{"fieldId":"a","value":"}{ \\" }","confidence":1}]} y } z ]', "SCANNED", [("a", '}{ " }', 1.0)]), ('say "hi {" then {"fields":[' + F1 + "]} or } ]", "SALVAGED", [("a", "1", 90.0)]),
        ('{"fields":[' + F1 + ',{"fieldId":"b","val', "SALVAGED", [("a", "1", 90.0)]), ("nothing", None, []), ("", None, []), (None, None, []), ("{{{{", None, []), ('{"fields": null}', "WHOLE", []), ('{"fields":[{"value":"no id"}]}', "WHOLE", []),
        ('{"fields":[{"fieldId":"n","value":12.5,"confidence":null},{"fieldId":"m","value":null}]}', "WHOLE", [("n", "12.5", None), ("m", None, None)]), ("\\ } ] [ {", None, []), ('{"a":1}{"fields":[' + F1 + "]}", "LIST", [("a", "1", 90.0)]), ('{"a":1}{"fields":[' + F1 + "]} ]", "SALVAGED", [("a", "1", 90.0)]), ('{"a":1} junk', "OBJECT", []), ("{'a':1}", None, []),
    ],
)
def test_reply(spark, reply, how, fields):
    r = spark.createDataFrame([(reply,)], "reply string").select(replies.read_fields(F.col("reply")).alias("r")).first().r
    assert (r.how, [tuple(f) for f in r.fields]) == (how, fields)


def test_long_strings_are_scanned(spark):
    """Many escapes in one string: nothing recurses over them."""
    value = '\\"}' * 40_000
    reply = 'ok {"fields":[{"fieldId":"a","value":"' + value + '","confidence":5}]} and } more ]'
    r = spark.createDataFrame([(reply,)], "reply string").select(replies.read_fields(F.col("reply")).alias("r")).first().r
    assert r.how == "SCANNED" and r.fields[0].value == '"}' * 40_000
