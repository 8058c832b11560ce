"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

One pattern finds

* phone numbers with a country code after + in any usual grouping, and ten-digit
  North American ones in groups (area in parentheses or not, 1 before or not),
* card numbers in one run or grouped 4-4-4-4, 4-6-5 and 4-6-4,
* IBANs of the countries in IBAN_LENGTHS, in one run or in groups of four,
* IPv4 addresses and e-mail addresses,
* numeric dates of 1900 to 2099, year first or last, with / - or . between. Year
  last is read as day/month, or as month/day where only that is in the calendar;
  a pseudonym keeps the order it was read in, and stays in those two centuries.

What fails its validation (Luhn's sum, IBAN's remainder, octets to 255, days of
the calendar) stays as it is. A value's number is permuted by a keyed Feistel
network within its format, so the same value has the same pseudonym in every
document, different values of a format have different ones, and a pseudonym has
the value's grouping and check digits. Work is per row: nothing is shuffled or
gathered.

Out of scope: names and postal addresses, phone numbers without + outside North
America or without grouping, numbers with 00 for +, extensions, 19-digit cards
in groups, dates with month names or two-digit years, IPv6, and national id
numbers (social security, passport, tax). A number that follows a phone number
after +, with nothing but a space between, may be taken for its last group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import carried, table

ROUNDS = 8
#: The days that dates are permuted among, 1900-01-01 to 2099-12-31, as a product of two factors.
DAYS = (17, 4297)

#: Look-arounds keep longer numbers, versions and words out.
PHONE = (
    r"\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\d)|\+[2-9](?:[ .-]?\(\d{1,4}\)(?=[ .-]?\d)|[ .-]?\d){7,14}(?!\d)"
    r"|(?<![\w.+-])(?:1[ .-])?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\d|[.-]\d)"
)
#: What isn't permuted: the country code of the E.164 list, and a trunk 0 in parentheses.
PHONE_HEAD = r"^(?:\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})[ .-]*(?:\(0\))?|1[ .-])?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = "|".join(rf"(?<![\d{c}])(?:(?:19|20)\d\d{c}\d\d?{c}\d\d?|\d\d?{c}\d\d?{c}(?:19|20)\d\d)(?!\d|{c}{after})" for c, after in ((r"\-", ""), ("/", ""), (r"\.", r"\d")))
CARD = r"(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?![\d-])"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|CR|HR|LI|LV", 22: "BG|BH|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "PT|ST", 26: "IS|TR", 27: "FR|GR|IT|MC|MR|SM", 28: "AL|AZ|CY|DO|GT|HU|LB|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c})\d\d(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
#: A look at the next character settles most places of a text.
NUMBER = f"(?=[0-9+(]|[A-Z]{{2}}[0-9]{{2}})(?:(?:{IBAN})|(?:{PHONE})|(?:{IPV4})|(?:{DATE})|(?:{CARD}))"
ANY = f"(?:{EMAIL})|{NUMBER}"
#: Stands around values while a text is cut (a private-use character).
MARK = "\ue0f7"


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once: a lambda's variable is, where an expression named twice is evaluated twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(number: Column, left: Column, right: Column, key: str, tweak: str | Column) -> Column:
    """A permutation of 0 .. left * right - 1: the halves, number div right and mod right, take turns in being shifted by a keyed draw of the other."""
    state = F.struct(F.call_function("div", number, right).alias("l"), (number % right).alias("r"))
    step = lambda s, i: F.when(
        i % 2 == 0, F.struct(((s["l"] + _drawn(key, tweak, i, s["r"], left)) % left).alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _drawn(key, tweak, i, s["l"], right)) % right).alias("r")))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step), lambda out: out["l"] * right + out["r"])


def _drawn(key: str, tweak: str | Column, i: Column, half: Column, size: Column) -> Column:
    """A keyed number below size: 48 bits of a SHA-256 of key, format, round and half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string"), size.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % size


def _long(c: int) -> Column:
    return F.lit(c).cast("long")


def permuted_digits(digits: Column, key: str, tweak: str | Column) -> Column:
    """A string of 1 to 18 digits, permuted among those of its length."""
    powers = F.array(*[_long(10**i) for i in range(10)])

    def halves(d):
        low = F.shiftright(F.length(d), 1)
        return F.struct(d.cast("long").alias("number"), F.get(powers, F.length(d) - low).alias("left"), F.get(powers, low).alias("right"), F.length(d).alias("n"))

    return let(let(digits, halves), lambda s: F.lpad(feistel(s["number"], s["left"], s["right"], key, tweak).cast("string"), s["n"], "0"))


def luhn_sum(digits: Column) -> Column:
    """The sum over all digits, every second from the right doubled, nines cast out."""

    def total(digits):
        def add(total, i):
            d = F.substring(digits, i, F.lit(1)).cast("int")
            twice = d * 2 - F.when(d > 4, 9).otherwise(0)
            return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)

    return let(digits, total)


def _refill(pattern: Column, digits: Column) -> Column:
    """pattern with its digits, one after another, taken from digits."""
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def filled(digits):
        def put(state, c):
            is_digit = c.between("0", "9")
            return F.struct(F.concat(state["s"], F.when(is_digit, F.substring(digits, state["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (state["k"] + is_digit.cast("int")).alias("k"))

        return F.aggregate(F.split(pattern, ""), zero, put)["s"]

    return let(digits, filled)


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column, key: str) -> Column:
    def made(digits):
        body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        whole = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _refill(v, whole)).otherwise(v)

    return let(_only_digits(v), made)


def _phone(v: Column, key: str) -> Column:
    """The digits after the country code, which is 1 where there is none."""

    def made(s):
        tweak = F.when(s["code"] == "1", "phone").otherwise(F.concat(F.lit("phone"), s["code"]))
        return F.concat(s["head"], _refill(s["rest"], permuted_digits(_only_digits(s["rest"]), key, tweak)))

    def parts(head):
        code = F.when(head.startswith("+"), _only_digits(F.regexp_replace(head, r"\(0\)", ""))).otherwise("1")
        return F.struct(head.alias("head"), code.alias("code"), F.substring(v, F.length(head) + 1, F.lit(99)).alias("rest"))

    return let(let(F.regexp_extract(v, PHONE_HEAD, 0), parts), made)


def _mod97(v: Column) -> Column:
    """The remainder of a string of digits and capitals, which count from 10 on."""

    def of(v):
        def add(rest, i):
            d = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(v, i, F.lit(1))) - 1
            return (rest * F.when(d > 9, 100).otherwise(10) + d) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), add)

    return let(v, of)


def _iban(v: Column, key: str) -> Column:
    """The digits after the check digits, which are made anew; letters stay."""

    def parts(plain):
        body = F.substring(plain, F.lit(5), F.lit(99))
        return F.struct(plain.alias("plain"), F.substring(plain, 1, 2).alias("country"), body.alias("body"), _only_digits(body).alias("digits"))

    def made(p):
        # Up to 28 digits: the second half's permutation depends on the first half.
        half = F.shiftright(F.length(p["digits"]), 1)
        first, second = F.substring(p["digits"], F.lit(1), half), F.substring(p["digits"], half + 1, F.lit(99))
        digits = F.concat(permuted_digits(first, key, "iban"), permuted_digits(second, key, F.concat(F.lit("iban"), p["country"], first)))
        check = lambda d: F.lpad((98 - _mod97(F.concat(_refill(p["body"], d), p["country"], F.lit("00")))).cast("string"), 2, "0")
        new = let(digits, lambda d: F.concat(p["country"], _refill(F.substring(v, F.lit(3), F.lit(99)), F.concat(check(d), d))))
        return F.when((_mod97(F.concat(p["body"], F.substring(p["plain"], 1, 4))) == 1) & (F.length(p["digits"]) >= 4), new).otherwise(v)

    return let(let(F.regexp_replace(v, " ", ""), parts), made)


def _ipv4(v: Column, key: str) -> Column:
    def made(parts):
        number = F.aggregate(parts, _long(0), lambda n, p: n * 256 + p)
        shown = lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])
        return F.when(F.forall(parts, lambda p: p <= 255), let(let(number, lambda n: feistel(n, _long(65536), _long(65536), key, "ipv4")), shown)).otherwise(v)

    return let(F.transform(F.split(v, r"\."), lambda p: p.cast("long")), made)


def _date(v: Column, key: str) -> Column:
    def read(parts):
        part = lambda i: F.lpad(F.element_at(parts, i), 2, "0")
        day_of = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.element_at(parts, y), part(m), part(d)), "yyyy-MM-dd")
        iso = F.length(F.element_at(parts, 1)) == 4
        return F.struct(iso.alias("iso"), F.when(iso, day_of(1, 2, 3)).otherwise(day_of(3, 2, 1)).alias("day"), F.when(~iso, day_of(3, 1, 2)).alias("month_first"))

    start, short = F.lit("1900-01-01").cast("date"), F.length(v) < 10  # without leading zeros

    def made(r):
        day = F.coalesce(r["day"], r["month_first"])
        other = let(F.datediff(day, start).cast("long"), lambda n: F.date_add(start, feistel(n, _long(DAYS[0]), _long(DAYS[1]), key, "date").cast("int")))
        shown = lambda d, full, brief: F.when(short, F.date_format(d, brief)).otherwise(F.date_format(d, full))
        new = lambda d: F.when(r["iso"], shown(d, "yyyy-MM-dd", "yyyy-M-d")).when(r["day"].isNotNull(), shown(d, "dd-MM-yyyy", "d-M-yyyy")).otherwise(shown(d, "MM-dd-yyyy", "M-d-yyyy"))
        return F.when(day.isNull(), v).otherwise(F.replace(let(other, new), F.lit("-"), F.regexp_extract(v, "[-/.]", 0)))

    return let(let(F.split(v, "[-/.]"), read), made)


def _email(v: Column, key: str) -> Column:
    """No number: a keyed digest of the lower-cased address, in the form of an address that can't exist."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(v)), 256), 1, 16), F.lit("@mail.invalid"))


def kind_of(v: Column) -> Column:
    return (
        F.when(F.contains(v, F.lit("@")), "email").when(v.rlike("^[A-Z]"), "iban").when(v.rlike(r"^(\d{4}([-/.])\d\d?\2\d\d?|\d\d?([-/.])\d\d?\3\d{4})$"), "date")
        .when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ipv4").when(v.rlike(r"^[+(]|^(1[ .-])?\(?\d{3}\)?[ .-]"), "phone").otherwise("card")
    )


def pseudonym(v: Column, key: str) -> Column:
    return let(kind_of(v), lambda kind: (
        F.when(kind == "email", _email(v, key)).when(kind == "phone", _phone(v, key)).when(kind == "ipv4", _ipv4(v, key)).when(kind == "date", _date(v, key))
        .when(kind == "iban", _iban(v, key)).otherwise(_card(v, key))
    ))


def _cut(text: Column, pattern: str) -> Column:
    """The text in pieces: what the pattern leaves, then a value, and so on in turn. One pass; two for a text that holds MARK."""
    twice = F.flatten(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with pseudonyms in text, and n_pii: the values that were replaced.

    Null texts become empty; texts without personal data stay as they are. Rows
    that repeat and other columns are kept; a column n_pii is replaced. Equal
    values have equal pseudonyms under one key, whatever document they are in.
    """
    docs = docs.drop("n_pii")
    whole, back = carried(docs, text)
    t = F.coalesce(F.col(text), F.lit("")).alias("t")
    pieces = F.when(F.contains("t", F.lit("@")), _cut(F.col("t"), ANY)).when(F.regexp_like("t", F.lit("[0-9]")), _cut(F.col("t"), NUMBER))
    staged = docs.select(whole, t).select("whole", "t", pieces.alias("pieces"))
    new = F.transform("pieces", lambda v, i: F.when((i % 2 == 0) | (v == ""), v).otherwise(pseudonym(v, key)))
    staged = staged.select("whole", "t", "pieces", F.when(F.size("pieces") > 1, new).alias("new"))
    changed = F.aggregate(F.zip_with("pieces", "new", lambda a, b: (a != b).cast("long")), _long(0), lambda n, x: n + x)
    done = staged.select("whole", F.coalesce(F.array_join("new", ""), "t").alias(text), F.coalesce(changed, _long(0)).alias("n_pii"))
    return done.select(*back, "n_pii")


#: The key of the registered query. A user takes one from a secret store.
DEMO_KEY = "corpus-demo-key"


def query(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "n_pii")
