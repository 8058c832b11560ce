import datetime
import hashlib
import re

from pyspark.sql import functions as F

from tallyspark.llm import pseudonyms as p


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_feistel_permutes(spark):
    got = spark.range(1000).select(p.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"), p.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "other", "t").alias("y")).collect()
    assert sorted(r.x for r in got) == [f"{i:03}" for i in range(1000)] == sorted(r.y for r in got)
    assert sum(r.x == r.y for r in got) < 20
    days = spark.range(366).select(p._date(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), "k").alias("d")).collect()
    assert len({r.d for r in days}) == 366 and all(datetime.date.fromisoformat(r.d) for r in days)


def test_values_keep_their_format_and_stay_linked(spark):
    card, phone, ip, day = "4111 1111 1111 1111", "+1 (212) 555-0123", "192.168.10.7", "03/12/1987"
    texts = [
        (1, f"call {phone}, card {card}; from {ip} on {day} and 1987-12-03."), (2, f"{phone} {card}\n{ip} {day} Mail A.B@x-y.org"), (3, "card 4111 1111 1111 1112, 999.1.1.1, 2023-02-30, v1.2.3.4.5, 31/02/2020"), (4, None), (5, ""),
        (6, "no data here"), (7, "word " * 40_000 + card), (7, card), (None, phone), (8, "a.b@X-Y.org"),
    ]
    df = spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id long, text string, n_pii int")
    rows = p.pseudonymise(df, "key").collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    found = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}), card ((?:\d{4} ){3}\d{4}); from ([\d.]+) on (\d\d/\d\d/\d{4}) and (\d{4}-\d\d-\d\d)\.", by[1].text)
    assert found and by[1].n_pii == 5
    a, b, c, d, e = found.groups()
    assert by[2].text.startswith(f"{a} {b}\n{c} {d} Mail u") and by[2].text.endswith("@mail.invalid") and by[None].text == a
    assert luhn(b.replace(" ", "")) and (a, b, c, d) != (phone, card, ip, day) and all(int(x) < 256 for x in c.split("."))
    assert datetime.datetime.strptime(d, "%d/%m/%Y").date() == datetime.date.fromisoformat(e)
    assert by[3].text == texts[2][1] and by[3].n_pii == 0 and by[4].text == by[5].text == "" and by[6].text == "no data here"
    assert sorted(r.text[-19:] for r in rows if r.doc_id == 7) == [b, b]
    assert by[8].text == by[2].text.split("Mail ")[1]
    assert p.pseudonymise(df.limit(0), "key").count() == 0
    assert p.pseudonymise(df, "another").where("doc_id = 1").first().text != by[1].text


def test_forms_that_the_tables_do_not_hold(spark):
    forms = {
        r"\+1 \d{3}-\d{3}-\d{4}": "+1 415-555-0100", r"\d{3}-\d{3}-\d{4}": "415-555-0100", r"\(\d{3}\) \d{3}-\d{4}": "(415) 555-0100", r"1\.\d{3}\.\d{3}\.\d{4}": "1.415.555.0100", r"\+1\d{10}": "+14155550100",
        r"\+44 \d\d \d{4} \d{4}": "+44 20 7946 0958", r"\+44 \(0\)\d\d \d{4} \d{4}": "+44 (0)20 7946 0958", r"\+49 \d{3}/?\d+-\d+": "+49 30901820-12", r"\+33\d{9}": "+33142685300",
        r"\d{4} \d{6} \d{5}": "3782 822463 10005", r"\d{4}-\d{6}-\d{4}": "3056-930902-5904", r"\d\d/\d\d/\d{4}": "04/25/1990", r"\d\d\.\d\d\.\d{4}": "25.04.1990", r"\d\d?/\d\d?/\d{4}": "4/5/1990", r"\d{4}/\d\d/\d\d": "1990/04/25",
        r"DE\d\d(?: \d{4}){4} \d\d": "DE89 3704 0044 0532 0130 00", r"GB\d\dNWBK\d{14}": "GB29NWBK60161331926819", r"BE\d\d(?: \d{4}){3} ABC": "BE68 5390 0754 7034 ABC", r"PL\d{26}": "PL61109010140000071219812874",
    }
    left = ["3782 822463 10006", "DE89 3704 0044 0532 0130 01", "13/13/1990", "2023-02-30", "1.2.3", "100-200-3000", "123-45-6789", "4155550100", "+12"]
    df = spark.createDataFrame([(i, f"see {v}.") for i, v in enumerate([*forms.values(), *left])], "doc_id long, text string")
    rows = {r.doc_id: r for r in p.pseudonymise(df, "key").collect()}
    for i, (form, v) in enumerate(forms.items()):
        assert re.fullmatch(f"see {form}\\.", rows[i].text) and rows[i].n_pii == 1 and v not in rows[i].text, (v, rows[i])
    for i, v in enumerate(left, len(forms)):
        assert rows[i].text == f"see {v}." and rows[i].n_pii == 0
    got = {v: rows[i].text[4:-1] for i, v in enumerate(forms.values())}
    digits = lambda v: re.sub(r"\D", "", v)
    assert len({digits(got[v])[-10:] for v in list(forms.values())[:5]}) == 1 and digits(got["+44 20 7946 0958"]) == digits(got["+44 (0)20 7946 0958"].replace("(0)", ""))
    assert luhn(digits(got["3782 822463 10005"])) and luhn(digits(got["3056-930902-5904"]))
    for v in [x for x in got.values() if x[0] in "DGBP"]:
        v = v.removesuffix(" ABC").replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


class Brute:
    """The same pseudonyms in plain Python, value by value."""

    def __init__(self, key):
        self.key = key

    def feistel(self, n, left, right, tweak):
        a, b = divmod(n, right)
        for i in range(8):
            half, size = (b, left) if i % 2 == 0 else (a, right)
            drawn = int(hashlib.sha256(f"{self.key}|{tweak}|{i}|{half}|{size}".encode()).hexdigest()[:12], 16) % size
            a, b = ((a + drawn) % left, b) if i % 2 == 0 else (a, (b + drawn) % right)
        return a * right + b

    def digits(self, d, tweak):
        low = len(d) // 2
        return f"{self.feistel(int(d), 10 ** (len(d) - low), 10**low, tweak):0{len(d)}}"

    @staticmethod
    def refill(pattern, digits):
        it = iter(digits)
        return "".join(next(it) if c in "0123456789" else c for c in pattern)

    def card(self, v):
        d = re.sub(r"[^0-9]", "", v)
        if not luhn(d):
            return v
        body = self.digits(d[:-1], "card")
        return self.refill(v, next(body + str(c) for c in range(10) if luhn(body + str(c))))

    def phone(self, v):
        head = re.match(p.PHONE_HEAD, v)[0]
        code = re.sub(r"[^0-9]", "", head.replace("(0)", "")) if head.startswith("+") else "1"
        rest = v[len(head) :]
        return head + self.refill(rest, self.digits(re.sub(r"[^0-9]", "", rest), "phone" if code == "1" else "phone" + code))

    def iban(self, v):
        plain = v.replace(" ", "")
        country, body = plain[:2], plain[4:]
        rest = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        d = re.sub(r"[^0-9]", "", body)
        if rest(body + plain[:4]) != 1 or len(d) < 4:
            return v
        first, second = d[: len(d) // 2], d[len(d) // 2 :]
        made = self.digits(first, "iban") + self.digits(second, "iban" + country + first)
        return country + self.refill(v[2:], f"{98 - rest(self.refill(body, made) + country + '00'):02}" + made)

    def ipv4(self, v):
        parts = [int(x) for x in v.split(".")]
        if max(parts) > 255:
            return v
        n = self.feistel(int.from_bytes(bytes(parts), "big"), 65536, 65536, "ipv4")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def date(self, v):
        sign = re.search("[-/.]", v)[0]
        a = v.split(sign)
        orders = ["ymd"] if len(a[0]) == 4 else ["dmy", "mdy"]
        for order in orders:
            x = dict(zip(order, map(int, a), strict=True))
            try:
                day = datetime.date(x["y"], x["m"], x["d"])
            except ValueError:
                continue
            start = datetime.date(1900, 1, 1)
            new = start + datetime.timedelta(self.feistel((day - start).days, *p.DAYS, "date"))
            two = (lambda n: str(n)) if len(v) < 10 else (lambda n: f"{n:02}")
            return sign.join({"y": f"{new.year:04}", "m": two(new.month), "d": two(new.day)}[c] for c in order)
        return v

    def email(self, v):
        return "u" + hashlib.sha256(f"{self.key}|email|{v.lower()}".encode()).hexdigest()[:16] + "@mail.invalid"

    def of(self, v):
        if "@" in v:
            return self.email(v)
        if re.match("[A-Z]", v):
            return self.iban(v)
        if re.fullmatch(r"\d{4}([-/.])\d\d?\1\d\d?|\d\d?([-/.])\d\d?\2\d{4}", v):
            return self.date(v)
        if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v):
            return self.ipv4(v)
        return self.phone(v) if re.match(r"[+(]|(1[ .-])?\(?\d{3}\)?[ .-]", v) else self.card(v)

    def text(self, t):
        n = 0

        def put(m):
            nonlocal n
            new = self.of(m[0])
            n += new != m[0]
            return new

        done = re.sub(p.ANY, put, t, flags=re.ASCII)
        return done, n


def test_documents_against_plain_python(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    brute = Brute(p.DEMO_KEY)
    want = {d: brute.text(t) for d, t in texts.items()}
    assert {r.doc_id: (r.text, r.n_pii) for r in p.query(spark, sf).collect()} == want
    assert sum(n for _, n in want.values()) > 10


def test_forms_against_plain_python(spark):
    mark = p.MARK
    texts = [
        "+44 (0)20 7946 0958 and 415-555-0100, 1.415.555.0100; 4111111111111111 4111 1111 1111 1112", f"DE89 3704 0044 0532 0130 00{mark}a@b.org{mark}{mark} 12.12.2012", f"{mark}10.0.0.1{mark}", "12/31/1999 1/2/2003 31/02/2020 2099-12-31 1900-01-01",
        "6304000000000000 0000 300000000000000000003 999.1.1.1", "x@y.com,z@y.com", "2020-01-01@x.org", "4026000000000002 5105105105105100 6011111111111117",
    ]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, _found int, whole int")
    got = p.pseudonymise(df, "k")
    assert got.columns == [*df.columns, "n_pii"]
    brute = Brute("k")
    assert {r.doc_id: (r.text, r.n_pii) for r in got.collect()} == {i: brute.text(t) for i, t in enumerate(texts)}


def test_long_numbers_stay_apart(spark):
    """Where a double's division would round: numbers of 16 to 18 digits beside multiples of the right half."""
    numbers = [f"{k * 10 ** (n // 2) + d:0{n}}" for n in (16, 17, 18) for k in (1, 999, 10 ** (n - n // 2) - 1) for d in (0, 1, 10 ** (n // 2) - 1)] + ["000000000999999999", "999999999999999999"]
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(numbers)], "d string")
    got = {r.d: r.x for r in df.select("d", p.permuted_digits(F.col("d"), "k", "card").alias("x")).collect()}
    brute = Brute("k")
    assert got == {d: brute.digits(d, "card") for d in got} and len(set(got.values())) == len(got)
