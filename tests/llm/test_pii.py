"""Pseudonyms of every kind against a plain version, and back again."""

import calendar
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from roadloom.llm import pii


def network(x, a, b, kind, key="k"):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        f = lambda half, n, i=i: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16) % n
        if i % 2 == 0:
            left = (left + f(right, a)) % a
        else:
            right = (right + f(left, b)) % b
    return left * b + right


def fill(layout, number):
    it = iter(number)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def luhn_digit(head):
    s = 0
    for i, c in enumerate(reversed(head)):
        x = int(c) * (2 - i % 2)
        s += x - 9 * (x > 9)
    return str(-s % 10)


def iban_digits(country, body):
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def brute(value, kind):
    d = re.sub(r"\D", "", value)
    if kind == "card":
        n = len(d) - 1
        head = f"{network(int(d[:-1]), 10 ** (n - n // 2), 10 ** (n // 2), f'card{n + 1}'):0{n}d}"
        return fill(value, head + luhn_digit(head))
    if kind == "ip":
        x = 0
        for q in value.split("."):
            x = x * 256 + int(q)
        y = network(x, 1 << 16, 1 << 16, "ip")
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        area = int(d[:3])
        y = network(((area - (2 if area > 666 else 1)) * 99 + int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898 * 99, 9999, "ssn")
        area = y // (99 * 9999)
        return f"{area + (2 if area >= 665 else 1):03d}-{y // 9999 % 99 + 1:02d}-{y % 9999 + 1:04d}"
    if kind == "phone":
        if not value.startswith("+") or value.startswith("+1"):
            return fill(value, d[:-10] + f"{network(int(d[-10:]), 10**5, 10**5, 'phone'):010d}")
        n = len(d) - 3
        return fill(value, d[:3] + f"{network(int(d[3:]), 10 ** (n - n // 2), 10 ** (n // 2), f'phone{len(d)}'):0{n}d}")
    if kind == "iban":
        moved = fill(value, d[:-10] + f"{network(int(d[-10:]), 10**5, 10**5, 'iban'):010d}")
        plain = moved.replace(" ", "")
        return moved[:2] + iban_digits(plain[:2], plain[4:]) + moved[4:]
    if "-" in value or re.fullmatch(r"(\d\d)([/.])(\d\d)\2\d{4}", value) and int(value[3:5]) <= 12:
        day = np.datetime64(value if "-" in value else f"{value[6:]}-{value[3:5]}-{value[:2]}")
        y, m, dd = str(np.datetime64("1900-01-01") + network(int((day - np.datetime64("1900-01-01")).astype(int)), 17, 4297, "date")).split("-")
        return f"{y}-{m}-{dd}" if "-" in value else f"{dd}{value[2]}{m}{value[2]}{y}"
    one, mark, two, year = re.fullmatch(r"(\d+)([/.])(\d+)[/.](\d+)", value).groups()
    month_first = int(two) > 12
    month, day = (one, two) if month_first else (two, one)
    if (int(month), int(day)) == (2, 29):
        return value[:-4] + str(1904 + 4 * network((int(year) - 1904) // 4, 7, 7, "leap"))
    same = [m * 100 + x for m in range(1, 13) for x in range(1, calendar.monthrange(2001, m)[1] + 1) if len(one) == len(two) == 2 and x > 12 or not (len(one) == len(two) == 2) and (len(str(m)), len(str(x))) == (len(month), len(day)) and (not month_first or x > 12)]
    name = ("m" if month_first else "d") + str(len(one)) + str(len(two))
    y = network((int(year) - 1900) * len(same) + same.index(int(month) * 100 + int(day)), 200, len(same), name)
    m, x = divmod(same[y % len(same)], 100)
    wide = 2 if len(one) == len(two) == 2 else 1
    return f"{m if month_first else x:0{wide}d}{mark}{x if month_first else m:0{wide}d}{mark}{1900 + y // len(same)}"


def values():
    rng = np.random.default_rng(7)
    some = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    out = []
    for n in range(13, 20):
        head = str(rng.integers(1, 10)) + some(n - 2)
        out.append((head + luhn_digit(head), "card"))
    head = "4" + some(14)
    card = head + luhn_digit(head)
    out += [(" ".join(card[i : i + 4] for i in range(0, 16, 4)), "card"), ("-".join(card[i : i + 4] for i in range(0, 16, 4)), "card")]
    out += [(x, "date") for x in ("1984-02-29", "2099-12-31", "1900-01-01", "31/12/1999", "01.05.2020", "29/02/2000", "12/31/2020", "02/29/2000", "5/6/2020", "9/12/1999", "3/25/2011", "2/29/2004", "29/2/2004", "31/1/1950", "1.2.2003", "24.8.1999", "7.11.2024")]
    out += [(x, "phone") for x in ("+1 (212) 555-0123", "(212) 555-0123", "212-555-0123", "212.555.0123", "+1-212-555-0123", "+49 30 901820", "+33 1 23 45 67 89", "+34 (91) 123-45-67", "+442079460958", "+86 138 0013 8000")]
    out += [(f"{a:03d}-{g:02d}-{s:04d}", "ssn") for a, g, s in ((1, 1, 1), (665, 99, 9999), (667, 50, 1234), (899, 99, 9999))]
    out += [(x, "ip") for x in ("10.0.0.255", "0.0.0.0", "255.255.255.255")]
    for country, body in (("DE", "370400440532013000"), ("GB", "WEST12345698765432"), ("NL", "ABNA0417164300"), ("FR", "20041010050500013M02606")):
        plain = country + iban_digits(country, body) + body
        out += [(plain, "iban"), (" ".join(plain[i : i + 4] for i in range(0, len(plain), 4)), "iban")]
    return out


def test_every_kind_matches_the_plain_version(spark):
    cases = values()
    docs = spark.createDataFrame([(i, f"see {v} here") for i, (v, _) in enumerate(cases)], "doc_id long, text string")
    out = pii.pseudonymise(docs, "k")
    got = {r.doc_id: r for r in out.collect()}
    for i, (value, kind) in enumerate(cases):
        assert [(c.kind, c.old, c.new) for c in got[i].changed] == [(kind, value, brute(value, kind))], value
        assert got[i].text == f"see {brute(value, kind)} here"
    back = pii.pseudonymise(out.drop("changed"), "k", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_what_does_not_validate_stays(spark):
    texts = ["DE00 3704 0044 0532 0130 00", "31/13/2020", "30/2/2020", "29/2/2001", "13.25.2020", "+49 30", "4111111111111112", "300.1.1.1", "000-12-3456", "1/2/1899", "DE89370400440532013000X"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()} == dict(enumerate(texts))


def test_sets_have_no_gaps():
    assert [len(x) for x in pii.LAYOUTS.values()] == [81, 27, 192, 165, 221]


def test_short_dates_are_permuted(spark):
    assert sorted(permuted(spark, 7, 7)) == list(range(49))


def permuted(spark, a, b, back=False):
    p = F.struct(F.col("id").alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit("t").alias("name"))
    df = spark.range(0, a * b).select(F.array(F.struct(p.alias("p"))).alias("c"))
    return [r.y for r in pii.feistel(df, "c", F.lit("k"), back).select(F.col("c")[0]["p"]["x"].alias("x"), F.col("c")[0]["y"].alias("y")).orderBy("x").collect()]


def test_feistel_undoes_itself(spark):
    there, back = permuted(spark, 17, 43), permuted(spark, 17, 43, True)
    assert [back[y] for y in there] == list(range(17 * 43)) and there == [network(x, 17, 43, "t") for x in range(17 * 43)]
