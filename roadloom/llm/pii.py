"""Format-preserving pseudonyms for validated numbers and dates, with DataFrame functions only.

Kinds, in the order of their choice where two could begin at one place:
  card   13 to 19 digits, or 15 or 16 in the usual groups, that pass the Luhn check
  iban   two letters, two check digits, 11 to 30 more characters with at least ten digits, sum 1 modulo 97
  date   a calendar date of 1900 to 2099: yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, the last two also with
         single digits, and mm/dd/yyyy where the day is over 12 (others count as day first)
  phone  a North American number with area code, in its usual forms, with or without +1, or any other
         international number of 8 to 15 digits behind a plus sign
  ssn    ddd-dd-dddd with valid parts
  ip     dotted quad of numbers to 255

A value is a point of a known set (digits of a card but the last, days of two centuries, ten phone
digits, ...). A keyed alternating Feistel network permutes that set, and the result is put back
into the value's own layout; check digits of cards and IBANs are computed anew so that they stay
valid. An international number keeps its first three digits (country code), an IBAN all but its last
ten digits (the account); 29 February in a short or month-first layout changes its year only. Equal
values get equal pseudonyms in all documents, other values other ones, and ``reverse`` undoes it.
Values that don't validate stay as they are.

Defined results: a null text stays null, an empty one empty; repeated rows are changed alike;
overlapping candidates are taken leftmost, without overlap.
"""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import numbered

#: Key of the query over the test tables only; the library asks for one.
QUERY_KEY = "key of the test query"
ROUNDS = 8
CARD = r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19}"
DATE = r"(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|(?:[0-3]?[0-9]/[0-3]?[0-9]/|[0-3]?[0-9]\.[01]?[0-9]\.)(?:19|20)[0-9]{2}"
PHONE = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"
ABROAD = r"\+(?!1[ .(-]?[0-9])[1-9](?:[ .-]?\(?[0-9]\)?){7,14}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
#: A full stop or hyphen before a value belongs to the word or bracket before it, and a time may follow a date.
BEFORE = r"(?:(?<![0-9A-Za-z+.-])|(?<=[\p{L})\]:][.-]))"
PATTERN = rf"{BEFORE}(?:(?:{DATE})(?=T[0-9]{{2}}:?[0-9]{{2}})|(?:{PHONE}|{ABROAD}|{DATE}|{SSN}|{IP}|{IBAN}|{CARD})(?![0-9A-Za-z]|[.-][0-9]))"
#: Days from 1900-01-01 to 2099-12-31: 73 049 = 17 * 4 297.
_DAYS = (17, 4297)


def _month_days(keep) -> list[int]:
    """month * 100 + day of the dates that every year has and that ``keep`` accepts."""
    return [m * 100 + d for m in range(1, 13) for d in range(1, calendar.monthrange(2001, m)[1] + 1) if keep(d, m)]


#: Other layouts of dates by the order and the numbers of digits of day and month, with their month-days.
LAYOUTS = {
    "d11": _month_days(lambda d, m: d < 10 and m < 10),
    "d12": _month_days(lambda d, m: d < 10 <= m),
    "d21": _month_days(lambda d, m: m < 10 <= d),
    "m12": _month_days(lambda d, m: m < 10 and d > 12),
    "m22": _month_days(lambda d, m: d > 12),
}
#: Digits of an IBAN that are permuted, and of an international number that stay.
ACCOUNT, COUNTRY = 10, 3


def _round(key: Column, kind: Column, i: int, half: Column, size: Column) -> Column:
    """A keyed value in [0, size) of one half."""
    digest = F.sha2(F.concat_ws("|", key, kind, F.lit(str(i)), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def _mod(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n))


def _seated(x: Column, a: Column, b: Column, kind: Column) -> Column:
    """The state of the network before its first round: x = left * b + right below a * b."""
    a, b = a.cast("long"), b.cast("long")
    return F.struct(F.floor(x.cast("decimal(20,0)") / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"), a.alias("a"), b.alias("b"), kind.alias("kind"))


def _turned(s: Column, key: Column, i: int, back: bool) -> Column:
    """The state after round i (or before it, with ``back``): the halves are changed in turn."""
    sign = -1 if back else 1
    if i % 2 == 0:
        return _state(s, F.pmod(s["l"] + sign * _round(key, s["kind"], i, s["r"], s["a"]), s["a"]), s["r"])
    return _state(s, s["l"], F.pmod(s["r"] + sign * _round(key, s["kind"], i, s["l"], s["b"]), s["b"]))


def feistel(df: DataFrame, column: str, key: Column, back: bool = False) -> DataFrame:
    """df whose array ``column`` of structs with p (x, a, b, name) gains y: x permuted among the whole numbers below a * b.

    A round is a column step of its own; in one nested expression they take long to analyse.
    """
    df = df.withColumn(column, F.transform(column, lambda s: s.withField("y", F.when(s["p"].isNotNull(), _seated(s["p"]["x"], s["p"]["a"], s["p"]["b"], s["p"]["name"])))))

    def turn(i: int):
        return lambda s: s.withField("y", _turned(s["y"], key, i, back))

    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        df = df.withColumn(column, F.transform(column, turn(i)))
    return df.withColumn(column, F.transform(column, lambda s: s.withField("y", s["y"]["l"] * s["y"]["b"] + s["y"]["r"])))


def _state(s: Column, left: Column, right: Column) -> Column:
    return F.struct(left.alias("l"), right.alias("r"), s["a"].alias("a"), s["b"].alias("b"), s["kind"].alias("kind"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(number: Column, doubled_last: bool = False) -> Column:
    """Luhn sum of a digit string; every second digit from the right counts double."""
    odd = 0 if doubled_last else 1
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda c, i: F.when(c == "", F.lit(0)).otherwise(
            F.when(F.pmod(i, F.lit(2)) == odd, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.try_cast("int") + 1)).otherwise(c.try_cast("int"))
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def put_back(layout: Column, number: Column) -> Column:
    """The digits of ``number`` in the places of the digits of ``layout``."""
    chars = F.split(layout, "")
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        chars,
        zero,
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(number, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _date(value: Column) -> Column:
    """The date of the layouts with two digits, day first or ISO."""
    iso = F.when(value.rlike("^[0-9]{4}-"), value).when(value.rlike("^[0-9]{2}[/.][0-9]{2}[/.]"), F.concat(value.substr(7, 4), F.lit("-"), value.substr(4, 2), F.lit("-"), value.substr(1, 2)))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def _other_date(value: Column) -> Column:
    """(layout, year, md) of a date that ``_date`` does not read: layout "leap" for 29 February; null if it is none."""
    part = F.split(value, "[/.]")
    one, two, year = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    sizes = F.concat(F.length(F.get(part, F.lit(0))), F.length(F.get(part, F.lit(1))))
    layout = F.when(sizes == "22", "m22").when(sizes == "11", "d11").when(sizes == "21", "d21").when(two <= 12, "d12").otherwise("m12")
    month_first = layout.startswith("m")
    md = F.when(month_first, one * 100 + two).otherwise(two * 100 + one)
    layout = F.when((md == 229) & (year % 4 == 0) & (year != 1900), "leap").otherwise(layout)
    known = F.array_contains(_of_layout(layout), md) | (layout == "leap")
    usable = value.rlike(r"^[0-9]{1,2}[/.][0-9]{1,2}[/.]") & _date(value).isNull() & known & ~(value.contains(".") & month_first)
    return F.when(F.coalesce(usable, F.lit(False)), F.struct(layout.alias("layout"), year.alias("year"), md.alias("md")))


def _of_layout(layout: Column) -> Column:
    out = F.array().cast("array<int>")
    for name, days in LAYOUTS.items():
        out = F.when(layout == name, F.expr(f"array({', '.join(map(str, days))})")).otherwise(out)
    return out


def mod97(text: Column) -> Column:
    """Remainder of the number that the characters spell, letters as 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban_check(plain: Column) -> Column:
    """The check digits of an IBAN without blanks, whatever it has in their place."""
    body = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(2)), F.lit("00"))
    return F.lpad((98 - mod97(body)).cast("string"), 2, "0")


def kind_of(value: Column) -> Column:
    """The kind of a candidate that validates, else null."""
    quad = F.split(value, r"\.")
    ip = F.forall(quad, lambda q: q.try_cast("int") <= 255)
    d = digits(value)
    plain = F.replace(value, F.lit(" "))
    iban = (F.length(plain).between(15, 34)) & (F.length(d) >= 2 + ACCOUNT) & (F.substr(plain, F.lit(3), F.lit(2)) == _iban_check(plain))
    return (
        F.when(value.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
        .when(value.rlike(f"^(?:{ABROAD})$"), F.when(F.length(d).between(8, 15), F.lit("phone")))
        .when(value.rlike(f"^(?:{DATE})$"), F.when(_date(value).isNotNull() | _other_date(value).isNotNull(), F.lit("date")))
        .when(value.rlike(f"^(?:{SSN})$"), F.when(~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$"), F.lit("ssn")))
        .when(value.rlike(f"^(?:{IP})$"), F.when(ip, F.lit("ip")))
        .when(value.rlike(f"^(?:{IBAN})$"), F.when(iban, F.lit("iban")))
        .when(value.rlike(f"^(?:{CARD})$"), F.when((F.length(d) >= 13) & (_mod(luhn_sum(d), 10) == 0), F.lit("card")))
    )


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _halves(n: Column) -> tuple[Column, Column]:
    """Sizes of the halves of a number of n digits."""
    right = F.floor(n / 2)
    return _power(n - right), _power(right)


def _point(value: Column, kind: Column) -> Column:
    """Where a value lies in the set of its kind: x below a * b, and the name of the set."""
    d, n = digits(value), F.length(digits(value))
    other = _other_date(value)
    days = F.size(_of_layout(other["layout"]))
    at = F.array_position(_of_layout(other["layout"]), other["md"]) - 1
    # valid areas are 001-899 but 666 (898 of them), groups 01-99, serials 0001-9999
    area, group, serial = (F.substr(d, F.lit(i), F.lit(k)).try_cast("long") for i, k in ((1, 3), (4, 2), (6, 4)))
    rank = ((F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1) * 9999 + serial - 1
    quad = F.aggregate(F.split(value, r"\."), F.lit(0).cast("long"), lambda a, q: a * 256 + F.coalesce(q.try_cast("long"), F.lit(0)))

    def point(x: Column, a, b, name) -> Column:
        a, b, name = (v if isinstance(v, Column) else F.lit(v) for v in (a, b, name))
        return F.struct(x.try_cast("long").alias("x"), a.cast("long").alias("a"), b.cast("long").alias("b"), name.alias("name"))

    return (
        F.when(kind == "card", point(F.substr(d, F.lit(1), n - 1), *_halves(n - 1), F.concat(F.lit("card"), n)))
        .when((kind == "date") & other.isNull(), point(F.date_diff(_date(value), F.lit("1900-01-01").cast("date")), *_DAYS, "date"))
        .when((kind == "date") & (other["layout"] == "leap"), point((other["year"] - 1904) / 4, 7, 7, "leap"))
        .when(kind == "date", point((other["year"] - 1900) * days + at, 200, days, other["layout"]))
        .when((kind == "phone") & value.rlike(f"^(?:{PHONE})$"), point(F.right(d, F.lit(10)), 10**5, 10**5, "phone"))
        .when(kind == "phone", point(F.substr(d, F.lit(COUNTRY + 1)), *_halves(n - COUNTRY), F.concat(F.lit("phone"), n)))
        .when(kind == "ssn", point(rank, 898 * 99, 9999, "ssn"))
        .when(kind == "ip", point(quad, 1 << 16, 1 << 16, "ip"))
        .when(kind == "iban", point(F.right(d, F.lit(ACCOUNT)), 10**5, 10**5, "iban"))
    )


def _padded(y: Column, size) -> Column:
    return F.lpad(y.cast("string"), size if isinstance(size, Column) else F.lit(size), F.lit("0"))


def _digits_of(value: Column, kind: Column, name: Column, y: Column) -> Column:
    """The digits that the point y has in a value; null for the kinds that are written anew."""
    d, n = digits(value), F.length(digits(value))
    head = _padded(y, n - 1)
    at = F.floor(y / (99 * 9999)).cast("long")
    area = F.when(at >= 665, at + 2).otherwise(at + 1)
    return (
        F.when(kind == "card", F.concat(head, F.pmod(10 - F.pmod(luhn_sum(head, True), F.lit(10)), F.lit(10)).cast("string")))
        .when(name == "phone", F.concat(F.when(value.startswith("+"), F.lit("1")).otherwise(F.lit("")), _padded(y, 10)))
        .when(kind == "phone", F.concat(F.left(d, F.lit(COUNTRY)), _padded(y, n - COUNTRY)))
        .when(kind == "ssn", F.concat(_padded(area, 3), _padded(F.pmod(F.floor(y / 9999), F.lit(99)) + 1, 2), _padded(F.pmod(y, F.lit(9999)) + 1, 4)))
        .when(kind == "iban", F.concat(F.left(d, n - ACCOUNT), _padded(y, ACCOUNT)))
    )


def _written(value: Column, kind: Column, name: Column, y: Column, filled: Column) -> Column:
    """The point y of a set in the layout of ``value``; filled: the value with its new digits, if it is of such a kind."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), y.cast("int"))
    plain = F.when(value.substr(5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).when(value.substr(3, 1) == "/", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    table = _of_layout(name)
    md = F.get(table, F.pmod(y, F.size(table)).cast("int"))
    month, of_month = (_padded(c, F.when(name == "m22", 2).otherwise(F.length(c.cast("string")))) for c in (F.floor(md / 100), md % 100))
    month_first = name.startswith("m")
    mark = F.when(value.contains("/"), "/").otherwise(".")
    short = F.concat(F.when(month_first, month).otherwise(of_month), mark, F.when(month_first, of_month).otherwise(month), mark, (1900 + F.floor(y / F.size(table))).cast("string"))
    return (
        F.when(kind == "iban", F.overlay(filled, _iban_check(F.replace(filled, F.lit(" "))), F.lit(3), F.lit(2)))
        .when(filled.isNotNull(), filled)
        .when(kind == "ip", F.concat_ws(".", *(F.pmod(F.floor(y / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
        .when(name == "date", plain)
        .when(name == "leap", F.concat(F.left(value, F.length(value) - 4), (1904 + 4 * y).cast("string")))
        .when(kind == "date", short)
        .otherwise(value)
    )


def replaced(df: DataFrame, column: str, key: Column, back: bool = False) -> DataFrame:
    """df whose array ``column`` of candidates becomes one of (kind, old, new); kind null: unchanged.

    new is the value's pseudonym, or with ``back`` the value of a pseudonym. Each step is a column step
    of its own, so that its value is computed once and the plan stays quick to analyse.
    """

    def also(df: DataFrame, name: str, of) -> DataFrame:
        return df.withColumn(column, F.transform(column, lambda s: s.withField(name, of(s))))

    df = df.withColumn(column, F.transform(column, lambda v: F.struct(v.alias("old"))))
    df = also(df, "kind", lambda s: kind_of(s["old"]))
    df = also(df, "p", lambda s: F.when(s["kind"].isNotNull(), _point(s["old"], s["kind"])))
    df = feistel(df, column, key, back)
    df = also(df, "digits", lambda s: F.when(s["kind"].isNotNull(), _digits_of(s["old"], s["kind"], s["p"]["name"], s["y"])))
    df = also(df, "filled", lambda s: F.when(s["digits"].isNotNull(), put_back(s["old"], s["digits"])))
    df = also(df, "new", lambda s: F.when(s["kind"].isNull(), s["old"]).otherwise(_written(s["old"], s["kind"], s["p"]["name"], s["y"], s["filled"])))
    return df.withColumn(column, F.transform(column, lambda s: F.struct(s["kind"].alias("kind"), s["old"].alias("old"), s["new"].alias("new"))))


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """docs with every validated value in ``text`` replaced; adds array ``changed`` of (kind, old, new).

    A column ``changed`` of docs gives way to it; other columns may have any name. The key is a
    literal of the plan, so whoever may read the plans of a session (event logs) can read it.
    """
    docs = docs.drop("changed")
    plain, names = numbered(docs)
    text = F.coalesce("text", F.lit(""))
    found = plain.withColumn("__m", F.when(text.rlike("[0-9][^A-Za-z]*[0-9]"), F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    found = replaced(found.withColumnRenamed("__m", "__c"), "__c", F.lit(key), back)
    parts = F.transform(F.split("text", PATTERN, -1), lambda p, i: F.concat(p, F.coalesce(F.get(F.col("__c"), i)["new"], F.lit(""))))
    new = F.when(F.size("__c") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    others = [F.col(n) if n != "text" else new.alias("text") for n in names]
    return found.select(*others, F.filter("__c", lambda c: c["kind"].isNotNull()).alias("changed")).toDF(*docs.columns, "changed")


KINDS = ("card", "date", "phone", "ssn", "ip", "iban")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, QUERY_KEY)

    def count(kind: str) -> Column:
        return F.size(F.filter("changed", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select("doc_id", "text", *counts, F.array_join(F.transform("changed", lambda c: F.concat_ws(":", c["kind"], c["new"])), ",").alias("pseudonyms"))
