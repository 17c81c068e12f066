"""Format-preserving pseudonyms for personal numbers and dates, in SQL functions only.

A validated value is a number of a fixed range a * b and is permuted within it by an alternating Feistel network whose round
function is a keyed SHA-256. So a pseudonym has the value's format and validity, equal values get equal pseudonyms in all documents, and
different values different ones; whoever holds the key can go back.

Kinds, all of them found in one pass of one pattern:

* card: 13 to 19 digits with a valid check digit, in one piece or in groups (4-4-4-4, 4-6-5, 4-6-4, 4-4-4-4-3) with spaces or hyphens: all digits
  but the last are permuted, the check digit is made anew, separators stay;
* phone: ten digits as AAA-BBB-CCCC, AAA.BBB.CCCC or (AAA) BBB-CCCC, with or without 1 or +1 (then spaces and no separators too): those ten; or + and
  8 to 15 digits of another country: all but the first two. Separators stay, and a number gets the same pseudonym however it is written;
* ip: four octets of 0 to 255, as a 32-bit number;
* ssn: AAA-GG-SSSS in the issued ranges, which are kept;
* date: a real yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy of 1800 to 2199: its day number in those 400 years;
* email and secret (40 hex digits) are no numbers: they get a keyed digest of the same alphabet, linked in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 5
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9_À-ɏ][A-Za-z0-9._%+À-ɏ-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "phone": r"(?:(?:\+1[ .-]?|(?<![0-9.+-])1[ .-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}|(?:\([0-9]{3}\)[ .-]?|(?<![0-9.+-])[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9]|[.-][0-9])"
    r"|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|\+[2-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])",
    "date": r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|" + "|".join(s.join(f"[0-9]{{{n}}}" for n in sizes) for s in " -" for sizes in ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))) + r")(?![0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _keyed(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def feistel(x: Column, a: int | Column, b: int | Column, key: str, kind: str | Column) -> Column:
    """Permutes 0 .. a*b-1."""

    def value(i: Column, half: str, of: Column, most: int) -> Column:
        digest = F.conv(F.substring(_keyed(key, kind, half, i.cast("string"), of.cast("string")), 1, 15), 16, 10)
        return F.pmod(digest.cast("long"), F.lit(most))

    def turn(at: Column, i: Column) -> Column:
        left = (at["l"] + value(i, "l", at["r"], a)) % a
        return F.struct(left.alias("l"), ((at["r"] + value(i, "r", left, b)) % b).alias("r"))

    start = F.struct(F.round((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda at: at["l"] * b + at["r"])


def _digit_sum(number: Column, first: int | Column) -> Column:
    """Luhn's sum of a digit string whose first digit is doubled if first is 1."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((i + first) % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add)


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _permuted(digits: Column, key: str, kind: str, usual: int) -> Column:
    """Digits of any number up to 18 permuted among those of as many; each length has its own permutation."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")

    def power(i: Column) -> Column:
        return F.element_at(F.array(*(F.lit(10**k).cast("long") for k in range(1, 10))), i)

    named = F.when(n == usual, F.lit(kind)).otherwise(F.concat(F.lit(kind), n.cast("string")))
    return F.lpad(feistel(digits.cast("long"), power(half), power(n - half), key, named).cast("string"), n, "0")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced one by one, all else in place."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(had: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct((had["at"] + is_digit.cast("int")).alias("at"), F.concat(had["out"], F.when(is_digit, F.substring(digits, had["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(m, ""), start, step, lambda had: had["out"])


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        first = 1 - F.length(d) % 2
        body = _permuted(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", 15)
        done = _let(body, lambda b: F.concat(b, ((10 - _digit_sum(b, first) % 10) % 10).cast("string")))
        return F.when(_digit_sum(d, first) % 10 == 0, _let(done, lambda x: _refill(m, x))).otherwise(m)

    return _let(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        kept = F.when(m.startswith("+") & ~m.startswith("+1"), 2).otherwise(F.length(d) - 10)
        new = _permuted(F.substring(d, kept + 1, F.length(d)), key, "phone", 10)
        return _let(F.concat(F.substring(d, F.lit(1), kept), new), lambda x: _refill(m, x))

    return _let(_digits(m), of)


def _ip(m: Column, key: str) -> Column:
    number = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long"))
    return _let(feistel(number, 1 << 16, 1 << 16, key, "ip"), lambda n: F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel((rank * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def shown(n: Column) -> Column:
        r = F.floor(n / (99 * 9999))
        parts = (F.when(r >= 665, r + 2).otherwise(r + 1), F.floor(n / 9999) % 99 + 1, n % 9999 + 1)
        return F.concat_ws("-", *(F.lpad(p.cast("string"), w, "0") for p, w in zip(parts, (3, 2, 4), strict=True)))

    return F.when(valid, _let(new, shown)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = F.substring(m, 5, 1) == "-"
    mark = F.substring(m, 3, 1)
    written = F.when(iso, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    day = F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date")
    first = F.lit("1800-01-01").cast("date")
    number = F.datediff(day, first).cast("long")
    valid = day.isNotNull() & number.between(0, 189 * 773 - 1) & (iso | (mark == F.substring(m, 6, 1)))

    def shown(n: Column) -> Column:
        d = F.date_add(first, n.cast("int"))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "yyyy")))

    return F.when(valid, _let(feistel(number, 189, 773, key, "date"), shown)).otherwise(m)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_keyed(key, "email", F.lower(m)), 1, 14), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    new = F.substring(_keyed(key, "secret", F.lower(m)), 1, 40)
    return F.when(F.upper(m) == m, F.upper(new)).otherwise(new)


def _kind(m: Column) -> Column:
    """Of a match: which pattern made it."""
    def whole(kind: str) -> Column:
        return m.rlike(f"^(?:{PATTERNS[kind]})$")

    return (
        F.when(m.contains("@"), "email").when(F.length(m) == 40, "secret").when(whole("phone"), "phone").when(whole("date"), "date").when(whole("ssn"), "ssn")
        .when(F.length(_digits(m)) > 12, "card").otherwise("ip")
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `text` pseudonymised and two columns more: n_private (values replaced) and private_kinds (kinds replaced, distinct and sorted, comma-joined).

    Other columns and all rows stay; columns of those two names are replaced. A null text stays null and an empty one empty, with
    n_private 0. Values that fail their check (check digit, calendar, ranges) stay as they are. Equal values get equal pseudonyms
    under the same key, in whatever document.
    """
    make = {"email": _email, "phone": _phone, "secret": _secret, "card": _card, "date": _date, "ssn": _ssn, "ip": _ip}
    column = F.col(text)

    def new(m: Column) -> Column:
        def of(kind: Column) -> Column:
            out = None
            for name, f in make.items():
                out = F.when(kind == name, f(m, key)) if out is None else out.when(kind == name, f(m, key))
            return F.struct(kind.alias("kind"), m.alias("old"), out.alias("new"))

        return _let(_kind(m), of)

    found = F.transform(F.regexp_extract_all(column, F.lit(ANY), F.lit(0)), new)
    between = F.split(column, ANY, -1)
    work = docs.drop("n_private", "private_kinds", "__found", "__between")
    columns = [c for c in work.columns]
    # most texts hold none of the signs that every pattern needs
    likely = column.rlike(r"[0-9]{3}|@|[0-9]\.[0-9]|\+[0-9]|[0-9A-Fa-f]{40}")
    work = work.withColumn("__found", F.when(likely, found)).withColumn("__between", F.when(F.size("__found") > 0, between))
    joined = F.concat_ws("", F.flatten(F.zip_with("__between", F.col("__found.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
    changed = F.filter("__found", lambda x: x["old"] != x["new"])
    return work.select(
        *(F.when(F.col("__between").isNotNull(), joined).otherwise(column).alias(c) if c == text else F.col(f"`{c}`") for c in columns),
        F.when(F.size("__found") > 0, F.size(changed)).otherwise(0).cast("long").alias("n_private"),
        F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.transform(changed, lambda x: x["kind"]))), ","), F.lit("")).alias("private_kinds"),
    )
