"""Pseudonyms against a second version in plain Python, on random texts of all kinds of values."""

import datetime
import hashlib
import random
import re

from trussline.llm import pii

KEY = "another key"


def digest(*parts):
    return hashlib.sha256("|".join([KEY, *map(str, parts)]).encode()).hexdigest()


def permute(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(1, pii.ROUNDS + 1):
        left = (left + int(digest(kind, "l", i, right)[:15], 16)) % a
        right = (right + int(digest(kind, "r", i, left)[:15], 16)) % b
    return left * b + right


def permute_digits(d, kind, usual):
    half = len(d) // 2
    new = permute(int(d), 10**half, 10 ** (len(d) - half), kind if len(d) == usual else f"{kind}{len(d)}")
    return str(new).zfill(len(d))


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def refilled(m, digits):
    new = iter(digits)
    return re.sub("[0-9]", lambda _: next(new), m)


def replaced(m):
    """kind and pseudonym of one match."""
    d = re.sub("[^0-9]", "", m)
    whole = {k: re.fullmatch(p, m) for k, p in pii.PATTERNS.items()}
    if "@" in m:
        return "email", "u" + digest("email", m.lower())[:14] + "@" + m.rpartition("@")[2]
    if len(m) == 40:
        new = digest("secret", m.lower())[:40]
        return "secret", new.upper() if m == m.upper() else new
    if whole["phone"]:
        kept = 2 if m[0] == "+" and m[1] != "1" else len(d) - 10
        return "phone", refilled(m, d[:kept] + permute_digits(d[kept:], "phone", 10))
    if whole["date"]:
        iso = m[4] == "-"
        try:
            day = datetime.date.fromisoformat(m if iso else f"{m[6:]}-{m[3:5]}-{m[:2]}")
        except ValueError:
            return "date", m
        n = (day - datetime.date(1800, 1, 1)).days
        if not 0 <= n < 189 * 773 or not iso and m[2] != m[5]:
            return "date", m
        new = datetime.date(1800, 1, 1) + datetime.timedelta(permute(n, 189, 773, "date"))
        return "date", new.isoformat() if iso else new.strftime(f"%d{m[2]}%m{m[2]}") + f"{new.year:04d}"
    if whole["ssn"]:
        area, group, serial = map(int, m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return "ssn", m
        areas = [x for x in range(1, 900) if x != 666]
        n = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return "ssn", f"{areas[n // (99 * 9999)]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if len(d) > 12:
        if luhn(d):
            return "card", m
        body = permute_digits(d[:-1], "card", 15)
        return "card", refilled(m, body + next(c for c in "0123456789" if not luhn(body + c)))
    parts = [int(x) for x in m.split(".")]
    n = permute(int.from_bytes(bytes(parts)), 1 << 16, 1 << 16, "ip")
    return "ip", ".".join(map(str, n.to_bytes(4)))


def value(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    kind = r.randrange(12)
    if kind < 2:
        body = d(r.randrange(12, 19))
        number = body + (next(c for c in "0123456789" if not luhn(body + c)) if r.random() < 0.7 else d(1))
        return f"{number[:4]} {number[4:8]} {number[8:12]} {number[12:]}" if len(number) == 16 and r.random() < 0.5 else number
    if kind < 4:
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+49 {d(3)} {d(7)}", f"+1{d(10)}"])
    if kind < 6:
        y, m, t = r.randrange(1750, 2260), r.randrange(0, 14), r.randrange(0, 33)
        return r.choice([f"{y:04d}-{m:02d}-{t:02d}", f"{t:02d}.{m:02d}.{y:04d}", f"{t:02d}/{m:02d}/{y:04d}", f"{t:02d}.{m:02d}/{y:04d}"])
    if kind < 8:
        return f"{r.choice([d(3), '000', '666', '899', '900'])}-{d(2)}-{d(4)}"
    if kind < 10:
        return ".".join(str(r.randrange(300 if r.random() < 0.2 else 256)) for _ in range(4))
    return r.choice([f"name.{d(2)}@mail.example.org", "É.x@a-b.fr", "".join(r.choice("0123456789abcdef") for _ in range(40)), "".join(r.choice("0123456789ABCDEF") for _ in range(40))])


def test_equals_a_second_version(spark):
    r = random.Random(12)
    texts = [" ".join(r.choice(["word", "no. 12", "v1.2.3", value(r), value(r)]) + r.choice(["", ",", ".", ")", "x", "7", "-"]) for _ in range(r.randrange(1, 25))) for _ in range(400)] + ["", None]
    got = {x.i: x for x in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), KEY).collect()}
    seen = set()
    for i, text in enumerate(texts):
        if text is None:
            assert got[i].text is None and got[i].n_private == 0
            continue
        kinds = []

        def one(m):
            kind, new = replaced(m[0])
            if new != m[0]:
                kinds.append(kind)
            return new

        assert got[i].text == re.sub(pii.ANY, one, text), text
        assert (got[i].n_private, got[i].private_kinds) == (len(kinds), ",".join(sorted(set(kinds))))
        seen |= set(kinds)
    assert seen == set(pii.PATTERNS)
