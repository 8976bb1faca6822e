"""Personal data replaced by format-preserving Feistel pseudonyms.

Validated numbers and dates are permuted by a keyed Feistel network within their own
format: a payment card stays one with a right check digit, a date stays a date, an
address stays an address, separators stay where they are.  The permutation depends
on the key and the kind only, so equal values have equal pseudonyms in all documents
and different ones differ.  What has no such format (mail addresses, secrets) becomes
a keyed tag.  All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: What is looked for; what begins first and then stands first here is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})"
    r"|(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s*[=:]\s*(?:\"[^\"\n]{6,}\"|'[^'\n]{6,}'|(?=[^\s\"',;]*[\d!#$%^&*_+/=~-])[^\s\"',;]{6,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:]|\.\d)",
    "ip": r"(?<![\d.])(?<!(?i:version|release|ver|v)[ .]{0,2})(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])[2-9]\d\d([-. ])[2-9]\d\d\1\d{4}(?![\d-]|\.\d)|(?<![\d.-])0\d{2,4} \d{3,4} \d{3,4}(?![\d-]|\.\d)",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)",
}
KINDS = tuple(PATTERNS)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often then uses it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def hmac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of parts joined by |, in hex."""
    raw = key.encode()
    block = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.concat_ws("|", *parts).cast("binary")), 256))), 256)


def draw(key: str, kind: str, r: Column, x: Column) -> Column:
    """The round function: 52 bits of a keyed digest."""
    return F.conv(F.substring(hmac(key, F.lit(kind), r.cast("string"), x.cast("string")), 1, 13), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, a_size: Column, b_size: Column) -> Column:
    """A keyed permutation of the pairs (a, b) with a < a_size and b < b_size, as a struct."""
    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    left = lambda s, r: F.struct(((s["a"] + draw(key, kind, r, s["b"])) % a_size.cast("long")).alias("a"), s["b"].alias("b"))
    right = lambda s, r: F.struct(s["a"].alias("a"), ((s["b"] + draw(key, kind, r, s["a"])) % b_size.cast("long")).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, lambda s, r: F.when(r % 2 == 1, left(s, r)).otherwise(right(s, r)))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of the same length (30 digits at most); one digit or none stays."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    power = lambda k: F.element_at(F.array(*(F.lit(10**i) for i in range(1, 16))), k)
    a, b = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n)
    moved = let(feistel(key, kind, a, b, power(half), power(n - half)), lambda out: F.concat(F.lpad(out["a"].cast("string"), half, F.lit("0")), F.lpad(out["b"].cast("string"), n - half, F.lit("0"))))
    return F.when(n < 2, digits).otherwise(moved)


def with_digits(m: Column, digits: Column) -> Column:
    """m with its digits, from the first on, replaced by others; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    put = lambda d: lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(d, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return let(digits, lambda d: F.aggregate(F.split(m, ""), start, put(d))["out"])


def luhn(digits: Column) -> Column:
    """The check sum of a digit string; 0 is valid."""

    def worth(digits: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return let(digits, lambda ds: F.aggregate(F.sequence(F.lit(1), F.length(ds)), F.lit(0), lambda s, i: s + worth(ds, i)) % 10)


def new_card(key: str, m: Column) -> Column:
    """The first digit (its network) stays, the account is permuted, the check digit follows."""
    body = let(digits_of(m), lambda d: F.concat(F.substring(d, 1, 1), permute_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2))))
    whole = let(body, lambda b: F.concat(b, ((10 - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
    return with_digits(m, whole)


#: The country calling codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def new_phone(key: str, m: Column) -> Column:
    """The country code (or a leading 0) stays, the rest is permuted; a ten-digit number without either keeps its first digits from 2 to 9."""
    code = F.when(m.startswith("+"), F.regexp_extract(m, COUNTRY, 0)).when(m.startswith("0"), "0").otherwise("")
    rest = lambda c: F.substring(m, F.length(c) + 1, F.length(m))
    part = lambda d, i, n: F.substring(d, i, n).cast("long")
    local = let(digits_of(m), lambda d: let(feistel(key, "local", part(d, 1, 3) - 200, (part(d, 4, 3) - 200) * 10000 + part(d, 7, 4), F.lit(800), F.lit(8000000)), lambda out: with_digits(m, F.format_string("%03d%03d%04d", out["a"] + 200, F.floor(out["b"] / 10000) + 200, out["b"] % 10000))))
    moved = let(code, lambda c: F.concat(c, let(rest(c), lambda x: with_digits(x, permute_digits(key, "phone", digits_of(x))))))
    return F.when(digits_of(m).rlike(r"^[2-9]\d\d[2-9]\d{6}$") & ~m.startswith("+"), local).otherwise(moved)


def iban_rest(s: Column) -> Column:
    """What an IBAN without blanks leaves modulo 97, its first four characters standing last; 1 is valid."""
    worth = lambda c: F.when(c.between("0", "9"), c.cast("long")).otherwise(F.ascii(c).cast("long") - 55)
    add = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + worth(c)) % 97).otherwise((acc * 100 + worth(c)) % 97)
    return F.aggregate(F.split(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)), ""), F.lit(0).cast("long"), add)


def new_iban(key: str, m: Column) -> Column:
    """Country and letters stay, digits are permuted, the check digits follow."""
    packed = F.replace(m, F.lit(" "), F.lit(""))
    body = lambda s: F.substring(s, F.lit(5), F.length(s))
    check = lambda s, b: F.lpad((98 - iban_rest(F.concat(F.substring(s, 1, 2), F.lit("00"), b))).cast("string"), 2, "0")
    digits = let(packed, lambda s: let(with_digits(body(s), permute_digits(key, "iban", digits_of(body(s)))), lambda b: F.concat(check(s, b), digits_of(b))))
    return with_digits(m, digits)


def new_ipv6(key: str, m: Column) -> Column:
    """Groups keep their lengths; their hexadecimal digits are permuted, those of the same places in two halves."""
    hexes = F.lower(F.regexp_replace(m, "[^0-9A-Fa-f]", ""))

    def moved(h: Column) -> Column:
        n = F.length(h)
        half = F.greatest((n / 2).cast("int"), n - 15)
        power = lambda k: F.element_at(F.array(*(F.lit(16**i) for i in range(1, 16))), k)
        value = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")
        tail = n - half
        top = F.least(half, F.lit(15))  # up to 30 digits move; the first two of 32 stay
        keep = half - top
        a, b = F.substring(h, keep + 1, top), F.substring(h, half + 1, tail)
        shown = lambda x, k: F.lpad(F.lower(F.hex(x)), k, F.lit("0"))
        out = feistel(key, "ipv6", value(a), value(b), power(top), power(tail))
        return let(out, lambda o: F.concat(F.substring(h, F.lit(1), keep), shown(o["a"], top), shown(o["b"], tail)))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    put = lambda d: lambda s, c: F.when(c == ":", F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))).otherwise(F.struct(F.concat(s["out"], F.substring(d, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k")))
    return let(let(hexes, moved), lambda d: F.aggregate(F.split(m, ""), start, put(d))["out"])


def new_ip(key: str, m: Column) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("int")
    halves = feistel(key, "ip", part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536))
    return let(halves, lambda out: F.concat_ws(".", *(x.cast("string") for h in ("a", "b") for x in (F.floor(out[h] / 256), out[h] % 256))))


#: Days from 1900-01-01 that a date may be, as a product: 280 * 261 = 73080 reach to 2100-01-31.
DAYS = (280, 261)


def as_date(m: Column) -> Column:
    """The date that a match writes, or null."""
    found = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd.MM.yyyy"), F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy"))
    day = F.datediff(found, F.lit("1900-01-01").cast("date"))
    return F.when(day.between(0, DAYS[0] * DAYS[1] - 1), day)


def new_date(key: str, m: Column) -> Column:
    """A day of the same format.  Slashes are read as day/month; what only fits as month/day moves on until its day is past 12, so no two dates look alike."""
    start = F.lit("1900-01-01").cast("date")
    step = lambda day: let(feistel(key, "date", (day / DAYS[1]).cast("long"), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1])), lambda out: (out["a"] * DAYS[1] + out["b"]).cast("int"))
    american = m.contains("/") & F.try_to_date(m, "dd/MM/yyyy").isNull()
    past = lambda day: F.dayofmonth(F.date_add(start, day)) > 12
    moved = let(as_date(m), lambda day: step(day))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(60)), moved, lambda day, _: F.when(past(day), day).otherwise(step(day)))
    date = F.date_add(start, F.when(american, walked).otherwise(moved))
    show = lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("."), F.date_format(d, "dd.MM.yyyy")).when(american, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    return let(date, show)


def new_ssn(key: str, m: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda i: F.element_at(F.split(m, "-"), i).cast("int")
    area = part(1) - 1 - F.when(part(1) > 666, 1).otherwise(0)
    moved = feistel(key, "ssn", area, (part(2) - 1) * 9999 + part(3) - 1, F.lit(898), F.lit(99 * 9999))
    back = lambda a: a + 1 + F.when(a >= 665, 1).otherwise(0)
    return let(moved, lambda out: F.format_string("%03d-%02d-%04d", back(out["a"]), F.floor(out["b"] / 9999) + 1, out["b"] % 9999 + 1))


def tag(key: str, kind: str, m: Column) -> Column:
    return F.concat(F.lit(f"<{kind.upper()}_"), F.substring(hmac(key, F.lit(kind), m), 1, 12), F.lit(">"))


def valid_kind(m: Column) -> Column:
    """The kind of a match, or null if it is none after all (a wrong check digit, a date that is none, too few groups)."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    ssn = whole("ssn") & ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    ipv6 = m.rlike(r"\d") & (groups >= 3) & ((groups == 8) | (m.contains("::") & (groups <= 7)))
    iban = iban_rest(F.replace(m, F.lit(" "), F.lit(""))) == 1
    found = F.when(whole("email"), "email").when(whole("secret"), "secret").when(whole("iban"), F.when(iban, "iban")).when(whole("ipv6"), F.when(ipv6, "ipv6"))
    return found.when(whole("ip"), "ip").when(whole("date"), F.when(as_date(m).isNotNull(), "date")).when(whole("ssn"), F.when(ssn, "ssn")).when(whole("phone"), "phone").when(m.rlike(r"^\d[\d -]*$") & (luhn(digits_of(m)) == 0), "card")


def secret_name(m: Column) -> Column:
    """What stands before a secret's value (password=), which stays."""
    return F.regexp_extract(m, r"^([A-Za-z_-]+\s*[=:]\s*)", 1)


def replaced(key: str, m: Column, kind: Column) -> Column:
    name = F.when(m.startswith("-----"), "").otherwise(secret_name(m))
    secret = let(name, lambda n: F.concat(n, tag(key, "secret", F.regexp_replace(F.substring(m, F.length(n) + 1, F.length(m)), "[\"']", ""))))
    out = F.when(kind == "email", tag(key, "email", F.lower(m))).when(kind == "secret", secret)
    for k, new in (("iban", new_iban), ("ipv6", new_ipv6), ("ip", new_ip), ("date", new_date), ("ssn", new_ssn), ("phone", new_phone), ("card", new_card)):
        out = out.when(kind == k, new(key, m))
    return out.otherwise(m)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores at their ends where docs has such columns."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text replaced and a last column pii, an array of (kind, place) of what was found, with place its order in the text.

    A null text stays null and has an empty array; a text without findings is unchanged
    byte for byte.  A number that only looks like one kind (a wrong check digit, no
    calendar day) is left alone.  All rows and columns are kept, repeated rows too; the
    added column is named pii_ where docs has a column pii.
    """
    pii, match, kind, new = free_names(docs, "pii", "pii_match", "pii_kind", "pii_new")
    pattern = "|".join(f"(?:{p})" for p in PATTERNS.values())
    text = F.col(f"`{text_col}`").cast("string")
    maybe = F.coalesce(text.rlike("[0-9@]|(?i:password|passwd|pwd|secret|token|api.?key|access.?key|private key)"), F.lit(False))
    found = docs.withColumn(match, F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn(kind, F.transform(match, valid_kind))
    found = found.withColumn(new, F.transform(match, lambda m, i: replaced(key, m, F.get(kind, i))))
    gaps = F.split(text, pattern, -1)
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit("")))), "")
    listed = F.filter(F.transform(kind, lambda k, i: F.struct(k.alias("kind"), i.alias("place"))), lambda x: x["kind"].isNotNull())
    return found.withColumn(text_col, F.when(F.exists(kind, lambda k: k.isNotNull()), joined).otherwise(text)).withColumn(pii, listed).drop(match, kind, new)
