"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats that are looked for, the first that fits at a place wins. Fixed patterns.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}",
    "secret": r"(?i:password|passwd|secret|token|api_?key)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{8,}|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9]|[/.-][0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
KINDS = tuple(PATTERNS)
#: Phone numbers by their marks alone (+1, parentheses, separators), whatever the area code and exchange.
MARKED_PHONE = r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
DAY_MODULI = (17, 4297)


def _digest(key: str, kind: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string")).cast("binary"), 256)


def permuted_number(left: Column, right: Column, moduli: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (left, right) below the moduli: alternating Feistel rounds; a struct (l, r)."""

    def turn(acc: Column, r: Column) -> Column:
        shift = F.conv(F.substring(_digest(key, kind, r, acc["r"]), 1, 12), 16, 10).cast("long")
        return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + shift, F.when(r % 2 == 0, F.lit(moduli[0])).otherwise(F.lit(moduli[1]))).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _shifted(c: Column, by: Column) -> Column:
    """A digit, small or capital letter moved within its class; anything else as it is."""
    code = F.ascii(c)
    out = c
    for first, size in ((48, 10), (65, 26), (97, 26)):
        out = F.when(code.between(first, first + size - 1), F.chr((F.lit(first) + F.pmod(code - first + by, F.lit(size))).cast("long"))).otherwise(out)
    return out


def permuted_string(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the same character classes at the same places.

    Feistel rounds over the halves: each character of one half moves within its
    class by a byte of a digest of the other half.
    """
    half = F.floor(F.char_length(s) / 2).cast("int")

    def turn(acc: Column, r: Column) -> Column:
        digest = F.array(_digest(key, kind, r, acc["r"]))  # bound once, not worked out again for each character
        moved = F.transform(digest, lambda d: F.array_join(F.transform(F.split(acc["l"], ""), lambda c, i: _shifted(c, F.conv(F.substr(d, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int"))), ""))
        return F.struct(acc["r"].alias("l"), moved[0].alias("r"))

    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.char_length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _poured(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    at = F.sequence(F.lit(1), F.char_length(form))
    return F.array_join(F.transform(at, lambda i: F.when(F.substr(form, i, F.lit(1)).rlike("[0-9]"), F.substr(digits, F.char_length(_digits(F.substr(form, F.lit(1), i))), F.lit(1))).otherwise(F.substr(form, i, F.lit(1)))), "")


def luhn_sum(digits: Column) -> Column:
    def weighed(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_string(F.substr(d, F.lit(2), F.char_length(d) - 2), key, "card"))
    return F.transform(F.array(body), lambda b: _poured(m, F.concat(b, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))))[0]


def _number(s: Column, at: int, n: int) -> Column:
    return F.substring(s, at, n).try_cast("long")


def _phone(m: Column, key: str) -> Column:
    """Area code and exchange from 200, line of four digits: 80,000 * 80,000 numbers; all others: 60,000 * 60,000."""
    all_digits = _digits(m)
    d = F.substr(all_digits, F.char_length(all_digits) - 9, F.lit(10))
    area, exchange, line = _number(d, 1, 3), _number(d, 4, 3), _number(d, 7, 4)
    three = lambda x: F.lpad(x.cast("string"), 3, "0")

    def put(area: Column, exchange: Column, v: Column) -> Column:
        ten = F.concat(three(area), three(exchange), F.lpad((v % 10_000).cast("string"), 4, "0"))
        return _poured(m, F.concat(F.substr(all_digits, F.lit(1), F.char_length(all_digits) - 10), ten))

    def written(p: Column) -> Column:
        v = p["l"] * 80_000 + p["r"]
        return put(F.floor(v / 8_000_000) + 200, F.floor(v % 8_000_000 / 10_000) + 200, v)

    def other_written(p: Column) -> Column:
        v = p["l"] * 60_000 + p["r"]
        at = F.floor(v / 10_000)
        low = at < 200_000
        return put(F.when(low, F.floor(at / 1000)).otherwise(F.floor((at - 200_000) / 200) + 200), F.when(low, at % 1000).otherwise(at % 200), v)

    n = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line
    other = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange) * 10_000 + line
    pair = permuted_number(F.floor(n / 80_000), n % 80_000, (80_000, 80_000), key, "phone")
    other_pair = permuted_number(F.floor(other / 60_000), other % 60_000, (60_000, 60_000), key, "phone-other")
    valid = (area >= 200) & (exchange >= 200)
    return F.when(valid, F.transform(F.array(pair), written)[0]).otherwise(F.transform(F.array(other_pair), other_written)[0])


def _ssn(m: Column, key: str) -> Column:
    """898 areas (not 0, 666, 900 and above) by 99 groups by 9999 serials."""
    area = _number(m, 1, 3)
    left = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + _number(m, 5, 2) - 1
    pair = permuted_number(left, _number(m, 8, 4) - 1, (898 * 99, 9999), key, "ssn")

    def written(p: Column) -> Column:
        a = F.floor(p["l"] / 99) + 1
        return F.concat_ws("-", F.lpad(F.when(a > 665, a + 1).otherwise(a).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.transform(F.array(pair), written)[0]


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    pair = permuted_number(o[0] * 256 + o[1], o[2] * 256 + o[3], (65_536, 65_536), key, "ip")
    return F.transform(F.array(pair), lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))[0]


#: How each written form of a date is read: year first, month first, or day first with dots.
DATE_FORMS = {"-": "yyyy-MM-dd", "/": "MM/dd/yyyy", ".": "dd.MM.yyyy"}


def _day(m: Column) -> Column:
    """The date that ``m`` writes, null if there is none."""
    iso = F.when(F.substring(m, 5, 1) == "-", m).when(F.substring(m, 3, 1) == "/", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return iso.try_cast("date")


def _date(m: Column, key: str) -> Column:
    first = F.lit("1900-01-01").cast("date")
    n = F.datediff(_day(m), first)
    pair = permuted_number(F.floor(n / DAY_MODULI[1]), n % DAY_MODULI[1], DAY_MODULI, key, "date")
    day = F.transform(F.array(pair), lambda p: F.date_add(first, (p["l"] * DAY_MODULI[1] + p["r"]).cast("int")))[0]
    return F.transform(F.array(day), lambda d: F.when(F.substring(m, 5, 1) == "-", F.date_format(d, DATE_FORMS["-"])).when(F.substring(m, 3, 1) == "/", F.date_format(d, DATE_FORMS["/"])).otherwise(F.date_format(d, DATE_FORMS["."])))[0]


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted_string(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(AKIA|.*[=:][ ]?[\"']?)", 1)
    return F.concat(name, permuted_string(F.substr(m, F.char_length(name) + 1, F.char_length(m)), key, "secret"))


def kind_of(m: Column, patterns: dict[str, str]) -> Column:
    """Kind of a match, null where it fails its kind's validation."""
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in patterns.items()}
    luhn = F.pmod(luhn_sum(_digits(m)), F.lit(10)) == 0
    ssn = ~_number(m, 1, 3).isin(0, 666) & (_number(m, 1, 3) < 900) & (_number(m, 5, 2) > 0) & (_number(m, 8, 4) > 0)
    return (
        F.when(whole["email"], F.lit("email")).when(whole["secret"], F.lit("secret")).when(whole["phone"], F.lit("phone"))
        .when(whole["ssn"], F.when(ssn, F.lit("ssn"))).when(whole["date"], F.when(_day(m).isNotNull(), F.lit("date")))
        .when(whole["ip"], F.lit("ip")).when(whole["card"], F.when(luhn, F.lit("card")))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    makers = {"email": _email, "secret": _secret, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card}
    out = m
    for name, make in makers.items():
        out = F.when(kind == name, make(m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, any_area: bool = False) -> DataFrame:
    """``docs`` as (doc, text, found): each row whole, its text with pseudonyms, and the number of each kind replaced.

    Card numbers (Luhn), North American phone and social security numbers,
    IPv4 addresses and calendar dates of 1900-2099 are validated and permuted
    among the valid values of their format; local parts of e-mail addresses and
    values of named secrets are permuted within the classes of their
    characters. The permutation depends on ``key`` and the kind alone: equal
    values get equal pseudonyms in all documents, unlike values unlike ones
    (a card number keeps its first digit and a valid check digit; separators
    stay and play no part). With ``any_area`` a phone number is what +1,
    parentheses or separators mark as one: area codes and exchanges below 200,
    which are not assigned, are permuted among themselves. All in Spark
    expressions, row by row: nothing is shuffled.

    Defined results: a null text stays null, an empty one empty; matches that
    fail validation stay; of an address with more domain labels than the 128
    that DNS allows the first 128 count as the domain; texts without digits and @ are not touched; repeated
    rows are treated alike; an empty table gives no rows; further columns stay
    inside ``doc`` whatever their names.
    """
    patterns = {**PATTERNS, "phone": MARKED_PHONE} if any_area else PATTERNS
    any_ = "|".join(f"(?:{p})" for p in patterns.values())
    text = F.col("text").cast("string")
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"))
    none = F.array().cast("array<string>")
    step = step.select("doc", "text", F.when(F.col("text").rlike("[0-9@=:]|AKIA"), F.regexp_extract_all("text", F.lit(any_), 0)).otherwise(none).alias("matches"))
    step = step.select("doc", "text", F.transform("matches", lambda m: F.struct(m.alias("m"), kind_of(m, patterns).alias("kind"))).alias("matches"))
    step = step.select("doc", "text", F.transform("matches", lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("to"))).alias("matches"))
    parts = F.split("text", any_, -1)
    woven = F.transform(F.array(parts), lambda p: F.concat(p[0], F.array_join(F.transform(F.col("matches"), lambda x, i: F.concat(x["to"], p[i + 1])), "")))[0]
    count = lambda k: F.size(F.filter("matches", lambda x: x["kind"] == k)).cast("long")
    found = F.struct(*[count(k).alias(k) for k in KINDS])
    return step.select("doc", F.when(F.exists("matches", lambda x: x["kind"].isNotNull()), woven).otherwise(F.col("text")).alias("text"), found.alias("found"))


def pseudonymised_documents(docs: DataFrame, key: str, any_area: bool = False) -> DataFrame:
    """``docs`` with the texts of ``pseudonymised`` and its own other columns."""
    out = pseudonymised(docs, key, any_area)
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
