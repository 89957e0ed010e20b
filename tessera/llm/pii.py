"""Personal numbers, dates, addresses and secrets under format-preserving Feistel pseudonyms.

One pattern finds all candidates; each is validated (Luhn and mod-97 checks, octets, calendar, digit
counts) and then permuted by a keyed Feistel network within its own format: a card stays a valid card, a date a
date. The permutation sees only the value, without separators, so equal values have equal pseudonyms in all
documents and different values of one format have different ones. It goes through the network, takes a step there and goes
back, so no value is its own pseudonym. The round function is SHA-256 of key, kind, round and
the other half. Everything is built from SQL functions; no row moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_columns, whole_row

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Dates from FIRST_DAY on are permuted within DAYS[0] * DAYS[1] days (to 2100-05-01); others stay.
FIRST_DAY, DAYS = "1900-01-01", (271, 270)
#: Valid areas (001 to 899 but 666) and, in each, groups 01 to 99 times serials 0001 to 9999 of social-security numbers.
SSN = (898, 99 * 9999)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Groups repeat a bounded number of times or possessively: others recurse once for each repeat and end the stack on long texts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[0-9a-f]{16,64}+(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!\d|[./-]\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+(-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"\1", r"\k<s>").replace(r"\2", r"\k<t>").replace("([-/.])", "(?<s>[-/.])", 1)
ANY = ANY.replace("([-/.])", "(?<t>[-/.])", 1)
#: What every candidate holds; other texts are left alone at once.
MAYBE = r"[0-9@]|AKIA|(?:password|passwd|secret|token|api_key)\s?[=:]"


def _random(key: str, *parts) -> Column:
    """60 bits from SHA-256 of the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *[x if isinstance(x, Column) else F.lit(str(x)) for x in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permuted(value: Column, alphabets: list[str], key: str, kind: str, at: Callable[[Column], Column] | None = None, narrow: list[str] | None = None) -> Column:
    """value with every symbol of an alphabet moved within it; other symbols stay. Places that `at` picks have the alphabets `narrow`.

    A Feistel network whose halves are the even and the odd places: in each round the symbols of one half
    are shifted by numbers that depend on their place and the whole other half. After ROUNDS rounds each symbol takes a step
    in its alphabet; then the rounds are undone. So every value with a symbol of an alphabet changes.
    """

    def within(c: Column, own: list[str], by: Callable[[int], Column]) -> Column:
        out = c
        for a in own:
            place = F.instr(F.lit(a), c).cast("long")
            out = F.when(place > 0, F.substr(F.lit(a), (F.pmod(place - 1 + by(len(a)), F.lit(len(a))) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    def shift(c: Column, i: Column, by: Callable[[int], Column]) -> Column:
        return within(c, alphabets, by) if at is None else F.when(at(i), within(c, narrow, by)).otherwise(within(c, alphabets, by))

    def round_(chars: Column, t: Column) -> Column:
        r = F.when(t < ROUNDS, t).otherwise(2 * ROUNDS - t)
        sign = F.when(t < ROUNDS, F.lit(1)).otherwise(F.lit(-1)).cast("long")
        other = F.array_join(F.filter(chars, lambda _, i: i % 2 != r % 2), "")
        turn = lambda i: sign * (_random(key, kind, r.cast("string"), i.cast("string"), other) % 1_000_000_007)
        rounds = F.transform(chars, lambda c, i: F.when(i % 2 == r % 2, shift(c, i, lambda n: turn(i))).otherwise(c))
        step = F.transform(chars, lambda c, i: shift(c, i, lambda n: 1 + _random(key, kind, "step") % (n - 1)))
        return F.when(t == ROUNDS, step).otherwise(rounds)

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), chars, round_), "")


def moved(n: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Another number of 0 .. sizes[0] * sizes[1] - 1, by the same way with the two digits of n as halves."""

    def size(r: Column) -> Column:
        return F.when(r % 2 == 0, F.lit(sizes[0])).otherwise(F.lit(sizes[1])).cast("long")

    def turn(r: Column, half: Column) -> Column:
        return _random(key, kind, r.cast("string"), half.cast("string")) % 1_000_000_007

    def round_(s: Column, t: Column) -> Column:
        r, a, b = F.when(t < ROUNDS, t).otherwise(2 * ROUNDS - t), s["a"], s["b"]
        of = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
        step = of(a, F.pmod(b + 1 + _random(key, kind, "step") % (sizes[1] - 1), F.lit(sizes[1]).cast("long")))
        return F.when(t < ROUNDS, of(b, F.pmod(a + turn(r, b), size(r)))).when(t == ROUNDS, step).otherwise(of(F.pmod(b - turn(r, a), size(r)), a))

    start = F.struct(F.floor(n / sizes[1]).cast("long").alias("a"), F.pmod(n, F.lit(sizes[1]).cast("long")).alias("b"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), start, round_)
    return out["a"] * sizes[1] + out["b"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def filled(form: Column, digits: Column, wanted: str = DIGITS) -> Column:
    """form with its symbols of `wanted` replaced by those of `digits`, in order."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("i"))

    def step(s: Column, c: Column) -> Column:
        new = F.struct(F.concat(s["t"], F.substr(digits, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))
        return F.when((c != "") & F.contains(F.lit(wanted), c), new).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i")))

    return F.aggregate(F.split(form, ""), start, step)["t"]


def luhn_sum(digits: Column, odd_places: int) -> Column:
    """Sum of digits from the right; those in places i with i % 2 == odd_places (from 0) count twice, less 9 if over 9."""
    places = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == odd_places, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """A number written with digits and letters (A = 10 .. Z = 35) modulo 97."""
    def step(s: Column, c: Column) -> Column:
        n = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(c == "", s).otherwise(F.pmod(s * F.when(n > 9, 100).otherwise(10) + n, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def pseudonym_card(m: Column, key: str) -> Column:
    """First digit stays, the rest is permuted, the check digit follows; null unless Luhn holds."""
    d = _digits(m)
    body = F.concat(F.substring(d, 1, 1), permuted(F.substr(d, F.lit(2), F.length(d) - 2), [DIGITS], key, "card"))
    check = F.pmod(10 - luhn_sum(body, 0) % 10, F.lit(10)).cast("string")
    valid = F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0) & ~d.rlike("^(.)\\1*$")
    return F.when(valid, filled(m, F.concat(body, check)))


def pseudonym_iban(m: Column, key: str) -> Column:
    """Country stays, the account is permuted, the check digits follow; null unless the check holds."""
    d = F.replace(m, F.lit(" "), F.lit(""))
    body = permuted(F.substr(d, F.lit(5), F.length(d)), [DIGITS, UPPER], key, "iban")
    country = F.substring(d, 1, 2)
    check = F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    valid = F.length(d).between(15, 34) & (mod97(F.concat(F.substr(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1)
    return F.when(valid, filled(m, F.concat(country, check, body), DIGITS + UPPER))


def pseudonym_ip(m: Column, key: str) -> Column:
    """The address as two halves of 16 bits."""
    n = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    n = moved(n, (65536, 65536), key, "ip")
    return F.array_join(F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda by: F.pmod(F.floor(n / F.pow(F.lit(2.0), by)), F.lit(256).cast("long"))), ".")


def pseudonym_date(m: Column, key: str) -> Column:
    """The day's number as two mixed digits; order of the fields, separators and padding stay. Day before month if both can be."""
    f = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    x, y, z = (F.get(f, F.lit(i)) for i in range(3))
    iso = m.rlike(r"^\d{4}")
    ymd = F.try_to_date(F.format_string("%04d-%02d-%02d", x, y, z), "yyyy-MM-dd")
    dmy = F.try_to_date(F.format_string("%04d-%02d-%02d", z, y, x), "yyyy-MM-dd")
    mdy = F.try_to_date(F.format_string("%04d-%02d-%02d", z, x, y), "yyyy-MM-dd")
    day = F.when(iso, ymd).otherwise(F.coalesce(dmy, mdy))
    n = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), moved(n, DAYS, key, "date").cast("int"))
    order = F.when(iso, F.array(F.lit("yyyy"), F.lit("MM"), F.lit("dd"))).when(dmy.isNotNull(), F.array(F.lit("dd"), F.lit("MM"), F.lit("yyyy"))).otherwise(F.array(F.lit("MM"), F.lit("dd"), F.lit("yyyy")))
    parts = {"yyyy": F.date_format(new, "yyyy"), "MM": F.date_format(new, "MM"), "dd": F.date_format(new, "dd")}
    separator = F.regexp_extract(m, "[-/.]", 0)
    text = F.array_join(F.transform(order, lambda k: F.when(k == "yyyy", parts["yyyy"]).when(k == "MM", parts["MM"]).otherwise(parts["dd"])), "|")
    return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), F.replace(text, F.lit("|"), separator))


def pseudonym_phone(m: Column, key: str) -> Column:
    """+ and country code (to the first separator, 1 digit without one) stay; 7 to 15 digits in all. A number's first digit
    stays zero or not; North American area and exchange codes stay within 200 to 999."""
    head = F.regexp_extract(m, r"^\+(\d{1,3})(?=[ .(-])", 1)
    head = F.when(head != "", head).when(m.startswith("+"), F.substring(m, 2, 1)).otherwise(F.lit(""))
    d = _digits(m)
    rest = F.substr(d, F.length(head) + 1, F.length(d))
    american = head.isin("", "1") & (F.length(rest) == 10)
    new = F.when(american, permuted(rest, [DIGITS], key, "phone", lambda i: i.isin(0, 3), [DIGITS[2:], DIGITS[:2]]))
    new = new.otherwise(permuted(rest, [DIGITS], key, "phone", lambda i: i == 0, [DIGITS[1:]]))
    return F.when(F.length(d).between(7, 15), filled(m, F.concat(head, new)))


def pseudonym_ssn(m: Column, key: str) -> Column:
    """Areas 000, 666 and 900 on, group 00 and serial 0000 are never given out: not valid, and never a pseudonym."""
    valid = ~m.rlike("^(?:000|666|9..)|-00-|-0000$")
    area, group, serial = (F.substring(m, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    n = (area - 1 - F.when(area > 666, 1).otherwise(0)) * SSN[1] + (group - 1) * 9999 + serial - 1
    n = moved(n, SSN, key, "ssn")
    area, rest = F.floor(n / SSN[1]), F.pmod(n, F.lit(SSN[1]).cast("long"))
    new = F.format_string("%03d-%02d-%04d", area + 1 + F.when(area >= 665, 1).otherwise(0), F.floor(rest / 9999) + 1, F.pmod(rest, F.lit(9999).cast("long")) + 1)
    return F.when(valid, new)


def pseudonym_email(m: Column, key: str) -> Column:
    """The part before @ keeps its length and kinds of symbols; the domain stays."""
    at = F.instr(m, "@")
    return F.concat(permuted(F.substr(m, F.lit(1), at - 1), [DIGITS, LOWER, UPPER], key, "email"), F.substr(m, at, F.length(m)))


def pseudonym_secret(m: Column, key: str) -> Column:
    """AKIA or what stands before the hexadecimal digits stays."""
    aws = F.concat(F.lit("AKIA"), permuted(F.substr(m, F.lit(5), F.lit(16)), [DIGITS, UPPER], key, "aws"))
    value = F.regexp_extract(m, "[0-9a-f]{16,64}$", 0)
    other = F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), permuted(value, [HEX], key, "hex"))
    return F.when(m.startswith("AKIA"), aws).otherwise(other)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a candidate, or null if it isn't valid."""
    digits_only = r"^\d[\d -]*$"
    return (
        F.when(F.contains(m, F.lit("@")), pseudonym_email(m, key))
        .when(m.rlike(r"^(?:AKIA|password|passwd|secret|token|api_key)"), pseudonym_secret(m, key))
        .when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), pseudonym_ip(m, key))
        .when(m.rlike(r"^(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})$"), pseudonym_date(m, key))
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), pseudonym_iban(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), pseudonym_ssn(m, key))
        .when(m.rlike(r"^[+(]|^[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}$"), pseudonym_phone(m, key))
        .when(m.rlike(digits_only), pseudonym_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal values and secrets in `text` replaced, and n_found (long), how many were.

    Candidates that fail validation stay, so do all other characters. A null text stays null with n_found 0. Only the value and
    the key decide, so equal texts have equal results; an own column named n_found is replaced.
    """
    text = F.col("text")
    has = F.coalesce(text.rlike(MAYBE), F.lit(False))
    found = F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.select(whole_row(docs), text.alias("text_"), found.alias("found_"))
    out = out.withColumn("new_", F.transform("found_", lambda m: F.coalesce(pseudonym(m, key), m)))
    joined = F.array_join(F.zip_with(F.split("text_", ANY), "new_", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found_", "new_", lambda a, b: a != b), lambda x: x))
    out = out.select("row_", F.when(F.size("found_") > 0, joined).otherwise(F.col("text_")).alias("text_"), changed.cast("long").alias("n_found"))
    own = dict(zip(docs.columns, row_columns(docs))) | {"text": F.col("text_").alias("text")}
    own.pop("n_found", None)
    return out.select(*own.values(), "n_found")
