"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

Card numbers (Luhn), bank accounts (IBAN, modulo 97), social security numbers, telephone
numbers, IPv4 addresses and calendar dates are found, validated and then permuted within
their own format by a keyed Feistel network, so the same value gets the same pseudonym in
every document, different values get different ones, and a pseudonym is itself a valid
value of the format (check digits are computed anew). What fails validation stays as it is.
E-mail addresses have no such number; their local part becomes a keyed digest.

A Feistel network here works on a pair (l, r) with 0 <= l < ma, 0 <= r < mb: rounds add to
l or to r, by turns and modulo ma or mb, a keyed hash of the other. Each round can be
undone, so the whole is a permutation of the ma * mb pairs. Domains:

- n digits: ma = 10 ** ceil(n / 2), mb = 10 ** floor(n / 2);
- IPv4: 65536 * 65536;
- social security numbers: (898 areas * 99 groups) * 9999 serials;
- telephone numbers: the digits after the country code;
- dates: the days of the date's own century, 92 * 397 = 36524, or 75 * 487 = 36525 where
  the century starts with a leap year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import free_names, other_columns

ROUNDS = 8
#: Steps after which a walk to a day of the same kind, of which two in five steps end at least, is over.
WALK = 100
#: Characters of an account number by country, and digits after the country code where a country has one length.
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
PHONE_DIGITS = {8: "45|47|65|852", 9: "27|31|33|34|41|48|61|351|380|420", 10: "1|7|52|57|90|91"}
COUNTRY_CODE = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
_END = r"(?![\p{L}\p{N}])"
_IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)\d{4})(?![\p{L}\p{N}]|[./-]\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
_LOCAL = r"(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})"
_CARD = r"(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})"
#: A group of digits that goes on a number is not the beginning of another one.
_SAME = rf"(?!{_IPV4}|{_DATE}|{_SSN}|{_LOCAL}{_END}|{_CARD}{_END})"
_BREAK = r"(?: ?\(|\) ?|[ .-])"
_FIXED_IBAN = "|".join(rf"(?:{codes})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}{_END}" for n, codes in IBAN_CHARS.items())
#: The prefix 00 counts as +; where a country has numbers of several lengths, only with a break behind its code, as zeros also fill up other numbers.
_FIXED_PHONE = "|".join(rf"(?:\+|00 ?)(?:{codes})(?:{_BREAK}?\d){{{n}}}{_END}" for n, codes in PHONE_DIGITS.items())
_OTHER_PHONE = rf"\+\d(?:{_BREAK}?\d){{7}}(?:(?:{_BREAK}{_SAME})?\d){{0,7}}{_END}|00 ?(?=[1-9]\d{{0,2}}[ (.-])(?:{COUNTRY_CODE})(?:{_BREAK}?\d){{6}}(?:(?:{_BREAK}{_SAME})?\d){{0,8}}{_END}"
#: What the kinds may look like, in the order in which they are tried at a place. Shapes are as wide as validation allows:
#: an account number ends where its country says, a telephone number at the last group within 15 digits, a card at one of
#: the ends that _card tries.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:{_FIXED_IBAN}|[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}}| [A-Z0-9]{{4}}(?: \d{{4}}){{1,6}}(?: \d{{1,3}})?){_END})",
    "ipv4": rf"(?<![\p{{L}}\p{{N}}.]){_IPV4}",
    "date": rf"(?<![\p{{L}}\p{{N}}./-]){_DATE}",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:{_FIXED_PHONE}|(?:\+\d{{1,3}}[ .-]?)?\(\d{{2,4}}\) ?\d{{3,4}}[ .-]\d{{4}}{_END}|{_OTHER_PHONE}|{_LOCAL}{_END})",
    "ssn": rf"(?<![\p{{L}}\p{{N}}-]){_SSN}",
    "card": rf"(?<![\p{{L}}\p{{N}}])(?:\d{{4}}(?: \d{{4}}){{3}} {_SAME}\d{{1,3}}|\d{{4}}(?:-\d{{4}}){{3}}-{_SAME}\d{{1,3}}|{_CARD}|\d(?:(?:[ -]{_SAME})?\d){{12,18}}){_END}",
}


def _any(kinds) -> str:
    return "|".join(f"(?:{PATTERNS[k]})" for k in kinds)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _draw(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """A keyed 60-bit number."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(key: str, tweak: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """A struct (l, r): the permuted pair."""
    pair = lambda l, r: F.struct(l.cast("bigint").alias("l"), r.cast("bigint").alias("r"))  # noqa: E731, E741

    def step(s: Column, turn: Column) -> Column:
        on_left = pair((s["l"] + _draw(key, tweak, turn, s["r"])) % left_size, s["r"])
        on_right = pair(s["l"], (s["r"] + _draw(key, tweak, turn, s["l"])) % right_size)
        return F.when(turn % 2 == 0, on_left).otherwise(on_right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(left, right), step)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Another string of as many digits (at most 34)."""

    def body(d: Column) -> Column:
        n = F.length(d)
        head = F.ceil(n / F.lit(2)).cast("int")
        size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")
        tail = n - head
        tweak = F.concat(F.lit(f"{kind}:"), n.cast("string"))
        mixed = feistel(key, tweak, _number(d.substr(F.lit(1), head)), _number(d.substr(head + 1, tail)), size(head), size(tail))
        return _let(mixed, lambda s: F.concat(F.lpad(s["l"].cast("string"), head, "0"), F.when(tail > 0, F.lpad(s["r"].cast("string"), tail, "0")).otherwise("")))

    return _let(digits, body)


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits, one after another, replaced by digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        here = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(here, digits.substr(s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + here.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum, where the digits at odd (1) or even (0) places from the right, from 0, count double."""

    def step(s: Column, c: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.struct((s["sum"] + F.when(s["at"] % 2 == doubled, twice).otherwise(d)).alias("sum"), (s["at"] + 1).alias("at"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")), step, lambda s: s["sum"])


def _card(key: str, m: Column) -> Column:
    """Of the ends of groups within m the last at which 13 to 19 digits pass Luhn; what stands behind it stays."""

    def body(d: Column) -> Column:
        made = permuted_digits(key, "card", d.substr(F.lit(1), F.length(d) - 1))
        return _let(made, lambda p: F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string")))

    def passes(end: Column) -> Column:
        whole = ~m.substr(end + 1, F.lit(1)).between("0", "9")
        return whole & _let(_digits(m.substr(F.lit(1), end)), lambda d: F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0))

    def ended(end: Column) -> Column:
        shape = m.substr(F.lit(1), end)
        return F.when(end.isNotNull(), F.concat(refilled(shape, _let(_digits(shape), body)), m.substr(end + 1, F.length(m))))

    ends = F.sequence(F.length(m), F.least(F.lit(13), F.length(m)), F.lit(-1))
    return _let(F.get(F.filter(ends, passes), 0), ended)


def _rest97(text: Column) -> Column:
    """The remainder modulo 97, letters counting as 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((r * 100 + letter) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(key: str, m: Column) -> Column:
    def body(c: Column) -> Column:
        valid = (_rest97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(F.lit(1), F.lit(4)))) == 1) & F.length(c).between(15, 34)
        account = c.substr(F.lit(5), F.length(c))
        made = refilled(account, permuted_digits(key, "iban", _digits(account)))
        check = lambda a: F.lpad((98 - _rest97(F.concat(a, c.substr(F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
        whole = _let(made, lambda a: F.concat(c.substr(F.lit(1), F.lit(2)), check(a), a))
        spaced = lambda w: F.aggregate(
            F.split(m, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, x: F.struct(F.concat(s["out"], F.when(x == " ", " ").otherwise(w.substr(s["at"], F.lit(1)))).alias("out"), (s["at"] + (x != " ").cast("int")).alias("at")),
            lambda s: s["out"],
        )
        return F.when(valid, _let(whole, spaced))

    return _let(F.regexp_replace(m, " ", ""), body)


def _ipv4(key: str, m: Column) -> Column:
    def body(o: Column) -> Column:
        part = lambda k: _number(F.get(o, k))
        mixed = feistel(key, F.lit("ipv4"), part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
        halves = lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)])
        return F.when(F.forall(o, lambda x: _number(x) <= 255), _let(mixed, halves))

    return _let(F.split(m, r"\."), body)


def _ssn(key: str, m: Column) -> Column:
    def body(o: Column) -> Column:
        area, group, serial = (_number(F.get(o, k)) for k in range(3))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        index = area - F.when(area > 666, 2).otherwise(1)
        mixed = feistel(key, F.lit("ssn"), index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

        def shown(s: Column) -> Column:
            place = F.floor(s["l"] / 99)
            number = place + F.when(place >= 665, 2).otherwise(1)
            return F.concat_ws("-", F.lpad(number.cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, _let(mixed, shown))

    return _let(F.split(m, "-"), body)


def _until(m: Column, n: int) -> Column:
    """How many characters of m there are up to its n-th digit."""
    return F.length(F.regexp_extract(m, rf"^(?:[^0-9]*[0-9]){{{n}}}", 0))


def _phone(key: str, m: Column) -> Column:
    """The country code after + or 00 and a trunk zero in brackets stay; the other digits are permuted, so all spellings of a number stay linked."""
    zeros = F.when(m.startswith("00"), 2).otherwise(0)
    digits = _digits(m).substr(zeros + 1, F.length(m))
    code = F.when(m.startswith("+") | m.startswith("00"), F.regexp_extract(digits, f"^(?:{COUNTRY_CODE})", 0)).otherwise("")

    def body(c: Column) -> Column:
        taken = F.lit(0)
        for n in range(1, 6):
            taken = F.when(F.length(c) + zeros == n, _until(m, n)).otherwise(taken)
        kept = F.when(c == "", F.lit("")).otherwise(m.substr(F.lit(1), taken))
        rest = F.replace(m.substr(F.when(c == "", 0).otherwise(taken) + 1, F.length(m)), F.lit("(0)"), F.lit("(\x00)"))
        made = refilled(rest, permuted_digits(key, "phone", _digits(rest)))
        return F.concat(kept, F.replace(made, F.lit("\x00"), F.lit("0")))

    return F.when(F.length(digits).between(8, 15), _let(code, body))


def _date(key: str, m: Column) -> Column:
    """Year-month-day, day.month.year, and month/day/year or, where only that is a date, day/month/year; years 100 to 9999.

    Days up to the 12th go to such days and days beyond it to days beyond it, whatever the notation: the
    permutation is applied again until it leads to one. So a pseudonym reads in its notation as the date does, all notations of a
    day stay linked, and no two days get one pseudonym."""
    shapes = ["yyyy-MM-dd", "d.M.yyyy", "M/d/yyyy", "d/M/yyyy"]
    tests = [m.contains("-"), m.contains("."), m.contains("/"), m.contains("/")]
    parsed = [F.when(t, F.try_to_timestamp(m, F.lit(s)).cast("date")) for t, s in zip(tests, shapes, strict=True)]
    padded = F.length(m) == 10
    out = {"yyyy-MM-dd": ("yyyy-MM-dd",) * 2, "d.M.yyyy": ("dd.MM.yyyy", "d.M.yyyy"), "M/d/yyyy": ("MM/dd/yyyy", "M/d/yyyy"), "d/M/yyyy": ("dd/MM/yyyy", "d/M/yyyy")}

    def body(day: Column) -> Column:
        base = (F.floor(F.year(day) / 100) * 100).cast("int")
        leap = base % 400 == 0
        left, right = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
        first = F.make_date(base, F.lit(1), F.lit(1))
        at = F.datediff(day, first)
        tweak = F.concat(F.lit("date:"), base.cast("string"))
        far = lambda at: F.dayofmonth(F.date_add(first, at.cast("int"))) > 12
        late = F.dayofmonth(day) > 12

        def step(s: Column, _: Column) -> Column:
            mixed = feistel(key, tweak, F.floor(s["at"] / right), s["at"] % right, left, right)
            onward = _let(mixed, lambda p: F.struct((p["l"] * right + p["r"]).cast("bigint").alias("at"), (late == far(p["l"] * right + p["r"])).alias("done")))
            return F.when(s["done"], s).otherwise(onward)

        start = F.struct(at.cast("bigint").alias("at"), F.lit(False).alias("done"))
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda s: F.date_add(first, s["at"].cast("int")))
        text = F.lit(None).cast("string")
        for p, s in reversed(list(zip(parsed, shapes, strict=True))):
            wide, narrow = out[s]
            text = F.when(p.isNotNull(), F.when(padded, F.date_format(moved, wide)).otherwise(F.date_format(moved, narrow))).otherwise(text)
        return F.when(F.year(day) >= 100, text)

    return _let(F.coalesce(*parsed), body)


def _email(key: str, m: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("user-"), F.substring(digest, 1, 16), F.regexp_extract(m, "@.*$", 0))


_MAKERS = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def replacement(key: str, m: Column, kinds=tuple(_MAKERS)) -> Column:
    """A struct (kind, value) for one match: of the first of kinds whose shape and validation hold, else (null, m)."""

    def tried(kind: str) -> Column:
        valid = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), _MAKERS[kind](key, m))
        return _let(valid, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))))

    return F.coalesce(*map(tried, kinds), F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))


def _joined(text: Column, kinds, values: Column) -> Column:
    """text with values in place of its matches."""
    between = F.split(text, _any(kinds), -1)
    return F.array_join(F.zip_with(between, F.array_append(values, F.lit("")), lambda a, b: F.concat(a, b)), "")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised and pii_kinds, the kinds replaced in order of place.

    A null text stays null and an empty one empty, with no kinds; a text without anything
    that validates comes out as it went in. What looks like an account number and is none
    may still hold other numbers. Other columns, whatever they are called, and repeated rows
    are kept; a column named pii_kinds is replaced."""
    text = F.col("text")
    docs = docs.select(other_columns(docs, "pii_kinds"))
    seen, made_ = free_names(docs.columns, "pii_found_", "pii_made_")
    outer, inner = tuple(_MAKERS), tuple(k for k in _MAKERS if k not in ("email", "iban"))
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_any(outer)), F.lit(0)))
    spotted = docs.withColumn(seen, found)
    mapped = spotted.withColumn(made_, F.when(F.size(seen) > 0, F.transform(seen, lambda m: replacement(key, m))))

    def second(r: Column) -> Column:
        held = F.when(r["kind"].isNull() & r["value"].rlike(r"^[A-Z]{2}\d{2}"), F.regexp_extract_all(r["value"], F.lit(_any(inner)), F.lit(0)))
        made = F.transform(held, lambda m: replacement(key, m, inner))
        within = lambda x: F.struct(F.transform(x, lambda y: y["kind"]).alias("kinds"), _joined(r["value"], inner, F.transform(x, lambda y: y["value"])).alias("value"))
        once = F.struct(F.array(r["kind"]).alias("kinds"), r["value"].alias("value"))
        return F.when(F.size(held) > 0, _let(made, within)).otherwise(once)

    again = mapped.withColumn(made_, F.transform(made_, second))
    joined = _joined(text, outer, F.transform(made_, lambda r: r["value"]))
    kinds = F.filter(F.flatten(F.transform(made_, lambda r: r["kinds"])), lambda k: k.isNotNull())
    changed = again.withColumn("pii_kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    new = F.when(F.size("pii_kinds") > 0, joined).otherwise(text)
    return changed.withColumn("text", new).drop(seen, made_)
