"""Format-preserving Feistel pseudonyms for personal numbers, dates, addresses and keys, in DataFrame operations only.

A value becomes one or two parts, each of symbols with a radix; one keyed Feistel network with position-wise modular
addition, the same for all kinds, permutes the symbols within these radices, and the new symbols go back into the
value's own punctuation. Only valid values count, and they become valid ones: check digits of cards and account
numbers hold, dates exist, octets stay under 256. Telephone numbers have no check digit and their areas differ by
country, so they count by form alone. The same value has the same pseudonym in every document.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: An even number, so that the halves end in their places.
ROUNDS = 10
#: Where the key of the registered queries is set; without it, each application draws one of its own.
KEY_SETTING = "spark.corpusloom.pii.key"

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: What is looked for, by kind: candidates; those of them that are valid are replaced.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![\w-])",
    "secret": r"(?i:(?<=(?:token|secret|key|password) {0,3}[=:] {0,3}\"?))[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "access_key": r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z_-])(?:sk-[0-9A-Za-z-]{20,200}|gh[oprsu]_[0-9A-Za-z]{36})(?![0-9A-Za-z_-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?i:[23][0-9a-f]{3}|f[cde][0-9a-f]{2})(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\w:])",
    "phone": r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w.+-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.+-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])|(?<![\w.+-])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)",
    "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": rf"(?<![\w.+-])\d{{4}}-\d{{2}}-\d{{2}}(?![\w-])|(?<![\w./+-])\d{{1,2}}/\d{{1,2}}/\d{{4}}(?![\w/])|(?<![\w./+-])\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(?!\.?\w)|(?<![\w./+-])\d{{1,2}} (?:{MONTHS}) \d{{4}}(?!\w)|(?<!\w)(?:{MONTHS}) \d{{1,2}}, \d{{4}}(?!\w)",
    "ipv4": r"(?<![\w.+-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)",
    "card": r"(?<![\w.+-])\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}(?![\w-])|(?<![\w.+-])(?:\d{13,15}|\d{17,19})(?![\w-])",
}
#: How a match tells its kind, tried in this order; secrets, known by what stands before them, are the rest.
SHAPES = {
    "email": "@",
    "access_key": r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^sk-|^gh[oprsu]_",
    "iban": r"^[A-Z]{2}\d{2}[ 0-9A-Z]{10,}$",
    "ipv6": ":",
    "phone": r"^\+|^\(|^\d{3}([.-])\d{3}\1\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "date": r"^\d{4}-\d{2}-\d{2}$|/|^\d{1,2}\.\d{1,2}\.\d{4}$|[a-z] ",
    "ipv4": r"^\d{1,3}\.\d{1,3}\.",
    "card": r"^(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|\d{13,15}|\d{17,19})$",
}
#: The forms of dates, each with the pattern that reads and writes it; a form with two digits is tried before one digit's.
DATE_FORMS = {
    r"^\d{4}-": "yyyy-MM-dd",
    r"^(?:0\d|1[0-2])/\d\d/": "MM/dd/yyyy",
    r"^(?:0?[1-9]|1[0-2])/": "M/d/yyyy",
    r"^\d\d/\d\d/": "dd/MM/yyyy",
    r"^\d\d/": "d/M/yyyy",
    r"^\d\d\.\d\d\.": "dd.MM.yyyy",
    r"^\d{1,2}\.": "d.M.yyyy",
    r"^\d\d ": "dd MMMM yyyy",
    r"^\d ": "d MMMM yyyy",
    r"^[A-Z][a-z]+ \d\d,": "MMMM dd, yyyy",
    r"^[A-Z]": "MMMM d, yyyy",
}
#: Days of one cycle of the Gregorian calendar from 1700-01-01, as a product for the two halves.
CYCLE_START, CYCLE = "1700-01-01", (189, 773)
#: Social security numbers: areas but 000, 666 and 900 on, groups but 00; serials but 0000.
AREAS_GROUPS, SERIALS = 898 * 99, 9999
#: Mail domains of so many people that they tell nobody, and stay.
PUBLIC_DOMAINS = ["aol.com", "free.fr", "gmail.com", "gmx.de", "gmx.net", "googlemail.com", "hotmail.com", "icloud.com", "live.com", "mail.com", "msn.com", "orange.fr", "outlook.com", "proton.me", "protonmail.com", "t-online.de", "web.de", "yahoo.com", "yandex.ru"]

#: All kinds in one pass; at one place the first kind that matches counts.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every candidate meets.
HINT = r"\d{4}|\d\.\d|@|[0-9A-Fa-f]{32}|\+[2-9]|AKIA|ASIA|sk-|gh[oprsu]_|[A-Z]{2}\d\d|::"

Parts = list[tuple[Column, Column, Column]]


def key_of(spark: SparkSession) -> str:
    """The key that KEY_SETTING names: with the same one, runs give the same pseudonyms. Where it is unset, the
    application's own random key, which nobody else has: values are linked within the application then."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def feistel(symbols: Column, radices: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the arrays below radices: in each round, the first half moves by a hash of the
    other one, and the halves change places."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    low, high = (lambda a: F.slice(a, F.lit(1), half)), (lambda a: F.slice(a, half + 1, F.size(symbols) - half))
    start = F.struct(low(symbols).alias("a"), high(symbols).alias("b"), low(radices).alias("ra"), high(radices).alias("rb"))

    def turn(s: Column, n: Column) -> Column:
        message = F.concat_ws("|", F.lit(key), tweak, n.cast("string"), F.concat_ws(",", F.transform(s["b"], lambda x: x.cast("string"))))
        digest = lambda m, i: F.conv(F.substring(F.sha2(F.concat_ws("|", m, i.cast("string")), 256), 1, 13), 16, 10).cast("bigint")
        moved = _once(message, lambda m: F.transform(s["a"], lambda x, i: F.pmod(x + digest(m, i), F.element_at(s["ra"], i + 1))))
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    if rounds % 2:
        raise ValueError("an odd number of rounds would leave the halves exchanged")
    return _once(F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn), lambda s: F.concat(s["a"], s["b"]))


def _big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _digits(value: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(value, r"\D", "")), lambda c: c.cast("bigint"))


def _same(symbols: Column, radix: int) -> Column:
    return F.transform(symbols, lambda _: _big(radix))


def _refill(value: Column, classes: str, fresh: Column) -> Column:
    """value with its characters of these classes, in order, replaced by the strings in fresh."""
    between = F.split(value, f"[{classes}]")
    return F.array_join(F.zip_with(between, F.concat(fresh, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _strings(symbols: Column) -> Column:
    return F.transform(symbols, lambda d: d.cast("string"))


def luhn_sum(digits: Column) -> Column:
    """Of digits from the left; the last one counts once."""
    return F.aggregate(F.transform(digits, lambda d, i: F.when((F.size(digits) - 1 - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))), _big(0), lambda a, d: a + d)


def _card(v: Column) -> tuple[Column, Parts]:
    digits = _digits(v)
    body = F.slice(digits, F.lit(1), F.size(digits) - 1)
    return (luhn_sum(digits) % 10 == 0) & (luhn_sum(digits) > 0), [(body, _same(body, 10), F.concat(F.lit("card"), F.size(digits).cast("string")))]


def _card_back(v: Column, fresh: Column) -> Column:
    check = lambda b: F.pmod(-luhn_sum(F.concat(b, F.array(_big(0)))), _big(10))
    return _refill(v, "0-9", _strings(_once(fresh[0], lambda b: F.concat(b, F.array(check(b))))))


def _country_digits(v: Column) -> Column:
    """How many digits of a telephone number stay: a country code's, which has up to three of them."""
    code = F.when(v.rlike(r"^\+[17]"), 1).when(v.rlike(r"^\+"), 3).otherwise(0)
    return F.greatest(code, F.size(_digits(v)) - 10)


def _phone(v: Column) -> tuple[Column, Parts]:
    digits, stay = _digits(v), _country_digits(v)
    body = F.slice(digits, stay + 1, F.size(digits) - stay)
    return F.size(digits).between(8, 15), [(body, _same(body, 10), F.lit("phone"))]


def _phone_back(v: Column, fresh: Column) -> Column:
    return _refill(v, "0-9", _strings(F.concat(F.slice(_digits(v), F.lit(1), _country_digits(v)), fresh[0])))


def _ssn(v: Column) -> tuple[Column, Parts]:
    area, group, serial = (F.substring(v, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    symbols = F.array((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1)
    return valid, [(symbols, F.array(_big(AREAS_GROUPS), _big(SERIALS)), F.lit("ssn"))]


def _ssn_back(v: Column, fresh: Column) -> Column:
    area = lambda x: F.floor(x / 99) + F.when(F.floor(x / 99) >= 665, 2).otherwise(1)
    return _once(fresh[0], lambda x: F.format_string("%03d-%02d-%04d", area(x[0]), x[0] % 99 + 1, x[1] + 1))


def _date_form(v: Column) -> Column:
    form = F.lit(None).cast("string")
    for shape, pattern in reversed(DATE_FORMS.items()):
        form = F.when(v.rlike(shape), F.lit(pattern)).otherwise(form)
    return form


def _date(v: Column) -> tuple[Column, Parts]:
    """Month/day/year where that is a date, else day/month/year; with dots, the day comes first."""
    number = F.datediff(F.try_to_timestamp(v, _date_form(v)).cast("date"), F.lit(CYCLE_START).cast("date")).cast("bigint")
    symbols = F.array(F.floor(number / CYCLE[1]).cast("bigint"), F.pmod(number, _big(CYCLE[1])))
    return (number >= 0) & (number < CYCLE[0] * CYCLE[1]), [(symbols, F.array(*map(_big, CYCLE)), F.lit("date"))]


def _date_back(v: Column, fresh: Column) -> Column:
    day = _once(fresh[0], lambda x: F.date_add(F.lit(CYCLE_START).cast("date"), (x[0] * CYCLE[1] + x[1]).cast("int")))
    return F.call_function("date_format", day, _date_form(v))


def _ipv4(v: Column) -> tuple[Column, Parts]:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("bigint"))
    return F.forall(parts, lambda x: x < 256), [(parts, _same(parts, 256), F.lit("ipv4"))]


def _ipv4_back(v: Column, fresh: Column) -> Column:
    return F.array_join(_strings(fresh[0]), ".")


def _codes(value: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(value, "[^0-9A-Za-z]", "")), lambda c: F.ascii(c).cast("bigint"))


def _base(c: Column) -> Column:
    return F.when(c >= 97, 97).when(c >= 65, 65).otherwise(48).cast("bigint")


def _coded(value: Column, tweak: Column) -> tuple[Column, Column, Column]:
    """Letters of either case and digits, each within its own kind of character."""
    codes = _codes(value)
    return F.transform(codes, lambda c: c - _base(c)), F.transform(codes, lambda c: F.when(c >= 65, 26).otherwise(10).cast("bigint")), tweak


def _decoded(value: Column, fresh: Column) -> Column:
    return _refill(value, "0-9A-Za-z", F.zip_with(_codes(value), fresh, lambda c, x: F.chr(_base(c) + x)))


def _domain(v: Column) -> Column:
    return F.lower(F.substring_index(v, "@", -1))


def _own_domain(v: Column) -> Column:
    """What of a domain tells its owner: all but its last label, and nothing of the public ones."""
    return F.when(_domain(v).isin(PUBLIC_DOMAINS), F.lit("")).otherwise(F.regexp_extract(v, r"@(.*)\.[^.]*$", 1))


def _email(v: Column) -> tuple[Column, Parts]:
    """The local part, with its domain in the key, and the domain but for its last label. One character alone has
    no half to mix with, and moves by the key only."""
    return F.lit(True), [_coded(F.substring_index(v, "@", 1), F.concat(F.lit("email"), _domain(v))), _coded(_own_domain(v), F.lit("domain"))]


def _email_back(v: Column, fresh: Column) -> Column:
    rest = F.substring(F.substring_index(v, "@", -1), F.length(_own_domain(v)) + 1, 10_000)
    own = F.when(_own_domain(v) == "", F.lit("")).otherwise(_decoded(_own_domain(v), fresh[1]))
    return F.concat(_decoded(F.substring_index(v, "@", 1), fresh[0]), F.lit("@"), own, rest)


def _key_prefix(v: Column) -> Column:
    return F.regexp_extract(v, r"^(AKIA|ASIA|sk-|gh[oprsu]_)", 1)


def _after_prefix(v: Column) -> Column:
    return F.regexp_replace(v, r"^(AKIA|ASIA|sk-|gh[oprsu]_)", "")


def _access_key(v: Column) -> tuple[Column, Parts]:
    return F.lit(True), [_coded(_after_prefix(v), _key_prefix(v))]


def _access_key_back(v: Column, fresh: Column) -> Column:
    return F.concat(_key_prefix(v), _decoded(_after_prefix(v), fresh[0]))


def _mod97(value: Column) -> Column:
    """Of an account number as its rule reads it: letters count 10 to 35."""
    step = lambda a, c: F.when(c >= 65, F.pmod(a * 100 + c - 55, _big(97))).otherwise(F.pmod(a * 10 + c - 48, _big(97)))
    return F.aggregate(_codes(value), _big(0), step)


def _account(v: Column) -> Column:
    """An account number without its country, check digits and spaces."""
    return F.substring(F.regexp_replace(v, " ", ""), 5, 40)


def _iban(v: Column) -> tuple[Column, Parts]:
    return _mod97(F.concat(_account(v), F.substring(v, 1, 4))) == 1, [_coded(_account(v), F.substring(v, 1, 2))]


def _iban_back(v: Column, fresh: Column) -> Column:
    country = F.substring(v, 1, 2)
    check = lambda a: F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
    whole = _once(_decoded(_account(v), fresh[0]), lambda a: F.concat(country, check(a), a))
    return _refill(v, "0-9A-Z", _chars(whole))


def _hex(v: Column, tweak: str) -> tuple[Column, Parts]:
    symbols = F.transform(_chars(F.regexp_replace(v, "[^0-9A-Fa-f]", "")), lambda c: F.conv(c, 16, 10).cast("bigint"))
    return F.lit(True), [(symbols, _same(symbols, 16), F.lit(tweak))]


def _hex_back(v: Column, fresh: Column) -> Column:
    """Capitals stay capitals, and the same value in either case has the same pseudonym."""
    made = F.transform(fresh[0], lambda x: F.when(v.rlike("[A-F]"), F.hex(x)).otherwise(F.lower(F.hex(x))))
    return _refill(v, "0-9A-Fa-f", made)


#: By kind: a value's validity and parts, and the way back from a value and its parts' new symbols.
KINDS: dict[str, tuple[Callable[[Column], tuple[Column, Parts]], Callable[[Column, Column], Column]]] = {
    "email": (_email, _email_back),
    "access_key": (_access_key, _access_key_back),
    "iban": (_iban, _iban_back),
    "ipv6": (lambda v: _hex(v, "ipv6"), _hex_back),
    "phone": (_phone, _phone_back),
    "ssn": (_ssn, _ssn_back),
    "date": (_date, _date_back),
    "ipv4": (_ipv4, _ipv4_back),
    "card": (_card, _card_back),
    "secret": (lambda v: _hex(v, "secret"), _hex_back),
}


def _kind(v: Column) -> Column:
    kind = F.lit("secret")
    for name, shape in reversed(SHAPES.items()):
        kind = F.when(v.rlike(shape), F.lit(name)).otherwise(kind)
    return kind


def _parts(v: Column, kind: Column) -> Column:
    """The parts of a value of a kind; null where it isn't valid."""
    whole = F.lit(None)
    for name, (take, _) in KINDS.items():
        valid, parts = take(v)
        made = F.array(*[F.struct(s.alias("symbols"), r.alias("radices"), t.alias("tweak")) for s, r, t in parts])
        whole = F.when((kind == name) & valid, made).otherwise(whole)
    return whole


def _back(v: Column, kind: Column, fresh: Column) -> Column:
    text = v
    for name, (_, back) in KINDS.items():
        text = F.when(kind == name, back(v, fresh)).otherwise(text)
    return text


def pseudonyms(found: Column, key: str) -> Column:
    """An array (kind, original, pseudonym) for an array of matches of ANY; a match that isn't valid has a null kind,
    and its text stays. The network stands in the plan once, for all kinds and matches."""
    kinds = F.transform(found, lambda v: F.struct(v.alias("v"), _kind(v).alias("kind")))
    parts = F.transform(kinds, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), _parts(x["v"], x["kind"]).alias("parts")))
    moved = F.transform(parts, lambda x: F.struct(x["v"].alias("v"), F.when(x["parts"].isNotNull(), x["kind"]).alias("kind"), F.transform(x["parts"], lambda p: feistel(p["symbols"], p["radices"], key, p["tweak"])).alias("fresh")))
    return F.transform(moved, lambda x: F.struct(x["kind"].alias("kind"), x["v"].alias("original"), F.when(x["kind"].isNotNull(), _back(x["v"], x["kind"], x["fresh"])).otherwise(x["v"]).alias("pseudonym")))


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", pii_col: str = "pii") -> DataFrame:
    """docs with pseudonyms in their texts, and pii_col: an array of (kind, original, pseudonym) in text order.

    key: a secret; who has it can go back from pseudonyms to values. It stands in the plan, so plans and event logs
    are to be kept like it. Null texts stay null, with an empty array; texts without valid values stay as they are.
    Repeated rows and ties are treated alike, an empty table gives none, and other columns stay, whatever their names
    (one named like pii_col is replaced). Numbers that fail their check digits, dates that don't exist and addresses with
    parts over 255 aren't personal data; neither are ten digits without any punctuation.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col(text_col)
    found_col, fresh_col = unused(docs, "found", "fresh")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    made = docs.withColumn(found_col, F.coalesce(found, F.array().cast("array<string>")))
    made = made.withColumn(fresh_col, F.when(F.size(found_col) > 0, pseudonyms(F.col(found_col), key)))
    between = F.split(text, ANY, -1)
    filled = F.array_join(F.zip_with(between, F.concat(F.transform(fresh_col, lambda x: x["pseudonym"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    pii = F.coalesce(F.filter(fresh_col, lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,original:string,pseudonym:string>>"))
    return made.withColumns({pii_col: pii, text_col: F.when(F.size(found_col) > 0, filled).otherwise(text)}).drop(found_col, fresh_col)
