"""Format-preserving pseudonyms for personal numbers, dates, addresses and credentials.

Candidates are found by one regular expression and validated: Luhn for cards, mod 97 for
IBANs, number plans for telephone (unless written with +) and social security numbers, the calendar for dates,
octets for addresses. A valid value is replaced by its image under a keyed Feistel
permutation of all valid values of its format, so that equal values get equal pseudonyms in every
document and notation, different ones different pseudonyms, and separators, widths and check digits stay right.

==========  ===========================================================================
card        first digit kept, the others permuted, check digit recomputed
phone       ten digits, whatever the separators, with +1, 1 or nothing before them: area and exchange of the
            number plan (200 to 999) go to others of it; after +1 those below 200 stay below 200;
            other numbers after +: all digits but the first two. Ten bare digits are no phone number
ssn         valid (area, group and serial) triples
iban        country kept, digits and letters permuted by class, check digits recomputed
date        1900-01-01 to 2099-12-31 as year-month-day (also before a time), year/month/day, day.month.year,
            month/day/year (day/month/year where the first is over 12), 3 March 1985, March 3, 1985: the same image
            in each. Days and months of one digit go to such, those of two to such, 29 February to 29 February
ip          all IPv4 addresses
email       letters and digits before the @, by class
secret      access keys and values assigned to password, token and the like, of any length, by class
==========  ===========================================================================

Only DataFrame functions are used. Defined results: null text stays null with no finding; what isn't valid is
left as it is; texts without digit and @ are passed through unsearched. Rows are kept one for one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

ROUNDS = 10
#: The key of the registered query; pass a secret one.
DEMO_KEY = "tessera-demo-key"

_PHONE1 = r"(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4})"
_CARD = r"(?:\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})"
_IP = r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
_SECRET = r"""(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9+/_.=-]{8,}+"""
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in _MONTHS) + ")"
_NAMED = rf"(?:\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}}, \d{{4}})"
_NUMBERS = r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})"
PATTERN = (
    r"(?<![A-Za-z0-9@+])(?:"
    + "|".join([
        _SECRET, r"AKIA[0-9A-Z]{16}", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _PHONE1, r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}",
        _NUMBERS, r"\d{3}-\d{2}-\d{4}", _IP, _CARD, _NAMED,
    ])
    + r")(?:(?![A-Za-z0-9])|(?<=\d{4}-\d{2}-\d{2})(?=T\d{2}:))"
)


def _digest(key: str, tag: str, i: Column, x: Column) -> Column:
    inner = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), x.cast("string")), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _number(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """The image of (left below a, right below b) as a struct (l, r): each round adds a keyed function of one half to the other."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        turn = F.when(i % 2 == 0, F.struct(((s["l"] + _number(_digest(key, tag, i, s["r"]))) % a).alias("l"), s["r"].alias("r")))
        return turn.otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _number(_digest(key, tag, i, s["l"]))) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not again at each of its uses."""
    return F.transform(F.array(c), body)[0]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _shifted(s: Column, hexes: Column, letters: Column) -> Column:
    """Each letter and digit moved within its class by a byte of ``hexes``; ``letters``: how many lower-case letters there are."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(hexes, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        return (
            F.when(c.rlike("^[0-9]$"), F.char((code - 48 + by) % 10 + 48))
            .when(c.rlike("^[a-z]$"), F.char((code - 97 + by) % letters + 97))
            .when(c.rlike("^[A-Z]$"), F.char((code - 65 + by) % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(s), move), "")


def feistel_chars(s: Column, key: str, tag: str, letters: Column | None = None) -> Column:
    """A permutation of the strings with the same classes of characters in the same places."""
    letters = F.lit(26) if letters is None else letters
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))

    def step(x: Column, i: Column) -> Column:
        turn = F.when(i % 2 == 0, F.struct(_shifted(x["l"], _digest(key, tag, i, x["r"]), letters).alias("l"), x["r"].alias("r")))
        return turn.otherwise(F.struct(x["l"].alias("l"), _shifted(x["r"], _digest(key, tag, i, x["l"]), letters).alias("r")))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return _let(done, lambda x: F.concat(x["l"], x["r"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _padded(x: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    s = x.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), n - F.length(s))), s)


def _into(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(_chars(m), start, step)["out"]


def _part(s: Column, start: int | Column, n: int | Column) -> Column:
    return F.substr(s, F.lit(start) if isinstance(start, int) else start, F.lit(n) if isinstance(n, int) else n)


def _halves(s: Column, key: str, tag: str) -> Column:
    """A permutation of the digit strings of the length of ``s``."""
    n = F.length(s)
    u = F.floor(n / 2).cast("int")
    ten = F.lit(10.0)
    done = feistel(_part(s, 1, u), _part(s, u + 1, n - u), F.pow(ten, u).cast("long"), F.pow(ten, n - u).cast("long"), key, tag)
    return _let(done, lambda x: F.concat(F.when(u > 0, _padded(x["l"], u)).otherwise(""), _padded(x["r"], n - u)))


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    body = F.concat(_part(d, 1, 1), _halves(_part(d, 2, n - 2), key, "card"))
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(body, c.cast("string"))))[0]
    return F.when(F.call_function("luhn_check", d), _into(m, F.concat(body, check.cast("string"))))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    ten = F.substr(d, F.length(d) - 9)
    area, exchange, line = _part(ten, 1, 3).cast("long"), _part(ten, 4, 3).cast("long"), _part(ten, 7, 4).cast("long")
    low, base = (F.when(x < 200, F.lit(0)).otherwise(F.lit(200)) for x in (area, exchange))
    done = feistel(area - low, (exchange - base) * 10_000 + line, F.when(area < 200, F.lit(200)).otherwise(F.lit(800)), F.when(exchange < 200, F.lit(2_000_000)).otherwise(F.lit(8_000_000)), key, "phone")
    new = _let(done, lambda x: F.concat(_padded(x["l"] + low, 3), _padded(x["r"] + base * 10_000, 7)))
    plan = _into(m, F.concat(F.when(F.length(d) > 10, F.lit("1")).otherwise(""), new))
    abroad = _into(m, F.concat(_part(d, 1, 2), _halves(F.substr(d, F.lit(3)), key, "abroad")))
    return F.when(d.rlike("^1?[0-9]{10}$") & ~m.rlike(r"^\+(?!1)"), plan).when(F.length(d).between(8, 15), abroad)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = feistel(F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    back = lambda x: F.concat_ws("-", _padded(F.when(x["l"] < 665, x["l"] + 1).otherwise(x["l"] + 2), 3), _padded(F.floor(x["r"] / 9999) + 1, 2), _padded(x["r"] % 9999 + 1, 4))
    return F.when(ok, _let(done, back))


def _mod97(s: Column) -> Column:
    return F.aggregate(_chars(s), F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    s = F.regexp_replace(m, " ", "")
    body = feistel_chars(F.substr(s, F.lit(5)), key, "iban")
    check = _padded(98 - _mod97(F.concat(body, _part(s, 1, 2), F.lit("00"))), 2)
    ok = F.length(s).between(15, 34) & (_mod97(F.concat(F.substr(s, F.lit(5)), _part(s, 1, 4))) == 1)
    new = F.concat(_part(s, 1, 2), check, body)
    spaced = F.when(m.contains(" "), F.trim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    return F.when(ok, spaced)


def _moved(year: Column, month: Column, day: Column, key: str) -> Column:
    """The image (y, m, d) of a date; null where it is none, or not from 1900 to 2099."""
    date = F.try_to_date(F.concat_ws("-", _padded(year, 4), _padded(month, 2), _padded(day, 2)), "yyyy-MM-dd")
    ok = date.isNotNull() & year.between(1900, 2099)
    # where each month begins in a year's dates of the same widths
    ints = lambda *x: F.array(*map(F.lit, x))
    early, short = month < 10, day < 10
    begins = F.when(early & short, ints(*range(0, 81, 9))).when(short, ints(0, 9, 18)).when(early, ints(0, 22, 41, 63, 84, 106, 127, 149, 171)).otherwise(ints(0, 22, 43))
    n = F.when(early & short, F.lit(81)).when(short, F.lit(27)).when(early, F.lit(192)).otherwise(F.lit(65))
    base, least = F.when(early, F.lit(1)).otherwise(F.lit(10)), F.when(short, F.lit(1)).otherwise(F.lit(10))
    done = feistel(year - 1900, F.element_at(begins, (month - base + 1).cast("int")) + day - least, F.lit(200), n, key, "date")

    def back(x: Column) -> Column:
        return _let(F.size(F.filter(begins, lambda b: b <= x["r"])), lambda k: F.struct((x["l"] + 1900).alias("y"), (base + k - 1).cast("long").alias("m"), (x["r"] - F.element_at(begins, k) + least).cast("long").alias("d")))

    i = F.floor((year - 1904) / 4)
    leap = feistel(F.floor(i / 7), i % 7, F.lit(7), F.lit(7), key, "leap day")
    leap_day = _let(leap, lambda x: F.struct((x["l"] * 28 + x["r"] * 4 + 1904).alias("y"), F.lit(2).cast("long").alias("m"), F.lit(29).cast("long").alias("d")))
    return F.when(ok & (month == 2) & (day == 29), leap_day).when(ok, _let(done, back))


def _date(m: Column, key: str) -> Column:
    parts = F.split(m, "[-./]")
    sign = F.regexp_extract(m, "([-./])", 1)
    ordered, dots = m.rlike("^[0-9]{4}"), m.contains(".")
    us = ~ordered & ~dots & (parts[0].cast("int") <= 12)
    places = F.when(ordered, F.array(*map(F.lit, (0, 1, 2)))).when(us, F.array(*map(F.lit, (2, 0, 1)))).otherwise(F.array(*map(F.lit, (2, 1, 0))))  # of year, month, day

    def back(new: Column) -> Column:
        values = F.array(new["y"], new["m"], new["d"])
        return F.when(new.isNotNull(), F.call_function("array_join", F.transform(parts, lambda p, i: _padded(F.get(values, (F.array_position(places, i) - 1).cast("int")), F.length(p))), sign))

    return _let(_moved(*(F.get(parts, places[i]).cast("long") for i in range(3)), key), back)


def _named_date(m: Column, key: str) -> Column:
    names, brief = F.array(*map(F.lit, _MONTHS)), F.array(*(F.lit(x[:3]) for x in _MONTHS))
    name, first = F.regexp_extract(m, "([A-Z][a-z]+)", 1), m.rlike("^[A-Z]")
    day = F.regexp_extract(m, r"(?:^|[a-z] )([0-9]{1,2})(?:,| )", 1)
    new = _moved(F.substr(m, F.length(m) - 3).cast("long"), F.array_position(brief, F.substr(name, F.lit(1), F.lit(3))), day.cast("long"), key)

    def back(x: Column) -> Column:
        to = F.element_at(F.when(F.length(name) > 3, names).otherwise(brief), x["m"].cast("int"))
        d, y = _padded(x["d"], F.length(day)), x["y"].cast("string")
        return F.when(x.isNotNull(), F.when(first, F.concat(to, F.lit(" "), d, F.lit(", "), y)).otherwise(F.concat_ws(" ", d, to, y)))

    return _let(new, back)


def _ip(m: Column, key: str) -> Column:
    o = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    done = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    ok = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    back = lambda x: F.concat_ws(".", *(v.cast("string") for h in ("l", "r") for v in (F.floor(x[h] / 256), x[h] % 256)))
    return F.when(ok, _let(done, back))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(feistel_chars(_part(m, 1, at - 1), key, "email"), F.substr(m, at))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"""^(AKIA|.*?[=:]\s*["']?)""", 1)
    value = F.substr(m, F.length(head) + 1)
    letters = F.when(value.rlike(r"^[0-9a-f]+\.*$"), F.lit(6)).otherwise(F.lit(26))
    end = F.regexp_extract(value, r"(\.*)$", 1)  # of the sentence
    core = F.substr(value, F.lit(1), F.length(value) - F.length(end))
    return F.when(value.rlike("[0-9]"), F.concat(head, feistel_chars(core, key, "secret", letters), end))


#: Kind, pattern of the whole candidate, pseudonym (null where it isn't valid); the first pattern that fits decides.
KINDS: tuple[tuple[str, str, Callable[[Column, str], Column]], ...] = (
    ("secret", r"^(?:AKIA[0-9A-Z]{16}$|[A-Za-z_-]+\s*[=:])", _secret),
    ("email", "@", _email),
    ("iban", "^[A-Z]{2}[0-9]", _iban),
    ("phone", rf"^(?:\+|{_PHONE1}$)", _phone),
    ("date", f"^{_NUMBERS}$", _date),
    ("date", "^[A-Z]|[a-z] ", _named_date),
    ("ssn", r"^\d{3}-\d{2}-\d{4}$", _ssn),
    ("ip", r"\.", _ip),
    ("card", "", _card),
)


def _replaced(m: Column, key: str) -> Column:
    """(kind, text): null kind where nothing is replaced."""
    whole, kind = None, None
    for name, pattern, make in KINDS:
        fits = m.rlike(pattern)
        whole = F.when(fits, make(m, key)) if whole is None else whole.when(fits, make(m, key))
        kind = F.when(fits, F.lit(name)) if kind is None else kind.when(fits, F.lit(name))
    return F.struct(kind.alias("kind"), m.alias("old"), whole.alias("new"))


def pseudonymize(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` as one struct ``row_``, with the new text ``text_`` and the kinds found ``kinds_`` (array of string, in text order)."""
    text = F.col(f"row_.`{text_col}`")
    searched = F.when(text.rlike("[0-9@]"), text)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    found = rows.select("row_", F.transform(F.regexp_extract_all(searched, F.lit(PATTERN), 0), lambda m: _replaced(m, key)).alias("found_"))
    between = F.split(text, PATTERN, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(between, F.col("found_"), lambda a, f: F.array(a, F.coalesce(f["new"], f["old"], F.lit(""))))))
    kinds = F.transform(F.filter("found_", lambda f: f["new"].isNotNull()), lambda f: f["kind"])
    return found.select("row_", F.when(F.size("found_") > 0, joined).otherwise(text).alias("text_"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds_"))


def pseudonymized(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the new text."""
    done = pseudonymize(docs, key, text_col=text_col)
    return done.select(*(F.col("text_").alias(c) if c == text_col else F.col(f"row_.`{c}`").alias(c) for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, DEMO_KEY).select("row_.doc_id", F.col("text_").alias("text"), F.size("kinds_").alias("n_found"), F.concat_ws(",", "kinds_").alias("kinds"))
