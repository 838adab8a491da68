"""Format-preserving pseudonyms for personal data, in SQL functions only.

E-mail addresses, IP addresses, phone numbers, card numbers, bank accounts, social security numbers and dates are found by pattern and validated. The
value is taken apart into components of fixed ranges (digits, letters, octets, the two factors of a day count), and a keyed Feistel network
permutes the components within their ranges. So a pseudonym has the format of its value, equal values have equal pseudonyms in all documents
and however they are written, and whoever holds the key can undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "date", "ssn", "ip", "phone", "card")
#: One pattern per kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"(?<![\w./-])(?<!\d:)(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!(?!T\d)[\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){11,18}(?![\w-])",
}
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)
#: Accounts and cards are sought in whole runs of groups, so that no match ends within the next value.
RUNS = {
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]{4}){2})[A-Z0-9 ]*(?<! )(?!\w|[./:@+-]\w)",
    "card": r"(?<![\w.-])\d(?=(?:[ -]?\d){11})[\d -]*(?<=\d)(?![\w-]|[./:@+]\w)",
}
#: Characters of the shortest and the longest value that may stand in a run.
SHORTEST, LONGEST = 7, 44
#: A run is searched in blocks of words (they end at a blank or a bracket, as values do), each with what a value may need beyond it. No value holds a
#: word of over 46 characters, which is a block of its own.
BLOCK = r"((?:[^ )]{47,}+[ )]?)|(?:[^ )]{0,46}+(?:[ )]|$)){1,64})(?=(.{0,46}))"
ANY = "|".join((PATTERNS | RUNS).values())


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, ranges: Column, key: str, tweak: str, back: bool = False) -> Column:
    """A keyed permutation of the integers ``values`` (array), each within 0 and its range.

    Rounds change the components at even and at odd places by turns: to each is added, modulo its range, a number of 16 bits from the SHA-256
    of key, tweak, round and the components at the other places. ``back`` subtracts, in the reverse order.
    """
    def one(v: Column, r: Column) -> Column:
        other = F.array_join(F.filter(v, lambda _, i: i % 2 != r % 2).cast("array<string>"), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), r.cast("string"), other), 256)

        def moved(d: Column) -> Column:
            def at(x: Column, i: Column) -> Column:
                add = F.conv(F.substr(d, F.lit(1) + F.lit(4) * F.pmod(F.floor(i / 2), F.lit(16)).cast("int"), F.lit(4)), 16, 10).cast("int")
                return F.when(i % 2 == r % 2, F.pmod(x - add if back else x + add, F.get(ranges, i))).otherwise(x)

            return F.transform(v, at)

        return _let(digest, moved)

    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    return F.aggregate(rounds, values, one)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _places(chars: Column) -> tuple[Column, Column, Column]:
    """For digits and letters: value, range and first code point."""
    code = F.transform(chars, lambda c: F.ascii(c))
    base = F.transform(code, lambda c: F.when(c >= 97, 97).when(c >= 65, 65).otherwise(48))
    return F.zip_with(code, base, lambda c, b: c - b), F.transform(base, lambda b: F.when(b == 48, 10).otherwise(26)), base


def permuted(compact: Column, key: str, tweak: str, back: bool = False) -> Column:
    """The digits and ASCII letters of ``compact`` permuted, each within its class."""
    def body(chars: Column) -> Column:
        values, ranges, base = _places(chars)
        return F.array_join(F.zip_with(feistel(values, ranges, key, tweak, back), base, lambda v, b: F.char(v + b)), "")

    return _let(_chars(compact), body)


def _poured(shape: Column, compact: Column, taken: str) -> Column:
    """``shape`` with its characters of the class ``taken`` replaced, in order, by those of ``compact`` (the last ones, if it has fewer)."""
    skip = F.length(F.regexp_replace(shape, f"[^{taken}]", "")) - F.length(compact)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        use = c.rlike(f"^[{taken}]$")
        new = F.when(use & (acc["n"] >= skip), F.substr(compact, acc["n"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["n"] + F.when(use, 1).otherwise(0)).alias("n"))

    return F.aggregate(_chars(shape), start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one being the check digit."""
    values = F.transform(F.reverse(_chars(digits)), lambda c: c.cast("int"))
    return F.aggregate(F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)), F.lit(0), lambda a, d: a + d)


def _mod97(s: Column) -> Column:
    numbers = F.transform(_chars(s), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(numbers, F.lit(0), lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + d) % 97)


def _iban_rest(s: Column) -> Column:
    return _mod97(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)))


def _day(m: Column) -> Column:
    """The date of ``yyyy-mm-dd``, ``d/m/yyyy`` or ``d.m.yyyy``; where the middle number is no month, ``m/d/yyyy``. Null if it is none."""
    p = F.split(m, "[-/.]")
    iso = F.length(p[0]) == 4
    swapped = ~iso & (p[1].cast("int") > 12)
    month = F.when(swapped, p[0]).otherwise(p[1])
    day = F.when(iso, p[2]).when(swapped, p[1]).otherwise(p[0])
    date = F.concat_ws("-", F.when(iso, p[0]).otherwise(p[2]), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    n = F.date_diff(F.try_to_date(date, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < DAY_PARTS[0] * DAY_PARTS[1]), n)


def _kind(m: Column) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    compact = F.regexp_replace(m, " ", "")

    def is_(name: str) -> Column:
        return m.rlike(f"^(?:{PATTERNS[name]})$")

    return (F.when(is_("email"), F.lit("email"))
            .when(is_("iban"), F.when(_iban_rest(compact) == 1, F.lit("iban")))
            .when(is_("date"), F.when(_day(m).isNotNull(), F.lit("date")))
            .when(is_("ssn"), F.when(~digits.rlike("^(000|666|9)|^...00|0000$"), F.lit("ssn")))
            .when(is_("ip"), F.when(F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255), F.lit("ip")))
            .when(is_("phone"), F.when((n >= 8) & (n <= 15), F.lit("phone")))
            .when(is_("card"), F.when(luhn_sum(digits) % 10 == 0, F.lit("card"))))


def _new_email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    compact = F.regexp_replace(local, "[^0-9A-Za-z]", "")
    return F.concat(_poured(local, permuted(compact, key, "email"), "0-9A-Za-z"), F.lit("@"), domain)


def _new_iban(m: Column, key: str) -> Column:
    compact = F.regexp_replace(m, " ", "")
    body = F.concat(F.substring(compact, 1, 2), F.lit("00"), permuted(F.substring(compact, 5, 64), key, "iban"))
    return _let(body, lambda b: _poured(m, F.concat(F.substring(b, 1, 2), F.lpad((98 - _iban_rest(b)).cast("string"), 2, "0"), F.substring(b, 5, 64)), "0-9A-Z"))


def _new_date(m: Column, key: str) -> Column:
    n = _day(m)
    parts = F.array((n % DAY_PARTS[0]).cast("int"), F.floor(n / DAY_PARTS[0]).cast("int"))
    ranges = F.array(*[F.lit(r) for r in DAY_PARTS])

    def write(v: Column) -> Column:
        date = F.date_add(F.lit(FIRST_DAY).cast("date"), v[0] + v[1] * DAY_PARTS[0])
        mark = F.when(m.contains("/"), F.lit("/")).otherwise(F.lit("."))
        swapped = m.contains("/") & (F.split(m, "/")[1].try_cast("int") > 12)
        dm = F.when(swapped, F.date_format(date, "MM.dd")).otherwise(F.date_format(date, "dd.MM"))
        return F.when(m.contains("-"), F.date_format(date, "yyyy-MM-dd")).otherwise(
            F.regexp_replace(F.concat(dm, F.lit("."), F.date_format(date, "yyyy")), r"\.", mark))

    return _let(feistel(parts, ranges, key, "date"), write)


def _new_numbers(m: Column, key: str, kind: str) -> Column:
    """Addresses and social security numbers: components within the ranges that are valid for them."""
    if kind == "ip":
        values, ranges = F.split(m, r"\.").cast("array<int>"), F.array(*[F.lit(256)] * 4)
        return F.array_join(feistel(values, ranges, key, kind).cast("array<string>"), ".")
    d = _digits(m)
    area = F.substring(d, 1, 3).cast("int")
    values = F.array(area - F.when(area > 666, 2).otherwise(1), F.substring(d, 4, 2).cast("int") - 1, F.substring(d, 6, 4).cast("int") - 1)

    def write(v: Column) -> Column:
        new = v[0] + F.when(v[0] >= 665, 2).otherwise(1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((new, 3), (v[1] + 1, 2), (v[2] + 1, 4))])

    return _let(feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, kind), write)


def _new_phone(m: Column, key: str) -> Column:
    """The last ten digits change; a country code before them stays."""
    return _poured(m, permuted(F.substring(_digits(m), -10, 10), key, "phone"), "0-9")


def _new_card(m: Column, key: str) -> Column:
    """All digits but the check digit change; that is computed anew."""
    d = _digits(m)
    body = permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
    return _let(body, lambda b: _poured(m, F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")), "0-9"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (F.when(kind == "email", _new_email(m, key)).when(kind == "iban", _new_iban(m, key)).when(kind == "date", _new_date(m, key))
            .when(kind == "ssn", _new_numbers(m, key, "ssn")).when(kind == "ip", _new_numbers(m, key, "ip"))
            .when(kind == "phone", _new_phone(m, key)).when(kind == "card", _new_card(m, key)).otherwise(m))


def _hits(m: Column, reach: Column, done: Column) -> Column:
    """The values in ``m`` that start after ``done`` and not beyond ``reach``, (start, size, kind) in order: at each place the longest one that is valid."""
    def at(start: Column) -> Column:
        def within(w: Column) -> Column:
            def one(size: Column) -> Column:
                return F.struct(start.alias("start"), size.alias("size"), _let(F.substr(w, F.lit(1), size), _kind).alias("kind"))

            last = F.least(F.lit(LONGEST), F.length(w))
            sizes = F.when(last >= SHORTEST, F.sequence(last, F.lit(SHORTEST), F.lit(-1))).otherwise(F.array().cast("array<int>"))
            ends = F.filter(sizes, lambda n: F.substr(w, n, F.lit(3)).rlike(r"^[\w)](?![\w-]|[./:@+]\w)"))
            return F.get(F.filter(F.transform(ends, one), lambda x: x["kind"].isNotNull()), F.lit(0))

        return _let(F.substr(m, start, F.lit(LONGEST + 2)), within)

    def step(acc: Column, start: Column) -> Column:
        free = F.get(F.transform(F.slice(acc, -1, 1), lambda x: x["start"] + x["size"]), F.lit(0))
        return F.when(start < F.coalesce(free, F.lit(1)), acc).otherwise(
            _let(at(start), lambda hit: F.when(hit.isNull(), acc).otherwise(F.concat(acc, F.array(hit)))))

    starts = F.filter(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))),
                      lambda i: (i > done) & (i <= reach) & ((i == 1) | F.substr(m, i - 1, F.lit(2)).rlike(r"^[^\w.+(/-][\w+(]")))
    return F.aggregate(starts, F.array().cast("array<struct<start:int,size:int,kind:string>>"), step)


def _replaced(m: Column, key: str) -> Column:
    """(text, found) of a match: with pseudonyms for the match or, where it is no value, for the values within it.

    Blocks are searched one after the other, so the time grows with the length of the match; a value that reaches into the next
    block is written with the first.
    """
    def block(acc: Column, part: Column) -> Column:
        body, done = part["body"], acc["done"]
        n = F.length(body)

        def write(state: Column, hit: Column) -> Column:
            def put(new: Column) -> Column:
                return F.struct(F.concat(state["text"], F.substr(part["all"], state["at"], hit["start"] - state["at"]), new).alias("text"),
                                (hit["start"] + hit["size"]).alias("at"),
                                F.concat(state["found"], F.array(F.struct(hit["kind"].alias("kind"), new.alias("value")))).alias("found"))

            return _let(_let(F.substr(part["all"], hit["start"], hit["size"]), lambda v: pseudonym(v, hit["kind"], key)), put)

        def woven(hits: Column) -> Column:
            start = F.struct(F.lit("").alias("text"), (done + 1).alias("at"), F.array().cast("array<struct<kind:string,value:string>>").alias("found"))
            return F.aggregate(hits, start, write, lambda s: F.struct(
                F.concat(acc["text"], F.array(F.concat(s["text"], F.substr(body, s["at"], n)))).alias("text"),
                F.concat(acc["found"], s["found"]).alias("found"), F.greatest(s["at"] - 1 - n, F.lit(0)).alias("done")))

        whole = F.when((done == 0) & (n == F.length(part["all"])), _let(_kind(body), lambda k: F.when(k.isNotNull(), F.array(F.struct(
            F.lit(1).alias("start"), n.alias("size"), k.alias("kind"))))))
        word = F.when(body.rlike(r"^[^ )]{47,}[ )]?$"), F.array().cast("array<struct<start:int,size:int,kind:string>>"))
        return _let(F.coalesce(whole, word, _hits(part["all"], n, done)), woven)

    def ahead(body: Column, more: Column) -> Column:
        return F.struct(body.alias("body"), F.concat(body, more).alias("all"))

    cut = F.zip_with(F.regexp_extract_all(m, F.lit(BLOCK), 1), F.regexp_extract_all(m, F.lit(BLOCK), 2), ahead)
    parts = F.when(F.length(m) <= 4 * LONGEST, F.array(ahead(m, F.lit("")))).otherwise(cut)
    start = F.struct(F.array().cast("array<string>").alias("text"), F.array().cast("array<struct<kind:string,value:string>>").alias("found"), F.lit(0).alias("done"))
    return F.aggregate(parts, start, block, lambda acc: F.struct(F.array_join(acc["text"], "").alias("text"), acc["found"].alias("found")))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``pii``: an array of (kind, pseudonym) in the order of the text.

    Numbers that fail their validation (a card's or an account's check digits, a day that is none, an octet over 255) stay as they are; valid values within or beside them are
    still found, in a time that grows with the length of the text. Left in clear are dates outside 1900 to 2099, accounts in lower case, e-mail
    addresses with letters beyond ASCII and phone numbers without a country code that are not written as three, three and four digits. A null
    text stays null with no findings; texts without a digit or an @ are passed on unread. Domains of e-mail addresses and
    country codes stay. Nothing is shuffled; a column named ``pii`` is replaced.
    """
    t = F.col(text)

    nothing = F.array().cast("array<struct<text:string,found:array<struct<kind:string,value:string>>>>")
    found = F.when(t.rlike(r"@|\d"), F.transform(F.regexp_extract_all(t, F.lit(f"({ANY})"), 1), lambda m: _replaced(m, key)))
    out = docs.withColumn("__all", F.coalesce(found, nothing))
    woven = F.array_join(F.zip_with(F.split(t, ANY, -1), F.col("__all.text"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = out.withColumn(text, F.when(F.exists("__all", lambda x: F.size(x["found"]) > 0), woven).otherwise(t))
    return out.withColumn("pii", F.flatten("__all.found")).drop("__all")
