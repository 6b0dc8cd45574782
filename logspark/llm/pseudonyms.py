"""Format-preserving pseudonyms for personal data.

Everything is DataFrame expressions. One pattern finds candidates, a validator per kind decides,
and a keyed Feistel network permutes the value within the numbers of its own format:

* card numbers of 13 to 19 digits with a right check digit: the digits before it; a new check digit
* phone numbers of the ten-digit plan: area and exchange (first digit 2 to 9) and line
* social security numbers: area 001 to 899 but 666, group and serial not 0
* IPv4 addresses: the two halves
* dates from 1900 to 2099 as yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy: the day among 17 * 4,297 days

A card may stand in a longer run of digit groups, next to an order number or a security code.
Separators stay where they are. Equal values get equal pseudonyms in every document, and whoever
holds the key can invert them (``invert=True``; of a run with several overlapping candidates, the same ones are found again). Mail addresses have no fixed format: they become
``u`` and 16 keyed hex digits at ``pseudonym.invalid``, linked but not invertible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions.web import let
from logspark.llm.common import free_name, prepare
from logspark.llm.spans import matches_of, parts_of, replaced

ROUNDS = 10
#: Key of the registered query; a production caller passes a secret of its own.
DEMO_KEY = "pseudonyms-demo-key"

_ODD = "(?<![0-9A-Za-z])"
_END = "(?![0-9A-Za-z])"
MAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"
ADDRESS = "(?<![0-9A-Za-z.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\\.[0-9])"
DATE = f"{_ODD}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}){_END}"
SOCIAL = f"{_ODD}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}"
PHONE = f"(?:\\+1[ .-]?|{_ODD})(?:\\([2-9][0-9]{{2}}\\) ?|[2-9][0-9]{{2}}[ .-])[2-9][0-9]{{2}}[ .-][0-9]{{4}}{_END}"
# A run of digit groups, all parted by the same sign or by none, of 13 digits or more; a card may be a part of it.
_RUN = "(?<![0-9A-Za-z.])(?<![0-9][-/])"
CARD = (
    f"{_RUN}(?:(?=[0-9](?: ?[0-9]){{12}})[0-9]+(?: [0-9]+)*(?![0-9A-Za-z]|[-./][0-9])"
    f"|(?=[0-9](?:-?[0-9]){{12}})[0-9]+(?:-[0-9]+)*(?![0-9A-Za-z]|[./][0-9]))"
)
PATTERNS = {"mail": MAIL, "address": ADDRESS, "date": DATE, "social": SOCIAL, "phone": PHONE, "card": CARD}
ANY = "|".join(PATTERNS.values())
#: Holds in every text with a match.
_QUICK = "@|[0-9]{4}|[0-9]\\.[0-9]|[0-9](?:[ -]?[0-9]){12}"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _whole(m: Column, kind: str) -> Column:
    return m.rlike(f"^(?:{PATTERNS[kind]})$")


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Sum of the digits from the right, every second one doubled; ``doubled_from`` 0 doubles the last."""
    size = F.char_length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(i, F.lit(2)) == doubled_from, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), one), F.lit(0), lambda s, x: s + x)


def feistel(x: Column, a: Column, b: Column, kind: str, key: str, invert: bool) -> Column:
    """A keyed permutation of 0 .. a * b - 1: the halves x div b and x mod b are shifted in turn."""

    def shift(value: Column, turn: Column, of: Column) -> Column:
        told = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn, value), 256)
        return F.pmod(F.conv(F.substring(told, 1, 15), 16, 10).cast("long"), of)

    def step(s: Column, turn: Column) -> Column:
        sign = -1 if invert else 1
        left = F.struct(F.pmod(s["l"] + sign * shift(s["r"], turn, a), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * shift(s["l"], turn, b), b).alias("r"))
        return F.when(F.pmod(turn, F.lit(2)) == 0, left).otherwise(right)

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if invert else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    halves = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(turns, halves, step, lambda s: s["l"] * b + s["r"])


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _put(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced one after the other; what is no digit stays."""
    chars = F.transform(F.sequence(F.lit(1), F.char_length(m)), lambda i: F.substring(m, i, F.lit(1)))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    digit = lambda c: c.rlike("[0-9]")
    step = lambda s, c: F.struct(F.concat(s["out"], F.when(digit(c), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit(c).cast("int")).alias("at"))
    return F.aggregate(chars, start, step, lambda s: s["out"])


def _card(m: Column, key: str, invert: bool) -> Column:
    """One card number with a right check digit; ``m`` is a bound value."""
    power = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")

    def mixed(body: Column) -> Column:
        # eighteen digits fit a long, and so do the halves' sums
        size, left = F.char_length(body), F.floor(F.char_length(body) / 2).cast("int")
        return F.lpad(feistel(body.cast("long"), power(left), power(size - left), "card", key, invert).cast("string"), size, F.lit("0"))

    def whole(digits: Column) -> Column:
        return _put(m, F.concat(digits, F.pmod(10 - F.pmod(luhn_sum(digits, 0), F.lit(10)), F.lit(10)).cast("string")))

    return let(_digits(m), lambda d: let(F.substring(d, F.lit(1), F.char_length(d) - 1), lambda body: let(mixed(body), whole)))


#: Printed cards: sizes of their groups, as text and in a run.
_SHAPES = "^(?:4,4,4,4|4,6,[45]|1[3-9])$"
_SHAPED = "(?<![0-9])(?:[0-9]{4}([ -])(?:[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[0-9]{6}\\1[0-9]{4,5})|[0-9]{13,19})(?![0-9])"


def _cards(m: Column, key: str, invert: bool) -> Column:
    """A run of digit groups with the card numbers in it changed.

    A card begins and ends with a group, has 13 to 19 digits and a right check digit. In a run with
    groups of the sizes of printed cards only such groups count; of others the first and longest.
    """

    def run(x: Column) -> Column:
        groups, sign, shaped = x["groups"], x["sign"], x["shaped"]

        def is_card(i: Column, n: Column) -> Column:
            def test(part: Column) -> Column:
                shape = F.array_join(F.transform(part, lambda g: F.char_length(g).cast("string")), ",")
                sum_of = let(F.array_join(part, ""), lambda d: F.when(F.char_length(d).between(13, 19), F.pmod(luhn_sum(d, 1), F.lit(10))))
                return F.when(~shaped | shape.rlike(_SHAPES), F.coalesce(sum_of == 0, F.lit(False))).otherwise(False)

            return let(F.slice(groups, i + 1, n), test)

        def groups_of_card(i: Column) -> Column:
            sizes = F.sequence(F.least(F.lit(19), F.size(groups) - i), F.lit(1), F.lit(-1))
            return F.coalesce(F.get(F.filter(sizes, lambda n: is_card(i, n)), F.lit(0)), F.lit(0))

        found = F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: F.struct(i.alias("i"), groups_of_card(i).alias("n")))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))

        def step(s: Column, g: Column) -> Column:
            size = F.greatest(g["n"], F.lit(1))
            text = F.call_function("array_join", F.slice(groups, g["i"] + 1, size), sign)
            new = let(text, lambda t: F.when(g["n"] > 0, _card(t, key, invert)).otherwise(t))
            return F.when(g["i"] < s["next"], s).otherwise(F.struct(F.concat(s["out"], F.array(new)).alias("out"), (g["i"] + size).alias("next")))

        return F.call_function("array_join", F.aggregate(found, start, step, lambda s: s["out"]), sign)

    facts = F.struct(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)).alias("groups"), F.regexp_extract(m, "[ -]", 0).alias("sign"), m.rlike(_SHAPED).alias("shaped"))
    return let(facts, run)


def _phone(m: Column, key: str, invert: bool) -> Column:
    all_digits = _digits(m)
    d = F.substring(all_digits, F.char_length(all_digits) - 9, F.lit(10))
    area, exchange, line = (F.substring(d, i, n).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
    x = feistel(((area - 200) * 800 + exchange - 200) * 10_000 + line, _long(800), _long(8_000_000), "phone", key, invert)
    rest = F.pmod(x, _long(8_000_000))
    new = [F.floor(x / 8_000_000) + 200, F.floor(rest / 10_000) + 200, F.lpad(F.pmod(rest, _long(10_000)).cast("string"), 4, "0")]
    prefix = F.when(F.char_length(all_digits) > 10, F.lit("1")).otherwise(F.lit(""))
    return _put(m, F.concat(prefix, *[c.cast("string") for c in new]))


def _social(m: Column, key: str, invert: bool) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    x = feistel((place * 99 + group - 1) * 9_999 + serial - 1, _long(898 * 99), _long(9_999), "social", key, invert)
    head = F.floor(x / 9_999)
    place = F.floor(head / 99)
    area = F.when(place >= 665, place + 2).otherwise(place + 1)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    new = F.concat_ws("-", pad(area, 3), pad(F.pmod(head, _long(99)) + 1, 2), pad(F.pmod(x, _long(9_999)) + 1, 4))
    return F.when(good, new).otherwise(m)


def _address(m: Column, key: str, invert: bool) -> Column:
    part = [F.get(F.split(m, "\\."), F.lit(i)).cast("long") for i in range(4)]
    good = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)
    x = feistel(((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3], _long(65_536), _long(65_536), "address", key, invert)
    new = F.concat_ws(".", *[F.pmod(F.floor(x / 256**i), _long(256)).cast("string") for i in (3, 2, 1, 0)])
    return F.when(good, new).otherwise(m)


def _date(m: Column, key: str, invert: bool) -> Column:
    form = F.when(F.substring(m, 5, 1) == "-", "yyyy-MM-dd").when(F.substring(m, 3, 1) == ".", "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    iso = F.when(form == "yyyy-MM-dd", m).when(form == "dd.MM.yyyy", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(
        F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))
    )
    first = F.lit("1900-01-01").cast("date")
    x = F.datediff(iso.try_cast("date"), first).cast("long")
    good = (x >= 0) & (x < 17 * 4_297)
    day = F.date_add(first, feistel(x, _long(17), _long(4_297), "date", key, invert).cast("int"))
    new = F.when(form == "yyyy-MM-dd", F.date_format(day, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return F.when(good, new).otherwise(m)


def _mail(m: Column, key: str) -> Column:
    told = F.sha2(F.concat_ws(":", F.lit(key), F.lit("mail"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(told, 1, 16), F.lit("@pseudonym.invalid"))


def pseudonym(m: Column, key: str, invert: bool = False) -> Column:
    """The pseudonym of one match of ``ANY``; what fails its validator stays."""
    mail = m if invert else _mail(m, key)
    out = F.when(F.contains(m, F.lit("@")), mail).when(_whole(m, "address"), _address(m, key, invert)).when(_whole(m, "date"), _date(m, key, invert))
    return out.when(_whole(m, "social"), _social(m, key, invert)).when(_whole(m, "phone"), _phone(m, key, invert)).otherwise(_cards(m, key, invert))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", invert: bool = False, count_col: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced; every other column is unchanged.

    A null text stays null, an empty one empty. Rows are treated one by one, so repeated rows,
    null ids and empty tables need no rule. ``count_col`` adds the number of values changed.
    """
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    some = text.rlike(_QUICK)
    found, parts, new = (free_name(docs, x) for x in ("found", "parts", "new"))
    out = docs.withColumn(found, F.when(some, matches_of(text, ANY)))
    any_found = F.size(found) > 0
    out = out.withColumn(parts, F.when(any_found, parts_of(text, ANY)))
    out = out.withColumn(new, F.when(any_found, F.transform(found, lambda m: pseudonym(m, key, invert))))
    told = F.when(any_found, replaced(F.col(parts), F.col(new), lambda m: m)).otherwise(text)
    if count_col:
        changed = F.size(F.filter(F.zip_with(found, new, lambda x, y: x != y), lambda x: x)).cast("long")
        out = out.withColumn(count_col, F.when(any_found, changed).otherwise(F.lit(0).cast("long")))
    return out.withColumn(text_col, told).drop(found, parts, new)
