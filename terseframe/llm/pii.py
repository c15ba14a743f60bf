"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions alone.

Validated numbers, dates and addresses are permuted under a key within the set of values of their own
format: the value becomes a list of digits of mixed radix, an unbalanced Feistel network of
:data:`ROUNDS` rounds permutes that list (each round adds a keyed digest of one half to the other, place
by place, modulo the radices), and the result is written in the original's layout. It is a bijection of
the format, so equal values stay equal in all documents and different ones stay different.

==========  =====================================================================================
email       letters and digits of the local part, each within its class; the domain stays. Parts are as
            long as addresses allow: 64 characters before the sign, labels of 63, 127 labels
ip          all four octets
date        year-month-day, month/day/year (day/month/year where the first is over 12) and
            day.month.year; one day has one pseudonym in all layouts, among the days of its 400 years (1800 to
            2199, and those before and after) that are over 12 as well or are not, so no two days share one
ssn         area (001-899 but 666), group (01-99) and serial (0001-9999)
phone       the last ten digits; the first digits of area and exchange stay in 2-9 or in 0-1
iban        letters and digits after the check digits, if those are right; they are made anew
card        13 to 19 digits that pass the Luhn test: all between the first and the check digit
==========  =====================================================================================

What fails validation stays as it is. The key is the caller's; who has it can invert the pseudonyms. No
pattern repeats a group without a bound, so long texts do not exhaust the stack. Defined cases: a null text stays null and an empty one empty;
repeated rows get equal texts; texts are searched whole; extra columns pass through; output columns
replace equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 10
#: Steps of a walk along the permutation of months and days over 12 until it meets a day that exists (97 % of them do).
WALK = 16

_FREE = r"(?<![0-9A-Za-z])"
_END = r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "date": rf"(?<![0-9A-Za-z/.-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})(?![0-9A-Za-z]|[/-][0-9])",
    "ssn": rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z]|-[0-9])",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}){_END}",
    "iban": rf"{_FREE}[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}{_END}",
    "card": rf"{_FREE}(?:[0-9]{{13,19}}|[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_END}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _hex(h: Column, at: Column) -> Column:
    return F.conv(F.substr(h, (at % 10) * 6 + 1, F.lit(6)), 16, 10).cast("int")


def feistel(values: Column, radices: Column, tweak: Column, key: str) -> Column:
    """Permute ``values`` (array<int>, each below its radix) among all lists with these radices and this tweak."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def add(side: Column, radix: Column, other: Column, i: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        return _let(F.sha2(said.cast("binary"), 256), lambda h: F.transform(side, lambda x, j: F.pmod(x + _hex(h, j), F.get(radix, j))))

    left_radix, right_radix = F.slice(radices, F.lit(1), half), F.slice(radices, half + 1, n - half)
    start = F.struct(F.slice(values, F.lit(1), half).alias("l"), F.slice(values, half + 1, n - half).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(add(s["l"], left_radix, s["r"], i).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), add(s["r"], right_radix, s["l"], i).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return _let(end, lambda s: F.concat(s["l"], s["r"]))


def _chars(m: Column) -> Column:
    return F.filter(F.split(m, ""), lambda c: c != "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _place(value: Column, radix: Column, base: Column) -> Column:
    return F.struct(value.cast("int").alias("v"), radix.cast("int").alias("r"), base.cast("int").alias("b"))


def _fixed(c: Column) -> Column:
    return _place(F.lit(0), F.lit(1), F.ascii(c))


def _by_class(c: Column) -> Column:
    a = F.ascii(c)
    return (
        F.when(a.between(48, 57), _place(a - 48, F.lit(10), F.lit(48)))
        .when(a.between(97, 122), _place(a - 97, F.lit(26), F.lit(97)))
        .when(a.between(65, 90), _place(a - 65, F.lit(26), F.lit(65)))
        .otherwise(_fixed(c))
    )


def _permute_chars(places: Column, tweak: str, key: str) -> Column:
    """Text of the places after permutation; the layout (radices and bases) is part of the tweak."""

    def moved(p: Column) -> Column:
        shape = F.concat_ws("|", F.lit(tweak), F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["r"].cast("string"), F.when(x["r"] > 1, x["b"]).otherwise(0).cast("string"))), ","))
        # places of radix 1 would be idle halves of the network, so only the others take part
        free = F.filter(p, lambda x: x["r"] > 1)
        out = feistel(F.transform(free, lambda x: x["v"]), F.transform(free, lambda x: x["r"]), shape, key)
        rank = lambda i: F.size(F.filter(F.slice(p, F.lit(1), i + 1), lambda x: x["r"] > 1))
        return _let(out, lambda o: F.array_join(F.transform(p, lambda x, i: F.when(x["r"] > 1, F.chr(x["b"] + F.get(o, rank(i) - 1))).otherwise(F.chr(x["b"]))), ""))

    return _let(places, moved)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit being the check digit."""
    n = F.length(digits)

    def step(s: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return s + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def mod97(text: Column) -> Column:
    """ISO 7064 remainder of a text of digits and capital letters."""

    def step(s: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a.between(48, 57), (s * 10 + a - 48) % 97).otherwise((s * 100 + a - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    places = F.transform(_chars(local), _by_class)
    return F.concat(_permute_chars(places, "email", key), F.substr(m, F.length(local) + 1))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(feistel(octets, F.array_repeat(F.lit(256), 4), F.lit("ip"), key), lambda x: x.cast("string")), ".")


def _date(m: Column, key: str) -> Column:
    iso = F.contains(m, F.lit("-"))
    slash = F.contains(m, F.lit("/"))
    parts = F.split(m, "[-/.]")

    def done(p: Column) -> Column:
        day_first = ~slash | (p[0].cast("int") > 12)
        year = F.when(iso, p[0]).otherwise(p[2])
        month = F.when(iso, p[1]).when(day_first, p[1]).otherwise(p[0])
        day = F.when(iso, p[2]).when(day_first, p[0]).otherwise(p[1])
        when = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")

        def shifted(d: Column) -> Column:
            y, high = F.year(d), F.dayofmonth(d) > 12
            era = F.floor((y + 200) / 400)  # the years of an era are 400 but for the first and last, which have 200
            first = F.greatest(F.lit(0), era * 400 - 200)
            months = F.when((era == 0) | (era == 25), 2400).otherwise(4800)
            place = F.array(((y - first) * 12 + F.month(d) - 1).cast("int"), (F.dayofmonth(d) - F.when(high, 13).otherwise(1)).cast("int"))
            radices = F.array(months.cast("int"), F.when(high, 19).otherwise(12).cast("int"))
            tweak = F.concat(F.lit("date|"), era.cast("string"), F.when(high, F.lit("|high")).otherwise(F.lit("|low")))

            def day_of(v: Column) -> Column:
                of_month = F.make_date((first + F.floor(v[0] / 12)).cast("int"), (v[0] % 12 + 1).cast("int"), F.lit(1))
                there = F.date_add(of_month, v[1] + F.when(high, 12).otherwise(0))
                return F.when(F.month(there) == F.month(of_month), there)  # null: no such day

            def step(s: Column, _: Column) -> Column:
                return F.when(s["day"].isNotNull(), s).otherwise(_let(feistel(s["v"], radices, tweak, key), lambda v: F.struct(v.alias("v"), day_of(v).alias("day"))))

            start = F.struct(place.alias("v"), F.lit(None).cast("date").alias("day"))
            new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step)["day"]
            two = lambda x, old: F.when(F.length(old) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

            def written(n: Column) -> Column:
                y, mo, da = F.lpad(F.year(n).cast("string"), 4, "0"), two(F.month(n), month), two(F.dayofmonth(n), day)
                sep = F.when(slash, "/").otherwise(".")
                return F.when(iso, F.concat_ws("-", y, mo, da)).when(day_first, F.concat(da, sep, mo, sep, y)).otherwise(F.concat(mo, sep, da, sep, y))

            return _let(new, lambda n: F.when(n.isNull(), m).otherwise(written(n)))

        return _let(when, lambda d: F.when(d.isNull(), m).otherwise(shifted(d)))

    return _let(parts, done)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    out = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = _let(out, lambda v: F.concat_ws("-", pad(F.when(v[0] >= 665, v[0] + 2).otherwise(v[0] + 1), 3), pad(v[1] + 1, 2), pad(v[2] + 1, 4)))
    return F.when(valid, text).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    chars = _chars(m)

    def place(c: Column, i: Column) -> Column:
        after = F.length(_digits(F.substr(m, i + 2)))
        a = F.ascii(c)
        lead = F.when(a >= 50, _place(a - 50, F.lit(8), F.lit(50))).otherwise(_place(a - 48, F.lit(2), F.lit(48)))
        return F.when(~a.between(48, 57) | (after >= 10), _fixed(c)).when(after.isin(9, 6), lead).otherwise(_place(a - 48, F.lit(10), F.lit(48)))

    # the country code and separators are layout, not value: equal numbers stay equal in every layout
    free = lambda p: F.filter(p, lambda x: x["r"] > 1)

    def moved(p: Column) -> Column:
        f = free(p)
        shape = F.concat_ws("|", F.lit("phone"), F.array_join(F.transform(f, lambda x: x["r"].cast("string")), ","))
        out = feistel(F.transform(f, lambda x: x["v"]), F.transform(f, lambda x: x["r"]), shape, key)
        rank = lambda i: F.size(free(F.slice(p, F.lit(1), i + 1)))
        return _let(out, lambda o: F.array_join(F.transform(p, lambda x, i: F.when(x["r"] > 1, F.chr(x["b"] + F.get(o, rank(i) - 1))).otherwise(F.chr(x["b"]))), ""))

    return _let(F.transform(chars, place), moved)


def _iban(m: Column, key: str) -> Column:
    valid = mod97(F.concat(F.substr(m, F.lit(5)), F.substr(m, F.lit(1), F.lit(4)))) == 1
    places = F.transform(_chars(F.substr(m, F.lit(5))), _by_class)

    def checked(b: Column) -> Column:
        country = F.substr(m, F.lit(1), F.lit(2))
        return F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)

    return F.when(valid, _let(_permute_chars(places, "iban", key), checked)).otherwise(m)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    middle = F.transform(_chars(F.substr(digits, F.lit(2), n - 2)), _by_class)
    tweak = F.concat(F.lit("card|"), n.cast("string"), F.lit("|"), F.substr(digits, F.lit(1), F.lit(1)))
    out = feistel(F.transform(middle, lambda x: x["v"]), F.transform(middle, lambda x: x["r"]), tweak, key)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.array_join(F.transform(out, lambda x: x.cast("string")), ""))

    def checked(b: Column) -> Column:
        full = F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
        laid = lambda f: F.array_join(F.transform(_chars(m), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(f, F.length(_digits(F.substr(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
        return _let(full, laid)

    return F.when(luhn_sum(digits) % 10 == 0, _let(body, checked)).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of :data:`ANY`; the kind is the first whose pattern the match has."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    out = F.when(F.contains(m, F.lit("@")), _email(m, key))
    for kind, made in (("ip", _ip), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("iban", _iban)):
        out = out.when(whole(kind), made(m, key))
    return out.otherwise(_card(m, key))


def scrub(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with pseudonyms under ``key`` in ``column`` and their number in ``n_pseudonyms``.

    Only texts with a digit or an at sign are searched at all.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_pseudonyms"]
    held = unused("_found", docs)
    found, text = F.col(held), F.col(f"`{column}`")
    rows = docs.select(*keep, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias(held))
    changed = F.transform(found, lambda m: pseudonym(m, key))
    rows = rows.select(*keep, F.when(F.size(found) > 0, F.struct(found.alias("old"), changed.alias("new"))).alias(held))
    # a split with limit -1 has one gap more than there are matches
    gaps = F.split(text, ANY, -1)
    filled = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found["new"])), found["new"], lambda a, b: F.concat(a, b)), ""), F.element_at(gaps, -1))
    n = F.size(F.filter(F.arrays_zip(found["old"], found["new"]), lambda x: x["old"] != x["new"])).cast("long")
    out = [F.when(found.isNull(), text).otherwise(filled).alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_pseudonyms"]
    return rows.select(*out, F.coalesce(F.when(found.isNotNull(), n), F.lit(0)).cast("long").alias("n_pseudonyms"))
