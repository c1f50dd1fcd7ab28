"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel networks in SQL functions.

A value that passes its check is permuted among the values of its format that pass: card numbers
(Luhn) and IBANs (mod 97) get new check digits, social security numbers, IPv4 addresses and dates
(1900 to 2099) stay valid, phone numbers keep country code and layout, mail addresses their domain and
layout, long hexadecimal secrets their layout. The permutation depends on the key alone, so equal
values get equal pseudonyms in all documents, and different values of a format different ones.
Numbers that fail their check are no such numbers and stay.

Null texts stay null with no replacement; empty texts stay empty. A text of any length is taken whole
in one pass; cost grows with its length and its hits. Repeated rows get repeated results, and other
columns stay as they are, whatever their names, as the functions are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.functions.spans import below, chain

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days from 1900 to 2099

# --- formats, in the order in which they are tried
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"
SECRET = r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}|[0-9]{3}[.-][0-9]{3}|(?<=[0-9][ .-])[0-9]{2,4}[ .-][0-9]{3,4})(?:[ .-]?[0-9]{2,4}){1,3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
# --- a value ends where a neighbour cannot continue its own format
_WORD_BEFORE, _WORD_AFTER = r"(?<![A-Za-z0-9_@])", r"(?![A-Za-z0-9_@])"
_MAIL_BEFORE = r"(?<![A-Za-z0-9._%+-])"


def _between(pattern: str, separators: str, after: str = _WORD_AFTER) -> str:
    """``pattern`` where no digit stands behind one of ``separators`` beside it."""
    return rf"{_WORD_BEFORE}(?<![0-9][{separators}])(?:{pattern}){after}(?![{separators}][0-9])"


#: A time (``T10:00``) or a zone (``Z``) may follow a date at once.
_DAY_AFTER = r"(?![0-9_@A-SU-Ya-z]|T(?![0-9])|Z[A-Za-z0-9_])"
_DATES = "|".join(_between(d, s, _DAY_AFTER) for d, s in (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "-"), (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "."), (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "/")))
#: Runs of groups, in which any groups in a row may be an IBAN or a card number.
_GROUP = r"[A-Z0-9]++(?![a-z_@])(?!\.[0-9])"
RUN = rf"{_WORD_BEFORE}(?<![0-9]\.)(?=[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11}}|[0-9](?:[ -]?[0-9]){{12}}){_GROUP}(?:[ -]{_GROUP})*+"
#: Dots before a comma and digits group the thousands of an amount.
_PHONE_AFTER = rf"{_WORD_AFTER}(?!(?<=\.[0-9]{{3}}),[0-9])"
#: Tried one after another, the run between the two others, on what is left of the text.
FIXED = "|".join((
    rf"{_MAIL_BEFORE}{EMAIL}", rf"{_WORD_BEFORE}{SECRET}{_WORD_AFTER}", _between(SSN, "-"), _DATES, _between(IPV4, "."),
    _between(rf"(?=\+){PHONE}", ".-", _PHONE_AFTER)))
PHONES = tuple(_between(p, ".-", _PHONE_AFTER) for p in (PHONE, PHONE.removesuffix("{1,3}")))
CARD_LAYOUTS = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
#: Length of a country's IBANs; among several candidates the one of this length is taken.
IBAN_LENGTHS = {n: c.split() for n, c in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST LY",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items()}


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256)


def _shift(c: Column, by: Column, letters: int) -> Column:
    """A digit or letter moved ``by`` places within its kind; any other character as it is."""

    def among(first: int, size: int) -> Column:
        return F.chr(first + (F.ascii(c) - first + by) % size)

    return (
        F.when(c.rlike("^[0-9]$"), among(48, 10))
        .when(c.rlike("^[a-z]$"), among(97, letters))
        .when(c.rlike("^[A-Z]$"), among(65, letters))
        .otherwise(c)
    )


def feistel_text(s: Column, key: str, kind: str, letters: int = 26) -> Column:
    """A keyed permutation of the strings with the same kinds of characters in the same places."""

    def one_round(state: Column, number: Column) -> Column:
        def moved(digest: Column) -> Column:
            half = F.transform(_chars(state["l"]), lambda c, j: _shift(c, _number(F.substr(digest, (j % 31) * 2 + 1, F.lit(2))).cast("int"), letters))
            return F.struct(state["r"].alias("l"), F.array_join(half, "").alias("r"))

        return _let(_keyed(key, F.lit(kind), number, F.length(state["l"]), state["r"]), moved)

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, lambda state: F.concat(state["l"], state["r"]))


def feistel_pair(x: Column, y: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of the pairs ``(x, y)`` below ``sizes``, as ``struct<x, y>``."""

    def one_round(state: Column, number: Column) -> Column:
        size = F.when(number % 2 == 1, F.lit(sizes[0])).otherwise(F.lit(sizes[1])).cast("long")
        by = _number(F.substr(_keyed(key, F.lit(kind), number, state["y"]), F.lit(1), F.lit(15)))
        return F.struct(state["y"].alias("x"), ((state["x"] + by % size) % size).alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def _luhn_sum(digits: Column, first: int) -> Column:
    """Sum with every second digit doubled, from the right; the last digit has weight ``first``."""
    weighted = F.transform(_chars(F.reverse(digits)), lambda c, j: c.cast("int") * F.when(j % 2 == 0, first).otherwise(3 - first))
    return F.aggregate(weighted, F.lit(0), lambda total, v: total + F.when(v > 9, v - 9).otherwise(v))


def _mod97(s: Column) -> Column:
    """An IBAN without blanks modulo 97, its first four characters taken last."""

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))), F.lit(0), step)


def _laid_out(layout: Column, kept: str, plain: Column) -> Column:
    """``plain`` character by character in the places of ``layout`` whose characters are in the set ``kept``."""
    places = F.transform(_chars(layout), lambda c, j: F.when(
        c.rlike(f"^[{kept}]$"),
        F.substr(plain, F.length(F.regexp_replace(F.substr(layout, F.lit(1), (j + 1).cast("int")), f"[^{kept}]", "")), F.lit(1))).otherwise(c))
    return F.array_join(places, "")


def _card(h: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        def checked(body: Column) -> Column:
            return F.concat(body, ((10 - _luhn_sum(body, 2) % 10) % 10).cast("string"))

        body = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return F.when(_luhn_sum(digits, 1) % 10 == 0, _let(_let(body, checked), lambda new: _laid_out(h, "0-9", new)))

    return _let(F.regexp_replace(h, "[ -]", ""), of)


def _iban(h: Column, key: str) -> Column:
    def of(plain: Column) -> Column:
        def checked(body: Column) -> Column:
            country = F.substr(plain, F.lit(1), F.lit(2))
            check = 98 - _mod97(F.concat(country, F.lit("00"), body))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

        body = feistel_text(F.substr(plain, F.lit(5), F.length(plain)), key, "iban")
        valid = (F.length(plain) >= 15) & (F.length(plain) <= 34) & (_mod97(plain) == 1)
        return F.when(valid, _let(_let(body, checked), lambda new: _laid_out(h, "A-Z0-9", new)))

    return _let(F.regexp_replace(h, " ", ""), of)


def _ssn(h: Column, key: str) -> Column:
    area, group, serial = (F.substr(h, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1

    def shown(p: Column) -> Column:
        a = F.floor(p["x"] / 99)
        return F.format_string("%03d-%02d-%04d", F.when(a >= 665, a + 2).otherwise(a + 1), p["x"] % 99 + 1, p["y"] + 1)

    return F.when(valid, _let(feistel_pair(index, serial - 1, (898 * 99, 9999), key, "ssn"), shown))


def _ipv4(h: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        def shown(p: Column) -> Column:
            halves = [F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256]
            return F.concat_ws(".", *(x.cast("string") for x in halves))

        pair = feistel_pair(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], (65536, 65536), key, "ipv4")
        return F.when(F.array_max(parts) <= 255, _let(pair, shown))

    return _let(F.split(h, r"\.").cast("array<int>"), of)


def _date(h: Column, key: str) -> Column:
    def of(format: str, shape: str) -> Column:
        def permuted(day: Column) -> Column:
            n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
            pair = feistel_pair(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date")
            back = _let(pair, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAYS[1] + p["y"]).cast("int")), format))
            return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), back)

        return F.when(h.rlike(shape), _let(F.try_to_date(h, format), permuted))

    return F.coalesce(of("yyyy-MM-dd", r"^\d{4}-"), of("dd.MM.yyyy", r"^\d{2}\."), F.when(h.rlike(r"^\d{2}/"), _slash_date(h, key)))


#: Days of the months, and days from the 13th on in the months before each, without leap days.
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_LATE_BEFORE = tuple(sum(_MONTHS[:m]) - 12 * m for m in range(12))
_LATE = sum(_MONTHS) - 12 * 12
YEARS, LEAP_DAYS = (1900, 200), (1904, 49)  # first and number of the years, and of the leap years, which are four years apart


def _slash_date(h: Column, key: str) -> Column:
    """Dates with slashes may be read day first or month first, so the strings are permuted that are a date in either
    reading: those with two numbers up to 12 among themselves; those with a later day among the strings of their order
    of day and month; leap days among leap days. Every string has one place in one of these, so none is made twice.
    """
    a, b, year = (F.substr(h, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 2), (4, 2), (7, 4)))

    def of(d: Column) -> Column:
        a, b, year = d["a"], d["b"], d["year"]
        day, month, day_first = F.greatest(a, b), F.least(a, b), a > b
        leap = (month == 2) & (day == 29) & (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))

        def table(values: tuple[int, ...], at: Column) -> Column:
            return F.get(F.array(*map(F.lit, values)), at)

        def shown(p: Column, q: Column, y: Column) -> Column:
            return F.format_string("%02d/%02d/%04d", p.cast("int"), q.cast("int"), y.cast("int"))

        def ordered(day_: Column, month_: Column, y: Column) -> Column:
            return F.when(day_first, shown(day_, month_, y)).otherwise(shown(month_, day_, y))

        def late(p: Column) -> Column:
            month_ = F.size(F.filter(F.array(*map(F.lit, _LATE_BEFORE)), lambda n: n <= p["x"]))
            return ordered(p["x"] - table(_LATE_BEFORE, month_ - 1) + 13, month_, p["y"] + YEARS[0])

        early = feistel_pair((a - 1) * 12 + b - 1, year - YEARS[0], (144, YEARS[1]), key, "date/")
        late_ = feistel_pair(table(_LATE_BEFORE, month - 1) + day - 13, year - YEARS[0], (_LATE, YEARS[1]), key, "late/")
        number = F.floor((year - LEAP_DAYS[0]) / 4)
        leap_ = feistel_pair(F.floor(number / 7), number % 7, (7, LEAP_DAYS[1] // 7), key, "leap/")
        return F.when(~year.between(YEARS[0], YEARS[0] + YEARS[1] - 1) | (month < 1) | (month > 12), None).when(
            day <= 12, _let(early, lambda p: shown(F.floor(p["x"] / 12) + 1, p["x"] % 12 + 1, p["y"] + YEARS[0]))).when(
            leap, _let(leap_, lambda p: ordered(F.lit(29), F.lit(2), LEAP_DAYS[0] + 4 * (p["x"] * 7 + p["y"])))).when(
            day <= table(_MONTHS, month - 1), _let(late_, late))

    return _let(F.struct(a.alias("a"), b.alias("b"), year.alias("year")), of)


def _phone(h: Column, key: str) -> Column:
    def of(code: Column) -> Column:
        rest = F.substr(h, F.length(code) + 1, F.length(h))
        digits = F.regexp_replace(rest, "[^0-9]", "")
        new = feistel_text(digits, key, "phone")
        total = F.length(F.regexp_replace(h, "[^0-9]", ""))
        return F.when((total >= 7) & (total <= 15), F.concat(code, _let(new, lambda n: _laid_out(rest, "0-9", n))))

    return _let(F.regexp_extract(h, r"^(\+[0-9]{1,3}(?=[^0-9]))?", 0), of)


def _email(h: Column, key: str) -> Column:
    local = F.substring_index(h, "@", 1)
    return F.concat(feistel_text(local, key, "email"), F.substr(h, F.length(local) + 1, F.length(h)))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value, or null if it fails the check of every format that it has."""
    tried = ((IBAN, _iban), (SSN, _ssn), (DATE, _date), (IPV4, _ipv4), (CARD, _card))
    first = F.coalesce(*(F.when(value.rlike(_whole(p)), f(value, key)) for p, f in tried))
    phone = F.when(value.rlike(r"[ .()-]") & ~value.rlike(rf"{_whole(DATE)}|{_whole(IPV4)}|{_whole(SSN)}|{_whole(CARD)}")
                   & ~value.rlike("[A-Za-z]"), _phone(value, key))
    secret = F.when(value.rlike(_whole(SECRET)) & value.rlike("[A-Fa-f]") & value.rlike("[0-9]"), feistel_text(value, key, "secret", 6))
    return F.when(value.contains("@"), _email(value, key)).otherwise(F.coalesce(secret, first, phone))


def _piece(text: Column, settled: Column | bool) -> Column:
    return F.struct(text.alias("s"), (F.lit(settled) if isinstance(settled, bool) else settled).alias("settled"))


def _usual(s: Column) -> Column:
    """Whether an IBAN without blanks has the length of its country."""
    pairs = [F.lit(c + str(n)) for n, countries in IBAN_LENGTHS.items() for c in countries]
    return F.concat(F.substr(s, F.lit(1), F.lit(2)), F.length(s).cast("string")).isin(*pairs)


def _rank(s: Column, run: Column) -> Column:
    """3 for a card number in a usual layout or an IBAN of its country's length, 2 for another card number, 1 for
    another IBAN, 0 for neither. A card number that is not the whole run has one kind of separator.
    """
    plain = F.regexp_replace(s, "[ -]", "")
    card = s.rlike(_whole(CARD)) & ((s == run) | ~(s.contains(" ") & s.contains("-")))
    iban = s.rlike(_whole(IBAN)) & F.length(plain).between(15, 34)
    return (F.when(card, F.when(_luhn_sum(plain, 1) % 10 != 0, 0).when(s.rlike(_whole(CARD_LAYOUTS)), 3).otherwise(2))
            .when(iban, F.when(_mod97(plain) != 1, 0).when(_usual(plain), 3).otherwise(1)).otherwise(0))


def _in_run(run: Column) -> Column:
    """Pieces of a run: the values in it, from left to right, and what stands between them.

    Of the candidates that start at a group the one of the best rank is taken, the longest if there are several;
    it gives way to one of a better rank that starts within it.
    """

    def of(groups: Column) -> Column:
        def best(i: Column) -> Column:
            def ranked(c: Column) -> Column:
                s = F.regexp_replace(F.array_join(F.slice(groups, i + 1, c), ""), "^[ -]", "")
                return F.struct(_rank(s, run).alias("rank"), c.alias("size"), i.alias("i"), s.alias("s"))

            counts = F.sequence(F.lit(1), F.least(F.lit(34), F.size(groups) - i))
            return F.when(F.get(groups, i).rlike("^[ -]?(?:[A-Z]{2}[0-9]{2}|[0-9])"), F.array_max(F.transform(counts, ranked)))

        def shown(kept: Column) -> Column:
            def one(x: Column, n: Column) -> Column:
                before = F.get(kept, n - 1)
                first = F.coalesce(before["i"] + before["size"], F.lit(0))
                lead = F.regexp_extract(F.get(groups, x["i"]), "^[ -]", 0)
                between = F.concat(F.array_join(F.slice(groups, first + 1, x["i"] - first), ""), lead)
                return F.array(_piece(between, False), _piece(x["s"], True))

            end = F.coalesce(F.array_max(F.transform(kept, lambda x: x["i"] + x["size"])), F.lit(0))
            rest = F.array_join(F.slice(groups, end + 1, F.size(groups)), "")
            return F.concat(F.flatten(F.transform(kept, one)), F.array(_piece(rest, False)))

        def chosen(all_: Column) -> Column:
            # A candidate spans 34 groups at most, so only so many behind it can be within it.
            def beaten(x: Column) -> Column:
                return F.exists(F.slice(all_, x["i"] + 2, x["size"] - 1), lambda y: F.coalesce(y["rank"] > x["rank"], F.lit(False)))

            valid = F.filter(all_, lambda x: F.coalesce(x["rank"] > 0, F.lit(False)) & ~beaten(x))
            # Each leads to the next one that starts behind it.
            following = _let(valid, lambda v: F.transform(below(F.transform(v, lambda x: x["i"]), F.transform(v, lambda x: x["i"] + x["size"])),
                                                          lambda n, i: F.greatest(n, i + 1)))
            return _let(valid, lambda v: F.when(F.size(v) < 2, v).otherwise(F.transform(chain(following), lambda i: F.get(v, i))))

        # One candidate a group, null where none starts.
        return _let(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), best), lambda all_: _let(chosen(all_), shown))

    return _let(F.regexp_extract_all(run, F.lit("[ -]?[^ -]+"), F.lit(0)), of)


def _found(h: Column) -> Column:
    """A hit with a fixed form is settled, whether it passes or not; of phone numbers those of 7 to 15 digits."""
    digits = F.length(F.regexp_replace(h, "[^0-9]", ""))
    fixed = h.contains("@") | h.rlike(rf"{_whole(SSN)}|{_whole(DATE)}|{_whole(IPV4)}|{_whole(SECRET)}")
    return F.array(_piece(h, fixed | digits.between(7, 15)))


def _searched(pieces: Column, pattern: str, found: Callable[[Column], Column]) -> Column:
    """``pieces`` with those that are not settled cut up by ``pattern``; ``found`` gives the pieces of a hit."""

    def cut(p: Column) -> Column:
        between = F.transform(F.split(p["s"], pattern, -1), lambda b: F.array(_piece(b, False)))
        hits = F.transform(F.regexp_extract_all(p["s"], F.lit(pattern), F.lit(0)), found)
        both = F.zip_with(between, hits, lambda b, h: F.when(h.isNull(), b).otherwise(F.concat(b, h)))
        return F.when(p["settled"] | ~p["s"].rlike(pattern), F.array(p)).otherwise(F.flatten(both))

    return F.flatten(F.transform(pieces, cut))


def pseudonymised(text: Column | str, key: str) -> Column:
    """``struct<text, replaced>``: the text with pseudonyms for its values, and how many were replaced.

    Each step searches what the steps before it left, so a hit that fails its check hides no other value.
    """
    text = F.col(text) if isinstance(text, str) else text

    def assembled(new: Column) -> Column:
        replaced = F.size(F.filter(new, lambda n: n["replaced"])).cast("long")
        return F.struct(F.array_join(new["s"], "").alias("text"), replaced.alias("replaced"))

    def shown(p: Column) -> Column:
        made = F.array(F.when(p["settled"], pseudonym(p["s"], key)))
        return F.transform(made, lambda n: F.struct(F.coalesce(n, p["s"]).alias("s"), n.isNotNull().alias("replaced")))[0]

    pieces = F.array(_piece(text, False))
    for pattern, found in ((FIXED, _found), (RUN, _in_run), *((p, _found) for p in PHONES)):
        pieces = _searched(pieces, pattern, found)
    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("replaced"))
    return F.when(text.rlike("[0-9@]"), _let(F.transform(pieces, shown), assembled)).otherwise(none)
