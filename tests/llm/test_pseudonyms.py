"""Pseudonyms against a plain Feistel network, and their formats."""

import datetime
import hashlib
import random
import re

import pytest

from llm_fixtures import docs, folder, odd  # noqa: F401

from velum.llm import pseudonyms as P


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def shift(c, by, letters):
    for first, size in (("0", 10), ("a", letters), ("A", letters)):
        if c.isascii() and (c.isdigit() if first == "0" else c.islower() if first == "a" else c.isupper()):
            return chr(ord(first) + (ord(c) - ord(first) + by) % size)
    return c


def feistel_text(s, key, kind, letters=26):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(1, P.ROUNDS + 1):
        h = digest(key, kind, r, len(left), right)
        left, right = right, "".join(shift(c, int(h[j % 31 * 2 : j % 31 * 2 + 2], 16), letters) for j, c in enumerate(left))
    return left + right


def feistel_pair(x, y, sizes, key, kind):
    for r in range(1, P.ROUNDS + 1):
        size = sizes[0] if r % 2 else sizes[1]
        x, y = y, (x + int(digest(key, kind, r, y)[:15], 16)) % size
    return x, y


def luhn(s):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(s))) % 10 == 0


def card(s):
    d = s.replace(" ", "").replace("-", "")
    if not luhn(d):
        return s
    body = feistel_text(d[:-1], "k", "card")
    new = iter(next(body + c for c in "0123456789" if luhn(body + c)))
    return "".join(next(new) if c.isdigit() else c for c in s)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, values, key="k"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(4)
    return [r.p for r in sorted(df.select("i", P.pseudonymised("t", key).alias("p")).collect())]


def test_cards_addresses_and_dates_by_a_plain_network(spark):
    pick = random.Random(1)
    cards = ["".join(pick.choice("0123456789") for _ in range(16)) for _ in range(60)] + ["4111 1111 1111 1111", "4111-1111-1111-1112"]
    got = [r.text for r in run(spark, cards)]
    assert got == list(map(card, cards))
    ips = [".".join(str(pick.randrange(256)) for _ in range(4)) for _ in range(30)]
    want = []
    for a, b, c, d in (map(int, ip.split(".")) for ip in ips):
        x, y = feistel_pair(a * 256 + b, c * 256 + d, (65536, 65536), "k", "ipv4")
        want.append(f"{x // 256}.{x % 256}.{y // 256}.{y % 256}")
    assert [r.text for r in run(spark, ips)] == want
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(pick.randrange(73049)) for _ in range(30)]
    first = datetime.date(1900, 1, 1)
    want = []
    for d in days:
        x, y = feistel_pair(*divmod((d - first).days, 4297), (17, 4297), "k", "date")
        want.append(str(first + datetime.timedelta(x * 4297 + y)))
    assert [r.text for r in run(spark, list(map(str, days)))] == want


def test_formats_stay_valid_and_values_apart(spark):
    ssn = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)]
    got = [r.text for r in run(spark, ssn)]
    assert len(set(got)) == len(ssn)
    for s in got:
        a, g, n = map(int, s.split("-"))
        assert 0 < a < 900 and a != 666 and g and n
    ibans = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    for old, r in zip(ibans, run(spark, ibans)):
        assert r.replaced == 1 and r.text != old and mod97(r.text.replace(" ", "")) == 1 and r.text[:2] == old[:2]
        assert re.sub("[0-9]", "9", re.sub("[A-Z]", "A", r.text)) == re.sub("[0-9]", "9", re.sub("[A-Z]", "A", old))
    dates = ["2020-02-29", "31.12.1999", "25/12/2020", "12/25/2020"]
    for old, r in zip(dates, run(spark, dates)):
        assert r.replaced == 1 and r.text != old and re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", old)


def test_equal_values_stay_linked_in_any_text(spark):
    a, b = run(spark, ["Und.34@mail7.example.com, +1 (017) 555-7713, 97.51.17.173.", "x 97.51.17.173!! +1 (017) 555-7713&&& <Und.34@mail7.example.com>"])
    assert a.replaced == b.replaced == 3
    mail, phone, ip = re.fullmatch(r"(\S+), (\+1 \(\d{3}\) \d{3}-\d{4}), ([\d.]+)\.", a.text).groups()
    assert b.text == f"x {ip}!! {phone}&&& <{mail}>" and mail.endswith("@mail7.example.com") and mail[:3].isalpha()
    assert run(spark, ["97.51.17.173"], "k")[0].text != run(spark, ["97.51.17.173"], "other")[0].text


@pytest.mark.parametrize("text", ["4111111111111112", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "666-12-3456", "2020-13-45", "1850-01-01", "version 3.14",
                                  "1,234,567", "12:30", "License 2.0.", "DE00370400440532013000", "a@b", "", "no numbers", "1990 2020", "abc123"])
def test_what_fails_its_check_stays(spark, text):
    assert tuple(run(spark, [text])[0]) == (text, 0)


def test_odd_rows(spark, docs, odd, folder):
    from velum.llm.queries import QUERIES

    rows = [*odd, (20, "ip 97.51.17.173 " * 5000), (21, "1" * 100_000), (22, "a." * 50_000 + "@")]
    got = {r.doc_id: r for r in QUERIES["op2_pii_pseudonyms"](spark, folder(documents=docs(rows, clash=True))).collect()}
    assert got[1].text is None and got[1].n_replaced == 0 and got[2].text == "" and got[20].n_replaced == 5000
    assert all(got[i].text == t for i, t in rows if i != 20)
    assert QUERIES["op2_pii_pseudonyms"](spark, folder(documents=docs([]))).collect() == []


def test_no_python_in_the_plan(spark, sf):
    import contextlib
    import io

    from velum.llm.queries import QUERIES

    with contextlib.redirect_stdout(io.StringIO()) as plan:
        QUERIES["op2_pii_pseudonyms"](spark, sf).explain("formatted")
    assert "Scan" in plan.getvalue() and not re.search("Python|Arrow|Pandas", plan.getvalue())


CARD, ES, BE, AT = "4111 1111 1111 1111", "ES9121000418450200051332", "BE68539007547034", "AT611904300234573201"


@pytest.mark.parametrize("text, value", [
    (f"{CARD} 123", CARD), (f"order 2025 {CARD}", CARD), (f"12-34 {CARD} 99 2", CARD), (f"AB12 {CARD}", CARD), ("7 123-45-6789 5555", "123-45-6789"),
    ("1 2021-03-04 1234567", "2021-03-04"), (f"{ES} EUR", ES), (f"{BE} PAID", BE), (f"{AT} 1200", AT), (f"AB12 {ES} EUR 7", ES),
    ("ES91 2100 0418 4502 0005 1332 EUR", "ES91 2100 0418 4502 0005 1332"), (f"{CARD} 12abc", CARD)])
def test_a_failed_run_is_searched_for_the_value_in_it(spark, text, value):
    alone, within = run(spark, [value, text])
    assert alone.text != value and alone.replaced == 1
    assert within.text == text.replace(value, alone.text) and within.replaced == 1


def test_two_values_in_one_run(spark):
    a, b = "4111 1111 1111 1111", "5500 0000 0000 0004"
    x, y, both, phones = run(spark, [a, b, f"{a} {b} 77", "555-123-4567 555-123-4568"])
    assert tuple(both) == (f"{x.text} {y.text} 77", 2) and phones.replaced == 2


@pytest.mark.parametrize("text, values", [
    ("4111111111111111,2021-03-04", ("4111111111111111", "2021-03-04")), ("123-45-6789,2", ("123-45-6789",)), ("1,2021-03-04,1", ("2021-03-04",)),
    ("2021-03-04T10:00:00", ("2021-03-04",)), ("2021-03-04/2021-03-09", ("2021-03-04", "2021-03-09")), ("7,97.51.17.173,5", ("97.51.17.173",)),
    ("97.51.17.173/24", ("97.51.17.173",)), ("31.12.1999-25.12.2020", ("31.12.1999", "25.12.2020")), ("2021-03-04Z", ("2021-03-04",))])
def test_neighbouring_fields_do_not_hide_a_value(spark, text, values):
    whole, *alone = run(spark, [text, *values])
    want = text
    for value, r in zip(values, alone):
        assert r.text != value
        want = want.replace(value, r.text)
    assert tuple(whole) == (want, len(values))


@pytest.mark.parametrize("text", ["0.4111111111111111", "4111111111111111.5", "1.2021-03-04-5", "97.51.17.173.4", "123-45-6789-1", "2021-03-04Tea",
                                  "123.456.789,12"])
def test_a_part_of_a_longer_number_stays(spark, text):
    assert tuple(run(spark, [text])[0]) == (text, 0)


def plain_slash(s):
    """The permutation of dates with slashes, by a plain network."""
    a, b, y = (int(x) for x in s.split("/"))
    day, month = max(a, b), min(a, b)
    show = lambda d, m, year: f"{d:02d}/{m:02d}/{year:04d}" if a > b else f"{m:02d}/{d:02d}/{year:04d}"
    late = [(m, d) for m in range(1, 13) for d in range(13, 32) if d <= [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]]
    if not 1900 <= y <= 2099 or not 1 <= month <= 12:
        return s
    if day <= 12:
        x, year = feistel_pair((a - 1) * 12 + b - 1, y - 1900, (144, 200), "k", "date/")
        return f"{x // 12 + 1:02d}/{x % 12 + 1:02d}/{year + 1900:04d}"
    if (month, day) == (2, 29) and (y % 4 == 0 and (y % 100 or y % 400 == 0)):
        x, z = feistel_pair((y - 1904) // 4 // 7, (y - 1904) // 4 % 7, (7, 7), "k", "leap/")
        return show(29, 2, 1904 + 4 * (x * 7 + z))
    if (month, day) not in late:
        return s
    x, year = feistel_pair(late.index((month, day)), y - 1900, (len(late), 200), "k", "late/")
    return show(late[x][1], late[x][0], year + 1900)


def test_all_dates_with_slashes_stay_apart(spark):
    """Every string that is a date in one of its readings: as many pseudonyms as dates, each a date in the same order."""
    valid = lambda d, m, y: m <= 12 and d <= (datetime.date(y + (m == 12), m % 12 + 1, 1) - datetime.timedelta(1)).day
    dates = [f"{a:02d}/{b:02d}/{y}" for y in range(1900, 2100) for a in range(1, 32) for b in range(1, 32) if valid(a, b, y) or valid(b, a, y)]
    got = [r.text for r in run(spark, dates)]
    assert len(dates) == len(set(got)) == 117_298 and set(got) == set(dates)
    pick = random.Random(1).sample(range(len(dates)), 400)
    assert [got[i] for i in pick] == [plain_slash(dates[i]) for i in pick]
    wrong = ["29/02/1900", "31/04/2000", "02/30/2020", "00/10/2000", "13/13/2000", "31/12/1899", "01/01/2100"]
    assert [r.text for r in run(spark, wrong)] == wrong


def test_cost_follows_the_values_of_a_run(spark):
    import time

    def seconds(n):
        text = " ".join(f"{4 * 10**15 + i * 10 + next(c for c in range(10) if luhn(str(4 * 10**15 + i * 10 + c)))}" for i in range(n))
        start = time.perf_counter()
        assert run(spark, [text])[0].replaced == n
        return time.perf_counter() - start

    seconds(50)
    few, many = seconds(500), seconds(2000)
    assert many < 6 * max(few, 1.0)
