import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from slateql.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def done(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kind int")
    return {r.doc_id: (r.text, [tuple(x) for x in r["__found"] or []]) for r in pii.pseudonymize(df, key).collect()}


def test_formats_and_links(spark):
    values = ["anna.B7@mail.example.com", "4539578763621486", "+1 (017) 555-7713", "192.168.1.254", "2001-12-31", "31.12.2001", "12/31/2001", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "B44E15E09FD311C3CF3163B66D5A9875"]
    found = done(spark, [f"x {v} y, {v}. {v}" for v in values] + values)
    for k, v in enumerate(values):
        text, matches = found[k]
        new = matches[0][2]
        assert text == f"x {new} y, {new}. {new}" and new != v
        assert found[len(values) + k][0] == new  # the same value in another document
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", v))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", new))) or matches[0][0] in ("ip", "secret")
    assert luhn(found[1][1][0][2])
    assert all(int(x) < 256 for x in found[3][1][0][2].split("."))
    day = found[4][1][0][2]
    assert date.fromisoformat(day).strftime("%d.%m.%Y") == found[5][1][0][2]
    assert date.fromisoformat(day).strftime("%m/%d/%Y") == found[6][1][0][2]
    assert re.fullmatch("[0-9a-f]{40}", found[7][1][0][2]) and re.fullmatch("[0-9A-F]{32}", found[8][1][0][2])


@pytest.mark.parametrize("text", ["4539578763621487", "999.1.1.1", "2001-13-31", "31.02.2001", "12345678901234567890123", "1.2.3.4.5", "a4539578763621486", "no one@ here", "+1 (17) 555-7713", "1850-01-01", "2.0.1", "._%+-@mail.example.com"])
def test_what_is_not_valid_stays(spark, text):
    assert done(spark, [f"<{text}>"])[0] == (f"<{text}>", [])


def test_permutation(spark):
    cards = [str(k) for k in range(4000000000000, 4000000020000)]
    cards = [c for c in cards if luhn(c)]
    found = done(spark, [" ".join(cards)])[0][0].split()
    assert len(set(found)) == len(cards) and all(map(luhn, found)) and all(len(c) == 13 for c in found)
    days = spark.range(73_170).select(F.array(F.floor(F.col("id") / 271).cast("int"), (F.col("id") % 271).cast("int")).alias("v"))
    moved = days.select(pii.permuted(F.col("v"), F.array(F.lit(270), F.lit(271)), "date", "k").alias("p"))
    assert moved.distinct().count() == 73_170
    assert moved.where("p[0] < 0 OR p[0] >= 270 OR p[1] < 0 OR p[1] >= 271").count() == 0


def test_keys_differ(spark):
    text = "4539578763621486"
    assert done(spark, [text], "a")[0][0] != done(spark, [text], "b")[0][0]


def test_defined_cases(spark):
    found = done(spark, [None, "", "plain", "w " * 50_000 + "10.0.0.1"])
    assert found[0] == (None, []) and found[1] == ("", []) and found[2] == ("plain", [])
    assert len(found[3][1]) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.pseudonymize(empty, "k").count() == 0
    assert "Python" not in pii.pseudonymize(empty, "k")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind, values", [
    ("card", ["4539 5787 6362 1486", "4539-5787-6362-1486", "3782 822463 10005"]),
    ("phone", ["555-123-4567", "(555) 123-4567", "+49 30 1234567", "+33 1 23 45 67 89", "+34 612 345 678", "+1 555-123-4567", "+15551234567"]),
    ("date", ["31/12/2001", "1.2.2001", "1/2/2001", "2001-1-2"]),
    ("email", ["a@mail.example.com", "7@mail.example.com"]),
])
def test_other_formats(spark, kind, values):
    for v, (text, matches) in zip(values, done(spark, [f"x {v}, y" for v in values]).values()):
        assert [m[:2] for m in matches] == [(kind, v)]
        new = matches[0][2]
        assert new != v and text == f"x {new}, y"
        if kind != "date":
            assert re.sub(r"[0-9a-z]", "9", new) == re.sub(r"[0-9a-z]", "9", v)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new))


def test_one_value_in_several_formats(spark):
    found = done(spark, ["4539578763621486", "4539 5787 6362 1486", "+1 (555) 123-4567", "+15551234567", "2001-12-31", "31/12/2001", "2001-12-31T10:00"])
    digits = [re.sub(r"\D", "", found[k][0]) for k in range(4)]
    assert digits[0] == digits[1] and digits[2] == digits[3]
    assert date.fromisoformat(found[4][0]).strftime("%d/%m/%Y") == found[5][0]
    assert found[6][0] == found[4][0] + "T10:00" != "2001-12-31T10:00"


def feistel(values, moduli, kind, key, width=2):
    """The network again, in plain Python."""
    cut = len(values) // 2
    left, right = list(values[:cut]), list(values[cut:])
    for i in range(8):
        half, other, m = (left, right, moduli[:cut]) if i % 2 == 0 else (right, left, moduli[cut:])
        seen = f"{key}|{kind}|{len(values)}|{i}|{','.join(map(str, other))}"
        digest = "".join(hashlib.sha256(f"{seen}|{k}".encode()).hexdigest() for k in range(2))
        half[:] = [(v + int(digest[width * j : width * (j + 1)], 16)) % n for j, (v, n) in enumerate(zip(half, m))]
    return left + right


def spelled(text, kind, key, alphabets):
    of = [next((a for a in alphabets(i) if c in a), c) for i, c in enumerate(text)]
    new = feistel([a.index(c) for c, a in zip(text, of)], list(map(len, of)), kind, key)
    return "".join(a[v] for a, v in zip(of, new))


def test_against_an_independent_network(spark):
    rng, key = random.Random(12), "another key"
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    classes = lambda *a: lambda i: a
    letters = classes(pii._CLASSES[0], pii._CLASSES[1], pii._CLASSES[2])
    texts, wanted = [], []

    def case(value, new):
        texts.append(f"({value}) and {value}")
        wanted.append(f"({new}) and {new}")

    for _ in range(30):
        body = digits(15)
        check = lambda b: next(str(d) for d in range(10) if luhn(b + str(d)))
        new = spelled(body, "card", key, letters)
        case(body + check(body), new + check(new))
        local = "".join(rng.choice("abYZ09._") for _ in range(rng.randrange(2, 12)))
        if re.search("[a-zA-Z0-9]", local):
            case(f"{local}@mail.example.org", spelled(local, "email", key, letters) + "@mail.example.org")
        octets = [rng.randrange(256) for _ in range(4)]
        case(".".join(map(str, octets)), ".".join(map(str, feistel(octets, [256] * 4, "ip", key))))
        n = rng.randrange(270 * 271)
        a, b = feistel([n // 271, n % 271], [270, 271], "date", key, 4)
        case(str(date(1900, 1, 1) + timedelta(n)), str(date(1900, 1, 1) + timedelta(a * 271 + b)))
        phone = digits(10)
        of = lambda i: ("01", "23456789") if i in (0, 3) else ("0123456789",)
        new = spelled(phone, "phone", key, of)
        case(f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}", f"+1 ({new[:3]}) {new[3:6]}-{new[6:]}")
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64, 128))))
        case(secret, spelled(secret, "secret", key, classes("0123456789", "abcdef")))
    assert [t for t, _ in done(spark, texts, key).values()] == wanted


def test_secrets_of_digits_stay_digits_and_numbers_stay_valid(spark):
    secret, numbers = "1234567890" * 4, [f"+1 ({a}) {b}-4567" for a in range(200, 240) for b in range(200, 230)]
    found = done(spark, [secret, " ".join(numbers)])
    assert re.fullmatch(r"\d{40}", found[0][0]) and found[0][0] != secret
    news = re.findall(r"\+1 \(([2-9]\d\d)\) ([2-9]\d\d)-(\d{4})", found[1][0])
    assert len(set(news)) == len(numbers)


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([("10.0.0.1", 3)], "text string, __found int")
    with pytest.raises(ValueError):
        pii.pseudonymize(df, "k")
    row = pii.pseudonymize(df, "k", name="found").first()
    assert row["__found"] == 3 and row.found[0].kind == "ip" and row.text == row.found[0].new
