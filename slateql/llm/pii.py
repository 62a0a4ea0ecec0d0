"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Column expressions only. One regular expression finds candidates; each is
validated (Luhn sum of a card number, octets of an address, the calendar for
dates) and then permuted within its format:

* card numbers, unbroken or in groups (4-4-4-4, 4-6-4, 4-6-5): all digits but the last are permuted, the last is the new check digit;
* telephone numbers: the digits behind ``+`` and the country code, or ten digits as 555-123-4567, 555.123.4567 or (555) 123-4567;
  of North American numbers the first digits of area and exchange stay within 2-9 (or, not valid there, within 0-1);
* IPv4 addresses: four numbers below 256;
* dates (2001-12-31, 31.12.2001, 12/31/2001, also 1.2.2001, 1/2/2001 and before a time, 2001-12-31T10:00) from 1900-01-01 on:
  the day's number among 270 * 271 days, up to 2100-05-02; with slashes the month comes first, or second where that is no date;
* e-mail addresses: letters and digits of the local part, each within its class;
* hexadecimal secrets of 32 to 128 digits: digits within 0-9, letters within a-f or A-F.

A value is a list of digits, each with its own modulus. Its halves are
alternately shifted by a keyed digest of the other half, ``ROUNDS`` times; the
moduli never change, so every round is invertible: equal values get equal
pseudonyms in every document under the same key, and different ones of a kind and format different ones.

Defined cases: null stays null, texts without candidates stay as they are, whole texts are read whatever their length.
What fails its validation stays as it is, and so does a local part without letters or digits; a value that stays is not reported. Candidates inside longer runs of
digits, letters or dots are none. Repeated rows are treated one by one. An empty table gives no rows. Columns keep their names; the one more, ``name``, must not be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateql.llm.exprs import let

ROUNDS = 8
KINDS = ("email", "secret", "phone", "card", "ip", "date")

_EMAIL = r"(?<![\w.%+-])[\w.%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
_COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
_PHONE = (
    r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?!\+1)" + _COUNTRY + r"(?:[ ./-]?(?:\(\d{1,4}\)|\d)){6,12}(?!\d)"
    r"|(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w|[.-]\d)"
)
_CARD = r"(?<![\w.])(?:\d{13,19}|(?<!\d-)(?:\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3}|[ -]\d{6}[ -]\d{4,5}))(?!-\d))(?!\w)"
_IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
_DATE = r"(?<![\w.])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!(?!T\d\d:)\w|[./-]\d)"
CANDIDATE = "|".join((_EMAIL, _SECRET, _PHONE, _CARD, _IP, _DATE))
_FIRST, _DAYS_A, _DAYS_B = "1900-01-01", 270, 271


def _shift(half: Column, moduli: Column, other: Column, tweak: Column, width: int) -> Column:
    """Each digit plus ``width`` hex digits of the keyed digest of the other half, within its modulus."""
    seen = F.concat(tweak, F.lit("|"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
    digest = F.concat(F.sha2(F.concat(seen, F.lit("|0")), 256), F.sha2(F.concat(seen, F.lit("|1")), 256))
    return let(digest, lambda d: F.transform(half, lambda v, i: F.pmod(v + F.conv(F.substring(d, width * i + 1, F.lit(width)), 16, 10).cast("int"), F.get(moduli, i))))


def permuted(values: Column, moduli: Column, kind: str, key: str, width: int = 2) -> Column:
    """A keyed permutation of digit lists (2 to 256 / ``width`` digits) with these moduli, which are well below 16 ** ``width``."""

    def halves(both: Column) -> Column:
        v, m = both["v"], both["m"]
        cut = F.floor(F.size(v) / 2).cast("int")
        parts = F.struct(F.slice(v, F.lit(1), cut).alias("l"), F.slice(v, cut + 1, F.size(v) - cut).alias("r"))
        ml, mr = F.slice(m, F.lit(1), cut), F.slice(m, cut + 1, F.size(v) - cut)

        def step(s: Column, i: Column) -> Column:
            tweak = F.concat(F.lit(f"{key}|{kind}|"), F.size(v).cast("string"), F.lit("|"), i.cast("string"))
            left = F.struct(_shift(s["l"], ml, s["r"], tweak, width).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), _shift(s["r"], mr, s["l"], tweak, width).alias("r"))
            return F.when(i % 2 == 0, left).otherwise(right)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), parts, step, lambda s: F.concat(s["l"], s["r"]))

    return let(F.struct(values.alias("v"), moduli.alias("m")), halves)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789", "abcdef", "ABCDEF")
_LEADING = ("01", "23456789")


def _class(c: Column, classes: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.position(c, F.lit(a)) > 0, F.lit(a)) for a in classes], c)


def _permuted_text(text: Column, kind: str, key: str, classes: tuple[str, ...] = _CLASSES, leading=None) -> Column:
    """Characters permuted within their classes; others stay. ``leading`` says at which places, from 1, the classes are ``_LEADING``."""

    def of(t: Column) -> Column:
        def place(i: Column) -> Column:
            def named(c: Column) -> Column:
                alphabet = _class(c, classes) if leading is None else F.when(leading(i), _class(c, _LEADING)).otherwise(_class(c, classes))
                return F.struct(c.alias("c"), alphabet.alias("a"))

            return let(F.substring(t, i, F.lit(1)), named)

        placed = F.transform(F.sequence(F.lit(1), F.length(t)), place)

        def spelled(p: Column) -> Column:
            values = F.transform(p, lambda x: (F.position(x["c"], x["a"]) - 1).cast("int"))
            moduli = F.transform(p, lambda x: F.length(x["a"]))
            return F.array_join(F.zip_with(permuted(values, moduli, kind, key), p, lambda v, x: F.substring(x["a"], v + 1, F.lit(1))), "")

        return let(placed, spelled)

    def single(t: Column) -> Column:
        alphabet = _class(t, classes)
        digest = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|1|"), alphabet), 256), 1, 8), 16, 10).cast("bigint")
        moved = (F.position(t, alphabet) + digest % F.greatest(F.length(alphabet) - 1, F.lit(1))) % F.length(alphabet)
        return F.substring(alphabet, moved.cast("int") + 1, F.lit(1))

    return F.when(F.length(text) < 1, text).when(F.length(text) == 1, let(text, single)).otherwise(let(text, of))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _placed(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in turn by ``digits``."""
    char = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.struct(F.substring(m, i, F.lit(1)).alias("c"), F.length(_digits(F.substring(m, F.lit(1), i))).alias("n")))
    return F.array_join(F.transform(char, lambda x: F.when(x["c"].rlike("[0-9]"), F.substring(digits, x["n"], F.lit(1))).otherwise(x["c"])), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, mod 10, of a number without its check digit."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn(digits)) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = let(_permuted_text(body, "card", key), lambda b: _placed(m, F.concat(b, _check_digit(b))))
        return F.when(_check_digit(body) == F.substring(d, F.length(d), F.lit(1)), new)

    return let(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; a number has the same pseudonym however its digits are grouped."""
    code = F.regexp_extract(m, "^" + _COUNTRY, 0)

    def of(c: Column) -> Column:
        rest = F.substring(m, F.length(c) + 1, F.length(m))
        american = (F.length(_digits(rest)) == 10) & ((c == "") | (c == "+1"))
        leading = lambda i: american & ((i == 1) | (i == 4))
        return let(rest, lambda r: F.concat(c, let(_permuted_text(_digits(r), "phone", key, leading=leading), lambda d: _placed(r, d))))

    return let(code, of)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    moduli = F.array(*[F.lit(256)] * 4)
    return let(octets, lambda o: F.when(F.forall(o, lambda x: x < 256), F.array_join(F.transform(permuted(o, moduli, "ip", key), lambda x: x.cast("string")), ".")))


def _date(m: Column, key: str) -> Column:
    formats = [
        (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"),
        (r"^\d{4}-", "yyyy-M-d"),
        (r"^\d\d\.\d\d\.", "dd.MM.yyyy"),
        (r"^\d+\.", "d.M.yyyy"),
        (r"^\d\d/\d\d/", "MM/dd/yyyy"),
        (r"^\d\d/\d\d/", "dd/MM/yyyy"),
        (r"^\d+/", "M/d/yyyy"),
        (r"^\d+/", "d/M/yyyy"),
    ]
    moduli = F.array(F.lit(_DAYS_A), F.lit(_DAYS_B))

    def read(fmt: str) -> Column:
        day = F.datediff(F.try_to_date(m, fmt), F.lit(_FIRST).cast("date"))
        return let(day, lambda d: F.when(d.isNotNull(), F.struct(F.lit(fmt).alias("fmt"), d.alias("d"))))

    def of(x: Column) -> Column:
        pair = F.array(F.floor(x["d"] / _DAYS_B).cast("int"), (x["d"] % _DAYS_B).cast("int"))
        new = let(permuted(pair, moduli, "date", key, 4), lambda p: F.date_add(F.lit(_FIRST).cast("date"), F.get(p, F.lit(0)) * _DAYS_B + F.get(p, F.lit(1))))
        spelled = let(new, lambda n: F.coalesce(*[F.when(x["fmt"] == fmt, F.date_format(n, fmt)) for _, fmt in formats]))
        return F.when(x["d"].between(0, _DAYS_A * _DAYS_B - 1), spelled)

    return let(F.coalesce(*[F.when(m.rlike(p), read(fmt)) for p, fmt in formats]), of)


def pseudonym(m: Column, key: str) -> Column:
    """(kind, new): the pseudonym of a candidate; null if it is not valid or stays as it is."""
    local = F.substring_index(m, "@", 1)
    new = {
        "email": F.when(m.contains("@"), F.concat(_permuted_text(local, "email", key), F.substring(m, F.length(local) + 1, F.length(m)))),
        "phone": F.when(m.rlike(f"^(?:{_PHONE})$"), _phone(m, key)),
        "secret": F.when(m.rlike("^[0-9A-Fa-f]{32,}$"), _permuted_text(m, "secret", key, _HEX)),
        "card": F.when(m.rlike(f"^(?:{_CARD})$"), _card(m, key)),
        "ip": F.when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), _ip(m, key)),
        "date": F.when(m.rlike(r"^\d+[-./]\d\d?[-./]\d+$"), _date(m, key)),
    }

    def named(kind: str, value: Column) -> Column:
        return let(value, lambda x: F.when(x != m, F.struct(F.lit(kind).alias("kind"), x.alias("new"))))

    return F.coalesce(*[named(k, v) for k, v in new.items()])


def pseudonymize(df: DataFrame, key: str, text: str = "text", name: str = "__found") -> DataFrame:
    """``df`` with pseudonyms in its text, and ``name``: an array of (kind, old, new)."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name} is there already")
    matches = F.transform(F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)), lambda m: let(pseudonym(m, key), lambda p: F.struct(p["kind"].alias("kind"), m.alias("old"), p["new"].alias("new"))))
    found = df.withColumn(name, F.when(F.col(text).isNotNull(), matches))
    between = F.split(F.col(text), CANDIDATE, -1)
    news = F.concat(F.transform(name, lambda x: F.coalesce(x["new"], x["old"])), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, news, lambda a, b: F.concat(a, b)), "")
    return found.withColumn(text, F.when(F.size(name) > 0, joined).otherwise(F.col(text))).withColumn(name, F.filter(name, lambda x: x["kind"].isNotNull()))
