"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers that are valid in their format (payment cards by their check digit,
addresses by their octets, dates by the calendar) and telephone numbers are
mapped by a keyed Feistel permutation of their own format: equal values get
equal pseudonyms in every document, different values different ones, and the
holder of the key can undo it. The two halves of a value take turns in adding a
keyed hash of the other half modulo their own size, so a domain of u * v values
is permuted exactly, without cycle walking. E-mail addresses become keyed
tokens.

Card numbers are sought in runs of digits with single spaces or hyphens: every
stretch of 13 to 19 digits between two separators or ends of its run is tested,
so a card keeps its pseudonym next to other numbers. What no card covers is
searched for the other formats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import set_aside

ROUNDS = 8
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Starts at the head of a run and never goes back into it, so long runs take one pass.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,}"
IPV4 = _EDGE + r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9A-Za-z])"
DATE = _EDGE + r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])" + _END
SSN = _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END
#: A number that goes on as another format does not belong to a run.
_OTHER = rf"(?!{IPV4}|{EMAIL}|[0-9]{{3}}(?:\.[0-9]{{3}}[ .-]|[ -][0-9]{{3}}\.)[0-9]{{4}}{_END})"
RUN = _EDGE + rf"(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++{_END}(?:[ -]{_OTHER}[0-9]++{_END})*+"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, DATE, SSN, PHONE, RUN))
IN_RUN = "|".join(f"(?:{p})" for p in (DATE, SSN, PHONE))
#: Usual layouts of cards. A stretch of another layout never takes a part of one of these.
CARD = "[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
#: Days from 1900-01-01 to 2099-12-31, as a product of two numbers.
DAYS = (17, 4297)


def feistel(a: Column, b: Column, u: Column | int, v: Column | int, tweak: Column | str, key: str, invert: bool = False) -> Column:
    """A permutation of pairs (a below u, b below v), as a struct (a, b). ``tweak`` keeps formats apart."""
    u, v = (F.lit(x) if isinstance(x, int) else x for x in (u, v))
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def keyed(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        sign = -1 if invert else 1
        return F.struct(
            F.when(even, F.pmod(acc["a"] + sign * keyed(i, acc["b"]), u)).otherwise(acc["a"]).cast("long").alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + sign * keyed(i, acc["a"]), v)).cast("long").alias("b"),
        )

    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if invert else range(ROUNDS))])
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _power(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("long")


def permuted_digits(digits: Column, tweak: str, key: str, invert: bool = False) -> Column:
    """A string of up to 18 digits, permuted among the strings of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    out = feistel(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n).cast("long"), _power(left), _power(n - left), F.concat_ws(":", F.lit(tweak), n), key, invert)
    return F.concat(F.lpad(out["a"].cast("string"), left, "0"), F.lpad(out["b"].cast("string"), n - left, "0"))


def luhn_sum(digits: Column) -> Column:
    """Sum of the check-digit rule, counted from the right end."""
    places = F.reverse(F.split(digits, ""))
    values = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda acc, x: (acc + x).cast("int"))


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _into(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct((acc["at"] + digit.cast("int")).alias("at"), F.concat(acc["out"], F.when(digit, F.substring(digits, acc["at"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def kind_of(value: Column) -> Column:
    """The kind of a value, or null if it is not valid in its format."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(whole(IPV4), F.lit("ip"))
        .when(whole(DATE), F.when(F.try_to_date(value).isNotNull(), F.lit("date")))
        .when(whole(SSN), F.lit("ssn"))
        .when(whole(PHONE), F.lit("phone"))
        .when(luhn_sum(_only_digits(value)) % 10 == 0, F.lit("card"))
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def _piece(value: Column, kind: Column) -> Column:
    return F.struct(value.alias("v"), kind.alias("k"))


def _other_pieces(text: Column) -> Column:
    """``text`` of a run outside its cards, cut at the values of other formats."""
    none = F.lit(None).cast("string")
    pairs = F.zip_with(F.split(text, IN_RUN, -1), F.regexp_extract_all(text, F.lit(IN_RUN), F.lit(0)), lambda b, m: F.array(_piece(b, none), _piece(F.coalesce(m, F.lit("")), F.when(m.isNotNull(), kind_of(m)))))
    return F.flatten(pairs)


def pieces_of(run: Column) -> Column:
    """A match of RUN, cut into pieces (v, k) with a null kind for what stays.

    From the left, the longest valid stretch at each number is a card, unless it
    would take a part of a valid stretch in one of the usual layouts.
    """
    text = lambda g, first, n: F.array_join(F.slice(g, first, n), "")

    def valid(g: Column, i: Column) -> Column:
        def stretch(w: Column) -> Column:
            return F.struct(i.alias("at"), (i + w).alias("end"), F.regexp_replace(text(g, i, w), "^[ -]", "").alias("v"))

        options = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(g) - i + 1)), stretch)
        digits = lambda c: _only_digits(c["v"])
        good = F.filter(options, lambda c: F.when(F.length(digits(c)).between(13, 19), luhn_sum(digits(c)) % 10 == 0).otherwise(False))
        return F.reverse(F.transform(good, lambda c: F.struct(c["at"].alias("at"), c["end"].alias("end"), c["v"].rlike(f"^(?:{CARD})$").alias("usual"))))

    def chosen(found: Column) -> Column:
        cuts = lambda c: F.exists(F.flatten(F.slice(found, c["at"] + 1, c["end"] - c["at"] - 1)), lambda x: x["usual"] & (x["end"] > c["end"]))
        best = F.filter(F.transform(found, lambda at: F.get(F.filter(at, lambda c: c["usual"] | ~cuts(c)), F.lit(0))), lambda c: c.isNotNull())
        span = lambda c, before: F.struct(before.alias("before"), c["at"].alias("at"), c["end"].alias("end"))
        start = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<before:int,at:int,end:int>>").alias("out"))
        step = lambda acc, c: F.when(c["at"] >= acc["end"], F.struct(c["end"].alias("end"), F.concat(acc["out"], F.array(span(c, acc["end"]))).alias("out"))).otherwise(acc)
        return F.aggregate(best, start, step)

    def cut(g: Column, picked: Column) -> Column:
        def pieces(c: Column) -> Column:
            card = text(g, c["at"], c["end"] - c["at"])
            lead = F.regexp_extract(card, "^[ -]?", 0)
            return F.concat(_other_pieces(F.concat(text(g, c["before"], c["at"] - c["before"]), lead)), F.array(_piece(F.regexp_replace(card, "^[ -]", ""), F.lit("card"))))

        return F.concat(F.flatten(F.transform(picked["out"], pieces)), _other_pieces(text(g, picked["end"], F.size(g))))

    numbers = F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0))
    found = lambda g: F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: valid(g, i))
    return _let(numbers, lambda g: _let(_let(found(g), chosen), lambda picked: cut(g, picked)))


def pseudonym(value: Column, kind: Column, key: str, invert: bool = False) -> Column:
    """The pseudonym of a valid value; with ``invert``, the value of a pseudonym (e-mail tokens cannot be undone)."""
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    ip = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, "ip", key, invert)
    half = lambda x: F.concat_ws(".", F.floor(x / 256).cast("long"), x % 256)
    day = F.date_diff(F.try_to_date(value), F.lit("1900-01-01").cast("date"))
    day2 = feistel(F.floor(day / DAYS[1]), day % DAYS[1], *DAYS, "date", key, invert)
    digits = _only_digits(value)
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key, invert)
    card = F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    phone = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), permuted_digits(F.substring(digits, F.length(digits) - 9, F.lit(10)), "phone", key, invert))
    return (
        F.when(kind == "email", F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16), F.lit("@mail.invalid")))
        .when(kind == "ip", F.concat_ws(".", half(ip["a"]), half(ip["b"])))
        .when(kind == "date", F.date_add(F.lit("1900-01-01").cast("date"), (day2["a"] * DAYS[1] + day2["b"]).cast("int")).cast("string"))
        .when(kind == "ssn", _into(value, permuted_digits(digits, "ssn", key, invert)))
        .when(kind == "phone", _into(value, phone))
        .when(kind == "card", _into(value, card))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", invert: bool = False) -> DataFrame:
    """``docs`` with its text's personal data replaced, and ``n_email, n_ip, n_date, n_ssn, n_phone, n_card`` (long).

    A null text stays null and counts nothing. Values that are not valid in
    their format (a card whose check digit is wrong, a day that no month has)
    stay. Dates from 1900 to 2099 count as personal, and so do their pseudonyms. A longer valid stretch wins over a card inside it; where one
    comes about by a pseudonym before one or three more digits (one in ten), that
    card cannot be undone. Repeated rows get equal results; other columns pass
    through, save those with the new names; an empty table stays empty.
    """
    text = F.col(text_col)
    names = [f"n_{k}" for k in KINDS]
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    out, back = set_aside(docs.drop(*names), "_found", "_before")
    has = text.rlike(PATTERN)
    run = lambda m: m.rlike("^[0-9 -]+$") & ~m.rlike(f"^(?:{IN_RUN})$")
    found = F.transform(matches, lambda m: F.when(run(m), pieces_of(m)).otherwise(F.array(_piece(m, kind_of(m)))))
    out = out.withColumns({"_found": F.when(has, found).otherwise(F.array().cast("array<array<struct<v:string,k:string>>>")), "_before": F.when(has, F.split(text, PATTERN, -1)).otherwise(F.array().cast("array<string>"))})
    pieces = F.zip_with("_before", "_found", lambda b, m: F.concat(b, F.when(m.isNull(), F.lit("")).otherwise(F.array_join(F.transform(m, lambda p: pseudonym(p["v"], p["k"], key, invert)), ""))))
    of_kind = lambda k: F.size(F.filter(F.flatten("_found"), lambda m: m["k"] == k)).cast("long")
    counts = {f"n_{k}": of_kind(k) for k in KINDS}
    return back(out.withColumns({text_col: F.when(F.size("_found") > 0, F.array_join(pieces, "")).otherwise(text), **counts}).drop("_found", "_before"))
