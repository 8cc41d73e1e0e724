"""Format-preserving pseudonyms for personal data, in DataFrame operations.

Numbers and dates that pass the validation of their kind are permuted within their format by a
keyed Feistel network over two parts of mixed radix, so that a value always becomes the same other
value of its kind (equal values stay linked across documents) and no two become the same:

========  ==================================================  ==========================================
kind      valid if                                            permuted
========  ==================================================  ==========================================
card      13 to 19 digits with a right Luhn digit             all but the first and the check digit
iban      country, 2 check digits, remainder 1 modulo 97      the digits after the check digits
ssn       area not 000, 666, 9xx; no zero group or serial     all valid (area, group, serial)
phone     +1 or national, area and exchange from 200          all valid (area, exchange, line)
phone     +1 and ten other digits                             all ten-digit numbers that are not valid
phone     other country codes, 7 to 12 further digits         those digits
ip        four numbers up to 255                              all 32 bits
date      a day of 1900 to 2099 (y-m-d, m/d/y, d.m.y)         all 73,049 days
email     one @ and a dotted domain                           letters and digits before the @
========  ==================================================  ==========================================

Separators, signs and letter case stay. The key is a parameter; without it pseudonyms cannot be
traced back, with it the network can be run in reverse.

A longest match that is not valid is not the end: an IBAN is sought in its shorter prefixes at spaces, and all
text that no other kind has taken, parts of matches too, is searched for cards. There, a run of digits with single spaces or
hyphens between them is read group by group: of all spans of whole groups the leftmost, and of those
the longest, that is a valid card is replaced, and the search goes on behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Patterns of the kinds, tried in this order at every position.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    # a word of two letters and two digits begins the next one
    "iban": r"[A-Z]{2}[0-9]{2}(?:(?: (?![A-Z]{2}[0-9]{2} ))?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})",
    "card": r"[0-9][0-9 -]{11,}[0-9]",  # a run that may hold some; one class, as a repeated group is a recursion in Java
}
OTHERS = [k for k in KINDS if k != "card"]
ANY = r"(?<![A-Za-z0-9_+])(?:" + "|".join(KINDS[k] for k in OTHERS) + r")(?![A-Za-z0-9_])"
RUN = r"(?<![A-Za-z0-9_+])" + KINDS["card"] + r"(?![A-Za-z0-9_])"


def _hash(key: str, kind: str, r: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(kind: str, key: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """A keyed permutation of the pairs ``0 <= left < a, 0 <= right < b`` (both below 2**60)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(s: Column, r: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + F.pmod(_hash(key, kind, r, s["r"]), a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_hash(key, kind, r, s["l"]), b), b).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def _int(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("0")).cast("decimal(20,0)").cast("long")


def _pow10(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n.cast("int"))).cast("long")


def _pad(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width.cast("int"), F.lit("0"))


def _permute_digits(kind: str, key: str, digits: Column) -> Column:
    """A permutation of the digit strings of one length (up to 34 digits, by halves)."""
    def halves(d: Column) -> Column:
        k = F.length(d)
        h = F.floor(k / 2).cast("int")
        left, right = F.substring(d, F.lit(1), h), F.substring(d, h + 1, k)
        out = feistel(kind, key, _int(left), _int(right), _pow10(h), _pow10(k - h))
        return _let(out, lambda o: F.concat(F.when(h > 0, _pad(o["l"], h)).otherwise(F.lit("")), _pad(o["r"], k - h)))

    return F.when(F.length(digits) == 0, F.lit("")).otherwise(_let(digits, halves))


def _fill(form: Column, chars: Column, where: str) -> Column:
    """``form`` with the characters of class ``where`` replaced, in order, by those of ``chars``."""
    pieces = F.split(form, where, -1)
    letters = F.concat(F.split(chars, ""), F.array(F.lit("")))
    return F.array_join(F.flatten(F.transform(pieces, lambda x, i: F.array(x, F.get(letters, i)))), "", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum; the last digit counts once."""
    def each(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), each), F.lit(0), lambda s, v: s + v)


def _mod97(text: Column) -> Column:
    """Letters count as 10 to 35."""
    def step(s: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return (s * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(d: Column, key: str) -> Column:
    """The pseudonym of the digits of a valid card."""
    body = F.concat(F.substring(d, 1, 1), _permute_digits("card", key, F.substring(d, F.lit(2), F.length(d) - 2)))
    return _let(body, lambda x: F.concat(x, ((10 - _luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))


def _cards(run: Column, key: str) -> Column:
    """``text, n``: a run of digits with its cards replaced, and their number."""

    def reach(groups: Column) -> Column:
        """How many groups the longest card from each group on takes; 0 if there is none."""
        def spans(i: Column) -> Column:
            some = F.slice(groups, i + 1, F.lit(19))
            joined = F.transform(some, lambda _, n: F.struct((n + 1).alias("n"), F.array_join(F.slice(some, F.lit(1), n + 1), "-").alias("s")))
            # separators stand alone: two of them leave an empty group
            whole = F.filter(joined, lambda x: ~x["s"].contains("--") & F.length(F.replace(x["s"], F.lit("-"), F.lit(""))).between(13, 19))
            return F.filter(whole, lambda x: _luhn_sum(F.replace(x["s"], F.lit("-"), F.lit(""))) % 10 == 0)

        return F.transform(groups, lambda g, i: F.when(g == "", 0).otherwise(F.coalesce(F.array_max(F.transform(spans(i), lambda x: x["n"])), F.lit(0))))

    def chosen(reach: Column) -> Column:
        """From the left, the cards that do not lie in an earlier one."""
        def take(state: Column, n: Column) -> Column:
            card = (state["at"] >= state["free"]) & (n > 0)
            return F.struct((state["at"] + 1).alias("at"), F.when(card, state["at"] + n).otherwise(state["free"]).alias("free"),
                            F.when(card, F.concat(state["cards"], F.array(F.struct(state["at"].alias("at"), n.alias("n"))))).otherwise(state["cards"]).alias("cards"))

        none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast("array<struct<at:int,n:int>>").alias("cards"))
        return F.aggregate(reach, none, take, lambda x: x["cards"])

    def replaced(groups: Column, found: Column) -> Column:
        """The digits of the run with those of the cards in their place."""
        def put(state: Column, c: Column) -> Column:
            before = F.array_join(F.slice(groups, state["at"] + 1, c["at"] - state["at"]), "")
            new = _let(F.array_join(F.slice(groups, c["at"] + 1, c["n"]), ""), lambda d: _card(d, key))
            return F.struct((c["at"] + c["n"]).alias("at"), F.concat(state["text"], before, new).alias("text"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
        digits = F.aggregate(found, start, put, lambda x: F.concat(x["text"], F.array_join(F.slice(groups, x["at"] + 1, F.size(groups)), "")))
        return F.struct(F.when(F.size(found) > 0, _fill(run, digits, "[0-9]")).otherwise(run).alias("text"), F.size(found).alias("n"))

    return _let(F.split(run, "[ -]"), lambda g: _let(reach(g), lambda r: _let(chosen(r), lambda c: replaced(g, c))))


def _plain(text: Column, key: str) -> Column:
    """``text, n``: text that no other kind has taken, with its cards replaced, and their number."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda m: _cards(m, key))

    def joined(found: Column) -> Column:
        between = F.split(text, RUN, -1)
        parts = F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(found, i)["text"], F.lit("")))))
        return F.struct(F.array_join(parts, "").alias("text"), F.aggregate(found, F.lit(0), lambda n, x: n + x["n"]).alias("n"))

    return F.when(text.rlike(RUN), _let(runs, joined)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def _iban(m: Column, key: str) -> Column:
    def make(s: Column) -> Column:
        bban = F.substring(s, 5, 40)
        new = _fill(bban, _permute_digits("iban", key, _digits(bban)), "[0-9]")
        country = F.substring(s, 1, 2)
        return _let(new, lambda x: F.concat(country, _pad(98 - _mod97(F.concat(x, country, F.lit("00"))), F.lit(2)), x))

    def checked(s: Column) -> Column:
        return F.when(_mod97(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))) == 1, make(s))

    words = F.split(m, " ")
    # the longest prefix at a space that is valid; what follows stays
    prefixes = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    tried = F.transform(prefixes, lambda x: F.struct(x.alias("old"), _let(F.replace(x, F.lit(" "), F.lit("")), checked).alias("new")))
    valid = F.filter(tried, lambda x: (F.length(F.replace(x["old"], F.lit(" "), F.lit(""))) >= 15) & x["new"].isNotNull())
    return _let(F.get(valid, F.lit(0)), lambda x: F.when(x["new"].isNotNull(), F.concat(_fill(x["old"], x["new"], "[A-Z0-9]"), F.lit(_END), F.substring(m, F.length(x["old"]) + 1, F.length(m)))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
    out = feistel("ssn", key, rank, serial - 1, 898 * 99, 9999)

    def show(o: Column) -> Column:
        a = F.floor(o["l"] / 99)
        return F.concat_ws("-", _pad(F.when(a >= 665, a + 2).otherwise(a + 1), F.lit(3)), _pad(o["l"] % 99 + 1, F.lit(2)), _pad(o["r"] + 1, F.lit(4)))

    return F.when(valid, _let(out, show))


def _phone(m: Column, key: str) -> Column:
    """The country code is what stands between + and the next separator; without + it is North American."""
    code = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+([0-9]{1,3}?)(?=[ .(-]|[0-9]{10}$)", 1)).otherwise("1")

    def make(c: Column) -> Column:
        rest = _digits(F.when(m.startswith("+"), F.substring(m, F.length(c) + 2, F.length(m))).otherwise(m))
        area, exchange, line = F.substring(rest, 1, 3).cast("long"), F.substring(rest, 4, 3).cast("long"), F.substring(rest, 7, 4).cast("long")
        assigned = feistel("phone", key, (area - 200) * 800 + exchange - 200, line, 640_000, 10_000)
        shown = _let(assigned, lambda o: F.concat(
            _pad(F.floor(o["l"] / 800) + 200, F.lit(3)), _pad(o["l"] % 800 + 200, F.lit(3)), _pad(o["r"], F.lit(4))))
        # the other numbers of +1: areas below 200 with every exchange, then the rest with exchanges below 200
        other = feistel("phone-other", key, F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange), line, 360_000, 10_000)
        unassigned = _let(other, lambda o: F.concat(F.when(o["l"] < 200_000, _pad(o["l"], F.lit(6))).otherwise(
            F.concat(_pad(F.floor((o["l"] - 200_000) / 200) + 200, F.lit(3)), _pad((o["l"] - 200_000) % 200, F.lit(3)))), _pad(o["r"], F.lit(4))))
        american = F.when((area >= 200) & (exchange >= 200), shown).when(m.startswith("+"), unassigned)
        new = F.when((c == "1") & (F.length(rest) == 10), american).when(
            (c != "1") & F.length(rest).between(7, 12), _permute_digits("phone", key, rest))
        return _let(new, lambda x: F.when(x.isNotNull(), _fill(m, F.concat(F.when(m.startswith("+"), c).otherwise(F.lit("")), x), "[0-9]")))

    return _let(code, make)


def _ip(m: Column, key: str) -> Column:
    part = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    out = feistel("ip", key, part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536)
    show = _let(out, lambda o: F.concat_ws(".", *[x.cast("string") for x in (F.floor(o["l"] / 256), o["l"] % 256, F.floor(o["r"] / 256), o["r"] % 256)]))
    return F.when(F.greatest(*part) < 256, show)


def _date(m: Column, key: str) -> Column:
    """73,049 days = 17 x 4297."""
    form = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("/"), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    iso = F.when(m.contains("-"), m).when(m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(
        F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    day = F.datediff(iso.try_cast("date"), F.lit("1900-01-01").cast("date"))

    def make(d: Column) -> Column:
        out = feistel("date", key, F.floor(d / 4297), d % 4297, 17, 4297)
        date = F.date_add(F.lit("1900-01-01").cast("date"), _let(out, lambda o: o["l"] * 4297 + o["r"]).cast("int"))
        return F.when(d.between(0, 73_048), F.date_format(date, "yyyy-MM-dd"))

    def shown(x: Column) -> Column:
        y, mo, d = F.substring(x, 1, 4), F.substring(x, 6, 2), F.substring(x, 9, 2)
        return F.when(form == "yyyy-MM-dd", x).when(form == "MM/dd/yyyy", F.concat_ws("/", mo, d, y)).otherwise(F.concat_ws(".", d, mo, y))

    return _let(_let(day, make), lambda x: F.when(x.isNotNull(), shown(x)))


def _email(m: Column, key: str) -> Column:
    """Feistel over the two halves of the local part: letters and digits move within their class."""
    local, domain = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "(@.*)$", 1)

    def turn(half: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), r.cast("string"), other), 256)

        def each(c: Column, i: Column) -> Column:
            # a fresh digest every 16 characters
            fresh = F.when(i < 16, digest).otherwise(F.sha2(F.concat_ws("|", digest, F.floor(i / 16).cast("string")), 256))
            move = F.conv(F.substring(fresh, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            return (
                F.when(code.between(48, 57), F.char(F.lit(48) + (code - 48 + move) % 10))
                .when(code.between(97, 122), F.char(F.lit(97) + (code - 97 + move) % 26))
                .when(code.between(65, 90), F.char(F.lit(65) + (code - 65 + move) % 26)).otherwise(c)
            )

        return F.when(half == "", half).otherwise(F.array_join(F.transform(F.split(half, ""), each), ""))

    h = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), h).alias("l"), F.substring(local, h + 1, F.length(local)).alias("r"))

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(turn(s["l"], s["r"], r).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), turn(s["r"], s["l"], r).alias("r")))

    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda o: F.concat(o["l"], o["r"], domain))


_MAKE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


_END = "\0"  # parts a pseudonym from what the match holds behind it; no match holds this character


def pseudonym(m: Column, key: str) -> Column:
    """``kind, value, rest`` of one match: its pseudonym, and the text that is no part of it; kind null if all of it is rest."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(OTHERS):
        fits = m.rlike(f"^(?:{KINDS[name]})$")
        value = F.when(fits, _MAKE[name](m, key)).otherwise(value)
        kind = F.when(fits, F.lit(name)).otherwise(kind)
    return _let(value, lambda v: F.struct(
        F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(F.substring_index(v, _END, 1), F.lit("")).alias("value"),
        F.when(v.isNull(), m).when(v.contains(_END), F.substring_index(v, _END, -1)).otherwise("").alias("rest")))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_replaced`` and ``n_<kind>`` for each kind.

    ``key`` must stay secret: with it pseudonyms can be traced back. Null text stays null with counts of 0; texts
    without personal data come back unchanged. Whole texts are scanned. Rows are independent of each other: repeated
    rows give repeated results, and identifiers may be null. Other columns are not read.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    found = rows.withColumn("m", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0)))
    found = found.withColumn("v", F.transform("m", lambda m: pseudonym(m, key)))
    # what a match leaves over is searched together with the text behind it
    rests = F.concat(F.array(F.lit("")), F.transform("v", lambda v: v["rest"]))
    found = found.withColumn("plain", F.zip_with(rests, F.split(text, ANY, -1), lambda r, x: F.concat(r, x)))
    found = found.withColumn("plain", F.transform("plain", lambda x: _plain(x, key)))
    new = F.array_join(F.flatten(F.transform("plain", lambda x, i: F.array(x["text"], F.coalesce(F.get(F.col("v"), i)["value"], F.lit(""))))), "")
    kinds = F.filter(F.transform("v", lambda x: x["kind"]), lambda k: k.isNotNull())
    cards = F.aggregate("plain", F.lit(0), lambda a, x: a + x["n"])
    found = found.withColumn("kinds", kinds).withColumn("cards", F.coalesce(cards, F.lit(0)))

    def count(name: str) -> Column:
        return (F.col("cards") if name == "card" else F.size(F.filter("kinds", lambda k: k == name))).alias(f"n_{name}")

    total = (F.size("kinds") + F.col("cards")).alias("n_replaced")
    return found.select("doc_id", F.when(F.size("kinds") + F.col("cards") > 0, new).otherwise(text).alias("text"), total, *map(count, KINDS))
