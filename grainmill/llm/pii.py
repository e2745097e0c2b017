"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in DataFrame functions only.

E-mail addresses, telephone numbers, payment cards (Luhn), social security numbers, IPv4 addresses, calendar dates and long
hexadecimal keys are found by one regular expression and validated; the cards in it are those windows of a digit run, longest
first, that pass their check. A valid value is brought to a canonical form (digits
without separators, lower-case letters), permuted within its own format by a ten-round alternating Feistel network whose
round function is SHA-256 under the key, and written back with the separators and letter case that it had. A card keeps a
right check digit and a date or security number stays valid (by cycle walking), so the map is one-to-one on the valid values
of a format: equal values stay linked across documents, different ones stay apart, and the owner of the key can invert it.

Everything happens inside the row: no shuffle, no state, no Python on the executors.

Cases: null text stays null with count 0; text without a match stays the same, byte for byte; numbers that fail their check
(Luhn, octets over 255, impossible dates) stay; repeated rows get equal results; very long texts are scanned whole; all
further columns are kept, and a column named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm.shared import fresh

ROUNDS = 10
DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
FIRST_DAY, DAYS = "1900-01-01", 73049  # up to 2099-12-31

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "key": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9]|[.-][0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
}
ANY = "|".join(PATTERNS.values())
#: the digit runs of 13 to 19 digits that begin and end at borders of digit groups, longest first; each place gives one of a size
WINDOWS = [r"(?<![0-9])(?=([0-9](?:[ -]?[0-9]){%d}(?![0-9])))" % (n - 1) for n in range(19, 12, -1)]
RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12}"
#: no match holds neither two neighbouring digits, nor two digits around a separator, nor an @, nor a long hexadecimal run
MAYBE = r"@|[0-9]{2}|[0-9][ ./-][0-9]|[0-9a-f]{32}|[0-9A-F]{32}"


def characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _rotate(half: Column, other: Column, i: Column, key: str, kind: Column) -> Column:
    """Every character of ``half`` moved within its alphabet by as much as the hash of the other half says."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), F.length(half).cast("string"), other).cast("binary"), 512)

    def turn(c: Column, j: Column) -> Column:
        alphabet = F.when(kind.isin("key", "ip"), F.lit(HEX)).when(c.rlike("[0-9]"), F.lit(DIGITS)).when(c.rlike("[a-z]"), F.lit(LETTERS)).otherwise(c)
        # four hash digits a character; beyond 32 characters the hash is read again, which keeps the map one-to-one
        shift = F.conv(F.substr(digest, F.pmod(j * 4, F.lit(125)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")
        return F.substr(alphabet, F.pmod(F.position(c, alphabet) - 1 + shift, F.length(alphabet)) + 1, F.lit(1))

    return F.array_join(F.transform(characters(half), turn), "")


def feistel(x: Column, key: str, kind: Column) -> Column:
    """The keyed permutation of canonical strings of one kind and length."""
    cut = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), cut).alias("l"), F.substr(x, cut + 1, F.length(x)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.struct(_rotate(s["l"], s["r"], i, key, kind).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), _rotate(s["r"], s["l"], i, key, kind).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def walk(x: Column, key: str, kind: Column, valid, most: int) -> Column:
    """Cycle walking: permute until the value is valid again."""
    first = F.struct(feistel(x, key, kind).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, lambda s, _: F.when(valid(s["v"]), s).otherwise(F.struct(feistel(s["v"], key, kind).alias("v"))), lambda s: s["v"])


def luhn_digit(body: Column) -> Column:
    """The check digit that makes the digits a valid card number."""
    n = F.length(body)
    doubled = F.transform(characters(body), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10, F.lit(10)).cast("string")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def as_day(x: Column) -> Column:
    """Days since 1900 of an ISO, d/m/y or d.m.y date (m/d/y where only that is possible); null if there is no such day."""
    part = F.split(x, "[^0-9]")
    iso = F.when(F.length(part[0]) == 4, x)
    dmy = F.concat_ws("-", part[2], F.lpad(part[1], 2, "0"), F.lpad(part[0], 2, "0"))
    mdy = F.concat_ws("-", part[2], F.lpad(part[0], 2, "0"), F.lpad(part[1], 2, "0"))
    day = F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.when(iso.isNull(), F.coalesce(F.try_to_date(dmy, "yyyy-MM-dd"), F.try_to_date(mdy, "yyyy-MM-dd"))))
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < DAYS), n)


def valid_ssn(x: Column) -> Column:
    return ~x.rlike("^(?:000|666|9)|^...00|0000$")


def kind_of(x: Column) -> Column:
    """The kind of a match, null if it fails the check of its kind."""
    d = digits(x)
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike("^[0-9A-Fa-f]{32,}$"), F.when(x.rlike("[0-9]"), F.lit("key")))
        .when(x.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(F.forall(octets, lambda o: o < 256), F.lit("ip")))
        .when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(valid_ssn(d), F.lit("ssn")))
        .when(x.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})$"), F.when(as_day(x).isNotNull(), F.lit("date")))
        .when(x.rlike(r"^[+(]") | x.rlike(r"^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone")
        .otherwise(F.when(valid_card(d), F.lit("card")))
    )


def valid_card(d: Column) -> Column:
    return luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1))


def either(cards: Column) -> Column:
    """The pattern of any of these cards between borders of digit groups."""
    return F.concat(F.lit("(?<![0-9])(?:"), F.array_join(cards, "|"), F.lit(")(?![0-9])"))


def cards_of(t: Column) -> Column:
    """The valid cards of a text as they are written, longest first; what a longer one takes is not looked at again.

    The number beside a card (expiry, CVV, a leading number) may stand in its digit run, so every window of the run is tried.
    """
    start = F.struct(t.alias("left"), F.array().cast("array<string>").alias("cards"))

    def step(s: Column, p: Column) -> Column:
        found = F.filter(F.array_distinct(F.regexp_extract_all(s["left"], p, F.lit(1))), lambda x: valid_card(digits(x)))
        return _once(found, lambda v: F.when(F.size(v) == 0, s).otherwise(F.struct(F.regexp_replace(s["left"], either(v), F.lit("#")).alias("left"), F.concat(s["cards"], v).alias("cards"))))

    return F.aggregate(F.array(*map(F.lit, WINDOWS)), start, step, lambda s: s["cards"])


def write_back(form: Column, new: Column) -> Column:
    """``new`` in the place of the letters and digits of ``form``, with its separators and capitals."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        n = F.substr(new, s["k"], F.lit(1))
        used = F.struct(F.concat(s["out"], F.when(c.rlike("[A-Z]"), F.upper(n)).otherwise(n)).alias("out"), (s["k"] + 1).alias("k"))
        return F.when(c.rlike("[0-9A-Za-z]"), used).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))

    return F.aggregate(characters(form), state, put, lambda s: s["out"])


def pseudonym(kind: Column, x: Column, key: str) -> Column:
    d = digits(x)
    name = F.substring_index(x, "@", 1)
    email = F.concat(write_back(name, feistel(F.lower(F.regexp_replace(name, "[^0-9A-Za-z]", "")), key, kind)), F.substr(x, F.length(name) + 1, F.length(x)))
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    card = _with_check(feistel(body, key, kind))
    kept = F.least(F.greatest(F.length(d) - 10, F.lit(0)), F.length(d) - 1)
    phone = F.concat(F.substr(d, F.lit(1), kept), feistel(F.substr(d, kept + 1, F.length(d)), key, kind))
    octets = F.array_join(F.transform(F.split(x, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))), "")
    ip = _octets(feistel(octets, key, kind))
    day = walk(F.lpad(as_day(x).cast("string"), 5, "0"), key, kind, lambda v: v.cast("int") < DAYS, 40)
    return (
        F.when(kind == "email", email)
        .when(kind == "key", F.when(x.rlike("[A-F]"), F.upper(feistel(F.lower(x), key, kind))).otherwise(feistel(x, key, kind)))
        .when(kind == "phone", write_back(x, phone))
        .when(kind == "card", write_back(x, card))
        .when(kind == "ssn", write_back(x, walk(d, key, kind, valid_ssn, 12)))
        .when(kind == "ip", ip)
        .when(kind == "date", _date_form(x, day))
        .otherwise(x)
    )


def _once(x: Column, f) -> Column:
    """``f`` of a value that is computed once though ``f`` names it often."""
    return F.transform(F.array(x), f)[0]


def _with_check(body: Column) -> Column:
    return _once(body, lambda b: F.concat(b, luhn_digit(b)))


def _octets(h: Column) -> Column:
    return _once(h, lambda v: F.concat_ws(".", *(F.conv(F.substr(v, F.lit(1 + 2 * i), F.lit(2)), 16, 10) for i in range(4))))


def _date_form(x: Column, day: Column) -> Column:
    """The day as ISO date if ``x`` is one, otherwise day first with the separator of ``x``."""
    date = F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    part = F.split(x, "[^0-9]")
    slash = F.when(x.contains("/"), F.lit("/")).otherwise(F.lit("."))
    return _once(
        date,
        lambda v: F.when(F.length(part[0]) == 4, F.date_format(v, "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format(v, "dd"), slash, F.date_format(v, "MM"), slash, F.date_format(v, "yyyy"))),
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_pii`` (replaced values) and ``kinds`` (their kinds in order)."""
    t = F.col(text)
    any_, hits, valid = (fresh(docs, c) for c in ("any", "hits", "valid"))
    cards = F.when(t.rlike(RUN), cards_of(t))
    any_of = F.coalesce(_once(cards, lambda c: F.when(F.size(c) > 0, F.concat(F.lit(ANY + "|"), either(c)))), F.lit(ANY))
    found = F.when(t.rlike(MAYBE), F.transform(F.regexp_extract_all(t, F.col(any_), F.lit(0)), lambda x: F.struct(kind_of(x).alias("kind"), x.alias("x"))))
    out = docs.withColumn(any_, any_of).withColumn(hits, found).withColumn(valid, F.filter(F.transform(hits, lambda h: h["kind"]), lambda k: k.isNotNull()))
    gaps = F.split(t, F.col(any_), -1)
    new = F.transform(hits, lambda h: F.when(h["kind"].isNull(), h["x"]).otherwise(pseudonym(h["kind"], h["x"], key)))
    joined = F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    n = F.coalesce(F.size(valid), F.lit(0))
    out = out.withColumn("n_pii", F.when(F.col(valid).isNull(), 0).otherwise(n).cast("long"))
    out = out.withColumn("kinds", F.coalesce(valid, F.array().cast("array<string>")))
    return out.withColumn(text, F.when(F.col("n_pii") > 0, joined).otherwise(t)).drop(any_, hits, valid)
