"""Personal data to format-preserving pseudonyms, by keyed Feistel permutations in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import let

ROUNDS = 8
#: Days of one Gregorian cycle from FIRST_DAY, and two factors of it: the halves of a date.
FIRST_DAY, DAYS, DAYS_LOW = "1800-01-01", 146_097, 189
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What names a secret before its value.
SECRET_NAMES = "(?i:token|secret|password|passwd|apikey|api_key|api-key)"
#: Kind and pattern, in the order in which they are tried at each place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}",
    "secret": rf"(?<=\b{SECRET_NAMES}\s{{0,3}}[=:]\s{{0,3}}[\"'])[A-Za-z0-9+/_=-]{{8,}}+(?=[\"'])",
    "date": r"(?<![0-9-])(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What a text with a find of any kind holds: all kinds but secrets and mail addresses need a digit.
HINT = f"[0-9@]|{SECRET_NAMES}"


def _round(key: str, kind: str, i: Column, other: Column, size: Column) -> Column:
    """A keyed number below size, of one half of a value."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"), size.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def feistel(key: str, kind: str, left: Column, right: Column, n_left: Column, n_right: Column, back: bool = False) -> Column:
    """Struct (l, r): a keyed permutation of the pairs below n_left and n_right; back undoes it."""
    sign = F.lit(-1 if back else 1)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + sign * _round(key, kind, i, s["r"], n_left), n_left)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * _round(key, kind, i, s["l"], n_right), n_right)).alias("r"),
        )

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permuted_digits(key: str, kind: str, digits: Column, back: bool = False) -> Column:
    """Digits of equal length, 2 to 36, a permutation of those of that length."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a

    def size(n: Column) -> Column:
        return F.pow(F.lit(10.0), n).cast("long")

    def joined(s: Column) -> Column:
        return F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), b, F.lit("0")))

    tag = F.substr(digits, F.lit(1), a), F.substr(digits, a + 1, b)
    return let(feistel(key, kind, tag[0], tag[1], size(a), size(b), back), joined)


def luhn_sum(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def card(key: str, digits: Column, back: bool = False) -> Column:
    """A number of 13 to 19 digits with the same Luhn remainder: all digits but the last are permuted, the last keeps the remainder."""

    def closed(p: Column) -> Column:
        rest = F.pmod(luhn_sum(digits) - luhn_sum(F.concat(p, F.lit("0"))), F.lit(10))
        return F.concat(p, rest.cast("string"))

    return let(permuted_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1), back), closed)


def in_format(template: Column, digits: Column) -> Column:
    """template with its digits replaced, in order, by digits."""

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct((s["i"] + F.when(digit, 1).otherwise(0)).alias("i"), F.concat(s["out"], F.when(digit, F.substr(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), put)["out"]


def date(key: str, text: Column, back: bool = False) -> Column:
    """A date of the 400 years from FIRST_DAY, among which dates are permuted; a text that is none stays."""
    n = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))

    def out(s: Column) -> Column:
        return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * (DAYS // DAYS_LOW) + s["r"]).cast("int")), "yyyy-MM-dd")

    moved = let(feistel(key, "date", F.floor(n / (DAYS // DAYS_LOW)), n % (DAYS // DAYS_LOW), F.lit(DAYS_LOW).cast("long"), F.lit(DAYS // DAYS_LOW).cast("long"), back), out)
    return F.when(n.isNull() | ~n.between(0, DAYS - 1), text).otherwise(moved)


def ssn(key: str, digits: Column, back: bool = False) -> Column:
    """Nine digits of a valid number, permuted among the valid ones: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substr(digits, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))

    def out(s: Column) -> Column:
        return F.concat(
            F.lpad((s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"),
        )

    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    return let(feistel(key, "ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), back), out)


def address(key: str, text: Column, back: bool = False) -> Column:
    """An IPv4 address, permuted among all."""
    o = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    half = F.lit(65_536).cast("long")
    return let(feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, back), lambda s: F.concat_ws(".", *(x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256))))


def mail(key: str, text: Column) -> Column:
    """A mail address of keyed hexadecimal names: equal addresses stay equal, whatever their case."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(text)), 256)
    return F.concat(F.substring(h, 1, 12), F.lit("@"), F.substring(h, 13, 8), F.lit(".example"))


def secret(key: str, text: Column) -> Column:
    """Keyed hexadecimal text of the secret's length, upper case if the secret has no lower-case letter."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), text), 256)
    out = F.substr(F.repeat(h, F.ceil(F.length(text) / 64).cast("int")), F.lit(1), F.length(text))
    return F.when(text.rlike("[a-z]"), out).otherwise(F.upper(out))


def kind_of(found: Column) -> Column:
    """The kind of a match of ANY; null for one that its kind's check rejects."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    return (
        F.when(found.rlike(f"^(?:{KINDS['email']})$"), "email")
        .when(found.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ip")
        .when(found.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(F.try_to_date(found, "yyyy-MM-dd").isNotNull(), "date"))
        .when(found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(r"^(\+|\(|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$)"), F.when(F.length(digits).between(7, 15), "phone"))
        .when(found.rlike("^[0-9 -]{13,}$"), F.when(digits.rlike("[^0]") & (luhn_sum(digits) % 10 == 0), "card"))
        .otherwise("secret")
    )


def pseudonym(key: str, kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    code = F.regexp_extract(found, r"^\+([0-9]+)[ .(-]", 1)  # a country's code stays
    number = let(digits, lambda d: F.concat(code, permuted_digits(key, "phone", F.substr(d, F.length(code) + 1, F.length(d)))))
    return (
        F.when(kind == "email", mail(key, found))
        .when(kind == "ip", address(key, found))
        .when(kind == "date", date(key, found))
        .when(kind == "ssn", in_format(found, let(digits, lambda d: ssn(key, d))))
        .when(kind == "phone", in_format(found, number))
        .when(kind == "card", in_format(found, let(digits, lambda d: card(key, d))))
        .when(kind == "secret", secret(key, found))
        .otherwise(found)
    )


def _number(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda m: m["kind"] == kind)).cast("long")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Every row of docs with text_col rewritten and struct column private: the number of finds of each kind.

    Numbers (card numbers of 13 to 19 digits that pass the Luhn check, telephone and social-security numbers, IPv4 addresses) and dates are permuted under key
    within their format, so that they stay valid, are as many, and can be turned back with the key; a card number still passes
    the check, and one that does not pass is no card and stays. Mail addresses and secrets in quotes become keyed hashes of like form. Equal values get equal
    pseudonyms in every document. A null text stays null, without finds; a text without a digit, an at sign or
    a secret's name is not searched further. Rows are treated one by one: ids, repeated rows and other columns, whatever their names but private, don't matter. No shuffle.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(f"`{text_col}`").cast("string")
    names = docs.columns
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # a subquery's value, so that the key stands in no plan, event log or page
    secret_key = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    each = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text.alias("text"), F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m"))).alias("found"), secret_key.alias("key"))
    own = F.col("key")

    def rewritten(gaps: Column) -> Column:
        parts = F.zip_with(gaps, F.col("found"), lambda g, m: F.concat(g, F.coalesce(pseudonym(own, m["kind"], m["m"]), F.lit(""))))
        return F.array_join(parts, "")

    new = F.when(F.size("found") > 0, let(F.split("text", ANY), rewritten)).otherwise(F.col("text"))
    counts = F.struct(*(_number("found", k).alias(f"n_{k}") for k in KINDS))
    columns = [new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names]
    return each.select(*columns, counts.alias("private"))
