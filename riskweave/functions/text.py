"""Text forms: transaction text, redaction, instants, identifiers."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import fixed_values as V


def as_text(value: Column, scale: int, precision: int = 20) -> Column:
    """A decimal printed with a fixed number of places."""
    return value.cast(f"decimal({precision},{scale})").cast("string")


def fill(template: str, **values: Column | str | int) -> Column:
    """A text template as one concat; a null value makes the whole text null."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            value = values[field]
            parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


def transaction_text() -> Column:
    return fill(
        V.TRANSACTION_TEXT,
        amount=as_text(F.col("amount"), 4),
        **{name: F.col(name) for name in ("currency", "from_account", "to_account", "description")},
    )


def pseudonym(account: Column) -> Column:
    return F.substring(F.sha2(account, 256), 1, V.PSEUDONYM_HEX_DIGITS)


def scrub(text: Column) -> Column:
    """Replace social-security numbers, then e-mail addresses, then phone numbers.

    Both kinds of number end in four digits and every address has an @, so
    text without either skips the costly searches.
    """
    digits, at = text.rlike("[0-9]{4}"), F.contains(text, F.lit("@"))

    def addresses(part: Column) -> Column:
        return F.when(at, F.regexp_replace(part, V.EMAIL_PATTERN, V.EMAIL_MARK)).otherwise(part)

    without_ssn = F.regexp_replace(text, V.SSN_PATTERN, V.SSN_MARK)
    return F.when(
        digits, F.regexp_replace(addresses(without_ssn), V.PHONE_PATTERN, V.PHONE_MARK)
    ).otherwise(addresses(text))


def first_sanctioned(text: Column) -> Column:
    """The first sanctioned pattern found in the text, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(p)) for p in V.SANCTIONED_PATTERNS])


def iso_instant(ts: Column) -> Column:
    """UTC instant with no, three or six fraction digits, as short as is exact."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def parse_instant(text: Column) -> Column:
    """A full ISO instant as a timestamp; null for anything else, bare dates included."""
    return F.when(text.rlike(V.INSTANT_PATTERN), F.try_to_timestamp(F.upper(text)))


def canonical_uuid(text: Column) -> Column:
    """Lower-case 36-character UUID; groups without leading zeros are filled up. Null if not a UUID."""
    groups = [
        F.lpad(F.right(F.regexp_extract(text, V.SHORT_UUID_PATTERN, i + 1), F.lit(n)), n, "0")
        for i, n in enumerate((8, 4, 4, 4, 12))
    ]
    return (
        F.when(text.rlike(V.UUID_PATTERN), F.lower(text))
        .when(text.rlike(V.SHORT_UUID_PATTERN) & (F.length(text) <= 36), F.lower(F.concat_ws("-", *groups)))
    )


def uuid_of(*parts: Column) -> Column:
    """A repeatable UUID-shaped id, so that a retried task or batch writes the same row."""
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in cuts])
