"""Column functions that fix how values are written and read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text layouts that are read as timestamps, tried in this order; anything else is null.
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def plain_number(x: Column) -> Column:
    """A number as it is written, without trailing zeros (10, 10.5, 10.004); null for null.

    Whole numbers and those of up to 26 digits before and 12 after the point are written out; others as doubles are.
    """
    number = x.cast("double")
    exact = number.try_cast("decimal(38,12)")
    text = F.rtrim(F.rtrim(exact.cast("string"), F.lit("0")), F.lit("."))
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.try_cast("long").cast("string")).when(exact.cast("double") == number, text).otherwise(number.cast("string"))


def row_key(timestamp: Column, kind: Column, amount: Column, balance: Column) -> Column:
    """SHA-256 of timestamp|type|amount|balance. Null and empty parts are alike."""
    parts = (timestamp, kind, plain_number(amount), plain_number(balance))
    return F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def lenient_timestamp(text: Column) -> Column:
    """Text as a timestamp by the first layout that fits, else null.

    A layout is only tried on texts that have its separators, since one that doesn't fit costs an exception.
    """
    upper = F.upper(text)
    dated, timed, parts = upper.rlike("^[+-]?[0-9]"), upper.contains("T"), upper.contains(".")
    zoned = upper.endswith("Z") | upper.rlike("T.*[+-]")
    fits = (timed & parts, timed & ~parts & zoned, timed & ~parts, ~timed & upper.contains(" "), ~timed & ~upper.contains(" "))
    return F.coalesce(*(F.when(dated & fit, F.try_to_timestamp(text, F.lit(f))) for f, fit in zip(TIMESTAMP_FORMATS, fits, strict=True)))


def iso_millis(ts: Column) -> Column:
    """2026-01-31T12:00:00.000Z, in the session's time zone, which is to be UTC."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis_between(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))


def csv_field(x: Column) -> Column:
    """Quoted where it holds a quote, a comma or a line feed, with quotes doubled; null is empty."""
    text = x.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n]'), quoted).otherwise(text), F.lit(""))


def csv_line(*columns: Column) -> Column:
    """One record without its line end."""
    return F.concat_ws(",", *(csv_field(c) for c in columns))


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes held as signed longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(text: Column) -> Column:
    """A 64-bit hash written in hexadecimal, not padded, as a signed long."""
    return F.conv(text, 16, -10).cast("long")


def stored_hash(meta: Column) -> Column:
    """The hash in a medium's metadata, JSON text whose dHash is hexadecimal; null where the text, the field or the hash isn't well-formed."""
    text = F.try_variant_get(F.try_parse_json(meta), "$.dHash", "string")
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), hash_from_hex(text))


def difference_hash(pixels: Column) -> Column:
    """64 bits from 8 rows of 9 gray values, flattened: whether each is brighter than its right neighbour, first bit highest."""
    bit = lambda i: F.when(F.get(pixels, (i / 8).cast("int") * 9 + i % 8) > F.get(pixels, (i / 8).cast("int") * 9 + i % 8 + 1), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(bit(i)))
