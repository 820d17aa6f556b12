"""Scalar functions on text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lookup_key(x: Column) -> Column:
    """What two mentions of one entity have in common."""
    return F.lower(stripped(x))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_valid(x: Column) -> Column:
    return F.call_function("luhn_check", digits(x))


def iban_valid(x: Column) -> Column:
    """ISO 13616: the rotated number, letters as two digits, leaves 1 divided by 97; 15 to 34 characters."""
    plain = F.upper(F.regexp_replace(x, "[^0-9A-Za-z]", ""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def octets_valid(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)


def file_key(x: Column) -> Column:
    """A name that any file system takes."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}_.-]", "_")


def bare_mime(x: Column) -> Column:
    """A MIME type without its parameters."""
    return F.lower(F.trim(F.split_part(x, F.lit(";"), F.lit(1))))


def data_uri_mime(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, "^data:([^;,]+)", 1), F.lit(""))


def data_uri_bytes(x: Column) -> Column:
    """The payload after the first comma; null for anything else than base64 data."""
    payload = F.substring(x, F.instr(x, ",") + 1, F.length(x))
    return F.when(x.startswith("data:") & (F.instr(x, ",") > 0), F.try_to_binary(payload, F.lit("base64")))


def data_uri(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
