"""Checksum predicates as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplication and permutation tables of the Verhoeff scheme.
VERHOEFF_D = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
VERHOEFF_P = ("0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258")
#: The alphabet of the mod-36 check character.
MOD36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shape of a GST number.
GSTIN = r"^\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_valid(c: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten; separators are ignored."""
    d = digits(c)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def _table(rows: tuple[str, ...]) -> Column:
    return F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in rows])


def verhoeff_valid(c: Column) -> Column:
    """The Verhoeff sum of the digits is zero; no digits are valid by the same rule."""
    d = F.reverse(digits(c))
    each = F.transform(F.filter(F.split(d, ""), lambda x: x != ""), lambda x, i: F.struct(x.cast("int").alias("x"), i.alias("i")))
    table, permute = _table(VERHOEFF_D), _table(VERHOEFF_P)
    total = F.aggregate(each, F.lit(0), lambda s, e: F.get(F.get(table, s), F.get(F.get(permute, e["i"] % 8), e["x"])))
    return F.coalesce(total == 0, F.lit(False))


def aadhaar_valid(c: Column) -> Column:
    d = digits(c)
    return F.coalesce((F.length(d) == 12) & d.rlike("^[2-9]"), F.lit(False)) & verhoeff_valid(c)


def gstin_valid(c: Column) -> Column:
    """The shape, and the mod-36 check character over the first fourteen characters."""
    s = F.upper(c)
    each = F.transform(F.split(F.left(s, F.lit(14)), ""), lambda x, i: (F.instr(F.lit(MOD36), x) - 1) * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(F.filter(each, lambda v: v >= 0), F.lit(0), lambda a, v: a + F.floor(v / 36).cast("int") + v % 36)
    check = F.substring(F.lit(MOD36), 1, 36)
    want = F.substr(check, ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))
    return F.coalesce(s.rlike(GSTIN) & (want == F.substring(s, 15, 1)), F.lit(False))
