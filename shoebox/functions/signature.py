"""64-bit signatures as signed BIGINT columns (F-01 to F-03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_bigint(h: Column) -> Column:
    """Sixteen hex digits as a signed 64-bit number; null where it isn't hex."""
    return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("bigint"))


def bigint_to_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """F-01: differing bits of two numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """F-02: differing bits of two hex strings."""
    return hamming(hex_to_bigint(a), hex_to_bigint(b))


def band_layout(bits: int, bands: int) -> list[tuple[int, int]]:
    """(shift, width) of contiguous bands from the lowest bit on; the first ones take the odd bits."""
    width, odd = divmod(bits, bands)
    out, shift = [], 0
    for i in range(bands):
        w = width + (i < odd)
        out.append((shift, w))
        shift += w
    return out


def band_key(h: Column, shift: int, width: int) -> Column:
    """F-03: the bits of one band."""
    if width == 0:
        return F.lit(0).cast("bigint")
    mask = (1 << width) - 1 if width < 64 else -1
    return F.shiftrightunsigned(h, min(shift, 63)).bitwiseAND(F.lit(mask).cast("bigint"))
