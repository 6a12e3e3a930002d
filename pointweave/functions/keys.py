"""Grid cells and packed cell keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the key layout: 21 bits per axis, signed keys biased by 2^20.
AXIS_BITS = 21
AXIS_MASK = (1 << AXIS_BITS) - 1
AXIS_BIAS = 1 << (AXIS_BITS - 1)

# Fixed values of the spatial hash: one prime per axis and the table size.
HASH_PRIMES = (73856093, 19349663, 83492791)
HASH_TABLE = 1000000


def cell(value, size, origin=0.0) -> Column:
    """Signed grid index, rounding toward minus infinity."""
    return F.floor((value - origin) / size).cast("long")


def cells(p, size, origin=(0.0, 0.0, 0.0)):
    return tuple(cell(c, size, o) for c, o in zip(p, origin))


def centre(index, size, origin=0.0) -> Column:
    return (index + 0.5) * size + origin


def quantize(value, eps) -> Column:
    """Nearest multiple index of ``eps``."""
    return F.floor(value / eps + 0.5).cast("long")


def pack21(gx, gy, gz) -> Column:
    part = [g.bitwiseAND(F.lit(AXIS_MASK)) for g in (gx, gy, gz)]
    return F.shiftleft(part[0], 2 * AXIS_BITS).bitwiseOR(F.shiftleft(part[1], AXIS_BITS)).bitwiseOR(part[2])


def unpack21(key):
    """Signed indices: bit 20 of each field is the sign."""
    fields = [F.shiftrightunsigned(key, s).bitwiseAND(F.lit(AXIS_MASK)) for s in (2 * AXIS_BITS, AXIS_BITS, 0)]
    return tuple(F.when(f >= AXIS_BIAS, f - (AXIS_MASK + 1)).otherwise(f) for f in fields)


def _spread(value: Column) -> Column:
    """Move bit i to bit 3i; one linear sum, so the expression stays small."""
    out = value.bitwiseAND(F.lit(1))
    for bit in range(1, AXIS_BITS):
        out = out.bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit(1 << bit)), 2 * bit))
    return out


def _gather(value: Column) -> Column:
    """Inverse of ``_spread``."""
    out = value.bitwiseAND(F.lit(1))
    for bit in range(1, AXIS_BITS):
        out = out.bitwiseOR(F.shiftrightunsigned(value.bitwiseAND(F.lit(1 << (3 * bit))), 2 * bit))
    return out


def morton(gx, gy, gz) -> Column:
    """Interleave three unsigned 21-bit indices, x in the lowest bit."""
    return _spread(gx).bitwiseOR(F.shiftleft(_spread(gy), 1)).bitwiseOR(F.shiftleft(_spread(gz), 2))


def unmorton(key):
    return tuple(_gather(F.shiftrightunsigned(key, s)) for s in range(3))


def morton_signed(gx, gy, gz) -> Column:
    return morton(gx + AXIS_BIAS, gy + AXIS_BIAS, gz + AXIS_BIAS)


def unmorton_signed(key):
    return tuple(u - AXIS_BIAS for u in unmorton(key))


def spatial_hash(gx, gy, gz, table: int = HASH_TABLE) -> Column:
    """Prime-product hash of a cell over 32-bit wraparound arithmetic."""
    products = []
    for g, prime in zip((gx, gy, gz), HASH_PRIMES):
        low = (g * prime).bitwiseAND(F.lit(0xFFFFFFFF))
        products.append(F.when(low >= 0x80000000, low - 0x100000000).otherwise(low))
    mixed = products[0].bitwiseXOR(products[1]).bitwiseXOR(products[2])
    return F.pmod(mixed, F.lit(table).cast("long"))


def tsdf_to_short(value) -> Column:
    """Clamp to [-1, 1] and scale to a 16-bit integer, truncating toward zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)) * 32767.0).cast("short")


def short_to_tsdf(value) -> Column:
    return value.cast("double") / 32767.0
