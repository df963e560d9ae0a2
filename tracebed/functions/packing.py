"""Packed values: a nibble tells how many bytes a value has and whether they are negated."""

from __future__ import annotations

import struct

SIGNED_BITS = {32: 24, 64: 56}


def pack_unsigned(value: int) -> tuple[int, bytes]:
    size = max(1, (value.bit_length() + 7) // 8)
    return size, value.to_bytes(size, "little")


def pack_signed(value: int, bits: int) -> tuple[int, bytes]:
    """Small negative values are kept by their size with 8 added to the nibble; others as they are in memory."""
    if -(1 << SIGNED_BITS[bits]) < value < 0:
        size, data = pack_unsigned(-value)
        return size + 8, data
    return pack_unsigned(value & ((1 << bits) - 1))


def pack_float(value: float, single: bool = False) -> tuple[int, bytes]:
    return (4, struct.pack("<f", value)) if single else (8, struct.pack("<d", value))


def size_of(nibble: int) -> int:
    return 16 if nibble == 0 else nibble if nibble <= 8 else nibble - 8


def unpack_integer(nibble: int, data: bytes) -> int:
    """The value as an unsigned or negated number; the caller wraps it to its type."""
    value = int.from_bytes(data, "little") if nibble else 0
    return -value if nibble > 8 else value


def unpack_float(nibble: int, data: bytes) -> float:
    if nibble == 4:
        return struct.unpack("<f", data)[0]
    return struct.unpack("<d", data)[0] if nibble == 8 else extended(data[:10])


def extended(data: bytes) -> float:
    """An 80-bit x87 number as a double."""
    mantissa, head = struct.unpack("<QH", data[:10])
    sign, exponent = (-1.0 if head >> 15 else 1.0), head & 0x7FFF
    if exponent == 0x7FFF:
        return sign * float("inf") if mantissa << 1 & (1 << 64) - 1 == 0 else float("nan")
    if not mantissa:
        return sign * 0.0
    from math import ldexp

    return sign * ldexp(mantissa, exponent - 16383 - 63)


def to_extended(value: float) -> bytes:
    from math import copysign, frexp, isinf, isnan

    head = 0x8000 if copysign(1.0, value) < 0 else 0
    if value == 0:
        return struct.pack("<QH", 0, head) + bytes(6)
    if isinf(value) or isnan(value):
        return struct.pack("<QH", (1 << 63) | (isnan(value) << 62), head | 0x7FFF) + bytes(6)
    fraction, exponent = frexp(abs(value))
    return struct.pack("<QH", int(fraction * (1 << 64)), head | (exponent + 16382)) + bytes(6)


def join_nibbles(nibbles: list[int]) -> bytes:
    """Low nibble first; 16 is kept as 0."""
    padded = [n & 15 for n in nibbles] + [0] * (len(nibbles) % 2)
    return bytes(a | b << 4 for a, b in zip(padded[::2], padded[1::2], strict=True))


def split_nibbles(data: bytes, n: int) -> list[int]:
    return [x for b in data for x in (b & 15, b >> 4)][:n]
