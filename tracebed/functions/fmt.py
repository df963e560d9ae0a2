"""Format strings: fragments, argument types, parameter kinds, and C's printf in Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import isfinite
from typing import Any

# C's conversion syntax, and the names and widths of its types.
SPEC = re.compile(r"%(?P<flags>[-+ #0]*)(?P<width>\d+|\*)?(?P<dot>\.(?P<prec>\d+|\*)?)?(?P<length>hh|h|ll|l|L|j|z|Z|t)?(?P<conv>[diuoxXfFeEgGaAcspn])")
NONE = "NONE"
SIGNED = {"hh": "signed_char_t", "h": "short_int_t", "": "int_t", "l": "long_int_t", "ll": "long_long_int_t", "j": "intmax_t_t", "z": "size_t_t", "Z": "size_t_t", "t": "ptrdiff_t_t"}
UNSIGNED = {"hh": "unsigned_char_t", "h": "unsigned_short_int_t", "": "unsigned_int_t", "l": "unsigned_long_int_t", "ll": "unsigned_long_long_int_t", "j": "uintmax_t_t", "z": "size_t_t", "Z": "size_t_t", "t": "ptrdiff_t_t"}
STRINGS = ("const_char_ptr_t", "const_wchar_t_ptr_t")
#: Bits of each integer type; negative: signed.
BITS = {"unsigned_char_t": 8, "unsigned_short_int_t": 16, "unsigned_int_t": 32, "unsigned_long_int_t": 64, "unsigned_long_long_int_t": 64, "uintmax_t_t": 64, "size_t_t": 64, "const_void_ptr_t": 64, "wint_t_t": 32, "signed_char_t": -8, "short_int_t": -16, "int_t": -32, "long_int_t": -64, "long_long_int_t": -64, "intmax_t_t": -64, "ptrdiff_t_t": -64}


class FormatError(ValueError):
    """A format string with a specifier that has no type."""


@dataclass(frozen=True)
class Fragment:
    arg_type: str
    dyn_width: bool
    dyn_prec: bool
    fragment: str


def arg_type(length: str | None, conv: str) -> str | None:
    """The type of an argument, or None for a pair that C does not know."""
    length = length or ""
    if conv in "di":
        return SIGNED.get(length)
    if conv in "uoxX":
        return UNSIGNED.get(length)
    if conv in "fFeEgGaA":
        return "long_double_t" if length == "L" else "double_t"
    if conv == "c":
        return {"": "int_t", "l": "wint_t_t"}.get(length)
    if conv == "s":
        return {"": STRINGS[0], "l": STRINGS[1]}.get(length)
    return "const_void_ptr_t" if conv == "p" and not length else None


def specifiers(fmt: str) -> list[re.Match]:
    """Conversion specifiers; a backslash hides the character after it, and %% is text."""
    out, at = [], 0
    while at < len(fmt):
        if fmt[at] == "\\":
            at += 2
        elif fmt[at] != "%":
            at += 1
        elif fmt.startswith("%%", at):
            at += 2
        elif m := SPEC.match(fmt, at):
            out.append(m)
            at = m.end()
        else:
            at += 1
    return out


def parse_format(fmt: str, strict: bool = True) -> list[Fragment] | None:
    """Pieces with one specifier each; text after the last belongs to it, a text without any is one piece.

    A specifier without a type is an error; where not strict, as logs are read, it gives no pieces at all."""
    found = specifiers(fmt)
    if not found:
        return [Fragment(NONE, False, False, fmt)]
    out, begin = [], 0
    for k, m in enumerate(found):
        kind = arg_type(m["length"], m["conv"])
        if kind is None and not strict:
            return None
        if kind is None:
            raise FormatError(f"{m[0]!r} in {fmt!r} has no type")
        end = len(fmt) if k == len(found) - 1 else m.end()
        out.append(Fragment(kind, m["width"] == "*", m["prec"] == "*", fmt[begin:end]))
        begin = end
    return out


def num_nibbles(fragments: list[Fragment]) -> int:
    """Values that are packed: all but strings, with dynamic widths and precisions."""
    return sum(f.dyn_width + f.dyn_prec + (f.arg_type not in (*STRINGS, NONE)) for f in fragments)


def param_types(fmt: str) -> list[str | int]:
    """For each parameter: W, P (dynamic width, precision), N (no string), S (string), SP (string of dynamic precision), or a string's precision."""
    out: list[str | int] = []
    for m in specifiers(fmt):
        if m["width"] == "*":
            out.append("W")
        if m["prec"] == "*":
            out.append("P")
        if m["conv"] != "s":
            out.append("N")
        elif m["prec"] == "*":
            out.append("SP")
        else:
            out.append(int(m["prec"] or 0) if m["dot"] else "S")
    return out


def signature(fmt: str) -> str:
    """The types of the arguments of a message, in order."""
    out = []
    for f in parse_format(fmt):
        out += ["int_t"] * (f.dyn_width + f.dyn_prec) + [f.arg_type] * (f.arg_type != NONE)
    return ", ".join(out)


# --- printf -------------------------------------------------------------------------------------------------------------


def c_integer(m: re.Match, kind: str, value: int, width: int | None, prec: int | None, flags: str) -> str:
    bits = abs(BITS[kind])
    value &= (1 << bits) - 1
    conv = m["conv"]
    if conv in "di":
        if value >> (bits - 1):
            value -= 1 << bits
        digits, sign = str(abs(value)), "-" if value < 0 else "+" if "+" in flags else " " if " " in flags else ""
    else:
        digits, sign = {"u": "d", "o": "o", "x": "x", "X": "X"}[conv], ""
        digits = format(value, digits)
    if prec is not None:
        digits = "" if prec == 0 and value == 0 else digits.rjust(prec, "0")
    if "#" in flags and conv == "o" and not digits.startswith("0"):
        digits = "0" + digits
    prefix = sign + ("0" + conv if "#" in flags and conv in "xX" and value else "")
    return pad(prefix, digits, width, flags, zero="0" in flags and prec is None)


def pad(prefix: str, body: str, width: int | None, flags: str, zero: bool) -> str:
    room = (width or 0) - len(prefix) - len(body)
    if room <= 0:
        return prefix + body
    if "-" in flags:
        return prefix + body + " " * room
    return prefix + "0" * room + body if zero else " " * room + prefix + body


def c_hex(value: float, prec: int | None, upper: bool, long: bool) -> str:
    """%a: hexadecimal without trailing zeros, of an 80-bit number for long double."""
    if value == 0:
        out = "0x0" + ("." + "0" * prec if prec else "") + "p+0"
    else:
        mantissa, exponent = float(value).hex().removeprefix("-").removeprefix("0x").split("p")
        exp = int(exponent)
        lead, _, digits = mantissa.partition(".")
        number, bits = int(lead + digits, 16), 4 * len(digits)
        if long:  # four bits before the point
            number, bits, exp = number << 3, bits + 0, exp - 3
        if prec is not None and 4 * prec < bits:
            cut = bits - 4 * prec
            low, number = number & ((1 << cut) - 1), number >> cut
            number += low > 1 << (cut - 1) or low == 1 << (cut - 1) and number & 1
            bits = 4 * prec
        text = format(number & ((1 << bits) - 1), f"0{bits // 4}x") if bits else ""
        text = text.rstrip("0") if prec is None else text.ljust(prec, "0")
        out = f"0x{number >> bits:x}" + ("." + text if text else "") + f"p{exp:+d}"
    return out.upper() if upper else out


def c_float(m: re.Match, kind: str, value: float, width: int | None, prec: int | None, flags: str) -> str:
    conv = m["conv"]
    sign = "-" if str(value).startswith("-") else "+" if "+" in flags else " " if " " in flags else ""
    size, finite = abs(value), value == value and abs(value) != float("inf")
    if not finite:
        body = ("nan" if value != value else "inf").upper() if conv.isupper() else "nan" if value != value else "inf"
    elif conv in "aA":
        hexed = c_hex(size, prec, conv == "A", kind == "long_double_t")
        return pad(sign + hexed[:2], hexed[2:], width, flags, "0" in flags)
    else:
        body = f"%{'#' if '#' in flags else ''}.{6 if prec is None else prec}{conv}" % size
    return pad(sign, body, width, flags, "0" in flags and finite)


def c_format(m: re.Match, kind: str, value: Any, width: int | None, prec: int | None) -> str:
    """One conversion; a negative width is the flag -, a negative precision is none."""
    flags = m["flags"]
    if width is None and m["width"] not in (None, "*"):
        width = int(m["width"])
    if width is not None and width < 0:
        flags, width = flags + "-", -width
    if m["dot"] and m["prec"] != "*":
        prec = int(m["prec"] or 0)
    if prec is not None and prec < 0:
        prec = None
    conv = m["conv"]
    if conv == "s":
        raw = value if isinstance(value, bytes) else str(value).encode()
        if prec is not None:
            raw = raw[:prec]  # C counts bytes
        room = (width or 0) - len(raw)
        text = raw.decode("utf-8", "replace")
        return text if room <= 0 else text + " " * room if "-" in flags else " " * room + text
    if conv == "c":
        return pad("", chr(int(value) & (0xFF if kind == "int_t" else 0x1FFFFF)), width, flags, False)
    if conv == "p":
        return pad("", f"0x{int(value):x}" if value else "(nil)", width, flags, False)
    if kind in ("double_t", "long_double_t"):
        return c_float(m, kind, float(value), width, prec, flags)
    return c_integer(m, kind, int(value), width, prec, flags)


def converter(m: re.Match, kind: str) -> Callable[[Any], str]:
    """c_format of one conversion that gets no width or precision of its own; what Python's % does as C does goes there."""
    conv, flags, whole = m["conv"], m["flags"], lambda v: c_format(m, kind, v, None, None)
    if "*" in (m["width"], m["prec"]):
        return whole
    if conv in "fFeEgG":
        spec = f"%{flags}{m['width'] or ''}{m['dot'] or ''}{conv}"
        return lambda v: spec % x if isfinite(x := float(v)) else whole(v)
    if m["dot"] or conv not in "diuxX" or conv in "xX" and "#" in flags:
        return whole
    half, signed = 1 << abs(BITS[kind]) - 1, conv in "di"
    mask, flags = 2 * half - 1, flags.replace("#", "") if signed else re.sub("[+ #]", "", flags)
    spec = f"%{flags}{m['width'] or ''}{conv if conv in 'xX' else 'd'}"
    return (lambda v: spec % ((int(v) + half & mask) - half)) if signed else lambda v: spec % (int(v) & mask)


class Renderer:
    """A format, parsed once, applied to the arguments of many messages."""

    def __init__(self, fmt: str):
        self.steps, begin = [], 0
        found = specifiers(fmt)
        for m, f in zip(found, parse_format(fmt), strict=False):
            self.steps.append((fmt[begin : m.start()].replace("%%", "%"), m, f.arg_type))
            begin = m.end()
        self.tail = fmt[begin:].replace("%%", "%")
        self.converters = [converter(m, kind) for _, m, kind in self.steps]

    def __call__(self, args: list[dict]) -> str:
        out = []
        for (text, m, kind), a in zip(self.steps, args, strict=False):
            value = next((a[k] for k in ("s", "d", "u", "i") if a.get(k) is not None), a.get("b"))
            out += [text, c_format(m, kind, value, a.get("width"), a.get("prec"))]
        return "".join([*out, self.tail])


def log_id_key(fmt: str, filename: str, line: int) -> str:
    """A name made of letters, digits and ordinals, in any alphabet; its order is the canonical order of messages."""
    parts = [re.sub(r"\W|_", lambda c: str(ord(c[0])), text) for text in (fmt, filename)]
    return "__".join(["", *parts, str(line), ""])


def hex_dump(data: bytes) -> str:
    """Offsets of 16 digits, two groups of eight bytes, and the printable ones; a line for each 16 bytes."""
    out = []
    for i in range(0, len(data), 16):
        row = data[i : i + 16]
        pairs = [f"{b:02x}" for b in row] + ["  "] * (16 - len(row))
        shown = "".join(chr(b) if 32 <= b < 127 else "." for b in row)
        out.append(f"{i:016x}  {' '.join(pairs[:8])}  {' '.join(pairs[8:])}  |{shown}|\n")
    return "".join(out)
