"""Format strings, packed values and printf against fixtures and C's rules."""

import math
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracebed.functions.fmt import FormatError, Renderer, hex_dump, log_id_key, num_nibbles, param_types, parse_format, signature
from tracebed.functions.packing import extended, join_nibbles, pack_float, pack_signed, pack_unsigned, split_nibbles, to_extended, unpack_float, unpack_integer


@pytest.mark.parametrize(
    ("fmt", "types", "nibbles"),
    [
        ("Nothing", ["NONE"], 0),
        ("%% %*.4s %lf %Lf %4.*ls %*.*d blah", ["const_char_ptr_t", "double_t", "long_double_t", "const_wchar_t_ptr_t", "int_t"], 7),
        ("%%%lf%Lf%*.*d", ["double_t", "long_double_t", "int_t"], 5),
    ],
)
def test_fragments(fmt, types, nibbles):
    pieces = parse_format(fmt)
    assert [p.arg_type for p in pieces] == types
    assert num_nibbles(pieces) == nibbles
    assert "".join(p.fragment for p in pieces) == fmt


@pytest.mark.parametrize("fmt", ["%Ls", "%hhn", "%jn", "%zn", "%lp"])
def test_rejected(fmt):
    with pytest.raises(FormatError):
        parse_format(fmt)


def test_params():
    assert param_types("Hello %*.*d %%%s %*.*s %10.500s %10.500d %+#.s") == ["W", "P", "N", "S", "W", "P", "SP", 500, "N", 0]
    assert signature("%*d %s") == "int_t, int_t, const_char_ptr_t"
    assert parse_format(r"\%d %d")[0].arg_type == "int_t" and len(parse_format(r"\%d %d")) == 1


@pytest.mark.parametrize(
    ("fmt", "value", "text"),
    [
        ("%d", {"i": -1}, "-1"), ("%5d|", {"i": 42}, "   42|"), ("%-5d|", {"i": 42}, "42   |"), ("%05d", {"i": -42}, "-0042"), ("%+d", {"i": 3}, "+3"),
        ("%.3d", {"i": 7}, "007"), ("%u", {"i": -1}, "4294967295"), ("%hhd", {"i": 255}, "-1"), ("%hu", {"i": 65536 + 20002}, "20002"),
        ("%ho", {"i": 20003}, "47043"), ("%#o", {"i": 8}, "010"), ("%#x", {"i": 255}, "0xff"), ("%lX", {"u": 2**64 - 1}, "FFFFFFFFFFFFFFFF"),
        ("%f", {"d": 0.11}, "0.110000"), ("%.2f", {"d": 0.125}, "0.12"), ("%6.1f", {"d": 2.25}, "   2.2"), ("%e", {"d": 9.0}, "9.000000e+00"), ("%E", {"d": 10.0}, "1.000000E+01"),
        ("%g", {"d": 11.0}, "11"), ("%a", {"d": 13.0}, "0x1.ap+3"), ("%A", {"d": 14.0}, "0X1.CP+3"), ("%La", {"d": 13.0}, "0xdp+0"), ("%LA", {"d": 14.0}, "0XEP+0"),
        ("%c", {"i": 97}, "a"), ("%s", {"s": "abc"}, "abc"), ("%.2s", {"s": "abc"}, "ab"), ("%6s|", {"s": "abc"}, "   abc|"), ("%p", {"u": 1}, "0x1"), ("%p", {"u": 0}, "(nil)"),
        ("%*.*lf", {"d": 12345.12345, "width": 10, "prec": 2}, "  12345.12"), ("%*d|", {"i": 5, "width": -4}, "5   |"), ("%.*s", {"s": "abc", "prec": -1}, "abc"),
        ("%f", {"d": math.inf}, "inf"), ("100%% %d", {"i": 1}, "100% 1"), ("%.1s", {"s": "é"}, "�"),
    ],
)
def test_printf(fmt, value, text):
    assert Renderer(fmt)([value]) == text


@given(st.integers(-(2**63), 2**64 - 1))
def test_printf_integers(value):
    assert Renderer("%ld")([{"i": value}]) == str((value + 2**63) % 2**64 - 2**63)
    assert Renderer("%lu")([{"u": value}]) == str(value % 2**64)


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_hex_floats(value):
    assert float.fromhex(Renderer("%a")([{"d": value}])) == value
    assert float.fromhex(Renderer("%La")([{"d": value}])) == value
    assert extended(to_extended(value)) == value


@pytest.mark.parametrize(("value", "size"), [(0, 1), (255, 1), (2**8, 2), (2**16, 3), (2**24, 4), (2**32, 5), (2**40, 6), (2**48, 7), (2**56, 8)])
def test_pack_unsigned(value, size):
    assert pack_unsigned(value)[0] == size == len(pack_unsigned(value)[1])


@pytest.mark.parametrize(("value", "bits", "code"), [(-1, 32, 9), (-255, 32, 9), (-(2**8), 32, 10), (-(2**16), 32, 11), (-(2**24), 32, 4), (-(2**24), 64, 12), (-(2**56), 64, 8)])
def test_pack_signed(value, bits, code):
    assert pack_signed(value, bits)[0] == code


@given(st.integers(-(2**63), 2**63 - 1))
def test_signed_round_trip(value):
    code, data = pack_signed(value, 64)
    assert (unpack_integer(code, data) + 2**63) % 2**64 - 2**63 == value


def test_pack_float():
    assert pack_float(1.5, single=True)[0] == 4 and unpack_float(*pack_float(1.5, single=True)) == 1.5
    assert unpack_float(*pack_float(math.pi)) == math.pi
    assert unpack_float(0, struct.pack("<QH", 1 << 63, 16383) + bytes(6)) == 1.0


@given(st.lists(st.integers(1, 16)))
def test_nibbles(codes):
    assert split_nibbles(join_nibbles(codes), len(codes)) == [c % 16 for c in codes]


def test_small_helpers():
    assert log_id_key("a b", "f_é.c", 3) == "__a32b__f95é46c__3__"
    keys = [log_id_key("m", "f.c", n) for n in (2, 20)]
    assert sorted(keys) == keys[::-1]  # digits come before the mark that ends a name
    assert hex_dump(b"Hello\n") == "0000000000000000  48 65 6c 6c 6f 0a" + " " * 33 + "|Hello.|\n"
    assert hex_dump(bytes(range(17))).splitlines()[1] == "0000000000000010  10" + " " * 48 + "|.|"
    assert hex_dump(b"") == ""


def test_lenient_parsing():
    assert parse_format("%Ls", strict=False) is None and parse_format("%d", strict=False) == parse_format("%d")
    assert [p.arg_type for p in parse_format("%Zd")] == ["size_t_t"]
