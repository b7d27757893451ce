"""Order-preserving keys: tuples as bytes that compare as the tuples do, and as columns.

A field is a tag and its value: NULL 01, FALSE 02, TRUE 03, INT 04 and 8 bytes with the sign bit turned, UINT 05 and 8
bytes, TEXT 06 and its bytes with 00 written as 00 FF, closed by 00 00.  A descending field has all its bits turned.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags of the format.
NULL, FALSE, TRUE, INT, UINT, TEXT = 1, 2, 3, 4, 5, 6


class Unsigned(int):
    """A UINT value, to tell it from an INT."""


Value = None | bool | int | Unsigned | str | bytes


def encode_field(value: Value, descending: bool = False) -> bytes:
    if value is None:
        out = bytes([NULL])
    elif isinstance(value, bool):
        out = bytes([TRUE if value else FALSE])
    elif isinstance(value, Unsigned):
        out = bytes([UINT]) + int(value).to_bytes(8, "big")
    elif isinstance(value, int):
        out = bytes([INT]) + (value + 2**63).to_bytes(8, "big")
    else:
        data = value.encode() if isinstance(value, str) else value
        out = bytes([TEXT]) + data.replace(b"\x00", b"\x00\xff") + b"\x00\x00"
    return bytes(255 - b for b in out) if descending else out


def encode(values: Sequence[Value], descending: Sequence[bool] = ()) -> bytes:
    turned = [*descending, *[False] * (len(values) - len(descending))]
    return b"".join(map(encode_field, values, turned))


def decode_field(data: bytes, at: int = 0, descending: bool = False) -> tuple[Value, int]:
    """The value that starts at an offset (TEXT as bytes), and where the next one starts."""
    turn = 255 if descending else 0

    def byte(k: int) -> int:
        if k >= len(data):
            raise ValueError("a key ends within a field")
        return data[k] ^ turn

    tag = byte(at)
    if tag in (NULL, FALSE, TRUE):
        return {NULL: None, FALSE: False, TRUE: True}[tag], at + 1
    if tag in (INT, UINT):
        number = int.from_bytes(bytes(byte(k) for k in range(at + 1, at + 9)), "big")
        return (Unsigned(number) if tag == UINT else number - 2**63), at + 9
    if tag != TEXT:
        raise ValueError(f"no field has the tag {tag}")
    out, k = bytearray(), at + 1
    while True:
        b = byte(k)
        if b:
            out.append(b)
            k += 1
        elif (after := byte(k + 1)) == 0:
            return bytes(out), k + 2
        elif after == 255:
            out.append(0)
            k += 2
        else:
            raise ValueError("a text field has a lone zero byte")


def decode(data: bytes, descending: Sequence[bool] = ()) -> list[Value]:
    out, at = [], 0
    while at < len(data):
        value, at = decode_field(data, at, len(out) < len(descending) and descending[len(out)])
        out.append(value)
    return out


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key after all keys with a prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def ordering(value: Value) -> tuple:
    """A sort key of one value: by tag, then by value."""
    if value is None or isinstance(value, bool):
        return (NULL if value is None else TRUE if value else FALSE,)
    if isinstance(value, int):
        return (UINT if isinstance(value, Unsigned) else INT, int(value))
    return (TEXT, value.encode() if isinstance(value, str) else value)


def compare(a: Sequence[Value], b: Sequence[Value], descending: Sequence[bool] = ()) -> int:
    """-1, 0 or 1, as the encoded tuples compare."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        x, y = ordering(x), ordering(y)
        if x != y:
            return (1 if x < y else -1) if k < len(descending) and descending[k] else (-1 if x < y else 1)
    return (len(a) > len(b)) - (len(a) < len(b))


def encoded(column: Column, kind: str, descending: bool = False) -> Column:
    """The field of a column of kind BOOL, INT, UINT or TEXT, by built-in functions."""
    if kind == "BOOL":
        digits = F.when(column, "03").when(~column, "02")
    elif kind == "INT":
        # Hex of a long is of its two's complement; adding 2**63 turns the sign bit.
        digits = F.concat(F.lit("04"), F.lpad(F.hex(column.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    elif kind == "UINT":
        low = column.cast("decimal(20,0)")
        as_long = F.when(low >= F.lit(Decimal(2**63)), (low - F.lit(Decimal(2**64)))).otherwise(low.cast("decimal(21,0)")).cast("long")
        digits = F.concat(F.lit("05"), F.lpad(F.hex(as_long), 16, "0"))
    else:
        # Pairs of digits are kept apart while 00 is replaced.
        pairs = F.regexp_replace(F.hex(column.cast("binary")), "(..)", "$1 ")
        digits = F.concat(F.lit("06"), F.replace(F.replace(pairs, F.lit("00 "), F.lit("00FF")), F.lit(" "), F.lit("")), F.lit("0000"))
    digits = F.coalesce(digits, F.lit("01"))
    return F.unhex(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210") if descending else digits)


def encoded_key(columns: Sequence[tuple[Column, str, bool]]) -> Column:
    """The key of several (column, kind, descending)."""
    return F.concat(*(encoded(*c) for c in columns))
