"""Pieces of SQL that several oracles need."""

from __future__ import annotations

_BIT = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"


class _Crc32:
    """CRC-32 of a text's UTF-8 bytes, byte by byte over the table of a byte's remainders."""

    # A relation with one row and the column ``remainders``.
    table = (
        "select list_transform(range(256), lambda i: list_reduce("
        f"list_prepend(i, range(8)), lambda c, k: {_BIT})) as remainders"
    )

    def __call__(self, text: str) -> str:
        bytes_of = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as bigint))"
        step = "xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
        return f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: {step}), 4294967295)"


crc32 = _Crc32()
