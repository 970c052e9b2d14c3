"""Parts that statements of several operators share."""

from __future__ import annotations

#: A table of one row ``t``: what each byte does to a CRC-32 register.
CRC_TABLE = """crc_table as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n::bigint, range(8)),
    lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t)"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 of a text, byte by byte, where ``t`` of ``CRC_TABLE`` is at hand."""
    code = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(length({code}) // 2),
        lambda i: ('0x' || substr({code}, cast(2 * i + 1 as bigint), 2))::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""
