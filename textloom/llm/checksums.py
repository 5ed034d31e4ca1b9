"""CRC-32 in DuckDB SQL, which has none of its own."""

from __future__ import annotations

#: A common table ``crc`` of one row, whose list ``t`` holds the remainders of all bytes.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS t FROM (
             SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END, i::BIGINT) AS c
             FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text expression's UTF-8 bytes, where ``crc`` is joined."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({digits}, lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
