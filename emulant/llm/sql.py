"""Pieces of SQL that several checks share."""

from __future__ import annotations

#: Words of a whole text.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Unsigned crc32 of the decimal form of a column: eight shifts for each of its characters.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), "
    "lambda ch: CAST(ascii(ch) AS BIGINT))), lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT)"
)
