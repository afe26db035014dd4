"""Pieces of DuckDB SQL that more than one query's SQL needs."""

#: A common table: the 256 remainders of CRC-32, worked out bit by bit from its polynomial.
CRC_TABLE = """crc_table AS (SELECT list(r ORDER BY i) AS entries FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) t(i)))"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, where crc_table is joined."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295)"
