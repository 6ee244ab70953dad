"""SQL shared by the checks of this subpackage."""

# CRC-32 of a column's ASCII text, byte by byte, bit by bit
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda b: ord(b)::BIGINT)),
 lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
