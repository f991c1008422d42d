"""crc32 for SQL engines that do not have it."""

from __future__ import annotations

# Start and end mask, and the reversed polynomial, of crc32.
_MASK, _POLYNOMIAL = 4294967295, 3988292384


def crc32_sql(text: str) -> str:
    """DuckDB SQL: the unsigned crc32 of an ASCII text expression, bit by bit."""
    step = "xor(crc, byte)"
    for _ in range(8):
        shifted = f"CASE WHEN (c & 1) = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END"
        step = f"list_transform([{step}], lambda c: {shifted})[1]"
    values = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    start = f"list_concat([{_MASK}::BIGINT], {values})"
    return f"xor(list_reduce({start}, lambda crc, byte: {step}), {_MASK}::BIGINT)"
