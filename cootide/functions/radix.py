"""Mixed-radix codes of coordinates as column expressions, and their decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

LARGEST = (1 << 63) - 1


def fits(sizes: list[int]) -> bool:
    """Whether codes of these sizes fit 64 bits."""
    return reduce(lambda a, b: a * b, sizes, 1) <= LARGEST


def encode_decimal(columns: list[str], sizes: list[int]) -> Column:
    """``encode`` in decimal numbers of 38 digits."""
    if reduce(lambda a, b: a * b, sizes, 1) >= 10**38:
        raise OverflowError("codes have more than 38 digits")
    code = F.lit(0).cast("decimal(38,0)")
    for c, n in zip(columns, sizes):
        code = (code * F.lit(n).cast("decimal(20,0)") + F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
    return code


def checked_product(sizes: list[int]) -> int:
    out = reduce(lambda a, b: a * b, sizes, 1)
    if out > LARGEST:
        raise OverflowError(f"codes up to {out} do not fit 64 bits")
    return out


def encode(columns: list[Column | str], sizes: list[int]) -> Column:
    """Code of coordinates, the last varying fastest."""
    checked_product(sizes)
    code = F.lit(0).cast("long")
    for c, n in zip(columns, sizes):
        code = code * F.lit(n).cast("long") + (F.col(c) if isinstance(c, str) else c)
    return code


def decode(code: Column, sizes: list[int]) -> list[Column]:
    """Coordinates of a code; the inverse of ``encode``. Codes out of range give nulls."""
    whole = checked_product(sizes)
    out: list[Column] = []
    rest = F.when((code >= 0) & (code < whole), code)
    for n in reversed(sizes):
        out.append(F.pmod(rest, F.lit(n).cast("long")))
        rest = F.floor(rest / n) if whole < (1 << 52) else (rest - F.pmod(rest, F.lit(n).cast("long"))) / n
        rest = rest.cast("long")
    return out[::-1]


def encode_value(coordinates: list[int], sizes: list[int]) -> int | None:
    """Code of plain integers, or None if a coordinate is out of range."""
    if any(not 0 <= c < n for c, n in zip(coordinates, sizes)):
        return None
    return reduce(lambda code, cn: code * cn[1] + cn[0], zip(coordinates, sizes), 0)


def decode_value(code: int, sizes: list[int]) -> list[int] | None:
    if not 0 <= code < reduce(lambda a, b: a * b, sizes, 1):
        return None
    out = []
    for n in reversed(sizes):
        code, c = divmod(code, n)
        out.append(c)
    return out[::-1]


def codes_with(mode: int, value: int, sizes: list[int]) -> list[int]:
    """All codes whose coordinate ``mode`` is ``value``, ascending."""
    step = checked_product(sizes[mode + 1 :])
    span = step * sizes[mode]
    return [outer * span + value * step + inner for outer in range(checked_product(sizes[:mode])) for inner in range(step)]
