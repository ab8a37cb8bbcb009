"""Exact money in integer nano-USD as DECIMAL(38,0); nothing here passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = "decimal(38,0)"
MILLION = 1_000_000
CLASSES = ("input", "output", "cache_write", "cache_read")
#: Token counts above this are no exact integers where the logs come from.
MAX_TOKENS = (1 << 53) - 1


def price_to_nano(price: Column) -> Column:
    """A decimal price per million tokens, at most nine decimals, as nano-USD per million; else null."""
    text = F.trim(price)
    value = F.try_to_number(text, F.lit("999999999.999999999"))
    whole = F.when(text.rlike(r"^\d{1,9}(\.\d{1,9})?$"), value)
    return (whole.cast("decimal(18,9)") * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("bigint")


def class_cost(tokens: Column, nano: Column) -> Column:
    """floor(tokens * nano / 10^6) for tokens below 2^53 and any bigint price.

    The product may exceed 64 bits, so tokens are split at a million: the high part times the price
    is exact as a decimal, the rest stays within bigint.
    """
    high, low = _div(tokens, MILLION), F.pmod(tokens, F.lit(MILLION).cast("bigint"))
    rest = low * _div(nano, MILLION) + _div(low * F.pmod(nano, F.lit(MILLION).cast("bigint")), MILLION)
    return (high.cast("decimal(11,0)") * nano.cast("decimal(19,0)") + rest.cast("decimal(19,0)")).cast(NANO)


def _div(a: Column, b: int) -> Column:
    """Integer division of non-negative bigints."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def cents_half_even(nano: Column) -> Column:
    """Nano-USD to cents, half to even, the same on either side of zero."""
    ten = F.lit(10_000_000).cast(NANO)
    size = F.abs(nano)
    rest = size % ten
    cents = ((size - rest) / ten).cast(NANO)
    up = (rest * 2 > ten) | ((rest * 2 == ten) & (cents % 2 == 1))
    return (F.signum(nano.cast("double")).cast(NANO) * (cents + F.when(up, 1).otherwise(0))).cast(NANO)


def nano_to_usd(nano: Column) -> Column:
    """Two decimals without grouping: ``-1234.50``."""
    cents = cents_half_even(nano)
    size = F.abs(cents)
    text = F.concat(((size - size % 100) / 100).cast(NANO).cast("string"), F.lit("."), F.lpad((size % 100).cast(NANO).cast("string"), 2, "0"))
    return F.concat(F.when(cents < 0, "-").otherwise(""), text)


# The same on the driver, for collected results.


def cost_int(tokens: int, nano: int) -> int:
    return tokens * nano // MILLION


def cents_int(nano: int) -> int:
    q, r = divmod(abs(nano), 10_000_000)
    q += r > 5_000_000 or (r == 5_000_000 and q % 2 == 1)
    return -q if nano < 0 else q


def usd_string(nano: int) -> str:
    cents = cents_int(nano)
    return f"{'-' if cents < 0 else ''}{abs(cents) // 100}.{abs(cents) % 100:02d}"


def format_usd(nano: int) -> str:
    cents = cents_int(nano)
    return f"{'-' if cents < 0 else ''}${abs(cents) // 100:,}.{abs(cents) % 100:02d}"


def money_json(nano: int) -> dict[str, str]:
    return {"nanoUsd": str(nano), "usd": usd_string(nano)}
