"""Concentrated-liquidity arithmetic as column expressions. Invalid input gives NULL instead of an error."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Q96 = float(2**96)
TICK_BASE = 1.0001


def number(c: Column | str) -> Column:
    """A wide integer, kept as decimal text, as double; NULL where it is no number."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string").try_cast("double")


def wide_text(c: Column | str) -> Column:
    """An integer of any width as canonical decimal text: no blanks, sign only if negative, no leading zeros."""
    c = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    digits = F.regexp_extract(c, r"^[+-]?0*([0-9]+)$", 1)
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), F.when(c.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits))


def price_of_sqrt(sqrt_x96: Column, decimals0: Column | int, decimals1: Column | int) -> Column:
    d0, d1 = (F.lit(x) if isinstance(x, int) else x for x in (decimals0, decimals1))
    root = sqrt_x96 / F.lit(Q96)
    return F.when(sqrt_x96 > 0, root * root * F.pow(F.lit(10.0), (d0 - d1).cast("double")))


def price_of_tick(tick: Column, decimals0: Column | int, decimals1: Column | int) -> Column:
    d0, d1 = (F.lit(x) if isinstance(x, int) else x for x in (decimals0, decimals1))
    return F.pow(F.lit(TICK_BASE), tick.cast("double")) * F.pow(F.lit(10.0), (d0 - d1).cast("double"))


def tick_of_price(price: Column, decimals0: Column | int, decimals1: Column | int) -> Column:
    d0, d1 = (F.lit(x) if isinstance(x, int) else x for x in (decimals0, decimals1))
    raw = price / F.pow(F.lit(10.0), (d0 - d1).cast("double"))
    return F.when(raw > 0, F.floor(F.log(raw) / F.log(F.lit(TICK_BASE)))).cast("int")


def raw_price(price: Column, decimals0: Column | int, decimals1: Column | int) -> Column:
    """A price per whole token as the price per smallest units that the pool's square roots and ticks are of."""
    d0, d1 = (F.lit(x) if isinstance(x, int) else x for x in (decimals0, decimals1))
    return price / F.pow(F.lit(10.0), (d0 - d1).cast("double"))


def raw_liquidity(liquidity: Column, decimals0: Column | int, decimals1: Column | int) -> Column:
    """Liquidity of amounts in whole tokens, in the units of a pool's ``liquidity``: the root of the product of both units."""
    d0, d1 = (F.lit(x) if isinstance(x, int) else x for x in (decimals0, decimals1))
    return liquidity * F.pow(F.lit(10.0), (d0 + d1).cast("double") / 2)


def price_or_reference(sqrt_x96: Column, reference: Column, decimals0: Column | int, decimals1: Column | int) -> Column:
    """The pool's price, or where it has none the reference's."""
    return F.coalesce(price_of_sqrt(sqrt_x96, decimals0, decimals1), reference)


def input_value(amount0: Column, amount1: Column, reference: Column) -> Column:
    """What a swap pays in, in units of the second token; NULL where neither amount is positive. NaN counts as none."""
    paid = lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0)
    return F.when(paid(amount0), amount0 * reference).when(paid(amount1), amount1)


def pro_rata_fee(fee: Column, own: Column, active: Column) -> Column:
    """The part of ``fee`` of a position of liquidity ``own`` beside the ``active`` one of others, in the same units; negative ones count as 0."""
    whole = F.greatest(active, F.lit(0.0)) + own
    return F.when(whole > 0, fee * own / F.nullif(whole, F.lit(0.0))).otherwise(0.0)


def scaled(raw: Column | str, decimals: Column | int) -> Column:
    """A wide integer in smallest units, kept as decimal text, in whole tokens."""
    d = F.lit(decimals) if isinstance(decimals, int) else decimals
    return number(raw) / F.pow(F.lit(10.0), d.cast("double"))


def signed_delta(size: Column | str, event: Column | str) -> Column:
    """The size of a change of liquidity as canonical text, negative for a burn, whatever sign it was written with; NULL for other events."""
    e = F.col(event) if isinstance(event, str) else event
    digits = F.ltrim(wide_text(size), F.lit("-"))
    return F.when(e == "Mint", digits).when(e == "Burn", F.when(digits == "0", digits).otherwise(F.concat(F.lit("-"), digits)))


def hex_integer(c: Column | str) -> Column:
    """A hexadecimal number of up to 32 bytes, with or without 0x, as decimal text; NULL where it is none.

    Seven digits at a time are weighed by their powers of 16, in four limbs of 20 decimal digits, so no sum exceeds a
    decimal; what a limb has too much is carried to the next at the end.
    """
    c = F.col(c) if isinstance(c, str) else c
    kind, size = "decimal(38,0)", F.lit(str(10**20)).cast("decimal(38,0)")

    def once(x: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of a value that is computed once, however often it occurs in it."""
        return F.transform(F.array(x), then)[0]

    def limb(pieces: Column, at: int, carry: Column) -> Column:
        weights = [16 ** (7 * (9 - i)) // 10 ** (20 * at) % 10**20 for i in range(10)]
        parts = [(pieces[i] * F.lit(str(w)).cast("decimal(20,0)")).cast(kind) for i, w in enumerate(weights) if w]
        return reduce(lambda x, y: (x + y).cast(kind), parts, carry)

    def rest(pieces: Column, at: int, carry: Column) -> Column:
        """The decimal digits of a limb, after those of the higher ones."""
        if at == 4:
            return F.lit("")
        split = lambda w: once((w % size).cast(kind), lambda r: F.concat(
            rest(pieces, at + 1, ((w - r) / size).cast(kind)), F.lpad(r.cast("string"), 20, "0")
        ))
        return once(limb(pieces, at, carry), split)

    def decimal(text: Column) -> Column:
        digits = F.lpad(text, 70, "0")
        pieces = F.array(*[F.conv(F.substring(digits, 1 + 7 * i, 7), 16, 10).cast("decimal(10,0)") for i in range(10)])
        number = once(pieces, lambda p: rest(p, 0, F.lit(0).cast(kind)))
        return once(F.ltrim(number, F.lit("0")), lambda n: F.when(n == "", "0").otherwise(n))

    return once(F.regexp_extract(F.lower(F.trim(c)), r"^(?:0x)?([0-9a-f]{1,64})$", 1), lambda t: F.when(t != "", decimal(t)))


def position_amounts(liquidity: Column, price: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """Both amounts of a position of (human-unit) liquidity over [lower, upper]; all zero-based inputs must be positive."""
    ok = (liquidity >= 0) & (price > 0) & (lower > 0) & (upper > lower)
    sp, sa, sb = F.sqrt(price), F.sqrt(lower), F.sqrt(upper)
    at = F.when(sp <= sa, sa).when(sp >= sb, sb).otherwise(sp)
    return F.when(ok, liquidity * (sb - at) / (at * sb)), F.when(ok, liquidity * (at - sa))


def position_value(liquidity: Column, price: Column, lower: Column, upper: Column) -> Column:
    a0, a1 = position_amounts(liquidity, price, lower, upper)
    return a0 * price + a1


def liquidity_for_value(value: Column, price: Column, lower: Column, upper: Column) -> Column:
    return value / F.nullif(position_value(F.lit(1.0), price, lower, upper), F.lit(0.0))


def gamma(liquidity: Column, price: Column, lower: Column, upper: Column) -> Column:
    """Second derivative of the position's value by central difference; the value is linear in the liquidity."""
    h = F.greatest(price * 1e-4, F.lit(1e-6))
    v = lambda p: position_value(F.lit(1.0), p, lower, upper)
    return F.when(liquidity >= 0, liquidity * ((v(price + h) - 2 * v(price) + v(price - h)) / (h * h)))


def pack_nibbles(low: Column, high: Column) -> Column:
    return low.bitwiseOR(F.shiftleft(high, 4))


def unpack_nibbles(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND(15), F.shiftright(packed, 4).bitwiseAND(15)


def compounded(apr_ray: Column, periods: int = 31_536_000) -> Column:
    """Yearly yield of a rate in 27-digit fixed point that compounds every second."""
    return F.expm1(F.log1p(apr_ray / 1e27 / periods) * periods)


def annualised(total: Column, days: Column) -> Column:
    return F.when(total > -1, F.pow(1 + total, 365.0 / F.nullif(days, F.lit(0.0))) - 1).when(total <= -1, -1.0)


def clipped_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.greatest(part / F.nullif(whole, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
