"""Price-tick, price-band and cost rules as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from eqpanel import params as P


def tick_size(price: Column, rules=P.TICK_RULES) -> Column:
    expr = F.lit(rules[-1][1])
    for below, tick in reversed(rules[:-1]):
        expr = F.when(price < below, F.lit(tick)).otherwise(expr)
    return expr


def round_down_to_tick(price: Column, rules=P.TICK_RULES) -> Column:
    """Largest valid price not above ``price``.

    Settled on six decimals first: 10,000 * 1.005 is 10049.999999999998 as a
    double, and flooring that would lose a whole tick.
    """
    exact = price.cast("double").cast("decimal(20,6)")
    tick = tick_size(exact.cast("double"), rules)
    # whole ticks counted in millionths, so the division is exact
    units = F.floor((exact * 1000000).cast("long") / (tick.cast("long") * 1000000))
    return (units * tick).cast("double")


def venue_band(venue: Column, bands=P.VENUE_BANDS) -> Column:
    """Daily price band of a venue; null for one that is not listed."""
    return F.coalesce(*[F.when(F.upper(F.trim(venue)) == v, F.lit(b)) for v, b in bands.items()])


def floor_price(reference: Column, band: float | Column = P.PRICE_BAND) -> Column:
    return round_down_to_tick(reference * (1 - band if isinstance(band, Column) else F.lit(1 - band)))


def ceiling_price(reference: Column, band: float | Column = P.PRICE_BAND) -> Column:
    return round_down_to_tick(reference * (1 + band if isinstance(band, Column) else F.lit(1 + band)))


@dataclass(frozen=True)
class Costs:
    commission: float
    fee_included: bool = True
    fee: float = P.EXCHANGE_FEE_RATE
    sell_tax: float = P.SELL_TAX_RATE
    slippage_bps: float = P.SLIPPAGE_BPS

    @property
    def buy_rate(self) -> float:
        return self.commission + (0.0 if self.fee_included else self.fee) + self.slippage_bps / 10000

    @property
    def sell_rate(self) -> float:
        return self.buy_rate + self.sell_tax


def cost_rates(profiles) -> tuple[Column, Column]:
    """Buy and sell rate from the columns of an effective-dated cost table."""
    fee = F.when(F.col("fee_included"), F.lit(0.0)).otherwise(F.col("exchange_fee_rate"))
    buy = F.col("commission_rate") + fee + F.col("slippage_bps") / 10000
    return buy, buy + F.col("sell_tax_rate")


def net_return(gross: Column, buy_rate, sell_rate) -> Column:
    buy = buy_rate if isinstance(buy_rate, Column) else F.lit(buy_rate)
    sell = sell_rate if isinstance(sell_rate, Column) else F.lit(sell_rate)
    return (1 - sell) * (1 + gross) / (1 + buy) - 1


def finite_positive(value: Column) -> Column:
    """True for numbers that are present, finite and above zero."""
    x = value.try_cast("double")
    return F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))
