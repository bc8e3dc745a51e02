"""Execution costs and trade sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the default cost model.
COMMISSION, MINIMUM, HANDLING, TRANSFER, STAMP = 0.00015, 0.0, 0.00004, 0.0, 0.0
HALF_SPREAD_BPS, SLIPPAGE_BPS, IMPACT_BPS = 2.0, 3.0, 18.0
MOST_PARTICIPATION, LOT = 0.10, 100


def estimate(side: Column, price: Column, shares: Column, daily_amount: Column) -> Column:
    """A struct of gross, participation, impact_bps, fees, slippage, total_cost, effective_price and capacity_exceeded."""
    price, shares = F.greatest(F.lit(0.0), price), F.greatest(F.lit(0.0), shares)
    gross = price * shares
    adv = F.greatest(F.coalesce(daily_amount, F.lit(0.0)), gross)
    asked = F.coalesce(F.try_divide(gross, adv), F.lit(0.0))
    participation = F.least(asked, F.lit(MOST_PARTICIPATION))
    impact = IMPACT_BPS * F.sqrt(participation)
    slippage = gross * (HALF_SPREAD_BPS + SLIPPAGE_BPS + impact) / 10000
    fees = F.greatest(F.when(gross > 0, MINIMUM).otherwise(0.0), gross * COMMISSION) + gross * (HANDLING + TRANSFER) + F.when(side == "SELL", gross * STAMP).otherwise(0.0)
    cost = fees + slippage
    effective = F.coalesce(F.try_divide(F.when(side == "BUY", gross + cost).otherwise(gross - cost), shares), F.lit(0.0))
    parts = {"gross": gross, "participation": participation, "impact_bps": impact, "fees": fees, "slippage": slippage, "total_cost": cost, "effective_price": effective, "capacity_exceeded": asked > MOST_PARTICIPATION + 1e-12}
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def round_lot(shares: Column) -> Column:
    return (F.floor(F.greatest(shares, F.lit(0.0)) / LOT) * LOT).cast("bigint")


def capacity_lot(price: Column, daily_amount: Column) -> Column:
    """Shares that stay within the participation limit, in whole lots."""
    return F.when((price > 0) & (daily_amount > 0), round_lot(daily_amount * MOST_PARTICIPATION / price)).otherwise(F.lit(0).cast("bigint"))


def estimate_sql(side: str, price: str, shares: str, amount: str) -> dict[str, str]:
    """The same parts as SQL expressions."""
    gross = f"({price} * {shares})"
    part = f"least({gross} / greatest({amount}, {gross}), {MOST_PARTICIPATION}::DOUBLE)"
    slip = f"({gross} * ({HALF_SPREAD_BPS + SLIPPAGE_BPS}::DOUBLE + {IMPACT_BPS}::DOUBLE * sqrt({part})) / 10000)"
    fees = f"({gross} * {COMMISSION}::DOUBLE + {gross} * {HANDLING}::DOUBLE)"
    return {"gross": gross, "participation": part, "slippage": slip, "fees": fees, "total_cost": f"({fees} + {slip})", "effective_price": f"(({gross} {'+' if side == 'BUY' else '-'} ({fees} + {slip})) / {shares})"}
