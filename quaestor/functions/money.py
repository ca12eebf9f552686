"""Exact money: integer minor units, shares in basis points rounded half up, bid ladders.

Amounts are bigint, sums over rows decimal(38,0). A result above the largest safe
integer is null: an amount that can't be held exactly is not shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest integer a double holds exactly, and the currencies in their order.
SAFE = (1 << 53) - 1
CURRENCIES = ("USD", "EUR", "GBP", "CHF", "AUD", "CAD", "HKD", "JPY", "SEK", "DKK", "NOK", "CZK", "PLN", "HUF")

#: Amounts of a fee sheet, all zero where absent.
FEES = ("shipping_minor", "payment_fee_bps", "payment_fee_minor", "premium_vat_bps", "platform_fee_bps", "import_vat_bps")


def exact(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")


def share(minor: Column, bps: Column) -> Column:
    """minor x bps / 10 000, half up, exactly and in bigint.

    Ten thousands and the rest are taken apart, so that no product passes 2^63 for a safe
    amount of up to 10 000 basis points.
    """
    minor = minor.cast("bigint")
    whole = F.call_function("div", minor, F.lit(10_000))
    rest = minor % 10_000
    return whole * bps + F.call_function("div", rest * bps + 5000, F.lit(10_000))


def safe(x: Column) -> Column:
    return F.when(x <= SAFE, x).cast("bigint")


def currency_rank(currency: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CURRENCIES)), currency)


def premium(hammer: Column, bps: Column) -> Column:
    """struct<premium, hammer_plus_premium>; null for bps outside 0..10 000 or an unsafe result."""
    good = hammer.between(0, SAFE) & bps.between(0, 10_000)
    part = share(hammer, bps)
    return F.when(good & (part + hammer <= SAFE), F.struct(part.alias("premium"), (part + hammer).alias("hammer_plus_premium")))


def _lines(hammer: Column, bps: Column, fees: dict[str, Column] | None) -> dict[str, Column]:
    fee = {name: (fees or {}).get(name, F.lit(0)).cast("bigint") for name in FEES}
    part = share(hammer, bps)
    both = part + hammer
    vat, platform = share(part, fee["premium_vat_bps"]), share(hammer, fee["platform_fee_bps"])
    base = both + vat + platform + fee["shipping_minor"]
    payment = share(base, fee["payment_fee_bps"]) + fee["payment_fee_minor"]
    imports = share(both + fee["shipping_minor"], fee["import_vat_bps"])
    return {"premium": part, "hammer_plus_premium": both, "premium_vat": vat, "platform_fee": platform, "payment_fee": payment, "import_vat": imports, "total": base + payment + imports}


def bid_cost(hammer: Column, bps: Column, fees: dict[str, Column] | None = None) -> Column:
    """struct of the lines of an invoice, each rounded on its own; null if any is unsafe.

    VAT is charged on the premium, the platform's fee on the hammer, the payment fee on all
    of these with shipping, import VAT on hammer, premium and shipping.
    """
    lines = _lines(hammer, bps, fees)
    # A guard before the sums keeps them in range; one behind keeps them safe.
    good = hammer.between(0, SAFE) & bps.between(0, 10_000)
    return F.when(good, F.when(lines["total"] <= SAFE, F.struct(*(v.cast("bigint").alias(k) for k, v in lines.items()))))


def ladder(tiers: list[tuple[int, int]]) -> Column:
    """A bid ladder as array<struct<from, step>>; tiers rise strictly from zero, steps are positive."""
    if not 1 <= len(tiers) <= 20 or tiers[0][0] != 0 or any(b[0] <= a[0] for a, b in zip(tiers, tiers[1:], strict=False)) or any(s < 1 for _, s in tiers):
        raise ValueError("a ladder needs 1 to 20 tiers that rise from 0, each with a positive step")
    return F.array(*(F.struct(F.lit(a).cast("bigint").alias("from"), F.lit(s).cast("bigint").alias("step")) for a, s in tiers))


def tier_at(tiers: Column, minor: Column) -> Column:
    """The last tier that starts at or below a bid, as of the ladder."""
    return F.element_at(F.filter(tiers, lambda t: t["from"] <= minor), -1)


def next_on_ladder(tiers: Column, minor: Column) -> Column:
    """The smallest bid on the ladder at or above minor; a step never passes the next tier's start."""
    tier = tier_at(tiers, minor)
    over = (minor - tier["from"]) % tier["step"]
    step = F.when(over == 0, minor).otherwise(minor + tier["step"] - over)
    return F.least(step, F.array_min(F.transform(F.filter(tiers, lambda t: t["from"] > minor), lambda t: t["from"])))


def previous_on_ladder(tiers: Column, minor: Column) -> Column:
    """The highest bid on the ladder at or below minor."""
    tier = tier_at(tiers, minor)
    return minor - (minor - tier["from"]) % tier["step"]


#: How far a hammer may be from where rates alone would put it: rounding of the lines, and one for the division.
SLACK = 6


def with_affordable_bid(df: DataFrame, name: str, budget: Column, bps: Column, tiers: Column, minimum: int = 0, fees: dict[str, Column] | None = None) -> DataFrame:
    """Add the highest hammer on the ladder whose total stays within budget; null if none does.

    Cost is the hammer times a rate plus what does not depend on it, but for rounding. So the
    rate gives a first hammer, what that leaves of the budget a second one, and the last few
    units are tried in turn. All of it is plain arithmetic in compiled code.
    """
    share_of = {f: (fees or {}).get(f, F.lit(0)).cast("double") / 10_000 for f in FEES if f.endswith("bps")}
    p = bps.cast("double") / 10_000
    rate = (1 + p + p * share_of["premium_vat_bps"] + share_of["platform_fee_bps"]) * (1 + share_of["payment_fee_bps"]) + (1 + p) * share_of["import_vat_bps"]
    given = {f"_fee_{f}": c for f, c in (fees or {}).items()}
    rows = df.withColumns({"_budget": budget.cast("bigint"), "_bps": bps, "_rate": rate, "_floor": next_on_ladder(tiers, F.lit(max(minimum, 1)).cast("bigint")), **given})
    total = lambda h: _lines(h, F.col("_bps"), {f: F.col(f"_fee_{f}") for f in fees or {}})["total"]
    rows = rows.withColumn("_h", F.floor((F.col("_budget") - total(F.lit(0).cast("bigint"))) / F.col("_rate")).cast("bigint"))
    rows = rows.withColumn("_h", F.greatest("_h", "_floor"))
    rows = rows.withColumn("_h", F.col("_h") + F.floor((F.col("_budget") - total(F.col("_h"))) / F.col("_rate")).cast("bigint"))
    best = F.coalesce(*(F.when(total(F.col("_h") + k) <= F.col("_budget"), F.col("_h") + k) for k in range(SLACK, -SLACK - 1, -1)))
    rows = rows.withColumn("_best", F.greatest(best, F.col("_floor"))).withColumn("_fits", total(F.col("_floor")) <= F.col("_budget"))
    return rows.withColumn(name, F.when(F.col("_fits"), previous_on_ladder(tiers, F.col("_best")))).select(*(c for c in df.columns if c != name), name)


SETTLED = ("settled-won", "settled-lost", "reopened-active", "reopened-inactive")


def bid_premium_rate(history: Column, planned_bps: Column) -> Column:
    """The premium rate of a lot: that of its last settled or reopened bid with a rate, but the plan's
    if this was revised later, or if there is no such bid. history: array<struct<action, bps>>, oldest first."""
    last = lambda test: F.coalesce(F.array_max(F.transform(history, lambda x, i: F.when(test(x), i))), F.lit(-1))
    settled = last(lambda x: x["action"].isin(*SETTLED) & x["bps"].isNotNull())
    revised = last(lambda x: x["action"] == "planned-revised")
    return F.when(planned_bps.isNotNull() & (revised > settled), planned_bps).when(settled >= 0, F.get(history, settled)["bps"]).otherwise(planned_bps)


def won_cost(hammer: Column, currency: Column, bps: Column, sheet_currency: Column, no_fees: Column, fees: dict[str, Column]) -> Column:
    """struct<missing, premium, fees, total, import_vat> of a won lot.

    missing names what was never recorded, in the order hammer, premium-rate, fees, fee-currency.
    With a gap only the premium is given, if hammer and rate are there; total leaves import VAT out.
    no_fees: the outcome says that none were charged, which no sheet overrides.
    """
    sheet = F.when(no_fees, currency).otherwise(sheet_currency)
    gaps = {"hammer": hammer.isNull(), "premium-rate": bps.isNull(), "fees": sheet.isNull() & ~no_fees, "fee-currency": sheet.isNotNull() & hammer.isNotNull() & (sheet != currency)}
    missing = F.array_compact(F.array(*(F.when(test, F.lit(gap)) for gap, test in gaps.items())))
    charged = {f: F.when(no_fees, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))) for f, c in fees.items()}
    cost = bid_cost(hammer, bps, charged)
    whole = F.size(missing) == 0
    total = cost["total"] - cost["import_vat"]
    return F.struct(
        missing.alias("missing"), F.when(whole, cost["premium"]).otherwise(premium(hammer, bps)["premium"]).alias("premium"),
        F.when(whole, cost["total"] - cost["hammer_plus_premium"]).alias("fees"), F.when(whole, total).alias("total"), F.when(whole, cost["import_vat"]).alias("import_vat"),
    )


def shown_total(cost: Column, hammer: Column) -> Column:
    """struct<total, partial>: a complete cost with import VAT; hammer and premium where only fees were
    never recorded, which is partial; else none."""
    only_fees = (F.size(cost["missing"]) == 1) & F.array_contains(cost["missing"], "fees")
    partial = safe(hammer + cost["premium"])
    total = F.when(F.size(cost["missing"]) == 0, safe(cost["total"] + cost["import_vat"])).when(only_fees, partial)
    return F.struct(total.alias("total"), F.coalesce(only_fees & partial.isNotNull(), F.lit(False)).alias("partial"))


def sticky_sum(minor: Column) -> Column:
    """An exact total, null once it can't be held safely."""
    total = F.sum(exact(minor))
    return F.when(total <= SAFE, total).cast("bigint")


def plain_decimal(minor: Column, places: int = 2) -> Column:
    """12345 -> '123.45'; no grouping, no sign of currency."""
    if places == 0:
        return minor.cast("string")
    digits = F.lpad(minor.cast("string"), F.greatest(F.length(minor.cast("string")), F.lit(places + 1)), F.lit("0"))
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - places), F.lit("."), F.right(digits, F.lit(places)))
