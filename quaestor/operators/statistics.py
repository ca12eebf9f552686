"""Price statistics. Two kinds of quartiles are kept apart: interpolated ones over
provider prices, and medians of halves over exact evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 100
FEWEST = 3  # counted sales behind a median of a grade, a year or a side of a trend
FLAT_PERCENT = 5


def summarise(sales: DataFrame, by: list[str], today: Column) -> DataFrame:
    """Per group: total, count, capped, interpolated median and quartiles, min, max, years,
    unpriced and future counts.

    sales has amount (double, null if it can't be read), price (its text) and sale_date. A
    priced row dated after today is no sale yet; an undated one counts.
    """
    ahead = F.coalesce(F.col("sale_date") > today, F.lit(False))
    counted = F.when(F.col("amount").isNotNull() & ~ahead, F.col("amount"))
    quarter = F.percentile(counted, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    year = F.when(counted.isNotNull(), F.year("sale_date"))
    return sales.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(counted).alias("count"),
        (F.count(F.lit(1)) >= PAGE).alias("capped"),
        F.get(quarter, F.lit(1)).alias("median"),
        F.get(quarter, F.lit(0)).alias("lower_quartile"),
        F.get(quarter, F.lit(2)).alias("upper_quartile"),
        F.min(counted).alias("min"),
        F.max(counted).alias("max"),
        F.min(year).alias("earliest"),
        F.max(year).alias("latest"),
        F.count_if(~F.coalesce("price", F.lit("")).rlike("[0-9]")).alias("unpriced"),
        F.count_if(F.col("amount").isNotNull() & ahead).alias("future"),
    )


def _median(amount: Column) -> Column:
    return F.percentile(amount, F.lit(0.5))


def medians(sales: DataFrame, by: list[str], fewest: int = FEWEST) -> DataFrame:
    """Median and count of amounts per group, of groups with enough of them."""
    rows = sales.filter(F.col("amount").isNotNull())
    return rows.groupBy(*by).agg(_median(F.col("amount")).alias("median"), F.count(F.lit(1)).alias("count")).filter(F.col("count") >= fewest)


def years_before(today: Column, years: int) -> Column:
    """The same day years ago; 29 February falls back to the 28th."""
    return F.add_months(today, -12 * years)


def in_period(sales: DataFrame, today: Column, years: int | None) -> DataFrame:
    """Sales on or after the day years ago; undated ones are kept only without a period."""
    return sales if years is None else sales.filter(F.col("sale_date") >= years_before(today, years))


def upcoming(sales: DataFrame, today: Column) -> DataFrame:
    """Rows still to be sold, soonest first: dated ahead, or today with no figure in the price."""
    no_figure = ~F.coalesce("price", F.lit("")).rlike("[0-9]")
    return sales.filter((F.col("sale_date") > today) | ((F.col("sale_date") == today) & no_figure)).orderBy("sale_date", "row_idx")


def trend(sales: DataFrame, by: list[str], today: Column, years: int = 2) -> DataFrame:
    """Recent against earlier median per group, where both rest on enough counted sales.

    move is the rounded percentage, about the same up to five.
    """
    dated = sales.filter(F.col("amount").isNotNull() & (F.col("sale_date") <= today))
    recent = F.col("sale_date") >= years_before(today, years)
    side = lambda cond: F.when(cond, F.col("amount"))
    rows = dated.groupBy(*by).agg(
        _median(side(recent)).alias("recent"), F.count(side(recent)).alias("recent_count"),
        _median(side(~recent)).alias("earlier"), F.count(side(~recent)).alias("earlier_count"),
    )
    percent = F.floor(F.abs(F.col("recent") - F.col("earlier")) * 100 / F.col("earlier") + 0.5).cast("bigint")
    move = F.when(percent <= FLAT_PERCENT, "same").when(F.col("recent") > F.col("earlier"), "up").otherwise("down")
    return rows.filter((F.col("recent_count") >= FEWEST) & (F.col("earlier_count") >= FEWEST)).withColumn("percent", percent).withColumn("move", move)


def price_check(sales: DataFrame, by: list[str], asked: Column) -> DataFrame:
    """How many sales were strictly below what is asked, and its multiple of the median."""
    rows = sales.filter(F.col("amount").isNotNull())
    return rows.groupBy(*by).agg(F.count_if(F.col("amount") < asked).alias("below"), F.count(F.lit(1)).alias("count"), (F.first(asked) / _median(F.col("amount"))).alias("ratio"))


def last_sale(sales: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The sale with the latest date per group, the first in page order among equals."""
    dated = sales.filter(F.col("amount").isNotNull() & F.col("sale_date").isNotNull())
    best = F.max_by(F.struct("sale_date", *columns), F.struct(F.col("sale_date"), -F.col("row_idx")))
    return dated.groupBy(*by).agg(best.alias("last")).select(*by, "last.*")


def half_medians(minors: Column) -> dict[str, Column]:
    """Median, lower and upper quartile of an array of integers, as medians of its halves (the
    middle one belongs to neither), means half up; null below three."""
    ranked, n = F.array_sort(minors), F.size(minors)
    half = F.floor(n / 2).cast("int")

    def middle(xs: Column, size: Column) -> Column:
        at = F.floor(size / 2).cast("int")
        even = F.floor((F.get(xs, at - 1).cast("decimal(38,0)") + F.get(xs, at) + 1) / 2).cast("bigint")
        return F.when(size % 2 == 1, F.get(xs, at)).otherwise(even)

    upper = F.slice(ranked, half + 1 + n % 2, F.greatest(half, F.lit(1)))
    enough = n >= FEWEST
    return {
        "median": F.when(enough, middle(ranked, n)),
        "lower_quartile": F.when(enough, middle(F.slice(ranked, F.lit(1), F.greatest(half, F.lit(1))), half)),
        "upper_quartile": F.when(enough, middle(upper, half)),
    }


def counted_half_medians(rows: DataFrame, by: list[str], amount: str) -> DataFrame:
    """by, count and half_medians of each group's amounts, without a list of them: equal amounts
    are counted, and the middle ranks found by cumulative counts."""
    times = rows.groupBy(*by, F.col(amount).alias("_v")).agg(F.count(amount).alias("_n"))
    whole = Window.partitionBy(*by)
    ranked = times.withColumn("_until", F.sum("_n").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("count", F.sum("_n").over(whole))
    n, half = F.col("count"), F.floor(F.col("count") / 2)
    parts = {"median": (F.lit(0), n), "lower_quartile": (F.lit(0), half), "upper_quartile": (n - half, half)}
    at = lambda r: F.min(F.when(F.col("_until") >= r, F.col("_v")))
    pairs = {k: (at(first + F.floor((size + 1) / 2)), at(first + F.floor(size / 2) + 1)) for k, (first, size) in parts.items()}
    middle = {k: F.floor((a.cast("decimal(38,0)") + b + 1) / 2).cast("bigint") for k, (a, b) in pairs.items()}
    made = ranked.groupBy(*by, "count").agg(*(v.alias(k) for k, v in middle.items()))
    return made.select(*by, "count", *(F.when(n >= FEWEST, F.col(k)).alias(k) for k in middle))


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Repeats of a key numbered from one in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
