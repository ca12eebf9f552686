"""Amounts and percentages as a collector types them, in minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand between groups of three digits, the largest exact amount, the longest input.
GROUPERS = (" ", " ", " ", "'", "’", ",", ".")
LARGEST, LONGEST = 2**53 - 1, 32


def parse_fixed(text: Column, group: str | None, digits: int, largest: int = LARGEST) -> Column:
    """struct<status, minor>: ok with the minor units, or too-long, invalid, ambiguous or out-of-range.

    The text is runs of digits and the characters between them. Two runs around a point or comma
    with one or two digits behind it are a decimal; with three behind one to three they are
    thousands only where the mark is the locale's own (group) and no lone zero leads, else ambiguous. More runs are
    groups of three behind one and the same mark, with a decimal behind another one. Places
    beyond digits must be zeros. A null text is invalid.
    """
    raw = F.trim(F.coalesce(text, F.lit("")))
    runs = F.split(raw, "[^0-9]", -1)
    marks = F.regexp_extract_all(raw, F.lit("[^0-9]"), F.lit(0))
    n, first, last = F.size(runs), F.get(runs, F.lit(0)), F.try_element_at(runs, F.lit(-1))
    mark, end = F.get(marks, F.lit(0)), F.try_element_at(marks, F.lit(-1))
    full, point = F.forall(runs, lambda r: r != ""), end.isin(".", ",")
    lone = full & (n == 2) & point
    open_to_doubt = lone & (F.length(last) == 3) & (F.length(first) <= 3)
    thousands = open_to_doubt & (first != "0") & (F.lit(group).isNotNull() & (mark == F.lit(group)))
    placed = full & (n > 1) & point & (F.length(last) <= 2)
    groups = F.when(placed, F.slice(runs, 1, F.greatest(n - 1, F.lit(1)))).otherwise(runs)
    between = F.array_distinct(F.slice(marks, 1, F.greatest(F.size(groups) - 1, F.lit(0))))
    even = (F.length(first) <= 3) & F.forall(F.slice(groups, 2, LONGEST), lambda r: F.length(r) == 3) & (F.size(between) == 1) & F.get(between, F.lit(0)).isin(*GROUPERS)
    grouped = full & (F.size(groups) > 1) & even & ~(placed & (end == F.get(between, F.lit(0))))
    readable = full & ((n == 1) | (lone & placed) | thousands | (grouped & ~open_to_doubt))
    fraction = F.when(placed, last).otherwise(F.lit(""))
    exact = ~F.substring(fraction, digits + 1, LONGEST).rlike("[^0]")
    minor = F.concat(F.array_join(groups, ""), F.rpad(F.substring(fraction, 1, digits), digits, "0")).try_cast("decimal(38,0)")
    status = (
        F.when(F.length(raw) > LONGEST, "too-long").when(open_to_doubt & ~thousands, "ambiguous").when(~(readable & exact), "invalid")
        .when(minor > largest, "out-of-range").otherwise("ok")
    )
    return F.struct(status.alias("status"), F.when(status == "ok", minor.cast("bigint")).alias("minor"))


def parse_percent(text: Column, group: str | None) -> Column:
    """struct<status, minor>: a percentage from 0 to 100 in basis points."""
    return parse_fixed(text, group, 2, 10_000)


def parse_ladder(text: Column, group: str | None, digits: int = 2) -> Column:
    """array<struct<from_minor, step_minor>> of lines 'from: step'; null where a line can't be read or the ladder isn't one.

    A ladder has 1 to 20 tiers, begins at zero, rises strictly, and has steps of one at least.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    part = lambda x, k: parse_fixed(F.get(F.split(x, ":", -1), F.lit(k)), group, digits)["minor"]
    tiers = F.transform(lines, lambda x: F.when(F.size(F.split(x, ":", -1)) == 2, F.struct(part(x, 0).alias("from_minor"), part(x, 1).alias("step_minor"))))
    whole = F.forall(tiers, lambda t: F.coalesce(t["from_minor"].isNotNull() & (t["step_minor"] >= 1), F.lit(False)))
    starts = F.transform(tiers, lambda t: t["from_minor"])
    rising = (F.get(starts, F.lit(0)) == 0) & (F.array_sort(F.array_distinct(starts)) == starts)
    return F.when(F.size(tiers).between(1, 20) & whole & rising, tiers)
