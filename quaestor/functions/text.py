"""Text keys, prices, dates, addresses and hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space beyond ASCII, and query parameters that only track.
WIDE = "   -     　﻿"
SPACE = rf"[\s{WIDE}]"
TRACKING = r"^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid)(=|$)"
#: Marks of the four currencies that prices carry.
MARKS = {"USD": r"(?i)US\$|\$|\bUSD\b", "EUR": r"(?i)€|\bEUR\b", "GBP": r"(?i)£|\bGBP\b", "CHF": r"(?i)\bCHF\b|\bFr\."}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once.

    As the end of a fold over nothing: an item of a transformed array has its type worked out anew for
    every row, over all that use holds.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def squash(text: Column) -> Column:
    """Null as empty; every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def plain(text: Column) -> Column:
    """Whether a text is ASCII with single spaces alone, told without a pattern."""
    test = F.octet_length(text) == F.length(text)
    for run in ("  ", *"\t\n\v\f\r"):
        test = test & ~text.contains(run)
    return test


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def with_identity_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Add compatibility-folded, squashed, lower-cased keys: new column -> column.

    ASCII needs no folding, so only rows with other texts go through Python; no row is moved.
    """
    wide = F.lit(False)
    for text in keys.values():
        wide = wide | F.coalesce(F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(False))
    plain = df.filter(~wide).withColumns({key: identity_key(F.col(text)) for key, text in keys.items()})
    return plain.unionByName(df.filter(wide).withColumns({key: F.lower(squash(_folded(text))) for key, text in keys.items()}))


def with_identity_key(df: DataFrame, text: str, key: str) -> DataFrame:
    return with_identity_keys(df, {key: text})


def identity_key(text: Column) -> Column:
    """The key of ASCII text, natively."""
    return F.lower(squash(text))


def parse_price(text: Column, currency: Column) -> Column:
    """The one amount of a price text as a double; null for anything in doubt.

    At most one currency's mark, at an end and agreeing with the currency wanted. What is left
    is read as runs of digits and the characters between them: a last run of one or two behind
    a point or comma is decimal; the others are groups of three behind one and the same other
    character, the first of one to three; a single run may have any length.
    """
    raw = squash(text)
    found = F.array_compact(F.array(*(F.when(raw.rlike(p), F.lit(c)) for c, p in MARKS.items())))
    amount = raw
    for pattern in MARKS.values():
        bare = pattern.removeprefix("(?i)")
        amount = F.regexp_replace(F.regexp_replace(amount, f"(?i)^(?:{bare}) *", ""), f"(?i) *(?:{bare})$", "")
    runs, between = F.split(F.trim(amount), "[^0-9]", -1), F.regexp_extract_all(F.trim(amount), F.lit("[^0-9]"), F.lit(0))
    last, n = F.try_element_at(runs, F.lit(-1)), F.size(runs)
    decimal = (n > 1) & F.try_element_at(between, F.lit(-1)).isin(".", ",") & F.length(last).isin(1, 2)
    groups = F.when(decimal, F.slice(runs, 1, F.greatest(n - 1, F.lit(1)))).otherwise(runs)
    marks = F.array_distinct(F.slice(between, 1, F.greatest(F.size(groups) - 1, F.lit(0))))
    grouped = (F.size(marks) == 1) & F.get(marks, F.lit(0)).isin(" ", "'", "’", ".", ",") & F.length(F.get(groups, F.lit(0))).between(1, 3) & F.forall(F.slice(groups, 2, n), lambda g: F.length(g) == 3) & ~(decimal & (F.get(marks, F.lit(0)) == F.try_element_at(between, F.lit(-1))))
    fits = F.forall(runs, lambda r: r != "") & ((F.size(groups) == 1) | grouped) & (F.size(found) <= 1)
    value = F.concat(F.array_join(groups, ""), F.when(decimal, F.concat(F.lit("."), last)).otherwise("")).try_cast("double")
    agrees = (F.size(found) == 0) | currency.isNull() | (F.get(found, F.lit(0)) == F.upper(currency))
    return F.when(fits & agrees & (value > 0), value)


def ruler_key(df: DataFrame, text: str, key: str) -> DataFrame:
    """Add the key of a ruler's name: squashed, lower-cased, without diacritics."""
    wide = F.coalesce(F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(False))
    return df.filter(~wide).withColumn(key, identity_key(F.col(text))).unionByName(df.filter(wide).withColumn(key, F.lower(squash(_bare(text)))))


@F.pandas_udf(T.StringType())
def _bare(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


#: Letters with marks that are one character, below U+2000, and their letters without.
_MARKED = {chr(k): d[0] for k in range(0xC0, 0x2000) for d in [unicodedata.normalize("NFD", chr(k))] if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])}


def name_key(text: Column) -> Column:
    """The key of a name: squashed, lower-cased, without diacritics. All within the JVM, for names in alphabets below U+2000."""
    bare = lambda t: F.regexp_replace(F.translate(squash(t), "".join(_MARKED), "".join(_MARKED.values())), r"\p{M}+", "")
    return F.lower(let(text, lambda t: F.when(plain(t), F.trim(t)).otherwise(bare(t))))


def sale_date(text: Column) -> Column:
    """DD.MM.YYYY or YYYY-MM-DD at the start, followed by a space or the end; no rolling over."""
    raw = squash(text)
    dotted = F.regexp_extract(raw, r"^(\d{2}\.\d{2}\.\d{4})(?:\s|$)", 1)
    iso = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})(?:\s|$)", 1)
    turned = F.concat_ws("-", F.substring(dotted, 7, 4), F.substring(dotted, 4, 2), F.substring(dotted, 1, 2))
    return F.when(dotted != "", turned).otherwise(F.nullif(iso, F.lit(""))).try_cast("date")


def strip_tracking(url: Column) -> Column:
    """An address without tracking parameters and without a cosmetic fragment (#/ and #! stay)."""
    bare, mark = F.substring_index(url, "#", 1), F.regexp_extract(url, "(#[/!].*)$", 1)
    path, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")), mark)


def fnv32(text: Column, seed: int = 0x811C9DC5) -> Column:
    """FNV-1a over UTF-16 code units (characters beyond the first plane count as two)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    units = F.flatten(F.transform(codes, lambda c: F.when(c < 65536, F.array(c)).otherwise(F.array(F.lit(55296) + F.shiftright(c - 65536, 10), F.lit(56320) + (c - 65536) % 1024))))
    return F.aggregate(units, F.lit(seed).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF))


#: The seeds of the four hashes of a derived UUID.
SEEDS = (0x811C9DC5, 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35)


def stable_uuid(text: Column) -> Column:
    """A version 4 UUID that is the same for the same text: four seeded hashes, with the
    version and variant nibbles put in."""
    h = reduce(F.concat, [F.lpad(F.lower(F.hex(fnv32(F.concat(F.lit(f"{k}:"), text), seed))), 8, "0") for k, seed in enumerate(SEEDS)])
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def greek_name(latin: Column) -> Column:
    """A Latin spelling of a Greek name turned back: us, ae, c (not ch), final o, in this order."""
    steps = (("us$", "os"), ("ae", "ai"), ("c(?!h)", "k"), ("o$", "on"))
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, latin)


def csv_cell(value: Column) -> Column:
    """A quoted cell; a leading character that a spreadsheet would run gets an apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    tame = F.when(text.rlike(rf"^(?:[\t\r]|{SPACE}*[=+\-@\uFF1D\uFF0B\uFF0D\uFF20])"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(tame, F.lit('"'), F.lit('""')), F.lit('"'))
