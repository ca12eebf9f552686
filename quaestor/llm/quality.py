"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Documents on which costs and rejections of the rules are estimated.
SAMPLE = 2000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of anything but space and U+0009..U+000D; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first ones included."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("w"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda x, at: F.coalesce(x["w"] == F.get(s, at)["w"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

    def covered(at: Column) -> Column:
        begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, begin, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    def count(h: Column) -> Column:
        return _let(F.sort_array(windows(h)), lambda s: covered(F.sort_array(twice(s))))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), count))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every document.

    Null counts as a text without words. Repeated rows are measured one by one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    words = words_of(F.col("text"))
    least = lambda e: e.cast("long")
    # The array of words is made once for each row and then used by name.
    split = rows.select("doc_id", "text", F.explode(F.array(words)).alias("words"), F.lit(0).alias("_"))
    return split.select(
        "doc_id",
        "text",
        least(F.size("words")).alias("n_words"),
        least(F.length(F.translate("text", BLANKS, ""))).alias("word_chars"),
        least(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        least(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """name -> whether a document (text, and the measures above) is to be rejected.

    The thresholds are wide: only what is plainly no prose fails.
    """
    n = F.col("n_words")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    lines = F.size(F.split("text", "\n", -1))
    return {
        "symbols": F.col("n_symbols") * 10 > n,
        "repeated lines": F.col("n_dup_lines") * 10 > lines * 3,
        "word length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "letters": letters * 10 < F.col("word_chars") * 6,
        "ellipses": F.regexp_count("text", F.lit(r"(\.\.\.|…) *(\n|$)")) * 10 > lines * 3,
        "capitals": F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")) * 10 > letters * 6,
    }


def ordered(sample: DataFrame, tests: dict[str, Column]) -> list[str]:
    """Names of the rules by rejections per second on a sample, the best first."""

    def timed(*what: Column) -> tuple[float, int]:
        begin = perf_counter()
        found = sample.agg(*what).first()[0] or 0
        return perf_counter() - begin, found

    timed(F.count(F.lit(1)))
    idle = timed(F.count(F.lit(1)))[0]
    worth = {}
    for name, test in tests.items():
        seconds, rejected = timed(F.count_if(test))
        worth[name] = rejected / max(seconds - idle, 1e-3)
    return sorted(tests, key=lambda name: -worth[name])


def cascade(order: list[str], tests: dict[str, Column]) -> Column:
    """The name of the first rule, in this order, that rejects a row; null if none does.

    Later rules are not computed for a row that one has rejected. The order changes which
    name is given, never whether there is one.
    """
    first = F
    for name in order:
        first = first.when(tests[name], F.lit(name))
    return first.otherwise(F.lit(None).cast("string")) if order else F.lit(None).cast("string")


def bounded_sample(documents: DataFrame, size: int = SAMPLE) -> DataFrame:
    """About so many rows at most, whatever the size of the table."""
    rows = documents.count()
    return documents.sample(False, min(1.0, size / rows), seed=7) if rows else documents


def judged(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The measures of every document with the text, base_failed, and the first rule that rejects it."""
    tests = rules()
    order = ordered(cut(measured(bounded_sample(documents, sample))), tests)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(documents).withColumn("base_failed", failed).withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(order, tests)))


def quality(documents: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, and kept: neither that nor a rule rejects it."""
    return judged(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"),
    )
