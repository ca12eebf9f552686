"""Language identification by Bayesian fusion of evidence.

A naive Bayes over hashed byte trigrams gives the text's likelihood in each language.
Declared markup language speaks through an estimated confusion table, the host through
its languages, smoothed towards those of its address suffix, which are smoothed towards
all; both tables come from grouped aggregation of the texts' own posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

BUCKETS = 1 << 13
#: Labelled texts of each language, about, on which likelihoods are fitted: all, where there are fewer.
FITTED = 1000
#: Languages whose counts a fitting task holds at once.
HELD = 256
#: A text's evidence counts as that of so many independent trigrams at most.
INDEPENDENT = 60
#: Imagined documents behind each host and suffix.
SMOOTHING = 10.0
#: Hosts whose priors may travel to every task; with more, priors are joined by a shuffle.
TRAVELLING = 50_000
UNKNOWN = "und"


def _trigrams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), "u1").astype("u4")
    if len(b) < 3:
        return np.empty(0, "u4")
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1]) * np.uint32(0x85EBCA6B) + b[2:]
    return (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 13)


class Likelihoods:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype("f4"))

    def of(self, text: bytes | None) -> list[float] | None:
        """Log likelihoods, weighed down for long texts; null for a text with no letter."""
        if not text or not (text.isalpha() or any(chr(c).isalpha() or c > 127 for c in text[:4096]) or any(chr(c).isalpha() or c > 127 for c in text)):
            return None
        at = _trigrams(text)
        total = np.zeros(len(self.languages))
        for k in range(0, len(at), 65536):
            total += self.table[at[k : k + 65536]].sum(0, dtype="f8")
        return (total * min(1.0, INDEPENDENT / max(len(at), 1))).tolist()


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> Likelihoods:
    """Trigram counts of every language that labels a row, from a draw of about FITTED of its
    different texts, in order of their hashes; tasks send sums by language."""
    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    # The same text repeated counts and is drawn once, so that copies don't crowd out the rest.
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    share = rows.groupBy("label").agg(F.least(F.lit(1.0), F.lit(float(FITTED)) / F.greatest(F.approx_count_distinct(place), F.lit(1))).alias("share"))
    bound = cut(share.select(F.col("label").alias("_label"), F.when(F.col("share") < 1, F.col("share") * (1 << 30)).otherwise(F.lit(float(1 << 30))).alias("_bound")))
    drawn = rows.join(F.broadcast(bound), (F.col("label") == F.col("_label")) & (place < F.col("_bound"))).select("text", "label").dropDuplicates()

    def sent(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["label", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(name, np.zeros(BUCKETS, "i8"))
                own += np.bincount(_trigrams(text), minlength=BUCKETS)
                if len(sums) >= HELD:
                    yield sent(sums)
                    sums.clear()
        yield sent(sums)

    counts: dict[str, np.ndarray] = {}
    for row in drawn.select(F.col("text").cast("binary").alias("text"), "label").coalesce(16).mapInArrow(run, "label string, sums binary").collect():
        counts[row.label] = counts.get(row.label, 0) + np.frombuffer(row.sums, "i8")
    names = sorted(counts) or [UNKNOWN]
    return Likelihoods(names, np.array([counts.get(x, np.zeros(BUCKETS)) for x in names]))


def _scored(df: DataFrame, model: Likelihoods, says: np.ndarray | None = None) -> DataFrame:
    """df with _ll, the text's log likelihoods; with says, also _said_ll, those of what is declared."""
    given = df.sparkSession.sparkContext.broadcast((model, None if says is None else np.log(says)))
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*df.schema.fields, T.StructField("_ll", numbers), *[T.StructField("_said_ll", numbers)][: says is not None]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.schema.names.index("_text")).cast(pa.binary()).to_pylist()
                made = [[own.of(t) for t in texts]]
                if table is not None:
                    made.append(list(table.T[part.column(part.schema.names.index("_said")).to_numpy()]))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.list_(pa.float64())) for x in made)], names=schema.names)

    return df.mapInArrow(run, schema)


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.element_at(F.transform(F.array(e), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))), 1)


def identify(df: DataFrame, model: Likelihoods, text: Column, declared: Column, host: Column, suffix: Column) -> DataFrame:
    """df with _language, _confidence and _text_language.

    A text without letters is of unknown language: nothing is guessed from its host. An
    undeclared language, a missing host or suffix add no evidence of their own. Rows are
    taken as they come, repeated ones too.
    """
    names, size = model.languages, len(model.languages)
    number = F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring_index(F.substring_index(declared, "-", 1), "_", 1)))
    given = df.select(*df.columns, text.alias("_text"), F.coalesce(number, F.lit(0)).cast("int").alias("_said"), host.cast("string").alias("_host"), suffix.cast("string").alias("_suffix"))
    slim = _scored(given.select("_text", "_said", "_host", "_suffix"), model).filter("_ll is not null")
    # What is aggregated carries no text: a few numbers a row.
    soft = cut(slim.select("_said", "_host", "_suffix", _softmax(F.col("_ll")).alias("p")))
    sums = [F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in range(size)]
    hosts = cut(soft.groupBy("_host", "_suffix").agg(*sums))
    # Confusion: how often each language of the text is declared as each; size x (size + 1) cells.
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    seen = {(r.best, r._said): r["count"] for r in soft.groupBy(best.alias("best"), "_said").count().collect()}
    says = np.full((size, size + 1), 0.5)
    for k in range(size):
        says[k, k + 1] += 4  # declarations are imagined to be right rather than wrong
        for d in range(1, size + 1):
            says[k, d] += seen.get((k, d), 0)
        says[k, 1:] /= says[k, 1:].sum()
    says[:, 0] = 1.0 / size
    whole = [F.sum(f"s{k}").alias(f"s{k}") for k in range(size)]
    total = [x or 0.0 for x in hosts.agg(*whole).first()]
    every = [(x + 1) / (sum(total) + size) for x in total]
    mass = lambda side: sum(F.coalesce(f"{side}{k}", F.lit(0.0)) for k in range(size))
    by_suffix = hosts.filter("_suffix is not null").groupBy(F.col("_suffix").alias("_of")).agg(*(F.sum(f"s{k}").alias(f"u{k}") for k in range(size)))
    joined = hosts.join(by_suffix, F.col("_suffix") == F.col("_of"), "left").withColumns({"_u": mass("u"), "_s": mass("s")})
    above = [(F.coalesce(f"u{k}", F.lit(0.0)) + SMOOTHING * q) / (F.col("_u") + SMOOTHING) for k, q in enumerate(every)]
    own = [F.when(F.col("_host").isNull(), above[k]).otherwise((F.col(f"s{k}") + SMOOTHING * above[k]) / (F.col("_s") + SMOOTHING)) for k in range(size)]
    priors = cut(joined.select(F.col("_host").alias("_prior_host"), F.col("_suffix").alias("_prior_suffix"), F.array(*map(F.log, own)).alias("_prior")))
    if priors.count() <= TRAVELLING:
        priors = F.broadcast(priors)
    both = _scored(given, model, says).join(priors, F.col("_host").eqNullSafe(F.col("_prior_host")) & F.col("_suffix").eqNullSafe(F.col("_prior_suffix")), "left")
    flat = F.array(*(F.lit(float(np.log(q))) for q in every))
    fused = F.zip_with(F.zip_with("_ll", "_said_ll", lambda a, b: a + b), F.coalesce("_prior", flat), lambda a, b: a + b)
    post = both.withColumn("_post", _softmax(fused))
    name = lambda x: F.coalesce(F.get(F.array(*map(F.lit, names)), (F.array_position(x, F.array_max(x)) - 1).cast("int")), F.lit(UNKNOWN))
    return post.select(*df.columns, name(F.col("_post")).alias("_language"), F.coalesce(F.array_max("_post"), F.lit(0.0)).alias("_confidence"), name(F.col("_ll")).alias("_text_language"))


def _of_documents(documents: DataFrame, model: Likelihoods) -> DataFrame:
    source = F.col("source")
    suffix = F.when(source.contains("."), F.substring_index(source, ".", -1))
    return identify(documents, model, F.coalesce("text", F.lit("")), F.col("lang"), source, suffix)


def documents_language(documents: DataFrame) -> DataFrame:
    """doc_id, language, confidence, text_language, kept of every document.

    Its lang is what is declared, its source the host. Kept is a document whose language
    is known and more likely than all others together; null or letterless texts are not.
    """
    found = _of_documents(documents.select("doc_id", "text", "lang", "source"), fit(documents))
    return found.select("doc_id", F.col("_language").alias("language"), F.col("_confidence").alias("confidence"), F.col("_text_language").alias("text_language"), _kept().alias("kept"))


def _kept() -> Column:
    return (F.col("_language") != UNKNOWN) & (F.col("_confidence") > 0.5)


def accepted(documents: DataFrame) -> DataFrame:
    """The documents that documents_language keeps, columns as they were."""
    return _of_documents(documents, fit(documents)).filter(_kept()).select(*documents.columns)


def pages_language(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, language, confidence, text_language, declared of every web page."""
    html = F.coalesce("html", F.lit(""))
    shown = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*+>", " ")
    declared = F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""", 1), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/:?#]+)", 1)), F.lit(""))
    found = identify(pages.select("page_id", "url", "html"), fit(labelled), shown, declared, host, F.substring_index(host, ".", -1))
    return found.select("page_id", F.col("_language").alias("language"), F.col("_confidence").alias("confidence"), F.col("_text_language").alias("text_language"), declared.alias("declared"))
