"""Token counts by prefix dynamic programming: the exact count at every prefix."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import NONE, PrefixTable

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Rows worked on and handed back at a time, whatever the size of Spark's batches.
ROWS = 256
#: No piece of the vocabulary has a space behind another character, so none crosses these.
_STRETCH = re.compile(r" +[^ ]*")


class PrefixCounter:
    """One task's counter for a piece vocabulary with byte fallback and a leading space.

    Characters outside the vocabulary count their UTF-8 bytes. Counts of short stretches
    are kept up to a fixed number of them.
    """

    KEPT, KEPT_CHARS = 400_000, 40

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.table = PrefixTable({model.id_to_piece(i): -model.get_score(i) for i in normal})
        pairs = {p[i : i + 2] for p in self.table.text for i in range(len(p) - 1)}
        if any(p[1] == SPACE and p[0] != SPACE for p in pairs):
            raise ValueError("pieces of this vocabulary cross spaces")
        self.pairs = pairs
        self.words: dict[str, int] = {}
        self.cells_kept: dict[str, int] = {}

    def cells(self, stretch: str) -> list[str]:
        """Cut where no piece has these two characters side by side; nothing merges there."""
        out, begin, pairs = [], 0, self.pairs
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in pairs:
                out.append(stretch[begin:i])
                begin = i
        out.append(stretch[begin:])
        return out

    def prefixes(self, stretch: str) -> list[int]:
        """Tokens of each prefix of one stretch."""
        counts, base, size = [], 0, self.table.size
        for cell in self.cells(stretch.replace(" ", SPACE)):
            own = [0]
            for end, n in enumerate(self.table.extend([], cell), 1):
                own.append(own[end - size[n]] + 1 if n != NONE else own[-1] + len(cell[end - 1].encode()))
            counts += [base + c for c in own[1:]]
            base += own[-1]
        return counts

    def total(self, stretch: str) -> int:
        """Tokens of a whole stretch; of those, the counts of short cells are kept."""
        found = 0
        for cell in self.cells(stretch.replace(" ", SPACE)):
            count = self.cells_kept.get(cell)
            if count is None:
                tokens = self.table.tokens(self.table.extend([], cell))
                count = sum(1 if n != NONE else len(cell.encode()) for n in tokens)  # such a symbol is a cell of its own
                if len(cell) <= self.KEPT_CHARS:
                    if len(self.cells_kept) >= self.KEPT:
                        self.cells_kept.clear()
                    self.cells_kept[cell] = count
            found += count
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            return sum(map(self.total, _STRETCH.findall(f" {text}")))
        words = text.split(" ")
        counts = list(map(self.words.get, words))
        if None in counts:
            for i, c in enumerate(counts):
                if c is None:
                    counts[i] = self.words.get(words[i]) or self.total(f" {words[i]}")
                    if len(self.words) < self.KEPT and len(words[i]) <= self.KEPT_CHARS:
                        self.words[words[i]] = counts[i]
        return sum(counts)

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[: i] for every i, each as if it were the whole text."""
        out, total = [], 0
        for part in _STRETCH.findall(f" {text.replace(SPACE, ' ')}"):
            own = self.prefixes(part)
            out += [total + c for c in own]
            total += own[-1]
        return [0, *out[1:]] if text else [0]

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with no more than budget tokens.

        Counts may fall as a prefix grows, so the last fitting one is looked for.
        """
        if self.count(text) <= budget:
            return len(text)
        return max(i for i, c in enumerate(self.prefix_counts(text)) if c <= budget)


@lru_cache(1)
def counter(path: str) -> PrefixCounter:
    """One for each worker process, as its tasks follow one another."""
    return PrefixCounter(path)


def _with_long(df: DataFrame, text: str, target: str, path: str, make) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name != target]
    schema = T.StructType([*fields, T.StructField(target, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make(counter(path))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                columns[target] = pa.array([None if x is None else work(x) for x in columns[text].to_pylist()], pa.int64())
                yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in schema.fields})

    return df.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """Add the token count of each whole text; null for a null text, 0 for an empty one.

    Other columns pass through; a column already called as the new one is replaced.
    """
    return _with_long(df, text, n_tokens, path, lambda own: own.count)


def truncate_to_budget(df: DataFrame, budget: int, text: str = "text", cut: str = "cut", path: str = VOCABULARY) -> DataFrame:
    """Add how many characters of each text fit into budget tokens; the answer comes from
    the stored prefix counts, with no second encoding."""
    return _with_long(df, text, cut, path, lambda own: lambda x: own.longest_within(x, budget))


def token_counts(documents: DataFrame, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; a null text counts as empty."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return count_tokens(sized).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
