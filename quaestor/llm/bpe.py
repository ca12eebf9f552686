"""Byte-level BPE encoding and decoding by prefix dynamic programming."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import PrefixTable

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: White space as the splitting pattern has it: that of the standard library without U+001C..1F.
_BLANK = r"[^\S\x1c-\x1f]"
_INK = r"[\S\x1c-\x1f]"
#: Stretches that no match of the splitting pattern crosses; so they can be kept and looked up.
_STRETCH = re.compile(rf" ?{_INK}+|{_BLANK}+(?!{_INK})|{_BLANK}")
_BLANKS = re.compile(rf"{_BLANK}+")
#: A space beside another blank: then a text is not simply words between spaces.
_MIXED = re.compile(r" (?:(?=\s)|(?<=\s ))")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _latin(text: str) -> str:
    """A character for each UTF-8 byte."""
    return text.encode().decode("latin-1")


class BytePairCodec:
    """A worker's encoder. Encodings of words are kept up to a fixed number of them."""

    KEPT, KEPT_CHARS = 500_000, 40

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.ids = np.fromiter(ranks.values(), "<u4")
        self.table = PrefixTable({token.decode("latin-1"): rank for token, rank in ranks.items()})
        self.whole = self.table.number.get
        self.split = regex.compile(pattern).findall
        self.bytes = np.frombuffer(b"".join(ranks), "u1")
        self.sizes, self.starts = np.zeros((2, max(ranks.values()) + 1), "i8")
        sizes = np.fromiter(map(len, ranks), "i8")
        self.sizes[self.ids], self.starts[self.ids] = sizes, np.cumsum(sizes) - sizes
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def numbers(self, piece: str) -> list[int]:
        """Tokens of one piece; the library takes a piece that is a token as it is."""
        data = _latin(piece)
        found = self.whole(data)
        return [found] if found is not None else self.table.tokens(self.table.extend([], data))

    def stretch(self, text: str) -> bytes:
        out, pieces = [], self.pieces
        for piece in self.split(text):
            found = pieces.get(piece)
            if found is None:
                found = self.ids[self.numbers(piece)].tobytes()
                if len(pieces) < self.KEPT and len(piece) <= self.KEPT_CHARS:
                    pieces[piece] = found
            out.append(found)
        return b"".join(out)

    def looked_up(self, parts: list[str], lead: str) -> list[bytes]:
        """Encodings of stretches, each with lead before it."""
        kept = self.kept
        out = list(map(kept.get, parts))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    part = parts[i]
                    out[i] = kept.get(part) or self.stretch(lead + part)
                    if len(kept) < self.KEPT and len(part) <= self.KEPT_CHARS:
                        kept[part] = out[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if text[:1] == " " or text[-1:] == " " or _MIXED.search(text):
            return b"".join(map(self.stretch, _STRETCH.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([self.stretch(first), *self.looked_up(rest, " ")])

    def decode(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4")
        sizes = self.sizes[own]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(sizes.sum()) + np.repeat(self.starts[own] - ends + sizes, sizes)].tobytes()


@lru_cache(1)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One for each worker process, as its tasks follow one another."""
    return BytePairCodec(path, pattern)


class Document:
    """A text whose prefix tables are kept, for exact appends and for edits in place.

    Only the pieces an edit touches, and those behind it until the split falls in step
    again, are encoded anew; of the first of them its unchanged prefix is reused.
    """

    def __init__(self, codec: BytePairCodec, text: str = "") -> None:
        self.codec, self.text = codec, ""
        self.pieces: list[tuple[str, list]] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        text = self.text[:start] + new + self.text[end:]
        keep, at = 0, 0
        # A piece stays when it ends before the edit with another one between them: the
        # pattern looks no further ahead than that, but for runs of white space.
        while keep + 1 < len(self.pieces) and at + len(self.pieces[keep][0]) + len(self.pieces[keep + 1][0]) < start and not _BLANKS.fullmatch(self.pieces[keep + 1][0]):
            at += len(self.pieces[keep][0])
            keep += 1
        old, shift = self.pieces[keep:], len(text) - len(self.text)
        starts, pos = {}, at
        for n, (piece, _) in enumerate(old):
            starts[pos] = n
            pos += len(piece)
        fresh, pos, tail = [], at, []
        spare = iter(old)
        for piece in self.codec.split(text, at):
            n = starts.get(pos - shift)
            if pos >= start + len(new) and n is not None and pos - shift > end and old[n][0] == piece:
                tail = old[n:]
                break
            before, last = next(spare, ("", []))
            table = self.codec.table
            fresh.append((piece, table.edit(last, _latin(before), _latin(piece))))
            pos += len(piece)
        self.text, self.pieces = text, self.pieces[:keep] + fresh + tail

    def ids(self) -> list[int]:
        codec, out = self.codec, []
        for piece, last in self.pieces:
            whole = codec.whole(_latin(piece))
            out += codec.ids[[whole] if whole is not None else codec.table.tokens(last)].tolist()
        return out


#: Rows worked on and handed back at a time, whatever the size of Spark's batches.
ROWS = 256


def _with_binary(df: DataFrame, made: dict[str, tuple[str, Callable]]) -> DataFrame:
    """df with binary columns, each computed from one that is there by then: name -> (from, how)."""
    fields = [f for f in df.schema.fields if f.name not in made]
    schema = T.StructType([*fields, *(T.StructField(name, T.BinaryType()) for name in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = {name: (source, how()) for name, (source, how) in made.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                for name, (source, how) in work.items():
                    columns[name] = pa.array([None if x is None else how(x) for x in columns[source].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_pydict({f.name: columns[f.name] for f in schema.fields})

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", tokens: str = "tokens", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, decoded: str | None = None) -> DataFrame:
    """Add the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    A null text has null ids, an empty one none. With decoded, add the bytes the ids stand
    for as well, in the same pass. Other columns pass through; a column already called as
    a new one is replaced. Rows are neither moved nor merged, so repeated rows and extra
    columns need no care.
    """
    made = {tokens: (text, lambda: codec(path, pattern).encode)}
    return _with_binary(df, made | {decoded: (tokens, lambda: codec(path, pattern).decode)} if decoded else made)


def decode(df: DataFrame, tokens: str = "tokens", decoded: str = "decoded", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Add the bytes that packed ids stand for; null ids have null bytes."""
    return _with_binary(df, {decoded: (tokens, lambda: codec(path, pattern).decode)})


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; a null text counts as empty."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(rows, decoded="decoded").select(
        "doc_id",
        (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
