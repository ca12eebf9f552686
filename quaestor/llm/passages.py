"""Repeated passages: what an earlier document holds as well is removed from later ones.

Every stretch of LENGTH bytes that is shared has the same least hash among its short
grams, and consecutive stretches mostly share it; so texts fall into segments, keyed by
that hash, and only segments whose key occurs twice need a closer look. Whole copies of an
earlier text go at once and take no further part: what they hold, the first one holds too.
Segments of a key meet in one task, which puts their suffixes in order. From the previous
and the next suffix of a smaller document in that order, and the least common prefix on
the way there, follows the longest match each place has in a smaller document: its
longest previous factor. Where that is LENGTH or more, the bytes are removed. A segment
that occurs again whole, and a window that very many documents hold, is told by the least
document it occurs in, before anything is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, is_set, kept

LENGTH = 50
GRAM = 18  # longer ones make more keys, shorter ones are shared by more unrelated texts
#: Bits of the filter of keys that occur in two texts: KEY_BITS a key, between the least and the most.
#: It only saves moving segments that are alone; beyond its keys more of them are moved, never all.
FILTER_BITS, MOST_BITS = 26, 29
KEY_BITS = 16
FILTER_KEYS = 1 << MOST_BITS
#: Segments of a key that one task puts in order; those of a more frequent key are split
#: into their windows of LENGTH bytes, each a key of its own. At most MANY keys are that frequent.
HOT, MANY = 20_000, 4_000_000
#: Windows more frequent than HOT, at most, that travel with the least document holding them.
FIRSTS = 200_000
#: Bits of the filters of rows: whole copies, and rows that lose something.
ROW_BITS = 24
#: Bytes of segments put in suffix order at a time.
BLOCK = 1_000_000
#: Bits of the slots that tell windows of such a block apart, and bytes whose hashes are made at a time.
WINDOW_BITS, CHUNK = 22, 1 << 15


def _grams(text: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at each place, by doubling."""
    n, done, size = len(text) - k + 1, 0, 1
    now, out = (text.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), None
    while k:
        if k & 1:
            part = now[done : done + n]
            out = part.copy() if out is None else out * np.uint64(0xC2B2AE3D27D4EB4F) + part
            done += size
        k >>= 1
        if k:
            now = now[:-size] * np.uint64(0x165667B19E3779F9 + 2 * size) + now[size:]
            now ^= now >> np.uint64(31)
            size *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def segments(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, first place and end (exclusive, in bytes) of the segments of a text of LENGTH bytes or more."""
    width = LENGTH - GRAM + 1
    now, size = _grams(text, GRAM), 1
    n = len(now) - width + 1
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    least = np.minimum(now[:n], now[width - size : width - size + n])
    turn = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    # In periodic text a key may last; then it is cut, so that a segment's first and last
    # stretch hold all of it.
    lasting = np.diff(np.append(turn, n))
    if lasting.max() > LENGTH:
        turn = np.concatenate([np.arange(a, a + m, LENGTH) for a, m in zip(turn, lasting, strict=True)])
    return least[turn].view("i8"), turn, np.append(turn[1:], n) + LENGTH - 1


def suffix_order(flat: np.ndarray, left: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Ranks of all places by the 7, 14, 28, ... bytes from there on, up to where the longest text ends.

    left says how many bytes a place's text still has; a text that ends comes before one
    that goes on. The last ranks are those of whole suffixes.
    """
    n, padded = len(flat), np.concatenate([flat, np.zeros(7, "u1")])
    key = np.zeros(n, "u8")
    for k in range(7):
        key = key << np.uint64(8) | np.where(left > k, padded[k : k + n], 0).astype("u8")
    key = key << np.uint64(8) | np.minimum(left, 7).astype("u8")
    levels, size = [], 7
    while True:
        order = np.argsort(key)
        rank = np.empty(n, "i8")
        rank[order] = np.cumsum(np.concatenate([[0], key[order[1:]] != key[order[:-1]]]))
        levels.append((size, rank))
        if size >= left.max():
            return levels
        behind = np.where(left > size, rank[np.minimum(np.arange(n) + size, n - 1)] + 1, 0)
        key = (rank << 32 | behind).view("u8")
        size *= 2


def common_prefixes(order: np.ndarray, flat: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order; none for the first."""
    a, b = order[:-1], order[1:]
    most, last = np.minimum(left[a], left[b]), len(flat) - 1
    shared = np.zeros(len(a), "i8")
    for size, rank in reversed(levels):
        same = (shared < most) & (rank[np.minimum(a + shared, last)] == rank[np.minimum(b + shared, last)])
        shared += np.where(same, size, 0)
    same = shared < most
    for _ in range(7):
        same &= (shared < most) & (flat[np.minimum(a + shared, last)] == flat[np.minimum(b + shared, last)])
        shared += same
    return np.concatenate([[0], np.minimum(shared, most)])


def _previous_smaller(docs: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order, the length it shares with the nearest one before it of a
    smaller document; 0 where there is none, or where what is shared falls below least.

    Pointers jump over what is not smaller: all of that has been passed for the one jumped to.
    """
    to, length = np.arange(-1, len(docs) - 1), shared.copy()
    going = np.flatnonzero(length >= least)
    while len(going):
        going = going[docs[to[going]] >= docs[going]]
        over = to[going]
        length[going] = np.minimum(length[going], length[over])
        to[going] = to[over]
        going = going[length[going] >= least]
    return np.where(length >= least, length, 0)


def previous_factors(order: np.ndarray, docs: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each suffix in order: the longest match in a smaller document
    that is least or more, else 0. It lies at the previous or the next smaller position."""
    before = _previous_smaller(docs, shared, least)
    turned = np.concatenate([[0], shared[:0:-1]])
    return np.maximum(before, _previous_smaller(docs[::-1], turned, least)[::-1])


def shared_windows(flat: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Where LENGTH bytes start that a text of another number may hold too; all such places, and a few more whose hashes meet.

    Of two different numbers that write to a slot one stays, which the other then finds.
    """
    places, slots = np.flatnonzero(left >= LENGTH), np.empty(len(flat), "i4")
    for at in range(0, max(len(flat) - LENGTH + 1, 0), CHUNK):
        part = _grams(flat[at : at + CHUNK + LENGTH - 1], LENGTH)
        slots[at : at + len(part)] = part >> np.uint64(64 - WINDOW_BITS)
    slots, number = slots[places], number[places].astype("i4")
    last, met = np.empty(1 << WINDOW_BITS, "i4"), np.zeros(1 << WINDOW_BITS, bool)
    last[slots] = number
    met[slots[last[slots] != number]] = True
    return places[met[slots]]


def covered(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place where LENGTH bytes of a text start: whose text and which place, if a
    text of a smaller document has them too.

    Only stretches of windows that another document may hold are put in suffix order.
    """
    flat = np.frombuffer(b"".join(texts), "u1")
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    near = shared_windows(flat, ends[owner] - np.arange(len(flat)), np.unique(docs, return_inverse=True)[1][owner])
    if not len(near):
        return near, near
    place = np.flatnonzero(np.cumsum(np.bincount(near, minlength=len(flat) + 1) - np.bincount(near + LENGTH, minlength=len(flat) + 1))[:-1])
    flat, of = flat[place], owner[place]
    last = np.append(np.flatnonzero((np.diff(place) > 1) | (np.diff(of) > 0)), len(place) - 1)
    left = np.repeat(last, np.diff(last, prepend=-1)) + 1 - np.arange(len(place))
    levels = suffix_order(flat, left)
    whole = np.flatnonzero(left >= LENGTH)
    order = whole[np.argsort(levels[-1][1][whole])]
    factors = previous_factors(order, docs[of[order]], common_prefixes(order, flat, left, levels), LENGTH)
    found = np.sort(order[factors >= LENGTH])
    return of[found], place[found] - (ends - sizes)[of[found]]


def _resolve(rows: list[tuple[bytes, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, hash, start, end) of what is covered in distinct segments (segment, doc, hash, start)."""
    texts, at = [], {}
    docs = []
    for text, doc, _, _ in rows:
        if (text, doc) not in at:
            at[text, doc] = len(texts)
            texts.append(text)
            docs.append(doc)
    owner, place = covered(texts, np.array(docs))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for text, doc, row, start in rows:
        k = at[text, doc]
        for a, b in _stretches(place[cuts[k] : cuts[k + 1]]):
            yield doc, row, start + a, start + b


def _stretches(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of the bytes that windows at these ascending places cover, joined where windows follow one another."""
    if len(places):
        edges = np.flatnonzero(np.diff(places) > 1) + 1
        for part in np.split(places, edges):
            yield int(part[0]), int(part[-1]) + LENGTH


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, doc, h, text, s: rows of one doc_id and text are the same row for all that follows,
    so nothing hangs on the order in which rows come. s is the row's slot in a filter."""
    text = F.coalesce("text", F.lit(""))
    known = documents.select("doc_id", F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))
    return known.select("*", F.pmod(F.xxhash64("doc", "h"), F.lit(1 << ROW_BITS)).alias("s"))


def whole_copies(rows: DataFrame) -> np.ndarray:
    """A bitmap over slots of rows (doc, text, s): all rows of a set slot repeat the text of a smaller doc_id.

    Its size is fixed. A slot that other rows share stays unset; its copies are then found
    like other repeats.
    """
    sized = rows.filter(F.octet_length("text") >= LENGTH)
    told = cut(sized.select("s", "doc", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    first = told.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("digest", "first")
    copies = cut(told.join(first, "digest", "left").select("s", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy")))
    return bit_filter(copies.filter("copy").select("s"), "s", ROW_BITS) & ~bit_filter(copies.filter("not copy").select("s"), "s", ROW_BITS)


def removable(rows: DataFrame, skipped: Broadcast | None = None) -> DataFrame:
    """doc, h, start, end (bytes): stretches of rows (doc, h, text, s) that start in a smaller doc_id too.

    Rows in slots of the bitmap skipped take no part.
    """
    spark = rows.sparkSession

    def parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if skipped is not None:
                batch = batch.filter(pa.array(~is_set(skipped.value, batch.column(3).to_numpy())))
            yield from (batch.slice(at, size) for at in range(0, batch.num_rows, size))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 256):
            keys = [np.unique(segments(np.frombuffer(text, "u1"))[0]) for text in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    rows = rows.filter(F.octet_length("text") >= LENGTH).select("doc", "h", F.col("text").cast("binary").alias("text"), "s")
    shared = kept(rows.mapInArrow(keyed, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    n, most = shared.agg(F.count(F.lit(1)), F.sum("n")).first()
    hot = max(HOT, (most or 0) // MANY)
    often = np.sort(shared.filter(F.col("n") > hot).select("key").toArrow().column("key").to_numpy())
    width = min(max(FILTER_BITS, (KEY_BITS * n).bit_length()), MOST_BITS)
    slots = (1 << width) - 1
    bitmap = bit_filter(shared.select(F.col("key").bitwiseAND(slots).alias("s")), "s", width) if n <= FILTER_KEYS else None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """window, doc, n of frequent keys, summed up in the task."""
        held: dict[bytes, list[int]] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["window", "doc", "n"])

        for part in parts(batches, 128):
            for doc, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                keys, starts, ends = segments(np.frombuffer(text, "u1"))
                hit = np.isin(keys, often)
                for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True):
                    for at in range(a, b - LENGTH + 1):
                        own = held.get(text[at : at + LENGTH])
                        if own is None:
                            held[text[at : at + LENGTH]] = [doc, 1]
                        else:
                            own[0] = min(own[0], doc)
                            own[1] += 1
            if len(held) > 100_000:
                yield sent()
                held.clear()
        yield sent()

    first: dict[bytes, int] = {}
    if len(often):
        # A segment has LENGTH windows at most, so that no more than FIRSTS are that frequent.
        common = rows.mapInArrow(windows, "window binary, doc bigint, n bigint").groupBy("window").agg(F.min("doc").alias("doc"), F.sum("n").alias("n"))
        first = {bytes(r.window): r.doc for r in common.filter(F.col("n") > max(hot, LENGTH * most // FIRSTS)).select("window", "doc").collect()}
    given = spark.sparkContext.broadcast((bitmap, often, first))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments; of frequent keys windows; and what is known to be covered (no segment, start and end in one)."""
        bits, frequent, least = given.value
        for part in parts(batches, 128):
            out: list[list] = [[], [], [], [], [], []]
            for doc, row, text in zip(*(c.to_pylist() for c in part.columns[:3]), strict=True):
                keys, starts, ends = segments(np.frombuffer(text, "u1"))
                if bits is not None:
                    keep = is_set(bits, keys & slots)
                    keys, starts, ends = keys[keep], starts[keep], ends[keep]
                spread = np.isin(keys, frequent)
                single = [text[a:b] for a, b in zip(starts[~spread].tolist(), ends[~spread].tolist(), strict=True)]
                own, places, alone = keys[~spread].tolist(), starts[~spread].tolist(), [False] * len(single)
                gone = []
                for a, b in zip(starts[spread].tolist(), ends[spread].tolist(), strict=True):
                    for at in range(a, b - LENGTH + 1):
                        window = text[at : at + LENGTH]
                        before = least.get(window)
                        if before is None:
                            single.append(window)
                            places.append(at)
                            alone.append(True)
                            own.append(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True))
                        elif before < doc:
                            gone.append(at)
                for a, b in _stretches(np.array(gone, "i8")):
                    single.append(None)
                    places.append(a << 32 | b)
                    alone.append(True)
                    own.append(row)
                for target, more in zip(out, (own, single, [doc] * len(own), [row] * len(own), places, alone), strict=True):
                    target += more
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), *(pa.array(x, pa.int64()) for x in out[2:5]), pa.array(out[5], pa.bool_())], names=["key", "segment", "doc", "h", "start", "alone"])

    pieces = rows.mapInArrow(cut_out, "key bigint, segment binary, doc bigint, h bigint, start bigint, alone boolean")
    if bitmap is None:
        pieces = pieces.filter("not alone").join(shared.select("key"), "key", "left_semi").unionByName(pieces.filter("alone"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by key, segment and document: all documents but a segment's first are
        # covered by it at once; the first ones of a key's segments are put in suffix order.
        waiting: list[tuple[bytes, int, int, int]] = []  # of whole keys
        group: list[tuple[bytes, int, int, int]] = []  # of the key at hand
        key = segment = first = None
        suffixes, kinds = 0, 0
        names = ["doc", "h", "start", "end"]

        def batch_of(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], [], []))], names=names)

        for batch in batches:
            told = batch.filter(pc.is_null(batch.column(1)))
            at = told.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([told.column(2), told.column(3), pa.array(at >> 32), pa.array(at & 0xFFFFFFFF)], names=names)
            batch = batch.filter(pc.is_valid(batch.column(1)))
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column(1)
            keys, docs, rows, starts = (batch.column(c).to_numpy() for c in (0, 2, 3, 4))
            turn = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
            fresh = turn | np.append(texts[0].as_py() != segment, pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False))
            begun = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            firsts = np.where(begun < 0, 0 if first is None else first, docs[np.maximum(begun, 0)])
            later = docs != firsts
            ends = starts + pc.binary_length(texts).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c[later]) for c in (docs, rows, starts, ends)], names=names)
            # Keys are numbered, the one at hand 0. Only those of several segments, and the last one, are looked at row by row.
            number = np.cumsum(turn)
            last = int(number[-1])
            several = np.bincount(number[fresh], minlength=last + 1)
            several[0] += kinds
            seen = ~later & ((several[number] > 1) | (number == last))
            held = list(zip(texts.filter(pa.array(seen)).to_pylist(), *(c[seen].tolist() for c in (docs, rows, starts)), strict=True))
            one, end = np.searchsorted(number[seen], [1, last]).tolist()
            if last:
                done = (group + held[:one] if several[0] > 1 else []) + held[one:end]
                waiting += done
                suffixes += sum(len(g[0]) for g in done)
                group = held[end:]
            else:
                group += held
            key, segment, first, kinds = keys[-1], texts[n - 1].as_py(), int(firsts[-1]), int(several[last])
            if suffixes > BLOCK:
                yield batch_of(list(_resolve(waiting)))
                waiting, suffixes = [], 0
        yield batch_of(list(_resolve(waiting + (group if kinds > 1 else []))) if waiting or kinds > 1 else [])

    pieces = pieces.select("key", "segment", "doc", "h", "start")
    return pieces.repartition("key").sortWithinPartitions("key", "segment", "doc").mapInArrow(meet, "doc bigint, h bigint, start bigint, end bigint")


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) with kept (the bytes left), n_bytes, n_removed and n_spans.

    A byte goes if it lies in LENGTH bytes that also start in a document with a smaller
    doc_id, judged on the texts as they came; matches lie within one document. A null text
    is empty. A row without doc_id neither loses anything nor counts as earlier; rows with
    the same doc_id are not earlier than one another. An empty table gives no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = _rows(documents)
    known = rows.filter(F.col("doc").isNotNull())
    spark = documents.sparkSession
    copies = spark.sparkContext.broadcast(whole_copies(known))
    joined = F.shiftleft("start", 32).bitwiseOR(F.col("end"))
    spans = kept(removable(known, copies).groupBy(F.col("doc").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_set(joined).alias("spans")))
    touched = spark.sparkContext.broadcast(bit_filter(spans.select(F.pmod(F.xxhash64("_doc", "_h"), F.lit(1 << ROW_BITS)).alias("s")), "s", ROW_BITS))
    given = rows.select("doc_id", "doc", "h", F.col("text").cast("binary").alias("text"), "s")

    def left(text: bytes, spans: list[int] | None) -> tuple[bytes, int, int, int]:
        """spans: start and end of each in one number, 32 bits each."""
        if not spans:
            return text, len(text), 0, 0
        both = np.array(spans, "i8")
        change = np.bincount(both >> 32, minlength=len(text) + 1) - np.bincount(both & 0xFFFFFFFF, minlength=len(text) + 1)
        gone = np.cumsum(change)[:-1] > 0
        return np.frombuffer(text, "u1")[~gone].tobytes(), len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())

    def made(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*found, strict=True) if found else ([],) * 4
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    def parts(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows that lose some bytes by their spans, or the others, of which whole copies lose all."""
        for batch in batches:
            slots = batch.column(4).to_numpy()
            whole = is_set(copies.value, slots) & (pc.and_(batch.column(1).is_valid(), pc.greater_equal(pc.binary_length(batch.column(3)), LENGTH))).to_numpy(zero_copy_only=False)
            flags = is_set(touched.value, slots) & ~whole
            own, whole = batch.filter(pa.array(flags == hit)), whole[flags == hit]
            yield from ((own.slice(at, 256), whole[at : at + 256]) for at in range(0, own.num_rows, 256))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, whole in parts(batches, False):
            yield made(part.column(0), [(b"", len(t), len(t), 1) if gone else left(t, None) for t, gone in zip(part.column(3).to_pylist(), whole, strict=True)])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in parts(batches, True):
            yield part.select(["doc_id", "doc", "h", "text"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield made(part.column(0), [left(*x) for x in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)])

    # Only texts that lose something (and a few that the filter takes for such) are moved.
    schema = f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
    met = given.mapInArrow(some, f"doc_id {kind}, doc bigint, h bigint, text binary").join(spans, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    lost = met.select("doc_id", "text", "spans").mapInArrow(remove, schema)
    return given.mapInArrow(untouched, schema).unionByName(lost)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return without_repeats(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
