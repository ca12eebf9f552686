"""N-gram Jaccard join: word shingle sets of similarity 0.9 and more, by prefix trees.

Sets are ordered rarest shingle first. What two linked sets share begins within a prefix of
each, so only sets with a shared shingle in their prefix go on, and every set has its home
with that one of them which most sets hold. The sets of a home, or of a bounded cell of it, are a trie in
one global order of shingles; all sets at hand walk it together, the overlap with a path is
counted once for all sets below it, and a subtree is left once what remains on both sides
cannot reach the overlap demanded. Pairs whose sets live in different cells, and which no
link connects yet, are met by a visit: per shared shingle the members outside its largest
component go to the cells of the others. So every link joins two documents of one
component, and no group of copies is compared with itself pair by pair.

Shingles and whole sets are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, is_set, kept
from .graph import components
from .neardup import _groups, shingles

#: Tokens of a cell; larger homes are dealt into several, which PIVOTS of their sets visit first.
CELL, PIVOTS = 1 << 19, 8
#: Tokens that a task counts at a time, and that meet in one bucket.
CHUNK, BUCKET = 1 << 19, 1 << 19
#: A shingle in one of OFTEN documents, and in MANY at least, is known to all tasks and counts as most
#: frequent. There are at most OFTEN times as many of them as a document has shingles on average.
OFTEN, MANY = 128, 4096
FILTER_BITS = 24


def least_overlap(n: int, m: int, percent: int) -> int:
    """What sets of n and m shingles share at least if they are linked."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Of the shingles in order, how many may precede the first that a linked set shares, plus one."""
    return n - -(-percent * n // 100) + 1


def _planes(values: np.ndarray) -> bytes:
    """Bytes of one significance side by side, which compress well where the values are in order."""
    return values.view("u1").reshape(len(values), -1).T.tobytes()


def _flat(planes: list[bytes], kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.empty(0, kind), *(np.ascontiguousarray(np.frombuffer(p, "u1").reshape(width, -1).T).view(kind).ravel() for p in planes)])


def _set_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def signed(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n, set (a hash, null for empty sets) of every row; and often, counts of frequent shingles, in some rows."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def often(chunk: list[np.ndarray]) -> list[dict]:
        found, count = np.unique(np.concatenate([np.empty(0, "u8"), *chunk]), return_counts=True)
        some = count >= max(16, 2 * len(chunk) // OFTEN)
        return [{"token": int(t), "count": int(c)} for t, c in zip(found[some].view("i8"), count[some], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("token", pa.int64()), ("count", pa.int64())]))
        chunk, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                chunk += sets
                held += sum(map(len, sets))
                counts = [None] * len(sets)
                if held >= CHUNK:
                    counts[0], chunk, held = often(chunk), [], 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array(counts, shape)], names=["doc_id", "n", "set", "often"]
                )
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([often(chunk)], shape)], names=["doc_id", "n", "set", "often"])

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, set bigint, often array<struct<token: bigint, count: bigint>>")


def ordered(documents: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """set, n, prefix, tokens of sets that may have links: the shingles that other sets hold as well
    (64-bit, packed, rarest first), and those of them that are within the set's prefix.

    A shingle's documents meet in one bucket, counted there; what is held once goes no further.
    """
    spark = documents.sparkSession
    total, docs = rows.agg(F.sum("n"), F.count("n")).first()
    buckets = 1 << max(0, (-(-(total or 0) // BUCKET) - 1).bit_length())
    shift = 64 - (buckets.bit_length() - 1)
    frequent = rows.select(F.explode("often").alias("o")).groupBy("o.token").agg(F.sum("o.count").alias("c")).filter(F.col("c") >= max(MANY, docs // OFTEN))
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in frequent.select("token").collect()], "i8").view("u8")))
    classes = rows.filter("set is not null").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("rep"))
    # Copies are left out by a bitmap of fixed size; one that slips through does no harm.
    slot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << FILTER_BITS))
    known = spark.sparkContext.broadcast(bit_filter(classes.select(F.col("rep").alias("doc_id")).select(slot.alias("s")), "s", FILTER_BITS))

    def dealt(chunk: list[np.ndarray]) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
        """A chunk's sets by bucket (kind 0); their sizes (1) and frequent shingles (2) by part of the sets."""
        ids = np.array([_set_id(s) for s in chunk], "i8")
        size = np.array([len(s) for s in chunk], "i8")
        token, at = np.concatenate(chunk), np.repeat(np.arange(len(chunk), dtype="u4"), size)
        hot = np.isin(token, frequent.value)
        part = ids & (buckets - 1)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            yield int(p), 1, ids[own].tobytes(), b"", b"", size[own].tobytes()
            much = hot & (part[at] == p)
            if much.any():
                yield int(p), 2, ids[at[much]].tobytes(), b"", _planes(token[much]), b""
        token, at = token[~hot], at[~hot]
        order = np.argsort(token, kind="stable")
        token, at = token[order], at[order]
        bucket = (token >> np.uint64(shift)).astype("i8") if buckets > 1 else np.zeros(len(token), "i8")
        for k in np.split(np.arange(len(token)), np.flatnonzero(np.diff(bucket)) + 1) if len(token) else []:
            local, index = np.unique(at[k], return_inverse=True)
            yield int(bucket[k[0]]), 0, ids[local].tobytes(), _planes(index.astype("u4")), _planes(token[k]), b""

    packed = "part bigint, kind int, ids binary, at binary, token binary, count binary"
    names = [c.split()[0] for c in packed.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            wanted = batch.filter(pa.array(is_set(known.value, batch.column(1).to_numpy())))
            for at in range(0, wanted.num_rows, 256):
                for text in wanted.column(0).slice(at, 256).to_pylist():
                    own = shingles(text, width)
                    if len(own):
                        chunk.append(own)
                        held += len(own)
                    if held >= CHUNK:
                        yield batch_of([*dealt(chunk)])
                        chunk, held = [], 0
        if chunk:
            yield batch_of([*dealt(chunk)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a bucket: entries of shingles that several sets hold, with their counts, by part of the sets."""
        for group in _groups(batches, 6):
            part, kinds, ids, at, token, count = group
            rest = [(p, k, i, a, t, c) for p, k, i, a, t, c in zip(part, kinds, ids, at, token, count, strict=True) if k]
            if rest:
                yield batch_of(rest)
            some = [k for k, kind in enumerate(kinds) if kind == 0]
            if not some:
                continue
            own = np.concatenate([np.frombuffer(ids[k], "i8")[_flat([at[k]], "u4")] for k in some])
            tokens = _flat([token[k] for k in some], "u8")
            order = np.argsort(tokens, kind="stable")
            own, tokens = own[order], tokens[order]
            new = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            times = np.repeat(np.diff(np.append(new, len(tokens))), np.diff(np.append(new, len(tokens)))).astype("u4")
            shared = times > 1
            own, tokens, times = own[shared], tokens[shared], times[shared]
            order = np.argsort(own & (buckets - 1), kind="stable")
            own, tokens, times = own[order], tokens[order], times[order]
            cuts = np.flatnonzero(np.diff(own & (buckets - 1))) + 1
            found = [(int(i[0] & (buckets - 1)), 0, _planes(i), b"", _planes(t), _planes(c)) for i, t, c in zip(*(np.split(x, cuts) for x in (own, tokens, times)), strict=True) if len(i)]
            if found:
                yield batch_of(found)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, ids, _, token, count in _groups(batches, 5):
            by = lambda k: [x for x, kind in enumerate(kinds) if kind == k]
            size = dict(zip(np.concatenate([np.empty(0, "i8"), *(np.frombuffer(ids[k], "i8") for k in by(1))]).tolist(), np.concatenate([np.empty(0, "i8"), *(np.frombuffer(count[k], "i8") for k in by(1))]).tolist(), strict=True))
            own = np.concatenate([_flat([ids[k] for k in by(0)], "i8"), *(np.frombuffer(ids[k], "i8") for k in by(2))])
            tokens = _flat([token[k] for k in (*by(0), *by(2))], "u8")
            times = np.full(len(tokens), 1 << 31, "u4")
            often = _flat([count[k] for k in by(0)], "u4")
            times[: len(often)] = often
            order = np.lexsort((tokens, times, own))
            own, tokens = own[order], tokens[order]
            once = np.ones(len(own), bool)
            once[1:] = (own[1:] != own[:-1]) | (tokens[1:] != tokens[:-1])
            own, tokens = own[once], tokens[once]
            out = []
            cuts = np.flatnonzero(np.diff(own)) + 1
            for who, what in zip(np.split(own, cuts), np.split(tokens, cuts), strict=True):
                if not len(who):
                    continue
                n = size[int(who[0])]
                first = prefix_length(n, percent) - (n - len(what))
                if first > 0 and least_overlap(n, n + 1, percent) <= n:
                    out.append((int(who[0]), n, what[:first].view("i8"), what.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["set", "n", "prefix", "tokens"])

    texts = documents.select(F.col("text").cast("binary").alias("text"), slot.alias("s"))
    by_bucket = texts.mapInArrow(spread, packed).select("part", F.col("part").alias("own"), *names[1:]).repartition(buckets, "part").sortWithinPartitions("part")
    by_set = by_bucket.mapInArrow(counted, packed).repartition(buckets, "part").sortWithinPartitions("part")
    return kept(by_set.mapInArrow(gathered, "set bigint, n bigint, prefix array<bigint>, tokens binary"))


class Labels:
    """Which documents are connected so far."""

    def __init__(self, of: np.ndarray) -> None:
        first, self.parent = np.unique(of, return_index=True, return_inverse=True)[1:]
        self.parent = first[self.parent]

    def __call__(self, some: np.ndarray) -> np.ndarray:
        up = self.parent[some]
        while (self.parent[up] != up).any():
            up = self.parent[up]
        self.parent[some] = up
        return up

    def join(self, a: int, b: int) -> bool:
        x, y = int(self(np.array([a]))[0]), int(self(np.array([b]))[0])
        self.parent[max(x, y)] = min(x, y)
        return x != y


class Trie:
    """Sets in one order of their tokens, walked depth first along the paths they share."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> None:
        """sets: the tokens of each that may be shared, in any order; sizes: with those that are not."""
        self.percent = percent
        self.values, flat, often = np.unique(np.concatenate([np.empty(0, "u8"), *sets]), return_inverse=True, return_counts=True)
        place = np.empty(len(often), "i8")
        place[np.argsort(-often, kind="stable")] = np.arange(len(often))
        self.rank = place
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        paths = [np.sort(p) for p in np.split(place[flat], cuts)] if sets else []
        # In the order of the paths, those that share a beginning are side by side.
        self.order = sorted(range(len(paths)), key=lambda k: paths[k].astype(">u4").tobytes())
        self.paths = [paths[k] for k in self.order]
        self.sizes = np.asarray(sizes)[self.order]
        self.lengths = np.array([len(p) for p in self.paths], "i8")

    def _shared(self, low: int, high: int, depth: int) -> int:
        a, b = self.paths[low], self.paths[high - 1]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        return depth + int(differ[0]) if len(differ) else m

    def walk(self, queries: list[np.ndarray], sizes: np.ndarray, labels: Labels, who: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links (query, set) that join what labels do not connect yet. who: the labels' numbers of queries,
        own: of the sets; without own the queries are the sets in order."""
        count = len(queries)
        if own is None:
            own = who
        local = []
        for q in queries:
            at = np.minimum(np.searchsorted(self.values, q), len(self.values) - 1)
            local.append(np.sort(self.rank[at[self.values[at] == q]]))
        lengths = np.array([len(x) for x in local], "i8")
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([np.empty(0, "i8"), *local])
        holder = np.repeat(np.arange(count), lengths)
        keys = holder * len(self.values) + flat
        by = np.argsort(flat, kind="stable")
        post, where = holder[by], np.searchsorted(flat[by], np.arange(len(self.values) + 1))
        mark = np.zeros(len(self.values), "i8")

        def overlap(edge: np.ndarray, active: np.ndarray) -> np.ndarray:
            """How many tokens of an edge each active query holds."""
            if len(active) <= 8:
                mark[edge] = 1
                out = np.array([mark[local[q]].sum() for q in active], "i8")
                mark[edge] = 0
                return out
            length = where[edge + 1] - where[edge]
            steps = np.repeat(where[edge] - np.cumsum(length) + length, length) + np.arange(length.sum())
            return np.bincount(post[steps], minlength=count)[active]

        stack = [(0, len(self.paths), 0, np.arange(count), np.zeros(count, "i8"))] if self.paths else []
        while stack:
            low, high, depth, active, over = stack.pop()
            least, most, longest = self.sizes[low:high].min(), self.sizes[low:high].max(), self.lengths[low:high].max()
            n = sizes[active]
            fits = (100 * n >= self.percent * least) & (100 * most >= self.percent * n)
            if high - low == 1:
                fits &= labels(who[active]) != labels(own[self.order[low : low + 1]])
            active, over = active[fits], over[fits]
            if not len(active):
                continue
            end = self._shared(low, high, depth)
            if end > depth:
                edge = self.paths[low][depth:end]
                over = over + overlap(edge, active)
                passed = np.searchsorted(keys, active * len(self.values) + edge[-1], "right") - starts[active]
                rest = np.minimum(lengths[active] - passed, longest - end)
                fits = (over + rest) * (100 + self.percent) >= self.percent * (sizes[active] + least)
                active, over = active[fits], over[fits]
            at = low
            while at < high and self.lengths[at] == end:
                linked = active[over * (100 + self.percent) >= self.percent * (sizes[active] + self.sizes[at])]
                x = self.order[at]
                for q in linked[labels(who[linked]) != labels(own[x : x + 1])] if len(linked) else ():
                    if labels.join(int(who[q]), int(own[x])):
                        yield int(q), x
                at += 1
            if len(active):
                while at < high:
                    token, begin = self.paths[at][end], at
                    while at < high and self.paths[at][end] == token:
                        at += 1
                    stack.append((begin, at, end, active, over))


def _found(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def meet(members: DataFrame, guests: DataFrame, percent: int, among: bool) -> DataFrame:
    """Links (a, b) in each cell between its guests and its members, and if asked among members.

    Both have cell, set, label, n, tokens. Members of a cell are of bounded size; guests pass by in chunks.
    Of links that join the same labels only one is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, trie, held, waiting, size = None, None, [], [], 0

        def settle(guests: list) -> pa.RecordBatch:
            nonlocal trie
            unpack = lambda rows: [np.frombuffer(r[3], "u8") for r in rows]
            sizes = lambda rows: np.array([r[2] for r in rows], "i8")
            out = []
            if trie is None:
                trie = Trie(unpack(held), sizes(held), percent)
                if among:
                    out = [(held[a][0], held[b][0]) for a, b in trie.walk(unpack(held), sizes(held), Labels(np.array([r[1] for r in held], "i8")), np.arange(len(held)))]
            if guests and held:
                both = Labels(np.array([r[1] for r in (*held, *guests)], "i8"))
                out += [(guests[q][0], held[x][0]) for q, x in trie.walk(unpack(guests), sizes(guests), both, np.arange(len(held), len(held) + len(guests)), np.arange(len(held)))]
            return _found(out)

        for batch in batches:
            for key, guest, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != cell:
                    if len(held) + len(waiting) > 1:
                        yield settle(waiting)
                    cell, trie, held, waiting, size = key, None, [], [], 0
                if guest:
                    waiting.append(row)
                    size += len(row[3]) // 8
                    if size >= CELL:
                        yield settle(waiting)
                        waiting, size = [], 0
                else:
                    held.append(row)
        if len(held) + len(waiting) > 1:
            yield settle(waiting)

    columns = ("set", "label", "n", "tokens")
    rows = members.select("cell", F.lit(False).alias("guest"), *columns).unionByName(guests.select("cell", F.lit(True).alias("guest"), *columns))
    return rows.repartition("cell").sortWithinPartitions("cell", "guest", "set").mapInArrow(run, "a bigint, b bigint")


def _visits(known: DataFrame, percent: int) -> DataFrame:
    """set, label, cell of visits that entries (token, set, n, label, cell) ask for: what shares a shingle
    but neither a cell nor a component, where sizes allow a link.

    Of each shingle the members of its largest component stay where they are.
    """
    per = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("many"))
    main = per.groupBy("token").agg(F.max(F.struct("many", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("token", "main")
    goers = known.join(main, "token").filter("label <> main").select("token", "set", "label", "n", F.col("cell").alias("own"))
    there = known.join(main.select("token"), "token", "left_semi").groupBy(F.col("token").alias("_token"), "cell").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    worth = (F.col("cell") != F.col("own")) & ((F.col("l0") != F.col("label")) | (F.col("l1") != F.col("label"))) & (100 * F.col("n") >= percent * F.col("n0")) & (100 * F.col("n1") >= percent * F.col("n"))
    return goers.join(there, (F.col("token") == F.col("_token")) & worth).select("set", "label", "cell")


def links(sets: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """Links (a, b) among sets (set, n, prefix, tokens) that connect them as all their links would."""
    entries = sets.select("set", "n", F.explode("prefix").alias("token"))
    sizes = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    entries = cut(entries.join(sizes, "token"))
    # The shingle of its prefix that most sets hold: so most of a group of copies has few homes.
    homes = entries.groupBy("set").agg(F.max(F.struct("size", "token"))["token"].alias("home")).join(sets.select("set", "n", (F.octet_length("tokens") / 8 + 32).cast("bigint").alias("cost")), "set")
    parts = homes.groupBy("home").agg(F.ceil(F.sum("cost") / cell).cast("int").alias("parts"), *(F.min(F.struct(F.xxhash64("set", F.lit(j)), "set"))["set"].alias(f"p{j}") for j in range(PIVOTS)))
    placed = homes.join(parts.select("home", "parts"), "home").select("set", "home", "parts", F.xxhash64("home", F.pmod(F.xxhash64("set", F.lit(3)), "parts").cast("bigint")).alias("cell"))
    placed = cut(placed)
    body = sets.select("set", "n", "tokens")
    pivots = parts.filter("parts > 1").select("home", "parts", F.explode(F.array_distinct(F.array(*(f"p{j}" for j in range(PIVOTS))))).alias("set"))
    visits = pivots.select("set", "home", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("parts") - 1).cast("bigint"))).alias("part")).select("set", F.xxhash64("home", "part").alias("cell"))
    alone = F.col("set").alias("label")
    crowded = placed.groupBy("cell").count().filter("count > 1").select("cell")
    members = body.join(placed.select("set", "cell").join(crowded.union(visits.select("cell").distinct()).distinct(), "cell"), "set")
    first = cut(meet(members.withColumn("label", alone), body.join(visits, "set").withColumn("label", alone), percent, True))
    label = F.coalesce("component", "set").alias("label")
    labelled = cut(placed.select("set", "cell").join(components(first), F.col("set") == F.col("id"), "left").select("set", "cell", label))
    visits = cut(_visits(cut(entries.select("token", "set", "n").join(labelled, "set")), percent).distinct())
    if not visits.take(1):
        return first
    hosts = labelled.join(visits.select("cell").distinct(), "cell", "left_semi")
    return first.union(meet(hosts.join(body, "set"), visits.join(body, "set"), percent, False))


def ngram_components(documents: DataFrame, width: int = 3, percent: int = 90, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A row's set are the distinct shingles of width words (A-Z in lower case), or all its words
    where there are fewer; rows are linked where 100 * shared >= percent * all shingles of both. A
    component is named by its least doc_id. Null and blank texts have no shingles, are linked with
    nothing and keep their own doc_id, as do rows of a component without any doc_id. Rows that repeat a
    doc_id are judged by their own texts. An empty table gives no rows; other columns play no part.
    """
    rows = cut(signed(documents.select("doc_id", "text"), width))
    judged = rows.filter("n is not null")
    sets = ordered(documents.select("doc_id", "text"), rows, width, percent)
    found = components(links(sets, percent, cell))
    classes = judged.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep")).join(found, F.col("set") == F.col("id"), "left").select("set", "rep", F.coalesce("component", "set").alias("component"))
    classes = cut(classes)
    named = classes.groupBy("component").agg(F.min("rep").alias("least"))
    of_set = classes.join(named, "component").select(F.col("set").alias("_set"), "least")
    joined = judged.select("doc_id", "n", "set").join(of_set, F.col("set") == F.col("_set"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


SQL = """WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS s FROM w, range(1, 1000000) r(i) WHERE i <= greatest(len(w) - 2, least(len(w), 1))),
n AS MATERIALIZED (SELECT rid, doc_id, count(s) AS n FROM w LEFT JOIN s USING (rid) GROUP BY 1, 2),
k AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1), t AS MATERIALIZED (SELECT * FROM s SEMI JOIN k USING (s)),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS m FROM t a JOIN t b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
c(rid, other) AS (SELECT a, b FROM e UNION SELECT c.rid, e.b FROM c JOIN e ON e.a = c.other)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(min(o.doc_id), n.doc_id), n.doc_id) AS component_id FROM n LEFT JOIN c USING (rid) LEFT JOIN n o ON o.rid = c.other GROUP BY n.rid, n.doc_id, n.n"""
