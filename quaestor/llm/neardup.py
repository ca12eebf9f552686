"""Near duplicates: a chosen-path set similarity join over minwise tokens.

Documents with equal shingle sets form a class, and one of each goes on. A tree starts
from one or two minwise tokens; documents with the same token share a node. A node with
few documents compares them all; a larger one branches on further tokens that its path
chooses, unless most of it resembles one document: then that document stands for the
node, and the rest branches on. Several independent trees make up for pairs that a
tree parts. All this yields candidates by estimates; the links that count are confirmed
on full sets, in cells of bounded size. In a large group all are first held against one of
them, and only those that do not resemble it against all others.
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

TOKENS = 128  # minwise tokens of a document
TREES = 12
LEAF = 32  # documents compared exhaustively in a node
DEPTH = 24
#: Documents of a node that a task branches by itself. A larger node is dealt by further tokens of
#: its documents, SPREAD of them a level; what is as large after LEVELS levels is alike throughout, and
#: is taken as a candidate group whole, which loses no pair.
NODE, SPREAD, LEVELS = 20_000, 4, 3
#: Documents of a cell; larger candidate groups are dealt into several.
CELL = 2000
#: A pair of similarity 0.8 is estimated below STRONG with a chance under 1e-12 (128 tokens). What is
#: estimated NEARLY or more to a third document leaves the node with it; whatever is 0.8 to that has 0.5 and
#: more with the third, and is estimated below WEAK with a chance of a few in ten thousand.
STRONG, NEARLY, WEAK = 0.5, 0.75, 0.35
FILTER_BITS = 24

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, TOKENS, dtype="u8") * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, TOKENS, dtype="u8")
_PLACES = _rng.integers(1, 1 << 63, 16, dtype="u8") * np.uint64(2) + np.uint64(1)
#: The tokens at which each tree starts: one, or for every fourth tree two (1 / 0.8 on average).
_ROOTS = _rng.permutation(TOKENS)[: TREES + TREES // 4]


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, "u8")
    for k in range(min(width, len(words))):
        out = (out ^ (out >> np.uint64(29))) * _PLACES[k] + h[k : k + n]
    out ^= out >> np.uint64(32)
    return np.unique(out * _PLACES[-1])


def minwise(sets: np.ndarray) -> np.ndarray:
    best = np.full(TOKENS, np.iinfo("u8").max, "u8")
    for at in range(0, len(sets), 2048):
        mixed = sets[at : at + 2048, None] * _FACTORS + _ADDENDS
        best = np.minimum(best, (mixed ^ (mixed >> np.uint64(32))).min(0))
    return best


def signed(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n, key (of the set), sig (tokens' low 16 bits), roots (whole tokens) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, keys, sigs, roots = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = shingles(text, width)
                    n.append(len(own))
                    tokens = minwise(own) if len(own) else None
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    sigs.append((tokens & np.uint64(0xFFFF)).astype("<u2").tobytes() if len(own) else None)
                    roots.append(tokens[_ROOTS].view("i8") if len(own) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(roots, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sig", "roots"])

    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, key binary, sig binary, roots array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """Rows of a sorted stream by their first column, a group at a time: the other columns as lists."""
    key, held = None, [[] for _ in range(columns)]
    for batch in batches:
        keys = batch.column(0).to_pylist()
        rest = [c.to_pylist() for c in batch.columns[1:]]
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                if held[0]:
                    yield held
                key, held = keys[at], [[] for _ in range(columns)]
            for own, more in zip(held, rest, strict=True):
                own += more[at:end]
            at = end
    if held[0]:
        yield held


def branch(ids: np.ndarray, n: np.ndarray, sig: np.ndarray, seed: int) -> list[tuple[int, int]]:
    """Candidate pairs of a node that connect what resembles each other, fewer than it has documents."""
    edges: list[tuple[int, int]] = []
    part_of = np.arange(len(ids))

    def connect(one: int, others: np.ndarray) -> None:
        for other in others[part_of[others] != part_of[one]]:
            if part_of[other] != part_of[one]:
                edges.append((int(ids[one]), int(ids[other])))
                part_of[part_of == part_of[other]] = part_of[one]

    stack = [(np.arange(len(ids)), 1, seed)]
    while stack:
        some, depth, path = stack.pop()
        if len(some) < 2:
            continue
        if len(some) <= LEAF:
            own, size = sig[some], n[some]
            alike = (own[:, None] == own[None]).mean(2) >= STRONG
            alike &= np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * 80
            many = alike.sum(1)
            for i in np.argsort(-many, kind="stable")[: np.count_nonzero(many > 1)]:
                connect(some[i], some[alike[i]])
            continue
        luck = np.random.default_rng(path & 0x7FFFFFFF)
        trial = luck.choice(some, 16, replace=False)
        pivot = trial[(sig[trial][:, None] == sig[luck.choice(some, 32, replace=False)][None]).mean((1, 2)).argmax()]
        like = (sig[some] == sig[pivot]).mean(1)
        if (like >= NEARLY).mean() >= 0.5 or depth >= DEPTH:
            near = some[(like >= WEAK) | (depth >= DEPTH)]
            connect(pivot, near)
            if depth < DEPTH:
                stack.append((some[like < NEARLY], depth, path + 1))
            continue
        for token in luck.choice(TOKENS, 2 if luck.random() < 0.25 else 1, replace=False):
            order = some[np.argsort(sig[some, token], kind="stable")]
            cuts = np.flatnonzero(np.diff(sig[order, token].astype("i4"))) + 1
            for k, part in enumerate(np.split(order, cuts)):
                stack.append((part, depth + 1, path * 31 + int(token) * 7 + k + 1))
    return edges


def candidates(classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) among classes (rep, n, sig, roots)."""
    def counted(rooted: DataFrame) -> DataFrame:
        sizes = rooted.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("least")).filter("size > 1")
        return cut(rooted.join(sizes, "node"))

    shared = counted(classes.select("rep", F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "rep"))
    fits = shared.filter(F.col("size") <= NODE)
    large = shared.filter(F.col("size") > NODE)
    for level in range(LEVELS):
        if not large.take(1):
            break
        # The node chooses which tokens; they are the same for all of its documents.
        place = F.pmod(F.xxhash64("node", F.lit(level), F.col("j")), F.lit(len(_ROOTS))).cast("int")
        deeper = large.select("node", "rep", F.explode(F.array(*map(F.lit, range(SPREAD)))).alias("j")).withColumn("place", place).join(classes.select("rep", "roots"), "rep")
        dealt = counted(deeper.select(F.xxhash64("node", "place", F.get("roots", F.col("place"))).alias("node"), "rep").distinct())
        fits, large = fits.unionByName(dealt.filter(F.col("size") <= NODE)), dealt.filter(F.col("size") > NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, ids, n, sig in _groups(batches, 4):
            found = branch(np.array(ids), np.array(n), np.frombuffer(b"".join(sig), "<u2").reshape(len(sig), TOKENS), nodes[0])
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    small = fits.join(classes.select("rep", "n", "sig"), "rep")
    small = small.select("node", F.col("node").alias("seed"), "rep", "n", "sig").repartition("node").sortWithinPartitions("node", "rep")
    pairs = small.mapInArrow(run, "a bigint, b bigint")
    whole = large.filter(F.col("rep") != F.col("least")).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    return pairs.union(whole).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Sets:
    """The shingle sets of a cell's documents, to be held against one of them at a time."""

    def __init__(self, sets: list[bytes]) -> None:
        self.size = np.array([len(s) // 8 for s in sets])
        self.local = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)[1]
        self.starts = np.cumsum(self.size) - self.size
        self.mark = np.zeros(int(self.local.max(initial=-1)) + 1, "i4")

    def near(self, x: int) -> np.ndarray:
        """Which of them have a similarity of 0.8 or more with the x-th."""
        own = self.local[self.starts[x] : self.starts[x] + self.size[x]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.local], self.starts)
        self.mark[own] = 0
        return np.flatnonzero(100 * both >= 80 * (self.size + self.size[x] - both))


def linked(ids: list[int], sets: list[bytes]) -> list[tuple[int, int]]:
    """Links (at least 0.8 on full sets) that connect a cell's documents as all its links would.

    One document at a time is held against all others. Those of the largest component
    need no turn: a link to another component has its other end there.
    """
    own = Sets(sets)
    label = np.arange(len(ids))
    done = np.zeros(len(ids), bool)
    links = []
    while True:
        count = np.bincount(label, minlength=len(ids))
        open_ = np.flatnonzero(~done & (label != count.argmax())) if done.any() else np.flatnonzero(~done)
        if not len(open_):
            return links
        x = open_[0] if done.any() else int(own.size.argsort(kind="stable")[len(own.size) // 2])
        done[x] = True
        near = own.near(x)
        for other in np.unique(label[near]):
            if other != label[x]:
                y = near[label[near] == other][0]
                links.append((ids[x], ids[y]))
                label[label == other] = label[x]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(documents: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Links (a, b) confirmed on full sets among the candidate groups that pairs connect.

    A group of a cell's size is compared within one task. In a larger one, dealt into cells,
    everything is held against its pivot, the document in most pairs; what does not link with
    it is held against every document of the group. So each link of the group either joins two
    that are linked with the pivot, or is found; what moves grows with the group and with the
    rest of it, not with its square.
    """
    pairs = cut(pairs)  # they cost the trees, and are asked for again where groups are large
    group = cut(components(pairs))
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = cut(group.join(sizes, "component").select("id", "component", F.ceil(F.col("size") / CELL).cast("int").alias("blocks")))
    # A filter of fixed size keeps most other documents from being cut into shingles again.
    slot = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << FILTER_BITS))
    known = documents.sparkSession.sparkContext.broadcast(bit_filter(group.select(slot.alias("s")), "s", FILTER_BITS))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pa.array(is_set(known.value, batch.column(2).to_numpy()))).select([0, 1])
            for at in range(0, wanted.num_rows, 256):
                part = wanted.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, width).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "set"])

    rows = documents.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << FILTER_BITS)).alias("s"))
    sets = rows.mapInArrow(cut_up, f"doc_id {kind}, set binary")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in _groups(batches, 2):
            yield _pairs(linked(ids, own))

    small = sets.join(sized.filter("blocks = 1").select("id", F.xxhash64("component").alias("cell")), F.col("doc_id") == F.col("id")).select("cell", "id", "set")
    links = small.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(within, "a bigint, b bigint")
    large = sized.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int"))
    if not large.take(1):
        return links
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    pivots = cut(large.join(degree, "id").groupBy("component").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot")))
    gathered = kept(sets.join(large, F.col("doc_id") == F.col("id")).select("id", "component", "blocks", "block", "set"))
    cell = lambda *c: F.xxhash64("component", *c).alias("cell")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    guests = gathered.join(pivots.select(F.col("pivot").alias("id")), "id").select("id", "component", every, "set", F.lit(True).alias("guest"))
    members = gathered.select("id", "component", "block", "set", F.lit(False).alias("guest"))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Guests of a cell against its members."""
        for ids, own, guest in _groups(batches, 3):
            held, found = Sets(own), []
            for x in np.flatnonzero(guest):
                found += [(ids[x], ids[y]) for y in held.near(x) if not guest[y] and ids[y] != ids[x]]
            yield _pairs(found)

    def meet(visitors: DataFrame, residents: DataFrame, *by: str) -> DataFrame:
        rows = visitors.select(cell(*by), "id", "set", "guest").unionByName(residents.select(cell(*by), "id", "set", "guest"))
        return rows.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(against, "a bigint, b bigint")

    around = cut(meet(guests, members, "block"))
    rest = gathered.join(around.select(F.col("b").alias("id")).union(pivots.select("pivot")).distinct(), "id", "left_anti")
    rest = cut(rest.join(rest.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("teams")), "component"))
    teams = rest.select("component", "teams").distinct()
    team = F.pmod(F.xxhash64("id", F.lit(13)), F.col("teams")).cast("int").alias("team")
    guests = rest.select("id", "component", team, every, "set", F.lit(True).alias("guest"))
    members = gathered.join(teams, "component").select("id", "component", F.explode(F.sequence(F.lit(0), F.col("teams") - 1)).alias("team"), "block", "set", F.lit(False).alias("guest"))
    return links.union(around).union(meet(guests, members, "team", "block"))


def near_duplicates(documents: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Texts are linked if their sets of word shingles (A-Z in lower case) have a Jaccard
    similarity of 0.8 or more; a component is named by its least doc_id, which alone is
    kept. Null and blank texts, and rows without doc_id, are linked with nothing and kept.
    Rows with the same doc_id count as one document in all its versions. An empty table gives
    no rows. Candidates come from trees, so a link may be missed; see recall in the tests.
    """
    rows = cut(signed(documents.select("doc_id", "text"), width))
    classes = cut(rows.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("roots").alias("roots")))
    links = confirmed(documents.select("doc_id", "text"), candidates(classes), width)
    found = components(links)
    of_class = classes.select("key", "rep").join(found, F.col("rep") == F.col("id"), "left").select(F.col("key").alias("_key"), F.coalesce("component", "rep").alias("_component"))
    joined = rows.select("doc_id", "n", "key").join(of_class, F.col("key") == F.col("_key"), "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_component")), F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, width: int = 5) -> DataFrame:
    """The documents of which near_duplicates keeps the doc_id, columns as they were.

    Of rows that repeat a doc_id one stays, the least by the other columns, so one document of
    a group is left. An empty table gives no rows.
    """
    judged = near_duplicates(documents, width)
    gone = judged.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    again = documents.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count().filter("count > 1").select("_again")
    left = documents.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    # Few ids repeat; only their rows are moved.
    repeated = left.join(again, F.col("doc_id") == F.col("_again"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*documents.columns)).alias("_row")).select("_row.*")
    return left.join(again, F.col("doc_id") == F.col("_again"), "left_anti").unionByName(repeated)
