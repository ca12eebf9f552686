"""A Merkle manifest of a table: a digest of every row, a root of all, and for every row the
siblings that lead from its digest to that root.

Rows are numbered within their tree by range partitions and counts of those, so no tree is
ordered in one task. A tree is cut into aligned blocks. Within a block the siblings come
from a fractal traversal: subtrees of few levels are stacked upon each other, those that
exist serve the leaf at hand, and beside each the one desired next grows by a leaf a step.
The roots of the blocks are leaves of the same kind again, until one is left a tree; their
siblings are appended on the way back down.
"""

from __future__ import annotations

from binascii import hexlify, unhexlify
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

#: A block has 2^BITS leaves; stacked subtrees have SPAN levels each.
BITS, SPAN = 12, 3


def node(*children: bytes) -> bytes:
    """The digest (hex text) of a run of digests."""
    return hexlify(sha256(b"".join(children)).digest())


def leaf(*fields: Column) -> Column:
    """The digest (binary) of a row: of each value its length in UTF-8 bytes, a colon and the value; a dash for null."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256))


def _height(size: int, bits: int) -> int:
    """Levels that a block climbs: to the root of a tree that is one block, else to the block's own."""
    return (size - 1).bit_length() if size <= 1 << bits else bits


class Hashing:
    """Digests of a subtree from its leaves in order, with a stack of what waits for a sibling.

    Nodes of the levels from low up to high are kept; the subtree's first leaf is begin.
    """

    def __init__(self, begin: int, low: int, high: int) -> None:
        self.begin, self.low, self.high = begin, low, high
        self.stack: list[tuple[int, bytes]] = []
        self.kept: list[list[bytes]] = [[] for _ in range(low, high + 1)]

    def _put(self, level: int, digest: bytes) -> None:
        if level >= self.low:
            self.kept[level - self.low].append(digest)

    def add(self, digest: bytes) -> None:
        level = 0
        self._put(0, digest)
        while level < self.high and self.stack and self.stack[-1][0] == level:
            digest = node(self.stack.pop()[1], digest)
            level += 1
            self._put(level, digest)
        self.stack.append((level, digest))

    def close(self) -> None:
        """No leaf follows in this block: what waits goes up alone until it meets a sibling or the top."""
        while self.stack and self.stack[-1][0] < self.high:
            level, digest = self.stack.pop()
            if self.stack and self.stack[-1][0] == level:
                digest = node(self.stack.pop()[1], digest)
            else:
                digest = node(digest)
            self._put(level + 1, digest)
            self.stack.append((level + 1, digest))

    def at(self, level: int, index: int) -> bytes:
        return self.kept[level - self.low][index - (self.begin >> level)]


def block_root(digests: list[bytes], height: int) -> bytes:
    tree = Hashing(0, height, height)
    for d in digests:
        tree.add(d)
    tree.close()
    return tree.stack[0][1]


def traverse(digests: list[bytes], height: int, span: int = SPAN) -> Iterator[bytes]:
    """Of each leaf in turn its siblings up to the block's root: for each level L or R (where the
    sibling stands) and its 32 bytes, or a dash where there is none.

    At most two subtrees of each span of levels are held, and a stack for each that grows.
    """
    count = len(digests)
    spans = [(low, min(low + span, height)) for low in range(0, height, span)]

    def grown(begin: int, low: int, high: int, leaves: int) -> Hashing:
        tree = Hashing(begin, low, high)
        for d in digests[begin : begin + leaves]:
            tree.add(d)
        if begin + leaves >= count:
            tree.close()
        return tree

    exist = [grown(0, low, high, 1 << high) for low, high in spans]
    desire = [Hashing(1 << high, low, high) for low, high in spans]
    for q in range(count):
        out = []
        for tree, (low, high) in zip(exist, spans, strict=True):
            for level in range(low, high):
                other = (q >> level) ^ 1
                if other << level >= count:
                    out.append(b"-")
                else:
                    out.append((b"L" if other & 1 == 0 else b"R") + unhexlify(tree.at(level, other)))
        yield b"".join(out)
        for k, (low, high) in enumerate(spans):
            ahead = q + (1 << high)
            if ahead < count:
                desire[k].add(digests[ahead])
                if ahead == count - 1:
                    desire[k].close()
            if (q + 1) & ((1 << high) - 1) == 0:
                exist[k], desire[k] = desire[k], Hashing(q + 1 + (1 << high), low, high)


def siblings(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The steps of a path: its letter and the digest (hex text, empty for a dash)."""
    at = 0
    while at < len(path):
        step = path[at : at + 1]
        own = b"" if step == b"-" else hexlify(path[at + 1 : at + 33])
        at += 1 if step == b"-" else 33
        yield step, own


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest (hex text) and its path lead to."""
    for step, own in siblings(path):
        digest = node(own, digest) if step == b"L" else node(digest, own)
    return digest


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with pos (from 0, by order within tree) and size (rows of the tree).

    Rows are placed once by ranges; the rest are counts, at most one for each range and tree.
    """
    part = F.shiftright("_at", 33)
    placed = kept(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id()))
    runs = placed.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("_tree")
    runs = runs.select("_tree", "_part", (F.sum("_n").over(own.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("size"))
    joined = placed.join(runs, (F.col(tree) == F.col("_tree")) & (part == F.col("_part")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "size")


def _climb(leaves: DataFrame, bits: int) -> list[DataFrame]:
    """Levels of blocks over leaves (tree, pos, size, digest): the roots of all blocks, then those
    of the blocks of these, and so on until a single one is left of each tree."""

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        first = rows.iloc[0]
        size = int(first["size"])
        digest = block_root([hexlify(d) for d in rows["digest"]], _height(size, bits))
        return pd.DataFrame({"tree": [first["tree"]], "pos": [int(first["pos"]) >> bits], "size": [-(-size >> bits)], "digest": [unhexlify(digest)]})

    levels = [leaves]
    while True:
        blocks = levels[-1].select("tree", "pos", "size", "digest").groupBy("tree", F.shiftright("pos", bits).alias("block"))
        levels.append(kept(blocks.applyInPandas(root, "tree string, pos bigint, size bigint, digest binary")))
        if (levels[-1].agg(F.max("size")).first()[0] or 0) <= 1:
            return levels


def _descend(levels: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """levels[0] with the columns of tops (tree, pos, path, ...) of its tree; path begins in the leaf's block."""
    more = [c for c in tops.columns if c not in ("tree", "pos", "path")]
    for nodes in reversed(levels[:-1]):
        fields = [*nodes.schema.fields, *(f for f in tops.schema.fields if f.name in ("path", *more))]

        def appended(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("pos").drop(columns="block")
            above = above.iloc[0]
            height = _height(int(own["size"].iloc[0]), bits)
            paths = [p + above["path"] for p in traverse([hexlify(d) for d in own["digest"]], height)]
            return own.assign(path=paths, **{c: above[c] for c in more})  # noqa: B023

        block = F.shiftright("pos", bits).alias("block")
        tops = (
            nodes.withColumn("block", block).groupBy("tree", "block").cogroup(tops.withColumnRenamed("pos", "block").groupBy("tree", "block"))
            .applyInPandas(appended, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))
        )
        if nodes is not levels[0]:
            tops = kept(tops.select("tree", "pos", "path", *more))
    return tops


def authenticated(leaves: DataFrame, *order: str, bits: int = BITS) -> DataFrame:
    """leaves (tree string, digest binary, and columns to carry) with pos and size in the tree,
    path (as traverse gives it, from the leaf to the root), subroot and root (binary).

    Leaves of a tree stand in the given order, trees by their names bytewise. Rows that tie in
    all of these are the same leaf, and take their places in any order. No leaves, no rows.
    """
    carried = leaves.withColumn("_tie", F.monotonically_increasing_id())
    levels = _climb(numbered(kept(carried), "tree", *order, "digest", "_tie").drop("_tie"), bits)
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    above = _climb(numbered(subroots, "tree", "name"), bits)
    root = above[-1].select("tree", "pos", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    tops = _descend(above, root, bits).select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    return _descend(levels, kept(tops), bits)


def manifest(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, tree, digest, tampered, pos, size, path, subroot, root of every row of documents.

    digest is of doc_id, source, lang, n_chars and text, tampered the same with n_chars grown by
    one where crc32 of doc_id is divisible by seven (null elsewhere, and where doc_id or n_chars is
    null). A tree is a lang, the one without lang first; rows without doc_id come first
    in their tree. Empty texts are values like others; other columns play no part.
    """
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang"))
    fields = lambda chars: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), chars, F.col("text"))
    bent = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = documents.select("doc_id", tree.alias("tree"), fields(F.col("n_chars")).alias("digest"), F.when(bent, fields(more)).alias("tampered"))
    return authenticated(rows, "doc_id", bits=bits)


def digests(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; see manifest.

    folded_root is what the tampered digest, or else the digest, and the path lead to.
    """
    made = manifest(documents, bits)
    kind = made.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            leaves, bent, subroots, roots = ([d and hexlify(d) for d in batch.column(c).to_pylist()] for c in ("digest", "tampered", "subroot", "root"))
            proofs = [hexlify(sha256(b"".join(own for _, own in siblings(p))).digest()) for p in paths]
            folded = [fold(b or d, p) for d, b, p in zip(leaves, bent, paths, strict=True)]
            texts = [pa.array([x.decode() for x in c], pa.string()) for c in (leaves, subroots, roots, proofs, folded)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *texts, pa.array([f == r for f, r in zip(folded, roots, strict=True)], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return made.select("doc_id", "digest", "tampered", "path", "subroot", "root").mapInArrow(
        run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


#: Unsigned crc32 of the decimal text d, a bit at a time.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, x % 2 * 3988292384 + y))), 4294967295)"""
_LEVELS = "SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 2, n"
_STEPS = "SELECT {1} AS id, {2} + r.j AS k, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < {0}.pos >> r.j THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step FROM {0}, range(40) r(j)"
SQL = f"""WITH RECURSIVE f AS (SELECT row_number() OVER () AS rid, *, lang IS NOT NULL AS named, doc_id::VARCHAR AS d FROM documents),
p AS (SELECT *, {_CRC} % 7 = 0 AND n_chars IS NOT NULL AS bent FROM f),
w AS (SELECT *, {" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang"))} AS a,
  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS b, strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1)::VARCHAR AS b2, coalesce(strlen(text) || ':' || text, '-') AS c FROM p),
l AS (SELECT rid, doc_id, named, lang, sha256(a || b || c) AS leaf, CASE WHEN bent THEN sha256(a || b2 || c) END AS tampered FROM w),
k AS (SELECT *, dense_rank() OVER (ORDER BY named, lang) - 1 AS tree, row_number() OVER (PARTITION BY named, lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY named, lang) AS n FROM l),
t(tree, level, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM k UNION ALL {_LEVELS.format("t")}),
e AS (SELECT tree AS pos, h, count(*) OVER () AS n, level AS high FROM t WHERE n = 1),
u(tree, level, pos, n, h) AS (SELECT 0, 0, pos, n, h FROM e UNION ALL {_LEVELS.format("u")}),
s AS ({_STEPS.format("k", "k.rid", "0")} LEFT JOIN t s ON s.tree = k.tree AND s.level = r.j AND s.pos = xor(k.pos >> r.j, 1) JOIN e ON e.pos = k.tree AND r.j < e.high
  UNION ALL {_STEPS.format("e", "k.rid", "100")} LEFT JOIN u s ON s.level = r.j AND s.pos = xor(e.pos >> r.j, 1) JOIN k ON k.tree = e.pos JOIN u top ON top.n = 1 AND r.j < top.level),
g AS (SELECT id, list(step ORDER BY s.k) AS steps FROM s GROUP BY id),
o AS (SELECT k.doc_id, k.leaf, e.h AS subroot, top.h AS root, sha256(coalesce(list_aggregate(list_transform(steps, lambda x: x[2:]), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(steps, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM k JOIN e ON e.pos = k.tree JOIN u top ON top.n = 1 LEFT JOIN g ON g.id = k.rid)
SELECT *, folded_root = root AS verified FROM o"""
