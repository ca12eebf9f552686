"""The n-gram join, centroid clusters and the manifest against brute force and their SQL."""

import random

import numpy as np
import pytest

from quaestor.llm import centroids, merkle, ngramjoin
from quaestor.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute
from tests.oracle import compare, connect


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_ngram_join", "op13_merkle_manifest"])
def test_equals_sql(name, spark, data):
    assert compare(connect(data), QUERIES[name](spark, data), ORACLE_SQL[name]) == ""


def edited_copies(seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(None, "a b c d e"), (None, "x"), (1, None), (2, " "), (3, "a b"), (4, "A b"), (5, "a b c d e"), (5, "q r s"), (5, "q r s"), (6, "a b c")]
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([11, 12, 40, 120, 300]))]
        for _ in range(rnd.choice([3, 10, 60])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rnd.randrange(len(words))
                words[at : at + rnd.choice([0, 1])] = [rnd.choice(vocabulary)] * rnd.choice([0, 1])
            rows.append((100 + len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("cell", [ngramjoin.CELL, 300])
def test_join_of_edited_copies(cell, spark):
    """Clusters of copies with edits; homes of one cell, and homes dealt into many that only visits connect."""
    rows = edited_copies()
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, n int, tokens string").repartition(5)
    assert rows_of(ngramjoin.ngram_components(docs, cell=cell)) == sorted(brute.joined(rows), key=repr)


def test_join_at_the_threshold(spark):
    """Nine of ten shingles shared is enough, and 17 of 19 is not."""
    words = [f"v{i}" for i in range(22)]
    rows = [(1, " ".join(words[:11])), (2, " ".join(words[:12])), (3, " ".join(words[:19])), (4, " ".join([*words[:19], "z", "y"]))]
    assert rows_of(ngramjoin.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 9, 1), (2, 10, 1), (3, 17, 3), (4, 19, 4)]


def test_frequent_shingles_come_last(spark, monkeypatch):
    """Every shingle that several texts hold counts as frequent; the driver decides that."""
    monkeypatch.setattr(ngramjoin, "MANY", 2)
    rows = [(i, " ".join(f"s{j}" for j in range(30)) + f" u{i % 40}") for i in range(80)] + [(100 + i, f"a{i} b{i} c{i} d{i}") for i in range(9)]
    assert rows_of(ngramjoin.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute.joined(rows), key=repr)


def test_a_trie_gives_what_connects():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 62, 60, dtype="u8")
    sets = [np.unique(np.concatenate([base[rnd.random(60) > rnd.choice([0, 0.03, 0.2])], rnd.integers(0, 1 << 62, int(rnd.integers(0, 4)), dtype="u8")])) for _ in range(120)]
    sizes = np.array([len(s) for s in sets])
    labels = ngramjoin.Labels(np.arange(len(sets)))
    links = list(ngramjoin.Trie(sets, sizes, 90).walk(sets, sizes, labels, np.arange(len(sets))))
    full = np.array([[100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) for b in sets] for a in sets])
    assert all(full[a, b] for a, b in links)
    reach = full
    for _ in range(8):
        reach = reach @ reach
    got = labels(np.arange(len(sets)))
    assert ((got[:, None] == got[None]) == reach).all()
    assert len(links) == len(sets) - len(set(got.tolist()))


VECTORS = [(i, [random.Random(i * 64 + j).choice([-1.0, 0.0, 0.5, 1 / 64, j / 50]) for j in range(64)]) for i in range(60)] + [
    (100, None), (101, [1.0] * 63), (102, [None] + [1.0] * 63), (103, [float("nan")] * 64), (104, [float("inf")] * 64), (None, [0.3] * 64), (5, [0.3] * 64), (5, [0.3] * 64), (105, [0.0] * 64), (106, []),
]


@pytest.mark.parametrize("more", [[], [(200, [1e200] * 64), (201, [-1e308] * 64), (202, [1.7e308] * 64)], [(300 + i, [float([1 << 20, 1 << 30, 1 << 40, 3][i % 4])] * 64) for i in range(20)], "few", "none"])
def test_clusters_of_odd_vectors(more, spark):
    """Unusable, repeated and tied vectors; components beyond exact doubles and distances beyond a long; fewer vectors than centroids."""
    rows = {"few": VECTORS[:5], "none": []}.get(more, None) if isinstance(more, str) else VECTORS + more
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    assert rows_of(centroids.clusters(df)) == sorted(brute.clusters(rows), key=repr)


def test_annulus_leaves_centroids_out_and_keeps_ties():
    rnd = np.random.default_rng(1)
    rows = [[int(x) for x in c] for c in rnd.integers(-9, 9, (40, 3)) * np.linspace(1, 30, 40).astype(int)[:, None]]
    index = centroids.Annulus(rows)
    vectors = np.floor(rnd.normal(size=(2000, 3)) * rnd.choice([3, 50, 200], (2000, 1)))
    number, best, compared = index.nearest(vectors)
    full = ((vectors[:, None] - np.array(rows, "f8")[None]) ** 2).sum(2)
    assert (full.argmin(1) == number).all() and (full.min(1) == best).all()
    assert compared < 0.5 * full.size


@pytest.mark.parametrize("bits", [merkle.BITS, 2])
def test_manifest_of_odd_rows(bits, spark):
    """Nulls everywhere, repeated rows, the largest number, one row of a language, blocks that end early."""
    rows = [(None, "a", None, None, None), (None, "a", None, None, None), (5, None, "", 2**63 - 1, ""), (5, None, "", 2**63 - 1, ""), (14, "x", "é", 3, "t" * 100)]
    rows += [(i, "s", "en", i, f"x{i}") for i in range(1, 23)] + [(0, "s", "en", None, None)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string").repartition(3)
    want = sorted(brute.manifest(rows), key=repr)
    assert rows_of(merkle.digests(df, bits)) == want
    assert {w[-1] for w in want} == {True, False}
    assert rows_of(merkle.digests(df.filter("doc_id < 0"), bits)) == []


@pytest.mark.parametrize("count", [1, 2, 5, 63, 64, 65, 100])
def test_traversal_gives_every_path(count):
    leaves = [brute.h(str(i)).encode() for i in range(count)]
    height = (count - 1).bit_length()
    root, paths = brute.tree([x.decode() for x in leaves])
    for span in (1, 3):
        made = list(merkle.traverse(leaves, height, span))
        assert [[(s.decode(), o.decode()) for s, o in merkle.siblings(p)] for p in made] == paths
        assert {merkle.fold(x, p).decode() for x, p in zip(leaves, made, strict=True)} == {root}
    assert merkle.block_root(leaves, height).decode() == root
