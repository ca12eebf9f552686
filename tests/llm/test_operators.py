"""The training-data operators against brute force, public libraries and held-out rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from quaestor.llm import ann, bpe, graph, language, lm, mixing, neardup, passages, pii, quality, tokens
from quaestor.llm.prefix import PrefixTable
from tests.llm import brute

PASSAGE = "the quick brown fox jumps over the lazy dog while seventeen owls look on in silence "
LINE = " ".join(f"word{i}" for i in range(60))
#: Null, empty, blank, tiny, repeated, near, periodic, long and odd texts.
TEXTS = {
    1: None, 2: "", 3: " \n\t ", 4: "a b", 5: "A  b", 6: LINE, 7: LINE, 8: LINE + " more", 9: LINE.replace("word30", "other"),
    10: PASSAGE * 2 + "end", 11: "start " + PASSAGE + "x", 12: "x" * 400, 13: "y" + "x" * 300, 14: "é" * 60 + "ü " + PASSAGE,
    15: "x\nx\n\nx\n a b c a b c", 16: "a@b.com@c.de _x@y.z 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 +1 (743) 555-3824 4111 1111 1111 1111",
    17: "9" * 3000, 18: "+" + "1 " * 200 + "call phone (743) 555-3824 or mail bob (at) example (dot) com", 19: "  two  spaces\n\n here▁ <s> <|endoftext|> 's",
    20: " ".join(f"w{i % 700}" for i in range(30_000)),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, ["en", None, "de"][d % 3], [None, "a.de", "b", "ä"][d % 4], 7, "clash", "clash") for d, t in TEXTS.items()]
    # Columns beyond those of documents, with names the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, tokens string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aeth  \n\t'sé한😀▁.,%-01x ") for _ in range(rnd.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    codec = bpe.BytePairCodec(bpe.VOCABULARY, public_tokenizers.PATTERN)
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def test_prefix_table_grows_and_edits():
    table = PrefixTable({"ab": 0, "bc": 1, "abc": 2, "a": 9, "b": 9, "c": 9})
    last = table.extend([], "abx")
    assert table.extend(list(last), "abxabc") == table.extend([], "abxabc")
    assert table.edit(last, "abx", "abc") == table.extend([], "abc")
    assert [table.text[n] if n >= 0 else "?" for n in table.tokens(table.extend([], "abcxbc"))] == ["abc", "?", "bc"]


def test_bpe_equals_library(docs, library):
    codec, encoding = library
    rows = by_id(bpe.digests(docs))
    for d, t in TEXTS.items():
        ids = encoding.encode_ordinary(t or "")
        assert (rows[d].n_tokens, rows[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert rows[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    for t in random_texts(500):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == encoding.encode_ordinary(t)
    kept = bpe.encode(docs).filter("doc_id = 1").first()
    assert kept.tokens is None and kept.spans == "clash"


def test_bpe_document_edits(library):
    codec, encoding = library
    rnd = random.Random(5)
    for t in random_texts(150):
        document = bpe.Document(codec, t)
        for _ in range(3):
            a = rnd.randrange(len(document.text) + 1)
            document.replace(a, min(len(document.text), a + rnd.randrange(4)), rnd.choice(["x", " the", "\n", "", "'s"]))
            assert document.ids() == encoding.encode_ordinary(document.text)
        document.append(" end of it")
        assert document.ids() == encoding.encode_ordinary(document.text)


def test_token_counts_equal_library(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.VOCABULARY)
    rows = by_id(tokens.token_counts(docs, limit=100))
    for d, t in TEXTS.items():
        n = len(model.encode(t or ""))
        assert (rows[d].n_tokens, rows[d].over_limit, rows[d].n_bytes) == (n, n > 100, len((t or "").encode()))
    counter = tokens.PrefixCounter(tokens.VOCABULARY)
    for t in random_texts(120):
        assert counter.prefix_counts(t) == [len(model.encode(t[:i])) for i in range(len(t) + 1)]
    cut = by_id(tokens.truncate_to_budget(docs.select("doc_id", "text"), 10))
    assert cut[1].cut is None and cut[6].cut == max(i for i in range(len(LINE)) if len(model.encode(LINE[:i])) <= 10)


def test_mixing(docs, spark):
    rows = [r[:] for r in mixing.taken(docs).collect()]
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    assert sorted(rows) == sorted(con.sql(mixing.SQL).fetchall())
    assert sorted(rows) == sorted(r[:] for r in mixing.taken(docs.repartition(5)).collect())
    assert all(r[4] <= 3 * r[1] for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() >= sum(r[4] // r[1] for r in rows if r[1])


def test_water_filling_clamps(spark):
    sources = spark.createDataFrame([("a", 10, 5), ("b", 1000, 2), ("c", 500, 1), (None, 0, 5)], "source string, source_size long, weight long")
    target = {r.source: r.target for r in mixing.water_fill(sources, 1510, 3).collect()}
    assert target["a"] == 30 and target[None] == 0
    assert target["b"] == pytest.approx(2 * target["c"]) and sum(target.values()) == pytest.approx(1510)


def test_quality_measures(docs):
    rows = by_id(quality.quality(docs))
    for d, t in TEXTS.items():
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rows[6].kept


def test_cascade_order_does_not_change_verdict(docs):
    tests = quality.rules()
    rows = quality.measured(docs)
    names = list(tests)
    a, b = (rows.select("doc_id", quality.cascade(o, tests).isNull().alias("kept")) for o in (names, names[::-1]))
    assert sorted(a.collect()) == sorted(b.collect())
    sample = rows.cache()
    assert set(quality.ordered(sample, tests)) == set(names)


def test_pii_base_and_added(docs):
    rows = by_id(pii.digests(docs))
    for d, t in TEXTS.items():
        base = brute.base_spans(t)
        assert rows[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(rows[d].spans.split(",")) | {""}
        assert [rows[d][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k + ":") for x in base) for k in pii.KINDS]
    clean = by_id(pii.redact(docs))
    assert clean[1].text is None and clean[6].text == LINE and clean[6].spans == "clash"
    assert "<email>" in clean[16].text and "555-3824" not in clean[16].text


def test_overlapping_personal_data_goes_whole(spark):
    texts = ["1.2.3.4.john@x.com", "4111111111111111@x.com", "+14155552671@x.com", "to 1.2.3.4.john@x.com and 5.6.7.8, or a@b.de"]
    clean = pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["<email>"] * 3 + ["to <email> and <ip>, or <email>"]


def test_near_duplicates(docs):
    for width in (4, 5):
        rows, want = by_id(neardup.near_duplicates(docs, width)), brute.near(TEXTS, width)
        assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in rows.items()} == {d: (n, c, c == d) for d, (n, c) in want.items()}
    left = neardup.deduplicate(docs.union(docs.filter("doc_id = 6")), 4)
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, (_, c) in brute.near(TEXTS, 4).items() if c == d)
    assert left.columns == docs.columns


def test_near_duplicates_in_large_and_split_groups(spark, monkeypatch):
    """A group larger than a node and a cell, so that branching, stars and blocks are used."""
    rnd = random.Random(1)
    start = [f"t{i}" for i in range(120)]
    texts = {}
    for d in range(150):
        own = list(start if d % 3 else [f"u{i}" for i in range(120)])
        for _ in range(rnd.randrange(5)):
            own[rnd.randrange(len(own))] = f"z{rnd.randrange(10**6)}"
        texts[d] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {d: c for d, (_, c) in brute.near(texts, 4).items()}
    for name, small in (("CELL", 20), ("NODE", 40), ("LEAF", 4)):
        monkeypatch.setattr(neardup, name, small)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in graph.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_tasks_of_components_follow_their_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = graph.components(edges)
        assert found.rdd.getNumPartitions() <= 2 * graph.LEAST
        assert {r.id: r.component for r in found.collect()} == dict.fromkeys(range(10), 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_candidate_pairs_are_worked_out_once(spark, monkeypatch):
    texts = [(d, " ".join(f"w{i}" for i in range(100)) + f" own{d}") for d in range(12)]
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda b: seen.add(1) or b, "long")
    pairs = spark.range(1, 12).select(F.lit(0).cast("long").alias("a"), told("id").alias("b"))
    monkeypatch.setattr(neardup, "CELL", 4)  # a large group asks for pairs again, for its pivot
    links = neardup.confirmed(spark.createDataFrame(texts, "doc_id long, text string"), pairs, 4)
    assert {r.id: r.component for r in graph.components(links).collect()} == dict.fromkeys(range(12), 0)
    assert seen.value == 11


def test_passages(docs, monkeypatch):
    want = brute.passages(TEXTS)
    check = lambda: {r.doc_id: tuple(r[1:]) for r in passages.digests(docs).collect()}
    assert check() == want
    monkeypatch.setattr(passages, "HOT", 3)
    assert check() == want
    monkeypatch.setattr(passages, "FILTER_KEYS", 0)
    assert check() == want


def test_more_shared_keys_than_the_least_filter_holds_need_no_join(spark, monkeypatch):
    """Segments that are alone stay where they are, however many keys are shared; the filter grows with these."""
    monkeypatch.setattr(passages, "FILTER_BITS", 15)
    words = [f"{i * 7919 % 100003} {i} and" for i in range(8000)]
    rows = passages._rows(spark.createDataFrame([(1, " ".join(words)), (2, "x" + " ".join(words[:4000])), (3, " ".join(f"{w}ly" for w in words))], "doc_id long, text string"))
    made, whole = [], passages.bit_filter
    monkeypatch.setattr(passages, "bit_filter", lambda df, slot, bits: made.append(bits) or whole(df, slot, bits))
    plan = passages.removable(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and made[-1] > 15 and passages.FILTER_KEYS > 1 << 28


def test_whole_copies(spark, monkeypatch):
    """Copies of a smaller doc_id go, whether or not their slot tells; the same doc_id and null ones stay."""
    rows = [(5, PASSAGE), (5, PASSAGE), (9, PASSAGE), (None, PASSAGE), (7, "short"), (8, "short"), (11, PASSAGE + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(PASSAGE)
    want = sorted([(5, n, 0, 0), (5, n, 0, 0), (9, n, n, 1), (-1, n, 0, 0), (7, 5, 0, 0), (8, 5, 0, 0), (11, n + 4, n, 1)])
    check = lambda: sorted((-1 if r.doc_id is None else r.doc_id, *r[1:4]) for r in passages.digests(docs).collect())
    assert check() == want
    monkeypatch.setattr(passages, "whole_copies", lambda rows: np.zeros(1 << (passages.ROW_BITS - 3), "u1"))
    assert check() == want


def test_lm(docs, spark, data):
    want, total = brute.unigrams(TEXTS)
    rows = by_id(lm.scored(docs))
    for d, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known) == want[d][:3] and r.train_tokens == total
        assert r.base_score == pytest.approx(want[d][3]) and r.score < 0
    real = lm.scored(spark.read.parquet(f"{data}/../sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert real[0] > real[1]


def test_lm_with_few_frequent_words(docs, monkeypatch):
    before = by_id(lm.scored(docs))
    monkeypatch.setattr(lm, "FREQUENT", 5)
    after = by_id(lm.scored(docs))
    assert all(after[d].score == pytest.approx(before[d].score) and after[d].n_known == before[d].n_known for d in before)


def table_of_zeros():
    return np.zeros((2, 1 << lm.LEAST_BITS), "f4")


def test_mixed_bits_are_a_distribution():
    """Whole bytes behind an empty context: their probabilities sum to one."""
    words = [b"", *(bytes([b]) for b in range(256) if b != 0x20)]
    first = lm.Mixer().log10(words, np.zeros(len(words), "i8"), lm.Predictors(table_of_zeros()))
    assert (10 ** first[1:]).sum() < 1 and np.isfinite(first).all()


def test_every_byte_of_a_long_word_is_coded(monkeypatch):
    """Words of one length and one start differ by what follows; a repetition is cheap; blocks change nothing."""
    rnd = random.Random(2)
    noise = bytes(rnd.randrange(33, 127) for _ in range(500))
    words = [b"ab" * 32 + b"ab" * 250, b"ab" * 32 + noise, b"", b"x", noise + b"\xe4\xb8\xad" * 90]
    states = np.array([3, 3, 0, 5, 7])
    table = table_of_zeros()
    for bits in lm.blocks([b"ab" * n for n in range(1, 400, 7)], np.full(60, 3), lm.LEAST_BITS):
        for k in range(lm.ORDERS):
            np.add.at(table, (bits.bit, bits.slot[k]), 1)
    told = lm.Predictors(table)
    whole = lm.Mixer().log10(words, states, told)
    assert whole[0] > whole[1] + 300
    assert whole[1] == pytest.approx(lm.Mixer().log10(words[1:2], states[1:2], told)[0])
    for block in (64, 1):
        monkeypatch.setattr(lm, "BLOCK", block)
        assert lm.Mixer().log10(words, states, told) == pytest.approx(whole)


def test_slots_are_told_once_for_all_bits_that_ask():
    """Logs of a slot's counts are worked out once, and say the same as those of the counts."""
    counts = np.random.default_rng(4).integers(0, 9, (2, 1 << lm.LEAST_BITS)).astype("f4")
    told = lm.Predictors(counts)
    bits = next(lm.blocks([b"abc", b"de"], np.array([3, 4]), lm.LEAST_BITS))
    x, _ = told.inputs(bits)
    assert told.plain() is told.plain()
    for k in range(lm.ORDERS):
        n0, n1 = counts[:, bits.slot[k]]
        assert x[k] == pytest.approx(np.log((n1 + 0.02) / (n0 + 0.02)), abs=1e-5)


def test_every_byte_of_a_long_word_is_in_its_hash():
    texts = [b"  " + b"x" * 200, b"x" * 199 + b"y", b"", b" ", b"x" * 200 + b"  z", b"x" * 30]
    own = lm.Words(texts, np.zeros((1, lm.PAIRS)), np.zeros(1))
    words = [own.flat[s : s + n].tobytes() for s, n in zip(own.start, own.size, strict=True)]
    assert [bytes(w) for t in texts for w in (*t.split(), b"")] == words
    said = {}
    for w, state, h in zip(words, own.state.tolist(), own.hash.tolist(), strict=True):
        assert said.setdefault((w, state), h) == h
    assert len(set(said.values())) == len(said)


def test_weights_are_learnt_on_all_words(spark, monkeypatch):
    """Every bit of every training pair of state and word, of many more than a draw would hold."""
    words = [f"w{i:x}".encode() for i in range(60_000)]
    units = spark.createDataFrame([(w, 3, 1) for w in words] + [(b"held", 3, 0)], "word binary, state long, c long").repartition(3)
    bits = sum(8 * (len(w) + 1) for w in words)
    for lesson, times in ((7000, 1), (150_000, 3)):  # eight shards; one shard, read three times
        monkeypatch.setattr(lm, "LESSON", lesson)
        met = lm.learnt(units, table_of_zeros(), len(words)).filter(F.col("at") % (2 * lm.ORDERS + 1 + lm.CELLS) == 0)
        assert met.agg(F.sum("met")).first()[0] == times * bits


def test_bits_count_as_often_as_words_occur(spark, monkeypatch):
    """ab five times and ac twice: behind all but their last bit, and in what is learnt."""
    units = spark.createDataFrame([(b"ab", 3, 5), (b"ac", 3, 2), (b"held", 3, 0)], "word binary, state long, c long")
    table = lm.bit_counts(units, 2)
    bits = next(lm.blocks([b"ab"], np.array([3]), lm.LEAST_BITS))
    for k in (4, 5):  # all of the word so far, and the state too
        assert table[:, bits.slot[k][0]].tolist() == [7, 0] and table[:, bits.slot[k][15]].tolist() == [5, 2]
    monkeypatch.setattr(lm, "LESSON", 2)
    met = lm.learnt(units, table_of_zeros(), 2).filter(F.col("at") % (2 * lm.ORDERS + 1 + lm.CELLS) == 0)
    assert met.agg(F.sum("met")).first()[0] == 8 * 3 * (5 + 2)


def test_lm_does_not_hang_on_partitions(spark, data, monkeypatch):
    """The same scores however rows are dealt, with several shards of lessons and with one."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for lesson in (2000, 50_000):
            monkeypatch.setattr(lm, "LESSON", lesson)
            runs = []
            for parts, adaptive in ((2, "true"), (7, "false")):
                spark.conf.set("spark.sql.shuffle.partitions", parts)
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                runs.append(by_id(lm.scored(docs.repartition(parts, F.xxhash64("text", F.lit(parts))))))
            assert runs[0].keys() == runs[1].keys()
            for d, r in runs[0].items():
                assert r.score == pytest.approx(runs[1][d].score, rel=1e-9)
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def walked(text, model):
    """The words of a text with their states, one by one."""
    flat, out, at, before = (text or "").encode().lower(), [], 0, None
    odds = model.prior.copy()
    for m in [*re.finditer(rb"[^ \t-\r]+", flat), None]:
        start = m.start() if m else len(flat)
        while at + 2 <= start:  # pairs of letters read so far
            odds = odds + model.log_pairs[:, lm._pair_kinds(np.frombuffer(flat[at : at + 2], "u1"))[0]]
            at += 1
        ending = 0 if before is None else 1 if before[-1:] in b".!?" else 2 if before[-1:] in b",;:" else 3
        before = m[0] if m else None
        out.append((int(odds.argmax()) * lm.ENDINGS + ending, m[0] if m else b""))
    return out


def test_state_along_a_text(docs):
    """Words, states and counts of all texts, against a walk over each, whatever the chunks."""
    model = lm.components(docs)
    own = [t or "" for t in TEXTS.values()]
    words = lm.Words([t.encode() for t in own], model.log_pairs, model.prior)
    got = list(zip(words.doc.tolist(), words.state.tolist(), words.words(np.arange(len(words.doc))).to_pylist(), strict=True))
    assert got == [(i, s, w) for i, t in enumerate(own) for s, w in walked(t, model)]
    assert len(set(words.hash.tolist())) == len({(s, w) for _, s, w in got})
    want = {}
    for d, t in TEXTS.items():
        for unit in walked(t, model):
            c = want.setdefault(unit, [0, 0])
            c[0] += zlib.crc32(str(d).encode()) % 10 != 0
            c[1] += 1
    assert {(r.state, bytes(r.word)): [r.c, r["all"]] for r in lm.unit_counts(docs, model).collect()} == want


def test_lm_score_is_the_sum_over_a_walk(docs, monkeypatch):
    """Each text's score from the scores of its pairs of state and word; those of one state sum to less than one."""
    model = lm.components(docs)
    known, n, _ = lm.unit_scores(docs, model)
    lp = {(r.state, bytes(r.word)): r.lp for r in known.collect()}
    rows = by_id(lm.scored(docs))
    for d, t in TEXTS.items():
        assert rows[d].score == pytest.approx(sum(lp[u] for u in walked(t, model)))
    for state in {s for s, _ in lp}:
        assert sum(10 ** x for (s, _), x in lp.items() if s == state) < 1 + 1e-9
    monkeypatch.setattr(lm, "CHUNK", 100)
    monkeypatch.setattr(lm, "HELD", 50)
    again = by_id(lm.scored(docs))
    assert all(again[d].score == pytest.approx(rows[d].score) for d in rows)


def test_lm_order_and_repeated_rows(spark):
    """What a text says first changes what is expected later; the same row twice has its score twice."""
    german, english = "der die und nicht straße über schön ", "the and with which there through shall "
    texts = [(g * 40).strip() + "." for g in (german, english)] * 6 + [german + english, english + german]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (0, "other")]
    made = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    score = {}
    for r in made:
        score.setdefault(r.doc_id, []).append(r.score)
    assert len(made) == len(rows) and len(score[0]) == 3 and len({round(x, 6) for x in score[0]}) == 2
    assert score[12][0] != pytest.approx(score[13][0], abs=1e-6)


def test_language(docs, spark, data):
    rows = by_id(language.documents_language(docs))
    assert not rows[1].kept and not rows[17].kept
    documents = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r.doc_id: r.lang for r in documents.collect()}
    held = documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = by_id(language.documents_language(held))
    odd = [d for d in labels if d % 2 and found[d].kept]
    assert sum(found[d].language == labels[d] for d in odd) >= 0.97 * len(odd)
    assert len([d for d in labels if found[d].kept]) >= 0.97 * len(labels)
    assert language.accepted(documents).columns == documents.columns


def test_every_label_is_a_language(spark, monkeypatch):
    """More than 64 labels, rare ones among many rows, and one behind copies of a single text."""
    monkeypatch.setattr(language, "FITTED", 20)
    rnd = random.Random(8)
    words = lambda k: " ".join(chr(0x4E00 + 40 * k + rnd.randrange(40)) for _ in range(30))
    rows = [(words(0), "en") for _ in range(3000)] + [(words(k), f"l{k:02}") for k in range(1, 70) for _ in range(2)] + [(words(70), "zz")] * 500
    docs = spark.createDataFrame([(i, t, lang, None) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    model = language.fit(docs)
    assert model.languages == sorted({lang for _, lang in rows})
    found = by_id(language.documents_language(docs.filter("lang != 'en'").union(docs.filter("lang = 'en'").limit(20))))
    assert sum(r.language == rows[d][1] and r.kept for d, r in found.items()) >= 0.97 * len(found)


def test_neighbours_recall_and_edges(spark, data):
    embeddings = spark.read.parquet(f"{data}/embeddings.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, [0.0] * 64), (10**6 + 2, [float("nan")] * 64), (10**6 + 3, [1.0, None] * 32), (10**6 + 50, [1.0])], "vec_id long, embedding array<float>")
    df = embeddings.select("vec_id", "embedding").unionByName(odd).unionByName(embeddings.select((F.col("vec_id") + 5000).alias("vec_id"), "embedding"))
    rows = ann.neighbours(df).collect()
    assert max(r.vec_id for r in rows) < 10**6
    x = {r.vec_id: np.array(r.embedding, "f8") for r in df.filter("vec_id < 1000000").collect()}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in x.items()}
    hits = total = 0
    for q in (i for i in x if i % 50 == 0):
        like = sorted(((-round(float(unit[q] @ unit[i]), 12), i) for i in x if i != q))[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert own[0][1] == abs(q - 5000) if q >= 5000 else own[0][1] == q + 5000
        hits, total = hits + len({i for _, i in like} & {r[1] for r in own}), total + 5
    assert hits >= 0.9 * total


def test_partition_is_balanced():
    x = ann._unit(np.random.default_rng(1).normal(size=(800, 8)))
    size = np.bincount(ann.partition(x, ann._nearest(x, 10), 8), minlength=8)
    assert size.max() <= 106


def test_empty_tables(empty, spark):
    for made in (bpe.digests(empty), tokens.token_counts(empty), mixing.taken(empty), quality.quality(empty), pii.digests(empty), neardup.near_duplicates(empty), passages.digests(empty), lm.scored(empty), language.documents_language(empty)):
        assert made.count() == 0
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data)
    assert out.columns[:5] == list(corpus_pipeline.COLUMNS)
    codec = bpe.BytePairCodec(bpe.VOCABULARY, public_tokenizers.PATTERN)
    assert all(codec.decode(r.tokens).decode() == r.text for r in out.limit(20).collect())
    stage = docs
    for _, f in corpus_pipeline.STAGES[:4]:
        stage = f(spark, stage, data)
        assert stage.columns == docs.columns


def test_longest_previous_factors():
    """Of suffixes in order against all pairs; periodic texts, zero bytes, equal documents."""
    rnd = random.Random(9)
    for _ in range(40):
        base = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(60, 120))) for _ in range(3)]
        texts = [rnd.choice(base)[rnd.randrange(9) :][: rnd.randrange(50, 99)] + bytes(rnd.choice(b"xy") for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(2, 9))]
        texts = [t for t in texts if len(t) >= passages.LENGTH] or [b"q" * 60]
        docs = np.array([rnd.randrange(4) for _ in texts])
        flat, sizes = np.frombuffer(b"".join(texts), "u1"), np.array(list(map(len, texts)))
        owner, place = np.repeat(np.arange(len(texts)), sizes), np.concatenate([np.arange(n) for n in sizes])
        left = sizes[owner] - place
        levels = passages.suffix_order(flat, left)
        order = np.argsort(levels[-1][1])
        suffix = [texts[owner[i]][place[i] :] for i in order]
        assert suffix == sorted(suffix)
        shared = passages.common_prefixes(order, flat, left, levels)
        length = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert shared.tolist() == [0, *(length(x, y) for x, y in zip(suffix, suffix[1:], strict=False))]
        got = passages.previous_factors(order, docs[owner[order]], shared, 1)
        assert got.tolist() == [max((length(s, t[k:]) for j, t in enumerate(texts) if docs[j] < docs[owner[i]] for k in range(len(t))), default=0) for i, s in zip(order, suffix, strict=True)]


def test_spans_that_the_method_adds(spark):
    texts = {
        1: "please write to bob (at) example (dot) com or ann@b.org, ok",
        2: "call phone (743) 555-3824 now",
        3: "x@y.com (at) z.com",  # what overlaps a base span is not added
        4: "isbn (743) 555-3824",
        **{k: f"please write to u{k} (at) mail (dot) com and call phone (743) 555-{3000 + k}" for k in range(10, 60)},
    }
    rows = by_id(pii.digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    at = lambda d, part, kind: f"{kind}:{texts[d].index(part)}:{texts[d].index(part) + len(part)}"
    assert rows[1].spans.split(",") == [at(1, "bob (at) example (dot) com", "email"), at(1, "ann@b.org", "email")]
    assert rows[2].spans == at(2, "(743) 555-3824", "phone") and rows[2].n_phone == 0
    assert rows[3].spans == at(3, "x@y.com", "email")
    assert rows[4].spans == ""
    assert all(rows[k].spans.count(":") == 4 for k in range(10, 60))


def test_personal_data_in_hostile_texts(spark):
    """Many spans, and shapes that recursion or retries would not survive."""
    texts = ["1." * 8000, "a (at) b" + ".aa" * 20_000, "+1" + " " * 50_000, "é a@b.de " * 4000, "x (at) y.com a@b.co " * 1500, "1 " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, clean = by_id(pii.digests(df)), by_id(pii.redact(df))
    for d, t in enumerate(texts):
        assert [rows[d][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k + ":") for x in brute.base_spans(t)) for k in pii.KINDS]
    assert clean[3].text == "é <email> " * 4000 and clean[0].text.count("<ip>") == 2000
    assert pii.redact(df.filter("doc_id < 0")).count() == 0


def test_running_merges(spark):
    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 10, 99, 100, 101):
        v = [rnd.randrange(50) for _ in range(n)]
        df = spark.createDataFrame([(v,)], "v array<bigint>").selectExpr(f"{pii.running('v', pii.SUM, 0)} s", f"{pii.running('v', pii.MOST, -1)} m", f"{pii.running('v', pii.LEAST, 99)} l")
        r = df.first()
        assert (r.s, r.m, r.l) == tuple([f(v[: i + 1]) for i in range(n)] for f in (sum, max, min))


def test_near_duplicate_recall(spark, data):
    """Of all pairs of similarity 0.8 and more on the tables at hand, those in one component."""
    rows = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    sets = {d: set(neardup.shingles((t or "").encode(), 4).tolist()) for d, t in texts.items()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    both = {}
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                both[b, a] = both.get((b, a), 0) + 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(rows).collect()}
    assert len(links) > 50 and sum(found[a] == found[b] for a, b in links) >= 0.98 * len(links)
    want = {d: d for d in texts}
    for _ in range(20):  # components of the links themselves: none is joined that has no link
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert all(want[d] <= c for d, c in found.items())


def test_neighbours_of_repeated_rows_and_ties(spark):
    """Equal scores go to the smaller vec_id; rows that share a vec_id are candidates each, but not for it."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.5, 0.0])]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 5, 1.0), (5, 3, 0.0)]


def test_parts_grow_with_the_table(spark):
    """Recall against brute force with several parts, more of them for more rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(60, size=9000)] + rng.normal(size=(9000, 16)) * 0.6).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    few, many = ann.fit(df.selectExpr("vec_id", "embedding vector"), 2000), ann.fit(df.selectExpr("vec_id", "embedding vector"), 9000)
    assert 1 < few.parts < many.parts
    unit = ann._unit(x.astype("f8"))
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 9000, 50):
        like = unit @ unit[q]
        like[q] = -2
        hits += len(got[q] & set(np.argsort(-like)[:5].tolist()))
    assert hits >= 0.9 * 5 * 180


def test_mixing_many_sources(docs, monkeypatch):
    """Joined instead of broadcast, and numbered in ranges: the same rows."""
    few = sorted(r[:] for r in mixing.taken(docs).collect())
    copies = sorted(r.doc_id for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "TRAVELLING", 0)
    assert sorted(r[:] for r in mixing.taken(docs).collect()) == few
    assert sorted(r.doc_id for r in mixing.mix(docs).collect()) == copies
    reps = {r.doc_id: r.reps for r in mixing.repetitions(docs).collect()}
    assert copies == sorted(d for d, n in reps.items() for _ in range(n))


def test_neighbours_of_extreme_vectors(spark):
    """Squares that over- or underflow; equal directions have a cosine of one."""
    rows = [(0, [1e-200, 2e-200]), (1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [1e200, 1e200]), (4, [-1e300, 5e-324]), (5, [5e-324, 1e-323])]
    made = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in made] == [(0, 1), (0, 2), (0, 5), (0, 3), (0, 4)]
    assert [r.score for r in made] == pytest.approx([1, 1, 1, 3 / 10**0.5, -(5**-0.5)])


def test_search_widens_until_there_are_enough(spark):
    """A part of two vectors far from all others: its query looks further and finds the exact nearest."""
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(400, 8)) * 0.1 + 5, [[-5.0] * 8, [-5.0] * 7 + [-4.9]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    router = ann.Router(np.zeros((1, 8)), 1)
    router.parts, router.probes = 2, 1  # a part for each side of the origin
    router.w1, router.b1 = np.zeros((8, 2)), np.zeros(2)
    router.w1[0] = [1, -1]
    router.w2, router.b2 = np.eye(2), np.zeros(2)
    got = [(r.vec_id, r.score) for r in ann.search(df, df.filter("vec_id in (400, 7)"), 5, router).filter("query_id = 400").orderBy("rank").collect()]
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    like = unit @ unit[400]
    like[400] = -2
    want = np.lexsort((np.arange(len(x)), -like))[:5]
    assert [v for v, _ in got] == want.tolist()
    assert [s for _, s in got] == pytest.approx(like[want])
    assert ann.search(df, df.filter("vec_id in (400, 7)"), 5, router).count() == 10


def test_pairs_of_a_node_are_fewer_than_its_documents():
    import numpy as np

    from quaestor.llm import neardup

    draw = np.random.default_rng(1)
    sig = np.repeat(draw.integers(0, 60000, (3, neardup.TOKENS)).astype("<u2"), 10, axis=0)
    found = neardup.branch(np.arange(30), np.full(30, 100), sig, 7)
    assert len(found) == 27 and {(a // 10, b // 10) for a, b in found} == {(0, 0), (1, 1), (2, 2)}
