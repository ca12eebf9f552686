"""What is read of a text is read once: costly patterns stand once in the plan that runs."""

import re

import numpy as np
from pyspark.sql import functions as F

from quaestor.functions import grades, text
from quaestor.functions.references import parse_reference
from quaestor.llm import passages
from quaestor.operators import bids, evidence, lots, provider
from quaestor.plans import views
from quaestor.plans.queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_marked_once(spark, tmp_path):
    spark.createDataFrame([(1, "RIC 5; Cohen 7")], "id int, text string").write.parquet(f"{tmp_path}/lots")
    assert _plan(lots.references(spark.read.parquet(f"{tmp_path}/lots"))).count("BMCRE|") == 1


def test_only_names_are_moved(spark, tmp_path):
    """Word runs meet the names before anything is told apart or moved."""
    spark.createDataFrame([(1, "Titus. RIC 5; Cohen 7")], "id int, text string").write.parquet(f"{tmp_path}/lots")
    people = spark.createDataFrame([("titus", "Titus")], "person string, name string")
    assert not re.search(r"Aggregate \[_id#\d+L?, s#\d+, e#\d+, _key", _plan(lots.rulers(spark.read.parquet(f"{tmp_path}/lots"), people)))


def test_runs_are_made_where_a_word_begins_a_name(spark, tmp_path):
    """Words meet the first words of names before any run is made of them."""
    spark.createDataFrame([(1, "Titus. RIC 5; Cohen 7")], "id int, text string").write.parquet(f"{tmp_path}/lots")
    people = spark.createDataFrame([("titus", "Titus")], "person string, name string")
    plan = _plan(lots.rulers(spark.read.parquet(f"{tmp_path}/lots"), people))
    above, below = plan.split("LeftSemi")
    assert above.count("Generate explode(") == below.count("Generate explode(") == 1


def test_what_is_bound_has_its_type_worked_out_once(spark):
    """Not for every row: no item is taken of an array that is made within a row."""
    assert "transform(array(" not in _plan(spark.range(3).select(text.let(F.col("id") + 1, lambda x: text.let(x * 2, lambda y: y + x)).alias("x")))
    assert "transform(array(" not in _plan(spark.range(3).select(parse_reference(F.col("id").cast("string")).alias("x")))


def test_keys_are_tried_by_their_first_letter(spark):
    """As the alternatives one by one, longer ones first."""
    for words in (lots.PLAIN, lots.DOTTED, lots.NAMES, lots.PLATES):
        one, other = (re.compile(p, re.IGNORECASE) for p in (lots._any(words), lots._branched(words)))
        for w in words.split("|"):
            assert all(getattr(one.match(x), "group", str)() == getattr(other.match(x), "group", str)() for x in (w, w + "H", w[:-1], w.upper(), w + " 5"))


def test_links_of_a_page_are_read_once(spark, tmp_path):
    spark.createDataFrame([("<p>", "nero", "a", "USD")], "html string, term string, section string, currency string").write.parquet(f"{tmp_path}/pages")
    assert _plan(provider.read_pages(spark.read.parquet(f"{tmp_path}/pages"), "https://r.example", F.lit("1997-01-01").cast("date"))).count('''href=["']([^"']+)["']''') <= 2


def test_addresses_of_a_page_are_parsed_for_path_and_query(spark, tmp_path):
    """Not for each key of the query; what an address is asked for is read as before."""
    row = '<tr id="1"><td><a class="R" href="lotviewer.php?%s&amp;AucID=1&amp;Lot=3&amp;Val=x"><div class="auctiontitle">A &amp;lt; B &#65;</div></a><nobr>4 Jan 1996</nobr></td><td class="price">5 USD</td></tr>'
    head = "<span class='headertext'>Your search for '<b>nero</b>' matched 1 lots from auctions added in the last six months.</span><table>"
    spark.createDataFrame([(head + row % asked, "nero", "a", "USD") for asked in ("LotID=1", "xLotID=1")], "html string, term string, section string, currency string").write.parquet(f"{tmp_path}/pages")
    read = provider.read_pages(spark.read.parquet(f"{tmp_path}/pages"), "https://r.example", F.lit("1997-01-01").cast("date"))
    assert sorted((r.status, [x.title for x in r.lots or []]) for r in read.collect()) == [("layout", []), ("ok", ["A &lt; B A"])]
    assert len(re.findall(r"parse_?url\(", _plan(read), re.IGNORECASE)) <= 2


def test_an_entry_meets_each_pattern_once(spark, tmp_path):
    """Of a lot's number and of a year; texts that tell of no owner are not parted."""
    spark.createDataFrame([(1, "Ex Leu 7, 1973, lot 5")], "id int, text string").write.parquet(f"{tmp_path}/lots")
    plan = _plan(lots.provenance(spark.read.parquet(f"{tmp_path}/lots")))
    assert [plan.count(p) for p in ("(?=[, l]),? ?", "(?i), ?(?:n[or]", ")(.*)$, $2\u0003$1\u0003$3")] == [1, 1, 1]


def test_lines_meet_their_part_before_texts_are_made(spark, data):
    """Below the join of sale observations are the columns of the tables alone; keys are not compared within a sale."""
    rows = views.sale_obs(spark, data)
    assert "concat" not in _plan(rows).split("Join Inner", 1)[1]
    assert "first(sale_key" not in _plan(evidence.deduplicate(rows))


def test_grades_are_sought_where_a_word_can_begin_one():
    """Most words of a text are told by their first letters."""
    begins = re.compile(grades._OPENS.replace(r"\p{L}", "a-zA-Z").replace("(?!a-zA-Z)", "(?![a-zA-Z])").replace(r"m\p{Lu}", "m[A-Z]").replace("(?iu:", "(?i:"))
    assert [w for w in "Trajan Denarius RIC style struck Stempel stadt vzor VF ss. très qSPL mMS Nearly".split() if begins.match(w)] == ["Stempel", "VF", "ss.", "très", "qSPL", "mMS", "Nearly"]


def test_commands_are_put_in_order_once_they_are_dealt(spark, data):
    """Not before it as well, and the lines that commands are made of are numbered once, though each is sent twice."""
    plan = QUERIES["bid_commands"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan and plan.count("Window [row_number()") == 1
    lots = spark.createDataFrame([(1, 0, None, None, "open", False), (2, 0, None, None, "open", False)], "id long, revision long, planned long, active long, outcome string, linked boolean")
    sent = [(1, "a", 2, "bid.place", 0, 500, None), (1, "a", 3, "bid.place", 1, 600, None), (2, "a", 1, "bid.place", 0, 7, None), (1, None, 4, "bid.place", 0, 9, None)]
    made = bids.apply(lots, spark.createDataFrame(sent, "lot_id long, request_id string, seq long, kind string, expected long, amount long, outcome string"))
    assert {r.id: r.active for r in made.collect()} == {1: 9, 2: 7}


def test_only_shared_stretches_are_put_in_suffix_order(monkeypatch):
    """Of texts that have one window in common, not the rest; what is covered is as by hand."""
    rng, ordered = np.random.default_rng(1), []
    alone = [rng.integers(97, 123, 2000).astype("u1").tobytes() for _ in range(8)]
    texts = [*alone, alone[2][500:580] + alone[0][:70], alone[2][520:600]]
    docs = np.array([5, 6, 7, 8, 1, 2, 3, 4, 9, 0])
    put = passages.suffix_order
    monkeypatch.setattr(passages, "suffix_order", lambda flat, left: ordered.append(len(flat)) or put(flat, left))
    first = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    hand = [(k, i) for k, (t, d) in enumerate(zip(texts, docs.tolist(), strict=True)) for i in range(len(t) - 49) if first[t[i : i + 50]] < d]
    assert list(zip(*(x.tolist() for x in passages.covered(texts, docs)), strict=True)) == hand and hand
    # A few windows share a slot by chance.
    assert sum(ordered) < sum(map(len, texts)) / 2
