"""The grade reader against texts with known grades."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quaestor.functions import grades
from quaestor.plans.queries import QUERIES

#: Texts and the bucket each must be read as.
KNOWN = {
    "Fine and below": [
        'Fine, porous.',
        'Nero. Denar. RIC 306. s-ss',
        's/ss',
        'Erhaltung: s',
        'Fine',
        'TB à TTB.',
        'Obverse VF, reverse Fine.',
        'Fine 12 h.',
        'Schöne Patina, sge',
        'sge-s',
        'sge/ss',
        'Fair, worn.',
        'Fair to Fine',
        'Pitted. Fair.',
    ],
    'VF': [
        'Nero. As. RIC 306. Very Fine, dark patina.',
        'Good very fine, lightly toned.',
        'NGC Choice VF 5/5 - 4/5.',
        'gVF',
        'VF/EF',
        'Schoene Patina. ss-vz.',
        'Belle patine. TTB.',
        'An attractive example with a fine portrait. Good very fine.',
        'Schöne Patina. ss. Aus Sammlung Müller.',
        'ss, R!',
        'ss+',
        'Erhaltung: ss-vz.',
        '(VF/EF)',
        'Vgl. RIC 306 (s. Anm.). ss',
        'Rs. Adler n. r., s. RIC 12. ss.',
        'Ex Fair collection. GVF.',
        'Very Fine',
        'Very fine',
        'Good very fine',
        'Good VF',
        'Almost Very Fine.',
        'About Very Fine.',
        'Nice VF.',
        'Toned VF.',
        'Minor porosity, otherwise Very Fine.',
        'Gutes sehr schön.',
        'Fast sehr schön.',
        'Knapp sehr schön.',
        'Buon BB.',
        'NGC Choice VF 5/5 - 4/5',
        'NGC Ch VF',
        'Very Fine and rare.',
        'Very Fine & Rare.',
        'Very Fine - Extremely Fine.',
        'VF - EF.',
        'VF (scratch).',
        'Very Fine (light scratches).',
        'Sehr schön +.',
        'TTB à SUP.',
        '"Good VF"',
        'Nero. As. RIC 306. "Very Fine"',
        'VF*',
        'Schöne Patina. ss*',
        'Good VF though off-centre.',
        'ss, though schwach ausgeprägt.',
        'otherwise very fine',
        'Flan crack, otherwise very fine.',
        'Flan crack, otherwise good very fine',
        'qBB',
        'q.BB',
        'BB+',
        'mBB',
        'Bella patina. mBB.',
        'Moneta con patina, BB+.',
        'VF 3.41 g',
        'VF 17.23 g, 18 mm, 6 h.',
        'Nero. Denarius. RIC 306. VF 3.41 g',
        'ss 3,41 g',
        'Toned, GVF.',
        'Some porosity, NVF.',
        'Toned, nVF.',
        'GVF/GEF',
        'BB/Spl',
    ],
    'EF': [
        'Extremely Fine, minor marks.',
        'Herrliche Patina, vorzüglich.',
        'Patina verde. SPL.',
        'Extremely Fine, with a fine old cabinet tone.',
        'A portrait as fine as any. EF',
        'From the BB collection. EF',
        'EF, Fine Style',
        'Selten, s. Kommentar. vz',
        'Aus Sammlung Müller, s. Auktion 12. Vorzüglich.',
        'Ex Slg. X (s. o.). vz',
        'AU/EF',
        'AU - EF.',
        'About EF',
        'Extremely fine',
        'vorzüglich',
        'Vorzüglich',
        'Near EF.',
        'Nearly Extremely Fine.',
        'Choice EF.',
        'Superb EF.',
        'A few light marks, otherwise EF.',
        'Fast vorzüglich.',
        'fast vz.',
        'NGC XF 4/5',
        'Extremely Fine for the issue.',
        'EF with luster.',
        '“EF”',
        'EF★',
        'Extremely Fine though weakly struck.',
        'nearly extremely fine',
        'Flan crack, otherwise nearly extremely fine.',
        'qSPL',
        'SPL+',
        'Roma. Sesterzio. RIC 306. qSPL',
        'EF 18mm',
        'Extremely fine / Fdc',
        'Attractive, GEF, rare.',
        'NEF with some lustre',
        'Toned, nEF.',
        'vz-Stgl.',
        'Bella patina. Spl',
        'qSpl.',
        'EBC/S/C',
        'Conservación: EBC',
    ],
    'AU/Mint State': [
        'FDC.',
        'Mint State, fully lustrous.',
        'Erhaltung: st',
        'Stempelglanz.',
        'Erhaltung: Stgl. Notes: vz for the type',
        'NGC AU 58',
        'About Uncirculated',
        'AU',
        'Choice AU',
        'AU 12 h.',
        'Nero. AR Denarius. NGC AU 5/5.',
        'Solidus. NGC AU 58',
        'NGC MS 5/5 - 4/5, Fine Style',
        'MS 63',
        'AU.',
        'NGC AU 5/5 - 4/5',
        'NGC Choice AU★ 5/5 - 5/5, Fine Style.',
        'about uncirculated with luster',
        'qFDC',
        'Virtually as struck and Fdc',
        'Rare. Fdc.',
        'RIC 53. 3,42 g. Stgl.',
        'Feine Tönung. Stgl',
        'fast Stgl.',
        'f.Stgl.',
        'Feine Tönung, prfr.',
        'Herrliche Tönung, prägefrisch.',
        'Fast prägefrisch.',
        'BU, prooflike',
        'Choice BU.',
        'aUNC.',
        'AUNC',
        'NGC Gem MS 5/5 - 5/5',
        'Brilliant Uncirculated.',
        'S/C. Brillo original.',
        'Felipe II. 1589. Sevilla. B. 8 reales. (Cal. 690). 27,23 g. S/C.',
        'Felipe II. 8 reales. 27,23 g. S/C.',
        'Felipe II. 8 reales. Brillo original. S/C.',
        'Felipe II. 8 reales. Muy bella. S/C.',
        'Felipe II. 8 reales. Bonita pátina. S/C.',
        'Nero. Denar. Prfr.',
        'Morgan Dollar. Gem BU.',
        'Conservación: S/C',
    ],
    None: [
        'Fine, rough surfaces.',
        'Die Erhaltung ist gut, ss ist untertrieben, schaut selbst',
        'Of fine style, some wear.',
        'Nero. As. RIC 306.',
        '',
        'Er ist stolz',
        'Kassel',
        'A "fine" portrait.',
        'Ex "MS" collection.',
        'Some corrosion, very fine portrait.',
        'a nearly extremely fine example of the type',
        'Vgl. mss. Kommentar.',
        'Monogramma mBB nel campo.',
        'Slg. vz 12.',
        'Ex Slg. MS 63.',
        'Fine 12.',
        'Solidus. AU 4.45 g.',
        'Aureus. AU, 7.25 g.',
        'Gold (AU) solidus',
        'AU 21 mm.',
        'Tremissis. AU 1.48 g, 15 mm.',
        'Byzantine. Solidus. AU.',
        'fine',
        'very fine',
        'a fine coin',
        'vf',
        'ef',
        'fdc',
        'A fair portrait.',
        'Fair Lawn collection. Unread.',
        'Ex Fair collection',
        'fair',
        'Of Fair style',
        'Rev. BU monogram in field.',
        'Ex BU collection.',
        'Cohen 302 (BU).',
        'control: BU.',
        'Rev. Spes advancing left. S/C.',
        'Rev. S/C, legend around.',
        'SC (unlisted)',
        'S/C (unlisted)',
        'Splendido esemplare.',
        'Gemma incisa. Pubblicato.',
        'Gem of a portrait.',
        'gvf',
        'Stglanz',
        'prägefrischer Glanz',
        'Rev.: Roma sentada. S/C.',
        'Rev. Victory standing. 10,85 g. Rev. S/C.',
        'Felipe II. 8 reales. Victoria alada. S/C.',
        'Gem BUlk lot',
    ],
}


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.g for r in df.select("k", grades.grade_of(F.col("t")).alias("g")).orderBy("k").collect()]


def test_known_texts(spark):
    pairs = [(t, g) for g, texts in KNOWN.items() for t in texts]
    assert [p for p, g in zip(pairs, read(spark, [t for t, _ in pairs]), strict=True) if p[1] != g] == []


def test_last_statement_counts_and_labelled_beats_last(spark):
    texts = ["VF. Later EF.", "EF. Grade: VF. Notes: FDC.", "Grade: VF/EF. FDC.", "Grade: EF. Condition: VF", None, "", "   ", "\u0001VF\u0002"]
    assert read(spark, texts) == ["EF", "VF", "VF", "VF", None, None, None, "VF"]


def test_what_lies_beyond_the_limit_is_not_read(spark):
    assert read(spark, ["x" * 4000 + ". EF", "EF. " + "x " * 50_000]) == [None, "EF"]


def test_whole_texts_are_read_without_a_limit(spark, data):
    """By any number of words, of which a range's may lie in two blocks; the queries set no limit."""
    texts = ["x" * 4000 + ". EF", "Trajan. " * 500 + "Grade: VF. Notes: EF.", "VF. " * 2000 + "Fine", "Kopf nach links. " * 300 + "ss-vz"]
    texts += ["FDC. " * n + "EF/VF. Ex " + "y" * 500 + "." for n in (62, 63, 64, 127)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = [r.g for r in df.select("k", grades.grade_of(F.col("t"), limit=None).alias("g")).orderBy("k").collect()]
    assert found == ["EF", "VF", "Fine and below", "VF"] + ["VF"] * 4
    for name in ("lot_grades", "price_medians_by_grade"):
        assert str(grades.LIMIT) not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("part", ["VF/EF ", "very fine ", "ss ", "Fine - ", "Good "])
def test_hostile_texts_cost_no_more_than_others(part, spark):
    begin = time.perf_counter()
    read(spark, [part * 20_000] * 4)
    assert time.perf_counter() - begin < 20


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(grades.grade_of(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_words_of_every_kind_stand_alone_behind_a_label(spark):
    """Each word of the lists, behind a label, is its bucket."""
    lists = (grades.ABBREVIATION, grades.MARK, grades.IN_RANGE)
    words = [(w, k) for table in lists for k, group in enumerate(table) for w in group.split()] + [(w, k) for table in (grades.NAME, grades.MARK_OF_TWO, grades.IN_RANGE_NAME) for k, group in enumerate(table) for w in group.split("|") if w]
    random.Random(1).shuffle(words)
    assert [(w, b) for (w, k), b in zip(words, read(spark, [f"Condition: {w[0].upper() + w[1:] if ' ' in w else w}." for w, _ in words]), strict=True) if b != grades.BUCKETS[k]] == []
