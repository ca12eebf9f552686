"""Registered queries of guided lookup, with SQL that resolves the same references by relations instead of arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.references import parse_reference
from ..operators import lookup, lots
from .registry import query
from .views import table

_SECTIONS = ("Nero", "Trajan", "Hadrian", "Trier", "Rome", "Valerian", "Philip I", "Probus (joint reign)")
_OF = ("nero", "trajan", "hadrian", "nero", "trajan", "valerian", "philip", "probus")
_PLAIN = ("I (2nd edition)", "II", "II, Part 1 (2nd edition)", "II, Part 3 (2nd edition)", "III", "IV", "V", "X")
_ASKED_VOLUMES = ("", "II", "VII", "II, Part 3", "V", "I (2nd edition)", "I", "IV")
_ASKED_SECTIONS = ("", "", "Nero", "Trier", "Philip I", "Valerian I", "Zeno", "Rome", "")
_RULERS = (None, ["Nero"], None, ["Philip I", "Otacilia"], ["Valerianus"], None, ["Trajan"])
_PEOPLE = (("nero", "Nero"), ("trajan", "Trajan"), ("hadrian", "Hadrian"), ("valerian", "Valerian"), ("valerian", "Valerian I"), ("valerian", "Valerianus"), ("valerian2", "Valerianus"), ("probus", "Probus"))


def _types(spark, sf_dir):
    """Types from parts: sections of two mints and of rulers, numbers with and without remarks."""
    at = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    s = F.col("p_size") % 8
    mint = s.isin(3, 4)
    volume = F.when(mint, at(lookup.MINT_VOLUMES, k % 4)).otherwise(at(_PLAIN, k % 8))
    number = F.concat((k % 40 + 1).cast("string"), F.when(k % 7 == 0, " (aureus)").when(k % 11 == 0, "-60").otherwise(""))
    rows = p.select(F.concat(F.lit("t"), k).alias("id"), volume.alias("volume"), at(_SECTIONS, s).alias("section"), number.alias("number"),
                    F.array(at(_OF, s)).alias("authorities"), F.array(at(_OF, k % 3)).alias("portraits"), F.when(k % 5 == 0, "NERO REST").alias("legend"), (k % 31 != 0).alias("present"))
    return rows.withColumn("title", F.concat_ws(" ", F.lit("RIC"), "volume", "section", "number", "id"))


def _references(spark, sf_dir):
    """References from orders, some over a range, with volumes, sections, headings and hints in turn."""
    at = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    k = F.col("o_orderkey")
    number, c = (k % 45 + 1).cast("string"), F.col("o_custkey")
    rulers = F.get(F.array(*(F.lit(None).cast("array<string>") if r is None else F.array(*map(F.lit, r)) for r in _RULERS)), (c % 7).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("ref_id"), number.alias("number"), F.when(k % 5 == 0, F.concat(number, F.lit("-60"))).alias("range"), at(_ASKED_VOLUMES, c % 8).alias("volume"), at(_ASKED_SECTIONS, c % 9).alias("section"),
        rulers.alias("rulers"), F.when(c % 2 == 0, F.array(F.lit("Treveri"))).when(c % 11 == 0, F.array(F.lit("Rome"), F.lit("Siscia"))).alias("struck_at"), (c % 13 == 0).alias("heading_mint"),
        F.when(k % 6 == 0, F.concat(F.lit("t"), k % 200 + 1)).alias("hint"),
    )


def _list(values) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else _list(v)
    return f"[{', '.join(map(text, values))}]"


def _picked(name: str, rows: str, volume: str, section: str, aliases: bool, when: str) -> str:
    """Tables name_f, name_k and name: what is found, kept and chosen of rows, a reference and type each."""
    listed = "(" + ", ".join(f"'{v.lower()}'" for v in lookup.VOLUMES) + ")"
    person = " OR EXISTS (SELECT 1 FROM also WHERE also.ref = x.ref AND also.k = x.key)" if aliases else ""
    return f"""{name}_a AS (SELECT *, lower({volume}) AS av, lower({section}) AS ar, regexp_extract(lower({volume}), '^([ivx]+)', 1) AS an, regexp_extract(lower({volume}), '^[ivx]+, part (\\d)', 1) AS ap FROM {rows} x WHERE {when}),
{name}_f AS (SELECT *, av = '' OR av IN {listed} AS exact, an <> '' AND an = av AS family FROM {name}_a x WHERE (ar = '' OR name = ar OR starts_with(name, ar || ' ('){person})),
{name}_k AS (SELECT * FROM {name}_f WHERE CASE WHEN exact AND NOT family THEN av = '' OR vol = av ELSE numeral = an AND (ap = '' OR an <> 'ii' OR part = ap) END),
{name}_w AS (SELECT * FROM {name}_k QUALIFY ranged OR NOT bool_or(ranged) OVER (PARTITION BY ref)),
{name}_o AS (SELECT *, NOT (family AND ar <> '') OR vol = av AS own, bool_or(NOT (family AND ar <> '') OR vol = av) OVER (PARTITION BY ref) AS any_own FROM {name}_w),
{name} AS MATERIALIZED (SELECT * EXCLUDE (av, ar, an, ap, exact, family, own, any_own), any_own AND exact AND count(*) OVER (PARTITION BY ref) = 1 AND (ar = '' OR name = ar) AS ok FROM {name}_o WHERE own OR NOT any_own)"""


_SQL = f"""WITH people(person, k) AS (VALUES {", ".join(f"('{p}', '{n.lower()}')" for p, n in _PEOPLE)}),
t AS (SELECT 't' || p_partkey AS id, CASE WHEN p_size % 8 IN (3, 4) THEN {_list(lookup.MINT_VOLUMES)}[p_partkey % 4 + 1] ELSE {_list(_PLAIN)}[p_partkey % 8 + 1] END AS volume, {_list(_SECTIONS)}[p_size % 8 + 1] AS section,
  p_partkey % 40 + 1 || CASE WHEN p_partkey % 7 = 0 THEN ' (aureus)' WHEN p_partkey % 11 = 0 THEN '-60' ELSE '' END AS number, {_list(_OF)}[p_size % 8 + 1] AS authority, {_list(_OF)}[p_partkey % 3 + 1] AS portrait,
  p_partkey % 5 = 0 AS restored, p_partkey % 31 <> 0 AS present FROM part),
u AS (SELECT *, 'RIC ' || volume || ' ' || section || ' ' || number || ' ' || id AS title, list_position({_list(lookup.VOLUMES)}, volume) AS rank, lower(section) AS name, lower(split_part(section, ' (', 1)) AS key, lower(volume) AS vol,
  regexp_extract(lower(volume), '^([ivx]+)', 1) AS numeral, regexp_extract(lower(volume), '^[ivx]+, part (\\d)', 1) AS part, section IN ('Trier', 'Rome') AS mint FROM t),
n AS (SELECT id, number AS w FROM u UNION SELECT id, regexp_replace(number, ' \\(.*', '') FROM u),
r AS (SELECT o_orderkey AS ref, (o_orderkey % 45 + 1)::VARCHAR AS number, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 45 + 1 || '-60' END AS range, {_list(_ASKED_VOLUMES)}[o_custkey % 8 + 1] AS asked, {_list(_ASKED_SECTIONS)}[o_custkey % 9 + 1] AS wanted,
  {_list(_RULERS)}[o_custkey % 7 + 1] AS rulers, CASE WHEN o_custkey % 2 = 0 THEN ['trier'] WHEN o_custkey % 11 = 0 THEN ['rome', 'siscia'] ELSE [] END AS struck, o_custkey % 13 = 0 AS heading_mint,
  CASE WHEN o_orderkey % 6 = 0 THEN 't' || (o_orderkey % 200 + 1) END AS hint FROM orders),
s AS (SELECT *, EXISTS (SELECT 1 FROM people WHERE k = lower(wanted)) AS is_person, wanted IN ('Trier', 'Rome') AS place FROM r),
h AS (SELECT *, CASE WHEN is_person THEN (SELECT list(DISTINCT p.person) FROM people p WHERE p.k = lower(wanted)) ELSE coalesce((SELECT list(DISTINCT p.person) FROM people p WHERE list_contains(list_transform(rulers, lambda x: lower(x)), p.k)), []) END AS who,
  coalesce(wanted = '' AND len(rulers) > 1 AND list_contains(rulers, 'Philip I'), false) AS headed, CASE WHEN is_person THEN '' ELSE wanted END AS cited FROM s),
also AS (SELECT DISTINCT h.ref, q.k FROM h JOIN people p ON p.k = lower(wanted) JOIN people q USING (person)),
m AS (SELECT ref, id, bool_or(w IS NOT DISTINCT FROM range) AS ranged FROM r JOIN n ON w IN (r.number, r.range) GROUP BY 1, 2),
c AS MATERIALIZED (SELECT h.*, m.ranged, u.* EXCLUDE (number), len(who) > 0 OR headed AS heading, list_contains(who, authority) OR list_contains(who, portrait) OR (headed AND name = 'philip i') AS borne,
  len(struck) > 0 AND mint AND NOT list_contains(struck, name) AS stray FROM m JOIN h USING (ref) JOIN u USING (id)),
{_picked("hi", "c", "asked", "cited", False, "id = hint")},
{_picked("d", "c", "asked", "cited", False, "heading")},
dm AS (SELECT * FROM d WHERE borne),
{_picked("wi", "c", "''", "''", False, "heading AND place AND asked = ''")},
mo AS (SELECT w.* FROM wi w WHERE borne AND (NOT EXISTS (SELECT 1 FROM dm WHERE dm.ref = w.ref) OR NOT mint AND NOT EXISTS (SELECT 1 FROM dm WHERE dm.ref = w.ref AND dm.id = w.id))),
he AS (SELECT * EXCLUDE (ok), count(*) OVER (PARTITION BY ref) AS before FROM dm QUALIFY NOT (stray AND bool_or(mint AND NOT stray AND len(struck) > 0) OVER (PARTITION BY ref))),
{_picked("f", "he", "asked", "cited", False, "true")},
fo AS (SELECT *, ok AND NOT is_person AND len(rulers) > 0 AND NOT list_contains(who, portrait) AND list_contains(who, authority) AND NOT restored AS bad,
  ok AND NOT (before > 1 AND len(struck) > 1) AND NOT headed AND NOT stray AND NOT (regexp_full_match(lower(asked), '[ivx]+') AND vol <> lower(asked)) AS may FROM f),
{_picked("a", "c", "asked", "wanted", True, "NOT heading")},
{_picked("b", "c", "''", "wanted", True, "NOT heading AND wanted <> '' AND asked <> '' AND NOT EXISTS (SELECT 1 FROM a WHERE a.ref = x.ref)")},
{_picked("e", "c", "asked", "''", False, "NOT heading AND wanted <> '' AND NOT EXISTS (SELECT 1 FROM a WHERE a.ref = x.ref) AND NOT EXISTS (SELECT 1 FROM b WHERE b.ref = x.ref)")},
o AS (SELECT ref, 1 AS p, 'hint' AS stage, id, rank, section, title, volume, present, true AS ok, false AS mismatch, false AS bad FROM hi WHERE ok AND (len(who) = 0 OR borne)
  UNION ALL SELECT ref, 2, 'wider-mint', id, rank, section, title, volume, present, false, false, false FROM mo
  UNION ALL SELECT ref, 2, 'wider-mint', id, rank - 100, section, title, volume, present, false, false, false FROM dm WHERE EXISTS (SELECT 1 FROM mo WHERE mo.ref = dm.ref)
  UNION ALL SELECT ref, 3, 'people', id, rank, section, title, volume, present, may AND NOT bad, false, bad FROM fo
  UNION ALL SELECT ref, 3, 'people', id, rank, section, title, volume, present, false, true, false FROM d WHERE NOT EXISTS (SELECT 1 FROM dm WHERE dm.ref = d.ref)
  UNION ALL SELECT ref, 4, 'typed', id, rank, section, title, volume, present, ok AND NOT (coalesce(len(rulers), 0) > 0 OR heading_mint OR asked = '' AND place), false, false FROM a
  UNION ALL SELECT ref, 5, 'any-volume', id, rank, section, title, volume, present, false, false, false FROM b
  UNION ALL SELECT ref, 6, 'any-section', id, rank, section, title, volume, present, false, false, false FROM e),
z AS (SELECT * FROM o QUALIFY p = min(p) OVER (PARTITION BY ref)),
g AS (SELECT ref, min(stage) AS stage, list(id ORDER BY rank, section, title) AS ids, bool_and(present) AS there, bool_and(ok) AS ok, bool_or(mismatch) AS mismatch, bool_or(bad) AS bad, min(volume) AS held FROM z GROUP BY ref)
SELECT h.ref AS ref_id, CASE WHEN g.ref IS NULL THEN 'none' WHEN NOT there THEN 'unavailable' WHEN g.ok THEN 'ok' ELSE 'candidates' END AS status, coalesce(g.stage, CASE WHEN len(who) > 0 OR headed THEN 'people' ELSE 'typed' END) AS stage,
  CASE WHEN there THEN array_to_string(ids, ',') ELSE '' END AS ids, coalesce(mismatch, false) AS person_mismatch,
  CASE WHEN NOT there OR g.ok OR g.ref IS NULL THEN NULL WHEN bad THEN 'portrait' WHEN len(ids) = 1 AND (asked, held) IN (('I', 'I (2nd edition)'), ('II, Part 3', 'II, Part 3 (2nd edition)')) THEN 'edition' END AS note
FROM h LEFT JOIN g USING (ref)"""


@query(_SQL)
def guided_lookup(spark, sf_dir):
    people = spark.createDataFrame(list(_PEOPLE), "person string, name string")
    mints = spark.createDataFrame([("Treveri", "Trier")], "alias string, section string")
    found = lookup.resolve(_references(spark, sf_dir), _types(spark, sf_dir), people, mints)
    return found.select("ref_id", "status", "stage", F.array_join("ids", ",").alias("ids"), "person_mismatch", "note")


_CARDS = f"""SELECT 't' || p_partkey AS id, CASE WHEN p_size % 8 IN (3, 4) THEN {_list(lookup.MINT_VOLUMES)}[p_partkey % 4 + 1] ELSE {_list(_PLAIN)}[p_partkey % 8 + 1] END AS volume, {_list(_SECTIONS)}[p_size % 8 + 1] AS section,
  p_partkey % 40 + 1 || CASE WHEN p_partkey % 7 = 0 THEN ' (aureus)' WHEN p_partkey % 11 = 0 THEN '-60' ELSE '' END AS number FROM part"""


@query(f"""WITH f AS ({_SQL}), cards AS ({_CARDS}),
a AS (SELECT ref_id, status, {_list(_ASKED_VOLUMES)}[o_custkey % 8 + 1] AS v, {_list(_ASKED_SECTIONS)}[o_custkey % 9 + 1] AS s, (o_orderkey % 45 + 1)::VARCHAR AS n, ids FROM f JOIN orders ON o_orderkey = ref_id),
e AS (SELECT ref_id, unnest(string_split(ids, ',')) AS id FROM a WHERE ids <> ''),
j AS (SELECT a.ref_id, a.status, c.volume = v AND c.section = s AND c.number = n AS same, a.status = 'ok' OR (c.section = s AND c.number = n) AS near,
  'RIC ' || replace(replace(c.volume, ', Part ', '.'), ' (2nd edition)', '²') || ' ' || c.section || ' ' || c.number AS name FROM a LEFT JOIN e USING (ref_id) LEFT JOIN cards c ON c.id = e.id),
g AS (SELECT ref_id, coalesce(bool_or(same), false) OR any_value(status) = 'unavailable' AS kept, list_sort(list(DISTINCT name) FILTER (near AND name IS NOT NULL)) AS names FROM j GROUP BY ref_id)
SELECT ref_id, CASE WHEN kept THEN 'as-written' WHEN len(names) = 1 THEN 'renamed' WHEN len(names) > 1 THEN 'choices' ELSE 'refused' END AS action, CASE WHEN kept THEN '' ELSE coalesce(array_to_string(names, ';'), '') END AS names FROM g""")
def want_names(spark, sf_dir):
    people = spark.createDataFrame(list(_PEOPLE), "person string, name string")
    mints = spark.createDataFrame([("Treveri", "Trier")], "alias string, section string")
    types = _types(spark, sf_dir)
    found = lookup.wanted_names(lookup.resolve(_references(spark, sf_dir), types, people, mints), types)
    return found.withColumn("names", F.array_join(F.array_sort("names"), ";"))


@query("""WITH t AS (SELECT p_partkey AS id, ['RRC', 'SC', 'CPE', 'Price'][p_partkey % 4 + 1] AS c, p_size AS s, p_partkey AS k, p_partkey % 17 <> 0 AS present FROM part),
u AS (SELECT lpad(id::VARCHAR, 7, '0') AS id, c, present, CASE c WHEN 'RRC' THEN k % 300 || '/' || s WHEN 'SC' THEN k % 300 || '.' || s WHEN 'CPE' THEN k % 300 || chr(97 + s::INT % 26) ELSE k % 900 || '' END AS n FROM t),
g AS (SELECT *, CASE c WHEN 'RRC' THEN split_part(n, '/', 1) WHEN 'SC' THEN split_part(n, '.', 1) WHEN 'CPE' THEN regexp_replace(n, '[a-z]+$', '') END AS g FROM u),
x AS (SELECT c, n, min(id) AS id, arg_min(present, id) AS present FROM g GROUP BY 1, 2), m AS (SELECT c, g, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS ids FROM g WHERE g IS NOT NULL GROUP BY 1, 2),
r AS (SELECT o_orderkey AS ref_id, ['RRC', 'SC', 'CPE', 'Price', 'RIC'][o_custkey % 5 + 1] AS c, o_orderkey % 400 AS k, o_custkey % 50 AS s FROM orders),
q AS (SELECT ref_id, c, CASE c WHEN 'RRC' THEN k || '/' || s WHEN 'SC' THEN k || '.' || s WHEN 'CPE' THEN k || chr(97 + s::INT % 26) ELSE k || '' END AS n, CASE WHEN c IN ('RRC', 'SC', 'CPE') THEN k || '' END AS g FROM r)
SELECT ref_id, CASE WHEN x.id IS NOT NULL THEN CASE WHEN present THEN 'ok' ELSE 'unavailable' END WHEN m.n <= 5 THEN 'candidates' ELSE 'none' END AS status,
  CASE WHEN x.id IS NOT NULL THEN CASE WHEN present THEN x.id ELSE '' END WHEN m.n <= 5 THEN m.ids ELSE '' END AS ids FROM q LEFT JOIN x ON x.c = q.c AND x.n = q.n LEFT JOIN m ON m.c = q.c AND m.g = q.g""")
def title_lookup(spark, sf_dir):
    def numbered(c, k, s):
        return F.when(c == "RRC", F.concat_ws("/", k, s)).when(c == "SC", F.concat_ws(".", k, s)).when(c == "CPE", F.concat(k, F.char(97 + s.cast("bigint") % 26)))

    at = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    types = table(spark, sf_dir, "part").select(F.lpad(p.cast("string"), 7, "0").alias("id"), at(("RRC", "SC", "CPE", "Price"), p % 4).alias("catalogue"), F.col("p_size").alias("s"), p.alias("k"), (p % 17 != 0).alias("present"))
    types = types.withColumn("number", F.coalesce(numbered(F.col("catalogue"), F.col("k") % 300, F.col("s")), (F.col("k") % 900).cast("string")))
    asked = table(spark, sf_dir, "orders").select(o.alias("ref_id"), at(("RRC", "SC", "CPE", "Price", "RIC"), F.col("o_custkey") % 5).alias("catalogue"), (F.col("o_custkey") % 50).alias("s"), (o % 400).alias("k"))
    asked = asked.withColumn("number", F.coalesce(numbered(F.col("catalogue"), F.col("k"), F.col("s")), F.col("k").cast("string")))
    return lookup.by_title(asked, types).select("ref_id", "status", F.array_join("ids", ",").alias("ids"))


_NAMES = (("Titus", "titus"), ("Vespasian", "vespasian"), ("Julia Domna", "domna"), ("Julia", "julia"), ("Severus Alexander", "alexander"), ("Alexander", "alexander the great"))
_HEADED = ("Titus", "Julia Domna with Vespasian", "SEVERUS ALEXANDER", "Uncertain ruler", "Divus Vespasian. Struck under Titus")


def _lots(spark, sf_dir):
    """Descriptions from lines of orders: a heading, a weight, references in several spellings, brackets, a sale and a collection."""
    k, p, s = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    head = F.get(F.array(*map(F.lit, _HEADED)), (k % len(_HEADED)).cast("int"))
    cited = (
        F.when(s == 1, F.concat(F.lit("RIC II "), k, F.lit("; Cohen "), p, F.lit(" (this coin illustrated); BMC 12, "), s, F.lit(".")))
        .when(s == 2, F.concat(F.lit("Ref: C."), p, F.lit(" - RIC."), k, F.lit(" - cf. RSC "), p, F.lit("a (= BMC 7)")))
        .when(s == 3, F.concat(F.lit("Price "), k, F.lit(", "), k + 1, F.lit(" (Müller "), p, F.lit("). Price realized 1,200. C. "), p))
        .when(s == 4, F.concat(F.lit("Crawford "), k, F.lit("/1; Crawford "), k, F.lit("/1. Ex Leu 7, 1973, lot 12. Hunter Coin Cabinet; Hunter "), p))
        .otherwise(F.concat(F.lit("RIC IV ("), F.lit("Geta"), F.lit(") "), k, F.lit("a. Purchased from Spink, 1998; RIC "), p))
    )
    key = (F.col("l_orderkey") * 10 + s) * 100_000 + k
    rows = table(spark, sf_dir, "lineitem").select(key.alias("id"), F.struct(p.alias("p"), F.concat(head, F.lit(", AD 79-81. Denarius (Silver, 3.21 g, 18mm). "), cited).alias("text")).alias("row"))
    return rows.groupBy("id").agg(F.min("row")["text"].alias("text"))


@query("""WITH l AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_partkey AS k, l_suppkey AS p, l_linenumber AS s FROM lineitem QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1),
r(id, position, written, catalogue, volume, section, number, cf) AS (
  SELECT id, 1, 'RIC II ' || k, 'RIC', 'II', '', k || '', false FROM l WHERE s = 1 UNION ALL SELECT id, 2, 'Cohen ' || p, 'Other', '', '', 'Cohen ' || p, false FROM l WHERE s = 1 UNION ALL SELECT id, 3, 'BMC 12, ' || s, 'Other', '', '', 'BMC 12, ' || s, false FROM l WHERE s = 1
  UNION ALL SELECT id, 1, 'C.' || p, 'Other', '', '', 'C.' || p, false FROM l WHERE s = 2 UNION ALL SELECT id, 2, 'RIC.' || k, 'RIC', '', '', k || '', false FROM l WHERE s = 2 UNION ALL SELECT id, 3, 'RSC ' || p || 'a', 'Other', '', '', 'RSC ' || p || 'a', true FROM l WHERE s = 2
  UNION ALL SELECT id, 1, 'Price ' || k, 'Price', '', '', k || '', false FROM l WHERE s = 3 UNION ALL SELECT id, 2, 'Müller ' || p, 'Other', '', '', 'Müller ' || p, false FROM l WHERE s = 3
  UNION ALL SELECT id, 1, 'Crawford ' || k || '/1', 'RRC', '', '', k || '/1', false FROM l WHERE s = 4 UNION ALL SELECT id, 2, 'Hunter ' || p, 'Other', '', '', 'Hunter ' || p, false FROM l WHERE s = 4
  UNION ALL SELECT id, 1, 'RIC IV (Geta) ' || k || 'a', 'RIC', 'IV', 'Geta', k || 'a', false FROM l WHERE s > 4 UNION ALL SELECT id, 2, 'RIC ' || p, 'RIC', '', '', p || '', false FROM l WHERE s > 4)
SELECT * FROM r""")
def lot_references(spark, sf_dir):
    found = lots.references(_lots(spark, sf_dir))
    return found.select("id", "position", "written", "reference.*", "cf")


@query(f"""WITH l AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_partkey % 5 AS h FROM lineitem)
SELECT id, ['titus', 'domna,vespasian', 'alexander', NULL, 'vespasian,titus'][h + 1] AS rulers FROM l WHERE h <> 3""")
def lot_rulers(spark, sf_dir):
    people = spark.createDataFrame([(p, n) for n, p in _NAMES], "person string, name string")
    return lots.rulers(_lots(spark, sf_dir), people).withColumn("rulers", F.array_join("rulers", ","))


@query("""WITH l AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_linenumber AS s, l_partkey % 900 AS k, 1950 + l_partkey % 70 AS y FROM lineitem)
SELECT id, 1 AS position, 'Ex Leu ' || k || ', 25. Mai ' || y || ', Los ' || s || 'a' AS entry, 'Leu ' || k AS source, y::INT AS year, s || 'a' AS lot FROM l WHERE s = 1 UNION ALL SELECT id, 2, 'Ex Hess 1958', 'Hess', 1958, NULL FROM l WHERE s = 1
UNION ALL SELECT id, 1, 'Gorny & Mosch ' || k, 'Gorny & Mosch ' || k, NULL, NULL FROM l WHERE s = 2
UNION ALL SELECT id, 1, 'Ex NAC ' || k || ', ' || y || ', ' || s || ' (hammer CHF 3,200)', 'NAC ' || k, y, s || '' FROM l WHERE s = 3 UNION ALL SELECT id, 2, 'ex Hunt collection (part II), Sotheby''s 1991', 'Hunt collection (part II), Sotheby''s', 1991, NULL FROM l WHERE s = 3
UNION ALL SELECT id, 1, 'Acquired from Spink, ' || y, 'Spink', y, NULL FROM l WHERE s = 4""")
def lot_provenance(spark, sf_dir):
    s, k, y = F.col("l_linenumber"), F.col("l_partkey") % 900, 1950 + F.col("l_partkey") % 70
    said = (
        F.when(s == 1, F.concat(F.lit("Ex Leu "), k, F.lit(", 25. Mai "), y, F.lit(", Los "), s, F.lit("a. Ex Hess 1958.")))
        .when(s == 2, F.concat(F.lit("Provenance: Gorny & Mosch "), k, F.lit(".")))
        .when(s == 3, F.concat(F.lit("Ex NAC "), k, F.lit(", "), y, F.lit(", "), s, F.lit(" (hammer CHF 3,200); ex Hunt collection (part II), Sotheby's 1991.")))
        .when(s == 4, F.concat(F.lit("Acquired from Spink, "), y, F.lit("; RIC 53."))).otherwise("Rare.")
    )
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 10 + s) * 100_000 + F.col("l_partkey")).alias("id"), F.concat(F.lit("Nero. Denarius. RIC 5. "), said).alias("text"))
    return lots.provenance(rows.distinct())


#: Forms of references and what they are read as: catalogue, volume, section, number; # stands for a number.
_FORMS = (
    ("RIC II Hadrian #", ("RIC", "II", "Hadrian", "#")), ("RIC V, part II Probus #", ("RIC", "V, Part 2", "Probus", "#")), ("RIC II.2 Hadrian #", None), ("RIC XI Nero #", None), ("RIC hello #", None),
    ("Crawfrd #/5", None), ("Craw. #/5", ("RRC", "", "", "#/5")), ("Euthydemus I Bop. #A", ("Bop", "", "Euthydemus I", "#A")), ("Lot 80: RIC #", None), ("SNG Cop #; Price #", ("Price", "", "", "#")),
    ("(RIC I (2nd ed.) Nero #)", ("RIC", "I (2nd edition)", "Nero", "#")), ("SNG Spaer #", ("Other", "", "", "SNG Spaer #")), ("#", None),
)
_WANTED = ", ".join("NULL" if r is None else "[" + ", ".join(f"'{x}'" for x in r) + "]" for _, r in _FORMS)


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS n, [{_WANTED}][o_orderkey % {len(_FORMS)} + 1] AS r FROM orders)
SELECT id, r[1] AS catalogue, r[2] AS volume, r[3] AS section, replace(r[4], '#', n) AS number FROM r""")
def reference_readings(spark, sf_dir):
    form = F.get(F.array(*(F.lit(t) for t, _ in _FORMS)), (F.col("o_orderkey") % len(_FORMS)).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.replace(form, F.lit("#"), F.col("o_custkey").cast("string")).alias("text"))
    return rows.select("id", parse_reference(F.col("text")).alias("r")).select("id", "r.*")
