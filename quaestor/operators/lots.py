"""Lot descriptions: every catalogue reference in them, and the rulers their headings name.

One pass sets off the catalogue keys of a text. From there a reference is a row: windows over
the rows of a text know how deep in brackets a key stands, which rows run on from one another
and which repeat; what follows a key is read in a window of fixed width. Rulers are found by
joining the word runs of a heading with the spellings of people. All of it stays in the JVM,
and costs grow with the length of a text, not with its square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import READING, parse_reference
from ..functions.text import let, name_key

#: Characters read behind a key; a reference is far shorter.
SPAN = 400
#: Words of a ruler's name.
NAME_WORDS = 4
#: Spellings of catalogue keys. PLAIN ones count wherever they stand, dots allowed behind DOTTED ones;
#: the others are words or names, and count only with a number behind them, PLATES also with a numeral between.
PLAIN = (
    "BMC/RE|BMCRE|BMCRR|BMC|Bopearachchi|Calicó|Calico|Cohen|Crawford|RIC|RBW|RRCH|RRC|RSC|RPC|RCV|HCRI|CRI|LRBC|CNR|AGK|DCA|AMNG|GIC|SGI|H&J|K&G|TJC|AJC|GBC|HN Italy|ACGC|ACIP|CNH|IGCH|WSM|CSE|CPE|SMA|Göbl|Goebl|Gobl|SNS|MACW"
    "|MIBEC|MIBE|MIB|MEC|SCBI|SICA|MIRB|SNAT|SNG|HGC|BCD|Sear|SBCV|SB|SGCV|GCV|SG|Scholten|Seleucid Coins|SC|Pr|Mitchiner|MIG|DOC|MIR|Sydenham|Müller|Muller|KM|Kroll|Svoronos|McClean|Benner|CBN|BN|GRPC|ESMS|ESM"
)
DOTTED = "Bop|Coh|Craw|Cr|R.I.C|Sell|Dav|Syd"
NAMES = (
    "Hunter|Woytek|Cunetio|Elmer|Normanby|Mairat|Bastien|Giard|Depeyrot|Estiot|Szaivert|Gnecchi|Babelon|Bahrfeldt|Banti|Kampmann|Van Meter|Vagi|Foss|Mazzini|Biaggi|Seaby|Prieur|McAlee|Moushmov|Bellinger|Butcher|Spijkerman|Rosenberger"
    "|Kadman|Sofaer|Ziegler|Klose|Emmett|Milne|Dattari-Savio|Dattari|Geissen|Curtis|Köln|Koeln|Koln|Christiansen|Howgego|Pangerl|Hendin|Meshorer|Mildenberg|Vlasto|Fischer-Bossert|Böhringer|Boehringer|Bohringer|Noe|Jenkins|Weber|Forrer|Pozzi"
    "|Jameson|Gulbenkian|Thompson|Troxell|Newell|Le Rider|Kraay|Grose|Betlyon|Rouvier|Klein|Asyut|Carradice|Bodenstedt|Ashton|Draganov|Weiser|Sellwood|Shore|Senior|Alram|Nercessian|Jongeward|Lorber|Saeedi|Paruck|Vondrovec|Cribb|Rosenfield"
    "|Ratto|Sommer|Füeg|Fueg|Morrisson|Grierson|Hahn|Tolstoi|Bendall|Metlich|Malloy|Metcalf|Hobbs|Scheers|Mack|Dembski|Kostial|Sills|Album|Walker|Nicol|Bernardi|Lavoix|Diler|Sabatier|Wroth|Van Arsdell|Delestrée|Delestree|Klat|Balog|Goodwin"
    "|Artuk|Prieto y Vives|Vives|Friedberg|Davenport|Bitkin|Cal"
)
PLATES = "Varbanov|Lindgren|Recueil|Traité|Traite|Von Fritze|Karayotov|Schindel|LT"
WORDS = "Sunrise|COI|OTA|DT|ABC|VA"
TYPED = "RIC|R.I.C|RRC|Crawford|Craw|Cr|SC|Seleucid Coins|Price|Pr|Bopearachchi|Bop|CPE|Newell Demetrius|Newell, Demetrius|Newell Demetrius Poliorcetes|Newell, Demetrius Poliorcetes"
HOUSES = "Album|Sear|Calicó|Calico|Seaby|Ratto"
INFIXES = "pl pls eng engl isch bnf sidon em générale generale"
VOLUME_WORDS = "ed eds vol vols part parts pt"
ARGUED = "note notes argues suggests dates publishes lists discusses records catalogues covers remains revised"
ABBREVIATED = "Dr Mr Mrs Ms Prof St Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Dez Okt No no Nr nr Vol vol Pl pl Slg Smlg Auk Kat Abb Taf Lot Los"
PROVENANCE = "Exemplar der|Aus der Sammlung|Aus Sammlung|Aus Slg|Erworben|Provenienza|Provenienz|Provenance|Provient de|Proviene|Ex|From"
PURCHASE = "Privately purchased|Acquired|Purchased|Bought"
VOLUME_PARTS = "II 1|II 3|IV 1|IV 2|IV 3|V 1|V 2"
FIRST_NAMES = "Stephen|Rodolfo"
#: Months as they are written in five languages, and words for a lot.
MONTHS = (
    "Jan|January|Januar|Feb|February|Februar|Mar|March|März|Apr|April|May|Mai|Jun|June|Juni|Jul|July|Juli|Aug|August|Sep|Sept|September|Oct|October|Okt|Oktober|Nov|November|Dec|December|Dez|Dezember"
    "|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre|gennaio|febbraio|aprile|maggio|giugno|luglio|settembre|ottobre|novembre|dicembre"
    "|janvier|février|fevrier|mars|avril|juin|juillet|août|aout|septembre|octobre|décembre|decembre"
)
LOT_WORDS, NO_YEAR = "lots|lot|los|lotto|lote", "lots|lot|los|lotto|lote|no|nr|n|sale|auction|catalogue"
ENTRIES = 10
CUES = "see cf per following compare contra after from published discussed cited dated attributed"

_SEP = r"[\s.,:#-]"
_DIGIT = r"(?:\p{Lu}\p{L}?[.-]){0,2}\d"
_ORDINAL = r"\d+(?:st|nd|rd|th)"
_PASSED = rf"(?iu:{_ORDINAL}|{'|'.join(VOLUME_WORDS.split())})\.?"
_KEPT = rf"(?:[&-]\s*\p{{Lu}}\p{{L}}+|\(?(?iu:{'|'.join(INFIXES.split())})\.?\)?)"
_GAP = rf"(?:{_SEP}*(?:{_PASSED}|{_KEPT})){{0,2}}{_SEP}*"
_NUMERAL = rf"(?:[IVXL]+{_SEP}+)?"
_TOP = r"\s*(?:;|,(?=\s)|\.(?=\s)|=|\n)\s*|\s+-\s+"
_NO_WORD = r"(?![\p{L}\d])"


def _any(words: str) -> str:
    return "|".join(sorted((w.replace(".", r"\.") for w in words.split("|")), key=len, reverse=True))


def _branched(words: str) -> str:
    """The same alternatives by their first letter, so that only those a word can be are tried."""
    first: dict[str, list[str]] = {}
    for w in words.split("|"):
        first.setdefault(w[0].lower(), []).append(w)
    return "(?:" + "|".join(f"(?={c})(?:{_any('|'.join(group))})" for c, group in first.items()) + ")"


_KEY = (
    rf"(?=[\p{{Lu}}c])(?<![\p{{L}}\d])((?i:cf\.?\s*)?)((?=\p{{Lu}})(?iu:Newell(?:,\s*|\s+)Demetrius(?:\s+Poliorcetes)?|{_branched(PLAIN)}|Price(?!\s+reali[sz]ed)|{_branched(DOTTED)}\.?){_NO_WORD}|Y#"
    rf"|(?=\p{{Lu}})(?iu:{_branched(f'{NAMES}|{WORDS}')})\b(?=(?:{_GAP}|(?:{_SEP}*{_PASSED}){{1,2}}{_SEP}*[IVXL]+{_SEP}+){_DIGIT})|(?=\p{{Lu}})(?iu:{_branched(PLATES)})\b(?={_GAP}{_NUMERAL}{_DIGIT})|[CS]{_NO_WORD})"
)


def _name(key: Column) -> Column:
    """A key as it is listed: in lower case, without a full stop."""
    return F.lower(F.regexp_replace(F.regexp_replace(key, r"\.$", ""), r"\s+", " "))


def _in(name: Column, words: str) -> Column:
    return name.isin([w.lower() for w in words.split("|")])


def _has(text: Column, *parts: str) -> Column:
    """Whether a text holds any of the parts, told without a pattern."""
    return reduce(lambda test, part: test | text.contains(part), parts[1:], text.contains(parts[0]))


def _asked(test: Column, text: Column, pattern: str, to: str | Column) -> Column:
    """A text with a pattern replaced, which is tried only where a test says so."""
    return F.when(test, F.regexp_replace(text, pattern, to)).otherwise(text)


def clean(text: Column) -> Column:
    """Without characters that do not show, long dashes as short ones, blanks within a line as one space."""
    hidden = "[\u0001-\u0003\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]"

    def shown(t: Column) -> Column:
        # Texts of ASCII need a look at single characters alone; so do blanks.
        return F.when(_has(t, "\u0001", "\u0002", "\u0003") | (F.octet_length(t) != F.length(t)), F.regexp_replace(F.regexp_replace(t, hidden, ""), "[\u2013\u2014]", "-")).otherwise(t)

    spaced = lambda t: F.when(_has(t, "  ", *"\t\v\f\r"), F.regexp_replace(t, r"[^\S\n]+", " ")).otherwise(t)
    return let(let(F.coalesce(text, F.lit("")), shown), spaced)


def _sentences(text: Column) -> Column:
    """Sentences; a full stop of an initial or an abbreviation ends none, unless a typed citation follows."""
    cited = rf"\.(?=\s(?:[Cc]f\.?\s)?(?:{_any(TYPED)})\.?[^.;\n]{{0,40}}?\d)"
    stop = rf"(?<!\b\p{{L}})(?<!\b(?:{'|'.join(ABBREVIATED.split())}))\.(?=\s)(?!(?<=\b\d{{1,2}}\.)\s\p{{Lu}}\p{{Ll}}+\.?\s\d{{4}})"
    return F.split(F.regexp_replace(text, rf"(?=[.!?\n])(?:{cited}|{stop}|[!?](?=\s)|\n)", "$0\u0003"), "\u0003", -1)


def _owned(sentence: Column) -> Column:
    return sentence.rlike(rf"^\s*(?:{_any(PROVENANCE)})\b|^\s*Asta [A-Z]")


def _bought(sentence: Column) -> Column:
    return sentence.rlike(rf"^\s*(?:{_any(PURCHASE)})\b")


def _tells(text: Column) -> Column:
    """Whether any sentence may tell where a coin came from; a text of which none does is not parted."""
    return text.rlike(rf"(?:^|[.!?\n])\s*(?=[A-Z])(?:(?:{_any(f'{PROVENANCE}|{PURCHASE}')})\b|Asta [A-Z])")


#: Where a citation begins that the sentence of a purchase runs on to.
_RUN_ON = rf"(?:[;,]|\s-)?\s\(?((?:{_any(TYPED)})\.?[\s.,:#-]*[IVX\d].*)$"


def without_provenance(text: Column) -> Column:
    """A text without the sentences that tell where a coin came from; behind a purchase the typed citation that
    the sentence runs on to stays."""

    def left(x: Column) -> Column:
        behind = F.regexp_extract(x, _RUN_ON, 1)
        return F.when(_owned(x), "").when(_bought(x), F.when(behind != "", F.concat(F.lit(" "), behind)).otherwise("")).otherwise(x)

    return let(text, lambda t: F.when(_tells(t), F.array_join(F.transform(_sentences(t), left), "")).otherwise(t))


def _keys(lots: DataFrame, id_: str, text: str) -> DataFrame:
    """_id, k, cf, key and its name, after and before (the text on either side up to the next key), head, of every listed key.

    A key within brackets counts only if the bracket opens on a key, and then behind a separator.
    What is not listed is text of the key before it.
    """
    marked = F.split(F.regexp_replace(without_provenance(clean(F.col(text))), _KEY, "\u0001$1\u0002$2\u0002"), "\u0001", -1)
    # Outer, so that no filter on the pieces is inferred, below which they would be marked once more.
    pieces = lots.select(F.col(id_).alias("_id"), marked.alias("_pieces"))
    rows = pieces.select("_id", F.get("_pieces", F.lit(0)).alias("head"), F.posexplode_outer("_pieces").alias("k", "_piece")).filter("k > 0")
    part = F.split("_piece", "\u0002", -1)
    rows = rows.withColumns({"cf": F.get(part, F.lit(0)) != "", "key": F.get(part, F.lit(1)), "after": F.get(part, F.lit(2)), "_raw": F.replace("_piece", F.lit("\u0002"), F.lit(""))})
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    text_ = Window.partitionBy("_id").orderBy("k")
    past = text_.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda x: count(F.col("head"), x) + F.coalesce(F.sum(count(F.col("_raw"), x)).over(past), F.lit(0))
    rows = rows.withColumns({"_opened": so_far("("), "_closed": so_far(")"), "before": F.coalesce(F.lag("after").over(text_), "head")})
    rows = rows.withColumn("opens", F.col("before").endswith("("))
    level = F.greatest(F.col("_opened") - F.col("_closed"), F.lit(0))
    on_key = F.max("opens").over(Window.partitionBy("_id", "_opened"))
    parted = F.col("before").rlike(r"(?:[;,.=]\s*|\s-\s+)$")
    # A key right behind another, or its co-author, is part of it.
    within = (F.col("k") > 1) & F.col("before").rlike(r"^\s*[&-]?\s*$") & ~F.col("before").contains("\n")
    rows = rows.withColumn("_listed", ~within & ((level == 0) | ((level == 1) & (F.col("opens") | (on_key & parted)))))
    rows = rows.withColumn("_of", F.sum(F.col("_listed").cast("int")).over(text_)).filter("_of > 0")
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("_listed"), F.col("after")).otherwise(F.col("_raw")).alias("t")))), lambda x: x["t"]), "")
    first = lambda c: F.max(F.when(F.col("_listed"), F.col(c))).alias(c)
    return rows.groupBy("_id", F.col("_of").alias("k")).agg(first("cf"), first("key"), first("opens"), F.max(F.when(F.col("_listed"), F.substring(F.col("before"), -60, 60))).alias("before"), F.max(F.when(F.col("k") == 1, F.col("head"))).alias("head"), tail.alias("after")).withColumn("name", _name(F.col("key")))


_WORD = r"\s*+(?:\([^()]*+\)|[^\s()]++)"
_NUMBERED_BODY = rf"(?:{_WORD}){{0,4}}\s*+[^\s()]*\d[^\s()]*+(?:\s*+\([^()]*+\)|\s++(?:var\.?|passim){_NO_WORD}[^\s()]*+){{0,8}}"


def _body(chunk: Column) -> Column:
    """The start of a chunk up to a number within five words, with brackets, var. or passim behind it; three words
    at most where there is no number; else empty. Brackets of a chunk are whole."""
    return F.regexp_extract(chunk, rf"^({_NUMBERED_BODY}|(?:\s*+[^\s()\d]++){{0,3}}+(?=\s*+$))", 1)


def _spans(keys: DataFrame) -> DataFrame:
    """keys with body (what is read behind the key) and broken (whether anything else stands before the next one)."""
    text_ = Window.partitionBy("_id").orderBy("k")
    c = F.col
    keys = keys.withColumns({"typed_key": _in(c("name"), TYPED), "_next_opens": F.coalesce(F.lead("opens").over(text_), F.lit(False))})
    after = F.when(c("_next_opens") & c("after").endswith("("), F.left("after", F.length("after") - 1)).otherwise(c("after"))
    keys = keys.withColumn("span", after)
    keys = keys.withColumn("span", F.when(c("span").contains("OCRE"), F.get(F.split("span", r"\s+OCRE\b", 2), F.lit(0))).otherwise(c("span")))
    stopped_ = _in(c("name"), "RIC|RRC|Pr") & c("span").startswith(".")
    span = F.when(stopped_, F.regexp_replace("span", r"^\.(?=\s+\d)", "")).when(_in(c("name"), "CPE|" + TYPED[TYPED.index("Newell") :]), F.regexp_replace("span", r"^\s*,?\s*no\.\s*(?=[Bb]?\d)", " ")).otherwise(c("span"))
    keys = keys.withColumn("span", F.regexp_replace(span, rf"^(?:{_SEP}*{_PASSED}){{1,2}}{_SEP}*(?={_NUMERAL}{_DIGIT})", " ")).withColumn("_near", F.substring("span", 1, SPAN))
    keys = keys.withColumn("_open", F.when(_has(c("_near"), "(", ")"), F.regexp_extract("_near", r"^(?:[^()]++|\([^()]*+\))*+", 0)).otherwise(c("_near")))
    stopped = F.length("_open") < F.length("_near")
    parts = F.split(F.replace(F.regexp_replace("_open", rf"(?=[\s(;,.=])(?:(\([^()]*\))|({_TOP}))", "$1\u0003$2\u0003"), F.lit("\u0003\u0003"), F.lit("")), "\u0003", -1)
    keys = keys.withColumns({"_parts": parts, "_stopped": stopped | (F.length("span") > SPAN)})
    keys = keys.withColumn("_first", _body(F.get("_parts", F.lit(0))))
    volume_only = c("_first").rlike(r"(?i)^\s*(?:vol\.?\s*)?[IVX]+(?:\s*[./]\s*\d|\s+part\s*\d)?\s*(?:²|\(2\)|\(?2nd ed(?:ition|\.)?\)?)?\s*$")
    state = lambda body, ended, broken: F.struct(body.alias("body"), ended.alias("ended"), broken.alias("broken"))
    begin = state(c("_first"), c("typed_key") & ~volume_only, c("_stopped") | (F.trim(F.substr(F.get("_parts", F.lit(0)), F.length("_first") + 1)) != ""))

    def step(acc: Column, at: Column) -> Column:
        piece = F.regexp_replace(F.trim(F.get("_parts", 2 * at)), r"\s*[.,;:]+$", "")
        return F.when(acc["broken"], acc).otherwise(let(piece, lambda x: F.when(x == "", acc).otherwise(let(F.concat(acc["body"], F.get("_parts", 2 * at - 1), x), lambda joined: longer(acc, x, joined)))))

    def longer(acc: Column, piece: Column, joined: Column) -> Column:
        measure = piece.rlike(r"^\d[\d.,]*\s*(?:g|gr|mm|h)$|\b(?:AD|BC|BCE|CE)\b|(?i)^(?:circa|ca?\.)\s")
        whole = piece.rlike(r"^(?:\d|\p{Lu}\p{L}*\s+\d)") & (_body(piece) == piece) & ~measure
        # A volume with its part behind a comma waits for the number, if the volume has that part.
        volume = r"^\s*(?:vol\.?\s*)?([IVX]+)\s*,\s*(\d)\s*$"
        part = c("typed_key") & joined.rlike(volume)
        real = F.concat_ws(" ", F.regexp_extract(joined, volume, 1), F.regexp_extract(joined, volume, 2)).isin(VOLUME_PARTS.split("|"))
        return (
            F.when(~whole, state(acc["body"], F.lit(True), F.lit(True)))
            .when(piece.rlike(r"^\d") & ~acc["ended"] & part, state(F.when(real, joined).otherwise(F.lit("")), F.lit(False), ~real))
            .when(piece.rlike(r"^\d") & ~acc["ended"], state(joined, c("typed_key"), F.lit(False))).otherwise(state(acc["body"], F.lit(True), F.lit(False)))
        )

    more = F.call_function("div", F.size("_parts"), F.lit(2)).cast("int")
    read = F.aggregate(F.slice(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), F.lit(1), more), begin, step)
    return keys.withColumn("_read", read).withColumns({"body": c("_read.body"), "broken": c("_read.broken")})


def _own(name: Column, body: Column, broken: Column, before: Column, span: Column) -> Column:
    """Whether the number behind a key is its own: not a book's year, a sale's lot, an amount, or part of a sentence behind a name."""
    plain = F.rtrim(F.regexp_replace(F.regexp_replace(body, r"\([^()]*\)|(?i)\s+(?:var\.?|passim)$", ""), r"\s*[.,;:]+$", ""))
    number = plain.rlike(rf"^(?![.,]\s)[\s.:#-]*(?:{_KEPT}{_SEP}*)?{_NUMERAL}{_DIGIT}[^\s()]*(?:,\s*\d[^\s()]*)*$")
    year = F.trim(plain).rlike(r"^[\s.:#-]*(?:1[5-9]\d\d|20\d\d|2100)$")
    over = _in(name, "RRC|Crawford|Craw|Cr|Bopearachchi|Bop") | before.rlike(rf"(?i)\b(?:{'|'.join(CUES.split())})(?:\s+(?:by|in|as))?\s*$")
    told = F.regexp_replace(span, r"^\D*\d{4}", "").rlike(rf"^[\s,]*pp?\.|^\s*(?:pl|vol|no|fig|n|ed|ff|op|cit)\.|^\s*\(\d{{4}}\)|^\s+(?:{'|'.join(ARGUED.split())})\b")
    sale = _in(name, HOUSES) & span.rlike(rf"(?i)^{_SEP}*\d[^\s;]*\s*,\s*lot\s+\d")
    amount = _in(name, "Price|Pr") & span.rlike(r"^[\s.:]*\d+(?:[.,']\d+)*\s*(?:[$€£]|(?:EUR|USD|CHF|GBP)(?!\p{L}))")
    surname = _in(name, f"{NAMES}|{PLATES}".replace("|LT", ""))
    person = before.rlike(rf"\b(?:{FIRST_NAMES})\s+$") | before.rlike(r"(?<!\p{L})[ABEFGHJKNOPQRSTUWYZ]\.\s$") | before.rlike(r"\p{L}\p{L}+\s(?:&|and)\s$")
    return ~(_in(name, HOUSES) & person) & (~surname | (number & ~(broken & year))) & ~(year & (over | told)) & ~sale & ~amount


def references(lots: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """id, position, written, reference (catalogue, volume, section, number), cf, variant, typed of every reference.

    positions are those of the text, from 1; a reading that was there before is left out. A single letter is a key
    only in a run with a longer one. A catalogue without types of its own is Other, with its text as the number.
    Null and empty texts have no references; rows that share an id count as one text each only if ids are unique.
    """
    c = F.col
    rows = _spans(_keys(lots, id_, text))
    own = _own(c("name"), c("body"), c("broken"), c("before"), c("span"))
    rows = rows.withColumn("written", F.trim(F.concat("key", F.when(own, c("body")).otherwise(F.lit("")))))
    past = Window.partitionBy("_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run", F.coalesce(F.sum((c("broken") | c("_next_opens")).cast("int")).over(past), F.lit(0)))
    longer = F.max(F.length("key") > 1).over(Window.partitionBy("_id", "_run"))
    rows = rows.withColumn("_long", longer).filter(c("written").rlike(r"\d") & ~c("written").rlike(rf"^\D*{_ORDINAL}\D*$") & ((F.length("key") > 1) | c("_long")))
    ric = _in(c("name"), "RIC|R.I.C")
    variant = c("written").rlike(rf"(?i)\d\s?v(?:ar)?\.?$|\bvar{_NO_WORD}")
    named = F.regexp_extract("written", r"\s*\((\p{Lu}[\p{L}/. ]+)\)", 1)
    remark = r"\s*\((?:[\p{Ll}=][^()]*|R+\d*|\d+(?:st|nd|rd|th) ed[^()]*|\d+\s?[$€£])\)"
    bare = let(_asked(c("written").rlike(r"[Mm]$|[Rr]\.?$"), c("written"), r"(?i)\s+var\.?$|\s+passim$", ""), lambda w: _asked(w.contains("("), w, remark, ""))

    def shown(w: Column) -> Column:
        named = F.when(_in(c("name"), "SG|SGCV|GCV"), F.regexp_replace(w, r"(?<=\d)v(?:ar)?\.?$", "")).when(_in(c("name"), "Cal"), F.regexp_replace(w, r"^(?i:cal)\.?[\s.:#-]*(?:(?:19|20)\d\d\s*[,-]\s*(?=\d))?", "Calicó ")).otherwise(w)
        return let(let(named, lambda x: _asked(~ric & x.contains("("), x, r"\s*\((?!2)\p{Lu}\p{Ll}+(?:[ /]\p{L}+)*\)", "")), lambda x: F.regexp_replace(x, r"\s*[.,;:]+$", ""))

    rows = rows.withColumns({"_ric": ric, "variant": variant, "_named": named, "text": let(bare, shown)})

    def asked(t: Column) -> Column:
        placed = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*\(\p{Lu}[\p{L}/. ]+\)", ""), r"\s+(\S+)$", F.concat(F.lit(" "), F.replace("_named", F.lit("$"), F.lit("")), F.lit(" $1")))
        spaced = lambda x: F.when(x.startswith("R") | x.startswith("Pr"), F.regexp_replace(F.regexp_replace(x, r"^R\.I\.C\.?\s*", "RIC "), r"^(RIC|RRC|Pr)[.-]\s*(?=\d)", "$1 ")).otherwise(x)
        return let(spaced(t), lambda x: F.when(c("_ric") & (c("_named") != ""), placed(x)).otherwise(_asked(x.startswith("Pr "), x, r"^Pr (?=\d)", "Price ")))

    # Only keys with types ask for a reading.
    rows = rows.withColumn("_asked", F.when(c("typed_key"), let(c("text"), asked))).withColumn("_read", F.when(c("typed_key"), parse_reference(c("_asked"))))
    blank = F.lit("")
    made = lambda catalogue, number: F.struct(F.lit(catalogue).alias("catalogue"), blank.alias("volume"), blank.alias("section"), number.alias("number"))
    typed = c("typed_key") & (c("_read.catalogue") != "Other") & ((c("_read.catalogue") != "RIC") | c("_ric"))
    reference = F.when(F.coalesce(typed, F.lit(False)), c("_read")).when(c("_ric"), made("RIC", F.regexp_replace("text", r"^(?:R\.I\.C|RIC)[\s.:#-]*", ""))).otherwise(made("Other", c("text")))
    rows = rows.withColumn("reference", reference)
    again = F.row_number().over(Window.partitionBy("_id", F.replace(F.lower(F.concat_ws("\u0001", *(f"reference.{n}" for n in READING))), F.lit(" "), F.lit(""))).orderBy("k"))
    rows = rows.withColumn("_again", again).filter("_again = 1")
    position = F.row_number().over(Window.partitionBy("_id").orderBy("k"))
    return rows.select(c("_id").alias(id_), position.alias("position"), c("text").alias("written"), "reference", "cf", "variant", (c("reference.catalogue") != "Other").alias("typed"))


def rulers(lots: DataFrame, people: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """id, rulers: the people (person, name: every spelling) that the heading of a text names, in order, once each.

    A heading ends at the first key (with provenance left out), or at what describes a picture. From the left the longest run of words that
    is a name counts; a name of two people names both. Texts that name nobody have no row.
    """
    pictured = r"(?=[hbsorHBSOR])\b(?i:head of|bust of|suckling|standing|seated|obv|rev)\b"
    head = F.regexp_extract(without_provenance(clean(F.col(text))), rf"(?s)^(.*?)(?:{_KEY}|{pictured}|\z)", 1)
    # A full stop parts clauses, so that no name runs across it.
    words = F.regexp_extract_all(head, F.lit(r"\p{L}[\p{L}\p{M}'’/]*|[.;:(\n]"), F.lit(0))
    # Words get their keys once each; a run is the keys of its words. Outer, so that no filter on the runs is inferred, below which they would be made once more.
    rows = lots.select(F.col(id_).alias("_id"), F.transform(words, name_key).alias("_w"))
    run = lambda k, n: F.array_join(F.filter(F.slice("_w", k + 1, n), lambda w: w != ""), " ")
    spelt = people.select(name_key(F.col("name")).alias("_key"), "person").distinct().groupBy("_key").agg(F.array_sort(F.collect_list("person")).alias("_people"))
    # Names are few and sent to where texts are. Runs are made only where a word begins a name.
    begin = F.transform("_w", lambda _, k: F.struct(k.alias("s"), F.get(F.filter(F.slice("_w", k + 1, NAME_WORDS), lambda w: w != ""), F.lit(0)).alias("w")))
    begun = rows.select("_id", "_w", F.explode_outer(begin).alias("r")).select("_id", "_w", "r.s", F.col("r.w").alias("_first"))
    begun = begun.join(F.broadcast(spelt.select(F.substring_index("_key", " ", 1).alias("_first")).distinct()), "_first", "left_semi")
    runs = F.transform(F.sequence(F.lit(1), F.lit(NAME_WORDS)), lambda n: F.struct((F.col("s") + n).alias("e"), run(F.col("s"), n).alias("t")))
    found = begun.select("_id", "s", F.explode_outer(runs).alias("r")).select("_id", "s", "r.e", F.col("r.t").alias("_key"))
    # Only runs that are names are moved, once by their text.
    hits = found.join(F.broadcast(spelt), "_key").select("_id", "s", "e", "_people").repartition("_id").distinct()
    before = Window.partitionBy("_id").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("_taken", F.coalesce(F.max("e").over(before), F.lit(0))).filter("s >= _taken")
    return hits.groupBy(F.col("_id").alias(id_)).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "_people"))), lambda x: x["_people"]))).alias("rulers"))


_ENDS = r"^[\s,.;:–-]+|[\s,.;:–-]+$"
_YEAR = rf"(?=[12])(?<!\b(?i:{_any(NO_YEAR)})\.? ?)(?<!# ?)(?<!n\.?[°º] ?)(?<![\d,])(?:1[6-9]\d\d|20\d\d)(?!\d|[.,]\d)"
_LOT = rf"(?i)(?=[, l]),? ?\b(?:{_any(LOT_WORDS)})\b\.? ?(?:no\.? ?|nr\.? ?|n\.?[°º] ?|n\. ?|# ?)?(\d{{1,6}}[a-z]?)(?![\da-z])"
_NUMBERED = r"(?i), ?(?:n[or]\b\.?|n\.?[°º]|n\.) ?(\d{1,6}[a-z]?)(?![\da-z])"
_LAST = rf"(?i)(?=, \d)(?<={_YEAR}\)?), (\d{{1,6}}[a-z]?)$"
_DATED = rf"(?iu)(?:(?:\b\d{{1,2}}(?:st|nd|rd|th|er)?\.? (?:de )?)?\b{_branched(MONTHS)}\.? (?:de )?(?:\d{{1,2}}(?:st|nd|rd|th)?,? )?|\b\d{{1,2}}[./]\d{{1,2}}[./])$"
_VERB = r"(?iu)(?=[pabe])(?<![\p{L}\d])(?:privately purchased from|purchased privately from|acquired from|purchased from|bought from|erworben\b[^,;()]{0,40}?\bbei(?:\s+(?:der|dem|den))?)\s+"


def provenance(lots: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """id, position, entry, source, year, lot of every owner or sale that a text tells, in order, ENTRIES at most.

    An entry is a sentence that opens with the words of one, or a part of it: parted by semicolons and before another
    ex. The year is the last one written that is no number of a lot or sale; the lot stands behind its
    word, or last behind the year. source is what is left, null if that is no name. Null and empty texts have none.
    Every row is a text of its own, whatever its id.
    """
    c = F.col
    ends = lambda x: F.regexp_replace(x, _ENDS, "")
    owners = lambda t: F.transform(F.filter(_sentences(t), lambda x: _owned(x) | _bought(x)), lambda x: F.when(_bought(x), F.regexp_replace(x, _RUN_ON, "")).otherwise(x))
    told = let(clean(c(text)), lambda t: F.when(_tells(t), owners(t)))
    parts = rf";|,(?= ?[Ee][Xx] )| and (?=[Ee][Xx] )|,(?= (?:(?iu:{_any(PURCHASE)}) from|[Ee]rworben) )|(?<=\.) (?=(?:{_any(f'{PROVENANCE}|{PURCHASE}')})\b)"
    entry = lambda x: ends(F.regexp_replace(ends(x), r"(?i)^(?:provenance|provenienza?|provenienz) ?:? ?", ""))
    aside = r"\s*\((?:(?!(?:part|vol|lot)\b)(?![^()]*(?<!\d)(?:1[6-9]\d\d|20\d\d)(?!\d))\p{Ll}[^()]*|[^()]*(?:[$€£]|\b(?:CHF|EUR|USD|GBP)\b)[^()]*)\)$"

    def bare(x: Column) -> Column:
        left = F.regexp_replace(x, r"(?i)^(?:ex|from|exemplar der|aus(?: der)?|provient de|proviene(?: d[a-z']*)?)\b\.? ?:? ?", "")
        left = ends(F.regexp_replace(left, r"(?i)\s*\((?:there|where|previously|formerly)\s+(?:described|catalogued|cataloged|graded|offered|listed)\b[^()]*\)", ""))
        return ends(F.regexp_replace(left, aside, ""))

    # Entries are counted within their row, so that texts of one id stay apart.
    parted = lambda x: F.split(F.regexp_replace(x, parts, "\u0003"), "\u0003", -1)
    entries = lambda told: let(F.transform(told, parted), lambda x: F.transform(F.flatten(x), entry))
    named = lambda x: F.filter(x, lambda e: e["w"].rlike(r"[\p{L}\d]"))
    read = let(told, lambda t: let(let(entries(t), lambda e: F.transform(e, lambda x: F.struct(x.alias("entry"), bare(x).alias("w")))), named))
    rows = lots.select(c(id_).alias("_id"), F.posexplode(F.slice(read, 1, ENTRIES)).alias("_k", "_e"))
    rows = rows.select("_id", (c("_k") + 1).alias("position"), c("_e.entry").alias("entry"), c("_e.w").alias("_w"))
    # A sale's year and lot together in brackets are written as if they stood without.
    rows = rows.withColumn("_w", F.regexp_replace("_w", rf"(?i)\(([^()]{{0,55}}{_YEAR}), (\d{{1,6}}[a-z]?)\)$", "($1), $2"))
    # Each pattern is tried once: what it finds is set before the rest, behind a mark.
    lot = lambda p: F.regexp_replace("_w", rf"(?s)^(.*?)(?:{p})(.*)$", "$2\u0003$1$3")
    first = lambda p, other: let(lot(p), lambda x: F.when(x.contains("\u0003"), x).otherwise(other))
    rows = rows.withColumn("_m", F.split(first(_LOT, first(_NUMBERED, lot(_LAST))), "\u0003"))
    rows = rows.withColumns({"lot": F.when(F.size("_m") == 2, F.get("_m", F.lit(0))), "_v": F.element_at("_m", -1)})
    rows = rows.withColumn("_v", F.regexp_replace("_v", r"(?i),?\s+in\s+(?=(?:1[6-9]\d\d|20\d\d)(?![\d.,]\d))", " "))
    rows = rows.withColumn("_m", F.split(F.regexp_replace("_v", rf"^(.*)({_YEAR})(.*)$", "$2\u0003$1\u0003$3"), "\u0003"))
    has = F.size("_m") == 3
    rows = rows.withColumns({"year": F.when(has, F.get("_m", F.lit(0))).cast("int"), "_l": F.when(has, F.get("_m", F.lit(1))).otherwise(c("_v")), "_r": F.when(has, F.get("_m", F.lit(2))).otherwise("")})
    bracketed = c("year").isNotNull() & c("_l").rlike(r"\([^()]*$") & c("_r").rlike(r"^[^()]*\)")
    left = F.when(bracketed, F.regexp_replace("_l", r"\([^()]*$", "")).when(c("year").isNotNull(), F.concat(F.left("_l", F.length("_l") - 30), F.regexp_replace(F.right("_l", F.lit(30)), _DATED, ""))).otherwise(c("_l"))
    rows = rows.withColumn("_s", F.concat(left, F.when(bracketed, F.regexp_replace("_r", r"^[^()]*\)", "")).otherwise(c("_r"))))
    source = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c("_s"), "  +", " "), _VERB, ""), r", ?(?=,)", ""), r" +,", ",")
    rows = rows.withColumn("source", F.substring(ends(F.regexp_replace(source, "  +", " ")), 1, 120))
    named = c("source").rlike(r"\p{L}") & ~c("source").rlike(r"(?i)^(?:privately purchased|acquired|purchased|bought|erworben)$")
    return rows.select(c("_id").alias(id_), "position", F.substring("entry", 1, 300).alias("entry"), F.when(named, c("source")).alias("source"), "year", "lot")
