"""The grade a lot's description states, read within the JVM.

Every word of a grade is set off in one pass over the text; each becomes a struct with what
stands on either side of it, in windows of fixed width. Then a fold over these decides, in
order, which are grades: by kind a word needs a capital, an opening or a closing edge. Grades
joined by a range or by the sides of a coin are one statement, worth its lower end; the last
statement counts, or the last one behind a label. Windows are taken from a block of words and the
text around them, so that costs grow with the length of a text, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, plain, squash

#: Characters that a column of a result page reads of a text; EDGE of them on either side of a word, CITATION before one.
LIMIT, EDGE, CITATION = 3000, 24, 160
#: Words whose windows are taken from one text, and words of it before them and behind. A word and what parts it from the next
#: are two characters or more, so that BEFORE of them hold CITATION, and BEHIND what is read behind a word and the next one.
BLOCK, BEFORE, BEHIND = 64, 96, 32
#: Fixed values from here on: the buckets in order, and the words that mean each, by kind.
BUCKETS = ("Fine and below", "VF", "EF", "AU/Mint State")
ABBREVIATION = ("gF aF VG", "VF gVF aVF GVF NVF nVF", "EF XF gEF aEF GEF NEF nEF", "FDC UNC AU Fdc aUNC AUNC")
NAME = ("", "Very Fine|très très beau", "Extremely Fine", "Mint State|Uncirculated|Brilliant Uncirculated|Stempelglanz|fleur de coin|fior di conio")
BARE = ("Fine|Fair", "", "", "")
MARK = ("MB TB BC sge", "ss BB TTB MBC ZF s.sch. s.sch", "vz SPL SUP EBC PR Spl", "st MS SC BU Stgl prfr Prfr S/C")
MARK_OF_TWO = ("", "", "", "Gem MS|Gem BU")
PRAISE = ("molto bello|très beau|beau", "sehr schön|bellissimo|zeer fraai", "vorzüglich|superbe|splendide|splendido|prachtig", "prägefrisch")
IN_RANGE = ("s F", "", "", "")
IN_RANGE_NAME = ("schön|fraai", "", "", "")
QUALIFIERS = "Near Nearly Almost About Good Choice Ch Superb Nice Toned otherwise sonst Fast Gutes Knapp Buon Presque Casi NGC PCGS"
FINE_QUALIFIERS = "About Good Near Nearly Almost Choice"
SIDES = "obverse obv reverse rev avers revers av rs vs kz dritto rovescio"
CLOSING_WORDS = "and for with to bis but though or details obv obverse rev reverse revers avers rs av dritto rovescio"
UNITS, WEIGHTS, CURRENCIES = "mm cm gr g h", "mm cm grams gram gr gm g", "USD EUR GBP CHF AUD CAD HKD JPY SEK DKK NOK CZK PLN HUF"
GOLD_COINS = "solidus aureus tremissis semissis stater nomisma histamenon hyperpyron siliqua miliarense denarius antoninianus sestertius dupondius follis tetradrachm didrachm drachm obol quinarius dinar"
PLACES = "field exergue ex left right below above beneath under monogram control controls throne wreath Feld Abschnitt campo esergo champ"
REMARKS = "original bella bello pátina patina brillo rara escasa atractiva"
CITED_KEYS = "RIC RSC RPC RRC BMCRE BMCRR BMC Crawford Craw Cr Sydenham Syd Cohen C Sear SGCV SG SNG HGC Price SC CPE Calicó Calico Depeyrot LRBC DOC MIB SB"


def _any(words: str, by: str = " ") -> str:
    """Words as alternatives, longer ones first."""
    quoted = ("".join("\\" + c if c in "./" else c for c in w) for w in words.split(by))
    return "|".join(sorted(quoted, key=len, reverse=True))


_END, _BEGIN = r"(?![\p{L}\d])", r"(?<![\p{L}\d])"
_AS_WRITTEN = {w: k for words in (ABBREVIATION, MARK, IN_RANGE) for k, group in enumerate(words) for w in group.split()} | {w: k for k, group in enumerate(MARK_OF_TWO) for w in group.split("|") if w}
_ANY_CASE = {w: k for words in (NAME, BARE, PRAISE, IN_RANGE_NAME) for k, group in enumerate(words) for w in group.split("|") if w}
_WORDS = "|".join(sorted([*("".join("\\" + c if c in "./" else c for c in w) for w in _AS_WRITTEN), *(f"(?iu:{w})" for w in _ANY_CASE)], key=lambda w: len(w.removeprefix("(?iu:")) - w.count("\\") - (1 if w.startswith("(?iu:") else 0), reverse=True))
_QUALIFIER = rf"(?:(?iu:{_any(QUALIFIERS)})[.,]?\s+|[qQ]\.?|m(?=\p{{Lu}}))"


def _openings(words: list[str], letters: int = 3) -> str:
    """What any of the words begins with, letter by letter, so that most words of a text are told at a glance."""
    following: dict[str, list[str]] = {}
    for w in words:
        following.setdefault(w[:1].lower(), []).append(w[1:])
    quoted = lambda c: "\\" + c if c in "./" else c
    return "|".join((quoted(c) + (f"(?:{_openings(rest, letters - 1)})" if letters > 1 else "")) if c else r"(?!\p{L})" for c, rest in sorted(following.items()))


_OPENS = rf"(?=[qQ]|m\p{{Lu}}|(?iu:{_openings([*_AS_WRITTEN, *_ANY_CASE, *QUALIFIERS.split()])}))"
_CANDIDATE = rf"{_BEGIN}{_OPENS}((?:{_QUALIFIER}){{0,2}}?)({_WORDS})(\+*)(★?(?:\s?\d{{1,2}}(?:/\d{{1,2}})?)?){_END}"
_NUMBER = r"\d{1,3}(?:[.,]\d{1,3})?"
_ESTIMATE = rf"(?:US\$|[$€£¥]|(?:{_any(CURRENCIES)})(?!\p{{L}}))\s?\d"
_CLOSING_MARKS = ("", *".;,:+-)/!\"“”*★")
_CLOSES = rf"(?iu)^(?:\s[-–(+&/]|\s(?:à|{_any(CLOSING_WORDS)}){_END}|\s{_NUMBER}\s?(?:{_any(UNITS)}){_END}|\s{_ESTIMATE})"
_SIDE = rf"(?:{_any(SIDES)})\.?"
_SIDE_BEFORE = rf"(?iu){_BEGIN}{_SIDE}\s+$"
_MEASURED = rf"(?:\d[.,]\d+\s?(?:g|gr|gm)\.?|\d\s?mm\.?|{_BEGIN}(?:g|gr|gm)\.?\s?\d{{1,3}}[.,]\d{{1,3}})\)?(?:\s[-–])?\s+$"
_LABEL = r"(?iu)(?:Erhaltung|Grade|Condition|Conservaci[oó]n)\s*:?\s*$"
_RANGE = r"(?iu)^\s*(?:\+\s*)?(?:[-–/]|to|bis|à)\s*$"
_AND = r"(?iu)^\s+(?:and|und|e|et|y)\s+$"
_SIDE_BETWEEN = rf"(?iu)^[\s,.]*{_SIDE}[\s,.]*$"
_METAL = rf"^[,.]?\s?\(?\s?{_NUMBER}\s?(?:{_any(WEIGHTS)}){_END}"
_COIN = rf"(?iu){_BEGIN}(?:{_any(GOLD_COINS)})\.?[\s,]*$"
_QUOTED = rf"(?iu){_BEGIN}(?:(?:described|catalogued|cataloged|offered|sold|listed)\s+as|(?:there|where|previously|formerly)\s+graded|graded\s+there)\s*[\"“']?\s*$"
_STYLE = rf"^(?:\s+and{_END}|[-\s][Ss]tyle{_END}|,\s+\p{{Ll}}+[- ]\p{{Ll}}+)"
_CITED = rf"\((?:cf\.\s*)?(?:{_any(CITED_KEYS)})\.?\s?[IVX\d][^()]*\)\s*,\s*$"
_SPANISH = rf"(?iu)(?:\d\s?(?:g|gr|mm)|(?<!\p{{L}})(?:{_any(REMARKS)}))\.\s*$"
_SLAB = r"\b(?:NGC|PCGS)\b"


def _kinds() -> tuple[dict[str, tuple[str, int]], dict[str, tuple[str, int]]]:
    """Kind and bucket of each word: as written, and in any case."""
    tables = (("range", IN_RANGE, " "), ("abbreviation", ABBREVIATION, " "), ("mark", MARK, " "), ("mark", MARK_OF_TWO, "|")), (("range", IN_RANGE_NAME, "|"), ("bare", BARE, "|"), ("praise", PRAISE, "|"), ("name", NAME, "|"))
    written, lower = ({w: (kind, k) for kind, table, by in group for k, words in enumerate(table) for w in words.split(by) if w} for group in tables)
    return written, {w.lower(): of for w, of in lower.items()}


def _told(token: Column) -> Column:
    """Kind and bucket of a word, in one look."""
    told = lambda of: F.struct(F.lit(of[0]).alias("kind"), F.lit(of[1]).alias("bucket"))
    written, lower = (F.create_map(*(x for w, of in table.items() for x in (F.lit(w), told(of)))) for table in _kinds())
    return F.coalesce(F.try_element_at(written, token), F.try_element_at(lower, F.lower(token)), F.struct(F.lit("name").alias("kind"), F.lit(None).cast("int").alias("bucket")))


def _piece(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


def _pieces(text: Column) -> Column:
    """What stands between the words a grade may be, and these, in turn; a word is its qualifiers, itself, its plus signs and what
    a slab prints behind it, parted by marks. Of what lies between two, only what windows reach is left."""
    marked = F.split(F.regexp_replace(text, _CANDIDATE, "\u0001$1\u0002$2\u0002$3\u0002$4\u0001"), "\u0001", -1)
    ends = lambda p: F.concat(F.left(p, F.lit(3 * EDGE)), F.right(p, F.lit(CITATION + EDGE)))
    return F.transform(marked, lambda p: F.when(F.length(p) > 4 * EDGE + CITATION, ends(p)).otherwise(p))


def _words_of(pieces: Column, begin: Column) -> Column:
    """Every word of some pieces: where it starts, how far from the one before, its qualifiers, itself, its plus signs and what a
    slab prints behind it. begin says whether a text begins with these pieces."""
    number = F.call_function("div", F.size(pieces), F.lit(2)).cast("int")
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("begun"), F.array().cast("array<struct<start:int,far:int,first:boolean,quals:string,token:string,plus:string,slab:string>>").alias("words"))

    def add(acc: Column, k: Column) -> Column:
        start, said = acc["end"] + F.length(F.get(pieces, 2 * k)), F.get(pieces, 2 * k + 1)
        word = let(F.split(said, "\u0002", -1), lambda p: F.struct(start.alias("start"), (start - acc["begun"]).alias("far"), (begin & (start == 0)).alias("first"), F.get(p, F.lit(0)).alias("quals"), F.get(p, F.lit(1)).alias("token"), F.get(p, F.lit(2)).alias("plus"), F.get(p, F.lit(3)).alias("slab")))
        # Three marks part what is said.
        return F.struct((start + F.length(said) - 3).alias("end"), start.alias("begun"), F.concat(acc["words"], F.array(word)).alias("words"))

    return F.aggregate(F.slice(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1), F.lit(1), number), none, add, lambda acc: acc["words"])


def _edged(text: Column, words: Column) -> Column:
    """Words with what precedes and follows them."""

    def edges(x: Column) -> Column:
        before = _piece(text, F.greatest(x["start"] - EDGE, F.lit(0)), x["start"])

        def ended(b: Column) -> Column:
            named = (b.contains("NGC") | b.contains("PCGS")) & F.element_at(F.split(b, "[.;:(]", -1), -1).rlike(_SLAB)
            slabbed = ((x["quals"] != "") & x["quals"].rlike(_SLAB)) | named | (x["first"] & x["token"].isin("MS", "Gem MS"))
            core = x["start"] + F.length(x["quals"]) + F.length(x["token"])
            # Spaces are single here, so what ends in a comma and white space ends in a comma or a comma and a space.
            cited = F.rtrim(b).endswith(",") & _piece(text, F.greatest(x["start"] - CITATION, F.lit(0)), x["start"]).rlike(_CITED)

            def read(slabbed: Column) -> Column:
                end = core + F.length(x["plus"]) + F.when(slabbed, F.length(x["slab"])).otherwise(0)
                return F.struct(
                    x["start"].alias("start"), end.alias("end"), x["far"].alias("far"), x["first"].alias("first"), x["quals"].alias("quals"), x["token"].alias("token"), slabbed.alias("slabbed"), b.alias("before"),
                    F.substring(text, end + 1, EDGE).alias("tail"), F.substring(text, core + 1, 2 * EDGE).alias("rest"), cited.alias("cited"),
                    _told(x["token"]).alias("told"),
                )

            return let(slabbed, read)

        return let(before, ended)

    return F.transform(words, edges)


def _judged(text: Column, words: Column) -> Column:
    """The first BLOCK words with what their edges, and the word behind each, say of them."""

    def judge(x: Column, k: Column) -> Column:
        # What a label or a quotation ends in, before any pattern is tried.
        hint = F.upper(F.substring(F.rtrim(x["before"], F.lit(" :\"“'")), -2, 2)).isin("NG", "DE", "ON", "ÓN", "AS", "ED", "RE")
        return let(hint, lambda h: let(F.struct((h & x["before"].rlike(_LABEL)).alias("label"), (h & x["before"].rlike(_QUOTED)).alias("quoted")), lambda b: read(x, F.get(words, k + 1), b["label"], b["quoted"])))

    def read(x: Column, later: Column, label: Column, quoted: Column) -> Column:
        """What only words of some kinds are asked for is null for the others."""
        kind, gap = x["told"]["kind"], _piece(text, x["end"], later["start"])
        beside = F.coalesce((later["start"] - x["end"]) <= EDGE, F.lit(False))
        before, tail, token, quals = x["before"], x["tail"], x["token"], x["quals"]
        first = x["first"]
        metal = (token == "AU") & ~x["slabbed"] & (tail.rlike(_METAL) | (before.rlike(rf"(?iu){_BEGIN}gold\s*\(\s*$") & tail.startswith(")")) | before.rlike(_COIN))
        side, measured = before.endswith(" ") & before.rlike(_SIDE_BEFORE), before.endswith(" ") & before.rlike(_MEASURED)
        opened = first | before.rlike(r"[.;,:(/]\s*$") | side | measured
        cited = (quals == "") & x["cited"]
        control = (before.endswith("(") & x["rest"].startswith(")")) | before.rlike(r"(?<![\p{L}\d])\p{Ll}+:\s*$") | before.rlike(rf"(?iu){_BEGIN}(?:{_any(PLACES)})\.?\s*,\s*$")
        described = before.rlike(r"(?<![\p{L}\d])\p{Ll}\p{L}*\.\s*$") & ~((token == "S/C") & before.rlike(_SPANISH))
        alone = first | (before.rlike(r"\.\s*$") & ~side & ~described) | (quals != "") | label
        senate = token.isin("SC", "S/C")
        return F.struct(
            x["far"].alias("far"), (x["end"] - x["start"]).alias("end"), before.alias("before"), kind.alias("kind"), x["told"]["bucket"].alias("bucket"), label.alias("label"), quoted.alias("quoted"),
            (metal | ((token == "PR") & x["slabbed"])).alias("no_grade"), (F.substring(tail, 1, 1).isin(*_CLOSING_MARKS) | tail.rlike(_CLOSES) | (beside & gap.rlike(_AND))).alias("closed"),
            F.when(kind.isin("bare", "mark"), opened).alias("opened"), F.when(kind.isin("name", "bare"), F.concat(quals, token).rlike(r"\p{Lu}") | cited).alias("capital"), (quals != "").alias("qualified"), metal.alias("metal"),
            F.when(kind == "bare", quals.rlike(rf"(?iu)^(?:{_any(FINE_QUALIFIERS)})\b")).alias("fine_qualified"), F.when(kind == "bare", x["rest"].rlike(_STYLE)).alias("style"), F.when(kind == "mark", control).alias("control"),
            senate.alias("senate"), F.when(senate, tail.rlike(r"^\s[-–(]")).alias("aside"), F.when(senate, alone).alias("alone"),
            F.when(kind == "praise", first | before.rlike(r"[.;,:/]\s*$") | measured).alias("clause"), F.when(kind == "range", F.coalesce(beside & (later["told"]["kind"] != "range") & (gap.rlike(_RANGE) | gap.rlike(_SIDE_BETWEEN)), F.lit(False))).alias("opens_range"),
        )

    return F.transform(F.slice(words, 1, BLOCK), judge)


def _judged_words(pieces: Column) -> Column:
    """The judged words of a text, block by block."""
    number = F.call_function("div", F.size(pieces), F.lit(2)).cast("int")
    blocks = F.sequence(F.lit(0), F.call_function("div", F.greatest(number, F.lit(1)) - 1, F.lit(BLOCK)).cast("int"))

    def block(b: Column) -> Column:
        begin, own = F.greatest(b * BLOCK - BEFORE, F.lit(0)), F.least(b * BLOCK, F.lit(BEFORE))
        around = F.slice(pieces, 2 * begin + 1, 2 * (own + BLOCK + BEHIND) + 1)
        text = lambda p: F.replace(F.array_join(p, ""), F.lit("\u0002"), F.lit(""))
        # With the next block's first word, which the last one is judged by.
        words = lambda p: F.slice(_words_of(p, begin == 0), own + 1, F.lit(BLOCK + 1))
        return let(around, lambda p: let(text(p), lambda t: let(_edged(t, words(p)), lambda e: _judged(t, e))))

    return let(F.transform(blocks, block), F.flatten)


def _counted(words: Column) -> Column:
    """The number of the bucket that counts, by a fold over the words in order. Ends are counted from where the word at hand starts."""
    none = F.lit(None).cast("int")
    state = lambda end, quoted, now, labelled, kept: F.struct(end.alias("end"), quoted.alias("quoted"), now.alias("now"), labelled.alias("labelled"), kept.alias("kept"))
    start = state(none, none, none, F.lit(False), none)

    def step(acc: Column, x: Column) -> Column:
        return let(state(acc["end"] - x["far"], acc["quoted"] - x["far"], acc["now"], acc["labelled"], acc["kept"]), lambda acc: told(acc, x))

    def told(acc: Column, x: Column) -> Column:
        near = lambda end: F.coalesce(end >= -EDGE, F.lit(False))
        behind = lambda end: F.right(x["before"], -end)
        since, gap = behind(acc["quoted"]), behind(acc["end"])
        quoted = x["quoted"] | (near(acc["quoted"]) & (since.rlike(_RANGE) | since.rlike(_AND)))
        between = F.struct((near(acc["end"]) & gap.rlike(_RANGE)).alias("signed"), (near(acc["end"]) & gap.rlike(_AND)).alias("and"), (near(acc["end"]) & gap.rlike(_SIDE_BETWEEN)).alias("sided"))

        def read(b: Column) -> Column:
            joined = b["signed"] | b["and"] | b["sided"]
            grade = (
                F.when(x["kind"] == "abbreviation", F.lit(True))
                .when(x["kind"] == "name", x["capital"] | b["signed"] | x["qualified"])
                .when(x["kind"] == "bare", (x["capital"] | b["signed"]) & ~x["style"] & (x["opened"] | joined | x["fine_qualified"]))
                .when(x["kind"] == "mark", (x["opened"] | joined | x["qualified"]) & ~x["control"] & (~x["senate"] | (~x["aside"] & (x["alone"] | joined))))
                .when(x["kind"] == "praise", x["clause"] | b["signed"])
                .otherwise(b["signed"] | b["sided"] | x["label"] | x["opens_range"])
            )
            separate = state(x["end"], acc["quoted"], x["bucket"], x["label"], F.when(acc["labelled"], acc["now"]).otherwise(acc["kept"]))
            return F.when(~grade, acc).when(joined, state(x["end"], acc["quoted"], F.least(acc["now"], x["bucket"]), acc["labelled"], acc["kept"])).otherwise(separate)

        passed = state(acc["end"], x["end"], acc["now"], acc["labelled"], acc["kept"])
        return F.when(x["metal"], acc).when(quoted, passed).when(x["no_grade"] | ~x["closed"], acc).otherwise(let(between, read))

    return F.aggregate(words, start, step, lambda acc: F.when(acc["labelled"], acc["now"]).otherwise(F.coalesce(acc["kept"], acc["now"])))


def grade_of(description: Column, limit: int | None = LIMIT) -> Column:
    """The bucket of the grade that a description states; null where it states none, or is null or empty. A text is read up to limit
    characters, whole without one."""
    unmarked = F.replace(F.replace(F.coalesce(description, F.lit("")), F.lit("\u0001"), F.lit(" ")), F.lit("\u0002"), F.lit(" "))
    clean = let(unmarked, lambda t: F.when(plain(t), F.trim(t)).otherwise(squash(t)))
    read = clean if limit is None else F.substring(clean, 1, limit)
    number = let(read, lambda t: let(_pieces(t), lambda p: _counted(_judged_words(p))))
    return F.get(F.array(*map(F.lit, BUCKETS)), number)
