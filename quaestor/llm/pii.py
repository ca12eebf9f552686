"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions find base spans and looser candidates. Labelers vote on each of
them; expectation-maximisation over the counts of vote patterns estimates how reliable
every labeler is, and its soft labels train the classifier that decides on candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: The shapes of the four kinds. A search starts where a run of the first
#: class begins or the last match ended, which changes no match and keeps the search
#: linear; what need not be given back is not.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser shapes: an address spelt out, a national number.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}+)++",
    "phone": r"(?<![0-9A-Za-z+.)-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-]|\.[0-9])",
}
#: What a text must hold for a search to be worth while.
TRIGGER = {"email": "@", "ip": ".", "phone": "+"}
#: Words before a span that speak for its kind, and such as speak for none.
CONTEXT = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|courriel|correo)",
    "ip": r"(?i)(\bip\b|address|host|server|adresse|from)",
    "card": r"(?i)(card|visa|mastercard|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|tel\b|tel\.|call|mobile|fax|telefon|llame|appel)",
}
AGAINST = r"(?i)(isbn|version|order|invoice|serial|token|=|#)[^a-z]{0,4}$"
#: Gazetteers: leading digits of card issuers, common last labels, networks that name no one.
ISSUER = r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5|4[4-9]))"
LABEL = r"(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"
UNROUTED = r"^(0|127|255)\."
NEAR = 32  # code points of context before a span
ROUNDS = 25


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, merge: str, zero: int) -> str:
    """SQL of what merge (of a and x) makes of an array of bigint up to each place.

    Arrays that grow are copied at each step, so that one fold costs the square of its
    length. Here folds run over blocks about as long as there are blocks, and over the blocks.
    """
    none, first = "cast(array() as array<bigint>)", f"cast({zero} as bigint)"
    step = f"element_at(transform(array(s.at), a -> {merge}), 1)"
    fold = lambda block, base, out: f"aggregate({block}, named_struct('at', {base}, 'out', {none}), (s, x) -> named_struct('at', {step}, 'out', concat(s.out, array({out}))), s -> s.out)"
    totals = f"transform(bs, b -> aggregate(b, {first}, (a, x) -> {merge}))"
    joined = f"flatten(zip_with(bs, {fold(totals, first, 's.at')}, (b, base) -> {fold('b', 'base', step)}))"
    blocks = "transform(sequence(1, size(v), cast(ceil(sqrt(size(v))) as int)), k -> slice(v, k, cast(ceil(sqrt(size(v))) as int)))"
    return _let("v", values, f"CASE WHEN size(v) > 0 THEN {_let('bs', blocks, joined)} ELSE {none} END")


SUM, MOST, LEAST = "a + x", "if(a > x, a, x)", "if(a < x, a, x)"


def found_spans(text: str, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """Leftmost matches that do not overlap, as array<struct<s, e, bs, be, m, near, after>>, of those
    for which keep(match) holds; text and pattern are SQL.

    s and e count code points, bs and be bytes, ends exclusive. near is what stands before a
    match, NEAR code points at most and no more than two gaps back; after the next one behind it.
    The pieces between matches give the places, in time that hardly grows faster than the text.
    """
    ends = lambda size: running(f"transform(m, (t, i) -> cast({size}(g[i]) + {size}(t) as bigint))", SUM, 0)
    last = lambda t: f"right({t}, {NEAR})"
    near = last(f"concat({last(_at('g', 'i - 1'))}, {last(_at('m', 'i - 1'))}, {last('g[i]')})")
    after = f"left(concat(left(g[i + 1], 1), left({_at('m', 'i + 1')}, 1)), 1)"
    span = f"named_struct('s', cast(e[i] as int) - length(t), 'e', cast(e[i] as int), 'bs', cast(b[i] as int) - octet_length(t), 'be', cast(b[i] as int), 'm', t, 'near', {near}, 'after', {after})"
    placed = _let("e", ends("length"), _let("b", ends("octet_length"), f"transform(m, (t, i) -> {span})"))
    whole = _let("m", f"regexp_extract_all({text}, r'{pattern}', 0)", _let("g", f"split({text}, r'{pattern}', -1)", placed))
    return F.filter(F.expr(whole), lambda x: keep(x["m"]))


def _at(array: str, place: str) -> str:
    """A text of an array, empty outside of it."""
    return f"coalesce(get({array}, {place}), '')"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _is_card(m: Column) -> Column:
    return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))


def _is_ip(m: Column) -> Column:
    part = "0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _is_ip,
    "card": _is_card,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,bs:int,be:int,m:string,near:string,after:string>>")


def _vote(*cases: tuple[Column, int]) -> Column:
    """The first vote whose condition holds: 1 for, 2 against, 0 abstains."""
    return reduce(lambda rest, case: F.when(F.coalesce(case[0], F.lit(False)), case[1]).otherwise(rest), reversed(cases), F.lit(0))


def _labelled(kind: str, spans: Column, base: bool) -> Column:
    """Each span with the labelers' votes (v) and what the classifier sees (f: length, and
    the characters before and after)."""

    def one(x: Column) -> Column:
        near, before, after, digits = x["near"], F.right(x["near"], F.lit(1)), x["after"], _digits(x["m"])
        gazetteer = {
            "email": _vote((F.regexp_replace(x["m"], r" ?[(\[]dot[)\]] ?", ".").rlike(LABEL), 1)),
            "ip": _vote((x["m"].rlike(UNROUTED), 2)),
            "card": _vote((digits.rlike(ISSUER), 1), (F.lit(True), 2)),
            "phone": _vote((digits.rlike("^(1|3[0-9]|4[0-9])?[2-9][0-9]{8}"), 1)),
        }[kind]
        shape = F.lit(1) if base else _vote((~_luhn(digits), 2)) if kind == "card" else F.lit(0)
        context = _vote((near.rlike(AGAINST), 2), (near.rlike(CONTEXT[kind]), 1))
        glued = _vote((before.rlike(r"[\p{L}\p{N}]") | after.rlike(r"[\p{L}\p{N}]"), 2))
        side = lambda c: F.when(c == "", 0).when(c.rlike(r"[\p{L}\p{N}]"), 1).when(c.rlike(r"\s"), 2).otherwise(3)
        size = F.least(F.floor((x["e"] - x["s"]) / 4), F.lit(9)).cast("int")
        votes = ((shape * 3 + gazetteer) * 3 + context) * 3 + glued
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["bs"].alias("bs"), x["be"].alias("be"), F.lit(base).alias("base"), votes.cast("int").alias("v"), ((size * 4 + side(before)) * 4 + side(after)).cast("int").alias("f"))

    return F.transform(spans, one)


def candidates(documents: DataFrame, column: str = "spans") -> DataFrame:
    """documents with all base spans and candidates of each text in a column; null texts have none."""
    text, read = F.coalesce("text", F.lit("")), "coalesce(text, '')"
    valid_or_loose = {"email": VALID["email"], "phone": lambda m: F.lit(True)}
    lists = []
    for kind in KINDS:
        worth = text.contains(TRIGGER[kind]) if kind in TRIGGER else text.rlike("[0-9]")
        lists.append(_labelled(kind, F.when(worth, found_spans(read, BASE[kind], VALID[kind])).otherwise(_none()), True))
    for kind, hint in (("email", r"[(\[]at[)\]]"), ("phone", "[0-9]{3}[ .-][0-9]{4}")):
        lists.append(_labelled(kind, F.when(text.rlike(hint), found_spans(read, LOOSE[kind], valid_or_loose[kind])).otherwise(_none()), False))
    unproven = lambda m: F.length(_digits(m)).between(13, 19) & ~_luhn(_digits(m))
    lists.append(_labelled("card", F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), found_spans(read, BASE["card"], unproven)).otherwise(_none()), False))
    return documents.withColumn(column, F.concat(*lists))


def ballots(v: int) -> tuple[int, ...]:
    """The labelers' votes: shape, gazetteer, context, neighbours."""
    return v // 27, v // 9 % 3, v // 3 % 3, v % 3


def fit(found: DataFrame, column: str = "spans") -> dict[tuple[int, int, int], float]:
    """Log odds that a candidate is personal data, by (kind, votes, features).

    Only counts of distinct patterns leave the cluster: at most 4 x 81 x 160 of them. In
    each kind, EM treats the labelers as independent given the truth; their reliabilities
    start at 4 to 1. The classifier is a naive Bayes over the features, trained on EM's
    soft labels, that adds to the odds of the votes.
    """
    spans = found.select(F.explode(column).alias("x")).select("x.k", "x.v", "x.f")
    counts = {(r.k, r.v, r.f): r["count"] for r in spans.groupBy("k", "v", "f").count().collect()}
    odds: dict[tuple[int, int, int], float] = {}
    marks = lambda f: (f // 16, f // 4 % 4, f % 4)
    for k in range(len(KINDS)):
        own = {(v, f): n for (kind, v, f), n in counts.items() if kind == k}
        if not own:
            continue
        prior = 0.5
        rate = {(j, y, b): {0: 0.5, 1: 0.4 if y else 0.1, 2: 0.1 if y else 0.4}[b] for j in range(4) for y in (0, 1) for b in (0, 1, 2)}
        soft: dict[tuple[int, int], float] = {}

        def log_odds(v: int) -> float:
            return log(prior / (1 - prior)) + sum(log(rate[j, 1, b] / rate[j, 0, b]) for j, b in enumerate(ballots(v)))

        def chance(x: float) -> float:
            return 1 / (1 + 2.718281828459045 ** -max(-50.0, min(50.0, x)))

        for _ in range(ROUNDS):
            soft = {key: chance(log_odds(key[0])) for key in own}
            yes = sum(own[key] * p for key, p in soft.items())
            total = sum(own.values())
            prior = min(0.99, max(0.01, (yes + 1) / (total + 2)))
            for y, mass in ((1, yes), (0, total - yes)):
                for j in range(4):
                    for b in (0, 1, 2):  # a few imagined votes keep a labeler's direction
                        fixed = {0: 2, 1: 8 if y else 2, 2: 2 if y else 8}[b]
                        seen = sum(own[key] * (p if y else 1 - p) for key, p in soft.items() if ballots(key[0])[j] == b)
                        rate[j, y, b] = (seen + fixed) / (mass + 12)
        sums: dict[tuple[int, int, int], float] = {}
        for key, p in soft.items():
            for j, m in enumerate(marks(key[1])):
                for y, q in ((1, p), (0, 1 - p)):
                    sums[j, m, y] = sums.get((j, m, y), 0.0) + own[key] * q
        whole = {y: sum(own[key] * (p if y else 1 - p) for key, p in soft.items()) for y in (0, 1)}
        size = (10, 4, 4)
        for v, f in own:
            part = sum(log((sums.get((j, m, 1), 0) + 1) / (whole[1] + size[j]) * (whole[0] + size[j]) / (sums.get((j, m, 0), 0) + 1)) for j, m in enumerate(marks(f)))
            odds[k, v, f] = log_odds(v) + part
    return odds


def _apart(kind: int) -> str:
    """SQL of the picked spans of a kind that overlap no base span. Base spans do not overlap one another.

    In order of starts, a span is free if no base span before it reaches behind its start,
    and the next one does not start before its end.
    """
    far = 1 << 40
    of = lambda xs: f"filter({xs}, y -> y.k = {kind})"
    marked = lambda xs, c: f"transform({of(xs)}, y -> named_struct('s', y.s, 'e', y.e, 'c', {c}, 'bs', y.bs, 'be', y.be))"
    reach = running("transform(both, y -> cast(if(y.c, -1, y.e) as bigint))", MOST, -1)
    following = f"reverse({running(f'reverse(transform(both, y -> cast(if(y.c, {far}, y.s) as bigint)))', LEAST, far)})"
    free = _let("r", reach, _let("n", following, "filter(both, (y, i) -> y.c AND r[i] <= y.s AND n[i] >= y.e)"))
    both = _let("both", f"array_sort(concat({marked('_pii_base', 'false')}, {marked('_pii_picked', 'true')}))", free)
    apart = f"CASE WHEN size({of('_pii_base')}) > 0 AND size({of('_pii_picked')}) > 0 THEN {both} ELSE {marked('_pii_picked', 'true')} END"
    return f"transform({apart}, y -> named_struct('k', {kind}, 's', y.s, 'e', y.e, 'bs', y.bs, 'be', y.be))"


def _slim(x: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in ("k", "s", "e", "bs", "be")))


def decided(found: DataFrame, column: str, odds: dict[tuple[int, int, int], float], threshold: float) -> DataFrame:
    """found with _pii_base and _pii_added, of a column of candidates: arrays of struct<k, s, e, bs, be> by kind and start.

    Base spans always stay. A candidate is added if its log odds are above the threshold,
    more labelers speak for it than against, and it overlaps no base span of its kind.
    """
    good = sorted(key for key, x in odds.items() if x > threshold and ballots(key[1]).count(1) > ballots(key[1]).count(2))
    code = lambda x: (x["k"] * 81 + x["v"]) * 160 + x["f"]
    chosen = F.array(*(F.lit((k * 81 + v) * 160 + f) for k, v, f in good)).cast("array<int>")
    base = F.array_sort(F.transform(F.filter(column, lambda x: x["base"]), _slim))
    picked = F.transform(F.filter(column, lambda x: ~x["base"] & F.array_contains(chosen, code(x))), _slim)
    # Card candidates come from the same search as base cards, so only the others can overlap.
    parts = ", ".join([*(_apart(KINDS.index(k)) for k in LOOSE), f"filter(_pii_picked, y -> y.k = {KINDS.index('card')})"])
    added = F.expr(f"CASE WHEN size(_pii_picked) = 0 THEN _pii_picked ELSE array_sort(concat({parts})) END")
    return found.withColumns({"_pii_base": base, "_pii_picked": picked}).withColumn("_pii_added", added).drop("_pii_picked")


def spans(documents: DataFrame, threshold: float = 0.0) -> DataFrame:
    """doc_id, base and added of every document; repeated rows are searched one by one.

    Null and empty texts hold nothing; an empty table gives no rows.
    """
    found = cut(candidates(documents.select("doc_id", "text")).select("doc_id", "spans"))
    return decided(found, "spans", fit(found), threshold).select("doc_id", F.col("_pii_base").alias("base"), F.col("_pii_added").alias("added"))


def written(list_: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(list_, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"], x["e"])), ",")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (with the added ones)."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return spans(documents).select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(documents: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The documents with each span in the text replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, named by the longest of them. Null texts stay null; all columns stay
    as they were. The texts are searched twice, so that no copy of them is kept.
    """
    found = candidates(documents, "_pii")
    judged = decided(found, "_pii", fit(found, "_pii"), threshold)
    # Spans in order; where one begins behind all before it, a union begins.
    ordered = "array_sort(transform(concat(_pii_base, _pii_added), y -> named_struct('s', y.s, 'e', y.e, 'k', y.k, 'bs', y.bs, 'be', y.be)))"
    heads = "transform(filter(transform(o, (y, i) -> if(i = 0 OR y.s >= get(r, i - 1), i, NULL)), i -> i IS NOT NULL), i -> i)"
    own = "slice(o, i + 1, coalesce(get(h, j + 1), size(o)) - i)"
    longest = f"array_max(transform({own}, y -> named_struct('w', y.e - y.s, 's', -y.s, 'k', -y.k))).k"
    union = f"named_struct('bs', o[i].bs, 'be', array_max(transform({own}, y -> y.be)), 'k', -{longest})"
    unions = _let("r", running("transform(o, y -> cast(y.e as bigint))", MOST, 0), _let("h", heads, f"transform(h, (i, j) -> {union})"))
    cut_at = lambda begin, end: f"cast(substring(data, {begin} + 1, {end} - {begin}) as string)"
    tag = f"array({', '.join(repr(f'<{k}>') for k in KINDS)})"
    pieces = f"transform(u, (y, i) -> concat({cut_at('coalesce(get(u, i - 1).be, 0)', 'y.bs')}, {tag}[y.k]))"
    written_out = f"concat(array_join({pieces}, ''), {cut_at('element_at(u, -1).be', 'octet_length(data)')})"
    clean = F.expr(_let("o", ordered, f"CASE WHEN size(o) > 0 THEN {_let('u', unions, _let('data', 'cast(text as binary)', written_out))} ELSE text END"))
    return judged.withColumn("text", F.when(F.size("_pii") > 0, clean).otherwise(F.col("text"))).select(*documents.columns)
