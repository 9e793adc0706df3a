"""Personal data by weak supervision, in SQL functions only.

Candidates of four kinds (email, ip, card, phone) are the matches of a strict pattern and of
a looser one (spelled-out addresses, defanged numbers, other separators, local numbers).
Four labelers vote -1, 0 or 1 on each: a pattern check (digit counts, ranges, check digits), a gazetteer
(top-level domains, address ranges, card prefixes, dialling codes), the words before it, and its edges.
Expectation-maximisation over the counted vote patterns of all documents estimates each labeler's
reliability per kind, and with it how likely each pattern is a true span.  These chances
are the soft labels of the final span classifier, naive Bayes over the span's shape, which also scores
votes it has seldom seen.  Strict matches that pass their check always stay; the
classifier adds loose ones that pass theirs.

Vote patterns, shapes and weights are bounded by the number of votes and features, not by the data.
Patterns use possessive repetition and run starts, so that long runs of one character take
linear time.

Defined cases: a null text counts as empty and has no spans; without candidates nothing is added; repeated
rows and null identifiers are treated like any other; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import keyed
from endsight.operators.scale import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Chance from which the classifier adds a loose candidate; rounds of estimation.
ADD_FROM, ROUNDS = 0.9, 30
#: Matches handled at once.
CHUNK = 256
#: Characters before a span in which words are looked for.
BEFORE = 40

# A local part starts where its run of characters starts, or where the last match ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Cheap tests that hold for every text with a match.
GATES = {
    "email": "contains(_t, '@')",
    "ip": "_t rlike '[0-9][.][0-9]'",
    "card": "_t rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'",
    "phone": "contains(_t, '+')",
}
LOOSE_GATES = {
    "email": "contains(_t, '[at]') or contains(_t, '(at)')",
    "ip": "contains(_t, '[.]')",
    "card": "_t rlike '[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}'",
    "phone": "_t rlike '[0-9]{3}[ .-][0-9]{4}'",
}
#: Gazetteers.
TOP_LEVEL = "com org net edu gov mil int io co uk de fr es it nl ch at be pl pt se no dk fi eu us ca au jp cn in br ru info biz dev app".split()
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Words before a span that speak for its kind, and for none.
CUES = {
    "email": "mail|contact|write|schreib|courriel|correo",
    "ip": "host|server|address|login|from|adresse|servidor",
    "card": "card|visa|pay|credit|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|ruf|appel|llam",
}
AGAINST = "version|isbn|issn|order|serial|total|page|sha|hash|token|key"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


_FOUND = "array<struct<k:int,s:int,e:int,v:string,l:string,r:string>>"


def found(kind: int, pattern: str, gate: str) -> str:
    """SQL: matches of ``pattern`` with start, end, and the text around them.

    Splitting at the pattern gives what lies between the matches, so running lengths give places.
    """
    p = _quoted(pattern)
    zipped = f"zip_with(regexp_extract_all(_t, {p}, 0), split(_t, {p}, -1), (m, b) -> named_struct('m', m, 'b', b))"
    # the last entry is the text after the last match: it ends the span before it
    step = (
        "named_struct('at', a.at + length(x.b) + coalesce(length(x.m), 0), "
        "'out', concat(a.out, array(named_struct("
        f"'k', {kind}, 's', int(a.at + length(x.b)), 'e', int(a.at + length(x.b) + coalesce(length(x.m), 0)), 'v', x.m, "
        f"'l', right(x.b, {BEFORE}), 'r', left(x.b, 1)))))"
    )
    start = f"named_struct('at', bigint(at), 'out', cast(array() as {_FOUND}))"
    length = "aggregate(c, 0L, (n, x) -> n + length(x.b) + coalesce(length(x.m), 0))"
    # stretches of CHUNK entries keep the growing arrays short
    chunks = f"transform(sequence(0, (size(y) - 1) div {CHUNK}), i -> slice(y, i * {CHUNK} + 1, {CHUNK}))"
    starts = f"aggregate(transform(z, c -> {length}), array(0L), (a, n) -> concat(a, array(a[size(a) - 1] + n)))"
    pieces = f"flatten(zip_with(z, slice(p, 1, size(z)), (c, at) -> aggregate(c, {start}, (a, x) -> {step}, a -> a.out)))"
    scan = _let("y", zipped, _let("z", chunks, _let("p", starts, pieces)))
    # r still holds the text before a span's own start: take it from the next entry
    shifted = (
        f"transform(array({scan}), o -> transform(slice(o, 1, size(o) - 1), (x, i) -> "
        "named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v, 'l', x.l, 'r', o[i + 1].r)))[0]"
    )
    return f"if({gate}, {shifted}, cast(array() as {_FOUND}))"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, int(substr(d, -i, 1)), "
    "int(substr('0246813579', int(substr(d, -i, 1)) + 1, 1)))) % 10 = 0"
)


def valid(kind: str) -> str:
    """SQL: whether span ``x`` passes the check of its kind."""
    if kind == "email":
        return "true"
    if kind == "ip":
        octet = "length(ltrim('0', o)) <= 3 and coalesce(try_cast(ltrim('0', o) as int), 0) <= 255"
        return f"forall(regexp_extract_all(x.v, '[0-9]+', 0), o -> {octet})"
    if kind == "card":
        return _let("d", _DIGITS, f"if(length(d) between 14 and 19, {_LUHN}, false)")
    return f"length({_DIGITS}) between 10 and 15"


def gazetteer(kind: str) -> str:
    """SQL: the gazetteer's vote on span ``x``."""
    if kind == "email":
        known = ", ".join(f"'{t}'" for t in TOP_LEVEL)
        return f"if(lower(regexp_extract(x.v, '([A-Za-z0-9-]+)$', 1)) in ({known}), 1, -1)"
    if kind == "ip":
        first = "coalesce(try_cast(regexp_extract(x.v, '^([0-9]{1,3})', 1) as int), 0)"
        return f"if({first} between 1 and 223 and {first} <> 127, 1, -1)"
    if kind == "card":
        return "if(left(x.v, 1) in ('3', '4', '5', '6'), 1, -1)"
    known = ", ".join(f"'{t}'" for t in DIALLING)
    code = "regexp_extract(x.v, '^[+]([0-9]+)', 1)"
    return (
        f"case when left(x.v, 1) <> '+' then if(regexp_extract(x.v, '([0-9])', 1) between '2' and '9', 1, -1) "
        f"when left({code}, 1) in ({known}) or left({code}, 2) in ({known}) then 1 else -1 end"
    )


def judged(kind: str) -> str:
    """SQL: span ``x`` with its check, votes and shape."""
    own, against = _quoted(f"(?i)({CUES[kind]})"), _quoted(f"(?i)({AGAINST})")
    edge = "if(right(x.l, 1) rlike '[A-Za-z0-9]' or x.r rlike '[A-Za-z0-9]', -1, 1)"
    context = f"case when x.l rlike {own} then 1 when x.l rlike {against} then -1 else 0 end"
    left = "case when x.l = '' then 'start' when right(x.l, 1) rlike '[A-Za-z0-9]' then 'glued' when right(x.l, 1) rlike '\\\\s' then 'blank' else 'other' end"
    after = "case when x.r = '' then 'end' when x.r rlike '[A-Za-z0-9]' then 'glued' when x.r rlike '\\\\s' then 'blank' else 'other' end"
    return (
        f"named_struct('k', x.k, 's', x.s, 'e', x.e, 'ok', ok, "
        f"'votes', array(if(ok, 1, -1), {gazetteer(kind)}, {context}, {edge}), "
        f"'shape', array(concat('left ', {left}), concat('right ', {after}), "
        f"concat('size ', least(8, length(x.v) div 4)), concat('digits ', least(10, length({_DIGITS}) div 2))))"
    )


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _strict, _loose``: judged spans of every document, strict ones and the loose ones apart from them."""
    rows = keyed(docs, doc_id, text).selectExpr("_id", "coalesce(_text, '') as _t")

    def all_of(patterns: dict[str, str], gates: dict[str, str]) -> str:
        parts = [
            f"transform({found(i, patterns[k], gates[k])}, x -> "
            + _let("ok", valid(k), judged(k))
            + ")"
            for i, k in enumerate(KINDS)
        ]
        return f"concat({', '.join(parts)})"

    both = rows.selectExpr("_id", f"{all_of(STRICT, GATES)} as _strict", f"{all_of(LOOSE, LOOSE_GATES)} as _wide")
    apart = "filter(_wide, w -> not exists(_strict, b -> b.ok and b.s < w.e and w.s < b.e))"
    return both.selectExpr("_id", "_strict", f"{apart} as _loose")


def estimate(spans: DataFrame) -> DataFrame:
    """``_kind, _votes, _chance``: how likely a span of these votes is true, by expectation-maximisation.

    Each kind is one row with its vote patterns (at most 81) and their counts; the rounds are
    an aggregate over that row.
    """
    patterns = (
        spans.groupBy("_kind", "_votes")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_kind")
        .agg(F.sort_array(F.collect_list(F.struct("_votes", F.col("_n").cast("double").alias("n")))).alias("_p"))
    )
    total = "aggregate(z, 0D, (a, x) -> a + x.p.n * {share})"
    sums = (
        "transform(sequence(0, 11), q -> named_struct("
        "'yes', (aggregate(z, 1D, (a, x) -> a + if(x.p._votes[q div 3] = q % 3 - 1, x.p.n * x.r, 0D)) / (yes + 3)), "
        "'no', (aggregate(z, 1D, (a, x) -> a + if(x.p._votes[q div 3] = q % 3 - 1, x.p.n * (1 - x.r), 0D)) / (no + 3))))"
    )
    odds = (
        "aggregate(sequence(0, 3), ln((yes + 1) / (no + 1)), (a, k) -> "
        "a + ln(w[k * 3 + y._votes[k] + 1].yes / w[k * 3 + y._votes[k] + 1].no))"
    )
    again = f"transform(_p, y -> 1 / (1 + exp(-({odds}))))"
    step = _let("z", "zip_with(_p, r, (p, s) -> named_struct('p', p, 'r', s))",
        _let("yes", total.format(share="x.r"), _let("no", total.format(share="(1 - x.r)"), _let("w", sums, again))))
    start = "transform(_p, y -> 1 / (1 + exp(-1.5D * aggregate(y._votes, 0, (a, v) -> a + v))))"
    chances = f"aggregate(sequence(1, {ROUNDS}), {start}, (r, i) -> {step})"
    return patterns.selectExpr("_kind", f"zip_with(_p, {chances}, (p, r) -> named_struct('v', p._votes, 'c', r)) as _all").selectExpr(
        "_kind", "inline(_all)"
    ).selectExpr("_kind", "v as _votes", "c as _chance")


def train(judged_spans: DataFrame) -> DataFrame:
    """``_kind, _feature, _weight``: log odds of each shape feature; the empty feature is the prior."""
    spans = judged_spans.selectExpr("explode(concat(_strict, _loose)) as x").selectExpr(
        "x.k as _kind", "x.votes as _votes", "x.shape as _shape"
    )
    counted = spans.groupBy("_kind", "_votes", "_shape").agg(F.count(F.lit(1)).alias("_n"))
    chances = estimate(spans)
    soft = counted.join(F.broadcast(chances), ["_kind", "_votes"])
    each = soft.selectExpr("_kind", "_n * _chance as _yes", "_n * (1 - _chance) as _no", "explode(concat(array(''), _shape)) as _feature")
    sums = each.groupBy("_kind", "_feature").agg(F.sum("_yes").alias("_yes"), F.sum("_no").alias("_no"))
    whole = sums.where("_feature = ''").selectExpr("_kind", "_yes as _all_yes", "_no as _all_no")
    weight = (
        "if(_feature = '', ln((_yes + 1) / (_no + 1)), "
        "ln((_yes + 0.5) / (_all_yes + 5)) - ln((_no + 0.5) / (_all_no + 5)))"
    )
    return sums.join(F.broadcast(whole), "_kind").selectExpr("_kind", "_feature", f"{weight} as _weight")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, add_from: float = ADD_FROM) -> DataFrame:
    """``_id, _base, _spans``: the strict spans that pass, and all spans; arrays of (s, k, e) by start, then kind."""
    judged_spans = cut_lineage(candidates(docs, doc_id, text))
    # at most kinds x features rows
    weights = {f"{r[0]}:{r[1]}": float(r[2]) for r in train(judged_spans).collect()}
    table = F.create_map(*[F.lit(x) for pair in ({"": 0.0} | weights).items() for x in pair])
    chance = (
        "1 / (1 + exp(-aggregate(x.shape, coalesce(_w[concat(x.k, ':')], 0D), "
        "(a, f) -> a + coalesce(_w[concat(x.k, ':', f)], 0D))))"
    )
    plain = "named_struct('s', x.s, 'k', x.k, 'e', x.e)"
    split = judged_spans.withColumn("_w", table).selectExpr(
        "_id",
        f"array_sort(transform(filter(_strict, x -> x.ok), x -> {plain})) as _base",
        f"transform(filter(_loose, x -> x.ok and {chance} >= {add_from}), x -> {plain}) as _more",
    )
    return split.selectExpr("_id", "_base", "array_sort(concat(_base, _more)) as _spans")


def listed(column: str) -> str:
    """SQL: spans as kind:start:end, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({column}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
