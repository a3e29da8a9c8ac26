"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

Every kind has one pattern, one validator, a score and words that speak for it when they
stand close by: such a word adds to the score. Base kinds stay whatever their score; a
span of the method's kinds needs ``LEAST_SCORE``, so that kinds whose check proves little
need a word beside them. All of it is SQL expressions: the matches of a text are one
array, the pieces between them another, and positions are running sums of their lengths,
in blocks, so that a text with very many matches costs little more a match. The patterns start
only where a run of their first characters starts (or the last match ended) and their
repetitions never give back, so that no text makes them slow or deep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfall.llm.runs import between, blocks_of, let, most_before, sums_before
from emberfall.llm.words import LOWER, UPPER

CONTEXT_REACH = 40
# Two matches of any kind are at least three characters apart, so that so many cover the reach.
CONTEXT_MATCHES = 14
SCORE_STEP = 0.25
LEAST_SCORE = 0.5


def digits_of(match: str) -> str:
    return f"regexp_replace({match}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether the last digit is the check digit of the others."""
    value = "IF(i % 2 = 0, INT(d), IF(INT(d) < 5, INT(d) * 2, INT(d) * 2 - 9))"
    return f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> {value}), 0, (a, b) -> a + b) % 10 = 0"


def card_fits(match: str) -> str:
    digits = digits_of(match)
    return f"IF(length({digits}) BETWEEN 12 AND 19, {luhn(digits)}, false)"


def ip_fits(match: str) -> str:
    """Every part is 255 at most, leading zeros aside."""
    parts = rf"transform(split({match}, r'\.'), p -> ltrim('0', p))"
    return f"forall({parts}, p -> IF(length(p) <= 3, coalesce(try_cast(p AS INT), 0) <= 255, false))"


def phone_fits(match: str) -> str:
    return f"length({digits_of(match)}) BETWEEN 9 AND 15"


def iban_fits(match: str) -> str:
    """15 to 34 characters whose number, country and check digits last, leaves 1 by 97."""
    plain = f"replace({match}, ' ', '')"
    turned = f"concat(substring({plain}, 5, 34), substring({plain}, 1, 4))"
    codes = f"transform(split({turned}, ''), c -> IF(c BETWEEN 'A' AND 'Z', ascii(c) - 55, ascii(c) - 48))"
    rest = f"aggregate({codes}, 0, (r, v) -> (IF(v > 9, r * 100, r * 10) + v) % 97)"
    return f"IF(length({plain}) BETWEEN 15 AND 34, {rest} = 1, false)"


def ssn_fits(match: str) -> str:
    """A number that can have been given out: no part is zero, the first is not 666 or from 900 on."""
    area = f"substring({match}, 1, 3)"
    return (
        f"({area} NOT IN ('000', '666') AND {area} < '900'"
        f" AND substring({match}, 5, 2) <> '00' AND substring({match}, 8, 4) <> '0000')"
    )


def always(match: str) -> str:
    return "true"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``gate``: a pattern every text with a match has. ``fits``: SQL
    over the match. Patterns hold no quotes."""

    name: str
    gate: str
    pattern: str
    fits: Callable[[str], str]
    score: float
    context: str


# Lengths of account numbers and the countries that have them.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """Account numbers, compact or in fours: of a known country as long as its numbers are, so
    that what follows is not swallowed; others, and shorter ones, as far as they go."""
    known = []
    for n, countries in IBAN_COUNTRIES.items():
        fours, rest = divmod(n - 4, 4)
        tail = f" [A-Z0-9]{{{rest}}}" if rest else ""
        known.append(
            f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{fours}}}{tail})"
        )
    return "|".join(known) + r"|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"


# The four base kinds come first; their order is the order of equal starts.
BASE = [
    Kind(
        "email",
        "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        always,
        0.75,
        "mail|contact|write|reply|address",
    ),
    Kind(
        "ip",
        r"[0-9]\.[0-9]",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ip_fits,
        0.5,
        "ip|host|server|address|login|client",
    ),
    Kind("card", "[0-9]", r"[0-9](?:[ -]?[0-9])++", card_fits, 0.75, "card|visa|credit|payment|debit|account"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", phone_fits, 0.5, "phone|call|tel|mobile|fax|contact"),
]
METHOD = [
    Kind(
        "iban",
        "[A-Z]{2}[0-9]{2}",
        iban_pattern(),
        iban_fits,
        0.75,
        "iban|bank|account|transfer|konto",
    ),
    # Three groups of digits are common: only a word beside them tells.
    Kind(
        "ssn",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        ssn_fits,
        0.25,
        "ssn|social|security|taxpayer|tax id",
    ),
]


SPANS = "ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING, score: DOUBLE>>"


def kind_spans(text: str, kind: Kind, rank: int) -> str:
    """Confirmed spans of one kind with their scores; an empty array without any."""
    none, pattern = f"CAST(array() AS {SPANS})", f"r'{kind.pattern}'"
    # A match, what stands before it, what stands after it, its place among the matches.
    parts = (
        "transform(l_m, (m, i) -> named_struct('match', m, 'before', get(l_p, i), 'after', get(l_p, i + 1), 'i', i))"
    )
    starts = sums_before("transform(l_x, x -> length(x.before) + length(x.match))")
    fit = f"filter(l_x, x -> {kind.fits('x.match')})"
    head = lambda c: f"substring({c}, 1, {CONTEXT_REACH})"
    tail = lambda c: f"substring({c}, -{CONTEXT_REACH}, {CONTEXT_REACH})"
    # Other matches are looked at only where they stand within the reach.
    earlier = f"transform(slice(l_x, greatest(x.i - {CONTEXT_MATCHES}, 0) + 1, least(x.i, {CONTEXT_MATCHES})), y -> {tail('concat(y.before, y.match)')})"
    later = f"transform(slice(l_x, x.i + 2, {CONTEXT_MATCHES}), y -> {head('concat(y.match, y.after)')})"
    left = f"IF(length(x.before) >= {CONTEXT_REACH}, {tail('x.before')}, {tail(f'concat(array_join({earlier}, {chr(39) * 2}), x.before)')})"
    right = f"IF(length(x.after) >= {CONTEXT_REACH}, {head('x.after')}, {head(f'concat(x.after, array_join({later}, {chr(39) * 2}))')})"
    near = f"translate(concat({left}, ' ', {right}), '{UPPER}', '{LOWER}') RLIKE r'(?:^|[^a-z])(?:{kind.context})'"
    start = "(get(l_at, x.i) + length(x.before))"
    scored = (
        f"transform({fit}, x -> named_struct('start', {start}, 'rank', {rank}, 'end', {start} + length(x.match),"
        f" 'kind', '{kind.name}', 'score', {kind.score}D + IF({near}, {SCORE_STEP}D, 0D)))"
    )
    if rank >= len(BASE):
        scored = f"filter({scored}, s -> s.score >= {LEAST_SCORE}D)"
    spans = let("l_p", f"split({text}, {pattern}, -1)", let("l_x", parts, let("l_at", starts, scored)))
    met = let("l_m", f"regexp_extract_all({text}, {pattern}, 0)", f"IF(size(l_m) > 0, CAST({spans} AS {SPANS}), {none})")
    return f"IF({text} RLIKE r'{kind.gate}', {met}, {none})"


def find_spans(docs: DataFrame, text_col: str = "text", kinds: list[Kind] | None = None, into: str = "pii") -> DataFrame:
    """``docs`` with an array column ``into`` of (start, rank, end, kind, score), sorted by
    start, then kind in the order given. The score is the kind's, more if one of its words
    stands within 40 characters.

    Starts and ends are code points, ends exclusive. Matches of a kind are leftmost and
    do not overlap; spans of different kinds may. A NULL or empty text has no spans. Rows
    are independent: repeated rows and ids need nothing special, an empty table stays
    empty, other columns stay, and a column named as ``into`` is replaced.
    """
    kinds = BASE + METHOD if kinds is None else kinds
    text = f"coalesce(`{text_col}`, '')"
    parts = [kind_spans(text, kind, rank) for rank, kind in enumerate(kinds)]
    return docs.withColumn(into, F.expr(f"array_sort(concat({', '.join(parts)}))"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: str, spans: str) -> Column:
    """The text (a column's name) with each span replaced by its kind in angle brackets; of
    overlapping spans the first (then the longer reach) hides the rest."""
    before = between("l_b", "get(l_r, i)", "s.start")
    shown = f"transform({spans}, (s, i) -> IF(s.start >= get(l_r, i), concat({before}, '<', s.kind, '>'), ''))"
    ends = f"transform({spans}, s -> s.end)"
    last = between("l_b", f"array_max({ends})", f"length({text})")
    hidden = let("l_b", blocks_of(text), let("l_r", most_before(ends), f"concat(array_join({shown}, ''), {last})"))
    return F.expr(f"IF(size({spans}) > 0, {hidden}, {text})")
