"""Secret scans by assignment-aware lexing.

A text is read as source or configuration: heads (a name and an assignment sign) are found,
and what follows is lexed into literals and names. Every pair of a name and its value goes
into a table of constants; a name used as a value stands for what was assigned to it last (or,
where nothing was yet, first thereafter). Joined strings and strings with names inside
stand for all their parts, as a graph of shared nodes, so that long chains stay linear.
A literal is scored by the most telling name it reaches, alone or through constants, and
by its own variety; from ``THRESHOLD`` on it is a span. Three base kinds of plain patterns
are found besides, whatever the syntax.

Texts are independent: one Python column function over Arrow batches, no shuffle, no state
between rows. Patterns never give back and heads cannot start inside a bare value, so the
work is linear in the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfall.llm import pii
from emberfall.llm.words import bound_batches

THRESHOLD = 0.5
LEAST_LENGTH = 6
#: This many bits of variety make a literal as telling as can be.
FULL_BITS = 64.0

# The base kinds; their order is the order of equal starts.
BASE = ["assign", "access", "hex"]
METHOD = ["literal"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

# What a name tells, by the words it has next to each other: weight from 0 to 1.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.8, "passcode": 0.9, "pin": 0.5,
    "secret": 1.0, "credential": 0.9, "credentials": 0.9, "creds": 0.9, "apikey": 1.0, "token": 0.9, "bearer": 0.8,
    "auth": 0.7, "authorization": 0.8, "jwt": 0.8, "dsn": 0.6, "salt": 0.7, "key": 0.6, "cookie": 0.6, "signature": 0.5,
    "api key": 1.0, "access key": 0.95, "secret key": 1.0, "private key": 1.0, "signing key": 1.0, "encryption key": 1.0,
    "master key": 1.0, "auth token": 1.0, "access token": 1.0, "refresh token": 1.0, "session key": 0.9,
    "account key": 0.95, "connection string": 0.8, "client secret": 1.0, "shared key": 0.9, "deploy key": 0.9,
}
# Parts of words that every telling name has: a text without any has no telling name.
STEMS = ["pass", "pwd", "pin", "secret", "cred", "key", "token", "bearer", "auth", "jwt", "dsn", "salt", "cookie", "signature", "connection"]
# Last words of names that speak of a secret without holding it.
ABOUT = set(
    "file path dir directory name url uri host id type kind length len size count field label hint prompt policy regex"
    " pattern format expiry expires ttl timeout age algorithm algo limit max min column header prefix version location"
    " required enabled valid error message placeholder title description text input element button index usage".split()
)
PUBLIC = {"public", "max", "min", "num", "n", "total", "primary", "foreign", "sort", "partition", "row", "cache"}
PLACEHOLDERS = re.compile(
    r"(?i)(?:x+|\*+|\.+|-+|_+|#+|0+|none|null|nil|undefined|true|false|yes|no|todo|tbd|fixme|change.?me|example\w*|sample\w*"
    r"|dummy\w*|placeholder|redacted|removed|hidden|your.*|my.?(?:password|secret|token|key)|insert.*|enter.*"
    r"|string|number|integer|boolean|optional|required|password|secret|token|passwd)"
)

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+(?:(?:[.-]|->|::)[A-Za-z_][A-Za-z0-9_]*+)*+"
_STRING = r"(?:[rRbBuUfF]{1,2}+)?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\[\s\S])*+`)"
# A head: name (plain, quoted, or indexed), perhaps a type, and an assignment sign.
HEAD = re.compile(
    rf"""(?<![A-Za-z0-9_$.:=/\\@%+-])
    (?:(?P<define>(?:define|setenv|putenv|set|setProperty|put)\(\s*+)?(?P<quote>["'])(?P<quoted>[A-Za-z_][A-Za-z0-9_ .-]{{0,99}}+)(?P=quote)
      |(?P<flag>--?)?(?P<name>{_NAME})(?:\[["'](?P<item>[A-Za-z_][A-Za-z0-9_.-]{{0,99}}+)["']\])?)
    (?:[ \t]*+:[ \t]*+&?[A-Za-z_][A-Za-z0-9_.]*+(?:[\[<][^\]>\n]{{0,60}}+[\]>])?(?=[ \t]*+=[^=])|[ \t]++(?:string|String|str)(?=[ \t]*+=[^=]))?
    (?:[ \t]*+(?P<sign>:=|=>|\?=|\|\|=|\+=|=(?![=~])|:(?![:/]))|(?<=["'])[ \t]*+(?P<comma>,)|(?P<gap>[ \t]++)(?=[^\s=:]))
    [ \t]*+""",
    re.VERBOSE | re.ASCII,
)
TAG = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,99}+)>(?P<value>[^<>\n]++)</(?P=name)>", re.ASCII)
STRING = re.compile(_STRING)
REFERENCE = re.compile(rf"\$\{{({_NAME})\}}|\$\(({_NAME})\)|\$({_NAME})|\*([A-Za-z_][A-Za-z0-9_-]*+)|({_NAME})(?![A-Za-z0-9_(\"'`])", re.ASCII)
CALL = re.compile(rf"""(?:(?:new|await)[ \t]++)?{_NAME}(?:\[["'][^"'\]\n]{{0,99}}+["']\]|\()""", re.ASCII)
ANCHOR = re.compile(r"&([A-Za-z_][A-Za-z0-9_-]*+)[ \t]++", re.ASCII)
BARE = re.compile(r"[^\s\"'`,;=&?<>(){}\[\]|\\#]++={0,2}+(?![^\s,;&)}\]>])")
JOIN = re.compile(r"[ \t]*+(?:\+|\.\.?|\|\|)[ \t]*+")
NEXT_STRING = re.compile(r"[ \t]++(?=[\"'])")
REST = re.compile(r"[ \t]*+(?:[,;][ \t]*+)?(?:(?:#|//)[^\n]*+)?(?=\r?\n|\r|\Z)")
# A line may put these before a name.
LEAD = re.compile(r"(?:^|[\r\n])[ \t]*+(?:(?:export|set|const|let|var|final|static|private|public|protected|readonly|ENV|ARG|-)[ \t]++)*+\Z")
INSIDE = re.compile(rf"\$\{{({_NAME})\}}|\{{\{{[ \t]*+({_NAME})[ \t]*+\}}\}}|\{{({_NAME})\}}|\$({_NAME})|%\(({_NAME})\)s|#\{{({_NAME})\}}", re.ASCII)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
QUOTES = re.compile(r"^[rRbBuUfF]{0,2}(\"\"\"|'''|[\"'`])")


def words_of_name(name: str) -> list[str]:
    """Lower-case words of a name in snake, kebab, dotted or camel case."""
    return [w.lower() for w in WORDS.findall(name)]


def name_weight(name: str) -> float:
    """How telling a name is: 0 if it is of nothing secret, or only about a secret."""
    words = words_of_name(name)
    if not words or words[-1] in ABOUT or PUBLIC & set(words):
        return 0.0
    pairs = [" ".join(x) for x in zip(words, words[1:])]
    return max(NAME_WEIGHTS.get(w, 0.0) for w in [*words, *pairs, "".join(words)])


def own_name(name: str) -> str:
    """A name without the object it belongs to, where that is the own one."""
    return name.removeprefix("self.").removeprefix("this.").lstrip("$")


def variety(literal: str) -> float:
    """From 0 to 1: the bits that its characters' frequencies give a literal, up to FULL_BITS;
    0 for short ones and placeholders."""
    if len(literal) < LEAST_LENGTH or PLACEHOLDERS.fullmatch(literal):
        return 0.0
    n = len(literal)
    bits = -sum(c * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / FULL_BITS)


class Node:
    """A value: a literal (its span) or what its parts stand for."""

    __slots__ = ("start", "end", "parts", "weight", "name")

    def __init__(self, start: int = -1, end: int = -1, parts: list[Node] | None = None) -> None:
        self.start, self.end, self.parts = start, end, parts or []
        self.weight, self.name = 0.0, ""


class Reader:
    """One text: its constants, and the literals that telling names reach."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[str, Node] = {}
        self.open: dict[str, Node] = {}
        self.literals: list[Node] = []
        self.weights: dict[str, float] = {}
        self.targets: list[tuple[float, str, Node]] = []

    def reference(self, name: str) -> Node:
        """What a name stands for here; a name without a value waits for its first one."""
        name = own_name(name)
        if name in self.known:
            return self.known[name]
        return self.open.setdefault(name, Node())

    def literal(self, start: int, end: int) -> Node:
        """A literal and the names inside it."""
        inner = self.text[start:end]
        found = [m for m in INSIDE.finditer(inner)] if "$" in inner or "{" in inner or "%(" in inner else []
        node = Node(start, end, [self.reference(next(g for g in m.groups() if g)) for m in found])
        if sum(m.end() - m.start() for m in found) == end - start and found:
            node.start = node.end = -1  # nothing of its own
        else:
            self.literals.append(node)
        return node

    def value(self, at: int, bare: bool, lined: bool) -> tuple[Node | None, int]:
        """The value that starts at ``at`` and where it ends; None if it is no constant.
        ``bare``: words without quotes count, to the end of the line if ``lined``."""
        text, parts, anchor = self.text, [], ANCHOR.match(self.text, at)
        if anchor:
            at = anchor.end()
        while True:
            quoted = STRING.match(text, at)
            if m := quoted:
                mark = QUOTES.match(m.group()).group()
                parts.append(self.literal(at + len(mark), m.end() - len(mark.lstrip("rRbBuUfF"))))
                at = m.end()
            elif CALL.match(text, at):
                return (Node(parts=parts) if parts else None), at
            elif (m := REFERENCE.match(text, at)) and not self._bare_goes_on(m, bare, lined):
                parts.append(self.reference(next(("*" + g if k == 3 else g) for k, g in enumerate(m.groups()) if g)))
                at = m.end()
            elif bare and not parts and (m := BARE.match(text, at)) and (not lined or REST.match(text, m.end())):
                parts.append(self.literal(at, m.end()))
                at = m.end()
            else:
                break
            joined = JOIN.match(text, at) or (quoted and NEXT_STRING.match(text, at))
            if not joined:
                break
            at = joined.end()
        node = parts[0] if len(parts) == 1 else Node(parts=parts) if parts else None
        if anchor and node:
            self.define("*" + anchor.group(1), node)
        return node, at

    def _bare_goes_on(self, m: re.Match, bare: bool, lined: bool) -> bool:
        """Whether what looks like a name is a bare literal: it goes on past the name, or
        nothing of that name is known."""
        if not bare or m.group(5) is None:
            return False
        word = BARE.match(self.text, m.start())
        if not word or (lined and not REST.match(self.text, word.end())):
            return False
        return word.end() > m.end() or own_name(m.group(5)) not in self.known

    def define(self, name: str, node: Node) -> None:
        name = own_name(name)
        self.known[name] = node
        if waiting := self.open.pop(name, None):
            waiting.parts.append(node)

    def pair(self, name: str, node: Node) -> None:
        """A name and its value: a constant, and a target if the name is telling."""
        if name not in self.weights:
            self.weights[name] = name_weight(name)
        if self.weights[name]:
            self.targets.append((self.weights[name], name, node))

    def read(self) -> None:
        text, entry = self.text, None
        for m in HEAD.finditer(text):
            quoted, sign = m.group("quoted"), m.group("sign")
            name = quoted or m.group("name")
            if m.group("comma") and not m.group("define") or m.group("gap") and not m.group("flag") or m.group("define") and not m.group("comma"):
                continue
            if m.group("item"):
                name = f"{name}.{m.group('item')}"
            before = text[max(0, m.start() - 80) : m.start()]
            lined = LEAD.search(before if m.start() > 80 else "\n" + before) is not None and not m.group("flag")
            bare = lined or bool(m.group("flag")) or (sign == "=" and before[-1:] in ("?", "&"))
            node, _ = self.value(m.end(), bare and not quoted or (lined and sign == ":"), lined)
            if node is None:
                continue
            if sign == "+=" and own_name(name) in self.known:
                node = Node(parts=[self.known[own_name(name)], node])
            self.pair(name, node)
            self.define(name, node)
            # {"name": "X", "value": "..."}: X is the name.
            if name in ("name", "key") and node.start >= 0:
                entry = text[node.start : node.end]
            elif name == "value" and entry:
                self.pair(entry, node)
                self.define(entry, node)
            if name not in ("name", "key"):
                entry = None
        if "</" in text:
            for m in TAG.finditer(text):
                self.pair(m.group("name"), self.literal(*m.span("value")))

    def spans(self) -> list[tuple[int, int, float, str]]:
        """(start, end, score, name) of literals that telling names reach."""
        # The most telling target goes first, so that each node is visited once.
        for weight, name, node in sorted(self.targets, key=lambda x: -x[0]):
            stack = [node]
            while stack:
                x = stack.pop()
                if not x.weight:
                    x.weight, x.name = weight, name
                    stack += x.parts
        found = {}
        for x in self.literals:
            if x.weight:
                own = variety(self.text[x.start : x.end])
                score = round(x.weight * (0.5 + 0.5 * own), 4) if own else 0.0
                if score >= THRESHOLD and score > found.get((x.start, x.end), (0.0, ""))[0]:
                    found[x.start, x.end] = (score, x.name)
        return [(a, b, *said) for (a, b), said in sorted(found.items())]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) of the base kinds: leftmost, not overlapping within a kind."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def secrets_of(text: str | None) -> list[dict]:
    """All spans of one text, sorted by start, then kind."""
    if not text:
        return []
    low = text.lower()
    found = [(a, rank, b, BASE[rank], 1.0, "") for a, rank, b in base_spans(text, low)]
    if any(s in low for s in STEMS):
        reader = Reader(text)
        reader.read()
        found += [(a, len(BASE), b, METHOD[0], score, name) for a, b, score, name in reader.spans()]
    names = ("start", "rank", "end", "kind", "score", "name")
    return [dict(zip(names, x)) for x in sorted(found)]


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double,name:string>>"


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with an array column ``into`` of (start, rank, end, kind, score, name), sorted by
    start, then kind: assign, access, hex, literal. ``name`` is the name that a literal
    reaches, empty for the base kinds, whose score is 1.

    Starts and ends are code points, ends exclusive; a literal's span is within its quotes.
    A NULL or empty text has no spans. Rows are independent: repeated rows and ids need
    nothing special, an empty table stays empty, other columns stay, and a column named as
    ``into`` is replaced.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([secrets_of(t) for t in texts], dtype="object")

    return docs.withColumn(into, found(F.col(text_col)))


def redact(text: str, spans: str) -> Column:
    """The text with every secret replaced by its kind; see ``pii.redact``."""
    return pii.redact(text, spans)
