"""Secrets in texts: three fixed patterns, and literals assigned to names that sound secret.

The second part lexes source and configuration syntax into name-literal pairs. A right side may
be a quoted literal, a bare word, a name bound before in the same text, or several of them added
together; bound names stand for their literals, so a secret put into `a` and handed on by
`client_secret = a` is found where it is written. A declared type between name and literal
(`a: str = "..."`) is skipped, and `a = b = "..."` binds both. Literals may have a prefix or
triple quotes. Besides assignments a name gets a value as a key in brackets (`env["NAME"] = ...`), as
the first argument of a call (`define("NAME", "...")`), by a setter (`setName("...")`) and as an
element (`<name>...</name>`). Pairs are scored by what their name says and by how much the literal
looks like a generated value.

A sum refers to its parts and is scored from counts, so time and memory follow the text even
where lines double a value again and again. A literal has the score of the first binding that
reports it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.stages import in_arrow

#: Fixed patterns, in the order that breaks ties of equal starts. The minimum lengths drop
#: matches; they do not change where a match begins.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "pair")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

_NAME = re.compile(r"(?<![\w$.-])[A-Za-z_$][\w$.-]*+", re.A)
_BOUND = re.compile(r"""(?:["'][\x20\t]*\]|["'])?[\x20\t]*(?::=|=>|=(?![=~])|:(?!:))[\x20\t]*""", re.A)
#: A type with brackets, marks of references and alternatives, up to the sign that assigns.
_TYPED = re.compile(
    r"""[?!]?[\x20\t]*:[\x20\t]*(?:[&*]++(?:'\w++[\x20\t]++)?(?:mut[\x20\t]++)?)?"""
    r"""(?:[A-Za-z_$][\w.$]*+(?:::\w++)*+(?:\[[^\[\]\n=]*+(?:\[[^\[\]\n=]*+\][^\[\]\n=]*+)*+\]"""
    r"""|<[^<>\n=]*+(?:<[^<>\n=]*+>[^<>\n=]*+)*+>|\?)*+[\x20\t]*+(?:\|[\x20\t]*+(?=[A-Za-z_$])|(?==)))++"""
    r"""=(?![=~>])[\x20\t]*""", re.A)
_PREFIX = r"(?:[bBfFrRuULtT]{1,2}|u8|[@$]{1,2})?"
_TRIPLE = re.compile(_PREFIX + r'''(?:"""(.*?)"""|\'\'\'(.*?)\'\'\')''', re.S)
_QUOTED = re.compile(_PREFIX + r'''(?:"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|\'([^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+)\')''')
_ASSIGNS = re.compile(r"=(?!>)")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@%^&*-]++", re.A)
#: After a quoted name that is a call's first argument; after the name of a setter; an element.
_ARGUMENT = re.compile(r"""["'][\x20\t]*,[\x20\t]*(?=[bBfFrRuULtT]{0,2}["'])""")
_SETTER = re.compile(r"""\([\x20\t]*(?=[bBfFrRuULtT]{0,2}["'])""")
_SETS = re.compile(r"(?:^|[.$_])(?:set|with|add|put)(?=[A-Z_])[\w$-]*$", re.A)
_ELEMENT = re.compile(r">[\x20\t]*([^<>\n]*?)[\x20\t]*</")
_PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
#: What parts of a name say, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "credential": 0.9,
    "credentials": 0.9, "token": 0.9, "bearer": 0.9, "apikey": 1.0, "auth": 0.7, "private": 0.6, "api": 0.4,
    "access": 0.4, "key": 0.4, "signing": 0.5, "encryption": 0.5, "salt": 0.6, "dsn": 0.6, "session": 0.5,
}
HARMLESS = frozenset("count counts size length len limit max min name names field type url uri path file id index "
                     "public expires expiry ttl header prefix label policy".split())
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|change_?me.*|your[_-].*|example.*|test|todo|"
                          r"<.*>|\$\{?.*|%.*%|password|secret|token)$")
LEAST_SCORE = 0.5


def name_score(name: str) -> float:
    """How surely a value bound to this name is secret: 1 less the product of what its parts leave
    open. A last part like `count` or `path` says the value is about a secret, not one."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    rest = 1.0
    for part in parts:
        rest *= 1 - SENSITIVE.get(part, 0.0)
    return 1 - rest


class Value:
    """A literal, by its place in the text, or a sum of values."""

    __slots__ = ("span", "parts", "about", "told")

    def __init__(self, span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()):
        self.span, self.parts, self.about, self.told = span, parts, None, False

    def measured(self, text: str) -> tuple[Counter, str, str]:
        """Counts of its characters, its first `HEAD` characters and its last one."""
        waiting = [self]
        while waiting:
            top = waiting[-1]
            open_ = [p for p in top.parts if p.about is None]
            if open_:
                waiting += open_
                continue
            waiting.pop()
            if top.about is not None:
                continue
            if top.span:
                own = text[slice(*top.span)]
                top.about = Counter(own), own[:HEAD], own[-1:]
                continue
            counts, head, tail = Counter(), "", ""
            for part in top.parts:
                counts.update(part.about[0])
                head = head if len(head) >= HEAD else (head + part.about[1])[:HEAD]
                tail = part.about[2] or tail
            top.about = counts, head, tail
        return self.about

    def literals(self) -> Iterator[tuple[int, int]]:
        """Places of its literals that no binding has reported before."""
        waiting = [self]
        while waiting:
            top = waiting.pop()
            if top.told:
                continue
            top.told = True
            if top.span:
                yield top.span
            waiting += top.parts[::-1]


HEAD = 64


def value_score(counts: Counter, head: str, tail: str) -> float:
    """From 0 to 1: length and entropy of a literal; placeholders and prose score 0."""
    size = sum(counts.values())
    if size < 8 or " " in counts:
        return 0.0
    if PLACEHOLDERS.match(head) if size <= HEAD else _LONG_PLACEHOLDERS.match(head) or head[0] + tail in ("<>", "%%"):
        return 0.0
    bits = -sum(c / size * math.log2(c / size) for c in counts.values())
    mixed = (any(c.isdigit() for c in counts) + any(c.isalpha() for c in counts)) / 2
    return min(1.0, bits / 3.0) * mixed


#: Placeholders that may go on; those of one repeated character have no entropy.
_LONG_PLACEHOLDERS = re.compile(r"(?i)change_?me|your[_-]|example|\$")


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """`name, value` of each binding of a text, in order."""
    bound: dict[str, Value] = {}
    at, names, expected = 0, [], -1  # names before `expected` wait for the literal at its end
    while found := _NAME.search(text, at):
        at = found.end()
        if found.start() != expected:
            names = []
        names.append(found[0])
        typed = _TYPED.match(text, at)
        operator = typed or _BOUND.match(text, at) or _handed(text, found)
        if not operator:
            if text[found.start() - 1 : found.start()] == "<" and (element := _ELEMENT.match(text, at)):
                yield found[0], Value(element.span(1))
            continue
        pos, parts, plain = operator.end(), [], False
        inner = None  # what is in triple quotes is lexed as well
        while True:
            if quoted := (triple := _TRIPLE.match(text, pos)) or _QUOTED.match(text, pos):
                begin, end = quoted.span(1 if quoted[1] is not None else 2)
                if triple:
                    inner = begin if inner is None else inner
                    found_text = text[begin:end]
                    begin, end = begin + len(found_text) - len(found_text.lstrip()), begin + len(found_text.rstrip())
                    begin = min(begin, end)
                parts.append(Value((begin, end)))
                pos = quoted.end()
            elif bare := _BARE.match(text, pos):
                parts.append(bound.get(bare[0]) or Value(bare.span()))
                pos, plain = bare.end(), len(parts) == 1
            else:
                break
            plus = _PLUS.match(text, pos)
            if not plus:
                break
            pos = plus.end()
        if typed and (declared := _NAME.search(text, found.end(), operator.end())):
            names.append(declared[0])  # `a: b = literal` may also be a key and an assignment to b
        if parts:
            if len(parts) == 1 and plain and (more := _TYPED.match(text, pos) or _BOUND.match(text, pos)):
                # The right side is itself a name that gets a value: in `a = b = literal` both do.
                expected = operator.end() if _ASSIGNS.search(more[0]) else -1
                continue
            value = parts[0] if len(parts) == 1 else Value(parts=tuple(parts))
            for name in names:
                bound[name] = value
                yield name, value
            at = pos if inner is None else inner


def _handed(text: str, name: re.Match) -> re.Match | None:
    """The sign after a name that a call gives a literal to."""
    if text[name.end() : name.end() + 1] == "(":
        return _SETTER.match(text, name.end()) if _SETS.search(name[0]) else None
    before = text[max(0, name.start() - 8) : name.start()]
    if before[-1:] in ("'", '"') and before[:-1].rstrip(" \t")[-1:] == "(":
        return _ARGUMENT.match(text, name.end())
    return None


def find(text: str) -> list[tuple[int, int, str, float]]:
    """All spans `(begin, end, kind, score)` in code points, by begin and then by kind as listed."""
    out: list[tuple[int, int, str, float]] = []
    lower = text.lower() if text.isascii() else text.encode().lower()
    keys = KEYWORDS if text.isascii() else [k.encode() for k in KEYWORDS]
    if any(k in lower for k in keys):
        out += [(*m.span(), "assign", 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access", 1.0) for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex", 1.0) for m in HEX.finditer(text)]
    if any(sign in text for sign in "=:(<"):
        taken = [(b, e) for b, e, kind, _ in out if kind == "assign"]  # in order, apart from each other
        extra = {}
        for name, value in pairs(text):
            score = 0.0 if value.told else name_score(name)
            if score >= LEAST_SCORE and (score := score * value_score(*value.measured(text))) >= LEAST_SCORE:
                for b, e in value.literals():
                    k = bisect_right(taken, (b, len(text))) - 1
                    if e > b and not (k >= 0 and e <= taken[k][1]):
                        extra.setdefault((b, e), score)
        out += [(b, e, "pair", s) for (b, e), s in extra.items()]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        texts = batch.column(1)
        spans = [
            [{"kind": k, "begin": b, "end": e, "score": s} for b, e, k, s in find(texts[i].as_py() or "")]
            for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, spans` of every row of `docs`; a span has kind, begin, end (code points) and score.

    Null and empty texts have no span. Rows come back one for one, also repeated ones and those
    without an id; other columns are not read. Spans of different kinds may overlap.
    """
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_arrow(narrow, _scan,
                    "doc_id bigint, spans array<struct<kind: string, begin: bigint, end: bigint, score: double>>")


def masked(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, last = [], 0
    for b, e, _, _ in find(text):
        if e <= last:
            continue
        if b >= last:
            out += [text[last:b], mark]
        last = e
    return "".join(out) + text[last:]


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        column = batch.column(at)
        texts = [None if (t := column[i].as_py()) is None else masked(t) for i in range(batch.num_rows)]
        own = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(own, names=batch.schema.names)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets of its column `text` masked; a null text stays null."""
    return in_arrow(docs, _mask, docs.schema)
