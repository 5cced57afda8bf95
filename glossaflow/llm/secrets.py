"""Secret scans by assignment-aware lexing.

Three patterns find the plain cases.  Beyond them, assignments are read as source or configuration
text: each gives pairs of a name and what it is given, a quoted string of one or several lines, several
of them added, an indented block, a bare value, another name, or what an ``or`` falls back to.
Private keys between header and footer need no name.  Another name stands for the literals it was
given before, or else is first given later in the text.  Literals are scored by how sensitive the
name sounds and how much they look like a secret; those above the threshold become spans of kind
``literal``, unless a span of a pattern holds them whole.

Names are read by their parts, at separators and capitals, and fillers by whole parts of a value, so
that chance pieces of longer words count for nothing.

Defined results: null and empty texts have no spans.  Whole texts are read, in time that grows with
their length.  Repeated rows are scanned alike.  Other columns, whatever their names, are not read, as
``scan`` is an expression over one.  An empty table gives an empty table.  Places are
code points, with the end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")

# Names, and what they are given.  A name may be quoted, or the key in brackets of something else, and
# may have a type.  Nothing is bounded: repetitions are possessive, so that no place is tried twice.
_OPEN = re.compile(
    rb"""(?<![A-Za-z0-9_.$-])(?:"([A-Za-z0-9_.$ -]++)"|'([A-Za-z0-9_.$ -]++)'|([A-Za-z_$][A-Za-z0-9_.$-]*+))"""
    rb"[ \t]*+\]?+[ \t]*+"
    rb"(?::[ \t]*+([A-Za-z_$][A-Za-z0-9_.$]*+)(?:\[[^\[\]\n=:]*+\])?+\??+[ \t]*+=(?![=>])|:=|=>|=|:)[ \t]*+"
)
_QUOTED = re.compile(rb""""(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+'""")
_PREFIX = re.compile(rb"""[fbru]{0,2}(?=["'`])""")
_PLUS = re.compile(rb"""\s*+\+\s*+[fbru]{0,2}(?=["'`])""")
_OTHER = re.compile(rb"[A-Za-z_$][A-Za-z0-9_.$]*+(?![A-Za-z0-9_.$/+=-])")
_BARE = re.compile(rb"[^\s\"'<>{}\[\](),;]++")
_ELEMENT = re.compile(rb"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>]++)</")
_LOGIN = re.compile(rb"://[^\s:/@]++:([^\s:/@]++)@")
_HEADER = re.compile(rb"-----BEGIN [A-Z0-9 ]*+-----")

# A block under a name, and what an assignment falls back to.
_BLOCK = re.compile(rb"[|>][+-]?[0-9]?[+-]?[ \t]*+(?:#[^\n]*+)?\r?\n")
_ELSE = re.compile(rb"""(?:\|\||\?\?|\bor\b)[ \t]*+(?=[fbru]{0,2}["'`])""")
_BREAK = re.compile(rb"[;,{}]")

#: How sensitive a name sounds: the first that it holds, written without separators.
NAMES = (
    ("privatekey", 3), ("secretkey", 3), ("accesskey", 3), ("apikey", 3), ("password", 3), ("passwd", 3),
    ("passphrase", 3), ("secret", 3), ("authtoken", 3), ("accountkey", 3), ("signingkey", 3), ("encryptionkey", 3),
    ("masterkey", 3), ("sharedkey", 3), ("credential", 2), ("connectionstring", 2), ("authorization", 2),
)
#: Short ones count as whole parts of a name only.
PARTS = {"pass": 3, "pw": 2, "pwd": 3, "token": 2, "bearer": 2, "dsn": 1, "auth": 1, "key": 1, "pin": 1}
#: Parts that say a name is about a secret, not one.
ABOUT = frozenset(
    "hint length policy url file path field label name type count expiry regex id ids size index prefix".split()
)
FILLERS = frozenset("changeme example placeholder your dummy redacted none null todo sample insert replace".split())
THRESHOLD = 5.0
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@lru_cache(maxsize=1 << 14)
def name_score(name: bytes) -> float:
    parts = [p.lower() for p in _PART.findall(name.decode("ascii", "ignore"))]
    plain = "".join(parts)
    score = next((s for word, s in NAMES if word in plain), 0)
    score = max([score, *[PARTS.get(p, PARTS.get(p.removesuffix("s"), 0)) for p in parts]])
    return score - 2 * any(p in ABOUT for p in parts) if score else 0


def literal_score(value: bytes, blanks: bool = False) -> float:
    """0 to about 5: long, mixed, evenly spread characters, without blanks unless they may be there."""
    if len(value) < 8 or (b" " in value and not blanks) or b"${" in value or value[:1] in b"<{%$":
        return 0
    low = value.lower().decode("utf-8", "ignore")
    words = re.findall(r"[a-z]+", low) if len(low) < 64 else re.split(r"[^a-z0-9]+", low)
    if any(w in FILLERS for w in words) or re.fullmatch(r"(.)\1*+|.*([x*])\2{3}.{0,8}", low):
        return 0
    spread = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return min(spread, 4) * 0.6 + 0.6 * (classes - 1) + (0.5 if len(value) >= 16 else 0)


def _string(text: bytes, at: int) -> tuple[int, int, int] | None:
    """Begin and end of what is in the string that starts at ``at``, and the end of the string."""
    for mark in (b'"""', b"'''", b"`"):
        if text.startswith(mark, at):
            end = text.find(mark, at + len(mark))
            return (at + len(mark), end, end + len(mark)) if end >= 0 else None
    m = _QUOTED.match(text, at)
    return (at + 1, m.end() - 1, m.end()) if m else None


def _strings(text: bytes, at: int) -> tuple[list[tuple[int, int]], int]:
    """All strings of a sum that starts at ``at``, and where it ends."""
    pieces, end, m = [], at, _PREFIX.match(text, at)
    while m and (found := _string(text, m.end())):
        pieces.append(found[:2])
        end = found[2]
        m = _PLUS.match(text, end)
    return pieces, end


def _block(text: bytes, line: int, at: int) -> list[tuple[int, int]]:
    """Lines of a block that starts at ``at``, further in than the line that names it."""
    own, pieces = _indent(text, line), []
    while at < len(text):
        stop = text.find(b"\n", at)
        stop = len(text) if stop < 0 else stop
        begin = at + _indent(text, at)
        end = stop - (text[stop - 1 : stop] == b"\r")
        if begin < end:
            if begin - at <= own:
                break
            pieces.append((begin, end))
        at = stop + 1
    return pieces


_BLANKS = re.compile(rb"[ \t]*+")


def _indent(text: bytes, at: int) -> int:
    return _BLANKS.match(text, at).end() - at


def _pairs(text: bytes):
    """(place, names, literals, other name, whether quoted); literals are spans of bytes in the text.

    What may be a name of its own within a bare value is looked at again.
    """
    at = bare_end = line = 0
    while line < len(text):
        stop = text.find(b"\n", line)
        stop = len(text) if stop < 0 else stop
        at = max(at, line)
        if text.find(b"=", at, stop) >= 0 or text.find(b":", at, stop) >= 0:
            # Where the line falls back to a string, and where what is assigned ends for certain.
            falls = [m.end() for m in _ELSE.finditer(text, at, stop)]
            breaks = [m.start() for m in _BREAK.finditer(text, at, stop)] if falls else []
            while at < stop and (m := _OPEN.search(text, at, stop)):
                names = [m.group(1) or m.group(2) or m.group(3)]
                if m.group(4) and name_score(m.group(4)) > 0:  # word: name = value
                    names.append(m.group(4))
                pieces, at = _strings(text, m.end())
                if pieces:
                    yield m.start(), names, pieces, None, True
                    continue
                if block := _BLOCK.match(text, m.end()):
                    if pieces := _block(text, line, block.end()):
                        yield m.start(), names, pieces, None, True
                        continue
                if falls and (k := bisect_left(falls, m.end())) < len(falls):
                    j = bisect_left(breaks, m.end())
                    if j == len(breaks) or breaks[j] > falls[k]:
                        yield m.start(), names, _strings(text, falls[k])[0], None, True
                if other := _OTHER.match(text, m.end()):
                    yield m.start(), names, [other.span()], other.group(), False
                elif m.end() < bare_end:
                    yield m.start(), names, [(m.end(), bare_end)], None, False
                elif bare := _BARE.match(text, m.end()):
                    bare_end = bare.end()
                    yield m.start(), names, [bare.span()], None, False
        line = stop + 1
    if b"</" in text:
        for m in _ELEMENT.finditer(text):
            yield m.start(), [m.group(1)], [m.span(2)], None, False
    if b"://" in text:
        for m in _LOGIN.finditer(text):
            yield m.start(), [b"password"], [m.span(1)], None, False


def _key_blocks(text: bytes):
    """Spans of private keys, from header to footer, or to the end of a text without one."""
    at = 0
    while m := _HEADER.search(text, at):
        at = m.end()
        if b"PRIVATE KEY" in m.group():
            foot = text.find(b"-----END ", at)
            end = text.find(b"-----", foot + 9) if foot >= 0 else -1
            at = end + 5 if end >= 0 else len(text)
            yield m.start(), at


class _Value:
    """Literals with what is known of them, so that another use costs nothing more."""

    __slots__ = ("literals", "quoted", "scores", "found")

    def __init__(self, literals: list[tuple[int, int]], quoted: bool):
        self.literals, self.quoted, self.scores, self.found = literals, quoted, {}, False

    def score(self, text: bytes, blanks: bool) -> float:
        if blanks not in self.scores:
            self.scores[blanks] = literal_score(b"".join(text[a:b] for a, b in self.literals), blanks)
        return self.scores[blanks]


def _literals(text: bytes) -> list[tuple[int, int]]:
    pairs = [
        (names, _Value(literals, quoted), other)
        for _, names, literals, other, quoted in sorted(_pairs(text), key=lambda p: p[0])
        if literals
    ]
    # What a name is first given, for uses before that.
    later: dict[bytes, _Value] = {}
    for names, value, other in pairs:
        if other is None:
            for name in names:
                later.setdefault(name, value)
    known: dict[bytes, _Value] = {}
    found = set(_key_blocks(text)) if b"-----BEGIN" in text else set()
    # The end of the last bare value, and the highest score of a name that it was tried for.
    tried = (-1, 0)
    for names, value, other in pairs:
        if other is not None:
            value = known.get(other) or later.get(other) or value
        for name in names:
            known[name] = value
        sensitive = max(map(name_score, names))
        if sensitive <= 0 or value.found:
            continue
        if not value.quoted:
            if tried[0] == value.literals[-1][1] and sensitive <= tried[1]:
                continue
            tried = value.literals[-1][1], sensitive
        score = value.score(text, value.quoted and sensitive >= 3)
        if score > 0 and sensitive + score >= THRESHOLD:
            value.found = True
            found.update(s for s in value.literals if s[0] < s[1])
    return sorted(found)


def scan_text(text: bytes | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans in order, in code points."""
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(word in low for word in (b"passw", b"secret", b"token", b"api")):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    taken = _merged([(a, b) for a, _, b in spans])
    spans += [(a, 3, b) for a, b in _literals(text) if not _inside(a, b, taken)]
    if not spans:
        return []
    if not text.isascii():
        points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(points[i - 1]) if i else 0
        spans = [(at(a), k, at(b)) for a, k, b in spans]
    return sorted(spans)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _touches(a: int, b: int, disjoint: list[tuple[int, int]]) -> bool:
    """Whether a span shares a place with one of the disjoint spans."""
    k = bisect_left(disjoint, (b, 0))
    return k > 0 and disjoint[k - 1][1] > a


def _inside(a: int, b: int, disjoint: list[tuple[int, int]]) -> bool:
    """Whether one of the disjoint spans holds the whole span."""
    k = bisect_left(disjoint, (a + 1, 0))
    return k > 0 and disjoint[k - 1][1] >= b


_FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
)


@F.arrow_udf(_FOUND)
def _scanned(texts: pa.Array) -> pa.Array:
    counts, base, spans = [[] for _ in KINDS], [], []
    for text in texts:
        found = scan_text(text.as_py())
        for k, column in enumerate(counts):
            column.append(sum(1 for s in found if s[1] == k))
        said = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in found]
        base.append(",".join(x for k, x in said if k < 3))
        spans.append(",".join(x for _, x in said))
    return pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in counts] + [pa.array(base, pa.string()), pa.array(spans, pa.string())],
        names=_FOUND.names,
    )


def scan(text: Column) -> Column:
    """Struct of the number of spans of each kind, the base spans and all spans as text."""
    return _scanned(text.cast("binary"))
