"""Secret scan: fixed patterns, and an assignment-aware lexer for what the patterns do not see."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

#: Order of kinds where spans start at the same place.
KINDS = ("assign", "access", "hex", "literal")

# The words of the patterns, and the names and values that the score knows.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NAME_WEIGHTS = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.8,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "private": 0.5,
    "signing": 0.5,
    "encryption": 0.5,
    "access": 0.4,
    "auth": 0.6,
    "bearer": 0.8,
    "api": 0.4,
    "key": 0.5,
}
PLACEHOLDERS = frozenset(
    """a an api apikey change changeme dummy enter env example false fill foo here insert key me my none null password passwd
    placeholder redacted replace sample secret some test the this todo token true undefined unset value with xxx xxxx xxxxx
    xxxxxx your""".split()
)

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The head of a pair: a name, perhaps quoted or indexed, and an assignment.  Comparisons and scopes (``::``) are none.
HEAD = re.compile(
    r"""(?<![A-Za-z0-9_])(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?:\\?["'`\]]){0,2}+[ \t]*+"""
    r"""(?P<op>:=|=>|[?+]?=(?![=>~])|:(?![:=]))[ \t]*+""",
    re.A,
)
#: A name and a literal as the first two arguments of a call.
CALL = re.compile(r"""\([ \t\n]*+(["'])(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)\1[ \t]*+,[ \t\n]*+(?=["'`])""", re.A)
#: User and password of a URL.
USER = re.compile(r"""://[^\s:/@"'<>]++:(?P<value>[^\s:/@"'<>]++)@""")
PREFIX = re.compile(r"""[A-Za-z@$]{0,2}(?=["'`])|""", re.A)
STRING = re.compile(
    r'''"""(?P<triple>.*?)"""|"(?P<double>(?:[^"\\\n]|\\.)*+)"|`(?P<back>[^`\n]*+)`'''
    r"""|'''(?P<third>.*?)'''|'(?P<single>(?:[^'\\\n]|\\.)*+)'|\\(?P<mark>["'])(?P<inner>[^\n]*?)\\(?P=mark)""",
    re.S,
)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]#&]++""")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*+\r?\n")
#: Between the terms of a concatenation: an operator, a continued line, or blanks before a further string.
JOIN = re.compile(
    r"""[ \t]*+(?:(?:\+|\.{1,2}|~)(?![=+])[ \t]*+(?:\n[ \t]*+)?|\\\n[ \t]*+(?=["'])|\n[ \t]*+(?:\+|\.{1,2})[ \t]*+)|[ \t]++(?=["'])"""
)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
REFERENCE = re.compile(r"(?:\$\{?)?([A-Za-z_][A-Za-z0-9_.\-]*)\}?", re.A)
#: Whole values that stand for another one: variables, templates, masks.
STANDS_FOR = re.compile(r"\$[A-Za-z_]\w*|\$\{[^}]*\}|\$\([^)]*\)|%[A-Za-z_]\w*%|\{\{.*\}\}|<[^<>]*>|[*.xX#_-]+", re.A)

MIN_LITERAL = 6
#: Longer values are no placeholders.
LONGEST_PLACEHOLDER = 80
MIN_SCORE = 0.75


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost, non-overlapping matches per kind as ``(start, end, kind)``; the cheap tests lose no match."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


@lru_cache(4096)
def name_score(name: str) -> float:
    """How much a target name speaks of a secret: the weights of its words, at most 1.  A word may end in a weighty one."""
    words = [w.lower() for w in WORD.findall(name)]
    weights = [NAME_WEIGHTS.get(w) or max((v for n, v in NAME_WEIGHTS.items() if v >= 0.8 and w.endswith(n)), default=0.0) for w in words]
    return min(1.0, sum(weights))


class Value:
    """What a name was given: the place of the literal, and the characters of all its parts, counted when first asked for."""

    __slots__ = ("start", "end", "parts", "bare", "counts", "size", "whole")

    def __init__(self, start: int, end: int, parts: list, bare: bool = False):
        self.start, self.end, self.parts, self.bare, self.counts = start, end, parts, bare, None

    def measure(self, text: str) -> None:
        if self.counts is not None:
            return
        self.counts, self.size = Counter(), 0.0
        pieces = []
        for part in self.parts:
            if isinstance(part, Value):  # measured when it was joined
                self.counts.update(part.counts)
                self.size += part.size
                pieces.append(part.whole)
            else:
                piece = text[part[0] : part[1]]
                self.counts.update(piece)
                self.size += len(piece)
                pieces.append(piece if len(piece) <= LONGEST_PLACEHOLDER else None)
        if self.size > 2.0**40:  # names joined with themselves: shares are all that counts
            self.counts = Counter({c: n / 2.0**20 for c, n in self.counts.items()})
            self.size /= 2.0**20
        short = None not in pieces and self.size <= LONGEST_PLACEHOLDER
        self.whole = "".join(pieces) if short else None
        self.parts = []

    def score(self, text: str) -> float:
        """0 for short values and placeholders, judged by the whole value; grows with the entropy of the characters, up to 1.

        A bare value of one kind of characters only is rather a word or another name, and counts half.
        """
        self.measure(text)
        if self.size < MIN_LITERAL:
            return 0.0
        if self.whole is not None:
            words = [w.lower() for w in WORD.findall(self.whole)]
            if STANDS_FOR.fullmatch(self.whole) or all(w in PLACEHOLDERS or (w.isdigit() and len(w) < 4) for w in words):
                return 0.0
        entropy = -sum(c / self.size * math.log2(c / self.size) for c in self.counts.values())
        kinds = {"a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." for c in self.counts}
        return min(1.0, entropy / 2.5) * (0.5 if self.bare and len(kinds) == 1 else 1.0)


class Lexer:
    """Reads the pairs of a text in order; every step goes on where the one before ended, so time grows with the text."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, Value] = {}
        self.run_end = -1
        self.found: set[tuple[int, int]] = set()
        self.pending: tuple[float, Value] | None = None

    def string(self, at: int) -> tuple[tuple[int, int], int] | None:
        """The place of a string's content, and the end of the string, if one starts at ``at``."""
        m = STRING.match(self.text, PREFIX.match(self.text, at).end())
        if m is None:
            return None
        return next(m.span(g) for g in ("triple", "double", "back", "third", "single", "inner") if m[g] is not None), m.end()

    def term(self, at: int):
        """One term: ``(place or value, end, bare)``; ``None`` as the first where it is code or a name without value."""
        literal = self.string(at)
        if literal is not None:
            (a, b), end = literal
            if self.text.startswith("$", a):
                reference = REFERENCE.fullmatch(self.text, a, b)
                if reference and reference[1] in self.known:
                    return self.known[reference[1]], end, False
            return (a, b), end, False
        if at < self.run_end:
            end = self.run_end
        else:
            m = BARE.match(self.text, at)
            if m is None:
                return None, at, True
            end = self.run_end = m.end()
        reference = REFERENCE.match(self.text, at)
        if reference and reference.end() == end and _plain(reference[1]) in self.known:
            return self.known[_plain(reference[1])], end, True
        return (None if self.text.startswith(("(", "["), end) else (at, end)), end, True

    def block(self, at: int, head: int) -> Value | None:
        """The indented lines after a block mark, of a head that starts at ``head``."""
        text = self.text
        margin = _indent(text, text.rfind("\n", 0, head) + 1)
        start, end = None, at
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            inside = _indent(text, at)
            if at + inside < stop and text[at + inside] != "\r":
                if inside <= margin:
                    break
                start = at + inside if start is None else start
                end = stop
            at = stop + 1
        if start is None:
            return None
        while text[end - 1] in " \t\r":
            end -= 1
        return Value(start, end, [(start, end)])

    def value(self, at: int, head: int) -> Value | None:
        mark = BLOCK.match(self.text, at)
        if mark:
            return self.block(mark.end(), head)
        if self.text.startswith("(", at):
            at += 1
            while at < len(self.text) and self.text[at] in " \t\n":
                at += 1
        first, end, bare = self.term(at)
        if bare and isinstance(first, tuple):
            name = REFERENCE.match(self.text, at)
            if name is None or name.end() != end:  # no name, so nothing can be joined to it
                return Value(*first, [first], bare=True)
        terms = [first]
        while True:
            join = JOIN.match(self.text, end)
            if join is None:
                break
            more, stop, more_bare = self.term(join.end())
            if more is None or (more_bare and not isinstance(more, Value)):
                break
            terms.append(more)
            end = stop
        if len(terms) == 1:
            return first if first is None or isinstance(first, Value) else Value(*first, [first], bare=bare)
        if bare and not isinstance(first, Value):
            terms = terms[1:]  # a name without a known value
        for t in terms:
            if isinstance(t, Value):
                t.measure(self.text)
        written = [t for t in terms if not isinstance(t, Value)]
        most = max((t for t in terms if isinstance(t, Value)), key=lambda t: t.size, default=None)
        if most is not None and most.size > sum(b - a for a, b in written):
            return Value(most.start, most.end, terms)
        return Value(written[0][0], written[-1][1], terms)

    def settle(self, until: int) -> None:
        """Decide on the sensitive pair that waits, unless a sensitive pair at ``until`` stands inside its value."""
        if self.pending is not None:
            weight, value = self.pending
            self.pending = None
            if not value.start <= until < value.end and weight * value.score(self.text) >= MIN_SCORE:
                self.found.add((value.start, value.end))

    def give(self, names: list[str], value: Value, at: int) -> None:
        for name in names:
            self.known[_plain(name)] = value
        weight = max(map(name_score, names))
        if weight >= MIN_SCORE:
            self.settle(at)
            self.pending = (weight, value)

    def read(self) -> set[tuple[int, int]]:
        text = self.text
        typed: tuple[str, int] | None = None
        if "=" in text or ":" in text:
            for m in HEAD.finditer(text):
                value = self.value(m.end(), m.start()) if m.end() < len(text) else None
                names = [m["name"]] + ([typed[0]] if typed and typed[1] == m.start() else [])
                typed = (m["name"], m.end()) if m["op"] == ":" else None
                if value is not None:
                    self.give(names, value, m.start())
            self.settle(-1)
        if "('" in text or '("' in text or "(\n" in text or "( " in text:
            for m in CALL.finditer(text):
                value = self.value(m.end(), m.start())
                if value is not None:
                    self.give([m["name"]], value, m.start())
            self.settle(-1)
        if "://" in text:
            for m in USER.finditer(text):
                value = Value(*m.span("value"), [m.span("value")])
                if value.score(text) >= MIN_SCORE:
                    self.found.add((value.start, value.end))
        return self.found


def _plain(name: str) -> str:
    return name.removeprefix("self.").removeprefix("this.")


def _indent(text: str, at: int) -> int:
    start = at
    while at < len(text) and text[at] in " \t":
        at += 1
    return at - start


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through other names, as ``(start, end, 'literal')``.

    Pairs are read from assignments, keyword arguments, JSON, YAML with block values, INI, shell and URL queries, also
    inside strings, values and comments; comments count, as a secret in one is as open as elsewhere.  Strings may hold
    escapes and may be joined, also over lines; the span of a joined one goes from its first to its last string.  A value
    that names an earlier pair is that pair's literal, and the span is where the literal stands, also where such a name is
    most of a joined value.  Of a sensitive pair inside another's value only the inner one is reported.
    """
    return [(start, end, "literal") for start, end in sorted(Lexer(text).read())]


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """Counts per base kind, the digest of the base spans, and all spans; null is the empty text."""
    text = text or ""
    base = base_spans(text)
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    starts, ends = zip(*sorted((a, b) for a, b, _ in base)) if base else ((), ())
    reach = [-1, *accumulate(ends, max)]  # the furthest end of the base spans that start up to a place
    extra = [s for s in literal_spans(text) if reach[bisect_right(starts, s[0])] < s[1]]
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=order))
    counts = Counter(k for _, _, k in base)
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    return counts["assign"], counts["access"], counts["hex"], digest, joined([*base, *extra])


def scan_texts(texts: list) -> list[tuple]:
    return list(zip(*map(scan, texts))) if texts else [[]] * 5


def secret_scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets in every text, one row per input row.

    Columns: ``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` (``kind:start:end`` in code
    points, end exclusive, by start and then kind).  A null or empty text has no spans; null keys and repeated rows are
    kept as they are; an empty table gives no rows.  No shuffle: each text is scanned where it is read.
    """
    from cohortspark.llm.common import map_texts

    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(df, [key], text, scan_texts, fields)
