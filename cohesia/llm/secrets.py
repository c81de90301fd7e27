"""Secret scans: fixed patterns, and an assignment-aware lexer that pairs names with literals.

The lexer reads assignments as source and configuration files write them: ``name = "x"``, ``name: x``, ``name := x``,
``"name" => 'x'``, ``d["name"] = x``, ``name: str = "x"``, keyword arguments, ``put("name", "x")``, XML attributes and
elements, ``key="name" value="x"``, environment files, values on the next line, triple quotes and YAML blocks. A value is a
sum of literals and constants. A call is no literal. Constants are followed to where they are defined, before or after.
A definition is reported if the sensitivity of its name and the form of its whole value together score enough, and
with it every literal that its value is made of. Time is linear in the text; names and values may have any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The patterns of the contract. All of a pattern's matches are taken from left to right, without overlaps, and then short ones are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a word of a name is. A name scores as its most sensitive word, or as all of a pair.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 2, "credentials": 2, "authorization": 2, "auth": 1, "bearer": 2, "signature": 1, "key": 1, "pin": 1}
SENSITIVE_PAIRS = {("api", "key"): 3, ("access", "key"): 3, ("private", "key"): 3, ("secret", "key"): 3, ("signing", "key"): 3, ("encryption", "key"): 3, ("client", "secret"): 3, ("pass", "word"): 3, ("pass", "phrase"): 3}
PLACEHOLDERS = re.compile(r"(?i)^(?:changeme|change_me|none|null|nil|true|false|todo|tbd|example|sample|dummy|placeholder|redacted|undefined|your[_-].*|my[_-]?(?:password|secret|token)|x{3,}|\*+|\.+|<.*>|\$\{.*\}|\$\(.*\)|\$[A-Za-z_]\w*|%\(.*\)s|\{\{.*\}\})$")
#: The least total of name and value scores, and the least length of a value.
THRESHOLD, MIN_LITERAL = 4, 6

_OPERATOR = re.compile(r"(?<![=!<>:])(?::=|\+=|=>|[:=])(?![=:>~])|\(\s*(?=[\"'])")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
#: After a colon: a type and then the assignment itself.
_TYPED = re.compile(r"[ \t]*[A-Za-z_][\w.]*(?:\[[^\]\n=]*\])?[ \t]*=(?!=)")
_STRING = re.compile(
    r"""[rbfuRBFU]{0,2}(?:\"{3}(?P<t2>.*?)\"{3}|'{3}(?P<t1>.*?)'{3}|"(?P<q2>[^"\\\n]*(?:\\.[^"\\\n]*)*)"|'(?P<q1>[^'\\\n]*(?:\\.[^'\\\n]*)*)'|`(?P<q0>[^`\n]*)`|\\"(?P<e2>[^"\\\n]*)\\"|\\'(?P<e1>[^'\\\n]*)\\')""", re.DOTALL
)
_BARE = re.compile(r"[^\s\"'`,;&<>()\[\]{}]+")
_WHOLE = re.compile(r"[^\s\"'`]\S*")
_PLUS = re.compile(r"(?:\s|\\\n)*(?:\+|\.\.|\|\|)(?:\s|\\\n)*")
_GAP, _LINE_GAP = re.compile(r"(?:\s|\\\n)*"), re.compile(r"[ \t]*(?:\\\n[ \t]*)?")
_BLOCK_MARK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[ \t]*\n")
_SCHEME = re.compile(r"(?i:bearer|basic|token)[ \t]+(?=\S)")
_LINE = re.compile(r"([ \t]*)(?:export[ \t]+)?")
_COMMA = re.compile(r"\s*,\s*")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)[^<>]*>([^<>]*)</\1\s*>")
#: Names of an assignment whose value names what the next assignment, called value, holds.
_NAMING, _NAMED = {"name", "key", "id"}, {"value", "val"}


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, end, kind)`` of the fixed patterns, kind as the place in KINDS."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= MIN_ASSIGN:
            yield m.start(), m.end(), 0
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                yield m.start(), m.end(), 1
    if m := _LONG_HEX.search(text):  # earlier runs are short; they can't reach into this one
        for m in HEX.finditer(text, m.start()):
            if m.end() - m.start() >= MIN_HEX:
                yield m.start(), m.end(), 2


def name_score(name: str) -> int:
    words = [w.lower() for w in _PARTS.findall(name)]
    best = max((SENSITIVE.get(w, 0) for w in words), default=0)
    return max([best, *(SENSITIVE_PAIRS.get(p, 0) for p in zip(words, words[1:]))])


@dataclass
class Form:
    """What a value's score needs of its characters; of a value made of several, the sum."""

    counts: Counter = field(default_factory=Counter)
    placeholder: bool = False

    @classmethod
    def of(cls, text: str) -> Form:
        return cls(Counter(text), PLACEHOLDERS.match(text) is not None)

    def add(self, other: Form) -> None:
        self.counts.update(other.counts)

    def score(self) -> int:
        """Zero for what can't be a secret, up to 3 for long strings of mixed characters."""
        size = self.counts.total()
        if size < MIN_LITERAL or self.placeholder or any(c.isspace() for c in self.counts):
            return 0
        bits = -sum(n / size * math.log2(n / size) for n in self.counts.values())
        lower, upper, digits = (sum(n for c, n in self.counts.items() if f(c)) for f in (str.islower, str.isupper, str.isdigit))
        classes = (lower > 0) + (upper > 0) + (digits > 0) + (size > lower + upper + digits)
        return 1 + (classes >= 2) + (size >= 16 and bits >= 3 and lower + upper > 0 and (digits >= 3 or (lower > 2 and upper > 2)))


def value_score(value: str) -> int:
    return Form.of(value).score()


@dataclass
class Definition:
    """An assignment: the names it goes by, the spans of its literals and the constants in its value."""

    names: list[str]
    at: int
    spans: list[tuple[int, int]] = field(default_factory=list)
    constants: list[str] = field(default_factory=list)
    weak: bool = False  # a bare word among other text


class Lexer:
    """One pass over the operators of a text, each with the name before it and the value after it."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[Definition] = []

    def read(self) -> list[Definition]:
        text, done, line, newline = self.text, 0, 0, self.text.find("\n")
        read, lead = 0, _LINE.match(text)
        for op in _OPERATOR.finditer(text):
            at = op.start()
            if at < done:
                continue
            while 0 <= newline < at:
                line, newline = newline + 1, text.find("\n", newline + 1)
            if op[0][0] == "(":
                if (pair := self._call_pair(op.end())) is None:
                    continue
                names, value_at = pair
            else:
                names = self._names(at, max(done, line), op[0])
                value_at = op.end()
                if not names or (op[0] == ":" and (text.startswith("//", value_at) or _TYPED.match(text, value_at))):
                    continue
            if line != read:
                read, lead = line, _LINE.match(text, line)
            whole = line <= self._name_start <= lead.end(1) or self._name_start == lead.end()
            done = max(done, self._value(names, value_at, op[0], whole))
        for m in _ELEMENT.finditer(text):
            inner = m[2].strip()
            if inner:
                start = m.start(2) + len(m[2]) - len(m[2].lstrip())
                self.found.append(Definition([m[1]], m.start(), [(start, start + len(inner))]))
        return self.found

    def _names(self, at: int, low: int, op: str) -> list[str]:
        """The name before an operator; before ``=`` also the one that the type of an annotation stands behind."""
        name, start = self._name_before(at, low)
        self._name_start = start
        names = [name] if name else []
        if name and op == "=":
            i = self._back(start, low)
            if i > low and self.text[i - 1] == ":":
                typed, before = self._name_before(i - 1, low)
                if typed:
                    names.append(typed)
                    self._name_start = before
        return names

    def _back(self, i: int, low: int) -> int:
        while i > low and self.text[i - 1] in " \t":
            i -= 1
        return i

    def _name_before(self, at: int, low: int) -> tuple[str, int]:
        text, i = self.text, self._back(at, low)
        if i <= low:
            return "", at
        last = text[i - 1]
        if last == "]":
            i = self._back(i - 1, low)
            last = text[i - 1] if i > low else ""
            if last not in ("'", '"'):  # the type of an annotation
                i = text.rfind("[", low, i)
                last = text[i - 1] if i > low else ""
        if last and last in "\"'`":
            start = text.rfind(last, low, i - 1)
            return (text[start + 1 : i - 1], start) if start >= 0 else ("", at)
        start = i
        while start > low and text[start - 1] in _NAME_CHARS:
            start -= 1
        name = text[start:i].lstrip("-.")
        return (name, i - len(name)) if name and (name[0].isalpha() or name[0] in "_$") else ("", at)

    def _call_pair(self, at: int) -> tuple[list[str], int] | None:
        """``("name", "literal"``: the name and where the literal starts."""
        m = _STRING.match(self.text, at)
        if m and (comma := _COMMA.match(self.text, m.end())) and _STRING.match(self.text, comma.end()):
            self._name_start = at
            return [m[m.lastgroup]], comma.end()
        return None

    def _value(self, names: list[str], at: int, op: str, whole: bool) -> int:
        """Reads the value at ``at``, adds the definition and tells where to go on: after it, or in a string that holds quotes.

        ``whole``: nothing else stands before the name in its line.
        """
        text, made = self.text, Definition(names, at)
        if op == ":" and (mark := _BLOCK_MARK.match(text, at)):
            return self._block(made, mark.end())
        i = _LINE_GAP.match(text, at).end()
        across = i < len(text) and text[i] in "(\n"
        if across:
            i = _GAP.match(text, i + 1).end()
            if not _STRING.match(text, i):
                return at
        end, inside = i, None
        while True:
            if scheme := _SCHEME.match(text, i):
                i = scheme.end()
            if m := _STRING.match(text, i):
                self._literal(made, m.lastgroup, *m.span(m.lastgroup))
                if inside is None and m.lastgroup[0] == "q" and ('\\"' in m[0] or "\\'" in m[0]):
                    inside = m.start(m.lastgroup)
            else:
                env = whole and op == "=" and i == at and not made.spans
                m = (_WHOLE if env else _BARE).match(text, i)
                if not m or text[m.end() : m.end() + 1] in ("(", "["):
                    if m:
                        return m.end()
                    break
                if env and "(" in m[0] and _IDENTIFIER.fullmatch(m[0][: m[0].index("(")]):
                    return i + m[0].index("(")
                bare = m[0].rstrip(".,;:")
                if _IDENTIFIER.fullmatch(bare):
                    made.constants.append(bare)
                if bare:
                    made.spans.append((i, i + len(bare)))
                    made.weak = made.weak or (bare.isalpha() and not whole)
            end = m.end()
            if plus := _PLUS.match(text, end):
                i = plus.end()
            elif across and _STRING.match(text, i := _GAP.match(text, end).end()):
                continue
            else:
                break
        if made.spans:
            last = self.found[-1] if self.found else None
            if last and names[0].lower() in _NAMED and last.names[0].lower() in _NAMING and len(last.spans) == 1 and not re.search(r"[>}]", text[last.spans[0][1] : at]):
                made.names = [*names, text[slice(*last.spans[0])]]
            self.found.append(made)
        return end if inside is None else inside

    def _literal(self, made: Definition, kind: str, start: int, end: int) -> None:
        text = self.text
        if kind in ("t1", "t2"):
            self._lines(made, start, end)
            return
        if scheme := _SCHEME.match(text, start, end):
            start = scheme.end()
        made.spans.append((start, end))

    def _lines(self, made: Definition, start: int, end: int) -> None:
        for m in re.compile(r"[^\s](?:[^\n]*[^\s])?").finditer(self.text, start, end):
            if not m[0].startswith("-----"):
                made.spans.append(m.span())

    def _block(self, made: Definition, at: int) -> int:
        """The lines under a YAML block mark that are indented more than the line of the mark, or as the first of them."""
        text, end, indent = self.text, at, None
        while end < len(text):
            stop = text.find("\n", end)
            stop = len(text) if stop < 0 else stop
            row = text[end:stop]
            width = len(row) - len(row.lstrip())
            if row.strip():
                indent = width if indent is None else indent
                if width < max(indent, 1):
                    break
            end = min(stop + 1, len(text))
        self._lines(made, at, end)
        if made.spans:
            self.found.append(made)
        return end


def literal_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """The literals of every definition that scores enough, constants followed."""
    if not any(c in text for c in "=:(<"):
        return
    found = Lexer(text).read()
    defined: dict[str, list[int]] = defaultdict(list)
    for i, d in enumerate(found):
        for name in d.names:
            defined[name].append(i)
            if "." in name:
                defined[name.rpartition(".")[2]].append(i)
    targets = [(i, n) for i, d in enumerate(found) if (n := max(map(name_score, d.names)))]
    if not targets:
        return
    parts: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}

    def split(i: int) -> tuple[list[int], list[tuple[int, int]]]:
        """The definitions that a value refers to, and its own literals."""
        if i not in parts:
            d, refers, own = found[i], [], []
            names = iter(d.constants)
            name = next(names, None)
            for span in d.spans:
                if name is not None and text[slice(*span)] == name:
                    at = defined.get(name, ()) or defined.get(name.rpartition(".")[2], ())
                    if at and (j := at[max(bisect_right(at, i - 1) - 1, 0)]) != i:  # the last definition before, else the first after
                        refers.append(j)
                    else:
                        own.append(span)
                    name = next(names, None)
                else:
                    own.append(span)
            parts[i] = refers, own
        return parts[i]

    forms: dict[int, Form] = {}
    for i, _ in targets:
        stack, open_ = [i], set()
        while stack:
            j = stack[-1]
            refers, own = split(j)
            if j not in forms and j not in open_:
                open_.add(j)
                stack += [k for k in refers if k not in forms and k not in open_]
                continue
            stack.pop()
            if j not in forms:
                form = Form.of("".join(text[slice(*s)] for s in own))
                for k in set(refers):
                    if k in forms:  # a constant that refers back to itself adds nothing
                        form.add(forms[k])
                form.placeholder = form.placeholder and not refers
                if found[j].weak and not refers:
                    form.placeholder = True
                forms[j] = form
    reported: set[int] = set()
    for i, n in targets:
        if (v := forms[i].score()) and n + v >= THRESHOLD:
            stack = [i]
            while stack:
                if (j := stack.pop()) not in reported:
                    reported.add(j)
                    refers, own = split(j)
                    stack += refers
                    yield from ((start, end, 3) for start, end in own if end > start)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and those literals that lie in no base span."""
    base = sorted(base_spans(text or ""), key=lambda s: (s[0], s[2]))
    starts, reach = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    more = []
    for s in set(literal_spans(text or "")):
        before = bisect_right(starts, s[0])
        if not before or reach[before - 1] < s[1]:
            more.append(s)
    return base, sorted(base + more, key=lambda s: (s[0], s[2], s[1]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, of the whole match for the fixed patterns and of the bare
    literal for the lexer's. A null text counts as empty: no spans, and the digest of the empty string. Texts, names and
    literals may have any length. Rows that repeat are judged each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1):
                base, found = scan(text.as_py())
                kinds = Counter(s[2] for s in base)
                counts.append([kinds[k] for k in range(3)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.record_batch([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], _NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
