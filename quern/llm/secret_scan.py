"""Secret scan: base patterns plus assignment-aware lexing.

Base kinds, leftmost non-overlapping matches of each: ``assign`` (a sensitive word, ``:`` or ``=``, a value of 6 or more
characters), ``access`` (an access-key id of 20 or more characters), ``hex`` (24 or more lower-case hex digits).

The lexer reads source and configuration syntax as (name, expression) pairs: ``name = expr``, ``name: expr``,
``name: type = expr``, ``"name": expr``, ``table["name"] = expr``, ``name => expr``, ``name := expr``. An expression is
string literals, bare values and names of constants joined by ``+`` or ``.``; constants are propagated in text order, so
a literal counts where its value reaches a sensitive name. A literal scores by its target's name (strong or weak words,
less for names of urls, files, ids and the like) and by its own form (length, character classes, entropy, placeholders).
The spans of the literals that reach ``LEAST`` are added as kind ``lexed``; base spans stay.

Spans are in code points, end exclusive, ordered by start, then kind. Defined results: null and empty texts have no
spans; repeated rows and null ids are scanned row by row; an empty table gives an empty result. The scan is map-only and
no name, literal, value or number of parts is cut; its work per text is linear, so hot sources and long texts need no dealing. ``scan`` reads only the key and the text;
``redact`` keeps all columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs are maximal, so a lower bound inside the pattern finds the same as dropping short matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names that make a target sensitive, and parts that make it less so.
STRONG = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "accesskey", "privatekey", "credential", "bearer", "clientkey")
WEAK = ("auth", "key", "pass", "salt", "signature", "cert", "pin", "cred")
LESS = ("url", "uri", "path", "file", "name", "type", "length", "size", "count", "field", "label", "hint", "public", "expiry", "expires", "ttl", "header", "prompt", "id")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|change_me|placeholder|example.*|your[_-].*|todo|none|null|nil|true|false|undefined|test|dummy|sample.*|<.*>|\$\{.*\}|\$\(.*\)|%\(.*\)s|\{\{.*\}\}|os\.environ.*|process\.env.*)$")
LEAST, SHORTEST = 1.0, 6
#: Values up to this length are kept as text; longer ones by their counts and ends, which give the same score.
PLAIN = 4000

#: A bare name starts at its run's first character that may start one (or at an ``@``), so a run is read once, however long.
PAIR = re.compile(
    r"""(?:(?P<q>["'`])(?P<quoted>[^"'`\n]++)(?P=q)[ \t]*+(?:\][ \t]*+)?|(?:(?<![\w$.\-])[\d.\-]*+|(?=@))(?P<ident>[A-Za-z_$@][\w$.\-]*+)[ \t]*+)"""
    r"""(?::[ \t]*+[A-Za-z_][\w.\[\]|]*+[ \t]*+=(?![=~>])|:=|=>|=(?![=~>])|:(?![:/=]))[ \t]*+""",
    re.A,
)
QUOTED = re.compile(r"""[rRbBuUfF]{0,2}(?:(?P<t>\"{3}|'{3})(?P<long>.*?)(?P=t)|"(?P<d>(?:\\.|[^"\\\n]++)*+)"|'(?P<s>(?:\\.|[^'\\\n]++)*+)'|`(?P<b>[^`\n]*+)`)""", re.S)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
PLUS = re.compile(r"""[ \t]*[+.][ \t]*(?=["'`A-Za-z_])""")
NAME = re.compile(r"[A-Za-z_$@][\w$.\-]*+\Z", re.A)
PART, HEAD = re.compile(r"[\w$.\-]*+"), re.compile(r"[\w$]*+", re.A)
_TRIGGERS = (*STRONG, "api_key", "access_key", "private_key", "client_key", *WEAK)


def name_score(name: str) -> float:
    """How sensitive a target name is: 1 for strong words, 0.5 for weak ones, less for names of harmless things."""
    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name.rsplit(".", 1)[-1]).lower())
    joined = "".join(parts)
    score = 1.0 if any(w in joined for w in STRONG) else 0.5 if any(p in WEAK or p.rstrip("s") in WEAK for p in parts) else 0.0
    return score - 1.0 if score and parts and (parts[-1] in LESS or "public" in parts) else score


class Value:
    """A value by what its score needs: length, counts of characters, both ends, and the text where it is short.

    So a concatenation costs as much as its alphabet, however long the joined value is.
    """

    __slots__ = ("n", "counts", "head", "tail", "text")

    def __init__(self, n: int, counts: Counter, head: str, tail: str, text: str | None):
        self.n, self.counts, self.head, self.tail, self.text = n, counts, head, tail, text

    @classmethod
    def of(cls, text: str, counts: Counter | None = None) -> Value:
        return cls(len(text), Counter(text) if counts is None else counts, text[:32], text[-4:], text if len(text) <= PLAIN else None)

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        n, head, tail, counts = sum(p.n for p in parts), "", "", Counter()
        for p in parts:
            if len(head) < 32:
                head = (head + p.head)[:32]
            tail = (tail + p.tail)[-4:]
            counts.update(p.counts)
        return cls(n, counts, head, tail, "".join(p.text for p in parts) if n <= PLAIN else None)

    def sketch(self) -> str:
        """The text, or for a long value one with the same ends and the same set of characters."""
        if self.text is not None:
            return self.text
        last = self.tail[-1] == "\n" and self.counts["\n"] == 1
        return self.head + "".join(c for c in self.counts if not (last and c == "\n")) + self.tail


def literal_score(value: str | Value, quoted: bool) -> float:
    """How much a literal looks like a secret; below zero for placeholders, short values and prose."""
    value = Value.of(value) if isinstance(value, str) else value
    n, form = value.n, value.sketch()
    if n < SHORTEST or PLACEHOLDER.match(form):
        return -1.0
    entropy = -sum(c / n * math.log2(c / n) for c in value.counts.values())
    kinds = sum(bool(re.search(p, form)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    score = 0.25 * (entropy >= 2.5) + 0.25 * (entropy >= 3.2 and n >= 16) + 0.15 * (kinds >= 2) + 0.1 * (kinds >= 3) + 0.1 * quoted
    if re.search(r"\s", form):
        score -= 0.5
    if not quoted and not re.search("[0-9]", form):
        score -= 0.6
    return score


class Runs:
    """Bare values of one text. Those of ``a=b=c=...`` end together: a long run's end is sought once, its characters counted once."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.at, self.counts = text, 0, 0, 0, None

    def end_of(self, at: int) -> int:
        """The end of the run of bare characters at ``at``; ``at`` itself if there is none."""
        if not self.start <= at < self.end:
            m = BARE.match(self.text, at)
            if not m:
                return at
            self.start, self.end, self.counts = at, m.end(), None
        return self.end

    def stripped(self, at: int, end: int) -> int:
        while end > at and self.text[end - 1] in ".:":
            end -= 1
        return end

    def value(self, at: int, end: int) -> Value:
        text = self.text
        if end - at <= PLAIN:
            return Value.of(text[at:end])
        if self.counts is None or at < self.at or self.counts[1] != end:
            self.counts = (Counter(text[at:end]), end)
        else:
            self.counts[0].subtract(text[self.at : at])
        self.at = at
        return Value(end - at, +self.counts[0], text[at : at + 32], text[end - 4 : end], None)


class Constants(dict):
    """name -> (value, spans, all quoted), and the lengths of the names."""

    def __init__(self):
        super().__init__()
        self.lengths: set[int] = set()

    def __setitem__(self, name: str, held: tuple) -> None:
        super().__setitem__(name, held)
        self.lengths.add(len(name))


def expression(text: str, at: int, constants: Constants, runs: Runs) -> tuple[Value, list, bool, str | None]:
    """(value, literal spans, all quoted, the single name it is) of the expression at ``at``.

    Spans are a list of (start, end) and of such lists, which constants share.
    """
    value, spans, quoted, only, first = [], [], True, None, True
    while True:
        if (m := QUOTED.match(text, at)) and m.end() > at:
            group = m.lastgroup if m.lastgroup != "t" else "long"
            value.append(Value.of(m[group]))
            spans.append(m.span(group))
            end = m.end()
        elif (stop := runs.end_of(at)) > at:
            end = stop if first else PART.match(text, at, stop).end()
            # A run ends in one place, so at most one piece of each length that a constant's name has is taken from it.
            word = text[at:end] if end - at in constants.lengths else None
            name = HEAD.match(text, at, end)[0]
            if word in constants or name in constants:
                known = word if word in constants else name
                v, s, q = constants[known]
                value.append(v)
                spans.append(s)
                quoted, end = quoted and q, at + len(known)
            elif first:
                end = runs.stripped(at, end)
                value.append(runs.value(at, end))
                spans.append((at, end))
                quoted, only = False, m[0] if (m := NAME.match(text, at, end)) else None
            else:
                quoted = False
        else:
            break
        at = end
        first = False
        if not (p := PLUS.match(text, at)):
            break
        at = p.end()
        only = None
    return Value.joined(value) if value else Value.of(""), spans, quoted, only


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose values reach sensitive names with a score of ``LEAST`` or more."""
    constants = Constants()
    found: set[tuple[int, int]] = set()
    runs, marked = Runs(text), {}

    def mark(spans: list) -> None:
        """Add all spans below; every shared list is walked once (``marked`` keeps it, so its id stays its own)."""
        todo = [spans]
        while todo:
            at = todo.pop()
            if isinstance(at, tuple):
                found.add(at)
            elif id(at) not in marked:
                marked[id(at)] = at
                todo += at

    waiting: list[tuple[str, str, int]] = []
    for m in PAIR.finditer(text):
        name = m["quoted"] or m["ident"]
        value, spans, quoted, only = expression(text, m.end(), constants, runs)
        chained = [a for a, b, end in waiting if b == name and end == m.start()]
        waiting = [(a, name, m.start()) for a in chained]
        if only and PAIR.match(text, m.end()):
            waiting = [(x, only, m.end()) for x in [name, *chained]]
            continue
        if not spans:
            continue
        for target in [name, *chained]:
            constants[target] = (value, spans, quoted)
            score = name_score(target)
            if score > 0 and (look := literal_score(value, quoted)) > 0 and score + look >= LEAST:
                mark(spans)
    return sorted(s for s in found if s[1] > s[0])


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text) and any(w in low for w in _TRIGGERS):
        out += [("lexed", *s) for s in lexed(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` to key and spans (array of kind, start, end)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _TYPE)], [key, "spans"])

    return arrow_map(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, spans {SPANS}", 256)


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every maximal run of overlapping spans replaced by ``mark``."""
    merged: list[list[int]] = []
    for _, s, e in find_spans(text):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in reversed(merged):
        text = text[:s] + mark + text[e:]
    return text


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all its columns, the secrets in the text replaced."""
    at = docs.columns.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(b.columns)
        cols[at] = pa.array([redact_text(t.as_py(), mark) for t in b.column(at)], pa.string())
        return pa.RecordBatch.from_arrays(cols, b.schema.names)

    return arrow_map(docs, run, docs.schema, 256)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.kind = '{}')) as long) AS n_{}"
    return found.selectExpr(
        "doc_id", *(count.format(k, k) for k in KINDS[:3]),
        f"sha2({joined.format("filter(spans, s -> s.kind <> 'lexed')")}, 256) AS base_sha256", f"{joined.format('spans')} AS spans",
    )
