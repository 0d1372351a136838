"""Secret scan by assignment-aware lexing (operator 1).

Three fixed patterns give the base spans. The method adds `lexed` spans: source and configuration syntax is read as
name-literal pairs (`name = "..."`, `name: ...`, `name => ...`, `<name>...</name>`, command-line flags, URL parameters and
concatenations), names that hold constants are propagated to later assignments, and every literal is scored by the
sensitivity of the names it reaches and by its own shape.

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; spans count code points of the whole
text, with no limit on its length; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from foresift.llm.common import map_rows

# fixed patterns and least lengths of the base kinds, in the order in which ties are listed
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")       # runs are maximal, so the least length can stand in the pattern
KINDS = ("assign", "access", "hex", "lexed")

# sensitive parts of a target name and their weights
SENSITIVE = (
    ("private_key", 1.0), ("privatekey", 1.0), ("secret_key", 1.0), ("secretkey", 1.0), ("access_key", 1.0), ("accesskey", 1.0),
    ("api_key", 1.0), ("apikey", 1.0), ("password", 1.0), ("passwd", 1.0), ("passphrase", 1.0), ("secret", 1.0),
    ("auth_token", 1.0), ("token", 0.9), ("bearer", 0.9), ("credential", 0.9), ("pwd", 0.9), ("signing_key", 0.9),
    ("encryption_key", 0.9), ("connection_string", 0.8), ("auth", 0.6), ("session", 0.5), ("key", 0.4), ("salt", 0.4),
)
# values that stand for a secret in examples
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*+|\.+|changeme|change_me|example|sample|dummy|none|null|true|false|todo|test|"
                         r"your[_-].*|my[_-]?(?:password|secret|token)|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|env[:.].*)$")

NAME = r"[A-Za-z_$][\w$.\-]*"
STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
# what may follow the run of name characters that a name ends with; nothing here is read twice
_PAIR_REST = re.compile(
    rf"""["'\]]{{0,2}}+(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w., ]*+\])?+(?=[ \t]*+=))?"""
    rf"""[ \t]*+(?P<op>:=|=>|=(?![=~])|:(?![:/]))[ \t]*+(?P<rhs>(?:{STRING}|[A-Za-z0-9+/_.=\-$]++)"""
    rf"""(?:[ \t]*+(?:[+.&][ \t]*+)?(?:{STRING})|[ \t]*+\+[ \t]*+{NAME})*+)""", re.ASCII)
_NAME_RUN = re.compile(r"[\w$.\-]++", re.ASCII)
_NAME_START = re.compile(r"[A-Za-z_$]")
_TAG = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*)>(?P<rhs>[^<>\s]{6,})</(?P=name)>")
_FLAG_RUN, _FLAG_START = re.compile(r"[a-z\-]++"), re.compile(r"--(?=[a-z])")
_FLAG_REST = re.compile(rf"[ \t]++(?P<rhs>{STRING}|[A-Za-z0-9+/_.=\-]{{6,}}+)")
_ATOM = re.compile(rf"{STRING}|[A-Za-z0-9_$.+/=\-]+", re.ASCII)
_FIRST = re.compile(r"[:=]|--[a-z]|</")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_weight(name: str) -> float:
    """Sensitivity of a target name: the heaviest sensitive part that it holds."""
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_")
    return max((w for part, w in SENSITIVE if part in plain), default=0.0)


def literal_weight(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret: length, mixed character classes and entropy; 0 for placeholders and prose."""
    return _Value.literal(0, value, quoted).weight()


class _Value:
    """A literal or a concatenation: what its weight needs, and the literals in it as references.

    Concatenations add up lengths and character counts, so that a chain of names costs no more than its lines, however often
    literals repeat in it.
    """
    EDGE = 64

    def __init__(self, parts: list["_Value"], spans: list[tuple[int, int]], n: int, chars: Counter, edges: tuple[str, str], quoted: bool):
        self.parts, self.spans, self.n, self.chars, self.edges, self.quoted = parts, spans, n, chars, edges, quoted
        self.shown = False

    @classmethod
    def literal(cls, start: int, value: str, quoted: bool) -> "_Value":
        n = len(value)
        edges = (value, "") if n <= 2 * cls.EDGE else (value[:cls.EDGE], value[-cls.EDGE:])
        return cls([], [(start, start + n)], n, Counter(value), edges, quoted)

    @classmethod
    def joined(cls, parts: list["_Value"]) -> "_Value":
        if len(parts) == 1:
            return parts[0]
        chars: Counter = Counter()
        for p in parts:
            for c, k in p.chars.items():
                chars[c] += k
        n = sum(p.n for p in parts)
        whole = "".join("".join(p.edges) for p in parts)
        edges = (whole, "") if n <= 2 * cls.EDGE else (whole[:cls.EDGE], whole[-cls.EDGE:])
        return cls(parts, [], n, chars, edges, all(p.quoted for p in parts))

    def weight(self) -> float:
        n, chars = self.n, self.chars
        # of long values the edges decide whether they are placeholders
        if n < 6 or PLACEHOLDER.match("".join(self.edges)) or any(c.isspace() for c in chars):
            return 0.0
        digits = sum(k for c, k in chars.items() if c.isdigit())
        if not self.quoted and (digits == 0 or n < 8):
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in chars.values() if k / n > 0)
        classes = ((digits > 0) + any(c.islower() for c in chars) + any(c.isupper() for c in chars)
                   + any(not c.isalnum() for c in chars))
        return min(1.0, 0.3 + 0.1 * classes + 0.1 * min(entropy, 4.0) + 0.02 * min(n, 20) - (0.3 if digits == 0 else 0.0))

    def show(self) -> list[tuple[int, int]]:
        """The literals in it that no call has shown before."""
        out, todo = [], [self]
        while todo:
            value = todo.pop()
            if not value.shown:
                value.shown = True
                out += value.spans
                todo += value.parts
        return out


def _runs(text: str, run: re.Pattern, first: re.Pattern, rest: re.Pattern):
    """Matches of `rest` behind runs that hold a `first`: the name from there to the end of the run, and the match."""
    at = 0
    while m := run.search(text, at):
        at = m.end()
        begin = first.search(text, m.start(), m.end())
        if begin and (after := rest.match(text, at)):
            yield begin, text[begin.end() if first is _FLAG_START else begin.start():at], after
            at = after.end()


def _pairs(text: str) -> list[tuple[int, str, int, int]]:
    """(place, name, start and end of the right-hand side) in text order."""
    kinds = [(_NAME_RUN, _NAME_START, _PAIR_REST)] + ([(_FLAG_RUN, _FLAG_START, _FLAG_REST)] if "--" in text else [])
    out = [(b.start(), name, m.start("rhs"), m.end("rhs")) for kind in kinds for b, name, m in _runs(text, *kind)]
    if "</" in text:
        out += [(m.start(), m["name"], m.start("rhs"), m.end("rhs")) for m in _TAG.finditer(text)]
    return sorted(out)


def lexed_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, str]]:
    """Spans of literals that reach a sensitive name, directly or through names that hold them."""
    if not _FIRST.search(text):
        return []
    constants: dict[str, _Value] = {}
    found = []
    for _, name, start, end in _pairs(text):
        parts = []
        for m in _ATOM.finditer(text, start, end):
            if m[0][0] in "\"'`":
                parts.append(_Value.literal(m.start() + 1, m[0][1:-1], True))
            elif m[0] in constants:
                parts.append(constants[m[0]])
            elif m[0] not in ("+", "."):
                parts.append(_Value.literal(m.start(), m[0], False))
        if not parts:
            constants.pop(name, None)
            continue
        # parts of one concatenation are judged together
        value = constants[name] = _Value.joined(parts)
        weight = name_weight(name)
        if weight and weight * value.weight() >= threshold:
            found += [(a, b, "lexed") for a, b in value.show() if b > a]
    return sorted(set(found))


def scan(text: str | None, threshold: float = 0.5) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind."""
    text = text or ""
    return sorted(base_spans(text) + lexed_spans(text, threshold), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, array of spans (start, end, kind) over its whole text."""
    def make():
        def run(cols):
            return [cols[0], [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t, threshold)] for t in cols[1]]]
        return run
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col],
                    f"{id_col} {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>", make)


def span_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, digest of the base spans and text of all spans."""
    from pyspark.sql import functions as F

    def text(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.kind != "lexed")
    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    count = {k: of_kind(k) for k in KINDS}
    return spans.select(F.col(id_col), count["assign"], count["access"], count["hex"],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
                        count["lexed"])


def mask_text(text: str | None, mask: str = "[SECRET]", threshold: float = 0.5) -> str | None:
    """The text with each run of overlapping secret spans replaced by the mask; a null text stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in scan(text, threshold):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:] if at else text


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns and rows with secrets masked in the text."""
    place = docs.columns.index(text_col)

    def make():
        def run(cols):
            cols[place] = [mask_text(t) for t in cols[place]]
            return cols
        return run
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(docs, docs.columns, ddl, make)


def base_digest(text: str | None) -> str:
    spans = sorted(base_spans(text or ""), key=lambda s: (s[0], KINDS.index(s[2])))
    return hashlib.sha256(joined(spans).encode()).hexdigest()
