"""Secret scans through a trigram index.

Each rule is a regular expression. From its parse tree follows a Boolean query
over trigrams that any match must hold (case folded). A batch of texts is a
shard of the index: the trigrams that the rules ask for get postings of texts,
a rule's query intersects and unites them, and only the texts left are searched
with the expression itself. A rule without a mandatory trigram searches all
texts. No row leaves its task, so no key can be hot and nothing is shuffled.

Defined results: a null or empty text has no spans. Spans are in code points,
end exclusive, leftmost and non-overlapping within a kind, sorted by start and
then by the order of the rules; kinds may overlap each other. A private key runs
from its BEGIN line to its END line or, where that is missing, to its last line
of base64. Rows are scanned alone; other columns, whatever their names, pass through ``redact`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.words import pieces, utf8

MOST_STRINGS = 64  # alternatives a query keeps apart before it falls back to fewer trigrams


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# A private key: what stands between the lines of its body (quotes, comment marks and written-out line breaks too), the
# headers, and a line of the body. Repeats are possessive, so that a text is read once.
GAP = r"""(?:["']\s*[+.]\s*["']|\\+[nrt]|<br\s*/?>|[\s"'`,;>#*|\\])"""
HEADERS = rf"(?:{GAP}++(?:(?:Proc-Type|DEK-Info):\s*[A-Za-z0-9,-]++|(?:Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+))*+"
LINES = rf"(?:{GAP}++[A-Za-z0-9+/]{{20,}}+={{0,2}})*+"
LAST_LINE = rf"(?:(?:[\r\n]|\\+n){GAP}*+[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t\"',;\\]*(?:[\r\n]|\Z)|\\))?"
KEY = r"[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
# Published formats of credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", rf"-----BEGIN {KEY}{HEADERS}(?:(?:{GAP}|[A-Za-z0-9+/=])*+-----END {KEY}|{LINES}{LAST_LINE})"),
    Rule("url_login", r"://[^/\s:@]+:[^/\s:@]+@"),
)
RULES = BASE + MORE


# --- trigram queries: True (no demand), a trigram, ("and", ...) or ("or", ...) ---


def both(*parts):
    kept = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def either(*parts):
    parts = tuple(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def of_strings(strings: frozenset[str]):
    """What a text must hold if it holds one of the strings."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def strings_of(node) -> frozenset[str] | None:
    """All strings a parse node can match, folded, or None if there are too many to list."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return frozenset([chr(value).lower()])
    if kind == "IN":
        if len(value) <= 6 and all(str(k) == "LITERAL" for k, _ in value):
            return frozenset(chr(v).lower() for _, v in value)
        return None
    if kind == "SUBPATTERN":
        return strings_of_all(value[3])
    if kind == "BRANCH":
        options = [strings_of_all(x) for x in value[1]]
        return None if None in options else frozenset().union(*options)
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
        once = strings_of_all(value[2])
        return None if once is None else once | {""} if value[0] == 0 else once
    return None


def strings_of_all(nodes) -> frozenset[str] | None:
    out = frozenset([""])
    for node in nodes:
        more = strings_of(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a, b in product(out, more))
    return out


def demand(nodes):
    """The query of a sequence of parse nodes: neighbouring short lists of strings are joined before they are cut to trigrams."""
    parts, run = [], frozenset([""])
    for node in nodes:
        strings = strings_of(node)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        parts.append(of_strings(run))
        run = frozenset([""]) if strings is None else strings
        if strings is None:
            parts.append(inner(node))
    return both(*parts, of_strings(run))


def inner(node):
    kind, value = str(node[0]), node[1]
    if kind == "SUBPATTERN":
        return demand(value[3])
    if kind == "BRANCH":
        return either(*(demand(x) for x in value[1]))
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
        return demand(value[2])
    return True


def trigram_query(pattern: str):
    return demand(re._parser.parse(pattern))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


class Index:
    """Postings of the wanted trigrams over one shard of texts."""

    def __init__(self, wanted: list[str]):
        self.number = {t: k + 1 for k, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for t, k in self.number.items():
            a, b, c = t.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = k
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n = len(offsets) - 1
        folded = self.fold[data]
        hits = self.table[folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]] if len(data) > 2 else np.zeros(0, np.uint8)
        at = np.flatnonzero(hits)
        text = np.searchsorted(offsets, at, side="right") - 1
        own = at + 2 < offsets[text + 1]
        pairs = np.unique(hits[at[own]].astype(np.int64) << 40 | text[own])
        number = pairs >> 40
        cuts = np.searchsorted(number, np.arange(1, len(self.number) + 2))
        self.postings = [pairs[a:b] & ((1 << 40) - 1) for a, b in zip(cuts, cuts[1:])]

    def find(self, query) -> np.ndarray:
        """Texts that may match, in order."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings[self.number[query] - 1]
        parts = sorted((self.find(q) for q in query[1:]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    # a fixed character outside ASCII can't be folded bytewise: such a trigram is no demand
    queries = [q if all(t.isascii() for t in trigrams(q)) else True for q in queries]
    return Index([t for t in wanted if t.isascii()]), [(r, r.compiled(), q) for r, q in zip(rules, queries)]


def spans_of(texts: list[str], data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, str, int]]]:
    """Per text (start, rank of the rule, kind, end), sorted."""
    index, own = compiled(rules)
    index.build(data, offsets)
    out: list[list] = [[] for _ in texts]
    for rank, (rule, expression, query) in enumerate(own):
        for k in index.find(query).tolist():
            for m in expression.finditer(texts[k]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[k].append((m.start(), rank, rule.kind, m.end()))
    for found in out:
        found.sort()
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def batches_with_spans(batch: pa.RecordBatch, column: pa.Array, rules) -> Iterator[tuple[int, int, list[str], list]]:
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        texts = [x or "" for x in column.slice(a, b - a).to_pylist()]
        yield a, b, texts, spans_of(texts, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rules)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, spans in batches_with_spans(batch, batch.column(1), rules):
                found = pa.array([[{"kind": k, "start": s, "end": e} for s, _, k, e in x] for x in spans], SPANS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, schema)


def masked(text: str, spans: list, mask: str) -> str:
    """Every code point that a span covers gives way, one mask for each run of them."""
    out, at = [], 0
    for start, _, _, end in spans:
        if start > at or not out:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced; all rows and columns stay, a null text stays null."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            new = []
            for _, _, texts, spans in batches_with_spans(batch, column, rules):
                new += [masked(t, s, mask) if s else t for t, s in zip(texts, spans)]
            arrays = list(batch.columns)
            arrays[place] = pa.array([None if null else t for t, null in zip(new, column.is_null().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
