"""Secrets in texts, found through a trigram index.

Method: each rule's regular expression is parsed for the trigrams that every match must
contain, as a Boolean query. Documents are indexed where they lie: each slice of rows gets
posting lists for the rules' trigrams, a query intersects and unites them, and the regular
expression verifies the rows that are left. A rule without mandatory trigrams reads every
row. The index covers whole texts and is bounded by a slice; nothing is shuffled.

Defined results: a null or empty text has no spans; repeated rows and null ids give a row
each; an empty table gives an empty result; extra columns are ignored by ``scan`` and kept
by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palestra.llm.arrays import LOWER, joined, slices


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; those whose ``group`` is shorter than
    ``least`` are dropped after matching. ``value`` is the group that holds the secret,
    ``whole`` the one whose span is reported."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    value: int = 0
    whole: int = 0


# Between the lines of a key: white space, also escaped, and what code and quotes put there.
_GAP = r"""(?:\\[nrt]|[\s"'>#*|,\\]|\+(?=\s))*+"""
# From the header to the footer, or without one to the end of the lines of base64; a short
# last line counts if it stands alone.
_KEY = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:"
    r"(?:[^-]|-(?!----BEGIN ))*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?>(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*)*)"
    rf"(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})+"
    rf"(?:{_GAP}[A-Za-z0-9+/]++={{0,2}}(?=[ \t]*(?:[\r\n\\\"']|\Z)))?"
    r"|)"
)

# fixed values: the first three rules
BASE_RULES = (
    Rule(
        "assign",
        r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, value=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # a maximal run that is long enough; shorter runs would be dropped anyway
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
MORE_RULES = (
    Rule("private_key", _KEY),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    # begins where a run of such characters does, so that long runs are read once
    Rule(
        "url_login", r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]++://[^/\s:@]++:([^/\s:@]{3,}+)@)",
        value=2, whole=1,
    ),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no condition), a trigram, ("and", ...) or ("or", ...).


def _both(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _grams(text: str):
    return _both([text[i : i + 3] for i in range(len(text) - 2)])


def _query(tokens):
    """What a match must contain. Literals that follow each other form one text; anything
    else ends it and adds its own condition."""
    parts, text = [], ""
    for op, value in tokens:
        if op is sre.LITERAL and value < 128:
            text += chr(value).lower()
            continue
        parts.append(_grams(text))
        text = ""
        if op is sre.SUBPATTERN:
            parts.append(_query(value[-1]))
        elif op is sre.BRANCH:
            found = [_query(branch) for branch in value[1]]
            parts.append(True if True in found else ("or", *found))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            parts.append(_query(value[2]))
    return _both([*parts, _grams(text)])


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression, on lower-case bytes. A branch with
    a common start is parsed as one; then the parts hold what is left of each."""
    return _query(_parser.parse(pattern, re.ASCII))


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:]))


class _Index:
    """Posting lists of the wanted trigrams for the rows of one slice."""

    _wanted: dict[frozenset, np.ndarray] = {}

    def __init__(self, data: np.ndarray, offsets: np.ndarray, grams: frozenset[str]):
        codes = sorted(int.from_bytes(g.encode(), "big") for g in grams)
        if grams not in _Index._wanted:
            table = np.zeros(1 << 24, bool)
            table[codes] = True
            _Index._wanted[grams] = table
        low = LOWER[data].astype(np.int32)
        found = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else low[:0]
        at = np.flatnonzero(_Index._wanted[grams][found])
        rows = np.searchsorted(offsets, at, "right") - 1
        self._postings = {c: np.unique(rows[found[at] == c]) for c in codes}
        self._all = np.arange(len(offsets) - 1)

    def rows(self, query) -> np.ndarray:
        if query is True:
            return self._all
        if isinstance(query, str):
            return self._postings[int.from_bytes(query.encode(), "big")]
        lists = sorted((self.rows(q) for q in query[1:]), key=len)
        merge = np.intersect1d if query[0] == "and" else np.union1d
        found = lists[0]
        for other in lists[1:]:
            found = merge(found, other)
        return found


class Scanner:
    """Finds the spans of all rules in a slice of rows."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.grams = frozenset().union(*(_trigrams(q) for _, _, q in self.rules))

    def spans(self, column: pa.Array) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """By row: (start, number of the rule, end, start and end of the secret itself)."""
        index = _Index(*joined(column), self.grams)
        found: dict[int, list] = {}
        texts = {}
        for number, (rule, regex, query) in enumerate(self.rules):
            for row in index.rows(query).tolist():
                if row not in texts:
                    texts[row] = column[row].as_py() or ""
                for m in regex.finditer(texts[row]):
                    if len(m[rule.group]) >= rule.least:
                        found.setdefault(row, []).append((m.start(rule.whole), number, m.end(rule.whole), *m.span(rule.value)))
        return {row: sorted(spans) for row, spans in found.items()}


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all
    spans as text ``kind:start:end`` in code points."""
    schema = T.StructType(
        [docs.schema["doc_id"], *(T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE_RULES),
         T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )
    kinds, base = [r.kind for r in rules], len(BASE_RULES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        empty = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches):
            n = batch.num_rows
            counts = np.zeros((base, n), np.int64)
            digests, texts = [empty] * n, [""] * n
            for row, spans in scanner.spans(batch.column("text")).items():
                shown = [(k, f"{kinds[k]}:{start}:{end}") for start, k, end, _, _ in spans]
                for k, _ in shown:
                    if k < base:
                        counts[k, row] += 1
                own = ",".join(s for k, s in shown if k < base)
                digests[row] = hashlib.sha256(own.encode()).hexdigest()
                texts[row] = ",".join(s for _, s in shown)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets, and ``n_chars``
    corrected in changed rows."""
    kinds = [r.kind for r in rules]
    # names by position, since a column may have any name
    names = [f"c{k}" for k in range(len(docs.columns))]
    text_column = names[docs.columns.index("text")]
    size_column = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None

    def clean(text: str, spans) -> str:
        parts, done = [], 0
        for start, end, k in sorted((s, e, k) for _, k, _, s, e in spans):
            if start >= done:
                parts += [text[done:start], f"[{kinds[k]}]"]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in slices(batches, text_column):
            found = scanner.spans(batch.column(text_column))
            if found:
                texts = batch.column(text_column).to_pylist()
                for row, spans in found.items():
                    texts[row] = clean(texts[row], spans)
                columns = dict(zip(batch.schema.names, batch.columns))
                columns[text_column] = pa.array(texts, columns[text_column].type)
                if size_column:
                    sizes = columns[size_column].to_pylist()
                    for row in found:
                        sizes[row] = len(texts[row])
                    columns[size_column] = pa.array(sizes, columns[size_column].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            yield batch

    plain = docs.toDF(*names)
    return plain.mapInArrow(rows, plain.schema).toDF(*docs.columns)
