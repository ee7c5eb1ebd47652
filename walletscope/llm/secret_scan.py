"""Secret scans: three patterns, and windows of high Shannon entropy.

Patterns, leftmost and not overlapping per kind, too short matches dropped:
``assign`` (a name such as password or token, a separator, a value), ``access``
(AKIA...), ``hex`` (long runs of lower-case hexadecimal digits).

``entropy`` spans: candidates are runs of at least ``WINDOW`` characters of
base64 and its URL-safe form. A window slides over each candidate; the counts of
its characters, and the sum of ``c * log2(c)`` over them, are updated by the
character that enters and the one that leaves. Windows at or above the threshold
of the candidate's class (hexadecimal, or mixed) are joined to spans.
Candidates on the allow-list give none: plain words (letters, joined by hyphens,
slashes or underscores), numbers, UUIDs, dates, and repeated single characters.
A part between separators that contains an allowed word gives none either; what
stands before and after it is judged by itself.

Spans are code points, end exclusive. Null and empty texts have no spans. Every
row of the input gives one row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
HEX_CLASS = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
#: Bits a character, by class, for windows of 20.
THRESHOLD = {"hex": 3.0, "mixed": 3.8}
ALLOWED = re.compile(
    r"[A-Za-z][-A-Za-z_/+=]*\Z|[0-9]+(?:[-/_][0-9]+)*\Z|(.)\1*\Z"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z"
)
PART = re.compile(r"[A-Za-z0-9]+")
ALLOWED_WORDS = ("example", "placeholder", "changeme")
_CLOG = [0.0, *(c * log2(c) for c in range(1, WINDOW + 1))]

Span = tuple[int, int, int]  # start, number of the kind, end


def allowed(candidate: str) -> bool:
    return bool(ALLOWED.match(candidate))


def stretches(candidate: str) -> Iterator[tuple[int, str]]:
    """What is left of a candidate without its parts that hold an allowed word, as (start, characters)."""
    at, low = 0, candidate.lower()
    if any(w in low for w in ALLOWED_WORDS):
        for part in PART.finditer(candidate):
            if any(w in part[0].lower() for w in ALLOWED_WORDS):
                yield at, candidate[at : part.start()]
                at = part.end()
    yield at, candidate[at:]


def entropy_spans(candidate: str) -> list[tuple[int, int]]:
    """Joined windows of high entropy, as (start, end) in the candidate."""
    least = THRESHOLD["hex" if HEX_CLASS.match(candidate) else "mixed"]
    most = (log2(WINDOW) - least) * WINDOW + 1e-9  # the entropy falls as the sum of c * log2(c) grows
    counts = Counter(candidate[:WINDOW])
    total = sum(_CLOG[c] for c in counts.values())
    spans: list[tuple[int, int]] = []
    for at in range(len(candidate) - WINDOW + 1):
        if at:
            gone, came = candidate[at - 1], candidate[at + WINDOW - 1]
            c = counts[gone]
            total += _CLOG[c - 1] - _CLOG[c]
            counts[gone] = c - 1
            c = counts[came]
            total += _CLOG[c + 1] - _CLOG[c]
            counts[came] = c + 1
        if total <= most:
            if spans and spans[-1][1] >= at:
                spans[-1] = (spans[-1][0], at + WINDOW)
            else:
                spans.append((at, at + WINDOW))
    return spans


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text by start, kind and end."""
    if not text:
        return []
    spans: list[Span] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    # Every access or hex span of the least length lies in one candidate.
    for found in CANDIDATE.finditer(text):
        start, run = found.start(), found[0]
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            least = LEAST[KINDS[kind]]
            spans += [
                (start + m.start(), kind, start + m.end()) for m in pattern.finditer(run) if m.end() - m.start() >= least
            ]
        for at, left in stretches(run):
            if len(left) >= WINDOW and not allowed(left):
                spans += [(start + at + a, 3, start + at + b) for a, b in entropy_spans(left)]
    return sorted(spans)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(text: Column) -> Column:
    """Counts by kind, the digest of the pattern spans, and all spans."""
    columns = ["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
    types = ["bigint"] * 4 + ["string"] * 2

    @pandas_udf(", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True)))
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for found in map(find_spans, texts):
            base = written([s for s in found if s[1] < 3])
            kinds = [s[1] for s in found]
            rows.append((*map(kinds.count, range(4)), hashlib.sha256(base.encode()).hexdigest(), written(found)))
        return pd.DataFrame(rows, columns=columns)

    return scanned(text)


def without_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``; other texts stay as they are."""

    @pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = map(find_spans, texts)
            yield pd.Series([redacted(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op3_secret_scan(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), scan(F.col("text")).alias("found")).select(
        "doc_id", "found.*"
    )
