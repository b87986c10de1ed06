"""Secret scan by password guess cost.

Values that stand in a credential context are cut into dictionary words, dates,
repeats, keyboard walks and brute-force spans so that the guesses needed are
fewest (a dynamic program over the value); a value that even then takes many
guesses is a secret. Fixed patterns for assignments, access keys and long
hexadecimal runs come beside it.

The dictionary is every word with at least one in ``1 << SHARE`` of all word
occurrences, counted over all documents, so it holds at most ``1 << SHARE``
words at every size; it travels to the tasks. Costs are thousandths of a bit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import comb, log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, claim, pieces, stage

SHARE = 18
LEAST_BITS = 40.0
LEAST_CHARS = 8
LONGEST_WORD = 24
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A name that announces a credential, then a separator; what follows up to white space, a quote or a bracket is the value.
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|api[_-]?key|(?:access|private|secret|signing|encryption)[_-]?key)"
    r"(?:[\"']?[\x20\t]*(?:[:=]|=>)|[\x20\t]+is)[\x20\t]*[\"']?(?:(?:bearer|basic)[\x20\t]+)?([^\s\"'<>(){}\[\],;]+)"
    r"|(?<![A-Za-z0-9])bearer[\x20\t]+([^\s\"'<>(){}\[\],;]+)|://[^\s:/@]+:([^\s/@]+)@",
    re.ASCII | re.IGNORECASE,
)
#: One of these is in every text, lower-cased, that the patterns above find something in.
NAMES = ("pass", "pwd", "secret", "token", "credential", "auth", "key", "bearer", "://")
_HEX_RUN, _HEX = b"h" * 24, bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

# fixed values: keyboard rows, each shifted half a key to the right of the one above, and usual letter substitutes
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_KEY = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_STEPS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
_PLAIN = str.maketrans(SUBSTITUTES | {chr(c): chr(c + 32) for c in range(65, 91)})
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
DATES = [
    (re.compile(rf"{_YEAR}"), log2(200)),
    (re.compile(rf"{_YEAR}{_MONTH}{_DAY}|{_DAY}{_MONTH}{_YEAR}|{_MONTH}{_DAY}{_YEAR}"), log2(200 * 366 * 3)),
    (re.compile(rf"{_YEAR}([-/._]){_MONTH}\1{_DAY}|{_DAY}([-/._]){_MONTH}\2{_YEAR}|{_MONTH}([-/._]){_DAY}\3{_YEAR}"), log2(200 * 366 * 3 * 4)),
    (re.compile(rf"{_DAY}{_MONTH}\d\d|\d\d{_MONTH}{_DAY}"), log2(100 * 366 * 2)),
]


def milli(bits: float) -> int:
    return round(1000 * bits)


#: What starting one more span adds: the kinds to choose from.
SPAN = milli(log2(5))


def char_cost(c: str) -> int:
    """Brute force: the size of the character's class."""
    return milli(log2(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 2048))


def word_cost(part: str, costs: dict[str, int]) -> int | None:
    """A dictionary word by its frequency, with capitals and substituted letters; None if it is none."""
    lower = part.translate(_PLAIN)
    base = costs.get(lower)
    if base is None:
        return None
    upper = sum("A" <= c <= "Z" for c in part)
    odd = sum(c in SUBSTITUTES for c in part)
    cased = 0 if not upper else 1 if upper == len(part) or (upper == 1 and "A" <= part[0] <= "Z") else 1 + log2(comb(len(part), upper))
    return base + milli(cased + (1 + log2(comb(len(part), odd)) if odd else 0))


def walks(value: str) -> list[tuple[int, int, int]]:
    """(start, end, cost) of the longest walks over neighbouring keys, three keys at least; every turn is a new direction to guess."""
    out, start, turns, step = [], 0, 0, None
    at = [_KEY.get(c.lower() if c < "\x80" else c) for c in value]
    for i in range(1, len(value) + 1):
        now = None
        if i < len(value) and at[i] and at[i - 1]:
            now = (at[i][0] - at[i - 1][0], at[i][1] - at[i - 1][1])
        if now in _STEPS:
            turns, step = turns + (now != step), now
            continue
        if i - start >= 3:
            out.append((start, i, milli(log2(len(_KEY)) + log2(i - start) + turns * log2(len(_STEPS)))))
        start, turns, step = i, 0, None
    return out


def repeats(value: str, longest: int = 8) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the longest runs of a unit of at most ``longest`` characters, twice or more and three characters at least."""
    out = []
    for p in range(1, min(longest, len(value) // 2) + 1):
        i = 0
        while i + p < len(value):
            j = i
            while j + p < len(value) and value[j] == value[j + p]:
                j += 1
            n = (j - i + p) // p
            if n > 1 and n * p > 2:
                out.append((i, i + n * p, p))
            i = max(j, i) + 1
    return out


def spans_of(value: str, costs: dict[str, int]) -> dict[int, list[tuple[int, int, str]]]:
    """All spans the program may use but brute force, by their end: (start, cost, kind)."""
    out: dict[int, list[tuple[int, int, str]]] = {}
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            c = word_cost(value[i:j], costs)
            if c is not None:
                out.setdefault(j, []).append((i, c, "word"))
        if "0" <= value[i] <= "9":
            for pattern, bits in DATES:
                m = pattern.match(value, i)
                if m:
                    out.setdefault(m.end(), []).append((i, milli(bits), "date"))
    for i, j, c in walks(value):
        out.setdefault(j, []).append((i, c, "walk"))
    for i, j, p in repeats(value):
        out.setdefault(j, []).append((i, best_cut(value[i : i + p], costs)[0] + milli(log2((j - i) // p)), "repeat"))
    return out


def best_cut(value: str, costs: dict[str, int]) -> tuple[int, list[tuple[int, int, str]]]:
    """Least cost (thousandths of a bit) of all ways to cut ``value`` into spans, and the spans (start, end, kind) of the first such way."""
    spans = spans_of(value, costs)
    n = len(value)
    whole, forced, back, begun = [0] * (n + 1), [1 << 60] * (n + 1), [(0, "")] * (n + 1), [0] * (n + 1)
    for j in range(1, n + 1):
        # a brute-force span goes on or starts here
        on, new = forced[j - 1], whole[j - 1] + SPAN
        forced[j] = char_cost(value[j - 1]) + min(on, new)
        begun[j] = begun[j - 1] if on < new else j - 1
        whole[j], back[j] = forced[j], (begun[j], "brute")
        for i, c, kind in spans.get(j, ()):
            if whole[i] + SPAN + c < whole[j]:
                whole[j], back[j] = whole[i] + SPAN + c, (i, kind)
    cut, j = [], n
    while j:
        i, kind = back[j]
        cut.append((i, j, kind))
        j = i
    return whole[n], cut[::-1]


def fixed_spans(text: str, raw: bytes, named: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, code points, end exclusive; cheap tests leave out texts that can hold none."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if named else []
    out += [(*m.span(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(*m.span(), "hex") for m in HEX.finditer(text)] if _HEX_RUN in raw.translate(_HEX) else []
    return out


def credential_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values in credential contexts, without closing punctuation, ``LEAST_CHARS`` characters at least."""
    out = []
    for m in CONTEXT.finditer(text):
        i, j = m.span(m.lastindex)
        if text[j : j + 1] != "@":
            j = i + len(text[i:j].rstrip(".:!?"))
        if j - i >= LEAST_CHARS:
            out.append((i, j))
    return out


def scan(raw: bytes, costs: dict[str, int], least: float = LEAST_BITS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) by start, then kind: the fixed patterns and values that take 2^least guesses or more; bits only for those."""
    text = raw.decode()
    small = raw.lower().decode()
    named = any(x in small for x in NAMES)
    found = [(k, i, j, None) for i, j, k in fixed_spans(text, raw, named)]
    for i, j in credential_values(text) if named else ():
        if not any(a < j and i < b for _, a, b, _ in found):
            bits = best_cut(text[i:j], costs)[0] / 1000
            if bits >= least:
                found.append(("guess", i, j, bits))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def word_costs(docs: DataFrame, text_col: str = "text", share: int = SHARE) -> dict[str, int]:
    """Guess cost of every word of 3 to 24 letters with at least one in 2^share of all occurrences: how rare it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in pieces(batches, "text", 16 << 20):
            n: Counter = Counter()
            for raw in as_bytes(b.column("text")):
                n.update(raw.translate(_LETTERS).split())
            found = [(w, c) for w, c in ((w.decode(), c) for w, c in n.items()) if 3 <= len(w) <= LONGEST_WORD]
            yield pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in found)], pa.string()), pa.array([sum(c for _, c in found), *(c for _, c in found)], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    counts = stage(rows.groupBy("word").agg(F.sum("n").alias("n")), "guess-words")
    total = counts.where("word is null").first()
    if not total or not total.n:
        return {}
    got = counts.where("word is not null").where(F.col("n") * F.lit(1 << share).cast("decimal(20,0)") >= F.lit(total.n)).toArrow()  # at most 2^share rows
    return {w: milli(log2(total.n / c)) for w, c in zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True)}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, least: float = LEAST_BITS) -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end, bits) by start, then kind.

    Places are code points, the end exclusive. Kinds are ``assign``, ``access``, ``hex`` (fixed patterns) and ``guess`` (values in
    credential contexts that take 2^least guesses or more and overlap no other span; bits says how many). NULL and empty texts have no spans; repeated
    rows are scanned alike; an empty table gives an empty result; other columns are not read. A long text is scanned whole.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.sparkContext.broadcast(word_costs(docs, text_col, share))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        costs = known.value
        for b in pieces(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "bits"), x, strict=True)) for x in scan(raw, costs, least)] for raw in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, span)], names=["doc_id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,bits:double>>")


def digest_spans(found: DataFrame) -> DataFrame:
    """doc_id, numbers of fixed spans by kind, their digest, and all spans, each as kind:start:end."""

    def said(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"

    fixed = F.expr(said("filter(spans, s -> s.kind <> 'guess')"))
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count[:3], F.sha2(fixed, 256).alias("base_sha256"), F.expr(said("spans")).alias("spans"), count[3])
