"""Toxicity by maximum-scoring segments.

Words carry log-odds of toxic against other training texts under an informative
Dirichlet prior; words without a significant difference cost a small constant.
One linear scan (Ruzzo and Tompa) finds all maximal segments of a text, a
segment is significant by its extreme-value (Karlin-Altschul) score, and the
sum of the significant segments is calibrated to a probability on the training
texts.

Word counts cover every training text and combine before they shuffle; the
lexicon that travels to the tasks is whole or, beyond ``size``, an error; the calibration
reads a histogram of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, claim, pieces, stage

_PUNCTUATION = bytes(32 if chr(x) in ".,;:!?\"'()[]{}|-_*/<>" else x for x in range(256))


def tokens(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_PUNCTUATION).split()


def segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a text in linear time.

    ``hits`` are (word index, score) of the words that are not neutral, in
    order; every neutral word scores ``-cost``.
    """
    kept: list[list] = []  # start, end, sum before it, sum up to its end, and the last kept one with a smaller sum before
    total, at = 0.0, 0
    for i, s in hits:
        total -= cost * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        k = [i, i + 1, before, total, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= k[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= k[3]:
                k[4] = j
                kept.append(k)
                break
            k = [kept[j][0], k[1], kept[j][2], k[3], -1]
            del kept[j:]
    return [(a, b, r - p) for a, b, p, r, _ in kept]


@dataclass
class ToxicModel:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    cost: float = 0.1
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 0.1  # K
    slope: float = 0.0
    offset: float = 0.0

    def evidence(self, raw: bytes, alpha: float = 0.05) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of normalised scores of the significant segments, and the segments."""
        words = tokens(raw)
        lex = self.lexicon
        hits = [(i, lex[w]) for i, w in enumerate(words) if w in lex]
        if not hits:
            return 0.0, []
        found = []
        limit = -math.log(-math.log1p(-alpha))  # a normalised score that chance reaches with probability alpha
        for a, b, s in segments(hits, self.cost):
            norm = self.rate * s - math.log(self.scale * max(len(words), 1))
            if norm > limit:
                found.append((a, b, norm))
        return sum(x[2] for x in found), found

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * math.log1p(evidence)))))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, toxic, other): texts of each label that hold the word, over all training rows of (text, toxic).

    A text counts a word once, so one text that repeats itself proves nothing; slices are counted before anything moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in pieces(batches, "text"):
            both: tuple[Counter, Counter] = (Counter(), Counter())
            for raw, t in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                both[t].update(set(tokens(raw)))
            words = list(both[0] | both[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([both[1][w] for w in words], pa.int64()), pa.array([both[0][w] for w in words], pa.int64())],
                names=["word", "toxic", "other"],
            )

    counted = train.select("text", "toxic").mapInArrow(run, "word binary, toxic long, other long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit_toxicity(train: DataFrame, prior: float = 0.1, least_z: float = 3.0, size: int = 500_000) -> ToxicModel:
    """Learn from (text, toxic) with toxic 0 or 1; rows with another label are left out. Without both labels every score is (almost) 0.

    ``prior`` is the weight of the Dirichlet prior as a share of the corpus, so it means the same at every size.
    The lexicon holds every word of either sign with |z| >= ``least_z``; if there are more than ``size``, it stops with an error.
    """
    rows = stage(train.where("toxic in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")), "toxic-train")
    counts = stage(word_counts(rows), "toxic-words")
    n = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    if not n["t"] or not n["o"]:
        return ToxicModel(offset=-30.0)
    t, o, every = float(n["t"]), float(n["o"]), float(n["t"] + n["o"])
    a, prior_size = F.lit(prior) * (F.col("toxic") + F.col("other")), prior * every  # the prior is the whole corpus, shrunk
    yt, yo = F.col("toxic") + a, F.col("other") + a
    delta = F.log(yt / (F.lit(t + prior_size) - yt)) - F.log(yo / (F.lit(o + prior_size) - yo))
    scored = counts.withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(1 / yt + 1 / yo))
    lex = scored.where(F.abs("z") >= least_z).orderBy("word").select("word", "delta", "toxic", "other").limit(size + 1).collect()
    if len(lex) > size:
        raise ValueError(f"more than {size} words reach |z| >= {least_z}; raise size or least_z")
    model = ToxicModel({bytes(r["word"]): float(r["delta"]) for r in lex})
    _chance(model, [(float(r["delta"]), r["other"] / o) for r in lex])
    _calibrate(model, rows)
    return model


def _chance(model: ToxicModel, law: list[tuple[float, float]]) -> None:
    """lambda as the root of sum p exp(lambda s) = 1 over the score law of other texts; the drift is made negative first."""
    mean = sum(s * p for s, p in law)
    model.cost = max(0.05, 0.05 + mean)
    rest = 1 - sum(p for _, p in law)

    def f(x: float) -> float:
        return sum(p * math.exp(min(x * s, 700)) for s, p in law) + rest * math.exp(-x * model.cost) - 1

    if not any(s > 0 and p > 0 for s, p in law):
        model.rate = math.log(2)
        return
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    model.rate = min(hi, 5.0)


def _calibrate(model: ToxicModel, rows: DataFrame, bins: int = 512) -> None:
    """Logistic fit of the label on the evidence, from a histogram over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        hist = np.zeros((bins, 2), np.int64)
        for b in pieces(batches, "text"):
            for raw, t in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                hist[min(bins - 1, int(40 * math.log1p(model.evidence(raw)[0]))), t] += 1
        at = np.flatnonzero(hist.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hist[at, 0]), pa.array(hist[at, 1])], names=["bin", "zero", "one"])

    got = rows.mapInArrow(run, "bin long, zero long, one long").groupBy("bin").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).collect()
    x = np.array([r["bin"] / 40 + 0.0125 * (r["bin"] > 0) for r in got])
    y1, n = np.array([r["one"] for r in got], float), np.array([r["one"] + r["zero"] for r in got], float)
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (y1 - n * p) - 1e-3 * w
        h = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = np.clip(w + np.clip(np.linalg.solve(h, g), -2, 2), -30, 30)
    model.offset, model.slope = float(w[0]), float(max(w[1], 0.0))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", held_out: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, passages (first word, end word, normalised score).

    NULL and empty texts have no passage and get the score of such texts.
    Repeated rows are scored alike; other columns are not read.
    """
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in pieces(batches, "text"):
            found = [model.evidence(raw) for raw in as_bytes(b.column(2))]
            p = [model.probability(e) for e, _ in found]
            spans = [[{"start": s, "end": t, "score": v} for s, t, v in x] for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(spans, passage)],
                names=["doc_id", "held_out", "score", "predicted", "passages"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start: int, end: int, score: double>>")
