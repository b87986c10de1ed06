"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of its hashed 2- and 3-byte grams. Every
language has several centroids, found by spherical k-means, and a text gets the
language of the centroid with the highest cosine. A text farther from it than
nearly all of the language's own training texts is marked ``rejected``.

Document frequencies count every training text. Centroids are fitted on a
sample of at most about ``per_lang`` texts of a language, picked by hash, one
task per language; the model is ``max_langs`` x ``clusters`` vectors at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, pieces
from .mixing import uniform

DIM = 4096
_KEEP = bytes(32 if x < 65 or 90 < x < 97 or 122 < x < 128 else x for x in range(256))  # ASCII non-letters become spaces


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """(texts x DIM) counts of the byte 2- and 3-grams of every whole text, lower-cased."""
    raw = [b"  " + (t or "").lower().encode().translate(_KEEP) + b"  " for t in texts]
    n = len(raw)
    ends = np.cumsum([len(x) for x in raw])
    b = np.frombuffer(b"".join(raw) + b"   ", np.uint8).astype(np.uint32)
    x, y, z = b[:-3], b[1:-2], b[2:-1]
    y = y * np.uint32(0x85EBCA6B)
    two = (x * np.uint32(0x9E3779B1) + y) >> np.uint32(20)
    three = (x * np.uint32(0x27D4EB2F) ^ y ^ z * np.uint32(0xC2B2AE35)) * np.uint32(0x9E3779B1) >> np.uint32(20)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(ends, prepend=0))
    counts = np.zeros(n * DIM + 1, np.int64)
    for h in (two, three):
        at = row + h[: len(row)]
        at[ends - 1] = at[ends - 2] = n * DIM  # these grams would reach into the next text
        counts += np.bincount(at, minlength=n * DIM + 1)
    return counts[:-1].reshape(n, DIM)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; farthest-first start from the mean, so the result is fixed by the rows."""
    k = min(k, len(x))
    c = [x.mean(0) / max(np.linalg.norm(x.mean(0)), 1e-12)]
    near = x @ c[0]
    while len(c) < k:
        c.append(x[int(np.argsort(near)[len(near) // 20])])  # far out, but not the farthest: that is noise
        near = np.maximum(near, x @ c[-1])
    m = np.array(c)
    for _ in range(rounds):
        own = (x @ m.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                s = x[own == j].sum(0)
                m[j] = s / max(np.linalg.norm(s), 1e-12)
    return m.astype(np.float32)


def document_frequency(train: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each gram, over all training texts; DIM rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        df, n = np.zeros(DIM, np.int64), 0
        for b in pieces(batches, "text", 4 << 20):
            df += (gram_counts(b.column("text").to_pylist()) > 0).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], names=["bin", "df"])

    out = np.zeros(DIM + 1, np.int64)
    for r in train.select("text").mapInArrow(run, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect():
        out[r["bin"]] = r["df"]
    return out[:-1], int(out[-1])


class LanguageModel:
    """Centroids (rows sorted by language), idf weights and the rejection limit of each language."""

    def __init__(self, langs: list[str], centroids: np.ndarray, owner: np.ndarray, limits: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.owner, self.limits, self.idf = langs, centroids, owner, limits, idf

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cosine, rejected) of each text; equal cosines go to the first language in order."""
        if not self.langs:
            return [("und", 0.0, 0.0, True)] * len(texts)
        cos = vectors(gram_counts(texts), self.idf) @ self.centroids.T
        best = np.full((len(texts), len(self.langs)), -1.0, np.float32)
        for j, o in enumerate(self.owner):
            best[:, o] = np.maximum(best[:, o], cos[:, j])
        top = best.argmax(1)
        e = np.exp(25 * (best - best.max(1, keepdims=True)))
        score = 1 / e.sum(1)
        out = []
        for i, t in enumerate(texts):
            if not t or not any(c.isalpha() for c in t):
                out.append(("und", 0.0, 0.0, True))
            else:
                c = float(best[i, top[i]])
                out.append((self.langs[top[i]], float(score[i]), c, c < self.limits[top[i]]))
        return out


def fit_languages(train: DataFrame, id_col: str = "doc_id", clusters: int = 4, per_lang: int = 1500, max_langs: int = 1000, reject: float = 0.002) -> LanguageModel:
    """Learn from (id, text, lang); rows with a NULL text or lang are left out."""
    rows = train.where("text is not null and lang is not null")
    df, n = document_frequency(rows)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    sizes = train.sparkSession.createDataFrame(counts, "lang string, _n long")  # at most max_langs rows
    sample = rows.join(F.broadcast(sizes), "lang").where(uniform(id_col, 1) < per_lang / F.col("_n"))

    def vec(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            v = vectors(gram_counts(b.column("text").to_pylist()), idf)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in v], pa.binary())], names=["lang", "v"])

    def fit(key, pdf):
        x = np.stack([np.frombuffer(v, np.float32) for v in sorted(pdf["v"])])
        m = spherical_kmeans(x, clusters)
        limit = float(np.quantile((x @ m.T).max(1), reject))
        return pd.DataFrame({"lang": [key[0]] * len(m), "k": range(len(m)), "c": [r.tobytes() for r in m], "lim": [limit] * len(m)})

    fitted = sample.select("lang", "text").mapInArrow(vec, "lang string, v binary").groupBy("lang").applyInPandas(fit, "lang string, k int, c binary, lim double")
    got = sorted(fitted.limit(max_langs * clusters + 1).collect(), key=lambda r: (r["lang"], r["k"]))
    if len(got) > max_langs * clusters:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted({r["lang"] for r in got})
    centroids = np.stack([np.frombuffer(r["c"], np.float32) for r in got]) if got else np.zeros((0, DIM), np.float32)
    limits = {r["lang"]: r["lim"] for r in got}
    return LanguageModel(langs, centroids, np.array([langs.index(r["lang"]) for r in got], int), np.array([limits[x] for x in langs]), idf)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", held_out: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, cosine, rejected.

    NULL texts, and texts without a letter, are ``und`` with score 0; every
    other text gets a learned language, ``rejected`` says that it is far from
    it. Without any training text everything is ``und``. Repeated rows are
    answered alike; other columns are not read.
    """
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for b in pieces(batches, "text", 4 << 20):
            p, s, c, r = zip(*model.predict(b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p, pa.string()), pa.array(s, pa.float64()), pa.array(c, pa.float64()), pa.array(r, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "cosine", "rejected"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cosine double, rejected boolean")
