"""Phrase collocations by Toivonen's method.

A sample of the documents proposes phrases. One full pass then counts, over all
documents, the proposed phrases together with their negative border: every
phrase whose two parts (all words but the last, all words but the first) are
proposed, and every single word. A border phrase that turns out frequent was
missed by the sample; while there are such failures, a further pass counts what
they add to the border, until it is closed. Every frequent phrase is then known,
because all parts of a frequent phrase are frequent.

Passes count 62-bit keys of phrases; the numbers of a slice are combined before
they travel, packed by key range, and the number of ranges follows the size of
the texts. The proposed set travels as a bit filter of at most ``FILTER_BITS``
bits: a wrong "yes" only lets a phrase be counted in vain, a wrong "no" does not
exist. A last pass counts the phrases found by their words; there a key only
groups the occurrences inside one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, claim, doc_remainder, give_back, pieces, stage

FILTER_BITS = 28
LONGEST = 4
SLICE = 4 << 20
HELD = 1 << 21
_CUT = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 44 if c in _CUT else c for c in range(256))
_INSIDE = bytes(c not in b", \t" for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def fold(raw: bytes) -> bytes:
    """A text with A-Z lower-cased, a comma for everything that ends a piece and one at its end."""
    return raw.translate(_TABLE) + b","


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def split_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a folded text, in order, with an empty entry of hash 0 where a piece ends.

    The hash is a polynomial in the word's bytes, computed for all words at once; it is 0 for no word.
    """
    byte = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = np.frombuffer(raw.translate(_INSIDE), bool)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.insert(edge, 0, 0)
    first, last = edge[::2], edge[1::2]
    stop = np.flatnonzero(byte == 44)
    start, end = np.concatenate([first, stop]), np.concatenate([last, stop])
    order = np.argsort(start, kind="stable")
    hashes = np.zeros(len(start), np.uint64)
    if len(first):
        size = last - first
        at = np.cumsum(size) - size
        power = np.cumprod(np.full(int(size.max()), _A, np.uint64))
        place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
        own = _mix(np.add.reduceat(power[place] * (byte[inside[:-1]] + np.uint64(1)), at))
        own[own == 0] = 1
        hashes[: len(first)] = own
    return start[order], end[order], hashes[order]


def phrase_keys(hashes: np.ndarray, seeds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to 4: keys of the phrases that start at each word (the length minus one in the last two bits), and which of them exist."""
    out, h, ok = [], seeds, np.ones(len(hashes), bool)
    for k in range(min(LONGEST, len(hashes))):
        n = len(hashes) - k
        h = _mix(h[:n] * _A + hashes[k:])
        ok = ok[:n] & (hashes[k:] != 0)
        out.append(((h << np.uint64(2)) | np.uint64(k), ok))
    return out


class Filter:
    """A set of keys as bits: two for each key."""

    def __init__(self, bits: int):
        self.bits, self.field = bits, np.zeros(1 << (bits - 6), np.uint64)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return (keys >> np.uint64(2)) & low, (keys >> np.uint64(2 + self.bits)) & low

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.field[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def plus(self, keys: DataFrame) -> Filter:
        """With the keys of a table; at most 2^bits / 64 rows reach the driver."""
        shifted = F.shiftrightunsigned("key", 2)
        at = F.explode(F.array(shifted.bitwiseAND((1 << self.bits) - 1), F.shiftrightunsigned("key", 2 + self.bits).bitwiseAND((1 << self.bits) - 1)))
        spots = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
        got = spots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = Filter(self.bits)
        out.field[:] = self.field
        out.field[got["word"].to_numpy()] |= got["bits"].to_numpy().view(np.uint64)
        return out


def _slices(batches: Iterator[pa.RecordBatch]):
    """Slices of whole texts: the folded text, start, end, hash, language seed and language number of every word, and the languages."""
    for b in pieces(batches, "text", SLICE):
        known: dict[str, int] = {}
        lang = np.array([known.setdefault(x, len(known)) for x in b.column("lang").to_pylist()], np.int64)
        texts = [fold(x) for x in as_bytes(b.column("text"))]
        ends = np.cumsum([len(x) for x in texts])
        raw = b"".join(texts)
        del texts
        start, end, hashes = split_words(raw)
        of = lang[np.searchsorted(ends, start, side="right")]
        seed = np.array([xxhash.xxh3_64_intdigest(x) for x in known], np.uint64)
        yield raw, start, end, hashes, seed[of], of, list(known)


def _tally(levels: tuple[int, ...], known, before, parts: int):
    """Slices -> (part, keys, counts): phrases of the given lengths whose parts are both in ``known`` but were not both in ``before``.

    A phrase is in a filter if its parts are, down to its words: a wrong "yes" of the earlier filter about a phrase of words it did
    not know must not pass for one that the earlier pass has counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        give_back()
        for _, _, _, hashes, seeds, _, _ in _slices(batches):
            counted, prev = [], None
            for k, (keys, ok) in enumerate(phrase_keys(hashes, seeds), 1):
                if k > max(levels):
                    break
                if k == 1:
                    take = ok
                else:
                    ok = ok & (prev[0][:-1] & prev[0][1:])
                    take = ok & ~(prev[1][:-1] & prev[1][1:]) if before else ok
                if k in levels:
                    counted.append(keys[take])
                if k < max(levels):
                    inside, old = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
                    at = np.flatnonzero(ok)
                    inside[at] = known.value.has(keys[at])
                    if before:
                        at = np.flatnonzero(ok if k == 1 else ok & prev[1][:-1] & prev[1][1:])
                        old[at] = before.value.has(keys[at])
                    prev = inside, old
            u, n = np.unique(np.concatenate(counted), return_counts=True) if counted else ([], [])
            if not len(u):
                continue
            part = (u >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
            cut = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1, append=-1))
            rows = [(int(part[i]), u[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            for lo in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 1024], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "counts"])

    return run


def _sums(least: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        n = np.add.reduceat(n, first)
        keep = n >= least
        return pa.table({"key": keys[first][keep].view(np.int64), "n": n[keep]})

    return run


def _not_in(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~known.value.has(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_()))

    return run


_PACKED = "part int, lang array<string>, k array<int>, phrase array<string>, n array<long>"


def _by_words(known, parts: int):
    """Slices -> phrases in ``known``, whose parts are too, by their words, packed by hash range; k = 0 has the number of all words.

    The counts of successive slices are added up, ``HELD`` rows at a time, and go on when the sums alone are half as many.
    """
    kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()))

    def packed(sums: pa.Table) -> Iterator[pa.RecordBatch]:
        phrases = sums["phrase"].to_pylist()
        part = np.fromiter((xxhash.xxh3_64_intdigest(x) % parts for x in phrases), np.int64, len(phrases))
        order = np.argsort(part, kind="stable")
        sums, part = sums.take(pa.array(order)), part[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            body = [sums[c].slice(i, j - i).combine_chunks() for c in ("lang", "k", "phrase", "n")]
            lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x.cast(t.value_type)) for x, t in zip(body, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[i])], pa.int32()), *lists], names=["part", "lang", "k", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        give_back()
        held: list[pa.Table] = []
        for raw, start, end, hashes, seeds, of, langs in _slices(batches):
            names = np.array(langs, object)
            size = np.bincount(of[hashes != 0], minlength=len(langs))
            held.append(_table(names[size > 0], 0, [b""] * int((size > 0).sum()), size[size > 0]))
            prev = None
            for k, (keys, ok) in enumerate(phrase_keys(hashes, seeds), 1):
                at = np.flatnonzero(ok if k == 1 else ok & prev[:-1] & prev[1:])
                at = at[known.value.has(keys[at])]
                prev = np.zeros(len(keys), bool)
                prev[at] = True
                _, first, n = np.unique(keys[at], return_index=True, return_counts=True)
                first = at[first]
                found = [raw[i:j] for i, j in zip(start[first].tolist(), end[first + k - 1].tolist(), strict=True)]
                if k > 1:  # one space between words, whatever the text has
                    found = [b" ".join(x.split()) if b"  " in x or b"\t" in x else x for x in found]
                held.append(_table(names[of[first]], k, found, n))
            if sum(t.num_rows for t in held) > HELD:
                held = [_added_up(held)]
                if held[0].num_rows > HELD // 2:
                    yield from packed(held.pop())
        if held:
            yield from packed(_added_up(held))

    return run


def _table(langs: np.ndarray, k: int, phrases: list[bytes], n: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array(langs, pa.string()), "k": pa.array(np.full(len(phrases), k, np.int32)), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "n": pa.array(n.astype(np.int64))})


def _added_up(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "k", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "k", "phrase", "n"])


def _word_sums(least: int):
    """Packed counts of one hash range -> (lang, k, phrase, a) of those that are frequent."""

    def run(table: pa.Table) -> pa.Table:
        flat = pa.table({c: table[c].combine_chunks().flatten() for c in ("lang", "k", "phrase", "n")})
        sums = _added_up([flat]).rename_columns(["lang", "k", "phrase", "a"])
        return sums.filter(pc.or_(pc.equal(sums["k"], 0), pc.greater_equal(sums["a"], least)))

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 8, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, k, phrase, a: all phrases of 1 to 4 words found ``least`` times or more in their language, and k = 0 with the number of its words.

    ``sample`` proposes from one document in so many; the result does not depend on it. NULL texts count as empty, NULL languages
    as ``und``; repeated rows count as often as they come; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    picked = F.coalesce(doc_remainder(id_col, sample) == sample // 2, F.lit(False))
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"), picked.alias("picked"))
    size = src.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (8 << 20)))

    def tally(over: DataFrame, levels: tuple[int, ...], known, before, at_least: int, parts: int, label: str) -> DataFrame:
        rows = over.select("lang", "text").mapInArrow(_tally(levels, known, before, parts), "part int, keys binary, counts binary")
        return stage(rows.groupBy("part").applyInArrow(_sums(at_least), "key long, n long"), label)

    # the sample's phrases, level by level; the threshold leaves room for chance
    expected = least / sample
    low = max(2, int(expected - 2 * expected**0.5))
    part = src.where("picked")
    proposed = tally(part, (1,), None, None, low, max(1, ranges // sample), "phrases-sample-1")
    bits = min(filter_bits, max(16, (64 * proposed.count()).bit_length()))
    known = Filter(bits).plus(proposed)
    for k in range(2, LONGEST):
        known = known.plus(tally(part, (k,), spark.sparkContext.broadcast(known), None, low, max(1, ranges // sample), f"phrases-sample-{k}"))

    # proposed phrases and their border over all documents, then what failures add, until closed
    now = spark.sparkContext.broadcast(known)
    frequent = tally(src, tuple(range(1, LONGEST + 1)), now, None, least, ranges, "phrases-full")
    found = [frequent]
    while True:
        fresh = stage(frequent.where(F.col("key").bitwiseAND(3) < LONGEST - 1).mapInArrow(_not_in(now), "key long, n long"), "phrases-failures")
        if fresh.isEmpty():
            break
        known, before = known.plus(fresh), now
        now = spark.sparkContext.broadcast(known)
        frequent = tally(src, tuple(range(2, LONGEST + 1)), now, before, least, ranges, "phrases-more")
        found.append(frequent)

    keys = found[0]
    for x in found[1:]:
        keys = keys.union(x)
    all_ = Filter(min(filter_bits, max(16, (16 * keys.count()).bit_length()))).plus(keys)
    named = src.select("lang", "text").mapInArrow(_by_words(spark.sparkContext.broadcast(all_), ranges), _PACKED)
    return named.groupBy("part").applyInArrow(_word_sums(least), "lang string, k int, phrase string, a long")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 8) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to 4 words.

    A phrase found a times, cut in two whose parts are found l and r times, scores floor(2,000,000 a / (l + r)); the lowest cut
    counts, of equal ones the first. Phrases are left out if a longer one around them is found ``percent`` % as often or more.
    Odd input as in ``frequent_phrases``.
    """
    known = stage(frequent_phrases(docs, least, id_col, text_col, lang_col, sample), "phrases")
    phrases = known.where("k > 0")
    cuts = phrases.where("k > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right")
    )
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))

    split = phrases.where("k > 2").withColumn("w", F.split("phrase", " "))
    inner = split.select("lang", "a", "k", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
    around = inner.groupBy("lang", F.expr("array_join(slice(w, i, m), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    covered = F.expr(f"cast(100 as decimal(20,0)) * longer >= cast({percent} as decimal(20,0)) * a")
    free = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", rank).where(F.col("rank") <= top)
    sizes = known.where("k = 0").select("lang", F.col("a").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
