"""Ranked lexical search by pipelined term partitioning.

Every query term has one owner stage; the stages are passed from rare terms to
frequent ones. An item bundle carries its sparse document accumulators from
stage to stage: each stage is a cogroup of the bundles with the lists of the
owner's terms, adds integer contributions and hands the accumulators on; the
last one selects. Documents are parted into shards (slices of the input), so a
list, however frequent its term, lies in pieces of one shard each, and a task
holds the accumulators of one bundle over one shard.

Only lists of query terms are written while the query vocabulary has at most
``VOCABULARY`` terms, which then travels to the tasks; beyond that all lists
are written and the join with the bundles finds the right ones. The results
are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, claim, pieces, stage

VOCABULARY = 1 << 20
SHARD = 32 << 20
#: Stage of a term: the first whose share of documents it stays under.
OWNERS = (1 / 256, 1 / 32, 1 / 4, 2.0)
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_TERM).split()


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied by in a document of ``n`` terms."""
    m = 50 + (50 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _frequencies(wanted):
    """text -> (term, df, length) of a slice; the row without a term has the documents with terms and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        keep = wanted.value if wanted else None
        for b in pieces(batches, "text"):
            df: Counter = Counter()
            docs = length = 0
            for raw in as_bytes(b.column("text")):
                found = terms(raw)
                docs, length = docs + bool(found), length + len(found)
                df.update(keep.keys() & found if keep is not None else set(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *df], pa.binary()).cast(pa.string()), pa.array([docs, *df.values()], pa.int64()), pa.array([length] + [0] * len(df), pa.int64())],
                names=["term", "df", "length"],
            )

    return run


def _lists(wanted, docs: int, total: int):
    """(doc_id, text) -> one row per term of a shard: places in the shard (by doc_id) and impacts; the row without a term has the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        shard = TaskContext.get().partitionId() << 32
        for b in pieces(batches, "text", SHARD):
            b = pa.Table.from_batches([b]).sort_by([("doc_id", "ascending")]).combine_chunks()  # NULL ids last
            number = wanted.value if wanted else {}
            owner, ids, n = [], [], []
            for i, raw in enumerate(as_bytes(b.column("text"))):
                found = terms(raw)
                n.append(len(found))
                own = list(filter(None, map(number.get, found))) if wanted else [number.setdefault(t, len(number) + 1) for t in found]
                owner.append(np.full(len(own), i, np.int64))
                ids.append(np.array(own, np.int64))
            size = len(n)
            key, tf = np.unique(np.concatenate(ids) * size + np.concatenate(owner), return_counts=True)
            term, at = key // size, key % size
            q = impact(tf.astype(np.int64), np.array(n, np.int64)[at], docs, total)
            cut = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
            name = {v: k for k, v in number.items()} if not wanted else wanted.value["\0"]
            rows = [(shard, name[int(term[i])].decode(), at[i:j].astype(np.uint32).tobytes(), q[i:j].astype(np.uint32).tobytes(), None) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            rows.append((shard, None, None, None, b.column("doc_id").to_pylist()))
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 4096], strict=True), _LIST, strict=True)], names=["shard", "term", "docs", "q", "ids"])
            shard += 1

    return run


_LIST = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _add(held: pa.Table, lists: pa.Table) -> tuple[int, int, np.ndarray]:
    """shard, bundle and the (slot, place) accumulators after an owner's contributions."""
    any_ = held if held.num_rows else lists
    have = [np.frombuffer(x, np.int64).reshape(3, -1) for x in held["acc"].to_pylist()]
    came = [
        (np.array(slots), np.frombuffer(docs, np.uint32).astype(np.int64), w * np.frombuffer(q, np.uint32).astype(np.int64))
        for w, slots, docs, q in zip(*(lists[c].to_pylist() for c in ("w", "slots", "docs", "q")), strict=True)
    ]
    slots = 1 + max([int(x[0].max()) for x in have] + [int(s.max()) for s, _, _ in came])
    places = 1 + max([int(x[1].max()) for x in have] + [int(d.max()) for _, d, _ in came])
    acc = np.zeros((slots, places), np.int64)
    for x in have:
        acc[x[0], x[1]] = x[2]
    for s, d, v in came:
        acc[s[:, None], d[None, :]] += v[None, :]
    return any_["shard"][0].as_py(), any_["bundle"][0].as_py(), acc


def _carry(held: pa.Table, lists: pa.Table) -> pa.Table:
    shard, bundle, acc = _add(held, lists)
    slot, place = np.nonzero(acc)
    if not len(slot):
        return _CARRIED.empty_table()
    return pa.Table.from_arrays([pa.array([shard], pa.int64()), pa.array([bundle], pa.int32()), pa.array([np.stack([slot, place, acc[slot, place]]).tobytes()], pa.binary())], schema=_CARRIED)


_CARRIED = pa.schema([("shard", pa.int64()), ("bundle", pa.int32()), ("acc", pa.binary())])


def _select(k: int):
    """The last owner's stage: the k best documents of every item in this shard, ties by place (which follows doc_id)."""

    def run(held: pa.Table, lists: pa.Table) -> pa.Table:
        shard, bundle, acc = _add(held, lists)
        out = []
        for slot, row in enumerate(acc):
            at = np.flatnonzero(row)
            if len(at) > k:
                at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
            out += [(shard, bundle, slot, int(p), int(row[p])) for p in at[np.lexsort((at, -row[at]))][:k]]
        cols = zip(*out, strict=True) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["shard", "bundle", "slot", "place", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim()
    for b in pieces(batches, "text"):
        found = [[t.decode() for t in set(terms(raw))] for raw in as_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    bundle: int = 128, vocabulary: int = VOCABULARY,
) -> DataFrame:
    """item_id, rank, doc_id, score: every item's ``k`` best documents with a score above 0; equal scores by doc_id, NULL ids last.

    Scores are exact integers: a term's weight floor(1000 ln((2N + 2) / (2 df + 1))) times ``impact``. NULL and empty texts have
    no terms, so such documents and items are in no result; neither are items none of whose terms is found. Rows of one item_id
    (NULL is one too) are one item with the terms of all of them, once each; rows of one doc_id are documents of their own, in an
    arbitrary but fixed order where they tie. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    asked = stage(asked.mapInArrow(_item_terms, f"item_id {kind}, terms array<string>").select("item_id", F.explode("terms").alias("term")).distinct(), "search-items")
    words = asked.select("term").distinct().limit(vocabulary + 1).toArrow()["term"].to_pylist()
    wanted = None
    if len(words) <= vocabulary:
        number = {t.encode(): i + 1 for i, t in enumerate(sorted(words))}
        wanted = spark.sparkContext.broadcast(number | {"\0": [None, *number]})  # the str key never meets a term, which is bytes

    freq = stage(src.select("text").mapInArrow(_frequencies(wanted), "term string, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")), "search-counts")
    every = freq.where("term is null").first()
    n_docs, total = (every.df, every.length) if every else (0, 0)
    lists = src.mapInArrow(_lists(wanted, n_docs, max(total, 1)), "shard long, term string, docs binary, q binary, ids array<long>")
    lists = stage(lists if total else lists.limit(0), "search-lists")

    # bundles of about ``bundle`` items; an item's slot is its place in the bundle
    named = asked.select("item_id").distinct()
    bundles = -(-named.count() // bundle) or 1
    named = named.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int"))
    slots = stage(named.withColumn("slot", F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1), "search-slots")
    share = F.col("df") / F.lit(float(max(n_docs, 1)))
    owner = F.coalesce(*[F.when(share < x, i) for i, x in enumerate(OWNERS)])
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = freq.where("term is not null").select("term", weight.alias("w"), owner.alias("owner"))
    needs = asked.join(slots, asked.item_id.eqNullSafe(slots.item_id)).join(weights, "term").groupBy("bundle", "term", "w", "owner").agg(F.collect_list("slot").alias("slots"))
    needs = stage(needs, "search-needs")

    held = spark.createDataFrame([], "shard long, bundle int, acc binary")
    for s in range(len(OWNERS)):
        owned = lists.where("term is not null").drop("ids").join(needs.where(F.col("owner") == s), "term").select("shard", "bundle", "w", "slots", "docs", "q")
        met = held.groupBy("shard", "bundle").cogroup(owned.groupBy("shard", "bundle"))
        if s < len(OWNERS) - 1:
            held = met.applyInArrow(_carry, "shard long, bundle int, acc binary")
        else:
            best = met.applyInArrow(_select(k), "shard long, bundle int, slot int, place int, score long").where("score > 0")
    places = lists.where("term is null").select("shard", F.posexplode("ids").alias("place", "doc_id"))
    order = Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place")
    ranked = best.join(places, ["shard", "place"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(slots, ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")
