"""N-gram Jaccard join with a token-group matrix.

Documents are partitioned into groups of similar ones, the matrix holds the
tokens (shingle hashes) of each group, and a group is opened for a query only
if the query's overlap with the group's token union can reach the threshold.

1. Token frequencies over all documents give the order "rare first". The most
   frequent tokens, at most ``HOT_MAX``, travel to the tasks; the table only
   orders tokens, so its bound changes no result.
2. A document with n tokens that links to another shares at least ceil(0.85 n)
   with it; all but ceil(0.85 n) - m of its tokens are among its first
   n - ceil(0.85 n) + m in that order, so two linked documents share at least
   the smaller m of such prefixes. m is a twentieth of n, plus one. The prefix
   tokens per group are the stored matrix. A group is the smallest hash among a
   document's common tokens if these prevail, else among its rare ones, so near
   copies meet and documents that only share a passage do not.
3. Groups that share at least the smallest m of their members in matrix entries
   are the candidates. Groups are cut into blocks of about
   ``BLOCK`` sets or ``SHINGLES`` shingles, whichever are fewer. Blocks are first linked inside, then by one
   pivot of each local component; only blocks that are not yet entirely in one
   component are opened against each other, and there only documents whose
   overlap with the block's token union reaches the bound are compared.

Equal sets are one vertex. Links inside a component already known are not
looked for again, which changes no component. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropping_shuffles
from .common import as_bytes, claim, give_back, pieces, stage, unstage
from .components import connected

HOT_MAX = 1 << 18
HOT_FROM = 16
BLOCK = 256
SHINGLES = 1 << 18  # of a block, about
SLICE = 2 << 20
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


LONG = 64  # bytes of a word that are hashed by their places
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_BYTE, _PLACE = (np.random.default_rng(7).integers(0, 1 << 64, n, np.uint64) for n in (256, LONG))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE |= np.uint64(1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of a text's lower-cased words, in order, and where the words begin and end.

    Sums over a word's bytes, each times its place's own odd number; long words are hashed one by one.
    """
    inside = np.zeros(len(raw) + 2, bool)
    b = np.frombuffer(raw, np.uint8)
    _IN_WORD.take(b, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    first = np.cumsum(size) - size
    b = b[inside[1:-1]]
    place = np.arange(len(b)) - np.repeat(first, size)
    h = _BYTE.take(b)
    h *= _PLACE.take(place, mode="wrap")
    h = np.add.reduceat(h, first)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].lower())
    h += size.astype(np.uint64) * _A
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h, start, end


def shingle_set(raw: bytes, k: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a lower-cased text; fewer words are one shingle, no word is none."""
    w = word_hashes(raw)[0]
    n = len(w)
    if not n:
        return w
    with np.errstate(over="ignore"):
        if n < k:
            h = np.full(1, n, np.uint64)
            for i in range(n):
                h = h * _A + w[i]
        else:
            h = np.full(n - k + 1, k, np.uint64)
            for i in range(k):
                h = h * _A + w[i : n - k + 1 + i]
        h = (h ^ (h >> np.uint64(32))) * _B
        h = (h ^ (h >> np.uint64(29))) * _A
        h ^= h >> np.uint64(32)
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Tokens that a partner must share with a set of n."""
    return (percent * n + 99) // 100


def lead(n: int) -> int:
    """Prefix tokens that two linked documents share at least."""
    return n // 20 + 1


def _short(tokens: np.ndarray) -> np.ndarray:
    """40 bits are enough to tell frequent tokens; an accidental meeting only changes the order."""
    return tokens >> np.uint64(24)


def _coded(tokens: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct numbers and how often each occurs, as few bytes: the gaps between the numbers by byte places, the places above 1 of the counts."""
    gaps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    more = np.flatnonzero(counts > 1).astype(np.uint32)
    return bytes([width]) + planes.tobytes(), more.tobytes() + counts[more].astype(np.uint32).tobytes()


def _decoded(t: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(t, np.uint8, offset=1).reshape(t[0], -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, : t[0]] = planes.T
    counts = np.ones(planes.shape[1], np.int64)
    more, n = np.frombuffer(c, np.uint32).reshape(2, -1)
    counts[more] = n
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), counts


def frequent_tokens(src: DataFrame, k: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 40-bit tokens found in HOT_FROM documents or more, and their counts: the HOT_MAX most frequent.

    All documents are counted: slices send each token range one packed row, and
    a hot token is one entry per slice.
    """
    bits = max(6, int(ranges - 1).bit_length())
    each = HOT_MAX >> bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        give_back()
        for b in pieces(batches, "text", SLICE):
            sets = [shingle_set(x, k) for x in as_bytes(b.column("text"))]
            t, c = np.unique(_short(np.concatenate(sets)), return_counts=True)
            part = (t >> np.uint64(40 - bits)).astype(np.int64)
            cut = np.searchsorted(part, np.arange((1 << bits) + 1))
            low = (t & np.uint64((1 << (40 - bits)) - 1)).astype(np.uint64)
            rows = [(p, *_coded(low[i:j], c[i:j])) for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "t", "c"])

    def reduce(key, table):
        t, c = (np.concatenate(x) for x in zip(*map(_decoded, table["t"].to_pylist(), table["c"].to_pylist()), strict=True))
        u, at = np.unique(t, return_inverse=True)
        n = np.bincount(at, weights=c).astype(np.int64)
        top = np.flatnonzero(n >= HOT_FROM)
        top = top[np.lexsort((u[top], -n[top]))][:each]
        full = u[top] | (np.uint64(key[0].as_py()) << np.uint64(40 - bits))
        return pa.table({"t": full.astype(np.int64), "n": n[top]})

    with dropping_shuffles(src.sparkSession):
        got = src.mapInArrow(count, "part int, t binary, c binary").groupBy("part").applyInArrow(reduce, "t long, n long").toArrow()
    t, n = got["t"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(t)
    return t[order], n[order]


def _describe(hot: np.ndarray, freq: np.ndarray, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        give_back()
        for b in pieces(batches, "text", SLICE):
            ns, sigs, groups, prefixes, leads = [], [], [], [], []
            sent: set = set()  # a slice sends a group's frequent token once, and the tokens of equal sets once
            for raw in as_bytes(b.column("text")):
                t = shingle_set(raw, k)
                n = len(t)
                ns.append(n)
                leads.append(lead(n))
                if not n:
                    sigs.append(None), groups.append(None), prefixes.append([])
                    continue
                rank = np.zeros(n, np.int64)
                if len(hot):
                    s = _short(t)
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    rank = np.where(hot[at] == s, freq[at], 0)
                common = rank > 0
                pick = t[common] if 2 * common.sum() > n else t[~common]
                groups.append(int(pick[0].astype(np.int64)))
                sigs.append(xxhash.xxh3_128_digest(t.tobytes()))
                if sigs[-1] in sent:
                    prefixes.append([])
                    continue
                sent.add(sigs[-1])
                first = np.argsort(rank, kind="stable")[: n - need(n, percent) + leads[-1]]  # ties stay in hash order
                tokens, rare = t[first].astype(np.int64), rank[first] == 0
                again = [x for x in tokens[~rare].tolist() if (groups[-1], x) not in sent]
                sent.update((groups[-1], x) for x in again)
                prefixes.append(tokens[rare].tolist() + again)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_id"), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(leads, pa.int64())],
                names=["doc_id", "row_id", "n_shingles", "sig", "grp", "prefix", "lead"],
            )

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of every set of ``a`` with every set of ``b`` (exact)."""
    if len(a) == 1 and len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]], np.int64)
    both = a + b
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    u, at, c = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = c[at] > 1
    new = np.cumsum(c > 1) - 1
    col, owner = new[at[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    out = np.zeros((len(a), len(b)), np.int64)
    total = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, total, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((len(both), min(width, total - lo)), np.float32)
        x[owner[i:j], col[i:j] - lo] = 1
        out += np.rint(x[: len(a)] @ x[len(a) :].T).astype(np.int64)
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs (index in a, index in b) that reach the threshold; a set is compared only if its overlap with the other side's union can."""
    ka, kb = _qualify(a, b, percent), _qualify(b, a, percent)
    if not len(ka) or not len(kb):
        return np.zeros((0, 2), np.int64)
    sa, sb = [a[i] for i in ka], [b[i] for i in kb]
    inter = overlaps(sa, sb)
    union = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - inter
    hit = np.argwhere(100 * inter >= percent * union)
    return np.stack([ka[hit[:, 0]], kb[hit[:, 1]]], 1)


def _qualify(q: list[np.ndarray], group: list[np.ndarray], percent: int) -> np.ndarray:
    union = group[0] if len(group) == 1 else np.unique(np.concatenate(group))
    if len(union) == 0:
        return np.zeros(0, np.int64)
    keep = []
    for i, t in enumerate(q):
        at = np.minimum(np.searchsorted(union, t), len(union) - 1)
        if int((union[at] == t).sum()) >= need(len(t), percent):
            keep.append(i)
    return np.array(keep, np.int64)


def _streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, from sorted batches."""
    held: list[tuple] = []
    for b in pieces(batches, "text", SLICE):
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and row[:keys] != held[-1][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _local(k: int, percent: int):
    """(grp, blk, node, text) sorted by block -> (node, comp): the smallest node that links inside the block reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        give_back()
        for rows in _streamed(batches, 2):
            rows.sort(key=lambda r: r[2])
            nodes, root = [r[2] for r in rows], list(range(len(rows)))
            if len(rows) > 1:
                sets = [shingle_set(r[3].encode(), k) for r in rows]

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                inter = overlaps(sets, sets) if len(sets) > 2 else overlaps(sets[:1], sets[1:])
                n = np.array([len(s) for s in sets])
                if len(sets) > 2:
                    hits = np.argwhere(np.triu(100 * inter >= percent * (n[:, None] + n[None, :] - inter), 1))
                else:
                    hits = [(0, 1)] if 100 * inter[0, 0] >= percent * (n.sum() - inter[0, 0]) else []
                for i, j in hits:
                    a, b = find(int(i)), find(int(j))
                    root[max(a, b)] = min(a, b)
                root = [find(i) for i in range(len(root))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[i] for i in root], pa.int64())], names=["node", "comp"])

    return run


def _cross(k: int, percent: int):
    """(left block, right block, side, comp, text) sorted by the blocks -> (a, b): components that a link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        give_back()
        for rows in _streamed(batches, 4):
            left, right = [r for r in rows if r[4] == 0], [r for r in rows if r[4] == 1]
            if not left or not right:
                continue
            hit = linked([shingle_set(r[6].encode(), k) for r in left], [shingle_set(r[6].encode(), k) for r in right], percent)
            found = sorted({(left[i][5], right[j][5]) for i, j in hit.tolist() if left[i][5] != right[j][5]})
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


_PAIR = ["ga", "ba", "gb", "bb"]


def _compare(pairs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Open the right block for the members of the left block of every pair; members: grp, blk, comp, text."""
    left = pairs.join(members, (F.col("ga") == F.col("grp")) & (F.col("ba") == F.col("blk"))).select(*_PAIR, F.lit(0).alias("side"), "comp", "text")
    right = pairs.join(members, (F.col("gb") == F.col("grp")) & (F.col("bb") == F.col("blk"))).select(*_PAIR, F.lit(1).alias("side"), "comp", "text")
    met = left.union(right).repartition(*_PAIR).sortWithinPartitions(*_PAIR)
    return met.mapInArrow(_cross(k, percent), "a long, b long")


def _relabel(table: DataFrame, roots: DataFrame) -> DataFrame:
    j = table.join(roots, F.col("comp") == F.col("vertex"), "left")
    return j.withColumn("comp", F.coalesce("root", "comp")).drop("vertex", "root")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, block: int = BLOCK, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included), component, row_id.

    ``component`` numbers the components (NULL for empty sets); ``row_col`` names a unique row number that ``row_id`` repeats.

    Texts without words (NULL, empty, white space) have an empty set and link
    with nothing, not even each other. Repeated rows link with each other; rows
    with the same id and different texts are vertices of their own. Rows with a
    NULL id link as all others and get the smallest id reachable, NULL if there is none. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    number = F.lit(None).cast("long") if row_col is None else F.col(row_col).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), number.alias("row_id"))
    hot, freq = frequent_tokens(src, k, int(spark.conf.get("spark.sql.shuffle.partitions")))
    described = src.mapInArrow(_describe(hot, freq, k, percent), "doc_id long, row_id long, n_shingles long, sig binary, grp long, prefix array<long>, lead long")
    rows = stage(described.withColumn("node", F.monotonically_increasing_id()), "ngram-rows")
    sets = stage(rows.where("sig is not null").groupBy("sig").agg(F.min("node").alias("node"), F.min("doc_id").alias("first_id"), F.min("grp").alias("grp"), F.min("lead").alias("lead"), F.min("n_shingles").alias("n")), "ngram-sets")

    # the matrix: tokens that more than one group holds
    cells = rows.where("grp is not null").select("grp", F.explode("prefix").alias("token")).repartition("token").dropDuplicates(["token", "grp"])
    held = cells.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    matrix = stage(cells.join(held.hint("shuffle_hash"), "token", "left_semi"), "ngram-matrix")
    other = matrix.select("token", F.col("grp").alias("gb"))
    shared = matrix.select("token", F.col("grp").alias("ga")).join(other, "token").where("ga < gb").groupBy("ga", "gb").agg(F.count("*").alias("n"))
    leads = sets.groupBy("grp").agg(F.min("lead").alias("lead"))
    bounded = shared.join(leads.toDF("ga", "la"), "ga").join(leads.toDF("gb", "lb"), "gb").where("n >= least(la, lb)")
    cand = stage(bounded.select("ga", "gb"), "ngram-candidates")

    sizes = sets.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    paired = cand.select(F.col("ga").alias("grp")).union(cand.select(F.col("gb").alias("grp"))).distinct()
    busy = sizes.join(paired.withColumn("paired", F.lit(True)), "grp", "left").where("size > 1 or paired").select("grp", F.ceil(F.greatest(F.col("size") / block, F.col("n") / SHINGLES)).cast("int").alias("blocks"))
    members = stage(sets.join(busy, "grp").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "ngram-members")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # an id may stand for several texts
        claim()
        give_back()
        for b in pieces(batches, "text", SLICE):
            ok = [xxhash.xxh3_128_digest(shingle_set(t, k).tobytes()) == s for t, s in zip(as_bytes(b.column("text")), b.column("sig").to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).drop_columns(["sig"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        give_back()
        for b in pieces(batches, "text", SLICE):
            sigs = [xxhash.xxh3_128_digest(shingle_set(t, k).tobytes()) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), b.column("text")], names=["sig", "text"])

    slim = members.select(F.col("first_id").alias("doc_id"), "sig", "grp", "blk", "node")
    by_id = src.drop("row_id").join(slim.hint("shuffle_hash"), "doc_id").select("grp", "blk", "node", "sig", "text").mapInArrow(same, "grp long, blk int, node long, text string")
    # sets whose rows have no id are met by the set itself
    nameless = src.where("doc_id is null").select("text").mapInArrow(signed, "sig binary, text string").dropDuplicates(["sig"])
    by_set = nameless.join(slim.where("doc_id is null").hint("shuffle_hash"), "sig").select("grp", "blk", "node", "text")
    written = stage(by_id.union(by_set), "ngram-texts")
    texts = written.dropDuplicates(["node"])

    ordered = texts.repartition("grp", "blk").sortWithinPartitions("grp", "blk")
    local = ordered.mapInArrow(_local(k, percent), "node long, comp long")
    placed = stage(local.join(texts, "node").select("node", "comp", "grp", "blk", "text"), "ngram-local")
    unstage(written, matrix)

    # one pivot of each local component: block 0 against the other blocks of its group, and against block 0 of candidate groups
    star = members.where("blk > 0").select(F.col("grp").alias("ga"), F.lit(0).alias("ba"), F.col("grp").alias("gb"), F.col("blk").alias("bb")).distinct()
    first = cand.select("ga", F.lit(0).alias("ba"), "gb", F.lit(0).alias("bb"))
    edges = stage(_compare(star.union(first), placed.where("node = comp"), k, percent), "ngram-edges")
    joined = stage(_relabel(placed.drop("text"), connected(edges)), "ngram-joined")

    # what may still be open: pairs of blocks that do not lie in one component altogether
    state = joined.groupBy("grp", "blk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    whole = state.groupBy("grp").agg(F.min("lo").alias("glo"), F.max("hi").alias("ghi"), F.sum("n").alias("gn"), F.count("*").alias("gb_n"))
    odd = state.join(whole, "grp").where("(lo <> hi or lo <> glo) and gb_n > 1")
    left = odd.select(F.col("grp").alias("ga"), F.col("blk").alias("ba"))
    inside = left.join(state.select(F.col("grp").alias("gb"), F.col("blk").alias("bb")), F.col("ga") == F.col("gb")).where("ba <> bb")
    side = whole.select("grp", "glo", "ghi", "gn", "gb_n")
    open_ = (
        cand.join(side.toDF("ga", "alo", "ahi", "an", "abn"), "ga").join(side.toDF("gb", "blo", "bhi", "bn", "bbn"), "gb")
        .where("not (alo = ahi and blo = bhi and alo = blo) and (an > 1 or bn > 1)").select("ga", "gb")
    )
    across = open_.join(state.select(F.col("grp").alias("ga"), F.col("blk").alias("ba")), "ga").join(state.select(F.col("grp").alias("gb"), F.col("blk").alias("bb")), "gb")
    rest = inside.select(*_PAIR).union(across.select(*_PAIR)).distinct()
    now = joined.join(placed.select("node", "text"), "node")
    more = stage(_compare(rest, now, k, percent), "ngram-more")
    final = _relabel(joined, connected(more)).select("node", "comp")
    unstage(placed, edges, more)

    # back to documents: vertices that were never compared are components of their own
    label = sets.join(final, "node", "left").select("sig", "first_id", F.coalesce("comp", "node").alias("comp"))
    least = label.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = label.join(least, "comp").select("sig", "component_id", F.col("comp").alias("component"))
    back = rows.select("doc_id", "n_shingles", "sig", "row_id").join(named, "sig", "left")
    return back.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component", "row_id")
