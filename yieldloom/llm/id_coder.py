"""Token-id files: an adaptive context-mixing range coder over independent blocks.

A block is coded from a fresh model and carries its own checksums. Its ids lie
in lanes, each with a range coder of its own; all lanes take one step at a time
and share the model, so a step is a few array operations, for the decoder as
well. The order-2 and the order-1 context each predict one id with a
confidence, order 0 has adaptive frequencies. The weights that mix the three
follow the confidences and are learned from how often each was right.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, claim, partitions, pieces, remembers, stage

MAGIC = b"IDCM"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, vocabulary, words, checksum of the words, checksum of the ids
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 40)
_S16, _S48 = np.uint64(16), np.uint64(48)
_BRANCH, _ORDER0, _HASH = 12, 19, 18  # bits of the branch law, of the order-0 law, of the order-2 table
_SHIFT, _WHOLE, _ZERO, _ONE = np.uint64(_BRANCH), np.uint64(1 << _BRANCH), np.uint64(0), np.uint64(1)
_LOW = np.uint64((1 << 40) - 1)
MAX_LANES = 4096
#: Fixed value: the pattern by which a known family of tokenizers cuts texts into runs of letters, single digits and runs of marks.
RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Model:
    """What encoder and decoder know before a step; ``advance`` learns the ids of the step."""

    def __init__(self, vocab: int, lanes: int, slots: bool = False):
        self.vocab, self.slots = vocab, slots  # the decoder looks ids up by slot
        self.count = np.zeros(vocab, np.int64)
        self.law1, self.law2 = np.zeros(vocab, np.int32), np.zeros(1 << _HASH, np.int32)  # predicted id << 4 | confidence
        self.right = np.ones((512, 3), np.int64)  # by context: order 2 right, order 1 right, neither
        self.prev, self.at2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.recent = 0, []
        self._order0()
        self._weights()

    def _order0(self) -> None:
        if self.recent:
            self.count += np.bincount(np.concatenate(self.recent), minlength=self.vocab)
            self.recent = []
        scale = (1 << _ORDER0) / max(1, int(self.count.sum()))
        self.cum = np.zeros(self.vocab + 1, np.uint64)
        freq = (self.count * min(scale, 64.0)).astype(np.int64) + 1
        np.cumsum(freq, out=self.cum[1:], dtype=np.uint64)
        self.total = self.cum[-1]
        if self.slots:
            self.slot = np.repeat(np.arange(self.vocab), freq)

    def _weights(self) -> None:
        share = self.right / self.right.sum(1, keepdims=True)
        f = 1 + (share * ((1 << _BRANCH) - 3)).astype(np.int64)
        edges = np.column_stack([0 * f[:, 0], f[:, 0], f[:, 0] + f[:, 1], np.full(len(f), 1 << _BRANCH)])
        self.start = edges.astype(np.uint64).ravel()
        self.width = np.diff(edges, axis=1, append=0).astype(np.uint64).ravel()  # the fourth of each context is never read

    def predict(self):
        """Per lane the order-2 and order-1 predictions, and where its context's laws of the branch begin in ``start`` and ``width``."""
        self.v1, self.v2 = self.law1[self.prev], self.law2[self.at2]
        self.c1, self.c2 = self.v1 >> 4, self.v2 >> 4
        self.at = ((((self.v2 & 15) << 5) | ((self.v1 & 15) << 1) | (self.c1 == self.c2)) << 2).astype(np.int64)
        return self.c2, self.c1, self.at

    def advance(self, ids: np.ndarray, branch: np.ndarray) -> None:
        self.right += np.bincount(self.at + branch, minlength=2048).reshape(512, 4)[:, :3]
        fresh = (ids << 4).astype(np.int32)
        for law, at, c, v in ((self.law1, self.prev, self.c1, self.v1), (self.law2, self.at2, self.c2, self.v2)):
            s = v & 15
            missed = np.where(s > 1, v - s, fresh) | (s >> 1)
            law[at] = np.where(c == ids, np.minimum(v + 1, v | 15), missed)
        self.at2 = ((self.prev * 0x9E3779B1) ^ (ids * 0x85EBCA6B)) >> 7 & ((1 << _HASH) - 1)
        self.prev = ids
        self.recent.append(ids)
        self.step += 1
        n = self.step
        if n & (n - 1) == 0 or n % 32 == 0:
            self._order0()
        if n < 16 or n % 8 == 0:
            self._weights()


def _settle(low: np.ndarray, span: np.ndarray, move) -> None:
    """Shift out (or in) 16 bits in every lane whose leading bits are settled or whose span is too short; ``move(lanes)`` does the words."""
    i = np.flatnonzero(((low ^ (low + span)) < _TOP) | (span < _BOT))
    while len(i):
        a, s = low[i], span[i]
        same = (a ^ (a + s)) < _TOP
        s = np.where(same, s, (~a + _ONE) & _LOW) << _S16
        move(i)
        a = a << _S16
        low[i], span[i] = a, s
        i = i[((a ^ (a + s)) < _TOP) | (s < _BOT)]


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // 64), max(MAX_LANES // 2, n // 256)))  # more lanes mean fewer steps to learn from
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    model, out_lane, out_word = _Model(vocab, lanes), [], []

    def move(i: np.ndarray) -> None:
        out_lane.append(i)
        out_word.append((low[i] >> _S48).astype(np.uint16))

    for t in range(steps):
        x = grid[t]
        c2, c1, at = model.predict()
        branch = np.where(x == c2, 0, 2 - (x == c1))
        low, span = _branch(low, span, at + branch, model)
        miss = np.flatnonzero(branch == 2)
        _order0_part(low, span, miss, x[miss], model)
        _settle(low, span, move)
        model.advance(x, branch)
    for _ in range(4):
        move(np.arange(lanes))
        low = low << _S16
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane.astype(np.uint16), kind="stable")
    body = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[order].astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, n, lanes, vocab, len(word), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def _branch(low: np.ndarray, span: np.ndarray, at: np.ndarray, model: _Model):
    """Narrow every lane to its branch: order 2 right, order 1 right, neither."""
    r = span >> _SHIFT
    return low + model.start[at] * r, model.width[at] * r


def _order0_part(low: np.ndarray, span: np.ndarray, miss: np.ndarray, x: np.ndarray, model: _Model) -> None:
    r = span[miss] // model.total
    s = model.cum[x]
    low[miss] += s * r
    span[miss] = (model.cum[x + 1] - s) * r


def decode_block(block: bytes) -> np.ndarray:
    magic, n, lanes, vocab, _, check, own = _HEAD.unpack_from(block)
    body = block[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != check:
        raise ValueError("damaged block")
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(body, "<u2", offset=4 * lanes), np.zeros(8, np.uint16)).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    code = np.zeros(lanes, np.uint64)
    for k in range(4):
        code = (code << _S16) | words[at + k]
    at = at + 4
    steps = -(-n // lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    model, grid = _Model(vocab, lanes, True), np.zeros((steps, lanes), np.int64)

    def move(i: np.ndarray) -> None:
        code[i] = (code[i] << _S16) | words[at[i]]
        at[i] += 1

    for t in range(steps):
        c2, c1, first = model.predict()
        f = (code - low) // (span >> _SHIFT)
        branch = (f >= model.start[first + 1]).astype(np.int64) + (f >= model.start[first + 2])
        low, span = _branch(low, span, first + branch, model)
        x = np.where(branch == 0, c2, c1).astype(np.int64)
        miss = np.flatnonzero(branch == 2)
        f = np.minimum((code[miss] - low[miss]) // (span[miss] // model.total), model.total - _ONE)
        y = model.slot[f.astype(np.int64)]
        _order0_part(low, span, miss, y, model)
        x[miss] = y
        _settle(low, span, move)
        grid[t] = x
        model.advance(x, branch)
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != own:
        raise ValueError("decoded ids differ from the encoded ones")
    return ids.astype(np.int32)


# ---- tokens --------------------------------------------------------------------------------------------------------


class _Places(dict):
    """Numbers of words in the order of their first sight; ``new`` lists those not encoded yet."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of words cut at ASCII white space, which the tokenizer drops; frequent words are remembered up to a bound.

    Where the tokenizer lower-cases and cuts at marks itself, words that differ
    in that only share their ids: A-Z is lower-cased first (not in texts with
    combining marks, which may join a small letter but not the capital, nor
    with a beginning of a special token), and a word of an ASCII letter or
    digit with ``TAIL`` marks behind it is made of both parts' ids.
    """

    MARK, TAIL = "\x01", b".,;:!?#*$%&"

    def __init__(self, path: str, keep: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tok, self.keep, self.end = Tokenizer.from_file(path), keep, None
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        mark = self._ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self._rules()
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _rules(self) -> None:
        """Whether the tokenizer is known to lower-case, and to cut between letters or digits and marks."""
        spec = json.loads(self.tok.to_str())
        norm, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        norm, cut = norm.get("normalizers", [norm]), cut.get("pretokenizers", [cut])
        special = [t["content"].encode() for t in spec["added_tokens"]]
        plain = all(x.get("type") in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for x in norm)
        runs = cut[0].get("type") == "Split" and cut[0].get("behavior") == "Removed" and cut[0].get("invert") and cut[0].get("pattern") == {"Regex": RUNS}
        self.folds = plain and {"type": "Lowercase"} in norm and all(t.startswith(b"<|") for t in special)
        self.cuts = bool(plain and runs and not any(c in t for t in special for c in self.TAIL))
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = None  # by id: whether a run of letters or marks ends with it
        if self.cuts and suffix:
            self.last = np.zeros(self.vocab, bool)
            self.last[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def _split(self, text: bytes) -> list[bytes]:
        if self.folds and b"\xcc" not in text and b"<|" not in text:
            text = text.lower()
        return text.split()

    def _clear(self) -> None:
        self.place = _Places()  # None stands for the end of a text
        self.start, self.size, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def _store(self, numbers: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers], self.size[numbers] = self.used + start, size
        self.used += len(ids)

    def _shrink(self) -> None:
        """Forget all but the more frequent half."""
        n = len(self.place)
        best = np.sort(np.argsort(-self.hits[:n], kind="stable")[: self.keep // 2])
        words = list(self.place)
        size, old = self.size[best], self.start[best]
        first = np.cumsum(size) - size
        ids = self.flat[np.repeat(old - first, size) + np.arange(int(size.sum()))]
        hits = self.hits[best] // 2
        self._clear()
        self.place.update((words[i], k) for k, i in enumerate(best.tolist()))
        self._room(len(best))
        self.hits[: len(best)] = hits
        self._store(np.arange(len(best)), ids, first, size)

    def _room(self, n: int) -> None:
        while n > len(self.start):
            self.start, self.size, self.hits = (np.append(x, np.zeros_like(x)) for x in (self.start, self.size, self.hits))

    def _learn(self, group: int = 4000) -> None:
        """Encode the new words, many in one call, a mark between them; words with marks behind them are put together."""
        new, first, joined = self.place.new, len(self.place) - len(self.place.new), []
        for k, w in enumerate(new) if self.cuts else ():
            if w and w[-1] in self.TAIL:
                core = w.rstrip(self.TAIL)
                if core[-1:].isalnum():
                    joined.append((first + k, self.place[core], self.place[w[len(core) :]]))  # unknown parts line up behind
        own = np.ones(len(new), bool)
        own[[x[0] - first for x in joined]] = False
        self._encode_new(first + np.flatnonzero(own), list(compress(new, own.tolist())), group)
        new.clear()
        if joined:
            number, *parts = np.array(joined).T
            a, b = (self.size[x] for x in parts)
            size = np.column_stack([a, b]).ravel()
            stop = np.cumsum(size)
            ids = self.flat[np.repeat(np.column_stack([self.start[x] for x in parts]).ravel() - (stop - size), size) + np.arange(int(stop[-1]))]
            self._store(number, ids, (stop - size)[::2], a + b)

    def _encode_new(self, numbers: np.ndarray, new: list, group: int) -> None:
        n = len(self.place)
        self._room(n)
        if not new:
            return
        text = b" ".join([w or b"" for w in new]).decode().split(" ")  # words hold no space; the end of a text is empty here
        letters = np.fromiter(map(str.isalpha, text), bool, len(text)) if self.last is not None else np.zeros(len(text), bool)
        marked = np.array([self.mark is not None and w != "" and self.MARK not in w for w in text], bool)
        rest: list[int] = []
        for at, gap, mark in ((np.flatnonzero(letters), " ", None), (np.flatnonzero(marked & ~letters), f" {self.MARK} ", self.mark)):
            for i in range(0, len(at), group):
                part = at[i : i + group]
                ids = np.array(self._ids(gap.join([text[k] for k in part.tolist()])), np.int32)
                if mark is None:  # a word of letters is one run: its last id ends it
                    stop = np.flatnonzero(self.last[ids]) + 1
                    start = np.concatenate([[0], stop[:-1]])
                else:
                    cut = np.flatnonzero(ids == mark)
                    start, stop = np.concatenate([[0], cut + 1]), np.append(cut, len(ids))
                if len(start) == len(part) and stop[-1] == len(ids):
                    self._store(numbers[part], ids, start, stop - start)
                else:
                    rest += part.tolist()
        alone = rest + np.flatnonzero(~letters & ~marked).tolist()
        for k in alone:
            ids = np.array([self.end] if new[k] is None else self._ids(text[k]), np.int32)
            self._store(numbers[k : k + 1], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` behind it, and the number of each."""
        if end != self.end:
            self._clear()
            self.end = end
        if len(self.place) > self.keep:
            self._shrink()
        split = [self._split(t) for t in texts]
        for x in split:
            x.append(None)
        count = np.array([len(x) for x in split], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        if self.place.new:
            self._learn()
        self.hits[: len(self.place)] += np.bincount(at, minlength=len(self.place))
        size = self.size[at]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (stop - size), size) + np.arange(int(stop[-1]))]
        return ids, np.diff(stop[np.cumsum(count) - 1], prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}
remembers("ids", _ENCODERS.clear)


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, end: int, label: str = "id-files", id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 21) -> DataFrame:
    """Encode and code all texts in ascending id order: rows (part, block, n, docs, data), written to the scratch folder.

    A row is a self-contained block of whole documents with about ``block_ids``
    ids (``n``), ``docs`` lists its documents (ids, which are valid, sizes). Parts and
    blocks are in id order, NULL ids first; rows with the same id are in text
    order. NULL and empty texts are one end id.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ids")
        enc, part, block = word_encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            names, ids, each = (list(x) for x in zip(*held, strict=True))
            known = np.array([i is not None for i in chain.from_iterable(names)], np.int64)
            doc = np.array([i or 0 for i in chain.from_iterable(names)], np.int64)
            index = np.concatenate([doc, known, np.concatenate(each)]).astype("<i8").tobytes()
            flat = np.concatenate(ids)
            row = (part, block, len(flat), zlib.compress(index, 1), encode_block(flat, enc.vocab))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "n", "docs", "data"])

        for b in pieces(batches, "text", 4 << 20):
            ids, each = enc.encode(as_bytes(b.column("text")), end)
            held.append((b.column("doc_id").to_pylist(), ids, each))
            if sum(len(x[1]) for x in held) >= block_ids:
                yield flush()
                held, block = [], block + 1
        if held:
            yield flush()

    ordered = src.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, "part int, block int, n long, docs binary, data binary"), label)


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode blocks: doc_id, start, n_tokens, ids_crc32 (and ids) of every document, checksums verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block, docs, data in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                doc, known, each = np.frombuffer(zlib.decompress(docs), "<i8").reshape(3, -1)
                ids = decode_block(data)
                stop = np.cumsum(each)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (s - n) : 4 * s]) for s, n in zip(stop.tolist(), each.tolist(), strict=True)]
                cols = [pa.array([part] * len(doc), pa.int32()), pa.array([block] * len(doc), pa.int32()), pa.array(doc, pa.int64(), mask=known == 0), pa.array(stop - each), pa.array(each), pa.array(crc, pa.int64())]
                names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(np.split(ids, stop[:-1]), pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    found = files.select("part", "block", "docs", "data").mapInArrow(run, schema)
    size = files.select("part", "block", "n")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = size.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))  # one row per part
    offsets = size.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("first") + F.col("ahead")).alias("first"))
    out = found.join(offsets, ["part", "block"]).withColumn("start", F.col("first") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
