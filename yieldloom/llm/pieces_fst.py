"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from a model file: the normaliser (space to U+2581, one in front), the
lexicon (a trie from characters to piece ids), byte fallback for characters
without a piece, and the acceptor of adjacent pieces. In a BPE model a
segmentation is the one that merging yields exactly if every two adjacent
pieces are what merging makes of their joined text, so adjacency arcs weigh 0
or infinity and the tropical shortest path is the only one of finite weight.
Composition with an input is lazy: arcs are built where the search gets to,
adjacency arcs are compiled when first met and remembered up to a bound.

No piece has U+2581 behind another character, so a text falls into units (a run
of U+2581 and what follows) that are composed on their own; frequent units are
remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, claim, pieces, remembers

SPACE = "▁"
_UNITS, _PAIRS = 1 << 18, 1 << 18  # units remembered in each of two generations, and adjacent pairs


class Transducer:
    """Encoder and decoder for a BPE model with byte fallback and an identity character map."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are compiled; a unigram model's pieces weigh otherwise")
        if model.normalizer_spec.precompiled_charsmap or not model.normalizer_spec.escape_whitespaces or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only identity normalisers with escaped white space are compiled")
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = []
        self.bytes: list[int] = [0] * 256
        self.unknown = 0
        for i, p in enumerate(model.pieces):
            text = b""
            if p.type == 1:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                text = p.piece.replace(SPACE, " ").encode()
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unknown, text = i, model.trainer_spec.unk_surface.encode()
            elif p.type not in (3, 5):
                raise ValueError(f"piece type {p.type} is not compiled")
            self.surface.append(text)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds white space behind another character")
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.text = {i: p for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        joining = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        inside = "".join(re.escape(c) for c in sorted(joining))
        self.unit = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]" if inside else f"{SPACE}+|[^{SPACE}]", re.S)
        self.segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.alphabet = {c for c in self.ids if len(c) == 1}
        self.valid: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def _merged(self, text: str) -> list[str]:
        """What merging by score, leftmost first, makes of a short text."""
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _adjacent(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.valid.get(key)
        if ok is None:
            if len(self.valid) >= _PAIRS:
                self.valid.clear()
            p, q = self.text[a], self.text[b]
            ok = self.valid[key] = p + q not in self.ids and self._merged(p + q) == [p, q]
        return ok

    def _arcs(self, s: str, at: int) -> list[tuple[int, int]]:
        """Lexicon arcs (end, id) from a position, shortest first."""
        out, node = [], self.trie
        for c in s[at : at + self.longest]:
            node = node.get(c)
            if node is None:
                break
            at += 1
            i = node.get("")
            if i is not None:
                out.append((at, i))
        return out

    def shortest(self, s: str) -> list[int] | None:
        """Ids on the path of finite weight through a stretch whose characters all have pieces.

        Long arcs come first; the arcs of a position are found once, dead states are remembered.
        """
        n, valid = len(s), self.valid
        out: list[int] = []
        arcs = {0: self._arcs(s, 0)}
        path = [(0, len(arcs[0]))]  # position, and how many of its arcs are still untried
        dead: set[tuple[int, int]] = set()
        before = -1
        while path:
            at, left = path.pop()
            ends = arcs[at]
            while left:
                left -= 1
                j, i = ends[left]
                own = valid.get(i)
                if own is None:
                    own = valid[i] = len(self._merged(s[at:j])) == 1
                if not own or (dead and (j, i) in dead):
                    continue
                if before >= 0:
                    ok = valid.get(before << 32 | i)
                    if not (self._adjacent(before, i) if ok is None else ok):
                        continue
                out.append(i)
                if j == n:
                    return out
                path.append((at, left))
                if j not in arcs:
                    arcs[j] = self._arcs(s, j)
                path.append((j, len(arcs[j])))
                before = i
                break
            else:
                if out:
                    dead.add((at, out.pop()))
                before = out[-1] if out else -1
        return None

    def _unit(self, u: str) -> list[int]:
        if self.alphabet.issuperset(u):
            return self.shortest(u)
        out, start = [], 0
        for k, c in enumerate(u + "\0"):  # byte fallback cuts the unit
            if k == len(u) or c not in self.ids:
                if k > start:
                    out += self.shortest(u[start:k])
                if k < len(u):
                    out += [self.bytes[b] for b in c.encode()]
                start = k + 1
        return out

    def _recall(self, u: str) -> list[int]:
        """A unit's ids; when the memory is full the younger generation becomes the older one, and what is used again is young again."""
        ids = self.older.get(u)
        if ids is None:
            ids = self._unit(u)
        if len(u) <= 64:
            if len(self.known) >= _UNITS:
                self.known, self.older = {}, self.known
            self.known[u] = ids
        return ids

    def forget(self) -> None:
        self.known, self.older, self.valid = {}, {}, {}

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            cuts = self.segment.findall(self.prefix + text.replace(" ", SPACE))
        else:
            cuts = (self.prefix + text.replace(" ", " " + SPACE)).split(" ")
        out: list[int] = []
        for s in cuts:  # a unit never goes on behind a space
            ids = self.known.get(s)
            if ids is not None:
                out += ids
                continue
            for u in self.unit.findall(s):
                ids = self.known.get(u)
                out += self._recall(u) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_LOADED: dict[str, Transducer] = {}
remembers("pieces", lambda: [t.forget() for t in _LOADED.values()])


def transducer(path: str) -> Transducer:
    """The compiled model of this process."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids (if asked for), n_tokens, ids_crc32, decoded_sha256, round_trip.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids; the text is decoded
    from the ids again, its digest and whether it is the input follow. NULL and
    empty texts have no ids. A text with U+2581 in it decodes with a space
    there. Repeated rows are answered alike; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces")
        t = transducer(path)
        for b in pieces(batches, "text", 4 << 20):
            rows = []
            for raw in as_bytes(b.column("text")):
                ids = t.encode(raw.decode())
                back = t.decode(ids).encode()
                packed = np.array(ids, "<u4")
                rows.append(([packed.astype(np.int32)] if with_ids else []) + [len(ids), zlib.crc32(packed.tobytes()), hashlib.sha256(back).hexdigest(), back == raw])
            types = ([pa.list_(pa.int32())] if with_ids else []) + [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            names = ["doc_id", *(["ids"] if with_ids else []), "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = "ids array<int>, " if with_ids else ""
    return src.mapInArrow(run, f"doc_id long, {ids}n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
