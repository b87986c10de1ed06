"""One pass over sorted partitions: positions, ties, totals and running sums per group.

The rows are range-sorted once and the order is written with ``checkpoint``, as
compressed batches. The pass that packs them sums up how each partition begins
and ends; from these rows, one per partition, the driver works out what every partition
has to add for groups and runs of equal values that began before it or go on
behind it. A second pass gives every row its columns. Nothing is shuffled after
the sort, a value that half of the rows share is spread like any other, and a
task holds the rows that one group has in its partition at most.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, packed, unpacked

_PACKED = "pid int, ends boolean, body binary"  # a partition's batches, then how it begins and ends


def _changes(b: pa.RecordBatch | pa.Table, cols: list[str]) -> np.ndarray:
    """Which rows differ from the row before in any of the columns; NULL equals NULL, NaN equals NaN. The first row counts as different."""
    out = np.zeros(b.num_rows, bool)
    out[:1] = True
    for c in cols:
        col = b.column(c)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if b.num_rows < 2:
            break
        null = col.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_floating(col.type):
            x = np.where(null, 0.0, col.to_numpy(zero_copy_only=False))
            differ = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
        else:
            differ = pc.fill_null(pc.not_equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False)
        out[1:] |= differ | (null[1:] != null[:-1])
    return out


def _key(b: pa.RecordBatch | pa.Table, cols: list[str], row: int) -> tuple:
    values = (b.column(c)[row].as_py() for c in cols)
    return tuple("NaN" if isinstance(v, float) and v != v else v for v in values)


def _numbers(b: pa.Table, c: str) -> np.ndarray:
    col = b.column(c).combine_chunks() if isinstance(b.column(c), pa.ChunkedArray) else b.column(c)
    kind = pa.float64() if pa.types.is_floating(col.type) else pa.int64()
    return pc.fill_null(col.cast(kind), 0).to_numpy(zero_copy_only=False)


def _known(b: pa.Table, value: str | None) -> np.ndarray:
    return np.ones(b.num_rows, bool) if value is None else b.column(value).is_valid().to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(value).combine_chunks().is_valid().to_numpy(zero_copy_only=False)


class _Run:
    """Rows, known values and weight sums of a group's (or tie's) rows at one end of a partition."""

    def __init__(self, key: tuple, weights: int):
        self.key, self.rows, self.known, self.sums = key, 0, 0, [0] * weights

    def add(self, known: np.ndarray, weights: list[np.ndarray], lo: int, hi: int) -> None:
        self.rows += hi - lo
        self.known += int(known[lo:hi].sum())
        self.sums = [s + w[lo:hi].sum().item() for s, w in zip(self.sums, weights, strict=True)]


def _ends(by: list[str], ties: list[str], value: str | None, weights: list[str]):
    """The batches, packed, and one row per partition: its first and last group and its first and last tie."""

    def row(ends: bool, body: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ends]), pa.array([body], pa.binary())], names=["pid", "ends", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, Any] = {}
        for b in batches:
            if not b.num_rows:
                continue
            yield row(False, packed(b))
            known, w = _known(b, value), [_numbers(b, c) for c in weights]
            for name, cols in (("group", by), ("tie", ties)):
                first, last = _key(b, cols, 0), _key(b, cols, b.num_rows - 1)
                cut = np.flatnonzero(_changes(b, cols))
                if name not in state:
                    state[name] = [_Run(first, len(weights))] * 2
                head, tail = state[name]
                edge = [*cut.tolist(), b.num_rows]
                for i, (lo, hi) in ((i, edge[i : i + 2]) for i in sorted({0, len(edge) - 2})):
                    key = first if i == 0 else last
                    if key != tail.key:
                        tail = _Run(key, len(weights))
                    tail.add(known, w, lo, hi)
                state[name] = [head, tail]
        if state:
            yield row(True, pickle.dumps({k: [vars(x) for x in v] + [v[0] is v[1]] for k, v in state.items()}))

    return run


def _carry(ends: dict[int, dict]) -> dict[int, dict]:
    """Per partition and kind of run: what its first run had before it and what its last run has behind it."""
    out: dict[int, dict] = {p: {} for p in ends}
    for kind in ("group", "tie"):
        for order, mine, theirs, name in ((sorted(ends), 0, 1, "before"), (sorted(ends, reverse=True), 1, 0, "after")):
            prev, sofar = None, None
            for p in order:
                run, far, one = ends[p][kind][mine], ends[p][kind][theirs], ends[p][kind][2]
                got = sofar if prev == run["key"] else None
                out[p][kind, name] = got or {"rows": 0, "known": 0, "sums": [0] * len(run["sums"])}
                base = out[p][kind, name] if one else {"rows": 0, "known": 0, "sums": [0] * len(run["sums"])}
                prev, sofar = far["key"], {"rows": base["rows"] + far["rows"], "known": base["known"] + far["known"], "sums": [a + c for a, c in zip(base["sums"], far["sums"], strict=True)]}
    return out


def _columns(t: pa.Table, by: list[str], ties: list[str], value: str | None, weights: list[str], carry: dict, leads: bool, trails: bool) -> list[np.ndarray]:
    """Columns of a block of whole groups (as far as they lie in this partition)."""
    n = t.num_rows
    known, w = _known(t, value), [_numbers(t, c) for c in weights]
    out = []
    none = {"rows": 0, "known": 0, "sums": [0] * len(weights)}
    edges = {}
    for kind, cols in (("group", by), ("tie", ties)):
        start = np.flatnonzero(_changes(t, cols))
        edges[kind] = start, np.diff(start, append=n), carry[kind, "before"] if leads else none, carry[kind, "after"] if trails else none
    start, size, before, after = edges["group"]
    place = np.arange(n) - np.repeat(start, size) + 1
    place[: size[0]] += before["rows"]
    total = np.add.reduceat(known.astype(np.int64), start)
    total[0] += before["known"]
    total[-1] += after["known"]
    out += [place, np.repeat(total, size)]
    if value is not None:
        tstart, tsize, tbefore, tafter = edges["tie"]
        low = place[tstart].copy()
        low[0] -= tbefore["rows"]
        count = tsize.copy()
        count[0] += tbefore["rows"]
        count[-1] += tafter["rows"]
        out += [np.repeat(low, tsize), np.repeat(count, tsize)]
    for k, x in enumerate(w):
        run = np.empty_like(x)
        sums = np.empty(len(start), x.dtype)
        for g, (i, m) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
            base = before["sums"][k] if g == 0 else 0
            run[i] = base
            if m > 1:
                run[i + 1 : i + m] = x[i : i + m - 1]
                np.cumsum(run[i : i + m], out=run[i : i + m])
            sums[g] = run[i + m - 1] + x[i + m - 1]
        sums[-1] += after["sums"][k]
        out += [run, np.repeat(sums, size)]
    return out


def _fill(by, ties, value, weights, carry, more: list[pa.Field]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        held: list[pa.RecordBatch] = []
        leads = True

        def done(trails: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            cols = _columns(t, by, ties, value, weights, own, leads, trails)
            for f, c in zip(more, cols, strict=True):
                t = t.append_column(f, pa.array(c, f.type))
            yield from t.to_batches(10_000)

        for pid, b in ((p.column(0)[0].as_py(), x) for p in batches if p.num_rows for x in unpacked(p.column(1))):
            own = carry.value[pid]  # the number of the sorted partition: this task's own may differ, behind a union for one
            cut = _changes(b, by)
            cut[0] = not held or _key(b, by, 0) != _key(held[-1], by, held[-1].num_rows - 1)
            last = np.flatnonzero(cut)
            if len(last) and (held or last[-1] > 0):
                if last[-1] > 0:
                    held.append(b.slice(0, int(last[-1])))
                yield from done(False)
                leads = False
                held = [b.slice(int(last[-1]))]
            else:
                held.append(b)
        if held:
            yield from done(True)

    return run


def scan_sorted(df: DataFrame, by: list[str], order: list[Column | str], value: str | None = None, weights: dict[str, str] | None = None) -> DataFrame:
    """Rows in the order (by, order) with columns about their group.

    ``_place`` is the row's 1-based place, ``_n`` the number of rows with a non-NULL ``value`` (all rows without one). With a ``value``, which
    has to be the first of ``order``, ``_low`` and ``_count`` are the first place and the number of rows that share it. Each weight
    (name -> integer or float column, NULL counts 0) gives the sum over the rows before, ``name``, and over the whole group, ``name_total``.
    ``order`` has to end in a unique key, so that equal values spread over the partitions.
    """
    weights = weights or {}
    ties = [*by, value] if value is not None else by
    saved = cut_lineage(df.orderBy(*by, *order).mapInArrow(_ends(by, ties, value, list(weights.values())), _PACKED))
    carry = _carry({r.pid: pickle.loads(r.body) for r in saved.where("ends").collect()})  # one row per partition
    new = [T.StructField(c, T.LongType()) for c in ("_place", "_n", *(("_low", "_count") if value is not None else ()))]
    for name, c in weights.items():
        kind = T.DoubleType() if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else T.LongType()
        new += [T.StructField(name, kind), T.StructField(f"{name}_total", kind)]
    schema = T.StructType([*df.schema.fields, *new])
    more = [pa.field(f.name, pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64()) for f in new]
    return saved.where("not ends").select("pid", "body").mapInArrow(_fill(by, ties, value, list(weights.values()), df.sparkSession.sparkContext.broadcast(carry), more), schema)
