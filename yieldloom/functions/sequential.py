"""The few truly sequential folds, over the days of many symbols at once.

A group is one symbol's daily history, at most one row per calendar day. Rows
arrive sorted by group and day; a block of whole groups is walked day by day,
each step a few array operations over all groups that have such a day. Columns
that a fold does not read pass as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .scan import _changes

BLOCK_ROWS = 1 << 16


class Days:
    """Rows of a block ordered by their place in their group, the longest groups first: the groups of step t are the first ones of step t - 1."""

    def __init__(self, start: np.ndarray, rows: int):
        size = np.diff(start, append=rows)
        self.start, self.end, self.groups = start, start + size, len(start)
        rank = np.empty(len(start), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(start))
        place = np.arange(rows) - np.repeat(start, size)
        self.order = np.lexsort((np.repeat(rank, size), place))
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(place))]) if rows else np.zeros(1, np.int64)

    def steps(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)

    def back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def before(self, x: np.ndarray) -> np.ndarray:
        """Each row's value of the day before in its group, NaN on the first; both in step order."""
        out = np.full(len(x), np.nan)
        prev = 0
        for lo, hi in self.steps():
            if lo:
                out[lo:hi] = x[prev : prev + hi - lo]
            prev = lo
        return out

    def smoothed(self, x: np.ndarray, com: float, least: int) -> np.ndarray:
        """Exponential mean (not adjusted, gaps decay) with centre of mass ``com``, NaN before ``least`` values; in step order."""
        alpha = 1 / (1 + com)
        keep = 1 - alpha
        out = np.empty(len(x))
        mean, weight, seen = np.full(self.groups, np.nan), np.ones(self.groups), np.zeros(self.groups, np.int64)
        for lo, hi in self.steps():
            now, m, w, n = x[lo:hi], mean[: hi - lo], weight[: hi - lo], seen[: hi - lo]
            there, began = now == now, m == m
            n += there
            w[began] *= keep
            both = there & began
            moved = (w * m + alpha * now) / (w + alpha)
            np.copyto(m, moved, where=both & (m != now))
            np.copyto(m, now, where=there & ~began)
            w[both] = 1.0
            out[lo:hi] = np.where(n >= least, m, np.nan)
        return out


def rolled(x: np.ndarray, place: np.ndarray, kind: str, n: int, shift: int = 0) -> np.ndarray:
    """Rolling avg, sd (sample deviation), max or min over the n rows of a group that end ``shift`` rows back, NaN until complete or with a gap.

    ``x`` in row order, ``place`` counts from 0 in each group. The values of all frames are taken up one after the other, oldest
    first, with the steps of Spark's own aggregates, so that the results have the same bits.
    """
    out = np.full(len(x), np.nan)
    rows = len(x) - (n - 1) - shift
    if rows <= 0:
        return out
    first = x[:rows]
    with np.errstate(all="ignore"):
        if kind == "sd":
            mean, m2 = np.zeros(rows), np.zeros(rows)
            for k in range(n):
                delta = x[k : k + rows] - mean
                part = delta / (k + 1)
                mean += part
                m2 += delta * (delta - part)
            got = np.sqrt(m2 / (n - 1)) if n > 1 else np.full(rows, np.nan)
        else:
            got = first.copy()
            step = {"avg": np.add, "max": np.maximum, "min": np.minimum}[kind]
            for k in range(1, n):
                step(got, x[k : k + rows], out=got)
            if kind == "avg":
                got /= n
    out[n - 1 + shift :] = got
    out[place < n - 1 + shift] = np.nan
    return out


class Frames:
    """Rolling aggregates, see ``rolled``, in the order that ``number`` gives the rows of a group; rows without a number come first."""

    def __init__(self, number: np.ndarray, days: Days):
        size = days.end - days.start
        self.place = np.arange(len(number)) - np.repeat(days.start, size)
        self.size = np.repeat(size, size)
        self.at = np.lexsort((np.where(np.isnan(number), -np.inf, number), np.repeat(np.arange(days.groups), size)))

    def roll(self, x: np.ndarray, kind: str, n: int, shift: int = 0) -> np.ndarray:
        return self.back(rolled(x[self.at], self.place, kind, n, shift))

    def back(self, x: np.ndarray) -> np.ndarray:
        """From the order of the numbers to row order."""
        out = np.empty_like(x)
        out[self.at] = x
        return out

    def lag(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The value n rows back in the group, NaN (0 in integers) where there is none; both in the order of the numbers."""
        out = np.full(len(x), np.nan) if x.dtype.kind == "f" else np.zeros_like(x)
        out[n:] = x[: max(0, len(x) - n)]
        out[self.place < n] = np.nan if x.dtype.kind == "f" else 0
        return out

    def was(self, flag: np.ndarray, k: int) -> np.ndarray:
        """Whether a flag held in any of the k rows before; both in the order of the numbers."""
        out = np.zeros(len(flag), bool)
        for n in range(1, k + 1):
            out |= self.lag(flag, n)
        return out

    def ahead(self, x: np.ndarray, wanted: np.ndarray, first: int, count: int) -> pa.ListArray:
        """For each wanted row, in row order, the known values of up to ``count`` rows that begin ``first`` rows on; x and wanted in the order of the numbers."""
        left = self.size - self.place - first
        rows = np.flatnonzero(wanted)
        rows = rows[np.argsort(self.at[rows], kind="stable")]
        n = np.clip(left[rows], 0, count)
        begin = np.cumsum(n) - n
        value = x[np.repeat(rows + first - begin, n) + np.arange(n.sum())]
        known = value == value
        sizes = np.zeros(len(x), np.int64)
        sizes[self.at[rows]] = np.diff(np.concatenate([[0], np.cumsum(known)])[np.append(begin, len(known))])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(value[known]))


def rolling_columns(value: str, rolls: frozenset[tuple[str, int, int]], order: str) -> tuple[list[str], Fold, list[str]]:
    """A fold that adds ``kind_n_shift`` for every (kind, n, shift), see ``rolled``; ``order`` is the row number of each row in its group."""
    wanted = sorted(rolls)

    def run(values: dict[str, np.ndarray], days: Days) -> list[np.ndarray]:
        frames = Frames(values[order], days)
        return [frames.roll(values[value], *w) for w in wanted]

    return [value, order], run, [f"{kind}_{n}_{shift} double" for kind, n, shift in wanted]


Fold = Callable[[dict[str, np.ndarray], Days], list[np.ndarray]]


def fold_by_symbol(df: DataFrame, keys: list[str], order: str, folds: list[tuple[list[str], Fold, list[str]]], emit: list[str] | None = None) -> DataFrame:
    """Add columns to every row, made by ``folds``: the number columns one reads, the function and the names and types of what it adds.
    A fold may read what an earlier one adds. ``emit`` names the columns to return, all without it.

    A function gets float arrays in row order, whole groups one after the other, and gives arrays in row order; NaN becomes NULL,
    also in the other columns. NULL keys are one group, NULL dates come last in theirs.
    """
    new = [x.rsplit(" ", 1) for _, _, names in folds for x in names]
    reads = [c for c in dict.fromkeys(c for cols, _, _ in folds for c in cols) if c not in {n for n, _ in new}]
    types = [(f.name, f.dataType.simpleString()) for f in df.schema] + [(n, t) for n, t in new]
    emitted = [n for n, _ in types] if emit is None else emit
    schema = ", ".join(f"`{n}` {dict(types)[n]}" for n in emitted)
    kinds = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}

    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        days = Days(np.flatnonzero(_changes(t, keys)), t.num_rows)
        values = {c: pc.cast(t[c], pa.float64()).to_numpy() for c in reads}
        for i, f in enumerate(t.schema):
            if pa.types.is_floating(f.type):
                t = t.set_column(i, f, pc.if_else(pc.is_nan(t[f.name]), pa.scalar(None, f.type), t[f.name]))
        made = []
        for cols, fn, names in folds:
            made += fn({c: values[c] for c in cols}, days)
            values.update(zip((n.rsplit(" ", 1)[0] for n in names), made[len(made) - len(names) :], strict=True))
        for (name, kind), x in zip(new, made, strict=True):
            if name in emitted:
                t = t.append_column(name, x if isinstance(x, pa.Array) else pa.array(x, kinds[kind], from_pandas=True))
        yield from t.select(emitted).to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < BLOCK_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_changes(t, keys))[-1])
            if last:
                yield from block(t.slice(0, last).combine_chunks())
            held = t.slice(last).combine_chunks().to_batches()
            rows -= last
        if rows:
            yield from block(pa.Table.from_batches(held).combine_chunks())

    return spread(df, *keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last()).mapInArrow(run, schema)


def smoothing(value: str, rsi: tuple[int, ...] = (), ema: tuple[int, ...] = (), zero_loss: float | None = 100.0, tight: tuple[tuple[int, float, int], ...] = ()) -> tuple[list[str], Fold, list[str]]:
    """The columns of ``with_smoothed`` as a fold."""
    bands = sorted({t[0] for t in tight})
    flags = [f"tight_{n}_{pct:g}_{look}".replace(".", "_") for n, pct, look in tight]
    names = [f"rsi_{p} double" for p in rsi] + [f"ema_{s} double" for s in ema] + [f"bw_{n} double" for n in bands] + [f"{n} boolean" for n in flags]

    def smooth(values: dict[str, np.ndarray], days: Days) -> list[np.ndarray]:
        own = values[value]
        x = own[days.order]
        out = []
        move = x - days.before(x) if rsi else x
        for p in rsi:
            com = (1 - 1 / p) / (1 / p)
            gain = days.smoothed(np.where(move < 0, 0.0, move), com, p)
            loss = days.smoothed(np.where(-move < 0, 0.0, -move), com, p)
            y = 100 - 100 / (1 + gain / np.where(loss > 0, loss, np.nan))
            if zero_loss is not None:
                y = np.where((loss == 0) & (gain > 0), zero_loss, y)
            out.append(days.back(y))
        for s in ema:
            out.append(days.back(days.smoothed(x, (s - 1) / 2, s)))
        widths, tights = [np.empty(len(own)) for _ in bands], [np.empty(len(own), bool) for _ in tight]
        for lo, hi in zip(days.start.tolist() if tight else [], days.end.tolist(), strict=False):
            one = pd.Series(own[lo:hi])
            of = {}
            for n, w in zip(bands, widths, strict=True):
                roll = one.rolling(n, min_periods=n)
                of[n] = roll.std() * 4 / roll.mean() * 100
                w[lo:hi] = of[n]
            for (n, pct, look), t in zip(tight, tights, strict=True):
                t[lo:hi] = of[n] <= of[n].rolling(look, min_periods=look).quantile(pct / 100)
        return [*out, *widths, *tights]

    return [value], smooth, names


def with_smoothed(df: DataFrame, value: str, rsi: tuple[int, ...] = (), ema: tuple[int, ...] = (), zero_loss: float | None = 100.0, keys: tuple[str, ...] = ("symbol",), tight: tuple[tuple[int, float, int], ...] = (), rolls: frozenset[tuple[str, int, int]] = frozenset()) -> DataFrame:
    """Add ``rsi_p`` (Wilder) and ``ema_s`` columns per symbol, and a ``kind_n_shift`` column for each of ``rolls`` in the order of ``rn``.

    First RSI at row p. A window without losses gives ``zero_loss`` (100 for
    signals, None for charts); a flat window gives NULL. Each ``tight`` entry
    (band period, percentile, look-back) adds the band width and whether it is
    at or below its own rolling percentile: the sorted rolling window of pandas
    is far cheaper here than a percentile over every window frame.
    """
    folds = [smoothing(value, rsi, ema, zero_loss, tight)]
    if rolls:
        folds.append(rolling_columns(value, rolls, "rn"))
    return fold_by_symbol(df, list(keys), "date", folds)
