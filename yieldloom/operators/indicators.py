"""Band, stochastic-RSI and supertrend features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequential import Days, Fold, Frames, fold_by_symbol, smoothing
from .returns import rolling


def bollinger(prices: DataFrame, n: int, k: float) -> DataFrame:
    mid, sd = rolling(F.avg, "close", n), rolling(F.stddev_samp, "close", n)
    return prices.select("symbol", "date", "close", mid.alias("middle"), (mid - k * sd).alias("lower"), (mid + k * sd).alias("upper"))


DAY = "_day"  # number of the row's date; folds read numbers


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(b != 0, a / b, np.nan)


def bands(value: str, n: int = 5, k: float = 2.0) -> tuple[list[str], Fold, list[str]]:
    """Bands of k sample deviations around the mean of n rows, their width in percent of the mean and the value's place in them."""

    def run(values: dict[str, np.ndarray], days: Days) -> list[np.ndarray]:
        x, frames = values[value], Frames(values[DAY], days)
        mid, sd = frames.roll(x, "avg", n), frames.roll(x, "sd", n)
        low, up = mid - k * sd, mid + k * sd
        return [low, mid, up, _ratio(up - low, mid) * 100, _ratio(x - low, up - low)]

    return [value, DAY], run, [f"BB{c}_{n}_{k:.1f} double" for c in "LMUBP"]


def stochastic_rsi(rsi: str, n: int = 14, k: int = 3, d: int = 3) -> tuple[list[str], Fold, list[str]]:
    """Position of RSI in its own range, smoothed twice."""

    def run(values: dict[str, np.ndarray], days: Days) -> list[np.ndarray]:
        x, frames = values[rsi], Frames(values[DAY], days)
        lo, hi = frames.roll(x, "min", n), frames.roll(x, "max", n)
        fast = frames.roll(_ratio(x - lo, hi - lo) * 100, "avg", k)
        return [fast, frames.roll(fast, "avg", d)]

    return [rsi, DAY], run, [f"STOCHRSI{c}_{n}_{n}_{k}_{d} double" for c in "kd"]


def supertrend(length: int = 7, factor: float = 3.0) -> tuple[list[str], Fold, list[str]]:
    """Average-true-range bands that only tighten until the close crosses them.

    Band and direction depend on the previous row, so this is a fold over one
    symbol's days.
    """
    tag = f"{length}_{factor:.1f}"
    names = [f"SUPERT_{tag}", f"SUPERTd_{tag}", f"SUPERTl_{tag}", f"SUPERTs_{tag}"]

    def run(values: dict[str, np.ndarray], days: Days) -> list[np.ndarray]:
        h, lo, c = (values[x][days.order] for x in ("high", "low", "close"))
        prev = days.before(c)
        tr = np.fmax(h - lo, np.fmax(np.abs(h - prev), np.abs(lo - prev)))
        alpha = 1 / length
        atr = days.smoothed(tr, (1 - alpha) / alpha, length)
        up, dn = (h + lo) / 2 + factor * atr, (h + lo) / 2 - factor * atr
        way = np.ones(len(c))
        line = np.full(len(c), np.nan)
        last = 0
        for i, j in days.steps():
            if i:
                k = slice(last, last + j - i)
                way[i:j] = np.where(c[i:j] > up[k], 1, np.where(c[i:j] < dn[k], -1, way[k]))
                same, rise = way[i:j] == way[k], way[i:j] > 0
                np.copyto(dn[i:j], dn[k], where=same & rise & (dn[i:j] < dn[k]))
                np.copyto(up[i:j], up[k], where=same & ~rise & (up[i:j] > up[k]))
                line[i:j] = np.where(rise, dn[i:j], up[i:j])
            last = i
        return [days.back(x) for x in (line, way, np.where(way > 0, line, np.nan), np.where(way < 0, line, np.nan))]

    return ["high", "low", "close"], run, [f"{n} double" for n in names]


def feature_indicators(prices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """RSI, supertrend, bands and stochastic RSI under their usual feature names; columns of ``keep`` pass as they are."""
    d = prices.select("symbol", "date", "open", "high", "low", "close", "volume", *keep, F.datediff("date", F.lit("1970-01-01")).alias(DAY))
    d = fold_by_symbol(d, ["symbol"], "date", [smoothing("close", rsi=(14,)), supertrend(), bands("close"), stochastic_rsi("rsi_14")])
    return d.drop(DAY).withColumnRenamed("rsi_14", "RSI_14")
