"""A series at a time as arrays: rows are dealt by symbol, and the calendar bounds each series.

Frames that Spark works out anew for every row cost rows times their width in boxed steps; here
the windows of a series are views of one array, reduced some at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, types as T

#: Windows that are reduced together, which bounds what a long series needs at a time.
TOGETHER = 1024


def in_order(table: pa.Table, by: str = "date") -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(by, "ascending")], null_placement="at_start"))


def values_of(table: pa.Table, name: str) -> np.ndarray:
    """A column of doubles, NULL as NaN."""
    return np.array(table.column(name).to_numpy(), dtype=np.float64)


def each_series(df: DataFrame, work: Callable[[pa.Table], dict], names: list[str]) -> DataFrame:
    """``df`` with the double columns ``names`` that ``work`` makes of each series in date order.

    ``work`` returns arrays as long as the series; NaN becomes NULL. An array ``kept`` of
    booleans beside them leaves rows out.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(table: pa.Table) -> pa.Table:
        table = in_order(table)
        made = work(table)
        for n in names:
            table = table.append_column(n, pa.array(made[n], pa.float64(), from_pandas=True))
        return table.filter(pa.array(made["kept"])) if "kept" in made else table

    return df.groupBy("symbol").applyInArrow(run, schema)


def windows(x: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The windows of ``n`` values, some at a time, each with the places of their last values."""
    if len(x) >= n:
        view = sliding_window_view(x, n)
        for a in range(0, len(view), TOGETHER):
            yield slice(a + n - 1, min(a + TOGETHER, len(view)) + n - 1), view[a : a + TOGETHER]


def centred(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window less its mean, NULLs as zero, and how many values it has. Equal values give zeros exactly."""
    there = ~np.isnan(w)
    n = there.sum(axis=1)
    first = np.take_along_axis(w, there.argmax(axis=1)[:, None], axis=1)
    d = np.where(there, w - first, 0.0)
    mean = d.sum(axis=1) / np.maximum(n, 1)
    return np.where(there, d - mean[:, None], 0.0), n


def deviation(x: np.ndarray, n: int, sample: bool = True) -> np.ndarray:
    """Standard deviation of the values among the last ``n`` rows, at rows that have so many before them."""
    out = np.full(len(x), np.nan)
    least = 1 if sample else 0
    for at, w in windows(x, n):
        d, held = centred(w)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at] = np.where(held > least, np.sqrt((d * d).sum(axis=1) / (held - least)), np.nan)
    return out
