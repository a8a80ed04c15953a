"""Ordered scans with bounds, prefix, suffix, filter and limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import Bytes, has_prefix, has_suffix, in_range


def scan(view: DataFrame, *, prefix: Bytes | None = None, suffix: Bytes | None = None, start: Bytes | None = None, end: Bytes | None = None, limit: int = 0, where: Column | None = None, ordered: bool = True) -> DataFrame:
    """Rows of a (key, value) view in key order.

    A prefix or suffix takes precedence: the bounds are ignored where either is given. A limit of 0 or less is
    none; with one the plan keeps ``limit`` rows a task and never sorts the rest.
    """
    if prefix or suffix:
        if prefix:
            view = view.where(has_prefix("key", prefix))
        if suffix:
            view = view.where(has_suffix("key", suffix))
    elif start or end:
        view = view.where(in_range("key", start, end))
    if where is not None:
        view = view.where(where)
    if ordered or limit > 0:
        view = view.orderBy("key")
    return view.limit(limit) if limit > 0 else view


def filter_keys(view: DataFrame, keep: Callable[[bytes], bool]) -> DataFrame:
    """Rows whose key satisfies a Python callable, in Arrow batches; a Column in ``scan(where=...)`` is faster."""
    kind = view.schema["key"].dataType.simpleString()

    @F.pandas_udf("boolean")
    def kept(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bool(keep(k if kind == "string" else bytes(k))))

    return view.where(kept("key"))


class Scanner:
    """Row by row over a scan: next(), key(), value(), error(), close(). Rows come a partition at a time."""

    def __init__(self, df: DataFrame):
        self._rows: Iterator | None = df.toLocalIterator(prefetchPartitions=True)
        self._row = self._error = None

    def next(self) -> bool:
        if self._rows is None:
            return False
        try:
            self._row = next(self._rows, None)
        except Exception as error:
            self._row, self._error, self._rows = None, error, None
        return self._row is not None

    def key(self) -> bytes | str | None:
        return None if self._row is None else _plain(self._row["key"])

    def value(self) -> bytes | str | None:
        return None if self._row is None else _plain(self._row["value"])

    def error(self) -> Exception | None:
        return self._error

    def close(self) -> None:
        self._rows = self._row = None

    def __iter__(self) -> Iterator[tuple]:
        while self.next():
            yield self.key(), self.value()


def _plain(x):
    return bytes(x) if isinstance(x, bytearray) else x
