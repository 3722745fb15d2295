"""User functions on Arrow batches: scalar, table-valued and aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(f: Callable[..., pd.Series], kind: str) -> Callable[..., Column]:
    """A function of whole columns (pandas Series)."""
    return F.pandas_udf(f, kind)


def aggregate(f: Callable[..., float], kind: str) -> Callable[..., Column]:
    """A function of a group's columns to one value; for what built-in aggregates don't express."""

    def run(*columns: pd.Series):
        return f(*columns)

    run.__annotations__ = {}
    return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)


def rows(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Batches of rows to batches of any rows: filter, map and flat map by plain code."""
    return df.mapInPandas(f, schema)
