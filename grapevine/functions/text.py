"""Labels and name similarity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tagged(prefix: str, value: Column) -> Column:
    """``prefix-<integer>``, or ``prefix-nan`` when the value is not an integer."""
    whole = value.cast("string").try_cast("bigint").cast("string")
    return F.coalesce(F.concat(F.lit(f"{prefix}-"), whole), F.lit(f"{prefix}-nan"))


def zip_label(value: Column) -> Column:
    return tagged("zc", value)


def store_label(value: Column) -> Column:
    return tagged("SId", value)


def week_label(value: Column) -> Column:
    return tagged("w", value)


def untagged(label: Column) -> Column:
    """The part of a label after the dash."""
    return F.split(label, "-").getItem(1)


def name_similarity(left: str, right: str) -> Column:
    """Ratcliff/Obershelp similarity of two columns, in [0, 1]; missing names give NULL.

    The order of the names matters. Spark has no such function and the matching is not an
    edit distance, so this is the one Python column of the library. Each worker remembers
    recent pairs; callers with many rows compare distinct pairs and join them back.
    """

    # Defined inside, so that it travels to the workers by value.
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=100_000)
        def matching_share(a: str, b: str) -> float:
            return SequenceMatcher(None, a, b).ratio()

        for names, others in batches:
            shares = [
                None if a is None or b is None else matching_share(a, b)
                for a, b in zip(names, others, strict=True)
            ]
            yield pd.Series(shares, dtype="float64")

    return F.pandas_udf(similarity, T.DoubleType())(left, right)
