"""Joins on group keys in which a null is a group like others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls equal to nulls; the keys come from the left side once."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    return left.join(other, reduce(and_, (left[k].eqNullSafe(other[f"_same_{k}"]) for k in keys)), how).drop(*(f"_same_{k}" for k in keys))
