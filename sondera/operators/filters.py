"""Filters given as a dictionary, compiled to one predicate that Catalyst can push to the scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that ask for a prefix of the source's path.
PREFIX_KEYS = ("path_prefix", "source_path_prefix")


def _field(df: DataFrame, key: str) -> Column:
    """A column of that name, else the key in the metadata."""
    if key in df.columns:
        return F.col(key)
    if "metadata" in df.columns and dict(df.dtypes)["metadata"] == "string":
        return F.get_json_object("metadata", f"$.{key}")
    return F.lit(None).cast("string")


def predicate(df: DataFrame, filters: Mapping[str, Any] | None, any_prefix: bool = False) -> Column:
    """All conditions together: a value must be equal (None equals a missing one), a list must hold it, a prefix must begin it.

    With ``any_prefix`` one of several prefixes is enough.
    """
    conditions, prefixes = [], []
    for key, value in (filters or {}).items():
        if key in PREFIX_KEYS:
            values = value if isinstance(value, (list, tuple, set, frozenset)) else [value]
            prefixes.append(reduce(lambda a, b: a | b, [F.coalesce(F.startswith(F.col("source_path"), F.lit(str(v))), F.lit(False)) for v in values], F.lit(False)))
        elif isinstance(value, (list, tuple, set, frozenset)):
            known = [v for v in value if v is not None]
            test = F.coalesce(_field(df, key).isin(*known), F.lit(False)) if known else F.lit(False)
            conditions.append(test | _field(df, key).isNull() if None in value else test)
        else:
            conditions.append(_field(df, key).eqNullSafe(F.lit(value)))
    if prefixes:
        conditions.append(reduce((lambda a, b: a | b) if any_prefix else (lambda a, b: a & b), prefixes))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def apply(df: DataFrame, filters: Mapping[str, Any] | None, any_prefix: bool = False) -> DataFrame:
    """The rows that pass the filters."""
    return df.where(predicate(df, filters, any_prefix)) if filters else df
