"""Predicates that the operators share; Catalyst pushes them to the scan."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import DEFAULT_EXCLUDE


#: The column and the comparison that each argument stands for.
CLAUSES = {"chat_id": ("chat_id", "eq"), "date_from": ("local_date", "ge"), "date_to": ("local_date", "le"), "sender": ("sender_name", "eq"), "kind": ("kind", "eq")}


def given(**values: str | None) -> Column:
    """All clauses that have a value; empty strings are none."""
    parts = (getattr(operator, by)(F.col(column), values[name]) for name, (column, by) in CLAUSES.items() if values.get(name))
    return reduce(operator.and_, parts, F.lit(True))


def condition(types: tuple[str, ...] | None = None, exclude: tuple[str, ...] = DEFAULT_EXCLUDE, chat_id: str | None = None, date_from: str | None = None, date_to: str | None = None, sender: str | None = None) -> Column:
    """The given clauses and the message types; `types` wins over `exclude`."""
    wanted = F.col("msg_type").isin(*types) if types is not None else ~F.col("msg_type").isin(*exclude) if exclude else F.lit(True)
    return given(chat_id=chat_id, date_from=date_from, date_to=date_to, sender=sender) & wanted


def select_messages(messages: DataFrame, **options) -> DataFrame:
    return messages.where(condition(**options))


def vectors(df: DataFrame, kind: str | None = None, chat_id: str | None = None, sender: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Metadata filter of a vector collection."""
    return df.where(given(kind=kind, chat_id=chat_id, sender=sender, date_from=date_from, date_to=date_to))
