"""Paged fetch of a ranking by key (sales, label), without offsets.

A page holds the rows after a cursor in the ranking's own order. The cursor is the last row's
key, so a page costs one filter and one top-k (``TakeOrderedAndProject``) however deep it lies, and rows added
between two fetches neither repeat nor skip a row that both fetches see. The labels must make the order total: equal
sales are told apart by them. A null label comes first among equal sales, as Spark orders it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.operators.rank import Mode
from salescope.star_schema import SALES

Cursor = tuple[Any, ...]


def _after(df: DataFrame, cursor: Cursor, mode: Mode, labels: Sequence[str]) -> Column:
    sales, *names = cursor
    if len(names) != len(labels):
        raise ValueError(f"a cursor of sales and {list(labels)} is needed, not {cursor!r}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    beyond = F.col(SALES) > F.lit(sales) if mode == "flop" else F.col(SALES) < F.lit(sales)
    # structs compare field by field, a null being the smallest
    place = F.struct(*labels)
    seen = F.struct(*[F.lit(n).cast(kinds[c]).alias(c) for n, c in zip(names, labels)])
    return beyond | ((F.col(SALES) == F.lit(sales)) & (place > seen))


def page(counted: DataFrame, size: int, labels: Sequence[str], mode: Mode = "all", after: Cursor | None = None) -> DataFrame:
    """The next ``size`` rows of ``counted`` (labels and sales, in any order) after the cursor, in order."""
    if size < 1:
        raise ValueError("a page has one row at least")
    rows = counted if after is None else counted.filter(_after(counted, after, mode, labels))
    sales = F.col(SALES).asc() if mode == "flop" else F.col(SALES).desc()
    return rows.orderBy(sales, *[F.col(c).asc() for c in labels]).limit(size)


def cursor_of(fetched: DataFrame, labels: Sequence[str], mode: Mode = "all") -> Cursor | None:
    """The cursor after a fetched page (one row comes to the driver); None after an empty page, which ends the ranking."""
    # the page's last row is the first of the reverse order
    sales = F.col(SALES).desc() if mode == "flop" else F.col(SALES).asc()
    last = fetched.orderBy(sales, *[F.col(c).desc() for c in labels]).select(SALES, *labels).first()
    return None if last is None else tuple(last)
