"""Tables cut off in the shared folder, and names that cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import checkpointed, scratch, shared_dir, staged

__all__ = ["checkpointed", "fresh", "numbered", "scratch", "staged", "shared_dir", "text_or_empty"]


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one made longer, that no column of ``df`` has in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, label: str = "numbered") -> tuple[DataFrame, str]:
    """The rows, each with a number of its own, and that column's name; written once, so that numbers stay."""
    row = fresh(df, "row")
    return staged(df.withColumn(row, F.monotonically_increasing_id()), label), row
