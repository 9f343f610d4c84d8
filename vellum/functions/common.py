from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    """A column, or the column of a name."""
    return F.col(c) if isinstance(c, str) else c
