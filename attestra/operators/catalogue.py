"""Small tables that every row of a large one is paired with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows that a table may have to be sent to every task.
MOST = 10_000


def held(small: DataFrame, most: int = MOST) -> tuple[DataFrame, list[Row] | None]:
    """``small`` read once, and its rows; the table itself, and None, if it has more than ``most``."""
    found = small.limit(most + 1).collect()
    if len(found) > most:
        return small, None
    return small.sparkSession.createDataFrame(found, small.schema), found


def paired(rows: DataFrame, small: DataFrame, most: int = MOST) -> DataFrame:
    """Every row of ``rows`` with every row of ``small``.

    ``small`` is a catalogue (a grid, a few requirements): it is counted as it
    is read, once, and broadcast if it has ``most`` rows or fewer; what is
    larger is left to Spark.
    """
    sent, found = held(small, most)
    return rows.crossJoin(sent if found is None else F.broadcast(sent))
