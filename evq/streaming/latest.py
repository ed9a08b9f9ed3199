"""Latest row of each key over a stream: the batch operator's partial aggregation, kept as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from evq.operators.relational import latest_one


def latest_stream(stream: DataFrame, key: str, order: str, keep: Sequence[str]) -> DataFrame:
    """For output mode update or complete; the state is one row a key."""
    return latest_one(stream, key, [order], list(keep))
