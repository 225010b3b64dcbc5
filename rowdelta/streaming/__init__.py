"""Comparing what a stream delivers with a baseline, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowdelta.model import DiffOptions, DiffResult
from rowdelta.plans import diff


def diff_stream(stream: DataFrame, baseline: DataFrame, options: DiffOptions, on_result: Callable[[DiffResult, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is the target of a diff against the rows of ``baseline`` with its keys.

    Rows of the baseline that a batch does not mention are not reported as deleted."""
    keys = list(options.keys)
    if not keys:
        raise ValueError("a stream needs key columns")

    def one(batch: DataFrame, number: int) -> None:
        same = [F.col(f"s.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        mentioned = baseline.alias("s").join(batch.select(*keys).distinct().alias("b"), on, "left_semi")
        on_result(diff(mentioned, batch, options), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
