"""Keeping a merged graph up to date while references stream in.

The merge is monotone (AND of ``external``, union of kinds), so a micro-batch only
has to be merged with the rows of the pairs it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom.plans.edges import kind_mask, kinds_of, merge_edges


def merged(old: DataFrame, refs: DataFrame) -> DataFrame:
    """The graph of ``old`` (source, target, external, kinds) and new references."""
    rows = old.unionByName(merge_edges(refs).select(old.columns))
    out = rows.groupBy("source", "target").agg(F.bool_and("external").alias("external"), F.bit_or(kind_mask("kinds")).alias("kinds"))
    return out.withColumn("kinds", kinds_of(F.col("kinds")))


def keep_merged(refs: DataFrame, read: Callable[[], DataFrame], replace: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of a stream of references; ``read`` and ``replace`` hold the table (by batch id)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        replace(merged(read(), batch), batch_id)

    return refs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
