"""Extension: blocking of newly arriving records against a fixed pool, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import normalize_records
from ..operators import blocking
from ..plans.candidates import BlockingConfig
from ..sources.tables import slim


def block_stream(records: DataFrame, pool: DataFrame, path: str, checkpoint: str, config: BlockingConfig = BlockingConfig()) -> StreamingQuery:
    """Write ranked candidates of a stream of raw records as Parquet, one folder for each batch.

    A batch that is repeated after a failure overwrites its own folder. The pool is a normalised, static frame.
    """

    def batch(df: DataFrame, number: int) -> None:
        votes = blocking.count_votes(blocking.block(slim(normalize_records(df)), slim(pool), config.keys, config.candidate_cap, config.truncation))
        blocking.rank_votes(votes, config.candidate_cap).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
