"""The outbox and the search projection as streams whose replays change nothing.

A micro-batch has a number that a restarted query repeats.  What a batch writes lies in a partition of
its own, so a batch that was written but not yet committed is recognised and left as it is, times included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.presentation import missing_projections, projection_events


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of ``schema`` where nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write ``rows``; partitions that they touch are replaced as a whole, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def publish_outbox(outbox: DataFrame, path: str, checkpoint: str, now: Callable[[], Column] = F.current_timestamp, trigger: dict | None = None, after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """Publish a stream of events (event_id, occurred_at, ...) to the table ``path``, each event once.

    The table has the events with ``published_at`` and, as partition, ``batch_id``.  Publishing and marking are one write:
    an event counts as published if the table holds it (``unpublished``).  Within a batch repeated ids are one event, the
    earliest; ids that an earlier batch published are left out.  ``after_write`` is called when a batch is written, for tests.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in outbox.schema)}, published_at timestamp, batch_id long"

    def write(batch: DataFrame, number: int) -> None:
        done = read_or_empty(batch.sparkSession, path, schema)
        if done.where(F.col("batch_id") == number).isEmpty():
            first = batch.groupBy("event_id").agg(F.min_by(F.struct(*batch.columns), F.struct("occurred_at", F.xxhash64(*batch.columns))).alias("e")).select("e.*")
            fresh = first.join(done.select("event_id"), "event_id", "left_anti").select(*batch.columns)
            _replace_partitions(fresh.withColumns({"published_at": now(), "batch_id": F.lit(number).cast("long")}), path, "batch_id")
        if after_write:
            after_write(number)

    return outbox.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def unpublished(outbox: DataFrame, published: DataFrame, limit: int = 1000) -> DataFrame:
    """The oldest events that ``published`` does not hold, by time, then id; a page of 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be within 1 and 1000")
    return outbox.join(published.select("event_id"), "event_id", "left_anti").orderBy("occurred_at", "event_id").limit(limit)


def build_projections(publications: DataFrame, members: DataFrame, project: Callable[[DataFrame], DataFrame], path: str, now: Callable[[], Column] = F.current_timestamp) -> None:
    """Build the projections of ``publications`` (publication_id) that ``path`` lacks.

    ``project`` makes rows with publication_id from the ``members`` of the missing ones.  Each publication is a
    partition, replaced as a whole; one that is there keeps its rows and its ``built_at``.
    """
    spark = publications.sparkSession
    wanted = publications.select("publication_id").distinct()
    rows = members.join(wanted, "publication_id", "left_semi")
    kind = members.schema["publication_id"].dataType.simpleString()
    built = read_or_empty(spark, path, f"publication_id {kind}")
    (missing,) = missing_projections(built, rows)
    _replace_partitions(project(missing).withColumn("built_at", now()), path, "publication_id")


def project_on_publish(published: DataFrame, members: DataFrame, project: Callable[[DataFrame], DataFrame], path: str, events: str, checkpoint: str, now: Callable[[], Column] = F.current_timestamp, trigger: dict | None = None, after_write: Callable[[int], None] | None = None) -> StreamingQuery:
    """Build a projection for every published publication of a stream, and tell of it.

    The chain of a batch (requested, then built if the projection is there) is written to the table ``events``,
    partitioned by ``batch_id``; a replayed batch writes the same chain in the same place.
    """

    def write(batch: DataFrame, number: int) -> None:
        build_projections(batch, members, project, path, now)
        kind = members.schema["publication_id"].dataType.simpleString()
        there = read_or_empty(batch.sparkSession, path, f"publication_id {kind}")
        chain = projection_events(batch.select("publication_id").distinct(), there)
        _replace_partitions(chain.withColumn("batch_id", F.lit(number).cast("long")), events, "batch_id")
        if after_write:
            after_write(number)

    return published.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
