"""Event streams.  ``dedupe``, ``with_subject``, ``dispatch``, ``split_invalid`` and ``newest`` work on batches and streams;
``assemblies``, ``expire``, ``supersede`` and ``pending`` on batches, ``publish`` and ``committed_scans`` on streams.

Events are rows of (event_id, event_type, occurred_at, idempotency_key, payload).  Delivery is
at least once, so results depend on sets and maxima, never on arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subjects that no rule gives.
SUBJECTS = {
    "SourceInventoryStarted": "workspace.discovery.source.inventory.started.v1",
    "SourceInventoryChunk": "workspace.discovery.source.inventory.chunk.v1",
    "SourceInventoryCompleted": "workspace.discovery.source.inventory.completed.v1",
    "SearchProjectionRequested": "workspace.search.projection.requested",
    "SearchProjectionBuilt": "workspace.search.projection.built",
    "DocumentProcessingSubmitted": "workspace.processing.document.submitted",
    "DocumentExtracted": "workspace.processing.document.extracted",
}
#: Types that are published under ``workspace.knowledge``.
KNOWLEDGE = (
    "KnowledgeCandidatesSubmitted", "KnowledgeEntityDiscovered", "KnowledgeEntitySuperseded",
    "KnowledgeRelationshipDiscovered", "KnowledgeRelationshipSuperseded", "KnowledgeModelPublished",
)
ERROR_CHARS = 512


def dedupe(events: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """One event for each key; on a stream, among events whose times are within ``delay``."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def with_subject(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """``events`` with ``subject``: a fixed one, else the type's words in lower case, joined by dots."""
    table = F.create_map(*[F.lit(x) for pair in SUBJECTS.items() for x in pair])
    known = F.col(kind).isin(*KNOWLEDGE)
    words = F.when(known, F.regexp_replace(kind, "^Knowledge", "")).otherwise(F.col(kind))
    dotted = F.regexp_replace(F.lower(F.regexp_replace(words, "([A-Z])", ".$1")), r"^\.", "")
    folder = F.when(known, "workspace.knowledge.").otherwise("workspace.discovery.")
    return events.withColumn("subject", F.coalesce(table[F.col(kind)], F.concat(folder, dotted)))


def dispatch(events: DataFrame, kind: str, schemas: dict[str, str], payload: str = "payload") -> dict[str, DataFrame]:
    """Events of each type with their payload parsed."""
    return {name: events.where(F.col(kind) == name).withColumn("body", F.from_json(payload, schema)) for name, schema in schemas.items()}


def split_invalid(events: DataFrame, problem: Column, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters): ``problem`` is null for valid events, else says what is wrong."""
    told = events.withColumn("_problem", problem)
    dead = told.where("_problem IS NOT NULL").select(
        *events.columns, F.left("_problem", F.lit(ERROR_CHARS)).alias("error"), F.sha2(F.coalesce(payload, F.lit("")), 256).alias("payload_sha256"), F.octet_length(F.coalesce(payload, F.lit(""))).alias("payload_bytes")
    )
    return told.where("_problem IS NULL").drop("_problem"), dead


def assemblies(chunks: DataFrame, announced: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each staged transfer, whatever order its parts came in.

    ``chunks`` has (keys.., chunk_index, checksum), ``announced`` (keys.., expected_chunks,
    checksum).  Equal repeats are idempotent; one index with two checksums is a conflict.  A transfer's digest is made in one
    task in any case, so its chunks are dealt by transfer once and are grouped by index there.
    """
    torn = F.coalesce(F.min("checksum") < F.max("checksum"), F.lit(False))
    one = chunks.repartition(*keys).groupBy(*keys, "chunk_index").agg(F.min("checksum").alias("c"), torn.alias("torn"))
    got = one.groupBy(*keys).agg(
        F.count("*").alias("received"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.bool_or("torn").alias("torn"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "c"))), lambda x: x["c"]), ""), 256).alias("found"),
    )
    joined = announced.join(got, keys, "full_outer")
    full = (F.col("received") == F.col("expected_chunks")) & (F.col("low") == 0) & (F.col("high") == F.col("expected_chunks") - 1)
    state = F.when(F.col("torn"), "conflict").when(F.col("expected_chunks").isNull() | ~F.coalesce(full, F.lit(False)), "assembling").when(F.col("found") == F.col("checksum"), "complete").otherwise("corrupt")
    return joined.select(*keys, F.coalesce("received", F.lit(0)).cast("long").alias("received"), "expected_chunks", state.alias("state"))


def expire(states: DataFrame, now: Column, updated: str = "updated_at", hours: int = 24) -> DataFrame:
    """Incomplete assemblies that no event touched for ``hours``."""
    return states.where(F.col("state") == "assembling").where(F.col(updated) < now - F.expr(f"INTERVAL {hours} HOURS"))


def supersede(scans: DataFrame, source: str, order: list[str]) -> DataFrame:
    """``scans`` with ``superseded``: a scan older than one that completed before it has no effect.

    ``order`` names the columns that order scans; ``completed_at`` orders their completion.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(source).orderBy("completed_at", *order).rowsBetween(Window.unboundedPreceding, -1)
    mine = F.struct(*order)
    return scans.withColumn("superseded", F.coalesce(mine < F.max(mine).over(before), F.lit(False)))


def pending(outbox: DataFrame, limit: int) -> DataFrame:
    """The oldest unpublished events, by time, then id."""
    return outbox.where("published_at IS NULL").orderBy("occurred_at", "event_id").limit(limit)


def publish(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream to an outbox folder, once for each micro-batch: a replayed batch overwrites
    its own folder, so readers never see it twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(heartbeats: DataFrame, keys: list[str], time: str, *kept: str) -> DataFrame:
    """The last heartbeat of each instance; older and equal times change nothing (update mode on streams)."""
    return heartbeats.groupBy(*keys).agg(F.max(time).alias("last_seen"), *[F.max_by(k, time).alias(k) for k in kept])


def committed_scans(scans: DataFrame, source: str, time: str, ident: str) -> DataFrame:
    """A stream of scans with ``superseded``, by state: the greatest (time, id) committed so far.

    Within a micro-batch scans are taken in the order of their completion time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else ("", "")
        rows = pd.concat(list(batches)).sort_values("completed_at", kind="stable")
        out = []
        for when, what in zip(rows[time].astype(str), rows[ident].astype(str), strict=True):
            out.append((str(key[0]), what, (when, what) < tuple(best)))
            best = max(tuple(best), (when, what))
        state.update(tuple(best))
        yield pd.DataFrame(out, columns=[source, ident, "superseded"])

    return scans.groupBy(source).applyInPandasWithState(step, f"{source} string, {ident} string, superseded boolean", "best_time string, best_id string", "append", GroupStateTimeout.NoTimeout)
