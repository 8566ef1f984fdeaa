"""Rollups over published knowledge and the state of running components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import health


def breakdown(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Counts over a fixed vocabulary, 0 where nothing is counted."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    return words.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def contributions(provenance: DataFrame, group: str = "extractor_id") -> DataFrame:
    """Distinct objects, evidence and the sorted processors of each extractor.

    One pass: each row gives its object, evidence and processor as (kind, value); they are made
    distinct first, which combines before the shuffle, then counted.
    """
    facts = F.array(
        F.struct(F.col("object_type").alias("kind"), F.col("object_id").cast("string").alias("value")),
        F.struct(F.lit("=evidence").alias("kind"), F.col("evidence_id").cast("string").alias("value")),
        F.struct(F.lit("=processor").alias("kind"), F.col("processor_id").cast("string").alias("value")),
    )
    distinct = provenance.select(group, F.explode(facts).alias("f")).select(group, "f.kind", "f.value").where("value IS NOT NULL").distinct()
    count = lambda kind: F.count_if(F.coalesce(F.col("kind") == kind, F.lit(False)))
    return distinct.groupBy(group).agg(
        count("entity").alias("entities"),
        count("relationship").alias("relationships"),
        count("=evidence").alias("evidence"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "=processor", F.col("value")))), ",").alias("processors"),
    )


def distinct_support(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.select(*keys, F.explode("evidence_ids").alias("evidence_id")).distinct()


def diagnostic_counts(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """For each document: a JSON object of counts by reason, reasons sorted."""
    counted = diagnostics.groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n"))))).alias("by_reason"))


def heartbeat_status(newest: DataFrame, now: str, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """The health of each instance by the age of its newest heartbeat ``ts`` at the time ``now``
    (both columns); expected instances that never reported are offline."""
    if expected is not None:
        newest = expected.select(*keys).join(newest, keys, "left")
    age = (F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1e6)
    return newest.select(*keys, F.floor(age).cast("long").alias("age_seconds"), F.coalesce(health(age), F.lit("offline")).alias("state"))


def decisions(decision_rows: DataFrame, relationships: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Decisions with the entities that refer to them; with ``words``, those that hold them all."""
    referring = relationships.where("type = 'REFERENCES'").groupBy(F.col("target_id").alias("entity_id")).agg(F.array_sort(F.collect_set("source_id")).alias("referenced_by"))
    found = decision_rows.join(referring, "entity_id", "left").withColumn("referenced_by", F.coalesce("referenced_by", F.array().cast("array<string>")))
    for word in words or []:
        found = found.where(F.contains(F.lower("name"), F.lit(word.lower())))
    return found
