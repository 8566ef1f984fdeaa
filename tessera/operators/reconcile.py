"""Reconciliation: candidates become versioned entities and relationships, then publications.

The whole model is reconciled in one set-based pass: every object's candidates are merged by
key, compared with the current version by a content hash, and get a new version only on change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import object_hash, row_json, stable_json

#: Lifecycle states that a publication leaves out.
RETIRED = ("superseded", "rejected")
#: Partitions of described candidates for each of the session's shuffle partitions.
WIDE = 4


def merge_candidates(candidates: DataFrame, key: str) -> DataFrame:
    """One row for each key: least name, sorted union of evidence, greatest confidence."""
    return candidates.groupBy(key).agg(
        F.min("type").alias("type"),
        F.min("name").alias("name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
        F.max("confidence").alias("confidence"),
    )


def merge_provenance(candidates: DataFrame, key: str, provenance: str = "provenance") -> tuple[DataFrame, DataFrame]:
    """(described, conflicts): what describes each evidence of each key, one row for each, and evidence described in different ways.

    ``provenance`` is an array of structs with ``evidence_id``; descriptions are the same if their canonical JSON is.  Equal ones
    become one before the shuffle, so a key that many candidates share is not gathered.  A null list describes nothing.
    """
    rows = candidates.select(key, F.explode(provenance).alias("p"))
    told = rows.select(key, F.col("p.evidence_id").alias("evidence_id"), "p", F.sha2(stable_json(F.col("p"), rows.schema["p"].dataType), 256).alias("h"))
    found = told.groupBy(key, "evidence_id").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.any_value("p").alias(provenance))
    return found.where("low = high").select(key, "evidence_id", provenance), found.where("low <> high").select(key, "evidence_id")


def merge_described(candidates: DataFrame, key: str, provenance: str = "provenance") -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): ``merge_candidates`` with the union of provenance, ordered by evidence; keys with a conflict are left out.

    Keys without any provenance get an empty list.  The merged row of a key is made in one task in any case, so candidates are
    dealt by key once; the groups by key and evidence, the lists and the joins find them there and shuffle nothing again.
    Rows widen when they are sorted, so they are dealt to WIDE times the usual number of partitions.
    """
    candidates = candidates.repartition(WIDE * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    described, conflicts = merge_provenance(candidates, key, provenance)
    by_evidence = lambda x, y: F.when(x["evidence_id"] < y["evidence_id"], -1).when(x["evidence_id"] > y["evidence_id"], 1).otherwise(0)
    lists = described.groupBy(key).agg(F.array_sort(F.collect_list(provenance), by_evidence).alias(provenance))
    sound = merge_candidates(candidates, key).join(conflicts.select(key).distinct(), key, "left_anti").join(lists, key, "left")
    none = F.array().cast(f"array<{described.schema[provenance].dataType.simpleString()}>")
    return sound.withColumn(provenance, F.coalesce(provenance, none)), conflicts


def provenance_conflicts(provenance: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Keys whose evidence is described in more than one way."""
    return provenance.groupBy(*keys).agg(F.count_distinct(content).alias("variants")).where("variants > 1")


def content_hash(*columns: Column) -> Column:
    from ..functions import canonical_json

    return F.sha2(canonical_json(*columns), 256)


def reconcile(current: DataFrame, desired: DataFrame, key: str, initial_status: str = "candidate") -> DataFrame:
    """key, action, version_number, status, content for the union of both sides.

    ``current`` has (key, version_number, status, content), ``desired`` (key, content).  New keys
    are created at version 1; equal content keeps the version; other content adds one and keeps
    the status; a superseded object that is desired again is revived; one that is no longer
    desired is superseded once.
    """
    old = current.select(key, F.col("version_number").alias("v"), F.col("status").alias("s"), F.col("content").alias("c"))
    new = desired.select(key, F.col("content").alias("d"))
    gone = F.col("s") == "superseded"
    action = (
        F.when(F.col("c").isNull(), "create")
        .when(F.col("d").isNull() & gone, "keep")
        .when(F.col("d").isNull(), "supersede")
        .when(gone, "revive")
        .when(F.col("c").eqNullSafe(F.col("d")), "keep")
        .otherwise("update")
    )
    status = F.when(F.col("action").isin("create", "revive"), initial_status).when(F.col("action") == "supersede", "superseded").otherwise(F.col("s"))
    return (
        old.join(new, key, "full_outer")
        .withColumn("action", action)
        .select(
            key,
            "action",
            (F.coalesce("v", F.lit(0)) + (F.col("action") != "keep").cast("int")).alias("version_number"),
            status.alias("status"),
            F.coalesce("d", "c").alias("content"),
        )
    )


def append_versions(versions: DataFrame, reconciled: DataFrame, key: str) -> DataFrame:
    """The version history with the rows that changed appended."""
    changed = reconciled.where("action <> 'keep'").select(key, "version_number", "status", "content")
    return versions.unionByName(changed)


def next_version(versions: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """``objects`` with the version number that a change would get."""
    latest = versions.groupBy(key).agg(F.max("version_number").alias("latest"))
    return objects.join(latest, key, "left").withColumn("next_version", F.coalesce("latest", F.lit(0)) + 1).drop("latest")


def latest_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key with the greatest order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def publish_members(objects: DataFrame, key: str) -> DataFrame:
    """What a publication holds: current, neither superseded nor rejected."""
    return objects.where(~F.col("status").isin(*RETIRED)).select(key, "version_number")


#: Fixed value: the schema version inside a publication's hash.
CONTENT_VERSION = 2


def content_rows(entities: DataFrame | None, relationships: DataFrame | None, publication: str, entity_fields: dict[str, str], relationship_fields: dict[str, str]) -> DataFrame:
    """(publication, section, id, item): members of publications as canonical JSON objects; the field ``id`` orders them."""
    parts = []
    for section, rows, fields in (("entities", entities, entity_fields), ("relationships", relationships, relationship_fields)):
        if rows is not None:
            parts.append(rows.select(publication, F.lit(section).alias("section"), F.col(fields["id"]).cast("string").alias("id"), row_json(rows, **fields).alias("item")))
    return reduce(DataFrame.unionByName, parts)


def publication_hash(members: DataFrame, publication: str, schema_version: int = CONTENT_VERSION) -> DataFrame:
    """(publication, members, content_hash) of ``content_rows``: the SHA-256 of the canonical JSON of
    schema version, entities and relationships, both sorted by id.  Members stream through the digest."""
    found = object_hash(members, publication, "section", "id", "item", ["entities", "relationships"], {"schemaVersion": str(schema_version)})
    return found.select(publication, F.col("items").alias("members"), F.col("hash").alias("content_hash"))


def tree_hash(members: DataFrame, group: str, key: str, content: Column, digits: int = 3) -> DataFrame:
    """(group, members, content_hash) in two levels, for comparisons inside this library at any size: no task sees all members.

    Members fall into ranges by the first hex ``digits`` of their key's SHA-256.  A range's hash is
    that of its members' hashes in key order, a group's that of its ranges' hashes in order.
    """
    rows = members.select(group, F.col(key).alias("k"), F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(digits)).alias("range"), F.sha2(content, 256).alias("h"))
    joined = lambda at, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]), ""), 256)
    ranges = rows.groupBy(group, "range").agg(F.count("*").alias("n"), joined("k", "h").alias("r"))
    return ranges.groupBy(group).agg(F.sum("n").alias("members"), joined("range", "r").alias("content_hash"))


def publish(members: DataFrame, previous: DataFrame, model: str, key: str | None = None, content: Column | None = None) -> DataFrame:
    """The publications that a step adds: (model, version, members, content_hash).

    ``members`` are ``content_rows``, or, with ``key`` and ``content``, rows that count as relationships of that id and content.  A model is published only if its content hash differs from that of its latest publication in
    ``previous`` (model, version, content_hash); its version is the latest one plus one, or 1.
    """
    if key is not None:
        members = content_rows(None, members.select(model, key, content.alias("content")), model, {}, {"id": key, "content": "content"})
    last = previous.groupBy(model).agg(F.max_by(F.struct("version", "content_hash"), "version").alias("_last"))
    now = publication_hash(members, model).join(last, model, "left")
    changed = now.where(~F.col("content_hash").eqNullSafe(F.col("_last.content_hash")))
    return changed.select(model, (F.coalesce("_last.version", F.lit(0)) + 1).cast("int").alias("version"), "members", "content_hash")


def withdraw(contributions: DataFrame, documents: DataFrame) -> DataFrame:
    """Active contributions without those of withdrawn documents."""
    return contributions.join(documents.select("document_id"), "document_id", "left_anti")


def activate(active: DataFrame, contributions: DataFrame, keys: list[str]) -> DataFrame:
    """One active contribution for each (model, document): new ones replace old ones."""
    newest = contributions.groupBy(*keys).agg(F.max("version").alias("version"))
    return active.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def current_gate(contributions: DataFrame, documents: DataFrame) -> DataFrame:
    """Contributions whose document is present with that fingerprint and points at that version."""
    now = documents.where("is_present").select("document_id", F.col("fingerprint").alias("_f"), F.col("current_version").alias("_v"))
    same = (F.col("fingerprint") == F.col("_f")) & (F.col("version") == F.col("_v"))
    return contributions.join(now, "document_id").where(same).drop("_f", "_v")
