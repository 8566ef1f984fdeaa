"""Reads over frozen publications: membership, integrity, traversal, provenance, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_DEFAULT, LIMIT_MOST = 50, 100


def page(df: DataFrame, key: str, after=None, limit: int = LIMIT_DEFAULT, filters: list[Column] | None = None) -> DataFrame:
    """A page by key: the next ``limit`` rows after ``after`` and one more that tells of a next page."""
    if not 1 <= limit <= LIMIT_MOST:
        raise ValueError(f"limit must be within 1 and {LIMIT_MOST}")
    conditions = [*(filters or []), *([F.col(key) > F.lit(after)] if after is not None else [])]
    return reduce(lambda d, c: d.where(c), conditions, df).orderBy(key).limit(limit + 1)


def members(publications: DataFrame, versions: DataFrame, list_col: str, version_key: str) -> DataFrame:
    """Publications joined with the versions that their list names: exploded, then an equi-join."""
    return publications.select("publication_id", F.explode(list_col).alias(version_key)).join(versions, version_key)


def latest(publications: DataFrame, model: str = "model_id", version: str = "version") -> DataFrame:
    return publications.groupBy(model).agg(F.max_by("publication_id", version).alias("publication_id"), F.max(version).alias(version))


def integrity_violations(entities: DataFrame, relationships: DataFrame, evidence: DataFrame | None = None, provenance: DataFrame | None = None, stored: DataFrame | None = None, hashes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(publication_id, object_id, problem) of unsound publications; sound ones give no rows.

    Members listed twice, edges whose ends are not published and self edges are told of ``entities`` and ``relationships``.
    With ``evidence`` (publication_id, object_id, evidence_id: what objects list) and ``provenance`` (the same and ``lineage``: what
    describes it): evidence listed twice, described but not listed, listed but not described.  With ``stored`` (evidence_id,
    lineage): provenance whose evidence is not stored or is stored with another lineage (object_id is the evidence).  With
    ``hashes``, two tables of (publication_id, content_hash), declared and computed: publications whose hashes differ or of which one lacks.

    Every statement is a tagged row; one aggregation, which combines before its shuffle, tells all faults.  Only keys found faulty meet
    the edges again.
    """
    fact = lambda section, key, **counts: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), *[F.lit(counts.get(c, 0)).alias(c) for c in ("said", "cited")], counts.get("text", F.lit(None)).cast("string").alias("text"))
    rows = [entities.select("publication_id", fact("entity", F.col("entity_id"), said=1).alias("f"))]
    edge = F.array(fact("relationship", F.col("relationship_id"), said=1), fact("entity", F.col("source_id"), cited=1), fact("entity", F.col("target_id"), cited=1))
    rows.append(relationships.select("publication_id", F.explode(edge).alias("f")))
    kind = rows[0].schema["publication_id"].dataType
    pair = F.to_json(F.array(F.col("object_id").cast("string"), F.col("evidence_id").cast("string")))
    if evidence is not None:
        rows.append(evidence.select("publication_id", fact("evidence", pair, said=1).alias("f")))
    if provenance is not None:
        described = fact("evidence", pair, cited=1)
        told = F.array(described, fact("lineage", F.col("evidence_id"), cited=1, text=F.col("lineage"))) if stored is not None else F.array(described)
        rows.append(provenance.select("publication_id", F.explode(told).alias("f")))
    if stored is not None:
        rows.append(stored.select(F.lit(None).cast(kind).alias("publication_id"), fact("lineage", F.col("evidence_id"), said=1, text=F.col("lineage")).alias("f")))
    if hashes is not None:
        for table, tag in zip(hashes, ("said", "cited"), strict=True):
            rows.append(table.select("publication_id", fact("hash", F.lit(""), text=F.col("content_hash"), **{tag: 1}).alias("f")))
    # A lineage is the same for all publications, so its rows meet without one.
    whose = F.when(F.col("f.section") != "lineage", F.col("publication_id"))
    facts = reduce(DataFrame.unionByName, rows).select(whose.alias("publication_id"), "f.*")
    found = facts.groupBy("publication_id", "section", "key").agg(F.sum("said").alias("said"), F.sum("cited").alias("cited"), F.min("text").alias("low"), F.max("text").alias("high"), F.count("text").alias("texts"))
    section, said, cited = F.col("section"), F.col("said"), F.col("cited")
    differs = (F.col("low") != F.col("high")) | (F.col("texts") < said + cited)
    problem = (
        F.when(section.isin("entity", "relationship") & (said > 1), F.concat(F.lit("duplicate-"), section))
        .when((section == "entity") & (said == 0), "missing")
        .when(section == "evidence", F.when(cited == 0, "evidence-not-described").when(said == 0, "evidence-not-listed").when(said > 1, "evidence-listed-twice"))
        .when((section == "lineage") & (cited > 0), F.when(said == 0, "lineage-not-stored").when(differs, "lineage-different"))
        .when(section == "hash", F.when((said == 0) | (cited == 0), "hash-missing").when(differs, "hash-different"))
    )
    faults = found.withColumn("problem", problem).where("problem IS NOT NULL").select("publication_id", "key", "problem")
    object_id = F.when(F.startswith("problem", F.lit("evidence")), F.concat_ws("#", F.from_json("key", "array<string>"))).when(F.startswith("problem", F.lit("hash")), F.col("publication_id").cast("string")).otherwise(F.col("key"))
    out = faults.where("problem <> 'missing'").select("publication_id", object_id.alias("object_id"), "problem")
    lost = faults.where("problem = 'missing'").select("publication_id", F.col("key").alias("end"))
    sides = F.explode(F.array(*[F.struct(F.col(f"{s}_id").cast("string").alias("end"), F.lit(f"missing-{s}").alias("problem")) for s in ("source", "target")]))
    dangling = relationships.select("publication_id", F.col("relationship_id").cast("string").alias("object_id"), sides.alias("s")).select("publication_id", "object_id", "s.*").join(lost, ["publication_id", "end"], "left_semi")
    own = relationships.where("source_id = target_id").select("publication_id", F.col("relationship_id").cast("string").alias("object_id"), F.lit("self-edge").alias("problem"))
    return out.unionByName(dangling.select("publication_id", "object_id", "problem")).unionByName(own)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def one_hop(relationships: DataFrame, entity_id: str, direction: str = "both", types: list[str] | None = None, after: str | None = None, limit: int = LIMIT_DEFAULT) -> DataFrame:
    """Relationships of an entity with their direction; of both ends, incoming wins.

    Use ``neighbourhood`` to ask for many entities at once.
    """
    incoming, outgoing = F.col("target_id") == entity_id, F.col("source_id") == entity_id
    wanted = {"incoming": incoming, "outgoing": outgoing, "both": incoming | outgoing}[direction]
    found = relationships.where(wanted)
    if types:
        found = found.where(F.col("type").isin(*types))
    return page(found.withColumn("direction", F.when(incoming, "incoming").otherwise("outgoing")), "relationship_id", after, limit)


def neighbourhood(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Both directions for every given entity: (entity_id, relationship_id, type, direction, other_id)."""
    sides = F.array(
        F.struct(F.col("target_id").alias("entity_id"), F.lit("incoming").alias("direction"), F.col("source_id").alias("other_id")),
        F.struct(F.col("source_id").alias("entity_id"), F.lit("outgoing").alias("direction"), F.col("target_id").alias("other_id")),
    )
    both = relationships.select("relationship_id", "type", F.explode(sides).alias("s")).select("s.entity_id", "relationship_id", "type", "s.direction", "s.other_id")
    return both.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def with_endpoint_names(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    side = lambda end: entities.select(F.col("entity_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"), F.col("type").alias(f"{end}_type"))
    return relationships.join(side("source"), "source_id").join(side("target"), "target_id")


def provenance(objects: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """One row for each (object, evidence) with the evidence's excerpt and whether it exists."""
    exploded = objects.select(key, F.explode("evidence_ids").alias("evidence_id"))
    return exploded.join(evidence.withColumn("_there", F.lit(True)), "evidence_id", "left").withColumn("resolved", F.coalesce("_there", F.lit(False))).drop("_there")


def export_rows(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """A publication's package as canonical JSON lines: (publication_id, section, key, line)."""
    from ..functions import canonical_json

    one = entities.select("publication_id", F.lit("entity").alias("section"), F.col("entity_id").alias("key"), canonical_json(F.col("entity_id").alias("id"), "name", "type").alias("line"))
    two = relationships.select(
        "publication_id", F.lit("relationship").alias("section"), F.col("relationship_id").alias("key"), canonical_json(F.col("relationship_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type").alias("line")
    )
    return one.unionByName(two)


def write_package(entities: DataFrame, relationships: DataFrame, path: str) -> None:
    """The package as text, one folder for each publication and section, lines sorted by key."""
    rows = export_rows(entities, relationships)
    rows.repartitionByRange("publication_id", "section", "key").sortWithinPartitions("publication_id", "section", "key").select("publication_id", "section", F.col("line").alias("value")).write.partitionBy("publication_id", "section").text(path)


def compact(publications: DataFrame) -> DataFrame:
    """Publications with the lengths of their member lists in place of the lists."""
    return publications.select("publication_id", "version", F.size("entity_version_ids").cast("long").alias("entity_count"), F.size("relationship_version_ids").cast("long").alias("relationship_count"))


def compact_members(entities: DataFrame, relationships: DataFrame, version: Column) -> DataFrame:
    """The same from member rows: distinct entities and all relationships of each publication are counted, never listed."""
    counted = entities.distinct().groupBy("publication_id").agg(F.count("*").alias("entity_count"))
    edges = relationships.groupBy("publication_id").agg(F.count("*").alias("relationship_count"))
    return edges.join(counted, "publication_id", "left").select("publication_id", version.alias("version"), F.coalesce("entity_count", F.lit(0)).cast("long").alias("entity_count"), "relationship_count")
