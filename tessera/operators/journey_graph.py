"""Journeys in the graph: what they contain, where they come from, what they call; and their published size.

Journeys are rows: ``journeys`` (journey_key, name, source_id, scope), ``evidence`` (journey_key, evidence_id, source_id, path),
``references`` (journey_key, entity_key, role), ``steps`` (journey_key, position, step_id, step_type, entity_key) and
``step_evidence`` (journey_key, position, evidence_id).  Later rounds refer to keys that earlier ones made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entity_key, filename
from ..functions.shared import settle
from .graph import wide

#: Bounds of a published journey (fixed values): characters of its model, bytes of the whole candidate.
MAX_CHARS, MAX_BYTES = 850_000, 800_000
HTTP_STEP = "HttpClientCallStep"


def document_key(source: Column, path: Column) -> Column:
    return entity_key(F.lit("document"), source, path, filename(path))


def link_journeys(
    journeys: DataFrame, evidence: DataFrame, references: DataFrame, steps: DataFrame, step_evidence: DataFrame, relationships: DataFrame, entities: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, step_references, violations) that journeys add to the graph.

    ``relationships`` (type, source_key, target_key, relation, evidence_id) and ``entities`` (key, type, ...) are the
    candidates of ``graph.publish_analysis``.  A journey is derived from the documents of its evidence, contains
    its steps and uses its references; a step is derived from its evidence's documents and refers to its
    subject, which must be among the journey's references (else a violation).  An HTTP step consumes
    the APIs that a published HTTP edge with the same evidence consumes, and so does its journey, which also refers to those APIs' providers.
    ``step_references`` is (journey_key, position, entity_key, role, is_subject): a step without a
    subject that consumes exactly one API gets it as its subject.
    """
    edge = lambda rows, kind, source, target, relation: rows.select(F.lit(kind).alias("type"), F.col(source).alias("source_key"), F.col(target).alias("target_key"), F.lit(relation).alias("relation"), "evidence_id")
    # First round: documents and steps.
    sources = evidence.withColumn("document_key", document_key(F.col("source_id"), F.col("path")))
    made = [sources.select(F.col("document_key").alias("key"), F.lit("document").alias("type"), filename(F.col("path")).alias("name"), "source_id", F.lit("source-document").alias("role"), "evidence_id")]
    told = steps.join(wide(journeys.select("journey_key", "name", "source_id", "scope")), "journey_key")
    name = F.concat(F.col("name"), F.lit(" ["), F.col("position").cast("string"), F.lit("] "), F.col("step_type"))
    scope = F.concat(F.col("scope"), F.lit("/step/"), (F.col("position") - 1).cast("string"))
    told = told.withColumns({"step_name": name, "step_key": entity_key(F.lit("operation"), F.col("source_id"), scope, name)})
    cited = told.join(wide(step_evidence), ["journey_key", "position"])
    made.append(cited.select(F.col("step_key").alias("key"), F.lit("operation").alias("type"), F.col("step_name").alias("name"), "source_id", F.lit("journey-step").alias("role"), "evidence_id"))
    edges = [edge(sources, "DERIVED_FROM", "journey_key", "document_key", "JOURNEY_SOURCE_EVIDENCE"), edge(cited, "CONTAINS", "journey_key", "step_key", "JOURNEY_CONTAINS_STEP")]
    placed = cited.join(wide(sources.select("journey_key", "evidence_id", "document_key")), ["journey_key", "evidence_id"], "left")
    edges.append(edge(placed.where("document_key IS NOT NULL"), "DERIVED_FROM", "step_key", "document_key", "STEP_SOURCE_EVIDENCE"))

    # Second round: subjects among the journey's references, its documents included.
    allowed = references.select("journey_key", "entity_key").union(sources.select("journey_key", "document_key")).distinct().withColumn("known", F.lit(True))
    subjects = cited.where("entity_key IS NOT NULL").join(wide(allowed), ["journey_key", "entity_key"], "left")
    edges.append(edge(subjects.where("known"), "REFERENCES", "step_key", "entity_key", "STEP_REFERENCES"))

    # Third round: published HTTP edges with a step's evidence, and the providers behind their APIs.
    apis = entities.where("type = 'api'").select(F.col("key").alias("api_key")).distinct()
    http = relationships.where("type = 'CONSUMES' AND relation = 'HTTP'").select(F.col("source_key").alias("caller"), F.col("target_key").alias("api_key"), "evidence_id").join(wide(apis), "api_key", "left_semi")
    http = settle(http.distinct())
    hit = cited.where(F.col("step_type") == HTTP_STEP).join(wide(http), "evidence_id").select("journey_key", "position", "step_key", "caller", "api_key").distinct()
    hit = settle(hit)
    consumed = hit.join(wide(http), ["caller", "api_key"])
    edges += [edge(consumed, "CONSUMES", "journey_key", "api_key", "JOURNEY_CALLS_API"), edge(consumed, "CONSUMES", "step_key", "api_key", "STEP_CALLS_API")]
    binding = relationships.where("type = 'REFERENCES' AND relation = 'CONFIGURED_SERVICE_TARGET'").select(F.col("source_key").alias("api_key"), F.col("target_key").alias("provider_key"), "evidence_id")
    provided = hit.select("journey_key", "position", "api_key").join(wide(binding), "api_key")
    edges.append(edge(provided, "REFERENCES", "journey_key", "provider_key", "JOURNEY_REFERENCES_PROVIDER"))

    # The journey's own references cite all its evidence.
    relation = F.when(F.col("role") == "service", "JOURNEY_PARTICIPATES_IN_SERVICE").otherwise("JOURNEY_REFERENCES")
    used = references.select("journey_key", "entity_key", relation.alias("relation")).distinct().join(wide(evidence.select("journey_key", "evidence_id").distinct()), "journey_key")
    used = used.select(F.lit("USES").alias("type"), F.col("journey_key").alias("source_key"), F.col("entity_key").alias("target_key"), "relation", "evidence_id")

    only = hit.groupBy("journey_key", "position").agg(F.count_distinct("api_key").alias("apis"), F.min("api_key").alias("only_api"))
    with_subject = told.join(wide(only), ["journey_key", "position"], "left").select("journey_key", "position", F.coalesce("entity_key", F.when(F.col("apis") == 1, F.col("only_api"))).alias("subject"))
    role = lambda rows, key, label: rows.select("journey_key", "position", F.col(key).alias("entity_key"), F.lit(label).alias("role"))
    listed = [role(told, "step_key", "step"), role(placed.where("document_key IS NOT NULL"), "document_key", "document"), role(hit, "api_key", "api"), role(provided, "provider_key", "api")]
    own = subjects.where("known").join(wide(references.select("journey_key", "entity_key", "role").distinct()), ["journey_key", "entity_key"]).select("journey_key", "position", "entity_key", "role")
    step_references = reduce(DataFrame.unionByName, [*listed, own]).distinct().join(wide(with_subject), ["journey_key", "position"])
    step_references = step_references.withColumn("is_subject", F.coalesce(F.col("entity_key") == F.col("subject"), F.lit(False))).drop("subject")
    lost = subjects.where("known IS NULL").select("journey_key", "position", F.lit("unknown-subject").alias("problem"), F.col("entity_key").alias("object"))
    homeless = placed.where("document_key IS NULL").select("journey_key", "position", F.lit("unknown-source").alias("problem"), F.col("evidence_id").alias("object"))
    bare = told.join(wide(step_evidence), ["journey_key", "position"], "left_anti").select("journey_key", "position", F.lit("no-evidence").alias("problem"), F.col("step_id").alias("object"))
    violations = lost.unionByName(homeless).unionByName(bare).distinct()
    # No two producers share a relation, so each is made distinct by itself.  What a journey uses, evidence times references,
    # is so by its two sides and is never held by an aggregation.
    relationships = reduce(DataFrame.unionByName, [*[e.distinct() for e in edges], used])
    return reduce(DataFrame.unionByName, made).distinct(), relationships, step_references, violations


def resolve_references(references: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, violations): references (journey_key, ..., entity_key) with (entity_id, entity_type, display_name) of the published
    ``entities`` (entity_key, entity_id, type, name); a key that is not published is a violation."""
    known = entities.select("entity_key", "entity_id", F.col("type").alias("entity_type"), F.col("name").alias("display_name"))
    joined = references.join(known, "entity_key", "left")
    lost = joined.where("entity_id IS NULL").select("journey_key", F.lit("unavailable-entity").alias("problem"), F.col("entity_key").alias("object")).distinct()
    return joined.where("entity_id IS NOT NULL").drop("entity_key"), lost


def resolve_relationships(references: DataFrame, relationships: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, violations): references (journey_key, relationship_key, type) with the published id and both ends' ids and names.

    The relationship must be published with that type, and both its ends too."""
    sides = relationships.select("relationship_key", "relationship_id", F.col("type").alias("published_type"), "source_key", "target_key")
    for end in ("source", "target"):
        side = entities.select(F.col("entity_key").alias(f"{end}_key"), F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_display_name"))
        sides = sides.join(side, f"{end}_key", "left")
    joined = references.join(sides, "relationship_key", "left")
    sound = (F.col("published_type") == F.col("type")) & F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull()
    checked = joined.withColumn("sound", F.coalesce(sound, F.lit(False)))
    lost = checked.where("NOT sound").select("journey_key", F.lit("unavailable-relationship").alias("problem"), F.col("relationship_key").alias("object")).distinct()
    return checked.where("sound").drop("sound", "published_type", "source_key", "target_key"), lost


def kept_steps(pieces: DataFrame, boundary: Column, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(journey_key, steps, kept, omitted, chars, bytes): how many of its first steps each journey can publish; ``kept`` is null if none fit.

    ``pieces`` has (journey_key, at, chars, bytes): parts of the model with the last step that each needs (0 for parts that always stay, n for
    the n-th step, a transition with both ends, a reference to a step), chars and bytes of its JSON with a separator; model and
    envelope parts alike.  All steps are kept if they fit both bounds; else as many as fit together with a ``boundary``, an expression over
    ``kept`` and ``steps`` for the JSON that tells of the omission (written twice, as boundary and as diagnostic).  Sizes run over steps in
    a window for each journey, over one row a step.
    """
    by_step = pieces.groupBy("journey_key", F.col("at").cast("int").alias("kept")).agg(F.sum("chars").alias("chars"), F.sum("bytes").alias("bytes"))
    run = Window.partitionBy("journey_key").orderBy("kept").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("journey_key")
    sums = by_step.select("journey_key", "kept", F.sum("chars").over(run).alias("c"), F.sum("bytes").over(run).alias("b"), F.max("kept").over(whole).alias("steps"))
    extra = F.when(F.col("kept") == F.col("steps"), F.lit("")).otherwise(boundary)
    sized = sums.withColumns({"c": F.col("c") + 2 * F.char_length(extra), "b": F.col("b") + 2 * F.octet_length(extra)})
    fits = (F.col("c") <= max_chars) & (F.col("b") <= max_bytes) & ((F.col("kept") >= 1) | (F.col("steps") == 0))
    best = sized.groupBy("journey_key").agg(F.max("steps").alias("steps"), F.max(F.when(fits, F.struct("kept", "c", "b"))).alias("best"))
    return best.select("journey_key", "steps", F.col("best.kept").alias("kept"), (F.col("steps") - F.col("best.kept")).alias("omitted"), F.col("best.c").alias("chars"), F.col("best.b").alias("bytes"))


def size_boundary(step_id: Column, evidence: Column) -> Column:
    """The JSON that tells that a journey was cut after ``kept`` of ``steps`` steps; its first omitted step and that one's evidence."""
    reason = F.concat(F.lit("journey-publication-size-limit:"), (F.col("steps") - F.col("kept")).cast("string"), F.lit("-steps-omitted"))
    return F.to_json(F.struct(F.concat(step_id, F.lit(":publication-size-limit")).alias("key"), reason.alias("reason"), step_id.alias("target"), evidence.alias("evidenceRef")))


def cut(rows: DataFrame, sizes: DataFrame, last_step: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, omitted) rows of journeys by the last step that each needs; journeys that cannot be published at all lose every row."""
    told = rows.join(sizes.select("journey_key", F.col("kept").alias("_kept")), "journey_key")
    stays = F.coalesce(last_step <= F.col("_kept"), F.lit(False))
    return told.where(stays).drop("_kept"), told.where(~stays).drop("_kept")
