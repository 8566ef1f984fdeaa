"""Submitted evidence and candidates: bounds, validation, explanation, and repair of what they point at.

Validators return rows that name the problem, so that one pass judges all submissions and sound
ones give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entity_key, relationship_key

#: Most bytes of a submission and most evidence rows of a document (fixed values).
MOST_BYTES, MOST_EVIDENCE = 900_000, 100_000
#: Processors whose source files make up the analysed code, and the folders it lies in (fixed values).
ANALYSED = ("scala-source", "play-routes", "hocon")
ANALYSED_PATH = "/(app|conf|src/main)/"


def bounds(submissions: DataFrame) -> DataFrame:
    """``submissions`` with ``problem``: null if accepted.

    Needs ``fingerprint`` (as discovered), ``content_hash`` (as processed), ``n_bytes`` and
    ``evidence_count``; the first rule broken is named.  A null value breaks its rule.
    """
    known = lambda ok: F.coalesce(ok, F.lit(False))
    problem = (
        F.when(~known(F.col("content_hash") == F.col("fingerprint")), "content-changed")
        .when(~known(F.col("evidence_count") <= MOST_EVIDENCE), "too-much-evidence")
        .when(~known(F.col("n_bytes") <= MOST_BYTES), "too-large")
    )
    return submissions.withColumn("problem", problem)


def valid_scope(kind: Column, scope: Column, document_path: Column) -> Column:
    """Whether an identity scope is external (modules only) or a clean path below the document's root."""
    outside = (kind == "module") & F.startswith(scope, F.lit("external:"))
    parts, root = F.split(scope, "/", -1), F.substring_index(document_path, "/", 1)
    inside = (F.get(parts, F.lit(0)) == root) & (root != "") & F.forall(parts, lambda p: ~p.isin("", ".", "..")) & ~F.contains(scope, F.lit("\\"))
    return F.coalesce(F.when(outside, F.char_length(scope) > len("external:")).otherwise(inside), F.lit(False))


def matching_evidence(cited: Column, described: Column) -> Column:
    """Both lists name each evidence once, and the same ones."""
    unique = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    return F.coalesce(unique(cited) & unique(described) & F.array_sort(cited).eqNullSafe(F.array_sort(described)), F.lit(False))


def entity_problems(candidates: DataFrame) -> DataFrame:
    """(key, problem) of candidates (key, type, source_id, identity_scope, name, document_path,
    evidence_ids, provenance_ids); a candidate with several faults gives several rows."""
    faults = F.array_compact(
        F.array(
            F.when(~F.col("key").eqNullSafe(entity_key(F.col("type"), F.col("source_id"), F.col("identity_scope"), F.col("name"))), "key"),
            F.when(~valid_scope(F.col("type"), F.col("identity_scope"), F.col("document_path")), "scope"),
            F.when(~matching_evidence(F.col("evidence_ids"), F.col("provenance_ids")), "evidence"),
        )
    )
    return candidates.select("key", F.explode(faults).alias("problem"))


def relationship_problems(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """(key, problem) of candidates (key, type, source_key, target_key); ``rejected`` (key) are
    entities that were refused, which no edge may name."""
    refused = rejected.select(F.col("key").alias("end"), F.lit(True).alias("refused")).distinct()
    ends = candidates.select("key", "type", "source_key", "target_key")
    for end in ("source", "target"):
        ends = ends.join(refused.withColumnsRenamed({"end": f"{end}_key", "refused": f"{end}_refused"}), f"{end}_key", "left")
    faults = F.array_compact(
        F.array(
            F.when(~F.col("key").eqNullSafe(relationship_key(F.col("type"), F.col("source_key"), F.col("target_key"))), "key"),
            F.when(F.col("source_key") == F.col("target_key"), "self-edge"),
            F.when(F.col("source_refused"), "rejected-source"),
            F.when(F.col("target_refused"), "rejected-target"),
        )
    )
    return ends.select("key", F.explode(faults).alias("problem"))


def active_contributions(active: DataFrame, contributions: DataFrame) -> DataFrame:
    """The contributions in force: those whose (model, document, version) is the active one."""
    keys = ["model_id", "document_id", "version_id"]
    return contributions.join(active.select(*keys).distinct(), keys, "left_semi")


def analysed_sources(evidence: DataFrame) -> DataFrame:
    """Evidence (processor_id, path) of the analysed processors inside the analysed folders."""
    return evidence.where(F.col("processor_id").isin(*ANALYSED) & F.col("path").rlike(ANALYSED_PATH))


def explain(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Evidence with the document, content and processor that it comes from; orphans are left out."""
    return evidence.join(versions, "version_id")


def repair_authority(pointers: DataFrame, eligible: DataFrame) -> DataFrame:
    """(document_id, version_id, revision): pointers after a repair against the eligible versions.

    A pointer at a version that is not eligible is cleared and its revision raised.  A document
    without a version, cleared ones included, then takes its eligible version if it has exactly
    one: the revision is raised again, or is 1 for a document that had no pointer row.
    """
    able = eligible.select("document_id", "version_id").distinct()
    alone = able.groupBy("document_id").agg(F.min("version_id").alias("only"), F.count("*").alias("n"))
    sound = able.withColumn("sound", F.lit(True))
    joined = (
        pointers.select("document_id", "version_id", "revision", F.lit(True).alias("had"))
        .join(sound, ["document_id", "version_id"], "left")
        .withColumn("cleared", F.col("version_id").isNotNull() & F.col("sound").isNull())
        .join(alone, "document_id", "full_outer")
    )
    bare = F.col("version_id").isNull() | F.coalesce("cleared", F.lit(False))
    taken = bare & (F.coalesce("n", F.lit(0)) == 1)
    raised = F.coalesce("revision", F.lit(0)) + F.coalesce(F.col("cleared").cast("int"), F.lit(0)) + taken.cast("int")
    out = joined.select("document_id", F.when(taken, F.col("only")).when(~bare, F.col("version_id")).alias("version_id"), raised.cast("int").alias("revision"), "had")
    # Documents that never had a pointer and get none stay without a row.
    return out.where("version_id IS NOT NULL OR had").drop("had")
