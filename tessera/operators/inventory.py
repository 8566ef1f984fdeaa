"""Inventories: change detection, processing authority, replay and bounded transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_changes(previous: DataFrame, scanned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``before``, ``after`` and ``change`` from two inventories with a ``fingerprint``.

    ``previous`` may have ``is_present``; a row that is not present counts as missing, so it comes back as
    added.  Rows that are missing on both sides give no row.
    """
    present = F.col("is_present") if "is_present" in previous.columns else F.lit(True)
    old = previous.select(*keys, F.when(present, F.col("fingerprint")).alias("before"))
    new = scanned.select(*keys, F.col("fingerprint").alias("after"))
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    )
    return old.join(new, keys, "full_outer").where("before IS NOT NULL OR after IS NOT NULL").withColumn("change", change)


def scan_metrics(changes: DataFrame) -> DataFrame:
    count = lambda kind: F.count_if(F.col("change") == kind).alias(f"{kind}_count")
    return changes.agg(*[count(k) for k in ("added", "modified", "removed", "unchanged")])


def clear_pointers(pointers: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Pointers (keys, current_version, revision) after a scan.

    A modified document loses its pointer and gains a revision only if it had one; a removed
    document always does.
    """
    joined = pointers.join(changes.select(*keys, "change"), keys, "left")
    lost = F.col("change").isin("modified", "removed")
    bump = F.when(F.col("change") == "removed", 1).when((F.col("change") == "modified") & F.col("current_version").isNotNull(), 1).otherwise(0)
    return joined.select(*keys, F.when(~F.coalesce(lost, F.lit(False)), F.col("current_version")).alias("current_version"), (F.col("revision") + bump).alias("revision"))


def change_events(changes: DataFrame, keys: list[str], correlation: str) -> DataFrame:
    """One event for each change that is one, with a key that makes its publication idempotent."""
    kind = F.initcap("change")
    key = F.concat_ws(":", F.lit("catalogue"), F.concat(F.lit("Document"), kind), *[F.col(k).cast("string") for k in keys], F.lit(correlation))
    return changes.where("change <> 'unchanged'").select(*keys, F.concat(F.lit("Document"), kind).alias("event_type"), key.alias("idempotency_key"))


def preferred_definition(documents: DataFrame, definitions: DataFrame, name_col: str = "filename") -> DataFrame:
    """``documents`` with the only definition whose exact name or suffix matches, else nulls; and ``matches``.

    ``definitions`` is the registry of processors, a dozen rows: it becomes one literal array, so
    every document is decided in its row and repeated documents stay apart.
    """
    name = F.lower(F.col(name_col))
    kind = "array<struct<match_kind:string,match:string,processor_id:string,extraction_rule_id:string>>"
    fields = ("match_kind", "match", "processor_id", "extraction_rule_id")
    known = [F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in definitions.select(*fields).collect()]
    registry = F.array(*known).cast(kind)
    hits = F.filter(registry, lambda d: F.when(d["match_kind"] == "exact", name == d["match"]).otherwise(F.endswith(name, d["match"])))
    found = documents.withColumn("_hits", hits)
    only = lambda c: F.when(F.size("_hits") == 1, F.get("_hits", F.lit(0))[c]).alias(c)
    matches = F.when(F.col(name_col).isNull(), 0).otherwise(F.size("_hits")).cast("long")
    return found.select(*documents.columns, only("processor_id"), only("extraction_rule_id"), matches.alias("matches"))


def dedupe_versions(results: DataFrame, keys: list[str], evidence_hash: str) -> DataFrame:
    """One row for each version key; ``conflict`` where its results differ in evidence."""
    return results.groupBy(*keys).agg(F.count("*").alias("results"), (F.count_distinct(evidence_hash) > 1).alias("conflict"))


def replay(events: DataFrame, id_col: str, payload_hash: str) -> DataFrame:
    """(id, deliveries, accepted): an id with one payload replays safely, with several it conflicts."""
    return events.groupBy(id_col).agg(F.count("*").alias("deliveries"), (F.count_distinct(payload_hash) == 1).alias("accepted"))


def unique_pick(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key that has exactly one distinct value."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.min(value).alias(value), F.count("*").alias("n")).where("n = 1").drop("n")


def owning_repository(documents: DataFrame, repositories: DataFrame) -> DataFrame:
    """``documents`` (path) with the deepest repository that contains each: an equi-join on ancestors."""
    from ..functions import ancestors

    paths = documents.select("path").distinct()
    exploded = paths.withColumn("_a", F.explode(ancestors(F.col("path"))))
    repos = repositories.select(F.col("path").alias("_a"), F.col("path").alias("repository"))
    owners = exploded.join(repos, "_a").groupBy("path").agg(F.max_by("repository", F.length("repository")).alias("repository"))
    # Rows of one path, repeated ones too, stay rows of their own.
    return documents.join(owners, "path", "left").select(*documents.columns, "repository")


def scope_by_rules(assets: DataFrame, rules: DataFrame) -> DataFrame:
    """Assets that some registered rule of their source covers: (source_id, path, workspace_id)."""
    return assets.join(rules, "source_id").where(F.col("path").rlike(F.col("pattern"))).select("source_id", "path", "workspace_id").distinct()


def extraction_context(documents: DataFrame, repositories: DataFrame, root: Column) -> DataFrame:
    """For each root: its sorted documents and repositories as of now."""
    docs = documents.withColumn("root", root).groupBy("root").agg(F.sort_array(F.collect_list(F.struct("path", "fingerprint"))).alias("documents"))
    repos = repositories.withColumn("root", root).groupBy("root").agg(F.sort_array(F.collect_list("path")).alias("repositories"))
    return docs.join(repos, "root", "left")
