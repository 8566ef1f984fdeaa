"""Which processing result speaks for a document: the ordered fold of accepted results, and its repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .submissions import repair_authority


def fold_results(results: DataFrame, document: str, order: list[str], preferred: Column, content: str, versions: tuple[str, str], version_id: str, current: DataFrame | None = None) -> DataFrame:
    """(document, version_id, revision) after all ``results`` of each document in the order of their acceptance.

    Only results of the document's preferred definition count.  One with other content than the
    version in force takes its place; one with the same content does only if its (processor,
    rule) ``versions`` are greater, so authority never goes back.  Each change raises the revision.  ``current`` has
    (document, version_id, content, preferred, processor_version, rule_version, revision), the pointers
    before; a null version or one that is not preferred yields to any preferred result.  Documents that
    neither had a pointer nor get one have no row.  Times are never looked at.

    A run of equal contents is an island: in it the version in force is the first of the greatest.  A
    document's results are sorted in one task, by windows that spill.
    """
    key = F.col(f"`{document}`").alias("document")
    pair = F.struct(*[F.col(f"`{v}`").cast("long").alias(n) for v, n in zip(versions, ("p", "r"), strict=True)])
    content_ = F.struct(F.col(f"`{content}`").cast("string").alias("c"))
    rows = results.where(preferred).select(key, F.lit(False).alias("seed"), F.struct(*[F.col(f"`{o}`") for o in order]).alias("at"), content_.alias("content"), pair.alias("pair"), F.col(f"`{version_id}`").alias("version_id"), F.lit(0).alias("revision"))
    if current is not None:
        stands = F.col("preferred") & F.col("version_id").isNotNull()
        seed = current.select(
            F.col(f"`{document}`").alias("document"), F.lit(True).alias("seed"), F.lit(None).cast(rows.schema["at"].dataType).alias("at"),
            # The pointer of another definition agrees with no content, not even a null one.
            F.when(stands, F.struct(F.col("content").cast("string").alias("c"))).alias("content"),
            F.struct(F.col("processor_version").cast("long").alias("p"), F.col("rule_version").cast("long").alias("r")).alias("pair"), "version_id", "revision",
        )
        rows = rows.unionByName(seed)
    by_time = Window.partitionBy("document").orderBy(F.col("seed").desc(), "at", "version_id")
    numbered = rows.withColumn("n", F.row_number().over(by_time))
    turned = numbered.withColumn("turn", (~F.col("content").eqNullSafe(F.lag("content").over(by_time)) | (F.col("n") == 1)).cast("long"))
    island = turned.withColumn("island", F.sum("turn").over(by_time))
    before = Window.partitionBy("document", "island").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    greatest = F.max("pair").over(before)
    advanced = island.withColumn("advance", ~F.col("seed") & (greatest.isNull() | (F.col("pair") > greatest)))
    stands = F.col("advance") | F.col("seed")
    return advanced.groupBy("document").agg(
        F.max_by("version_id", F.when(stands, F.col("n"))).alias("version_id"),
        (F.max("revision") + F.count_if("advance")).cast("int").alias("revision"),
    )


def matching_definition(filename: Column, definitions: list[tuple[str, str, str, str]], processor: Column, rule: Column) -> Column:
    """Whether some accepted definition (match kind, match, processor, rule) fits the file's name, the processor and the rule."""
    name = F.lower(filename)
    hits = [((name == m) if kind == "exact" else F.endswith(name, F.lit(m))) & (processor == p) & (rule == r) for kind, m, p, r in definitions]
    return reduce(Column.__or__, hits, F.lit(False))


def eligible_versions(versions: DataFrame, documents: DataFrame, inventory: DataFrame, runs: DataFrame, definitions: list[tuple[str, str, str, str]]) -> DataFrame:
    """(document_id, version_id), distinct: versions that may speak for their document as it is now.

    ``versions`` has (version_id, document_id, source_id, path, content_fingerprint, processor_id,
    processor_version, rule_id, rule_version); its document must still lie at that source and path, the
    inventory must hold the path as a present document with that content, an accepted definition must fit the
    filename, both versions must be positive and a processing run of it must be completed.  Definitions are a dozen
    rows, tested in the row; the rest are equi-joins on (source, path) and on the version.
    """
    here = documents.select("document_id", "source_id", "path", "filename")
    present = inventory.where("asset_type = 'document' AND is_present").select("source_id", "path", F.col("fingerprint").alias("content_fingerprint"))
    done = runs.where("status = 'completed'").select("version_id")
    fit = matching_definition(F.col("filename"), definitions, F.col("processor_id"), F.col("rule_id"))
    joined = versions.where("processor_version > 0 AND rule_version > 0").join(here, ["document_id", "source_id", "path"]).where(fit)
    joined = joined.join(present, ["source_id", "path", "content_fingerprint"], "left_semi").join(done, "version_id", "left_semi")
    return joined.select("document_id", "version_id").distinct()


def repair(pointers: DataFrame, versions: DataFrame, documents: DataFrame, inventory: DataFrame, runs: DataFrame, definitions: list[tuple[str, str, str, str]]) -> DataFrame:
    """``repair_authority`` against the eligible versions of the catalogue: clear unsound pointers, adopt a document's only one."""
    return repair_authority(pointers, eligible_versions(versions, documents, inventory, runs, definitions))
