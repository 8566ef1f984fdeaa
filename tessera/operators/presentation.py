"""What readers of a catalogue see: normal names, shown paths, cursors, parser packs, journey previews."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parser packs in their order with the extractors and the processors of each (fixed values).
PACKS = [
    ("typescript", ["typescript-dependencies", "package-dependencies", "container-images"], ["typescript", "dockerfile"]),
    ("openapi", ["openapi-operations"], []),
    ("adr", ["architectural-decisions"], []),
    ("markdown", ["markdown-references"], []),
    ("structure", ["repository-structure"], []),
]
#: Steps and provenance entries that a preview shows (fixed values).
STEPS_SHOWN, PROVENANCE_SHOWN = 5, 3


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKC")


def normalized(text: Column) -> Column:
    """Compatibility-composed (NFKC) and lower-cased, as names and texts are compared."""
    return F.lower(_nfkc(text))


def shown_path(path: Column) -> Column:
    """A document path without its opaque root; a path without a slash stays."""
    return F.regexp_replace(path, "^[^/]*/", "")


def repository_of_path(path: Column) -> Column:
    return F.substring_index(shown_path(path), "/", 1)


def locator_text(pointer: Column, line_start: Column, line_end: Column) -> Column:
    lines = F.when(line_start == line_end, F.concat(F.lit("line "), line_start.cast("string"))).otherwise(F.concat(F.lit("lines "), line_start.cast("string"), F.lit("–"), line_end.cast("string")))
    return F.when(pointer.isNotNull(), F.concat(F.lit("JSON pointer "), pointer)).otherwise(lines)


def _url_base64(raw: Column) -> Column:
    # Spark may break long output into lines.
    return F.translate(F.rtrim(F.base64(raw), F.lit("=")), "+/\r\n", "-_")


def encode_cursor(value: Column) -> Column:
    """Base64 with the URL alphabet and no padding."""
    return _url_base64(F.encode(value, "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    """The value of a cursor, null unless encoding it again gives the same cursor."""
    wellformed = cursor.rlike("^[A-Za-z0-9_-]+$") & (F.char_length(cursor) % 4 != 1)
    padded = F.rpad(F.translate(cursor, "-_", "+/"), F.ceil(F.char_length(cursor) / 4) * 4, F.lit("="))
    raw = F.when(wellformed, F.unbase64(padded))
    return F.when((_url_base64(raw) == cursor) & F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def pack_of(extractor: Column, processor: Column, pointer: Column) -> Column:
    """The pack of a provenance row: by extractor, then JSON by its pointer, then by processor; else null."""
    out = F.lit(None).cast("string")
    for pack, _, processors in reversed(PACKS):
        out = F.when(processor.isin(*processors), pack).otherwise(out) if processors else out
    contract = F.startswith(pointer, F.lit("/paths/")) | F.startswith(pointer, F.lit("/info"))
    out = F.when((processor == "json") & pointer.isNotNull(), F.when(contract, "openapi").otherwise("typescript")).otherwise(out)
    for pack, extractors, _ in reversed(PACKS):
        out = F.when(extractor.isin(*extractors), pack).otherwise(out)
    return out


def pack_contributions(provenance: DataFrame) -> DataFrame:
    """(pack, entities, relationships, evidence, extractors): distinct facts of every pack, zeros kept.

    ``provenance`` has (object_type, object_id, evidence_id, extractor_id, processor_id, pointer).
    Facts are made distinct before they are counted, so no group's ids meet in one task.
    """
    rows = provenance.withColumn("pack", pack_of(F.col("extractor_id"), F.col("processor_id"), F.col("pointer"))).where("pack IS NOT NULL")
    facts = F.explode(
        F.array(
            F.struct(F.col("object_type").alias("kind"), F.col("object_id").cast("string").alias("id")),
            F.struct(F.lit("evidence").alias("kind"), F.col("evidence_id").cast("string").alias("id")),
            F.struct(F.lit("extractor").alias("kind"), F.col("extractor_id").alias("id")),
        )
    )
    distinct = rows.select("pack", facts.alias("f")).select("pack", "f.kind", "f.id").distinct()
    count = lambda kind: F.count_if(F.col("kind") == kind)
    counted = distinct.groupBy("pack").agg(
        count("entity").alias("entities"), count("relationship").alias("relationships"), count("evidence").alias("evidence"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "extractor", F.col("id")))), ",").alias("extractors"),
    )
    packs = provenance.sparkSession.createDataFrame([(p,) for p, _, _ in PACKS], "pack string")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entities", "relationships", "evidence")]
    return packs.join(counted, "pack", "left").select("pack", *zero, F.coalesce("extractors", F.lit("")).alias("extractors"))


def documents_of(provenance: DataFrame) -> DataFrame:
    """One row: the number of distinct documents that any fact cites."""
    return provenance.select("document_id").where("document_id IS NOT NULL").distinct().agg(F.count("*").alias("documents"))


def journey_previews(steps: DataFrame, key: str, order: list[str], label: str, most: int = STEPS_SHOWN) -> DataFrame:
    """(key, step_count, step_preview, steps_truncated): the first ``most`` steps of each journey.

    Ranking within a key lets Spark drop later steps before they are gathered; a preview never
    holds more than ``most``.
    """
    ranked = steps.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_at") <= most)
    first = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(label).alias("label")))), lambda s: s["label"]).alias("step_preview"))
    counted = steps.groupBy(key).agg(F.count("*").alias("step_count"))
    return counted.join(first, key).select(key, "step_count", "step_preview", (F.col("step_count") > most).alias("steps_truncated"))


def missing_projections(projected: DataFrame, *members: DataFrame) -> list[DataFrame]:
    """The member tables without the publications that ``projected`` already holds: what a rebuild reads.

    The built publications, one row each, are broadcast: members stay where they are, none gather by publication.
    """
    built = F.broadcast(projected.select("publication_id").distinct())
    return [rows.join(built, "publication_id", "left_anti") for rows in members]


def projection_events(published: DataFrame, built: DataFrame) -> DataFrame:
    """The chain after publishing: a request for each published publication, and its end if built."""
    asked = published.select("publication_id", F.lit("SearchProjectionRequested").alias("event_type"))
    ended = published.select("publication_id").join(built.select("publication_id").distinct(), "publication_id", "left_semi")
    return asked.unionByName(ended.select("publication_id", F.lit("SearchProjectionBuilt").alias("event_type")))
