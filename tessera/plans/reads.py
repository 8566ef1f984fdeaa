"""Queries of published journeys, currency pages, merged provenance and guarded upserts, each with its DuckDB SQL.

Every document stands for a journey of one of four publications: its lines are the steps, and some of the
models are damaged in the ways that a read must tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import currency, journeys, presentation, reconcile, upserts
from .queries import _SUPPORT, currency_basis, currency_states, query
from .roles import table

_PARTS = """SELECT doc_id, doc_id % 4 AS publication_id, 'journey:' || doc_id AS entity_id, CASE WHEN doc_id % 17 = 0 THEN sha256('shared') ELSE sha256(CAST(doc_id AS VARCHAR)) END AS journey_id, 'J' || doc_id AS name,
 string_split(coalesce(text, ''), chr(10)) AS lines, CASE WHEN doc_id % 7 = 0 THEN 'not-one-model' WHEN doc_id % 11 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 THEN 'invalid-model' WHEN doc_id % 13 = 0 THEN 'other-model' END AS problem FROM documents WHERE doc_id IS NOT NULL"""
_J = f"WITH j AS ({_PARTS})"


def _published(spark, sf) -> DataFrame:
    """Documents as published entities with models; each seventh, eleventh, thirteenth, nineteenth and twenty-third is damaged."""
    docs = table(spark, sf, "documents").where("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    number = F.col("doc_id").cast("string")
    journey_id = F.when(F.col("doc_id") % 17 == 0, F.sha2(F.lit("shared"), 256)).otherwise(F.sha2(number, 256))

    def step(line, at):
        at_text, kind = at.cast("string"), at % 3
        when = lambda on, value: F.when(on, value)
        subject = F.struct(F.lit("api").alias("role"), F.lit("x").alias("label"), F.when(at % 2 != 0, "key").alias("entityKey"), *[F.when(at % 2 == 0, F.concat(F.lit("e"), at_text)).alias(f) for f in ("entityId", "entityType", "displayName")])
        source = F.struct(F.concat(F.lit("p"), at_text).alias("id"), F.lit("evidence").alias("kind"), F.lit("").alias("label"), when(at % 2 != 0, F.concat(F.lit("d"), at_text)).alias("documentEntityId"))
        return F.struct(
            F.concat(F.lit("s"), at_text).alias("id"), F.when(kind == 0, "HttpRouteStep").when(kind == 1, "ComponentStep").otherwise("UnresolvedCallStep").alias("type"), F.lit("source-order").alias("order"), F.lit("proven").alias("evidenceBasis"),
            when(kind == 0, F.lit("GET")).alias("method"), when(kind == 0, line).alias("route"), when((kind == 1) & (F.col("doc_id") % 23 != 0), line).alias("component"), when(kind == 2, line).alias("targetExpression"), when(kind == 2, F.lit("r")).alias("reason"),
            subject.alias("subject"), F.array(source).alias("provenance"),
        )

    whole = F.struct(F.lit("document").alias("role"), F.lit("whole").alias("label"), F.concat(F.lit("e"), number).alias("entityId"), F.lit("document").alias("entityType"), F.lit("w").alias("displayName"))
    empty = lambda of: F.from_json(F.lit("[]"), f"array<struct<{of}>>")
    # A short text has no component step that could lack its component, so the level is wrong as well.
    level = F.when((F.col("doc_id") % 19 == 0) | (F.col("doc_id") % 23 == 0), "surely").otherwise("complete")
    model = F.to_json(
        F.struct(
            journey_id.alias("id"), F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.concat(F.lit("J"), number)).alias("name"), F.array(F.lit("svc")).alias("sourceServices"), F.lit("proven").alias("confidence"), level.alias("completeness"),
            empty("id:string").alias("provenance"), F.transform(F.split("text", "\n"), step).alias("steps"), empty("id:string").alias("transitions"), F.array(whole).alias("entityReferences"), empty("type:string").alias("relationshipReferences"), empty("key:string").alias("unresolvedBoundaries"),
        )
    )
    broken = F.when(F.col("doc_id") % 11 == 0, F.left(model, F.char_length(model) - 1)).otherwise(model)
    facts = F.create_map(F.lit("journeyJson"), F.col("model"), F.lit("journeyId"), F.col("journey_id"))
    row, bare = F.struct(facts.alias("facts")), F.struct(F.create_map(F.lit("kind"), F.lit("journey")).alias("facts"))
    listed = F.when(F.col("doc_id") % 7 == 0, F.array(row, row)).otherwise(F.array(bare, row))
    rows = docs.select("doc_id", journey_id.alias("journey_id"), broken.alias("model"))
    return rows.select((F.col("doc_id") % 4).cast("long").alias("publication_id"), F.concat(F.lit("journey:"), F.col("doc_id").cast("string")).alias("entity_id"), F.lit("journey").alias("type"), F.concat(F.lit("J"), F.col("doc_id").cast("string")).alias("name"), F.array(F.col("doc_id").cast("string")).alias("evidence_ids"), listed.alias("provenance"))


@query(f"{_J} SELECT CAST(publication_id AS BIGINT) AS publication_id, entity_id AS object_id, problem FROM j WHERE problem IS NOT NULL")
def journey_faults(spark, sf):
    """Journeys whose models are doubled, broken, incomplete or of another name."""
    return journeys.read_journeys(_published(spark, sf))[1]


_FOUND = "problem IS NULL AND publication_id = 2 AND entity_id > 'journey:12' AND contains(lower(name || ' journey ' || journey_id || ' ' || name || ' svc whole ' || array_to_string(list_transform(lines, lambda l, i: CASE WHEN (i - 1) % 3 = 0 THEN 'GET ' || l ELSE l END), ' ')), 'get a')"


@query(f"{_J} SELECT CAST(publication_id AS BIGINT) AS publication_id, entity_id AS journey_entity_id, journey_id, CAST(len(lines) AS INTEGER) AS steps, CAST(len(lines) + 1 AS INTEGER) AS pins, '2' AS pinned_to FROM j WHERE {_FOUND} ORDER BY entity_id LIMIT 41")
def journey_search(spark, sf):
    """A page of a publication's journeys with a route that starts with a letter, whatever its case; all published references are pinned."""
    sound, _ = journeys.read_journeys(_published(spark, sf))
    found = journeys.search_journeys(journeys.project_journeys(sound), sound, api="GET A", publication=2, after="journey:12", limit=40)
    steps = F.col("model.steps")
    to = F.concat(F.transform(steps, lambda s: s["subject"]["publicationId"]), F.flatten(F.transform(steps, lambda s: F.transform(s["provenance"], lambda p: p["publicationId"]))), F.transform("model.entityReferences", lambda e: e["publicationId"]))
    pins = F.filter(to, lambda p: p.isNotNull())
    return found.select("publication_id", "journey_entity_id", "journey_id", F.size(steps).alias("steps"), F.size(pins).alias("pins"), F.array_join(F.array_distinct(pins), ",").alias("pinned_to"))


@query(
    f"{_J}, w AS (SELECT DISTINCT publication_id, CASE WHEN doc_id % 5 = 0 THEN 'J' || doc_id ELSE journey_id END AS journey_id FROM j), k AS (SELECT publication_id, journey_id, count(*) AS n, min(entity_id) AS e FROM j WHERE problem IS NULL GROUP BY 1, 2) "
    "SELECT CAST(w.publication_id AS BIGINT) AS publication_id, w.journey_id, CASE WHEN w.journey_id LIKE 'J%' THEN 'invalid' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS state, CASE WHEN n = 1 THEN e END AS journey_entity_id FROM w LEFT JOIN k ON k.publication_id = w.publication_id AND k.journey_id = w.journey_id"
)
def journey_lookup(spark, sf):
    """All journeys asked for by id: some models are damaged, some ids shared, some no ids."""
    published = _published(spark, sf)
    asked = table(spark, sf, "documents").where("doc_id IS NOT NULL").select((F.col("doc_id") % 4).cast("long").alias("publication_id"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'J' || doc_id WHEN doc_id % 17 = 0 THEN sha2('shared', 256) ELSE sha2(CAST(doc_id AS STRING), 256) END").alias("journey_id"))
    return journeys.find_journeys(journeys.read_journeys(published)[0], asked)


@query(
    f"{_J} SELECT CAST(publication_id AS BIGINT) AS publication_id, entity_id AS journey_entity_id, CAST(len(lines) AS INTEGER) AS step_count, len(lines) > 5 AS steps_truncated, sha256(array_to_string(list_transform(lines[1:5], lambda l, i: 's' || (i - 1) || ':' || l), chr(10))) AS shown_sha256, "
    "array_to_string(list_transform(lines[1:5], lambda l, i: CASE WHEN (i - 1) % 2 = 0 THEN 'e' || (i - 1) || '@' || publication_id ELSE 'key@' END), ',') AS subjects, 1 AS evidence_count, 0 AS diagnostic_count, 'e' || doc_id || '@' || publication_id AS reference FROM j WHERE problem IS NULL"
)
def journey_compact(spark, sf):
    """Every sound journey as search shows it: its first five steps, their subjects and the counts of the rest."""
    sound, _ = journeys.read_journeys(_published(spark, sf))
    seen = journeys.compact_journeys(journeys.pinned(sound))
    line = F.transform("step_preview", lambda s: F.concat(s["id"], F.lit(":"), F.coalesce(s["route"], s["component"], s["targetExpression"])))
    about = lambda e: F.concat(F.coalesce(e["entityId"], e["entityKey"]), F.lit("@"), F.coalesce(e["publicationId"], F.lit("")))
    subjects = F.array_join(F.transform("step_preview", lambda s: about(s["subject"])), ",")
    return seen.select("publication_id", "journey_entity_id", "step_count", "steps_truncated", F.sha2(F.array_join(line, "\n"), 256).alias("shown_sha256"), subjects.alias("subjects"), "evidence_count", "diagnostic_count", F.array_join(F.transform("entity_references", about), ",").alias("reference"))


# ---------------------------------------------------------------- currency


@query(f"WITH {_SUPPORT} SELECT object_type, object_id, state, CAST(object_id AS VARCHAR) AS after_id, true AS same_basis FROM st WHERE state = 'STALE' ORDER BY object_id LIMIT 21 OFFSET 20")
def currency_second_page(spark, sf):
    """The second page of stale orders, reached by the cursor of the first, with the cursor that each row offers."""
    basis = currency_basis(spark, sf).where("bucket = 3").first().basis_hash
    rows = currency_states(spark, sf).select("object_type", "object_id", "state")
    first = currency.details_page(rows, "p", basis, state="STALE", limit=20).collect()
    second = currency.details_page(rows, "p", basis, first[19].cursor, state="STALE", limit=20)
    said = presentation.decode_cursor(F.col("cursor"))
    return second.select("object_type", "object_id", "state", F.get_json_object(said, "$.afterId").alias("after_id"), (F.get_json_object(said, "$.currencyBasisHash") == basis).alias("same_basis"))


# ---------------------------------------------------------------- candidates

_DESCRIBED = """e AS (SELECT l_partkey AS k, 'o' || (l_orderkey % 3000) AS e, min(l_returnflag || l_linestatus) AS lo, max(l_returnflag || l_linestatus) AS hi FROM lineitem GROUP BY 1, 2),
 m AS (SELECT k, string_agg(e || '=' || lo, ',' ORDER BY e) AS p, string_agg(e, ',' ORDER BY e) FILTER (lo <> hi) AS x FROM e GROUP BY 1)"""


@query(f"WITH {_DESCRIBED} SELECT 'part:' || k AS entity_key, CASE WHEN x IS NULL THEN 'merged' ELSE 'conflict' END AS state, coalesce(x, p) AS evidence, (SELECT max(l_linenumber / 10.0) FROM lineitem WHERE l_partkey = k AND x IS NULL) AS confidence FROM m")
def provenance_union(spark, sf):
    """Parts with the union of what orders say of them; evidence said to be two things keeps a part back."""
    line = F.struct(F.concat(F.lit("o"), (F.col("l_orderkey") % 3000).cast("string")).alias("evidence_id"), F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus").alias("facts"))
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("entity_key"), F.lit("part").alias("type"), F.lit("n").alias("name"), F.array(line["evidence_id"]).alias("evidence_ids"), (F.col("l_linenumber") / 10.0).alias("confidence"), F.array(line).alias("provenance"),
    )
    merged, conflicts = reconcile.merge_described(rows, "entity_key")
    said = F.transform("provenance", lambda p: F.concat(p["evidence_id"], F.lit("="), p["facts"]["flag"], p["facts"]["status"]))
    held = conflicts.groupBy("entity_key").agg(F.array_join(F.array_sort(F.collect_list("evidence_id")), ",").alias("evidence"))
    return merged.select("entity_key", F.lit("merged").alias("state"), F.array_join(said, ",").alias("evidence"), "confidence").unionByName(held.select("entity_key", F.lit("conflict").alias("state"), "evidence", F.lit(None).cast("double").alias("confidence")))


# ---------------------------------------------------------------- upserts


@query(
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL OR a.s IS NOT DISTINCT FROM b.s AND a.k IS NOT NULL THEN a.s ELSE b.s END AS status, CASE WHEN b.k IS NULL OR a.s IS NOT DISTINCT FROM b.s AND a.k IS NOT NULL THEN 1 ELSE 2 END AS scan, "
    "CASE WHEN b.k IS NULL THEN 'kept' WHEN a.k IS NULL THEN 'inserted' WHEN a.s IS DISTINCT FROM b.s THEN 'updated' ELSE 'unchanged' END AS change FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 3 <> 0) a "
    "FULL OUTER JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 26 <> 0 THEN o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k"
)
def guarded_upsert(spark, sf):
    """Two scans of orders: a row is written only if its status differs, nulls included."""
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    stored = orders.where(key % 3 != 0).select(key.alias("k"), F.when(key % 13 != 0, F.col("o_orderstatus")).alias("status"), F.lit(1).alias("scan"))
    rows = orders.where(key % 5 != 0).select(key.alias("k"), F.when(key % 7 == 0, "X").when(key % 26 != 0, F.col("o_orderstatus")).alias("status"), F.lit(2).alias("scan"))
    return upserts.upserted(stored, rows, ["k"], ["status"])
