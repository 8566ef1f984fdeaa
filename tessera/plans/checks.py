"""Queries of integrity checks and stored differences over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import settle, shared_dir
from ..operators import diff_store, publication, search
from .queries import _PROJECTED, _projection, _with, query
from .roles import ends_of, entities, published_relationships, published_year, table, tasks_for

# ---------------------------------------------------------------- integrity

_CITED = """l AS (SELECT *, 'DEPENDS_ON:supplier:' || l_suppkey || '->part:' || l_partkey AS r FROM lineitem WHERE year(l_shipdate) = 1996),
 ev AS (SELECT r, l_orderkey AS e, count(*) AS n FROM l WHERE l_orderkey % 31 <> 0 GROUP BY 1, 2), pv AS (SELECT r, l_orderkey AS e, count(*) AS n FROM l WHERE l_orderkey % 37 <> 0 GROUP BY 1, 2),
 st AS (SELECT o_orderkey AS e, o_orderstatus AS s FROM orders WHERE o_orderkey % 41 <> 0),
 lin AS (SELECT DISTINCT l_orderkey AS e, CASE WHEN l_orderkey % 43 = 0 THEN '?' ELSE o_orderstatus END AS s FROM l JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 37 <> 0)"""


@query(
    _with(
        "SELECT 1996::BIGINT AS publication_id, coalesce(ev.r, pv.r) || '#' || coalesce(ev.e, pv.e) AS object_id, CASE WHEN pv.n IS NULL THEN 'evidence-not-described' WHEN ev.n IS NULL THEN 'evidence-not-listed' ELSE 'evidence-listed-twice' END AS problem "
        "FROM ev FULL OUTER JOIN pv ON ev.r = pv.r AND ev.e = pv.e WHERE ev.n IS NULL OR pv.n IS NULL OR ev.n > 1 UNION ALL SELECT NULL, CAST(lin.e AS VARCHAR), CASE WHEN st.e IS NULL THEN 'lineage-not-stored' ELSE 'lineage-different' END FROM lin LEFT JOIN st ON st.e = lin.e WHERE st.e IS NULL OR st.s <> lin.s",
        _CITED, "prel",
    )
)
def snapshot_evidence_integrity(spark, sf):
    """A year's edges with the orders as evidence: some are not described, not listed, listed twice, not stored or of another lineage."""
    lines = table(spark, sf, "lineitem").where(F.year("l_shipdate") == 1996)
    edge = F.concat(F.lit("DEPENDS_ON:supplier:"), F.col("l_suppkey").cast("string"), F.lit("->part:"), F.col("l_partkey").cast("string"))
    cited = lines.select(F.lit(1996).cast("long").alias("publication_id"), edge.alias("object_id"), F.col("l_orderkey").alias("evidence_id"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("lineage"))
    # Dealt by the number of lines, as ``published_year`` does.
    described = cited.where("evidence_id % 37 <> 0").repartition(tasks_for(table(spark, sf, "lineitem")), "evidence_id").join(orders, "evidence_id").withColumn("lineage", F.when(F.col("evidence_id") % 43 == 0, "?").otherwise(F.col("lineage")))
    objects, edges = published_year(spark, sf, 1996)
    return publication.integrity_violations(objects, edges, cited.where("evidence_id % 31 <> 0"), described, orders.where("evidence_id % 41 <> 0"))


# ---------------------------------------------------------------- differences

_COMPARED = """y AS (SELECT DISTINCT publication_id AS f, publication_id + 1 AS t FROM prel WHERE publication_id + 1 IN (SELECT publication_id FROM prel)),
 o AS (SELECT publication_id AS p, 'relationship' AS section, relationship_id AS k, n_lines || '|' || flag AS h, CAST(n_lines AS VARCHAR) AS x, flag AS z FROM prel UNION ALL SELECT publication_id, 'entity', entity_id, name || '|' || type, name, type FROM pent),
 c AS (SELECT coalesce(a.f, b.f) AS f, coalesce(a.t, b.t) AS t, coalesce(a.section, b.section) AS section, coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS change,
   CASE WHEN a.h <> b.h THEN '[' || array_to_string(list_filter([CASE WHEN a.x <> b.x THEN '"n_lines"' END, CASE WHEN a.z <> b.z THEN '"flag"' END], lambda v: v IS NOT NULL), ',') || ']' ELSE '[]' END AS fields
   FROM (SELECT * FROM y JOIN o ON o.p = y.f) a FULL OUTER JOIN (SELECT * FROM y JOIN o ON o.p = y.t) b ON a.f = b.f AND a.section = b.section AND a.k = b.k),
 n AS (SELECT f, t, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged,
   string_agg('{"change":"' || change || '","changedFields":' || fields || ',"id":"' || k || '"}', ',' ORDER BY k) FILTER (change <> 'unchanged' AND section = 'entity') AS e, string_agg('{"change":"' || change || '","changedFields":' || fields || ',"id":"' || k || '"}', ',' ORDER BY k) FILTER (change <> 'unchanged' AND section = 'relationship') AS r FROM c GROUP BY 1, 2)"""
_HASHED = """sha256('{"entity":[' || coalesce(e, '') || '],"relationship":[' || coalesce(r, '') || '],"summary":[{"added":' || added || ',"modified":' || modified || ',"removed":' || removed || ',"unchanged":' || unchanged || '}]}')"""


def _year_pairs(spark, sf):
    """(pairs of consecutive years, a comparison of both kinds of objects).  Both kinds are written once, for all comparisons."""
    edges = settle(published_relationships(spark, sf).drop("type"))
    version = lambda key: F.concat_ws("@", key, F.col("publication_id").cast("string")).alias("version_id")
    relations = edges.select("publication_id", F.col("relationship_id").alias("key"), version("relationship_id"), F.concat_ws("|", F.col("n_lines").cast("string"), "flag").alias("content_hash"), "n_lines", "flag")
    objects = settle(ends_of(edges, entities(spark, sf))).select("publication_id", F.col("entity_id").alias("key"), version("entity_id"), F.concat_ws("|", "name", "type").alias("content_hash"), "name", "type")
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("long").alias("publication_id")).distinct()
    pairs = years.join(years.select((F.col("publication_id") - 1).alias("publication_id")), "publication_id").select(F.col("publication_id").cast("string").alias("from_id"), (F.col("publication_id") + 1).cast("string").alias("to_id"))
    compare = lambda wanted: diff_store.compare_pairs(wanted, objects, "entity", "key", ["name", "type"]).unionByName(diff_store.compare_pairs(wanted, relations, "relationship", "key", ["n_lines", "flag"]))
    return pairs, compare


@query(_with(f"SELECT CAST(f AS VARCHAR) AS from_id, CAST(t AS VARCHAR) AS to_id, {_HASHED} AS content_hash, added, removed, modified, unchanged FROM n", _COMPARED, "pent"))
def diff_store_contents(spark, sf):
    """The stored differences of all consecutive years, read back from a store."""
    pairs, compare = _year_pairs(spark, sf)
    store = diff_store.DiffStore(spark, f"{shared_dir(spark).rstrip('/')}/diffs-{uuid.uuid4().hex}", compare)
    store.save(pairs)
    return store.rows().where("section = 'summary'").select("from_id", "to_id", "content_hash", "added", "removed", "modified", "unchanged")


@query(_with("SELECT CAST(f AS VARCHAR) AS from_id, CAST(t AS VARCHAR) AS to_id, CASE WHEN f % 2 = 0 THEN 'corrupt' ELSE 'valid' END AS state, CASE WHEN f % 2 = 0 THEN 'replaced' ELSE 'reused' END AS action FROM n", _COMPARED, "pent"))
def diff_store_repair(spark, sf):
    """Stored differences of which every second was altered: what verification says, and what saving again does."""
    pairs, compare = _year_pairs(spark, sf)
    path = f"{shared_dir(spark).rstrip('/')}/diffs-{uuid.uuid4().hex}"
    store = diff_store.DiffStore(spark, path, compare)
    store.save(pairs)
    altered = store.rows().where("CAST(from_id AS INT) % 2 = 0").withColumn("added", F.col("added") + 1)
    damaged = settle(altered)
    damaged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("from_id", "to_id").parquet(path)
    return store.save(pairs).select("from_id", "to_id", "state", "action")


# ---------------------------------------------------------------- search


@query(_with("SELECT * FROM proj WHERE publication_id = 1996 AND type IN ('part', 'supplier') AND contains(name_normalized, 'e') AND entity_id > 'part:1' ORDER BY entity_id LIMIT 31", _PROJECTED, "pent"))
def search_entities_filtered(spark, sf):
    """A page of a year's entities by type and a text in the name."""
    return search.search_entities(_projection(spark, sf), "E", types=["part", "supplier"], publication=1996, after="part:1", limit=30)
