"""Queries of transfers and authority over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import authority, processors
from .queries import _NAMES, query
from .roles import table

# ---------------------------------------------------------------- canonical JSON


@query(
    """SELECT event_id, sha256('{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(date_part('milliseconds', ts) AS INTEGER) % 1000 AS VARCHAR), 3, '0') || 'Z","props":' || coalesce(to_json(props)::VARCHAR, 'null') || ',"user":{"id":' || coalesce(CAST(user_id AS VARCHAR), 'null')
       || ',"tags":[' || coalesce(to_json(event_type)::VARCHAR, 'null') || ',null,""]},"value":' || CASE WHEN value IS NULL THEN 'null' ELSE regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') END || '}') AS hash FROM events"""
)
def canonical_events(spark, sf):
    """Events as nested objects in canonical JSON."""
    user = F.struct(F.array(F.col("event_type"), F.lit(None), F.lit("")).alias("tags"), F.col("user_id").alias("id"))
    rows = table(spark, sf, "events").select("event_id", "value", F.col("ts").alias("at"), "props", user.alias("user"))
    return rows.select("event_id", F.sha2(canonical.row_json(rows, value="value", user="user", props="props", at="at"), 256).alias("hash"))


@query("""SELECT doc_id, sha256('{"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"size":' || n_chars || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}') AS hash FROM documents""")
def canonical_documents(spark, sf):
    """Whole texts inside canonical JSON: quotes, backslashes and control characters escaped."""
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", F.sha2(canonical.row_json(rows, text="text", size="n_chars", lang="lang"), 256).alias("hash"))


# ---------------------------------------------------------------- authority

_CATALOGUE = f"""doc AS (SELECT c_custkey AS document_id, CAST(c_nationkey AS BIGINT) AS source_id, c_mktsegment || '/' || c_custkey AS path, {_NAMES.replace("doc_id", "c_custkey")} AS filename FROM customer),
 def(how, match, processor_id, rule_id) AS (VALUES {", ".join(str(d) for d in processors.DEFINITIONS)}),
 ver AS (SELECT o_orderkey AS version_id, document_id, source_id, CASE WHEN o_orderkey % 11 = 0 THEN 'moved/' || path ELSE path END AS path, o_orderstatus AS f, o_orderkey % 6 AS pv, o_orderkey % 7 AS rv,
    CASE WHEN o_orderkey % 3 = 0 THEN 'json' ELSE 'markdown' END AS processor_id, CASE WHEN o_orderkey % 3 = 0 THEN 'json-scalar-values' ELSE 'markdown-blocks' END AS rule_id FROM orders JOIN doc ON o_custkey = document_id),
 inv AS (SELECT source_id, path, CASE WHEN document_id % 2 = 0 THEN 'O' ELSE 'F' END AS f FROM doc WHERE document_id % 13 <> 0),
 el AS (SELECT DISTINCT ver.document_id AS d, ver.version_id AS v FROM ver JOIN doc ON doc.document_id = ver.document_id AND doc.source_id = ver.source_id AND doc.path = ver.path JOIN inv ON inv.source_id = ver.source_id AND inv.path = ver.path AND inv.f = ver.f
    JOIN def ON def.processor_id = ver.processor_id AND def.rule_id = ver.rule_id AND pv > 0 AND rv > 0 AND ((how = 'exact' AND lower(filename) = match) OR (how = 'suffix' AND ends_with(lower(filename), match)))
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = ver.version_id AND l_linestatus = 'O' AND l_linenumber = 1 OR l_orderkey = ver.version_id AND l_returnflag = 'A'))"""


def _catalogue(spark, sf):
    """Customers as documents, orders as their versions, lines as processing runs."""
    named = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("document_id"), F.col("c_nationkey").cast("long").alias("source_id"), F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string")).alias("path"),
        F.expr(_NAMES.replace("doc_id", "c_custkey")).alias("filename"),
    )
    key, as_json = F.col("o_orderkey"), F.col("o_orderkey") % 3 == 0
    versions = table(spark, sf, "orders").join(named, F.col("o_custkey") == F.col("document_id")).select(
        key.alias("version_id"), "document_id", "source_id", F.when(key % 11 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.col("o_orderstatus").alias("content_fingerprint"),
        (key % 6).alias("processor_version"), (key % 7).alias("rule_version"), F.when(as_json, "json").otherwise("markdown").alias("processor_id"), F.when(as_json, "json-scalar-values").otherwise("markdown-blocks").alias("rule_id"),
    )
    inventory = named.select("source_id", "path", F.lit("document").alias("asset_type"), (F.col("document_id") % 13 != 0).alias("is_present"), F.when(F.col("document_id") % 2 == 0, "O").otherwise("F").alias("fingerprint"))
    done = ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)) | (F.col("l_returnflag") == "A")
    runs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.when(done, "completed").otherwise("failed").alias("status"))
    return versions, named, inventory, runs, processors.DEFINITIONS


@query(f"WITH {_CATALOGUE} SELECT d AS document_id, v AS version_id FROM el")
def eligible_versions(spark, sf):
    return authority.eligible_versions(*_catalogue(spark, sf))


@query(
    f"WITH {_CATALOGUE}, alone AS (SELECT d, min(v) AS v FROM el GROUP BY 1 HAVING count(*) = 1), ptr AS (SELECT o_custkey AS d, CASE WHEN o_custkey % 3 <> 0 THEN max(o_orderkey) END AS v, 2 AS r FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1), "
    "cl AS (SELECT ptr.d, CASE WHEN el.v IS NULL THEN NULL ELSE ptr.v END AS v, r + CASE WHEN ptr.v IS NOT NULL AND el.v IS NULL THEN 1 ELSE 0 END AS r FROM ptr LEFT JOIN el ON ptr.d = el.d AND ptr.v = el.v) "
    "SELECT coalesce(cl.d, alone.d) AS document_id, coalesce(cl.v, alone.v) AS version_id, CAST(coalesce(cl.r, 0) + CASE WHEN cl.v IS NULL AND alone.v IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS revision FROM cl FULL OUTER JOIN alone ON cl.d = alone.d"
)
def authority_backfill(spark, sf):
    """Pointers repaired against the versions that the catalogue itself makes eligible."""
    orders = table(spark, sf, "orders").where("o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("document_id")).agg(F.max("o_orderkey").alias("newest"))
    pointers = orders.select("document_id", F.when(F.col("document_id") % 3 != 0, F.col("newest")).alias("version_id"), F.lit(2).alias("revision"))
    return authority.repair(pointers, *_catalogue(spark, sf))
