"""Queries of submissions and of what readers see, over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import presentation, search, submissions
from .queries import _PROJECTED, _with, query
from .roles import entities, ends_of, published_entities, published_relationships, sql, table

# ---------------------------------------------------------------- submissions


@query(
    "SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 9 = 0 THEN 'content-changed' WHEN length(text) - length(replace(text, ' ', '')) > 100000 THEN 'too-much-evidence' WHEN strlen(text) > 900000 THEN 'too-large' END AS problem FROM documents"
)
def submission_bounds(spark, sf):
    """Documents as submissions, their blanks as evidence rows; every ninth changed after discovery."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = docs.select(
        "doc_id", fn.fingerprint(F.col("text")).alias("content_hash"),
        F.when(F.col("doc_id") % 9 == 0, "-").otherwise(fn.fingerprint(F.col("text"))).alias("fingerprint"),
        F.octet_length("text").alias("n_bytes"), (F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))).alias("evidence_count"),
    )
    return submissions.bounds(rows).select("doc_id", "problem")


_CANDIDATES = """c AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 4 = 0 THEN 'module' ELSE 'part' END AS type,
   CASE p_partkey % 7 WHEN 0 THEN 'external:' WHEN 1 THEN 'external:x' WHEN 2 THEN 'root//a' WHEN 3 THEN 'other/a' WHEN 4 THEN 'root/../a' ELSE 'root/a' END AS scope, lower(replace(p_name, ' ', '')) AS name FROM part),
 ck AS (SELECT *, type || ':tpch:' || replace(replace(scope, ':', '%3A'), '/', '%2F') || ':' || CASE WHEN n % 5 = 0 THEN 'wrong' ELSE name END AS key FROM c),
 bad AS (SELECT key, 'key' AS problem FROM ck WHERE n % 5 = 0 UNION ALL
   SELECT key, 'scope' FROM ck WHERE NOT ((scope = 'external:x' AND type = 'module') OR scope = 'root/a') UNION ALL
   SELECT key, 'evidence' FROM ck WHERE n % 6 IN (0, 1))"""


def _entity_candidates(spark, sf):
    """Parts as candidates: some with a wrong key, a bad scope, evidence cited twice or not described."""
    n = F.col("p_partkey")
    scope = F.get(F.array(*[F.lit(s) for s in ("external:", "external:x", "root//a", "other/a", "root/../a", "root/a", "root/a")]), (n % 7).cast("int"))
    rows = table(spark, sf, "part").select(
        n.alias("n"), F.when(n % 4 == 0, "module").otherwise("part").alias("type"), F.lit("tpch").alias("source_id"), scope.alias("identity_scope"),
        F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name"), F.lit("root/a/b.ts").alias("document_path"),
    )
    cited = F.when(F.col("n") % 6 == 0, F.array(F.lit("e1"), F.lit("e1"))).otherwise(F.array(F.lit("e2"), F.lit("e1")))
    described = F.when(F.col("n") % 6 == 1, F.array(F.lit("e3"), F.lit("e1"))).when(F.col("n") % 6 == 0, F.array(F.lit("e1"))).otherwise(F.array(F.lit("e1"), F.lit("e2")))
    said = F.when(F.col("n") % 5 == 0, F.lit("wrong")).otherwise(F.col("name"))
    key = fn.entity_key(F.col("type"), F.col("source_id"), F.col("identity_scope"), said)
    return rows.withColumns({"key": key, "evidence_ids": cited, "provenance_ids": described})


@query(f"WITH {_CANDIDATES} SELECT * FROM bad")
def entity_candidate_problems(spark, sf):
    return submissions.entity_problems(_entity_candidates(spark, sf))


_EDGES = "c AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), e AS (SELECT 'USES' AS type, 'k' || s AS a, 'k' || p AS b, CASE WHEN p % 10 = 0 THEN 'USES:k' || s ELSE 'USES:k' || s || '->k' || p END AS key FROM c)"


@query(
    f"WITH {_EDGES} SELECT key, 'key' AS problem FROM e WHERE key NOT LIKE '%->%' UNION ALL SELECT key, 'self-edge' FROM e WHERE a = b UNION ALL "
    "SELECT key, 'rejected-source' FROM e WHERE a LIKE '%7' UNION ALL SELECT key, 'rejected-target' FROM e WHERE b LIKE '%7'"
)
def relationship_candidate_problems(spark, sf):
    """Supplies as candidates, with some wrong keys; entities ending in 7 were rejected."""
    pairs = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    source, target = (F.concat(F.lit("k"), F.col(c).cast("string")) for c in ("l_suppkey", "l_partkey"))
    key = F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("USES:"), source)).otherwise(fn.relationship_key(F.lit("USES"), source, target))
    rows = pairs.select(F.lit("USES").alias("type"), source.alias("source_key"), target.alias("target_key"), key.alias("key"))
    ends = rows.select(F.explode(F.array("source_key", "target_key")).alias("key"))
    return submissions.relationship_problems(rows, ends.where(F.endswith("key", F.lit("7"))))


@query("SELECT o_custkey % 5 AS model_id, o_custkey AS document_id, o_orderkey AS version_id, o_orderpriority AS candidate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def active_contributions(spark, sf):
    """Customers' orders as contributions of five models; the newest of each is active."""
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("model_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("candidate"), "o_orderdate")
    active = orders.groupBy("model_id", "document_id").agg(F.max_by("version_id", F.struct("o_orderdate", "version_id")).alias("version_id"))
    return submissions.active_contributions(active, orders.drop("o_orderdate"))


_FOLDERS = "CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN '/app/' WHEN 1 THEN '/conf/' WHEN 2 THEN '/src/main/' WHEN 3 THEN '/src/test/' ELSE '/application/' END"
_PROCESSORS = "CASE CAST(doc_id % 4 AS INTEGER) WHEN 0 THEN 'scala-source' WHEN 1 THEN 'play-routes' WHEN 2 THEN 'hocon' ELSE 'markdown' END"


@query(f"SELECT doc_id, source || {_FOLDERS} || doc_id AS path, {_PROCESSORS} AS processor_id FROM documents WHERE doc_id % 4 < 3 AND regexp_matches(source || {_FOLDERS} || doc_id, '/(app|conf|src/main)/')")
def analysed_sources(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr(f"source || {_FOLDERS} || doc_id").alias("path"), F.expr(_PROCESSORS).alias("processor_id"))
    return submissions.analysed_sources(docs)


@query("SELECT t.doc_id AS version_id, t.quality AS evidence, d.source, sha256(d.text) AS content_hash FROM labels t JOIN documents d ON t.doc_id = d.doc_id")
def evidence_explanation(spark, sf):
    """Labels as evidence, documents as the versions that explain it."""
    evidence = table(spark, sf, "labels").select(F.col("doc_id").alias("version_id"), F.col("quality").alias("evidence"))
    docs = table(spark, sf, "documents")
    return submissions.explain(evidence, docs.select(F.col("doc_id").alias("version_id"), "source", fn.fingerprint(F.col("text")).alias("content_hash")))


_REPAIR = """el AS (SELECT DISTINCT o_custkey AS d, o_orderkey AS v FROM orders WHERE o_orderkey % 4 = 0),
 alone AS (SELECT d, min(v) AS v FROM el GROUP BY 1 HAVING count(*) = 1),
 ptr AS (SELECT o_custkey AS d, CASE WHEN o_custkey % 3 <> 0 THEN max(o_orderkey) END AS v, CAST(2 AS INTEGER) AS r FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
 cl AS (SELECT ptr.d, CASE WHEN el.v IS NULL THEN NULL ELSE ptr.v END AS v, r + CASE WHEN ptr.v IS NOT NULL AND el.v IS NULL THEN 1 ELSE 0 END AS r FROM ptr LEFT JOIN el ON ptr.d = el.d AND ptr.v = el.v)"""


@query(f"WITH {_REPAIR} SELECT coalesce(cl.d, alone.d) AS document_id, coalesce(cl.v, alone.v) AS version_id, CAST(coalesce(cl.r, 0) + CASE WHEN cl.v IS NULL AND alone.v IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS revision FROM cl FULL OUTER JOIN alone ON cl.d = alone.d")
def authority_repair(spark, sf):
    """Customers as documents: a quarter never had a pointer, a third of the rest had none; every fourth order is eligible."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"))
    pointers = orders.where("document_id % 4 <> 0").groupBy("document_id").agg(F.max("version_id").alias("newest"))
    pointers = pointers.select("document_id", F.when(F.col("document_id") % 3 != 0, F.col("newest")).alias("version_id"), F.lit(2).alias("revision"))
    return submissions.repair_authority(pointers, orders.where("version_id % 4 = 0"))


# ---------------------------------------------------------------- what readers see

_WIDE = "".join(chr(0xFF21 + i) for i in range(26))


@query("SELECT doc_id, lower(source) AS name_normalized FROM documents")
def compatibility_names(spark, sf):
    """Sources written with full-width capitals normalise to the plain lower-cased name."""
    wide = F.translate(F.upper("source"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _WIDE)
    return table(spark, sf, "documents").select("doc_id", presentation.normalized(wide).alias("name_normalized"))


_SITE = "regexp_replace(url, '^[a-z]+://', '')"


@query(
    f"SELECT page_id, regexp_replace({_SITE}, '^[^/]*/', '') AS shown, split_part(regexp_replace({_SITE}, '^[^/]*/', ''), '/', 1) AS repository, "
    "CASE WHEN page_id % 3 = 0 THEN 'JSON pointer /p/' || page_id WHEN page_id % 3 = 1 THEN 'line ' || page_id ELSE 'lines ' || page_id || '–' || (page_id + 2) END AS located FROM pages"
)
def document_locations(spark, sf):
    page, path = F.col("page_id"), F.regexp_replace("url", "^[a-z]+://", "")
    pointer = F.when(page % 3 == 0, F.concat(F.lit("/p/"), page.cast("string")))
    located = presentation.locator_text(pointer, page, F.when(page % 3 == 1, page).otherwise(page + 2))
    return table(spark, sf, "pages").select("page_id", presentation.shown_path(path).alias("shown"), presentation.repository_of_path(path).alias("repository"), located.alias("located"))


@query("SELECT doc_id, replace(replace(rtrim(to_base64(encode('{\"after\":' || doc_id || ',\"source\":\"' || source || '\"}')), '='), '+', '-'), '/', '_') AS cursor, '{\"after\":' || doc_id || ',\"source\":\"' || source || '\"}' AS decoded, NULL::VARCHAR AS refused FROM documents")
def scoped_cursors(spark, sf):
    """Cursors of all documents, read back; one with a blank behind it is refused."""
    rows = table(spark, sf, "documents").select("doc_id", fn.canonical_json(F.col("doc_id").alias("after"), "source").alias("value"))
    cursor = presentation.encode_cursor(F.col("value"))
    return rows.select("doc_id", cursor.alias("cursor"), presentation.decode_cursor(cursor).alias("decoded"), presentation.decode_cursor(F.concat(cursor, F.lit(" "))).alias("refused"))


_EXTRACTOR = "CASE CAST(l_linenumber AS INTEGER) WHEN 1 THEN 'container-images' WHEN 2 THEN 'openapi-operations' WHEN 3 THEN 'markdown-references' ELSE 'other-rule' END"
_PROCESSOR = "CASE CAST(l_linenumber AS INTEGER) WHEN 4 THEN 'json' WHEN 5 THEN 'dockerfile' WHEN 6 THEN 'json' ELSE 'text' END"
_POINTER = "CASE WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN '/paths/x' WHEN l_linenumber = 4 THEN '/name' END"
_PACKED = f"""x AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'entity' ELSE 'relationship' END AS object_type, l_partkey, l_orderkey, {_EXTRACTOR} AS ex,
   CASE CAST(l_linenumber AS INTEGER) WHEN 1 THEN 'typescript' WHEN 2 THEN 'openapi' WHEN 3 THEN 'markdown' WHEN 4 THEN CASE WHEN l_returnflag = 'A' THEN 'openapi' ELSE 'typescript' END WHEN 5 THEN 'typescript' END AS pack FROM lineitem)"""


@query(
    f"WITH {_PACKED} SELECT w.pack, count(DISTINCT CASE WHEN object_type = 'entity' THEN l_partkey END) AS entities, count(DISTINCT CASE WHEN object_type = 'relationship' THEN l_partkey END) AS relationships, count(DISTINCT l_orderkey) AS evidence, "
    "coalesce(string_agg(DISTINCT ex, ',' ORDER BY ex), '') AS extractors FROM (VALUES ('typescript'), ('openapi'), ('adr'), ('markdown'), ('structure')) AS w(pack) LEFT JOIN x ON w.pack = x.pack GROUP BY 1"
)
def pack_contributions(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "entity").otherwise("relationship").alias("object_type"), F.col("l_partkey").alias("object_id"), F.col("l_orderkey").alias("evidence_id"),
        F.expr(_EXTRACTOR).alias("extractor_id"), F.expr(_PROCESSOR).alias("processor_id"), F.expr(_POINTER).alias("pointer"),
    )
    return presentation.pack_contributions(rows)


@query("SELECT count(DISTINCT l_orderkey) AS documents FROM lineitem")
def cited_documents(spark, sf):
    return presentation.documents_of(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id")))


@query("SELECT conv_id, count(*) AS step_count, string_agg(role, ',' ORDER BY pos) FILTER (WHERE pos <= 5) AS step_preview, count(*) > 5 AS steps_truncated FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS pos FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL) GROUP BY 1")
def journey_previews(spark, sf):
    """Conversations as journeys, their turns as steps."""
    steps = table(spark, sf, "conversations").select("conv_id", "turn", "role").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    return presentation.journey_previews(steps, "conv_id", ["turn", "role"], "role").withColumn("step_preview", F.array_join("step_preview", ","))


@query(_with("SELECT * FROM proj WHERE publication_id % 2 <> 0", _PROJECTED, "pent"))
def projection_rebuild(spark, sf):
    """Even years are projected already: only the others are built, their members chosen before any join."""
    edges = published_relationships(spark, sf)
    built = edges.where("publication_id % 2 = 0")
    (missing,) = presentation.missing_projections(built, edges)
    return search.project_entities(ends_of(missing, entities(spark, sf)), missing)


@query(sql("SELECT publication_id, 'SearchProjectionRequested' AS event_type FROM (SELECT DISTINCT publication_id FROM prel) UNION ALL SELECT publication_id, 'SearchProjectionBuilt' FROM (SELECT DISTINCT publication_id FROM prel) WHERE publication_id % 2 = 0", "prel"))
def projection_event_chain(spark, sf):
    published = published_relationships(spark, sf).select("publication_id").distinct()
    return presentation.projection_events(published, published_entities(spark, sf).where("publication_id % 2 = 0"))
