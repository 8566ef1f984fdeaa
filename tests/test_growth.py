"""Queries on tables that are cut, repeated or larger than the driver's smallest."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder, **tables):
    """The query over ``tables`` (DuckDB SELECTs over the smallest tables; the others as they are) equals its SQL."""
    import os

    db = duckdb.connect()
    for file in os.listdir(SF):
        table = file.split(".")[0]
        select = tables.get(table, f"SELECT * FROM '{SF}/{file}'")
        db.execute(f"COPY ({select}) TO '{folder}/{file}' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{file}'")
    found = catalog.QUERIES[name](spark, str(folder))
    said = db.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(said, key=str)
    return len(said)


@pytest.mark.parametrize("where", ["doc_id < 198", "doc_id % 8 <> 3", "doc_id % 4 = 0"])
def test_static_paths_of_cut_and_repeated_documents(spark, tmp_path, where):
    """Documents that lack their neighbours, and one id on two rows, give all their steps."""
    docs = f"SELECT * FROM '{SF}/documents.parquet' WHERE {where} UNION ALL SELECT * FROM '{SF}/documents.parquet' WHERE doc_id = 8"
    assert same_as_sql(spark, "static_path_steps", tmp_path, documents=docs) > 200


def test_hashes_of_long_lists_come_from_packed_pieces(spark, monkeypatch):
    """One task by key gets pieces of many items, in order over all ranges."""
    import hashlib

    from tessera.functions import canonical

    monkeypatch.setattr(canonical, "PIECE", 200, raising=False)
    df = spark.range(5000).selectExpr("CAST(id % 2 AS INT) AS k", "'a' AS f", "format_string('%05d', 5000 - id) AS at", "concat('{\"i\":', id, '}') AS item")
    found = canonical.object_hash(df.repartition(7), "k", "f", "at", "item", ["a"])
    assert "rangepartitioning" in found._jdf.queryExecution().toString()
    for row in found.collect():
        items = ",".join(f'{{"i":{i}}}' for i in range(4999, -1, -1) if i % 2 == row.k)
        assert (row["items"], row.hash) == (2500, hashlib.sha256(f'{{"a":[{items}]}}'.encode()).hexdigest())


def test_compared_objects_never_gather_by_pair(spark):
    """Pairs come to the objects: no shuffle deals objects by their publication alone."""
    from tessera.operators import diff_store

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        objects = spark.range(100).selectExpr("id % 2 AS publication_id", "id AS key", "'v' AS version_id", "'c' AS content_hash", "'n' AS name")
        pairs = spark.createDataFrame([("0", "1")], "from_id string, to_id string")
        plan = diff_store.compare_pairs(pairs, objects, "entity", "key", ["name"])._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1


def test_members_of_missing_projections_never_gather_by_publication(spark):
    from tessera.operators import presentation

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = spark.range(100).selectExpr("id % 5 AS publication_id", "id AS entity_id")
        (missing,) = presentation.missing_projections(members.where("publication_id = 2"), members)
        assert "SortMergeJoin" not in missing._jdf.queryExecution().toString()
        assert {r.publication_id for r in missing.collect()} == {0, 1, 3, 4}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_are_read_once_to_resolve_calls(spark):
    from tessera.operators import extractors, processors

    seen = spark.sparkContext.accumulator(0)

    def read(path, text):
        seen.add(1)
        yield from processors.read_scala(path, text)

    texts = [(i, "C.scala", f"package p\nclass C{i}(next: C{i + 1}) {{\n  def run(id: String) = {{\n    next.run(id)\n  }}\n}}") for i in range(5)]
    docs = spark.createDataFrame(texts, "document_id long, path string, text string")
    resolved, lost = extractors.resolve_calls(processors.per_document(docs, read, bounded=True))
    assert resolved.count() == 4 and lost.count() == 1 and seen.value == 5


def test_evidence_leaves_in_small_batches(spark):
    from tessera.operators import processors

    def read(path, text):
        yield from ((f"k{i}", "paragraph", "x", {}) for i in range(1000))

    docs = spark.range(50).selectExpr("id AS document_id", "'a' AS path", "'t' AS text").coalesce(1)
    assert processors.per_document(docs, read).count() == 50_000
    assert max(b.num_rows for b in _run_locally(processors, read)) <= 2000


def _run_locally(processors, read):
    """The batches that one task yields for 50 texts."""
    import pyarrow as pa

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            texts = {"document_id": pa.array(range(50), pa.int64()), "path": pa.array(["a"] * 50), "text": pa.array(["t"] * 50)}
            return list(run(iter([pa.RecordBatch.from_pydict(texts)])))

    return processors.per_document(Docs(), read)


def _shuffles(df):
    """The different shuffles of a plan as it is before it runs."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return sorted(re.findall(r"Exchange (\w+partitioning\([^\n]*?), \w+, \[plan_id", plan))


def test_described_candidates_are_dealt_by_key_alone(spark):
    """Neither lists nor joins of provenance shuffle again."""
    from tessera.operators import reconcile

    rows = spark.range(40).selectExpr("concat('k', id % 5) AS k", "'t' AS type", "'n' AS name", "array(concat('e', id % 7)) AS evidence_ids", "0.5D AS confidence", "array(named_struct('evidence_id', concat('e', id % 7), 'facts', map('f', 'v'))) AS provenance")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged, conflicts = reconcile.merge_described(rows, "k")
        kinds = _shuffles(merged)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert kinds and all(k.startswith("hashpartitioning(k#") and "evidence_id" not in k for k in kinds) and len(kinds) <= 3
    assert {len(r.provenance) for r in merged.collect()} == {7} and conflicts.count() == 0


def test_projections_read_relationships_once(spark):
    """Each publication's entities come from the counted ends of its edges, whatever reads the projection."""
    for name in ("projection_build", "search_entities_filtered"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_partkey") and plan.count("l_shipdate#") and plan.count("LocalRelation") == 0
        assert sum("Relation [" in line and "l_orderkey#" in line for line in plan.splitlines()) == 1


def test_projected_ends_are_the_projected_entities(spark):
    from tessera.operators import search

    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "a"), (2, "b", "c"), (None, "a", "b"), (1, "a", "x"), (2, None, "b")], "publication_id long, source_id string, target_id string")
    known = spark.createDataFrame([("a", "t", "A"), ("b", "t", None), ("c", "u", "C"), ("d", "u", "D")], "entity_id string, type string, name string")
    ends = edges.selectExpr("publication_id", "explode(array(source_id, target_id)) AS entity_id").distinct().join(known, "entity_id")
    before = search.project_entities(ends, edges).select("publication_id", "entity_id", "type", "name", "relationship_count", "name_normalized")
    after = search.project_ends(edges, known)
    assert sorted(map(tuple, after.collect()), key=str) == sorted(map(tuple, before.collect()), key=str) and after.count() == 6


def test_staged_chunks_are_dealt_once(spark):
    """By transfer, not by transfer, index and checksum as well."""
    from tessera.streaming import assemblies

    chunks = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 0, "c"), (3, 0, None)], "scan long, chunk_index int, checksum string")
    found = assemblies(chunks, chunks.groupBy("scan").agg(F.lit(2).alias("expected_chunks"), F.sha2(F.lit("ab"), 256).alias("checksum")), ["scan"])
    assert all("chunk_index" not in k for k in _shuffles(found)) and len(_shuffles(found)) == 2
    assert {(r.scan, r.received, r.state) for r in found.collect()} == {(1, 2, "complete"), (2, 1, "conflict"), (3, 1, "assembling")}


def test_routes_read_texts_once(spark):
    """Mounts, routes, repeats and the limit of a document's facts come from one pass over the texts."""
    from tessera.operators import processors

    many = "\n".join(["GET /a x.Y"] * (processors.MAX_FACTS + 1))
    texts = [(1, "-> /p q.Routes\nGET /a x.Y\n# no\nGET /a x.Y\nPUT /b\n\nget no"), (2, many), (None, many), (3, "GET /c z"), (3, "GET /c z"), (4, None)]
    docs = spark.createDataFrame([(i, "conf/app.routes", t) for i, t in texts], "document_id long, path string, text string")
    found = processors.play_routes(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and len(_shuffles(found)) == 1
    rows = [(r.document_id, r.key.replace("\0", " "), r.kind, r.excerpt) for r in found.collect()]
    tail = "route:conf/app.routes:app:"
    assert sorted(r[1:] for r in rows if r[0] == 1) == sorted([("mount:conf/app.routes:1:/p:q.Routes", "structured-value", "-> /p q.Routes"), (tail + "GET /a x.Y:1", "structured-value", "GET /a x.Y"), (tail + "GET /a x.Y:2", "structured-value", "GET /a x.Y"), (tail + "PUT /b :1", "structured-value", "PUT /b")])
    assert [r[1:] for r in rows if r[0] == 2] == [("rejected", "rejected", "too much evidence")]
    assert sum(r[0] is None for r in rows) == processors.MAX_FACTS + 2 and sum(r[0] == 3 for r in rows) == 2 and all(r[0] != 4 for r in rows)


@pytest.mark.parametrize("name", ["snapshot_evidence_integrity", "snapshot_integrity"])
def test_integrity_of_a_year_with_repeated_lines(spark, tmp_path, name):
    lines = f"SELECT * FROM '{SF}/lineitem.parquet' UNION ALL SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey % 3 = 0"
    assert same_as_sql(spark, name, tmp_path, lineitem=lines) > 50


@pytest.mark.parametrize("lines_a_task, least", [(10**9, 8), (1000, 12)])
def test_rows_of_a_year_are_dealt_by_their_number(spark, monkeypatch, lines_a_task, least):
    """Small compressed rows are not gathered in few tasks; more lines make more tasks."""
    from tessera.plans import roles

    monkeypatch.setattr(roles, "LINES_A_TASK", lines_a_task)
    for rows in roles.published_year(spark, SF, 1996):
        assert least <= rows.select(F.spark_partition_id().alias("p")).distinct().count() <= 15
