"""Edge cases of submissions, repair and what readers see."""

from pyspark.sql import functions as F

from tessera.operators import presentation, search, submissions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_bounds_at_their_edges(spark):
    cases = [(1, "a", "a", 900_000, 100_000), (2, "a", "a", 900_001, 1), (3, "a", "a", 1, 100_001), (4, "a", "b", 1, 1), (5, None, "b", 1, 1)]
    df = spark.createDataFrame(cases, "id int, fingerprint string, content_hash string, n_bytes long, evidence_count long")
    assert rows(submissions.bounds(df).select("id", "problem")) == [(1, None), (2, "too-large"), (3, "too-much-evidence"), (4, "content-changed"), (5, "content-changed")]


def test_scopes(spark):
    cases = [("module", "external:x", "r/a", True), ("module", "external:", "r/a", False), ("part", "external:x", "r/a", False), ("part", "r/a/b", "r/a", True), ("part", "r//b", "r/a", False), ("part", "r\\b", "r/a", False), ("part", "r/..", "r/a", False), ("part", None, "r/a", False)]
    df = spark.createDataFrame(cases, "kind string, scope string, path string, expected boolean")
    assert df.where(submissions.valid_scope(F.col("kind"), F.col("scope"), F.col("path")) != F.col("expected")).count() == 0


def test_repair_of_every_state(spark):
    pointers = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 4), (4, "d", 0), (6, None, 0)], "document_id long, version_id string, revision int")
    eligible = spark.createDataFrame([(1, "a"), (1, "a2"), (2, "b2"), (3, "c"), (3, "c"), (4, "d1"), (4, "d2"), (5, "e"), (7, "f"), (7, "g")], "document_id long, version_id string")
    expected = [(1, "a", 1), (2, "b2", 3), (3, "c", 5), (4, None, 1), (5, "e", 1), (6, None, 0)]
    assert rows(submissions.repair_authority(pointers, eligible)) == expected


def test_cursors_round_trip_and_refuse(spark):
    values = ['{"a":1}', "é–ü", "x" * 200, "??>>"]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("c", presentation.encode_cursor(F.col("v")))
    assert df.where(presentation.decode_cursor(F.col("c")).eqNullSafe(F.col("v"))).count() == len(values)
    bad = spark.createDataFrame([("a",), ("YR",), ("YQ==",), ("",), ("a b",), ("_w",), (None,)], "c string")
    assert bad.where(presentation.decode_cursor(F.col("c")).isNotNull()).count() == 0


def test_packs_by_extractor_then_pointer_then_processor(spark):
    cases = [("openapi-operations", "text", None, "openapi"), ("other", "json", "/paths/x", "openapi"), ("other", "json", "/version", "typescript"), ("other", "json", None, None), ("other", "dockerfile", None, "typescript"), ("other", "text", None, None), ("markdown-references", "json", "/info", "markdown")]
    df = spark.createDataFrame(cases, "e string, p string, q string, expected string")
    assert df.where(~presentation.pack_of(F.col("e"), F.col("p"), F.col("q")).eqNullSafe(F.col("expected"))).count() == 0


def test_compatibility_names_are_searchable(spark):
    entities = spark.createDataFrame([(1, "e1", "api", "ＡＰＩ Gateway"), (1, "e2", "api", None)], "publication_id int, entity_id string, type string, name string")
    edges = spark.createDataFrame([], "publication_id int, relationship_id string, source_id string, target_id string")
    projected = search.project_entities(entities, edges, presentation.normalized)
    assert [r.entity_id for r in search.search(projected, "ａｐｉ g", "prefix").collect()] == ["e1"]


def test_previews_of_short_and_long_journeys(spark):
    steps = spark.createDataFrame([("a", n, f"s{n}") for n in range(7)] + [("b", 0, "only")], "k string, n int, label string")
    expected = [("a", 7, ["s0", "s1", "s2", "s3", "s4"], True), ("b", 1, ["only"], False)]
    assert rows(presentation.journey_previews(steps, "k", ["n"], "label")) == expected


def test_paths_and_locators(spark):
    df = spark.createDataFrame([("root/repo/a/b.ts", None, 3, 3), ("alone", "/x", 1, 2), ("r/x", None, 1, 4)], "path string, q string, a int, b int")
    found = df.select(presentation.shown_path(F.col("path")), presentation.repository_of_path(F.col("path")), presentation.locator_text(F.col("q"), F.col("a"), F.col("b")))
    assert [tuple(r) for r in found.collect()] == [("repo/a/b.ts", "repo", "line 3"), ("alone", "alone", "JSON pointer /x"), ("x", "x", "lines 1–4")]
