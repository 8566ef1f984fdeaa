"""Properties of single operators on small inputs."""

from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import currency, diff, extractors, inventory, processors, publication, reconcile, search
from tessera.sources import VersionedTable, config_rows, glob_regex, matches_rules, read_files, read_repositories
from tessera.streaming import assemblies, committed_scans, dedupe, publish, split_invalid


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_column_functions(spark):
    df = spark.createDataFrame([("A b/c!*'()~", "x/../y/./z", "a/b/c.TS", "One [two](u). Three.")], "k string, p string, f string, s string")
    got = df.select(
        fn.percent_encode(F.col("k")), fn.normal_path(F.col("p")), fn.extension(F.col("f")), fn.ancestors(F.col("f")), fn.first_sentence(F.col("s")), fn.is_safe_path(F.col("p")), fn.folder(F.col("f")), fn.unescape_pointer(fn.escape_pointer(F.col("p")))
    ).first()
    assert tuple(got) == ("A%20b%2Fc!*'()~", "y/z", ".ts", ["a/b", "a"], "One two.", False, "a/b", "x/../y/./z")


def test_glob_and_rules(spark):
    import re

    assert re.match(glob_regex("**/node_modules"), "a/b/node_modules") and not re.match(glob_regex("*.md"), "a/b.md")
    df = spark.createDataFrame([("src/a.ts",), ("src/node_modules/x.ts",), ("doc/a.md",)], "path string")
    rules = [{"include": ["src/**"], "exclude": ["**/node_modules"]}]
    assert rows(df.where(matches_rules(F.col("path"), rules))) == [("src/a.ts",)]


def test_files_and_repositories(spark, tmp_path):
    (tmp_path / "r/.git/refs/heads").mkdir(parents=True)
    (tmp_path / "r/.git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / "r/.git/refs/heads/main").write_text("a" * 40 + "\n")
    (tmp_path / "r/doc").mkdir()
    (tmp_path / "r/doc/a.MD").write_text("# A")
    (tmp_path / "r/doc/b.bin").write_text("x")
    found = read_files(spark, str(tmp_path), [".md"], (".git",)).select("path", "size_bytes", "text").collect()
    assert [tuple(r) for r in found] == [("r/doc/a.MD", 3, "# A")]
    assert [r.head for r in read_repositories(spark, str(tmp_path)).collect()] == ["a" * 40]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, "a")], "id int, v string"))
    t.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), ["id"])
    t.insert_absent(spark.createDataFrame([(2, "z"), (3, "d")], "id int, v string"), ["id"])
    t.delete(spark.createDataFrame([(1,)], "id int"), ["id"])
    assert rows(t.read()) == [(2, "c"), (3, "d")] and rows(t.read(1)) == [(1, "a")]


def test_config_rows(spark):
    import pytest

    assert config_rows(spark, {"sources": [{"id": "s", "root": "/x"}]}).count() == 1
    with pytest.raises(ValueError):
        config_rows(spark, {"sources": [{"id": "s", "root": "/x"}, {"id": "s", "root": "/y"}]})


def test_changes_reappear_as_added(spark):
    old = spark.createDataFrame([("a", "1", True), ("b", "1", False), ("c", "1", True)], "path string, fingerprint string, is_present boolean")
    new = spark.createDataFrame([("a", "2"), ("b", "1")], "path string, fingerprint string")
    got = {r.path: r.change for r in inventory.classify_changes(old, new, ["path"]).collect()}
    assert got == {"a": "modified", "b": "added", "c": "removed"}


def test_reconcile_replay_changes_nothing(spark):
    want = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, content string")
    none = spark.createDataFrame([], "key string, version_number int, status string, content string")
    first = reconcile.reconcile(none, want, "key").drop("action")
    again = reconcile.reconcile(first, want, "key")
    assert {r.action for r in again.collect()} == {"keep"} and rows(again.drop("action")) == rows(first)
    gone = reconcile.reconcile(first, want.where("key = 'a'"), "key")
    assert {(r.key, r.action, r.version_number) for r in gone.collect()} == {("a", "keep", 1), ("b", "supersede", 2)}


def test_diff_is_symmetric_and_empty_on_itself(spark):
    a = spark.createDataFrame([("x", "v1", "h1", "n", 1), ("y", "v2", "h2", "m", 1)], "id string, version_id string, content_hash string, name string, rank int")
    b = spark.createDataFrame([("x", "v3", "h3", "n", 2), ("z", "v4", "h4", "k", 1)], a.schema)
    assert {r.change for r in diff.compare(a, a, "id", ["name", "rank"]).collect()} == {"unchanged"}
    there = {r.id: (r.change, r.changed_fields) for r in diff.compare(a, b, "id", ["name", "rank"]).collect()}
    back = {r.id: r.change for r in diff.compare(b, a, "id", ["name", "rank"]).collect()}
    assert there == {"x": ("modified", ["rank"]), "y": ("removed", []), "z": ("added", [])}
    assert back == {"x": "modified", "y": "added", "z": "removed"}


def test_integrity_violations(spark):
    ents = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "publication_id int, entity_id string")
    edges = spark.createDataFrame([(1, "r1", "a", "b"), (1, "r2", "a", "gone"), (1, "r3", "b", "b")], "publication_id int, relationship_id string, source_id string, target_id string")
    got = {(r.object_id, r.problem) for r in publication.integrity_violations(ents, edges).collect()}
    assert got == {("a", "duplicate-entity"), ("r2", "missing-target"), ("r3", "self-edge")}


def test_search_modes(spark):
    import pytest

    df = spark.createDataFrame([("1", "alpha"), ("2", "alphabet"), ("3", "the alpha")], "entity_id string, name_normalized string")
    assert [len(search.search(df, "Alpha", how).collect()) for how in search.MATCHES] == [1, 2, 3]
    with pytest.raises(ValueError):
        search.match(F.col("name_normalized"), "", "contains")


def test_currency_worst_state(spark):
    df = spark.createDataFrame([("e", "CURRENT"), ("e", "UNKNOWN"), ("f", "UNKNOWN"), ("f", "STALE")], "object_id string, state string")
    assert rows(currency.worst_state(df, ["object_id"])) == [("e", "UNKNOWN"), ("f", "STALE")]


def doc(spark, path, text):
    return spark.createDataFrame([(1, path, text)], "document_id long, path string, text string")


def test_markdown_fence_and_headings(spark):
    text = "# A\n## B\ntext\n~~~\n# not a heading\n~~~\n# C\nlast\n\nStatus: Accepted"
    got = {r.key: (r.excerpt, r.locator.heading_path) for r in processors.process(doc(spark, "x.md", text)).collect()}
    assert got["markdown:4:code"] == ("~~~\n# not a heading\n~~~", ["A", "B"])
    assert got["markdown:8:paragraph"][1] == ["C"] and "markdown-metadata:10" in got


def test_json_and_rejects(spark):
    both = doc(spark, "package.json", '{"name": "n", "dependencies": {"a/b": "1"}, "x": [1.0, null, true]}').union(doc(spark, "bad.json", "{").withColumn("document_id", F.lit(2).cast("long")))
    got = {(r.document_id, r.key): r.excerpt for r in processors.process(both).collect()}
    assert got[1, "json:/dependencies/a~1b"] == "1" and got[1, "json:/x/0"] == "1" and got[1, "json:/x/1"] == "null"
    assert (2, "rejected") in got


def test_package_extractor(spark):
    docs = doc(spark, "p/package.json", '{"name": "app", "dependencies": {"left": "1"}, "devDependencies": {"@s/right": "2"}}')
    evidence = processors.process(docs).join(docs.select("document_id", "path"), "document_id")
    entities, edges, rejected = extractors.package_dependencies(evidence)
    assert {r.name for r in entities.collect()} == {"app", "left", "@s/right"}
    assert {(r.source, r.target) for r in edges.collect()} == {("app", "left"), ("app", "@s/right")} and rejected.count() == 0


def test_module_extractor(spark):
    docs = doc(spark, "root/src/a.ts", "import { x } from './lib/b';\nimport fs from 'node:fs';\nexport * from '../../../other/z';")
    evidence = processors.process(docs).join(docs.select("document_id", "path"), "document_id")
    _, edges = extractors.module_dependencies(evidence)
    assert {(r.source, r.target) for r in edges.collect()} == {("root/src/a", "root/src/lib/b"), ("root/src/a", "external:node:fs")}


def test_openapi_rejects_repeated_operation(spark):
    text = '{"openapi": "3.0.1", "info": {"title": "Shop"}, "paths": {"/a": {"get": {"operationId": "one"}}, "/b": {"get": {"operationId": "two"}, "post": {"operationId": "two"}}}}'
    docs = doc(spark, "api.json", text)
    evidence = processors.process(docs).join(docs.select("document_id", "path"), "document_id")
    entities, edges, rejected = extractors.openapi(evidence)
    assert {(r.source, r.target) for r in edges.collect()} == {("Shop", "one")} and {r.target for r in rejected.collect()} == {"two"}
    assert {r.name for r in entities.collect()} == {"Shop", "one"}


def test_links_and_decisions(spark):
    docs = spark.createDataFrame(
        [(1, "d/ADR-001-a.md", "# First\n\nWe decide. More.\n\nStatus: Accepted\n\nRelated decisions: ADR-002"), (2, "d/adr-002-b.md", "# Second"), (3, "d/x.md", "# X\n\n[y](y.md#top) [gone](gone.md) [web](https://a.b)"), (4, "d/y.md", "# Y")],
        "document_id long, path string, text string",
    )
    evidence = processors.process(docs).join(docs.select("document_id", "path"), "document_id")
    _, edges, lost = extractors.markdown_references(evidence, docs)
    assert {(r.source, r.target) for r in edges.collect()} == {("d/x.md", "d/y.md")} and lost.count() == 2
    entities, refs = extractors.decisions(evidence, docs)
    first = entities.where("decision = 'ADR-1' OR decision = 'ADR-001'").first()
    assert (first.title, first.summary, first.status) == ("First", "We decide.", "Accepted")
    assert {(r.source, r.target) for r in refs.collect()} == {("d/ADR-001-a.md", "d/adr-002-b.md")}


def test_static_paths_do_not_loop_and_truncate(spark):
    calls = spark.createDataFrame([("A.a", "B.b", 2, 0), ("A.a", "C.c", 1, 0), ("C.c", "A.a", 1, 0)], "caller string, target string, line int, call_index int")
    handlers = spark.createDataFrame([("GET /", "A.a")], "route string, handler string")
    steps = extractors.static_paths(handlers, calls)
    assert [r.target for r in steps.orderBy("position").collect()] == ["C.c", "A.a", "B.b"]
    assert [r.stopped for r in steps.orderBy("position").collect()] == [None, "repeated-method", None]
    assert extractors.static_paths(handlers, calls, most_steps=1).first().truncated
    journey = extractors.journeys(steps, "s").first()
    assert [(t["from"], t["to"]) for t in journey.transitions] == [("C.c", "A.a"), ("A.a", "B.b")]
    assert extractors.find_journeys(extractors.journeys(steps, "s"), "b.B").count() == 1


def test_assemblies_in_any_order(spark):
    import hashlib

    good = hashlib.sha256(b"xy").hexdigest()
    chunks = spark.createDataFrame([("s", 1, "y"), ("s", 0, "x"), ("s", 0, "x"), ("t", 0, "x"), ("u", 0, "x"), ("u", 0, "z")], "scan string, chunk_index int, checksum string")
    announced = spark.createDataFrame([("s", 2, good), ("t", 2, good), ("u", 1, good)], "scan string, expected_chunks int, checksum string")
    assert {r.scan: r.state for r in assemblies(chunks, announced, ["scan"]).collect()} == {"s": "complete", "t": "assembling", "u": "conflict"}


def test_streams_equal_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", "k1"), (2, "2024-01-01 00:01:00", "k1"), (3, "2024-01-01 00:02:00", "k2")], "event_id long, t string, k string").withColumn("t", F.to_timestamp("t"))
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    publish(dedupe(stream, "k", "t"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("k").distinct().count() == dedupe(events, "k", "t").count() == 2


def test_stream_supersedes_older_scans(spark, tmp_path):
    source = str(tmp_path / "in")
    scans = spark.createDataFrame([("s", "2024-01-02", "b", 1), ("s", "2024-01-01", "a", 2), ("s", "2024-01-03", "c", 3)], "src string, discovered_at string, scan_id string, completed_at int")
    scans.coalesce(1).write.parquet(source)
    stream = committed_scans(spark.readStream.schema(scans.schema).parquet(source), "src", "discovered_at", "scan_id")
    publish(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.scan_id: r.superseded for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": True, "b": False, "c": False}


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, "ok"), (2, None)], "event_id int, payload string")
    valid, dead = split_invalid(df, F.when(F.col("payload").isNull(), "empty"))
    assert valid.count() == 1 and dead.first().payload_bytes == 0


def test_repeated_rows_keep_their_definition_and_repository(spark):
    docs = spark.createDataFrame([(1, "a.md"), (1, "a.md"), (2, "x"), (3, None)], "id int, filename string")
    registry = spark.createDataFrame(processors.DEFINITIONS, "match_kind string, match string, processor_id string, extraction_rule_id string")
    got = sorted(map(str, ((r.id, r.processor_id, r.matches) for r in inventory.preferred_definition(docs, registry).collect())))
    assert got == sorted(map(str, [(1, "markdown", 1), (1, "markdown", 1), (2, None, 0), (3, None, 0)]))
    twice = inventory.preferred_definition(docs, registry.union(registry))
    assert {(r.id, r.processor_id, r.matches) for r in twice.collect()} == {(1, None, 2), (2, None, 0), (3, None, 0)}
    paths = spark.createDataFrame([("r/s/a",), ("r/s/a",), ("q",)], "path string")
    repos = spark.createDataFrame([("r",), ("r/s",)], "path string")
    assert sorted(map(str, map(tuple, inventory.owning_repository(paths, repos).collect()))) == sorted(map(str, [("r/s/a", "r/s"), ("r/s/a", "r/s"), ("q", None)]))


def test_large_json_is_kept_large_hocon_rejected(spark):
    import json as js

    text = js.dumps({f"k{i}": i for i in range(5000)})
    assert processors.process(doc(spark, "big.json", text)).count() == 5000
    many = "\n".join(f"k{i} = {i}" for i in range(2001))
    assert [r.kind for r in processors.process(doc(spark, "big.conf", many)).collect()] == ["rejected"]
    routes = "\n".join(f"GET /p{i} controllers.C.m{i}" for i in range(2001))
    assert [r.kind for r in processors.process(doc(spark, "app.routes", routes)).collect()] == ["rejected"]


def test_hocon_scopes_quotes_and_comments(spark):
    text = "a {\n  b.c = 1 # one\n  'd' = 'x # y' // z\n  \"e.f\" : true\n  g = [\n    1\n  ]\n  h = { i = 1 }\n  u = \"http://h/p\"\n  v = http://h\n}\nk = ${a.b} \nm = ${?a} tail\nn = \"\"\"x\ny\"\"\"\nlast = off on"
    got = {r.excerpt: (r.locator.line_start, r.locator.value_kind) for r in processors.process(doc(spark, "x.conf", text)).collect()}
    assert got["a.b.c = 1"] == (2, "number") and got["a.e.f = true"] == (4, "boolean") and got["k = ${a.b}"] == (12, "substitution")
    assert got["a.u = \"http://h/p\""] == (9, "string") and got["a.g = <unsupported>"][0] == 5 and got["a.h = <unsupported>"][0] == 8
    assert got["m = <unsupported>"][1] == got["last = <unsupported>"][1] == "unsupported" and "a.v = http:" in got


def test_currency_of_absent_and_foreign_pointers(spark):
    support = spark.createDataFrame([("e", i, f"d{i}", f"v{i}") for i in range(6)], "object_type string, object_id int, document_id string, version_id string")
    versions = spark.createDataFrame([(f"v{i}", f"d{i}", f"h{i}") for i in range(6)], "version_id string, document_id string, content_hash string")
    pointers = spark.createDataFrame([("d0", False, None), ("d1", True, None), ("d2", False, "v2"), ("d3", True, "v2"), ("d4", True, "v4")], "document_id string, is_present boolean, current_version_id string")
    got = {r.object_id: (r.state, r.reason) for r in currency.classify_support(support, pointers, versions).collect()}
    assert got == {
        0: ("UNKNOWN", "DOCUMENT_REMOVED"), 1: ("UNKNOWN", "CURRENT_VERSION_UNAVAILABLE"), 2: ("UNKNOWN", "CURRENT_VERSION_UNRESOLVABLE"),
        3: ("UNKNOWN", "CURRENT_VERSION_UNRESOLVABLE"), 4: ("CURRENT", None), 5: (None, "BROKEN_HISTORY"),
    }


def test_static_paths_enter_a_method_once_on_ladders_of_diamonds(spark):
    rungs = [(f"m{i}", f"m{i + step}", step, 0) for i in range(12) for step in (1, 2)]
    calls = spark.createDataFrame(rungs, "caller string, target string, line int, call_index int")
    handlers = spark.createDataFrame([("GET /", "m0")], "route string, handler string")
    rows = extractors.static_paths(handlers, calls).orderBy("position").collect()
    assert [r.target for r in rows[:8]] == [f"m{i}" for i in range(1, 9)]
    assert rows[7].stopped == "depth-limit" and max(r.depth for r in rows) == 8
    # m8 is first met at the limit and entered from m6, the deepest method that is not at the limit.
    entered = [r.target for r in rows if r.stopped is None]
    assert len(entered) == len(set(entered)) and len(rows) < 30


def test_publish_only_on_change_and_diffs_verify(spark):
    from tessera.operators import diff, reconcile

    members = spark.createDataFrame([("a", "k1", "x"), ("b", "k1", "x"), ("c", "k1", "x")], "model string, key string, content string")
    none = spark.createDataFrame([], "model string, version int, content_hash string")
    first = reconcile.publish(members, none, "model", "key", F.col("content"))
    assert {(r.model, r.version) for r in first.collect()} == {("a", 1), ("b", 1), ("c", 1)}
    later = members.where("model <> 'b'").unionByName(spark.createDataFrame([("b", "k1", "y")], members.schema))
    again = reconcile.publish(later, first, "model", "key", F.col("content"))
    assert [(r.model, r.version) for r in again.collect()] == [("b", 2)]
    changes = spark.createDataFrame([("k", "modified", ["f"])], "key string, change string, changed_fields array<string>")
    kept = diff.stored(changes, "key", 1, 2)
    other = diff.stored(changes.withColumn("change", F.lit("removed")), "key", 1, 2)
    assert diff.verify(kept, kept).first().state == "valid" and diff.verify(kept, other).first().state == "corrupt"
    assert diff.verify(kept, kept.limit(0)).first().state == "not-computed"
