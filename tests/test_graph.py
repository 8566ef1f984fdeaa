"""Graph publication and journeys at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, journey_graph

AT = "source_id string, repository string, "


def rows(spark, schema, data):
    return spark.createDataFrame([("s", "r", *d) for d in data], AT + schema)


def resolve(spark, expression, values=(), parameters=(("config", "A", "x.ServicesConfig", "p"),), methods=(), injected=(), sites=()):
    symbols = rows(spark, "kind string, symbol string, owner string, signature string, evidence_id string", [("value", s, "A", e, f"v{i}") for i, (s, e) in enumerate(values)] + [("constructor-parameter", *p) for p in parameters] + [("method", s, "A", g, e) for s, g, e in methods])
    dependencies = rows(spark, "source string, target string, parameter string, evidence_id string", list(injected))
    call_sites = rows(spark, "enclosing string, receiver string, target_text string, excerpt string, evidence_id string", list(sites))
    starts = rows(spark, "id string, owner string, expression string", [("i", "A", expression)])
    found = graph.resolve_values(starts, symbols, dependencies, call_sites).collect()
    assert len(found) <= 1
    return (found[0].name, found[0].evidence) if found else None


LOOKUP = 'config.baseUrl("svc")'


@pytest.mark.parametrize(
    ("expression", "options", "expected"),
    [
        (LOOKUP, {}, ("svc", ["p"])),
        (LOOKUP, {"parameters": [("config", "A", "Other", "p")]}, None),
        ("this.a", {"values": [("A.a", LOOKUP)]}, ("svc", ["v0", "p"])),
        ("a", {"values": [("A.a", LOOKUP), ("A.a", LOOKUP)]}, None),
        ("a", {"values": [("A.a", "b"), ("A.b", "this.a")]}, None),
        ('s"${a}/x"', {"values": [("A.a", 's"$b"'), ("A.b", LOOKUP)]}, ("svc", ["v0", "v1", "p"])),
        ("a", {"values": [(f"A.{'abcdefg'[i]}", "bcdefg"[i] if i < 6 else LOOKUP) for i in range(7)]}, ("svc", [*[f"v{i}" for i in range(7)], "p"])),
        ("a", {"values": [(f"A.{'abcdefgh'[i]}", "bcdefgh"[i] if i < 7 else LOOKUP) for i in range(8)]}, None),
        ("x.u", {"values": [("B.u", LOOKUP)], "injected": [("A", "B", "x", "d")], "parameters": [("config", "B", "ServicesConfig", "p")]}, ("svc", ["v0", "d", "p"])),
        ("x.u", {"values": [("B.u", LOOKUP)], "injected": [("A", "B", "x", "d"), ("A", "B", "x", "e")], "parameters": [("config", "B", "ServicesConfig", "p")]}, None),
    ],
)
def test_values_name_services(spark, expression, options, expected):
    assert resolve(spark, expression, **options) == expected


def test_wrappers_name_services(spark):
    method, site = ("A.baseUrl", "def baseUrl(n: String): String =", "m"), ("A.baseUrl", "config", "config.baseUrl", "config\n.baseUrl(n)", "w")
    assert resolve(spark, 'baseUrl("svc")', methods=[method], sites=[site]) == ("svc", ["m", "w", "p"])
    assert resolve(spark, 'baseUrl("svc")', methods=[method], sites=[site, site]) is None
    assert resolve(spark, 'baseUrl("svc")', methods=[method, method], sites=[site]) is None
    assert resolve(spark, 'baseUrl("svc")', methods=[method], sites=[site], values=[("A.baseUrl.config", "x")]) is None
    assert resolve(spark, 'baseUrl("svc")', methods=[("A.baseUrl", "def baseUrl(n: Int) =", "m")], sites=[site]) is None


def test_merge_takes_the_strongest_role(spark):
    entities = spark.createDataFrame([("k", "api", "n", "s", "r", role, e) for role, e in (("downstream-system", "1"), ("declared-service", "2"), ("downstream-system", "2"))], "key string, type string, name string, source_id string, repository string, role string, evidence_id string")
    edges = spark.createDataFrame([("USES", "a", "b", x, e) for x, e in (("CALLS", "1"), ("IMPLEMENTED_BY", "1"), ("CALLS", "2"))], "type string, source_key string, target_key string, relation string, evidence_id string")
    one, two = graph.merge(entities, edges)
    assert [tuple(r) for r in one.collect()] == [("k", "api", "n", "declared-service", 2)] and [tuple(r) for r in two.collect()] == [("USES:a->b", "USES", "a", "b", 2)]


def test_published_references(spark):
    entities = spark.createDataFrame([("a", "ida", "api", "A"), ("b", "idb", "module", "B")], "entity_key string, entity_id string, type string, name string")
    found, lost = journey_graph.resolve_references(spark.createDataFrame([("j", 1, "a"), ("j", 2, "zz"), ("j", 3, "zz")], "journey_key string, position int, entity_key string"), entities)
    assert [(r.entity_id, r.entity_type, r.display_name) for r in found.collect()] == [("ida", "api", "A")] and [tuple(r) for r in lost.collect()] == [("j", "unavailable-entity", "zz")]
    published = spark.createDataFrame([("r1", "i1", "USES", "a", "b"), ("r2", "i2", "USES", "a", "gone")], "relationship_key string, relationship_id string, type string, source_key string, target_key string")
    asked = spark.createDataFrame([("j", "r1", "USES"), ("j", "r1", "CONSUMES"), ("j", "r2", "USES"), ("j", "r3", "USES")], "journey_key string, relationship_key string, type string")
    found, lost = journey_graph.resolve_relationships(asked, published, entities)
    assert [(r.relationship_id, r.source_entity_id, r.target_display_name) for r in found.collect()] == [("i1", "ida", "B")]
    assert sorted(r.object for r in lost.collect()) == ["r1", "r2", "r3"]


def sizes(spark, pieces, **bounds):
    df = spark.createDataFrame([("j", *p) for p in pieces], "journey_key string, at int, chars long, bytes long")
    step = F.concat(F.lit("s"), (F.col("kept") + 1).cast("string"))
    return journey_graph.kept_steps(df, journey_graph.size_boundary(step, F.lit("e")), **bounds).first()


def test_journeys_keep_what_fits(spark):
    pieces = [(0, 100, 100), (1, 50, 50), (2, 50, 50), (2, 30, 30), (3, 900, 950)]
    told = json.dumps({"key": "s3:publication-size-limit", "reason": "journey-publication-size-limit:1-steps-omitted", "target": "s3", "evidenceRef": "e"}, separators=(",", ":"))
    whole = sizes(spark, pieces, max_chars=1130, max_bytes=1180)
    assert (whole.steps, whole.kept, whole.omitted, whole.chars, whole.bytes) == (3, 3, 0, 1130, 1180)
    short = sizes(spark, pieces, max_chars=1130, max_bytes=1179)
    assert (short.kept, short.omitted, short.chars) == (2, 1, 230 + 2 * len(told))
    assert sizes(spark, pieces, max_chars=230 + 2 * len(told), max_bytes=5000).kept == 2
    assert sizes(spark, pieces, max_chars=229 + 2 * len(told), max_bytes=5000).kept == 1
    assert sizes(spark, pieces, max_chars=120, max_bytes=5000).kept is None
    assert sizes(spark, [(0, 10, 10)], max_chars=10, max_bytes=10).kept == 0


def test_cut_rows_follow_their_last_step(spark):
    kept = spark.createDataFrame([("j", 2), ("x", None)], "journey_key string, kept int")
    transitions = spark.createDataFrame([("j", 1, 2), ("j", 2, 3), ("x", 1, 2)], "journey_key string, a int, b int")
    stays, goes = journey_graph.cut(transitions, kept, F.greatest("a", "b"))
    assert [tuple(r) for r in stays.collect()] == [("j", 1, 2)] and sorted(tuple(r) for r in goes.collect()) == [("j", 2, 3), ("x", 1, 2)]


def test_facts_are_sorted_not_broadcast(spark):
    """small files would be broadcast through the driver at many times their size; only the providers' names may be."""
    from tessera.plans import graphs

    told = graph.publish_analysis(graphs._facts(spark, "/root/testdata/sf0.001"))[2]
    assert told._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 1


def test_what_journeys_use_is_distinct_without_aggregation(spark):
    """references times evidence never meet in one aggregation; repeated inputs still make one edge."""
    at = lambda schema, *data: spark.createDataFrame(list(data), schema)
    _, edges, _, _ = journey_graph.link_journeys(
        at("journey_key string, name string, source_id string, scope string", ("j", "n", "s", "r/journey/n")),
        at("journey_key string, evidence_id string, source_id string, path string", ("j", "e", "s", "r/a"), ("j", "e", "s", "r/a"), ("j", "e", "s", "r/b"), ("j", "f", "s", "r/a")),
        at("journey_key string, entity_key string, role string", ("j", "m", "component"), ("j", "m", "controller"), ("j", "m", "service")),
        at("journey_key string, position int, step_id string, step_type string, entity_key string", ("j", 1, "x", "MethodStep", "m")),
        at("journey_key string, position int, evidence_id string", ("j", 1, "e")),
        at("type string, source_key string, target_key string, relation string, evidence_id string"),
        at("key string, type string, name string, source_id string, repository string, role string, evidence_id string"),
    )
    found = [tuple(r) for r in edges.collect()]
    assert len(found) == len(set(found))
    assert sorted((r[3], r[4]) for r in found if r[0] == "USES") == [(x, e) for x in ("JOURNEY_PARTICIPATES_IN_SERVICE", "JOURNEY_REFERENCES") for e in "ef"]
    assert edges._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
