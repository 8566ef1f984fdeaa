"""Published journeys, currency pages, merged provenance and upserts at their edges."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import currency, journeys, reconcile, upserts

SCHEMA = "publication_id long, entity_id string, type string, name string, evidence_ids array<string>, provenance array<struct<facts:map<string,string>>>"
ID = hashlib.sha256(b"j").hexdigest()


def entity(key="e1", published=True):
    return {"role": "api", "label": "L", **({"entityId": key, "entityType": "api", "displayName": "D"} if published else {"entityKey": key})}


def step(kind="ServiceStep", n=0, **more):
    needs = {f: f"{f}{n}" for f in journeys.STEP_NEEDS.get(kind, [])}
    return {"id": f"s{n}", "type": kind, "order": "entry", "evidenceBasis": "proven", "provenance": [], **needs, **more}


def model(**changes):
    whole = {
        "id": ID, "name": "J", "sourceServices": ["billing"], "confidence": "proven", "completeness": "complete", "provenance": [], "steps": [], "transitions": [], "entityReferences": [], "relationshipReferences": [], "unresolvedBoundaries": [], **changes,
    }
    return json.dumps({k: v for k, v in whole.items() if v is not ...})


def row(text, key="a", publication=1, name="J", journey_id=ID, type="journey", evidence=("x",)):
    found = [{"facts": {"journeyJson": t, "journeyId": journey_id}} for t in ([text] if isinstance(text, str) else text)]
    return (publication, key, type, name, list(evidence), found)


def read(spark, *rows):
    return journeys.read_journeys(spark.createDataFrame(list(rows), SCHEMA))


SOUND = [
    model(), model(description="d", diagnostics=[]), model(steps=[step(k, i) for i, k in enumerate(journeys.STEP_NEEDS)]), model(entityReferences=[entity(), entity(published=False)]),
    model(relationshipReferences=[{"type": "USES", "relationshipKey": "k"}, {"type": "USES", "relationshipId": "r", "sourceEntityId": "a", "targetEntityId": "b"}]),
    model(transitions=[{"id": "t", "type": "RouteDispatch", "from": "s0", "to": "s1", "order": "entry", "provenance": [], "certainty": "proven"}]),
]
UNSOUND = [
    "", "{", "null", "[]", "7", '"x"', model(id="J"), model(id=ID.upper()), model(name=""), model(steps=...), model(steps=None), model(transitions=...), model(confidence="unresolved"), model(completeness="whole"), model(extra=1), model(sourceServices="billing"),
    model(sourceServices=[None]), model(steps=[step("OtherStep")]), model(steps=[step(route="r", kind="HttpRouteStep", method=None)]), model(steps=[step(order="first")]), model(steps=[step(provenance=None)]), model(steps=[step(), None]),
    model(steps=[step(subject={"role": "api", "label": "L"})]), model(entityReferences=[{**entity(), "role": "owner"}]), model(entityReferences=[{"role": "api", "label": "L", "entityId": "e"}]), model(relationshipReferences=[{"type": "USES", "relationshipId": "r"}]),
    model(provenance=[{"id": "", "kind": "evidence", "label": ""}]), model(provenance=[{"id": "p", "kind": "page", "label": ""}]), model(unresolvedBoundaries=[{"key": "k", "reason": "r"}]), model(diagnostics=[{"key": "", "reason": "r", "target": "t"}]),
    model(transitions=[{"id": "t", "type": "Jump", "from": "a", "to": "b", "order": "entry", "provenance": [], "certainty": "proven"}]),
]


def test_models_are_checked(spark):
    rows = [row(m, f"s{i}") for i, m in enumerate(SOUND)] + [row(m, f"u{i:02}") for i, m in enumerate(UNSOUND)]
    good, bad = read(spark, *rows)
    assert sorted(r.journey_entity_id for r in good.collect()) == [f"s{i}" for i in range(len(SOUND))]
    told = {r.object_id: r.problem for r in bad.collect()}
    # An empty text is no model at all.
    assert told == {f"u{i:02}": "not-one-model" if i == 0 else "invalid-model" for i in range(len(UNSOUND))}


def test_models_must_be_one_and_the_entity_s_own(spark):
    lists = spark.createDataFrame([(1, "null", "journey", "J", None, None)], SCHEMA)
    rows = spark.createDataFrame([row([model(), model()], "two"), row([], "none"), row(model(name="K"), "name"), row(model(), "id", journey_id="other"), row(model(), "fact", journey_id=None), row(["", model()], "one"), row("{", "api", type="api")], SCHEMA).unionByName(lists)
    good, bad = journeys.read_journeys(rows.withColumn("_corrupt", F.lit(1)).withColumn("model", F.lit(2)))
    assert [r.journey_entity_id for r in good.collect()] == ["one"]
    assert {r.object_id: r.problem for r in bad.collect()} == {"two": "not-one-model", "none": "not-one-model", "null": "not-one-model", "name": "other-model", "id": "other-model", "fact": "other-model"}
    empty = read(spark, *[row(model(), type="api")])
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_references_are_pinned(spark):
    relation = {"type": "USES", "relationshipId": "r", "sourceEntityId": "a", "targetEntityId": "b", "publicationId": "0"}
    source = [{"id": "p", "kind": "evidence", "label": "", "documentEntityId": "d"}, {"id": "q", "kind": "evidence", "label": "", "publicationId": "kept"}]
    hop = {"id": "t", "type": "RouteDispatch", "from": "a", "to": "b", "order": "entry", "certainty": "proven", "provenance": source, "fromSubject": entity(), "toSubject": entity(published=False), "relationshipReferences": [relation]}
    text = model(steps=[step(subject=entity(), provenance=source, entityReferences=[entity(published=False), entity()]), step()], transitions=[hop], entityReferences=[entity()], relationshipReferences=[relation, {"type": "USES", "relationshipKey": "k"}], provenance=source)
    found = journeys.pinned(read(spark, row(text, publication=9))[0]).first().model
    to = lambda items: [i.publicationId for i in items]
    first, second = found.steps
    assert first.subject.publicationId == "9" and to(first.provenance) == ["9", "kept"] and to(first.entityReferences) == [None, "9"] and second.subject is None and second.entityReferences is None
    (jump,) = found.transitions
    assert jump.fromSubject.publicationId == "9" and jump.toSubject.publicationId is None and to(jump.provenance) == ["9", "kept"] and to(jump.relationshipReferences) == ["9"] and jump.entityReferences is None
    assert to(found.entityReferences) == ["9"] and to(found.relationshipReferences) == ["9", None] and to(found.provenance) == ["9", "kept"]


def test_journeys_are_searched_by_one_text_and_paged(spark):
    rows = [row(model(steps=[step("ConnectorStep", i)], entityReferences=[{**entity(), "label": "Ledger"}] if i % 2 else []), f"k{i}", publication=1 + i // 4) for i in range(6)]
    good, _ = read(spark, *rows)
    stored = journeys.project_journeys(good)
    ids = lambda **given: sorted(r.journey_entity_id for r in journeys.search_journeys(stored, good, **given).collect())
    assert ids() == [f"k{i}" for i in range(6)] and ids(publication=2) == ["k4", "k5"] and ids(connector="CONNECTOR3") == ["k3"]
    assert ids(api="ledger", publication=1) == ["k1", "k3"] and ids(service="billing", after="k1", limit=2) == ["k2", "k3", "k4"] and ids(query=ID) == ids() and ids(query="absent") == []
    with pytest.raises(ValueError):
        ids(query="a", api="b")
    with pytest.raises(ValueError):
        ids(query="")


def test_journeys_are_found_by_id(spark):
    other = hashlib.sha256(b"k").hexdigest()
    good, _ = read(spark, row(model(), "a"), row(model(), "b"), row(model(id=other), "c", journey_id=other), row(model(id=other), "d", journey_id=other, publication=2))
    asked = spark.createDataFrame([(1, ID), (1, ID), (1, other), (2, ID), (2, other), (1, "x"), (1, None)], "publication_id long, journey_id string")
    found = {(r.publication_id, r.journey_id): (r.state, r.journey_entity_id) for r in journeys.find_journeys(good, asked).collect()}
    assert found == {(1, ID): ("ambiguous", None), (1, other): ("found", "c"), (2, ID): ("missing", None), (2, other): ("found", "d"), (1, "x"): ("invalid", None), (1, None): ("invalid", None)}


def test_previews_show_the_first_and_count_all(spark):
    source = [{"id": f"p{i}", "kind": "evidence", "label": ""} for i in range(4)]
    notes = [{"key": f"k{i}", "reason": "r", "target": "t"} for i in range(7)]
    text = model(steps=[step(n=i, subject=entity(), provenance=source, branchContext="b") for i in range(6)], provenance=source, unresolvedBoundaries=notes, entityReferences=[entity(), entity("k", False)])
    good, _ = read(spark, row(text, "long", evidence="abcd"), row(model(steps=[step()]), "short", evidence=()))
    seen = {r.journey_entity_id: r for r in journeys.compact_journeys(journeys.pinned(good)).collect()}
    long, short = seen["long"], seen["short"]
    assert long.step_count == 6 and long.steps_truncated and [s.id for s in long.step_preview] == [f"s{i}" for i in range(5)] and "branchContext" not in long.step_preview[0]
    assert [p.id for p in long.step_preview[0].provenance] == ["p0", "p1", "p2"] and long.step_preview[0].provenanceReferenceCount == 4 and long.step_preview[0].service == "service0"
    assert long.evidence_preview == ["a", "b", "c"] and long.evidence_count == 4 and long.provenance_count == 4 and len(long.provenance) == 3
    assert len(long.boundaries) == 5 and long.boundary_count == 7 and long.diagnostics == [] and long.diagnostic_count == 0
    known, legacy = long.entity_references
    assert (known.entityId, known.label, known.publicationId) == ("e1", None, "1") and (legacy.entityKey, legacy.label, legacy.publicationId) == ("k", "L", None)
    assert short.step_count == 1 and not short.steps_truncated and short.step_preview[0].subject is None and short.evidence_count == 0 and short.evidence_preview == []


def test_currency_pages_refuse_other_bases_and_listings(spark):
    rows = spark.createDataFrame([(t, i, s) for t in ("entity", "relationship") for i, s in (("a", "STALE"), ("b", "CURRENT"), ("c", "STALE"))], "object_type string, object_id string, state string")
    page = lambda cursor=None, **given: [(r.object_type, r.object_id, r.cursor) for r in currency.details_page(rows, given.pop("publication", "p"), given.pop("basis", "h"), cursor, **given).collect()]
    seen, cursor = [], None
    while True:
        found = page(cursor, limit=2)
        seen += [f[:2] for f in found[:2]]
        if len(found) < 3:
            break
        cursor = found[1][2]
    assert seen == [(t, i) for t in ("entity", "relationship") for i in "abc"]
    (_, first, *_), stale = (r[2] for r in page()), page(state="STALE", object_type="relationship")
    assert [r[:2] for r in stale] == [("relationship", "a"), ("relationship", "c")] and [r[1] for r in page(stale[0][2], state="STALE", object_type="relationship")] == ["c"]
    with pytest.raises(currency.BasisChanged):
        page(first, basis="moved")
    for cursor, given in ((first, {"publication": "q"}), (first, {"state": "STALE"}), (stale[0][2], {}), (stale[0][2], {"state": "CURRENT", "object_type": "relationship"}), (first + "=", {}), ("e30", {}), ("!", {}), (first[:-1], {}), ("", {})):
        with pytest.raises(ValueError):
            page(cursor, **given)
    for given in ({"limit": 0}, {"limit": 101}, {"state": "OLD"}):
        with pytest.raises(ValueError):
            page(**given)


def test_provenance_is_united_unless_it_conflicts(spark):
    schema = "key string, type string, name string, evidence_ids array<string>, confidence double, provenance array<struct<evidence_id:string,facts:map<string,string>>>"
    said = lambda *pairs: [{"evidence_id": e, "facts": f} for e, f in pairs]
    rows = [
        ("a", "t", "n2", ["y"], 0.2, said(("y", {"p": "1", "q": "2"}))), ("a", "t", "n1", ["x", "y"], 0.9, said(("y", {"q": "2", "p": "1"}), ("x", None))),
        ("b", "t", "n", ["y"], 0.1, said(("y", {"p": "1"}))), ("b", "t", "n", ["y"], 0.1, said(("y", {"p": "2"}))), ("c", "t", "n", [], 0.5, None),
    ]
    merged, conflicts = reconcile.merge_described(spark.createDataFrame(rows, schema), "key")
    found = {r.key: r for r in merged.collect()}
    assert set(found) == {"a", "c"} and found["a"].name == "n1" and found["a"].evidence_ids == ["x", "y"] and found["a"].confidence == 0.9
    assert [(p.evidence_id, p.facts) for p in found["a"].provenance] == [("x", None), ("y", {"p": "1", "q": "2"})] and found["c"].provenance == []
    assert [tuple(r) for r in conflicts.collect()] == [("b", "y")]
    assert reconcile.merge_described(spark.createDataFrame([], schema), "key")[0].count() == 0


def test_upserts_change_only_what_differs(spark):
    schema = "id int, part string, v string, at int"
    stored = spark.createDataFrame([(1, "a", "x", 1), (1, "b", None, 1), (2, "a", "y", 1), (3, "a", None, 1), (None, "a", "n", 1)], schema)
    rows = spark.createDataFrame([(1, "a", "x", 2), (1, "b", None, 2), (2, "a", "z", 2), (3, "a", "w", 2), (4, "a", None, 2), (None, "a", "n", 2)], schema)
    told = lambda compare: sorted(((r.id, r.part, r.v, r.at, r.change) for r in upserts.upserted(stored, rows, ["id", "part"], compare).collect()), key=str)
    guarded = [(1, "a", "x", 1, "unchanged"), (1, "b", None, 1, "unchanged"), (2, "a", "z", 2, "updated"), (3, "a", "w", 2, "updated"), (4, "a", None, 2, "inserted"), (None, "a", "n", 1, "kept"), (None, "a", "n", 2, "inserted")]
    assert told(["v"]) == sorted(guarded, key=str)
    assert set(told(None)) == {(i, p, v, 2 if c == "unchanged" else t, "updated" if c == "unchanged" else c) for i, p, v, t, c in guarded}
    assert [(r.id, r.part, r.n) for r in upserts.repeated_keys(rows.unionByName(rows.where("id = 4")), ["id", "part"]).collect()] == [(4, "a", 2)]
    assert upserts.upserted(stored, rows.limit(0), ["id", "part"]).where("change <> 'kept'").count() == 0
