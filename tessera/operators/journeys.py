"""Reads of published journeys: their models checked and pinned, searched by text, looked up by id, previewed.

A journey is a published entity of type ``journey`` whose provenance carries its model as JSON.  ``published`` has
(publication_id, entity_id, type, name, evidence_ids, provenance), provenance an array of structs with ``facts``, a map of texts.
Everything is a column expression over one row: nothing is shuffled but for pages and lookups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .presentation import PROVENANCE_SHOWN, STEPS_SHOWN
from .publication import page
from .search import match

# The parts of a journey's model, and what its steps must say by type.
_ENTITY = "struct<entityKey:string,role:string,label:string,entityId:string,entityType:string,displayName:string,publicationId:string>"
_RELATION = "struct<relationshipKey:string,type:string,relationshipId:string,sourceEntityId:string,targetEntityId:string,sourceDisplayName:string,targetDisplayName:string,publicationId:string>"
_SOURCE = "struct<id:string,kind:string,label:string,source:string,documentPath:string,documentId:string,documentVersionId:string,documentEntityId:string,publicationId:string>"
_NOTE = "struct<key:string,reason:string,target:string,evidenceRef:string>"
_STEP_TEXTS = ["method", "route", "controller", "service", "component", "connector", "target", "targetExpression"]
_STEP = (
    "struct<id:string,type:string,`order`:string,evidenceBasis:string,evidenceRef:string,reason:string,entityKey:string,stepEntityKey:string,stepEntityId:string,branchContext:string,asyncGroup:string,"
    + ",".join(f"{t}:string" for t in _STEP_TEXTS) + f",subject:{_ENTITY},entityReferences:array<{_ENTITY}>,provenance:array<{_SOURCE}>>"
)
_TRANSITION = f"struct<id:string,type:string,`from`:string,`to`:string,fromSubject:{_ENTITY},toSubject:{_ENTITY},evidenceRef:string,`order`:string,certainty:string,provenance:array<{_SOURCE}>,entityReferences:array<{_ENTITY}>,relationshipReferences:array<{_RELATION}>>"
MODEL = (
    f"id string, name string, description string, sourceServices array<string>, confidence string, completeness string, provenance array<{_SOURCE}>, steps array<{_STEP}>, transitions array<{_TRANSITION}>, "
    f"entityReferences array<{_ENTITY}>, relationshipReferences array<{_RELATION}>, unresolvedBoundaries array<{_NOTE}>, diagnostics array<{_NOTE}>"
)
STEP_NEEDS = {
    "HttpRouteStep": ["method", "route"], "ControllerStep": ["controller"], "ServiceStep": ["service"], "ComponentStep": ["component"], "ConnectorStep": ["connector", "service"],
    "HttpClientCallStep": ["targetExpression", "method"], "ApiCallStep": ["target"], "UnresolvedCallStep": ["targetExpression", "reason"], "PersistenceStep": ["target"],
}
ROLES = ["operation", "controller", "service", "connector", "component", "api", "document", "step"]
KINDS = ["evidence", "source-file", "publication", "service", "api", "connector", "relationship"]
ORDERS = ["entry", "source-order", "conditional", "grouped"]
CERTAINTIES = ["proven", "derived", "unresolved"]
TRANSITIONS = ["RouteDispatch", "MethodInvocation", "ConnectorInvocation", "HttpRequest", "PersistenceOperation"]
#: Fields of a step that a preview shows beside its id, type, order, subject, references and provenance.
STEP_SHOWN = ["route", "controller", "service", "component", "connector", "target", "targetExpression", "method", "reason", "evidenceBasis", "evidenceRef", "stepEntityId"]

Check = Callable[[Column], Column]


def _all(items: Column, check: Check, optional: bool = False) -> Column:
    """Whether a list is there (or may lack) and all its members, none of them null, pass."""
    return F.when(items.isNull(), F.lit(optional)).otherwise(F.forall(items, lambda x: F.coalesce(check(x), F.lit(False))))


def _entity_ok(e: Column) -> Column:
    told = F.when(e["entityId"].isNotNull(), e["entityType"].isNotNull() & e["displayName"].isNotNull()).otherwise(F.length(e["entityKey"]) > 0)
    return e["role"].isin(*ROLES) & e["label"].isNotNull() & told


def _relation_ok(r: Column) -> Column:
    told = F.when(r["relationshipId"].isNotNull(), r["sourceEntityId"].isNotNull() & r["targetEntityId"].isNotNull()).otherwise(F.length(r["relationshipKey"]) > 0)
    return r["type"].isNotNull() & told


def _source_ok(p: Column) -> Column:
    return (F.length(p["id"]) > 0) & p["kind"].isin(*KINDS) & p["label"].isNotNull()


def _note_ok(n: Column) -> Column:
    return (F.length(n["key"]) > 0) & n["reason"].isNotNull() & n["target"].isNotNull()


def _step_ok(s: Column) -> Column:
    needs = F.lit(False)
    for kind, fields in STEP_NEEDS.items():
        told = F.lit(True)
        for f in fields:
            told = told & s[f].isNotNull()
        needs = F.when(s["type"] == kind, told).otherwise(needs)
    subject = F.when(s["subject"].isNull(), True).otherwise(_entity_ok(s["subject"]))
    plain = (F.length(s["id"]) > 0) & s["evidenceBasis"].isin(*CERTAINTIES) & s["order"].isin(*ORDERS)
    return plain & needs & subject & _all(s["provenance"], _source_ok) & _all(s["entityReferences"], _entity_ok, True)


def _transition_ok(t: Column) -> Column:
    ends = F.lit(True)
    for end in ("from", "to"):
        subject = t[f"{end}Subject"]
        ends = ends & (F.length(t[end]) > 0) & F.when(subject.isNull(), True).otherwise(_entity_ok(subject))
    plain = (F.length(t["id"]) > 0) & t["type"].isin(*TRANSITIONS) & t["order"].isin(*ORDERS) & t["certainty"].isin(*CERTAINTIES)
    return plain & ends & _all(t["provenance"], _source_ok) & _all(t["entityReferences"], _entity_ok, True) & _all(t["relationshipReferences"], _relation_ok, True)


def model_ok(m: Column) -> Column:
    """Whether a parsed model has all its parts; never null."""
    plain = m["id"].rlike("^[a-f0-9]{64}$") & (F.length(m["name"]) > 0) & m["confidence"].isin("proven", "derived") & m["completeness"].isin("complete", "partial", "unresolved")
    lists = _all(m["sourceServices"], lambda s: s.isNotNull()) & _all(m["provenance"], _source_ok) & _all(m["steps"], _step_ok) & _all(m["transitions"], _transition_ok)
    more = _all(m["entityReferences"], _entity_ok) & _all(m["relationshipReferences"], _relation_ok) & _all(m["unresolvedBoundaries"], _note_ok) & _all(m["diagnostics"], _note_ok, True)
    return F.coalesce(plain & lists & more, F.lit(False))


def read_journeys(published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journeys, violations) of the published entities of type ``journey``.

    ``journeys`` has (publication_id, journey_entity_id, journey_id, evidence_ids, model), references not yet pinned;
    ``violations`` (publication_id, object_id, problem): ``not-one-model`` if the provenance carries no model or several
    (empty texts do not count), ``invalid-model`` if it is no JSON, has a part of another type, lacks one, or has a part of an unknown
    name at its top (unknown names further down are ignored), ``other-model`` if its name is not the entity's or no provenance
    row carries its id.  A null list of provenance counts as empty.  Every journey gives a row in exactly one of the two.
    """
    journeys = published.where("type = 'journey'")
    found = F.filter(F.transform("provenance", lambda p: p["facts"]["journeyJson"]), lambda j: F.length(j) > 0)
    read = journeys.withColumn("_found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("_json", F.get("_found", F.lit(0)))
    # Generated, not projected: filters on the model stay above, so that it is parsed once a row, not once for each use.
    parsed = F.from_json("_json", f"{MODEL}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = read.withColumn("_m", F.explode(F.array(parsed)))
    names = F.array(*[F.lit(f) for f in StructType.fromDDL(MODEL).names])
    sound = F.col("_m")["_corrupt"].isNull() & (F.size(F.array_except(F.json_object_keys("_json"), names)) == 0) & model_ok(F.col("_m"))
    same = (F.col("_m")["name"] == F.col("name")) & F.exists("provenance", lambda p: F.coalesce(p["facts"]["journeyId"] == F.col("_m")["id"], F.lit(False)))
    problem = F.when(F.size("_found") != 1, "not-one-model").when(~F.coalesce(sound, F.lit(False)), "invalid-model").when(~F.coalesce(same, F.lit(False)), "other-model")
    told = read.withColumn("problem", problem)
    good = told.where("problem IS NULL").select("publication_id", F.col("entity_id").alias("journey_entity_id"), F.col("_m")["id"].alias("journey_id"), "evidence_ids", F.col("_m").dropFields("_corrupt").alias("model"))
    return good, told.where("problem IS NOT NULL").select("publication_id", F.col("entity_id").alias("object_id"), "problem")


def pinned(journeys: DataFrame) -> DataFrame:
    """The journeys with every reference to something published naming the publication that was read."""
    publication = F.col("publication_id").cast("string")

    def pin(*keys: str) -> Check:
        def one(r: Column) -> Column:
            known = F.coalesce(*[F.nullif(r[k], F.lit("")) for k in keys]).isNotNull()
            return F.when(r.isNotNull(), r.withField("publicationId", F.when(known, publication).otherwise(r["publicationId"])))

        return one

    entity, relation, source = pin("entityId"), pin("relationshipId"), pin("documentEntityId")
    many = lambda items, how: F.transform(items, how)

    def step(s: Column) -> Column:
        return s.withField("subject", entity(s["subject"])).withField("entityReferences", many(s["entityReferences"], entity)).withField("provenance", many(s["provenance"], source))

    def transition(t: Column) -> Column:
        out = t.withField("fromSubject", entity(t["fromSubject"])).withField("toSubject", entity(t["toSubject"])).withField("provenance", many(t["provenance"], source))
        return out.withField("entityReferences", many(t["entityReferences"], entity)).withField("relationshipReferences", many(t["relationshipReferences"], relation))

    m = F.col("model")
    out = m.withField("entityReferences", many(m["entityReferences"], entity)).withField("relationshipReferences", many(m["relationshipReferences"], relation)).withField("provenance", many(m["provenance"], source))
    return journeys.withColumn("model", out.withField("steps", many(m["steps"], step)).withField("transitions", many(m["transitions"], transition)))


def model_text(m: Column) -> Column:
    """What a journey is searched by: its id, name, services, the labels it refers to and the texts of its steps, by single blanks."""
    steps = F.flatten(F.transform(m["steps"], lambda s: F.filter(F.array(*[s[t] for t in _STEP_TEXTS]), lambda t: t.isNotNull())))
    labels = F.transform(m["entityReferences"], lambda e: e["label"])
    return F.concat_ws(" ", m["id"], m["name"], m["sourceServices"], labels, steps)


def project_journeys(journeys: DataFrame, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(publication_id, journey_entity_id, journey_id, text): the rows to store for searches, so that these need no model."""
    text = F.concat_ws(" ", F.col("model")["name"], F.lit("journey"), model_text(F.col("model")))
    return journeys.select("publication_id", "journey_entity_id", "journey_id", fold(text).alias("text"))


def search_journeys(
    projection: DataFrame, journeys: DataFrame, query: str | None = None, service: str | None = None, api: str | None = None, connector: str | None = None, publication: object = None, after: str | None = None, limit: int = 50,
) -> DataFrame:
    """A page of pinned journeys by entity id whose text contains the one text given, if any; one row more tells of a next page.

    Two of ``query``, ``service``, ``api`` and ``connector`` are an error.  The page, at most 101 rows of ids, is found in the
    projection and only its models are read: its rows are few by construction, so they are broadcast.
    """
    given = [t for t in (query, service, api, connector) if t is not None]
    if len(given) > 1:
        raise ValueError("specify only one of query, service, api or connector")
    wanted = [F.col("publication_id") == F.lit(publication)] if publication is not None else []
    wanted += [match(F.col("text"), t) for t in given]
    ids = page(projection, "journey_entity_id", after, limit, wanted).select("publication_id", "journey_entity_id")
    return pinned(journeys.join(F.broadcast(ids), ["publication_id", "journey_entity_id"]))


def find_journeys(journeys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(publication_id, journey_id, state, journey_entity_id) for every distinct wanted pair of publication and journey id.

    ``found`` with its entity, ``missing``, or ``ambiguous`` if several entities of the publication carry the id (then no entity is
    named).  Ids that are no 64 lowercase hexadecimal digits are ``invalid``.
    """
    entities = journeys.groupBy("publication_id", "journey_id").agg(F.count_distinct("journey_entity_id").alias("n"), F.min("journey_entity_id").alias("entity"))
    joined = wanted.select("publication_id", "journey_id").distinct().join(entities, ["publication_id", "journey_id"], "left")
    valid = F.coalesce(F.col("journey_id").rlike("^[a-f0-9]{64}$"), F.lit(False))
    state = F.when(~valid, "invalid").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return joined.withColumn("state", state).select("publication_id", "journey_id", "state", F.when(F.col("state") == "found", F.col("entity")).alias("journey_entity_id"))


def compact_journeys(journeys: DataFrame, steps: int = STEPS_SHOWN, provenance: int = PROVENANCE_SHOWN) -> DataFrame:
    """Pinned journeys as search shows them: first steps, boundaries, diagnostics and sources with the counts of all; no transitions.

    Published references lose their keys, roles and labels; others stay as they are.  A missing list counts as 0 and shows nothing.
    """
    m = F.col("model")
    count = lambda items: F.coalesce(F.array_size(items), F.lit(0))
    first = lambda items, n: F.slice(F.coalesce(items, F.array()), 1, n)
    hide = lambda r, key, fields: F.when(r[key].isNull(), r).otherwise(_without(r, fields))
    entity = lambda e: F.when(e.isNotNull(), hide(e, "entityId", ["entityKey", "label"]))
    relation = lambda r: hide(r, "relationshipId", ["relationshipKey"])

    def step(s: Column) -> Column:
        shown = [s[f].alias(f) for f in ("id", "type", "order", *STEP_SHOWN)]
        return F.struct(*shown, entity(s["subject"]).alias("subject"), F.transform(s["entityReferences"], entity).alias("entityReferences"), first(s["provenance"], provenance).alias("provenance"), count(s["provenance"]).alias("provenanceReferenceCount"))

    return journeys.select(
        "publication_id", "journey_entity_id", "journey_id", first(F.col("evidence_ids"), provenance).alias("evidence_preview"), count(F.col("evidence_ids")).alias("evidence_count"),
        *[m[f].alias(f) for f in ("name", "description", "sourceServices", "confidence", "completeness")],
        count(m["steps"]).alias("step_count"), F.transform(first(m["steps"], steps), step).alias("step_preview"), (count(m["steps"]) > steps).alias("steps_truncated"), F.lit(True).alias("transitions_omitted"),
        first(m["provenance"], provenance).alias("provenance"), count(m["provenance"]).alias("provenance_count"),
        first(m["unresolvedBoundaries"], steps).alias("boundaries"), count(m["unresolvedBoundaries"]).alias("boundary_count"), first(m["diagnostics"], steps).alias("diagnostics"), count(m["diagnostics"]).alias("diagnostic_count"),
        F.transform(m["entityReferences"], entity).alias("entity_references"), F.transform(m["relationshipReferences"], relation).alias("relationship_references"),
    )


def _without(row: Column, fields: list[str]) -> Column:
    """The struct with some fields empty, so that its type stays and its JSON does not show them."""
    for f in fields:
        row = row.withField(f, F.lit(None).cast("string"))
    return row
