"""Currency: does published knowledge still rest on current document versions?"""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import object_hash, row_json

STATES = ("CURRENT", "UNKNOWN", "STALE")
#: Fixed value: the schema version inside a basis.
BASIS_VERSION = 1
CURSOR_KIND = "publication-currency"


def classify_support(support: DataFrame, pointers: DataFrame, versions: DataFrame) -> DataFrame:
    """(object keys.., document_id, version_id) with ``state`` and ``reason``.

    ``pointers`` has (document_id, is_present, current_version_id), ``versions`` (version_id,
    document_id, content_hash).  The supporting version and the document's state must exist; if
    one is missing the history is broken: reason BROKEN_HISTORY and no state.  A document without
    a pointer is unavailable, or removed if it is absent; a pointer that leads to no version, to
    another document's or from an absent document is unresolvable.
    """
    cited = versions.select("version_id", F.col("content_hash").alias("cited_hash"))
    newest = versions.select(F.col("version_id").alias("current_version_id"), F.col("document_id").alias("target_document"), F.col("content_hash").alias("current_hash"))
    known = pointers.withColumn("_known", F.lit(True))
    joined = support.join(cited, "version_id", "left").join(known, "document_id", "left").join(newest, "current_version_id", "left")
    present = F.coalesce("is_present", F.lit(False))
    reason = (
        F.when(F.col("cited_hash").isNull() | F.col("_known").isNull(), "BROKEN_HISTORY")
        .when(F.col("current_version_id").isNull(), F.when(present, "CURRENT_VERSION_UNAVAILABLE").otherwise("DOCUMENT_REMOVED"))
        .when(F.col("target_document").isNull() | (F.col("target_document") != F.col("document_id")) | ~present, "CURRENT_VERSION_UNRESOLVABLE")
        .when(F.col("current_version_id") == F.col("version_id"), F.lit(None))
        .when(F.col("current_hash") != F.col("cited_hash"), "CONTENT_CHANGED")
        .otherwise("PROCESSING_CHANGED")
    )
    state = F.when(reason.isNull(), "CURRENT").when(reason.isin("CONTENT_CHANGED", "PROCESSING_CHANGED"), "STALE").when(reason == "BROKEN_HISTORY", None).otherwise("UNKNOWN")
    return joined.select(*support.columns, state.alias("state"), reason.alias("reason"))


def worst_state(support: DataFrame, keys: list[str]) -> DataFrame:
    """Each object's worst state: STALE over UNKNOWN over CURRENT."""
    rank = F.when(F.col("state") == "STALE", 2).when(F.col("state") == "UNKNOWN", 1).otherwise(0)
    name = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.max(rank) + 1)
    return support.groupBy(*keys).agg(name.alias("state"))


def summarize(objects: DataFrame, kind: str = "object_type") -> DataFrame:
    """Objects by type and state, states without objects as 0."""
    return objects.groupBy(kind).pivot("state", list(STATES)).agg(F.count(F.lit(1))).fillna(0)


def details(objects: DataFrame, after: tuple[str, str] | None = None, limit: int = 50, state: str | None = None) -> DataFrame:
    """A page by (object type, id), optionally of one state."""
    if state is not None:
        objects = objects.where(F.col("state") == state)
    if after is not None:
        objects = objects.where(F.struct("object_type", "object_id") > F.struct(F.lit(after[0]).alias("object_type"), F.lit(after[1]).alias("object_id")))
    return objects.orderBy("object_type", "object_id").limit(limit + 1)


class BasisChanged(ValueError):
    """The current versions moved between two pages: the listing must start again."""


def details_page(objects: DataFrame, publication_id: str, basis_hash: str, cursor: str | None = None, object_type: str | None = None, state: str | None = None, limit: int = 50) -> DataFrame:
    """A page of a publication's objects by type and id with one row more, and for each row the ``cursor`` that goes on after it.

    A cursor holds the publication, the filters and the ``basis_hash`` that it was made under.  A cursor that is not well formed or
    belongs to another publication or other filters is an error, one of another basis ``BasisChanged``.
    """
    from .presentation import encode_cursor

    if state is not None and state not in STATES:
        raise ValueError(f"state must be one of {STATES}")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1 and 100")
    scope = {"version": 1, "kind": CURSOR_KIND, "publicationId": publication_id, **{k: v for k, v in (("objectType", object_type), ("state", state)) if v is not None}}
    if object_type is not None:
        objects = objects.where(F.col("object_type") == object_type)
    if state is not None:
        objects = objects.where(F.col("state") == state)
    if cursor is not None:
        last_type, last_id = _after(cursor, scope, basis_hash)
        objects = objects.where((F.col("object_type") > last_type) | ((F.col("object_type") == last_type) & (F.col("object_id") > F.lit(last_id))))
    at = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in scope.items()], F.lit(basis_hash).alias("currencyBasisHash"), F.col("object_type").alias("afterObjectType"), F.col("object_id").alias("afterId")))
    return objects.orderBy("object_type", "object_id").limit(limit + 1).withColumn("cursor", encode_cursor(at))


def _after(cursor: str, scope: dict, basis_hash: str) -> tuple[str, object]:
    """Where a cursor of this scope goes on."""
    try:
        text = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True)
        found = json.loads(text)
    except (binascii.Error, ValueError) as error:
        raise ValueError("the cursor is not well formed") from error
    if base64.urlsafe_b64encode(text).rstrip(b"=").decode() != cursor or not isinstance(found, dict) or set(found) != {*scope, "currencyBasisHash", "afterObjectType", "afterId"}:
        raise ValueError("the cursor is not well formed or of other filters")
    if any(found[k] != v for k, v in scope.items()):
        raise ValueError("the cursor belongs to another listing")
    if found["currencyBasisHash"] != basis_hash:
        raise BasisChanged("the current versions changed since the page before; start again")
    return found["afterObjectType"], found["afterId"]


def basis(pointers: DataFrame, versions: DataFrame, group: str) -> DataFrame:
    """(group, documents, basis_hash): what the classification of each group of documents rests on.

    The SHA-256 of the canonical JSON of every document's presence, pointer, revision and, if the pointer
    leads to a known version, that version's document and content, ordered by document id.
    ``pointers`` has (group, document_id, is_present, current_version_id, revision).
    """
    known = versions.select(F.col("version_id").alias("current_version_id"), F.struct(F.col("document_id").alias("documentId"), F.col("content_hash").alias("contentHash")).alias("currentVersion"))
    rows = pointers.join(known, "current_version_id", "left")
    item = row_json(rows, documentId="document_id", documentPresent="is_present", currentVersionId="current_version_id", revision="revision", currentVersion="currentVersion")
    listed = rows.select(group, F.lit("documents").alias("field"), F.col("document_id").alias("at"), item.alias("item"))
    found = object_hash(listed, group, "field", "at", "item", ["documents"], {"schemaVersion": str(BASIS_VERSION)})
    return found.select(group, F.col("items").alias("documents"), F.col("hash").alias("basis_hash"))
