"""Evidence to graph candidates: entities, relationships and diagnostics.

Inputs are evidence rows joined with their document: (document_id, path, key, kind, excerpt,
truncated, locator).  Each extractor returns (entities, relationships) or (entities,
relationships, diagnostics), all as DataFrames: joins and groupings over evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filename, first_sentence, folder, normal_path, unescape_pointer
from ..functions.shared import settle


def _entity(kind: str, name: Column, scope: Column, **facts: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), name.alias("name"), scope.alias("scope"), F.array(F.concat_ws("#", F.col("document_id").cast("string"), F.col("key"))).alias("evidence_ids"), *[c.alias(n) for n, c in facts.items()]]


def package_dependencies(evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages of manifests and what they depend on; a name that is no string is rejected."""
    rows = evidence.where(F.lower(filename(F.col("path"))) == "package.json")
    strings = rows.where("startswith(key, 'json-type:') AND excerpt = 'string'").select("document_id", F.concat(F.lit("json:"), F.substring("key", 11, 100000)).alias("key"))
    whole = rows.where("NOT truncated").join(strings, ["document_id", "key"])
    owners = whole.where("key = 'json:/name' AND excerpt <> ''").select("document_id", F.col("excerpt").alias("owner"))
    pattern = r"^json:/(?:dependencies|devDependencies|optionalDependencies|peerDependencies)/(.+)$"
    needs = whole.where(F.col("key").rlike(pattern)).withColumn("target", unescape_pointer(F.regexp_extract("key", pattern, 1))).join(owners, "document_id").where("target <> owner")
    entities = whole.where("key = 'json:/name' AND excerpt <> ''").select(*_entity("package", F.col("excerpt"), F.col("path"))).unionByName(needs.select(*_entity("package", F.col("target"), F.col("path"))))
    edges = needs.select(F.lit("DEPENDS_ON").alias("type"), F.col("owner").alias("source"), "target", F.col("path").alias("scope"))
    rejected = rows.where("key = 'json:/name'").join(owners, "document_id", "left_anti").select("document_id", F.lit("rejected").alias("disposition"), F.lit("PACKAGE_NAME_NOT_A_COMPLETE_STRING").alias("reason"), F.col("excerpt").alias("target"))
    return entities, edges, rejected


def module_scope(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.d)?\.(ts|tsx|js|jsx|mjs|cjs)$", "")


def module_dependencies(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules and what they import: relative targets by path inside one root, others external."""
    rows = evidence.where("startswith(key, 'typescript:') AND key RLIKE ':module:[0-9]+$'").withColumn("scope", module_scope(F.col("path")))
    said = F.col("locator.symbol")
    local = F.startswith(said, F.lit("."))
    joined = module_scope(normal_path(F.concat_ws("/", folder(F.col("scope")), said)))
    rows = rows.withColumn("target", F.when(local, joined).otherwise(F.concat(F.lit("external:"), said)))
    root = lambda c: F.substring_index(c, "/", 1)
    rows = rows.where((F.col("target") != F.col("scope")) & (~local | (root(F.col("target")) == root(F.col("scope")))))
    own = evidence.where("startswith(key, 'typescript:')").withColumn("scope", module_scope(F.col("path")))
    entities = own.select(*_entity("module", filename(F.col("scope")), F.col("scope"))).unionByName(rows.select(*_entity("module", F.when(local, filename(F.col("target"))).otherwise(said), F.col("target"))))
    return entities, rows.select(F.lit("DEPENDS_ON").alias("type"), F.col("scope").alias("source"), "target", "path").distinct()


def container_images(evidence: DataFrame) -> DataFrame:
    """Base images of Dockerfiles, but for scratch."""
    image = F.regexp_extract("excerpt", r"(?i)^FROM\s+(?:--platform=\S+\s+)?(\S+)", 1)
    rows = evidence.where("startswith(key, 'dockerfile:') AND NOT truncated").withColumn("image", image).where("image <> '' AND lower(image) <> 'scratch'")
    return rows.select(*_entity("container", F.col("image"), F.col("path")))


def openapi(evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """APIs of OpenAPI 3 documents and their operations; an operationId must be unique in its document."""
    rows = evidence.where(F.col("key").rlike("^(json|yaml):")).withColumn("pointer", F.col("locator.pointer"))
    apis = rows.where("pointer = '/openapi' AND startswith(excerpt, '3.')").select("document_id").join(
        rows.where("pointer = '/info/title'").select("document_id", F.col("excerpt").alias("api"), "path", "key"), "document_id"
    )
    operations = rows.where(F.col("pointer").rlike(r"^/paths/[^/]+/(get|put|post|delete|options|head|patch|trace)/operationId$")).join(apis.select("document_id", "api"), "document_id")
    counts = operations.groupBy("document_id", "excerpt").agg(F.count("*").alias("n"))
    told = operations.join(counts, ["document_id", "excerpt"])
    unique = told.where("n = 1 AND excerpt <> ''")
    entities = apis.select(*_entity("api", F.col("api"), F.col("path"))).unionByName(unique.select(*_entity("operation", F.col("excerpt"), F.col("path"))))
    edges = unique.select(F.lit("EXPOSES").alias("type"), F.col("api").alias("source"), F.col("excerpt").alias("target"), F.col("path").alias("scope"))
    return entities, edges, told.where("n > 1").select("document_id", F.lit("rejected").alias("disposition"), F.lit("OPERATION_ID_NOT_UNIQUE").alias("reason"), F.col("excerpt").alias("target"))


def resolve_links(links: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) links: relative to the linking document's folder, or to its root with a
    leading slash; fragments and queries are cut, other schemes stay unresolved."""
    bare = F.url_decode(F.regexp_replace("excerpt", r"[#?].*$", ""))
    joined = F.when(F.startswith(bare, F.lit("/")), normal_path(bare)).otherwise(normal_path(F.concat_ws("/", folder(F.col("path")), bare)))
    target = F.when(~F.col("excerpt").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:|^//|^#"), joined)
    rows = links.withColumn("target_path", target)
    known = documents.select(F.col("path").alias("target_path"), F.col("document_id").alias("target_id"))
    found = rows.join(known, "target_path", "left")
    lost = found.where("target_id IS NULL").select("document_id", F.lit("unresolved").alias("disposition"), F.lit("LINK_TARGET_NOT_DISCOVERED").alias("reason"), F.col("excerpt").alias("target"))
    return found.where("target_id IS NOT NULL AND target_id <> document_id"), lost


def decision_id(name: Column) -> Column:
    """``ADR-12`` of a decision's filename; empty for other files."""
    number = F.regexp_extract(F.lower(name), r"^adr-(\d+)", 1)
    return F.when(number == "", "").otherwise(F.concat(F.lit("ADR-"), number))


def markdown_references(evidence: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and the documents that they link to; decisions are left to ``decisions``."""
    rows = evidence.where(decision_id(filename(F.col("path"))) == "")
    entities = rows.where("kind IN ('heading', 'paragraph') AND NOT truncated").select("document_id", "path").distinct().select(F.lit("document").alias("type"), F.col("path").alias("name"), F.col("path").alias("scope"), "document_id")
    found, lost = resolve_links(rows.where("startswith(key, 'markdown-link:') AND NOT truncated"), documents)
    edges = found.where(decision_id(filename(F.col("target_path"))) == "").select(F.lit("REFERENCES").alias("type"), F.col("path").alias("source"), F.col("target_path").alias("target")).distinct()
    return entities, edges, lost


def decisions(evidence: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions with summary and metadata, and the decisions of their folder that they refer to.

    A referred number must belong to exactly one decision of the folder.
    """
    rows = evidence.withColumn("decision", decision_id(filename(F.col("path")))).where("decision <> ''")
    title = rows.where("kind = 'heading'").groupBy("document_id", "path", "decision").agg(F.min_by("excerpt", "locator.line_start").alias("title"))
    text = rows.where("kind = 'paragraph'").groupBy("document_id").agg(first_sentence(F.min_by("excerpt", "locator.line_start")).alias("summary"))
    meta = rows.where("startswith(key, 'markdown-metadata:')").withColumn("field", F.lower(F.regexp_extract("excerpt", r"^(?:\*\*)?([A-Za-z -]+):", 1)))
    status = meta.where("field = 'status'").groupBy("document_id").agg(F.min(F.regexp_extract("excerpt", r":(?:\*\*)?\s*(.+)$", 1)).alias("status"))
    entities = title.join(text, "document_id", "left").join(status, "document_id", "left").withColumn("type", F.lit("architectural-decision"))
    known = documents.withColumn("decision", decision_id(filename(F.col("path")))).where("decision <> ''").withColumn("folder", folder(F.col("path")))
    only = known.groupBy("folder", "decision").agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1")
    said = meta.where("field IN ('supersedes', 'superseded by', 'superseded-by', 'related decisions', 'references')")
    said = said.select("document_id", "path", folder(F.col("path")).alias("folder"), F.explode(F.regexp_extract_all(F.upper("excerpt"), F.lit(r"ADR-\d+"), F.lit(0))).alias("decision"))
    edges = said.join(only, ["folder", "decision"]).where("target <> path").select(F.lit("REFERENCES").alias("type"), F.col("path").alias("source"), "target").distinct()
    return entities, edges


def repository_structure(documents: DataFrame, repositories: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories contain the modules and packages of the documents that they own."""
    from .inventory import owning_repository

    owned = owning_repository(documents.select("document_id", "path"), repositories).where("repository IS NOT NULL")
    entities = repositories.select(F.lit("repository").alias("type"), filename(F.col("path")).alias("name"), F.col("path").alias("scope"))
    edges = modules.join(owned.select("path", "repository"), modules["scope"] == owned["path"]).select(F.lit("CONTAINS").alias("type"), F.col("repository").alias("source"), F.col("name").alias("target")).distinct()
    return entities, edges


def components(evidence: DataFrame) -> DataFrame:
    """Classes with package, parents, injected types and role.

    Roles, first that holds: controller (named or extending so, or owner of a route handler),
    connector (owns an HTTP call), service (injected somewhere, in a ``services`` package), component.
    """
    detail = lambda name: F.col("locator.detail")[name]
    classes = evidence.where("locator.value_kind IN ('class', 'object', 'trait')").select("document_id", "path", F.substring_index("locator.symbol", ".", -1).alias("component"), detail("package").alias("package"), detail("extends").alias("parents"))
    injected = evidence.where("locator.value_kind = 'parameter'").select(detail("type").alias("component")).distinct().withColumn("injected", F.lit(True))
    http = evidence.where("locator.value_kind = 'call'").where(detail("called").rlike(r"(?i)^(get|post|put|delete|patch)$") & detail("receiver").rlike(r"(?i)http|client")).select(detail("owner").alias("component")).distinct().withColumn("http", F.lit(True))
    handlers = evidence.where("startswith(key, 'route:')").select(F.element_at(F.split(F.regexp_replace(detail("handler"), r"\(.*$", ""), r"\."), -2).alias("component")).distinct().withColumn("routed", F.lit(True))
    told = classes.join(injected, "component", "left").join(http, "component", "left").join(handlers, "component", "left")
    role = (
        F.when(F.col("routed") | F.col("parents").rlike("Controller"), "controller").when(F.col("http"), "connector").when(F.col("injected") & F.col("package").contains("services"), "service").otherwise("component")
    )
    return told.select("document_id", "path", "component", "package", role.alias("role"))


def resolve_calls(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, diagnostics): calls joined to the one method of the receiver's injected type.

    A receiver is a constructor parameter of the calling class or the class itself; types and
    methods that exist more than once, or never, give diagnostics instead.  The rows that count are written once, so that
    texts are read once for calls, parameters and methods.
    """
    evidence = settle(evidence.where("locator.value_kind IN ('call', 'parameter', 'def')").select("document_id", "locator"))
    detail = lambda name: F.col("locator.detail")[name]
    calls = evidence.where("locator.value_kind = 'call'").select("document_id", F.col("locator.line_start").alias("line"), detail("index").cast("int").alias("call_index"), detail("owner").alias("owner"), detail("method").alias("method"), detail("receiver").alias("receiver"), detail("called").alias("called"))
    injected = evidence.where("locator.value_kind = 'parameter'").select(F.col("locator.symbol").alias("owner"), detail("name").alias("receiver"), detail("type").alias("target_type")).distinct()
    methods = evidence.where("locator.value_kind = 'def'").select(F.col("locator.symbol").alias("target"), "document_id").groupBy("target").agg(F.count("*").alias("n"))
    typed = calls.join(injected, ["owner", "receiver"], "left").withColumn("target", F.concat_ws(".", F.coalesce("target_type", F.when(F.col("receiver").isin("this", "self"), F.col("owner")).otherwise(F.col("receiver"))), "called"))
    joined = typed.join(methods, "target", "left")
    resolved = joined.where("n = 1").select("document_id", F.concat_ws(".", "owner", "method").alias("caller"), "target", "line", "call_index")
    reason = F.when(F.col("n").isNull(), "CALL_TARGET_NOT_FOUND").otherwise("CALL_TARGET_AMBIGUOUS")
    return resolved, joined.where("n IS NULL OR n > 1").select("document_id", F.lit("unresolved").alias("disposition"), reason.alias("reason"), "target")


def static_paths(handlers: DataFrame, calls: DataFrame, depth: int = 8, most_steps: int = 254) -> DataFrame:
    """Steps of the walk from each route's handler: (route, position, caller, target, depth, stopped, truncated).

    The walk goes depth first in (line, call index) order and enters a method once for each route: a
    call of a method already entered is a step with ``stopped`` ``repeated-method``, one at the last
    depth has ``depth-limit``.  Joins gather the distinct methods within reach of each handler, so
    diamonds do not multiply; the walk itself runs for each route over the calls within its reach and
    keeps the first ``most_steps`` (with the two entries of route and handler 256), told by ``truncated``.
    """
    edges = calls.select(F.col("caller").alias("at"), "target", "line", "call_index")
    reach = handlers.select("route", "handler", F.col("handler").alias("at")).distinct()
    for _ in range(depth - 1):
        ends = F.explode(F.array_compact(F.array("at", "target"))).alias("at")
        reach = reach.join(edges.select("at", "target"), "at", "left").select("route", "handler", ends).distinct()

    def walk(key, rows):
        following: dict[str, list[str]] = {}
        for row in rows.sort_values(["line", "call_index", "target"]).itertuples():
            following.setdefault(row.at, []).append(row.target)
        steps, entered, cut = [], {key[1]}, False
        waiting = [(key[1], 1, iter(following.get(key[1], [])))]
        while waiting:
            at, level, rest = waiting[-1]
            target = next(rest, None)
            if target is None:
                waiting.pop()
                continue
            if len(steps) == most_steps:
                cut = True
                break
            stopped = "depth-limit" if level >= depth else "repeated-method" if target in entered else None
            steps.append((key[0], len(steps) + 1, at, target, level, stopped))
            if stopped is None:
                entered.add(target)
                waiting.append((target, level + 1, iter(following.get(target, []))))
        columns = ["route", "position", "caller", "target", "depth", "stopped"]
        return type(rows)(steps, columns=columns).assign(truncated=cut)

    schema = "route string, position int, caller string, target string, depth int, stopped string, truncated boolean"
    return reach.join(edges, "at").groupBy("route", "handler").applyInPandas(walk, schema)


def journeys(steps: DataFrame, scope: str) -> DataFrame:
    """One journey for each route: id, ordered steps, and transitions between consecutive steps."""
    listed = F.array_sort(F.collect_list(F.struct("position", "caller", "target")))
    grouped = steps.groupBy("route").agg(listed.alias("steps"), F.max("depth").alias("depth"), F.bool_or("truncated").alias("truncated"))
    pairs = F.zip_with(F.slice("steps", F.lit(1), F.size("steps") - 1), F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))), lambda a, b: F.struct(a["target"].alias("from"), b["target"].alias("to")))
    return grouped.select(F.sha2(F.concat(F.lit(scope), F.lit("\x00"), F.col("route")), 256).alias("journey_id"), "route", "steps", F.when(F.size("steps") > 1, pairs).otherwise(F.array().cast("array<struct<from:string,to:string>>")).alias("transitions"), "depth", "truncated")


def find_journeys(found: DataFrame, text: str) -> DataFrame:
    """Journeys whose route or any step names the text, case-insensitively."""
    hit = F.contains(F.lower("route"), F.lit(text.lower())) | F.exists("steps", lambda s: F.contains(F.lower(s["target"]), F.lit(text.lower())))
    return found.where(hit)
