"""The analysis of repositories as graph candidates: services, components, operations and how they are tied.

Facts of the analysis are rows of one repository each, (source_id, repository, ..., evidence_id):

* ``settings`` (path, key, value, value_kind): configuration keys
* ``components`` (symbol, symbol_kind, role); ``dependencies`` (source, target, parameter): constructor injection
* ``symbols`` (kind, symbol, owner, signature): methods, values and constructor parameters
* ``calls`` (caller, target): resolved calls; ``call_sites`` (enclosing, receiver, target_text, excerpt): all of them
* ``routes`` (document, route_set, method, path, handler, resolved); ``http`` (enclosing, excerpt, target_text)

Every rule is a producer of candidate rows, one for each cited evidence; the same object made by several producers is
one entity whose role comes from the strongest.  References between producers are joins on keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entity_key, owner_of_method, percent_encode
from ..functions.shared import settle

#: Roles from the strongest to the weakest: which producer names an entity that several made.
ROLES = ("declared-service", "controller", "connector", "service", "component", "route", "downstream-system", "journey-step", "source-document")
#: References that a value may follow before it names a service (fixed value).
MOST_REFERENCES = 7
#: An expression that names another value, one that interpolates it, and the two that name a service.
_REFERENCE = r"^(?:this\.)?([A-Za-z_$][\w$]*)(?:\.([A-Za-z_$][\w$]*))?$"
_INTERPOLATED = r'^s"\$\{?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\}?(?:/[^"$]*)?"$'
_LOOKUP = r'^([A-Za-z_$][\w$]*)\.baseUrl\("([a-z][a-z0-9-]*)"\)$'
_WRAPPED = r'^baseUrl\("([a-z][a-z0-9-]*)"\)$'
_WRAPPER = r"^def\s+baseUrl\(\s*([A-Za-z_$][\w$]*)\s*:\s*String\s*\)\s*(?::\s*String\s*)?=$"
_CONFIG = r"^(?:[\w$]+\.)*ServicesConfig$"
_ARGUMENT = r'^[\w$]+\s*\.\s*(?:get|post|put|patch|delete|head|options)(?:\[[^\]]+\])?\(\s*(?:url|s)"\$\{?([\w$]+(?:\.[\w$]+)?)\}?(?:/[^"]*)?"\s*\)$'

_AT = ["source_id", "repository"]
_ids = lambda *columns: F.array_distinct(F.array_compact(F.array(*columns)))


def wide(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is sorted: facts are small as files, but many times larger once broadcast through the driver."""
    return rows.hint("merge")


def _entities(rows: DataFrame, kind: str, name: Column, scope: Column, role: Column, evidence: Column) -> DataFrame:
    key = entity_key(F.lit(kind), F.col("source_id"), scope, name)
    return rows.select(key.alias("key"), F.lit(kind).alias("type"), name.alias("name"), "source_id", "repository", role.alias("role"), F.explode(evidence).alias("evidence_id"))


def _edges(rows: DataFrame, kind: str, source: str, target: str, relation: str, evidence: Column) -> DataFrame:
    """Edges between two different entities."""
    told = rows.where(F.col(source) != F.col(target))
    return told.select(F.lit(kind).alias("type"), F.col(source).alias("source_key"), F.col(target).alias("target_key"), F.lit(relation).alias("relation"), F.explode(evidence).alias("evidence_id"))


def _diagnostics(rows: DataFrame, reason: str | Column, target: str | Column) -> DataFrame:
    as_column = lambda x, f: f(x) if isinstance(x, str) else x
    return rows.select("evidence_id", F.lit("unresolved").alias("disposition"), as_column(reason, F.lit).alias("reason"), as_column(target, F.col).alias("target"))


def resolve_values(starts: DataFrame, symbols: DataFrame, dependencies: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(id, name, evidence): the service that each start's expression names, and the evidence on the way.

    ``starts`` has (id, source_id, repository, owner, expression).  An expression may be a value of its owner, a value
    of the one component injected under a name, an interpolation that begins with either, or a look-up of
    a service: by an injected configuration or by the owner's one wrapper of that.  A name that is missing, defined twice or
    met again on the way resolves to nothing; so do more than MOST_REFERENCES references.  Each reference is one round of two joins.
    """
    one = lambda rows, keys, *kept: rows.groupBy(*_AT, *keys).agg(F.count("*").alias("n"), *[F.min(k).alias(k) for k in kept]).where("n = 1").drop("n")
    values = one(symbols.where("kind = 'value'").select(*_AT, "symbol", "signature", "evidence_id"), ["symbol"], "signature", "evidence_id")
    values = values.withColumnsRenamed({"evidence_id": "value_evidence"})
    injected = dependencies.select(*_AT, F.col("source").alias("owner"), F.col("parameter").alias("head"), F.col("target").alias("injected"), F.col("evidence_id").alias("injected_evidence"))
    injected = one(injected, ["owner", "head"], "injected", "injected_evidence")

    def plain(expression: Column) -> Column:
        inner = F.regexp_extract(expression, _INTERPOLATED, 1)
        return F.when(inner != "", inner).otherwise(expression)

    values, injected = settle(values), settle(injected)
    now = settle(starts.select("id", *_AT, "owner", plain(F.col("expression")).alias("expression"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("evidence")))
    ended = []
    for _ in range(MOST_REFERENCES):
        named = F.col("expression").rlike(_REFERENCE)
        ended.append(now.where(~named))
        parts = now.where(named).withColumns({"head": F.regexp_extract("expression", _REFERENCE, 1), "tail": F.regexp_extract("expression", _REFERENCE, 2)})
        parts = parts.join(wide(injected), [*_AT, "owner", "head"], "left")
        # A name without a dot is the owner's own; with one, its head must be injected exactly once.
        target = F.when(F.col("tail") == "", F.col("owner")).otherwise(F.col("injected"))
        parts = parts.withColumn("at", target).where("at IS NOT NULL").withColumn("symbol", F.concat_ws(".", "at", F.when(F.col("tail") == "", F.col("head")).otherwise(F.col("tail"))))
        met = parts.where(~F.array_contains("seen", F.col("symbol"))).join(wide(values), [*_AT, "symbol"])
        now = met.select(
            "id", *_AT, F.col("at").alias("owner"), plain(F.coalesce("signature", F.lit(""))).alias("expression"), F.array_append("seen", F.col("symbol")).alias("seen"),
            F.concat("evidence", F.array_compact(F.array("value_evidence", F.when(F.col("tail") != "", F.col("injected_evidence"))))).alias("evidence"),
        )
        # Each round is written once, else every later one would repeat all before it.
        now = settle(now)
        if now.isEmpty():
            break
    last = reduce(DataFrame.unionByName, [*ended, now.where(~F.col("expression").rlike(_REFERENCE))])
    config = symbols.where("kind = 'constructor-parameter'").where(F.trim("signature").rlike(_CONFIG)).groupBy(*_AT, "owner", F.col("symbol").alias("receiver")).agg(F.min("evidence_id").alias("config_evidence"))
    looked = last.select("*", F.regexp_extract("expression", _LOOKUP, 1).alias("receiver"), F.regexp_extract("expression", _LOOKUP, 2).alias("name")).where("name <> ''")
    looked = looked.join(wide(config), [*_AT, "owner", "receiver"]).select("id", "name", F.concat("evidence", F.array("config_evidence")).alias("evidence"))

    # A wrapper: the owner's only baseUrl, whose parameter is handed to a configuration's baseUrl in exactly one call.
    method = one(symbols.where("kind = 'method'").select(*_AT, "symbol", "signature", "evidence_id"), ["symbol"], "signature", "evidence_id").where(F.endswith("symbol", F.lit(".baseUrl")))
    method = method.select(*_AT, F.col("symbol").alias("enclosing"), F.regexp_extract(F.trim("signature"), _WRAPPER, 1).alias("given"), F.col("evidence_id").alias("method_evidence")).where("given <> ''")
    squeezed = F.regexp_replace("excerpt", r"\s+", "")
    sites = call_sites.where(F.col("target_text") == F.concat("receiver", F.lit(".baseUrl"))).join(wide(method), [*_AT, "enclosing"])
    sites = sites.where(squeezed == F.concat("receiver", F.lit(".baseUrl("), "given", F.lit(")")))
    sites = sites.groupBy(*_AT, "enclosing", "given", "method_evidence").agg(F.count("*").alias("n"), F.min("receiver").alias("receiver"), F.min("evidence_id").alias("site_evidence"))
    shadows = symbols.where("kind = 'value'").select(*_AT, F.col("symbol").alias("shadow")).distinct()
    sites = sites.where("n = 1 AND receiver <> given").withColumn("shadow", F.concat_ws(".", "enclosing", "receiver")).join(wide(shadows), [*_AT, "shadow"], "left_anti")
    sites = sites.withColumn("owner", owner_of_method(F.col("enclosing"))).join(wide(config), [*_AT, "owner", "receiver"])
    wrapped = last.withColumn("name", F.regexp_extract("expression", _WRAPPED, 1)).where("name <> ''").join(wide(sites), [*_AT, "owner"])
    wrapped = wrapped.select("id", "name", F.concat("evidence", F.array("method_evidence", "site_evidence", "config_evidence")).alias("evidence"))
    return looked.unionByName(wrapped)


def publish_analysis(facts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, diagnostics) of the facts.

    Entities: (key, type, name, source_id, repository, role, evidence_id), relationships: (type, source_key, target_key, relation,
    evidence_id), one row for each cited evidence, distinct; see ``merge``.  Diagnostics: (evidence_id, disposition, reason, target).
    """
    settings, components, symbols = facts["settings"], facts["components"], facts["symbols"]
    entities, edges, told = [], [], []
    module = components.select(*_AT, "symbol", entity_key(F.lit("module"), F.col("source_id"), F.col("repository"), F.col("symbol")).alias("module_key")).distinct()
    of = lambda symbol, key: wide(module.withColumnsRenamed({"symbol": symbol, "module_key": key}))
    entities.append(_entities(components, "module", F.col("symbol"), F.col("repository"), F.col("role"), F.array("evidence_id")))

    # Services that a repository declares: exactly one name makes an api, several are told.
    named = (F.col("path") == F.concat("repository", F.lit("/conf/application.conf"))) & (F.col("key") == "appName") & F.col("value_kind").isin("string", "unquoted") & F.col("value").rlike("^[a-z][a-z0-9-]*$")
    names = settings.where(named)
    known = names.groupBy(*_AT).agg(F.array_sort(F.collect_set("value")).alias("names"), F.array_sort(F.collect_set("evidence_id")).alias("declared_by"))
    declared = known.where(F.size("names") == 1).select(*_AT, F.get("names", F.lit(0)).alias("service"), "declared_by")
    declared = declared.withColumn("service_key", entity_key(F.lit("api"), F.col("source_id"), F.col("repository"), F.col("service")))
    entities.append(_entities(declared, "api", F.col("service"), F.col("repository"), F.lit("declared-service"), F.col("declared_by")))
    several = names.join(wide(known.where(F.size("names") > 1)), _AT)
    told.append(_diagnostics(several, "provider-appName-declaration-ambiguous", F.array_join("names", ", ")))

    # Components: injection and resolved calls.
    tied = facts["dependencies"].join(of("source", "source_key"), [*_AT, "source"]).join(of("target", "target_key"), [*_AT, "target"])
    edges.append(_edges(tied, "DEPENDS_ON", "source_key", "target_key", "constructor-injection", F.array("evidence_id")))
    methods = symbols.where("kind = 'method'").select(*_AT, F.col("symbol").alias("target"), F.col("evidence_id").alias("declaration"))
    calls = facts["calls"].withColumns({"caller_owner": owner_of_method(F.col("caller")), "target_owner": owner_of_method(F.col("target"))})
    calls = calls.join(of("caller_owner", "source_key"), [*_AT, "caller_owner"]).join(of("target_owner", "target_key"), [*_AT, "target_owner"])
    via = tied.select("source_key", "target_key", F.col("evidence_id").alias("injection")).distinct()
    cited = calls.join(wide(methods), [*_AT, "target"], "left").join(wide(via), ["source_key", "target_key"], "left")
    edges.append(_edges(cited, "USES", "source_key", "target_key", "CALLS", _ids("evidence_id", "declaration", "injection")))

    # Routes of the application: operations, exposed by the declared service, implemented by the handler's component.
    routes = facts["routes"].where("route_set = 'app'").withColumn("name", F.concat_ws(" ", "method", "path"))
    scope = F.concat_ws("/", "repository", "document", "route_set", *[percent_encode(F.col(c)) for c in ("method", "path", "handler")])
    routes = routes.withColumn("scope", scope).withColumn("route_key", entity_key(F.lit("operation"), F.col("source_id"), F.col("scope"), F.col("name")))
    entities.append(_entities(routes, "operation", F.col("name"), F.col("scope"), F.lit("route"), F.array("evidence_id")))
    exposed = routes.join(wide(declared), _AT)
    edges.append(_edges(exposed, "EXPOSES", "service_key", "route_key", "DECLARED_SERVICE_ROUTE", F.array_union("declared_by", F.array("evidence_id"))))
    handled = routes.withColumn("handler_owner", owner_of_method(F.col("resolved"))).join(of("handler_owner", "controller_key"), [*_AT, "handler_owner"])
    handled = handled.join(wide(methods.withColumnRenamed("target", "resolved")), [*_AT, "resolved"], "left")
    edges.append(_edges(handled, "USES", "route_key", "controller_key", "IMPLEMENTED_BY", _ids("evidence_id", "declaration")))
    edges.append(_edges(handled, "EXPOSES", "controller_key", "route_key", "EXPOSES_ENDPOINT", _ids("evidence_id", "declaration")))

    # HTTP calls of connectors: the service is named by a value, unless a local name hides it.
    http = facts["http"].withColumn("owner", owner_of_method(F.col("enclosing"))).join(of("owner", "connector_key"), [*_AT, "owner"])
    http = http.withColumn("expression", F.regexp_extract("excerpt", _ARGUMENT, 1)).withColumn("root", F.regexp_extract("expression", r"^[^.]*", 0))
    http = settle(http)
    local = symbols.where("kind = 'value'").select(*_AT, F.col("symbol").alias("hidden")).distinct()
    hidden = http.where("expression <> ''").withColumn("hidden", F.concat_ws(".", "enclosing", "root")).join(wide(local), [*_AT, "hidden"], "left_semi").select("evidence_id")
    signed = symbols.where("kind = 'method'").select(*_AT, F.col("symbol").alias("enclosing"), "signature")
    given = http.where("expression <> ''").join(wide(signed), [*_AT, "enclosing"]).where(F.regexp_like("signature", F.concat(F.lit(r"\b"), F.replace("root", F.lit("$"), F.lit(r"\$")), F.lit(r"\s*:")))).select("evidence_id")
    starts = http.where("expression <> ''").join(wide(hidden.union(given).distinct()), "evidence_id", "left_anti")
    found = resolve_values(starts.withColumn("id", F.col("evidence_id")), symbols, facts["dependencies"], facts["call_sites"]).withColumnsRenamed({"id": "evidence_id", "name": "service", "evidence": "named_by"})
    found = settle(found)
    told.append(_diagnostics(http.join(wide(found), "evidence_id", "left_anti"), "http-downstream-not-exactly-resolved", "target_text"))
    hosts = settings.select(*_AT, F.regexp_extract("key", r"^microservice\.services\.([a-z][a-z0-9-]*)\.host$", 1).alias("service"), "evidence_id").where("service <> ''")
    hosts = hosts.groupBy(*_AT, "service").agg(F.array_sort(F.collect_set("evidence_id")).alias("hosts"))
    bound = http.join(wide(found), "evidence_id").join(wide(hosts), [*_AT, "service"], "left")
    told.append(_diagnostics(bound.where("hosts IS NULL"), "downstream-hocon-host-not-found", "service"))
    bound = bound.withColumn("support", F.array_distinct(F.concat("named_by", F.coalesce("hosts", F.array().cast("array<string>")))))
    bound = settle(bound).withColumn("api_key", entity_key(F.lit("api"), F.col("source_id"), F.col("repository"), F.col("service")))
    entities.append(_entities(bound, "api", F.col("service"), F.col("repository"), F.lit("downstream-system"), F.col("support")))
    whole = F.array_union(F.array("evidence_id"), "support")
    edges.append(_edges(bound, "CONSUMES", "connector_key", "api_key", "HTTP", whole))

    # Providers by name: one is referred to, several are ambiguous, none is no error.
    providers = declared.select(F.col("service"), F.col("service_key").alias("provider_key"), "declared_by").groupBy("service").agg(F.count("*").alias("n"), F.min("provider_key").alias("provider_key"), F.min("declared_by").alias("declared_by"))
    # Names are few and some are frequent: written, they are broadcast as long as they are few.
    matched = bound.join(settle(providers), "service")
    edges.append(_edges(matched.where("n = 1"), "REFERENCES", "api_key", "provider_key", "CONFIGURED_SERVICE_TARGET", F.array_union(whole, "declared_by")))
    told.append(_diagnostics(matched.where("n > 1"), "downstream-provider-declaration-ambiguous", "service"))
    union = lambda frames: reduce(DataFrame.unionByName, frames).distinct()
    return union(entities), union(edges), union(told)


def merge(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates by key with the number of their evidence rows: (key, type, name, role, evidence) and (key, type, source_key, target_key, evidence).

    An entity that several producers made has the role of the first in ROLES.
    """
    strength = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    one = entities.groupBy("key").agg(F.min_by(F.struct("type", "name", "role"), F.struct(strength, "name")).alias("m"), F.count_distinct("evidence_id").alias("evidence"))
    key = F.concat("type", F.lit(":"), "source_key", F.lit("->"), "target_key")
    two = relationships.withColumn("key", key).groupBy("key", "type", "source_key", "target_key").agg(F.count_distinct("evidence_id").alias("evidence"))
    return one.select("key", "m.type", "m.name", "m.role", "evidence"), two
