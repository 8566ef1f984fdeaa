"""Queries of graph publication and journeys, over facts that documents stand for, each with its DuckDB SQL.

Eight documents make a repository, each a component with its symbols, calls and HTTP calls; every rule of the
analysis meets cases that hold, that are missing and that are ambiguous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, journey_graph
from .queries import query
from .roles import table

_OWN, _NEXT = "'pkg.C' || k", "'pkg.C' || (k + 1)"
_SERVICE = "'svc-' || ((r * 3 + k) % 11)"
_VALUE = f"""CASE doc_id % 5 WHEN 0 THEN 'c' || (k + 1) || '.url' WHEN 1 THEN 's"$' || '{{c' || (k + 1) || '.url}}/x"' WHEN 2 THEN 'config.baseUrl("' || {_SERVICE} || '")' WHEN 3 THEN 'this.other' ELSE 'baseUrl("' || {_SERVICE} || '")' END"""
_CALL = """CASE doc_id % 4 WHEN 0 THEN 'http.get[Json](s"$' || '{url}/a")' WHEN 1 THEN 'http.post(url"$c' || (k + 1) || '.url/x")' WHEN 2 THEN 'http.get(s"$' || 'url")' ELSE 'http.get(other)' END"""
#: Facts as parts of (condition, columns), in SQL that both engines read; doc_id, r (repository) and k (place in it) are given.
_FACTS: dict[str, list[tuple[str, dict[str, str]]]] = {
    "components": [("true", {"symbol": _OWN, "symbol_kind": "'class'", "role": "CASE k % 4 WHEN 0 THEN 'controller' WHEN 1 THEN 'connector' WHEN 2 THEN 'service' ELSE 'component' END", "evidence_id": "'c' || doc_id"})],
    "dependencies": [
        ("k < 7 AND doc_id % 3 <> 0", {"source": _OWN, "target": _NEXT, "parameter": "'c' || (k + 1)", "evidence_id": "'d' || doc_id"}),
        ("k < 7 AND doc_id % 7 = 0", {"source": _OWN, "target": "'pkg.C0'", "parameter": "'c' || (k + 1)", "evidence_id": "'x' || doc_id"}),
    ],
    "symbols": [
        ("true", {"kind": "'method'", "symbol": f"{_OWN} || '.run'", "owner": _OWN, "signature": "CASE WHEN doc_id % 17 = 0 THEN 'def run(url: String) =' ELSE 'def run(x: Int) =' END", "evidence_id": "'m' || doc_id"}),
        ("doc_id % 5 = 4", {"kind": "'method'", "symbol": f"{_OWN} || '.baseUrl'", "owner": _OWN, "signature": "'def baseUrl(name: String): String ='", "evidence_id": "'b' || doc_id"}),
        ("true", {"kind": "'value'", "symbol": f"{_OWN} || '.url'", "owner": _OWN, "signature": _VALUE, "evidence_id": "'v' || doc_id"}),
        ("doc_id % 5 = 3", {"kind": "'value'", "symbol": f"{_OWN} || '.other'", "owner": _OWN, "signature": f"""'config.baseUrl("' || {_SERVICE} || '")'""", "evidence_id": "'o' || doc_id"}),
        ("doc_id % 19 = 0", {"kind": "'value'", "symbol": f"{_OWN} || '.run.url'", "owner": _OWN, "signature": "'x'", "evidence_id": "'l' || doc_id"}),
        ("true", {"kind": "'constructor-parameter'", "symbol": "'config'", "owner": _OWN, "signature": "CASE WHEN doc_id % 13 = 0 THEN 'Other' ELSE 'uk.ServicesConfig' END", "evidence_id": "'p' || doc_id"}),
    ],
    "call_sites": [("doc_id % 5 = 4", {"enclosing": f"{_OWN} || '.baseUrl'", "receiver": "'config'", "target_text": "'config.baseUrl'", "excerpt": "'config.baseUrl( name )'", "evidence_id": "'w' || doc_id"})],
    "calls": [("k < 7", {"caller": f"{_OWN} || '.run'", "target": f"{_NEXT} || '.run'", "evidence_id": "'k' || doc_id"})],
    "routes": [("k = 0", {"document": "'conf/app.routes'", "route_set": "CASE WHEN r % 5 = 0 THEN 'prod' ELSE 'app' END", "method": "'GET'", "path": "'/items/' || r", "handler": "'pkg.C0.run'", "resolved": "CASE WHEN r % 4 <> 0 THEN 'pkg.C0.run' END", "evidence_id": "'r' || doc_id"})],
    "http": [("doc_id % 6 <> 0", {"enclosing": f"{_OWN} || '.run'", "excerpt": _CALL, "target_text": "'http.get'", "evidence_id": "'h' || doc_id"})],
    "settings": [
        ("k = 1", {"path": "repository || '/conf/application.conf'", "key": "'appName'", "value": "'svc-' || (r % 11)", "value_kind": "'string'", "evidence_id": "'a' || doc_id"}),
        ("k = 2 AND r % 6 = 5", {"path": "repository || '/conf/application.conf'", "key": "'appName'", "value": "'svc-x'", "value_kind": "'unquoted'", "evidence_id": "'a' || doc_id"}),
        ("k > 2 AND doc_id % 2 = 0", {"path": "repository || '/conf/application.conf'", "key": f"'microservice.services.' || {_SERVICE} || '.host'", "value": "'localhost'", "value_kind": "'string'", "evidence_id": "'s' || doc_id"}),
    ],
}
_BASE = {"doc_id": "doc_id", "source_id": "'src'", "r": "CAST(floor(doc_id / 8) AS BIGINT)", "k": "doc_id % 8"}


def _facts(spark, sf) -> dict[str, DataFrame]:
    base = table(spark, sf, "documents").where("doc_id IS NOT NULL").selectExpr(*[f"{e} AS {n}" for n, e in _BASE.items()]).withColumn("repository", F.expr("'repo' || r"))
    part = lambda where, columns: base.where(where).selectExpr("source_id", "repository", *[f"{e} AS {n}" for n, e in columns.items()])
    return {name: reduce(DataFrame.unionByName, [part(*p) for p in parts]) for name, parts in _FACTS.items()}


def _sql_facts() -> str:
    base = "SELECT *, 'repo' || r AS repository FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _BASE.items()) + " FROM documents WHERE doc_id IS NOT NULL)"
    base = base.replace("floor(doc_id / 8)", "doc_id // 8")
    parts = lambda ps: " UNION ALL ".join("SELECT source_id, repository, " + ", ".join(f"{e} AS {n}" for n, e in c.items()) + f" FROM base WHERE {w}" for w, c in ps)
    return f"base AS ({base}), " + ", ".join(f"f_{n} AS ({parts(p)})" for n, p in _FACTS.items())


_KEY = lambda kind, scope, name: f"'{kind}:src:' || url_encode({scope}) || ':' || url_encode({name if kind == 'module' else f'lower({name})'})"
_REF = r"'^(?:this\.)?([A-Za-z_$][\w$]*)(?:\.([A-Za-z_$][\w$]*))?$'"
_INNER = r"""'^s"\$\{?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\}?(?:/[^"$]*)?"$'"""
_ARG = r"""'^[\w$]+\s*\.\s*(?:get|post|put|patch|delete|head|options)(?:\[[^\]]+\])?\(\s*(?:url|s)"\$\{?([\w$]+(?:\.[\w$]+)?)\}?(?:/[^"]*)?"\s*\)$'"""
_plain = lambda e: f"CASE WHEN regexp_extract({e}, {_INNER}, 1) <> '' THEN regexp_extract({e}, {_INNER}, 1) ELSE {e} END"
_owner = lambda m: f"regexp_replace({m}, '\\.[^.]*$', '')"

#: Service names are followed one reference at a time, as the rule says it; the rest are joins.
_GRAPH = rf"""WITH RECURSIVE {_sql_facts()},
 mods AS (SELECT DISTINCT repository, symbol, {_KEY("module", "repository", "symbol")} AS key FROM f_components),
 vals AS (SELECT repository, symbol, min(signature) AS signature, min(evidence_id) AS ev FROM f_symbols WHERE kind = 'value' GROUP BY 1, 2 HAVING count(*) = 1),
 inj AS (SELECT repository, source AS owner, parameter AS head, min(target) AS injected, min(evidence_id) AS ev FROM f_dependencies GROUP BY 1, 2, 3 HAVING count(*) = 1),
 http AS (SELECT h.*, {_owner("enclosing")} AS owner, regexp_extract(excerpt, {_ARG}, 1) AS expression, m.key AS connector FROM f_http h JOIN mods m ON m.repository = h.repository AND m.symbol = {_owner("enclosing")}),
 starts AS (SELECT * FROM http h WHERE expression <> '' AND NOT EXISTS (SELECT 1 FROM f_symbols s WHERE s.kind = 'value' AND s.repository = h.repository AND s.symbol = h.enclosing || '.' || split_part(h.expression, '.', 1))
   AND NOT EXISTS (SELECT 1 FROM f_symbols s WHERE s.kind = 'method' AND s.repository = h.repository AND s.symbol = h.enclosing AND regexp_matches(s.signature, '\b' || split_part(h.expression, '.', 1) || '\s*:'))),
 walk AS (SELECT evidence_id AS id, repository, owner, {_plain("expression")} AS e, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS ev FROM starts UNION ALL
   SELECT id, w.repository, w.at, {_plain("v.signature")}, list_append(w.seen, v.symbol), w.ev || [v.ev] || CASE WHEN w.tail <> '' THEN [w.iev] ELSE [] END FROM (
     SELECT x.*, CASE WHEN tail = '' THEN x.owner ELSE i.injected END AS at, i.ev AS iev FROM (SELECT *, regexp_extract(e, {_REF}, 1) AS head, regexp_extract(e, {_REF}, 2) AS tail FROM walk WHERE regexp_matches(e, {_REF}) AND len(seen) < 7) x
     LEFT JOIN inj i ON i.repository = x.repository AND i.owner = x.owner AND i.head = x.head) w
   JOIN vals v ON v.repository = w.repository AND v.symbol = w.at || '.' || CASE WHEN w.tail = '' THEN w.head ELSE w.tail END WHERE NOT list_contains(w.seen, v.symbol)),
 conf AS (SELECT repository, owner, symbol AS receiver, min(evidence_id) AS ev FROM f_symbols WHERE kind = 'constructor-parameter' AND regexp_matches(signature, '^([\w$]+\.)*ServicesConfig$') GROUP BY 1, 2, 3),
 named AS (SELECT w.id, regexp_extract(e, '"([a-z0-9-]+)"', 1) AS service, w.ev || [c.ev] AS ev FROM walk w JOIN conf c ON c.repository = w.repository AND c.owner = w.owner AND e LIKE c.receiver || '.baseUrl("%' UNION ALL
   SELECT w.id, regexp_extract(e, '"([a-z0-9-]+)"', 1), w.ev || [m.evidence_id, s.evidence_id, c.ev] FROM walk w JOIN f_symbols m ON m.repository = w.repository AND m.kind = 'method' AND m.symbol = w.owner || '.baseUrl'
   JOIN f_call_sites s ON s.repository = w.repository AND s.enclosing = m.symbol JOIN conf c ON c.repository = w.repository AND c.owner = w.owner AND c.receiver = s.receiver WHERE e LIKE 'baseUrl("%'),
 hosts AS (SELECT repository, regexp_extract(key, 'services\.(.*)\.host', 1) AS service, list(evidence_id) AS ev FROM f_settings WHERE key LIKE 'microservice%' GROUP BY 1, 2),
 bound AS (SELECT h.*, n.service, n.ev || coalesce(x.ev, []) AS support, x.ev AS hosts, {_KEY("api", "h.repository", "n.service")} AS api FROM http h JOIN named n ON n.id = h.evidence_id LEFT JOIN hosts x ON x.repository = h.repository AND x.service = n.service),
 names AS (SELECT repository, list_sort(list(DISTINCT value)) AS vs, list(evidence_id) AS ev FROM f_settings WHERE key = 'appName' GROUP BY 1),
 decl AS (SELECT repository, vs[1] AS service, ev, {_KEY("api", "repository", "vs[1]")} AS key FROM names WHERE len(vs) = 1),
 prov AS (SELECT service, count(*) AS n, min(key) AS key, min(ev) AS ev FROM decl GROUP BY 1),
 tied AS (SELECT d.repository, s.key AS a, t.key AS b, d.evidence_id FROM f_dependencies d JOIN mods s ON s.repository = d.repository AND s.symbol = d.source JOIN mods t ON t.repository = d.repository AND t.symbol = d.target),
 ops AS (SELECT *, method || ' ' || path AS name, {_KEY("operation", "repository || '/' || document || '/' || route_set || '/' || url_encode(method) || '/' || url_encode(path) || '/' || url_encode(handler)", "method || ' ' || path")} AS key FROM f_routes WHERE route_set = 'app'),
 handled AS (SELECT o.*, m.key AS controller, d.evidence_id AS declaration FROM ops o JOIN mods m ON m.repository = o.repository AND m.symbol = {_owner("o.resolved")} LEFT JOIN f_symbols d ON d.repository = o.repository AND d.kind = 'method' AND d.symbol = o.resolved),
 ent AS (SELECT {_KEY("module", "repository", "symbol")} AS key, 'module' AS type, symbol AS name, role, evidence_id AS ev FROM f_components UNION SELECT key, 'api', service, 'declared-service', unnest(ev) FROM decl
   UNION SELECT key, 'operation', name, 'route', evidence_id FROM ops UNION SELECT api, 'api', service, 'downstream-system', unnest(support) FROM bound),
 rel AS (SELECT 'DEPENDS_ON' AS type, a, b, 'constructor-injection' AS relation, evidence_id AS ev FROM tied
   UNION SELECT 'USES', s.key, t.key, 'CALLS', unnest(list_filter([c.evidence_id, m.evidence_id, i.evidence_id], lambda x: x IS NOT NULL)) FROM f_calls c JOIN mods s ON s.repository = c.repository AND s.symbol = {_owner("c.caller")} JOIN mods t ON t.repository = c.repository AND t.symbol = {_owner("c.target")}
     LEFT JOIN f_symbols m ON m.repository = c.repository AND m.kind = 'method' AND m.symbol = c.target LEFT JOIN tied i ON i.a = s.key AND i.b = t.key
   UNION SELECT 'EXPOSES', d.key, o.key, 'DECLARED_SERVICE_ROUTE', unnest(d.ev || [o.evidence_id]) FROM ops o JOIN decl d ON d.repository = o.repository
   UNION SELECT 'USES', key, controller, 'IMPLEMENTED_BY', unnest(list_filter([evidence_id, declaration], lambda x: x IS NOT NULL)) FROM handled
   UNION SELECT 'EXPOSES', controller, key, 'EXPOSES_ENDPOINT', unnest(list_filter([evidence_id, declaration], lambda x: x IS NOT NULL)) FROM handled
   UNION SELECT 'CONSUMES', connector, api, 'HTTP', unnest(support || [evidence_id]) FROM bound
   UNION SELECT 'REFERENCES', api, p.key, 'CONFIGURED_SERVICE_TARGET', unnest(support || [evidence_id] || p.ev) FROM bound b JOIN prov p ON p.service = b.service AND p.n = 1),
 diag AS (SELECT s.evidence_id, 'provider-appName-declaration-ambiguous' AS reason, array_to_string(n.vs, ', ') AS target FROM f_settings s JOIN names n ON n.repository = s.repository AND len(vs) > 1 WHERE s.key = 'appName'
   UNION SELECT evidence_id, 'http-downstream-not-exactly-resolved', target_text FROM http WHERE evidence_id NOT IN (SELECT id FROM named) UNION SELECT evidence_id, 'downstream-hocon-host-not-found', service FROM bound WHERE hosts IS NULL
   UNION SELECT evidence_id, 'downstream-provider-declaration-ambiguous', b.service FROM bound b JOIN prov p ON p.service = b.service AND p.n > 1)"""
_STRENGTH = "list_position([" + ", ".join(f"'{r}'" for r in graph.ROLES) + "], role)"


@query(f"{_GRAPH} SELECT key, any_value(type) AS type, any_value(name) AS name, arg_min(role, {_STRENGTH}) AS role, count(DISTINCT ev) AS evidence FROM ent GROUP BY 1")
def graph_entities(spark, sf):
    """Services, components and operations that the analysis publishes."""
    entities, edges, _ = graph.publish_analysis(_facts(spark, sf))
    return graph.merge(entities, edges)[0]


@query(f"{_GRAPH} SELECT type || ':' || a || '->' || b AS key, type, a AS source_key, b AS target_key, count(DISTINCT ev) AS evidence FROM rel WHERE a <> b GROUP BY 1, 2, 3, 4")
def graph_relationships(spark, sf):
    """The five kinds of edges between them."""
    entities, edges, _ = graph.publish_analysis(_facts(spark, sf))
    return graph.merge(entities, edges)[1]


@query(f"{_GRAPH} SELECT evidence_id, 'unresolved' AS disposition, reason, target FROM diag")
def graph_diagnostics(spark, sf):
    """What could not be resolved, and why."""
    return graph.publish_analysis(_facts(spark, sf))[2]


# ---------------------------------------------------------------- journeys

_ENTRY = "'journey:src:' || 'repo' || r || ':j'"
_JOURNEYS: dict[str, list[tuple[str, dict[str, str]]]] = {
    "journeys": [("k = 0 AND r % 5 <> 0", {"journey_key": _ENTRY, "name": "'j' || r", "scope": "repository || '/journey/j' || r"})],
    "evidence": [("r % 5 <> 0", {"journey_key": _ENTRY, "evidence_id": "'k' || doc_id", "path": "repository || '/app/C' || k || '.scala'"}), ("r % 5 <> 0 AND doc_id % 6 <> 0", {"journey_key": _ENTRY, "evidence_id": "'h' || doc_id", "path": "repository || '/app/C' || k || '.scala'"})],
    "references": [("r % 5 <> 0 AND doc_id % 9 <> 0", {"journey_key": _ENTRY, "entity_key": "'module:src:repo' || r || ':pkg.C' || k", "role": "CASE k % 4 WHEN 2 THEN 'service' ELSE 'component' END"})],
    "steps": [
        ("r % 5 <> 0", {"journey_key": _ENTRY, "position": "CAST(2 * k + 1 AS INT)", "step_id": "'m' || doc_id", "step_type": "'MethodStep'", "entity_key": "'module:src:repo' || r || ':pkg.C' || k"}),
        ("r % 5 <> 0 AND doc_id % 6 <> 0", {"journey_key": _ENTRY, "position": "CAST(2 * k + 2 AS INT)", "step_id": "'h' || doc_id", "step_type": "'HttpClientCallStep'", "entity_key": "CAST(NULL AS CHAR(1))"}),
    ],
    "step_evidence": [
        ("r % 5 <> 0", {"journey_key": _ENTRY, "position": "CAST(2 * k + 1 AS INT)", "evidence_id": "CASE WHEN doc_id % 23 = 0 THEN 'lost' ELSE 'k' || doc_id END"}),
        ("r % 5 <> 0 AND doc_id % 6 <> 0 AND doc_id % 29 <> 0", {"journey_key": _ENTRY, "position": "CAST(2 * k + 2 AS INT)", "evidence_id": "'h' || doc_id"}),
    ],
}


def _journeys(spark, sf) -> dict[str, DataFrame]:
    base = table(spark, sf, "documents").where("doc_id IS NOT NULL").selectExpr(*[f"{e} AS {n}" for n, e in _BASE.items()]).withColumn("repository", F.expr("'repo' || r"))
    part = lambda where, columns: base.where(where).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()], "source_id")
    return {name: reduce(DataFrame.unionByName, [part(*p) for p in parts]) for name, parts in _JOURNEYS.items()}


_JSQL = (
    _GRAPH + ", " + ", ".join(f"j_{n} AS (" + " UNION ALL ".join("SELECT " + ", ".join(f"{e} AS {c}" for c, e in cs.items()) + f" FROM base WHERE {w}" for w, cs in ps) + ")" for n, ps in _JOURNEYS.items())
    + rf""", src AS (SELECT *, {_KEY("document", "path", "parse_filename(path)")} AS doc FROM j_evidence),
 st AS (SELECT s.*, j.name || ' [' || position || '] ' || step_type AS step_name, {_KEY("operation", "j.scope || '/step/' || (position - 1)", "j.name || ' [' || position || '] ' || step_type")} AS step_key FROM j_steps s JOIN j_journeys j ON j.journey_key = s.journey_key),
 cited AS (SELECT st.*, e.evidence_id FROM st JOIN j_step_evidence e ON e.journey_key = st.journey_key AND e.position = st.position),
 ok AS (SELECT journey_key, entity_key FROM j_references UNION SELECT journey_key, doc FROM src),
 calls AS (SELECT DISTINCT a AS caller, b AS api, ev FROM rel WHERE type = 'CONSUMES'),
 hit AS (SELECT DISTINCT journey_key, position, step_key, caller, api FROM cited JOIN calls ON ev = evidence_id WHERE step_type = 'HttpClientCallStep'),
 bind AS (SELECT a AS api, b AS provider, ev FROM rel WHERE type = 'REFERENCES' AND a <> b),
 jrel AS (SELECT 'DERIVED_FROM' AS type, journey_key AS a, doc AS b, 'JOURNEY_SOURCE_EVIDENCE' AS relation, evidence_id AS ev FROM src UNION SELECT 'CONTAINS', journey_key, step_key, 'JOURNEY_CONTAINS_STEP', evidence_id FROM cited
   UNION SELECT 'DERIVED_FROM', c.step_key, s.doc, 'STEP_SOURCE_EVIDENCE', c.evidence_id FROM cited c JOIN src s ON s.journey_key = c.journey_key AND s.evidence_id = c.evidence_id
   UNION SELECT 'REFERENCES', c.step_key, c.entity_key, 'STEP_REFERENCES', c.evidence_id FROM cited c JOIN ok ON ok.journey_key = c.journey_key AND ok.entity_key = c.entity_key
   UNION SELECT 'CONSUMES', journey_key, hit.api, 'JOURNEY_CALLS_API', ev FROM hit JOIN calls ON calls.caller = hit.caller AND calls.api = hit.api UNION SELECT 'CONSUMES', step_key, hit.api, 'STEP_CALLS_API', ev FROM hit JOIN calls ON calls.caller = hit.caller AND calls.api = hit.api
   UNION SELECT 'REFERENCES', journey_key, provider, 'JOURNEY_REFERENCES_PROVIDER', ev FROM hit JOIN bind ON bind.api = hit.api
   UNION SELECT 'USES', r.journey_key, r.entity_key, CASE WHEN role = 'service' THEN 'JOURNEY_PARTICIPATES_IN_SERVICE' ELSE 'JOURNEY_REFERENCES' END, e.evidence_id FROM j_references r JOIN j_evidence e ON e.journey_key = r.journey_key),
 subj AS (SELECT st.journey_key, st.position, coalesce(st.entity_key, (SELECT min(api) FROM hit WHERE hit.journey_key = st.journey_key AND hit.position = st.position HAVING count(DISTINCT api) = 1)) AS subject FROM st),
 jref AS (SELECT journey_key, position, step_key AS entity_key, 'step' AS role FROM st UNION SELECT c.journey_key, c.position, s.doc, 'document' FROM cited c JOIN src s ON s.journey_key = c.journey_key AND s.evidence_id = c.evidence_id
   UNION SELECT journey_key, position, api, 'api' FROM hit UNION SELECT journey_key, position, provider, 'api' FROM hit JOIN bind ON bind.api = hit.api
   UNION SELECT c.journey_key, c.position, c.entity_key, r.role FROM cited c JOIN j_references r ON r.journey_key = c.journey_key AND r.entity_key = c.entity_key)"""
)


def _linked(spark, sf):
    entities, edges, _ = graph.publish_analysis(_facts(spark, sf))
    given = _journeys(spark, sf)
    return journey_graph.link_journeys(given["journeys"], given["evidence"], given["references"].drop("source_id"), given["steps"].drop("source_id"), given["step_evidence"].drop("source_id"), edges, entities)


@query(f"{_JSQL} SELECT type, a AS source_key, b AS target_key, relation, ev AS evidence_id FROM jrel")
def journey_links(spark, sf):
    """What journeys, one a repository, contain, use, consume and are derived from."""
    return _linked(spark, sf)[1]


@query(f"{_JSQL} SELECT f.journey_key, f.position, f.entity_key, f.role, coalesce(f.entity_key = s.subject, false) AS is_subject FROM jref f JOIN subj s ON s.journey_key = f.journey_key AND s.position = f.position")
def journey_step_references(spark, sf):
    """The entities that each step refers to, and which of them it is about."""
    return _linked(spark, sf)[2]


@query(
    f"{_JSQL} SELECT c.journey_key, c.position, 'unknown-subject' AS problem, c.entity_key AS object FROM cited c WHERE c.entity_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.journey_key = c.journey_key AND ok.entity_key = c.entity_key) "
    "UNION SELECT c.journey_key, c.position, 'unknown-source', c.evidence_id FROM cited c WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.journey_key = c.journey_key AND s.evidence_id = c.evidence_id) "
    "UNION SELECT journey_key, position, 'no-evidence', step_id FROM st WHERE NOT EXISTS (SELECT 1 FROM j_step_evidence e WHERE e.journey_key = st.journey_key AND e.position = st.position)"
)
def journey_violations(spark, sf):
    """Steps about entities outside their journey, citing sources outside it, or citing nothing."""
    return _linked(spark, sf)[3]


_SIZED = """p AS (SELECT source AS journey_key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, length(text) + 1 AS c, strlen(text) + 1 AS b, doc_id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
 s AS (SELECT *, sum(c) OVER w AS sc, sum(b) OVER w AS sb, count(*) OVER (PARTITION BY journey_key) AS n, '{"key":"step' || (pos + 1) || ':publication-size-limit","reason":"journey-publication-size-limit:' || (count(*) OVER (PARTITION BY journey_key) - pos) || '-steps-omitted","target":"step' || (pos + 1) || '","evidenceRef":"e"}' AS j
   FROM p WINDOW w AS (PARTITION BY journey_key ORDER BY pos)),
 z AS (SELECT *, sc + CASE WHEN pos = n THEN 0 ELSE 2 * length(j) END AS tc, sb + CASE WHEN pos = n THEN 0 ELSE 2 * strlen(j) END AS tb FROM s)"""


@query(
    f"WITH {_SIZED} SELECT journey_key, CAST(any_value(n) AS INTEGER) AS steps, CAST(max(pos) FILTER (tc <= 60000 AND tb <= 61000) AS INTEGER) AS kept, CAST(any_value(n) - max(pos) FILTER (tc <= 60000 AND tb <= 61000) AS INTEGER) AS omitted, "
    "CAST(arg_max(tc, pos) FILTER (tc <= 60000 AND tb <= 61000) AS BIGINT) AS chars, CAST(arg_max(tb, pos) FILTER (tc <= 60000 AND tb <= 61000) AS BIGINT) AS bytes FROM z GROUP BY 1"
)
def journey_budgets(spark, sf):
    """Sources as journeys whose steps are the documents: how many fit 60,000 characters and 61,000 bytes."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    order = Window.partitionBy("source").orderBy("doc_id")
    pieces = docs.select(F.col("source").alias("journey_key"), F.row_number().over(order).alias("at"), (F.char_length("text") + 1).alias("chars"), (F.octet_length("text") + 1).alias("bytes"))
    next_step = F.concat(F.lit("step"), (F.col("kept") + 1).cast("string"))
    return journey_graph.kept_steps(pieces, journey_graph.size_boundary(next_step, F.lit("e")), 60_000, 61_000)
