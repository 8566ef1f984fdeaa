"""Documents to located evidence: one processor for each format.

A processor turns rows of (document_id, path, text) into evidence rows (document_id, key, kind,
excerpt, truncated, locator).  Formats whose lines stand alone use DataFrame functions; formats
that carry state from line to line are read by a small generator per document inside
``mapInArrow``.  Documents that cannot be parsed give a row of kind ``rejected``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import EXCERPT, extension, filename, lines_of, trimmed

_LOCATOR = (
    T.StructType()
    .add("line_start", "integer")
    .add("line_end", "integer")
    .add("heading_path", T.ArrayType(T.StringType()))
    .add("pointer", "string")
    .add("symbol", "string")
    .add("value_kind", "string")
    .add("detail", T.MapType(T.StringType(), T.StringType()))
)
EVIDENCE = T.StructType().add("document_id", "long").add("key", "string").add("kind", "string").add("excerpt", "string").add("truncated", "boolean").add("locator", _LOCATOR)
#: Fixed registry: how the filename is matched, processor, extraction rule.
DEFINITIONS = [
    ("suffix", ".md", "markdown", "markdown-blocks"),
    ("suffix", ".markdown", "markdown", "markdown-blocks"),
    ("suffix", ".yaml", "yaml", "yaml-scalar-values"),
    ("suffix", ".yml", "yaml", "yaml-scalar-values"),
    ("suffix", ".json", "json", "json-scalar-values"),
    ("suffix", ".txt", "plain-text", "text-paragraphs"),
    ("suffix", ".ts", "typescript", "typescript-imports"),
    ("suffix", ".scala", "scala-source", "scala-symbols-and-calls"),
    ("suffix", ".routes", "play-routes", "play-route-declarations"),
    ("suffix", ".conf", "hocon", "hocon-key-values"),
    ("exact", "dockerfile", "dockerfile", "dockerfile-base-images"),
    ("suffix", ".dockerfile", "dockerfile", "dockerfile-base-images"),
]
#: Bounds on the evidence of one routes, configuration or Scala document; beyond them it is rejected as a whole.
MAX_FACTS, MAX_BYTES = 2000, 500_000


def _locator(**given: Column) -> Column:
    kinds = EVIDENCE["locator"].dataType
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields])


def _columns(key: Column, kind: str, text: Column, locator: Column) -> list[Column]:
    bare = trimmed(text)
    return [key.alias("key"), F.lit(kind).alias("kind"), F.left(bare, F.lit(EXCERPT)).alias("excerpt"), (F.char_length(bare) > EXCERPT).alias("truncated"), locator.alias("locator")]


def _evidence(df: DataFrame, key: Column, kind: str, text: Column, locator: Column) -> DataFrame:
    return df.select("document_id", *_columns(key, kind, text, locator))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(document_id, path, number, line) from 1 on, with any line ends."""
    return docs.select("document_id", "path", F.posexplode(lines_of(F.coalesce("text", F.lit(""))))).select("document_id", "path", (F.col("pos") + 1).alias("number"), F.col("col").alias("line"))


def plain_text(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, their lines trimmed and joined by a space."""
    order = Window.partitionBy("document_id").orderBy("number")
    lines = numbered_lines(docs).withColumn("bare", trimmed(F.col("line")))
    island = F.col("number") - F.row_number().over(order)
    full = lines.where("bare <> ''").withColumn("island", island)
    joined = full.groupBy("document_id", "island").agg(
        F.min("number").alias("first"), F.max("number").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "bare"))), lambda x: x["bare"]), " ").alias("text")
    )
    key = F.concat(F.lit("text:"), F.col("first").cast("string"), F.lit(":paragraph"))
    return _evidence(joined, key, "paragraph", F.col("text"), _locator(line_start=F.col("first"), line_end=F.col("last")))


def dockerfile(docs: DataFrame) -> DataFrame:
    found = numbered_lines(docs).where(F.col("line").rlike(r"(?i)^\s*FROM\s+"))
    key = F.concat(F.lit("dockerfile:"), F.col("number").cast("string"), F.lit(":from"))
    return _evidence(found, key, "code-block", F.col("line"), _locator(line_start=F.col("number"), line_end=F.col("number")))


def route_set(path: Column) -> Column:
    name = F.lower(filename(path))
    # Fixed values.
    return (
        F.when(name == "app.routes", "app")
        .when(name == "prod.routes", "production-mounts")
        .when(name.contains("testonly") | name.contains("test-only"), "test-only")
        .when(name == "definition.routes", "definition")
        .otherwise("other")
    )


def play_routes(docs: DataFrame) -> DataFrame:
    """Mounts (``-> prefix target``) and routes (``METHOD path handler``); repeats are numbered.

    Texts are read once: lines of both kinds are dealt by document, where repeats and a document's facts are counted.
    """
    mount, route = r"^->\s+(\S+)\s+(\S+)$", r"^([A-Z]+)\s+(\S+)(?:\s+(.+?))?$"
    lines = numbered_lines(docs).withColumn("bare", trimmed(F.col("line"))).drop("line")
    lines = lines.where("bare <> '' AND NOT startswith(bare, '#')").where(F.col("bare").rlike(mount) | F.col("bare").rlike(route))
    part = lambda pattern, n: F.regexp_extract("bare", pattern, n)
    is_mount = F.startswith("bare", F.lit("->"))
    lines = lines.repartition("document_id").select("*", route_set(F.col("path")).alias("set"), is_mount.alias("is_mount"), *[F.when(is_mount, part(mount, n)).alias(name) for n, name in ((1, "prefix"), (2, "target"))], *[F.when(~is_mount, part(route, n)).alias(name) for n, name in ((1, "method"), (2, "declared"), (3, "handler"))])
    again, whole = Window.partitionBy("document_id", "method", "declared", "handler").orderBy("number"), Window.partitionBy("document_id")
    lines = lines.withColumn("repeat", F.row_number().over(again)).withColumn("base", F.concat_ws("\x00", "method", "declared", "handler"))
    mount_key = F.concat_ws(":", F.lit("mount"), "path", F.col("number").cast("string"), "prefix", "target")
    route_key = F.concat_ws(":", F.lit("route"), "path", "set", "base", F.col("repeat").cast("string"))
    mounted = F.create_map(F.lit("route_set"), F.col("set"), F.lit("mount_prefix"), F.col("prefix"), F.lit("include_target"), F.col("target"))
    routed = F.create_map(F.lit("route_set"), F.col("set"), F.lit("method"), F.col("method"), F.lit("path"), F.col("declared"), F.lit("handler"), F.col("handler"))
    place = _locator(line_start=F.col("number"), line_end=F.col("number"), detail=F.when(F.col("is_mount"), mounted).otherwise(routed))
    excerpt = F.left("bare", F.lit(EXCERPT))
    sized = lines.withColumns({"n": F.count("*").over(whole), "bytes": F.sum(F.octet_length(excerpt)).over(whole), "at": F.row_number().over(whole.orderBy("number"))})
    much, unnamed = (F.col("n") > MAX_FACTS) | (F.col("bytes") > MAX_BYTES), F.col("document_id").isNull()
    fact = F.struct(*_columns(F.when(F.col("is_mount"), mount_key).otherwise(route_key), "structured-value", F.col("bare"), place))
    rejected = F.struct(*_columns(F.lit("rejected"), "rejected", F.lit("too much evidence"), _locator()))
    # The first row of a document that says too much stands for all; facts of no document stay.
    told = F.array_compact(F.array(F.when(~much | unnamed, fact), F.when(much & (F.col("at") == 1), rejected)))
    return sized.select("document_id", F.inline(told))


#: Texts that are Python objects at once, and evidence rows of one Arrow batch.
TEXTS, FACTS = 32, 2000


def per_document(docs: DataFrame, read: Callable[[str, str], Iterator[tuple]], bounded: bool = False) -> DataFrame:
    """Evidence from a generator of (key, kind, text, locator dict) for each document's path and text.

    A ``bounded`` format rejects documents with more than MAX_FACTS facts or MAX_BYTES bytes of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(EVIDENCE)
        out: list[dict] = []
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                for id_, path, text in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    try:
                        found = list(read(path or "", text or ""))
                    except ValueError as error:
                        found = [("rejected", "rejected", str(error), {})]
                    if bounded and (len(found) > MAX_FACTS or sum(len(t.encode("utf-8", "replace")) for _, _, t, _ in found) > MAX_BYTES):
                        found = [("rejected", "rejected", "too much evidence", {})]
                    for key, kind, body, where in found:
                        bare = body.strip()
                        full = {f.name: where.get(f.name) for f in EVIDENCE["locator"].dataType.fields}
                        full["detail"] = list(where["detail"].items()) if where.get("detail") else None
                        out.append({"document_id": id_, "key": key, "kind": kind, "excerpt": bare[:EXCERPT], "truncated": len(bare) > EXCERPT, "locator": full})
                        if len(out) == FACTS:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return docs.select("document_id", "path", "text").mapInArrow(run, EVIDENCE)


_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.+?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_ITEM = re.compile(r"^\s*(?:[-+*]|\d+[.)])\s+")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_LINK = re.compile(r"(?<!!)\[(?:[^\]\\]|\\.)*\]\(\s*<?([^\s)>]+)>?(?:\s+[\"'][^)]*)?\)")
_META = re.compile(r"^(?:\*\*)?(?:Status|Supersedes|Superseded[- ]by|Related decisions|References|ADR-ID):(?:\*\*)?\s*.+$", re.IGNORECASE)


def _split(text: str) -> list[str]:
    return re.sub(r"\r\n?", "\n", text).split("\n")


def read_markdown(path: str, text: str) -> Iterator[tuple]:
    """Headings, fenced code, list items, table rows and paragraphs, then links and metadata lines.

    Inline links are found by pattern outside code blocks; reference-style links are not resolved.
    """
    heads: dict[int, str] = {}
    open_: tuple[str, int, list[str], str] | None = None  # kind, first line, lines, fence mark
    blocks: list[tuple[str, str, int, int, list[str] | None, list[str]]] = []

    def close(last: int) -> None:
        nonlocal open_
        if open_:
            kind, first, lines, _ = open_
            blocks.append((kind, ("\n" if kind == "code" else " ").join(lines), first, last, [heads[d] for d in sorted(heads)], lines))
            open_ = None

    for number, line in enumerate(_split(text), 1):
        if open_ and open_[0] == "code":
            open_[2].append(line)
            if re.match(rf"^\s*{re.escape(open_[3])}{{3,}}\s*$", line):
                close(number)
            continue
        heading, fence = _HEADING.match(line), _FENCE.match(line)
        if not line.strip() or heading or fence or _ITEM.match(line) or _ROW.match(line):
            close(number - 1)
        if not line.strip():
            continue
        if heading:
            depth = len(heading[1])
            heads = {d: h for d, h in heads.items() if d < depth} | {depth: heading[2].strip()}
            blocks.append(("heading", heading[2], number, number, None, [line]))
        elif fence:
            open_ = ("code", number, [line], fence[1][0])
        elif _ITEM.match(line) or _ROW.match(line):
            blocks.append(("list" if _ITEM.match(line) else "table", line, number, number, [heads[d] for d in sorted(heads)], [line]))
        elif open_:
            open_[2].append(line.strip())
        else:
            open_ = ("paragraph", number, [line.strip()], "")
    close(len(_split(text)))
    kinds = {"code": "code-block", "list": "list-item", "table": "table-row"}
    for name, body, first, last, above, _ in blocks:
        yield f"markdown:{first}:{name}", kinds.get(name, name), body, {"line_start": first, "line_end": last, "heading_path": above}
    for name, _, first, last, _, lines in blocks:
        if name == "code":
            continue
        where = {"line_start": first, "line_end": last}
        content = " ".join(lines)
        if _META.match(content):
            yield f"markdown-metadata:{first}", "structured-value", content, where
        for n, found in enumerate(_LINK.finditer(content)):
            yield f"markdown-link:{first}:{n}", "structured-value", found[1], where


def _pointer(part: str) -> str:
    return part.replace("~", "~0").replace("/", "~1")


def _scalar(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def _leaves(value, at: str = "") -> Iterator[tuple[str, object]]:
    if isinstance(value, dict):
        for key in sorted(value):
            yield from _leaves(value[key], f"{at}/{_pointer(key)}")
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from _leaves(item, f"{at}/{i}")
    else:
        yield at, value


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


#: Pointers whose scalar type is evidence too (fixed values).
_METHODS = "get|put|post|delete|options|head|patch|trace"
_NEEDS = "dependencies|devDependencies|optionalDependencies|peerDependencies"
_TYPED = re.compile(rf"^/(?:name|openapi|info/(?:title|version)|paths/[^/]+/(?:{_METHODS})/operationId|(?:{_NEEDS})/[^/]+|main|module|types|typings|files/\d+|exports(?:/.*)?)$")


def read_json(path: str, text: str) -> Iterator[tuple]:
    """Every scalar by its pointer, keys in order; and the type of scalars that extractors rely on."""
    for at, value in _leaves(json.loads(text, parse_constant=_no_constant)):
        yield f"json:{at}", "structured-value", _scalar(value), {"pointer": at}
        if _TYPED.match(at):
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
            yield f"json-type:{at}", "structured-value", kind, {"pointer": at}


def read_yaml(path: str, text: str) -> Iterator[tuple]:
    """Every scalar by its pointer with its lines; needs PyYAML on the executors."""
    import yaml

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error

    def walk(node, at: str) -> Iterator[tuple]:
        if isinstance(node, yaml.MappingNode):
            names = [k.value for k, _ in node.value]
            if len(set(names)) < len(names):
                raise ValueError(f"repeated key below {at or '/'}")
            for key, value in sorted(node.value, key=lambda kv: kv[0].value):
                yield from walk(value, f"{at}/{_pointer(key.value)}")
        elif isinstance(node, yaml.SequenceNode):
            for i, item in enumerate(node.value):
                yield from walk(item, f"{at}/{i}")
        elif node is not None:
            last = node.end_mark.line + (node.end_mark.column > 0 or node.end_mark.line == node.start_mark.line)
            where = {"pointer": at, "line_start": node.start_mark.line + 1, "line_end": last}
            yield f"yaml:{at}", "structured-value", node.value, where
            if _TYPED.match(at):
                kind = {"null": "null", "bool": "boolean", "int": "number", "float": "number"}.get(node.tag.rsplit(":", 1)[-1], "string")
                yield f"yaml-type:{at}", "structured-value", kind, where

    yield from walk(root, "")


#: Tokens of HOCON: long and short strings, substitutions, comments, line ends, signs, bare text.
_HOCON_TOKEN = re.compile(
    r'''(?P<long>"""[\s\S]*?"""+)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\$\{[^}\n]*\}|[^\s"'$\#/{}=:]+)'''
    r"""|(?P<comment>(?:\#|//)[^\n]*)|(?P<end>\r?\n|\r)|(?P<open>\{)|(?P<close>\})|(?P<is>[=:])|(?P<other>.)""",
)
#: Words of keys whose values are never shown (fixed values).
_SENSITIVE = re.compile(r"(?i)(?:password|secret|token|credential|api[-_.]?key|private[-_.]?key|authorization)|(?:^|\.)uri(?:$|\.)")
_SUBSTITUTION = re.compile(r"\$\{(\??[^}]+)\}")
_USER_IN_URL = re.compile(r"://[^/\s@]+:[^/\s@]+@")
#: Kinds of a value; the first rule that holds for (key, value) decides.
_VALUE_KINDS = (
    ("redacted", lambda k, v: _SENSITIVE.search(k) or _USER_IN_URL.search(v)),
    ("unsupported", lambda k, v: not v or len(v) > 2000 or v[0] in "{[" or v.startswith('"""')),
    ("substitution", lambda k, v: "${" in v and not _SUBSTITUTION.sub("", v).strip()),
    ("unsupported", lambda k, v: _SUBSTITUTION.search(v)),
    ("string", lambda k, v: re.fullmatch(r'"(?:[^"\\]|\\.)*"|\'[^\']*\'', v)),
    ("unsupported", lambda k, v: v[0] in "'\"" or len(v.split()) > 1),
    ("boolean", lambda k, v: v in ("true", "false")),
    ("number", lambda k, v: re.fullmatch(r"-?\d+(?:\.\d+)?", v)),
    ("unquoted", lambda k, v: True),
)


def value_kind(key: str, value: str) -> str:
    return next(kind for kind, holds in _VALUE_KINDS if holds(key, value))


def _key_path(said: str) -> list[str] | None:
    """The parts of a key, quoted parts whole; None if it is no single key."""
    said = said.strip()
    if re.fullmatch(r'"(?:[^"\\]|\\.)*"', said):
        return [said[1:-1]]
    return [part for part in said.split(".") if part] if said and not re.search(r"\s", said) else None


class _Scan:
    """The state of one pass over the tokens: open objects, the key being read and its value, if it has begun."""

    def __init__(self) -> None:
        self.objects: list[list[str]] = []
        self.key, self.value, self.line = "", None, 1

    def add(self, token: str) -> None:
        if self.value is None:
            self.key += token
        else:
            self.value += token

    def finish(self) -> tuple[int, str, str] | None:
        """End an entry: open an object, or return (line, dotted key, raw value) of an assignment."""
        key, value = self.key, self.value
        self.key, self.value = "", None
        opens = key.rstrip().endswith("{") if value is None else value.strip() == "{"
        parts = _key_path(key.rstrip()[:-1] if opens and value is None else key)
        if opens:
            self.objects.append(parts or [])
        elif value is not None and parts:
            return self.line, ".".join(part for path in [*self.objects, parts] for part in path), value.strip()
        return None


def _assignments(text: str) -> Iterator[tuple[int, str, str]]:
    scan = _Scan()
    for found in _HOCON_TOKEN.finditer(text + "\n"):
        kind, token = found.lastgroup, found[0]
        if kind == "end":
            made = scan.finish()
            if made:
                yield made
            scan.line += 1
        elif kind == "is" and scan.value is None and scan.key.strip():
            scan.value = ""
        elif kind == "close" and scan.value is None and not scan.key.strip():
            del scan.objects[-1:]
        elif kind != "comment":
            scan.add(token)
            scan.line += token.count("\n")


def read_hocon(path: str, text: str) -> Iterator[tuple]:
    """Assignments with their dotted key; secrets are redacted, values that need merging unsupported."""
    for number, key, value in _assignments(text):
        kind = value_kind(key, value)
        shown = {"redacted": "<redacted>", "unsupported": "<unsupported>"}.get(kind, value)
        detail = {"key": key}
        if kind == "substitution":
            detail["substitutions"] = ",".join(_SUBSTITUTION.findall(value))
        elif kind not in ("redacted", "unsupported"):
            detail["literal"] = value[1:-1] if kind == "string" else value
        yield f"hocon:{path}:{key}:{number}", "structured-value", f"{key} = {shown}", {"line_start": number, "line_end": number, "value_kind": kind, "detail": detail}


_TS_MODULE = re.compile(r"^\s*(import|export)\b[^;]*?\bfrom\s*['\"]([^'\"]+)['\"]|^\s*import\s*['\"]([^'\"]+)['\"]", re.MULTILINE)
_TS_DECLARED = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|function|enum|type|const)\s+([A-Za-z_$][\w$]*)", re.MULTILINE)


def read_typescript(path: str, text: str) -> Iterator[tuple]:
    """Module statements and top-level declarations, found by pattern (not by a full parser)."""
    bare = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.DOTALL)
    ordinal: dict[int, int] = {}
    for found in _TS_MODULE.finditer(bare):
        line = bare.count("\n", 0, found.start() + len(found[0]) - len(found[0].lstrip())) + 1
        ordinal[line] = ordinal.get(line, -1) + 1
        last = line + found[0].strip().count("\n")
        yield f"typescript:{line}:module:{ordinal[line]}", "code-block", found[0], {"line_start": line, "line_end": last, "symbol": found[2] or found[3]}
    for found in _TS_DECLARED.finditer(bare):
        line = bare.count("\n", 0, found.start(1)) + 1
        yield f"typescript:{line}:{found[1]}", "code-block", found[0], {"line_start": line, "line_end": line, "symbol": found[2]}


_SCALA_TYPE = re.compile(r"\b(class|object|trait)\s+([A-Za-z_]\w*)")
_SCALA_DEF = re.compile(r"\b(def|val)\s+([A-Za-z_]\w*)")
_SCALA_CALL = re.compile(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*(?=[(\[{])")
_SCALA_PARAM = re.compile(r"(?:val\s+)?([a-z]\w*)\s*:\s*([A-Z]\w*)")


def _scala_code(text: str) -> str:
    """Comments and string contents blanked, offsets and lines kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r'"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/', blank, text)


def read_scala(path: str, text: str) -> Iterator[tuple]:
    """Package, imports, types with constructor parameters, methods, and ``receiver.method`` calls.

    A pattern reader over brace depth: enough for call graphs of ordinary controllers, services
    and connectors; macros, operators and implicit calls are not seen.
    """
    code = _scala_code(text)
    package = re.search(r"^\s*package\s+([\w.]+)", code, re.MULTILINE)
    name = package[1] if package else ""
    if package:
        yield f"scala:{path}:package:{name}", "structured-value", name, {"line_start": code.count("\n", 0, package.start(1)) + 1, "symbol": name, "value_kind": "package"}
    depth, owner, method, calls = 0, ("", 0), ("", 0), {}
    for number, line in enumerate(code.split("\n"), 1):
        found = re.match(r"\s*import\s+([\w.]+(?:\.\{[^}]*\})?)", line)
        if found:
            yield f"scala:{path}:import:{number}", "structured-value", found[1], {"line_start": number, "line_end": number, "symbol": found[1], "value_kind": "import"}
        kind = _SCALA_TYPE.search(line)
        if kind:
            owner = (kind[2], depth)
            after = code.split("\n", number - 1)[-1][kind.end() :]
            head = after.split("{")[0]
            detail = {"package": name, "extends": " ".join(re.findall(r"\b(?:extends|with)\s+(\w+)", head))}
            yield f"scala:{path}:{kind[1]}:{kind[2]}", "code-block", line, {"line_start": number, "line_end": number, "symbol": f"{name}.{kind[2]}".strip("."), "value_kind": kind[1], "detail": detail}
            for param, type_ in _SCALA_PARAM.findall(head):
                yield f"scala:{path}:parameter:{kind[2]}.{param}", "structured-value", f"{param}: {type_}", {"line_start": number, "symbol": kind[2], "value_kind": "parameter", "detail": {"name": param, "type": type_}}
        else:
            made = _SCALA_DEF.search(line)
            if made and owner[0] and depth == owner[1] + 1:
                method = (made[2], depth)
                yield f"scala:{path}:{made[1]}:{owner[0]}.{made[2]}:{number}", "code-block", line, {"line_start": number, "line_end": number, "symbol": f"{owner[0]}.{made[2]}", "value_kind": made[1]}
        if owner[0] and method[0]:
            for target, called in _SCALA_CALL.findall(line):
                index = calls[(method[0], number)] = calls.get((method[0], number), -1) + 1
                detail = {"owner": owner[0], "method": method[0], "receiver": target, "called": called, "index": str(index)}
                yield f"scala:{path}:call:{owner[0]}.{method[0]}:{number}:{index}", "structured-value", f"{target}.{called}", {"line_start": number, "line_end": number, "symbol": f"{owner[0]}.{method[0]}", "value_kind": "call", "detail": detail}
        depth += line.count("{") - line.count("}")


PROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "markdown": lambda docs: per_document(docs, read_markdown),
    "plain-text": plain_text,
    "json": lambda docs: per_document(docs, read_json),
    "yaml": lambda docs: per_document(docs, read_yaml),
    "dockerfile": dockerfile,
    "play-routes": play_routes,
    "hocon": lambda docs: per_document(docs, read_hocon, bounded=True),
    "typescript": lambda docs: per_document(docs, read_typescript),
    "scala-source": lambda docs: per_document(docs, read_scala, bounded=True),
}


def processor_of(path: Column) -> Column:
    """The processor of a path by its last extension or its exact name; null if none supports it."""
    name, out = F.lower(filename(path)), F.lit(None).cast("string")
    for how, text, processor, _ in reversed(DEFINITIONS):
        out = F.when((name == text) if how == "exact" else (extension(filename(path)) == text), processor).otherwise(out)
    return out


def process(docs: DataFrame) -> DataFrame:
    """Evidence of all documents: each goes to its processor; others give nothing."""
    chosen = docs.withColumn("processor", processor_of(F.col("path")))
    parts = [run(chosen.where(F.col("processor") == name)) for name, run in PROCESSORS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
